"""Exact, near and suffix de-duplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixture_docs import corpus, empty, frame

from latentforge.llm import near_dedup as near
from latentforge.llm import suffix_dedup as suffix
from latentforge.llm.common import components, width
from latentforge.llm.exact_dedup import DigestIndex, exact_dedup, keep_exact, with_digest
from latentforge.llm.textblock import Block
from latentforge.session import new_scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    parent = {d: d for d, _ in sets}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(parent, a), find(parent, b)))
                parent[q] = p
    return {d: find(parent, d) for d in parent}


def test_exact_matches_grouping(spark):
    rows = corpus()
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in exact_dedup(frame(spark, rows), batches=3).collect())
    assert got == want


def test_exact_index_persists_and_earlier_batches_win(spark):
    path = new_scratch_path(spark, "index")
    first = spark.createDataFrame([(1, "A b"), (2, "c")], "doc_id long, text string")
    later = spark.createDataFrame([(8, "a B"), (9, "new"), (7, "new")], "doc_id long, text string")
    index = DigestIndex(spark, path, width(spark))
    index.append(with_digest(first))
    index.close()
    index = DigestIndex(spark, path, width(spark))  # opened anew
    index.append(with_digest(later))
    assert sorted(r.keep_id for r in index.rows().collect()) == [1, 2, 9]
    plan = index.verdicts(with_digest(later))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "SelectedBucketsCount" in plan
    index.close()


def test_keep_exact_keeps_columns_and_one_text_each(spark):
    rows = [r for r in corpus() if r[0] is not None]
    out = keep_exact(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    texts = Counter((r.text or "").translate(LOWER) for r in out.dropDuplicates(["doc_id"]).collect())
    assert max(texts.values()) == 1
    assert set(texts) == {(r[1] or "").translate(LOWER) for r in rows}


def test_near_matches_brute_force(spark):
    rows = corpus()
    want = brute_components(rows)
    got = near.near_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
            continue
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
    sizes = {r[0]: len(shingles(r[1])) for r in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)


@pytest.mark.parametrize("block", [1 << 18, 300])
def test_near_large_group_in_blocks(spark, monkeypatch, block):
    """One group of many distinct near copies, dealt to several blocks."""
    monkeypatch.setattr(near, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(near, "CELLS", 1 << 12)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for d in range(60):
        words = list(base)
        for at in rng.integers(0, 90, rng.integers(0, 4)):
            words[at] = f"x{rng.integers(0, 40)}"
        rows.append((d, " ".join(words)))
    want = brute_components(rows)
    got = near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_signature_recall_and_selectivity():
    """Pairs at the threshold share a table; unrelated sets do not."""
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 170, dtype=np.uint64)
        for _ in range(2):
            sets.append(np.concatenate([both, rng.integers(0, 1 << 63, 15, dtype=np.uint64)]))
    off = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    same = near.signature(np.concatenate(sets), off)
    agree = (same[0::2] == same[1::2]).sum(1)
    assert (agree >= 2).all()
    assert ((same[0:-1:2] == np.roll(same[1::2], 1, 0)).sum(1) < 2).all()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(5, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {
        **{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_cut(rows, n=400):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[i:i + n] for d in data for i in range(len(d) - n + 1))
    out = Counter()
    for r, d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[d[i:i + n]] > 1:
                gone[i:i + n] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out[(r[0], len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_suffix_matches_brute_force(spark, batches, monkeypatch):
    rows = corpus(seed=batches, n=25)
    real = suffix.suffix_dedup
    monkeypatch.setattr(suffix, "suffix_dedup", lambda d, **kw: real(d, batches, **kw))
    got = Counter(tuple(r) for r in suffix.repeated_bytes(
        frame(spark, rows)).drop("n_shared_passages").collect())
    assert got == brute_cut(rows)


def test_anchors_are_shared_by_equal_windows():
    rng = np.random.default_rng(1)
    for _ in range(20):
        part = rng.integers(97, 101, 700, dtype=np.uint8)
        left = rng.integers(97, 101, rng.integers(0, 500), dtype=np.uint8)
        data = np.concatenate([left, part, part[:650]])
        off = np.array([0, len(left) + 700, len(data)])
        doc, at, lo, hi, gram, ctx = suffix.anchors(Block(0, data, off), suffix.Prefix(data))
        of = {}
        for d, a, x, y in zip(doc, at, lo, hi, strict=True):
            for p in range(x, y + 1):
                of[p] = a - p
        second = off[1]
        for k in range(650 - 400 + 1):
            assert of[len(left) + k] == of[second + k]
        n_windows = sum(max(0, b - a - 399) for a, b in zip(off[:-1], off[1:], strict=True))
        assert len(of) == n_windows


def test_cut_repeats_changes_text_only(spark):
    rows = [r for r in corpus(2, 20) if r[0] is not None]
    docs = frame(spark, rows)
    out = suffix.cut_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    want = {k[0]: k[4] for k in brute_cut(rows)}
    for r in out.collect():
        if r.text is not None and all(ord(c) < 128 for c in r.text):
            had = next(x[1] for x in rows if x[0] == r.doc_id)
            if all(ord(c) < 128 for c in had):
                assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id]


@pytest.mark.parametrize("op", [exact_dedup, near.near_dedup, suffix.repeated_bytes])
def test_empty_table(spark, op):
    assert op(empty(spark)).count() == 0


def test_near_at_a_lower_threshold(spark):
    """Pairs between 0.80 and 0.85 are linked at 80 and not at 85."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(12):
        base = [f"w{k}_{i}" for i in range(160)]
        other = list(base)
        for at in (20, 75, 130):  # 15 of 156 shingles: 141 / 171 = 0.82
            other[at] = f"x{rng.integers(0, 1000)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at80 = {r.doc_id: r.component_id for r in near.near_dedup(docs, 80).collect()}
    assert at80 == {d: d // 2 * 2 for d, _ in rows}
    at85 = {r.doc_id: r.component_id for r in near.near_dedup(docs, 85).collect()}
    assert at85 == {d: d for d, _ in rows}
    assert near.keep_near(docs, 80).count() == 12


def test_collections_bound_the_missed_pairs():
    assert near.collections_for(85) == near.COLLECTIONS and near.collections_for(80) == 14
    assert near.missed(80, 14) < 2e-5 < 2.5e-4 < near.missed(80, 11)


def test_shared_passages(spark):
    """One at least for 50 words in a row that another document has too, none
    without 26 such words."""
    import random
    rng = random.Random(8)
    rows = corpus(5)
    fresh = [f"{w}{k}" for k in range(60) for w in ("al", "be", "ga", "de", "ep")]
    start = len(rows) + 100
    for j, n in enumerate((24, 26, 40, 49, 50, 51, 90)):
        shared = [f"p{j}x{i}" for i in range(n)]
        for k in range(2):
            mine = [f"{w}{j}{k}" for w in rng.sample(fresh, 120)]
            words = mine[:30 + k] + shared + mine[30 + k:]
            rows.append((start + 2 * j + k, "\n".join(words), *[None] * 8))
    got = {}
    for r in suffix.repeated_bytes(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r.n_shared_passages)

    def runs(text, n):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}

    for n, least in ((50, True), (26, False)):
        own = [runs(r[1], n) for r in rows]
        seen = Counter(x for s in own for x in s)
        for r, s in zip(rows, own):
            shares = any(seen[x] > 1 for x in s)
            if least and shares:
                assert min(got[r[0]]) >= 1, r[0]
            if not least and not shares:
                assert max(got[r[0]]) == 0, r[0]


def test_index_opened_again_under_another_width(spark, tmp_path):
    """The buckets are those the index was made with: all texts stay known."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    digests = with_digest(docs)
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (8, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            index = DigestIndex(spark, str(tmp_path / "index"), n)
            assert index.buckets == 8
            index.append(digests)
            assert index.rows().count() == 400
            assert index.verdicts(digests).count() == 400
            index.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_column_of_the_row_key_s_name_stays(spark):
    rows = [(i, f"a text of some words number {i % 5}", f"v{i}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    for keep in (keep_exact, near.keep_near):
        out = keep(docs)
        assert out.columns == docs.columns
        assert {r["_row"] for r in out.collect()} <= {f"v{i}" for i in range(10)}
        assert all(r["_row"] == f"v{r['doc_id']}" for r in out.collect()) and out.count() == 5


def test_cut_repeats_takes_short_passages_out(spark):
    """A passage of 55 words in two texts goes although it is under 400 bytes; 49
    words, a passage repeated in one text only, and copies of a short text stay."""
    rng = random.Random(8)

    def words(n):
        return " ".join(f"{rng.randrange(16 ** 5):x}" for _ in range(n))

    long, short, own, copy = words(55), words(49), words(52), words(51)
    a, b, c, d = (words(30) for _ in range(4))
    assert len(long) < 400
    texts = [f"{a} {long} {b}", f"{c}\n{long.replace(' ', chr(10), 3)}\té", f"{short} {d}",
             f"{b} {short}", f"{own} {a[:40]} {own}", copy, copy, None, ""]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_chars long")
    left = {r.doc_id: r.text for r in suffix.cut_repeats(docs, passages=True).collect()}
    want = dict(enumerate(texts)) | {0: f"{a}  {b}", 1: f"{c}\n\té"}
    assert left == want
    plain = {r.doc_id: r.text for r in suffix.cut_repeats(docs).collect()}
    assert plain == dict(enumerate(texts))
