"""The pipeline and the registered queries."""

import random

import pytest
from fixture_docs import SCHEMA, corpus, prose
from test_dedup import LOWER, brute_components, brute_cut
from test_models import measure
from test_tokens import check_pieces

import __spark_entry__
import corpus_pipeline
from latentforge.llm.common import join_back, maybe_in
from latentforge.session import new_scratch_path, scratch_path


def write(spark, rows):
    """A data folder with the documents, inside the shared folder."""
    path = new_scratch_path(spark, "sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path + "/documents.parquet")
    return path


def brute_quality(rows):
    """Measures and shrunk host rates by plain Python."""
    hosts, failed = {}, {}
    for r in rows:
        words, _, symbols, dup, _, base = measure(r[1])
        lines = sum(1 for x in (r[1] or "").split("\n") if x.strip(" \t\n\x0b\f\r"))
        failed[r[0]] = base or 100 * symbols > 50 * words or 100 * dup > 50 * lines
        n, f = hosts.get(r[3], (0, 0))
        hosts[r[3]] = (n + 1, f + failed[r[0]])
    rates = [f / n for n, f in hosts.values()]
    m = sum(rates) / len(rates)
    v = sum((x - m) ** 2 for x in rates) / len(rates)
    k = m * (1 - m) / v - 1 if 0 < v < m * (1 - m) else None
    rate = {h: (f + m * k) / (n + k) if k is not None else (f / n if v else m)
            for h, (n, f) in hosts.items()}
    return [r for r in rows if not failed[r[0]] and not rate[r[3]] * 100 > 50]


def brute_pipeline(rows):
    rows = brute_quality(rows)
    last = {}
    for r in rows:
        last[(r[1] or "").translate(LOWER)] = max(r[0], last.get((r[1] or "").translate(LOWER), -1))
    rows = [r for r in rows if last[(r[1] or "").translate(LOWER)] == r[0]]
    comp = brute_components(rows)
    rows = [r for r in rows if comp[r[0]] == r[0]]
    return rows


def pipeline_rows():
    rng = random.Random(9)
    rows = [r for r in corpus(5, 25) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    passage = prose(rng, 120)
    for i in range(8):
        rows.append((900 + i, prose(rng, 40) + " " + passage + "\n" + prose(rng, 60), "en",
                     "src1", 1, None, "u", None, None, "z"))
    # a host whose documents are bad
    rows += [(2000 + i, "too short", "en", "spam", 1, None, "u", None, None, "z") for i in range(30)]
    rows.append((2100, prose(rng, 120), "en", "spam", 1, None, "u", None, None, "z"))
    return rows


def test_pipeline_equals_brute_force(spark):
    rows = pipeline_rows()
    want = brute_pipeline(rows)
    assert 2100 not in {r[0] for r in want} and len(want) > 20
    path, docs = write(spark, rows), None
    docs = spark.read.parquet(path + "/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, path), name)
        assert docs.columns == columns
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted((r[0], r[1]) for r in want)
    cut = corpus_pipeline.materialize(corpus_pipeline.STAGES[3][1](spark, docs, path), "cut")
    assert cut.columns == columns
    sizes = {k[0]: (k[1], k[2]) for k in brute_cut(want)}
    left = cut.collect()
    assert any(removed for _, removed in sizes.values())
    for r in left:
        if all(ord(c) < 128 for c in next(x[1] for x in want if x[0] == r.doc_id)):
            n, removed = sizes[r.doc_id]
            assert len(r.text) == n - removed
            assert r.n_chars is None or not removed or r.n_chars == len(r.text)
    out = corpus_pipeline.run(spark, path).collect()
    check_pieces([(r.doc_id, r.text) for r in left], out)


def test_pipeline_keeps_one_row_of_repeats_and_null_ids(spark):
    """Repeated rows, copies without an id, ids on two texts, near copies
    without ids: one row of each group stays, with its text."""
    rng = random.Random(4)
    rest = SCHEMA.count(",") - 1

    def row(i, text):
        return (i, text, "en", "src1", *[None] * (rest - 2))

    def near(text):
        return text + " ending"

    texts = [prose(rng, 150) for _ in range(8)]
    rows = [row(1, texts[0])] * 3                                  # the same row thrice
    rows += [row(2, texts[1]), row(None, texts[1]), row(None, texts[1].replace("s", "S"))]
    rows += [row(None, texts[2])] * 2                              # no id at all
    rows += [row(3, texts[3]), row(3, texts[4]), row(4, texts[3])]  # one id, two texts
    rows += [row(None, texts[5]), row(None, near(texts[5]))]       # near copies without ids
    rows += [row(5, texts[6]), row(5, near(texts[6])), row(None, near(near(texts[6])))]
    rows += [row(6, texts[7])]
    path = write(spark, rows)
    docs = spark.read.parquet(path + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = corpus_pipeline.materialize(stage(spark, docs, path), name)
    left = sorted(((r.doc_id, r.text.lower()) for r in docs.collect()), key=str)
    want = [(1, texts[0]), (2, texts[1]), (None, texts[2]), (4, texts[3]), (3, texts[4]),
            (None, texts[5]), (None, near(texts[5])), (5, texts[6]), (5, near(texts[6])),
            (None, near(near(texts[6]))), (6, texts[7])]
    assert left == sorted(((i, t.lower()) for i, t in want), key=str)
    docs = corpus_pipeline.materialize(corpus_pipeline.STAGES[2][1](spark, docs, path), "near")
    left = docs.collect()
    groups = [next(k for k, t in enumerate(texts) if r.text.lower().startswith(t.lower()))
              for r in left]
    assert sorted(groups) == list(range(8))
    assert {k: r.doc_id for k, r in zip(groups, left, strict=True)} == {
        0: 1, 1: 2, 2: None, 3: 4, 4: 3, 5: None, 6: 5, 7: 6}
    cut = corpus_pipeline.materialize(corpus_pipeline.STAGES[3][1](spark, docs, path), "cut")
    assert sorted(r.text for r in cut.collect()) == sorted(r.text for r in left)
    out = corpus_pipeline.run(spark, path).collect()
    check_pieces([(r.doc_id, r.text) for r in left], out)


def test_pipeline_of_nothing(spark):
    assert corpus_pipeline.run(spark, write(spark, [])).count() == 0


def test_stages_are_the_given_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names
    assert {"op2_host_quality_rules", "op4_exact_dedup_index", "op12_aho_corasick_search",
            "op13_conversation_prefix_trie"} <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", ["op4_exact_dedup_index", "op7_licence_scan"])
def test_queries_return_a_row_per_document(spark, name):
    rows = corpus(3, 10)
    out = __spark_entry__.queries()[name](spark, write(spark, rows))
    assert out.count() == len(rows)


def test_join_back_with_hot_and_missing_keys(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(6000)]
                                + [(-1, None), (-2, "absent")], "id long, k string")
    small = big.filter("k is not null and k <> 'absent'").groupBy("k").count().selectExpr(
        "k", "count as n", "length(k) as v")
    inner = join_back(big, small, "k", "n", big["id"]).collect()
    assert len(inner) == 6000 and all(r.v == len(r.k) for r in inner)
    left = join_back(big, small, "k", "n", big["id"], "left").collect()
    assert len(left) == 6002 and sorted(r.id for r in left if r.v is None) == [-2, -1]


def test_bitmap_keeps_every_member(spark):
    big = spark.range(0, 20000).withColumnRenamed("id", "k")
    small = big.filter("k % 97 = 0")
    kept = {r.k for r in maybe_in(big, small, "k").collect()}
    assert {r.k for r in small.collect()} <= kept and len(kept) < 1000


def test_helper_tables_go(spark):
    """After a run only its result is left in the shared folder."""
    import os
    path = write(spark, corpus(2, 20))
    folder = scratch_path(spark, "").replace("file:", "")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, path)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("stage-packing")
    assert out.count() > 0


def test_helper_tables_stay_while_they_are_read(spark):
    """A stage called on a result that was not written leaves its tables."""
    path = write(spark, corpus(2, 20))
    docs = spark.read.parquet(path + "/documents.parquet")
    lazy = corpus_pipeline.exact_dedup(spark, docs, path)
    near = corpus_pipeline.near_dedup(spark, lazy, path)
    assert near.count() > 0 and lazy.count() > 0
