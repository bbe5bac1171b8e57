"""Ranked search by the automaton scan, against counting by hand."""

import math
import re
from collections import Counter

import pytest
from fixture_docs import corpus, empty, frame

from latentforge.llm import term_scan

TERM = re.compile(term_scan.TERM)
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(rows, items):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    n_docs = sum(bool(c) for _, c in docs)
    n_terms = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, Counter()).update(terms(text))
    out = []
    for item, counts in wanted.items():
        found = []
        for i, c in docs:
            m = 25 + 75 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in counts.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:10])]
    return sorted(out, key=repr)


ITEMS = [(1, "River STONE light; light"), (2, None), (3, ""), (4, "…"), (5, "é one-two 123"),
         (6, "notaword"), (7, "aé ab a"), (7, "River"), (None, "bread winter"),
         (9, " ".join(["the of and river stone light paper house garden window"] * 3))]


def run(spark, rows, items):
    got = term_scan.search(frame(spark, rows), spark.createDataFrame(
        [(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, doc_id long"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


def test_ranks_equal_counting(spark):
    rows = corpus()
    assert run(spark, rows, ITEMS) == by_hand([r[:2] for r in rows], ITEMS)


def test_many_blocks_and_items_beyond_a_block(spark, monkeypatch):
    """Items in blocks of their own, and one cut by its terms."""
    monkeypatch.setattr(term_scan, "BLOCK_BYTES", 120)
    monkeypatch.setattr(term_scan, "CELLS", 16)
    rows = corpus(3)
    whole, cut = term_scan.dealt(term_scan.item_terms(
        spark.createDataFrame(ITEMS, "item_id long, text string")))
    assert len(whole) > 1 and len(cut) == 1 and len(cut[0]) > 1
    for part in whole + [p for c in cut for p in c]:
        assert sum(len(t.encode()) + 16 for _, t, _ in part) <= 120
    assert run(spark, rows, ITEMS) == by_hand([r[:2] for r in rows], ITEMS)


def test_ties_go_to_the_least_id(spark):
    rows = [(i, "same text here", None, None, None, None, None, None, None, None)
            for i in range(40, 0, -1)] + [(77, "other", *[None] * 8)]
    got = run(spark, rows, [(1, "same")])
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(1, 11))
    assert len({r[3] for r in got}) == 1


def test_boundaries():
    """Hits are whole terms; neighbours share the byte between them."""
    import numpy as np

    from latentforge.llm.textblock import Block
    t = term_scan.Terms([(1, "ab", 1), (1, "é", 2), (2, "b", 1)])
    texts = ["ab ab,ab", "abab xb", "É é", "", "b"]
    data = "".join(texts).encode()
    off = np.cumsum([0] + [len(x.encode()) for x in texts])
    doc, term, tf, n = t.counts(Block(0, np.frombuffer(data, np.uint8), off))
    assert [*zip(doc.tolist(), term.tolist(), tf.tolist())] == [(0, 0, 3), (2, 2, 1), (4, 1, 1)]
    assert n.tolist() == [3, 2, 2, 0, 1]


@pytest.mark.parametrize("rows, items", [([], ITEMS), (None, []), ([(1, None, *[None] * 8)], ITEMS)])
def test_empty(spark, rows, items):
    docs = corpus() if rows is None else rows
    assert run(spark, docs, items) == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert term_scan.search(empty(spark), nothing).collect() == []
