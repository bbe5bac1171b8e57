"""Compression-distance toxicity: held-out quality and edge cases."""

import random
import zlib

import numpy as np
from fixture_docs import corpus, empty, frame, prose

from latentforge.llm import toxicity as tx
from latentforge.llm.textblock import Block

BAD = ["blorgish", "vrentok", "quazzle", "smerdling"]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def labelled(n=420, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words, toxic = prose(rng, rng.randint(20, 160)).split(), rng.random() < .3
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def run(spark, docs, labels, parts=3):
    got = tx.score_toxicity(
        spark.createDataFrame([(i, t, 0.5, "x") for i, t in docs],
                              "doc_id long, text string, score double, toxic string").repartition(parts),
        spark.createDataFrame([(i, y, "en") for i, y in labels], "doc_id long, toxic int, text string"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    return got.collect()


def test_held_out_quality_and_contract(spark):
    docs, labels = labelled()
    y = dict(labels)
    got = run(spark, docs + [(900, None), (901, ""), (902, "  \n"), docs[0], (None, "a text")], labels)
    assert len(got) == len(docs) + 5
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    out = [r for r in got if r.held_out and r.doc_id in y]
    score, label = np.array([r.score for r in out]), np.array([y[r.doc_id] == 1 for r in out])
    assert tx.rank_quality(score, label) > 0.95
    right = np.mean([(r.predicted == 1) == (y[r.doc_id] == 1) for r in out])
    assert right > 0.9
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by_id.values())
    assert by_id[900] == by_id[901] == by_id[902]


def test_scores_do_not_depend_on_partitions(spark):
    docs, labels = labelled(150)
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in run(spark, docs, labels, p)) for p in (1, 7))
    assert a == b


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = labelled(200)
    flipped = [(i, 1 - t if held(i) else t) for i, t in labels]
    a, b = (sorted((r.doc_id, r.score) for r in run(spark, docs, x)) for x in (labels, flipped))
    assert a == b


def test_long_texts_and_repeated_labels(spark):
    docs, labels = labelled(200)
    docs.append((5000, "x" * 40000 + " blorgish " * 30))
    twice = labels + labels[:50] + [(i, None) for i, _ in labels[:20]]
    assert sorted((r.doc_id, r.score) for r in run(spark, docs, twice)) == sorted(
        (r.doc_id, r.score) for r in run(spark, docs, labels))


def test_windows_cover_words():
    text = b"ab " + b"x" * 200 + b" c"
    start, end, doc = tx.windows(Block(0, np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    seen = np.zeros(len(text), bool)
    for a, b in zip(start, end):
        assert 0 < b - a <= tx.PIECE
        seen[a:b] = True
    assert seen.tolist() == [c != 32 for c in text] and (doc == 0).all()


def test_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.score_toxicity(empty(spark), labels).collect() == []
    rows = corpus()
    got = tx.score_toxicity(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.0}
    one = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, toxic int")
    assert {r.score for r in tx.score_toxicity(frame(spark, rows), one).collect()} == {0.0}
