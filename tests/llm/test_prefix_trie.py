"""Prefix trie of rebuilt conversations, against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from latentforge.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, key string, d long, len string"


def by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    nodes = defaultdict(list)
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(full[c]) + 1):
            nodes[full[c][:d]].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        size = len(p[-1][1].encode()) if p else 0
        saved[p] = (len(nodes[p]) - 1) * size + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if full[c] == p)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members),
                    len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    got = pt.prefix_trie(spark.createDataFrame([(*r, "k", 3, None) for r in rows], SCHEMA)
                         .repartition(3))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                           "saved_tokens", "ends_sha256"]
    assert all(t == "bigint" for c, t in got.dtypes if c != "ends_sha256")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def talks(seed, n=60, long=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < .15:
            continue
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", None]),
                         rng.choice(["hi", "é", "", None, "a longer text", f"only {c}"])))
    # a third of all conversations are the same; their bases too
    for c in range(100, 140):
        rows += [(c, t, "user", "same") for t in range(10)]
    rows += [(300, t, "user", f"turn {t % 3}") for t in range(long)]
    rows += [(-3, 0, "user", "below zero"), (-3, None, "x", "first"), (201, 5, "user", "no base")]
    rows += [(None, 0, "user", "no conversation")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_nodes_equal_a_dictionary(spark, seed):
    rows = talks(seed)
    assert run(spark, rows) == by_hand(rows)


def test_conversation_beyond_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 7)
    monkeypatch.setattr(pt, "IDS", 5)
    monkeypatch.setattr(pt, "FLUSH", 50)
    rows = talks(2, 30, long=60)
    assert run(spark, rows) == by_hand(rows)


def test_full_sketch_changes_nothing(spark, monkeypatch):
    """Where the sketch proves no singleton, all goes the exact way."""
    rows = talks(3, 40)
    monkeypatch.setattr(pt, "buckets", lambda hi, lo, width: np.zeros((pt.ROWS, len(hi)), np.int64))
    assert run(spark, rows) == by_hand(rows)


def test_sketch_never_counts_too_few(spark):
    keys = spark.range(3000).selectExpr(
        "named_struct('hi', xxhash64(id % 2000), 'lo', xxhash64(1, id % 2000)) as key").repartition(5)
    width = pt.MIN_WIDTH
    packed = pt.count_min(keys, width)
    got = keys.distinct().collect()
    hi, lo = (np.array([r["key"][c] for r in got]) for c in ("hi", "lo"))
    at = pt.buckets(hi, lo, width)
    least = np.stack([packed[r][at[r] >> 2] >> ((at[r] & 3) << 1) & 3 for r in range(pt.ROWS)]).min(0)
    once = {(r["key"]["hi"], r["key"]["lo"]) for r in keys.groupBy("key").count()
            .filter("count = 1").collect()}
    true = np.array([1 if (a, b) in once else 2 for a, b in zip(hi.tolist(), lo.tolist())])
    assert (least >= true).all() and (least == true).mean() > 0.99


def test_repeated_turns_ties_single_and_empty(spark):
    assert run(spark, []) == []
    rows = [(5, 0, "user", "a"), (5, 0, "user", "a"), (5, 1, None, None)]
    assert run(spark, rows) == by_hand(rows)
    tied = [(5, 0, "user", "a"), (5, 0, "user", "b"), (6, 0, "user", "b"), (6, 0, "user", "a")]
    assert run(spark, tied) == run(spark, tied[::-1])
