"""Hashed maximum-entropy language model with a class-factored softmax.

Tokens are A-Z lower-cased words plus one end per text. The model is

    p(w | h) = p(class(w) | h) * p(w | class(w), h)

over the ``CLASSES * SLOTS`` most frequent types, grouped by frequency. The first
of them stands for all other words, which are factored further: a word's
fingerprint deals it to one of ``CLASSES * SLOTS`` clusters,

    p(w | h) = ... * p(tail class | h) * p(cluster | tail class, h) * p(w | cluster)

where p(w | cluster) follows the smoothed corpus counts, with one unseen word per
cluster. So every word, seen or not, meets the history, and the probabilities add
up to one. Each of the four factors is a softmax over sums of hashed feature rows:
the previous word, the previous two words, and the words two and three back
(skips), added to logs of corpus frequencies. The rows of a factor grow with the
square root of the training tokens (``rows_for``) up to ``MOST_ROWS``, the bound of
what is broadcast; a class gets rows in proportion to its tokens and shares none.

Training: the gradient of the training texts' log likelihood is, in every cell
(row, slot), the observed minus the expected count. At the corpus frequencies the
expected count is the row's count times the slot's frequency, so a pass that counts
gives the exact gradient over all training tokens. Every task adds up the counts of
its documents; they are summed in a tree of grouped sums with at most ``FAN_IN``
arrays per task. The update is damped and scaled by the curvature (the expected
count): ``RATE * log((observed + DAMP) / (expected + DAMP))``. It is a sum over
tokens, so the model does not depend on how the documents are dealt to tasks.
Counting tasks are as many as keep their arrays smaller than the texts.

Scoring: one pass gives each document its model terms; the counts of words
with less than a ``FREQUENT``-th of all tokens are not broadcast but joined, as
(document, word, occurrences) rows.

Edge cases: null text counts as empty (the end token alone); with nothing to
learn from, counts are zero and the model is uniform over its types; repeated
rows, and ties of frequency (broken by fingerprint), are scored alike; a very
long text is a block of its own; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_path
from .common import crc_mod, materialize, recorded
from .textblock import GOLDEN, U, Block, Prefix, blocks, lists, mix, times_golden

CLASSES = SLOTS = 32
#: rows of hashed weights per factor: fewest and most
FEWEST_ROWS, MOST_ROWS = 1 << 14, 1 << 17
#: bound on the counts broadcast to the scoring tasks (16 bytes each)
FREQUENT = 1 << 17
RATE = 0.5
DAMP = 1.0
MINI_BATCH = 1 << 13
FAN_IN = 32
#: a counting task has at least so many tokens for each row of a factor
TOKENS_A_ROW = 32
#: counts and weights travel in chunks of so many rows
CHUNK = 1024
SMOOTH = 0.1
#: mass of a slot without a type: next to nothing, but with a logarithm
UNUSED = 1e-12

END = U(0)
LOG10E = float(np.log10(np.e))


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """``(type of each token, offsets)``; every document ends in END."""
    start, end, first = block.words()
    word = Prefix(block.data, lower=True).ranges(start, end)
    off = first + np.arange(block.n + 1)
    out = np.full(off[-1], END, U)
    mask = np.ones(len(out), bool)
    mask[off[1:] - 1] = False
    out[mask] = word
    return out, off


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        types, counts = [], []
        for block in blocks(batch.column("text"), 4 << 20):
            t, n = np.unique(tokens(block)[0], return_counts=True)
            types.append(t)
            counts.append(n)
        if types:
            t, at = np.unique(np.concatenate(types), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
            yield pa.record_batch([pa.array(t.view(np.int64)), pa.array(n)], names=["type", "n"])


def contexts(types: np.ndarray, off: np.ndarray) -> np.ndarray:
    """``(FEATURES, tokens)`` fingerprints of each token's history."""
    place = np.arange(len(types)) - np.repeat(off[:-1], np.diff(off))

    def back(k: int) -> np.ndarray:
        out = np.full(len(types), U(k + 1), U)
        out[k:] = np.where(place[k:] >= k, types[:len(types) - k], U(k + 1))
        return out

    one, two, three = back(1), back(2), back(3)
    return np.stack([mix(one + GOLDEN), mix(mix(one + GOLDEN) + two * U(3)),
                     mix(two + times_golden(2)), mix(three + times_golden(3))])


def rows_for(n_tokens: int) -> int:
    """Hashed rows of a factor: a power of two from four times the root of the tokens."""
    rows = FEWEST_ROWS
    while rows < MOST_ROWS and rows * rows < 16 * n_tokens:
        rows *= 2
    return rows


def cluster(types: np.ndarray) -> np.ndarray:
    """The tail cluster of each type: the top bits of its fingerprint."""
    return (types >> U(64 - CLUSTER_BITS)).astype(np.int64)


CLUSTER_BITS = (CLASSES * SLOTS - 1).bit_length()


class Level:
    """A class-factored softmax: log priors and the places of its rows.

    Row numbers from ``first`` on: ``rows`` for the class factor, then each
    class's own for the slot factor."""

    def __init__(self, mass: np.ndarray, rows: int, first: int):
        mass = mass.reshape(CLASSES, SLOTS)
        of_class = mass.sum(1)
        self.class_prior = np.log(of_class / of_class.sum()).astype(np.float32)
        self.slot_prior = np.log(mass / of_class[:, None]).astype(np.float32)
        self.class_first, self.class_rows = first, rows
        self.own = np.maximum((of_class / of_class.sum() * rows).astype(np.int64), 1)
        self.own_first = first + rows + np.cumsum(self.own) - self.own
        self.end = first + rows + int(self.own.sum())

    def row_priors(self) -> tuple[np.ndarray, np.ndarray]:
        """``(priors, which of them)`` for every row."""
        return (np.vstack([self.class_prior[None], self.slot_prior]),
                np.repeat(np.arange(CLASSES + 1), [self.class_rows, *self.own]))

    def factors(self, leaf: np.ndarray, ctx: np.ndarray):
        """Per factor: rows of each feature, the slot taken, log priors."""
        cls, slot = leaf // SLOTS, leaf % SLOTS
        h = (ctx >> U(24)).astype(np.int64)
        yield self.class_first + h % self.class_rows, cls, self.class_prior
        h = (mix(ctx) >> U(24)).astype(np.int64)
        yield self.own_first[cls] + h % self.own[cls], slot, self.slot_prior[cls]


class Model:
    """Vocabulary (sorted fingerprints and their numbers), the two levels of
    classes, weights. Type number 0 is any word of the tail.

    ``tail[0]`` and ``tail[1]`` are tokens and types of each cluster."""

    def __init__(self, top: list[tuple[int, int]], tail: np.ndarray, rows: int):
        k = CLASSES * SLOTS
        types = np.array([t for t, _ in top], np.int64).view(U)
        order = np.argsort(types)
        self.types, self.number = types[order], order + 1
        mass = np.full(k, UNUSED)
        mass[1:len(top) + 1] = [n + SMOOTH for _, n in top]
        mass[0] = tail[0].sum() + SMOOTH
        self.head = Level(mass, rows, 0)
        mass = tail[0] + SMOOTH * (tail[1] + 1)
        self.tail = Level(mass, rows, self.head.end)
        self.cluster_log = np.log10(mass)
        self.weights = np.zeros((self.tail.end, SLOTS), np.float16)

    def numbers(self, types: np.ndarray) -> np.ndarray:
        if not len(self.types):
            return np.zeros(len(types), np.int64)
        at = np.minimum(np.searchsorted(self.types, types), len(self.types) - 1)
        return np.where(self.types[at] == types, self.number[at], 0)

    def factors(self, types: np.ndarray, number: np.ndarray, ctx: np.ndarray):
        """Per factor: the tokens it is about, and ``Level.factors`` of them."""
        everyone, other = slice(None), np.flatnonzero(number == 0)
        for rows, slot, prior in self.head.factors(number, ctx):
            yield everyone, rows, slot, prior
        for rows, slot, prior in self.tail.factors(cluster(types[other]), ctx[:, other]):
            yield other, rows, slot, prior

    def log10(self, types: np.ndarray, number: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """log10 probability of the tokens after their contexts; of a word of
        the tail up to its smoothed count, log10(c + SMOOTH)."""
        out = np.zeros(len(types))
        for a in range(0, len(types), MINI_BATCH):
            to = slice(a, a + MINI_BATCH)
            part = out[to]
            for which, rows, slot, prior in self.factors(types[to], number[to], ctx[:, to]):
                logit = prior + self.weights[rows[0]]
                for r in rows[1:]:
                    logit += self.weights[r]
                logit -= logit.max(1, keepdims=True)
                taken = logit[np.arange(len(slot)), slot]
                np.exp(logit, out=logit)
                part[which] += taken - np.log(logit.sum(1))
        out *= LOG10E
        other = number == 0
        out[other] -= self.cluster_log[cluster(types[other])]
        return out

    def observe(self, counts: np.ndarray, types: np.ndarray, ctx: np.ndarray) -> None:
        """Adds the tokens to the flat ``counts`` of the cells."""
        for _, rows, slot, _ in self.factors(types, self.numbers(types), ctx):
            np.add.at(counts, (rows * SLOTS + slot).ravel(), counts.dtype.type(1))

    def update(self, row: int, observed: np.ndarray) -> np.ndarray:
        """Weights of the rows from ``row`` on, given their observed counts."""
        priors, which = zip(*(level.row_priors() for level in (self.head, self.tail)), strict=True)
        which = np.concatenate([which[0], which[1] + CLASSES + 1])[row:row + len(observed)]
        expected = observed.sum(1, keepdims=True) * np.exp(np.vstack(priors)[which])
        return (RATE * np.log((observed + DAMP) / (expected + DAMP))).astype(np.float16)


def narrow(counts: np.ndarray) -> tuple[int, bytes]:
    """Counts as bytes of the least width that holds them."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return kind.itemsize, counts.astype(kind.newbyteorder("<")).tobytes()


def widen(width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{width}").astype(np.int64)


COUNTED = "chunk int, task long, width int, data binary"


def learn_weights(docs: DataFrame, model: Model, tasks: int) -> np.ndarray:
    """The weights after the update by all of ``docs``, counted in ``tasks`` tasks."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    total, step = model.weights.size, CHUNK * SLOTS

    def rows(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        data = [narrow(c) for _, _, c in found]
        return pa.record_batch([
            pa.array([c for c, _, _ in found], pa.int32()), pa.array([t for _, t, _ in found], pa.int64()),
            pa.array([w for w, _ in data], pa.int32()), pa.array([d for _, d in data], pa.binary())],
            names=["chunk", "task", "width", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = shipped.value, np.zeros(total, np.int64)
        for batch in batches:
            for block in blocks(batch.column("text")):
                types, off = tokens(block)
                own.observe(counts, types, contexts(types, off))
        task = TaskContext.get().partitionId()
        for c in range(0, total, step):
            part = counts[c:c + step]
            if part.any():
                yield rows([(c // step, task, part)])

    def added(table: pa.Table) -> np.ndarray:
        return sum(widen(w.as_py(), d.as_py())
                   for w, d in zip(table.column("width"), table.column("data"), strict=True))

    def add(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([rows([(
            table.column("chunk")[0].as_py(), table.column("task")[0].as_py() // FAN_IN,
            added(table))])])

    def finish(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        w = shipped.value.update(chunk * CHUNK, added(table).reshape(-1, SLOTS))
        return pa.table({"chunk": pa.array([chunk], pa.int32()), "w": pa.array([w.tobytes()])})

    with recorded() as paths:
        parts = materialize(docs.select("text").coalesce(tasks).mapInArrow(run, COUNTED), "counts")
    left = tasks
    while left > FAN_IN:
        parts = parts.groupBy("chunk", F.expr(f"task div {FAN_IN}").alias("g")).applyInArrow(add, COUNTED)
        left = -(-left // FAN_IN)
    weights = np.zeros_like(model.weights)
    # at most the rows of the weights, whose number is bounded by MOST_ROWS
    for r in parts.groupBy("chunk").applyInArrow(finish, "chunk int, w binary").collect():
        w = np.frombuffer(r["w"], np.float16).reshape(-1, SLOTS)
        weights[r["chunk"] * CHUNK:r["chunk"] * CHUNK + len(w)] = w
    for path in paths:
        drop_path(docs.sparkSession, path)
    return weights


SCORED = ("uid long, doc_id long, held_out boolean, n_tokens long, known long, "
          "base double, model double, types array<long>, times array<long>")


def score_batches(batches: Iterator[pa.RecordBatch], model: Model, types: np.ndarray,
                  counts: np.ndarray, n_tokens: int, n_types: int) -> Iterator[pa.RecordBatch]:
    """Per document the terms that need no join, and its infrequent words."""
    uid = TaskContext.get().partitionId() << 36
    base_log = np.log10(n_tokens + SMOOTH * (n_types + 1))
    model = copy(model)
    model.weights = model.weights.astype(np.float32)
    for batch in batches:
        for block in blocks(batch.column("text")):
            t, off = tokens(block)
            number = model.numbers(t)
            uniq, inverse = np.unique(t, return_inverse=True)
            c = np.zeros(len(uniq), np.int64)
            if len(types):
                at = np.minimum(np.searchsorted(types, uniq), len(types) - 1)
                c = np.where(types[at] == uniq, counts[at], 0)
            c = c[inverse]
            log_c = np.where(c > 0, np.log10(c + SMOOTH), 0.0)
            other = number == 0
            terms = model.log10(t, number, contexts(t, off)) + np.where(other, log_c, 0.0)
            # infrequent words with their occurrences, by document
            rare = np.flatnonzero(c == 0)
            doc = np.searchsorted(off, rare, "right") - 1
            order = np.lexsort((t[rare], doc))
            d, w = doc[order], t[rare][order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
            first = np.flatnonzero(new)
            per_doc = np.bincount(d[first], minlength=block.n)
            yield pa.record_batch([
                pa.array(np.arange(uid, uid + block.n)),
                batch.column("doc_id").slice(block.row0, block.n),
                batch.column("held_out").slice(block.row0, block.n),
                pa.array(np.diff(off)), pa.array(np.add.reduceat((c > 0).astype(np.int64), off[:-1])),
                pa.array(np.add.reduceat(log_c - base_log, off[:-1])),
                pa.array(np.add.reduceat(terms, off[:-1])),
                lists(w[first].view(np.int64), per_doc, pa.int64()),
                lists(np.diff(np.append(first, len(d))), per_doc, pa.int64())],
                names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "model",
                       "types", "times"])
            uid += block.n


def score_corpus(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``:
    a tenth of the documents (crc32 of the id, modulo 10, is 0) is held out."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text",
                       (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"))
    learn = docs.filter(~F.col("held_out"))
    counts = materialize(
        learn.select("text").mapInArrow(count_tokens, "type long, n long")
        .groupBy("type").agg(F.sum("n").alias("n")), "token-counts")
    n_types, n_tokens = counts.agg(F.count("*"), F.sum("n")).first()
    n_tokens = n_tokens or 0
    # at most FREQUENT types can have a FREQUENT-th of all tokens each
    top = sorted(((r[0], r[1]) for r in counts.filter(
        F.col("n") * FREQUENT >= F.lit(n_tokens)).select("type", "n").collect()),
        key=lambda x: (-x[1], x[0]))
    head, k = top[:CLASSES * SLOTS - 1], CLASSES * SLOTS
    tail = np.zeros((2, k), np.int64)
    by_cluster = counts.groupBy(F.shiftrightunsigned("type", 64 - CLUSTER_BITS).alias("at")).agg(
        F.sum("n").alias("n"), F.count("*").alias("types"))
    for r in by_cluster.collect():  # a row per cluster
        tail[:, r["at"]] = r["n"], r["types"]
    at = cluster(np.array([t for t, _ in head], np.int64).view(U))
    np.subtract.at(tail, (0, at), np.array([n for _, n in head], np.int64))
    np.subtract.at(tail, (1, at), 1)
    rows = rows_for(n_tokens)
    model = Model(head, tail, rows)
    model.weights = learn_weights(learn, model, max(1, int(n_tokens / (TOKENS_A_ROW * rows))))
    types = np.array([t for t, _ in top], np.int64).view(U)
    order = np.argsort(types)
    shipped = spark.sparkContext.broadcast(
        (model, types[order], np.array([n for _, n in top], np.int64)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return score_batches(batches, *shipped.value, n_tokens, n_types)

    scored = materialize(docs.mapInArrow(run, SCORED), "scored")
    rare = scored.select("uid", F.explode(F.arrays_zip("types", "times")).alias("r")).select(
        "uid", F.col("r.types").alias("type"), F.col("r.times").alias("times"))
    found = rare.join(counts.hint("merge"), "type", "left").groupBy("uid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        # the base term was taken without the count: log10(c + 0.1) is added
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(found.hint("merge"), "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))
