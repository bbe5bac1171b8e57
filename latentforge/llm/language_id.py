"""Language identification by a bidirectional gated recurrent network over bytes.

A byte's row of the input table, the state of the bytes before it and the state
of the bytes after it give the byte's language probabilities; a document takes
the mean over all of its bytes. The network is trained in numpy by
backpropagation through time.

Texts are cut into segments of ``SEGMENT`` bytes that cover the whole text (the
states start at zero in each), and many segments run side by side: memory is
that of one block, whatever the length of a text.

Training takes at most ``SAMPLE`` rows per language, the ones with the least
hash of id and text (a documented bound), and learns on random segments of them,
from anywhere in the text; the
weights are a few kilobytes and are broadcast. Every text is labelled whole.

Edge cases: null text, or text without a letter, is ``und`` with score 0; with
no labelled row to learn from every text is ``und``; one language gives score 1;
repeated rows are labelled alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_mod
from .textblock import Block, blocks

HIDDEN = 8
SEGMENT = 96
#: labelled rows per language, and bytes of each that are learned from
SAMPLE = 300
SAMPLE_BYTES = 6 * SEGMENT
#: updates, and segments of each
UPDATES = 200
BATCH = 384
RATE = 0.03
#: segments that run side by side
LANES = 4096


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGRU:
    """Two directions of ``h' = (1 - z) h + z tanh(x + r (U h))``, joined by a
    softmax at each position."""

    def __init__(self, n_labels: int, seed: int = 0, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, hidden ** -0.5, (hidden, 3 * hidden)).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.3, (2 * hidden, n_labels)).astype(np.float32)
        self.p["c"] = np.zeros(n_labels, np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States ``(T, B, H)`` for bytes ``x (T, B)``; masked steps keep the
        state. ``keep`` receives what the backward pass needs."""
        k, table, u = self.hidden, self.p["x" + d], self.p["u" + d]
        out = np.zeros((*x.shape, k), np.float32)
        h = np.zeros((x.shape[1], k), np.float32)
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        for t in steps:
            a, g = table[x[t]], h @ u
            zr = sigmoid(a[:, :2 * k] + g[:, :2 * k])
            z = zr[:, :k] * mask[t][:, None]
            r = zr[:, k:]
            n = np.tanh(a[:, 2 * k:] + r * g[:, 2 * k:])
            if keep is not None:
                keep.append((t, h, g[:, 2 * k:], zr[:, :k], z, r, n))
            h = h + z * (n - h)
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Label probabilities ``(T, B, L)`` of every position."""
        k = self.hidden
        logit = self.run(x, mask, "f") @ self.p["o"][:k]
        logit += self.run(x, mask, "b") @ self.p["o"][k:]
        logit += self.p["c"]
        logit -= logit.max(2, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(2, keepdims=True)
        return logit

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean cross-entropy over positions, by backpropagation
        through time."""
        k, keep = self.hidden, {"f": [], "b": []}
        states = {d: self.run(x, mask, d, keep[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], 2)
        logit = both @ self.p["o"] + self.p["c"]
        logit -= logit.max(2, keepdims=True)
        e = np.exp(logit)
        p = e / e.sum(2, keepdims=True)
        self.loss = float(-(np.log(p[:, np.arange(x.shape[1]), y] + 1e-9) * mask).sum() / mask.sum())
        p[:, np.arange(x.shape[1]), y] -= 1
        p *= (mask / mask.sum())[:, :, None]
        g = {n: np.zeros_like(v) for n, v in self.p.items()}
        g["o"] = np.einsum("tbh,tbl->hl", both, p)
        g["c"] = p.sum((0, 1))
        back = p @ self.p["o"].T
        for d, part in (("f", back[:, :, :k]), ("b", back[:, :, k:])):
            u, dh = self.p["u" + d], np.zeros((x.shape[1], k), np.float32)
            for t, h, gn, z0, z, r, n in reversed(keep[d]):
                dh = dh + part[t]
                dn = dh * z * (1 - n * n)
                dz = dh * (n - h) * mask[t][:, None] * z0 * (1 - z0)
                dr = dn * gn * r * (1 - r)
                da = np.concatenate([dz, dr, dn], 1)
                dg = np.concatenate([dz, dr, dn * r], 1)
                np.add.at(g["x" + d], x[t], da)
                g["u" + d] += h.T @ dg
                dh = dh * (1 - z) + dg @ u.T
        return g


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, document)`` of the segments that cover the documents."""
    n = -(-np.diff(off) // SEGMENT)
    doc = np.repeat(np.arange(len(off) - 1), n)
    start = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * SEGMENT
    return start, np.minimum(start + SEGMENT, off[doc + 1]), doc


def lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Bytes ``(T, B)`` of segments side by side, and which are there."""
    at = start + np.arange(SEGMENT)[:, None]
    mask = at < end
    return data[np.minimum(at, len(data) - 1)], mask.astype(np.float32)


def train(pieces: list[bytes], labels: np.ndarray, n_labels: int, seed: int = 0) -> ByteGRU:
    """Adam on mini-batches of segments, deterministic for the same rows."""
    net, rng = ByteGRU(n_labels, seed), np.random.default_rng(seed + 1)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t) for t in pieces]))).astype(np.int64)
    start, end = off[:-1], off[1:]
    m = {n: np.zeros_like(v) for n, v in net.p.items()}
    v = {n: np.zeros_like(w) for n, w in net.p.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, UPDATES + 1):
        while len(order) < BATCH:  # pass after pass over the segments
            order = np.concatenate([order, rng.permutation(len(pieces))])
        some, order = order[:BATCH], order[BATCH:]
        x, mask = lanes(data, start[some], end[some])
        rate = RATE * 0.5 * (1 + np.cos(np.pi * step / (UPDATES + 1)))
        for n, g in net.gradients(x, mask, labels[some]).items():
            m[n] += 0.1 * (g - m[n])
            v[n] += 0.001 * (g * g - v[n])
            net.p[n] -= rate * (m[n] / (1 - 0.9 ** step)) / (
                np.sqrt(v[n] / (1 - 0.999 ** step)) + 1e-6)
    return net


def pooled(net: ByteGRU, block: Block, n_labels: int) -> np.ndarray:
    """Mean label probabilities of each document (0 without a byte)."""
    total = np.zeros((block.n, n_labels))
    start, end, doc = segments(block.data, block.offsets)
    for a in range(0, len(doc), LANES):
        s, e, d = start[a:a + LANES], end[a:a + LANES], doc[a:a + LANES]
        x, mask = lanes(block.data, s, e)
        np.add.at(total, d, np.einsum("tbl,tb->bl", net.probabilities(x, mask), mask))
    return total / np.maximum(np.diff(block.offsets), 1)[:, None]


def sample_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``SAMPLE_BYTES`` of each text, in segments from anywhere in it."""
    for batch in batches:
        seeds = batch.column("h").to_pylist()
        for block in blocks(batch.column("text")):
            start, end, doc = segments(block.data, block.offsets)
            first = np.searchsorted(doc, np.arange(block.n + 1))
            out = []
            for i in range(block.n):
                rng = np.random.default_rng(seeds[block.row0 + i] & 0xFFFFFFFF)
                n = first[i + 1] - first[i]
                pick = first[i] + np.sort(rng.permutation(n)[:SAMPLE_BYTES // SEGMENT])
                out.append([block.data[start[k]:end[k]].tobytes() for k in pick])
            yield pa.record_batch([
                batch.column("lang").slice(block.row0, block.n),
                batch.column("h").slice(block.row0, block.n),
                pa.array(out, pa.list_(pa.binary()))], names=["lang", "h", "segments"])


def training_rows(docs: DataFrame, per_language: int = SAMPLE) -> list:
    """``(lang, segments)`` of at most ``per_language`` labelled rows of each
    language (and rows that repeat them): those with the least hash of id and
    text. The cut-off is found on hashes alone; no text is shuffled."""
    rows = docs.filter("lang is not null and text is not null").select(
        "lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    order = Window.partitionBy("lang").orderBy("h")
    # a grouped limit: each task keeps its first rows before the shuffle
    last = (rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(order))
            .filter(f"k <= {per_language}").groupBy("lang").agg(F.max("h").alias("last")))
    found = (rows.join(F.broadcast(last), "lang").filter("h <= last").dropDuplicates(["lang", "h"])
             .mapInArrow(sample_segments, "lang string, h long, segments array<binary>"))
    return [(r["lang"], r["segments"]) for r in sorted(
        found.collect(), key=lambda r: (r["lang"], r["h"]))]


def identify(docs: DataFrame, held_out=None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; by default a quarter of the
    documents (crc32 of the id, modulo 4, is 2) is held out of training."""
    spark = docs.sparkSession
    out = held_out if held_out is not None else crc_mod(F.col("doc_id"), 4) == 2
    rows = training_rows(docs.filter(~out))
    labelled = [(bytes(piece), lang) for lang, parts in rows for piece in parts]
    names = sorted({lang for _, lang in labelled})
    net = None
    if names:
        net = train([piece for piece, _ in labelled],
                    np.array([names.index(lang) for _, lang in labelled]), len(names))
    shipped = spark.sparkContext.broadcast((net, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, labels = shipped.value
        labels = np.array(labels or ["und"], object)
        for batch in batches:
            for block in blocks(batch.column("text"), 1 << 19):
                letters = batch.column("letters").slice(block.row0, block.n).to_numpy(
                    zero_copy_only=False)
                p = np.zeros((block.n, 1)) if model is None else pooled(model, block, len(labels))
                ok = letters & (p.max(1) > 0)
                yield pa.record_batch([
                    batch.column("doc_id").slice(block.row0, block.n),
                    batch.column("held_out").slice(block.row0, block.n),
                    pa.array(np.where(ok, labels[p.argmax(1)], "und"), pa.string()),
                    pa.array(np.where(ok, np.minimum(p.max(1), 1.0), 0.0))],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(
        F.col("doc_id").cast("long"), out.alias("held_out"), "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
