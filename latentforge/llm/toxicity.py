"""Toxicity by compression distance.

Two zstandard dictionaries share a trained base of ordinary text and differ in
their last bytes: one ends in a dictionary trained on ordinary words, the other
in one trained on toxic words. A window is one word (long ones in overlapping
pieces of ``PIECE`` bytes) inside a fixed frame of base text; its gain is its
length compressed with the ordinary dictionary less that with the toxic one. The
frame keeps windows above the sizes at which zstandard stores raw bytes, and the
common base makes ordinary words come out alike, so a gain over the calibrated
threshold says that the toxic dictionary holds the word and the ordinary does not.

Toxic training words are chosen by contrast: those with a run of ``GRAM`` bytes
that at least ``MIN_SHARE`` of the toxic texts hold, at ``MIN_RATIO`` times the
rate of ordinary texts (all words of toxic texts, where there is no such run).
The threshold is the one that orders the calibration texts best; a document's
summed excess, and its excess per word, go through a logistic function fitted on
them. Score 0.5 is even odds under the classes' rates in the labels.

Plan: at most ``SAMPLE`` labelled ids of either class (a bound on what is fitted,
found by a cut on a hash of the id, whose width follows from the class's count)
are broadcast and met by the texts, of each of which at most ``SAMPLE_WORDS``
words from anywhere reach the driver. Scoring reads every whole text in one pass
without a shuffle; a worker remembers the gains of at most ``MAX_WORDS`` words.

Edge cases: null and empty texts have no word and get the score of no excess;
texts of any length are scored whole; rows with the same text score alike;
repeated label rows count once, an id with both labels as toxic; without a label
of either class the score is 0 for all; an empty table gives no rows; labels of
ids that are not in the documents do nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .textblock import ASCII_LOWER, Block, Prefix, blocks

SAMPLE = 800
SAMPLE_WORDS = 1200
GRAM = 5
MIN_SHARE, MIN_RATIO = 0.02, 20
BASE_BYTES, TAIL_BYTES = 1 << 16, 1 << 12
#: frame before and after a window
BEFORE, AFTER = 32, 12
PIECE, STEP = 48, 32
MAX_WORDS = 400_000
THRESHOLDS = range(9)
PREDICTED_FROM = 0.7


def windows(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, document)`` of the words; long ones in pieces."""
    start, end, first = block.words()
    doc = np.repeat(np.arange(block.n), np.diff(first))
    n = np.maximum(-(-(end - start - PIECE) // STEP), 0) + 1
    if (n > 1).any():
        at = np.repeat(np.arange(len(n)), n)
        start = start[at] + STEP * (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n))
        end, doc = np.minimum(start + PIECE, end[at]), doc[at]
    return start, end, doc


def trained(samples: list[bytes], size: int, k: int) -> bytes:
    """A zstandard dictionary of the samples, or where they are too few for the
    trainer the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def joined(words: list[bytes], n: int, rng: np.random.Generator) -> list[bytes]:
    """The words in random order, ``n`` to a sample."""
    mixed = [words[i] for i in rng.permutation(len(words))]
    return [b" " + b" ".join(mixed[i:i + n]) + b" " for i in range(0, len(mixed), n)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content)
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_BTOPT, min_match=3, window_log=17, hash_log=17, chain_log=17,
        search_log=4, target_length=64, write_content_size=0, write_checksum=0, write_dict_id=0)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


def grams(word: bytes) -> set[bytes]:
    word = b" " + word + b" "
    return {word[i:i + GRAM] for i in range(len(word) - GRAM + 1)}


def text_frequencies(texts: list[list[bytes]]) -> dict[bytes, int]:
    """In how many texts each run of ``GRAM`` bytes occurs."""
    out: dict[bytes, int] = {}
    for words in texts:
        for g in set().union(*map(grams, set(words))) if words else ():
            out[g] = out.get(g, 0) + 1
    return out


def toxic_words(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Words of the toxic texts with a contrasting run of bytes."""
    a, b = text_frequencies(toxic), text_frequencies(ordinary)
    least = max(2, MIN_SHARE * len(toxic))
    rate = MIN_RATIO * (len(toxic) + 1) / (len(ordinary) + 1)
    hot = {g for g, n in a.items() if n >= least and n + 0.5 >= rate * (b.get(g, 0) + 0.5)}
    words = [w for t in toxic for w in t]
    return [w for w in words if not hot.isdisjoint(grams(w))] or words


def rank_quality(score: np.ndarray, label: np.ndarray) -> float:
    """Share of (toxic, ordinary) pairs in the right order, ties half."""
    values, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    pos = int(label.sum())
    return (rank[label].sum() - pos * (pos + 1) / 2) / max(pos * (len(label) - pos), 1)


def features(excess: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(excess)), np.log1p(excess),
                     np.log1p(1000 * excess / np.maximum(n_words, 1))], 1)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Newton's method on the penalised likelihood (the intercept is free)."""
    w, ridge = np.zeros(x.shape[1]), penalty * np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)),
                               x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
    return w


class ToxicityModel:
    """Dictionaries, threshold and weights; compressors are made where used."""

    def __init__(self, texts: list[tuple[int, list[bytes]]]):
        """``texts``: (label, lower-case words); every fourth one calibrates."""
        rng = np.random.default_rng(0)
        parts = {c: [w for y, w in texts if y == c] for c in (0, 1)}
        fit = {c: [t for i, t in enumerate(p) if i % 4] or p for c, p in parts.items()}
        plain = [w for t in fit[0] for w in t]
        half = len(plain) // 2
        base = trained(joined(plain[:half] or plain, 32, rng), BASE_BYTES, 200)
        tails = [trained(joined(plain[half:], 16, rng), TAIL_BYTES, 64),
                 trained(joined(toxic_words(fit[1], fit[0]), 16, rng), TAIL_BYTES, 64)]
        self.contents = [base + t[-TAIL_BYTES:] for t in tails]
        self.before, self.after = base[-BEFORE:], base[-BEFORE - AFTER:-BEFORE]
        self.ready()
        held = [(c, t) for c, p in parts.items() for t in (p[::4] if len(p) > 4 else p)]
        label = np.array([c == 1 for c, _ in held])
        gains = [self.gains([b" " + w[:PIECE] + b" " for w in t]) for _, t in held]
        n = np.array([len(g) for g in gains])

        def excess(t):
            return np.array([np.maximum(g - t, 0).sum() for g in gains], float)

        self.threshold = max(THRESHOLDS, key=lambda t: rank_quality(
            excess(t) / np.maximum(n, 1), label))
        self.weights = logistic(features(excess(self.threshold), n), label.astype(float))

    def ready(self) -> None:
        self.compressors = [compressor(c) for c in self.contents]
        self.known: dict[int, int] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("compressors", "known")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.ready()

    def gains(self, words: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one."""
        if not words:
            return np.zeros(0, np.int64)
        framed = [self.before + w + self.after for w in words]
        size = []
        for c in self.compressors:
            got = c.multi_compress_to_buffer(framed, threads=1)
            size.append(np.fromiter((len(got[i]) for i in range(len(got))), np.int64, len(got)))
        return size[0] - size[1]

    def scores(self, block: Block) -> np.ndarray:
        start, end, doc = windows(block)
        keys, index, inverse = np.unique(Prefix(block.data, lower=True).ranges(start, end),
                                         return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > MAX_WORDS:
            self.known = {}
        listed = keys.tolist()
        fresh = [i for i, k in enumerate(listed) if k not in self.known]
        if fresh:
            data = ASCII_LOWER[block.data].tobytes()
            at = index[fresh]
            found = self.gains([b" " + data[a:b] + b" " for a, b in zip(
                start[at].tolist(), end[at].tolist(), strict=True)])
            self.known.update(zip([listed[i] for i in fresh], found.tolist(), strict=True))
        gain = np.fromiter((self.known[k] for k in listed), np.int64, len(listed))
        over = np.maximum(gain - self.threshold, 0)[inverse]
        excess = np.bincount(doc, over, block.n)
        n = np.bincount(doc, minlength=block.n)
        return 1 / (1 + np.exp(-np.clip(features(excess, n) @ self.weights, -30, 30)))


def sampled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``SAMPLE_WORDS`` words of each text, from anywhere in it."""
    for batch in batches:
        for block in blocks(batch.column("text")):
            start, end, doc = windows(block)
            data, first = ASCII_LOWER[block.data].tobytes(), np.searchsorted(doc, np.arange(block.n + 1))
            out = []
            for i in range(block.n):
                rng = np.random.default_rng(len(data) and int(block.offsets[i + 1] - block.offsets[i]))
                pick = first[i] + np.sort(rng.permutation(first[i + 1] - first[i])[:SAMPLE_WORDS])
                out.append(b" ".join([data[start[k]:end[k]] for k in pick]))
            yield pa.record_batch([batch.column("doc_id").slice(block.row0, block.n),
                                   batch.column("toxic").slice(block.row0, block.n),
                                   pa.array(out, pa.binary())], names=["doc_id", "toxic", "words"])


def training_texts(docs: DataFrame, labels: DataFrame) -> list[tuple[int, list[bytes]]]:
    """``(label, words)`` of at most ``SAMPLE`` (and five deviations) ids of
    either class, in order of a hash of the id."""
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return []
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxic")), F.lit(1 << 30))
    some = marked.filter(" or ".join(
        f"(toxic = {c} and pmod(xxhash64(doc_id, 'toxic'), {1 << 30}) < "
        f"{int((1 << 30) * min(1.0, SAMPLE / n))})" for c, n in counts.items()))
    found = (docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null")
             .join(F.broadcast(some), "doc_id")
             .mapInArrow(sampled_words, "doc_id long, toxic int, words binary")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("words").alias("words"))
             .withColumn("h", place))
    return [(r["toxic"], bytes(r["words"]).split()) for r in sorted(
        found.collect(), key=lambda r: (r["h"], r["doc_id"]))]


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """The model of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    texts = training_texts(docs, labels)
    if len({y for y, words in texts if words}) < 2:
        return None
    return ToxicityModel([t for t in texts if t[1]])


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out=None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document; by default a third
    (crc32 of the id, modulo 3, is 1) is held out of training."""
    out = held_out if held_out is not None else crc_mod(F.col("doc_id"), 3) == 1
    model = fit(docs.filter(~out), labels.filter(~out))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for block in blocks(batch.column("text")):
                score = np.zeros(block.n) if model is None else model.scores(block)
                yield pa.record_batch([
                    batch.column("doc_id").slice(block.row0, block.n),
                    batch.column("held_out").slice(block.row0, block.n), pa.array(score),
                    pa.array((score >= PREDICTED_FROM).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), out.alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
