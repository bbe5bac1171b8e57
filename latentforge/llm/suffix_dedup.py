"""Removal of long repeated byte strings by a logarithmic family of sparse
suffix arrays.

A byte goes when a 400-byte string that covers it also starts anywhere else
(in any document, the same one included). A suffix array over all bytes would
be many times the input, so only *anchors* are indexed: of the 201 starts of
200-byte strings inside a 400-byte window, the one with the least fingerprint.
Equal windows have the same anchor at the same offset, so two equal windows
always meet at an anchor (about one per 100 bytes). The suffix array of a batch
is its sorted table of anchored 200-byte strings, as 64-bit fingerprints with
the number of places. (The order of suffixes is that of their fingerprints, not
the alphabet: a merge scan needs equal ones side by side, nothing else.)

Index family: every batch of documents gets its array, a table bucketed and
sorted by fingerprint. While a level of the same rank is occupied, the two are
merged into one of the next rank, as in a binary counter, and the array that
results is merge-scanned against every level that stays; both are sort-merge
joins without a shuffle. So each entry is rewritten log2(batches) times.

Windows that share an anchor are a range; it has a *core*, the bytes common to
all windows the range can have, and a *whole*, the bytes from its first to its
last window. A core met once means that no window of the range is a repeat; a
whole met twice that all of them are. Anchors whose string the index has met
twice start as ranges of up to 201 windows; ranges that are neither settled
way, near the ends of repeats, are cut into ranges of 40, 5 and 1. Of wholes met
twice one place stays in the game for others with the same core. Fingerprints have 64
bits (range sums of a byte polynomial, finalised).

Edge cases: null text counts as empty; texts under 400 bytes lose nothing;
repeated rows are copies of each other and lose everything from 400 bytes on;
null ids are allowed; other columns are ignored; texts of any length are
processed whole (memory in a task: about 60 bytes per byte of the longest).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path
from .common import join_back, materialize, maybe_in, scratch_folder, width
from .textblock import BASE, U, Block, Prefix, blocks, lists, mix

LENGTH = 400
GRAM = 200
SPAN = LENGTH - GRAM + 1

NOWHERE = U(0xFFFFFFFFFFFFFFFF)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours (prefix and suffix minima of blocks)."""
    n = len(x) - w + 1
    pad = np.full(-(-len(x) // w) * w, NOWHERE, U)
    pad[:len(x)] = x
    grid = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


def anchors(block: Block, prefix: Prefix):
    """``(doc, at, lo, hi, gram, ctx)`` of the block's anchors: windows
    ``lo..hi`` (starts, relative to the block) share the anchor ``at``."""
    n = len(block.data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return (none,) * 4 + (np.zeros(0, U),) * 2
    gram = prefix.windows(GRAM)
    size = np.diff(block.offsets)
    # starts of windows that stay inside one document
    edge = np.zeros(n + 1, np.int32)
    long = size >= LENGTH
    edge[block.offsets[:-1][long]] += 1
    edge[block.offsets[1:][long] - LENGTH + 1] -= 1
    ok = np.cumsum(edge[:n - LENGTH + 1]) > 0
    # the upper half orders, the lower half says where (leftmost wins a tie)
    packed = (gram & U(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U)
    at = (sliding_min(packed, SPAN)[:n - LENGTH + 1] & U(0xFFFFFFFF)).astype(np.int64)
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | new[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    at = at[lo]
    doc = np.searchsorted(block.offsets, lo, "right") - 1
    return doc, at, lo, hi, gram[at], prefix.ranges(lo, hi + LENGTH)


#: words of a passage, and of the strings by which passages are met
PASSAGE, STRING = 50, 26


def word_grams(word: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of ``n`` words, from those of the words."""
    gram = np.zeros(len(word) - n + 1, U)
    for k in range(n):
        gram = gram * U(BASE) + word[k:len(word) - n + 1 + k]
    return mix(gram)


def passage_windows(block: Block, word: np.ndarray, first: np.ndarray):
    """``(window, document, string, at)`` of the windows of ``PASSAGE`` words inside a
    document: ``string`` is the least of their strings of ``STRING`` words, and
    ``at`` its place. Equal windows choose equal strings."""
    n = len(word)
    gram = word_grams(word, STRING)
    packed = (gram & U(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U)
    least = (sliding_min(packed, PASSAGE - STRING + 1) & U(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(block.n), np.diff(first))
    window = np.flatnonzero(doc[:n - PASSAGE + 1] == doc[PASSAGE - 1:])
    return window, doc[window], gram[least[window]], least[window]


def passage_strings(block: Block, prefix: Prefix) -> tuple[np.ndarray, np.ndarray]:
    """``(document, fingerprint)`` of the strings that windows of ``PASSAGE`` words
    choose, distinct in each document."""
    start, end, first = block.words()
    if len(start) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, U)
    _, owner, print_, at = passage_windows(block, prefix.ranges(start, end), first)
    change = np.diff(at, prepend=-1) != 0
    owner, print_ = owner[change], print_[change]
    order = np.lexsort((print_, owner))
    owner, print_ = owner[order], print_[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (print_[1:] != print_[:-1])
    return owner[new], print_[new]


WINDOWS = ["sha", "text", "window", "lo", "hi"]
WINDOWS_DDL = "sha binary, text string, window array<long>, lo array<long>, hi array<long>"


def open_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker: windows of ``PASSAGE`` words whose string is in ``shared`` (of the
    block's texts), with their fingerprints and byte ranges."""
    for batch in batches:
        for block in blocks(batch.column("text")):
            prefix = Prefix(block.data)
            start, end, first = block.words()
            shared, _ = flat(batch.column("shared"), block.row0, block.n)
            window, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
            print_ = np.zeros(0, U)
            if len(start) >= PASSAGE:
                word = prefix.ranges(start, end)
                window, owner, string, _ = passage_windows(block, word, first)
                met = np.isin(string.view(np.int64), shared)
                window, owner = window[met], owner[met]
                print_ = word_grams(word, PASSAGE)[window]
            n, base = np.bincount(owner, minlength=block.n), block.offsets[owner]
            yield pa.record_batch([
                batch.column("sha").slice(block.row0, block.n),
                batch.column("text").slice(block.row0, block.n),
                lists(print_.view(np.int64), n, pa.int64()),
                lists(start[window] - base, n, pa.int64()),
                lists(end[window + PASSAGE - 1] - base, n, pa.int64())], names=WINDOWS)


MARKS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()),
                   ("n_bytes", pa.int64()), ("core", pa.list_(pa.int64())),
                   ("whole", pa.list_(pa.int64())), ("strings", pa.list_(pa.int64()))])
MARKS_DDL = ("uid long, doc_id long, sha binary, n_bytes long, core array<long>, "
             "whole array<long>, strings array<long>")


def mark(batches: Iterator[pa.RecordBatch], passages: bool = False) -> Iterator[pa.RecordBatch]:
    """Anchors of every document (and the strings of its passages); rows are
    numbered within the task."""
    uid = TaskContext.get().partitionId() << 36
    for batch in batches:
        for block in blocks(batch.column("text")):
            prefix = Prefix(block.data)
            doc, _, _, _, core, whole = anchors(block, prefix)
            owner, strings = (passage_strings(block, prefix) if passages
                              else (np.zeros(0, np.int64), np.zeros(0, U)))
            counts = np.bincount(doc, minlength=block.n)
            yield pa.record_batch([
                pa.array(np.arange(uid, uid + block.n)),
                batch.column("doc_id").slice(block.row0, block.n),
                batch.column("sha").slice(block.row0, block.n),
                pa.array(np.diff(block.offsets)),
                lists(core.view(np.int64), counts, pa.int64()),
                lists(whole.view(np.int64), counts, pa.int64()),
                lists(strings.view(np.int64), np.bincount(owner, minlength=block.n), pa.int64())],
                schema=MARKS)
            uid += block.n


class SuffixIndex:
    """The levels: ``levels[k]`` is the table of 2^k batches, or nothing.

    A level is a folder with a table ``(gram, n)``, bucketed and sorted by
    ``gram``; merged levels are deleted."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.levels: list[str | None] = []
        self.found: list[DataFrame] = []

    def _store(self, rows: DataFrame) -> str:
        name = "suffix_level_" + uuid.uuid4().hex[:12]
        self.spark.sql(f"CREATE TABLE {name} (gram BIGINT, n BIGINT) USING parquet "
                       f"CLUSTERED BY (gram) SORTED BY (gram) INTO {self.buckets} BUCKETS "
                       f"LOCATION '{self.path}/tables/{name}'")
        rows.select("gram", "n").write.insertInto(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, f"{self.path}/tables/{name}")

    def _merge(self, a: str, b: str) -> str:
        x, y = self.spark.table(a), self.spark.table(b).withColumnRenamed("n", "m")
        out = self._store(x.join(y.hint("merge"), "gram", "full").select(
            "gram", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")))
        self._drop(a)
        self._drop(b)
        return out

    def add(self, grams: DataFrame) -> None:
        """``grams(gram)`` of a new batch, one row per place."""
        array, rank = self._store(grams.groupBy("gram").agg(F.count("*").alias("n"))), 0
        while rank < len(self.levels) and self.levels[rank] is not None:
            array = self._merge(self.levels[rank], array)
            self.levels[rank] = None
            rank += 1
        if rank == len(self.levels):
            self.levels.append(None)
        table = self.spark.table(array)
        found = table.filter("n >= 2").select("gram")
        for other in filter(None, self.levels):
            found = found.unionByName(table.join(
                self.spark.table(other).select("gram").hint("merge"), "gram").select("gram"))
        self.levels[rank] = array
        self.found.append(materialize(found, "grams"))

    def repeated(self) -> DataFrame:
        """Fingerprints met at two places or more so far."""
        out = self.found[0]
        for x in self.found[1:]:
            out = out.unionByName(x)
        return materialize(out.distinct(), "repeated-grams")

    def close(self) -> None:
        for name in filter(None, self.levels):
            self._drop(name)


#: sizes of the ranges that open ones are cut into, each a divisor of the last
STEPS = (40, 5, 1)


def cut_ranges(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int):
    """Windows ``lo..hi`` (before their anchor ``at``) in groups by how far
    before the anchor they start: ``(parent, far, near, nearest)``; a group's
    possible windows start ``nearest - step + 1 .. nearest``."""
    first, last = (at - hi) // step, (at - lo) // step
    n = last - first + 1
    parent = np.repeat(np.arange(len(at)), n)
    group = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    nearest = at[parent] - group * step
    return (parent, np.maximum(nearest - step + 1, lo[parent]),
            np.minimum(nearest, hi[parent]), nearest)


RANGES = ["uid", "core", "whole", "at", "lo", "hi"]
RANGES_DDL = ("uid long, core array<long>, whole array<long>, at array<long>, "
              "lo array<long>, hi array<long>")


def flat(column: pa.ListArray, row0: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``n`` lists, and how many each has."""
    part = column.slice(row0, n)
    return (part.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))


def open_ranges(step: int):
    """Worker: cuts the asking anchors (first step) or ranges of each text into
    ranges of ``step`` windows, with the fingerprints of core and whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                prefix = Prefix(block.data)
                pick, counts = flat(batch.column("ask"), block.row0, block.n)
                owner = np.repeat(np.arange(block.n), counts)
                if step == STEPS[0]:
                    doc, at, lo, hi, _, _ = anchors(block, prefix)
                    rows = np.searchsorted(doc, owner) + pick
                    at, lo, hi = at[rows], lo[rows], hi[rows]
                else:
                    (at, size), (lo, _), (hi, _) = (flat(batch.column(c), block.row0, block.n)
                                                    for c in ("at", "lo", "hi"))
                    rows = (np.cumsum(size) - size)[owner] + pick
                    base = block.offsets[owner]
                    at, lo, hi = at[rows] + base, lo[rows] + base, hi[rows] + base
                parent, far, near, nearest = cut_ranges(at, lo, hi, step)
                owner = owner[parent]
                n, base = np.bincount(owner, minlength=block.n), block.offsets[owner]
                core = prefix.ranges(nearest, nearest + LENGTH - step + 1)
                whole = prefix.ranges(far, near + LENGTH)
                yield pa.record_batch([
                    batch.column("uid").slice(block.row0, block.n),
                    lists(core.view(np.int64), n, pa.int64()),
                    lists(whole.view(np.int64), n, pa.int64()),
                    lists(at[parent] - base, n, pa.int64()), lists(far - base, n, pa.int64()),
                    lists(near - base, n, pa.int64())], names=RANGES)
    return run


def exploded(ranges: DataFrame) -> DataFrame:
    return ranges.select("uid", F.posexplode(F.arrays_zip("core", "whole")).alias("idx", "r")).select(
        "uid", "idx", "r.core", "r.whole")


def settle(rows: DataFrame) -> DataFrame:
    """Of ranges ``(uid, idx, core, whole)``: by ``uid``, ``done`` (wholes met
    twice) and ``ask`` (still open, or speaking for equal wholes)."""
    kinds = materialize(rows.groupBy("core", "whole").agg(
        F.count("*").alias("n"), F.min("uid").alias("speaker")), "kinds")
    cores = materialize(kinds.groupBy("core").agg(
        F.sum("n").alias("places"), F.count("*").alias("kinds"))
        .filter("places >= 2").select("core", "kinds"), "cores")
    met = materialize(kinds.join(cores.hint("merge"), "core"), "met")
    ask = (F.col("kinds") > 1) & ((F.col("n") == 1) | (F.col("speaker") == F.col("uid")))
    return (rows.join(met.hint("merge"), ["core", "whole"])
            .withColumn("asks", ask).filter("asks or n >= 2").groupBy("uid").agg(
                F.collect_list(F.when(F.col("n") >= 2, F.col("idx"))).alias("done"),
                F.collect_list(F.when(F.col("asks"), F.col("idx"))).alias("ask")))


VERDICT = pa.schema([("sha", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the bytes of the repeated windows: those of the anchors
    ``done``, and ``lo..hi``; and the passages ``plo..phi``. ``kept_text`` leaves out
    what a cut has left of a character; the digest is that of the remaining bytes."""
    for batch in batches:
        for block in blocks(batch.column("text")):
            doc, _, lo, hi, _, _ = anchors(block, Prefix(block.data))
            done, n_done = flat(batch.column("done"), block.row0, block.n)
            rows = np.searchsorted(doc, np.repeat(np.arange(block.n), n_done)) + done
            (more, n_more), (upto, _) = (flat(batch.column(c), block.row0, block.n)
                                         for c in ("lo", "hi"))
            (plo, n_p), (phi, _) = (flat(batch.column(c), block.row0, block.n)
                                    for c in ("plo", "phi"))
            base, p_base = (np.repeat(block.offsets[:-1], n) for n in (n_more, n_p))
            depth = np.zeros(len(block.data) + 1, np.int64)
            np.add.at(depth, np.concatenate([lo[rows], more + base, plo + p_base]), 1)
            np.add.at(depth, np.concatenate([hi[rows] + LENGTH, upto + base + LENGTH,
                                             phi + p_base]), -1)
            gone = np.cumsum(depth[:-1]) > 0
            out = []
            for i in range(block.n):
                a, b = block.offsets[i], block.offsets[i + 1]
                part = gone[a:b]
                kept = block.data[a:b][~part].tobytes()
                runs = int(part[:1].sum() + (part[1:] & ~part[:-1]).sum())
                out.append((int(part.sum()), runs, hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8", "ignore")))
            cols = zip(*out, strict=True)
            yield pa.record_batch(
                [batch.column("sha").slice(block.row0, block.n),
                 *[pa.array(c, f.type) for c, f in zip(cols, list(VERDICT)[1:], strict=True)]],
                schema=VERDICT)


def repeated_passages(marks: DataFrame, source: DataFrame) -> DataFrame:
    """``sha, text, plo, phi``: byte ranges of the windows of ``PASSAGE`` words that
    occur in another text too, for each text that has some. Copies of a whole text
    count as one text. Only texts that share a string of such a window are read again."""
    rows = marks.filter("size(strings) > 0").dropDuplicates(["sha"]).select(
        "sha", F.explode("strings").alias("string"))
    rows = materialize(rows, "passage-strings")
    met = materialize(rows.groupBy("string").agg(F.count("*").alias("n")).filter("n >= 2"),
                      "shared-strings")
    shared = materialize(join_back(maybe_in(rows, met, "string"), met, "string", "n",
                                   F.col("sha")).groupBy("sha").agg(
        F.collect_list("string").alias("shared")), "shared-by-text")
    texts = (maybe_in(source.select("sha", "text"), shared, "sha").dropDuplicates(["sha"])
             .join(shared.hint("merge"), "sha"))
    opened = materialize(texts.mapInArrow(open_passages, WINDOWS_DDL), "passage-windows")
    windows = opened.select("sha", F.posexplode("window").alias("idx", "window"))
    twice = materialize(windows.groupBy("window").agg(
        F.count("*").alias("n"), F.min("sha").alias("a"), F.max("sha").alias("b"))
        .filter("a < b").select("window", "n"), "shared-windows")
    hits = join_back(maybe_in(windows, twice, "window"), twice, "window", "n",
                     F.col("sha")).groupBy("sha").agg(F.collect_list("idx").alias("hits"))
    return materialize(opened.join(hits.hint("merge"), "sha").select(
        "sha", "text", *[F.expr(f"transform(hits, i -> get({c}, i))").alias("p" + c)
                         for c in ("lo", "hi")]), "repeated-passages")


def suffix_dedup(docs: DataFrame, batches: int = 4, passages: bool = False,
                 cut_passages: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(marks, verdicts)``: a narrow row per document, and for each text that
    may lose bytes ``sha, n_removed, n_spans, kept_sha256, kept_text, copies``.
    ``cut_passages`` takes out repeated passages too (see ``repeated_passages``)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long"),
                         F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
                         text.alias("text"))
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    marks = materialize(source.mapInArrow(lambda b: mark(b, passages or cut_passages), MARKS_DDL), "marks")
    entries = exploded(marks)
    index = SuffixIndex(spark, scratch_folder(spark, "suffix-index"), width(spark))
    for k in range(batches):
        batch = entries.filter(F.pmod(F.xxhash64("uid"), F.lit(batches)) == k)
        index.add(batch.select(F.col("core").alias("gram")))
    grams = index.repeated().withColumnRenamed("gram", "core")
    index.close()
    near = materialize(maybe_in(entries, grams, "core").join(grams.hint("merge"), "core",
                                                             "left_semi"), "near")
    copies = materialize(marks.filter(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(
        F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes")).filter("copies > 1"),
        "copies")
    # a text that has copies goes as a whole: it is read again only to speak
    state = settle(near).join(marks.select("uid", who.alias("who"), "sha"), "uid")
    state = materialize(
        state.join(copies.select("sha", "copies"), "sha", "left")
        .withColumn("copies", F.coalesce("copies", F.lit(1)))
        .filter("copies = 1 or size(ask) > 0"), "state")
    asked = materialize(
        state.join(maybe_in(source.select(who.alias("who"), "sha", "text"), state, "sha")
                   .hint("merge"), ["who", "sha"])
        .select("uid", "sha", "copies", "done", "ask", "text"), "asked")
    spans, texts = [], asked.filter("size(ask) > 0").select("uid", "ask", "text")
    for step in STEPS:
        ranges = materialize(texts.mapInArrow(open_ranges(step), RANGES_DDL), "ranges")
        answer = materialize(settle(exploded(ranges)), "answer")
        both = ranges.join(answer, "uid")
        spans.append(both.select("uid", *[F.expr(f"transform(done, i -> get({c}, i))").alias(c)
                                          for c in ("lo", "hi")]))
        texts = (both.filter("size(ask) > 0").select("uid", "ask", "at", "lo", "hi")
                 .join(asked.select("uid", "text"), "uid"))
    found = spans[0]
    for x in spans[1:]:
        found = found.unionByName(x)
    found = found.groupBy("uid").agg(F.flatten(F.collect_list("lo")).alias("lo"),
                                     F.flatten(F.collect_list("hi")).alias("hi"))
    none = F.array().cast("array<long>")
    cuts = (asked.filter("copies = 1").join(found, "uid", "left")
            .select("sha", "text", "done", F.coalesce("lo", none).alias("lo"),
                    F.coalesce("hi", none).alias("hi")))
    if cut_passages:
        found_passages = repeated_passages(marks, source)
        # copies go as a whole, from LENGTH bytes on
        alone = (found_passages.join(cuts.select("sha"), "sha", "left_anti")
                 .join(copies.select("sha"), "sha", "left_anti"))
        both = cuts.join(found_passages.drop("text"), "sha", "left")
        cuts = both.unionByName(alone.select("*", *[none.alias(c) for c in ("done", "lo", "hi")]))
    else:
        cuts = cuts.withColumns({"plo": none, "phi": none})
    cuts = (cuts.select("sha", "text", "done", "lo", "hi", F.coalesce("plo", none).alias("plo"),
                        F.coalesce("phi", none).alias("phi"))
            .mapInArrow(cut, "sha binary, n_removed long, n_spans long, kept_sha256 string, "
                             "kept_text string"))
    copied = copies.select(
        "sha", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit("").alias("kept_text"),
        "copies")
    return marks, cuts.withColumn("copies", F.lit(1).cast("long")).unionByName(copied)


def shared_strings(marks: DataFrame) -> DataFrame:
    """``uid, n_shared_passages``: how many passage strings of a document occur
    in another one too (0 is left out)."""
    rows = marks.select("uid", F.explode("strings").alias("string"))
    shared = materialize(rows.groupBy("string").agg(F.count("*").alias("n")).filter("n >= 2"),
                         "shared-strings")
    return join_back(maybe_in(rows, shared, "string"), shared, "string", "n", F.col("uid")).groupBy(
        "uid").agg(F.count("*").alias("n_shared_passages"))


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per document, and
    ``n_shared_passages``, which finds repeats that are too short for a cut: at
    least 1 where 50 words in a row occur in another document too, and 0 where no
    26 words in a row do (counted are chosen strings of 26 words)."""
    marks, verdicts = suffix_dedup(docs.select("doc_id", "text"), passages=True)
    met = materialize(shared_strings(marks), "passages")
    small = materialize(verdicts.drop("kept_text"), "verdicts")
    out = join_back(marks.select("uid", "doc_id", "sha", "n_bytes"), small, "sha", "copies",
                    F.col("uid"), "left")
    out = out.join(met.hint("merge"), "uid", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                      F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
                      F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
                      F.coalesce("n_shared_passages", F.lit(0)).alias("n_shared_passages"))


def cut_repeats(docs: DataFrame, passages: bool = False) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (and ``n_chars``,
    where there is one, counted anew). With ``passages``, runs of ``PASSAGE`` and more
    words that occur in another text too go as well, however few bytes they have; both
    are judged on the input. No row goes."""
    _, verdicts = suffix_dedup(docs.select("doc_id", "text"), cut_passages=passages)
    # only texts that have copies can be hot, and of these nothing is kept: no
    # text is broadcast
    hot = F.when(F.col("copies") > 1, F.col("copies")).otherwise(0).cast("long")
    small = materialize(verdicts.filter("n_removed > 0").select(
        "sha", "kept_text", hot.alias("copies")), "verdicts")
    packed = docs.select(F.struct("*").alias("doc"), F.unhex(F.sha2(
        F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("sha"))
    out = join_back(packed, small, "sha", "copies", F.col("doc.doc_id"), "left")
    text = F.when(F.col("kept_text").isNull(), F.col("doc.text")).otherwise(F.col("kept_text"))
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("kept_text").isNull(), F.col("doc.n_chars")).otherwise(
            F.length("kept_text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
