"""Packing of tokenised documents into sequences of bounded length.

Two packers over the same pieces (a document's ids followed by an end id; only
documents over ``capacity`` are cut, into full pieces and a rest):

* ``best_fit_packing``: bounded-space online best fit. At most ``OPEN`` bins
  are open; a bitset keyed by free space finds the fullest bin that still
  takes the piece; when a bin must close for a new one, the fullest goes.
* ``packed_matrices``: best-fit decreasing; a segment tree over the capacities
  finds the least free space that takes the piece. The packed ids come back as
  matrix rows with segment lengths and position resets.

Pieces are dealt by hash to packers of about ``PACKER_TOKENS`` tokens each, so
packing is one bounded task per packer, whatever the size of the data; a
packer leaves at most its open bins part-filled. Full pieces need no packer.

Edge cases: null and empty texts are the end id alone; repeated rows are
packed once each; null ids are carried; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textblock import blocks
from .word_tokens import WordEncoder, library_ids, load_tokenizer

CAPACITY = 4096
END_ID = 1
OPEN = 256
PACKER_TOKENS = 1 << 24
#: sequence number: packer above, number within the packer below
PACKER_SHIFT = 32


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(library_ids(load_tokenizer(path)))


def id_width(path: str) -> int:
    """Bytes of a stored id: 2 where the vocabulary fits, else 4."""
    return 2 if load_tokenizer(path).get_vocab_size() <= 1 << 16 else 4


def document_ids(batches: Iterator[pa.RecordBatch], path: str):
    """``(batch, block, ids, offsets)`` per block; every document ends in END_ID."""
    enc = encoder(path)
    for batch in batches:
        for block in blocks(batch.column("text")):
            ids, off = enc.ids_of(*enc.rows(block))
            where = off[1:] + np.arange(block.n)
            full = np.full(len(ids) + block.n, END_ID, np.uint32)
            mask = np.ones(len(full), bool)
            mask[where] = False
            full[mask] = ids
            yield batch, block, full, off + np.arange(block.n + 1)


def pieces(docs: DataFrame, path: str, with_ids: bool) -> DataFrame:
    """``uid, doc_id, piece, start, length, ids_crc32`` (and ``ids``,
    little-endian, ``id_width`` bytes each) of ``docs(doc_id, text)``; ``uid`` numbers the documents, and
    ``alone`` (below 0) is the sequence that a full piece is by itself."""
    fields = [("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()),
              ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("alone", pa.int64())]
    ddl = ("uid long, doc_id long, piece int, start long, length long, ids_crc32 long, "
           "alone long")
    if with_ids:
        fields.append(("ids", pa.binary()))
        ddl += ", ids binary"
    schema, width = pa.schema(fields), id_width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        alone = -1 - uid
        for batch, block, ids, off in document_ids(batches, path):
            n = -(-np.diff(off) // CAPACITY)
            doc = np.repeat(np.arange(block.n), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            lo = off[doc] + piece * CAPACITY
            hi = np.minimum(lo + CAPACITY, off[doc + 1])
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            spans = list(zip((4 * lo).tolist(), (4 * hi).tolist(), strict=True))
            cols = [pa.array(uid + doc), batch.column("doc_id").slice(block.row0, block.n)
                    .take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                    pa.array(piece.astype(np.int64) * CAPACITY), pa.array(hi - lo),
                    pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()),
                    pa.array(np.where(hi - lo == CAPACITY, alone - np.cumsum(hi - lo == CAPACITY),
                                      0))]
            alone -= int((hi - lo == CAPACITY).sum())
            if with_ids:
                small = memoryview(ids.astype(f"<u{width}").view(np.uint8))
                cols.append(pa.array([bytes(small[a * width // 4:b * width // 4])
                                      for a, b in spans], pa.binary()))
            yield pa.record_batch(cols, schema=schema)
            uid += block.n

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def best_fit(lengths: list[int], capacity: int = CAPACITY, open_bins: int = OPEN
             ) -> tuple[list[int], list[int]]:
    """Bin number and offset of each length, in the order given.

    ``free`` has bit f set when some open bin has f tokens free; ``stacks[f]``
    are those bins."""
    free, stacks, n_open, bins = 0, {}, 0, 0
    where, offset = [], []
    for need in lengths:
        fits = free >> need
        if fits:
            space = need + (fits & -fits).bit_length() - 1
            stack = stacks[space]
            b = stack.pop()
            if not stack:
                free &= ~(1 << space)
            n_open -= 1
        else:
            if n_open == open_bins:
                fullest = (free & -free).bit_length() - 1
                stack = stacks[fullest]
                stack.pop()
                if not stack:
                    free &= ~(1 << fullest)
                n_open -= 1
            b, space = bins, capacity
            bins += 1
        where.append(b)
        offset.append(capacity - space)
        space -= need
        if space:
            stacks.setdefault(space, []).append(b)
            free |= 1 << space
            n_open += 1
    return where, offset


class CapacityTree:
    """Segment tree over free spaces 0..capacity: which have a bin."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def change(self, space: int, by: int) -> None:
        k = space + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def least(self, need: int) -> int:
        """The least space of at least ``need`` with a bin, or -1."""
        k = need + self.size
        if self.count[k]:
            return need
        while k > 1 and (k & 1 or not self.count[k + 1]):
            k >>= 1
        if k <= 1:
            return -1
        k += 1
        while k < self.size:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        return k - self.size


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY
                        ) -> tuple[list[int], list[int]]:
    """Bin number and offset of each length; longer ones are placed first."""
    tree, stacks, bins = CapacityTree(capacity), {}, 0
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        space = tree.least(need)
        if space < 0:
            b, space = bins, capacity
            bins += 1
        else:
            b = stacks[space].pop()
            tree.change(space, -1)
        where[i], offset[i] = b, capacity - space
        stacks.setdefault(space - need, []).append(b)
        tree.change(space - need, 1)
    return where, offset


def place(cut: DataFrame, method) -> DataFrame:
    """Adds ``sequence_id, offset`` to pieces: one bounded task per packer."""
    open_ = cut.filter(F.col("length") < CAPACITY).select("uid", "piece", "length")
    total = open_.agg(F.sum("length")).first()[0] or 0
    packers = max(1, -(-total // PACKER_TOKENS))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["uid", "piece"], ignore_index=True)
        where, offset = method(frame["length"].tolist())
        return pd.DataFrame({"uid": frame["uid"], "piece": frame["piece"],
                             "sequence_id": (key[0] << PACKER_SHIFT) + np.asarray(where, np.int64),
                             "offset": np.asarray(offset, np.int64)})

    return (open_.withColumn("packer", F.pmod(F.xxhash64("uid", "piece"), F.lit(packers)))
            .groupBy("packer").applyInPandas(
                pack, "uid long, piece int, sequence_id long, offset long"))


def best_fit_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = materialize(pieces(docs, tokenizer, False), "pieces")
    placed = place(cut, best_fit)
    part = cut.filter(F.col("length") < CAPACITY).join(placed, ["uid", "piece"])
    return part.unionByName(_full(cut)).select("doc_id", "piece", "start", "length", "ids_crc32",
                                        "sequence_id", "offset")


def _full(cut: DataFrame) -> DataFrame:
    """The full pieces, each a sequence by itself."""
    return cut.filter(F.col("length") == CAPACITY).withColumns(
        {"sequence_id": F.col("alone"), "offset": F.lit(0).cast("long")})


def packed_matrices(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per sequence: ``sequence_id, n_tokens, ids`` (``CAPACITY``
    little-endian ids of ``id_bytes`` bytes each, padded with zeros),
    ``id_bytes`` (2 where the vocabulary has at most 65,536 ids, else 4),
    ``cu_seqlens`` (0, then the end of each segment), ``position_resets`` (where
    positions start at 0: the start of every segment that starts a document),
    ``doc_ids, pieces, starts``. Full pieces are sequences as they are and are
    not shuffled."""
    width = id_width(tokenizer)
    cut = materialize(pieces(docs, tokenizer, True), "id-pieces")
    placed = materialize(place(cut, best_fit_decreasing), "placed")
    part = cut.filter(F.col("length") < CAPACITY).join(placed, ["uid", "piece"])
    segment = F.struct("offset", "length", "doc_id", "piece", "start", "ids")
    rows = part.select("sequence_id", segment.alias("s"))
    # a sequence has at most `capacity` segments of one id or more
    seq = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    seq = seq.unionByName(_full(cut).select("sequence_id", F.array(segment).alias("s")))
    return seq.select(
        "sequence_id", F.expr("aggregate(s, 0L, (n, x) -> n + x.length)").alias("n_tokens"),
        F.expr(f"rpad(aggregate(s.ids, X'', (a, x) -> concat(a, x)), {width * CAPACITY}, X'00')")
        .alias("ids"), F.lit(width).alias("id_bytes"),
        F.expr("concat(array(0L), transform(s, x -> x.offset + x.length))").alias("cu_seqlens"),
        F.expr("transform(filter(s, x -> x.start = 0), x -> x.offset)").alias("position_resets"),
        F.col("s.doc_id").alias("doc_ids"), F.col("s.piece").alias("pieces"),
        F.col("s.start").alias("starts"))


def write_packed(docs: DataFrame, tokenizer: str, path: str) -> None:
    """The packed matrices as Parquet files at ``path``."""
    packed_matrices(docs, tokenizer).write.mode("overwrite").parquet(path)
