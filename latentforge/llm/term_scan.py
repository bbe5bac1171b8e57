"""Ranked lexical search by an Aho-Corasick scan of the documents.

Terms are runs of letters, digits and code points from 128 on, A-Z lower-cased.
All distinct terms of the items go into one automaton, guarded by a boundary on
either side (`` term ``); texts get one separator byte for everything that is no
term byte, so a hit is a whole term. The automaton's outputs are term numbers,
and a table of postings maps those to the items that hold the term, and how
often. There is no index of the documents: the first scan counts, per task, in
how many documents each item term occurs, documents and their terms; the second
scan counts term frequencies in each text, scores it for every item that shares a
term, and keeps the task's ten best per item. Only these rows are shuffled.

The terms that are broadcast are bounded: items are dealt to blocks of at most
``BLOCK_BYTES`` of distinct term bytes, and each block is a scan of its own (one,
for ordinary item tables). A single item beyond the bound is cut by its terms;
its scans return every document with a partial score, which are summed exactly.

Scores are 64-bit integers; the weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))``
in doubles.

Edge cases: null and empty texts have no term and are not counted in N; items
without terms return nothing, nor do terms that no document holds; rows that
share an item_id are one item with the terms of all, repeats included, and a null
item_id is an item too; repeated documents are ranked once each; null doc_ids
come last among equal scores; an empty table on either side gives no rows; texts
of any length are scanned whole (a text is copied once); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .textblock import Block, blocks

TOP = 10
#: bound on the distinct term bytes of one scan
BLOCK_BYTES = 8 << 20
#: cells of the document by item score table that a task holds
CELLS = 1 << 21
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: fixed values: the bytes of terms (digits, letters, and all from 0x80 on);
#: every other byte is the separator
SEPARATOR = 0x20
FOLD = np.full(256, SEPARATOR, np.uint8)
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, times`` of the items' texts."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (items.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))
                         .alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times")))


class Terms:
    """The automaton over a block's terms, built where it is used, and which
    items hold each term: term t has ``item[first[t]:first[t + 1]]``."""

    def __init__(self, rows: list[tuple[int | None, str, int]]):
        """``rows``: (item_id, term, times)."""
        self.names = sorted({t for _, t, _ in rows})
        self.item_ids = sorted({i for i, _, _ in rows}, key=lambda i: (i is None, i))
        number = {t: i for i, t in enumerate(self.names)}
        place = {x: i for i, x in enumerate(self.item_ids)}
        flat = sorted((number[t], place[i], n) for i, t, n in rows)
        term, self.item, self.times = np.array(flat, np.int64).reshape(-1, 3).T.copy()
        self.first = np.searchsorted(term, np.arange(len(self.names) + 1))
        self.automaton = None

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}

    def ready(self) -> None:
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for i, t in enumerate(self.names):
                # one character per byte, guarded on both sides
                self.automaton.add_word(" " + t.encode("utf-8").decode("latin-1") + " ", i)
            self.automaton.make_automaton()

    def counts(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(document, term, tf)`` of the hits, and the terms of each document."""
        self.ready()
        data = FOLD[block.data]
        inside = data != SEPARATOR
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        edge = block.offsets[:-1][np.diff(block.offsets) > 0]
        start[edge] = inside[edge]
        total = np.concatenate(([0], np.cumsum(start, dtype=np.int64)))
        n = total[block.offsets[1:]] - total[block.offsets[:-1]]
        raw, hits = data.tobytes().decode("latin-1"), []
        if self.names:
            for i in range(block.n):
                text = f" {raw[block.offsets[i]:block.offsets[i + 1]]} "
                hits.append(np.fromiter((v for _, v in self.automaton.iter(text)), np.int64))
        size = len(self.names)
        doc = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        pair = doc * max(size, 1) + (np.concatenate(hits) if hits else 0)
        pair, tf = np.unique(pair, return_counts=True) if len(doc) else (doc, doc)
        return pair // max(size, 1), pair % max(size, 1), tf, n


def statistics(docs: DataFrame, terms: Terms) -> tuple[int, int, np.ndarray]:
    """``(N, L, df of each term)`` over all documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shipped.value
        df = np.zeros(len(terms.names) + 2, np.int64)  # the last two are N and L
        for batch in batches:
            for block in blocks(batch.column("text")):
                _, term, _, n = terms.counts(block)
                df[:-2] += np.bincount(term, minlength=len(df) - 2)
                df[-2:] += (int((n > 0).sum()), int(n.sum()))
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at), pa.array(df[at])], names=["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n")).collect()  # at most a row per item term
    out = np.zeros(len(terms.names) + 2, np.int64)
    for r in found:
        out[r["term"]] = r["n"]
    return int(out[-2]), int(out[-1]), out[:-2]


def best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Rows of the ``TOP`` best of each item."""
    order = np.lexsort((doc, null, -score, item))
    first = np.searchsorted(item[order], item[order], "left")
    return order[np.arange(len(order)) - first < TOP]


def scored(docs: DataFrame, terms: Terms, n_docs: int, n_terms: int, df: np.ndarray,
           whole: bool = True) -> DataFrame:
    """``item_id, doc_id, uid, score`` of ``docs(doc_id, uid, text)``: of each
    task the best of each item, or (``whole`` false, where the scores are only
    parts) all documents with a hit."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1)))
                       for x in df], np.int64)
    shipped = docs.sparkSession.sparkContext.broadcast((terms, weight))
    n_items = len(terms.item_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight = shipped.value
        names = pa.array(terms.item_ids, pa.int64())
        bar = np.ones(n_items, np.int64)  # the score that a row must reach
        kept: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def settled() -> list[tuple[np.ndarray, ...]]:
            cols = [np.concatenate(c) for c in zip(*kept, strict=True)]
            cols = tuple(c[best(*cols[:4])] for c in cols)
            low = np.full(n_items, np.iinfo(np.int64).max)
            np.minimum.at(low, cols[0], cols[1])
            np.copyto(bar, low, where=np.bincount(cols[0], minlength=n_items) >= TOP)
            return [cols]

        def batch_of(item, score, doc, null, uid) -> pa.RecordBatch:
            return pa.record_batch([names.take(pa.array(item)), pa.array(doc, mask=null),
                                    pa.array(uid), pa.array(score)],
                                   names=["item_id", "doc_id", "uid", "score"])

        for batch in batches:
            ids = batch.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            uids = batch.column("uid").to_numpy(zero_copy_only=False).astype(np.int64)
            for block in blocks(batch.column("text")):
                doc, term, tf, n = terms.counts(block)
                m = 25 + (75 * n * n_docs) // max(n_terms, 1)
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                step = max(1, CELLS // n_items)
                for a in range(0, block.n, step):
                    lo, hi = np.searchsorted(doc, (a, a + step))
                    t = term[lo:hi]
                    size = terms.first[t + 1] - terms.first[t]
                    at = (np.repeat(terms.first[t] - (np.cumsum(size) - size), size)
                          + np.arange(size.sum()))
                    table = np.zeros(min(step, block.n - a) * n_items, np.int64)
                    np.add.at(table, np.repeat(doc[lo:hi] - a, size) * n_items + terms.item[at],
                              np.repeat(value[lo:hi], size) * terms.times[at])
                    table = table.reshape(-1, n_items)
                    d, item = np.nonzero(table >= bar)
                    row = block.row0 + a + d
                    out = (item, table[d, item], ids[row], null[row], uids[row])
                    if not whole:
                        yield batch_of(*out)
                        continue
                    kept.append(out)
                    rows += len(d)
                    if rows > max(1 << 16, 4 * TOP * n_items):
                        kept[:] = settled()
                        rows = len(kept[0][0])
        if kept:
            yield batch_of(*settled()[0])

    return docs.mapInArrow(run, "item_id long, doc_id long, uid long, score long")


def dealt(terms: DataFrame) -> tuple[list[list], list[list[list]]]:
    """Rows ``(item_id, term, times)`` of each block, and of each piece of each
    item that is beyond a block; every list is within ``BLOCK_BYTES``."""
    sized = terms.withColumn("bytes", F.octet_length("term") + 16)
    per_item = sized.groupBy("item_id").agg(F.sum("bytes").alias("size"))
    item = F.xxhash64("item_id", F.lit("block"))
    small = per_item.filter(F.col("size") <= BLOCK_BYTES)
    total = small.agg(F.sum("size")).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    while n > 1 and small.groupBy(F.pmod(item, F.lit(n)).alias("b")).agg(
            F.sum("size").alias("s")).agg(F.max("s")).first()[0] > BLOCK_BYTES:
        n *= 2

    def rows(part: DataFrame) -> list[tuple]:
        return [(r["item_id"], r["term"], r["times"]) for r in
                part.select("item_id", "term", "times").collect()]

    same = terms["item_id"].eqNullSafe(F.col("_item"))
    keep = terms.join(small.select(F.col("item_id").alias("_item")), same, "left_semi")
    whole = [rows(keep.filter(F.pmod(item, F.lit(n)) == b)) for b in range(n)]
    cut = []
    for r in per_item.filter(F.col("size") > BLOCK_BYTES).collect():
        own = sized.filter(F.col("item_id").eqNullSafe(F.lit(r["item_id"])))
        k, piece = 2 * -(-r["size"] // BLOCK_BYTES), F.xxhash64("term", F.lit("piece"))
        while own.groupBy(F.pmod(piece, F.lit(k)).alias("p")).agg(F.sum("bytes").alias("s")).agg(
                F.max("s")).first()[0] > BLOCK_BYTES:
            k *= 2
        cut.append([rows(own.filter(F.pmod(piece, F.lit(k)) == p)) for p in range(k)])
    return [w for w in whole if w], cut


def ranked(rows: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``TOP`` best rows of each item,
    found in groups of tasks first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = rows.withColumn("_part", F.spark_partition_id() % 64)
    for keys in (["item_id", "_part"], ["item_id"]):
        rows = rows.withColumn("rank", F.row_number().over(
            Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= TOP)
    return rows.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score`` for ``items(item_id, text)`` over
    ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    terms = materialize(item_terms(items.select(F.col("item_id").cast("long"), "text")),
                        "item-terms")
    whole, cut = dealt(terms)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = spark.createDataFrame([], "item_id long, doc_id long, uid long, score long")
    for rows in whole:
        block = Terms(rows)
        out = out.unionByName(scored(docs.withColumn("uid", F.lit(0).cast("long")), block,
                                     *statistics(docs, block)))
    if cut:  # parts of a score meet by a key per row
        keyed = materialize(docs.withColumn("uid", F.monotonically_increasing_id()), "rows")
        for pieces in cut:
            parts = []
            for rows in filter(None, pieces):
                block = Terms(rows)
                parts.append(materialize(scored(keyed, block, *statistics(docs, block), whole=False),
                                         "partial-scores"))
            both = parts[0]
            for p in parts[1:]:
                both = both.unionByName(p)
            out = out.unionByName(both.groupBy("item_id", "doc_id", "uid").agg(
                F.sum("score").alias("score")))
    return ranked(out)
