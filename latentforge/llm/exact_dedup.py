"""Exact de-duplication against a persistent digest index.

The index is a Parquet table in the shared folder, bucketed and sorted by the
SHA-256 digest of the normalised text (A-Z lower-cased; null counts as empty).
A batch is reduced to its distinct digests (map-side partial aggregates, so a
text that fills a third of the batch costs one row per task), sort-merge
anti-joined with the index (the index side needs no shuffle) and only the new
digests are appended. The first batch to bring a text in owns it; inside a
batch the largest ``doc_id`` does.

Edge cases: null text equals empty text; null ids never win over ids (a text
whose ids are all null keeps them all); repeated rows share one verdict;
an empty batch appends nothing; further columns are ignored. ``keep_exact``
goes by a key per row instead: of each text exactly one row stays, that of the
largest id, or of no id where none has one, and of rows that share it the first.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (ROW, ascii_lower, join_back, materialize, scratch_folder, width, with_row_key,
                     without_rows)


def with_digest(docs: DataFrame, text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, digest`` and the columns ``also``: one narrow row per document."""
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select("doc_id", *also, F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """A bucketed, sorted table of ``(digest, keep_id)`` at ``path``.

    Opening the path of an existing index continues it, in the buckets it was
    made with (they are noted beside the files), whatever ``buckets`` says."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path = spark, path
        self.buckets = buckets = self.layout(buckets)
        self.table = "digest_index_" + uuid.uuid4().hex[:12]
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
                  f"LOCATION '{path}'")

    def layout(self, buckets: int) -> int:
        """The number of buckets at ``path``, noted there by the first opening."""
        note = self.path.rstrip("/") + "/_layout"  # hidden from the table's scans
        try:
            return self.spark.read.schema("buckets int").parquet(note).first()["buckets"]
        except AnalysisException:
            self.spark.range(1).select(F.lit(buckets).cast("int").alias("buckets")).coalesce(
                1).write.parquet(note)
            return buckets

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, batch: DataFrame) -> None:
        """Adds the digests of ``batch(doc_id, digest)`` that are new."""
        firsts = batch.groupBy("digest").agg(F.max("doc_id").cast("long").alias("keep_id"))
        fresh = firsts.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        # the files being read are those appended to: settle the new rows first
        (materialize(fresh, "digests-new").repartition(self.buckets, "digest")
         .write.insertInto(self.table))

    def verdicts(self, digests: DataFrame, *more: Column) -> DataFrame:
        """``digest, keep_id, group_size`` (and further aggregates) for the
        digests of a batch."""
        sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"), *more)
        return sizes.join(self.rows().hint("merge"), "digest")

    def close(self) -> None:
        """Forgets the session's name for the table; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def id_batches(digests: DataFrame, n: int) -> list[DataFrame]:
    """Equal spans of doc_id, newest first; null ids come last."""
    lo, hi = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    if lo is None:
        return [digests]
    cuts = sorted({lo + (hi - lo + 1) * i // n for i in range(1, n)}, reverse=True)
    spans, upper = [], None
    for cut in [*cuts, None]:
        cond = F.lit(True) if cut is None else F.col("doc_id") >= cut
        if upper is not None:
            cond &= F.col("doc_id") < upper
        if cut is None:
            cond = F.coalesce(cond, F.lit(True))
        spans.append(digests.filter(cond))
        upper = cut
    return spans


def indexed(digests: DataFrame, batches: int, path: str | None, *more: Column) -> DataFrame:
    """Verdict per digest, after ``batches`` spans of descending ids have each
    been checked against the index so far."""
    spark = digests.sparkSession
    index = DigestIndex(spark, path or scratch_folder(spark, "digest-index"), width(spark))
    for part in id_batches(digests, batches):
        index.append(part)
    found = materialize(index.verdicts(digests, *more), "digest-verdicts")
    index.close()
    return found


def exact_dedup(docs: DataFrame, batches: int = 2, path: str | None = None) -> DataFrame:
    """Verdict per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The documents arrive in ``batches`` spans of descending ids, each checked
    against the index so far, so the largest id of equal texts stays."""
    digests = materialize(with_digest(docs), "digests")
    found = indexed(digests, batches, path)
    return join_back(digests, found, "digest", "group_size", F.col("doc_id")).select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_exact(docs: DataFrame, batches: int = 2) -> DataFrame:
    """``docs`` with exactly one row of each text."""
    keyed = with_row_key(docs)
    digests = materialize(with_digest(keyed, also=(ROW,)), "digests")
    # null ids come before all others, so the largest id wins, then the first row
    lead = F.max(F.struct("doc_id", (-F.col(ROW)).alias("back"))).alias("lead")
    found = indexed(digests, batches, None, lead).filter("group_size > 1").select(
        "digest", "group_size", (-F.col("lead").getField("back")).alias("lead"))
    return without_rows(keyed, join_back(digests, found, "digest", "group_size", F.col(ROW))
                        .filter(F.col(ROW) != F.col("lead")), docs.columns)
