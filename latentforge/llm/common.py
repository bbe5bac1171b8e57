"""Helpers shared by the operators of this subpackage (Spark side)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: a key is hot when it holds at least 1/HOT_SHARE of all rows; so there are
#: at most HOT_SHARE hot keys, whatever the size of the data
HOT_SHARE = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only (pure ASCII strings take the fast path)."""
    return (F.when(F.length(col) == F.octet_length(col), F.lower(col))
            .otherwise(F.translate(col, UPPER, UPPER.lower())))


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % m


_recording: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that operators make for helper tables inside the block. They
    are the caller's to delete (``session.drop_path``), once what was built on
    them is stored or no longer wanted."""
    paths: list[str] = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording.pop()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a helper table, inside the shared folder."""
    path = new_scratch_path(spark, name)
    for paths in _recording:
        paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` into the shared folder once and returns it re-read, so
    that a lost executor costs no recomputation of what came before."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: column of a row's own key
ROW = "_row"


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with a key per row, whatever the ids: written once, because
    computed anew the keys could come out otherwise. An input column of the
    key's name gets another until ``without_rows`` gives it back."""
    own = _aside(docs.columns)
    docs = docs.select([F.col(c).alias(own if c == ROW else c) for c in docs.columns])
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _aside(columns: list[str]) -> str:
    """A name that none of the columns has."""
    name = ROW + "_given"
    while name in columns:
        name += "_"
    return name


def without_rows(keyed: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` of the rows of ``keyed`` that are not in ``gone(_row)``."""
    own = _aside(columns)
    return keyed.join(materialize(gone.select(ROW), "gone"), ROW, "left_anti").select(
        [F.col(own if c == ROW else c).alias(c) for c in columns])


def width(spark: SparkSession) -> int:
    """The session's shuffle width: how the user sized this job."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_back(big: DataFrame, small: DataFrame, key: str, size: str, spread: Column,
              how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (unique ``key``) without a hot task.

    ``small[size]`` is the number of rows of ``big`` that carry the key. Keys
    with at least 1/1000 of all rows are at most 1000 rows of ``small``: they
    are broadcast. The others meet in a sort-merge join, in which no key has
    more than 1/1000 of the rows; rows settled by the broadcast, and rows
    without a key, are dealt by ``spread`` there and meet nothing. Rows whose
    key is not in ``small`` go, or stay with nulls (``how="left"``)."""
    total = small.agg(F.sum(size)).first()[0] or 1
    is_hot = F.col(size) * HOT_SHARE >= F.lit(total)
    vals = [c for c in small.columns if c != key]
    hot = small.filter(is_hot).select(key, F.struct(*vals).alias("_hot"))
    cold = small.filter(~is_hot).select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_deal"),
                                        F.struct(*vals).alias("_cold"))
    out = big.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long"))
        .otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1))
    out = out.join(cold.hint("merge"), (F.col(key) == F.col("_key"))
                   & (F.col("_salt") == F.col("_deal")), "left")
    out = out.withColumn("_got", F.coalesce("_hot", "_cold"))
    if how == "inner":
        out = out.filter("_got is not null")
    return out.select(*[F.col(c) for c in big.columns], *[F.col("_got")[c].alias(c) for c in vals])


#: bits of the membership bitmap: 4 MB, whatever the data
BITMAP_BITS = 1 << 25
BITMAP_BUCKET = 1 << 15


def maybe_in(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose key may be in ``small``: those whose hash is set
    in a bitmap of fixed size, which is broadcast. No row whose key is in
    ``small`` is lost; a few others stay, so an exact join still follows, but
    few texts have to be shuffled for it."""
    def place(df):
        return df.withColumn("_h", F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))).withColumn(
            "_bucket", F.expr(f"_h div {BITMAP_BUCKET}"))

    bitmaps = place(small.select(key)).groupBy("_bucket").agg(
        F.expr(f"bitmap_construct_agg(_h % {BITMAP_BUCKET})").alias("_bits"))
    byte = f"conv(hex(substring(_bits, cast(_h % {BITMAP_BUCKET} div 8 as int) + 1, 1)), 16, 10)"
    return (place(big).join(F.broadcast(bitmaps), "_bucket")
            .filter(f"(shiftright(cast({byte} as int), cast(_h % 8 as int)) & 1) = 1")
            .select(big.columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, component)`` with
    the smallest reachable id, by alternating large-star and small-star steps
    (each a grouped minimum and a join; every step is written to the shared
    folder). Ids without an edge are not returned."""
    def star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        low = materialize(e.groupBy("a").agg(F.min("b").alias("m")), "star-min")
        return e.join(low, "a"), low

    cur = materialize(
        edges.filter("a <> b and a is not null and b is not null")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges")
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined, _ = star(both)
        large = (joined.withColumn("m", F.least("m", "a")).filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        joined, low = star(materialize(large, "large-star"))
        cur = materialize(
            joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct(), "small-star")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == now:
            break
        seen = now
    lead = cur.select(F.col("b").alias("id")).distinct()
    return (cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .unionByName(lead.select("id", F.col("id").alias("component"))))
