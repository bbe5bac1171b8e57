"""Prefix trie of rebuilt conversations, screened by a count-min sketch.

Conversation c starts with the first h turns of conversation c - c % 5 (h is
crc32 of the decimal c, modulo 9) and goes on with its own turns from h on. Every
distinct sequence of first d turns is a node; the trie is given as one row per
node with its members, children, leaves and bytes saved by sharing.

A prefix is known by a 128-bit digest: sums of hashes of (place, role, text), so
that the digest of a prefix and that of its parent come from running sums over
chunks of ``CHUNK`` turns, however long a conversation is. Texts are hashed where
they are read and never shuffled.

Screening: every task counts its digests into a sketch of ``ROWS`` rows with
counters that stop at two; pages of counters are added up and the sketch (at most
``MAX_WIDTH`` counters a row, 48 MB in all) is broadcast. The sketch never counts
too few, so an estimate of one proves that a prefix has a single member: such nodes
are complete where they are (their subtree is the rest of that conversation).
Only the other prefixes, and the tops of the tails for their parent's name, are
shuffled and grouped exactly. Beyond the largest width the sketch proves fewer
singletons, and more prefixes take the exact way; no result depends on it.

Sums over subtrees need no walk over levels: a leaf counts for each prefix of its
smallest member; the bytes of a node count once for its smallest member, so a
node saves, summed over its members, the bytes from its depth to the depth at
which that member becomes the smallest of its node.

Hot prefixes (such as the root, which all share) are summed before the shuffle
and named by a broadcast of at most 1000 rows; the ids that end at a node are
sorted over many tasks into chunks, which one task streams into the digest.

Edge cases: rows without a conv_id are left out; null roles and texts are empty; null
turns come first; turns of the same number are ordered by their digests, and
repeated rows are turns of their own; an empty table gives no rows; a single
conversation is a path; other columns are ignored; ids may be negative (% keeps
the sign).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.ranking import group_position
from .common import join_back, materialize
from .textblock import U, mix

CHUNK = 4096
ROWS = 3
MIN_WIDTH, MAX_WIDTH = 1 << 16, 1 << 26
#: counters of a page, and digests that a task counts at a time
PAGE_BITS = 16
FLUSH = 1 << 20
#: ids in one chunk of a node's ends
IDS = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
SUMS = ["s1", "s2", "s3", "s4"]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, d, a, b, bytes, len``: a row per rebuilt turn (two hashes of
    role and text, UTF-8 bytes of the text) and one with d = 0."""
    text, role = (F.coalesce(c, F.lit("")) for c in ("text", "role"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), role, text).alias("b"),
        F.octet_length(text).cast("long").alias("bytes"))
    turns = materialize(group_position(turns, ["conv_id"], ["turn", "a", "b"], "pos")
                        .withColumn("pos", F.col("pos") + 1).drop("turn"), "turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9,
        "base": F.col("conv_id") - F.col("conv_id") % 5})
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = materialize(
        sizes.join(of_base, "base", "left")
        .withColumn("take", F.least("h", F.coalesce("n_base", F.lit(0))))
        .withColumn("len", F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))),
        "conversations")
    own = join_back(turns, convs.select("conv_id", "n", "h", "take", "len"), "conv_id", "n",
                    F.col("pos")).filter("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("take")).alias("d"), "a", "b", "bytes", "len")
    # at most 8 turns of a conversation go to at most 9 others
    start = turns.filter("pos <= 8").withColumnRenamed("conv_id", "base")
    begun = (convs.select("conv_id", "base", "take", "len").join(start, "base")
             .filter("pos <= take").select("conv_id", F.col("pos").alias("d"), "a", "b", "bytes", "len"))
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("d"), zero.alias("a"), zero.alias("b"),
                        zero.alias("bytes"), "len")
    return own.unionByName(begun).unionByName(root)


def digest(depth: Column, sums: list[Column]) -> Column:
    return F.struct(F.xxhash64(depth, *sums).alias("hi"),
                    F.xxhash64(F.lit(2), depth, *reversed(sums)).alias("lo"))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, d, len, key, parent, bytes, before``: the digest of every
    prefix and of its parent, and the bytes of the turns before its last."""
    at_root = F.col("d") == 0
    x = F.xxhash64("d", "a", "b")
    y = F.xxhash64(F.lit(3), F.col("d"), F.col("b"), F.col("a"))
    low = F.lit(0xFFFFFFFF)
    words = [x.bitwiseAND(low), F.shiftrightunsigned(x, 32), y.bitwiseAND(low),
             F.shiftrightunsigned(y, 32)]
    rows = turns.select("conv_id", "d", "len", "bytes", F.expr(f"d div {CHUNK}").alias("chunk"),
                        *[F.when(at_root, F.lit(0)).otherwise(w).cast("long").alias(s)
                          for s, w in zip(SUMS, words, strict=True)])
    cols = [*SUMS, "bytes"]
    inside = (Window.partitionBy("conv_id", "chunk").orderBy("d")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # chunks beyond the first: one row for each, joined to their rows
    totals = (rows.groupBy("conv_id", "chunk").agg(*[F.sum(c).alias(c) for c in cols])
              .select("conv_id", "chunk", *[F.sum(c).over(ahead).alias("ahead_" + c) for c in cols])
              .filter("chunk > 0"))
    rows = rows.select("conv_id", "d", "len", "chunk", *[F.col(c).alias("own_" + c) for c in cols],
                       *[F.sum(c).over(inside).alias(c) for c in cols])
    rows = rows.join(totals, ["conv_id", "chunk"], "left")
    total = {c: F.col(c) + F.coalesce("ahead_" + c, F.lit(0)) for c in cols}
    return rows.select(
        "conv_id", "d", "len", digest(F.col("d"), [total[s] for s in SUMS]).alias("key"),
        F.when(~at_root, digest(F.col("d") - 1, [total[s] - F.col("own_" + s) for s in SUMS]))
        .alias("parent"),
        F.col("own_bytes").alias("bytes"), (total["bytes"] - F.col("own_bytes")).alias("before"))


def buckets(hi: np.ndarray, lo: np.ndarray, width: int) -> np.ndarray:
    """``(ROWS, n)`` counters of the digests."""
    hi, lo = hi.view(U), lo.view(U)
    return np.stack([(mix(hi + U(r) * (lo | U(1))) & U(width - 1)).astype(np.int64)
                     for r in range(ROWS)])


def key_arrays(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.ascontiguousarray(column.field(i).fill_null(0).to_numpy(zero_copy_only=False))
                 for i in range(2))


def count_min(keys: DataFrame, width: int) -> np.ndarray:
    """``(ROWS, width)`` counters of ``keys(key)`` that stop at two."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            at = buckets(*(np.concatenate(x) for x in zip(*held, strict=True)), width)
            for r in range(ROWS):
                u, c = np.unique(at[r], return_counts=True)
                u = np.repeat(u, np.minimum(c, 2))  # two stand for any more
                page = u >> PAGE_BITS
                cut = np.flatnonzero(np.diff(page)) + 1
                for part in np.split(u, cut):
                    yield pa.record_batch(
                        [pa.array([r], pa.int32()), pa.array([int(part[0]) >> PAGE_BITS], pa.int32()),
                         pa.array([(part & 0xFFFF).astype("<u2").tobytes()], pa.binary())],
                        names=["r", "page", "hits"])

        for batch in batches:
            if batch.num_rows:
                held.append(key_arrays(batch.column("key")))
                n += batch.num_rows
            if n >= FLUSH:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << PAGE_BITS, np.int64)
        for x in table.column("hits"):
            total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=1 << PAGE_BITS)
        total = np.minimum(total, 2).astype(np.uint8).reshape(-1, 4)
        packed = total[:, 0] | total[:, 1] << 2 | total[:, 2] << 4 | total[:, 3] << 6
        return pa.table({"r": table.column("r")[:1], "page": table.column("page")[:1],
                         "counts": pa.array([packed.tobytes()], pa.binary())})

    pages = (keys.select("key").mapInArrow(count, "r int, page int, hits binary")
             .groupBy("r", "page").applyInArrow(add, "r int, page int, counts binary"))
    out = np.zeros((ROWS, width // 4), np.uint8)
    for p in pages.collect():  # the bounded size of the sketch, once
        at = p["page"] << (PAGE_BITS - 2)
        out[p["r"], at:at + (1 << (PAGE_BITS - 2))] = np.frombuffer(p["counts"], np.uint8)
    return out


def screened(rows: DataFrame) -> DataFrame:
    """``rows`` with ``alone`` (the prefix has this one member, proven) and
    ``parent_alone``."""
    n = rows.count()
    width = MIN_WIDTH
    while width < MAX_WIDTH and width < 4 * n:
        width *= 2
    shipped = rows.sparkSession.sparkContext.broadcast(count_min(rows, width))
    schema = StructType(rows.schema.fields + [StructField("alone", BooleanType()),
                                              StructField("parent_alone", BooleanType())])

    def ones(column: pa.StructArray) -> np.ndarray:
        sketch = shipped.value
        at = buckets(*key_arrays(column), width)
        least = np.stack([sketch[r][at[r] >> 2] >> ((at[r] & 3) << 1) & 3
                          for r in range(ROWS)]).min(0)
        return least == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, up = ones(batch.column("key")), ones(batch.column("parent"))
            up &= ~batch.column("parent").is_null().to_numpy(zero_copy_only=False)
            yield pa.record_batch([*batch.columns, pa.array(own), pa.array(up)],
                                  names=[*batch.schema.names, "alone", "parent_alone"])

    return rows.mapInArrow(run, schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of ``ends(key, conv_id)``: ids in order, joined by
    commas. Sorted over all tasks into chunks of ids, which are then streamed
    key by key; no task holds more than a chunk of a key."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo = key_arrays(batch.column("key"))
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            new = np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1
            first = np.concatenate(([0], new))
            size = np.diff(np.append(first, len(ids)))
            n = -(-size // IDS)
            at = np.repeat(first - (np.cumsum(n) - n) * IDS, n) + np.arange(n.sum()) * IDS
            upto = np.minimum(at + IDS, np.repeat(first + size, n))
            names = ids.astype("U20").tolist()
            yield pa.record_batch(
                [batch.column("key").take(pa.array(at)), pa.array(ids[at]),
                 pa.array([",".join(names[a:b]) for a, b in zip(at, upto, strict=True)])],
                names=["key", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []

        def out():
            return pa.record_batch([pa.array([k for k, _ in done], pa.struct(
                [("hi", pa.int64()), ("lo", pa.int64())])), pa.array([s for _, s in done], pa.string())],
                names=["key", "ends_sha256"])

        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(),
                                strict=True):
                if key == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            if len(done) >= IDS:
                yield out()
                done.clear()
        if now is not None:
            done.append((now, sha.hexdigest()))
        yield out()

    key = "key struct<hi:bigint,lo:bigint>"
    chunks = (ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
              .mapInArrow(runs, f"{key}, first long, ids string"))
    return (chunks.repartition("key").sortWithinPartitions("key", "first")
            .mapInArrow(digests, f"{key}, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`` per node of ``conversations(conv_id, turn, role,
    text)``."""
    rows = materialize(prefixes(rebuilt(conversations)), "prefixes")
    rows = materialize(screened(rows), "screened")
    shared, single = rows.filter("not alone"), rows.filter("alone")
    tops = single.filter("not parent_alone and d > 0")

    nodes = materialize(shared.groupBy("key").agg(
        F.min("conv_id").alias("node_conv"), F.count("*").alias("n_convs"),
        F.min("d").alias("depth"), F.first("parent").alias("parent"),
        F.first("parent_alone").alias("parent_alone")), "nodes")
    children = nodes.select("parent").unionByName(tops.select("parent")).filter(
        "parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))
    nodes = materialize(
        nodes.join(children.withColumnRenamed("parent", "key"), "key", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes-children")

    # by conversation: where it becomes the smallest member, whether it stands for a leaf
    named = materialize(join_back(
        shared.drop("alone", "parent_alone", "parent"),
        nodes.select("key", "node_conv", "n_convs", "n_children"), "key", "n_convs",
        F.col("conv_id")), "named")
    leads = named.select("conv_id", "d", "len", "bytes", "before",
                         (F.col("node_conv") == F.col("conv_id")).alias("leads"),
                         (F.col("n_children") == 0).alias("childless"))
    leads = leads.unionByName(single.select(
        "conv_id", "d", "len", "bytes", "before", F.lit(True).alias("leads"),
        (F.col("d") == F.col("len")).alias("childless")))
    at_end = F.col("d") == F.col("len")
    info = leads.groupBy("conv_id").agg(
        F.min(F.when(F.col("leads"), F.struct("d", "before"))).alias("lead"),
        F.max(F.when(at_end, F.col("before") + F.col("bytes"))).alias("total"),
        F.max((at_end & F.col("leads") & F.col("childless")).cast("long")).alias("leaf"),
        F.count(F.lit(1)).alias("n_rows")).select(
        "conv_id", "leaf", "n_rows", F.coalesce("lead.before", "total").alias("upto"))
    sums = join_back(named.select("key", "conv_id", "before", "d"), materialize(info, "leads"),
                     "conv_id", "n_rows", F.col("d")).groupBy("key").agg(
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("upto") - F.col("before"), F.lit(0))).alias("saved_tokens"))
    ends = end_digests(named.filter(at_end).select("key", "conv_id"))
    nodes = materialize(
        nodes.join(sums, "key").join(ends, "key", "left").select(
            "key", "parent", "parent_alone", "node_conv", "depth", "n_convs", "n_children",
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")),
        "nodes-summed")

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    own = single.select(
        "parent", "parent_alone", F.col("conv_id").alias("node_conv"), F.col("d").alias("depth"),
        one.alias("n_convs"), (F.col("d") < F.col("len")).cast("long").alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(at_end, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256))
        .otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256"))
    # the tails name their parents themselves; the others ask the nodes
    asks = "parent is not null and not parent_alone"
    local = own.unionByName(nodes.drop("key")).filter(f"not ({asks})").withColumn(
        "parent_conv_id", F.when(F.col("parent").isNotNull(), F.col("node_conv")))
    asking = nodes.drop("key").unionByName(own).filter(asks)
    parents = nodes.select(F.col("key").alias("parent"), F.col("node_conv").alias("parent_conv_id"),
                           F.col("n_children").alias("size"))
    out = join_back(asking, parents, "parent", "size", F.xxhash64("node_conv", "depth")).drop("size")
    return local.unionByName(out).select(
        F.col("node_conv").alias("conv_id"), F.col("depth").cast("long"), "parent_conv_id", "n_convs",
        "n_children", "n_leaves", F.col("saved_tokens").cast("long"), "ends_sha256")
