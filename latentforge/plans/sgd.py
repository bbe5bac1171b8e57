"""Block-stratified stochastic gradient descent (distributed SGD).

Method: Gemulla, Nijkamp, Haas, Sismanis, "Large-scale matrix
factorization with distributed stochastic gradient descent", KDD 2011.

Users and items are hashed into B blocks each. In stratum g (0..B-1)
task b works on rating block (b, (b+g) mod B); the blocks of one stratum
share no user and no item, so they run in parallel without locks and the
result does not depend on scheduling. B strata make one epoch.

B follows from the number of ratings and a bound on the rows of a block
(``rows_per_block``), and from nothing else: the same seed gives the same
model on any cluster, and a group never grows with the data.

A stratum is not a job of its own. Two blocks that share neither user nor item
may run in any order, so neighbouring blocks are run together: ``span`` user
blocks and ``span`` item blocks make a *group*, and the groups (U, U+G) run in
stage G. Within a group the ratings keep the serial order (stratum, user block,
piece, order of the epoch). The serial pass takes the items of a user, and the
users of an item, in an order that these stages keep, if the group (U, U) runs
twice: first its blocks of items not before the user block, and after all other
stages the rest. So the model is that of the strata one by one, bit for bit, and
an epoch has about ``sqrt(n / GROUP_ROWS)`` stages, or as many as keep a group's factors
near ``GROUP_BYTES`` (8 at least, as far as there are blocks), however small the blocks:
the factors move that many times.

Data flow (all DataFrame operations):

* the training ratings are read once, written to the shared folder, and
  from there written again as a table partitioned by stage (by stratum, where a
  group is a block), so a stage reads only its own files;
* one factor table holds both sides in chunks (``packed``), each of rows of one
  side and group, ``hblk`` being the group's place on that side; the group of
  a chunk in stage g is that place for users and ``(hblk - g) mod groups`` for items;
* ``cogroup`` of the stage's ratings, packed as they are read, with the factors, keyed
  by that group, runs one numpy step per group and returns the updated factors;
* the ratings of an error trace lie in the same blocks, and meet the factors in the
  same way, a few stages in a job; no rating carries a vector;
* every ``STRATA_PER_JOB`` stages the factors are written to the shared
  folder and the previous files deleted: plans stay small for any B, and a
  lost executor costs a few stages.

Every id follows one update rule. A block with more than ``rows_per_block``
ratings, as one that holds a hot user or item, is cut into pieces (by the
ratings' hashes, so that a hot id's row is cut by partner), which run one after
another; a group beyond ``group_rows`` ratings is cut along the serial order,
between blocks and pieces, into runs. Pieces (where a group is a block) and runs
are groups of their own, groups without further ones wait. So no group grows
with a hot id, and a fit is still the serial pass over (stratum, user block,
piece, order of the epoch), in which blocks of one stratum do not touch each other.

``split_threshold`` is off unless set: it trains ids with more ratings than
that as replicas (dealt by hash of the partner id, averaged after every
epoch), a different algorithm that runs a hot id's ratings in parallel. Its factor
rows ``(kind, id, rep, bias, factors, hblk, n_updates)`` are not in chunks.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session
from ..functions.hashing import SCALE, hash_bucket, hash_int, key
from ..functions.ranking import prefix_sums
from ..session import drop_path, new_scratch_path, write_table
from . import packed
from .factors import SgdParams, init_factors

FACTORS_OUT = ("kind string, id long, rep int, bias double, factors array<double>, "
               "hblk int, n_updates long")
OUT_COLUMNS = ["kind", "id", "rep", "bias", "factors", "hblk", "n_updates"]
#: default bound on the ratings of one block
ROWS_PER_BLOCK = 1 << 15
#: ratings of a group of blocks, and groups per side to run at once if there are
#: as many blocks
GROUP_ROWS, GROUPS = 1 << 20, 8
#: bytes of a group's factors, and of the factors that a job of an error trace moves
GROUP_BYTES, TRACE_BYTES = 3 << 24, 1 << 30
#: bits of a piece in the number of a cell
PIECE_BITS = 28
#: stages chained in one job between two writes of the factors
STRATA_PER_JOB = 4
#: bytes moved by the stages of a fit, after which the shuffle files of superseded
#: factors are released
RELEASE_BYTES = 1 << 31
#: features of a row up to which a stage moves them as columns instead of an array
FLAT_WIDTH = 64
#: ratings per file of the stratum table
ROWS_PER_FILE = 1 << 20


@dataclass
class SgdModel:
    """``user_factors`` / ``item_factors``: (id, bias, factors, n_updates)."""
    user_factors: DataFrame
    item_factors: DataFrame
    mu: float
    params: SgdParams
    trace: list = field(default_factory=list)
    block_sizes: DataFrame | None = None
    epoch_seconds: list = field(default_factory=list)
    blocks: int = 0


@dataclass
class Prepared:
    """Training ratings laid out for SGD; one layout serves many settings."""
    ratings: DataFrame       # partitioned by stratum, or by stage
    base: DataFrame          # user_id, item_id, rating as read, and hashes of the ids
    reps: DataFrame | None   # (kind, id, n_rep) of split ids
    labels: DataFrame        # (blk, label)
    cut_blocks: DataFrame | None   # (stratum, ublk, n_pieces) of groups in pieces
    pieces: dict             # stratum -> most pieces of a group, where over 1
    blocks: int
    n: int
    mu: float
    seed: int
    span: int = 1            # blocks per side of a group
    source: DataFrame | None = None   # the ratings as given

    @property
    def groups(self) -> int:
        return -(-self.blocks // self.span)

    @property
    def stages(self) -> int:
        return self.blocks if self.span == 1 else self.groups + 1

    @property
    def at(self) -> tuple[str, str, str]:
        """Columns of the ratings: stage, group and piece of the group."""
        return ("stratum", "ublk", "piece") if self.span == 1 else ("stage", "grp", "run")


def choose_blocks(n_ratings: int, rows_per_block: int = ROWS_PER_BLOCK) -> int:
    """Blocks per side so that a block has about ``rows_per_block`` ratings.

    There are B² blocks, at least 2 per side: no group holds everything.
    """
    return max(2, math.ceil(math.sqrt(n_ratings / rows_per_block)))


def block_labels(spark: SparkSession, n_blocks: int) -> list[int]:
    """Integers whose Spark hash partition is 0..B-1, one per block.

    Hashing the labels 0..B-1 directly leaves partitions empty; this picks,
    for each partition number, the smallest integer that lands there.
    A bounded probe: 64·B small integers.
    """
    probe = (spark.range(0, 64 * n_blocks)
             .select(F.col("id").cast("int").alias("label"),
                     F.pmod(F.hash(F.col("id").cast("int")), F.lit(n_blocks)).alias("part"))
             .groupBy("part").agg(F.min("label").alias("label"))
             .collect())
    found = {int(r["part"]): int(r["label"]) for r in probe}
    if len(found) < n_blocks:
        raise RuntimeError(f"no label found for some of {n_blocks} blocks")
    return [found[b] for b in range(n_blocks)]


def conflict_free_rounds(users: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Round of each update, in the given order, so that no round repeats a
    user or an item and every user's (item's) updates keep their order.

    Applying the rounds one after another, each as one vectorised update,
    is then exactly the serial SGD pass over the permutation sorted by
    (round, position). An update waits for the one before it of its user and
    of its item; rounds are the levels of that graph, peeled off with array
    operations, each update being touched twice at most.
    """
    n = len(users)
    out = np.zeros(n, dtype=np.int64)
    after, waits = [], np.zeros(n, dtype=np.int64)
    for ids in (users, items):
        order = np.argsort(ids, kind="stable")
        same = np.flatnonzero(ids[order][1:] == ids[order][:-1])
        nxt = np.full(n, -1, dtype=np.int64)
        nxt[order[same]] = order[same + 1]
        waits[order[same + 1]] += 1
        after.append(nxt)
    ready = np.flatnonzero(waits == 0)
    level = 0
    while len(ready):
        out[ready] = level
        following = np.concatenate([after[0][ready], after[1][ready]])
        following = following[following >= 0]
        np.subtract.at(waits, following, 1)
        ready = np.unique(following[waits[following] == 0])
        level += 1
    return out


def epoch_order(ords: np.ndarray, epoch: int) -> np.ndarray:
    """Sort keys of an epoch: the rating's hash and the epoch through a
    64-bit finaliser, so that every epoch has an order of its own."""
    x = ords.astype(np.uint64) ^ (np.uint64(epoch + 1) << np.uint64(32))
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    return x ^ (x >> np.uint64(31))


def _positions(ids: pd.Series, reps: pd.Series, of: pd.DataFrame, side: str) -> np.ndarray:
    """Row in the factor table of each rating's (id, replica)."""
    if (of["rep"] == 0).all():
        at = pd.Index(of["id"]).get_indexer(ids)
        at = np.where(reps.to_numpy() == 0, at, -1)
    else:
        at = pd.MultiIndex.from_arrays([of["id"], of["rep"]]).get_indexer(
            pd.MultiIndex.from_arrays([ids, reps]))
    if (at < 0).any():
        raise RuntimeError(f"{int((at < 0).sum())} ratings of a block have no {side} factors")
    return at


def block_rounds(ratings: pd.DataFrame, ui: np.ndarray, ii: np.ndarray, epoch: int):
    """The group's ratings in its serial order, as rounds without conflicts:
    ``(seq, steps, slices)`` with the rows to update one after another, the place
    of each in the serial order of its block, and the rounds as runs of both."""
    keys = [ratings["item_id"].to_numpy(), ratings["user_id"].to_numpy(),
            epoch_order(ratings["ord"].to_numpy(), epoch)]
    cells = ratings["cell"].to_numpy() if "cell" in ratings.columns else None
    order = np.lexsort(keys if cells is None else [*keys, cells])
    place = np.arange(len(order))
    if cells is not None:
        new = np.flatnonzero(np.diff(cells[order])) + 1
        first = np.zeros(len(order), dtype=np.int64)
        first[new] = new
        place -= np.maximum.accumulate(first)
    rounds = conflict_free_rounds(ui[order], ii[order])
    # rounds one after another give what the serial order gives
    steps = np.lexsort((np.arange(len(order)), rounds))
    bounds = np.flatnonzero(np.diff(rounds[steps])) + 1
    return order[steps], place[steps], np.split(np.arange(len(order)), bounds)


def step_rates(p: SgdParams, ratings: pd.DataFrame, seq: np.ndarray, steps: np.ndarray,
               epoch: int, n_total: int) -> np.ndarray:
    """Learning rate of each update."""
    if p.schedule == "step":
        first = ratings["first_step"].to_numpy(dtype=np.float64)[seq] + float(epoch) * n_total
        return p.lr * p.decay ** (first + steps)
    return np.full(len(steps), p.lr * p.decay ** epoch)


def _make_step(mu: float, p: SgdParams, epoch: int, n_total: int):
    """The step of an epoch: serial SGD over a group's blocks, vectorised.

    ``schedule="epoch"``: rate lr·decay^epoch. ``schedule="step"``: the rate
    decays with every update and the count goes on over blocks and epochs;
    ``first_step`` is the number of updates before the block (or piece) in its
    epoch, to which a rating's place in the block's serial order is added.
    """
    lam, lb, td = p.lam, p.lr_bias, p.train_dims
    breg = p.bias_reg * p.lam

    def update(ratings: pd.DataFrame, ui, ii, U, bu, V, bi) -> None:
        r = ratings["rating"].to_numpy(dtype=np.float64)
        kk = U.shape[1] if td is None else min(td, U.shape[1])
        seq, steps, slices = block_rounds(ratings, ui, ii, epoch)
        rate = step_rates(p, ratings, seq, steps, epoch, n_total)
        for sl in slices:
            t = seq[sl]
            a = ui[t]
            b = ii[t]
            fu = U[a]
            fi = V[b]
            pred = np.einsum("ij,ij->i", fu, fi)
            if p.biased:
                pred = pred + mu + bu[a] + bi[b]
            e = r[t] - pred
            if p.biased:
                bu[a] += lb * (e - breg * bu[a])
                bi[b] += lb * (e - breg * bi[b])
            lr_t = rate[sl][:, None]
            e2 = e[:, None]
            U[a, :kk] = fu[:, :kk] + lr_t * (e2 * fi[:, :kk] - lam * fu[:, :kk])
            V[b, :kk] = fi[:, :kk] + lr_t * (e2 * fu[:, :kk] - lam * fi[:, :kk])

    return on_frames(update, p.k)


def on_frames(update, width: int):
    """Step ``(ratings, factors) -> factors`` on frames. ``update(ratings, ui, ii, U,
    bu, V, bi)`` changes matrices of ``width`` features and biases in place; ``ui`` and
    ``ii`` are the rows of each rating's user and item in them."""
    def step(ratings: pd.DataFrame, factors: pd.DataFrame) -> pd.DataFrame:
        if ratings.empty:
            return factors[OUT_COLUMNS]
        flat = factors.reset_index(drop=True)
        bias, vectors, count = _updated(update, ratings, flat, lambda f: np.vstack(
            f["factors"].to_numpy()).astype(np.float64))
        return flat.assign(bias=bias, factors=list(vectors), n_updates=count)[OUT_COLUMNS]

    step.update, step.width = update, width
    return step


def on_columns(update, names: list[str]):
    """The same step with a column for each feature: a group's features are one
    matrix, not an array object for each row."""
    kept = [c for c in OUT_COLUMNS if c != "factors"]

    def step(ratings: pd.DataFrame, factors: pd.DataFrame) -> pd.DataFrame:
        if ratings.empty:
            return factors[kept + names]
        flat = factors.reset_index(drop=True)
        bias, vectors, count = _updated(update, ratings, flat, lambda f: f[names].to_numpy(
            dtype=np.float64))
        return pd.concat([flat[kept].assign(bias=bias, n_updates=count),
                          pd.DataFrame(vectors, columns=names)], axis=1)

    return step


def _updated(update, ratings: pd.DataFrame, factors: pd.DataFrame, matrix):
    """``(bias, features, n_updates)`` of the factor rows after ``update``."""
    is_user = (factors["kind"] == "u").to_numpy()
    at_u, at_i = np.flatnonzero(is_user), np.flatnonzero(~is_user)
    ids = factors[["id", "rep"]]
    ui = _positions(ratings["user_id"], ratings["urep"], ids.iloc[at_u], "user")
    ii = _positions(ratings["item_id"], ratings["irep"], ids.iloc[at_i], "item")
    vectors = matrix(factors).copy(order="C")
    bias = factors["bias"].to_numpy(dtype=np.float64).copy()
    count = factors["n_updates"].to_numpy().copy()
    U, V, bu, bi = vectors[at_u], vectors[at_i], bias[at_u], bias[at_i]
    update(ratings, ui, ii, U, bu, V, bi)
    for at, own, b, rows in ((at_u, U, bu, ui), (at_i, V, bi, ii)):
        vectors[at], bias[at] = own, b
        count[at] += np.bincount(rows, minlength=len(at))
    return bias, vectors, count


def _replicas(base: DataFrame, threshold: int) -> DataFrame:
    """(kind, id, n_rep) of the ids with more than ``threshold`` ratings."""
    sides = base.select(F.explode(F.array(
        F.struct(F.lit("u").alias("kind"), F.col("user_id").alias("id")),
        F.struct(F.lit("i").alias("kind"), F.col("item_id").alias("id")))).alias("s"))
    return (sides.groupBy("s.kind", "s.id").agg(F.count(F.lit(1)).alias("n"))
                 .where(F.col("n") > F.lit(threshold))
                 .select("kind", "id", F.ceil(F.col("n") / F.lit(threshold)).cast("int")
                         .alias("n_rep")))


def _place(kind: str, rep, prep: Prepared):
    """Place of a factor row's group on its side."""
    block = hash_bucket(key(kind + "blk", prep.seed, "@id", rep), prep.blocks)
    return F.floor(block / F.lit(prep.span)).cast("int")


def _runs(r: DataFrame, group_rows: int) -> tuple[DataFrame, DataFrame, dict]:
    """Ratings with the ``run`` of their group: blocks and pieces in the serial
    order, up to about ``group_rows`` ratings; and the groups of several runs."""
    spark, cell = r.sparkSession, ["stage", "grp", "stratum", "ublk", "piece"]
    sizes = write_table(r.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")),
                        new_scratch_path(spark, "sgd-cells"))
    serial = Window.partitionBy("stage", "grp").orderBy("stratum", "ublk", "piece")
    upto = F.sum("n").over(serial.rowsBetween(Window.unboundedPreceding, -1))
    runs = sizes.withColumn("run", F.floor(F.coalesce(upto, F.lit(0)) / F.lit(group_rows))
                            .cast("int"))
    cut = write_table(runs.groupBy(F.col("stage").alias("stratum"), F.col("grp").alias("ublk"))
                      .agg((F.max("run") + 1).alias("n_pieces")).where("n_pieces > 1"),
                      new_scratch_path(spark, "sgd-cut-groups"))
    most = _most_pieces(cut)
    if not most:
        return r.withColumn("run", F.lit(0)), cut, most
    return r.join(runs.drop("n"), cell), cut, most


def _most_pieces(cut: DataFrame) -> dict:
    return {x["stratum"]: x["m"] for x in     # at most a row per stratum
            cut.groupBy("stratum").agg(F.max("n_pieces").alias("m")).collect()}


def prepare(train: DataFrame, *, seed: int = 0, blocks: int | None = None,
            rows_per_block: int = ROWS_PER_BLOCK,
            split_threshold: int | None = None, groups: int | None = None,
            group_rows: int = GROUP_ROWS, values: int = 16,
            group_bytes: int = GROUP_BYTES) -> Prepared:
    """Reads ``train(user_id, item_id, rating)`` once and lays it out.

    ``groups`` per side (by default as many as keep a group near ``group_rows``
    ratings and its factor rows of ``values`` numbers near ``group_bytes``, and
    ``GROUPS`` at least) say which blocks run together; the model does not depend
    on it."""
    spark = train.sparkSession
    base = write_table(train.select(
        "user_id", "item_id", F.col("rating").cast("double").alias("rating"),
        hash_int(key("sgd", seed, "@user_id", "@item_id")).alias("ord"),
        hash_int(key("ublk", seed, "@user_id", 0)).alias("uhash"),
        hash_int(key("iblk", seed, "@item_id", 0)).alias("ihash")),
        new_scratch_path(spark, "sgd-train"))
    st = base.agg(F.avg("rating").alias("mu"), F.count(F.lit(1)).alias("n"),
                  (F.approx_count_distinct("user_id") + F.approx_count_distinct("item_id"))
                  .alias("ids")).first()
    n = int(st["n"])
    B = int(blocks) if blocks else choose_blocks(n, rows_per_block)
    wanted = groups or max(GROUPS, math.ceil(math.sqrt(n / group_rows)),
                           math.ceil(int(st["ids"]) * 8 * (values + 2) / group_bytes))
    span = max(1, -(-B // wanted))
    reps = None
    r = base.withColumn("urep", F.lit(0)).withColumn("irep", F.lit(0))
    if split_threshold:
        reps = write_table(_replicas(base, int(split_threshold)),
                           new_scratch_path(spark, "sgd-replicas"))
        r = base
        for kind, id_col, partner, rep in (("u", "user_id", "item_id", "urep"),
                                           ("i", "item_id", "user_id", "irep")):
            hot = reps.where(F.col("kind") == kind).select(F.col("id").alias(id_col), "n_rep")
            r = r.join(hot, id_col, "left").withColumn(rep, F.when(
                F.col("n_rep").isNull(), F.lit(0)).otherwise(
                hash_bucket(key("rep", "@" + partner), F.col("n_rep"))).cast("int")).drop("n_rep")
        r = (r.withColumn("uhash", hash_int(key("ublk", seed, "@user_id", "@urep")))
              .withColumn("ihash", hash_int(key("iblk", seed, "@item_id", "@irep"))))
    r = (r.withColumn("ublk", F.pmod("uhash", F.lit(B)).cast("int"))
          .withColumn("iblk", F.pmod("ihash", F.lit(B)).cast("int")).drop("uhash", "ihash")
          .withColumn("stratum", F.pmod(F.col("iblk") - F.col("ublk"), F.lit(B))))
    over = write_table(
        r.groupBy("stratum", "ublk").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > F.lit(rows_per_block))
        .select("stratum", "ublk", F.ceil(F.col("n") / F.lit(rows_per_block)).cast("int")
                .alias("n_pieces")), new_scratch_path(spark, "sgd-cut-blocks"))
    pieces = _most_pieces(over)
    piece = F.lit(0)
    if pieces:
        r = r.join(over, ["stratum", "ublk"], "left")
        piece = F.when(F.col("n_pieces").isNull(), F.lit(0)).otherwise(
            F.pmod(F.col("ord"), F.col("n_pieces")))
    r = r.withColumn("piece", piece.cast("int")).drop("n_pieces")
    prep = Prepared(r, base, reps, None, over, pieces, B, n,
                    float(st["mu"]) if st["mu"] is not None else 0.0, seed, span, train)
    if span > 1:
        place = (F.floor(F.col("iblk") / F.lit(span)) - F.floor(F.col("ublk") / F.lit(span)))
        r = (r.withColumn("stage", F.when(F.col("iblk") >= F.col("ublk"), place)
                          .otherwise(place + prep.groups).cast("int"))
              .withColumn("grp", F.floor(F.col("ublk") / F.lit(span)).cast("int"))
              .withColumn("cell", F.shiftleft(F.col("stratum").cast("long") * B + F.col("ublk"),
                                              PIECE_BITS) + F.col("piece")))
        r, prep.cut_blocks, prep.pieces = _runs(r, group_rows)
    stage, _, part = prep.at
    files = max(1, n // prep.stages // ROWS_PER_FILE)
    path = new_scratch_path(spark, "sgd-strata")
    (r.repartition(stage, part, F.pmod(F.hash("user_id"), F.lit(files)))
      .write.partitionBy(stage, part).parquet(path))
    prep.ratings = spark.read.schema(r.schema).parquet(path)
    prep.labels = spark.createDataFrame(list(enumerate(block_labels(spark, prep.groups))),
                                        "blk int, label int")
    if not prep.pieces:
        prep.cut_blocks = None
    return prep


def _expand(f: DataFrame, reps: DataFrame | None, kind: str, prep: Prepared) -> DataFrame:
    """Training rows of one side: one per id, or ``n_rep`` for a split id."""
    if reps is None:
        e = f.withColumn("rep", F.lit(0))
    else:
        hot = reps.where(F.col("kind") == kind).select("id", "n_rep")
        e = f.join(hot, "id", "left").withColumn(
            "rep", F.explode(F.sequence(F.lit(0), F.coalesce("n_rep", F.lit(1)) - 1)))
    return e.select(F.lit(kind).alias("kind"), "id", F.col("rep").cast("int").alias("rep"),
                    "bias", "factors",
                    _place(kind, "@rep", prep).alias("hblk"),
                    # replicas add up: the count so far stays with the first
                    F.when(F.col("rep") == 0, F.col("n_updates")).otherwise(F.lit(0))
                     .cast("long").alias("n_updates"))


def _collapse(factors: DataFrame, kind: str, k: int, split: bool) -> DataFrame:
    """(id, bias, factors, n_updates) of one side; replicas averaged."""
    t = factors.where(F.col("kind") == kind)
    if not split:
        return t.select("id", "bias", "factors", "n_updates")
    g = t.groupBy("id").agg(F.avg("bias").alias("bias"), F.sum("n_updates").alias("n_updates"),
                            *[F.avg(F.element_at("factors", j + 1)).alias(f"_f{j}")
                              for j in range(k)])
    return g.select("id", "bias", F.array(*[F.col(f"_f{j}") for j in range(k)]).alias("factors"),
                    "n_updates")


def _group_block(g: int, blocks: int):
    """Group that a factor row belongs to in stage ``g``."""
    return F.when(F.col("kind") == "u", F.col("hblk")).otherwise(
        F.pmod(F.col("hblk") - F.lit(g), F.lit(blocks)))


def _null_ids():
    """Flags of a rating's null ids: 1 for the user, 2 for the item."""
    return (F.col("user_id").isNull().cast("long")
            + F.lit(2) * F.col("item_id").isNull().cast("long"))


def _filled(ratings: DataFrame) -> DataFrame:
    """Ratings with long ids, the largest for a null one: it comes last in an order."""
    return ratings.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(2 ** 63 - 1))
                                for c in ("user_id", "item_id")})


def stratum_step(factors: DataFrame, ratings: DataFrame, prep: Prepared, g: int,
                 step, piece: int = 0) -> DataFrame:
    """Factors after the ``piece``-th pieces of the groups of stage ``g``:
    one cogroup, a group of it for each."""
    B = prep.groups
    stage, group, part = prep.at
    more = [c for c in ("first_step", "cell") if c in ratings.columns]
    reps = [] if "body" in factors.columns else ["urep", "irep"]
    cols = ["label", "user_id", "item_id", *reps, "rating", "ord", *more]

    def labels():   # B rows; own column instances for either side
        return F.broadcast(prep.labels.select(F.col("blk").alias("blk"),
                                              F.col("label").alias("label")))

    r = (ratings.where((F.col(stage) == F.lit(g)) & (F.col(part) == F.lit(piece)))
         .withColumn("blk", F.col(group))
         .join(labels(), "blk").select(*cols))
    f = factors.withColumn("blk", _group_block(g, B)).join(labels(), "blk")
    if "body" in factors.columns:
        types = {"user_id": np.int64, "item_id": np.int64, "rating": np.float64, "ord": np.int64,
                 **{c: np.int64 for c in more}}
        flagged = r.withColumn("ord", F.col("ord") + F.shiftleft(_null_ids(), packed.NULL_USER))
        chunks = packed.pack_ratings(_filled(flagged), "label", list(types))
        return chunks.repartition(B, "at").groupBy("at").cogroup(
            f.select("label", *packed.COLUMNS).repartition(B, "label").groupBy("label")
        ).applyInArrow(packed.on_chunks(step.update, types), packed.FACTORS_DDL)
    r = r.repartition(B, "label")
    if step.width > FLAT_WIDTH:
        f = f.select("label", *OUT_COLUMNS).repartition(B, "label")
        return r.groupBy("label").cogroup(f.groupBy("label")).applyInPandas(step, FACTORS_OUT)
    names = [f"v{j}" for j in range(step.width)]
    f = f.select("label", *[c for c in OUT_COLUMNS if c != "factors"],
                 *[F.get("factors", F.lit(j)).alias(v) for j, v in enumerate(names)])
    out = r.groupBy("label").cogroup(f.repartition(B, "label").groupBy("label")).applyInPandas(
        on_columns(step.update, names), FACTORS_OUT.replace(
            "factors array<double>", ", ".join(f"{v} double" for v in names)))
    return out.select(*[F.array(*names).alias(c) if c == "factors" else c for c in OUT_COLUMNS])


def further_pieces(factors: DataFrame, ratings: DataFrame, prep: Prepared, g: int,
                   step) -> tuple[DataFrame, list[str]]:
    """``factors`` (a stored table) after the second and later pieces of the
    cut groups of stage ``g``, and the files that it still reads. Only the
    factors of these groups move; every few pieces they are stored."""
    spark = factors.sparkSession
    of = factors.withColumn("blk", _group_block(g, prep.groups))
    cut = F.broadcast(prep.cut_blocks.where(F.col("stratum") == F.lit(g))   # at most B rows
                      .select(F.col("ublk").alias("blk")))
    act, rest = (of.join(cut, "blk", how).drop("blk") for how in ("left_semi", "left_anti"))
    held: list[str] = []
    for i in range(1, prep.pieces[g]):
        act = stratum_step(act, ratings, prep, g, step, i)
        if i % STRATA_PER_JOB == 0:
            path = new_scratch_path(spark, "sgd-pieces")
            act = write_table(act, path)
            for old in held:
                drop_path(spark, old)
            held = [path]
    return rest.select(factors.columns).unionByName(act.select(factors.columns)), held


def _with_first_steps(prep: Prepared, ratings: DataFrame) -> DataFrame:
    """Adds the number of updates before each block, or piece of a block, in an
    epoch (a row for each)."""
    at = ["stratum", "ublk", "piece"]
    sizes = ratings.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    before = prefix_sums(sizes, at, ["n"])
    return ratings.join(before.select(*at, F.col("n_before").alias("first_step")), at)


class FactorFiles:
    """The stored factors of a fit: the files that a write supersedes are deleted, and
    now and then the shuffle files of the stages before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.moved = spark, None, 0

    def cut(self, f: DataFrame) -> DataFrame:
        path = new_scratch_path(self.spark, "sgd-factors")
        out = write_table(f, path)
        if self.path:
            drop_path(self.spark, self.path)
        self.path = path
        self.moved += STRATA_PER_JOB * session.path_bytes(self.spark, path)
        if self.moved > RELEASE_BYTES:
            session.release(self.spark)
            self.moved = 0
        return out


def epoch_pass(fac: DataFrame, ratings: DataFrame, prep: Prepared, step, cut,
               merge=None) -> DataFrame:
    """Stored factors after every stage of an epoch, and ``merge``."""
    for g in range(prep.stages):
        fac = stratum_step(fac, ratings, prep, g, step)
        last = g == prep.stages - 1
        if g in prep.pieces:
            fac, own = further_pieces(cut(fac), ratings, prep, g, step)
            fac = cut(fac)
            for path in own:
                drop_path(fac.sparkSession, path)
        if last and merge:
            fac = merge(fac)
        if last or (g + 1) % STRATA_PER_JOB == 0:
            fac = cut(fac)
    return fac


class TraceSets:
    """Ratings of error traces in the blocks of ``prep``; the training ratings lie there
    already, others are written once. A pair whose user or item has no factor row counts
    as in ``evaluate.score``."""

    def __init__(self, prep: Prepared, sets: dict[str, DataFrame]):
        self.prep, self.names, self.parts, self.paths = prep, list(sets), [], []
        spark, stage = prep.base.sparkSession, prep.at[0]
        for code, df in enumerate(sets.values()):
            if df is prep.source:
                at = F.pmod(F.col(stage), F.lit(prep.groups)).cast("int")
                self.parts.append((code, prep.ratings.withColumn("_at", at), stage, prep.at[1]))
                continue
            place = {c: F.floor(hash_bucket(key(t, prep.seed, "@" + c, 0), prep.blocks)
                                / F.lit(prep.span)).cast("int")
                     for c, t in (("user_id", "ublk"), ("item_id", "iblk"))}
            laid = (df.select("user_id", "item_id", F.col("rating").cast("double").alias("rating"),
                              place["user_id"].alias("grp"), place["item_id"].alias("_i"))
                    .withColumn("_at", F.pmod(F.col("_i") - F.col("grp"), F.lit(prep.groups)))
                    .drop("_i"))
            path = new_scratch_path(spark, "sgd-trace")
            laid.repartition("_at", F.pmod(F.hash("user_id"), F.lit(4))).write.partitionBy("_at").parquet(path)
            self.paths.append(path)
            self.parts.append((code, spark.read.schema(laid.schema).parquet(path), "_at", "grp"))

    def errors(self, factors: DataFrame, models: list[tuple], n_rows: int, values: int) -> dict:
        """name -> (number of ratings, RMSE of every model ``(start, k, biased, mu)``)."""
        G, found = self.prep.groups, {}
        names = [f"{c}{j}" for j in range(len(models)) for c in "ms"]
        many = min(G, max(1, TRACE_BYTES // max(1, n_rows * 8 * (values + 2))))
        types = {"user_id": np.int64, "item_id": np.int64, "rating": np.float64, "flags": np.int64}
        for lo in range(0, G, many):
            hi = min(G, lo + many)
            r = None
            for code, df, stage, group in self.parts:
                own = F.col(stage).between(lo, hi - 1)
                if lo == 0:     # the last stage is the rest of the first
                    own |= F.col(stage) == F.lit(G)
                x = df.where(own).select(
                    "user_id", "item_id", "rating",
                    (_null_ids() + F.lit(4) * F.col("rating").isNull().cast("long")
                     + F.lit(8 * code)).alias("flags"),
                    ((F.col("_at") - F.lit(lo)) * F.lit(G) + F.col(group)).alias("cell"))
                r = x if r is None else r.unionByName(x)
            f = (factors.withColumn("_at", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
                 .withColumn("cell", (F.col("_at") - F.lit(lo)) * F.lit(G) + F.when(
                     F.col("kind") == "u", F.col("hblk")).otherwise(
                     F.pmod(F.col("hblk") - F.col("_at"), F.lit(G)))))
            n = (hi - lo) * G
            sums = packed.pack_ratings(_filled(r), "cell", list(types)).repartition(n, "at").groupBy(
                "at").cogroup(f.select("cell", *packed.COLUMNS).repartition(n, "cell").groupBy(
                    "cell")).applyInArrow(packed.on_errors(types, models, names),
                                          ", ".join(["code int", "n long", *[
                                              f"{c} {'long' if c[0] == 'm' else 'double'}"
                                              for c in names]]))
            for x in sums.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("n", *names)]
                                              ).collect():     # a row per set
                got = found.setdefault(x["code"], [0, *[0] * len(names)])
                for q, c in enumerate(("n", *names)):
                    got[q] += x[c]
        out = {}
        for code, name in enumerate(self.names):
            n, *rest = found.get(code, [0, *[0] * len(names)])
            out[name] = (int(n), [math.sqrt(s / m) if m else None
                                  for m, s in zip(rest[::2], rest[1::2], strict=True)])
        return out

    def drop(self) -> None:
        for path in self.paths:
            drop_path(self.prep.base.sparkSession, path)


def stored_rows(chunks: DataFrame) -> int:
    """Factor rows in the chunks."""
    return int(chunks.agg(F.sum(F.length("known"))).first()[0] or 0)


def fit_sgd(train: DataFrame | None = None, p: SgdParams = SgdParams(), *,
            blocks: int | None = None, rows_per_block: int = ROWS_PER_BLOCK,
            mu: float | None = None, eval_sets: dict[str, DataFrame] | None = None,
            trace_every: int = 5, split_threshold: int | None = None,
            sample_from: DataFrame | None = None, sample_n: int | None = None,
            prepared: Prepared | None = None) -> SgdModel:
    """Fit the (biased or unbiased) factor model by block-stratified SGD.

    ``train``: (user_id, item_id, rating), or ``prepared`` from ``prepare``.
    ``blocks=None`` takes B from ``rows_per_block``. ``eval_sets`` (name ->
    ratings) adds an RMSE trace every ``trace_every`` epochs before that
    epoch's updates and after the last one. With ``sample_from`` (all pairs)
    each epoch trains only on the training ratings among the first
    ``sample_n`` pairs of that epoch's seeded order (sampled-pair SGD).
    """
    from .evaluate import rmse, score

    prep = prepared or prepare(train, seed=p.seed, blocks=blocks, rows_per_block=rows_per_block,
                               split_threshold=split_threshold, values=p.k + 1)
    if prep.seed != p.seed:
        raise ValueError("the ratings were prepared with another seed")
    spark, split = prep.base.sparkSession, prep.reps is not None
    if mu is None:
        mu = prep.mu if p.biased else 0.0
    ratings = prep.ratings
    if p.schedule == "step":
        ratings = _with_first_steps(prep, ratings)

    def side0(col, kind):
        return init_factors(prep.base.select(col).distinct(), col, kind, p.k, seed=p.seed,
                            noise=p.noise, gaussian=p.gaussian_init).withColumn(
            "n_updates", F.lit(0).cast("long"))

    def both(uf, itf):
        return _expand(uf, prep.reps, "u", prep).unionByName(_expand(itf, prep.reps, "i", prep))

    def sides(f):
        f = f if split else packed.factor_rows(f)
        return _collapse(f, "u", p.k, split), _collapse(f, "i", p.k, split)

    cut = FactorFiles(spark).cut
    fac = both(side0("user_id", "u"), side0("item_id", "i"))
    fac = cut(fac if split else packed.pack_factors(fac))
    trace, epoch_seconds, t0 = [], [], time.time()
    sets = None
    if eval_sets and not split:
        sets, n_rows = TraceSets(prep, eval_sets), stored_rows(fac)
    elif eval_sets:
        n_users, n_items = fac.where("rep = 0").agg(F.count(F.when(F.col("kind") == "u", 1)),
                                                    F.count(F.when(F.col("kind") == "i", 1))).first()

    def record(epoch, f):
        if sets:
            for name, (n, (error,)) in sets.errors(
                    f, [(0, p.k, p.biased, mu)], n_rows, p.k + 1).items():
                trace.append((epoch, name, error, n, time.time() - t0))
            return
        uf, itf = sides(f)
        for name, df in (eval_sets or {}).items():
            row = rmse(score(df, uf, itf, mu, p.k, biased=p.biased, n_users=n_users,
                             n_items=n_items)).first()
            trace.append((epoch, name, float(row["rmse"]) if row["rmse"] is not None else None,
                          int(row["n"]), time.time() - t0))

    if sample_from is not None:
        total, users = sample_from.agg(F.count(F.lit(1)), F.countDistinct("user_id")).first()
        sample_n = int(users) if sample_n is None else int(sample_n)
    for epoch in range(p.epochs):
        if eval_sets and epoch % trace_every == 0:
            record(epoch, fac)
        te = time.time()
        step = _make_step(mu, p, epoch, prep.n)
        epoch_ratings = ratings
        if sample_from is not None:
            epoch_ratings = ratings.where(_sample_filter(sample_from, sample_n, p.seed, epoch,
                                                         int(total)))
        fac = epoch_pass(fac, epoch_ratings, prep, step, cut,
                         (lambda f: both(*sides(f))) if split else None)
        epoch_seconds.append(round(time.time() - te, 3))
    if eval_sets:
        record(p.epochs, fac)
    if sets:
        sets.drop()
    uf, itf = sides(fac)
    # diagnostic, a row per group; computed only if asked for
    block_sizes = prep.ratings.groupBy("ublk", "iblk", "piece").agg(F.count(F.lit(1)).alias("n_ratings"))
    return SgdModel(uf, itf, mu, p, trace, block_sizes, epoch_seconds, prep.blocks)


def update_counts(model: SgdModel) -> DataFrame:
    """(side, id, n_updates): how often each id was trained."""
    return (model.user_factors.select(F.lit("user").alias("side"), "id", "n_updates")
            .unionByName(model.item_factors.select(F.lit("item").alias("side"), "id",
                                                   "n_updates")))


def _sample_filter(pairs: DataFrame, n: int, seed: int, epoch: int, total: int):
    """Rows among the first ``n`` pairs of the epoch's order, as a predicate.

    The cut-off (largest sampled sort key) is one row; the training ratings
    are then filtered in place.
    """
    s = sampled_pairs(pairs, n, seed=seed, epoch=epoch, total=total)
    last = s.agg(F.max(F.struct("sample_key", "user_id", "item_id")).alias("m")).first()["m"]
    h = hash_int(key("sample", seed, epoch, "@user_id", "@item_id"))
    if last is None:
        return F.lit(False)
    return F.struct(h.alias("sample_key"), F.col("user_id"), F.col("item_id")) <= F.struct(
        F.lit(int(last[0])).alias("sample_key"), F.lit(int(last[1])).alias("user_id"),
        F.lit(int(last[2])).alias("item_id"))


def trace_frame(spark: SparkSession, model: SgdModel, config: str = "") -> DataFrame:
    """RMSE trace as a DataFrame (epoch, split, rmse, n, seconds)."""
    rows = [(config, e, s, r, n, sec) for (e, s, r, n, sec) in model.trace]
    return spark.createDataFrame(
        rows, "config string, epoch int, split string, rmse double, n long, seconds double")


def sampled_pairs(pairs: DataFrame, n: int | None = None, *, seed: int = 0,
                  epoch: int = 0, total: int | None = None) -> DataFrame:
    """One epoch's sample: the first ``n`` pairs of a seeded order.

    With ``n`` the number of users this is one drawn rating per user
    position per pass. Exact and distributed without sorting every pair:
    the 28-bit sort hash is uniform, so the share n / N gives a cut-off whose
    candidates, a little over ``n``, are counted once and range-sorted. Should
    they be too few, the cut-off is doubled.
    """
    from ..functions.ranking import global_position
    p = pairs.select("user_id", "item_id").withColumn(
        "_h", hash_int(key("sample", seed, epoch, "@user_id", "@item_id")))
    if total is None or n is None:
        stats = p.agg(F.count(F.lit(1)).alias("N"),
                      F.countDistinct("user_id").alias("U")).first()
        total = int(stats["N"])
        n = int(stats["U"]) if n is None else int(n)
    n = int(n)
    if n <= 0 or total == 0:
        return p.limit(0).select("user_id", "item_id", F.lit(0).cast("long").alias("position"),
                                 F.col("_h").alias("sample_key"))
    # five standard deviations above the expected count
    share = (n + 5 * math.sqrt(n) + 10) / total
    cand = p
    while share < 1.0:
        cand = p.where(F.col("_h") < F.lit(int(share * SCALE)))
        if cand.count() >= n:
            break
        share, cand = 2 * share, p
    pos = global_position(cand, ["_h", "user_id", "item_id"], "position")
    return pos.where(F.col("position") < F.lit(n)).select(
        "user_id", "item_id", "position", F.col("_h").alias("sample_key"))


def with_params(p: SgdParams, **kw) -> SgdParams:
    return replace(p, **kw)
