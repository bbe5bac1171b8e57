"""Near-duplicate documents by MinHash with tensored banding.

Texts are A-Z lower-cased and cut into words; a document's set is its distinct
5-word shingles (with fewer words: the whole sequence as one shingle). Sets are
linked when 100 * intersection >= percent * union (85 unless said otherwise),
confirmed on the full sets.

Tensoring: instead of L independent tables of K minhashes (L * K hashes per
shingle), m small collections of t minhashes are computed (m * t hashes), and a
table's key combines a *pair* of collections: m (m - 1) / 2 tables of 2 t
minhashes. With m = 11 and t = 2 there are 55 tables of 4 minhashes from 22
hashes per shingle instead of 220; a pair at similarity 0.85 shares no table
with probability 2e-5. A lower threshold takes as many collections as keep the
miss at the threshold within ``MISS``: at 0.80 they are 14 (91 tables; 1.6e-5,
where 11 would miss 2.7e-4).

Plan:
1. one pass computes per document the set size, a 128-bit set fingerprint and
   the m collection values; equal sets become one class (partial aggregates);
2. classes are dealt to tables; a table entry is represented by its smallest
   id (the centre), so g members give g - 1 (member, centre) rows, never pairs;
3. members of a centre are checked against it, and those that are not linked
   to it against the other members, by sparse products of set membership. The
   members of one centre are dealt to blocks of bounded total set size and a
   task holds two blocks, so a large group is spread over many tasks; a task
   returns a spanning forest of the links it confirms;
4. connected components, and a join back that broadcasts only hot classes.

Edge cases: null and empty texts, and texts of white space, have no set: size
0, own component. Null ids take part through their text and get the component
of their class. Rows that repeat an id are one node. Other columns are ignored.
``keep_near`` goes by a key per row instead of the ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (ROW, components, join_back, materialize, maybe_in, with_row_key,
                     without_rows)
from .textblock import U, GOLDEN, Block, Prefix, blocks, lists, mix, seeds

SHINGLE = 5
COLLECTIONS = 11
PER_COLLECTION = 2
PERCENT = 85
#: largest probability to miss a pair at the threshold
MISS = 2.3e-5
#: shingles of one block of a centre's members (8 bytes each)
BLOCK_SHINGLES = 1 << 18
#: cells of a membership matrix held at once
CELLS = 1 << 22

PLACE = seeds(SHINGLE, 5)
MOST_COLLECTIONS = 64
HASHES = seeds(MOST_COLLECTIONS * PER_COLLECTION, 9) | U(1)


def missed(percent: int, m: int) -> float:
    """Chance that a pair at the threshold shares none of the tables of ``m``
    collections: fewer than two collections agree."""
    q = (percent / 100) ** PER_COLLECTION
    return (1 - q) ** m + m * q * (1 - q) ** (m - 1)


def collections_for(percent: int) -> int:
    """Collections that a threshold takes, ``COLLECTIONS`` at least."""
    return next(m for m in range(COLLECTIONS, MOST_COLLECTIONS + 1)
                if missed(percent, m) <= MISS)


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted, end to end, and counts."""
    start, end, first = block.words()
    word = Prefix(block.data, lower=True).ranges(start, end)
    n = len(word)
    if n >= SHINGLE:
        runs = np.zeros(n - SHINGLE + 1, U)
        for k in range(SHINGLE):
            runs += mix(word[k:n - SHINGLE + 1 + k] + PLACE[k])
        runs = mix(runs)
    else:
        runs = np.zeros(0, U)
    sets, counts = [], np.zeros(block.n, np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= SHINGLE:
            s = np.sort(runs[a:b - SHINGLE + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = mix(sum((mix(word[a + k:a + k + 1] + PLACE[k]) for k in range(b - a)),
                        np.full(1, b - a, U) * GOLDEN))
        else:
            continue
        sets.append(s)
        counts[i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), counts


def signature(values: np.ndarray, starts: np.ndarray, m: int = COLLECTIONS) -> np.ndarray:
    """``(sets, m)``: each value combines the minima of two hashes."""
    out = np.zeros((len(starts), m), U)
    for c in range(m):
        key = np.full(len(starts), c, U)
        for h in HASHES[c * PER_COLLECTION:(c + 1) * PER_COLLECTION]:
            key = mix(key * GOLDEN + np.minimum.reduceat((values ^ (h >> U(1))) * h, starts))
        out[:, c] = key
    return out


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
                    ("sig", pa.list_(pa.int64()))])


def signer(m: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                values, counts = shingle_sets(block)
                full = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[full]
                sig = np.zeros((0, m), U)
                keys = [None] * block.n
                if len(full):
                    sig = signature(values, starts, m)
                    f1 = np.add.reduceat(mix(values + GOLDEN), starts)
                    f2 = np.add.reduceat(mix(values ^ GOLDEN), starts)
                    raw = np.stack([f1, f2, counts[full].astype(U)], 1).tobytes()
                    for j, i in enumerate(full.tolist()):
                        keys[i] = raw[24 * j:24 * j + 24]
                yield pa.record_batch([
                    batch.column("doc_id").slice(block.row0, block.n),
                    pa.array(counts), pa.array(keys, pa.binary()),
                    lists(sig.ravel().view(np.int64), np.where(counts > 0, m, 0),
                          pa.int64())], schema=SIGNED)
    return sign


SETS = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            values, counts = shingle_sets(block)
            yield pa.record_batch([batch.column("doc_id").slice(block.row0, block.n),
                                   lists(values.view(np.int64), counts, pa.int64())],
                                  schema=SETS)


def linked(inter: np.ndarray, size_a: np.ndarray, size_b: np.ndarray,
           percent: int = PERCENT) -> np.ndarray:
    inter = inter.astype(np.int64)
    return 100 * inter >= percent * (size_a + size_b - inter)


def block_links(centre: int, ids: np.ndarray, left: np.ndarray, values: np.ndarray,
                off: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links among one centre's members in two blocks (``left``: which).

    Members linked to the centre need no test among each other; the others
    are tested against all. Only items that occur in two or more sets count."""
    size = np.diff(off)
    owner = np.repeat(np.arange(len(ids)), size)
    items, inverse, times = np.unique(values, return_inverse=True, return_counts=True)
    keep = times[inverse] > 1
    column = np.cumsum(times > 1) - 1
    cols, owner = column[inverse[keep]], owner[keep]
    width = int((times > 1).sum())
    if not width:
        return []
    first = np.searchsorted(owner, np.arange(len(ids) + 1))
    at = int(np.flatnonzero(ids == centre)[0])
    has = np.zeros(width, bool)
    has[cols[first[at]:first[at + 1]]] = True
    inter = np.bincount(owner, weights=has[cols], minlength=len(ids))
    direct = linked(inter, size, size[at], percent)
    direct[at] = True
    edges = [(int(ids[i]), centre) for i in np.flatnonzero(direct) if i != at]
    group = np.where(direct, at, np.arange(len(ids)))
    rest = np.flatnonzero(~direct)
    step = max(1, CELLS // width)
    for lo in range(0, len(rest), step):
        rows = rest[lo:lo + step]
        dense = np.zeros((width, len(rows)), np.float32)
        for j, i in enumerate(rows):
            dense[cols[first[i]:first[i + 1]], j] = 1
        for low in range(0, len(ids), step):
            some = np.arange(low, min(low + step, len(ids)))
            a, b = first[some[0]], first[some[-1] + 1]
            other = np.zeros((len(some), width), np.float32)
            other[owner[a:b] - some[0], cols[a:b]] = 1
            ok = linked(other @ dense, size[some][:, None], size[rows][None, :], percent)
            # within one block pair: a pair inside one block belongs to the
            # task that holds that block alone
            ok &= (left[some][:, None] != left[rows][None, :]) | left.all()
            for j, i in enumerate(rows.tolist()):
                partners = some[ok[:, j]]
                for g in np.unique(group[partners]).tolist():
                    if g != group[i]:
                        p = partners[group[partners] == g][0]
                        edges.append((int(ids[i]), int(ids[p])))
                        group[group == g] = group[i]
    return edges


EDGES = "a long, b long"


def confirmer(percent: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def confirm(key: tuple, table: pa.Table) -> pa.Table:
        """One centre, two of its blocks: the confirmed spanning links."""
        centre = key[0].as_py()
        shingles = table.column("shingles").combine_chunks()
        edges = block_links(centre, table.column("id").to_numpy(),
                            table.column("side").to_numpy() == 0,
                            shingles.flatten().to_numpy().view(U),
                            np.concatenate(([0], np.cumsum(shingles.value_lengths().to_numpy()))),
                            percent)
        a, b = zip(*edges, strict=True) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return confirm


def signatures(docs: DataFrame, m: int = COLLECTIONS) -> DataFrame:
    """``doc_id, n_shingles, set_key, sig`` of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        signer(m), "doc_id long, n_shingles long, set_key binary, sig array<long>")


def candidates(classes: DataFrame, m: int = COLLECTIONS) -> DataFrame:
    """``(id, centre)``: every class met in a table, beside the table's centre."""
    pairs = (f"flatten(transform(sequence(0, {m - 2}), i -> "
             f"transform(sequence(i + 1, {m - 1}), "
             "j -> xxhash64(i, j, sig[i], sig[j]))))")
    entries = classes.select("id", F.explode(F.expr(pairs)).alias("key"))
    tables = materialize(
        entries.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("other"))
        .filter("centre <> other").select("key", "centre"), "tables")
    return entries.join(tables.hint("merge"), "key").filter("id <> centre").select(
        "id", "centre").distinct()


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links ``(a, b)`` that span the components."""
    met = materialize(candidates(classes, collections_for(percent)), "candidates")
    wanted = (met.select(F.col("id").alias("doc_id"))
              .unionByName(met.select(F.col("centre").alias("doc_id"))).distinct())
    texts = maybe_in(docs.select(F.col("doc_id").cast("long"), "text"), wanted,
                     "doc_id").join(wanted.hint("merge"), "doc_id")
    sets = materialize(texts.mapInArrow(sets_of, "id long, shingles array<long>")
                       .filter(F.size("shingles") > 0), "sets")
    sizes = classes.groupBy("id").agg(F.max("n_shingles").alias("n"))
    centres = materialize(
        met.join(sizes, "id").groupBy("centre").agg(
            F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")), "centres")
    dealt = (met.join(centres, "centre")
             .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .select("id", "centre", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("k"))
             .select("id", "centre", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"),
                     (F.col("own") > F.col("k")).cast("int").alias("side")))
    heads = (centres.select(F.col("centre").alias("id"), "centre",
                            F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), "blocks")
             .select("id", "centre", "i", F.explode(F.expr("sequence(i, blocks - 1)")).alias("j"),
                     F.lit(0).alias("side")))
    held = materialize(dealt.unionByName(heads), "dealt").join(sets.hint("merge"), "id")
    return held.groupBy("centre", "i", "j").applyInArrow(confirmer(percent), EDGES)


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document; sets are linked
    from a similarity of ``percent`` on."""
    signed = materialize(signatures(docs, collections_for(percent)), "signed")
    classes = materialize(
        signed.filter("set_key is not null").groupBy("set_key").agg(
            F.min("doc_id").alias("id"), F.max("n_shingles").alias("n_shingles"),
            F.first("sig").alias("sig"), F.count("*").alias("members")), "classes")
    named = classes.filter("id is not null")
    found = components(materialize(links(docs, named, percent), "links"))
    labels = materialize(
        classes.select("set_key", "id", "members").join(found, "id", "left")
        .select("set_key", "members", F.coalesce("component", "id").alias("component_id")),
        "labels")
    with_set = join_back(signed.select("doc_id", "n_shingles", "set_key"), labels,
                         "set_key", "members", F.col("doc_id"))
    alone = signed.filter("set_key is null").withColumn("component_id", F.col("doc_id"))
    cols = ["doc_id", "n_shingles", "component_id"]
    return with_set.select(cols).unionByName(alone.select(cols)).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"),
                           F.col("component_id").isNull()))


def keep_near(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with exactly one row of each component: that of the smallest
    id, or of no id where none has one, and of rows that share it the first.
    Rows are the nodes, so null and repeated ids are searched like others."""
    keyed = with_row_key(docs)
    found = materialize(near_dedup(keyed.select(F.col(ROW).alias("doc_id"), "text"),
                                   percent).select(F.col("doc_id").alias(ROW), "component_id"), "near")
    rows = materialize(keyed.select(ROW, "doc_id").join(found, ROW), "near-rows")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("lead")
    groups = materialize(
        rows.groupBy("component_id").agg(F.count("*").alias("members"), lead)
        .filter("members > 1").select("component_id", "members", F.col("lead")[ROW].alias("lead")),
        "near-groups")
    return without_rows(keyed, join_back(rows, groups, "component_id", "members", F.col(ROW))
                        .filter(F.col(ROW) != F.col("lead")), docs.columns)
