"""Registered queries: one per operator, each with its DuckDB twin.

Every query reads the given tables (or files Spark derives from them) in
full. Doubles are rounded to 6 digits on both sides; every computed
column carries the same alias in the Spark query and in the SQL.
Stochastic fits are checked by the number of updates of every id, full-batch
and alternating fits by their exact result, unrolled in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import (hash_bucket, key, sql_hash_bucket, sql_hash_gaussian,
                                sql_hash_int, sql_hash_uniform, sql_key, sql_lit)
from .functions.vectors import dot
from .operators import joins, prep
from .plans import als as als_plan
from .plans import evaluate as ev
from .plans import factors as fac
from .plans import gradient, grid, linear, sgd, tuning
from .session import new_scratch_path, write_table
from .sources import files, synth, tables, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Fixed values for the registered (checked) queries.
SEED = 0
K_CHECK = 8          # features for the checked factor queries
NOISE = 0.1
CHUNK = 16           # list chunk size for user_items / user_rows
RANGE = 64           # user_rows: ratings of a user beyond which the row is cut by item
FIRST_N = 100        # first-N users
SUBSET_MAX_USER = 1000
SYNTH_RANK = 4
GRAM_K = 4
FP_MAX_RATING = 1.0
FP_MIN_PREDICTION = 3.0
FP_LIMIT = 100
CHECK_PARAMS = fac.SgdParams(k=K_CHECK, lr=0.1, lr_bias=0.5, lam=0.1, bias_reg=0.1,
                             noise=NOISE, seed=SEED)


def _positive_zero_rounds(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``.

    DuckDB rounds a tiny negative to -0.0 where Spark gives 0.0; adding
    +0.0 turns -0.0 into 0.0 and leaves every other value unchanged.
    """
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len("round")
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _positive_zero_rounds(sql[j + len("round("):k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = _positive_zero_rounds(sql.strip())
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ---- shared Spark pieces ------------------------------------------------

def _ratings(spark, sf):
    return tables.ratings_view(spark, sf)


def _dedup(spark, sf):
    return prep.dedupe_ratings(_ratings(spark, sf))


def _split(spark, sf):
    return prep.train_test_split(_dedup(spark, sf), SEED)


def _books(spark, sf):
    return tables.book_view(spark, sf).select("user_id", "isbn", "rating")


def _stored_dedup(spark, sf):
    return write_table(_dedup(spark, sf), new_scratch_path(spark, "ratings"))


def _stored_split(spark, sf):
    """The split ratings, written once: what a model query reads again."""
    kept = write_table(_dedup(spark, sf).withColumn("is_train", prep.split_flag(SEED)),
                       new_scratch_path(spark, "ratings"))
    flag = F.col("is_train")
    return kept.where(flag).drop("is_train"), kept.where(~flag).drop("is_train")


def _mean(df):
    """The mean rating as a scalar subquery: no driver round trip, and the
    optimizer can share the de-duplication exchange with the main plan."""
    return df.select(F.avg("rating")).scalar()


def _init_side(train, side):
    """Initial factors as a stored table, so that joins to it can be split."""
    col = "user_id" if side == "u" else "item_id"
    return write_table(fac.init_factors(train.select(col).distinct(), col, side, K_CHECK,
                                        seed=SEED, noise=NOISE),
                       new_scratch_path(train.sparkSession, "factors"))


def _init_model(spark, sf):
    return _sized_model(spark, sf)[:-1]


def _sized_model(spark, sf):
    """Split, mean, initial factors and the rows of (all ratings, users, items),
    which are counted from the footers of the stored tables."""
    stored = _stored_dedup(spark, sf)
    train, test = prep.train_test_split(stored, SEED)
    uf, itf = _init_side(train, "u"), _init_side(train, "i")
    return train, test, _mean(train), uf, itf, (stored.count(), uf.count(), itf.count())


# ---- shared SQL pieces (DuckDB) ---------------------------------------------

def _bucket_split():
    return sql_hash_bucket(sql_key(sql_lit("split"), str(SEED), "user_id", "item_id"), 10)


W_RATINGS = """ratings AS (
  SELECT o.o_custkey AS user_id, l.l_partkey AS item_id,
         CAST(ceil(l.l_quantity / 10.0) AS DOUBLE) AS rating,
         CAST(epoch(o.o_orderdate) AS BIGINT) AS ts,
         l.l_orderkey AS l_orderkey, l.l_linenumber AS l_linenumber
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

W_DEDUP = """dedup AS (
  SELECT user_id, item_id, rating FROM (
    SELECT user_id, item_id, rating, row_number() OVER (
      PARTITION BY user_id, item_id
      ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, rating DESC) AS rn
    FROM ratings) WHERE rn = 1)"""

W_SPLIT = f"""split AS (
  SELECT user_id, item_id, rating, ({_bucket_split()} < 8) AS is_train FROM dedup),
train AS (SELECT user_id, item_id, rating FROM split WHERE is_train),
test AS (SELECT user_id, item_id, rating FROM split WHERE NOT is_train),
mu AS (SELECT avg(rating) AS mu FROM train)"""


def _w_factors(gen=sql_hash_uniform, tag="init", k=K_CHECK, sides=("u", "i")):
    def side(name, col, s):
        key_ = sql_key(sql_lit(tag), str(SEED), sql_lit(s), "x.id", "t.k")
        return f"""{name} AS (
  SELECT x.id AS id, CAST(t.k AS INTEGER) AS k, {gen(key_)} * {NOISE!r} AS v
  FROM (SELECT DISTINCT {col} AS id FROM train) x, range({k}) t(k))"""
    spec = {"u": ("uf", "user_id"), "i": ("itf", "item_id")}
    return ",\n".join(side(spec[s][0], spec[s][1], s) for s in sides)


W_FACTORS = _w_factors()

W_DOT = """dots AS (
  SELECT p.user_id, p.item_id, sum(u.v * i.v) AS d
  FROM (SELECT DISTINCT user_id, item_id FROM dedup) p
  JOIN uf u ON u.id = p.user_id JOIN itf i ON i.id = p.item_id AND i.k = u.k
  GROUP BY p.user_id, p.item_id)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = with_(W_RATINGS, W_DEDUP, W_SPLIT)
MODEL = with_(W_RATINGS, W_DEDUP, W_SPLIT, W_FACTORS, W_DOT)


# ============================================================================
# 2.1 sources
# ============================================================================

def _bad_bucket_sql():
    return sql_hash_bucket(sql_key(sql_lit("bad"), "l_orderkey", "l_linenumber",
                                   "item_id", "user_id"), files.BAD_BUCKETS)


@query("read_ratings", with_(W_RATINGS) + f"""
SELECT user_id, item_id, rating, ts FROM ratings WHERE {_bad_bucket_sql()} >= 3""")
def q_read_ratings(spark, sf):
    return files.read_ratings(spark, files.rating_lines_path(spark, sf))


@query("read_items", """
SELECT p_partkey AS item_id, p_name AS title, CAST(0 AS INTEGER) AS pos, p_type AS genre
FROM part
UNION ALL
SELECT p_partkey AS item_id, p_name AS title, CAST(1 AS INTEGER) AS pos, p_brand AS genre
FROM part""")
def q_read_items(spark, sf):
    it = files.read_items(spark, files.item_lines_path(spark, sf))
    return it.select("item_id", "title", F.posexplode("genres").alias("pos", "genre"))


W_BOOKS = """books AS (
  SELECT o.o_custkey AS user_id, lpad(CAST(l.l_partkey AS VARCHAR), 10, '0') AS isbn,
         CAST(CAST(l.l_quantity AS INTEGER) % 11 AS INTEGER) AS rating
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


@query("read_book_ratings", with_(W_BOOKS) + "SELECT user_id, isbn, rating FROM books")
def q_read_book_ratings(spark, sf):
    return files.read_book_ratings(spark, files.book_lines_path(spark, sf))


@query("reject_counts", with_(W_RATINGS) + f"""
SELECT CASE b WHEN 0 THEN 'field_count' WHEN 1 THEN 'parse' WHEN 2 THEN 'null_field'
            ELSE 'good' END AS reason,
       count(*) AS n_lines
FROM (SELECT {_bad_bucket_sql()} AS b FROM ratings) GROUP BY 1""")
def q_reject_counts(spark, sf):
    raw = files.read_ratings_raw(spark, files.rating_lines_path(spark, sf))
    good, bad = files.split_rejects(raw)
    reasons = files.reject_reasons(bad, "::", 4)
    g = good.agg(F.count(F.lit(1)).alias("n_lines")).select(F.lit("good").alias("reason"),
                                                            "n_lines")
    b = reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"))
    return g.unionByName(b)


def _synth_sql():
    m = sql_hash_uniform(sql_key(sql_lit("synth"), str(SEED), sql_lit("m"), "p.item_id", "t.k"))
    u = sql_hash_uniform(sql_key(sql_lit("synth"), str(SEED), sql_lit("u"), "p.user_id", "t.k"))
    return with_(W_RATINGS) + f"""
SELECT p.user_id, p.item_id, round(sum({m} * {u}), 6) AS rating
FROM (SELECT DISTINCT user_id, item_id FROM ratings) p, range({SYNTH_RANK}) t(k)
GROUP BY p.user_id, p.item_id"""


@query("synth_ratings", _synth_sql())
def q_synth_ratings(spark, sf):
    pairs = _ratings(spark, sf).select("user_id", "item_id").distinct()
    s = synth.synth_ratings(pairs, SYNTH_RANK, SEED)
    return s.select("user_id", "item_id", r6(F.col("rating")).alias("rating"))


@query("line_contains_count", """
WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT count(*) AS n_lines,
       CAST(sum(CASE WHEN contains(line, 'a') THEN 1 ELSE 0 END) AS BIGINT) AS lines_with_a,
       CAST(sum(CASE WHEN contains(line, 'b') THEN 1 ELSE 0 END) AS BIGINT) AS lines_with_b
FROM lines""")
def q_line_contains_count(spark, sf):
    return text.count_lines(tables.text_lines(spark, sf),
                            {"lines_with_a": "a", "lines_with_b": "b"})


# ============================================================================
# 2.2 projections, filters, reshaping
# ============================================================================

@query("explicit_ratings", with_(W_BOOKS) +
       "SELECT user_id, isbn, rating FROM books WHERE rating > 0")
def q_explicit_ratings(spark, sf):
    return prep.explicit_ratings(_books(spark, sf))


@query("user_ratings", with_(W_RATINGS) + """
SELECT user_id, count(*) AS n_ratings, sum(rating) AS rating_sum,
       min(item_id) AS min_item, max(item_id) AS max_item
FROM ratings GROUP BY user_id""")
def q_user_ratings(spark, sf):
    return prep.user_rating_stats(_ratings(spark, sf))


@query("pair_lookup", BASE + """
SELECT d.user_id, d.item_id, t.rating AS found_rating,
       CAST(t.rating IS NOT NULL AS INTEGER) AS found
FROM dedup d LEFT JOIN train t ON t.user_id = d.user_id AND t.item_id = d.item_id""")
def q_pair_lookup(spark, sf):
    d = _dedup(spark, sf)
    train, _ = prep.train_test_split(d, SEED)
    r = prep.pair_lookup(d.select("user_id", "item_id"), train)
    return r.withColumn("found", F.col("found").cast("int"))


@query("split_counts", BASE + """
SELECT CAST(is_train AS INTEGER) AS is_train, count(*) AS n_rows, sum(rating) AS rating_sum
FROM split GROUP BY 1""")
def q_split_counts(spark, sf):
    r = prep.split_counts(_dedup(spark, sf), SEED)
    return r.withColumn("is_train", F.col("is_train").cast("int"))


def _perm_sql():
    h = f"CAST(('0x' || substr(md5({sql_key(sql_lit('perm'), str(SEED), 'user_id')}), 1, 7)) AS BIGINT)"
    return with_(W_RATINGS) + f"""
SELECT user_id, row_number() OVER (ORDER BY {h}, user_id) - 1 AS position
FROM (SELECT DISTINCT user_id FROM ratings)"""


@query("user_permutation", _perm_sql())
def q_user_permutation(spark, sf):
    return prep.user_permutation(_ratings(spark, sf), SEED)


def _order_sql():
    h = f"CAST(('0x' || substr(md5({sql_key(sql_lit('order'), str(SEED), 'user_id', 'item_id')}), 1, 7)) AS BIGINT)"
    return with_(W_RATINGS) + f"""
SELECT user_id, item_id, row_number() OVER (ORDER BY {h}, user_id, item_id) - 1 AS position
FROM (SELECT DISTINCT user_id, item_id FROM ratings)"""


@query("interaction_order", _order_sql())
def q_interaction_order(spark, sf):
    pairs = _ratings(spark, sf).select("user_id", "item_id").distinct()
    return prep.interaction_order(pairs, SEED)


@query("user_items", with_(W_RATINGS, W_DEDUP) + f"""
SELECT user_id, CAST(rn // {CHUNK} AS BIGINT) AS chunk, CAST(rn % {CHUNK} AS INTEGER) AS pos,
       item_id
FROM (SELECT user_id, item_id,
             row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1 AS rn FROM dedup)""")
def q_user_items(spark, sf):
    ui = prep.user_items(_stored_dedup(spark, sf), CHUNK)
    return ui.select("user_id", "chunk", F.posexplode("items").alias("pos", "item_id"))


@query("pair_digest", with_(W_RATINGS, W_DEDUP) + """
SELECT user_id, item_id, md5(CAST(user_id AS VARCHAR) || ' ' || CAST(item_id AS VARCHAR))
       AS digest
FROM dedup""")
def q_pair_digest(spark, sf):
    return prep.pair_digest(_dedup(spark, sf).select("user_id", "item_id"))


@query("user_rows", with_(W_RATINGS, W_DEDUP) + f"""
SELECT user_id, CAST(rn // {CHUNK} AS BIGINT) AS chunk, CAST(rn % {CHUNK} AS INTEGER) AS pos,
       item_id, rating
FROM (SELECT user_id, item_id, rating,
             row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1 AS rn FROM dedup)""")
def q_user_rows(spark, sf):
    ur = prep.user_rows(_stored_dedup(spark, sf), CHUNK, RANGE)
    z = ur.select("user_id", "chunk",
                  F.posexplode(F.arrays_zip("indices", "values")).alias("pos", "cell"))
    return z.select("user_id", "chunk", "pos", F.col("cell.indices").alias("item_id"),
                    F.col("cell.values").alias("rating"))


@query("encode_items", with_(W_BOOKS) + """
SELECT isbn, row_number() OVER (ORDER BY isbn) - 1 AS item_id
FROM (SELECT DISTINCT isbn FROM books WHERE rating > 0)""")
def q_encode_items(spark, sf):
    books = prep.explicit_ratings(_books(spark, sf))
    _, dictionary = prep.encode_items(books, "isbn", "item_id")
    return dictionary


# ============================================================================
# 2.3 aggregates
# ============================================================================

@query("distinct_entities", with_(W_RATINGS) + """
SELECT DISTINCT 'user' AS kind, user_id AS id FROM ratings
UNION ALL
SELECT DISTINCT 'item' AS kind, item_id AS id FROM ratings""")
def q_distinct_entities(spark, sf):
    return prep.distinct_entities(_ratings(spark, sf))


@query("dataset_summary", BASE + """
SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users,
       count(DISTINCT item_id) AS n_items,
       CAST(sum(CASE WHEN is_train THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
       CAST(sum(CASE WHEN is_train THEN 0 ELSE 1 END) AS BIGINT) AS n_test
FROM split""")
def q_dataset_summary(spark, sf):
    return prep.dataset_summary(_dedup(spark, sf), SEED)


@query("dedupe_ratings", with_(W_RATINGS, W_DEDUP) +
       "SELECT user_id, item_id, rating FROM dedup")
def q_dedupe_ratings(spark, sf):
    return _dedup(spark, sf)


@query("global_mean", BASE + """
SELECT 'all' AS scope, round(avg(rating), 6) AS mean, CAST(floor(avg(rating)) AS DOUBLE) AS floor_mean
FROM dedup
UNION ALL
SELECT 'train' AS scope, round(avg(rating), 6) AS mean, CAST(floor(avg(rating)) AS DOUBLE) AS floor_mean
FROM train""")
def q_global_mean(spark, sf):
    d = _dedup(spark, sf)
    train, _ = prep.train_test_split(d, SEED)
    a = prep.global_mean(d).select(F.lit("all").alias("scope"), r6(F.col("mean")).alias("mean"),
                                   "floor_mean")
    t = prep.global_mean(train).select(F.lit("train").alias("scope"),
                                       r6(F.col("mean")).alias("mean"), "floor_mean")
    return a.unionByName(t)


@query("first_n_users", with_(W_RATINGS) + f"""
SELECT DISTINCT user_id FROM ratings ORDER BY user_id LIMIT {FIRST_N}""")
def q_first_n_users(spark, sf):
    return prep.first_n_users(_ratings(spark, sf), FIRST_N)


# ============================================================================
# 2.4 joins
# ============================================================================

@query("join_factors", MODEL + """
SELECT t.user_id, t.item_id, t.rating, round(d.d, 6) AS dot
FROM train t JOIN dots d ON d.user_id = t.user_id AND d.item_id = t.item_id""")
def q_join_factors(spark, sf):
    train, _, _, uf, itf, sizes = _sized_model(spark, sf)
    j = joins.join_factors(train, uf, itf, K_CHECK, sizes=sizes)
    return j.select("user_id", "item_id", "rating", r6(dot(F.col("fu"), F.col("fi"))).alias("dot"))


def _test_predictions(spark, sf):
    train, test, mu, uf, itf = _init_model(spark, sf)
    return ev.score(test, uf, itf, mu, K_CHECK), mu


W_TEST_PRED = """test_pred AS (
  SELECT t.user_id, t.item_id, t.rating,
         (SELECT mu FROM mu) + coalesce(d.d, 0.0) AS prediction,
         d.d IS NOT NULL AS has_factors
  FROM test t LEFT JOIN dots d ON d.user_id = t.user_id AND d.item_id = t.item_id)"""

PRED = with_(W_RATINGS, W_DEDUP, W_SPLIT, W_FACTORS, W_DOT, W_TEST_PRED)


@query("false_positives", PRED + f"""
SELECT p.user_id, p.item_id, pt.p_name AS title, p.rating, round(p.prediction, 6) AS prediction
FROM test_pred p JOIN part pt ON pt.p_partkey = p.item_id
WHERE p.rating <= {FP_MAX_RATING} AND p.prediction >= {FP_MIN_PREDICTION}
ORDER BY p.prediction DESC, p.user_id, p.item_id LIMIT {FP_LIMIT}""")
def q_false_positives(spark, sf):
    pred, _ = _test_predictions(spark, sf)
    _, top = joins.false_positives(pred, tables.items_view(spark, sf),
                                   max_rating=FP_MAX_RATING, min_prediction=FP_MIN_PREDICTION,
                                   n=FP_LIMIT)
    return top.withColumn("prediction", r6(F.col("prediction")))


@query("false_positive_count", PRED + f"""
SELECT count(*) AS n_false_positives FROM test_pred
WHERE rating <= {FP_MAX_RATING} AND prediction >= {FP_MIN_PREDICTION}""")
def q_false_positive_count(spark, sf):
    pred, _ = _test_predictions(spark, sf)
    count, _ = joins.false_positives(pred, tables.items_view(spark, sf),
                                     max_rating=FP_MAX_RATING,
                                     min_prediction=FP_MIN_PREDICTION, n=FP_LIMIT)
    return count


# ============================================================================
# 2.5 model operators
# ============================================================================

def _flat_init_sql(gen, tag, with_bias=True):
    w = with_(W_RATINGS, W_DEDUP, W_SPLIT, _w_factors(gen, tag))
    bias = ""
    if with_bias:
        bias = """
UNION ALL SELECT 'user' AS side, id, CAST(-1 AS INTEGER) AS k, 0.0 AS value FROM (SELECT DISTINCT id FROM uf)
UNION ALL SELECT 'item' AS side, id, CAST(-1 AS INTEGER) AS k, 0.0 AS value FROM (SELECT DISTINCT id FROM itf)"""
    return w + f"""
SELECT 'user' AS side, id, k, round(v, 6) AS value FROM uf
UNION ALL SELECT 'item' AS side, id, k, round(v, 6) AS value FROM itf{bias}"""


def _flat_init(spark, sf, gaussian=False, with_bias=True):
    train, _ = _split(spark, sf)
    out = None
    for side, col, name in (("u", "user_id", "user"), ("i", "item_id", "item")):
        f = fac.init_factors(train.select(col).distinct(), col, side, K_CHECK, seed=SEED,
                             noise=NOISE, gaussian=gaussian)
        flat = fac.flat_factors(f, name)
        if not with_bias:
            flat = flat.where(F.col("k") >= 0)
        out = flat if out is None else out.unionByName(flat)
    return out.withColumn("value", r6(F.col("value")))


@query("init_factors", _flat_init_sql(sql_hash_uniform, "init"))
def q_init_factors(spark, sf):
    return _flat_init(spark, sf)


@query("init_factors_nb", _flat_init_sql(sql_hash_uniform, "init", with_bias=False))
def q_init_factors_nb(spark, sf):
    return _flat_init(spark, sf, with_bias=False)


@query("init_factors_gauss", _flat_init_sql(sql_hash_gaussian, "gauss"))
def q_init_factors_gauss(spark, sf):
    return _flat_init(spark, sf, gaussian=True)


@query("predict", PRED + """
SELECT user_id, item_id, rating, round(prediction, 6) AS prediction FROM test_pred""")
def q_predict(spark, sf):
    pred, _ = _test_predictions(spark, sf)
    return pred.select("user_id", "item_id", "rating", r6(F.col("prediction")).alias("prediction"))


def _deltas_sql(biased: bool):
    p = CHECK_PARAMS
    if biased:
        err = "t.rating - ((SELECT mu FROM mu) + d.d)"
        extra = f""", round({p.lr_bias!r} * (e.err), 6) AS new_bu,
       round({p.lr_bias!r} * (e.err), 6) AS new_bi"""
    else:
        err = "t.rating - d.d"
        extra = ""
    return MODEL + f""",
errs AS (SELECT t.user_id, t.item_id, {err} AS err
         FROM train t JOIN dots d ON d.user_id = t.user_id AND d.item_id = t.item_id)
SELECT e.user_id, e.item_id, u.k, round(e.err, 6) AS err{extra},
       round(u.v + {p.lr!r} * (e.err * i.v - {p.lam!r} * u.v), 6) AS new_fu,
       round(i.v + {p.lr!r} * (e.err * u.v - {p.lam!r} * i.v), 6) AS new_fi
FROM errs e JOIN uf u ON u.id = e.user_id JOIN itf i ON i.id = e.item_id AND i.k = u.k"""


def _deltas(spark, sf, biased: bool):
    train, _, mu, uf, itf, sizes = _sized_model(spark, sf)
    p = CHECK_PARAMS if biased else fac.SgdParams(**{**CHECK_PARAMS.__dict__, "biased": False})
    j = joins.join_factors(train, uf, itf, K_CHECK, sizes=sizes)
    d = fac.sgd_deltas(j, mu if biased else 0.0, p)
    z = d.select("user_id", "item_id", "err", "new_bu", "new_bi",
                 F.posexplode(F.arrays_zip("new_fu", "new_fi")).alias("k", "f"))
    cols = ["user_id", "item_id", "k", r6(F.col("err")).alias("err")]
    if biased:
        cols += [r6(F.col("new_bu")).alias("new_bu"), r6(F.col("new_bi")).alias("new_bi")]
    cols += [r6(F.col("f.new_fu")).alias("new_fu"), r6(F.col("f.new_fi")).alias("new_fi")]
    return z.select(*cols)


@query("sgd_deltas", _deltas_sql(True))
def q_sgd_deltas(spark, sf):
    return _deltas(spark, sf, True)


@query("sgd_deltas_nb", _deltas_sql(False))
def q_sgd_deltas_nb(spark, sf):
    return _deltas(spark, sf, False)


@query("gradient_step", MODEL + f""",
errs AS (SELECT t.user_id, t.item_id, t.rating - ((SELECT mu FROM mu) + d.d) AS err
         FROM train t JOIN dots d ON d.user_id = t.user_id AND d.item_id = t.item_id),
g AS (
  SELECT 'user' AS side, e.user_id AS id, u.k AS k, e.err * i.v - {CHECK_PARAMS.lam!r} * u.v AS x
  FROM errs e JOIN uf u ON u.id = e.user_id JOIN itf i ON i.id = e.item_id AND i.k = u.k
  UNION ALL
  SELECT 'item' AS side, e.item_id AS id, u.k AS k, e.err * u.v - {CHECK_PARAMS.lam!r} * i.v AS x
  FROM errs e JOIN uf u ON u.id = e.user_id JOIN itf i ON i.id = e.item_id AND i.k = u.k
  UNION ALL
  SELECT 'user' AS side, user_id AS id, -1 AS k, err AS x FROM errs
  UNION ALL
  SELECT 'item' AS side, item_id AS id, -1 AS k, err AS x FROM errs)
SELECT side, id, CAST(k AS INTEGER) AS k, round(sum(x), 6) AS grad FROM g GROUP BY side, id, k""")
def q_gradient_step(spark, sf):
    train, _, mu, uf, itf, sizes = _sized_model(spark, sf)
    j = joins.join_factors(train, uf, itf, K_CHECK, sizes=sizes)
    g = fac.gradient_step(j, mu, CHECK_PARAMS)
    return g.select("side", "id", F.col("k").cast("int").alias("k"),
                    r6(F.col("grad")).alias("grad"))


def _sampled_sql():
    h = f"CAST(('0x' || substr(md5({sql_key(sql_lit('sample'), str(SEED), '0', 'user_id', 'item_id')}), 1, 7)) AS BIGINT)"
    return with_(W_RATINGS, W_DEDUP) + f"""
SELECT user_id, item_id, position FROM (
  SELECT user_id, item_id, row_number() OVER (ORDER BY {h}, user_id, item_id) - 1 AS position
  FROM dedup)
WHERE position < (SELECT count(DISTINCT user_id) FROM dedup)"""


@query("sampled_pairs", _sampled_sql())
def q_sampled_pairs(spark, sf):
    return sgd.sampled_pairs(_dedup(spark, sf).select("user_id", "item_id"), seed=SEED,
                             epoch=0).drop("sample_key")


# ---- model fitting ---------------------------------------------------------
# The SGD twins count updates: every rating trains its user and its item once
# per epoch, whatever the blocks, strata and samples.

FIT_EPOCHS = 3
FIT_ROWS_PER_BLOCK = 4096


def _updates_sql(ctes: str, times: str) -> str:
    """(side, id, n_updates) where ``times`` has one row per trained rating
    and epoch; ids of ``train`` without an update count 0."""
    def side(name, col):
        return f"""SELECT '{name}' AS side, x.id AS id, coalesce(c.n, 0) AS n_updates
FROM (SELECT DISTINCT {col} AS id FROM train) x
LEFT JOIN (SELECT {col} AS id, count(*) AS n FROM {times} GROUP BY {col}) c ON c.id = x.id"""
    return ctes + side("user", "user_id") + "\nUNION ALL\n" + side("item", "item_id")


EPOCHS_OF_TRAIN = f"(SELECT t.* FROM train t, range({FIT_EPOCHS}))"


def _fit(spark, sf, **kw):
    train, _ = _split(spark, sf)
    kw.setdefault("decay", 0.9)
    p = fac.SgdParams(k=10, epochs=FIT_EPOCHS, **kw)
    return sgd.fit_sgd(train, p, rows_per_block=FIT_ROWS_PER_BLOCK)


@query("fit_sgd", _updates_sql(BASE, EPOCHS_OF_TRAIN))
def q_fit_sgd(spark, sf):
    return sgd.update_counts(_fit(spark, sf))


@query("fit_sgd_parallel", _updates_sql(BASE, EPOCHS_OF_TRAIN))
def q_fit_sgd_parallel(spark, sf):
    return sgd.update_counts(_fit(spark, sf, lr_bias=0.1, decay=0.9999, schedule="step"))


@query("fit_sgd_nb", _updates_sql(BASE, EPOCHS_OF_TRAIN))
def q_fit_sgd_nb(spark, sf):
    return sgd.update_counts(_fit(spark, sf, biased=False))


W_BOOK_TRAIN = f"""dict AS (
  SELECT isbn, row_number() OVER (ORDER BY isbn) - 1 AS item_id
  FROM (SELECT DISTINCT isbn FROM books WHERE rating > 0)),
dedup AS (SELECT DISTINCT b.user_id, d.item_id FROM books b JOIN dict d ON d.isbn = b.isbn
          WHERE b.rating > 0),
train AS (SELECT user_id, item_id FROM dedup WHERE {_bucket_split()} < 8)"""


@query("fit_sgd_books", _updates_sql(with_(W_BOOKS, W_BOOK_TRAIN), EPOCHS_OF_TRAIN))
def q_fit_sgd_books(spark, sf):
    enc, _ = prep.encode_items(prep.explicit_ratings(_books(spark, sf)), "isbn", "item_id")
    # book lines carry no time: among repeats of a pair the higher rating wins
    r = prep.dedupe_ratings(enc.select("user_id", "item_id", F.col("rating").cast("double")),
                            order=["rating"])
    train, _ = prep.train_test_split(r, SEED)
    p = fac.SgdParams(k=10, epochs=FIT_EPOCHS, lr_bias=0.01, decay=1.0)
    return sgd.update_counts(sgd.fit_sgd(train, p, rows_per_block=FIT_ROWS_PER_BLOCK))


def _sampled_fit_sql():
    def epoch(e):
        h = sql_hash_int(sql_key(sql_lit("sample"), str(SEED), str(e), "user_id", "item_id"))
        return f"""SELECT user_id, item_id FROM (
    SELECT user_id, item_id, row_number() OVER (ORDER BY {h}, user_id, item_id) AS rn FROM dedup)
  WHERE rn <= (SELECT count(DISTINCT user_id) FROM dedup)"""
    drawn = "\n  UNION ALL\n  ".join(epoch(e) for e in range(FIT_EPOCHS))
    ctes = with_(W_RATINGS, W_DEDUP, W_SPLIT, f"""drawn AS ({drawn}),
trained AS (SELECT d.user_id, d.item_id FROM drawn d
            JOIN train t ON t.user_id = d.user_id AND t.item_id = d.item_id)""")
    return _updates_sql(ctes, "trained")


@query("fit_sgd_sampled", _sampled_fit_sql())
def q_fit_sgd_sampled(spark, sf):
    d = write_table(_dedup(spark, sf), new_scratch_path(spark, "ratings"))
    train, _ = prep.train_test_split(d, SEED)
    p = fac.SgdParams(k=10, epochs=FIT_EPOCHS, decay=1.0)
    return sgd.update_counts(sgd.fit_sgd(train, p, rows_per_block=FIT_ROWS_PER_BLOCK,
                                         sample_from=d.select("user_id", "item_id")))


# ---- SGD by value: the serial pass, replayed rating by rating in SQL ---------
# Nations rate part sizes by the mean rating of all their order lines.

VALUE_K, VALUE_EPOCHS, VALUE_ROWS = 2, 2, 192
VALUE = fac.SgdParams(k=VALUE_K, epochs=VALUE_EPOCHS, lr=0.1, lr_bias=0.2, lam=0.1, bias_reg=0.1,
                      decay=0.9, noise=0.5, seed=SEED)
VALUE_SETTINGS = {
    "biased": VALUE,
    "unbiased": sgd.with_params(VALUE, biased=False),
    "step": sgd.with_params(VALUE, decay=0.999, schedule="step"),
}


def _nation_ratings(spark, sf):
    """(user_id = nation, item_id = part size, mean rating) of every line."""
    r = _ratings(spark, sf).select("user_id", "item_id", "rating")
    customer = tables.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("nation"))
    part = tables.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_size").cast("long").alias("size"))
    return (r.join(customer, "user_id").join(part, "item_id")
            .groupBy(F.col("nation").alias("user_id"), F.col("size").alias("item_id"))
            .agg(F.avg("rating").alias("rating")))


W_NATIONS = """train AS (
  SELECT CAST(c.c_nationkey AS BIGINT) AS user_id, CAST(p.p_size AS BIGINT) AS item_id,
         avg(r.rating) AS rating
  FROM ratings r JOIN customer c ON c.c_custkey = r.user_id JOIN part p ON p.p_partkey = r.item_id
  GROUP BY c.c_nationkey, p.p_size)"""


def _replay_sql():
    """Serial SGD as a recursion over the ratings in the order of the fit. A
    step changes one place in each list of biases and features."""
    def block(kind, col):
        return sql_hash_bucket(sql_key(sql_lit(kind + "blk"), str(SEED), col, "0"), "n_blk")

    def mixed(x, shift, mul):
        return (f"CAST((CAST(xor({x}, {x} >> {shift}) AS UHUGEINT) * CAST({mul} AS UHUGEINT))"
                " % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)")

    def side(col, s):
        def f(q):
            return (sql_hash_uniform(sql_key(sql_lit("init"), str(SEED), sql_lit(s), "id", str(q)))
                    + f" * {VALUE.noise!r}")
        lists = ", ".join(f"list({f(q)} ORDER BY id) AS {s}{q}" for q in range(VALUE_K))
        return (f"(SELECT list(0.0::DOUBLE ORDER BY id) AS b{s}, {lists} "
                f"FROM (SELECT DISTINCT {col} AS id FROM train))")

    def put(name, at, value):
        return f"{name}[1:{at} - 1] || [{value}] || {name}[{at} + 1:] AS {name}"

    settings = ", ".join(
        f"('{n}', {int(p.biased)}, '{p.schedule}', {p.lr!r}, {p.decay!r})"
        for n, p in VALUE_SETTINGS.items())
    lam, lb, breg = VALUE.lam, VALUE.lr_bias, VALUE.bias_reg * VALUE.lam
    dot = " + ".join(f"u{q}[s.u] * i{q}[s.i]" for q in range(VALUE_K))
    state = ["bu", "bi"] + [f"{x}{q}" for x in "ui" for q in range(VALUE_K)]
    moved = [put("bu", "u", f"bu[u] + CASE WHEN biased = 1 THEN {lb!r} * (err - {breg!r} * bu[u]) ELSE 0 END"),
             put("bi", "i", f"bi[i] + CASE WHEN biased = 1 THEN {lb!r} * (err - {breg!r} * bi[i]) ELSE 0 END")]
    for own, at, other, oat in (("u", "u", "i", "i"), ("i", "i", "u", "u")):
        moved += [put(f"{own}{q}", at, f"{own}{q}[{at}] + rate * (err * {other}{q}[{oat}]"
                                       f" - {lam!r} * {own}{q}[{at}])") for q in range(VALUE_K)]
    ids = {"u": "user_id", "i": "item_id"}
    out = "\nUNION ALL\n".join(
        f"SELECT config, '{name}' AS side, x.id AS id, CAST({k} AS INTEGER) AS k, "
        f"round({lst}[x.n], 6) AS value FROM last, {s}ids x"
        for s, name in (("u", "user"), ("i", "item"))
        for k, lst in [(-1, "b" + s)] + [(q, f"{s}{q}") for q in range(VALUE_K)])
    return "WITH RECURSIVE " + ",\n".join([W_RATINGS, W_NATIONS, f"""size AS (
  SELECT avg(rating) AS mu, count(*) AS n,
         CAST(greatest(2, ceil(sqrt(count(*) / {VALUE_ROWS}.0))) AS BIGINT) AS n_blk FROM train)""",
        *[f"""{s}ids AS (SELECT id, row_number() OVER (ORDER BY id) AS n
  FROM (SELECT DISTINCT {col} AS id FROM train))""" for s, col in ids.items()],
        f"""placed AS (
  SELECT user_id, item_id, rating, n_blk, {block('u', 'user_id')} AS ublk, {block('i', 'item_id')} AS iblk,
         {sql_hash_int(sql_key(sql_lit('sgd'), str(SEED), 'user_id', 'item_id'))} AS ord FROM train, size)""",
        f"""cut AS (
  SELECT *, (iblk - ublk + n_blk) % n_blk AS stratum,
         CASE WHEN count(*) OVER b > {VALUE_ROWS}
              THEN ord % CAST(ceil(count(*) OVER b / {VALUE_ROWS}.0) AS BIGINT) ELSE 0 END AS piece
  FROM placed WINDOW b AS (PARTITION BY ublk, iblk))""",
        f"""keyed AS (
  SELECT c.*, e, xor(CAST(ord AS UBIGINT), CAST(e + 1 AS UBIGINT) << 32) AS x0
  FROM cut c, range({VALUE_EPOCHS}) r(e))""",
        f"m1 AS (SELECT *, {mixed('x0', 30, '13787848793156543929')} AS x1 FROM keyed)",
        f"m2 AS (SELECT *, {mixed('x1', 27, '10723151780598845931')} AS x2 FROM m1)",
        """turns AS (
  SELECT row_number() OVER (ORDER BY e, stratum, ublk, piece, xor(x2, x2 >> 31), user_id, item_id) AS t,
         e, u.n AS u, i.n AS i, rating
  FROM m2 JOIN uids u ON u.id = user_id JOIN iids i ON i.id = item_id)""",
        f"setting(config, biased, schedule, lr, decay) AS (VALUES {settings})",
        f"""run AS (
  SELECT config, CAST(0 AS BIGINT) AS t, {', '.join(state)}
  FROM setting, {side('user_id', 'u')}, {side('item_id', 'i')}
  UNION ALL
  SELECT config, t, {', '.join(moved)} FROM (
    SELECT r.*  EXCLUDE (t), s.t, s.u AS u, s.i AS i, biased,
           lr * pow(decay, CASE WHEN schedule = 'step' THEN s.t - 1 ELSE s.e END) AS rate,
           s.rating - ({dot} + CASE WHEN biased = 1
             THEN (SELECT mu FROM size) + bu[s.u] + bi[s.i] ELSE 0 END) AS err
    FROM run r JOIN turns s ON s.t = r.t + 1 JOIN setting USING (config)))""",
        "last AS (SELECT * FROM run WHERE t = (SELECT max(t) FROM turns))"]) + "\n" + out


def _flat_models(models):
    """(config, side, id, k, value) of models by name; k = -1 is the bias."""
    out = None
    for name, m in models.items():
        for side, f in (("user", m.user_factors), ("item", m.item_factors)):
            flat = fac.flat_factors(f, side).select(
                F.lit(name).alias("config"), "side", "id", F.col("k").cast("int").alias("k"),
                r6(F.col("value")).alias("value"))
            out = flat if out is None else out.unionByName(flat)
    return out


@query("fit_sgd_values", _replay_sql())
def q_fit_sgd_values(spark, sf):
    """Every bias and feature after the epochs, for the biased and unbiased model
    and for a rate that decays with each update."""
    train = write_table(_nation_ratings(spark, sf), new_scratch_path(spark, "ratings"))
    ready = sgd.prepare(train, seed=SEED, rows_per_block=VALUE_ROWS)
    return _flat_models({name: sgd.fit_sgd(p=p, prepared=ready)
                         for name, p in VALUE_SETTINGS.items()})


@query("fit_sgd_grid_values", _replay_sql())
def q_fit_sgd_grid_values(spark, sf):
    """The same models, fitted together in one pass over the ratings."""
    train = write_table(_nation_ratings(spark, sf), new_scratch_path(spark, "ratings"))
    models = grid.fit_sgd_grid(train, list(VALUE_SETTINGS.values()), rows_per_block=VALUE_ROWS)
    return _flat_models(dict(zip(VALUE_SETTINGS, models, strict=True)))


LEARNED_SHARE = 0.75     # of the standard deviation of the planted ratings


@query("fit_sgd_learns", with_(W_RATINGS, W_DEDUP, W_SPLIT) + """
SELECT count(*) AS n_test, CAST(1 AS INTEGER) AS learned FROM test""")
def q_fit_sgd_learns(spark, sf):
    """Planted low-rank ratings on the given pairs: the held-out error has to
    fall below a fixed share of their standard deviation."""
    pairs = _dedup(spark, sf).select("user_id", "item_id")
    r = write_table(synth.synth_ratings(pairs, SYNTH_RANK, SEED),
                    new_scratch_path(spark, "planted"))
    train, test = prep.train_test_split(r, SEED)
    p = fac.SgdParams(k=8, epochs=8, lr=0.05, lr_bias=0.02, lam=0.02, bias_reg=1.0, decay=1.0)
    m = sgd.fit_sgd(train, p)
    sd = r.agg(F.stddev("rating").alias("sd"))     # one row
    e = ev.rmse(ev.score(test, m.user_factors, m.item_factors, m.mu, p.k))
    return e.crossJoin(F.broadcast(sd)).select(
        F.col("n").alias("n_test"),
        (F.col("rmse") < F.lit(LEARNED_SHARE) * F.col("sd")).cast("int").alias("learned"))


# ---- full-batch gradient descent: exact twins, unrolled in SQL -------------

GD_K = 4
GD = fac.SgdParams(k=GD_K, epochs=2, lr=0.1, lr_bias=0.5, lam=0.1, bias_reg=0.1, decay=0.9,
                   noise=NOISE, seed=SEED)
GD_SETTINGS = {
    "base": GD,
    "lam": sgd.with_params(GD, lam=0.6),
    "rate": sgd.with_params(GD, lr=0.5),
    "decay": sgd.with_params(GD, decay=0.5),
    "bias_rate": sgd.with_params(GD, lr_bias=0.1),
    "features": sgd.with_params(GD, k=2),
}


def _gd_ctes(name: str, p: fac.SgdParams) -> str:
    """Tables ``u_{name}_{e}``, ``i_{name}_{e}`` (id, k, v; k = -1 is the bias)
    before epoch e, and ``p_{name}_{e}`` with the predictions."""
    def init(col, s):
        v = sql_hash_uniform(sql_key(sql_lit("init"), str(SEED), sql_lit(s), "x.id", "t.k"))
        return f"""SELECT x.id, CAST(t.k AS INTEGER) AS k,
    CASE WHEN t.k < 0 THEN 0.0 ELSE {v} * {p.noise!r} END AS v
  FROM (SELECT DISTINCT {col} AS id FROM train) x, range(-1, {p.k}) t(k)"""

    def pred(e):
        return f"""p_{name}_{e} AS (
  SELECT s.user_id, s.item_id, any_value(s.rating) AS rating,
         bool_or(s.is_train) AS is_train,
         (SELECT mu FROM mu) + coalesce(sum(CASE WHEN u.k < 0 THEN u.v END), 0)
         + coalesce(max(ib.v), 0)
         + coalesce(sum(CASE WHEN u.k >= 0 THEN u.v * i.v END), 0) AS pred
  FROM split s LEFT JOIN u_{name}_{e} u ON u.id = s.user_id
  LEFT JOIN i_{name}_{e} i ON i.id = s.item_id AND i.k = u.k
  LEFT JOIN i_{name}_{e} ib ON ib.id = s.item_id AND ib.k = -1
  GROUP BY s.user_id, s.item_id)"""

    def move(e, side, own, other):
        col, ocol = ("user_id", "item_id") if side == "u" else ("item_id", "user_id")
        lr = p.lr * p.decay ** e
        return f"""{side}_{name}_{e + 1} AS (
  SELECT o.id, o.k, any_value(o.v) + CASE WHEN o.k < 0
    THEN {p.lr_bias!r} * (avg(t.rating - t.pred) - {p.bias_reg * p.lam!r} * any_value(o.v))
    ELSE {lr!r} * (avg((t.rating - t.pred) * x.v) - {p.lam!r} * any_value(o.v)) END AS v
  FROM {own}_{name}_{e} o JOIN p_{name}_{e} t ON t.is_train AND t.{col} = o.id
  JOIN {other}_{name}_{e} x ON x.id = t.{ocol} AND x.k = o.k
  GROUP BY o.id, o.k)"""

    out = [f"u_{name}_0 AS (\n  {init('user_id', 'u')})",
           f"i_{name}_0 AS (\n  {init('item_id', 'i')})"]
    for e in range(p.epochs):
        out += [pred(e), move(e, "u", "u", "i"), move(e, "i", "i", "u")]
    return ",\n".join([*out, pred(p.epochs)])


def _trace_sql(settings) -> str:
    rows = "\nUNION ALL\n".join(f"""SELECT '{name}' AS config, CAST({e} AS INTEGER) AS epoch,
       CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, count(*) AS n,
       round(sqrt(avg(pow(rating - pred, 2))), 6) AS rmse
FROM p_{name}_{e} GROUP BY is_train""" for name, p in settings.items()
                                 for e in range(p.epochs + 1))
    return with_(W_RATINGS, W_DEDUP, W_SPLIT,
                 *[_gd_ctes(name, p) for name, p in settings.items()],
                 f"trace AS ({rows})")


def _gd_trace(spark, sf, settings):
    marked = (_dedup(spark, sf).withColumn("trains", prep.split_flag(SEED))
              .withColumn("split", F.when(F.col("trains"), "train").otherwise("test"))
              .withColumn("counted", F.lit(True)))
    return gradient.gradient_sweep(marked, settings).withColumn("rmse", r6(F.col("rmse")))


@query("rmse_trace", _trace_sql({"base": GD}) + "SELECT * FROM trace")
def q_rmse_trace(spark, sf):
    return _gd_trace(spark, sf, {"base": GD})


@query("sweep", _trace_sql(GD_SETTINGS) + "SELECT * FROM trace")
def q_sweep(spark, sf):
    return _gd_trace(spark, sf, GD_SETTINGS)


@query("best_config", _trace_sql(GD_SETTINGS) + f"""
SELECT config, rmse FROM trace WHERE split = 'test' AND epoch = {GD.epochs}
ORDER BY rmse, config LIMIT 1""")
def q_best_config(spark, sf):
    return tuning.best_config(q_sweep(spark, sf))


SGD_TRACE_EPOCHS = 6


@query("sgd_trace", with_(W_RATINGS, W_DEDUP, W_SPLIT) + f"""
SELECT e.epoch, s.split, s.n, CAST(1 AS INTEGER) AS finite
FROM (SELECT 'train' AS split, count(*) AS n FROM train
      UNION ALL SELECT 'test' AS split, count(*) AS n FROM test) s,
     (SELECT CAST(unnest([0, 5, {SGD_TRACE_EPOCHS}]) AS INTEGER) AS epoch) e""")
def q_sgd_trace(spark, sf):
    """The stochastic fit's own trace: before every 5th epoch and at the end."""
    train, test = _stored_split(spark, sf)
    p = fac.SgdParams(k=10, epochs=SGD_TRACE_EPOCHS, decay=0.9)
    m = sgd.fit_sgd(train, p, rows_per_block=FIT_ROWS_PER_BLOCK,
                    eval_sets={"train": train, "test": test})
    t = sgd.trace_frame(spark, m)
    return t.select("epoch", "split", "n", (F.col("rmse").isNotNull() & ~F.isnan("rmse")
                                            & (F.col("rmse") < 1e6)).cast("int").alias("finite"))


SGD_SETTINGS = [fac.SgdParams(k=5, epochs=3, decay=0.9),
                fac.SgdParams(k=5, epochs=3, lam=0.02, decay=0.9),
                fac.SgdParams(k=10, epochs=3, lr=0.005, decay=0.9)]
SGD_NAMES = [tuning.config_name(p) for p in SGD_SETTINGS]
_sgd_names = ", ".join(f"'{n}'" for n in SGD_NAMES)
_finite = "CAST(rmse IS NOT NULL AND NOT isnan(rmse) AND rmse < 1e6 AS INT)"


def _sgd_sweep(spark, sf):
    train, test = _stored_split(spark, sf)
    return tuning.sweep(train, test, SGD_SETTINGS, rows_per_block=FIT_ROWS_PER_BLOCK)


@query("fit_sgd_sweep", with_(W_RATINGS, W_DEDUP, W_SPLIT) + f"""
SELECT c.config, e.epoch, s.split, s.n, CAST(1 AS INTEGER) AS finite
FROM (SELECT 'train' AS split, count(*) AS n FROM train
      UNION ALL SELECT 'test' AS split, count(*) AS n FROM test) s,
     (SELECT CAST(unnest([0, 3]) AS INTEGER) AS epoch) e,
     (SELECT unnest([{_sgd_names}]) AS config) c""")
def q_fit_sgd_sweep(spark, sf):
    """Traces of the stochastic fits, one per setting."""
    return _sgd_sweep(spark, sf).select("config", "epoch", "split", "n",
                                        F.expr(_finite).alias("finite"))


@query("fit_sgd_best_config", with_(W_RATINGS, W_DEDUP, W_SPLIT) + """
SELECT count(*) AS n_test, CAST(1 AS INTEGER) AS n_best, CAST(1 AS INTEGER) AS known,
       CAST(1 AS INTEGER) AS finite
FROM test""")
def q_fit_sgd_best_config(spark, sf):
    """The sweep's best setting: one of those swept, with the least final test RMSE."""
    trace = _sgd_sweep(spark, sf)
    final = trace.where("split = 'test' AND epoch = 3")
    best = tuning.best_config(trace).select("config", F.col("rmse").alias("least"))
    return (final.join(best, "config").where("rmse = least")
            .agg(F.max("n").alias("n_test"), F.count("*").cast("int").alias("n_best"),
                 F.max(F.col("config").isin(SGD_NAMES).cast("int")).alias("known"),
                 F.max(F.expr(_finite)).alias("finite")))


@query("als_sweep", with_(W_RATINGS, W_DEDUP, W_SPLIT) + """
SELECT CAST(r.rank AS INTEGER) AS rank, g.reg, count(*) AS n_train, CAST(1 AS INTEGER) AS fitted,
       CAST(1 AS INTEGER) AS n_best
FROM train, (SELECT unnest([5, 10]) AS rank) r,
     (SELECT unnest([CAST(0.05 AS DOUBLE), CAST(0.1 AS DOUBLE)]) AS reg) g
GROUP BY r.rank, g.reg""")
def q_als_sweep(spark, sf):
    train, _ = _stored_split(spark, sf)
    out = tuning.als_sweep(train, ranks=(5, 10), regs=(0.05, 0.1), max_iter=3, blocks=4)
    # four settings and two single rows: small by construction
    n = train.agg(F.count(F.lit(1)).alias("n_train"))
    best = out.agg(F.sum(F.col("is_best").cast("int")).cast("int").alias("n_best"))
    return out.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(best)).select(
        "rank", "reg", "n_train", F.col("rmse").between(0, 5).cast("int").alias("fitted"), "n_best")


@query("fit_als", BASE + """
SELECT t.user_id, t.item_id, t.rating,
       CAST(u.id IS NOT NULL AND i.id IS NOT NULL AS INTEGER) AS has_prediction
FROM test t LEFT JOIN (SELECT DISTINCT user_id AS id FROM train) u ON u.id = t.user_id
LEFT JOIN (SELECT DISTINCT item_id AS id FROM train) i ON i.id = t.item_id""")
def q_fit_als(spark, sf):
    """Predictions per held-out pair; both ids have to be known."""
    train, test = _stored_split(spark, sf)
    model = als_plan.fit_als(train, rank=10, reg=0.1, max_iter=5, blocks=10)
    p = F.col("prediction")
    return als_plan.als_predict(model, test).select(
        "user_id", "item_id", "rating",
        (p.isNotNull() & ~F.isnan(p)).cast("int").alias("has_prediction"))


def _gram_sql(k):
    side = _w_factors(k=k, sides=("u",))
    return with_(W_RATINGS, W_DEDUP, W_SPLIT, side) + f"""
SELECT t.item_id, CAST(a.k AS INTEGER) AS k1, CAST(b.k AS INTEGER) AS k2,
       round(sum(a.v * b.v) + CASE WHEN a.k = b.k THEN {CHECK_PARAMS.lam!r} * count(*) ELSE 0 END, 6)
         AS value
FROM train t JOIN uf a ON a.id = t.user_id JOIN uf b ON b.id = t.user_id
GROUP BY t.item_id, a.k, b.k"""


@query("als_gram", _gram_sql(GRAM_K))
def q_als_gram(spark, sf):
    train, _ = _stored_split(spark, sf)
    users = write_table(fac.init_factors(train.select("user_id").distinct(), "user_id", "u",
                                         GRAM_K, seed=SEED, noise=NOISE),
                        new_scratch_path(spark, "factors"))
    ne = als_plan.normal_equations(train, users, "item_id", GRAM_K, CHECK_PARAMS.lam)
    z = ne.select(F.col("id").alias("item_id"), F.posexplode("gram").alias("p", "value"))
    return z.select("item_id", (F.col("p") / GRAM_K).cast("int").alias("k1"),
                    (F.col("p") % GRAM_K).cast("int").alias("k2"), r6(F.col("value")).alias("value"))


def _half_step_sql():
    side = _w_factors(k=1, sides=("u",))
    return with_(W_RATINGS, W_DEDUP, W_SPLIT, side) + f"""
SELECT t.item_id AS id,
       round(sum(u.v * t.rating) / (sum(u.v * u.v) + {CHECK_PARAMS.lam!r} * count(*)), 6) AS value
FROM train t JOIN uf u ON u.id = t.user_id GROUP BY t.item_id"""


@query("als_half_step", _half_step_sql())
def q_als_half_step(spark, sf):
    train, _ = _stored_split(spark, sf)
    users = write_table(fac.init_factors(train.select("user_id").distinct(), "user_id", "u", 1,
                                         seed=SEED, noise=NOISE),
                        new_scratch_path(spark, "factors"))
    x = als_plan.als_half_step(train, users, "item_id", 1, CHECK_PARAMS.lam)
    return x.select("id", r6(F.element_at("factors", 1)).alias("value"))


ALS_LOOP_ITERS = 2


def _als_loop_sql():
    """K = 1: a half step is one fraction per id."""
    lam = 0.1
    v = sql_hash_uniform(sql_key(sql_lit("init"), str(SEED), sql_lit("u"), "x.id", "0"))
    ctes = [f"u0 AS (SELECT x.id, {v} AS v FROM (SELECT DISTINCT user_id AS id FROM train) x)"]
    for it in range(ALS_LOOP_ITERS):
        ctes += [f"""i{it} AS (SELECT t.item_id AS id,
  sum(u.v * t.rating) / (sum(u.v * u.v) + {lam!r} * count(*)) AS v
  FROM train t JOIN u{it} u ON u.id = t.user_id GROUP BY t.item_id)""",
                 f"""u{it + 1} AS (SELECT t.user_id AS id,
  sum(i.v * t.rating) / (sum(i.v * i.v) + {lam!r} * count(*)) AS v
  FROM train t JOIN i{it} i ON i.id = t.item_id GROUP BY t.user_id)"""]
    last = ALS_LOOP_ITERS
    return with_(W_RATINGS, W_DEDUP, W_SPLIT, *ctes) + f"""
SELECT 'user' AS side, id, round(v, 6) AS value FROM u{last}
UNION ALL SELECT 'item' AS side, id, round(v, 6) AS value FROM i{last - 1}"""


@query("als_loop", _als_loop_sql())
def q_als_loop(spark, sf):
    train, _ = _stored_split(spark, sf)
    users, items, _ = als_plan.als_loop(train, k=1, iters=ALS_LOOP_ITERS, lam=0.1, seed=SEED)
    side = lambda f, name: f.select(
        F.lit(name).alias("side"), "id", r6(F.element_at("factors", 1)).alias("value"))
    return side(users, "user").unionByName(side(items, "item"))


ALS_RANK = 3


def _als_rank_sql():
    """K = 3: each half step is a 3 by 3 system per id, solved by determinants."""
    lam = 0.1

    def half(name, col, other, of):
        g = {}
        for a in range(ALS_RANK):
            for b in range(a, ALS_RANK):
                extra = f" + {lam!r} * count(*)" if a == b else ""
                g[a, b] = f"sum(f.v{a} * f.v{b}){extra} AS g{a}{b}"
        sums = ", ".join([*g.values(), *[f"sum(f.v{a} * t.rating) AS r{a}" for a in range(ALS_RANK)]])

        def m(a, b, put=None):
            return f"r{a}" if b == put else f"g{min(a, b)}{max(a, b)}"

        def det(put=None):
            c = lambda a, b: m(a, b, put)
            return (f"({c(0, 0)} * ({c(1, 1)} * {c(2, 2)} - {c(1, 2)} * {c(2, 1)})"
                    f" - {c(0, 1)} * ({c(1, 0)} * {c(2, 2)} - {c(1, 2)} * {c(2, 0)})"
                    f" + {c(0, 2)} * ({c(1, 0)} * {c(2, 1)} - {c(1, 1)} * {c(2, 0)}))")
        x = ", ".join(f"{det(q)} / {det()} AS v{q}" for q in range(ALS_RANK))
        return f"""{name} AS (SELECT id, {x} FROM (
  SELECT t.{col} AS id, {sums} FROM train t JOIN {of} f ON f.id = t.{other} GROUP BY t.{col}))"""

    init = ", ".join(sql_hash_uniform(sql_key(sql_lit("init"), str(SEED), sql_lit("u"), "x.id", str(q)))
                     + f" AS v{q}" for q in range(ALS_RANK))
    ctes = [f"u0 AS (SELECT x.id, {init} FROM (SELECT DISTINCT user_id AS id FROM train) x)"]
    for it in range(ALS_LOOP_ITERS):
        ctes += [half(f"i{it}", "item_id", "user_id", f"u{it}"),
                 half(f"u{it + 1}", "user_id", "item_id", f"i{it}")]
    out = "\nUNION ALL\n".join(
        f"SELECT '{name}' AS side, id, CAST({q} AS INTEGER) AS k, round(v{q}, 6) AS value FROM {t}"
        for name, t in (("user", f"u{ALS_LOOP_ITERS}"), ("item", f"i{ALS_LOOP_ITERS - 1}"))
        for q in range(ALS_RANK))
    return with_(W_RATINGS, W_DEDUP, W_SPLIT, *ctes) + out


@query("als_blocked_loop", _als_rank_sql())
def q_als_blocked_loop(spark, sf):
    """User and item vectors of rank 3 after two rounds over in-blocks."""
    train, _ = _stored_split(spark, sf)
    users, items, _ = als_plan.als_blocked_loop(train, k=ALS_RANK, iters=ALS_LOOP_ITERS, lam=0.1,
                                                seed=SEED)
    side = lambda f, name: f.select(
        F.lit(name).alias("side"), "id", F.posexplode("factors").alias("k", "value")).withColumn(
        "value", r6(F.col("value")))
    return side(users, "user").unionByName(side(items, "item"))


def _svm_bucket_sql():
    return sql_hash_bucket(sql_key(sql_lit("svm"), str(SEED), "vec_id"), 10)


HINGE_STEPS = 6
HINGE_REG, HINGE_RATE = 0.05, 1.0
HINGE_BATCHES = {"full": 1.0, "mini": 0.5}


def _hinge_sql():
    """The steps unrolled: one row (n, gradient sums, intercept's sum) per step."""
    def step(name, fraction, t):
        eta = HINGE_RATE / t ** 0.5
        h = sql_hash_int(sql_key(sql_lit("batch"), str(SEED), str(t), "vec_id"))
        where = "" if fraction >= 1 else f"WHERE {h} < {int(fraction * 2 ** 28)}"
        return f"""g_{name}_{t} AS (
  SELECT count(*) AS n, sum(g) AS b, list_transform(range(1, any_value(len(x)) + 1),
           lambda j: 0.0) AS zero
  FROM (SELECT x, CASE WHEN y * (list_dot_product(x, w) + c) < 1 THEN -y ELSE 0.0 END AS g
        FROM e, w_{name}_{t - 1} {where})),
s_{name}_{t} AS (
  SELECT list(s ORDER BY j) AS s FROM (
    SELECT j, sum(g * v) AS s FROM (
      SELECT CASE WHEN y * (list_dot_product(x, w) + c) < 1 THEN -y ELSE 0.0 END AS g,
             unnest(x) AS v, unnest(range(len(x))) AS j
      FROM e, w_{name}_{t - 1} {where}) GROUP BY j)),
w_{name}_{t} AS (
  SELECT list_transform(range(1, len(w) + 1), lambda j: {1 - eta * HINGE_REG!r} * w[j] - {eta!r} * s[j] / n) AS w,
         c - {eta!r} * b / n AS c
  FROM w_{name}_{t - 1}, g_{name}_{t}, s_{name}_{t})"""

    ctes = [f"""e AS (
  SELECT vec_id, embedding::DOUBLE[] AS x,
         CASE WHEN embedding[1]::DOUBLE + embedding[2]::DOUBLE > 0 THEN 1.0 ELSE -1.0 END AS y
  FROM embeddings)"""]
    for name, fraction in HINGE_BATCHES.items():
        ctes.append(f"w_{name}_0 AS (SELECT list_transform(max(x), lambda v: 0.0::DOUBLE) AS w, "
                    "0.0::DOUBLE AS c FROM e)")
        ctes += [step(name, fraction, t) for t in range(1, HINGE_STEPS + 1)]
    out = "\nUNION ALL\n".join(
        f"SELECT '{name}' AS batch, CAST(j AS INTEGER) AS j, round(v, 6) AS weight FROM ("
        f"SELECT unnest(list_prepend(c, w)) AS v, unnest(range(len(w) + 1)) AS j "
        f"FROM w_{name}_{HINGE_STEPS})" for name in HINGE_BATCHES)
    return "WITH " + ",\n".join(ctes) + "\n" + out


@query("fit_hinge", _hinge_sql())
def q_fit_hinge(spark, sf):
    """Intercept (j = 0) and weights of an SVM after hinge steps over all vectors,
    full-batch and on hashed mini-batches; the class is planted as in ``fit_svm``."""
    v = F.col("embedding").cast("array<double>")
    rows = write_table(tables.table(spark, sf, "embeddings").select(
        "vec_id", v.alias("features"), (v[0] + v[1] > 0).cast("int").alias("label")),
        new_scratch_path(spark, "vectors"))
    dims = rows.agg(F.max(F.size("features"))).first()[0]
    out = []
    for name, fraction in HINGE_BATCHES.items():
        m = linear.fit_hinge(rows, dims, steps=HINGE_STEPS, step_size=HINGE_RATE, reg=HINGE_REG,
                             fraction=fraction, seed=SEED)
        out += [(name, j, w) for j, w in enumerate([m.intercept, *m.weights])]
    return spark.createDataFrame(out, "batch string, j int, w double").select(
        "batch", "j", r6(F.col("w")).alias("weight"))


@query("fit_svm", f"""
WITH e AS (SELECT embedding[1] + embedding[2] > 0 AS pos, {_svm_bucket_sql()} < 8 AS is_train
           FROM embeddings)
SELECT CAST(sum(CASE WHEN is_train THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
       CAST(sum(CASE WHEN NOT is_train AND pos THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
       CAST(sum(CASE WHEN NOT is_train AND NOT pos THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
       CAST(1 AS INTEGER) AS separates
FROM e""")
def q_fit_svm(spark, sf):
    """Trained on a hash split, scored on the rows held out. The labels of the
    table do not follow from its vectors (held-out AUROC under 0.5), so the
    class is planted: the sign of the first two components' sum."""
    from pyspark.ml.functions import array_to_vector
    v = F.col("embedding")
    rows = tables.table(spark, sf, "embeddings").select(
        "vec_id", array_to_vector(v.cast("array<double>")).alias("features"),
        (v[0] + v[1] > 0).cast("double").alias("label"))
    is_train = hash_bucket(key("svm", SEED, "@vec_id"), 10) < 8
    train = rows.where(is_train)
    m = linear.fit_svm(train, max_iter=20)
    a = ev.auroc(linear.svm_scores(m, rows.where(~is_train)))
    n = train.agg(F.count(F.lit(1)).alias("n_train"))     # one row each
    return a.crossJoin(F.broadcast(n)).select(
        "n_train", "n_pos", "n_neg", (F.col("auroc") > 0.9).cast("int").alias("separates"))


# ============================================================================
# 2.6 evaluation
# ============================================================================

@query("rmse", PRED + """,
train_pred AS (
  SELECT t.user_id, t.item_id, t.rating, (SELECT mu FROM mu) + coalesce(d.d, 0.0) AS prediction
  FROM train t LEFT JOIN dots d ON d.user_id = t.user_id AND d.item_id = t.item_id)
SELECT 'train' AS split, count(*) AS n, round(sqrt(avg(pow(rating - prediction, 2))), 6) AS rmse
FROM train_pred
UNION ALL
SELECT 'test' AS split, count(*) AS n, round(sqrt(avg(pow(rating - prediction, 2))), 6) AS rmse
FROM test_pred""")
def q_rmse(spark, sf):
    train, test, mu, uf, itf, sizes = _sized_model(spark, sf)
    both = (train.withColumn("split", F.lit("train"))
            .unionByName(test.withColumn("split", F.lit("test"))))
    return ev.rmse(ev.score(both, uf, itf, mu, K_CHECK, sizes=sizes), by=("split",)).withColumn(
        "rmse", r6(F.col("rmse")))


@query("rmse_subset", PRED + f"""
SELECT count(*) AS n, round(sqrt(avg(pow(rating - prediction, 2))), 6) AS rmse
FROM test_pred WHERE user_id <= {SUBSET_MAX_USER}""")
def q_rmse_subset(spark, sf):
    pred, _ = _test_predictions(spark, sf)
    return ev.rmse_subset(pred, SUBSET_MAX_USER).select("n", r6(F.col("rmse")).alias("rmse"))


@query("rmse_nan_safe", PRED + """
SELECT count(*) AS n, round(sqrt(avg(pow(rating - prediction, 2))), 6) AS rmse
FROM test_pred WHERE has_factors""")
def q_rmse_nan_safe(spark, sf):
    pred, _ = _test_predictions(spark, sf)
    nanned = pred.withColumn("prediction", F.when(F.col("has_factors"), F.col("prediction"))
                             .otherwise(F.lit(float("nan"))))
    return ev.rmse_nan_safe(nanned).select("n", r6(F.col("rmse")).alias("rmse"))


def _rmse_pairs_sql():
    h = f"CAST(('0x' || substr(md5({sql_key(sql_lit('sample'), str(SEED), '0', 'user_id', 'item_id')}), 1, 7)) AS BIGINT)"
    return PRED + f""",
sample AS (
  SELECT user_id, item_id FROM (
    SELECT user_id, item_id, row_number() OVER (ORDER BY {h}, user_id, item_id) - 1 AS position
    FROM dedup)
  WHERE position < (SELECT count(DISTINCT user_id) FROM dedup)),
looked AS (
  SELECT s.user_id, s.item_id, p.rating, p.prediction
  FROM sample s LEFT JOIN test_pred p ON p.user_id = s.user_id AND p.item_id = s.item_id)
SELECT count(*) AS n_pairs,
       CAST(sum(CASE WHEN rating IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_found,
       CAST(sum(CASE WHEN rating IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
       round(sqrt(avg(pow(rating - prediction, 2))), 6) AS rmse
FROM looked"""


@query("rmse_pairs", _rmse_pairs_sql())
def q_rmse_pairs(spark, sf):
    train, test, mu, uf, itf = _init_model(spark, sf)
    d = _dedup(spark, sf)
    pairs = sgd.sampled_pairs(d.select("user_id", "item_id"), seed=SEED, epoch=0)
    r = ev.rmse_pairs(pairs, test, uf, itf, mu, K_CHECK)
    return r.withColumn("rmse", r6(F.col("rmse")))


def _dense_sql():
    def planted(alias, col, s):
        k = sql_key(sql_lit("synth"), str(SEED), sql_lit(s), "x.id", "t.k")
        return f"""{alias} AS (
  SELECT x.id AS id, CAST(t.k AS INTEGER) AS k, {sql_hash_uniform(k)} AS v
  FROM (SELECT DISTINCT {col} AS id FROM train) x, range({SYNTH_RANK}) t(k))"""
    return with_(W_RATINGS, W_DEDUP, W_SPLIT, W_FACTORS, planted("um", "user_id", "u"),
                 planted("im", "item_id", "m")) + """,
ua AS (SELECT id, list(v ORDER BY k) AS f FROM uf GROUP BY id),
ia AS (SELECT id, list(v ORDER BY k) AS f FROM itf GROUP BY id),
ut AS (SELECT id, list(v ORDER BY k) AS f FROM um GROUP BY id),
it AS (SELECT id, list(v ORDER BY k) AS f FROM im GROUP BY id),
u AS (SELECT ua.id, ua.f AS f, ut.f AS t FROM ua JOIN ut ON ut.id = ua.id),
i AS (SELECT ia.id, ia.f AS f, it.f AS t FROM ia JOIN it ON it.id = ia.id)
SELECT (SELECT count(*) FROM i) AS n_items, (SELECT count(*) FROM u) AS n_users,
       round(sqrt(avg(pow(list_dot_product(i.f, u.f) - list_dot_product(i.t, u.t), 2))), 6)
         AS rmse
FROM i, u"""


@query("rmse_dense", _dense_sql())
def q_rmse_dense(spark, sf):
    train, _ = _stored_split(spark, sf)
    uf, itf = _init_side(train, "u"), _init_side(train, "i")
    ut = synth.planted_factors(train.select("user_id").distinct(), "user_id", "u",
                               SYNTH_RANK, SEED)
    it = synth.planted_factors(train.select("item_id").distinct(), "item_id", "m",
                               SYNTH_RANK, SEED)
    r = ev.rmse_dense(uf, itf, ut, it, width=K_CHECK + SYNTH_RANK)
    return r.withColumn("rmse", r6(F.col("rmse")))


@query("prediction_listing", PRED + """
SELECT user_id, item_id, rating, round(prediction, 6) AS prediction,
       CAST(has_factors AS INTEGER) AS has_factors
FROM test_pred""")
def q_prediction_listing(spark, sf):
    pred, _ = _test_predictions(spark, sf)
    return ev.prediction_listing(pred).withColumn("prediction", r6(F.col("prediction")))


@query("predict_user", PRED + """
SELECT user_id, item_id, rating, round(prediction, 6) AS prediction FROM test_pred
WHERE user_id = (SELECT min(user_id) FROM test)""")
def q_predict_user(spark, sf):
    train, test, mu, uf, itf = _init_model(spark, sf)
    first = test.agg(F.min("user_id").alias("user_id"))   # one row
    pairs = test.join(F.broadcast(first), "user_id")
    pred = ev.score(pairs, uf, itf, mu, K_CHECK)
    return pred.select("user_id", "item_id", "rating", r6(F.col("prediction")).alias("prediction"))


@query("auroc", """
WITH s AS (SELECT embedding[1] AS s, CASE WHEN label = 0 THEN 1 ELSE 0 END AS pos FROM embeddings),
g AS (SELECT s, CAST(sum(pos) AS BIGINT) AS p, CAST(sum(1 - pos) AS BIGINT) AS q FROM s GROUP BY s),
c AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb FROM g)
SELECT round(sum(p * (qb + q / 2.0)) / (sum(p) * sum(q)), 6) AS auroc,
       CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg
FROM c""")
def q_auroc(spark, sf):
    emb = tables.table(spark, sf, "embeddings")
    scored = emb.select(F.element_at("embedding", 1).cast("double").alias("score"),
                        (F.col("label") == 0).cast("double").alias("label"))
    return ev.auroc(scored).select(r6(F.col("auroc")).alias("auroc"), "n_pos", "n_neg")
