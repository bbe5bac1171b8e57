"""Quality rules judged per host, with shrunk failure rates.

Each document is measured (words, symbols, repeated lines, repeated 3-word
windows) by column expressions inside its own row; no text is shuffled. Rule
failures are counted per host by partial aggregates, so a host with a third of
all documents costs one row per task. A host's failure rate is shrunk toward
the corpus by a beta prior fitted to the hosts' rates (method of moments):

    rate = (failures + alpha) / (documents + alpha + beta)

Hosts above ``host_rate`` are rejected and the verdict is joined back to the
documents.

A document itself fails when it has under 50 words, when over half of its
words lie in repeated 3-word windows, when it has over ``symbol_ratio``
symbols per word, or when over ``dup_line_ratio`` of its lines are repeated.

Edge cases: null text has no words (and fails as short); a null host is a host
of its own; one host, or hosts with equal rates, give an infinitely strong
prior: every host takes the corpus rate; an empty table gives no rows; further
columns are carried untouched by ``apply_host_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, join_back, materialize

#: thresholds; ratios are inclusive on the passing side
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOL_PERCENT = 50
DUP_LINE_PERCENT = 50
HOST_PERCENT = 50


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, base_failed, failed`` to ``docs`` (all computed in the row)."""
    t = F.coalesce(F.col(text), F.lit(""))
    q = docs.withColumn("_words", F.array_remove(F.split(t, SPACE), ""))
    # 3-word windows as 64-bit hashes with their start, sorted by hash: equal
    # windows become neighbours, without leaving the row
    q = q.withColumn("_win", F.expr(
        "CASE WHEN size(_words) >= 4 THEN array_sort(transform(sequence(0, size(_words) - 3), "
        "i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) AS h, i AS i))) "
        "ELSE cast(array() AS array<struct<h:bigint,i:int>>) END"))
    q = q.withColumn("_hit", F.expr(
        "filter(zip_with(slice(_win, 1, greatest(size(_win) - 1, 0)), "
        "slice(_win, 2, greatest(size(_win) - 1, 0)), "
        "(a, b) -> CASE WHEN a.h = b.h THEN array(a.i, b.i) END), x -> x IS NOT NULL)"))
    q = q.withColumn("_at", F.expr("sort_array(array_distinct(flatten(_hit)))"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    q = (q.withColumn("n_words", F.size("_words").cast("long"))
         .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
         .withColumn("n_symbols",
                     F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"))
         .withColumn("_lines", lines)
         .withColumn("n_lines", F.size("_lines").cast("long"))
         .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines")))
                     .cast("long"))
         # each repeated window covers up to 3 words, fewer if the next one
         # starts sooner
         .withColumn("n_repeat_words", F.expr(
             "CASE WHEN size(_at) = 0 THEN 0L ELSE 3L + aggregate(zip_with("
             "slice(_at, 1, size(_at) - 1), slice(_at, 2, size(_at) - 1), "
             "(a, b) -> least(3, b - a)), 0L, (s, x) -> s + x) END")))
    base = ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    q = q.withColumn("base_failed", base)
    failed = (F.col("base_failed")
              | (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("n_words"))
              | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines")))
    return q.withColumn("failed", failed).drop("_words", "_win", "_hit", "_at", "_lines")


def host_rates(measured: DataFrame, host: str = "host") -> DataFrame:
    """``host, host_docs, host_failed, host_rate, host_rejected``.

    The prior's mean m and variance v come from the hosts' raw rates:
    strength = m (1 - m) / v - 1, alpha = m strength, beta = (1 - m) strength."""
    hosts = materialize(
        measured.groupBy(host).agg(F.count("*").alias("host_docs"),
                                   F.sum(F.col("failed").cast("long")).alias("host_failed")),
        "hosts")
    m, v = hosts.agg(F.avg(F.col("host_failed") / F.col("host_docs")),
                     F.var_pop(F.col("host_failed") / F.col("host_docs"))).first()
    m, v = m or 0.0, v or 0.0
    if v > 0 and m * (1 - m) > v:
        strength = m * (1 - m) / v - 1
        rate: Column = ((F.col("host_failed") + m * strength)
                        / (F.col("host_docs") + strength))
    elif v > 0:  # rates of 0 and 1 only: nothing to shrink toward
        rate = F.col("host_failed") / F.col("host_docs")
    else:
        rate = F.lit(float(m))
    return hosts.withColumn("host_rate", rate).withColumn(
        "host_rejected", F.col("host_rate") * 100 > HOST_PERCENT)


def apply_host_rules(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Measures ``docs(text, source, ...)`` once, judges hosts, joins back.

    Returns struct ``doc`` with the ``carry`` columns, the measures, ``host``,
    ``host_docs, host_failed, host_rate, host_rejected`` and ``kept``."""
    packed = docs.select(F.struct(*[F.col(c) for c in carry]).alias("doc"),
                         F.col("text").alias("_text"),
                         F.concat(F.lit("="), F.col("source").cast("string")).alias("_host"))
    measured = measures(packed, "_text").withColumn(
        "host", F.coalesce("_host", F.lit("null"))).drop("_text", "_host")
    scored = materialize(measured, "measured")
    hosts = materialize(host_rates(scored), "host-rates")
    out = join_back(scored, hosts, "host", "host_docs",
                    F.xxhash64("n_words", "word_chars", "n_symbols"))
    return out.withColumn("kept", ~F.col("failed") & ~F.col("host_rejected"))


def keep_quality(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    return apply_host_rules(docs, docs.columns).filter("kept").select("doc.*")
