"""Corpus pipeline: what a raw crawl goes through before training.

Each stage takes and returns the columns of ``documents``, the last returns
packed pieces. Documents that the quality rules reject go; of equal texts one
row stays, of each near-duplicate group one document; byte strings of 400 and
more that start elsewhere too, and runs of 50 words and more that another text
has too, are cut out of the texts (the document stays); what is left is tokenised
and packed.

A stage's result reads helper tables in the shared folder. They are deleted as
soon as a later stage of the same run is called with input that no longer reads
them, that is, when the result has been written; ``run`` also deletes each
written result when the next one stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latentforge.llm.common import documents, materialize, recorded
from latentforge.llm.exact_dedup import keep_exact
from latentforge.llm.host_rules import keep_quality
from latentforge.llm.near_dedup import keep_near
from latentforge.llm.packing import best_fit_packing
from latentforge.llm.queries import tokenizer_path
from latentforge.llm.suffix_dedup import cut_repeats
from latentforge.session import drop_path

#: similarity from which near copies go; tests/llm holds the stage to this value
NEAR_PERCENT = 85


#: helper folders of stages that a later one has not cleared yet, by run and stage
_helpers: dict[tuple[str, int], list[str]] = {}


def _stage(number: int, spark: SparkSession, docs: DataFrame, sf_dir: str, work) -> DataFrame:
    """``work(docs)``, after the helper tables of earlier stages have gone."""
    earlier = [k for k in _helpers if k[0] == sf_dir and k[1] < number]
    reads = "\n".join(docs.inputFiles()) if earlier else ""
    for k in earlier:
        if not any(p.rpartition("/")[2] in reads for p in _helpers[k]):
            for path in _helpers.pop(k):
                drop_path(spark, path)
    with recorded() as paths:
        out = work(docs)
    _helpers.setdefault((sf_dir, number), []).extend(paths)
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2."""
    return _stage(1, spark, docs, sf_dir, keep_quality)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4."""
    return _stage(2, spark, docs, sf_dir, keep_exact)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10."""
    return _stage(3, spark, docs, sf_dir, lambda d: keep_near(d, NEAR_PERCENT))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8."""
    return _stage(4, spark, docs, sf_dir, lambda d: cut_repeats(d, passages=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5."""
    return _stage(5, spark, docs, sf_dir, lambda d: best_fit_packing(
        d.select("doc_id", "text"), tokenizer_path()))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup),
          ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", pack)]

#: the third to fifth stage are beyond SQL; tests/llm holds them to brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and reread."""
    docs, written = documents(spark, sf_dir), []
    for name, stage in STAGES:
        lazy = stage(spark, docs, sf_dir)
        with recorded() as paths:
            docs = materialize(lazy, "stage-" + name)
        for path in written:
            drop_path(spark, path)
        written = paths
    for key in [k for k in _helpers if k[0] == sf_dir]:
        for path in _helpers.pop(key):
            drop_path(spark, path)
    return docs
