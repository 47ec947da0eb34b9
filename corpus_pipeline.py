"""From raw documents to sharded training text: five stages, each one operator, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import decontam, mixing, near_text, quality, sharding
from framelake.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the corpus model is fitted on this stage's own input.

    Null and empty texts go, as they have too few words; repeated rows are judged one by one; without labels all that
    pass the base rules stay; no rows give none.
    """
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")), keep_columns=None, only_kept=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash candidates, 5-word similarity of 0.8): that of the smallest doc_id (null last).

    At equal ids that of the smallest text hash; rows alike in id and text are one; different texts with a null or the
    same id are told apart; no rows give none.
    """
    return near_text.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found, told apart by id and text; null texts stay, as they hold none."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a document, its text cut to the blocks that the mix draws.

    Null and word-less texts are never drawn; null sources are one source; of exact copies some may be drawn and others not.
    """
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, with the slot and the shard of each document; null ids share one; columns of these names are replaced."""
    return sharding.assign_shards(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]

#: Corpus models, hash links and drawn blocks are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
