"""From raw documents to token ids, in stages that are written and read again.

Every stage takes all rows of the stage before it. Cases, the same for all of them: null and empty texts are rows like others, as
each operator says; repeated rows are treated alike; a null doc_id or source is a value of its own; very long texts are read whole; an empty table gives
an empty one; columns beside those of documents are handed on whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cragline.llm import bpe, lines, mixing, neardup, quality
from cragline.llm.common import discard, materialise, table
from cragline.llm.queries import tokenizer_path


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows of documents, whatever docs holds."""
    model = quality.fit(table(spark, sf_dir, "documents"), quality.training_labels(table(spark, sf_dir, "labels"), 5, 0))
    return quality.accepted(docs, model)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of lines that stand in many sources go, and so do documents of which that leaves nothing."""
    return lines.without_boilerplate(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: of those rows that have no words, all."""
    return neardup.one_of_each(docs)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document: none for a null or an empty text."""
    return bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_path()).select("doc_id", "source", "ids")


STAGES = [("quality", stage_quality), ("line dedup", stage_lines), ("near duplicates", stage_near_duplicates), ("mixing", stage_mix), ("bpe", stage_encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes once the next one is written; the result still reads the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
