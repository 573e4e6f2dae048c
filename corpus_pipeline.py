"""From raw documents to packed training sequences, stage by stage.

Each stage takes all rows that its predecessor kept and returns rows of the
columns of ``documents``; the last returns the pieces with their sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronospan.llm.common import Scratch, configured, table
from chronospan.llm.decontam import without_leaks
from chronospan.llm.langid import in_known_language
from chronospan.llm.linededup import with_own_lines
from chronospan.llm.ngramjoin import one_of_each
from chronospan.llm.packing import pack_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    configured(spark)
    return in_known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without blocks of lines that earlier ones hold."""
    configured(spark)
    return with_own_lines(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, similarity 0.8 or more."""
    configured(spark)
    return one_of_each(docs, shingle=5, similar=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    configured(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    configured(spark)
    return pack_documents(docs)


STAGES = [("language ID", language), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_join), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]

#: SQL can express neither a patience diff nor the automata: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and reread."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.saved(docs, name.replace(" ", "-"))
    return docs
