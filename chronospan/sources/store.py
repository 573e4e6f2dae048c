"""A built timeline in a folder: spans, releases, dimension and steps are computed once and read many times (QRY-1, SNK-4).

All tables of a build are one generation: a reader sees those of one build.

``assertion_span`` lies in a folder for each panel, sorted by gene within its
files, so a query of one panel and gene reads few row groups.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospan.operators import movement, timeline
from chronospan.sources.generations import current, generation


class Built(NamedTuple):
    """The tables of a timeline; ``steps`` has each transition between neighbouring releases and its share."""

    releases: DataFrame
    spans: DataFrame
    dim: DataFrame
    steps: DataFrame


def build(raw: DataFrame, root: str, **more: DataFrame) -> Built:
    """Builds all tables from raw rows as one generation of ``root``, and tables ``more`` with them."""
    spark = raw.sparkSession
    with generation(spark, root) as new:
        timeline.counted(raw).write.parquet(f"{new}/release")
        releases = spark.read.parquet(f"{new}/release")
        spans = timeline.sparse_spans(raw, releases)
        # rows are dealt by allele already: sorting each task's rows takes no further exchange
        spans.sortWithinPartitions("panel", "gene", "allele_id", "valid_from").write.partitionBy("panel").parquet(f"{new}/assertion_span")
        derived(spark, new)
        for name, rows in more.items():
            rows.write.parquet(f"{new}/{name}")
    return stored_at(spark, new)


def derived(spark: SparkSession, folder: str) -> None:
    """Writes the tables that follow from the spans and releases of a folder."""
    releases, spans = spark.read.parquet(f"{folder}/release"), spans_at(spark, folder)
    spans.where("is_current").select(*timeline.KEY, *timeline.DIMENSION).write.parquet(f"{folder}/allele_dim")
    movement.step_series_from_spans(spans, releases).write.parquet(f"{folder}/policy_step")


def spans_at(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/assertion_span").withColumn("panel", F.col("panel").cast("string")).select(*timeline.SPAN)


def stored_at(spark: SparkSession, folder: str) -> Built:
    """The tables of a generation's folder."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return Built(read("release").select("panel", "release_date"), spans_at(spark, folder), read("allele_dim"), read("policy_step"))


def stored_in(spark: SparkSession, root: str) -> Built:
    """The tables of the generation that is committed now; later builds don't change them."""
    return stored_at(spark, current(spark, root))
