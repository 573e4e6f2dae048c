"""Listings of releases, samples of them, regions and panels (SRC-15, SRC-17, SRC-18, SRC-21, SCL-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Name of a release file in a listing: letters, eight digits of the date, nothing after the ending.
LISTED = r"clinvar_([0-9]{8})\.vcf\.gz(?!\.)"


def listed_dates(html: Column, pattern: str = LISTED) -> Column:
    """SRC-15: dates of a listing, distinct and sorted; names that are no date are left out."""
    found = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda d: F.try_to_timestamp(d, F.lit("yyyyMMdd")).cast("date"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda d: d.isNotNull())))


def file_url(root: Column, release: Column, dir_year: Column) -> Column:
    """SCL-16: a release lies in the folder of its listing's year, which may differ from its own."""
    return F.concat(root, F.lit("/"), F.coalesce(dir_year, F.year(release)).cast("string"), F.lit("/clinvar_"), F.date_format(release, "yyyyMMdd"), F.lit(".vcf.gz"))


def systematic_sample(releases: DataFrame, per_year: int) -> DataFrame:
    """SRC-17: of each year's n releases those numbered floor(i * n / per_year), all if there are no more."""
    w = W.partitionBy("year").orderBy("release_date")
    own = releases.withColumn("year", F.year("release_date")).withColumn("k", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(W.partitionBy("year")))
    # k is picked iff some i has floor(i * n / m) = k: the least i with i * n >= k * m, if i * n < (k + 1) * m
    i = F.floor((F.col("k") * per_year + F.col("n") - 1) / F.col("n"))
    picked = (F.col("n") <= per_year) | ((i < per_year) & (i * F.col("n") < (F.col("k") + 1) * per_year))
    return own.where(picked).drop("year", "k", "n")


def panel(spark: SparkSession, path: str) -> DataFrame:
    """SRC-21: the genes of a panel file, in upper case."""
    return spark.read.schema("name string, genes array<string>").json(path, multiLine=True).select("name", F.explode(F.transform("genes", F.upper)).alias("gene"))


def in_regions(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """FLT-8: rows inside a region (symbol, contig, start, end), with its symbol; contigs may bear ``chr``."""
    bare = lambda c: F.regexp_replace(c, "^chr", "")
    r = regions.select(F.col("symbol").alias("region"), bare(F.col("contig")).alias("region_contig"), "start", "end")
    hit = (bare(F.col("contig")) == F.col("region_contig")) & F.col("pos").between(F.col("start"), F.col("end"))
    return rows.join(r, hit).drop("region_contig", "start", "end")


def region_warnings(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """AGG-13: regions whose records never name the region's own gene."""
    seen = in_regions(rows, regions).groupBy("region").agg(F.collect_set("gene").alias("genes"))
    return seen.where(~F.array_contains("genes", F.col("region")))
