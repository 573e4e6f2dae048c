"""Point-in-time reads of a timeline (FLT-1, QRY-2, QRY-12, QRY-13, QRY-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronospan.functions.alleles import ABSENT, OPEN_END
from chronospan.operators.timeline import small


def on(day: str) -> Column:
    """FLT-1: whether a span holds on a date: from its start, before its end."""
    return (F.col("valid_from") <= F.lit(day).cast("date")) & (F.col("valid_to") > F.lit(day).cast("date"))


def as_of(spans: DataFrame, day: str) -> DataFrame:
    """FLT-1: spans that hold on a date."""
    return spans.where(on(day))


def at_both(spans: DataFrame, then: Column, then_columns: tuple[str, ...], now: Column, now_columns: tuple[str, ...]) -> DataFrame:
    """JOI-4, JOI-5: each allele that has a span in ``then``, its columns as struct ``then``, and those of its span in ``now``, null if it has none.

    An allele has at most one span in either, so an aggregate over one scan of
    the spans stands for the join: both conditions reach the scan, and there is one exchange.
    """
    pick = lambda held, columns: F.any_value(F.when(held, F.struct(*columns)), F.lit(True))
    both = spans.where(then | now).groupBy("panel", "allele_id").agg(pick(then, then_columns).alias("then"), pick(now, now_columns).alias("now"))
    return both.where("then IS NOT NULL")


def current(spans: DataFrame) -> DataFrame:
    """FLT-2"""
    return spans.where("is_current")


def history(spans: DataFrame, allele_id: str) -> DataFrame:
    """QRY-13: all states of one allele; the open end reads as null."""
    own = spans.where(F.col("allele_id") == allele_id)
    return own.select("panel", "allele_id", "bucket", "stars", "clnsig_raw", "valid_from", F.nullif("valid_to", F.lit(OPEN_END).cast("date")).alias("valid_to"), "is_current")


def timeline_start(spans: DataFrame) -> DataFrame:
    """QRY-16"""
    return spans.groupBy("panel").agg(F.min("valid_from").alias("timeline_start"))


def composition(spans: DataFrame, releases: DataFrame, gene: str) -> DataFrame:
    """QRY-12: classified alleles of a gene by panel, release and bucket; a release without any has one row, bucket null.

    The range join runs between spans and the release list, a counted
    broadcast; its counts are then joined to the list.
    """
    own = spans.where((F.col("gene") == gene.upper()) & (F.col("bucket") != ABSENT)).select("panel", "bucket", "valid_from", "valid_to")
    r = small(releases.select("panel", "release_date"))
    counts = own.alias("s").join(r.alias("r"), (F.col("s.panel") == F.col("r.panel")) & (F.col("valid_from") <= F.col("release_date")) & (F.col("valid_to") > F.col("release_date")))
    counts = counts.groupBy(F.col("r.panel").alias("panel"), "release_date", "bucket").agg(F.count("*").alias("n"))
    return releases.select("panel", "release_date").join(counts, ["panel", "release_date"], "left").select("panel", "release_date", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def composition_exploded(spans: DataFrame, releases: DataFrame, gene: str) -> DataFrame:
    """The same by release ordinals: each span lists the releases that it covers, no range join."""
    own = spans.where((F.col("gene") == gene.upper()) & (F.col("bucket") != ABSENT)).select("panel", "bucket", "valid_from", "valid_to")
    dates = releases.groupBy("panel").agg(F.sort_array(F.collect_set("release_date")).alias("dates"))
    held = F.filter("dates", lambda d: (F.col("valid_from") <= d) & (F.col("valid_to") > d))
    counts = own.join(small(dates), "panel").select("panel", "bucket", F.explode(held).alias("release_date")).groupBy("panel", "release_date", "bucket").agg(F.count("*").alias("n"))
    return releases.select("panel", "release_date").join(counts, ["panel", "release_date"], "left").select("panel", "release_date", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def composition_wide(spans: DataFrame, releases: DataFrame, gene: str) -> DataFrame:
    """AGG-10: one row a release, counts as a map and their total; releases without any stay."""
    long = composition(spans, releases, gene)
    entries = F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "n")))
    return long.groupBy("panel", "release_date").agg(F.map_from_entries(entries).alias("counts"), F.sum("n").alias("total"))
