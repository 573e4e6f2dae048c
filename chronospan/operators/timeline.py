"""Snapshots to a timeline of spans: stack, dimension, grid, islands (QRY-1).

A timeline belongs to a panel; every table carries ``panel`` and every grid is
that panel's own releases.  The sparse builder never materialises the grid: its
rows are observations and the ends of gaps.  The release list meets the rows as
a counted broadcast, and one exchange by (panel, allele_id) serves all windows,
the collapse and the dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronospan.functions.alleles import ABSENT, OPEN_END
from chronospan.session import tasks

KEY = ("panel", "allele_id")
DIMENSION = ("variation_id", "gene", "contig", "pos", "ref", "alt", "condition")
#: Rows up to which a counted table is broadcast.
SMALL_ROWS = 100_000
#: Rows that a task of the span builder gets, about; its sorts hold some 2 kB for each.
TASK_ROWS = 100_000
SPAN = (*KEY, *DIMENSION, "bucket", "stars", "clnsig_raw", "clnrevstat_raw", "valid_from", "valid_to", "last_seen", "first_snapshot_id", "is_current")


def allele_dim(raw: DataFrame) -> DataFrame:
    """AGG-5: each allele's columns as of its latest release, nulls kept."""
    return raw.groupBy(*KEY).agg(F.max_by(F.struct(*DIMENSION), "release_date").alias("d")).select(*KEY, "d.*")


def releases(raw: DataFrame) -> DataFrame:
    """The grid: releases with data, for each panel."""
    return raw.select("panel", "release_date").distinct()


def counted(raw: DataFrame) -> DataFrame:
    """The grid, with the number n of each release's rows."""
    return raw.groupBy("panel", "release_date").agg(F.count("*").alias("n"))


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, n of them, by allele in tasks of about TASK_ROWS; coalescing by shuffled bytes would give one task many times that.

    Rows for one task stay as they are: the windows' own exchange by allele will do for those.
    """
    parts = tasks(rows.sparkSession, n, TASK_ROWS)
    return rows.repartition(parts, *KEY) if parts > 1 else rows


def small(rows: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``rows`` as the broadcast side of a join if a count proves that they are at most ``most``; else as they are."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def dense_grid(raw: DataFrame) -> DataFrame:
    """JOI-1, JOI-2, PRJ-3: each allele at each release of its panel, absence made explicit."""
    grid = raw.select(*KEY).distinct().join(small(releases(raw)), "panel")
    seen = raw.select(*KEY, "release_date", "bucket", "stars", "clnsig_raw", "clnrevstat_raw", "snapshot_id")
    rows = grid.join(seen, [*KEY, "release_date"], "left")
    return rows.withColumn("bucket", F.coalesce("bucket", F.lit(ABSENT))).withColumn("stars", F.coalesce("stars", F.lit(-1)).cast("byte"))


def _spans(points: DataFrame) -> DataFrame:
    """WIN-6, WIN-3, AGG-5, JOI-3: islands of equal (bucket, stars) among points (at, until, d); d is the dimension where one was observed.

    The windows and the collapse all work within an allele, so one exchange
    serves them; the dimension is the latest observed one.
    """
    w = W.partitionBy(*KEY).orderBy("at")
    prev = F.lag(F.struct("bucket", "stars")).over(w)
    change = F.when(prev.eqNullSafe(F.struct("bucket", "stars")), 0).otherwise(1)
    islands = points.withColumn("change", change).withColumn("island", F.sum("change").over(w.rowsBetween(W.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)  # noqa: E731  AGG-6: at the span's start, nulls skipped
    spans = islands.groupBy(*KEY, "island").agg(
        F.min_by("bucket", "at").alias("bucket"), F.min_by("stars", "at").alias("stars"), first("clnsig_raw"), first("clnrevstat_raw"),
        F.min("at").alias("valid_from"), F.max("until").alias("last_seen"), F.min("snapshot_id").alias("first_snapshot_id"),
        F.max_by("d", F.when(F.col("d").isNotNull(), F.col("at"))).alias("d"), F.max(F.when(F.col("d").isNotNull(), F.col("at"))).alias("d_at"),
    )
    nxt = F.lead("valid_from").over(W.partitionBy(*KEY).orderBy("valid_from"))
    out = spans.withColumn("next", nxt).withColumn("valid_to", F.coalesce("next", F.lit(OPEN_END).cast("date"))).withColumn("is_current", F.col("next").isNull())
    latest = F.max_by("d", "d_at").over(W.partitionBy(*KEY))
    return out.withColumn("d", latest).select(*KEY, "d.*", *[c for c in SPAN if c not in (*KEY, *DIMENSION)]).select(*SPAN)


def dense_spans(raw: DataFrame) -> DataFrame:
    """Spans over the full grid."""
    grid = dense_grid(raw).withColumn("at", F.col("release_date")).withColumn("until", F.col("release_date"))
    seen = raw.select(*KEY, "release_date", F.struct(*DIMENSION).alias("d"))
    cells = F.approx_count_distinct("allele_id") * F.approx_count_distinct("release_date")
    n = raw.groupBy("panel").agg(cells.alias("n")).agg(F.sum("n")).first()[0] or 0
    return _spans(dealt(grid.join(seen, [*KEY, "release_date"], "left"), n))


def ordinals(dates: DataFrame) -> DataFrame:
    """The release list, as long as there are releases: each with its number, its neighbours, and its panel's first and last."""
    w = W.partitionBy("panel").orderBy("release_date")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return dates.select(
        "panel", "release_date", F.row_number().over(w).alias("i"), F.lag("release_date").over(w).alias("before"), F.lead("release_date").over(w).alias("after"),
        F.first("release_date").over(whole).alias("first"), F.last("release_date").over(whole).alias("last"),
    )


def sparse_points(raw: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Observations, and one absent point for the lead and for each gap: at and until are its first and last release, d an observation's dimension.

    ``dates`` as of ``counted`` spare a count of the rows.
    """
    dates = counted(raw) if dates is None else dates
    listed, n = dates.agg(F.count("*"), F.sum("n")).first() if "n" in dates.columns else (dates.limit(SMALL_ROWS + 1).count(), raw.count())
    grid = F.broadcast(ordinals(dates)) if listed <= SMALL_ROWS else ordinals(dates)
    own = raw.select(*KEY, "release_date", "bucket", "stars", "clnsig_raw", "clnrevstat_raw", "snapshot_id", F.struct(*DIMENSION).alias("d")).join(grid, ["panel", "release_date"])
    own = dealt(own, n or 0)
    w = W.partitionBy(*KEY).orderBy("release_date")
    own = own.withColumn("next", F.lead(F.struct("i", "before")).over(w)).withColumn("lead", F.lag("i").over(w).isNull() & (F.col("i") > 1))
    kept = ("bucket", "stars", "clnsig_raw", "clnrevstat_raw", "snapshot_id", "d")
    kinds = dict(own.select(*kept).dtypes)

    def absent(at: str, until: Column) -> Column:
        fixed = {"bucket": F.lit(ABSENT), "stars": F.lit(-1)}
        return F.struct(F.col(at).alias("at"), until.alias("until"), *(fixed.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in kept))

    seen = F.struct(F.col("release_date").alias("at"), F.col("release_date").alias("until"), *kept)
    gap = F.when(F.col("next").isNull(), F.col("after").isNotNull()).otherwise(F.col("next.i") > F.col("i") + 1)
    points = F.array(seen, F.when(gap, absent("after", F.coalesce("next.before", "last"))), F.when(F.col("lead"), absent("first", F.col("before"))))
    return own.select(*KEY, F.explode(F.filter(points, lambda p: p.isNotNull())).alias("p")).select(*KEY, "p.*")


def sparse_spans(raw: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """The spans of ``dense_spans`` without the grid; ``dates``: the releases, if they are known."""
    return _spans(sparse_points(raw, dates))


def overlaps(spans: DataFrame) -> DataFrame:
    """JOI-13: spans of one allele that reach into the next; none if all is well."""
    w = W.partitionBy(*KEY).orderBy("valid_from", "valid_to")
    return spans.withColumn("next_from", F.lead("valid_from").over(w)).where("next_from < valid_to").select(*KEY, "valid_from", "valid_to", "next_from")


def span_stats(spans: DataFrame) -> DataFrame:
    """QRY-17: spans, alleles, and alleles with more than one span, by panel."""
    each = spans.groupBy(*KEY).agg(F.count("*").alias("k"))
    return each.groupBy("panel").agg(F.sum("k").alias("spans"), F.count("*").alias("alleles"), F.count_if(F.col("k") > 1).alias("moved_alleles"))


def coverage(raw: DataFrame) -> DataFrame:
    """QRY-3: first and last release, releases, rows and alleles of each panel."""
    return raw.groupBy("panel").agg(
        F.min("release_date").alias("earliest"), F.max("release_date").alias("latest"), F.countDistinct("release_date").alias("n_releases"), F.count("*").alias("n_rows"), F.countDistinct("allele_id").alias("n_alleles")
    )
