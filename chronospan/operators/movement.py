"""What moved between two dates, and which moves are relabelling (QRY-4 to QRY-7)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronospan.functions.alleles import ABSENT, TOWARD_BENIGN, TOWARD_PATHOGENIC, ratio
from chronospan.operators.asof import at_both, on
from chronospan.operators.timeline import KEY

EVENT_KEY = ("panel", "from_bucket", "to_bucket", "changed_on")


def moves(spans: DataFrame, baseline: str, now: str) -> DataFrame:
    """JOI-4, FLT-4: alleles whose buckets differ between the dates."""
    both = at_both(spans, on(baseline), ("gene", "variation_id", "bucket", "stars"), on(now), ("bucket", "stars", "clnsig_raw", "valid_from"))
    rows = both.where("now IS NOT NULL").select(
        *KEY, "then.gene", "then.variation_id", F.col("then.bucket").alias("from_bucket"), F.col("then.stars").alias("from_stars"), F.col("now.bucket").alias("to_bucket"), F.col("now.stars").alias("to_stars"),
        F.col("now.clnsig_raw").alias("to_clnsig"), F.col("now.valid_from").alias("changed_on"),
    )
    return rows.where(~F.col("from_bucket").eqNullSafe(F.col("to_bucket")))


def panel_movement(spans: DataFrame, baseline: str, now: str, suspects: DataFrame | None = None) -> DataFrame:
    """QRY-4: the movement summary of each panel, in one pass over one aggregate.

    ``suspects`` has EVENT_KEY (see ``suspect_keys``); a bucket that no counter
    names still counts as moved.
    """
    both = at_both(spans, on(baseline), ("bucket",), on(now), ("bucket", "valid_from"))
    both = both.select("panel", F.col("then.bucket").alias("from_bucket"), F.col("now.bucket").alias("to_bucket"), F.col("now.valid_from").alias("changed_on")).withColumn("bucket", F.col("from_bucket"))
    flag = F.lit(False)
    if suspects is not None:
        both = both.join(suspects.select(*EVENT_KEY, F.lit(True).alias("hit")), list(EVENT_KEY), "left")
        flag = F.coalesce("hit", F.lit(False))
    moved = (F.col("bucket") == "UNCERTAIN") & F.col("to_bucket").isNotNull() & (F.col("bucket") != F.col("to_bucket"))
    to = F.col("to_bucket")
    out = both.groupBy("panel").agg(
        F.count_if(F.col("bucket") != ABSENT).alias("total_tracked"), F.count_if(F.col("bucket") == "UNCERTAIN").alias("vus_at_baseline"), F.count_if(moved).alias("vus_moved"),
        F.count_if(moved & to.isin(*TOWARD_PATHOGENIC)).alias("moved_to_pathogenic"), F.count_if(moved & to.isin(*TOWARD_BENIGN)).alias("moved_to_benign"),
        F.count_if(moved & (to == "CONFLICTING")).alias("moved_to_conflicting"), F.count_if(moved & (to == ABSENT)).alias("retracted"), F.count_if(moved & flag).alias("policy_suspect"),
    )
    n = F.col("vus_at_baseline")
    return (
        out.withColumn("movement_rate", ratio(F.col("vus_moved"), n))
        .withColumn("movement_rate_adjusted", ratio(F.col("vus_moved") - F.col("policy_suspect"), n))
        .withColumn("actionable_rate", ratio(F.col("moved_to_pathogenic") + F.col("moved_to_benign"), n))
    )


def movement_detail(spans: DataFrame, baseline: str, now: str, from_bucket: str = "UNCERTAIN", limit: int = 50) -> DataFrame:
    """QRY-5, SRT-3: the moves of highest review status; ties by gene, then identity."""
    return moves(spans, baseline, now).where(F.col("from_bucket") == from_bucket).orderBy(F.desc("to_stars"), "gene", "panel", "allele_id").limit(limit)


def step_series(grid: DataFrame) -> DataFrame:
    """QRY-6 at threshold 0, over the dense grid: each transition between neighbouring releases and its share of the earlier corpus."""
    w = W.partitionBy(*KEY).orderBy("release_date")
    stepped = grid.select(*KEY, "release_date", "bucket", F.lag("bucket").over(w).alias("prev"), F.lag("release_date").over(w).alias("prev_date"))
    moved = stepped.where((F.col("prev") != F.col("bucket")) & (F.col("prev") != ABSENT) & (F.col("bucket") != ABSENT))
    counts = moved.groupBy("panel", F.col("prev_date").alias("from_date"), F.col("release_date").alias("to_date"), F.col("prev").alias("from_bucket"), F.col("bucket").alias("to_bucket")).agg(F.count("*").alias("count"))
    corpus = grid.where(F.col("bucket") != ABSENT).groupBy("panel", F.col("release_date").alias("from_date")).agg(F.count("*").alias("corpus"))
    return counts.join(corpus, ["panel", "from_date"]).withColumn("share", F.col("count").cast("double") / F.col("corpus")).drop("corpus")


def step_series_from_spans(spans: DataFrame, releases: DataFrame) -> DataFrame:
    """The same without the grid: transitions happen only where a span starts, and the corpus changes only there too."""
    w = W.partitionBy(*KEY).orderBy("valid_from")
    before = W.partitionBy("panel").orderBy("release_date")  # as many rows as releases
    steps = releases.select("panel", "release_date").withColumn("from_date", F.lag("release_date").over(before))
    own = spans.select(*KEY, "bucket", "valid_from", "valid_to", F.lag("bucket").over(w).alias("prev"))
    moved = own.where((F.col("prev") != F.col("bucket")) & (F.col("prev") != ABSENT) & (F.col("bucket") != ABSENT))
    counts = moved.groupBy("panel", F.col("valid_from").alias("to_date"), F.col("prev").alias("from_bucket"), F.col("bucket").alias("to_bucket")).agg(F.count("*").alias("count"))
    # corpus at a release: classified spans begun by then less those ended by then, as running sums over the release list
    held = own.where(F.col("bucket") != ABSENT)
    edge = held.select("panel", F.explode(F.array(F.struct(F.col("valid_from").alias("at"), F.lit(1).alias("d")), F.struct(F.col("valid_to").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    change = edge.groupBy("panel", F.col("e.at").alias("release_date")).agg(F.sum("e.d").alias("d"))
    running = F.sum(F.coalesce("d", F.lit(0))).over(before.rowsBetween(W.unboundedPreceding, 0))
    corpus = releases.select("panel", "release_date").join(change, ["panel", "release_date"], "left").select("panel", F.col("release_date").alias("from_date"), running.alias("corpus"))
    out = counts.join(steps.withColumnRenamed("release_date", "to_date"), ["panel", "to_date"]).join(corpus, ["panel", "from_date"])
    return out.select("panel", "from_date", "to_date", "from_bucket", "to_bucket", "count", (F.col("count").cast("double") / F.col("corpus")).alias("share"))


def detected(steps: DataFrame, threshold: float) -> DataFrame:
    """QRY-6: steps of at least this share; the threshold has no default because it depends on the panel."""
    if not (math.isfinite(threshold) and 0 < threshold < 1):
        raise ValueError(f"a threshold lies between 0 and 1, not {threshold!r}")
    return steps.where(F.col("share") >= threshold)


def suspect_keys(events: DataFrame) -> DataFrame:
    """QRY-7: transition and landing date of each event; both must match."""
    return events.select("panel", "from_bucket", "to_bucket", F.col("to_date").alias("changed_on")).distinct()
