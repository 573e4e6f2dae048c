"""Ranked genes, headlines and pages of variants (QRY-8 to QRY-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronospan.functions.alleles import ABSENT, ACTIONABLE, TOWARD_BENIGN, TOWARD_PATHOGENIC, ratio
from chronospan.operators.asof import at_both, on
from chronospan.operators.movement import EVENT_KEY
from chronospan.operators.timeline import KEY

#: A rate of no more uncertain variants than this is too thin to lead with.
THIN = 200


def then_now(spans: DataFrame, day: str) -> DataFrame:
    """JOI-5: the state on a date beside the current one."""
    rest = tuple(c for c in spans.columns if c not in KEY)
    both = at_both(spans, on(day), rest, F.col("is_current"), ("bucket", "stars", "valid_from")).where("now IS NOT NULL")
    return both.select(*KEY, "then.*", F.col("now.bucket").alias("now_bucket"), F.col("now.stars").alias("now_stars"), F.col("now.valid_from").alias("changed_on"))


def _flagged(rows: DataFrame, suspects: DataFrame | None) -> DataFrame:
    """JOI-9: policy_suspect by panel, transition and landing date."""
    if suspects is None:
        return rows.withColumn("policy_suspect", F.lit(False))
    keys = suspects.select(F.col("panel"), F.col("from_bucket").alias("bucket"), F.col("to_bucket").alias("now_bucket"), "changed_on", F.lit(True).alias("hit"))
    return rows.join(keys, ["panel", "bucket", "now_bucket", "changed_on"], "left").withColumn("policy_suspect", F.coalesce("hit", F.lit(False))).drop("hit")


def genes_ranked(spans: DataFrame, day: str, allowed: DataFrame | None = None) -> DataFrame:
    """QRY-8: the actionable rate of each gene; ``allowed`` (gene) restricts to a panel's own genes."""
    rows = then_now(spans, day)
    if allowed is not None:
        rows = rows.join(allowed, "gene", "left_semi")
    vus = F.col("bucket") == "UNCERTAIN"
    out = rows.groupBy("panel", "gene").agg(F.count_if(vus).alias("vus"), F.count_if(vus & F.col("now_bucket").isin(*ACTIONABLE)).alias("actionable"))
    out = out.withColumn("actionable_rate", ratio(F.col("actionable"), F.col("vus"))).withColumn("thin", F.col("vus") <= THIN)
    return out.orderBy("thin", F.desc("actionable_rate"), F.desc("vus"), "panel", "gene")


def panel_headline(spans: DataFrame, day: str) -> DataFrame:
    """QRY-9"""
    vus = F.col("bucket") == "UNCERTAIN"
    out = then_now(spans, day).groupBy("panel").agg(
        F.count_if(vus).alias("uncertain"), F.count_if(vus & F.col("now_bucket").isin(*TOWARD_PATHOGENIC)).alias("to_pathogenic"), F.count_if(vus & F.col("now_bucket").isin(*TOWARD_BENIGN)).alias("to_benign")
    )
    return out.withColumn("actionable_rate", ratio(F.col("to_pathogenic") + F.col("to_benign"), F.col("uncertain")))


def gene_headline(spans: DataFrame, gene: str, day: str, suspects: DataFrame | None = None) -> DataFrame:
    """QRY-11: seven conditional counts in one aggregate; one row for each panel that holds the gene."""
    own = _flagged(then_now(spans.where(F.col("gene") == gene.upper()), day), suspects)
    classified, vus, now = F.col("bucket") != ABSENT, F.col("bucket") == "UNCERTAIN", F.col("now_bucket")
    return own.groupBy("panel", "gene").agg(
        F.count_if(classified).alias("classified"), F.count_if(vus).alias("uncertain"), F.count_if(vus & now.isin(*TOWARD_PATHOGENIC)).alias("now_pathogenic"), F.count_if(vus & now.isin(*TOWARD_BENIGN)).alias("now_benign"),
        F.count_if(classified & (F.col("bucket") != now)).alias("moved"), F.count_if(classified & F.col("policy_suspect")).alias("policy_suspect"), F.count_if(classified & (now == ABSENT)).alias("retracted"),
    )


def search(q: str | None) -> Column:
    """FLT-6, FLT-7: digits are an id or the start of a position; other text is a part of a condition, its wildcards literal."""
    q = (q or "").strip()
    if not q:
        return F.lit(True)
    if q.isdigit():
        return (F.col("variation_id") == q) | F.col("pos").cast("string").startswith(q)
    return F.lower("condition").contains(q.lower())


def variants(spans: DataFrame, gene: str, day: str, suspects: DataFrame | None = None, only_moved: bool = False, q: str | None = None) -> DataFrame:
    """QRY-10 before paging: a gene's classified variants on a date, and where each is now."""
    rows = _flagged(then_now(spans.where(F.col("gene") == gene.upper()), day), suspects).where(F.col("bucket") != ABSENT).where(search(q))
    rows = rows.withColumn("moved", ~F.col("bucket").eqNullSafe(F.col("now_bucket")))
    rows = rows.where("moved") if only_moved else rows
    return rows.select(*KEY, "variation_id", "gene", "contig", "pos", "ref", "alt", "bucket", "stars", "clnsig_raw", "condition", "now_bucket", "now_stars", "changed_on", "moved", "policy_suspect")


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """SRT-1, SRT-2: moved first, suspect after genuine, then review status; ``total`` is the size of all rows.

    The total is an aggregate joined as a scalar, so no task sees all rows; an
    empty page still has its total in ``total_of``.
    """
    top = rows.orderBy(F.desc("moved"), "policy_suspect", F.desc("now_stars"), "pos", "allele_id").offset(offset).limit(limit)
    return top.withColumn("total", total_of(rows).scalar())


def total_of(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


__all__ = ["EVENT_KEY", "THIN", "gene_headline", "genes_ranked", "page", "panel_headline", "search", "then_now", "total_of", "variants"]
