"""A tenant's reported variants against the timeline (QRY-14, QRY-19, SRC-3).

Every read takes a tenant; ``reconciled`` is the only way to the case table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronospan.functions.alleles import ABSENT, ACTIONABLE, TOWARD_BENIGN, TOWARD_PATHOGENIC, allele_id, ratio, strict_date
from chronospan.operators.asof import as_of

# Buckets of the demonstration and how a report names them.
DEMO_LABELS = {"UNCERTAIN": "VUS", "LIKELY_PATHOGENIC": "Likely pathogenic", "PATHOGENIC": "Pathogenic"}
COLUMNS = ("case_ref", "contig", "pos", "ref", "alt", "reported_classification", "reported_on")


def of_tenant(cases: DataFrame, tenant: str) -> DataFrame:
    """FLT-10"""
    if not tenant:
        raise ValueError("a tenant is needed")
    return cases.where(F.col("tenant_id") == tenant)


def judged(raw: DataFrame, tenant: str, assembly: str = "GRCh38") -> DataFrame:
    """SRC-3: rows of text columns as cases, with pos_text, and the reason why a row is rejected, null if it isn't."""
    gene = F.col("gene") if "gene" in raw.columns else F.lit(None).cast("string")
    pos = F.when(F.trim("pos").rlike(r"^[+-]?[0-9]{1,18}$"), F.trim("pos").cast("long"))
    own = raw.select(F.lit(tenant).alias("tenant_id"), "case_ref", gene.alias("gene"), "contig", F.col("pos").alias("pos_text"), pos.alias("pos"), "ref", "alt", "reported_classification", strict_date(F.trim("reported_on")).alias("reported_on"))
    own = own.withColumn("allele_id", allele_id(assembly, F.col("contig"), F.col("pos"), F.trim("ref"), F.trim("alt")))
    reason = F.when(F.col("pos").isNull(), "position is no number").when(F.col("reported_on").isNull(), "date is not yyyy-mm-dd").when(F.col("allele_id").isNull(), "alleles are not sequences")
    return own.withColumn("reason", reason)


def load_csv(spark: SparkSession, path: str, tenant: str, assembly: str = "GRCh38") -> tuple[DataFrame, DataFrame]:
    """SRC-3: (good rows, rejected rows with a reason); the header must have all COLUMNS, gene is optional."""
    raw = spark.read.csv(path, header=True, multiLine=True, inferSchema=False)
    if missing := [c for c in COLUMNS if c not in raw.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    own = judged(raw, tenant, assembly)
    kept = ["tenant_id", "case_ref", "allele_id", "gene", "contig", "pos", "ref", "alt", "reported_classification", "reported_on"]
    return own.where("reason IS NULL").select(*kept), own.where("reason IS NOT NULL").select("case_ref", "pos_text", "reason")


def reconciled(cases: DataFrame, spans: DataFrame, tenant: str, suspects: DataFrame | None = None) -> DataFrame:
    """JOI-6, JOI-7, JOI-8, AGG-11: each row of the tenant with its one outcome.

    An allele unknown to the timeline is unmatched; one known but signed out
    before coverage is before_coverage; the others are examined.  ``spans`` are
    those of one panel, so a row meets at most one span of each kind.
    """
    own = of_tenant(cases, tenant)
    # an allele's history is as long as its panel has releases: one aggregate and one join serve both states
    span = F.struct("valid_from", "valid_to", "bucket", "stars", "clnsig_raw", "is_current")
    history = spans.groupBy("allele_id", F.col("panel").alias("now_panel")).agg(F.collect_list(span).alias("history"))
    pick = lambda test: F.get(F.filter("history", test), F.lit(0))
    rows = own.join(history, "allele_id", "left").withColumn("then", pick(lambda x: (x["valid_from"] <= F.col("reported_on")) & (x["valid_to"] > F.col("reported_on")))).withColumn("now", pick(lambda x: x["is_current"]))
    rows = rows.withColumns({"at_signout": F.col("then.bucket"), "now_bucket": F.col("now.bucket"), "now_stars": F.col("now.stars"), "now_clnsig": F.col("now.clnsig_raw"), "changed_on": F.col("now.valid_from")}).drop("history", "then", "now")
    known, to = F.col("now_bucket").isNotNull(), F.col("now_bucket")
    outcome = (
        F.when(~known, "unmatched").when(F.col("at_signout").isNull(), "before_coverage").when(F.col("at_signout") == to, "unchanged").when(to.isin(*TOWARD_PATHOGENIC), "moved_to_pathogenic")
        .when(to.isin(*TOWARD_BENIGN), "moved_to_benign").when(to == "CONFLICTING", "moved_to_conflicting").when(to == ABSENT, "retracted").otherwise("moved_elsewhere")
    )
    rows = rows.withColumn("known", known).withColumn("outcome", outcome)
    moved = ~F.col("outcome").isin("unmatched", "before_coverage", "unchanged")
    if suspects is None:
        return rows.withColumn("policy_suspect", F.lit(False)).drop("now_panel")
    keys = suspects.select(F.col("panel").alias("now_panel"), F.col("from_bucket").alias("at_signout"), F.col("to_bucket").alias("now_bucket"), "changed_on", F.lit(True).alias("hit"))
    flagged = rows.join(keys, ["now_panel", "at_signout", "now_bucket", "changed_on"], "left")
    return flagged.withColumn("policy_suspect", moved & F.coalesce("hit", F.lit(False))).drop("hit", "now_panel")


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tenant_id", "outcome").agg(F.count("*").alias("n"))


def report(rows: DataFrame, floor: float = 0.9) -> DataFrame:
    """The counters of a tenant: loaded = unmatched + before_coverage + examined."""
    is_ = lambda *o: F.count_if(F.col("outcome").isin(*o))
    out = rows.groupBy("tenant_id").agg(
        F.count("*").alias("loaded"), is_("unmatched").alias("unmatched"), is_("before_coverage").alias("before_coverage"), F.count_if(~F.col("outcome").isin("unmatched", "before_coverage")).alias("examined"),
        is_("unchanged").alias("unchanged"), is_("moved_to_pathogenic").alias("moved_to_pathogenic"), is_("moved_to_benign").alias("moved_to_benign"), is_("moved_to_conflicting").alias("moved_to_conflicting"),
        is_("retracted").alias("retracted"), F.count_if("policy_suspect").alias("policy_suspect"),
    )
    rate = ratio(F.col("examined"), F.col("loaded"))
    return out.withColumn("match_rate", rate).withColumn("sound", rate >= floor).withColumn("actionable_rate", ratio(F.col("moved_to_pathogenic") + F.col("moved_to_benign"), F.col("examined")))


def findings(rows: DataFrame) -> DataFrame:
    """SRT-5: rows whose state moved, the most consequential first."""
    moved = rows.where(~F.col("outcome").isin("unmatched", "before_coverage", "unchanged"))
    variant = F.concat(F.col("contig"), F.lit(":"), F.col("pos").cast("string"), F.col("ref"), F.lit(">"), F.col("alt"))
    out = moved.select(
        "case_ref", "gene", variant.alias("variant"), "allele_id", F.col("reported_classification").alias("reported_as"), "reported_on", F.col("at_signout").alias("evidence_at_signout"), F.col("now_bucket").alias("evidence_now"),
        F.col("now_stars").alias("review_status_now"), "changed_on", F.col("now_bucket").isin(*ACTIONABLE).alias("actionable"), "policy_suspect",
    )
    return out.orderBy(F.desc("actionable"), "policy_suspect", F.desc("review_status_now"), "case_ref", "allele_id")


def sample_cases(spans: DataFrame, on: str, n: int, seed: int) -> DataFrame:
    """SRT-6: n classified alleles of a date, by hash of identity and seed."""
    own = as_of(spans, on).where(F.col("bucket") != ABSENT)
    return own.orderBy(_order(seed), "allele_id").limit(n).select("allele_id", "gene", "contig", "pos", "ref", "alt", "bucket")


def _order(seed: int, salt: str = "") -> Column:
    return F.md5(F.concat("allele_id", F.lit(f"|{seed}{salt}")).cast("binary"))


def demo_cases(spans: DataFrame, releases: DataFrame, n: int, seed: int) -> DataFrame:
    """QRY-19: n demonstration cases from the alleles of one panel that are of DEMO_LABELS at its first release.

    Reports are dated at releases of the first half of coverage, spread by hash;
    about one in twenty lies three years before coverage.  The same seed gives the same cases.
    """
    dates = releases.agg(F.sort_array(F.collect_list("release_date")).alias("dates"))  # one panel's list
    own = spans.where(F.col("bucket").isin(*DEMO_LABELS)).join(F.broadcast(dates)).where((F.col("valid_from") <= F.col("dates")[0]) & (F.col("valid_to") > F.col("dates")[0]))
    picked = own.orderBy(_order(seed), "allele_id").limit(n)  # n rows: numbered in one task
    number = F.row_number().over(W.orderBy(_order(seed), "allele_id"))
    at = lambda salt: F.conv(F.left(_order(seed, salt), F.lit(8)), 16, 10).cast("long")
    usable = F.greatest(F.lit(1), F.floor(F.size("dates") / 2))
    day = F.when(at("|early") % 20 == 0, F.add_months(F.col("dates")[0], -36)).otherwise(F.get("dates", (at("|day") % usable).cast("int")))
    label = F.create_map(*[F.lit(x) for pair in DEMO_LABELS.items() for x in pair])
    return picked.select(
        F.concat(F.lit("CASE-"), F.lpad(number.cast("string"), 5, "0")).alias("case_ref"), "gene", "contig", "pos", "ref", "alt", F.try_element_at(label, "bucket").alias("reported_classification"), day.alias("reported_on"),
    )
