"""Every query over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospan.functions import alleles as A
from chronospan.functions.leftalign import STRETCH, left_aligned
from chronospan.operators import asof, cases, explore, ledger, movement, timeline
from chronospan.plans import analogue
from chronospan.session import shared_dir, tasks
from chronospan.sources import digests, indexed, releases, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BASELINE, NOW, AS_OF, THRESHOLD, GENE = "1997-01-01", "2001-01-01", "1997-01-01", 0.03, "NATION_3"


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL pieces

_PRIORITY = "CASE low " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in analogue.PRIORITY.items()) + " END"


def raw_sql(grain: str) -> str:
    return f"""
periods AS (
  SELECT o_custkey, CAST(date_trunc('{grain}', o_orderdate) AS DATE) AS release_date, count(*) AS n, min(o_orderpriority) AS low, max(o_orderpriority) AS high, max(o_orderkey) AS last_key
  FROM orders GROUP BY ALL),
raw AS (
  SELECT 'A' || o_custkey AS allele_id, CAST(o_custkey AS VARCHAR) AS variation_id, upper(n_name) AS gene, CAST(c_nationkey AS VARCHAR) AS contig, o_custkey * 1000 + last_key % 997 AS pos, 'C' AS ref, 'T' AS alt,
    CASE WHEN low <> high THEN 'CONFLICTING' ELSE {_PRIORITY} END AS bucket, CAST(least(n, 4) AS TINYINT) AS stars, low AS clnsig_raw, 'n=' || n AS clnrevstat_raw, c_name AS condition, r_name AS panel, release_date,
    'orders-' || strftime(release_date, '%Y%m%d') AS snapshot_id
  FROM periods JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


_DIM = "variation_id gene contig pos ref alt condition".split()
DIM_SQL = "dim AS (SELECT panel, allele_id, " + ", ".join(f"arg_max({c}, release_date) AS {c}" for c in _DIM) + " FROM raw GROUP BY ALL)"
RELEASES_SQL = "releases AS (SELECT DISTINCT panel, release_date FROM raw)"
DENSE_SQL = f"""{RELEASES_SQL},
dense AS (
  SELECT a.panel, a.allele_id, r.release_date, coalesce(o.bucket, 'ABSENT') AS bucket, CAST(coalesce(o.stars, -1) AS TINYINT) AS stars, o.clnsig_raw, o.clnrevstat_raw, o.snapshot_id
  FROM (SELECT DISTINCT panel, allele_id FROM raw) a JOIN releases r USING (panel) LEFT JOIN raw o USING (panel, allele_id, release_date))"""
SPANS_SQL = f"""{DIM_SQL}, {DENSE_SQL},
flagged AS (
  SELECT *, CASE WHEN lag(bucket) OVER w IS DISTINCT FROM bucket OR lag(stars) OVER w IS DISTINCT FROM stars THEN 1 ELSE 0 END AS change FROM dense WINDOW w AS (PARTITION BY panel, allele_id ORDER BY release_date)),
numbered AS (SELECT *, sum(change) OVER (PARTITION BY panel, allele_id ORDER BY release_date ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
islands AS (
  SELECT panel, allele_id, island, min(bucket) AS bucket, min(stars) AS stars, arg_min(clnsig_raw, release_date) FILTER (WHERE clnsig_raw IS NOT NULL) AS clnsig_raw,
    arg_min(clnrevstat_raw, release_date) FILTER (WHERE clnrevstat_raw IS NOT NULL) AS clnrevstat_raw, min(release_date) AS valid_from, max(release_date) AS last_seen, min(snapshot_id) AS first_snapshot_id
  FROM numbered GROUP BY ALL),
spans AS (
  SELECT i.panel, i.allele_id, {', '.join('d.' + c for c in _DIM)}, bucket, stars, clnsig_raw, clnrevstat_raw, valid_from, coalesce(lead(valid_from) OVER w, DATE '9999-12-31') AS valid_to, last_seen, first_snapshot_id, lead(valid_from) OVER w IS NULL AS is_current
  FROM islands i JOIN dim d USING (panel, allele_id) WINDOW w AS (PARTITION BY i.panel, i.allele_id ORDER BY valid_from))"""
STEPS_SQL = """
stepped AS (SELECT *, lag(bucket) OVER w AS prev, lag(release_date) OVER w AS prev_date FROM dense WINDOW w AS (PARTITION BY panel, allele_id ORDER BY release_date)),
moved AS (
  SELECT panel, prev_date AS from_date, release_date AS to_date, prev AS from_bucket, bucket AS to_bucket, count(*) AS count FROM stepped
  WHERE prev <> bucket AND prev <> 'ABSENT' AND bucket <> 'ABSENT' GROUP BY ALL),
corpus AS (SELECT panel, release_date AS from_date, count(*) AS corpus FROM dense WHERE bucket <> 'ABSENT' GROUP BY ALL),
steps AS (SELECT m.*, CAST(count AS DOUBLE) / corpus AS share FROM moved m JOIN corpus USING (panel, from_date))"""
YEAR = f"WITH {raw_sql('year')}, {SPANS_SQL}"
QUARTER = f"WITH {raw_sql('quarter')}, {SPANS_SQL}"
SUSPECTS = f", {STEPS_SQL}, suspects AS (SELECT DISTINCT panel, from_bucket, to_bucket, to_date AS changed_on FROM steps WHERE share >= {THRESHOLD})"


def _held(on: str) -> str:
    return f"valid_from <= DATE '{on}' AND valid_to > DATE '{on}'"


def _rate(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} ELSE 0.0 END"


# ---------------------------------------------------------------- Spark pieces


def raw_year(spark: SparkSession, d: str) -> DataFrame:
    return analogue.raw(spark, d, "year")


def year_spans(spark: SparkSession, d: str) -> DataFrame:
    return analogue.built(spark, d).spans


def year_releases(spark: SparkSession, d: str) -> DataFrame:
    return analogue.built(spark, d).releases


def year_suspects(spark: SparkSession, d: str) -> DataFrame:
    return movement.suspect_keys(movement.detected(analogue.built(spark, d).steps, THRESHOLD))


# ---------------------------------------------------------------- timeline


@query(f"WITH {raw_sql('year')} SELECT * FROM raw")
def raw_stack(spark, d):
    return raw_year(spark, d)


@query(f"WITH {raw_sql('year')}, {DIM_SQL} SELECT * FROM dim")
def allele_dim(spark, d):
    return timeline.allele_dim(raw_year(spark, d))


@query(f"WITH {raw_sql('year')}, {DENSE_SQL} SELECT * FROM dense")
def dense_grid(spark, d):
    return timeline.dense_grid(raw_year(spark, d))


@query(f"{YEAR} SELECT * FROM spans")
def spans_year(spark, d):
    return timeline.dense_spans(raw_year(spark, d))


@query(f"{QUARTER} SELECT * FROM spans")
def spans_quarter(spark, d):
    return timeline.sparse_spans(analogue.raw(spark, d, "quarter"))


@query(f"{YEAR} SELECT * FROM spans")
def spans_sparse_equiv(spark, d):
    return timeline.sparse_spans(raw_year(spark, d))


@query(f"{YEAR} SELECT * FROM spans")
def spans_stored(spark, d):
    """SNK-4: the built table."""
    return year_spans(spark, d)


@query(f"{YEAR} SELECT panel, allele_id, gene, bucket, stars, valid_from, valid_to FROM spans WHERE {_held('1998-06-30')}")
def state_on_date(spark, d):
    return asof.as_of(year_spans(spark, d), "1998-06-30").select("panel", "allele_id", "gene", "bucket", "stars", "valid_from", "valid_to")


@query(f"{YEAR} SELECT panel, allele_id, bucket FROM spans WHERE {_held('1990-01-01')}")
def state_before_coverage(spark, d):
    return asof.as_of(year_spans(spark, d), "1990-01-01").select("panel", "allele_id", "bucket")


@query(f"{YEAR} SELECT panel, allele_id, bucket, stars, clnsig_raw, valid_from, nullif(valid_to, DATE '9999-12-31') AS valid_to, is_current FROM spans WHERE allele_id = 'A7'")
def timeline_one_key(spark, d):
    return asof.history(year_spans(spark, d), "A7")


@query(f"{YEAR} SELECT panel, allele_id, bucket, stars, valid_from, clnsig_raw FROM spans WHERE is_current AND bucket <> 'ABSENT'")
def current_state(spark, d):
    return asof.current(year_spans(spark, d)).where(F.col("bucket") != A.ABSENT).select("panel", "allele_id", "bucket", "stars", "valid_from", "clnsig_raw")


@query(f"WITH {raw_sql('quarter')}, {RELEASES_SQL} SELECT * FROM releases")
def release_dates(spark, d):
    return timeline.releases(analogue.raw(spark, d, "quarter"))


@query(f"WITH {raw_sql('quarter')} SELECT panel, min(release_date) AS earliest, max(release_date) AS latest, count(DISTINCT release_date) AS n_releases, count(*) AS n_rows, count(DISTINCT allele_id) AS n_alleles FROM raw GROUP BY panel")
def coverage(spark, d):
    return timeline.coverage(analogue.raw(spark, d, "quarter"))


@query(f"{YEAR} SELECT panel, CAST(sum(k) AS BIGINT) AS spans, count(*) AS alleles, count(*) FILTER (WHERE k > 1) AS moved_alleles FROM (SELECT panel, allele_id, count(*) AS k FROM spans GROUP BY ALL) GROUP BY panel")
def span_stats(spark, d):
    return timeline.span_stats(year_spans(spark, d))


@query(f"{YEAR} SELECT a.panel, a.allele_id, a.valid_from, a.valid_to, b.valid_from AS next_from FROM spans a JOIN spans b USING (panel, allele_id) WHERE a.valid_from < b.valid_from AND a.valid_to > b.valid_from")
def overlap_check(spark, d):
    return timeline.overlaps(year_spans(spark, d))


@query(f"{YEAR} SELECT panel, min(valid_from) AS timeline_start FROM spans GROUP BY panel")
def timeline_start(spark, d):
    return asof.timeline_start(year_spans(spark, d))


# ---------------------------------------------------------------- movement and detection

_MOVES = f"""then_ AS (SELECT * FROM spans WHERE {_held(BASELINE)}), later AS (SELECT panel, allele_id, bucket AS to_bucket, stars AS to_stars, clnsig_raw AS to_clnsig, valid_from AS changed_on FROM spans WHERE {_held(NOW)}),
moves AS (
  SELECT panel, allele_id, gene, variation_id, bucket AS from_bucket, stars AS from_stars, to_bucket, to_stars, to_clnsig, changed_on FROM then_ JOIN later USING (panel, allele_id) WHERE bucket IS DISTINCT FROM to_bucket)"""


def _movement_sql(suspects: bool) -> str:
    return f"""{YEAR}{SUSPECTS if suspects else ''}, {_MOVES},
vus AS (SELECT m.*, {'s.panel IS NOT NULL' if suspects else 'false'} AS hit FROM moves m {'LEFT JOIN suspects s ON s.panel = m.panel AND s.from_bucket = m.from_bucket AND s.to_bucket = m.to_bucket AND s.changed_on = m.changed_on' if suspects else ''} WHERE m.from_bucket = 'UNCERTAIN'),
base AS (SELECT panel, count(*) FILTER (WHERE bucket <> 'ABSENT') AS total_tracked, count(*) FILTER (WHERE bucket = 'UNCERTAIN') AS vus_at_baseline FROM then_ GROUP BY panel),
n AS (
  SELECT panel, count(*) AS vus_moved, count(*) FILTER (WHERE to_bucket IN ('PATHOGENIC', 'LIKELY_PATHOGENIC')) AS moved_to_pathogenic, count(*) FILTER (WHERE to_bucket IN ('BENIGN', 'LIKELY_BENIGN')) AS moved_to_benign,
    count(*) FILTER (WHERE to_bucket = 'CONFLICTING') AS moved_to_conflicting, count(*) FILTER (WHERE to_bucket = 'ABSENT') AS retracted, count(*) FILTER (WHERE hit) AS policy_suspect FROM vus GROUP BY panel),
both_ AS (SELECT panel, total_tracked, vus_at_baseline, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('vus_moved', 'moved_to_pathogenic', 'moved_to_benign', 'moved_to_conflicting', 'retracted', 'policy_suspect'))} FROM base LEFT JOIN n USING (panel))
SELECT *, {_rate('vus_moved', 'vus_at_baseline')} AS movement_rate, {_rate('(vus_moved - policy_suspect)', 'vus_at_baseline')} AS movement_rate_adjusted, {_rate('(moved_to_pathogenic + moved_to_benign)', 'vus_at_baseline')} AS actionable_rate FROM both_"""


@query(_movement_sql(False))
def panel_movement(spark, d):
    return movement.panel_movement(year_spans(spark, d), BASELINE, NOW)


@query(_movement_sql(True))
def movement_adjusted(spark, d):
    return movement.panel_movement(year_spans(spark, d), BASELINE, NOW, year_suspects(spark, d))


@query(f"{YEAR}, {_MOVES} SELECT * FROM moves WHERE from_bucket = 'UNCERTAIN' ORDER BY to_stars DESC, gene, panel, allele_id LIMIT 50")
def movement_detail_topk(spark, d):
    return movement.movement_detail(year_spans(spark, d), BASELINE, NOW)


@query(f"{YEAR}{SUSPECTS}, {_MOVES} SELECT m.panel, allele_id, m.from_bucket, m.to_bucket, m.changed_on FROM moves m JOIN suspects s ON s.panel = m.panel AND s.from_bucket = m.from_bucket AND s.to_bucket = m.to_bucket AND s.changed_on = m.changed_on")
def movement_suspect(spark, d):
    rows = movement.moves(year_spans(spark, d), BASELINE, NOW)
    return rows.join(year_suspects(spark, d), list(movement.EVENT_KEY), "left_semi").select("panel", "allele_id", "from_bucket", "to_bucket", "changed_on")


_STEPS = f"WITH {raw_sql('year')}, {DENSE_SQL}, {STEPS_SQL}"


@query(f"{_STEPS} SELECT * FROM steps WHERE share >= {THRESHOLD}")
def policy_events(spark, d):
    return movement.detected(movement.step_series(timeline.dense_grid(raw_year(spark, d))), THRESHOLD)


@query(f"{_STEPS} SELECT * FROM steps WHERE share >= {THRESHOLD}")
def policy_events_from_spans(spark, d):
    return movement.detected(movement.step_series_from_spans(year_spans(spark, d), year_releases(spark, d)), THRESHOLD)


@query(f"{_STEPS} SELECT * FROM steps")
def step_series(spark, d):
    return analogue.built(spark, d).steps


# ---------------------------------------------------------------- exploration

_THEN_NOW = f"""now_ AS (SELECT panel, allele_id, bucket AS now_bucket, stars AS now_stars, valid_from AS changed_on FROM spans WHERE is_current),
both_ AS (SELECT t.*, now_bucket, now_stars, changed_on FROM spans t JOIN now_ USING (panel, allele_id) WHERE {_held(AS_OF)})"""
_ACT = "('PATHOGENIC', 'LIKELY_PATHOGENIC', 'BENIGN', 'LIKELY_BENIGN')"


@query(f"""{YEAR}, {_THEN_NOW}, g AS (
  SELECT panel, gene, count(*) FILTER (WHERE bucket = 'UNCERTAIN') AS vus, count(*) FILTER (WHERE bucket = 'UNCERTAIN' AND now_bucket IN {_ACT}) AS actionable FROM both_ GROUP BY ALL)
SELECT *, {_rate('actionable', 'vus')} AS actionable_rate, vus <= {explore.THIN} AS thin FROM g""")
def genes_ranked(spark, d):
    return explore.genes_ranked(year_spans(spark, d), AS_OF)


@query(f"""{YEAR}, {_THEN_NOW}, g AS (
  SELECT panel, count(*) FILTER (WHERE bucket = 'UNCERTAIN') AS uncertain, count(*) FILTER (WHERE bucket = 'UNCERTAIN' AND now_bucket IN ('PATHOGENIC', 'LIKELY_PATHOGENIC')) AS to_pathogenic,
    count(*) FILTER (WHERE bucket = 'UNCERTAIN' AND now_bucket IN ('BENIGN', 'LIKELY_BENIGN')) AS to_benign FROM both_ GROUP BY ALL)
SELECT *, {_rate('(to_pathogenic + to_benign)', 'uncertain')} AS actionable_rate FROM g""")
def panel_headline(spark, d):
    return explore.panel_headline(year_spans(spark, d), AS_OF)


_FLAGGED = f"""{YEAR}{SUSPECTS}, {_THEN_NOW},
flagged_ AS (SELECT b.*, s.panel IS NOT NULL AS policy_suspect, b.bucket IS DISTINCT FROM b.now_bucket AS moved FROM both_ b LEFT JOIN suspects s ON s.panel = b.panel AND s.from_bucket = b.bucket AND s.to_bucket = b.now_bucket AND s.changed_on = b.changed_on
  WHERE gene = '{GENE}')"""
_PAGE = "panel, allele_id, variation_id, gene, contig, pos, ref, alt, bucket, stars, clnsig_raw, condition, now_bucket, now_stars, changed_on, moved, policy_suspect"
_ORDER = "ORDER BY moved DESC, policy_suspect, now_stars DESC, pos, allele_id"


@query(f"""{_FLAGGED} SELECT panel, gene, count(*) FILTER (WHERE bucket <> 'ABSENT') AS classified, count(*) FILTER (WHERE bucket = 'UNCERTAIN') AS uncertain,
  count(*) FILTER (WHERE bucket = 'UNCERTAIN' AND now_bucket IN ('PATHOGENIC', 'LIKELY_PATHOGENIC')) AS now_pathogenic, count(*) FILTER (WHERE bucket = 'UNCERTAIN' AND now_bucket IN ('BENIGN', 'LIKELY_BENIGN')) AS now_benign,
  count(*) FILTER (WHERE bucket <> 'ABSENT' AND moved) AS moved, count(*) FILTER (WHERE bucket <> 'ABSENT' AND policy_suspect) AS policy_suspect, count(*) FILTER (WHERE bucket <> 'ABSENT' AND now_bucket = 'ABSENT') AS retracted
FROM flagged_ GROUP BY panel, gene""")
def gene_headline(spark, d):
    return explore.gene_headline(year_spans(spark, d), GENE, AS_OF, year_suspects(spark, d))


def _variants(spark, d, **kw) -> DataFrame:
    return explore.variants(year_spans(spark, d), GENE, AS_OF, year_suspects(spark, d), **kw)


@query(f"{_FLAGGED}, v AS (SELECT {_PAGE} FROM flagged_ WHERE bucket <> 'ABSENT') SELECT *, (SELECT count(*) FROM v) AS total FROM v {_ORDER} LIMIT 20 OFFSET 5")
def variants_page(spark, d):
    return explore.page(_variants(spark, d), 20, 5)


@query(f"{_FLAGGED} SELECT {_PAGE} FROM flagged_ WHERE bucket <> 'ABSENT' AND moved")
def variants_only_moved(spark, d):
    return _variants(spark, d, only_moved=True)


@query(f"{_FLAGGED} SELECT {_PAGE} FROM flagged_ WHERE bucket <> 'ABSENT' AND condition ILIKE '%#0000000%' ESCAPE '\\'")
def variants_text_search(spark, d):
    return _variants(spark, d, q="#0000000")


@query(f"{_FLAGGED} SELECT {_PAGE} FROM flagged_ WHERE bucket <> 'ABSENT' AND (variation_id = '10' OR CAST(pos AS VARCHAR) LIKE '10%')")
def variants_numeric_search(spark, d):
    return _variants(spark, d, q="10")


@query(f"{_FLAGGED} SELECT count(*) AS total FROM flagged_ WHERE bucket <> 'ABSENT'")
def variants_total_empty_page(spark, d):
    return explore.total_of(_variants(spark, d))


_COMPOSITION = f"""{YEAR}, c AS (
  SELECT r.panel, r.release_date, s.bucket, count(s.allele_id) AS n FROM releases r LEFT JOIN spans s ON s.panel = r.panel AND s.gene = '{GENE}' AND s.valid_from <= r.release_date AND s.valid_to > r.release_date AND s.bucket <> 'ABSENT' GROUP BY ALL)"""


@query(f"{_COMPOSITION} SELECT * FROM c")
def composition_long(spark, d):
    return asof.composition(year_spans(spark, d), year_releases(spark, d), GENE)


@query(f"{_COMPOSITION} SELECT * FROM c")
def composition_exploded(spark, d):
    return asof.composition_exploded(year_spans(spark, d), year_releases(spark, d), GENE)


_CONTEXT = f"""{YEAR}{SUSPECTS}, {_THEN_NOW}
SELECT panel, count(DISTINCT gene) AS genes, min(valid_from) AS floor, count(*) FILTER (WHERE is_current) AS alleles, (SELECT count(*) FROM suspects e WHERE e.panel = spans.panel) AS events, (SELECT count(*) FROM releases r WHERE r.panel = spans.panel) AS n_releases
FROM spans GROUP BY panel"""


@query(_CONTEXT)
def context_bundle(spark, d):
    """QRY-21"""
    own = year_spans(spark, d).groupBy("panel").agg(F.countDistinct("gene").alias("genes"), F.min("valid_from").alias("floor"), F.count_if("is_current").alias("alleles"))
    events = year_suspects(spark, d).groupBy("panel").agg(F.count("*").alias("events"))
    dates = year_releases(spark, d).groupBy("panel").agg(F.count("*").alias("n_releases"))
    return own.join(events, "panel", "left").join(dates, "panel").fillna(0, ["events"])


# ---------------------------------------------------------------- cases

TENANT = "BUILDING"
_CASES = f"""{YEAR}{SUSPECTS},
cases AS (
  SELECT c_mktsegment AS tenant_id, CAST(o_orderkey AS VARCHAR) AS case_ref, 'A' || CASE WHEN o_orderkey % 33 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS allele_id, o_orderkey AS pos, o_orderpriority AS reported_classification,
    CASE WHEN o_orderkey % 20 = 0 THEN DATE '1990-06-01' ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) END AS reported_on
  FROM orders JOIN customer ON c_custkey = o_custkey),
rows_ AS (
  SELECT c.*, t.bucket AS at_signout, n.bucket AS now_bucket, n.stars AS now_stars, n.valid_from AS changed_on, n.panel AS now_panel, n.allele_id IS NOT NULL AS known
  FROM cases c LEFT JOIN spans t ON t.allele_id = c.allele_id AND t.valid_from <= reported_on AND t.valid_to > reported_on LEFT JOIN spans n ON n.allele_id = c.allele_id AND n.is_current WHERE tenant_id = '{TENANT}'),
outcomes AS (
  SELECT r.*, CASE WHEN NOT known THEN 'unmatched' WHEN at_signout IS NULL THEN 'before_coverage' WHEN at_signout = now_bucket THEN 'unchanged' WHEN now_bucket IN ('PATHOGENIC', 'LIKELY_PATHOGENIC') THEN 'moved_to_pathogenic'
      WHEN now_bucket IN ('BENIGN', 'LIKELY_BENIGN') THEN 'moved_to_benign' WHEN now_bucket = 'CONFLICTING' THEN 'moved_to_conflicting' WHEN now_bucket = 'ABSENT' THEN 'retracted' ELSE 'moved_elsewhere' END AS outcome,
    s.panel IS NOT NULL AND known AND at_signout IS NOT NULL AND at_signout <> now_bucket AS policy_suspect
  FROM rows_ r LEFT JOIN suspects s ON s.panel = now_panel AND s.from_bucket = at_signout AND s.to_bucket = now_bucket AND s.changed_on = r.changed_on)"""


def _reconciled(spark, d) -> DataFrame:
    return cases.reconciled(analogue.cases(spark, d), year_spans(spark, d), TENANT, year_suspects(spark, d))


@query(f"{_CASES} SELECT tenant_id, case_ref, allele_id, reported_on, at_signout, now_bucket, now_stars, changed_on, known, outcome, policy_suspect FROM outcomes")
def case_reconcile_rows(spark, d):
    return _reconciled(spark, d).select("tenant_id", "case_ref", "allele_id", "reported_on", "at_signout", "now_bucket", "now_stars", "changed_on", "known", "outcome", "policy_suspect")


@query(f"{_CASES} SELECT tenant_id, outcome, count(*) AS n FROM outcomes GROUP BY ALL")
def case_outcome_counts(spark, d):
    return cases.outcome_counts(_reconciled(spark, d))


_OUT = lambda *o: f"count(*) FILTER (WHERE outcome IN ({', '.join(repr(x) for x in o)}))"


@query(f"""{_CASES}, r AS (
  SELECT tenant_id, count(*) AS loaded, {_OUT('unmatched')} AS unmatched, {_OUT('before_coverage')} AS before_coverage, count(*) FILTER (WHERE outcome NOT IN ('unmatched', 'before_coverage')) AS examined, {_OUT('unchanged')} AS unchanged,
    {_OUT('moved_to_pathogenic')} AS moved_to_pathogenic, {_OUT('moved_to_benign')} AS moved_to_benign, {_OUT('moved_to_conflicting')} AS moved_to_conflicting, {_OUT('retracted')} AS retracted, count(*) FILTER (WHERE policy_suspect) AS policy_suspect
  FROM outcomes GROUP BY tenant_id)
SELECT *, {_rate('examined', 'loaded')} AS match_rate, {_rate('examined', 'loaded')} >= 0.9 AS sound, {_rate('(moved_to_pathogenic + moved_to_benign)', 'examined')} AS actionable_rate FROM r""")
def case_match_rate(spark, d):
    return cases.report(_reconciled(spark, d))


@query(f"""{_CASES} SELECT case_ref, CAST(NULL AS VARCHAR) AS gene, '1:' || pos || 'C>T' AS variant, allele_id, reported_classification AS reported_as, reported_on, at_signout AS evidence_at_signout, now_bucket AS evidence_now, now_stars AS review_status_now,
  changed_on, now_bucket IN {_ACT} AS actionable, policy_suspect FROM outcomes WHERE outcome NOT IN ('unmatched', 'before_coverage', 'unchanged')""")
def case_findings(spark, d):
    return cases.findings(_reconciled(spark, d))


@query(f"{_CASES} SELECT c.case_ref, EXISTS (SELECT 1 FROM spans e WHERE e.allele_id = c.allele_id) AS known FROM cases c WHERE tenant_id = '{TENANT}'")
def case_exists_flag(spark, d):
    """JOI-8: the flag as a semi-join in a projection."""
    own = cases.of_tenant(analogue.cases(spark, d), TENANT)
    known = asof.current(year_spans(spark, d)).select("allele_id").distinct().withColumn("known", F.lit(True))
    return own.join(known, "allele_id", "left").select("case_ref", F.coalesce("known", F.lit(False)).alias("known"))


@query("""SELECT c_mktsegment AS tenant_id, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL
UNION ALL SELECT c_mktsegment, count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY' GROUP BY ALL""")
def tenant_isolation_counts(spark, d):
    own = analogue.cases(spark, d)
    return cases.of_tenant(own, "BUILDING").unionByName(cases.of_tenant(own, "MACHINERY")).groupBy("tenant_id").agg(F.count("*").alias("n"))


@query(f"{YEAR} SELECT allele_id, gene, contig, pos, ref, alt, bucket FROM spans WHERE {_held('1998-01-01')} AND bucket <> 'ABSENT' ORDER BY md5(allele_id || '|7'), allele_id LIMIT 40")
def case_sample(spark, d):
    """SRT-6: the sample is the feature."""
    return cases.sample_cases(year_spans(spark, d), "1998-01-01", 40, 7)


PANEL = "ASIA"
_HASH = lambda salt: f"CAST('0x' || substr(md5(allele_id || '|7{salt}'), 1, 8) AS BIGINT)"


@query(f"""{YEAR}, dates AS (SELECT list(release_date ORDER BY release_date) AS dates FROM releases WHERE panel = '{PANEL}'),
own AS (SELECT * FROM spans, dates WHERE panel = '{PANEL}' AND bucket IN ('UNCERTAIN', 'LIKELY_PATHOGENIC', 'PATHOGENIC') AND valid_from <= dates[1] AND valid_to > dates[1] ORDER BY md5(allele_id || '|7'), allele_id LIMIT 60)
SELECT 'CASE-' || lpad(CAST(row_number() OVER (ORDER BY md5(allele_id || '|7'), allele_id) AS VARCHAR), 5, '0') AS case_ref, gene, contig, pos, ref, alt,
  CASE bucket WHEN 'UNCERTAIN' THEN 'VUS' WHEN 'LIKELY_PATHOGENIC' THEN 'Likely pathogenic' ELSE 'Pathogenic' END AS reported_classification,
  CASE WHEN {_HASH('|early')} % 20 = 0 THEN CAST(dates[1] - INTERVAL 36 MONTH AS DATE) ELSE dates[1 + CAST({_HASH('|day')} % greatest(1, len(dates) // 2) AS INTEGER)] END AS reported_on FROM own""")
def case_demo(spark, d):
    """QRY-19: the sample is the feature."""
    made, of_panel = analogue.built(spark, d), F.col("panel") == PANEL
    return cases.demo_cases(made.spans.where(of_panel), made.releases.where(of_panel), 60, 7)


# ---------------------------------------------------------------- loading

@query(f"""SELECT event_id, CASE WHEN regexp_matches(pos_text, '^[+-]?[0-9]{{1,18}}$') THEN CAST(pos_text AS BIGINT) END AS pos, CASE WHEN regexp_matches(day_text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN CAST(day_text AS DATE) END AS day,
  NOT regexp_matches(pos_text, '^[+-]?[0-9]{{1,18}}$') OR NOT regexp_matches(day_text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AS rejected FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'x' || event_id ELSE CAST(event_id AS VARCHAR) END AS pos_text,
  CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y%m%d') ELSE strftime(ts, '%Y-%m-%d') END AS day_text FROM events)""")
def csv_rejects(spark, d):
    """SRC-3: the loader's verdict on each row, from made-up text fields."""
    e = analogue.table(spark, d, "events")
    key, day = F.col("event_id"), F.col("ts").cast("date")
    pos = F.when(key % 7 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string"))
    when = F.when(key % 5 == 0, F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    fixed = [F.lit(v).alias(c) for c, v in (("contig", "17"), ("ref", "C"), ("alt", "T"), ("reported_classification", "VUS"))]
    out = cases.judged(e.select(key.cast("string").alias("case_ref"), pos.alias("pos"), when.alias("reported_on"), *fixed), "tenant")
    return out.select(F.col("case_ref").cast("long").alias("event_id"), "pos", F.col("reported_on").alias("day"), F.col("reason").isNotNull().alias("rejected"))


@query("""SELECT c_mktsegment AS tenant_id, count(*) AS n, min(o_orderkey) AS first FROM orders JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR c_mktsegment = 'BUILDING' AND o_orderkey % 2 = 0 GROUP BY ALL""")
def tenant_replace(spark, d):
    """SNK-7: one tenant's rows replaced, another's load empty, the others as they were."""
    root = f"{shared_dir(spark)}/tenants-{uuid.uuid4().hex}"
    own = analogue.cases(spark, d).select("tenant_id", F.col("case_ref").cast("long").alias("key"))
    own.write.partitionBy("tenant_id").parquet(root)
    snapshots.replace_tenant(own.where("tenant_id = 'BUILDING' AND key % 2 = 0"), root, "BUILDING")
    snapshots.replace_tenant(own.where("false"), root, "MACHINERY")
    return spark.read.schema("key long, tenant_id string").parquet(root).groupBy("tenant_id").agg(F.count("*").alias("n"), F.min("key").alias("first"))


@query("""SELECT CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 3 = 0 THEN 'altered' ELSE 'intact' END AS state, p_size > 10 AND p_partkey % 4 <> 0 AS reproducible, count(*) AS n FROM part GROUP BY ALL""")
def provenance_states(spark, d):
    """QRY-18, SCL-15: manifests against the digests that are found, of contents cut into leaves of eight bytes."""
    k, name = F.col("p_partkey"), F.col("p_name").cast("binary")
    own = analogue.table(spark, d, "part")
    sha = F.when(F.col("p_size") > 10, F.when(k % 4 == 0, "abc-dirty").otherwise("abc"))

    def hashed(rows: DataFrame) -> DataFrame:
        leaves = rows.select("path", F.explode(digests.leaf_sums(F.col("content"), 8)).alias("x")).select("path", "x.*")
        return digests.of_leaves(leaves).groupBy(F.col("path").alias("snapshot_id")).agg(digests.combined("digest").alias("found"))

    manifests = own.select(k.alias("snapshot_id"), sha.alias("pipeline_git_sha")).join(hashed(own.select(k.alias("path"), name.alias("content"))).withColumnRenamed("found", "parquet_sha256"), "snapshot_id")
    there = own.where("p_partkey % 5 <> 0")
    found = hashed(there.select(k.alias("path"), F.when(k % 3 == 0, F.concat(name, F.lit(b"x"))).otherwise(name).alias("content")))
    return snapshots.provenance_of(manifests, found)


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def dedupe_last_wins(spark, d):
    return snapshots.last_wins(analogue.table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT l_partkey AS snapshot_id, count(*) AS offered FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY ALL")
def manifest_first_wins(spark, d):
    """SNK-3: keys to append, none of those that are there."""
    old = analogue.table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("snapshot_id"))
    new = analogue.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("snapshot_id")).agg(F.count("*").alias("offered"))
    return snapshots.first_writer_wins(old, new)


@query("""WITH r AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS release_date FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY year(release_date) ORDER BY release_date) - 1 AS k, count(*) OVER (PARTITION BY year(release_date)) AS n FROM r)
SELECT release_date FROM k WHERE n <= 12 OR k IN (SELECT i * n // 12 FROM range(12) t(i))""")
def systematic_sample(spark, d):
    own = analogue.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("release_date")).distinct()
    return releases.systematic_sample(own, 12)


@query("SELECT p_partkey, md5(p_name || '|7') AS h FROM part ORDER BY h, p_partkey LIMIT 50")
def hash_sample(spark, d):
    """SRT-6: a sample by hash, the same each time."""
    own = analogue.table(spark, d, "part").select("p_partkey", F.md5(F.concat(F.col("p_name"), F.lit("|7")).cast("binary")).alias("h"))
    return own.orderBy("h", "p_partkey").limit(50)


# ---------------------------------------------------------------- scalars

_TERMS = list(A.SIGNIFICANCE)
_REVIEWS = [*A.STARS, "no_assertion_provided", "something else"]


def _pick(values: list[str], i) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def _sql_pick(values: list[str], i: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST(({i}) % {len(values)} AS INTEGER) + 1]"


_RANKED = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.SIGNIFICANCE.items()) + " END"
_SIG_SQL = f"{_sql_pick(_TERMS, 'p_partkey')} || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '|' || upper({_sql_pick(_TERMS, 'p_partkey * 7 + 3')}) ELSE ', ' || {_sql_pick(_TERMS, 'p_partkey * 5 + 1')} || '|drug_response' END"


@query(f"""WITH s AS (SELECT p_partkey, {_SIG_SQL} AS sig FROM part),
t AS (SELECT p_partkey, sig, i, lower(trim(regexp_split_to_array(sig, '[|,]')[i])) AS t FROM s, LATERAL (SELECT unnest(range(1, len(regexp_split_to_array(sig, '[|,]')) + 1)) AS i)),
b AS (SELECT *, {_RANKED} AS b FROM t),
w AS (SELECT *, CASE WHEN b IN ('PATHOGENIC', 'BENIGN') THEN 2 WHEN b IN ('LIKELY_PATHOGENIC', 'LIKELY_BENIGN') THEN 1 WHEN b = 'UNCERTAIN' THEN 0 END AS w FROM b)
SELECT p_partkey, sig, coalesce(arg_max(b, w * 100 - i) FILTER (WHERE w IS NOT NULL), max(b) FILTER (WHERE b = 'CONFLICTING'), 'OTHER') AS bucket FROM w GROUP BY ALL""")
def scalar_bucket(spark, d):
    k = F.col("p_partkey")
    more = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("|"), F.upper(_pick(_TERMS, k * 7 + 3)))).otherwise(F.concat(F.lit(", "), _pick(_TERMS, k * 5 + 1), F.lit("|drug_response")))
    return analogue.table(spark, d, "part").select("p_partkey", F.concat(_pick(_TERMS, k), more).alias("sig")).withColumn("bucket", A.bucket(F.col("sig")))


@query(f"SELECT p_partkey, s, CAST(CASE lower(trim(s)) {' '.join(f'WHEN {k!r} THEN {v}' for k, v in A.STARS.items())} ELSE 0 END AS TINYINT) AS stars FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper({_sql_pick(_REVIEWS, 'p_partkey')}) || ' ' ELSE {_sql_pick(_REVIEWS, 'p_partkey')} END AS s FROM part)")
def scalar_stars(spark, d):
    k = F.col("p_partkey")
    s = F.when(k % 2 == 0, F.concat(F.upper(_pick(_REVIEWS, k)), F.lit(" "))).otherwise(_pick(_REVIEWS, k))
    return analogue.table(spark, d, "part").select("p_partkey", s.alias("s")).withColumn("stars", A.stars(F.col("s")))


_CONTIGS = ["chr1", " 17", "CHRx", "chrM", "mt", "M", "Chr22 ", "y"]


@query(f"SELECT p_partkey, CASE WHEN c IN ('M', 'MT') THEN 'MT' ELSE c END AS contig FROM (SELECT p_partkey, upper(regexp_replace(trim({_sql_pick(_CONTIGS, 'p_partkey')}), '(?i)^chr', '')) AS c FROM part)")
def scalar_contig(spark, d):
    return analogue.table(spark, d, "part").select("p_partkey", A.contig(_pick(_CONTIGS, F.col("p_partkey"))).alias("contig"))


_BASES = "translate(substr(md5(CAST({x} AS VARCHAR)), 1, {n}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _bases(x, n) -> F.Column:
    return F.translate(F.substring(F.md5(x.cast("string").cast("binary")), F.lit(1), n.cast("int")), "0123456789abcdef", "ACGTACGTACGTACGT")


#: Alleles that a task gets, about.
TASK_ALLELES = 100_000


def _alleles(spark, d) -> DataFrame:
    """Pairs with shared ends: a common head and tail around different middles."""
    k = F.col("p_partkey")
    head, tail = _bases(k, k % 4), _bases(k + 1, k % 3)
    ref, alt = F.concat(head, _bases(k + 2, k % 5), tail), F.concat(head, _bases(k + 3, k % 4 + 1), tail)
    keys = analogue.table(spark, d, "part").select("p_partkey")
    # a file that Spark reads in one task has rows for many
    own = keys.repartition(tasks(spark, keys.count(), TASK_ALLELES), "p_partkey").select("p_partkey", ref.alias("ref"), alt.alias("alt"))
    return own.where("length(ref) > 0")


_ALLELES = (
    "alleles AS (SELECT * FROM (SELECT p_partkey, " + " || ".join((_BASES.format(x="p_partkey", n="p_partkey % 4"), _BASES.format(x="p_partkey + 2", n="p_partkey % 5"), _BASES.format(x="p_partkey + 1", n="p_partkey % 3"))) + " AS ref, "
    + " || ".join((_BASES.format(x="p_partkey", n="p_partkey % 4"), _BASES.format(x="p_partkey + 3", n="p_partkey % 4 + 1"), _BASES.format(x="p_partkey + 1", n="p_partkey % 3"))) + " AS alt FROM part) WHERE length(ref) > 0)"
)


@query(f"""WITH {_ALLELES},
s AS (SELECT *, (SELECT count(*) FROM range(1, 20) t(i) WHERE i < least(length(ref), length(alt)) AND right(ref, i) = right(alt, i)) AS tail FROM alleles),
c AS (SELECT p_partkey, left(ref, length(ref) - tail) AS ref, left(alt, length(alt) - tail) AS alt FROM s),
h AS (SELECT *, (SELECT count(*) FROM range(1, 20) t(i) WHERE i < least(length(ref), length(alt)) AND left(ref, i) = left(alt, i)) AS head FROM c)
SELECT p_partkey, 1000 + head AS pos, substr(ref, head + 1) AS ref, substr(alt, head + 1) AS alt FROM h""")
def scalar_trim(spark, d):
    own = _alleles(spark, d).withColumn("t", A.trimmed(F.lit(1000).cast("long"), F.col("ref"), F.col("alt")))
    return own.select("p_partkey", F.col("t.pos").alias("pos"), F.col("t.ref").alias("ref"), F.col("t.alt").alias("alt"))


@query("""SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who, '' AS flag, 'last' AS twice, 4 AS n FROM events""")
def scalar_info_map(spark, d):
    e = analogue.table(spark, d, "events")
    info = F.concat(F.lit("KIND="), F.col("event_type"), F.lit(";FLAG;TWICE=first;;WHO="), F.col("user_id").cast("string"), F.lit(";TWICE=last;"))
    own = e.select("event_id", A.info_map(info).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    return own.select("event_id", at("KIND").alias("kind"), at("WHO").alias("who"), at("FLAG").alias("flag"), at("TWICE").alias("twice"), F.size("m").alias("n"))


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS variation_id, '17' AS contig, p_partkey * 10 AS pos, 'A' AS ref, 'G' AS alt, p_brand AS gene, 'BENIGN' AS bucket, CAST(3 AS TINYINT) AS stars, replace(left(replace(p_name, '_', ' '), 300), '|', '; ') AS condition
FROM part WHERE p_partkey % 6 = 0""")
def vcf_line_parse(spark, d):
    """SRC-4: text lines of which one in six is a usable record."""
    k = F.col("p_partkey")
    alt = _pick(["G", "G,T", "<DEL>", ".", "G", "G"], k)
    pos = F.when(k % 6 == 4, F.lit("x")).otherwise((k * 10).cast("string"))
    end = F.when(k % 6 == 5, F.lit("")).otherwise(F.concat(F.lit("\t.\t.\tGENEINFO="), F.col("p_brand"), F.lit(":12|OTHER:3;CLNSIG=Benign;CLNREVSTAT=reviewed_by_expert_panel;CLNDN="), F.col("p_name")))
    line = F.concat(F.lit("17\t"), pos, F.lit("\t"), k.cast("string"), F.lit("\tA\t"), alt, end)
    own = A.vcf_records(analogue.table(spark, d, "part").select(line.alias("value")))
    return own.select("variation_id", "contig", "pos", "ref", "alt", "gene", "bucket", "stars", "condition")


@query("""SELECT page_id, DATE '2019-01-02' + CAST(page_id % 400 AS INTEGER) AS release_date FROM pages UNION ALL SELECT page_id, DATE '2024-02-29' FROM pages WHERE page_id % 2 = 0""")
def listing_extract(spark, d):
    """SRC-15: names in a listing; index files, repeats and other names don't count."""
    k = F.col("page_id")
    name = lambda day, end: F.concat(F.lit(' <a href="clinvar_'), F.date_format(day, "yyyyMMdd"), F.lit(f'{end}">x</a>'))
    day = F.date_add(F.lit("2019-01-02").cast("date"), (k % 400).cast("int"))
    leap = F.lit("2024-02-29").cast("date")
    more = F.when(k % 2 == 0, F.concat(name(leap, ".vcf.gz"), name(leap, ".vcf.gz"))).otherwise(name(leap, ".vcf.gz.tbi"))
    own = analogue.table(spark, d, "pages").select("page_id", F.concat(name(day, ".vcf.gz"), name(day, ".vcf.gz.tbi"), name(leap, "_papu.vcf.gz"), more).alias("html"))
    return own.select("page_id", F.explode(releases.listed_dates(F.col("html"))).alias("release_date"))


@query(r"""SELECT doc_id, replace(replace(replace(text || '100%_\', '\', '\\'), '%', '\%'), '_', '\_') AS escaped FROM documents""")
def like_escape(spark, d):
    own = analogue.table(spark, d, "documents")
    return own.select("doc_id", A.like_escaped(F.concat("text", F.lit("100%_\\"))).alias("escaped"))


@query()
def digest_sha512t24u(spark, d):
    return analogue.table(spark, d, "part").select("p_partkey", A.sha512t24u(F.col("p_name").cast("binary")).alias("digest"))


@query()
def allele_identity(spark, d):
    return _alleles(spark, d).select("p_partkey", A.allele_id("GRCh38", F.lit("chr17"), F.lit(1000).cast("long"), F.col("ref"), F.col("alt")).alias("allele_id"))


_STRETCH = "G" + "TTTTTC" * 30 + "A"


@query(f"""WITH RECURSIVE {_ALLELES},
s AS (SELECT *, (SELECT count(*) FROM range(1, 20) t(i) WHERE i <= least(length(ref), length(alt)) AND right(ref, i) = right(alt, i)) AS tail FROM alleles WHERE length(ref) <> length(alt)),
c AS (SELECT p_partkey, left(ref, length(ref) - tail) AS ref, left(alt, length(alt) - tail) AS alt FROM s),
h AS (SELECT *, (SELECT count(*) FROM range(1, 20) t(i) WHERE i <= least(length(ref), length(alt)) AND left(ref, i) = left(alt, i)) AS head FROM c),
m AS (
  SELECT p_partkey, 160 + head AS pos, substr(ref, head + 1) AS r, substr(alt, head + 1) AS a, substr(ref, head + 1) || substr(alt, head + 1) AS unit, 0 AS k FROM h UNION ALL
  SELECT p_partkey, pos - 1, r, a, right(unit, 1) || left(unit, length(unit) - 1), k + 1 FROM m WHERE (r = '' OR a = '') AND k < 500 AND pos > 100 AND substr('{_STRETCH}', CAST(pos - 100 AS BIGINT), 1) = right(unit, 1)),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k DESC) = 1),
p AS (SELECT *, substr('{_STRETCH}', CAST(pos - 100 AS BIGINT), 1) AS pad FROM l)
SELECT p_partkey, 160 AS pos, upper(ref) AS ref, upper(alt) AS alt, true AS covered FROM alleles WHERE length(ref) = length(alt) UNION ALL
SELECT p_partkey, CASE WHEN r <> '' AND a <> '' THEN pos ELSE pos - 1 END, CASE WHEN r = '' THEN pad WHEN a = '' THEN pad || unit ELSE r END, CASE WHEN r = '' THEN pad || unit WHEN a = '' THEN pad ELSE a END, true FROM p""")
def left_align(spark, d):
    """SCL-9 against a repeat; the reference is a fixed stretch."""
    own = _alleles(spark, d).select("p_partkey", F.lit("17").alias("contig"), F.lit(160).cast("long").alias("pos"), "ref", "alt")
    reference = spark.createDataFrame([("17", 100, _STRETCH)], STRETCH)
    return left_aligned(own, reference).select("p_partkey", "aligned.*")


#: A part's stretch of its brand's reference, and its indel: a unit more or less, somewhere in the stretch.
_UNITS = ["A", "AC", "ACG", "AC"]


@query(f"""WITH RECURSIVE x AS (
  SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, {_sql_pick(_UNITS, 'p_size // 13 % 4')} AS u FROM part),
whole AS (SELECT p_brand, string_agg(left(repeat(u, 24), 24), '' ORDER BY i) AS bases FROM x GROUP BY p_brand),
m AS (
  SELECT p_partkey, bases, 1 + 24 * i + p_partkey % 24 + 1 AS pos, CASE p_partkey % 2 WHEN 0 THEN '' ELSE u END AS r, CASE p_partkey % 2 WHEN 0 THEN u ELSE '' END AS a, 0 AS k FROM x JOIN whole USING (p_brand) UNION ALL
  SELECT p_partkey, bases, pos - 1, right(r, 1) || left(r, greatest(length(r) - 1, 0)), right(a, 1) || left(a, greatest(length(a) - 1, 0)), k + 1 FROM m WHERE k < 500 AND pos > 1 AND substr(bases, pos - 1, 1) = right(r || a, 1)),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k DESC) = 1),
p AS (SELECT *, CASE WHEN pos > 1 THEN substr(bases, pos - 1, 1) ELSE '' END AS pad FROM l)
SELECT p_partkey, pos - length(pad) AS pos, pad || r AS ref, pad || a AS alt, true AS covered FROM p""")
def left_align_tiled(spark, d):
    """SCL-9, SRC-19: every part's indel against its brand's reference, which adjoining stretches of all its parts make up, in short tiles."""
    from pyspark.sql import Window as W

    parts = analogue.table(spark, d, "part")
    i = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1
    own = parts.select("p_partkey", "p_brand", i.alias("i"), _pick(_UNITS, F.floor(F.col("p_size") / 13) % 4).alias("u"))
    reference = own.select(F.col("p_brand").alias("contig"), (1 + 24 * F.col("i")).cast("long").alias("start"), F.left(F.repeat("u", 24), F.lit(24)).alias("bases"))
    pad, more = F.lit("T"), F.col("p_partkey") % 2 == 0
    cases_ = own.select("p_partkey", F.col("p_brand").alias("contig"), (1 + 24 * F.col("i") + F.col("p_partkey") % 24).cast("long").alias("pos"), F.when(more, pad).otherwise(F.concat(pad, "u")).alias("ref"), F.when(more, F.concat(pad, "u")).otherwise(pad).alias("alt"))
    return left_aligned(cases_, reference, size=256).select("p_partkey", "aligned.*")


# ---------------------------------------------------------------- ledger and tenants

@query("""WITH own AS (SELECT conv_id, turn, sha256(role || chr(10) || coalesce(text, '')) AS h FROM conversations),
l AS (SELECT conv_id, turn, h AS entry_hash, CASE WHEN conv_id % 4 = 1 AND turn = 2 THEN 'forged' ELSE coalesce(lag(h) OVER (PARTITION BY conv_id ORDER BY turn), repeat('0', 64)) END AS prev_hash FROM own),
kept AS (SELECT * FROM l WHERE NOT (conv_id % 4 = 2 AND turn = 1)),
c AS (SELECT *, coalesce(lag(entry_hash) OVER (PARTITION BY conv_id ORDER BY turn), repeat('0', 64)) AS expected FROM kept)
SELECT CAST(conv_id AS VARCHAR) AS tenant_id, min(turn) FILTER (WHERE prev_hash <> expected) AS first_bad_seq, min(turn) FILTER (WHERE prev_hash <> expected) IS NULL AS intact FROM c GROUP BY conv_id""")
def hash_chain_verify(spark, d):
    """QRY-15: chains of conversations, some forged, some with an entry taken out."""
    from pyspark.sql import Window as W

    h = F.sha2(F.concat(F.col("role"), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary"), 256)
    w = W.partitionBy("conv_id").orderBy("turn")
    own = analogue.table(spark, d, "conversations").select("conv_id", "turn", h.alias("entry_hash"))
    prev = F.when((F.col("conv_id") % 4 == 1) & (F.col("turn") == 2), "forged").otherwise(F.coalesce(F.lag("entry_hash").over(w), F.lit(ledger.GENESIS)))
    rows = own.withColumn("prev_hash", prev).where(~((F.col("conv_id") % 4 == 2) & (F.col("turn") == 1)))
    return ledger.verify(rows.select(F.col("conv_id").cast("string").alias("tenant_id"), F.col("turn").alias("seq"), "prev_hash", "entry_hash"), hashed=F.col("entry_hash"))


@query(r"""SELECT conv_id, turn, sha256(sha256(coalesce(text, '')) || chr(10) || '{"allele_id":"A' || turn || '","case_ref":null,"created_at":"2024-01-01","evidence_snapshot_id":"s","rationale":"' || role || ' \"so\" \\","reviewer":"' || role
|| '","seq":' || turn || ',"tenant_id":"t' || conv_id || '","verdict":"ACT"}') AS entry_hash FROM conversations""")
def ledger_hashes(spark, d):
    """SCL-14: hashes of canonical entries; how beyond ASCII is escaped is tested against Python's json."""
    own = analogue.table(spark, d, "conversations")
    fixed = {"case_ref": F.lit(None).cast("string"), "verdict": F.lit("ACT"), "evidence_snapshot_id": F.lit("s"), "created_at": F.lit("2024-01-01")}
    rows = own.select(
        "conv_id", "turn", F.col("turn").alias("seq"), F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("tenant_id"), F.concat(F.lit("A"), F.col("turn").cast("string")).alias("allele_id"),
        F.concat("role", F.lit(' "so" \\')).alias("rationale"), F.col("role").alias("reviewer"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("prev_hash"), *(v.alias(k) for k, v in fixed.items()),
    )
    return rows.select("conv_id", "turn", ledger.entry_hash_column().alias("entry_hash"))


@query("""SELECT c_mktsegment AS tenant_id, count(*) FILTER (WHERE o_orderstatus IS NULL OR o_orderstatus <> 'F') AS active, count(*) FILTER (WHERE o_orderstatus = 'F') AS revoked FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NOT NULL GROUP BY ALL""")
def tenant_token_counts(spark, d):
    """QRY-20: orders as tokens, those of status F revoked."""
    who = analogue.table(spark, d, "customer")
    tenants = who.select(F.col("c_mktsegment").alias("tenant_id")).distinct()
    revoked = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    tokens = analogue.table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("tenant_id"), revoked.alias("revoked_at"))
    return ledger.token_counts(tenants, tokens)


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(coalesce(text, ''), turn) AS text FROM conversations GROUP BY conv_id")
def latest_per_key(spark, d):
    own = analogue.table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return ledger.latest(own, "conv_id", "turn")


# ---------------------------------------------------------------- index planning

#: Bits of a position below a bin, and the number of the first bin, of each level.
_LEVELS = [(bits, (8**k - 1) // 7) for k, bits in enumerate(indexed.LEVEL_BITS, 1)]


@query("SELECT l_orderkey, l_linenumber, bin FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey * 100000 AS b, l_partkey * 100000 + l_suppkey * 500 AS e FROM lineitem), LATERAL (SELECT 0 AS bin UNION ALL "
       + " UNION ALL ".join(f"SELECT unnest(range({first} + (b >> {s}), {first} + ((e - 1) >> {s}) + 1))" for s, first in _LEVELS) + ") WHERE e > b")
def region_bins(spark, d):
    """SRC-9: the bins of each region; the exchange by place serves the distinct too."""
    own = analogue.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 100000).alias("b"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 500).alias("e")).where("e > b")
    own = indexed.by_place(own, "b", "e", "l_orderkey", "l_linenumber").distinct().sortWithinPartitions("b", "e")
    return own.select("l_orderkey", "l_linenumber", F.explode(indexed.bins_column(F.col("b"), F.col("e"))).alias("bin"))


@query("""WITH r AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 7200 AS e FROM events),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS first FROM r),
g AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT user_id, min(s) AS range_start, max(e) AS range_end, count(*) AS parts FROM g GROUP BY user_id, g""")
def range_merge_islands(spark, d):
    """SRC-11: touching ranges merged, as islands."""
    from pyspark.sql import Window as W

    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    own = analogue.table(spark, d, "events").select("user_id", s.alias("s"), (s + 7200).alias("e"))
    w = W.partitionBy("user_id").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    flagged = own.withColumn("first", F.when(F.col("s") <= before + 1, 0).otherwise(1)).withColumn("g", F.sum("first").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return flagged.groupBy("user_id", "g").agg(F.min("s").alias("range_start"), F.max("e").alias("range_end"), F.count("*").alias("parts")).drop("g")

