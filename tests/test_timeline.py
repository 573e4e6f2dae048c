"""Timeline, detector and exploration on tiny snapshots, rows checked by hand."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from chronospan.operators import asof, explore, movement, timeline

RAW = "panel string, allele_id string, release_date date, bucket string, stars byte, gene string, condition string, pos long"
NAMES = {"U": "UNCERTAIN", "LP": "LIKELY_PATHOGENIC", "P": "PATHOGENIC", "B": "BENIGN", "C": "CONFLICTING"}
D = date.fromisoformat


def snapshots(spark, releases, gene=None, condition="Some condition"):
    """{date: {allele: 'U1'}} as raw rows; the digit is the stars."""
    rows = []
    for day, own in releases.items():
        for k, (a, state) in enumerate(own.items()):
            rows.append(("p", a, D(day), NAMES[state[:-1]], int(state[-1]), (gene or {}).get(a, "GENE"), condition if isinstance(condition, str) else condition.get(a), 1000 + k))
    own = spark.createDataFrame(rows, RAW)
    return own.select(
        "*", F.substring("allele_id", 2, 9).alias("variation_id"), F.lit("17").alias("contig"), F.lit("C").alias("ref"), F.lit("T").alias("alt"), F.col("bucket").alias("clnsig_raw"), F.lit(None).cast("string").alias("clnrevstat_raw"),
        F.concat(F.lit("s-"), F.date_format("release_date", "yyyyMMdd")).alias("snapshot_id"),
    )


THREE = {
    "2019-01-02": {"A1": "U1", "A2": "U1", "A3": "U1"},
    "2022-06-01": {"A1": "U1", "A2": "LP2", "A3": "U1", "A4": "P3"},
    "2026-08-08": {"A1": "U1", "A2": "LP2", "A4": "P3"},
}


@pytest.fixture(params=[timeline.dense_spans, timeline.sparse_spans], ids=["dense", "sparse"])
def build(request):
    return request.param


def listed(spans, allele):
    return [(r["bucket"], r["stars"], str(r["valid_from"]), str(r["valid_to"]), str(r["last_seen"])) for r in spans.where(F.col("allele_id") == allele).orderBy("valid_from").collect()]


def test_spans(spark, build):
    spans = build(snapshots(spark, THREE)).cache()
    assert listed(spans, "A1") == [("UNCERTAIN", 1, "2019-01-02", "9999-12-31", "2026-08-08")]
    assert listed(spans, "A2") == [("UNCERTAIN", 1, "2019-01-02", "2022-06-01", "2019-01-02"), ("LIKELY_PATHOGENIC", 2, "2022-06-01", "9999-12-31", "2026-08-08")]
    assert listed(spans, "A3") == [("UNCERTAIN", 1, "2019-01-02", "2026-08-08", "2022-06-01"), ("ABSENT", -1, "2026-08-08", "9999-12-31", "2026-08-08")]
    assert listed(spans, "A4") == [("ABSENT", -1, "2019-01-02", "2022-06-01", "2019-01-02"), ("PATHOGENIC", 3, "2022-06-01", "9999-12-31", "2026-08-08")]
    assert timeline.overlaps(spans).count() == 0
    assert spans.where("allele_id = 'A1'").first()["pos"] == 1000
    stats = timeline.span_stats(spans).first()
    assert (stats["spans"], stats["alleles"], stats["moved_alleles"]) == (7, 4, 3)


def test_stars_split_and_gaps_close(spark, build):
    raw = snapshots(spark, {"2020-01-01": {"B1": "P1", "B2": "U1"}, "2021-01-01": {"B1": "P3"}, "2022-01-01": {"B1": "P3", "B2": "U1"}})
    spans = build(raw)
    assert [s[1] for s in listed(spans, "B1")] == [1, 3]
    assert [s[0] for s in listed(spans, "B2")] == ["UNCERTAIN", "ABSENT", "UNCERTAIN"]


@pytest.mark.parametrize(("on", "bucket"), [("2019-01-02", "UNCERTAIN"), ("2020-05-05", "UNCERTAIN"), ("2022-06-01", "LIKELY_PATHOGENIC"), ("2030-01-01", "LIKELY_PATHOGENIC"), ("2015-01-01", None)])
def test_as_of(spark, on, bucket):
    got = asof.as_of(timeline.sparse_spans(snapshots(spark, THREE)), on).where("allele_id = 'A2'").collect()
    assert [r["bucket"] for r in got] == ([bucket] if bucket else [])


def test_sparse_equals_dense(spark):
    import random

    rng = random.Random(1)
    states = ["U1", "U2", "P3", "B1", "C1"]
    raw = snapshots(spark, {f"20{y}-01-01": {f"A{k}": rng.choice(states) for k in range(40) if rng.random() < 0.6} for y in range(10, 20)})
    a, b = timeline.dense_spans(raw), timeline.sparse_spans(raw)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    c, e = movement.step_series(timeline.dense_grid(raw)), movement.step_series_from_spans(b, timeline.releases(raw))
    assert c.exceptAll(e.select(c.columns)).count() == 0 and e.select(c.columns).exceptAll(c).count() == 0
    many = timeline.sparse_spans(raw.repartition(7))
    assert many.exceptAll(b).count() == 0


def swept(spark):
    first = {f"A{k}": "U1" for k in range(100)}
    second = {a: "C1" if k < 60 else "P1" if k < 62 else "U1" for k, a in enumerate(first)}
    third = {a: "B1" if 62 <= k < 65 else s for k, (a, s) in enumerate(second.items())}
    return snapshots(spark, {"2019-01-02": first, "2022-01-02": second, "2025-01-02": third})


def test_detector(spark):
    steps = movement.step_series(timeline.dense_grid(swept(spark)))
    got = movement.detected(steps, 0.05).collect()
    assert [(str(r["from_date"]), str(r["to_date"]), r["from_bucket"], r["to_bucket"], r["count"], r["share"]) for r in got] == [("2019-01-02", "2022-01-02", "UNCERTAIN", "CONFLICTING", 60, 0.6)]
    growth = snapshots(spark, {"2019-01-02": {f"A{k}": "U1" for k in range(10)}, "2022-01-02": {f"A{k}": "U1" for k in range(100)}})
    assert movement.step_series(timeline.dense_grid(growth)).count() == 0
    for bad in (0.0, 1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="threshold"):
            movement.detected(steps, bad)


def test_movement_and_suspects(spark):
    raw = swept(spark)
    spans = timeline.sparse_spans(raw)
    keys = movement.suspect_keys(movement.detected(movement.step_series(timeline.dense_grid(raw)), 0.05))
    r = movement.panel_movement(spans, "2019-01-02", "2025-01-02", keys).first()
    assert (r["total_tracked"], r["vus_at_baseline"], r["vus_moved"], r["moved_to_pathogenic"], r["moved_to_benign"], r["moved_to_conflicting"], r["retracted"], r["policy_suspect"]) == (100, 100, 65, 2, 3, 60, 0, 60)
    assert (r["movement_rate"], r["movement_rate_adjusted"], r["actionable_rate"]) == (0.65, 0.05, 0.05)
    other = keys.withColumn("changed_on", F.lit("2025-01-02").cast("date"))
    assert movement.panel_movement(spans, "2019-01-02", "2025-01-02", other).first()["policy_suspect"] == 0
    assert movement.movement_detail(spans, "2019-01-02", "2025-01-02", limit=7).count() == 7


def test_thin_genes_sort_last(spark):
    genes = {f"A{k}": "BIGGENE" if k < 250 else "SMALLGENE" for k in range(260)}
    first = dict.fromkeys(genes, "U1")
    last = {a: "P2" if k < 25 or k >= 255 else "U1" for k, a in enumerate(first)}
    spans = timeline.sparse_spans(snapshots(spark, {"2019-01-02": first, "2025-01-02": last}, genes))
    got = explore.genes_ranked(spans, "2019-01-02").collect()
    assert [(r["gene"], r["actionable_rate"], r["thin"]) for r in got] == [("BIGGENE", 0.1, False), ("SMALLGENE", 0.5, True)]
    allowed = spark.createDataFrame([("BIGGENE",)], "gene string")
    assert explore.genes_ranked(spans, "2019-01-02", allowed).count() == 1
    h = explore.panel_headline(spans, "2019-01-02").first()
    assert (h["uncertain"], h["to_pathogenic"], h["to_benign"]) == (260, 30, 0)


def test_pages(spark):
    names = {"A1": "Lynch_syndrome", "A2": "LynchXsyndrome", "A3": "100% penetrance"}
    spans = timeline.sparse_spans(snapshots(spark, THREE, condition={**names, "A4": "reduced penetrance"}))
    on = "2022-06-01"
    rows = explore.variants(spans, "gene", on)
    assert [r["allele_id"] for r in explore.page(rows, 10).collect()] == ["A3", "A4", "A2", "A1"]
    assert {r["total"] for r in explore.page(rows, 1, 2).collect()} == {4}
    assert explore.page(rows, 10, 50).count() == 0 and explore.total_of(rows).first()["total"] == 4
    find = lambda q: sorted(r["allele_id"] for r in explore.variants(spans, "GENE", on, q=q).collect())
    assert find("lynch_") == ["A1"] and find("100%") == ["A3"] and find("penetrance") == ["A3", "A4"] and find("2") == ["A2"] and find("100") == ["A1", "A2", "A3", "A4"]
    assert [r["allele_id"] for r in explore.variants(spans, "GENE", on, only_moved=True).collect()] == ["A3"]
    g = explore.gene_headline(spans, "gene", "2019-01-02").first()
    assert (g["classified"], g["uncertain"], g["now_pathogenic"], g["moved"], g["retracted"]) == (3, 3, 1, 2, 1)


def test_composition(spark):
    raw = snapshots(spark, THREE)
    spans, releases = timeline.sparse_spans(raw), timeline.releases(raw).unionByName(spark.createDataFrame([("p", D("2010-01-01"))], "panel string, release_date date"))
    wide = {str(r["release_date"]): (r["counts"], r["total"]) for r in asof.composition_wide(spans, releases, "gene").collect()}
    assert wide == {"2010-01-01": ({}, 0), "2019-01-02": ({"UNCERTAIN": 3}, 3), "2022-06-01": ({"UNCERTAIN": 2, "LIKELY_PATHOGENIC": 1, "PATHOGENIC": 1}, 4), "2026-08-08": ({"UNCERTAIN": 1, "LIKELY_PATHOGENIC": 1, "PATHOGENIC": 1}, 3)}
    a, b = asof.composition(spans, releases, "gene"), asof.composition_exploded(spans, releases, "gene")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert [r["valid_to"] for r in asof.history(spans, "A2").orderBy("valid_from").collect()] == [D("2022-06-01"), None]


def test_filters_reach_both_sides(spark, tmp_path):
    """JOI-4: one scan of a stored timeline, with the bounds of both dates pushed into it, and one exchange."""
    timeline.sparse_spans(snapshots(spark, THREE)).write.parquet(str(tmp_path / "spans"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = movement.moves(spark.read.parquet(str(tmp_path / "spans")), "2019-01-02", "2025-01-02")._jdf.queryExecution().executedPlan().toString()
    bounds = r"And\(LessThanOrEqual\(valid_from,{0}\),GreaterThan\(valid_to,{0}\)\)"
    assert re.search(r"PushedFilters: \[Or\(" + bounds.format("2019-01-02") + "," + bounds.format("2025-01-02"), plan)
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_sparse_builder_needs_few_exchanges(spark):
    plan = timeline.sparse_points(snapshots(spark, THREE))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """A task of either builder gets about TASK_ROWS rows, whatever adaptive execution would gather by bytes."""
    monkeypatch.setattr(timeline, "TASK_ROWS", 100, raising=False)
    raw = snapshots(spark, {f"20{y}-01-02": {f"A{i}": f"U{1 + y % 2}" for i in range(400)} for y in range(10, 15)})
    for rows in (timeline.sparse_spans(raw), timeline.dense_spans(raw)):
        each = rows.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in each) == 2000 and max(r["count"] for r in each) <= 300
