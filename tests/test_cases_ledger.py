"""Reconciliation, the ledger, tenants and the tenant audit."""

from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from chronospan.operators import cases, ledger, timeline
from chronospan.plans.audit import unscoped
from chronospan.schemas import CASE, LEDGER, TENANT, TOKEN_EVENT
from tests.test_timeline import snapshots

EVIDENCE = {"2019-01-02": {"A1": "U1", "A2": "U1", "A3": "U1"}, "2025-01-02": {"A1": "U1", "A2": "P3"}}


def case(ref, allele, day="2020-01-01", tenant="lab-a"):
    return (tenant, ref, allele, "GENE", "17", 1, "C", "T", "VUS", date.fromisoformat(day))


@pytest.fixture
def spans(spark):
    return timeline.sparse_spans(snapshots(spark, EVIDENCE))


def test_every_row_has_one_outcome(spark, spans):
    own = spark.createDataFrame([case("1", "A2"), case("2", "A1"), case("3", "unknown"), case("4", "A2", "2015-01-01"), case("5", "A3"), case("9", "A1", tenant="lab-b")], CASE)
    rows = cases.reconciled(own, spans, "lab-a")
    assert {r["case_ref"]: r["outcome"] for r in rows.collect()} == {"1": "moved_to_pathogenic", "2": "unchanged", "3": "unmatched", "4": "before_coverage", "5": "retracted"}
    r = cases.report(rows).first()
    assert r["loaded"] == r["unmatched"] + r["before_coverage"] + r["examined"] == 5 and not r["sound"]
    assert (r["match_rate"], r["actionable_rate"]) == (0.6, 1 / 3)
    found = cases.findings(rows).collect()
    assert [(f["case_ref"], f["actionable"], f["variant"]) for f in found] == [("1", True, "17:1C>T"), ("5", False, "17:1C>T")]
    keys = spark.createDataFrame([("p", "UNCERTAIN", "PATHOGENIC", date(2025, 1, 2))], "panel string, from_bucket string, to_bucket string, changed_on date")
    assert cases.report(cases.reconciled(own, spans, "lab-a", keys)).first()["policy_suspect"] == 1
    other = keys.withColumn("changed_on", F.lit(date(2023, 6, 1)))
    assert cases.report(cases.reconciled(own, spans, "lab-a", other)).first()["policy_suspect"] == 0
    with pytest.raises(ValueError, match="tenant"):
        cases.reconciled(own, spans, "")


def test_csv(spark, tmp_path):
    path = tmp_path / "cases.csv"
    path.write_text(
        "﻿case_ref,gene,contig,pos,ref,alt,reported_classification,reported_on\n1,G,chr17,100,A,G,VUS,2020-01-02\n2,G,17,x,A,G,VUS,2020-01-02\n3,G,17,100,A,G,VUS,20200102\n4,G,17,100,A,<DEL>,VUS,2020-01-02\n", encoding="utf-8"
    )
    good, bad = cases.load_csv(spark, str(path), "lab-a")
    assert [(r["case_ref"], r["tenant_id"], r["pos"]) for r in good.collect()] == [("1", "lab-a", 100)] and good.first()["allele_id"].startswith("chronospan:VA.")
    assert {r["case_ref"]: r["reason"] for r in bad.collect()} == {"2": "position is no number", "3": "date is not yyyy-mm-dd", "4": "alleles are not sequences"}
    path.write_text("case_ref,contig\n1,17\n")
    with pytest.raises(ValueError, match="columns missing"):
        cases.load_csv(spark, str(path), "lab-a")


def test_isolation(spark):
    own = spark.createDataFrame([case("1", "A1"), case("2", "A1", tenant="lab-b")], CASE)
    assert [r["case_ref"] for r in cases.of_tenant(own, "lab-b").collect()] == ["2"]


def test_audit(spark, tmp_path):
    spark.createDataFrame([case("1", "A1")], CASE).write.parquet(str(tmp_path / "cases"))
    own = spark.read.parquet(str(tmp_path / "cases"))
    assert unscoped(own) and not unscoped(cases.of_tenant(own, "lab-a"))


@pytest.fixture
def chain(spark):
    own = spark.createDataFrame([], LEDGER)
    for k in range(4):
        for tenant, why in (("lab-a", "plain reason"), ("lab-b", "Begründung / 中")):
            own = own.unionByName(ledger.append(own, tenant, f"A{k}", f"c{k}", "ACT", why, "me", "s-1", datetime(2024, 1, 1 + k, tzinfo=UTC)))
            own = spark.createDataFrame(own.collect(), LEDGER)
    return own


def verdicts(rows):
    return {r["tenant_id"]: (r["intact"], r["first_bad_seq"]) for r in ledger.verify(rows).collect()}


def test_chain(spark, chain):
    assert verdicts(chain) == {"lab-a": (True, None), "lab-b": (True, None)}
    hit = (F.col("tenant_id") == "lab-a") & (F.col("seq") == 2)
    assert verdicts(chain.withColumn("rationale", F.when(hit, "other").otherwise(F.col("rationale")))) == {"lab-a": (False, 2), "lab-b": (True, None)}
    assert verdicts(chain.where(~hit)) == {"lab-a": (False, 3), "lab-b": (True, None)}
    assert verdicts(chain.where("false")) == {}
    with pytest.raises(ValueError, match="verdict"):
        ledger.append(chain, "lab-a", "A", "c", "MAYBE", "", "", "")


def test_tokens(spark):
    shown, row = ledger.issue("lab-a", "first", "2024-01-01")
    events = spark.createDataFrame([row], TOKEN_EVENT)
    assert ledger.authenticated(events, shown) == "lab-a" and row[2] not in shown
    for wrong in (shown + "x", "csp.nothing.x", "other." + shown[4:], "", shown.replace("csp", "abc")):
        assert ledger.authenticated(events, wrong) is None
    revoked = events.unionByName(spark.createDataFrame([(row[0], row[1], None, None, "2024-02-01", "revoked")], TOKEN_EVENT))
    assert ledger.authenticated(revoked, shown) is None
    tenants = spark.createDataFrame([("lab-a", "A", ""), ("lab-b", "B", "")], TENANT)
    tokens = spark.createDataFrame([("lab-a", None), ("lab-a", "2024")], "tenant_id string, revoked_at string")
    assert {r["tenant_id"]: (r["active"], r["revoked"]) for r in ledger.token_counts(tenants, tokens).collect()} == {"lab-a": (1, 1), "lab-b": (0, 0)}


def test_sample_is_the_same_each_time(spark, spans):
    pick = lambda seed: [r["allele_id"] for r in cases.sample_cases(spans, "2019-06-01", 2, seed).collect()]
    assert pick(1) == pick(1) and len(pick(1)) == 2


def test_entry_hash_column(spark):
    """The JVM's canonical JSON is Python's, for escapes, control characters, all planes and nulls."""
    texts = ["plain", "", None, 'q"b\\s/', "tab\tline\nfeed\r\b\f", "\x00\x1f\x7f", "grün 中 \u2028", "😀 𝒳 mixed é", "e\u0301"]
    rows = [(k, "t", "A", None, "ACT", text, text, "s", "2024", "0" * 64, "") for k, text in enumerate(texts)]
    own = spark.createDataFrame(rows, LEDGER)
    got = {r["seq"]: r["h"] for r in own.select("seq", ledger.entry_hash_column().alias("h")).collect()}
    assert got == {r[0]: ledger.entry_hash(dict(zip(ledger.PAYLOAD, r[:9], strict=True)), r[9]) for r in rows}
    assert "Python" not in own.select(ledger.entry_hash_column())._jdf.queryExecution().executedPlan().toString()
