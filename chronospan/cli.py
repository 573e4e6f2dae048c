"""Command line over a folder of tables.

    python -m chronospan.cli --root R ingest --lines F --regions F --release D --panel P
    python -m chronospan.cli --root R spans | spike | timeline | provenance | export-public
    python -m chronospan.cli --root R tenant-create | tenant-list | tenant-revoke
    python -m chronospan.cli --root R case-load | case-demo | case-report | case-review | case-log | case-verify
"""

from __future__ import annotations

import argparse
import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospan.functions.alleles import allele_id
from chronospan.functions.leftalign import STRETCH, left_aligned
from chronospan.locks import lock
from chronospan.operators import cases, ledger, movement, timeline
from chronospan.schemas import TENANT, TOKEN_EVENT
from chronospan.service import Timeline
from chronospan.session import session
from chronospan.sources import ingest as ingesting
from chronospan.sources import indexed, snapshots, store
from chronospan.sources.blocks import ByteFile

THRESHOLD = 0.03


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if snapshots._exists(spark, path) else spark.createDataFrame([], schema)


def _raw(spark: SparkSession, a) -> DataFrame:
    return snapshots.read_snapshots(spark, f"{a.root}/snapshots")


def ingest(spark, a):
    """From text lines, or, where an index lies beside the file, from the byte ranges of the regions alone, read once."""
    regions = spark.read.schema("symbol string, contig string, start long, end long").json(a.regions)
    if not snapshots._exists(spark, f"{a.lines}.tbi"):
        made = ingesting.ingest(spark.read.text(a.lines), regions, f"{a.root}/snapshots", a.release, a.panel, a.lines, a.force)
        return made or "already there"
    folder = f"{a.root}/_lines-{uuid.uuid4().hex}"
    try:
        lines, sent = indexed.fetched_lines(spark, a.lines, [(r["contig"], r["start"], r["end"]) for r in regions.collect()], folder)
        return ingesting.ingest(lines, regions, f"{a.root}/snapshots", a.release, a.panel, a.lines, a.force, sent, ByteFile(a.lines).size()) or "already there"
    finally:
        snapshots.removed(spark, folder)


def spans(spark, a):
    raw = _raw(spark, a)
    made = store.build(raw, a.root, snapshot_manifest=raw.select("snapshot_id", "panel", "release_date").distinct())
    return [r.asDict() for r in timeline.span_stats(made.spans).collect()]


def spike(spark, a):
    made = store.stored_in(spark, a.root)
    keys = movement.suspect_keys(movement.detected(made.steps, a.threshold))
    return [r.asDict() for r in movement.panel_movement(made.spans, a.baseline, a.now, keys).collect()]


def timeline_(spark, a):
    own = store.stored_in(spark, a.root).spans.where(F.col("panel") == a.panel)
    return [r.asDict() for r in own.orderBy("pos", "allele_id", "valid_from").limit(a.limit).collect()]


def provenance(spark, a):
    manifests = snapshots.load_manifests(spark, f"{a.root}/snapshots/manifests/*")
    return [r.asDict() for r in snapshots.provenance(spark, manifests, f"{a.root}/snapshots").collect()]


def export_public(spark, a):
    snapshots.export_public(spark, a.root, a.target)
    return a.target


def tenant_create(spark, a):
    shown, row = ledger.issue(a.tenant, a.label, _now())
    spark.createDataFrame([(a.tenant, a.name or a.tenant, _now())], TENANT).write.mode("append").parquet(f"{a.root}/tenant")
    spark.createDataFrame([row], TOKEN_EVENT).write.mode("append").parquet(f"{a.root}/tenant_token")
    return {"token": shown}


def tenant_list(spark, a):
    events = _table(spark, f"{a.root}/tenant_token", TOKEN_EVENT)
    tokens = events.groupBy("token_id").agg(F.max("tenant_id").alias("tenant_id"), F.max(F.when(F.col("event") == "revoked", F.col("at"))).alias("revoked_at"))
    tenants = _table(spark, f"{a.root}/tenant", TENANT).dropDuplicates(["tenant_id"])
    return [r.asDict() for r in ledger.token_counts(tenants, tokens).orderBy("tenant_id").collect()]


def tenant_revoke(spark, a):
    spark.createDataFrame([(a.token, a.tenant, None, None, _now(), "revoked")], TOKEN_EVENT).write.mode("append").parquet(f"{a.root}/tenant_token")
    return "revoked"


def case_load(spark, a):
    """Cases are left-aligned where the folder holds reference stretches."""
    good, bad = cases.load_csv(spark, a.csv, a.tenant)
    if snapshots._exists(spark, f"{a.root}/reference"):
        moved = left_aligned(good, spark.read.schema(STRETCH).parquet(f"{a.root}/reference")).where("aligned IS NOT NULL")
        t = F.col("aligned")
        good = moved.withColumns({"pos": t["pos"], "ref": t["ref"], "alt": t["alt"], "allele_id": F.coalesce(allele_id("GRCh38", F.col("contig"), t["pos"], t["ref"], t["alt"]), "allele_id")}).drop("aligned")
    with lock(_lock(a)):
        snapshots.replace_tenant(good, f"{a.root}/case_variant", a.tenant)
    return {"loaded": good.count(), "rejected": [r.asDict() for r in bad.collect()]}


def case_demo(spark, a):
    made = store.stored_in(spark, a.root)
    of_panel = F.col("panel") == a.panel
    out = cases.demo_cases(made.spans.where(of_panel), made.releases.where(of_panel), a.limit, a.seed)
    out.coalesce(1).write.mode("overwrite").csv(a.csv, header=True)  # SNK-11
    return a.csv


def case_report(spark, a):
    own = Timeline(store.stored_in(spark, a.root), a.panel, a.threshold)
    return own.case_report(spark.read.parquet(f"{a.root}/case_variant"), a.tenant, a.limit)


def _lock(a) -> str:
    return a.lock or f"{a.root.removeprefix('file://')}/.lock"


def _ledger(spark, a):
    return ledger.stored(spark, f"{a.root}/decision_ledger")


def case_review(spark, a):
    return ledger.append_to(spark, f"{a.root}/decision_ledger", a.tenant, a.allele, a.case, a.verdict, a.rationale, a.reviewer, a.snapshot)


def case_log(spark, a):
    return [r.asDict() for r in _ledger(spark, a).where(F.col("tenant_id") == a.tenant).orderBy("seq").collect()]


def case_verify(spark, a):
    got = ledger.verify(_ledger(spark, a).where(F.col("tenant_id") == a.tenant)).first()
    return {"intact": got["intact"] if got else True, "first_bad_seq": got["first_bad_seq"] if got else None}


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


COMMANDS = {
    "ingest": ingest, "spans": spans, "spike": spike, "timeline": timeline_, "provenance": provenance, "export-public": export_public, "tenant-create": tenant_create, "tenant-list": tenant_list, "tenant-revoke": tenant_revoke,
    "case-load": case_load, "case-demo": case_demo, "case-report": case_report, "case-review": case_review, "case-log": case_log, "case-verify": case_verify,
}
OPTIONS = "lines regions release panel target tenant label name token csv allele case verdict rationale reviewer snapshot baseline now on".split()


def main(args: list[str] | None = None, spark: SparkSession | None = None):
    parser = argparse.ArgumentParser(prog="chronospan")
    parser.add_argument("--root", required=True)
    parser.add_argument("--lock", default="")
    parser.add_argument("command", choices=COMMANDS)
    for option in OPTIONS:
        parser.add_argument(f"--{option}", default="")
    parser.add_argument("--limit", type=int, default=50)
    parser.add_argument("--seed", type=int, default=7)
    parser.add_argument("--threshold", type=float, default=THRESHOLD)
    parser.add_argument("--force", action="store_true")
    a = parser.parse_args(args)
    out = COMMANDS[a.command](spark or session(), a)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
