"""SRC-23: text lines of one release to a snapshot with its manifest."""

from __future__ import annotations

import json
import os
import subprocess
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronospan.functions.alleles import allele_id, contig
from chronospan.functions.alleles import vcf_records as records
from chronospan.sources.releases import in_regions
from chronospan.sources.snapshots import last_wins, snapshot_hashes, write_snapshot


def snapshot_rows(lines: DataFrame, regions: DataFrame, assembly: str = "GRCh38") -> DataFrame:
    """Records inside the regions with their identity; of one identity in overlapping regions the last region's holds."""
    own = in_regions(records(lines), regions).withColumn("contig", contig(F.col("contig")))
    own = own.withColumn("allele_id", allele_id(assembly, F.col("contig"), F.col("pos"), F.col("ref"), F.col("alt"))).where("allele_id IS NOT NULL")
    return last_wins(own, "allele_id", "region", "pos", "variation_id").drop("region")


def git_state(folder: str) -> str:
    """SCL-18: the commit of the code, with -dirty where files differ from it; unknown outside a repository."""
    ask = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, timeout=60, check=True).stdout.strip()
    try:
        return ask("rev-parse", "HEAD") + ("-dirty" if ask("status", "--porcelain") else "")
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def ingest(
    lines: DataFrame, regions: DataFrame, root: str, release: str, panel: str, source_url: str = "", force: bool = False, bytes_fetched: int | None = None, source_full_bytes: int | None = None
) -> dict | None:
    """Writes a release of a panel once and returns its manifest; None if it was there."""
    if not write_snapshot(snapshot_rows(lines, regions), root, release, panel, force):
        return None
    spark = lines.sparkSession
    path = f"{root}/panel={panel}/release_date={release}"
    name = f"snapshot-{panel}-{release.replace('-', '')}"
    manifest = {
        "snapshot_id": name, "source": "vcf", "release_date": release, "panel": panel, "source_url": source_url, "retrieved_at": datetime.now(UTC).isoformat(timespec="seconds"),
        "parquet_sha256": snapshot_hashes(spark, path).first()["found"], "row_count": spark.read.parquet(path).count(), "bytes_fetched": bytes_fetched, "source_full_bytes": source_full_bytes,
        "genes_requested": regions.select("symbol").distinct().count(), "pipeline_git_sha": git_state(os.path.dirname(__file__)),
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifests/{name}")
    return manifest
