"""Declared schemas: an all-null column keeps its type because nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DateType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


SNAPSHOT = _struct(allele_id=_S, variation_id=_S, contig=_S, pos=_L, ref=_S, alt=_S, gene=_S, bucket=_S, stars=T.ByteType(), clnsig_raw=_S, clnrevstat_raw=_S, condition=_S)
MANIFEST = _struct(
    snapshot_id=_S, source=_S, release_date=_D, panel=_S, source_url=_S, retrieved_at=_S, parquet_sha256=_S, row_count=_L, bytes_fetched=_L, source_full_bytes=_L, genes_requested=T.IntegerType(), pipeline_git_sha=_S
)
CASE = _struct(tenant_id=_S, case_ref=_S, allele_id=_S, gene=_S, contig=_S, pos=_L, ref=_S, alt=_S, reported_classification=_S, reported_on=_D)
LEDGER = _struct(seq=_L, tenant_id=_S, allele_id=_S, case_ref=_S, verdict=_S, rationale=_S, reviewer=_S, evidence_snapshot_id=_S, created_at=_S, prev_hash=_S, entry_hash=_S)
TENANT = _struct(tenant_id=_S, name=_S, created_at=_S)
TOKEN_EVENT = _struct(token_id=_S, tenant_id=_S, secret_sha256=_S, label=_S, at=_S, event=_S)
EVENT = _struct(from_date=_D, to_date=_D, from_bucket=_S, to_bucket=_S, count=_L, share=T.DoubleType())
