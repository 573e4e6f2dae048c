"""An append-only, hash-chained ledger of decisions, and tenants' tokens (QRY-15, QRY-20, SNK-8, SNK-9)."""

from __future__ import annotations

import hashlib
import hmac
import json
import secrets
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronospan.schemas import LEDGER, TOKEN_EVENT
from chronospan.sources.generations import listed, put_if_absent

GENESIS = "0" * 64
VERDICTS = ("ACT", "NO_ACT", "DEFER", "RECONTACT")
PAYLOAD = ("seq", "tenant_id", "allele_id", "case_ref", "verdict", "rationale", "reviewer", "evidence_snapshot_id", "created_at")


def entry_hash(payload: dict, prev: str) -> str:
    """SCL-14: SHA-256 of the former hash, a line break and the canonical JSON of the entry."""
    return hashlib.sha256(f"{prev}\n{json.dumps(payload, sort_keys=True, separators=(',', ':'))}".encode()).hexdigest()


def _json_text(text: Column) -> Column:
    """A JSON string of printable ASCII, escaped as Python's json does."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    short = F.create_map(*[F.lit(x) for pair in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")) for x in pair])

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        two = F.concat(unit(0xD800 + F.shiftright(n - 0x10000, 10)), unit(0xDC00 + (n - 0x10000).bitwiseAND(0x3FF)))
        return F.coalesce(F.try_element_at(short, c), F.when((n >= 0x20) & (n <= 0x7E), c).when(n < 0x10000, unit(n)).otherwise(two))

    body = F.when(text.rlike(r"^[ !#-\[\]-~]*$"), text).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), ""))
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def entry_hash_column() -> Column:
    """SCL-14 for columns: the canonical JSON is put together and hashed in the JVM."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")) if c == "seq" else _json_text(F.col(c))
    parts = [x for k, c in enumerate(sorted(PAYLOAD)) for x in (F.lit(f'{"," if k else "{"}"{c}":'), value(c))]
    return F.sha2(F.concat(F.col("prev_hash"), F.lit("\n"), *parts, F.lit("}")).cast("binary"), 256)


def entry(last: tuple[int, str] | None, tenant: str, allele: str, case_ref: str, verdict: str, rationale: str, reviewer: str, snapshot: str, now: datetime | None = None) -> dict:
    """The entry after the last one, of which the number and the hash are given."""
    if verdict not in VERDICTS:
        raise ValueError(f"verdict is one of {', '.join(VERDICTS)}, not {verdict!r}")
    seq, prev = last or (0, GENESIS)
    values = (seq + 1, tenant, allele, case_ref, verdict, rationale, reviewer, snapshot, (now or datetime.now(UTC)).isoformat(timespec="seconds"))
    payload = dict(zip(PAYLOAD, values, strict=True))
    return payload | {"prev_hash": prev, "entry_hash": entry_hash(payload, prev)}


def append(ledger: DataFrame, tenant: str, *values) -> DataFrame:
    """SNK-8, WIN-7: the next entry of a tenant as a one-row table; for a ledger that one writer holds.  ``values``: as in ``entry``."""
    last = ledger.where(F.col("tenant_id") == tenant).agg(F.max_by(F.struct("seq", "entry_hash"), "seq").alias("x")).first()["x"]
    made = entry((last["seq"], last["entry_hash"]) if last else None, tenant, *values)
    return ledger.sparkSession.createDataFrame([tuple(made[f] for f in LEDGER.fieldNames())], LEDGER)


def _tenant(spark: SparkSession, root: str, tenant: str) -> str:
    return f"{root}/tenant_id={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(tenant)}"


def append_to(spark: SparkSession, root: str, tenant: str, *values, tries: int = 1000) -> dict:
    """SNK-8: appends a tenant's next entry to the stored ledger ``root``, whoever else appends to it.

    An entry is a file of its own, named by its number and made only if there is none: of
    writers that follow the same entry one succeeds, the others read its hash and go on from there.
    """
    folder = _tenant(spark, root, tenant)
    for _ in range(tries):
        names = [n for n in listed(spark, folder) if n.endswith(".json")]
        before = json.loads(spark.read.text(f"{folder}/{names[-1]}", wholetext=True).first()[0]) if names else None
        made = entry((before["seq"], before["entry_hash"]) if before else None, tenant, *values)
        if put_if_absent(spark, f"{folder}/{made['seq']:012d}.json", json.dumps(made).encode()):
            return made
    raise TimeoutError(f"{tries} other entries of {tenant} came first")


def stored(spark: SparkSession, root: str) -> DataFrame:
    """All entries of a stored ledger."""
    names = [n for n in listed(spark, root) if n.startswith("tenant_id=")]
    # the tenant is in the entry; the folder's name isn't read for it
    return spark.read.schema(LEDGER).json([f"{root}/{n}" for n in names]) if names else spark.createDataFrame([], LEDGER)


def verify(ledger: DataFrame, hashed: Column | None = None) -> DataFrame:
    """QRY-15: tenant_id, intact and first_bad_seq.

    Rows before the first bad one have matching hashes, so comparing each with
    its neighbour finds the same row as replaying the chain.
    """
    w = W.partitionBy("tenant_id").orderBy("seq")
    linked = F.col("prev_hash").eqNullSafe(F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS)))
    own = ledger.withColumn("linked", linked).withColumn("own_hash", entry_hash_column() if hashed is None else hashed)
    bad = F.when(~F.col("linked") | ~F.col("own_hash").eqNullSafe(F.col("entry_hash")), F.col("seq"))
    return own.groupBy("tenant_id").agg(F.min(bad).alias("first_bad_seq")).withColumn("intact", F.col("first_bad_seq").isNull())


def latest(events: DataFrame, key: str, by: str) -> DataFrame:
    """WIN-7: the last row of each key."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("x")).select(key, "x.*")


def token_counts(tenants: DataFrame, tokens: DataFrame) -> DataFrame:
    """QRY-20, JOI-12: tenants with their active and revoked tokens; tokens have revoked_at."""
    own = tokens.groupBy("tenant_id").agg(F.count_if(F.col("revoked_at").isNull()).alias("active"), F.count_if(F.col("revoked_at").isNotNull()).alias("revoked"))
    return tenants.join(own, "tenant_id", "left").fillna(0, ["active", "revoked"])


def issue(tenant: str, label: str, at: str) -> tuple[str, tuple]:
    """A new secret, shown once, and its event row; only a hash is kept."""
    token_id, secret = secrets.token_hex(8), secrets.token_urlsafe(32)
    return f"csp.{token_id}.{secret}", (token_id, tenant, hashlib.sha256(secret.encode()).hexdigest(), label, at, "issued")


def authenticated(events: DataFrame, presented: str) -> str | None:
    """The tenant of a valid token that isn't revoked; None for every other cause alike."""
    kind, _, rest = presented.partition(".")
    token_id, _, secret = rest.partition(".")
    rows = events.where(F.col("token_id") == token_id).select(*TOKEN_EVENT.fieldNames()).collect()
    issued = next((r for r in rows if r["event"] == "issued"), None)
    same = hmac.compare_digest(hashlib.sha256(secret.encode()).hexdigest(), issued["secret_sha256"] if issued else "0" * 64)
    return issued["tenant_id"] if kind == "csp" and issued and same and not any(r["event"] == "revoked" for r in rows) else None
