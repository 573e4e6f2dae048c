"""Snapshots, manifests and their provenance (SRC-1, SRC-20, SNK-1 to SNK-6, QRY-18)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronospan.operators.timeline import small
from chronospan.schemas import MANIFEST, SNAPSHOT
from chronospan.sources.digests import combined, file_digests
from chronospan.sources.generations import Gone, current, generation

#: Rows of a file, about, and bits of a position below its bin.
FILE_ROWS, BIN_BITS = 500_000, 17
#: Settings of the files, fixed so that equal rows give equal bytes.
WRITER = {"compression": "zstd", "parquet.compression.codec.zstd.level": "3", "parquet.block.size": str(128 << 20), "parquet.page.size": str(1 << 20), "parquet.enable.dictionary": "true"}
PUBLIC = ("snapshot_manifest", "allele_dim", "assertion_span")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _folder(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    p, fs = _folder(spark, path)
    fs.delete(p, True)


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """AGG-8: of rows with one key the last in order."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def dealt(rows: DataFrame, target: int | None = None) -> DataFrame:
    """``rows`` (SNAPSHOT) in partitions of about ``target`` rows, by default FILE_ROWS, that their values alone decide, in a total order.

    Exact counts of genomic bins tell where a partition ends, so equal rows are dealt
    alike whatever their order and partitions were.  A bin of more rows is
    dealt by hash.  Bins are as many as positions allow, not as there are rows.
    """
    target = target or FILE_ROWS
    place = {"bin_contig": F.coalesce("contig", F.lit("")), "bin": F.coalesce(F.shiftright("pos", BIN_BITS), F.lit(-1))}
    own = rows.withColumns(place)
    bins = own.groupBy(*place).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("bin_contig").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("k", F.floor(before / target)).withColumn("parts", F.ceil(F.col("n") / target))
    files = bins.groupBy("bin_contig", "k").agg(F.max("parts").alias("most"))
    files = files.withColumn("first", F.sum("most").over(W.orderBy("bin_contig", "k")) - F.col("most"))
    total = int(files.agg(F.max(F.col("first") + F.col("most"))).first()[0] or 1)
    numbered = bins.join(files, ["bin_contig", "k"]).select(*place, "first", "parts")
    at = (F.col("first") + F.pmod(F.xxhash64("allele_id"), F.col("parts"))).cast("int")
    order = [F.col(c).asc_nulls_first() for c in ("contig", "pos", "allele_id", *(c for c in rows.columns if c not in ("contig", "pos", "allele_id")))]
    return own.join(small(numbered), [*place]).repartitionById(total, at).select(*rows.columns).sortWithinPartitions(*order)


def write_snapshot(rows: DataFrame, root: str, release: str, panel: str, force: bool = False) -> bool:
    """SNK-1, SNK-2: one release of a panel, sorted by place; False if it is there already.

    The write goes through Spark's committer, which publishes whole results
    only.  Equal rows give files of equal bytes, so a snapshot's hash can be made again.
    """
    spark, path = rows.sparkSession, f"{root}/panel={panel}/release_date={release}"
    if not force and _exists(spark, f"{path}/_SUCCESS"):
        return False
    own = rows.select(*[F.col(f.name).cast(f.dataType) for f in SNAPSHOT.fields])
    writer = dealt(own).write.mode("overwrite")
    for name, value in WRITER.items():
        writer = writer.option(name, value)
    writer.parquet(path)
    return True


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """SRC-1, SNK-5: all releases at once; panel and release_date prune by folder."""
    own = spark.read.schema(SNAPSHOT).option("basePath", root).parquet(f"{root}/panel=*/release_date=*")
    day = F.col("release_date").cast("date")
    return own.withColumn("release_date", day).withColumn("snapshot_id", F.concat_ws("-", F.lit("snapshot"), "panel", F.date_format(day, "yyyyMMdd")))


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: snapshot rows from NDJSON in the declared schema; a line of another form stops the load."""
    return spark.read.schema(SNAPSHOT).option("mode", "FAILFAST").json(path)


def load_manifests(spark: SparkSession, glob: str, panel: str | None = None) -> DataFrame:
    """SRC-20"""
    own = spark.read.schema(MANIFEST).json(glob, multiLine=True)
    return (own if panel is None else own.where(F.col("panel") == panel)).orderBy("release_date", "snapshot_id")


def first_writer_wins(old: DataFrame, new: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """SNK-3: the rows of ``new`` to append, one for each key that ``old`` lacks."""
    return new.join(old.select(key), key, "left_anti").dropDuplicates([key])


def export_public(spark: SparkSession, source: str, target: str) -> None:
    """SNK-6: copies the public tables of the current generation by name, never all but some, as a generation of ``target``; refuses its source, however it is written."""
    (a, fs), (b, _) = _folder(spark, source), _folder(spark, target)
    if fs.makeQualified(a).equals(fs.makeQualified(b)):
        raise ValueError("the target is the source")
    try:
        folder = current(spark, source)
    except Gone:
        folder = source  # plain tables
    with generation(spark, target) as new:
        for name in PUBLIC:
            spark.read.parquet(f"{folder}/{name}").write.parquet(f"{new}/{name}")


def replace_tenant(rows: DataFrame, root: str, tenant: str) -> None:
    """SNK-7: a load takes the place of the tenant's former rows, also a load without rows; other tenants keep theirs."""
    spark, own = rows.sparkSession, rows.where(F.col("tenant_id") == tenant)
    if own.limit(1).count():
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(root)
    else:
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(tenant)
        removed(spark, f"{root}/tenant_id={name}")


def snapshot_hashes(spark: SparkSession, root: str) -> DataFrame:
    """SCL-15: snapshot_id and ``found``, the SHA-256 over the sorted digests of a snapshot's files, for each snapshot below ``root``."""
    part = lambda k: F.url_decode(F.regexp_extract("path", r"/panel=([^/]+)/release_date=([^/]+)/[^/]+$", k))
    each = file_digests(spark, root).select(part(1).alias("panel"), part(2).alias("day"), "digest").where("panel <> ''")
    name = F.concat_ws("-", F.lit("snapshot"), "panel", F.replace(F.col("day"), F.lit("-")))
    return each.groupBy(name.alias("snapshot_id")).agg(combined("digest").alias("found"))


def provenance(spark: SparkSession, manifests: DataFrame, root: str) -> DataFrame:
    """QRY-18, AGG-14: manifests by state: intact, altered, missing; and whether their code is reproducible."""
    return provenance_of(manifests, snapshot_hashes(spark, root))


def provenance_of(manifests: DataFrame, hashes: DataFrame) -> DataFrame:
    own = manifests.join(hashes, "snapshot_id", "left")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("parquet_sha256"), "intact").otherwise("altered")
    sha = F.coalesce("pipeline_git_sha", F.lit("unknown"))
    return own.groupBy(state.alias("state"), (~(sha.endswith("-dirty") | (sha == "unknown"))).alias("reproducible")).agg(F.count("*").alias("n"))


def report_json(row: DataFrame, path: str) -> None:
    """SNK-10: a one-row report as a JSON file on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row.first().asDict(recursive=True), f, default=str, indent=2)
