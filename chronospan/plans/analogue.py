"""The driver's tables read as snapshots, cases, a ledger and tenants.

An order's customer is the allele, its period the release, its priority the
classification; nation is the gene, region the panel, market segment the tenant.
"""

from __future__ import annotations

import hashlib
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospan.session import shared_dir
from chronospan.sources import store

# Order priorities and their buckets.
PRIORITY = {"1-URGENT": "PATHOGENIC", "2-HIGH": "LIKELY_PATHOGENIC", "3-MEDIUM": "UNCERTAIN", "4-NOT SPECIFIED": "LIKELY_BENIGN", "5-LOW": "BENIGN"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str, grain: str = "year") -> DataFrame:
    """One row for each customer and period with orders."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(PRIORITY.items())])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.trunc(F.col("o_orderdate").cast("date"), grain).alias("release_date"))
    own = orders.groupBy("o_custkey", "release_date").agg(
        F.count("*").alias("n"), F.min("o_orderpriority").alias("low"), F.max("o_orderpriority").alias("high"), F.max("o_orderkey").alias("last_key")
    )
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = own.join(who, F.col("o_custkey") == F.col("c_custkey"))
    bucket = F.when(F.col("low") != F.col("high"), F.lit("CONFLICTING")).otherwise(F.try_element_at(names, "low"))
    return rows.select(
        F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("allele_id"), F.col("o_custkey").cast("string").alias("variation_id"), F.upper("n_name").alias("gene"), F.col("c_nationkey").cast("string").alias("contig"),
        (F.col("o_custkey") * 1000 + F.col("last_key") % 997).alias("pos"), F.lit("C").alias("ref"), F.lit("T").alias("alt"), bucket.alias("bucket"), F.least(F.col("n"), F.lit(4)).cast("byte").alias("stars"),
        F.col("low").alias("clnsig_raw"), F.concat(F.lit("n="), F.col("n").cast("string")).alias("clnrevstat_raw"), F.col("c_name").alias("condition"), F.col("r_name").alias("panel"), "release_date",
        F.concat(F.lit("orders-"), F.date_format("release_date", "yyyyMMdd")).alias("snapshot_id"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a laboratory's reports: some of unknown alleles, some from before coverage."""
    orders, who = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    allele = F.when(key % 33 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey"))
    day = F.when(key % 20 == 0, F.lit("1990-06-01").cast("date")).otherwise(F.date_add(F.col("o_orderdate").cast("date"), (key % 400).cast("int")))
    return orders.join(who, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("tenant_id"), key.cast("string").alias("case_ref"), F.concat(F.lit("A"), allele.cast("string")).alias("allele_id"), F.lit(None).cast("string").alias("gene"), F.lit("1").alias("contig"), key.alias("pos"),
        F.lit("C").alias("ref"), F.lit("T").alias("alt"), F.col("o_orderpriority").alias("reported_classification"), day.alias("reported_on"),
    )


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the files behind ``raw``: a build is of use only while they stay the same."""
    jvm, out = spark._jvm, []
    for name in ("orders", "customer", "nation", "region"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(out)).encode()).hexdigest()[:20]


_built: dict[tuple[str, str, str], store.Built] = {}


def built(spark: SparkSession, sf_dir: str, grain: str = "year") -> store.Built:
    """The timeline of ``raw``, built once in an application while the tables behind it stay the same; its folder goes with the driver's JVM."""
    key = (spark.sparkContext.applicationId, grain, _state(spark, sf_dir))
    if key not in _built:
        root = f"{shared_dir(spark)}/timeline-{'-'.join(key)}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _built[key] = store.build(raw(spark, sf_dir, grain), root)
    return _built[key]
