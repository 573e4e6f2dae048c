"""A session with the settings that the plans count on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def session(app: str = "chronospan", **extra: str) -> SparkSession:
    """UTC, ANSI and adaptive execution with skew joins; ``extra`` overrides."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | extra
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()


def tasks(spark: SparkSession, rows: int, most: int) -> int:
    """How many tasks ``rows`` need if each takes about ``most``; one for each core at least, as long as those get a tenth of that."""
    return max(1, -(-rows // most), min(spark.sparkContext.defaultParallelism, 10 * rows // most))


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names.

    Only where that is unset and one machine does all, as in local tests, a
    temporary folder takes its place; a cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = _local.get(spark.sparkContext.applicationId)
        if not named:
            named = _local[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="chronospan-")
    return named.rstrip("/")
