"""SCL-15: digests of files of any size, as trees over byte ranges.

A file's leaves are its ranges of LEAF bytes; its digest is the SHA-256 over the
SHA-256 sums of its leaves in order, in hexadecimal, a line break between.  A task hashes the leaves of one
split, so no row holds a file, and the size of the splits changes nothing.  Files of up to
WHOLE bytes are read as one row each, by Spark in any store; larger ones in splits,
which a Python source reads from a local or mounted path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronospan.sources.generations import located

LEAF, SPLIT, WHOLE = 1 << 20, 64 << 20, 256 << 20


def combined(sums: str) -> Column:
    """An aggregate: one digest of the digests of a group, whatever their order."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(sums)), "\n").cast("binary"), 256)


def leaf_sums(content: Column, leaf: int = LEAF) -> Column:
    """The numbers and sums of the leaves of a whole content; an empty one has one empty leaf."""
    n = F.greatest(F.ceil(F.length(content) / leaf), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("long").alias("i"), F.sha2(F.substring(content, (i * leaf + 1).cast("int"), F.lit(leaf)), 256).alias("sum")))


def of_leaves(leaves: DataFrame) -> DataFrame:
    """path and digest from the leaves (path, i, sum) of files."""
    sums = F.transform(F.sort_array(F.collect_list(F.struct("i", "sum"))), lambda x: x["sum"])
    return leaves.groupBy("path").agg(F.sha2(F.array_join(sums, "\n").cast("binary"), 256).alias("digest"))


@dataclass
class Leaves(InputPartition):
    path: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], leaf: int, split: int):
        self.files, self.leaf, self.split = files, leaf, max(1, split // leaf)

    def partitions(self) -> list[Leaves]:
        return [Leaves(path, k, min(k + self.split, -(-size // self.leaf))) for path, size in self.files for k in range(0, -(-size // self.leaf), self.split)]

    def read(self, partition: Leaves) -> Iterator[tuple]:
        with open(partition.path.removeprefix("file:"), "rb") as f:
            f.seek(partition.first * self.leaf)
            for i in range(partition.first, partition.last):
                yield partition.path, i, hashlib.sha256(f.read(self.leaf)).hexdigest()


class FileLeaves(DataSource):
    """path, i and sum of the leaves of files; options: files (lines of path, tab, size), leaf, split."""

    @classmethod
    def name(cls) -> str:
        return "file_leaves"

    def schema(self) -> str:
        return "path string, i long, sum string"

    def reader(self, schema) -> _Reader:
        files = [(p, int(n)) for p, _, n in (x.rpartition("\t") for x in self.options["files"].split("\n"))]
        return _Reader(files, int(self.options["leaf"]), int(self.options["split"]))


def file_digests(spark: SparkSession, root: str, pattern: str = "*.parquet", leaf: int = LEAF, split: int = SPLIT, whole: int = WHOLE) -> DataFrame:
    """path and digest of each file below ``root`` whose name fits ``pattern``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    _, fs = located(spark, root)
    local = fs.getUri().getScheme() == "file"
    near = files.where(F.col("length") <= whole) if local else files
    leaves = near.select("path", F.explode(leaf_sums(F.col("content"), leaf)).alias("x")).select("path", "x.*")
    # the listing alone: contents aren't read; files this large are few
    large = files.where(F.col("length") > whole).select("path", "length").collect() if local else []
    if large:
        spark.dataSource.register(FileLeaves)
        listed = "\n".join(f"{r['path']}\t{r['length']}" for r in large)
        leaves = leaves.unionByName(spark.read.format("file_leaves").option("files", listed).option("leaf", leaf).option("split", split).load())
    return of_leaves(leaves)
