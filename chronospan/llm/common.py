"""Helpers that every operator of this package shares."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chronospan.session import shared_dir

#: Bytes of texts that a task works on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 18
#: Bytes hashed at once; a longer word is hashed alone.
HASH_BYTES = 1 << 17
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def configured(spark: SparkSession) -> SparkSession:
    """A session in which an application runs these operators: Arrow batches, which carry texts, hold BATCH_BYTES unless the session says otherwise.

    The queries and the pipeline call it; the operators leave settings alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


class Scratch:
    """Tables of one run of an operator, in a folder of their own in the shared folder.

    The operator drops a table when no later step reads it.  Those that its
    result reads stay until ``close``, or until the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._fs().deleteOnExit(self._at(self.path))

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it back: the lineage ends here.

        A lost executor costs a re-read of the files, not a recomputation.  The
        write's own shuffle files go with its end, and its Arrow batches are
        short; both settings are the caller's again afterwards.
        """
        path = f"{self.path}/{name}"
        conf = self.spark.conf
        own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
        before = {k: conf.get(k) for k in own}
        try:
            for k, v in own.items():
                conf.set(k, v)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs().delete(self._at(f"{self.path}/{name}"), True)

    def close(self) -> None:
        self._fs().delete(self._at(self.path), True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own and read back."""
    return Scratch(df.sparkSession, "run").saved(df, name)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so other columns can't clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def byte_table(word: bytes, lower: bool = True) -> bytes:
    """A translation table: bytes of ``word`` stay (A-Z lower-cased), all others become spaces.

    For UTF-8 text, ``text.translate(table).split()`` then lists its words.
    """
    keep = set(word)
    out = bytearray(b" " * 256)
    for b in keep:
        out[b] = b
    if lower:
        for b in range(0x41, 0x5B):
            if b + 32 in keep:
                out[b] = b + 32
    return bytes(out)


class Texts(NamedTuple):
    """UTF-8 texts side by side, a null one empty; text k is data[offsets[k]:offsets[k + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        if column.null_count:
            column = column.fill_null(b"")
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        return cls(own, at - at[0])


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; a task keeps those of usual lengths."""
    kept = _powers.get(base)
    if kept is None or len(kept) <= n:
        kept = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, HASH_BYTES), base, np.uint64))))
        if n <= HASH_BYTES:
            _powers[base] = kept
    return kept[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def places_of(texts: Texts, keep: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes after the translation ``keep``, start and end of each word, and the number of each text's first word."""
    low = np.take(np.frombuffer(keep, np.uint8), texts.data)
    inside = low != 32
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    border = texts.offsets[(texts.offsets > 0) & (texts.offsets < len(low))]
    starts[border] = inside[border]
    ends[border - 1] = inside[border - 1]
    first = np.flatnonzero(starts)
    return low, first, np.flatnonzero(ends) + 1, np.searchsorted(first, texts.offsets)


def hashes_at(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, of bytes low[start:end].

    No vocabulary is kept, so memory is a few times the bytes of the slice
    whatever the words are.
    """
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        lo = starts[k]
        to = max(k + 1, int(np.searchsorted(ends, lo + HASH_BYTES, "right")))
        part = low[lo : ends[to - 1]] * powers(_BASE, ends[to - 1] - lo)[:-1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        s, e = starts[k:to] - lo, ends[k:to] - lo
        out[k:to] = mixed((sums[e] - sums[s]) * powers(_INVERSE, len(part))[s])
        k = to
    return out


def word_hashes(texts: Texts, keep: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of all texts, and the number of each text's first word; ``keep`` is a ``byte_table``."""
    low, starts, ends, firsts = places_of(texts, keep)
    return hashes_at(low, starts, ends), firsts


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` words, in order; the caller leaves out windows over two texts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_BASE, len(hashes))[:-1], out=sums[1:])
    return mixed((sums[width:] - sums[:n]) * powers(_INVERSE, n)[:-1])


def slices(part: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs whose texts have at most SLICE_BYTES; a longer text comes alone."""
    at = Texts.of(part.column(column)).offsets
    k = 0
    while k < part.num_rows:
        to = max(k + 1, int(np.searchsorted(at, at[k] + SLICE_BYTES, "right")) - 1)
        yield part.slice(k, to - k)
        k = to


def per_slice(docs: DataFrame, make: Callable[[], Callable[..., list]], columns: str, extra: dict[str, Column] | None = None, keys: dict[str, Column] | None = None) -> DataFrame:
    """``keys``, by default doc_id, and ``columns`` (DDL), a row for each row of ``docs``.

    ``make`` runs once a task and gives the function from a slice of texts, a
    binary array, and the arrays of ``extra`` to the columns, as lists or arrays.
    The keys pass through as they are, null or repeated.
    """
    keys = keys or {"doc_id": F.col("doc_id").cast("long")}
    own = docs.select(*(c.alias(f"k{i}") for i, c in enumerate(keys.values())), F.col("text").cast("binary").alias("t"), *(c.alias(f"x{i}") for i, c in enumerate((extra or {}).values())))
    n = len(keys)
    schema = T.StructType([*(T.StructField(k, f.dataType) for k, f in zip(keys, own.schema.fields[:n], strict=True)), *T.StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_slice = make()
        for whole in parts:
            for part in slices(whole, n):
                made = of_slice(*(part.column(i) for i in range(n, part.num_columns)))
                made = (c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, list(arrow)[n:], strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(i).cast(arrow[i].type) for i in range(n)), *made], schema=arrow)

    return own.mapInArrow(batches, schema)


def with_columns(docs: DataFrame, make: Callable[[], Callable[..., list]], columns: str, key: Column | None = None, beside: DataFrame | None = None) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with ``columns``, made as in ``per_slice``, beside its own columns under names that meet no other; and what restores those names.

    With ``beside``, a table of a key and a value, the function also gets the value of
    each row's ``key``, or null.  What restores the names takes the table, perhaps
    filtered, and columns that take the place of some of its own.
    """
    text = docs.columns.index("text")
    own = docs.select(*(F.col(f"`{c}`").cast("string" if i == text else docs.schema[i].dataType).alias(f"c{i}") for i, c in enumerate(docs.columns)), *([] if key is None else [key.alias("key")]))
    if beside is not None:
        own = own.join(beside.toDF("key", "value"), "key", "left").drop("key")
    n = len(docs.columns)
    schema = T.StructType([*own.schema.fields[:n], *T.StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_slice = make()
        for whole in parts:
            texts = whole.column(text).cast(pa.large_binary() if pa.types.is_large_string(whole.column(text).type) else pa.binary())
            beside = pa.RecordBatch.from_arrays([texts, *whole.columns], ["t", *whole.schema.names])
            for part in slices(beside, 0):
                made = of_slice(part.column(0), *(part.column(i) for i in range(n + 1, part.num_columns)))
                made = (c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, list(arrow)[n:], strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(i + 1).cast(arrow[i].type) for i in range(n)), *made], schema=arrow)

    def named(rows: DataFrame, **instead: Column) -> DataFrame:
        return rows.select(*(instead.get(c, F.col(f"c{i}")).cast(docs.schema[i].dataType).alias(c) for i, c in enumerate(docs.columns)))

    return own.mapInArrow(batches, schema), named


def per_text(docs: DataFrame, make: Callable[[], Callable[..., tuple]], columns: str, extra: dict[str, Column] | None = None, keys: dict[str, Column] | None = None) -> DataFrame:
    """Like ``per_slice`` for a function from one whole UTF-8 text, None if null, and the values of ``extra`` to the values of the columns."""
    width = len(T.StructType.fromDDL(columns).fields)

    def of_slice() -> Callable[..., list]:
        one = make()

        def rows(*arrays: pa.Array) -> list:
            got = [one(*x) for x in zip(*(a.to_pylist() for a in arrays), strict=True)]
            return list(zip(*got, strict=True)) if got else [[]] * width

        return rows

    return per_slice(docs, of_slice, columns, extra, keys)


def bucket(column: Column, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``: the folds of the labelled rows."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
