"""Tables that change together, in any store: generations, and entries that are made once (SNK-4, SNK-6, SNK-8).

A writer claims the next number by making a file that nobody else can make, writes
its tables into the generation's own folder, and makes the file that commits it.
Readers take the highest committed number once and read its folder from then on, so
they see one whole generation whatever is written meanwhile, and a crash at any step
leaves the former one.  The files' names say all, so none is ever seen half written.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

GENERATIONS, CLAIMS, COMMITS = "_generations", "_claims", "_commits"
#: Generations that are kept: a reader that resolved one has it until so many later ones are committed.
KEPT = 2


class Gone(RuntimeError):
    """There is no committed generation."""


def located(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    p, fs = located(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def put_if_absent(spark: SparkSession, path: str, data: bytes = b"") -> bool:
    """Makes a whole file at ``path`` unless there is one; of writers at the same time one alone gets True.

    On a local disk a finished file is linked into its place; HDFS moves one
    there, and neither replaces what is there; an object store makes the file when it is
    closed, if its connector writes conditionally.
    """
    p, fs = located(spark, path)
    kind = fs.getUri().getScheme()
    fs.mkdirs(p.getParent())
    if kind == "file":
        target = fs.makeQualified(p).toUri().getPath()
        part = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        try:
            with open(part, "wb") as f:
                f.write(data)
            os.link(part, target)
            return True
        except FileExistsError:
            return False
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(part)
    if kind in ("hdfs", "viewfs"):
        part, _ = located(spark, f"{path}.{uuid.uuid4().hex}.part")
        _written(fs.create(part, False), data)
        try:
            return bool(not fs.exists(p) and fs.rename(part, p))
        finally:
            fs.delete(part, False)
    try:
        _written(fs.create(p, False), data)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or fs.exists(p):
            return False
        raise
    return True


def _written(stream, data: bytes) -> None:
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def committed(spark: SparkSession, root: str) -> list[str]:
    return listed(spark, f"{root}/{COMMITS}")


def current(spark: SparkSession, root: str) -> str:
    """The folder of the last committed generation, resolved once."""
    names = committed(spark, root)
    if not names:
        raise Gone(f"{root} has no committed generation")
    return f"{root}/{GENERATIONS}/{names[-1]}"


@contextlib.contextmanager
def generation(spark: SparkSession, root: str, keep: int = KEPT) -> Iterator[str]:
    """The folder of a new generation, committed when the block ends well; of two writers the one that began later holds."""
    taken = listed(spark, f"{root}/{CLAIMS}")
    number = int(taken[-1]) + 1 if taken else 1
    while not put_if_absent(spark, f"{root}/{CLAIMS}/{number:012d}"):
        number += 1
    folder = f"{root}/{GENERATIONS}/{number:012d}"
    try:
        yield folder
    except BaseException:
        p, fs = located(spark, folder)
        fs.delete(p, True)
        raise
    put_if_absent(spark, f"{root}/{COMMITS}/{number:012d}")
    vacuum(spark, root, keep)


def vacuum(spark: SparkSession, root: str, keep: int = KEPT) -> None:
    """Deletes generations before the last ``keep`` committed ones, those that were never committed too."""
    last = committed(spark, root)[-keep:]
    for name in listed(spark, f"{root}/{GENERATIONS}"):
        if last and name < last[0]:
            p, fs = located(spark, f"{root}/{GENERATIONS}/{name}")
            fs.delete(p, True)
    for name in listed(spark, f"{root}/{CLAIMS}"):
        if last and name < last[0]:
            p, fs = located(spark, f"{root}/{CLAIMS}/{name}")
            fs.delete(p, False)
    for name in committed(spark, root)[:-keep]:
        p, fs = located(spark, f"{root}/{COMMITS}/{name}")
        fs.delete(p, False)
