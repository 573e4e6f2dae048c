"""Files over HTTP on the driver: a content cache, and listings of a year's releases (SRC-14, SRC-16)."""

from __future__ import annotations

import hashlib
import os
import tempfile
import urllib.error
from datetime import date
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronospan.sources.blocks import ByteFile
from chronospan.sources.releases import listed_dates


class ListingError(RuntimeError):
    """It could not be told which releases a year has."""


def read_bytes(url: str) -> bytes:
    """A whole file, local or over HTTP."""
    return ByteFile(url).read()


def cached(url: str, folder: str, read=read_bytes) -> bytes:
    """The bytes of ``url``, kept under a hash of the address; a file appears whole or not at all."""
    path = Path(folder, hashlib.sha256(url.encode()).hexdigest()[:20])
    if not path.exists():
        data = read(url)
        path.parent.mkdir(parents=True, exist_ok=True)
        handle, part = tempfile.mkstemp(dir=folder)
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
            os.replace(part, path)
        except BaseException:
            os.unlink(part)
            raise
    return path.read_bytes()


def list_releases(spark: SparkSession, root: str, year: int, read=read_bytes) -> list[date]:
    """Dates in a year's folder; a folder that doesn't exist has none, any other failure raises."""
    try:
        html = read(f"{root}/{year}/").decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return []
        raise ListingError(f"{year}: {e}") from e
    except OSError as e:
        raise ListingError(f"{year}: {e}") from e
    return spark.createDataFrame([(html,)], "html string").select(listed_dates(F.col("html"))).first()[0]
