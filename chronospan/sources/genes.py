"""SRC-18: where the genes of a panel lie, asked from one provider after another.

A panel has tens of genes, so they are looked up on the driver; what is known
is a table and is never asked for again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospan.functions.alleles import padded
from chronospan.sources.snapshots import _exists

REGION = "symbol string, contig string, start long, end long, source string"

#: From a symbol to (contig, start, end), None if the provider doesn't know it; what it raises counts as a failure.
Provider = Callable[[str], tuple[str, int, int] | None]


class TooManyUnknown(RuntimeError):
    """More genes than the budget allows have no place."""


def resolved(spark: SparkSession, symbols: list[str], providers: dict[str, Provider], path: str, budget: float = 0.1) -> DataFrame:
    """The regions of ``symbols``, with flanks; new ones are appended to the table at ``path``.

    The first provider that knows a symbol decides.  If more than ``budget`` of the symbols stay
    unknown, nothing is written: a panel with holes would look like absence.
    """
    wanted = sorted({s.upper() for s in symbols})
    known = spark.read.schema(REGION).parquet(path) if _exists(spark, path) else spark.createDataFrame([], REGION)
    there = {r["symbol"] for r in known.where(F.col("symbol").isin(*wanted)).select("symbol").collect()} if wanted else set()
    found, missing = [], {}
    for symbol in wanted:
        for name, ask in providers.items() if symbol not in there else ():
            try:
                place = ask(symbol)
            except (OSError, ValueError, KeyError) as e:
                missing[symbol] = f"{name}: {e}"
                continue
            if place:
                found.append((symbol, *place, name))
                missing.pop(symbol, None)
                break
            missing.setdefault(symbol, f"{name}: unknown")
    if wanted and len(missing) > budget * len(wanted):
        raise TooManyUnknown("; ".join(f"{s} ({why})" for s, why in sorted(missing.items())))
    if found:
        spark.createDataFrame(found, REGION).write.mode("append").parquet(path)
    whole = spark.read.schema(REGION).parquet(path) if found or there else known
    region = padded(F.col("start"), F.col("end"))
    return whole.where(F.col("symbol").isin(*wanted)).dropDuplicates(["symbol"]).select("symbol", "contig", region["start"].alias("start"), region["end"].alias("end"), "source")
