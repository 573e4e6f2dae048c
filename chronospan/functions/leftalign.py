"""SCL-9, SCL-10, SRC-19: indels moved as far left as a reference sequence lets them, in column expressions.

A reference is a table of stretches (contig, start, bases), 1-based; they may
adjoin and overlap, and where they do the first by (start, bases) tells the base.  For alignment
it is dealt into tiles of equal length, each with a halo of the bases on its left:
a row meets its tile by equality of (contig, tile), so each row comes out once, and
stretches' borders are seen nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospan.operators.timeline import small

MAX_SHIFT = 500
#: Bases of a tile; tiles up to which a counted table is broadcast.
TILE, SMALL_TILES = 8192, 1000
STRETCH = "contig string, start long, bases string"


def kept_stretches(spark: SparkSession, path: str, regions: list[tuple[str, int, int]], read: Callable[[str, int, int], str]) -> DataFrame:
    """SRC-19: the stretches of ``path``; those of ``regions`` (contig, start, end) that it lacks are read and appended, as many as a panel has."""
    from chronospan.sources.snapshots import _exists

    there = {(r["contig"], r["start"], r["n"]) for r in spark.read.parquet(path).select("contig", "start", F.length("bases").alias("n")).collect()} if _exists(spark, path) else set()
    new = [(c, s, read(c, s, e)) for c, s, e in regions if (c, s, e - s + 1) not in there]
    if new or not there:
        spark.createDataFrame(new, STRETCH).write.mode("append").parquet(path)
    return spark.read.schema(STRETCH).parquet(path)


def _bare(contig: Column) -> Column:
    return F.regexp_replace(contig, "^chr", "")


def _laid(pieces: Column, length: int) -> Column:
    """One string of pieces (at, bases) in order of ``at``: what a former piece covers stands, what none covers is a dot."""
    put = lambda done, x: F.when(
        x["at"] + F.length(x["bases"]) > F.length(done),
        F.concat(done, F.repeat(F.lit("."), (x["at"] - F.length(done)).cast("int")), F.substring(x["bases"], F.greatest(F.length(done) - x["at"], F.lit(0)).cast("int") + 1, F.length(x["bases"]))),
    ).otherwise(done)
    return F.rpad(F.aggregate(F.array_sort(pieces), F.lit(""), put), length, ".")


def tiled(reference: DataFrame, size: int = TILE, halo: int = MAX_SHIFT + 1) -> DataFrame:
    """on (the contig without ``chr``), tile and text: the bases of positions tile * size + 1 - halo to (tile + 1) * size, A, C, G, T or a dot.

    Dots are what no stretch covers and what is no base.  Tiles without a base of their own are left out.
    """
    own = reference.select(_bare(F.col("contig")).alias("on"), F.col("start").cast("long").alias("start"), F.regexp_replace(F.upper("bases"), "[^ACGT]", ".").alias("bases"))
    own = own.where("length(bases) > 0 AND start > 0")
    lead = ((F.col("start") - 1) % size).cast("int")
    cut = F.posexplode(F.regexp_extract_all(F.concat(F.repeat(F.lit(" "), lead), "bases"), F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))).alias("i", "piece")
    cut_up = own.select("on", "start", lead.alias("lead"), cut).select("on", (F.floor((F.col("start") - 1) / size) + F.col("i")).alias("tile"), F.when(F.col("i") == 0, F.col("lead")).otherwise(0).alias("at"), F.col("start"), F.ltrim("piece").alias("bases"))
    whole = cut_up.groupBy("on", "tile").agg(_laid(F.collect_list(F.struct("at", "start", "bases")), size).alias("bases"))
    # a tile's halo comes from as many tiles on its left as the halo reaches
    back = -(-halo // size)
    part = lambda k: F.struct((F.col("tile") + k).alias("tile"), F.lit((back - k) * size).alias("at"), F.col("bases").alias("bases"), F.lit(k == 0).alias("own"))
    parts = whole.select("on", F.explode(F.array(*[part(k) for k in range(back + 1)])).alias("x")).select("on", "x.*")
    text = F.right(_laid(F.collect_list(F.struct("at", "bases")), (back + 1) * size), F.lit(size + halo))
    return parts.groupBy("on", "tile").agg(text.alias("text"), F.max("own").alias("own")).where("own").drop("own")


def _alike(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    other = F.array_position(F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: x != y), True)
    return F.when(n <= 0, 0).when(other == 0, n).otherwise(other - 1).cast("int")


def _at(text: Column, first: Column, pos: Column) -> Column:
    """The base of a text that begins at position ``first``; null outside it and at a dot."""
    base = F.substring(text, (pos - first + 1).cast("int"), F.lit(1))
    return F.when((pos >= first) & (pos < first + F.length(text)) & base.isin(*"ACGT"), base)


def base_at(pos: Column) -> Column:
    """SCL-10: the base of a stretch (start, bases) at a position; null outside it or where it is none of ACGT."""
    return _at(F.upper("bases"), F.col("start"), pos)


def left_aligned(rows: DataFrame, reference: DataFrame, most: int = MAX_SHIFT, size: int = TILE) -> DataFrame:
    """Adds ``aligned`` (pos, ref, alt, covered): the leftmost form; null if both alleles are equal.  One row comes out for each row.

    A substitution is only put in upper case.  Outside the reference an indel
    stays without its padding base, so its identity differs from the padded
    one's; ``covered`` tells whether the reference has its place.  The halo is one
    base longer than the longest shift, so no row runs out of its tile's text.
    """
    halo = most + 1
    names = rows.columns
    own = rows.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), _bare(F.col("contig")).alias("on"), F.col("pos").cast("long").alias("pos"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt"))
    tail = _alike(F.reverse("ref"), F.reverse("alt"))
    own = own.withColumn("tail", tail).withColumn("a", F.left("ref", F.length("ref") - F.col("tail"))).withColumn("b", F.left("alt", F.length("alt") - F.col("tail")))
    own = own.withColumn("head", _alike(F.col("a"), F.col("b"))).withColumn("p", F.col("pos") + F.col("head"))
    rest = lambda c: F.substring(F.col(c), F.col("head") + 1, F.length(c))
    own = own.withColumn("a", rest("a")).withColumn("b", rest("b"))
    indel = (F.length("a") == 0) != (F.length("b") == 0)
    own = own.withColumn("unit", F.when(indel, F.concat("a", "b"))).withColumn("n", F.greatest(F.length("unit"), F.lit(1))).withColumn("tile", F.floor((F.col("p") - 1) / size))
    own = own.join(small(tiled(reference, size, halo), SMALL_TILES), ["on", "tile"], "left").withColumn("first", F.col("tile") * size + 1 - halo)
    # bases on the left, nearest first, against the unit repeated backwards: each equal one is a step
    room = F.when(F.col("unit").isNotNull() & F.col("text").isNotNull(), F.least(F.lit(most), F.col("p") - 1)).otherwise(0)
    own = own.withColumn("room", F.greatest(room, F.lit(0)).cast("int"))
    before = F.reverse(F.substring("text", (F.col("p") - F.col("first") + 1).cast("int") - F.col("room"), F.col("room")))
    backwards = F.left(F.repeat(F.reverse("unit"), F.ceil(F.col("room") / F.col("n")).cast("int")), F.col("room"))
    own = own.withColumn("k", F.when(F.col("room") > 0, _alike(before, backwards)).otherwise(0)).withColumn("q", F.col("p") - F.col("k"))
    turn = F.col("k") % F.col("n")
    own = own.withColumn("unit", F.concat(F.right("unit", turn), F.left("unit", F.length("unit") - turn)))
    base = lambda pos: _at(F.col("text"), F.col("first"), pos)
    own = own.withColumn("pad", F.when(F.col("q") > 1, base(F.col("q") - 1))).withColumn("here", base(F.col("q")))
    form = lambda pos, ref, alt, covered: F.struct(pos.cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt"), covered.alias("covered"))
    pad, padded = F.coalesce("pad", F.lit("")), F.col("pad").isNotNull()
    unit = lambda side: F.concat(pad, F.when(F.length(side) > 0, F.col("unit")).otherwise(F.lit("")))
    aligned = (
        F.when(F.length("ref") == F.length("alt"), form(F.col("pos"), F.col("ref"), F.col("alt"), F.lit(True)))
        .when(F.col("unit").isNull(), form(F.col("p"), F.col("a"), F.col("b"), F.col("here").isNotNull()))
        .when(F.col("unit") != "", form(F.when(padded, F.col("q") - 1).otherwise(F.col("q")), unit("a"), unit("b"), padded | F.col("here").isNotNull()))
    )
    return own.select("row.*", F.when(F.length("ref").isNotNull() & F.length("alt").isNotNull(), aligned).alias("aligned"))
