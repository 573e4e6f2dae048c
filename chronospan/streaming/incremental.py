"""An extension: snapshots that arrive as a stream keep a timeline up to date, release by release (QRY-1, SNK-5).

The stored timeline is a list of parts: for each panel its releases, its current
spans, and its closed spans in buckets of alleles.  An update is a generation that
names the parts that hold from then on; parts that it doesn't change are named
again and not written.

* A release later than all of its panel meets the current spans alone: equal states
  are extended, others are closed and opened anew; closed spans are only added to.
* Any other rows (an earlier release, more rows of a known one) touch the alleles
  whose span at that release they contradict.  Those alleles' spans are built
  again from their raw rows; a bucket without such an allele keeps its parts.

Of rows of one panel, release and allele the first that came holds, so a release
may come in several batches, and a batch that runs again adds nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronospan.functions.alleles import ABSENT, OPEN_END
from chronospan.operators.timeline import DIMENSION, KEY, SPAN, sparse_spans
from chronospan.sources import generations
from chronospan.sources.snapshots import _exists

ROW = ["panel", "release_date", "allele_id"]
BUCKETS = 16
PARTS = "parts.json"
#: What a span tells of its own; the dimension is the current span's.
OWN = [c for c in SPAN if c not in (*KEY, *DIMENSION)]


def parts_of(spark: SparkSession, folder: str) -> dict:
    """The parts of a generation: by panel ``releases``, ``current``, and ``closed`` by bucket."""
    return json.loads(spark.read.text(f"{folder}/{PARTS}", wholetext=True).first()[0])


def known(spark: SparkSession, root: str) -> dict:
    try:
        return parts_of(spark, generations.current(spark, root))
    except generations.Gone:
        return {}


def _read(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def spans_of(spark: SparkSession, parts: dict, schema, panels: Iterable[str] | None = None) -> DataFrame:
    """The spans of some panels, or all; ``schema``: that of spans."""
    own = [parts[p] for p in (parts if panels is None else panels) if p in parts]
    current = _read(spark, [p["current"] for p in own], schema)
    closed = _read(spark, [x for p in own for paths in p["closed"].values() for x in paths], schema)
    return closed.drop(*DIMENSION).join(current.select(*KEY, *DIMENSION), [*KEY]).select(*SPAN).unionByName(current)


def stored_spans(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """The spans of the timeline at ``root`` as committed now."""
    parts = parts_of(spark, generations.current(spark, root))
    return spans_of(spark, parts, schema or spark.read.parquet(next(iter(parts.values()))["current"]).schema)


def moved_on(current: DataFrame, rows: DataFrame, release: date, first: date | None, before: date | None) -> DataFrame:
    """Current spans and the rows of a later release of their panel: the spans that follow from them, closed and current.

    ``first`` and ``before``: the panel's first release and its last one so far, None if there is none.
    """
    day, end = F.lit(release), F.lit(OPEN_END).cast("date")
    seen = rows.select(*KEY, F.struct("bucket", "stars", "clnsig_raw", "clnrevstat_raw", "snapshot_id", *DIMENSION).alias("o"))
    both = current.select(*KEY, F.struct(*DIMENSION, *OWN).alias("c")).join(seen, [*KEY], "full")
    o, c = F.col("o"), F.col("c")
    there, held = o.isNotNull(), c.isNotNull()
    bucket, stars = F.coalesce(o["bucket"], F.when(~there, F.lit(ABSENT))), F.coalesce(o["stars"], F.when(~there, F.lit(-1))).cast("byte")
    same = held & c["bucket"].eqNullSafe(bucket) & c["stars"].eqNullSafe(stars)
    latest = F.when(there, F.struct(*(o[x].alias(x) for x in DIMENSION))).otherwise(F.struct(*(c[x].alias(x) for x in DIMENSION)))

    def span(**own: Column) -> Column:
        return F.struct(latest.alias("d"), *(own[x].cast(current.schema[x].dataType).alias(x) for x in OWN))

    of = lambda **other: {x: c[x] for x in OWN} | other
    raw = {"clnsig_raw": o["clnsig_raw"], "clnrevstat_raw": o["clnrevstat_raw"]}
    none = F.lit(None)
    # of equal states the first value that was observed holds
    extended = span(**of(last_seen=day, **{x: F.coalesce(c[x], v) for x, v in raw.items()}, first_snapshot_id=F.least(c["first_snapshot_id"], o["snapshot_id"])))
    closed = span(**of(valid_to=day, is_current=F.lit(False)))
    opened = span(bucket=bucket, stars=stars, **raw, valid_from=day, valid_to=end, last_seen=day, first_snapshot_id=o["snapshot_id"], is_current=F.lit(True))
    lead = span(bucket=F.lit(ABSENT), stars=F.lit(-1), clnsig_raw=none, clnrevstat_raw=none, valid_from=F.lit(first), valid_to=day, last_seen=F.lit(before), first_snapshot_id=none, is_current=F.lit(False))
    fresh = F.array(lead, opened) if first is not None else F.array(opened)
    spans = F.when(same, F.array(extended)).when(held, F.array(closed, opened)).otherwise(fresh)
    return both.select(*KEY, F.explode(spans).alias("s")).select(*KEY, "s.d.*", *(f"s.{x}" for x in OWN)).select(*SPAN)


def touched(spans: DataFrame, rows: DataFrame, release: date, new: bool) -> DataFrame:
    """The alleles whose span at a release the rows of that release contradict or say more of; without a span there, all that have rows.

    ``new``: the panel hadn't that release, so an allele without a row is absent there.
    """
    at = F.lit(release)
    covering = spans.where((F.col("valid_from") <= at) & (F.col("valid_to") > at)).select(*KEY, F.struct("bucket", "stars", "clnsig_raw", "clnrevstat_raw", "first_snapshot_id", "last_seen").alias("c"))
    seen = rows.select(*KEY, F.struct("bucket", "stars", "clnsig_raw", "clnrevstat_raw", "snapshot_id").alias("o"))
    if not new:
        return seen.select(*KEY)
    both = spans.where("is_current").select(*KEY).join(covering, [*KEY], "left").join(seen, [*KEY], "full")
    o, c = F.col("o"), F.col("c")
    state = F.struct(F.when(o.isNull(), F.lit(ABSENT)).otherwise(o["bucket"]).alias("bucket"), F.when(o.isNull(), F.lit(-1)).otherwise(o["stars"]).cast("byte").alias("stars"))
    more = F.lit(False)
    for x in ("clnsig_raw", "clnrevstat_raw"):
        more = more | (o[x].isNotNull() & ~o[x].eqNullSafe(c[x]))  # it may be earlier than the first value that was observed
    other = ~F.struct(c["bucket"].alias("bucket"), c["stars"].alias("stars")).eqNullSafe(state) | more | (c["last_seen"] < at) | F.coalesce(o["snapshot_id"] < c["first_snapshot_id"], F.lit(False))
    return both.where(c.isNull() | other).select(*KEY)


class Update:
    """One generation of the timeline at ``root``: releases are merged in, then what changed is named."""

    def __init__(self, spark: SparkSession, root: str, folder: str, span_schema):
        self.spark, self.folder, self.span_schema = spark, folder, span_schema
        self.parts, self.n = known(spark, root), 0

    def _written(self, rows: DataFrame, name: str) -> str:
        self.n += 1
        path = f"{self.folder}/{self.n:04d}-{name}"
        rows.write.parquet(path)
        return path

    def _closed(self, rows: DataFrame) -> dict[str, list[str]]:
        """Closed spans written by bucket; a path for each bucket that has some."""
        self.n += 1
        path = f"{self.folder}/{self.n:04d}-closed"
        rows.withColumn("in_bucket", F.pmod(F.xxhash64("allele_id"), F.lit(BUCKETS))).write.partitionBy("in_bucket").parquet(path)
        return {n.removeprefix("in_bucket="): [f"{path}/{n}"] for n in generations.listed(self.spark, path) if n.startswith("in_bucket=")}

    def merge(self, panel: str, release: date, rows: DataFrame, raw: DataFrame) -> None:
        """Merges new rows of one release of a panel; ``raw`` has all rows, these too."""
        own = self.parts.get(panel, {"releases": [], "current": None, "closed": {}})
        days = [date.fromisoformat(x) for x in own["releases"]]
        new = release not in days
        if new and (not days or release > days[-1]):
            current = _read(self.spark, [own["current"]] if own["current"] else [], self.span_schema)
            path = self._written(moved_on(current, rows, release, days[0] if days else None, days[-1] if days else None), "step")
            made = self.spark.read.schema(self.span_schema).parquet(path)
            closed = self._added(own["closed"], made.where("NOT is_current"))
            current_path = self._written(made.where("is_current"), "current")
        else:
            spans = spans_of(self.spark, {panel: own}, self.span_schema)
            alleles = self.spark.read.parquet(self._written(touched(spans, rows, release, new).distinct(), "touched"))
            dates = self.spark.createDataFrame([(panel, x) for x in sorted({*days, release})], "panel string, release_date date")
            path = self._written(sparse_spans(raw.where(F.col("panel") == panel).join(alleles, [*KEY], "left_semi"), dates).select(*SPAN), "rebuilt")
            made = self.spark.read.schema(self.span_schema).parquet(path)
            hit = {str(r[0]) for r in alleles.select(F.pmod(F.xxhash64("allele_id"), F.lit(BUCKETS))).distinct().collect()}
            old = _read(self.spark, [x for b in hit for x in own["closed"].get(b, [])], self.span_schema).join(alleles, [*KEY], "left_anti")
            closed = {b: paths for b, paths in own["closed"].items() if b not in hit} | self._closed(old.unionByName(made.where("NOT is_current")))
            current = _read(self.spark, [own["current"]], self.span_schema).join(alleles, [*KEY], "left_anti").unionByName(made.where("is_current"))
            current_path = self._written(current, "current")
        self.parts[panel] = {"releases": [x.isoformat() for x in sorted({*days, release})], "current": current_path, "closed": closed}

    def _added(self, closed: dict[str, list[str]], rows: DataFrame) -> dict[str, list[str]]:
        out = {b: list(paths) for b, paths in closed.items()}
        for b, paths in self._closed(rows).items():
            out.setdefault(b, []).extend(paths)
        return out

    def commit(self) -> None:
        generations.put_if_absent(self.spark, f"{self.folder}/{PARTS}", json.dumps(self.parts).encode())


def merged(spark: SparkSession, rows: DataFrame, raw: str, root: str) -> None:
    """Brings the timeline at ``root`` up to date with the rows that the raw table lacks, then appends them to it.

    If it breaks off in between, the rows are merged again next time, which changes nothing.
    """
    rows, schema = rows.dropDuplicates(ROW), rows.schema
    before = spark.read.schema(schema).parquet(raw) if _exists(spark, raw) else spark.createDataFrame([], schema)
    span_schema = sparse_spans(spark.createDataFrame([], schema), spark.createDataFrame([], "panel string, release_date date")).schema
    with generations.generation(spark, root, keep=0) as folder:
        own = Update(spark, root, folder, span_schema)
        fresh = spark.read.schema(schema).parquet(own._written(rows.join(before.select(*ROW), ROW, "left_anti"), "rows"))
        for r in fresh.select("panel", "release_date").distinct().orderBy("panel", "release_date").collect():
            of_release = (F.col("panel") == r["panel"]) & (F.col("release_date") == F.lit(r["release_date"]))
            own.merge(r["panel"], r["release_date"], fresh.where(of_release), before.unionByName(fresh))
        own.commit()
    fresh.write.mode("append").partitionBy("panel", "release_date").parquet(raw)
    prune(spark, root)


def prune(spark: SparkSession, root: str) -> None:
    """Deletes the generations that neither of the last two names parts of."""
    last = generations.committed(spark, root)[-generations.KEPT :]
    named = "\n".join(json.dumps(parts_of(spark, f"{root}/{generations.GENERATIONS}/{n}")) for n in last)
    for name in generations.listed(spark, f"{root}/{generations.GENERATIONS}"):
        if name < last[-1] and name not in last and f"/{name}/" not in named:
            p, fs = generations.located(spark, f"{root}/{generations.GENERATIONS}/{name}")
            fs.delete(p, True)


def follow(spark: SparkSession, source: str, schema, raw: str, spans: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads snapshot rows (with panel and release_date) from ``source``; ``raw`` is a partitioned table, ``spans`` a timeline."""
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            merged(spark, rows, raw, spans)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
