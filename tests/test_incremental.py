"""The timeline kept up to date release by release is that of a full build, whatever the order of arrival."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from chronospan.operators.timeline import sparse_spans
from chronospan.sources import generations
from chronospan.streaming import incremental

SCHEMA = "allele_id string, variation_id string, gene string, contig string, pos long, ref string, alt string, bucket string, stars byte, clnsig_raw string, clnrevstat_raw string, condition string, panel string, release_date date, snapshot_id string"
DAYS = [date(2015 + k, 1 + k, 3) for k in range(5)]


def random_rows(rng, panel, alleles=25):
    out = []
    for a in range(alleles):
        bucket, stars, gene = rng.choice("UPB"), 1, "G"
        for day in DAYS:
            if rng.random() < 0.4:
                bucket, stars = rng.choice("UPB"), rng.randint(0, 2)
            if rng.random() < 0.2:
                gene = rng.choice("GHI")
            if rng.random() < 0.7:
                out.append((f"A{a}", f"v{rng.randrange(3)}", gene, "17", a, "A", "G", bucket, stars, rng.choice([None, bucket.lower(), "x"]), rng.choice([None, "r"]), rng.choice([None, "c"]), panel, day, f"snapshot-{panel}-{day:%Y%m%d}"))
    return out


def state(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("seed", [2, 3])
def test_any_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, "p", 10)
    batches = [(day, [r for r in rows if r[-2] == day]) for day in rng.sample(DAYS, len(DAYS))]
    if seed == 3:  # a release in two parts, and two releases at once
        day, own = batches.pop()
        batches = [(day, own[::2]), (None, batches[0][1] + batches[1][1]), *batches[2:], (day, own[1::2])]
    raw, root, seen = str(tmp_path / "raw"), str(tmp_path / "t"), []
    for _, own in batches:
        seen += own
        incremental.merged(spark, spark.createDataFrame(own + own[:2], SCHEMA), raw, root)
        want = sparse_spans(spark.createDataFrame(seen, SCHEMA))
        assert state(incremental.stored_spans(spark, root)) == state(want)
    assert spark.read.parquet(raw).count() == len(rows)


def test_what_is_not_written(spark, tmp_path):
    """A later release leaves closed spans and other panels as they are; one that tells nothing new touches no allele; a batch that comes again changes nothing."""
    rng = random.Random(9)
    raw, root = str(tmp_path / "raw"), str(tmp_path / "t")
    one, two = random_rows(rng, "p"), random_rows(rng, "q")
    of = lambda rows, days: spark.createDataFrame([r for r in rows if r[-2] in days], SCHEMA)
    incremental.merged(spark, of(one, DAYS[:3]).unionByName(of(two, DAYS)), raw, root)
    before = incremental.known(spark, root)
    incremental.merged(spark, of(one, DAYS[3:4]), raw, root)
    after = incremental.known(spark, root)
    assert after["q"] == before["q"] and all(after["p"]["closed"][b][: len(x)] == x for b, x in before["p"]["closed"].items())
    incremental.merged(spark, of(one, DAYS[3:4]), raw, root)
    assert incremental.known(spark, root) == after
    # a release between two others that says what they say
    day = date(2016, 6, 6)
    spans = incremental.stored_spans(spark, root).where(F.col("panel") == "p")
    at = spans.where((F.col("valid_from") <= F.lit(day)) & (F.col("valid_to") > F.lit(day)) & (F.col("bucket") != "ABSENT") & (F.col("last_seen") > F.lit(day)))
    same = [(r["allele_id"], r["variation_id"], r["gene"], "17", r["pos"], "A", "G", r["bucket"], r["stars"], r["clnsig_raw"], r["clnrevstat_raw"], None, "p", day, "snapshot-p-20160606") for r in at.collect()]
    hit = incremental.touched(spans, spark.createDataFrame(same, SCHEMA), day, True)
    assert {r["allele_id"] for r in hit.collect()}.isdisjoint({r[0] for r in same})
    assert len(generations.listed(spark, f"{root}/{generations.GENERATIONS}")) <= 4


def test_a_crash_before_the_rows_are_kept(spark, tmp_path, monkeypatch):
    """A batch that breaks off after the commit, or before it, comes out right when it runs again."""
    rng = random.Random(10)
    rows = random_rows(rng, "p")
    raw, root = str(tmp_path / "raw"), str(tmp_path / "t")
    of = lambda days: spark.createDataFrame([r for r in rows if r[-2] in days], SCHEMA)
    incremental.merged(spark, of(DAYS[:2]), raw, root)
    for where in ("commit", "raw"):
        days = DAYS[2:4] if where == "commit" else DAYS[4:]
        with monkeypatch.context() as m:
            if where == "commit":
                m.setattr(incremental.Update, "commit", lambda self: (_ for _ in ()).throw(OSError("crash")))
            else:
                m.setattr(incremental, "prune", lambda *a: None)
                from pyspark.sql import DataFrameWriter

                append = DataFrameWriter.parquet
                m.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (_ for _ in ()).throw(OSError("crash")) if path == raw else append(self, path, *a, **k))
            with pytest.raises(OSError, match="crash"):
                incremental.merged(spark, of(days), raw, root)
        incremental.merged(spark, of(days), raw, root)
        seen = [r for r in rows if r[-2] <= days[-1]]
        assert state(incremental.stored_spans(spark, root)) == state(sparse_spans(spark.createDataFrame(seen, SCHEMA)))
        assert spark.read.parquet(raw).count() == len(seen)
