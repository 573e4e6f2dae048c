"""Generations, snapshots of equal bytes, digests of files of any size, and appends by many writers."""

import hashlib
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from chronospan.operators import ledger
from chronospan.schemas import LEDGER, SNAPSHOT
from chronospan.sources import digests, generations, snapshots, store
from tests.test_timeline import THREE
from tests.test_timeline import snapshots as raw_rows


def test_put_if_absent(spark, tmp_path):
    """Of many writers one makes the file, and it is whole."""
    path, made = str(tmp_path / "a b" / "x"), []
    writers = [threading.Thread(target=lambda k=k: made.append((k, generations.put_if_absent(spark, path, b"%d" % k * 5000)))) for k in range(8)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    won = [k for k, ok in made if ok]
    assert len(won) == 1 and (tmp_path / "a b" / "x").read_bytes() == b"%d" % won[0] * 5000
    assert os.listdir(tmp_path / "a b") == ["x"]


def test_generations(spark, tmp_path):
    root = str(tmp_path / "g")
    with pytest.raises(generations.Gone):
        generations.current(spark, root)
    folders = []
    for k in range(4):
        with generations.generation(spark, root) as new:
            spark.range(k).coalesce(1).write.parquet(f"{new}/t")
            with pytest.raises(generations.Gone) if k == 0 else memory(spark, root, folders[-1] if folders else None):
                generations.current(spark, root)
        folders.append(generations.current(spark, root))
    assert len(set(folders)) == 4 and spark.read.parquet(f"{folders[-1]}/t").count() == 3 and spark.read.parquet(f"{folders[-2]}/t").count() == 2
    assert len(generations.listed(spark, f"{root}/{generations.GENERATIONS}")) == 2
    # a writer that fails leaves the former one, and its number is not used again
    with pytest.raises(ValueError, match="boom"), generations.generation(spark, root) as new:
        spark.range(9).write.parquet(f"{new}/t")
        raise ValueError("boom")
    assert generations.current(spark, root) == folders[-1]
    with generations.generation(spark, root) as again:
        assert again > new
    # of two writers at once the one that began later holds, whichever ends first
    with generations.generation(spark, root) as early:
        with generations.generation(spark, root) as late:
            pass
    assert generations.current(spark, root) == late > early


class memory:  # noqa: N801
    """Inside it the current generation is the one given."""

    def __init__(self, spark, root, folder):
        self.args, self.folder = (spark, root), folder

    def __enter__(self):
        assert generations.current(*self.args) == self.folder

    def __exit__(self, *error):
        return False


@pytest.mark.parametrize("step", ["release", "assertion_span", "allele_dim", "policy_step", "commit"])
def test_a_crash_leaves_the_former_build(spark, tmp_path, monkeypatch, step):
    """Whatever table a build breaks off at, readers have the former one in all four."""
    root, rows = str(tmp_path / "w"), raw_rows(spark, THREE)
    store.build(rows.where("release_date < date'2026-01-01'"), root)
    before = {name: sorted(map(str, t.collect())) for name, t in store.stored_in(spark, root)._asdict().items()}
    if step == "commit":
        real = generations.put_if_absent
        monkeypatch.setattr(generations, "put_if_absent", lambda s, p, d=b"": broken() if "_commits" in p else real(s, p, d))
    else:
        from pyspark.sql import DataFrameWriter

        real = DataFrameWriter.parquet
        monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: broken() if path.endswith(step) else real(self, path, *a, **k))
    with pytest.raises(OSError, match="crash"):
        store.build(rows, root)
    monkeypatch.undo()
    assert {name: sorted(map(str, t.collect())) for name, t in store.stored_in(spark, root)._asdict().items()} == before
    assert store.build(rows, root).releases.count() == 3 == store.stored_in(spark, root).releases.count()


def broken():
    raise OSError("crash")


def test_readers_see_whole_builds(spark, tmp_path):
    """While builds with more and fewer releases swap, each reader's four tables are of one of them."""
    root, rows = str(tmp_path / "w"), raw_rows(spark, THREE)
    some = rows.where("release_date < date'2026-01-01'")
    state = lambda own: (own.releases.count(), own.spans.count(), own.dim.count(), tuple(sorted(map(str, own.steps.collect()))))
    whole = {state(store.build(some, str(tmp_path / "one"))), state(store.build(rows, root))}
    stop, seen = threading.Event(), []

    def read():
        while not stop.is_set():
            seen.append(state(store.stored_in(spark, root)))

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(3):
        store.build((some, rows)[k % 2], root)
    stop.set()
    reader.join()
    assert len(whole) == 2 and seen and set(seen) <= whole


def shuffled(spark, rows, seed, parts):
    own = list(rows)
    random.Random(seed).shuffle(own)
    return spark.createDataFrame(own, SNAPSHOT).repartition(parts)


def test_equal_rows_give_equal_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "FILE_ROWS", 300)
    rng = random.Random(4)
    rows = [(f"A{k}", None, rng.choice(["1", "17", None]), rng.choice([None, rng.randrange(1 << 28), rng.randrange(5)]), "A", "G", rng.choice(["g", None]), "BENIGN", 1, "x", None, None) for k in range(3000)]
    rows += rows[:50] + [(f"B{k}", None, "2", 7, "A", "G", None, "BENIGN", 1, "x", None, None) for k in range(1500)]  # one bin of half as many rows as all others
    digest = lambda root: {r["snapshot_id"]: r["found"] for r in snapshots.snapshot_hashes(spark, root).collect()}
    out = []
    for k, parts in enumerate((1, 7, 3)):
        root = str(tmp_path / str(k))
        snapshots.write_snapshot(shuffled(spark, rows, k, parts), root, "2020-01-01", "p")
        files = spark.read.parquet(root).select(F.input_file_name().alias("f"), "contig", "pos")
        sizes = [r["count"] for r in files.groupBy("f").count().collect()]
        assert len(sizes) >= 15 and max(sizes) <= 700 and sum(sizes) == len(rows)
        out.append((digest(root), sorted(hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / str(k)).rglob("*.parquet"))))
    assert out[0] == out[1] == out[2]
    other = [*rows[:-1], ("C", *rows[-1][1:])]
    snapshots.write_snapshot(shuffled(spark, other, 1, 3), str(tmp_path / "other"), "2020-01-01", "p")
    assert digest(str(tmp_path / "other")) != out[0][0]


def plain_digest(data, leaf):
    sums = [hashlib.sha256(data[k : k + leaf]).hexdigest() for k in range(0, max(1, len(data)), leaf)]
    return hashlib.sha256("\n".join(sums).encode()).hexdigest()


def test_digests(spark, tmp_path):
    """Equal for any size of splits, and whether a file is read whole or in ranges; a file without a byte isn't listed."""
    rng, want = random.Random(6), {}
    for name, n in (("b", 1), ("c d", 1000), ("e", 1024), ("f", 50_001)):
        data = rng.randbytes(n)
        (tmp_path / f"{name}.parquet").write_bytes(data)
        want[name] = plain_digest(data, 1000)
    (tmp_path / "x.txt").write_bytes(b"not asked for")
    for whole, split in ((10**6, 1), (900, 1), (900, 3000), (0, 7000), (0, 10**6)):
        got = digests.file_digests(spark, str(tmp_path), leaf=1000, split=split, whole=whole)
        assert {r["path"].rsplit("/", 1)[1].removesuffix(".parquet").replace("%20", " "): r["digest"] for r in got.collect()} == want


def test_digest_of_a_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file of 3 GB: no row or task holds it."""
    size = (3 << 30) + 5
    with open(tmp_path / "big.parquet", "wb") as f:
        f.truncate(size)
    empty, tail = hashlib.sha256(bytes(1 << 20)).hexdigest(), hashlib.sha256(bytes(5)).hexdigest()
    want = hashlib.sha256("\n".join([empty] * (3 << 10) + [tail]).encode()).hexdigest()
    assert [r["digest"] for r in digests.file_digests(spark, str(tmp_path)).collect()] == [want]


def test_eight_writers_make_one_chain(spark, tmp_path):
    root, failed = str(tmp_path / "ledger"), []

    def write(k):
        try:
            for n in range(3):
                ledger.append_to(spark, root, "lab a/b", f"A{k}", f"c{n}", "ACT", f"warum {k} ü\n", "me", "s")
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    ledger.append_to(spark, root, "other", "A", "c", "DEFER", "x", "me", "s")
    own = ledger.stored(spark, root)
    assert not failed and own.schema.fieldNames() == LEDGER.fieldNames()
    assert {r["tenant_id"]: (r["intact"], r["first_bad_seq"]) for r in ledger.verify(own).collect()} == {"lab a/b": (True, None), "other": (True, None)}
    mine = own.where("tenant_id = 'lab a/b'").orderBy("seq").collect()
    assert [r["seq"] for r in mine] == list(range(1, 25)) and len({(r["allele_id"], r["case_ref"]) for r in mine}) == 24
    with pytest.raises(ValueError, match="verdict"):
        ledger.append_to(spark, root, "other", "A", "c", "MAYBE", "x", "me", "s")
