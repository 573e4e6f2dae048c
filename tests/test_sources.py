"""The indexed source, snapshots, manifests and the stream, on files made here."""

import http.server
import random
import re
import shutil
import struct
import threading
import zlib

import pytest
from pyspark.sql import functions as F

from chronospan.schemas import MANIFEST, SNAPSHOT
from chronospan.sources import blocks, fetch, generations, genes, indexed, releases, snapshots
from chronospan.sources.ingest import ingest
from chronospan.streaming.incremental import follow, stored_spans
from tests.test_timeline import THREE, listed
from tests.test_timeline import snapshots as raw_rows


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    extra = b"BC\x02\x00" + struct.pack("<H", len(body) + 25)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 6) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


def index_bytes(names, chunks, linear):
    blob = b"".join(n.encode() + b"\0" for n in names)
    out = indexed.MAGIC + struct.pack("<8i", len(names), 2, 1, 2, 0, 35, 0, len(blob)) + blob
    for own, steps in zip(chunks, linear, strict=True):
        out += struct.pack("<i", len(own))
        for number, parts in own.items():
            out += struct.pack("<Ii", number, len(parts)) + b"".join(struct.pack("<QQ", *p) for p in parts)
        out += struct.pack("<i", len(steps)) + struct.pack(f"<{len(steps)}Q", *steps)
    return out


def test_bins():
    assert indexed.bins_of(5, 5) == [0] and indexed.bins_of(0, 1) == [0, 1, 9, 73, 585, 4681]
    assert indexed.bins_of(0, 1 << 14)[-1] == 4681 and indexed.bins_of(0, (1 << 14) + 1)[-2:] == [4681, 4682]
    assert indexed.block_of((77 << 16) + 5) == (77, 5)


def test_members():
    a, b = member(b"one\ntwo\nth"), member(b"ree\nfour")
    assert blocks.inflated(a + b) == b"one\ntwo\nthree\nfour"
    assert blocks.inflated(a + b[:5]) == b"one\ntwo\nth" and blocks.inflated(b"junk") == b"" and blocks.inflated(b"") == b""


def test_index_plan():
    index = indexed.Index(index_bytes(["17", "chrX"], [{4681: [(0, 10 << 16)], 4682: [(10 << 16, 30 << 16)], 0: [(200_000 << 16, 200_001 << 16)]}, {}], [(5 << 16, 10 << 16), ()]))
    assert index.named("chr17") == ["17"] and index.named("X") == ["chrX"] and index.named("9") == []
    assert index.plan("17", 0, 100) == [(5 << 16, 10 << 16), (200_000 << 16, 200_001 << 16)]
    assert index.plan("17", 20_000, 20_100) == [(10 << 16, 30 << 16), (200_000 << 16, 200_001 << 16)]
    assert index.byte_ranges("17", 0, 20_000) == [(5, 30 + 65535), (200_000, 200_001 + 65535)] and index.byte_ranges("9", 0, 9) == []
    assert index.cut([(5 << 16, 30 << 16), (200_000 << 16, 200_001 << 16)], 5) == [[(5 << 16, 10 << 16)], [(10 << 16, 30 << 16)], [(200_000 << 16, 200_001 << 16)]]
    assert index.cut([(5 << 16, 30 << 16), (40 << 16, 50 << 16)], 1 << 20) == [[(5 << 16, 30 << 16), (40 << 16, 50 << 16)]]
    with pytest.raises(ValueError, match="index"):
        indexed.Index(b"nope")


def test_united():
    """As a set of integers says, for random ranges."""
    rng = random.Random(5)
    for _ in range(300):
        ranges = [(a, a + rng.randint(0, 6)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 9)))]
        got = indexed.united(ranges, gap=1)
        inside = {x for a, b in ranges for x in range(a, b + 1)}
        assert {x for a, b in got for x in range(a, b + 1)} == inside and all(b + 1 < c for (_, b), (c, _) in zip(got, got[1:]))


def test_bins_of_columns(spark):
    rows = [(0, 0), (5, 5), (0, 1), (16_383, 16_385), (1 << 20, (1 << 20) + 300_000), (9, 7), ((1 << 29) - 5, 1 << 29)]
    own = spark.createDataFrame(rows, "b long, e long")
    got = own.select("b", "e", indexed.bins_column(F.col("b"), F.col("e")).alias("bins")).collect()
    assert all(r["bins"] == indexed.bins_of(r["b"], r["e"]) for r in got)


def test_bins_of_wide_regions_are_small_on_disk(spark, tmp_path):
    """A thousand bins a region: neighbours lie side by side, so a bin takes under two bytes (four when dealt by hash); equal rows count once."""
    from chronospan.queries import QUERIES

    k = F.col("id")
    own = spark.range(6000).select((k * 7919 % 6001).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (k % 600 * 1000).alias("l_partkey"), (k % 50 * 1200).alias("l_suppkey"))
    own.unionByName(own.where("l_suppkey = 1200")).repartition(5).write.parquet(str(tmp_path / "lineitem.parquet"))
    QUERIES["region_bins"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    want = sum(len(indexed.bins_of(r[0], r[1])) for r in own.where("l_suppkey > 0").select(F.col("l_partkey") * 100000, F.col("l_partkey") * 100000 + F.col("l_suppkey") * 500).collect())
    assert out.count() == want == out.distinct().count()
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 2.5 * want


def test_bins_count(spark):
    own = spark.createDataFrame([(0, 0), (0, 1), (0, 1 << 14), (0, (1 << 14) + 1), (99_999, 70_000_000)], "b long, e long")
    assert all(n == len(indexed.bins_of(b, e)) for b, e, n in own.select("b", "e", indexed.bins_count(F.col("b"), F.col("e"))).collect())


def test_indexed_source(spark, tmp_path):
    line = lambda pos: f"17\t{pos}\t{pos}\tA\tG\t.\t.\tCLNSIG=Benign\n".encode()
    blocks = [b"#head\n" + b"".join(line(p) for p in range(1000, 1050)), b"".join(line(p) for p in range(20_000, 20_050)), b"".join(line(p) for p in range(40_000, 40_050))]
    data, at = b"", []
    for b in blocks:
        at.append(len(data))
        data += member(b)
        data += member(bytes(70_000).replace(b"\0", b"\n"))  # blank lines keep the ranges apart
    (tmp_path / "v.gz").write_bytes(data)
    ends = [*at[1:], len(data)]
    chunks = {4681 + k: [(a << 16, e << 16)] for k, (a, e) in enumerate(zip(at, ends, strict=True))}
    (tmp_path / "v.gz.tbi").write_bytes(member(index_bytes(["17"], [chunks], [tuple(a << 16 for a in at)])))
    spark.dataSource.register(indexed.IndexedVcf)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own = spark.read.format("indexed_vcf").option("path", str(tmp_path / "v.gz")).load()
    assert own.count() == 150
    got = own.where("contig = '17' AND pos BETWEEN 20010 AND 20019")
    assert sorted(r["pos"] for r in got.collect()) == list(range(20_010, 20_020))
    assert own.where("contig = '3'").count() == 0
    reader = indexed._Reader(str(tmp_path / "v.gz"), str(tmp_path / "v.gz.tbi"), 1 << 20)
    reader.contig, reader.low, reader.high = "17", 20_010, 20_019
    assert [p.ranges for p in reader.partitions()] == [[(at[1] << 16, at[2] << 16)]]
    regions = [("chr17", 20_010, 20_019), ("17", 20_015, 20_020), ("5", 1, 9)]
    rows, sent = indexed.fetched_lines(spark, str(tmp_path / "v.gz"), regions, str(tmp_path / "lines"))
    assert rows.count() == 11 and sent > len((tmp_path / "v.gz.tbi").read_bytes())
    rows, _ = indexed.fetched_lines(spark, str(tmp_path / "v.gz"), [("5", 1, 9)], str(tmp_path / "none"))
    assert rows.count() == 0


def blocked(rng, text):
    """A text in members of random sizes, some empty, some with bytes that look like a header; and their starts."""
    out, starts, at = b"", [], 0
    while at < len(text):
        n = rng.choice([0, 1, 7, 300, 20_000])
        starts.append(len(out))
        out += member(text[at : at + n])
        at += n
    return out, starts


@pytest.mark.parametrize("end", [b"", b"\n", b"\n\n"])
def test_splits_give_each_line_once(tmp_path, end):
    """Any size of splits gives the lines of one task, in order, a last line without a line break too."""
    rng = random.Random(len(end))
    noise = bytes(rng.randrange(256) for _ in range(3000)).replace(b"\n", b" ")
    text = b"\n".join(rng.choice([b"", b"x", b"some line", noise[: rng.randint(0, 3000)], blocks.HEADER + noise[:50], noise * 30]) for _ in range(220)) + end
    data, _ = blocked(rng, text)
    path = str(tmp_path / "v.gz")
    (tmp_path / "v.gz").write_bytes(data)
    want = text.split(b"\n")
    want = want if want[-1] else want[:-1]
    for split in (1, 100, 5000, 70_000, len(data) // 2, len(data) + 9) if len(end) else (5000, 70_001, 1 << 30):
        if split == 1:
            parts = [(s, s + 1) for s in range(0, len(data), 997)]  # most bytes begin no member
            assert set(x for s, e in parts for x in blocks.lines_of_split(blocks.ByteFile(path), len(data), s, e)) <= set(want)
            continue
        got = [x for s, e in blocks.splits(len(data), split if split > 100 else 4000) for x in blocks.lines_of_split(blocks.ByteFile(path), len(data), s, e)]
        assert got == want


def test_first_block_among_false_headers(tmp_path):
    """A stored block full of headers is no start of a block."""
    fake = (blocks.HEADER + b"\0\0\0\0\0\xff\x06\0BC\x02\0\x30\0" + b"z" * 31) * 900
    stored = zlib.compressobj(0, zlib.DEFLATED, -15)
    body = stored.compress(fake[:40_000]) + stored.flush()
    extra = b"BC\x02\x00" + struct.pack("<H", len(body) + 25)
    one = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 6) + extra + body + struct.pack("<II", zlib.crc32(fake[:40_000]), 40_000)
    data = one * 4 + member(b"a\nb\n") * 3
    (tmp_path / "f.gz").write_bytes(data)
    file = blocks.ByteFile(str(tmp_path / "f.gz"))
    starts = [k * len(one) for k in range(4)] + [4 * len(one) + k * len(member(b"a\nb\n")) for k in range(3)]
    for at in [*range(0, len(data), 1201), *starts, *(s + 1 for s in starts)]:
        assert blocks.first_block(file, at, len(data)) == next((s for s in starts if s >= at), None)


def test_ranges_begin_and_end_inside_blocks(tmp_path):
    rng = random.Random(9)
    text = b"".join(b"%d %s\n" % (k, b"y" * rng.randint(0, 900)) for k in range(2000))
    data, at, virtual = b"", 0, {}
    while at < len(text):  # virtual offsets of the places of the text
        n = rng.choice([1, 50, 4000, 30_000])
        virtual |= {at + k: len(data) << 16 | k for k in range(min(n, len(text) - at))}
        data += member(text[at : at + n])
        at += n
    virtual[len(text)] = len(data) << 16
    (tmp_path / "v.gz").write_bytes(data)
    begins = [0] + [k + 1 for k in range(len(text)) if text[k] == 10]
    for _ in range(60):
        a, b = sorted(rng.sample(begins, 2))
        file = blocks.ByteFile(str(tmp_path / "v.gz"))
        assert list(blocks.lines_of_range(file, len(data), virtual[a], virtual[b])) == text[a:b].split(b"\n")[:-1]
        assert file.sent <= (virtual[b] >> 16) - (virtual[a] >> 16) + blocks.CHUNK + 1


def test_whole_file_scan(spark, tmp_path):
    """Splits of a scan without a region: every record once, the last without a line break; and a plain gzip file, which can't be split."""
    line = lambda k: f"17\t{k}\t{k}\tA\tG\t.\t.\tCLNSIG=Benign;X={'z' * (k * 37 % 500)}".encode()
    text = b"#head\n" + b"\n".join(line(k) for k in range(4000))
    data, _ = blocked(random.Random(3), text)
    (tmp_path / "v.gz").write_bytes(data)
    plain = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "w.gz").write_bytes(plain.compress(text) + plain.flush())
    spark.dataSource.register(indexed.IndexedVcf)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for name, split, parts in (("v.gz", 10_000, -(-len(data) // 10_000)), ("v.gz", 1 << 25, 1), ("w.gz", 10_000, 1)):
        own = spark.read.format("indexed_vcf").option("path", str(tmp_path / name)).option("splitbytes", split).load()
        assert own.rdd.getNumPartitions() == parts and sorted(r["pos"] for r in own.collect()) == list(range(4000))


class Flaky(http.server.BaseHTTPRequestHandler):
    """Serves byte ranges; some answers are errors, some break off.  Counts the bytes of bodies that it sends."""

    files: dict = {}
    sent, asked = [], []

    def log_message(self, *args):
        pass

    def do_HEAD(self):  # noqa: N802
        self.send_response(200)
        self.send_header("Content-Length", str(len(self.files[self.path])))
        self.end_headers()

    def do_GET(self):  # noqa: N802
        data, span = self.files[self.path], self.headers.get("Range")
        if span:
            a, b = span.removeprefix("bytes=").split("-")
            data = data[int(a) : int(b) + 1 if b else None]
        self.asked.append(span)
        turn = len(self.asked) % 4
        body = b"try again" if turn == 1 else data
        self.send_response(503 if turn == 1 else 206 if span else 200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        body = body[: len(body) // 2] if turn == 2 else body
        self.wfile.write(body)
        self.sent.append(len(body))
        if turn == 2:
            self.close_connection = True


@pytest.fixture
def server():
    Flaky.files, Flaky.sent, Flaky.asked = {}, [], []
    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Flaky)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def test_bytes_as_sent(spark, server, tmp_path, monkeypatch):
    """What a scan over HTTP says it was sent is what the server sent, failed tries included."""
    line = lambda k: f"17\t{k}\t{k}\tA\tG\t.\t.\tCLNSIG=Benign\n".encode()
    data, at = b"", []
    for first in range(1, 60_000, 1000):
        at.append(len(data))
        data += member(b"".join(line(k) for k in range(first, first + 1000)))
    ends = [*at[1:], len(data)]
    chunks = {4681 + k: [(a << 16, e << 16)] for k, (a, e) in enumerate([(at[0], at[17]), (at[16], at[33]), (at[32], at[50]), (at[49], ends[-1])])}
    Flaky.files = {"/v.gz": data, "/v.gz.tbi": member(index_bytes(["17"], [chunks], [(at[0] << 16, at[16] << 16, at[32] << 16, at[49] << 16)]))}
    for start, end in ((0, None), (5, 900), (at[3], at[4])):
        file = blocks.ByteFile(f"{server}/v.gz", pause=0.01)
        before = sum(Flaky.sent)
        assert file.read(start, end) == data[start:end] and file.sent == sum(Flaky.sent) - before
    Flaky.sent.clear()
    rows, sent = indexed.fetched_lines(spark, f"{server}/v.gz", [("17", 20_000, 20_100), ("17", 20_050, 45_000)], str(tmp_path / "lines"), split=20_000)
    assert rows.count() == 25_001 == rows.distinct().count() and sent == sum(Flaky.sent) and len(Flaky.sent) > 5


def test_fetch_that_fails(server):
    file = blocks.ByteFile("http://127.0.0.1:9/x", tries=2, pause=0.01)
    with pytest.raises(OSError):
        file.read()
    assert file.sent == 0


def test_cache_without_leftovers(tmp_path):
    def broken(url):
        raise OSError("down")

    with pytest.raises(OSError, match="down"):
        fetch.cached("u", str(tmp_path / "c"), broken)
    assert not (tmp_path / "c").exists() or list((tmp_path / "c").iterdir()) == []
    assert fetch.cached("u", str(tmp_path / "c"), lambda u: b"x") == b"x" == fetch.cached("u", str(tmp_path / "c"), broken)
    assert len(list((tmp_path / "c").iterdir())) == 1


def test_regions_and_panels(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"name": "x",\n "genes": ["tp53", "Brca1"]}')
    assert sorted(r["gene"] for r in releases.panel(spark, str(tmp_path / "p.json")).collect()) == ["BRCA1", "TP53"]
    rows = spark.createDataFrame([("chr17", 10, "TP53"), ("17", 21, "TP53"), ("3", 5, "OTHER")], "contig string, pos long, gene string")
    regions = spark.createDataFrame([("TP53", "17", 1, 20), ("MLH1", "chr3", 1, 9)], "symbol string, contig string, start long, end long")
    assert sorted((r["region"], r["pos"]) for r in releases.in_regions(rows, regions).collect()) == [("MLH1", 5), ("TP53", 10)]
    assert [r["region"] for r in releases.region_warnings(rows, regions).collect()] == ["MLH1"]


def rows_of(spark, n=3):
    return spark.createDataFrame([(f"A{k}", None, "17", 10 - k, "A", "ü", None, "BENIGN", k, "", None, None) for k in range(n)], SNAPSHOT)


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "s")
    assert snapshots.write_snapshot(rows_of(spark), root, "2020-01-01", "p") and not snapshots.write_snapshot(rows_of(spark, 1), root, "2020-01-01", "p")
    assert snapshots.write_snapshot(rows_of(spark, 0), root, "2021-01-01", "p") and snapshots.write_snapshot(rows_of(spark, 2), root, "2021-01-01", "p", force=True)
    own = snapshots.read_snapshots(spark, root)
    assert own.count() == 5 and own.where("release_date = date'2021-01-01'").count() == 2
    r = own.where("allele_id = 'A1' AND release_date = date'2020-01-01'").first()
    assert r["variation_id"] is None and r["clnsig_raw"] == "" and r["alt"] == "ü" and r["snapshot_id"] == "snapshot-p-20200101"
    assert [f.dataType for f in own.schema.fields if f.name in SNAPSHOT.fieldNames()] == [f.dataType for f in SNAPSHOT.fields]
    last = snapshots.last_wins(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, at int, v string"), "k", "at")
    assert sorted(r["v"] for r in last.collect()) == ["b", "c"]


def test_rows_in_the_declared_schema(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"allele_id": "A1", "stars": 3, "pos": 7, "more": 1}\n{"allele_id": "A2"}\n')
    own = snapshots.load_rows(spark, str(tmp_path / "a.ndjson"))
    assert own.schema.fieldNames() == SNAPSHOT.fieldNames() and sorted((r["allele_id"], r["stars"]) for r in own.collect()) == [("A1", 3), ("A2", None)]
    (tmp_path / "b.ndjson").write_text("no json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        snapshots.load_rows(spark, str(tmp_path / "b.ndjson")).collect()


def test_manifests(spark, tmp_path):
    row = lambda i, day, panel="p": f'{{"snapshot_id": "{i}", "release_date": "{day}", "panel": "{panel}",\n"row_count": 1, "extra": 1}}'
    for i, day in (("b", "2021-01-01"), ("a", "2020-01-01")):
        (tmp_path / f"{i}.manifest.json").write_text(row(i, day))
    (tmp_path / "c.manifest.json").write_text(row("c", "2019-01-01", "q"))
    own = snapshots.load_manifests(spark, str(tmp_path / "*.manifest.json"))
    assert [r["snapshot_id"] for r in own.collect()] == ["c", "a", "b"] and own.schema.fieldNames() == MANIFEST.fieldNames()
    assert snapshots.load_manifests(spark, str(tmp_path / "*.manifest.json"), "p").count() == 2
    old = own.where("snapshot_id = 'a'")
    assert sorted(r["snapshot_id"] for r in snapshots.first_writer_wins(old, own.unionByName(own)).collect()) == ["b", "c"]


def test_provenance(spark, tmp_path):
    """A fresh ingest is intact; a file that changes is altered, a folder that goes is missing; the code's state decides on reproducible."""
    root = str(tmp_path / "s")
    lines = spark.createDataFrame([("17\t100\t7\tA\tG\t.\t.\tGENEINFO=G:1;CLNSIG=Benign",)], "value string")
    regions = spark.createDataFrame([("G", "17", 1, 1000)], "symbol string, contig string, start long, end long")
    for day in ("2020-01-01", "2021-01-01", "2022-01-01"):
        made = ingest(lines, regions, root, day, "p q", bytes_fetched=10, source_full_bytes=100)
        assert made["row_count"] == 1 and made["genes_requested"] == 1 and made["bytes_fetched"] == 10
    assert re.fullmatch(r"[0-9a-f]{40}(-dirty)?|unknown", made["pipeline_git_sha"])
    first = snapshots.load_manifests(spark, f"{root}/manifests/*").collect()
    manifests = spark.createDataFrame(first, MANIFEST).withColumn("pipeline_git_sha", F.lit("abc"))
    state = lambda: {(r["state"], r["reproducible"]): r["n"] for r in snapshots.provenance(spark, manifests, root).collect()}
    assert state() == {("intact", True): 3}
    ingest(lines.unionByName(lines.withColumn("value", F.replace("value", F.lit("100"), F.lit("200")))), regions, root, "2021-01-01", "p q", force=True)
    shutil.rmtree(next((tmp_path / "s").glob("panel=*/release_date=2022-01-01")))
    assert state() == {("intact", True): 1, ("altered", True): 1, ("missing", True): 1}
    dirty = manifests.withColumn("pipeline_git_sha", F.when(F.col("release_date") == "2020-01-01", "abc-dirty"))
    assert {(r["state"], r["reproducible"]) for r in snapshots.provenance(spark, dirty, root).collect()} == {("intact", False), ("altered", False), ("missing", False)}


def test_export_and_tenants(spark, tmp_path):
    source, target = str(tmp_path / "w"), str(tmp_path / "x")
    for name in (*snapshots.PUBLIC, "case_variant"):
        spark.range(2).write.parquet(f"{source}/{name}")
    snapshots.export_public(spark, source, target)
    assert generations.listed(spark, generations.current(spark, target)) == sorted(snapshots.PUBLIC)
    with pytest.raises(ValueError, match="source"):
        snapshots.export_public(spark, source, source + "/")
    root = str(tmp_path / "t")
    make = lambda *rows: spark.createDataFrame(rows, "tenant_id string, v int")
    for tenant in ("a", "b", "c d"):
        snapshots.replace_tenant(make((tenant, 1)), root, tenant)
    snapshots.replace_tenant(make(("a", 2), ("a", 3)), root, "a")
    snapshots.replace_tenant(make(("a", 2)).where("false"), root, "c d")
    assert sorted((r["tenant_id"], r["v"]) for r in spark.read.parquet(root).collect()) == [("a", 2), ("a", 3), ("b", 1)]


def test_stream(spark, tmp_path):
    source, raw, spans = (str(tmp_path / x) for x in ("in", "raw", "spans"))
    rows = raw_rows(spark, THREE)
    schema = rows.schema
    for day in ("2019-01-02", "2026-08-08", "2022-06-01"):  # the last comes late
        rows.where(F.col("release_date") == day).coalesce(1).write.mode("append").parquet(source)
        follow(spark, source, schema, raw, spans, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert [s[0] for s in listed(stored_spans(spark, spans), "A2")] == ["UNCERTAIN", "LIKELY_PATHOGENIC"]
    assert [s[0] for s in listed(stored_spans(spark, spans), "A4")] == ["ABSENT", "PATHOGENIC"]
    follow(spark, source, schema, raw, spans, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert spark.read.parquet(raw).count() == rows.count()


def test_stream_of_a_split_release(spark, tmp_path):
    """A release whose rows come in two batches keeps them all; a row that comes again changes nothing."""
    source, raw, spans = (str(tmp_path / x) for x in ("in", "raw", "spans"))
    rows = raw_rows(spark, THREE)
    for part in (rows.where("allele_id <> 'A2'"), rows.where("allele_id = 'A2'"), rows.where("allele_id = 'A1'").withColumn("bucket", F.lit("BENIGN"))):
        part.coalesce(1).write.mode("append").parquet(source)
        follow(spark, source, rows.schema, raw, spans, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert spark.read.parquet(raw).count() == rows.count()
    assert [s[0] for s in listed(stored_spans(spark, spans), "A1")] == ["UNCERTAIN"]


def test_genes(spark, tmp_path):
    path, asked = str(tmp_path / "genes"), []

    def first(symbol):
        asked.append(symbol)
        if symbol == "BAD":
            raise OSError("down")
        return ("17", 10_000, 20_000) if symbol == "ONE" else None

    providers = {"first": first, "second": lambda s: ("1", 7000, 8000) if s == "TWO" else None}
    got = {r["symbol"]: tuple(r)[1:] for r in genes.resolved(spark, ["one", "TWO"], providers, path).collect()}
    assert got == {"ONE": ("17", 5000, 25_000, "first"), "TWO": ("1", 2000, 13_000, "second")} and asked == ["ONE", "TWO"]
    with pytest.raises(genes.TooManyUnknown, match="BAD"):
        genes.resolved(spark, ["ONE", "BAD"], providers, path)
    assert asked == ["ONE", "TWO", "BAD"] and genes.resolved(spark, ["ONE", "BAD"], providers, path, budget=0.5).count() == 1
