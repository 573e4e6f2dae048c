"""The command line from ingest to report, the service's checks, locks and fetching."""

import os
import time
import urllib.error

import pytest

from chronospan import cli, locks
from chronospan.service import BadRequest, Timeline, day
from chronospan.sources import fetch, generations, store
from tests.test_timeline import THREE, snapshots


def line(pos, sig, gene="TP53"):
    return f"17\t{pos}\t{pos}\tA\tG\t.\t.\tGENEINFO={gene}:1;CLNSIG={sig};CLNREVSTAT=reviewed_by_expert_panel;CLNDN=x_y"


def test_command_line(spark, tmp_path, capsys):
    root, lock = str(tmp_path / "w"), str(tmp_path / "lock")
    run = lambda *a: cli.main(["--root", root, "--lock", lock, *a], spark)
    (tmp_path / "regions.json").write_text('{"symbol": "TP53", "contig": "chr17", "start": 1, "end": 500}\n{"symbol": "NEXT", "contig": "17", "start": 400, "end": 600}')
    for release, sig in (("2019-01-02", "Uncertain_significance"), ("2025-01-02", "Pathogenic")):
        (tmp_path / f"{release}.vcf").write_text("#head\n" + "\n".join([line(100, sig), line(200, "Benign"), line(450, sig), line(9999, sig), "17\t1\t1\tA\tG,T\t.\t.\tx"]))
        assert run("ingest", "--lines", str(tmp_path / f"{release}.vcf"), "--regions", str(tmp_path / "regions.json"), "--release", release, "--panel", "p")["row_count"] == 3
        assert run("ingest", "--lines", str(tmp_path / f"{release}.vcf"), "--regions", str(tmp_path / "regions.json"), "--release", release, "--panel", "p") == "already there"
    assert run("spans") == [{"panel": "p", "spans": 5, "alleles": 3, "moved_alleles": 2}]
    moved = run("spike", "--baseline", "2020-01-01", "--now", "2026-01-01", "--threshold", "0.99")[0]
    assert (moved["vus_at_baseline"], moved["moved_to_pathogenic"], moved["policy_suspect"]) == (2, 2, 0)
    assert len(run("timeline", "--panel", "p")) == 5
    assert [(r["state"], r["n"]) for r in run("provenance")] == [("intact", 2)]
    run("export-public", "--target", str(tmp_path / "public"))
    assert generations.listed(spark, generations.current(spark, str(tmp_path / "public"))) == ["allele_dim", "assertion_span", "snapshot_manifest"]
    token = run("tenant-create", "--tenant", "lab-a", "--label", "first")["token"]
    assert run("tenant-list")[0]["active"] == 1
    run("tenant-revoke", "--tenant", "lab-a", "--token", token.split(".")[1])
    assert run("tenant-list")[0]["revoked"] == 1
    (tmp_path / "cases.csv").write_text("case_ref,contig,pos,ref,alt,reported_classification,reported_on\n1,17,100,A,G,VUS,2020-01-01\n2,chr17,200,A,G,B,2020-01-01\n3,17,1,A,G,VUS,2020-01-01\n4,17,x,A,G,VUS,2020-01-01\n")
    loaded = run("case-load", "--csv", str(tmp_path / "cases.csv"), "--tenant", "lab-a")
    assert loaded["loaded"] == 3 and len(loaded["rejected"]) == 1
    report = run("case-report", "--tenant", "lab-a", "--panel", "p", "--threshold", "0.99")
    assert (report["counts"]["unmatched"], report["counts"]["unchanged"], report["counts"]["moved_to_pathogenic"]) == (1, 1, 1)
    run("case-review", "--tenant", "lab-a", "--allele", "A", "--case", "1", "--verdict", "ACT", "--rationale", "grün", "--reviewer", "me", "--snapshot", "s")
    run("case-review", "--tenant", "lab-a", "--allele", "A", "--case", "2", "--verdict", "DEFER", "--rationale", "b", "--reviewer", "me", "--snapshot", "s")
    assert [e["seq"] for e in run("case-log", "--tenant", "lab-a")] == [1, 2]
    assert run("case-verify", "--tenant", "lab-a") == {"intact": True, "first_bad_seq": None}
    run("case-demo", "--panel", "p", "--on", "2020-01-01", "--csv", str(tmp_path / "demo"), "--limit", "2")
    assert run("export-public", "--target", str(tmp_path / "public"))
    capsys.readouterr()


def test_service(spark, tmp_path):
    own = Timeline(store.build(snapshots(spark, THREE), str(tmp_path)), "p", 0.9)
    assert own.context()["floor"] == "2019-01-02" and len(own.context()["releases"]) == 3
    page = own.variants("gene", "2022-06-01", limit=2)
    assert page["total"] == 4 and len(page["rows"]) == 2 and page["headline"]["classified"] == 4
    assert [r["total"] for r in own.composition("GENE")] == [3, 4, 3] and len(own.timeline("A2")) == 2
    for bad in (lambda: own.variants("gene", "x"), lambda: own.variants("ge ne", "2020-01-01"), lambda: own.variants("g", "2020-01-01", limit=0), lambda: own.timeline("a b"), lambda: day("2020-02-30")):
        with pytest.raises(BadRequest):
            bad()


def test_locks(tmp_path):
    path = tmp_path / "l"
    with locks.lock(str(path)), pytest.raises(locks.Locked), locks.lock(str(path)):
        pass
    path.write_text("dead")
    with pytest.raises(locks.Locked), locks.lock(str(path)):
        pass
    os.utime(path, (0, time.time() - 7 * 3600))
    with locks.lock(str(path)):
        assert path.exists()
    path.write_text("dead")
    with locks.lock(str(path), force=True):
        pass
    assert not path.exists()


def test_fetch(spark, tmp_path):
    asked = []

    def read(url):
        asked.append(url)
        if url.endswith("/2018/"):
            raise urllib.error.HTTPError(url, 404, "no", None, None)
        if url.endswith("/2017/"):
            raise OSError("down")
        return b'<a href="clinvar_20190603.vcf.gz">'

    assert fetch.cached("u", str(tmp_path / "c"), read) == fetch.cached("u", str(tmp_path / "c"), read) and asked == ["u"]
    assert [d.isoformat() for d in fetch.list_releases(spark, "r", 2019, read)] == ["2019-06-03"] and fetch.list_releases(spark, "r", 2018, read) == []
    with pytest.raises(fetch.ListingError):
        fetch.list_releases(spark, "r", 2017, read)
