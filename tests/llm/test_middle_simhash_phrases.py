"""Fill-in-the-middle, SimHash near-duplicates and phrase mining against brute force, on edge rows, and against SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from chronospan.llm import fim, phrases, registry, simhash
from tests.llm.test_edges import EXTRA, LONG, ROWS, SCHEMA
from tests.llm.test_methods import LOWER, SF, compare, texts

ODD = [(1, None), (1, ""), (2, "\n"), (3, "\n\n\n"), (4, "a"), (5, "a\nb\nc"), (5, "a\nb\nc"), (6, "x<P>y\nz"), (None, "no\nid\nhere\n"), (None, None), (7, "é\r\n日本\n😀\n"), (8, "line\n" * 100_000), (9, "x" * 300_000), (10, "<P\n>S<\nM>")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in ROWS], SCHEMA)


# 11 ----------------------------------------------------------------------------


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", text, None, None
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return len(units), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return len(units), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def test_middle_brute_force(spark):
    rng = random.Random(11)
    rows = ODD + [(i, "".join(rng.choice(["a", "\n", "é", "<", "P>", " "]) for _ in range(rng.randint(0, 30)))) for i in range(20, 400)]
    out = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter(tuple(r) for r in out.collect())
    assert got == Counter((i, *plain_middle(i, t)) for i, t in rows)
    assert {k for _, _, k, *_ in got} == {"plain", "psm", "spm"}
    want = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["restored_sha256"]) for r in fim.digested(out).collect()) == want


def test_middle_general(spark):
    """Other units, marks, rates and orders, restored exactly."""
    rows = [(i, f"One {i}. Two? Three [A] four!" * (i % 5)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = ("", "", "")
    got = fim.fill_in_middle(docs, units=r"[^.?!]*[.?!]|[^.?!]+", marks=marks, seed=3, rate=60, spm=20).collect()
    forms = Counter(r["form"] for r in got if r["n"])
    assert 40 < forms["plain"] < 90 and forms["psm"] > 2 * forms["spm"] > 0
    assert {r["doc_id"]: fim.restore(r["output"], r["form"], marks) for r in got} == dict(rows)


def test_middle_sql(spark):
    compare(spark, fim.op11_fill_in_middle(spark, SF), fim.OP11_SQL)


# 12 ----------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=4):
    """doc_id to fingerprint and component, by all pairs."""
    fps = {i: plain_fingerprint(t) for i, t in rows}
    ids, up = sorted(fps), {i: i for i in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    each = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(each[k + 1 :] ^ each[k]) <= radius).tolist():
            a, b = top(i), top(ids[k + 1 + j])
            up[max(a, b)] = min(a, b)
    return {i: (f"{fps[i]:016x}", top(i)) for i in ids}


def found_groups(spark, rows):
    out = simhash.join_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out.collect()}


def test_fingerprints():
    rng = random.Random(12)
    for _ in range(400):
        text = "".join(rng.choice(["A", "b", " ", "\n", "é", "日", " c", "\x1f", "\x85"]) for _ in range(rng.randint(0, 60)))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text), text


def test_tree_search(monkeypatch):
    """What a forest finds within a radius is what all pairs give, whatever the size of the front; each child hangs at its distance."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    noise = [np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, 4)))) for _ in range(900)]
    fps = np.unique(np.concatenate((base, base[rng.integers(0, 30, 900)] ^ np.array(noise))))
    keys = np.sort(rng.integers(0, 7, len(fps)))
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    roots = simhash.run_starts(keys)
    forest = simhash.grown(fps, roots)
    parents, distances = np.divmod(forest.edges, 65)
    assert len(forest.children) == len(fps) - len(set(roots.tolist())) and (np.bitwise_count(fps[parents] ^ fps[forest.children]) == distances).all()
    assert len(set(forest.edges.tolist())) == len(forest.edges)
    sizes = np.bincount(roots, minlength=len(fps))[roots]
    for radius in (0, 2, 4, 9):
        want = {(i, j) for k in range(7) for i in np.flatnonzero(keys == k) for j in np.flatnonzero(keys == k) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
        for front in (50, 1 << 20):
            monkeypatch.setattr(simhash, "FRONT", front)
            assert {(int(q), int(n)) for a, b in simhash.searched(forest, fps, roots, sizes, radius) for q, n in zip(a, b, strict=True)} == want


@pytest.mark.parametrize("n", [10, 5_000_000, 5_000_000_000])
def test_similar_share_a_shard(n):
    """Fingerprints that differ in any four bits agree on the blocks of a table, for every number of blocks."""
    rng = random.Random(n)
    own = simhash.masks(n, 4)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not differ & mask for mask, _ in own)
    assert all(mask & after == 0 and after for mask, after in own)
    assert n >> min(mask.bit_count() for mask, _ in own) <= simhash.USUAL


@pytest.mark.parametrize("tree", [8, 2048])
def test_simhash_brute_force(spark, monkeypatch, tree):
    """Families of near copies, copies, wordless and short texts; small trees send families through parts and tiles."""
    monkeypatch.setattr(simhash, "TREE", tree)
    monkeypatch.setattr(simhash, "RUN", 64)
    rng = random.Random(13)
    rows = [(i, None if i % 7 == 0 else " ".join(rng.choice("abcd") for _ in range(i % 4))) for i in range(60)]
    for _ in range(3):
        base = [f"w{rng.randrange(300)}" for _ in range(110)]
        for _ in range(120):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(110)] = f"w{rng.randrange(300)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, rows[80][1]) for k in range(40)]
    want = plain_groups(rows)
    assert found_groups(spark, rows) == want
    sizes = Counter(c for _, c in want.values())
    assert max(sizes.values()) > 40 and sum(v == 1 for v in sizes.values()) > 50


def test_simhash_tables(spark):
    rows = texts()
    assert found_groups(spark, rows) == plain_groups(rows)
    assert registry.QUERIES["op12_simhash_dedup"](spark, SF).count() == len(rows)


# 13 ----------------------------------------------------------------------------


def plain_phrases(rows, longest=3, least=10, inside=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(words[i : i + m] for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, total[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def found_phrases(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def random_texts(n):
    rng = random.Random(n)
    common = ["new", "york", "of", "the", "Ünited", "STATES", "a\x1fb", "😀", "é"]
    for _ in range(n):
        yield rng.choice(["en", "fr", None, ""]), "".join(rng.choice(common) + rng.choice([" ", " ", " ", "\t ", "  ", ", ", "\n", "\x0b", "."]) for _ in range(rng.randint(0, 40)))


@pytest.mark.parametrize("shard", [200, 4 << 20])
@pytest.mark.parametrize("longest", [2, 3, 4, 5])
def test_phrases_brute_force(spark, monkeypatch, shard, longest):
    """Phrases of several lengths, whatever the shards are."""
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    rows = [*random_texts(300), (None, None), ("en", ""), ("en", "new york " * 500)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found_phrases(phrases.mine_phrases(docs, longest=longest, top=60)) == plain_phrases(rows, longest, top=60)


def test_phrases_with_a_full_filter(spark, monkeypatch):
    """A filter that all keys pass costs rows and changes none."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    rows = list(random_texts(200))
    assert found_phrases(phrases.mine_phrases(spark.createDataFrame(rows, "lang string, text string"))) == plain_phrases(rows)


def test_suffix_arrays():
    rng = np.random.default_rng(13)
    for _ in range(60):
        words = rng.integers(0, 4, rng.integers(1, 80)).astype(np.uint64)
        ends = np.unique(np.append(rng.integers(0, len(words), 3), len(words) - 1))
        rest = ends[np.searchsorted(ends, np.arange(len(words)))] - np.arange(len(words)) + 1
        for depth in (1, 2, 3, 4, 5):
            got = {n: Counter({tuple(words[p : p + n].tolist()): c for p, c in zip(at.tolist(), counts.tolist(), strict=True)}) for n, at, counts in phrases.lcp_intervals(phrases.suffix_ranks(words, rest, depth), rest, depth)}
            assert got == {n: Counter(tuple(words[p : p + n].tolist()) for p in range(len(words)) if rest[p] >= n) for n in range(1, depth + 1)}


def test_stretches(monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 50)
    for text in (b"", b"a b. " * 100, b"x" * 400, b"y" * 120 + b"!" + b"z" * 30):
        own = list(phrases.stretches(text))
        assert b"".join(own) == text and all(s[-1] in phrases.MARKS for s in own[:-1]) and (not own or own[-1])
    batch = pa.RecordBatch.from_arrays([pa.array([b"a b, c", b"d " * 80]), pa.array(["x", "y"])], ["t", "l"])
    assert sum(len(s.words) for s in phrases.shards(iter([batch]))) == 83


def test_phrases_sql(spark):
    compare(spark, phrases.op13_phrases(spark, SF), phrases.OP13_SQL)


def test_scores_pass_64_bits(spark):
    """a * a * 1000000 has more than 64 bits; the quotient is exact."""
    a, left, right = 10**9 + 7, 10**9 + 9, 10**9 + 21
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert row.select(phrases.score("a", "l", "r")).first()[0] == 1_000_000 * a * a // (left * right)


# all ---------------------------------------------------------------------------


def test_edge_rows(spark, docs):
    """Nulls, repeated rows, very long texts, clashing columns, empty tables."""
    none = docs.where("false")
    for got in (fim.digested(fim.fill_in_middle(docs)), simhash.join_fingerprints(docs)):
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    middle = {r["doc_id"]: r for r in fim.fill_in_middle(docs).collect()}
    assert middle[6]["n"] == 1 and fim.restore(middle[6]["output"], middle[6]["form"]) == LONG and middle[3]["form"] == "plain"
    groups = {r["doc_id"]: r for r in simhash.join_fingerprints(docs).where("doc_id IS NOT NULL").collect()}
    assert groups[2]["component_id"] == 1 and {groups[i]["component_id"] for i in (3, 4, 5)} == {3} and groups[3]["fingerprint"] == "0" * 16
    only = docs.where("doc_id IS NULL AND text IS NOT NULL")
    assert [r["component_id"] for r in simhash.join_fingerprints(only).collect()] == [None]
    mined = phrases.mine_phrases(docs)
    assert found_phrases(mined) == plain_phrases([(r[2], r[1]) for r in ROWS]) and mined.where(F.col("lang") == "la").count() > 0
    for f in (fim.fill_in_middle, simhash.join_fingerprints, phrases.mine_phrases):
        assert f(none).count() == 0
