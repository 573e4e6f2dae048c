"""Each operator against a plain brute-force version of what it computes."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from chronospan.llm import chat, common, components, decontam, langid, licenses, linededup, ngramjoin, packing, pii, quality_fm, quality_llr

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()


def compare(spark, got, sql, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(sql)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


# 1 -----------------------------------------------------------------------------


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.TOKENIZER)
    plain.encode_special_tokens = True
    encode = packing.Encoder(kept=50)
    rng = random.Random(1)
    parts = ["the", " ", "  ", "\n", "\t", "é", "日本", "a1", "'s", "...", "😀", " ", " ", "İ", "ß", "1234", "<|endoftext|>", "Ω", "ñ,"]
    for text in [t for _, t in texts()[:40]] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]:
        assert encode(text) == struct.pack(f"<{len(x := plain.encode(text, add_special_tokens=False).ids)}I", *x), text


def fewest(lengths, capacity):
    """The least number of bins, by trying all partitions of a few lengths."""
    best = len(lengths)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for b in range(len(rooms)):
            if rooms[b] >= lengths[k] and rooms[b] not in rooms[:b]:
                rooms[b] -= lengths[k]
                go(k + 1, rooms)
                rooms[b] += lengths[k]
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best


def least_slack(lengths, capacity):
    """Bins filled one after another with the longest length left and those that leave the least room beside it."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        best, steps = [capacity - left[0], []], 0

        def go(k, room, own):
            nonlocal steps, best
            if room < best[0]:
                best = [room, list(own)]
            for i in range(k, len(left)):
                steps += 1
                if not best[0] or steps > 2000:
                    return
                if left[i] <= room:
                    go(i + 1, room - left[i], [*own, i])

        go(1, capacity - left[0], [])
        for i in [*reversed(best[1]), 0]:
            left.pop(i)
        bins += 1
    return bins


def test_local_search():
    """Exchanges empty a bin that moves can't; valid bins, never more than best fit or least slack, near the optimum of small sets."""
    assert len(packing.improved([[0, 1], [2, 3], [4]], [6, 2, 5, 3, 4], 10)) == 2
    rng, over = random.Random(2), 0
    for k in range(150):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 11))] if k < 120 else [rng.randint(300, 1100) for _ in range(300)]
        capacity = 64 if k < 120 else 2048
        first = packing.best_fit(lengths, capacity)
        bins = packing.improved(first, lengths, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= capacity for b in bins) and len(bins) <= len(first)
        fills = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
        assert fills(bins) >= fills(first)
        if k < 120:
            over += len(bins) - fewest(lengths, capacity)
        else:
            assert len(bins) <= least_slack(lengths, capacity)
    assert over <= 2


@pytest.mark.parametrize("low,high", [(300, 1100), (600, 900), (20, 1500), (1100, 1200), (1, 40)])
def test_packing_of_many_blocks(spark, tmp_path, low, high):
    """Blocks packed apart need hardly more bins than all pieces in one, also where lengths fit badly and all bins stay open."""
    rng = random.Random(low)
    lengths = [rng.randint(low, high) for _ in range(20_000)]
    one = len(packing.pack_block(lengths))
    rows = spark.createDataFrame(list(enumerate(lengths)), "row long, length long")
    got = packing.pack(rows, common.Scratch(spark, "many"), block=4096).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], lengths[r["row"]]))
    assert len(got) == len(lengths) == len({r["row"] for r in got})
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert len(bins) <= one + 1, (len(bins), one)


def test_packing_of_all_documents(spark):
    rows = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), capacity=256, block=64, with_ids=True)
    got = rows.collect()
    encode = packing.Encoder()
    whole = {i: np.frombuffer(encode(t) + b"\0\0\0\0", np.uint32) for i, t in texts()}
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    assert by_doc.keys() == whole.keys()
    for i, ids in whole.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["piece"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["ids"] == part.tolist()
            assert r["piece"] == 0 or r["length"] == 256
            at += r["length"]
        assert at == len(ids)
    filled = {r["sequence_id"]: r["ids"] for r in packing.sequences(rows).collect()}
    assert all(len(x) <= 256 for x in filled.values()) and sum(map(len, filled.values())) == sum(map(len, whole.values()))
    assert len(filled) <= 1.02 * -(-sum(map(len, whole.values())) // 256) + 1


# 2 -----------------------------------------------------------------------------


def test_decontamination_sql(spark):
    compare(spark, decontam.op2_decontamination(spark, SF), decontam.OP2_SQL)


@pytest.mark.parametrize("block", [50, 200_000])
def test_containment_brute_force(spark, block):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij")
    items = [[word() for _ in range(rng.randint(1, 30))] for _ in range(40)]
    docs = []
    for k in range(120):
        own = [word() for _ in range(rng.randint(0, 60))]
        if k % 2:
            x = list(rng.choice(items))
            if len(x) > 8 and rng.random() < 0.7:
                x[rng.randrange(len(x))] = "zz"
            own[5:5] = x
        docs.append(own)
    shingles = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for i, x in enumerate(items):
        k = min(5, len(x))
        q = shingles(x, k)
        for j, d in enumerate(docs):
            n = len(q & shingles(d, k))
            if 100 * n >= 80 * len(q):
                want.add((j, i, n, len(q)))
    frame = lambda rows, key: spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in enumerate(rows)], f"{key} long, text string")
    got = decontam.find_leaks(frame(docs, "doc_id"), frame(items, "item_id"), block).collect()
    assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got} == want and len(got) == len(want)


# 3 -----------------------------------------------------------------------------


def test_license_base_counts():
    rng = random.Random(4)
    parts = ["MIT", "license", "License,", "apache", "general", "public", "-", "é", "mit-license", "\n", "under the", "GNU"]
    for text in [t for _, t in texts()] + [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2000)]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        at = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        got = licenses.scan(text.encode())
        assert (got.n_words, got.n_base, got.first_word, got.last_word) == (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert got.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, got.base_labels.split(","))) <= set(got.labels.split(","))


@pytest.mark.parametrize(("text", "label"), [
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"), ("licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("This is free and unencumbered software released into the public domain", "unlicense"), ("no licence here", ""),
])
def test_license_labels(text, label):
    got = licenses.scan(f"Foo bar. {text}\nend".encode())
    assert (label in got.labels.split(",")) and (got.score > 0) == bool(label)


def test_license_rules():
    own = licenses.rules()
    written = len(licenses._rows(licenses.TEXTS) + licenses._rows(licenses.NOTICES) + licenses._rows(licenses.FAMILIES))
    assert written > 300 and len({r.pattern for r in own}) == len(own) and all(r.words for r in own)
    mit = next(r for r in own if r.label == "mit")
    weak = mit._replace(label="weak", priority=1)
    kept = licenses.suppressed([(0, 10, 0, mit), (2, 8, 1, weak), (5, 12, 2, weak), (0, 10, 3, weak)])
    assert [(s, e, r.label) for s, e, r in kept] == [(0, 10, "mit"), (5, 12, "weak")]


def spelled(parsed, rng):
    """A random text of a parsed pattern."""
    out = ""
    for op, x in parsed:
        match str(op):
            case "LITERAL":
                out += chr(x)
            case "ANY":
                out += "x "  # gaps are whole words
            case "IN":
                out += chr(rng.choice([c for kind, y in x for c in ([y] if str(kind) == "LITERAL" else range(y[0], y[1] + 1))]))
            case "BRANCH":
                out += spelled(rng.choice(x[1]), rng)
            case "SUBPATTERN":
                out += spelled(x[-1], rng)
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += "".join(spelled(x[2], rng) for _ in range(rng.randint(x[0], min(x[1], x[0] + 1))))
            case _:
                raise ValueError(op)
    return out


def samples(rng, each):
    """Random texts of each rule, all its alternatives among them."""
    from re import _parser

    for k, (rule, pattern) in enumerate(licenses.compiled().rules):
        parsed = _parser.parse(rule.pattern)
        for text in sorted({spelled(parsed, rng) for _ in range(each)}):
            yield k, rule, pattern, text


def test_prefilter_hides_no_alternative():
    """Each rule is found in each of its own texts, alone and by its words in capitals with punctuation between them."""
    rng = random.Random(15)
    for k, rule, pattern, text in samples(rng, 40):
        assert pattern.search(f" {text} ".encode()), (rule.label, text)
        assert k in {x[2] for x in licenses.detections(text.encode().split())[1]}, (rule.label, text)
        assert licenses.scan(text.upper().replace(" ", ", ").encode()).labels
    for text in (b"released under the GPL v1", b"GPLv1", b"gpl v1 only"):
        assert "gpl-1.0" in licenses.scan(text).labels.split(",")


def test_licenses_without_prefilter():
    """All rules on whole texts, and suppression by comparing all detections, give the same spans."""
    rng = random.Random(16)
    pool = [text for *_, text in samples(rng, 2)]
    noise = ["the", "software", "license", "is", "x", "apache", "under", "und", "1"]
    rows = [" ".join(" ".join(rng.choices(noise, k=rng.randint(0, 4))) + " " + " ".join(t.split()[rng.choice((0, 0, 2)) :]) for t in rng.sample(pool, 5)) for _ in range(60)] + [t for _, t in texts()]
    for text in rows:
        words = text.encode().translate(licenses.WORDS).split()
        line = b" " + b" ".join(words) + b" "
        found = [(m.start(), m.end(), k, r) for k, (r, p) in enumerate(licenses.compiled().rules) for m in p.finditer(line)]
        kept = []
        for x in sorted(found, key=lambda x: (-x[3].priority, x[0] - x[1], x[0], x[2])):
            if not any(y[0] <= x[0] and x[1] <= y[1] for y in kept):
                kept.append(x)
        spans = [f"{r.label}:{line[:s].count(b' ') - 1}:{line[:e].count(b' ')}" for s, e, _, r in sorted(kept, key=lambda x: (x[0], x[1], x[3].label))]
        got = licenses.scan(text.encode())
        assert got.spans == ",".join(spans)
        assert got.score == max([x[3].relevance for x in kept] + [0.9] * bool(got.n_base), default=0.0)


# 4 -----------------------------------------------------------------------------


def test_interactions_identity():
    rng = np.random.default_rng(0)
    v, x = rng.normal(size=(9, 4)), rng.normal(size=9)
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i, j in itertools.combinations(range(9), 2))
    assert np.isclose(quality_fm.interactions(v, x), pairs)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality_fm.op4_quality_classifier(spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    held = [(got[i]["predicted"], q) for i, q in labels if got[i]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sum(p == q for p, q in held) >= 0.95 * len(held) > 20


# 5 -----------------------------------------------------------------------------


def plain_phrases(other, text):
    """Longest matches, one after another, by searching the training text."""
    n = at = 0
    while at < len(other):
        size = 1
        while at + size < len(other) and other[at : at + size + 1] in text:
            size += 1
        n, at = n + 1, at + size
    return n


def test_phrases_are_longest_matches():
    """Whole texts of any length side by side, with bytes that no training text has, and copies of the training text, whose one phrase spans segments."""
    rng = random.Random(5)
    long = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    for others in ([long, long[100:2000], long[5:700] + b"zz" + long[1000:2500], long[:256], long[1:257]],):
        assert langid.phrases(others, langid.tables((long, long[::-1]))).tolist() == [[plain_phrases(x, t) for t in (long, long[::-1])] for x in others]
    for _ in range(40):
        train = tuple("".join(rng.choice("abc \u00e9") for _ in range(rng.randint(1, 60))).encode() for _ in range(3))
        others = ["".join(rng.choice("abcd \u00e9\u00e8") for _ in range(rng.choice((1, 5, 30, 700)))).encode() for _ in range(6)]
        assert langid.phrases(others, langid.tables(train)).tolist() == [[plain_phrases(x, t) for t in train] for x in others]


def test_language_against_search(spark):
    """The predictions on whole texts are those of a plain search in the same training texts."""
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text"), train_bytes=3000)
    assert len({len(t) for t in model.values()}) == 1 and len(model) > 1
    rows = [(i, t) for i, t in texts() if t and len(t) < 3000][:25]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        n = sorted((plain_phrases(langid.folded(t.encode()), x), lang) for lang, x in model.items())
        assert got[i]["lang_pred"] == n[0][1] and got[i]["score"] == 1 - n[0][0] / n[1][0]


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op5_language_id(spark, sf).collect()
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held) > 100


def test_language_of_copies(spark):
    """A language whose rows are mostly copies keeps its distinct texts; a column of other things is an error."""
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    many = spark.range(20_000).selectExpr("'a' AS lang", f"element_at(split('{' '.join(words)}', ' '), CAST(id % 5 AS INT) + 1) AS text")
    model = langid.fit(many.union(spark.createDataFrame([("b", "un texte")], "lang string, text string")))
    assert sorted(model["a"].decode().split()) == sorted(words) and model["b"] == b" un texte "
    with pytest.raises(ValueError, match="more than"):
        langid.fit(spark.range(100).selectExpr("CAST(id AS STRING) AS lang", "'x' AS text"))


# 6 -----------------------------------------------------------------------------


def held_words(rows, k):
    """Of each document (doc_id, words) the places of words in stretches of k words that a document of a smaller id holds too."""
    seen, out = {}, {}
    for i, w in rows:
        for n in range(len(w) - k + 1):
            seen[tuple(w[n : n + k])] = min(i, seen.get(tuple(w[n : n + k]), i))
    for i, w in rows:
        out[i] = {n + m for n in range(len(w) - k + 1) if seen[tuple(w[n : n + k])] < i for m in range(k)}
    return out


def passages(rng):
    """Documents whose own words are all different, with passages, parts of them and passages within passages set in anywhere."""
    word = iter(f"w{k}" for k in range(10**6))
    pool = [[next(word) for _ in range(rng.randint(20, 120))] for _ in range(12)]
    docs = []
    for i in range(160):
        own = [next(word) for _ in range(rng.randint(0, 80))]
        for p in rng.sample(pool, rng.randint(0, 3)) + [pool[0]] * (i % 3 == 0):
            lo = rng.choice((0, 0, rng.randrange(len(p))))
            part = p[lo : rng.choice((len(p), rng.randint(lo, len(p))))]
            if not set(part) & set(own):
                at = rng.randint(0, len(own))
                own[at:at] = part
        docs.append((i, own))
    return docs


def test_small_languages(spark):
    """A language with little text is found beside one with much, and doesn't shorten the other's automaton."""
    much = " ".join(f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "rstvw")
    rows = [("a", much)] * 3 + [("a", much[::-1]), ("b", "qux quy quz xyz zyx yxq zqx")]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model["b"]) == 29 and len(model["a"]) > 1000
    docs = spark.createDataFrame([(1, "quz xyz qux"), (2, "bar dit fov gus"), (3, "xyz quy")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()} == {1: "b", 2: "a", 3: "b"}


@pytest.mark.parametrize("rare", [2, 4, 10**6])
def test_line_dedup_brute_force(spark, rare):
    """Nothing goes but what an earlier document holds in 30 words; with all holders linked, all of that goes, and most of it anyway."""
    rng = random.Random(13)
    docs = passages(rng)
    rows = [(i, "".join(x + rng.choice((" ", "  ", "\n", ". ")[:3]) for x in w)) for i, w in docs]
    got = {r["doc_id"]: r for r in linededup.without_lines(spark.createDataFrame(rows, "doc_id long, text string"), rare=rare).collect()}
    may, removed = held_words(docs, 30), 0
    for i, w in docs:
        left = got[i]["text"].split()
        gone = {k for k, x in enumerate(w) if x not in set(left)}
        assert left == [x for k, x in enumerate(w) if k not in gone] and got[i]["n_removed"] == len(gone) and got[i]["n_words"] == len(w)
        assert gone <= may[i] and (rare <= 160 or gone == may[i])
        removed += len(gone)
    assert removed >= (0.98 if rare < 160 else 1) * sum(map(len, may.values())) > 1000


def test_line_dedup_of_the_tables(spark):
    """Of the stretches of 30 words that earlier documents hold all goes, and of shorter texts exact copies; nothing else."""
    rows = [(i, (t or "").split()) for i, t in texts()]
    may, short = held_words(rows, 30), {}
    for i, w in rows:
        if 0 < len(w) < 30 and short.setdefault(tuple(w), i) < i:
            may[i] = set(range(len(w)))
    got = {r["doc_id"]: r["n_removed"] for r in linededup.op6_line_dedup(spark, SF).collect()}
    assert {i for i in got if got[i]} == {i for i in may if may[i]} and all(got[i] <= len(may[i]) for i in got)
    assert sum(got.values()) >= 0.99 * sum(map(len, may.values())) > 0


def test_line_dedup_recall(spark):
    """Pairs that share a passage of 30 to 60 words and nothing else lose it in the later one, whole; copies of any length go."""
    word = iter(f"w{k}" for k in range(10**6))
    take = lambda n: [next(word) for _ in range(n)]
    rows, want = [], {}
    for k in range(200):
        shared, head, tail = take(30 + k % 31), take(k % 50), take(k % 37)
        rows += [(2 * k, " ".join(take(k % 41) + shared + take(k % 23))), (2 * k + 1, " ".join(head + shared + tail))]
        want[2 * k + 1] = head + tail
    for n in range(1, 31):
        text = take(n)
        rows += [(1000 + 3 * n, " ".join(text)), (1001 + 3 * n, " \n".join(text)), (1002 + 3 * n, " ".join([*text, "more"]))]
        want |= {1001 + 3 * n: [], 1002 + 3 * n: [*text, "more"] if n < 30 else ["more"]}
    got = {r["doc_id"]: r["text"].split() for r in linededup.without_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (want[i] if i in want else t.split()) for i, t in rows)


def test_line_dedup_salted(spark, monkeypatch):
    """Frequent lines in many salts, runs of a few rows: the same passages go."""
    rng = random.Random(16)
    passage = [f"p{k}" for k in range(100)]
    rows = [(i, " ".join([f"h{i}x{k}" for k in range(i % 20)] + passage + [f"t{i}x{k}" for k in range(i % 13)])) for i in range(400)]
    rows += [(1000 + i, "same short text") for i in range(300)]
    rng.shuffle(rows)
    for name, value in (("SAMPLE", 2), ("FREQUENT", 4), ("SALTED", 20), ("RUN", 50)):
        monkeypatch.setattr(linededup, name, value)
    got = {r["doc_id"]: r["text"].split() for r in linededup.without_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = {i: t.split() for i, t in rows}
    assert all(got[i] == ([w for w in left[i] if w[0] != "p"] if 0 < i < 1000 else [] if i > 1000 else left[i]) for i in got)


def test_outermost_runs():
    """Against the definition; the widest run always stays."""
    rng = random.Random(18)
    for _ in range(300):
        runs = [[i := rng.randrange(60), i + rng.choice((0, 3, 20, 50)), 0, 0] for _ in range(rng.randint(1, 12))]
        want = [r for r in runs if not any(x[0] <= r[0] - 5 and x[1] >= r[1] + 5 for x in runs)]
        assert linededup.outermost(runs, 5) == sorted(want) and want


def test_linked_places(spark):
    """Each place of a group meets its first one, and in few places all earlier ones; never a document itself."""
    rng = np.random.default_rng(17)
    n = 600
    line, doc = rng.integers(0, 40, n), rng.integers(0, 30, n)
    row, start, before, after = doc * 7, rng.integers(0, 99, n).astype(np.int32), rng.integers(0, 3, n).astype(np.int32), rng.integers(0, 3, n).astype(np.int32)
    order = np.lexsort((start, row, doc, line))
    line, doc, row, start, before, after = (x[order] for x in (line, doc, row, start, before, after))
    salt = np.zeros(n, np.int32)
    for rare in (1, 8, 10**6):
        i, j, first = linededup.linked(line, salt, doc, row, start, before, after, rare)
        got = set(zip(i.tolist(), j.tolist(), strict=True))
        want = set()
        for k in range(n):
            own = [m for m in range(k) if line[m] == line[k]]
            few = (line == line[k]).sum() <= rare
            for m in own if few else (own[:1] + [m for m in own if after[m] == after[k]][:1] + [m for m in own if before[m] == before[k]][:1]):
                if doc[m] < doc[k]:
                    want.add((k, m))
        assert got == want and line[first].tolist() == sorted(set(line.tolist()))


def test_line_dedup_links(spark):
    """A paragraph goes although each of its sentences is first held by another document, and although thousands hold each of its lines."""
    lines = [f"Stock {w} " + " ".join(f"{w}{k}" for k in range(8)) for w in "abcdef"]
    rows = [*enumerate(lines), (10, " ".join(lines)), (11, " ".join(lines))]
    passage = " ".join(f"p{k}" for k in range(120))
    rows += [(100 + i, f"head{i} {passage} tail{i}") for i in range(300)]
    moved = " ".join(f"p{k}" for k in [*range(60, 120), *range(60)])
    rows += [(500, f"own words {moved} of {passage} this"), (501, "short and clean")]
    got = {r["doc_id"]: r["text"] for r in linededup.without_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == t for i, t in rows if i <= 100 or i == 501 if i != 11)
    assert got[11] == "" and all(got[100 + i] == f"head{i} tail{i}" for i in range(1, 300))
    assert "p5 " not in got[500] and "p70 " not in got[500] and got[500].startswith("own words ") and got[500].endswith("this")


def test_line_starts():
    """Starts against their definition; a shared stretch of words + window - 1 holds a start of both texts."""
    rng = np.random.default_rng(14)
    for _ in range(60):
        words, window = 6, int(rng.integers(1, 7))
        shared = rng.integers(0, 1 << 63, words + window - 1).astype(np.uint64)
        texts_ = [np.concatenate((rng.integers(0, 1 << 63, rng.integers(0, 20)).astype(np.uint64), shared, rng.integers(0, 9, rng.integers(0, 20)).astype(np.uint64))) for _ in range(2)] + [shared[:3]]
        firsts = np.cumsum([0, *map(len, texts_)])
        at, lines = linededup.line_starts(np.concatenate(texts_), firsts, words, window)
        want = set()
        for t, x in enumerate(texts_):
            each = common.windows(x, words)
            for k in range(max(1, len(each) - window + 1)) if len(each) else ():
                part = each[k : k + window]
                want |= {(firsts[t] + k + i, int(h)) for i, h in enumerate(part) if h == part.min()}
        want |= {(firsts[t] + i, int(h)) for t, x in enumerate(texts_) if len(each := common.windows(x, words)) for i, h in enumerate(each[:window]) if h == each[:window].min()}
        assert set(zip(at.tolist(), lines.tolist(), strict=True)) == want
        assert set(common.windows(shared, words).tolist()) & set(lines[at < firsts[1]].tolist()) & set(lines[at >= firsts[1]].tolist())


def test_word_hashes():
    """Equal words and windows have equal hashes wherever they stand, across slices, long words and odd bytes; others differ."""
    rng = random.Random(15)
    for keep in (linededup.WORDS, decontam.WORDS, ngramjoin.WORDS):
        rows = ["".join(rng.choice(["a", "B", "b", " ", "é", "\n", "1", ".", "日本"]) for _ in range(rng.randint(0, 40))).encode() for _ in range(300)] + [b"x" * 300_000, b"", b"x" * 299_999]
        array = pa.array([*rows, None], pa.binary())
        hashes, firsts = common.word_hashes(common.Texts.of(array), keep)
        words = [r.translate(keep).split() for r in [*rows, b""]]
        assert np.diff(firsts).tolist() == [len(w) for w in words]
        flat = [w for own in words for w in own]
        assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist(), strict=True)))
        two = common.windows(hashes, 2)
        assert len(set(zip(flat, flat[1:]))) == len(set(two.tolist())) == len(set(zip(flat, flat[1:], two.tolist())))
        part = pa.RecordBatch.from_arrays([array.slice(5)], ["t"])
        assert sum((p.column(0).to_pylist() for p in common.slices(part, 0)), []) == array.slice(5).to_pylist()


# 7 -----------------------------------------------------------------------------


def plain_components(rows, shingle=3, similar=90):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= similar * len(sets[a] | sets[b]):
            up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("rare", [3, 48])
def test_ngram_join_brute_force(spark, monkeypatch, rare):
    """Families around the threshold, copies, boilerplate; small bounds send them through combinations and tiles."""
    monkeypatch.setattr(ngramjoin, "RARE", rare)
    monkeypatch.setattr(ngramjoin, "TILE", 8)
    rng = random.Random(7)
    rows = [(i, None if i % 9 == 0 else " ".join(rng.choice("abcdefgh") for _ in range(i % 5))) for i in range(30)]
    for f in range(2):
        base = [f"F{f}w{k}" for k in range(70)]
        for _ in range(18):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(70)] = f"x{rng.randrange(40)}"
            rows.append((len(rows), " ".join(own)))
    for i in range(14):
        rows.append((len(rows), " ".join([f"boiler{k}" for k in range(25)] + [f"own{i}w{k}" for k in range(20)])))
    rows += [(len(rows) + k, rows[40][1]) for k in range(5)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


def test_ngram_join_sql(spark):
    compare(spark, ngramjoin.op7_ngram_jaccard(spark, SF), ngramjoin.OP7_SQL)


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    up = {x: x for e in links for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), common.Scratch(spark, "test")).collect()}
    assert got == {x: top(x) for x in up if any(a != b and x in (a, b) for a, b in links)}


def test_prefix_lemma():
    for n in range(1, 400):
        step = ngramjoin.size_step(n, 90)
        for m in range(n, 400):
            if 100 * n >= 90 * m:
                assert ngramjoin.size_step(m, 90) - step in (0, 1)
    rng = np.random.default_rng(9)
    for _ in range(200):
        n = int(rng.integers(12, 300))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate((np.delete(x, rng.integers(0, len(x), len(x) // 30)), rng.integers(0, 1 << 63, len(x) // 40).astype(np.uint64))))
        if 100 * len(np.intersect1d(x, y)) >= 90 * len(np.union1d(x, y)):
            keys = [set(ngramjoin.combos_of(s[: ngramjoin.prefix_length(len(s), 90, ngramjoin.extended(len(s), 90))].view(np.int64), len(s), 90)) for s in (x, y)]
            assert keys[0] & keys[1]
            differ = int(np.bitwise_count(np.bitwise_xor(*(np.frombuffer(ngramjoin.sketch_of(s), np.uint8) for s in (x, y)))).sum())
            assert differ <= len(np.setxor1d(x, y))


# 8 -----------------------------------------------------------------------------


def test_chat_sql(spark):
    compare(spark, chat.op8_chat_format(spark, SF), chat.OP8_SQL)


def test_chat_round_trip():
    tok = chat.tokenizer(chat.TOKENIZER)
    rng = random.Random(10)
    parts = ["<", "|", "\\", "im_end|>", chat.END, chat.START, chat.SEP, "\n", " ", "é😀", "ok", "<|endoftext|>", "<\\|"]
    for _ in range(400):
        turns = [(rng.choice(("user", "assistant", "system")), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(1, 5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        enc = tok.encode(text, add_special_tokens=False)
        ends = np.maximum.accumulate(np.array([e for _, e in enc.offsets]))
        assert chat.masked_text(text, ends, chat.mask(ends, spans)) == "".join(t for r, t in turns if r == "assistant")


# 9 -----------------------------------------------------------------------------


def plain_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_brute_force(spark):
    rng = random.Random(11)
    rows = texts() + [(10_000 + k, "".join(rng.choice(["a ", "b ", "a\n", "b\n", "\n", " \t", "#", "é "]) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    got = quality_llr.rule_counts(quality_llr.with_words(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = {i: plain_rules(t) for i, t in rows}
    assert all((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[r["doc_id"]] for r in got)


def test_log_ratio_brute_force(spark):
    import math

    rows = [(1, "a b a"), (2, "c d"), (3, ""), (4, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(1,), (4,)], "trusted_id long")
    size = 64
    grams = {r["doc_id"]: r["g"] for r in quality_llr.with_words(docs).select("doc_id", quality_llr.buckets(quality_llr.F.col("hashed"), quality_llr.F.col("n"), size).alias("g")).collect()}
    assert {i: len(g) for i, g in grams.items()} == {1: 5, 2: 3, 3: 0, 4: 3}
    raw, good = Counter(x for g in grams.values() for x in g), Counter(grams[1] + grams[4])
    w = [math.log((good[b] + 1) / (sum(good.values()) + size)) - math.log((raw[b] + 1) / (sum(raw.values()) + size)) for b in range(size)]
    got = {r["doc_id"]: r["score"] for r in quality_llr.judge(docs, trusted, modulus=size).collect()}
    assert all(math.isclose(got[i], sum(w[b] for b in g) / max(1, len(g)), abs_tol=1e-12) for i, g in grams.items())


def test_all_good_documents_are_trusted(spark):
    labels = spark.range(25_000).selectExpr("id AS doc_id", "1 AS quality")
    assert quality_llr.trusted_ids(labels.union(labels)).count() == 25_000


# 10 ----------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(d)))
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


def test_pii_base_brute_force():
    rng = random.Random(12)
    parts = ["a", "@", ".", "b.c", "-", "+1", " ", "(555)", "4111 1111 1111 1111", "255", "256.", "0.0.0.0", "é", "1", "x@y.z", "5500-0000-0000-0004"]
    weights = pii.trained()
    for text in [t for _, t in texts()] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(4000)]:
        base, spans = pii.find(text, weights)
        assert base == plain_spans(text), text
        assert set(base) <= set(spans)
        added = sorted(set(spans) - set(base))
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(added)) and not any(s < e2 and s2 < e for s, e, _ in added for s2, e2, _ in base)


def test_field_is_exact(monkeypatch):
    """Best segmentation and marginals, of segments and of near neighbours, against all subsets of a small lattice."""
    import math

    rng = random.Random(13)
    monkeypatch.setattr(pii, "NEAR", 3)
    for _ in range(80):
        segments = sorted({(s := rng.randrange(14), s + rng.randint(1, 5), rng.choice("ab")) for _ in range(rng.randint(1, 8))}, key=lambda x: (x[1], x[0], x[2]))
        scores = [rng.uniform(-2, 2) for _ in segments]
        weights = {f"{a}>{b}": rng.uniform(-2, 2) for a in "ab" for b in "ab"}
        sets = [c for k in range(len(segments) + 1) for c in itertools.combinations(range(len(segments)), k) if all(segments[a][1] <= segments[b][0] or segments[b][1] <= segments[a][0] for a, b in itertools.combinations(c, 2))]
        near = lambda c: [(a, b) for a, b in itertools.pairwise(c) if segments[b][0] - segments[a][1] <= 3]
        score = lambda c: sum(scores[i] for i in c) + sum(weights[f"{segments[a][2]}>{segments[b][2]}"] for a, b in near(c))
        value = {c: score(c) for c in sets}
        assert math.isclose(score([segments.index(s) for s in pii.best(segments, scores, weights)]), max(value.values()), abs_tol=1e-9)
        z = sum(math.exp(v) for v in value.values())
        single, double = pii.marginals(segments, scores, weights)
        for i, p in enumerate(single):
            assert math.isclose(p, sum(math.exp(v) for c, v in value.items() if i in c) / z, abs_tol=1e-9)
        for pair, p in double.items():
            assert math.isclose(p, sum(math.exp(v) for c, v in value.items() if pair in near(c)) / z, abs_tol=1e-9)


def test_pii_adds_and_redacts():
    """Precision and recall of each kind on fresh sentences, all spans there are counted, those that no proposal holds too."""
    weights = pii.trained()
    for kind, (there, right, said) in pii.recall(weights, 600, 99).items():
        assert there > 80 and right >= 0.9 * there and right >= 0.85 * said, (kind, there, right, said)
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and é a@b.de'
    got = pii.scan(text.encode(), weights)
    assert got[0] == 1 and got[4] == hashlib.sha256(b"email:57:63").hexdigest() and got[5] == "secret:9:49,email:57:63"
    assert pii.redact(text, got[5]) == 'token = "[SECRET]" and é [EMAIL]'


def test_pii_boundaries():
    """Neighbouring numbers are told apart; one leading group of an address, long secrets and shorter domains are proposed."""
    weights = pii.trained()
    spans = lambda text: {text[s:e] for s, e, _ in pii.find(text, weights)[1]}
    assert spans("tel 0171 2345 678 0172 3456 789 end") == {"0171 2345 678", "0172 3456 789"}
    assert "fe80::1" in spans("host fe80::1 up") and not spans("at 12:30:45 on 2024-01-15")
    secret = "aB3xY7" * 60
    assert spans(f"token {secret} end") == {secret}
    segments = pii.lattice("room 204 555-123-4567 mail x@é.com.then")
    assert (9, 21, "phone") in segments and {e for s, e, k in segments if k == "email"} == {34, 39}


# pipeline ----------------------------------------------------------------------


def test_pipeline_against_brute_force(spark):
    """Every stage on the output of the one before, each decision checked against a plain version."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        docs = f(spark, docs, SF)
        if k < 4:
            docs = common.saved(docs, "test")
            after.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert after[0] == rows  # all of them have letters
    lines = {r["doc_id"]: r["text"] for r in linededup.without_lines(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert after[1] == {i: t for i, t in lines.items() if t == rows[i] or t.strip()} and len(after[1]) < len(rows)
    groups = plain_components(after[1].items(), 5, 80)
    assert after[2].keys() == {i for i in after[1] if groups[i][1] == i}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(after[2].items()))
    leaks = {r[0] for r in con.sql(f"SELECT doc_id FROM ({decontam.OP2_SQL})").fetchall()}
    assert leaks and after[3].keys() == after[2].keys() - leaks
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == after[3].keys()
