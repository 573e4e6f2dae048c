"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronospan.llm import chat, decontam, langid, licenses, linededup, ngramjoin, packing, pii, quality_fm, quality_llr

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, found int, gone int, text_hash string, component string, words string, n int, gone_id int, block int, label int, key int"
EXTRA = (0.5, "r", 1, 1, "h", "c", "w", 1, 1, 1, 1, 1)
LONG = "lorem ipsum dolor sit amet. " * 9000
SOME = "the quick brown fox jumps over the lazy dog while the cat sleeps in the warm sun of the garden"
ROWS = [
    (1, SOME, "en", "a", 94), (1, SOME, "en", "a", 94), (2, SOME, None, None, None), (3, None, "en", "a", None), (4, "", "en", None, 0), (5, " \n\t ", "fr", "a", 3), (None, "sans identité, un texte", "fr", "a", 23), (None, None, None, None, None),
    (6, LONG, "la", "b", len(LONG)), (7, "x" * 200_000, "la", "b", 200_000), (8, "1234 5678", None, "b", 9), (9, "…", "en", "b", 1), (10, "één  twee drie\n\n 😀 <|endoftext|> <|im_end|>", "nl", "b", 40),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (2, 0), (6, 1), (7, 0), (None, 1), (8, None)], "doc_id long, label int")


MODEL = {"en": b" the quick dog ", "fr": b" sans un texte "}
WEIGHTS = {}
EACH = {
    "licenses": lambda s, d: licenses.scan_licenses(d),
    "language": lambda s, d: langid.identify(d, MODEL),
    "pii": lambda s, d: pii.find_pii(d, WEIGHTS),
    "quality": lambda s, d: quality_fm.scored(d, quality_fm.fit(d, labels(s))),
    "rules": lambda s, d: quality_llr.judge(d, quality_llr.trusted_ids(labels(s).withColumnRenamed("label", "quality"))),
    "lines": lambda s, d: linededup.without_lines(d),
    "ngrams": lambda s, d: ngramjoin.join_ngrams(d),
}


@pytest.mark.parametrize("name", EACH)
def test_one_row_for_each_row(spark, docs, none, name):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in EACH[name](spark, docs).collect())
    assert got == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert EACH[name](spark, none).count() == 0


def test_values_of_edge_rows(spark, docs):
    lang = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, MODEL).collect()}
    assert all(lang[i] == ("und", 0.0) for i in (3, 4, 5, 8, 9)) and lang[1][0] == "en"
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}
    found = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert found[3]["n_words"] == 0 and found[7]["n_words"] == 1 and found[3]["first_word"] is None
    rules = {r["doc_id"]: r for r in quality_llr.judge(docs, spark.createDataFrame([], "trusted_id long")).collect()}
    assert rules[3]["base_failed"] and rules[3]["n_words"] == 0 and rules[1]["score"] == 0.0 and not rules[1]["base_failed"]
    joined = {r["doc_id"]: r for r in ngramjoin.join_ngrams(docs).collect()}
    assert joined[2]["component_id"] == 1 and joined[4]["component_id"] == 4 and joined[4]["n_shingles"] == 0 and joined[7]["n_shingles"] == 1
    gone = {r["doc_id"]: r for r in linededup.without_lines(docs, block_words=10).collect()}
    assert gone[1]["text"] == SOME and gone[2]["text"] == "" and gone[3]["text"] is None and gone[6]["text"] == LONG


def test_packing_edges(spark, docs, none):
    rows = packing.pack_documents(docs).collect()
    assert sum(1 for r in rows if r["piece"] == 0) == len(ROWS)
    assert {r["length"] for r in rows if r["doc_id"] in (3, 4)} == {1}
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack_documents(none).count() == 0


def test_decontamination_edges(spark, docs, none):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog", 0), (1, "quick brown fox jumps over the lazy dog", 0), (2, None, 0), (3, "", 0), (None, "lorem ipsum", 0), (4, "dog", 0)], "item_id long, text string, n_shared int")
    got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in decontam.find_leaks(docs, items).collect())
    assert got == sorted([("1", "1")] * 4 + [("2", "1")] * 2 + [("1", "4")] * 2 + [("2", "4"), ("6", "None")])
    assert decontam.find_leaks(none, items).count() == 0
    assert decontam.find_leaks(docs, items.where("false")).count() == 0


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "b"), (2, 1, "assistant", ""), (3, 0, "assistant", "x " * 60_000)]
    turns = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(turns)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 1, 3: 1}
    assert got[3]["loss_chars"] == 120_000 and got[2]["loss_chars"] == 0 and got[None]["loss_chars"] == 1
    assert chat.digest(chat.format_conversations(turns.where("false"))).count() == 0


def test_fits_without_labels(spark, docs, none):
    assert langid.fit(none.select("lang", "text")) == {}
    model = quality_fm.fit(docs, labels(spark).where("false"))
    assert {round(r["score"], 6) for r in quality_fm.scored(docs, model).collect()} == {0.5}
    only = quality_fm.fit(docs, labels(spark).where("label = 1"))
    assert all(r["score"] > 0.99 for r in quality_fm.scored(docs, only).collect())


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stage_edges(spark, docs, none, stage, tmp_path):
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, f = corpus_pipeline.STAGES[stage]
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    out = f(spark, docs.select(*base), str(tmp_path))
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == base
        clashing = docs.select(*base, F.lit(1).alias("r"), F.lit("x").alias("row"), F.lit("x").alias("key"), F.lit("x").alias("found"), F.lit("x").alias("rest"), F.lit(2).alias("n_removed"), F.lit("x").alias("lang_pred"), F.lit("x").alias("a.b"), F.lit(3).alias("c0"))
        more = f(spark, clashing, str(tmp_path))
        assert more.columns == clashing.columns and more.count() == out.count() and {tuple(r)[5:] for r in more.collect()} == {(1, "x", "x", "x", "x", 2, "x", "x", 3)}
        assert out.where(F.col("doc_id") == 6).select("text").first()["text"] == LONG
    left = out.count()
    assert left > 0
    assert f(spark, none.select(*base), str(tmp_path)).count() == 0
