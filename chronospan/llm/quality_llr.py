"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame operations alone.

Each text's words and pairs of neighbouring words are hashed into BUCKETS.  Two
multinomials over the buckets, one of trusted target documents and one of the
whole raw corpus, give each bucket a log ratio; a text's score is the sum over
its n-grams divided by their number, and every text whose score is at least
THRESHOLD passes.  Raw counts cover every document, trusted counts every document
labelled good.

The rules count characters, symbols, repeated lines and repeated windows of
five words within each row, without a shuffle.  Repeated windows: texts whose
windows all hash apart have none; the others compare the windows themselves.

Defined results: a null or empty text has no words: all counts 0, base_failed.
With no trusted document every log ratio is 0.  A null doc_id is carried and
repeated rows give repeated results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospan.llm.common import id_and_text, table

#: Buckets of the multinomials, pseudo-count of each, lowest score that passes.
BUCKETS, PSEUDO, THRESHOLD = 1 << 14, 1.0, -0.12
#: Rules: fewest words, words of a window, most per cent of words in repeated windows.
MIN_WORDS, WINDOW, MAX_REPEAT = 10, 5, 20
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words between ASCII white space; an empty array if there is none."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def upto(n: Column) -> Column:
    """0 .. n-1, empty if n is 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_words(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, text.alias("text"), words_of(text).alias("words"))
    # each word is hashed once; pairs and windows are hashed from that
    return rows.withColumn("n", F.size("words")).withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))


def buckets(hashed: Column, n: Column, modulus: int) -> Column:
    """Bucket of each word, from its hash, and of each pair of neighbours."""
    one = F.transform(hashed, lambda h: F.pmod(h, F.lit(modulus)).cast("int"))
    two = F.transform(upto(n - 1), lambda i: F.pmod(F.xxhash64(hashed[i], hashed[i + 1]), F.lit(modulus)).cast("int"))
    return F.concat(one, two)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()


def log_ratios(docs: DataFrame, trusted: DataFrame, modulus: int = BUCKETS, pseudo: float = PSEUDO) -> DataFrame:
    """One row, one column ``weights``: the log ratio of each bucket, in order of the buckets."""
    # ids grow with the corpus, so they are never broadcast: texts are dealt by id at every size, those without one by their hash
    own = id_and_text(docs).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    flagged = own.join(trusted.hint("shuffle_hash"), F.col("key") == F.col("trusted_id"), "left").withColumn("good", F.col("doc_id").isNotNull() & F.col("trusted_id").isNotNull())
    rows = with_words(flagged, "good")
    grams = rows.select(F.col("good").cast("long").alias("t"), F.explode(buckets(F.col("hashed"), F.col("n"), modulus)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("good"))
    every = docs.sparkSession.range(modulus).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").fillna(0, ["raw", "good"])
    row = every.agg(F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good"), F.sort_array(F.collect_list(F.struct("b", "raw", "good"))).alias("each"))
    extra = pseudo * modulus

    def ratio(x: Column) -> Column:
        good = F.log((x["good"] + pseudo) / (F.col("all_good") + extra))
        return F.when(F.col("all_good") > 0, good - F.log((x["raw"] + pseudo) / (F.col("all_raw") + extra))).otherwise(F.lit(0.0))

    return row.select(F.transform("each", ratio).alias("weights"))


def rule_counts(rows: DataFrame) -> DataFrame:
    """Adds the counts of the rules to rows of text, words and n."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    words, hashed, n = F.col("words"), F.col("hashed"), F.col("n")
    hashes = F.transform(upto(n - WINDOW + 1), lambda i: F.xxhash64(*(hashed[i + k] for k in range(WINDOW))))
    windows = F.array_sort(F.transform(upto(n - WINDOW + 1), lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i"))))
    s, p = F.col("sorted"), F.col("places")
    same = lambda j, k: F.coalesce(F.get(s, j)["w"] == F.get(s, k)["w"], F.lit(False))
    repeated = F.filter(upto(F.size(s)), lambda j: same(j, j - 1) | same(j, j + 1))
    places = F.array_sort(F.transform(repeated, lambda j: s[j]["i"]))
    covered = F.aggregate(upto(F.size(p)), F.lit(0).cast("long"), lambda a, j: a + F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - p[j], F.lit(WINDOW))))
    return (
        rows.withColumn("lines", lines)
        .withColumn("hashes", hashes)
        .withColumn("sorted", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), windows))
        .withColumn("places", F.when(s.isNotNull(), places))
        .withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length(F.translate("text", SPACE, "")).cast("long"))
        .withColumn("n_symbols", (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("n_repeat_words", F.when(p.isNotNull(), covered).otherwise(F.lit(0)).cast("long"))
        .drop("lines", "hashes", "sorted", "places")
    )


def judge(docs: DataFrame, trusted: DataFrame, modulus: int = BUCKETS, pseudo: float = PSEUDO, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, score and verdict of every document; ``trusted`` holds each trusted id once, as trusted_id."""
    weights = log_ratios(docs, trusted, modulus, pseudo)
    rows = rule_counts(with_words(docs)).withColumn("grams", buckets(F.col("hashed"), F.col("n"), modulus)).withColumn("weights", weights.scalar())
    w, grams = F.col("weights"), F.col("grams")
    score = F.aggregate(grams, F.lit(0.0), lambda a, b: a + w[b]) / F.greatest(F.size(grams), F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    out = rows.withColumn("score", score).withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents, the trusted ones being those labelled good."""
    return judge(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))
