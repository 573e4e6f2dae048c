"""Phrase collocations, counted in suffix arrays of word ids.

Texts are dealt to shards of about SHARD_BYTES.  A shard numbers its words, each
language with numbers of its own, and sorts all suffixes that begin at a word by
numpy prefix doubling: ranks of the first word give ranks of the first two, those
give ranks of the first four.  A suffix ends with its piece, the stretch between two
marks of punctuation.  Neighbours of the suffix array that share n words or more make an LCP
interval: a phrase of n words and its count in the shard.  Counts of all shards
are merged by a shuffle on the phrase.

* Pass 1 merges the counts of all phrases of fewer words than the longest, under
  64-bit keys, and keeps the keys that reach the bound.  A collision can only add.
* Their bit filter, of at most FILTER_BITS whatever their number, goes to pass 2,
  which counts, as strings, the phrases whose parts all may have reached it: a
  phrase is at most as frequent as its parts.  What passes by chance only costs.
* Candidates then meet the counts of their parts in one join, a row for each part
  of each cut, and of each cut's score the lowest counts.  AQE splits a part that
  many candidates share.

Defined results: a null text is empty; a null language is ``und``; repeated rows
count again; an empty table gives an empty result; other columns, ids included,
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronospan.llm.common import Scratch, Texts, byte_table, configured, hashes_at, mixed, places_of, table

LONGEST, LEAST, INSIDE, TOP = 3, 10, 50, 2000
#: Heaps in which a language's candidates are ranked first.
HEAPS = 16
#: Bytes of texts of a shard; a piece that is longer is a shard.
SHARD_BYTES = 4 << 20
#: Bits of the filter, at most, and a key.
FILTER_BITS, BITS_A_KEY = 1 << 27, 16

MARKS = b".,;:!?\n\x0b\x0c\r"
WORDS = byte_table(bytes(b for b in range(256) if b not in b" \t" and b not in MARKS))
_MARK = np.isin(np.arange(256), np.frombuffer(MARKS, np.uint8))
_NEXT = re.compile(b"[" + MARKS + b"]")
_STEP = np.uint64(0xA0761D6478BD642F)


def dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones, from 1."""
    order = np.argsort(keys)
    own = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate((np.ones(1, bool), own[1:] != own[:-1])))[: len(keys)]
    return out


def suffix_ranks(words: np.ndarray, rest: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4 ... words, up to ``depth``, by prefix doubling.

    ``rest``: words from here to the end of the piece; what ends sooner ranks before what goes on.
    """
    ranks, k = [dense(words)], 1
    while k < depth:
        after = np.zeros(len(words), np.int64)
        on = np.flatnonzero(rest > k)
        after[on] = ranks[-1][on + k]
        ranks.append(dense(ranks[-1] * (len(words) + 1) + after))
        k *= 2
    return ranks


def lcp_intervals(ranks: list[np.ndarray], rest: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n from 1 to ``depth``: n, a place of each phrase of n words, and its count."""
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(order), np.int64)  # with the suffix before, up to depth
    lcp[1:] = ranks[0][a] == ranks[0][b]
    for n in range(2, depth + 1):
        same = np.flatnonzero((lcp[1:] == n - 1) & (rest[a] >= n) & (rest[b] >= n))
        lcp[1:][same[ranks[0][a[same] + n - 1] == ranks[0][b[same] + n - 1]]] = n
    for n in range(1, depth + 1):
        own = np.flatnonzero(rest[order] >= n)
        first = np.flatnonzero(lcp[own] < n)
        yield n, order[own[first]], np.diff(np.append(first, len(own)))


class Shard:
    """The words of some texts: hashes with the language, and the words left in each one's piece."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.bytes = b"".join(texts)
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64)))
        data = np.frombuffer(self.bytes, np.uint8)
        self.low, self.starts, self.ends, firsts = places_of(Texts(data, at), WORDS)
        self.langs = sorted(set(langs))
        number = {x: k for k, x in enumerate(self.langs)}
        self.lang = np.repeat(np.array([number[x] for x in langs], np.int64), np.diff(firsts))
        salts = np.array([salt(x) for x in self.langs], np.uint64)
        self.words = mixed(hashes_at(self.low, self.starts, self.ends) ^ salts[self.lang]) if len(self.starts) else np.zeros(0, np.uint64)
        # a piece ends at a mark before the next word, and with its text
        piece = np.concatenate((np.zeros(1, np.int64), np.cumsum(_MARK[data])))[self.starts] + np.searchsorted(at, self.starts, "right")
        last = np.append(np.flatnonzero(piece[1:] != piece[:-1]), len(piece) - 1)
        self.rest = np.repeat(last, np.diff(np.concatenate((np.full(1, -1), last)))) - np.arange(len(piece)) + 1 if len(piece) else piece

    def key(self, places: np.ndarray, n: int) -> np.ndarray:
        """64-bit key of the phrase of n words at each place."""
        out = self.words[places]
        for k in range(1, n):
            out = mixed(out * _STEP ^ self.words[places + k])
        return out

    def phrases(self, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if len(self.words):
            yield from lcp_intervals(suffix_ranks(self.words, self.rest, depth), self.rest, depth)

    def string(self, places: np.ndarray, n: int) -> list[bytes]:
        """The phrases at places, lower-cased, words joined by one space."""
        low = self.low.tobytes()
        return [b" ".join(low[a:b].split()) for a, b in zip(self.starts[places].tolist(), self.ends[places + n - 1].tolist(), strict=True)]


def salt(lang: str) -> int:
    """A number of the language, of its bytes."""
    out = 0x51
    for b in lang.encode():
        out = (out * 0x100000001B3 ^ b) % (1 << 64)
    return int(mixed(np.array([out], np.uint64))[0])


def stretches(text: bytes) -> Iterator[bytes]:
    """A text in stretches of SHARD_BYTES or a bit more, cut after marks."""
    at = 0
    while len(text) - at > SHARD_BYTES:
        mark = _NEXT.search(text, at + SHARD_BYTES)
        to = mark.end() if mark else len(text)
        yield text[at:to]
        at = to
    if at < len(text):
        yield text[at:]


def shards(parts: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """The shards of batches of (text, lang)."""
    texts: list[bytes] = []
    langs: list[str] = []
    size = 0
    for part in parts:
        for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            for own in stretches(text):
                if size and size + len(own) > SHARD_BYTES:
                    yield Shard(texts, langs)
                    texts, langs, size = [], [], 0
                texts.append(own)
                langs.append(lang)
                size += len(own)
    if texts:
        yield Shard(texts, langs)


def by_shard(docs: DataFrame, make: Callable[[], Callable[[Shard], Iterator[list]]], columns: str) -> DataFrame:
    own = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("l"))
    names = [c.split()[0] for c in columns.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_shard = make()
        for shard in shards(parts):
            for made in of_shard(shard):
                yield pa.RecordBatch.from_arrays(made, names)

    return own.mapInArrow(batches, columns)


def keyed(docs: DataFrame, depth: int) -> DataFrame:
    """key and f of each phrase of up to ``depth`` words in a shard; lang and f of all words of a language."""

    def make() -> Callable[[Shard], Iterator[list]]:
        def of_shard(shard: Shard) -> Iterator[list]:
            for n, places, counts in shard.phrases(depth):
                yield [pa.nulls(len(places), pa.string()), pa.array(shard.key(places, n).view(np.int64)), pa.array(counts, pa.int64())]
            yield [pa.array(shard.langs), pa.nulls(len(shard.langs), pa.int64()), pa.array(np.bincount(shard.lang, minlength=len(shard.langs)))]

        return of_shard

    return by_shard(docs, make, "lang string, key long, f long")


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Two bits for each key, in words of 64: FILTER_BITS at most come to the driver and go to the tasks."""
    bits = 64
    while bits < min(FILTER_BITS, BITS_A_KEY * keys.count()):
        bits *= 2
    slot = F.explode(F.array(F.col("key"), F.shiftrightunsigned("key", 32))).alias("b")
    set_bits = keys.select(slot).select(F.col("b").bitwiseAND(F.lit(bits - 1)).alias("b"))
    words = set_bits.groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("w")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("at").to_numpy()] = words.column("w").to_numpy().view(np.uint64)
    return out


def holds(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for b in (keys, keys >> np.uint64(32)):
        b = b & np.uint64(len(filter_) * 64 - 1)
        out &= (filter_[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def spelled(docs: DataFrame, filter_: np.ndarray, longest: int) -> DataFrame:
    """lang, phrase and f of each phrase of a shard whose parts pass the filter, itself included below the longest."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def make() -> Callable[[Shard], Iterator[list]]:
        bits = shared.value

        def of_shard(shard: Shard) -> Iterator[list]:
            n_words = len(shard.words)
            passes = {n: np.zeros(n_words, bool) for n in range(1, longest)}
            for n in range(1, longest):
                at = np.flatnonzero(shard.rest >= n)
                if n > 1:
                    at = at[passes[n - 1][at] & passes[n - 1][at + 1]]
                passes[n][at] = holds(bits, shard.key(at, n))
            for n, places, counts in shard.phrases(longest):
                may = passes[n][places] if n < longest else passes[n - 1][places] & passes[n - 1][places + 1]
                places, counts = places[may], counts[may]
                yield [pa.array(np.array(shard.langs, object)[shard.lang[places]], pa.string()), pa.array(shard.string(places, n), pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]

        return of_shard

    return by_shard(docs, make, "lang string, phrase string, f long")


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits; a phrase is at most as frequent as its parts, so it fits a long."""
    exact = [f"cast({c} as decimal(15, 0))" for c in (a, a, left, right)]
    return F.expr(f"({exact[0]} * {exact[1]} * cast(1000000 as decimal(7, 0))) div ({exact[2]} * {exact[3]})")


def mine_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the phrases of 2 to ``longest`` words that occur ``least`` times.

    a: occurrences; l and r: those of the two parts of the lowest-scoring cut; n: words
    of the language; score: floor(1000000 * a * a / (l * r)).  A phrase goes if a
    longer one around it has ``inside`` per cent of its occurrences.  Of each
    language the first ``top`` stay, or all.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    merged = scratch.saved(keyed(docs, longest - 1).groupBy("lang", "key").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("key").isNull()), "keys")
    totals = merged.where("key IS NULL").select("lang", F.col("f").alias("n"))
    filter_ = bit_filter(merged.where("key IS NOT NULL").select("key"))
    counts = spelled(docs, filter_, longest).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    counts = scratch.saved(counts, "counts")
    words = F.split("phrase", " ", -1)
    sized = counts.select("lang", "phrase", "f", words.alias("w"), F.size(words).alias("m"))
    candidates = sized.where("m > 1")

    # phrases inside longer candidates
    cuts = lambda most: F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.lit(most)), lambda n: F.transform(F.sequence(F.lit(1), F.col("m") - n + 1), lambda i: F.array_join(F.slice(F.col("w"), i, n), " ")))))
    around = [candidates.where(F.col("m") == m).select("lang", cuts(m - 1).alias("phrase"), "f") for m in range(3, longest + 1)]
    dropped = None
    for own in around:
        dropped = own if dropped is None else dropped.unionByName(own)
    open_ = candidates
    if dropped is not None:
        outer = dropped.groupBy("lang", "phrase").agg(F.max("f").alias("outer"))
        open_ = candidates.join(outer, ["lang", "phrase"], "left").where(F.expr(f"outer IS NULL OR 100 * outer < {int(inside)} * f"))

    # each cut's two parts meet their counts
    parts = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit("l").alias("side"), F.array_join(F.slice(F.col("w"), F.lit(1), k), " ").alias("part")),
        F.struct(k.alias("k"), F.lit("r").alias("side"), F.array_join(F.slice(F.col("w"), k + 1, F.col("m") - k), " ").alias("part")),
    ))))
    asked = open_.select("lang", "phrase", F.col("f").alias("a"), parts.alias("p")).select("lang", "phrase", "a", "p.*")
    met = asked.join(counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("g")), ["lang", "part"])
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("g"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("g"))).alias("r"))
    scored = both.withColumn("score", score("a", "l", "r"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")
    if top is None:
        ranked = lowest.withColumn("rank", rank("lang"))
    else:  # the first of each heap first, so that one task never sees more than HEAPS * top rows of a language
        some = lowest.withColumn("heap", F.pmod(F.xxhash64("phrase"), F.lit(HEAPS))).withColumn("rank", rank("lang", "heap")).where(F.col("rank") <= top)
        ranked = some.withColumn("rank", rank("lang")).where(F.col("rank") <= top).drop("heap")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: each language's first 2,000 collocations of two and three words."""
    return mine_phrases(table(configured(spark), sf_dir, "documents"))


OP13_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
n AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
grams AS (SELECT lang, w[i:i + m - 1] AS g, m FROM i, (SELECT unnest(range(1, {LONGEST} + 1)) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, g, m, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT * FROM f WHERE m > 1),
subs AS (SELECT lang, g[k:k + s - 1] AS g, max(f) AS outer_f FROM (SELECT *, unnest(range(1, m - s + 2)) AS k FROM (SELECT *, unnest(range(2, m)) AS s FROM c)) GROUP BY ALL),
left_over AS (SELECT c.* FROM c LEFT JOIN subs USING (lang, g) WHERE outer_f IS NULL OR 100 * outer_f < {INSIDE} * f),
cut AS (
  SELECT x.lang, x.g, x.f AS a, x.k, l.f AS l, r.f AS r, (1000000::HUGEINT * x.f * x.f // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM left_over) x
  JOIN f l ON l.lang = x.lang AND l.g = x.g[1:x.k] JOIN f r ON r.lang = x.lang AND r.g = x.g[x.k + 1:]),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""
