"""Jaccard join on word shingles with token-combination prefixes.

Documents of equal shingle sets are one class, and classes are joined.  Tokens
are 64-bit hashes of shingles, ordered by their value.  Two sets of similarity
SIMILAR per cent or more share k of their first n - ceil(SIMILAR * n) + k tokens.

* Each class's prefix is extended by g tokens, about half as many as the plain
  prefix has, so two similar classes share g + 1 tokens of their prefixes.  Its
  tokens are indexed one by one; tokens of one class go.
* Each class is first compared with the smallest class that shares a token and
  its size step: stars.  Their links make provisional components, and only pairs
  of classes in different components are looked at afterwards, since only those
  can change a component.
* A token of at most RARE classes gives its pairs.  A class with at most g more
  frequent tokens thus meets each similar class at a rare one: only pairs of
  classes that both have more are left, and all that they share is frequent.
* Those dense classes' frequent tokens are dealt into g token classes: of g + 1
  shared ones two fall in one, and the index holds the pairs of tokens of each
  token class.  A combination of at most RARE classes gives its pairs.  Those of
  a more frequent one are first linked to a few centres, then worked off in
  tiles of bounded size: members outside its largest component against all its
  members, each pair at one combination where a few random orders agree on
  one; a tile emits sketch survivors alone.
* Candidates pass an odd sketch of SKETCH bits: bits that differ are tokens that
  differ, so no similar pair is lost.  Survivors are verified on whole sets.

Nothing is capped, and the result is exact but for collisions of 64-bit hashes.

Defined results: a null or wordless text has an empty set, 0 shingles, and is
linked with nothing, so its component is its own doc_id.  Rows of one doc_id
are separate documents; a component is the smallest doc_id among its rows, null
if all are null.  Repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronospan.llm.common import Scratch, Texts, byte_table, configured, per_slice, saved, slices, table, windows, word_hashes
from chronospan.llm.components import components

SHINGLE, SIMILAR = 3, 90
#: Classes of a token or combination whose pairs are listed; members and queries of a tile.
RARE, TILE = 48, 512
#: Centres with which a member of a frequent combination is compared before the tiles; a shortcut, not a bound on links.
CENTRES = 4
#: Random orders of the keys in which a pair is looked at once.
ORDERS = 4
SKETCH = 2048
#: Ids that are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_IDS = 400_000

WORDS = byte_table(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))


def prefix_length(n: int, similar: int, k: int = 1) -> int:
    """Tokens of n of which two similar sets share k, at least."""
    return min(n, n - -(-similar * n // 100) + k)


def size_step(n: int, similar: int) -> int:
    """Steps of sizes such that similar sets are at most one apart."""
    return int(math.log(max(1, n)) / -math.log(similar / 100) + 1e-9) if similar < 100 else n


def token_classes(step: int, similar: int) -> int:
    """Token classes g of a size step: about half as many as a prefix has tokens."""
    return max(1, int((1 - similar / 100) / 2 * (similar / 100) ** -step)) if similar < 100 else 1


def extended(n: int, similar: int) -> int:
    """Tokens that the extended prefixes of two similar sets share, at least: one more than token classes of either's step or the next."""
    return token_classes(size_step(n, similar) + 1, similar) + 1


def tokens_of(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    hashes, firsts = word_hashes(Texts.of(texts), WORDS)
    each = windows(hashes, shingle)
    for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if hi - lo >= shingle:
            own = np.sort(each[lo : hi - shingle + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            yield own[new]
        else:
            yield windows(hashes[lo:hi], hi - lo) ^ np.uint64(hi - lo) if hi > lo else hashes[:0]


def set_hash(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def sketch_of(tokens: np.ndarray, bits: int = SKETCH) -> bytes:
    """Bit i: whether the number of tokens that fall on i is odd."""
    odd = np.bincount((tokens >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def identified(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row, n and set hash of each document."""

    def make():
        def of_slice(texts: pa.Array) -> list:
            own = list(tokens_of(texts, shingle))
            return [list(map(len, own)), [set_hash(x) if len(x) else None for x in own]]

        return of_slice

    return per_slice(docs, make, "n long, set_hash binary", keys={"doc_id": F.col("doc_id"), "row": F.col("row")})


def described(docs: DataFrame, shingle: int, similar: int) -> DataFrame:
    """doc_id, row, n, set hash, the extended prefix and the sketch of each document that has a shingle."""

    def make():
        def of_slice(texts: pa.Array) -> list:
            own = list(tokens_of(texts, shingle))
            prefixes = [x[: prefix_length(len(x), similar, extended(len(x), similar))] for x in own]
            ends = np.cumsum([0, *map(len, prefixes)])
            each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64)))
            return [list(map(len, own)), [set_hash(x) if len(x) else None for x in own], each, [sketch_of(x) if len(x) else None for x in own]]

        return of_slice

    own = per_slice(docs, make, "n long, set_hash binary, prefix array<long>, sketch binary", keys={"doc_id": F.col("doc_id"), "row": F.col("row")})
    return own.where("n > 0")


def combos_of(tokens: np.ndarray, n: int, similar: int) -> list[int]:
    """Hashes of the pairs of tokens of one token class, for the document's size step and the next.

    ``tokens``: those of its extended prefix, all or the frequent ones, in order.
    """
    out = []
    step = size_step(n, similar)
    for s in (step, step + 1):
        g = token_classes(s, similar)
        own = tokens.view(np.uint64)
        classes: dict[int, list[int]] = {}
        for t, k in zip(own.tolist(), ((own >> np.uint64(7)) % np.uint64(g)).tolist(), strict=True):
            classes.setdefault(k, []).append(t)
        for own_class in classes.values():
            out += [hash((s, a, b)) for a, b in combinations(own_class, 2)]
    return out


def similar_sizes(a: str, b: str, similar: int) -> Column:
    return 100 * F.least(a, b) >= similar * F.greatest(a, b)


def candidates(pairs: DataFrame, reps: DataFrame, similar: int) -> DataFrame:
    """Distinct pairs (a, b) whose sizes and sketches allow similarity, and the bits that differ."""
    side = lambda x: reps.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(similar_sizes("na", "nb", similar))

    @F.pandas_udf("long")
    def differ(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int64")
        u, v = (np.frombuffer(b"".join(s), np.uint64).reshape(len(s), -1) for s in (x, y))
        return pd.Series(np.bitwise_count(u ^ v).sum(axis=1).astype(np.int64))

    # |x - y| + |y - x| <= (100 - similar) / (100 + similar) * (|x| + |y|)
    near = both.withColumn("differ", differ("sa", "sb"))
    return near.where((100 + similar) * F.col("differ") <= (100 - similar) * (F.col("na") + F.col("nb"))).select("a", "b", "differ")


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int, similar: int, scratch: Scratch, name: str) -> DataFrame:
    """The candidates whose whole sets are similar; texts travel, which are shorter than their sets."""
    pairs = scratch.saved(pairs, f"{name}-candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(reps.select("c", "row", "set_hash"), "c")
    ends = scratch.saved(ends, f"{name}-ends")
    near = F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends

    def same():
        return lambda texts, own: [[set_hash(x) == h for x, h in zip(tokens_of(texts, shingle), own.to_pylist(), strict=True)]]

    texts = per_slice(docs.join(near, "row"), same, "same boolean", {"set_hash": F.col("set_hash")}, {"c": F.col("c"), "text": F.col("text").cast("binary")})
    texts = scratch.saved(texts.where("same").select("c", "text").dropDuplicates(["c"]), f"{name}-texts")
    side = lambda x: texts.select(F.col("c").alias(x), F.col("text").alias(f"t{x}"))

    def holds(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in slices(whole, 2):
                keep = []
                for u, v in zip(tokens_of(part.column(2), shingle), tokens_of(part.column(3), shingle), strict=True):
                    common = len(np.intersect1d(u, v, assume_unique=True))
                    keep.append(100 * common >= similar * (len(u) + len(v) - common))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    out = scratch.saved(both.mapInArrow(holds, "a long, b long").distinct(), f"{name}-links")
    scratch.drop(f"{name}-candidates", f"{name}-ends", f"{name}-texts")
    return out


def listed_pairs(rows: DataFrame, similar: int) -> DataFrame:
    """Pairs of classes in different components among rows (key, c, n, component) of keys that are rare."""
    x, y = rows.alias("x"), rows.alias("y")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.c") < F.col("y.c")) & (F.col("x.component") != F.col("y.component"))
    return x.join(y, near & similar_sizes("x.n", "y.n", similar)).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))


def keyed(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, c, n, component) of keys with several components, split into those of rare keys and of frequent ones."""
    groups = rows.groupBy("key").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "df")
    out = scratch.saved(rows.join(groups, "key"), name)
    return out.where(F.col("df") <= RARE), out.where(F.col("df") > RARE)


def nearest(pairs: DataFrame, most: int = CENTRES) -> DataFrame:
    """Of the pairs (a, b, differ) of each b the nearest few."""
    w = W.partitionBy("b").orderBy("differ", "a")
    return pairs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("a", "b")


def centred(rows: DataFrame) -> DataFrame:
    """Pairs of a key's members with its centre, the member of smallest hash; each key has another."""
    order = F.xxhash64("key", "c")
    centre = rows.groupBy("key").agg(F.min(F.struct(order.alias("h"), F.col("c"))).alias("x")).select("key", F.col("x.c").alias("centre"))
    both = rows.join(centre, "key").where("c <> centre")
    return both.select(F.least("c", "centre").alias("a"), F.greatest("c", "centre").alias("b"))


def largest(rows: DataFrame) -> DataFrame:
    """Of each key its largest component, its members, and how many of them are outside that component."""
    each = rows.groupBy("key", "component").agg(F.count("*").alias("k"))
    return each.groupBy("key").agg(F.max_by("component", "k").alias("main"), F.sum("k").alias("members"), (F.sum("k") - F.max("k")).alias("queries"))


def tiled_pairs(rows: DataFrame, reps: DataFrame, similar: int) -> DataFrame:
    """Sketch survivors among rows of frequent keys: queries outside the key's largest component against all its rows, in tiles.

    Copies share most keys, so a pair has one of them where it is looked at: in a
    few random orders each class has its first key, and the first order in which both
    have the same one decides.  A pair without such a key is looked at in each that it shares.
    """
    firsts = [F.min(F.struct(F.xxhash64("key", F.lit(k)).alias("h"), F.col("key")))["key"] for k in range(ORDERS)]
    by_class = rows.groupBy("c").agg(F.array(*firsts).alias("firsts"))
    own = rows.select("key", "c", "component").join(largest(rows), "key").join(by_class, "c").join(reps.select("c", "n", "sketch"), "c")
    blocks = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    pick = lambda seed, n: F.pmod(F.xxhash64("c", F.lit(seed)), blocks(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(blocks(n), F.lit(1)) - 1))
    kept = ["key", "c", "component", "n", "sketch", "firsts"]
    queries = own.where("component <> main").select(*kept, F.lit(True).alias("query"), pick(1, "queries").alias("i"), "members").select(*kept, "query", "i", upto("members").alias("j"))
    members = own.select(*kept, F.lit(False).alias("query"), pick(2, "members").alias("j"), "queries").select(*kept, "query", upto("queries").alias("i"), "j")

    def tile(part: pd.DataFrame) -> pd.DataFrame:
        q, m = part[part["query"]], part[~part["query"]]
        if not len(q) or not len(m):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        key = part["key"].iat[0]
        bits = lambda s: np.frombuffer(b"".join(s), np.uint64).reshape(len(s), -1)
        mb, mn, mc, mk, mf = bits(m["sketch"]), m["n"].to_numpy(), m["c"].to_numpy(), m["component"].to_numpy(), np.stack(m["firsts"])
        out = []
        for sketch, n, c, k, first in zip(bits(q["sketch"]), q["n"], q["c"], q["component"], q["firsts"], strict=True):
            same = mf == first
            here = ~same.any(axis=1) | (first[same.argmax(axis=1)] == key)
            near = np.flatnonzero(here & (mk != k) & (100 * np.minimum(mn, n) >= similar * np.maximum(mn, n)))
            if len(near):
                differ = np.bitwise_count(mb[near] ^ sketch).sum(axis=1)
                near = near[(100 + similar) * differ <= (100 - similar) * (mn[near] + n)]
                out += [(min(c, x), max(c, x)) for x in mc[near].tolist()]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return queries.unionByName(members).groupBy("key", "i", "j").applyInPandas(tile, "a long, b long").distinct()


def join_ngrams(docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs``.

    Two more columns: ``row`` is a hash of doc_id and text, ``component`` a
    number of the component, null without shingles.
    """
    # a row's number must not change between scans, so it comes from its content
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    scratch = Scratch(docs.sparkSession, "ngrams")
    # the texts are read once more for the rows, so that prefixes and sketches are stored for classes alone
    base = scratch.saved(identified(docs, shingle), "identified")
    first = described(docs, shingle, similar).groupBy("set_hash").agg(F.min("doc_id").alias("smallest"), F.first(F.struct("row", "n", "prefix", "sketch")).alias("x"))
    reps = scratch.saved(first.select(F.monotonically_increasing_id().alias("c"), "set_hash", "smallest", "x.*"), "classes")

    singles = reps.select("c", F.explode("prefix").alias("key"))
    shared = singles.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").select("key")
    postings = scratch.saved(singles.join(shared, "key").join(reps.select("c", "n"), "c"), "postings")

    # stars: the smallest class of each token and size step
    step = F.floor(F.log(F.col("n")) / -math.log(similar / 100) + 1e-9) if similar < 100 else F.col("n")
    stepped = postings.withColumn("step", step)
    centre = stepped.groupBy("key", "step").agg(F.min("c").alias("a"))
    stars = stepped.join(centre, ["key", "step"]).where("a < c").select("a", F.col("c").alias("b"))
    links = verified(nearest(candidates(stars, reps, similar)), docs, reps, shingle, similar, scratch, "stars")

    def placed(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
        known = components(links, scratch, name).withColumnRenamed("node", "c")
        return rows.join(known, "c", "left").withColumn("component", F.coalesce("component", "c"))

    rare, frequent = keyed(placed(postings.select("key", "c", "n"), links, "star-edges"), scratch, "tokens")
    scratch.drop("postings")

    # classes with more frequent tokens than token classes: as many tokens as they may have is bounded by their prefixes
    hot = frequent.groupBy("c", "n", "component").agg(F.collect_list("key").alias("hot"))
    least_classes = F.greatest(F.floor((1 - similar / 100) / 2 * F.pow(F.lit(similar / 100), -step)).cast("long"), F.lit(1)) if similar < 100 else F.lit(1)
    dense = hot.where(F.size("hot") > least_classes - 1)  # one less, should a logarithm be rounded

    def combine(parts):
        for part in parts:
            keys = [sorted(set(combos_of(np.sort(np.asarray(x, np.int64).view(np.uint64)).view(np.int64), n, similar))) for x, n in zip(part["hot"], part["n"], strict=True)]
            each = part[["c", "n", "component"]].loc[part.index.repeat([len(k) for k in keys])]
            yield each.assign(key=np.array([h for k in keys for h in k], np.int64))[["key", "c", "n", "component"]]

    combined = scratch.saved(dense.mapInPandas(combine, "key long, c long, n long, component long"), "combined")
    rare2, frequent2 = keyed(combined, scratch, "combinations")
    scratch.drop("combined")
    more = verified(nearest(candidates(centred(frequent2), reps, similar)), docs, reps, shingle, similar, scratch, "centres")
    links = scratch.saved(links.unionByName(more), "links")
    _, frequent2 = keyed(placed(frequent2.select("key", "c", "n"), links, "centre-edges"), scratch, "frequent-combinations")
    pairs = tiled_pairs(frequent2, reps, similar)
    for own in (rare, rare2):
        pairs = pairs.unionByName(listed_pairs(own.drop("df"), similar))
    more = verified(candidates(pairs, reps, similar).drop("differ"), docs, reps, shingle, similar, scratch, "pairs")

    whole = components(links.unionByName(more), scratch).withColumnRenamed("node", "c")
    scratch.drop("tokens", "combinations", "frequent-combinations", "links", "stars-links", "centres-links", "pairs-links")
    classes = reps.select("c", "set_hash", "smallest").join(whole, "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = classes.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = classes.join(least, "component").select("set_hash", "component_id", "component")
    out = base.select("doc_id", "row", F.col("n").alias("n_shingles"), "set_hash").join(named, "set_hash", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "row", "component")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each component.

    The row of the smallest doc_id stays, nulls first, then of the smallest
    hash; of rows equal in doc_id and text, one.  Rows without a shingle stay.
    """
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = saved(join_ngrams(own, shingle, similar).where("component IS NOT NULL").select("doc_id", "row", "component"), "components")
    stays = found.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("x")).select("x.row")
    row = own.select("r", F.xxhash64("doc_id", "text").alias("row"), (F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == "").alias("wordless"))
    first = row.where(~F.col("wordless")).join(stays, "row", "left_semi").dropDuplicates(["row"])
    return first.unionByName(row.where("wordless")).select("r.*")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the components of all documents."""
    return join_ngrams(table(configured(spark), sf_dir, "documents")).drop("row", "component")


#: All pairs of documents that share a shingle, and all that is reached by links: for tables of thousands.
OP7_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least({SHINGLE}, len(w)) - 1], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {SHINGLE} + 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {SIMILAR} * (x.n + y.n - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT doc_id, b FROM reached JOIN sides ON r = a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reached LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
