"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is the set of its windows of five words (an item with fewer words:
the one window of all its words).  A document contains an item if it holds at
least CONTAINED per cent of the item's windows.  Items are partitioned by size;
each is indexed by its MinHash sketch, the k smallest hashes of its windows.
k is one more than the most windows that an item of the partition may lack, so
every containing document, however long, holds a hash of the sketch: nothing is
missed.  A document's windows above the partition's largest sketch hash are
skipped, the others are looked up, and each candidate is verified by exact
containment, first of hashes, then of the words themselves.

The index goes to the tasks in blocks of items, each of about BLOCK_WINDOWS
windows: 16 bytes a window and the items' words, so 60 MB a block.  A benchmark of
several blocks costs as many passes.

Words are runs of letters and digits, A-Z in lower case, non-ASCII characters
counted as letters.  Defined results: a null or empty text or item has no
windows and is never matched; repeated rows of either side give repeated
results; null ids are carried; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospan.llm.common import Texts, byte_table, configured, per_slice, table, windows, with_columns, word_hashes

SHINGLE, CONTAINED = 5, 80
BLOCK_WINDOWS = 2_000_000
WORDS = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


class Item(NamedTuple):
    item_id: int | None
    width: int
    words: bytes  # lower-cased, joined by spaces
    hashes: np.ndarray  # sorted, distinct


class Partition(NamedTuple):
    """Items of one window width and size class, by the hashes of their sketches: those of sketch[k] are items[firsts[k]:firsts[k + 1]]."""

    width: int
    sketch: np.ndarray
    firsts: np.ndarray
    items: np.ndarray


def needed(n: int) -> int:
    """Windows of an item of n that a containing document holds, at least."""
    return -(-n * CONTAINED // 100)


def grams_of(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def indexed(rows: list[tuple[int | None, bytes]]) -> tuple[list[Item], list[Partition]]:
    """Items of a block, and their partitions."""
    items, groups = [], {}
    hashes, firsts = word_hashes(Texts.of(pa.array([text for _, text in rows], pa.binary())), WORDS)
    for (item_id, text), lo, hi in zip(rows, firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if hi > lo:
            width = min(SHINGLE, hi - lo)
            own = np.unique(windows(hashes[lo:hi], width))
            groups.setdefault((width, len(own).bit_length()), []).append(len(items))
            items.append(Item(item_id, width, b" ".join(text.translate(WORDS).split()), own))
    parts = []
    for (width, _), own in sorted(groups.items()):
        k = max(len(items[i].hashes) - needed(len(items[i].hashes)) + 1 for i in own)
        keys = np.concatenate([items[i].hashes[:k] for i in own])
        of = np.repeat(np.array(own, np.int32), [min(k, len(items[i].hashes)) for i in own])
        order = np.argsort(keys, kind="stable")
        sketch, first = np.unique(keys[order], return_index=True)
        parts.append(Partition(width, sketch, np.append(first, len(keys)), of[order]))
    return items, parts


def candidates(hashes: np.ndarray, firsts: np.ndarray, part: Partition) -> set[tuple[int, int]]:
    """(number of a text, number of an item) for each sketch hash that a text holds."""
    every = windows(hashes, part.width)
    low = np.flatnonzero(every <= part.sketch[-1])
    at = np.searchsorted(part.sketch, every[low])
    hit = part.sketch[at] == every[low]
    low, at = low[hit], at[hit]
    text = np.searchsorted(firsts, low, "right") - 1
    inside = low + part.width <= firsts[text + 1]
    return {(t, i) for t, k in set(zip(text[inside].tolist(), at[inside].tolist(), strict=True)) for i in part.items[part.firsts[k] : part.firsts[k + 1]].tolist()}


def contained(texts: pa.Array, items: list[Item], parts: list[Partition]) -> list[list[tuple[int, int, int]]]:
    """For each text (number of an item, its distinct windows in the text, its distinct windows) of each contained item."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    hashes, firsts = word_hashes(Texts.of(texts), WORDS)
    found = sorted(set().union(*(candidates(hashes, firsts, p) for p in parts)))
    for t, own in groupby(found, key=lambda x: x[0]):
        ordered: dict[int, np.ndarray] = {}
        exact: dict[int, set[bytes]] = {}
        words: list[bytes] = []
        for _, i in own:
            item, w = items[i], items[i].width
            if w not in ordered:
                ordered[w] = np.unique(windows(hashes[firsts[t] : firsts[t + 1]], w))
            if len(np.intersect1d(item.hashes, ordered[w], assume_unique=True)) < needed(len(item.hashes)):
                continue
            words = words or texts[t].as_py().translate(WORDS).split()
            if w not in exact:
                exact[w] = grams_of(words, w)
            grams = grams_of(item.words.split(), w)
            n = len(grams & exact[w])
            if n >= needed(len(grams)):
                out[t].append((i, n, len(grams)))
    return out


def _blocks(benchmark: DataFrame, block_windows: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items, a stated query set, in blocks of about so many words: a word begins at most one window."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    words = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    blocks = max(1, math.ceil((own.agg(F.sum(words)).first()[0] or 0) / block_windows))
    for b in range(blocks):
        yield [(r[0], r[1].encode()) for r in own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]


FOUND = "found array<struct<item_id: long, n_shared: long, n_item: long>>"


def _finder(docs: DataFrame, items: list[tuple[int | None, bytes]]) -> Callable[[], Callable[..., list]]:
    """Makes the function from texts to the items of one block that each contains."""
    shared = docs.sparkSession.sparkContext.broadcast(indexed(items))

    def make() -> Callable[..., list]:
        items, parts = shared.value
        return lambda texts: [[[(items[i].item_id, n, size) for i, n, size in own] for own in contained(texts, items, parts)]]

    return make


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment for each item in each document that contains it."""
    out = None
    for items in _blocks(benchmark, block_windows):
        hits = per_slice(docs, _finder(docs, items), FOUND)
        part = hits.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item."""
    for items in _blocks(benchmark, block_windows):
        rows, named = with_columns(docs, _finder(docs, items), FOUND)
        docs = named(rows.where(F.size("found") == 0))
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the benchmark items that each document contains; a document without any has no row."""
    return find_leaks(table(configured(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = rf"""
WITH words AS (
  SELECT doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark),
w AS (
  SELECT doc_id, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM words),
sized AS (SELECT *, least({SHINGLE}, len(w)) AS width FROM w WHERE item_id IS NOT NULL AND len(w) > 0),
items AS (SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM sized)),
docs AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS gram
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM w, (SELECT DISTINCT width FROM sized) WHERE doc_id IS NOT NULL AND len(w) >= width)),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (width, gram) GROUP BY ALL),
n AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM shared JOIN n USING (item_id) WHERE 100 * n_shared >= {CONTAINED} * n_item
"""
