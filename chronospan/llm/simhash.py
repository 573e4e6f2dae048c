"""Near-duplicate documents by SimHash fingerprints, searched in BK-trees.

A text's fingerprint has a bit set where over half of its shingles' hashes have
it set, repeats included.  Fingerprints link at ``radius`` or fewer differing
bits; texts of one fingerprint are one node, and what is returned are components.

* The 64 bits are cut into blocks.  Fingerprints within the radius agree on all
  but ``radius`` blocks, so each combination of the other blocks is a table, and
  a shard is what agrees on a table's blocks: similar fingerprints share one.
  The number of blocks follows the number of fingerprints, so that a usual shard
  stays small; it changes the work and not the links.
* A shard's fingerprints make a BK-tree: a child hangs on its parent by the
  integer Hamming distance.  A query at distance d of a node goes on along the edges
  d - radius to d + radius alone.  Shards lie in runs of sorted rows; all trees of a run
  are built and searched level by level in arrays.
* A shard of more than TREE fingerprints has several trees: first each part,
  made of fingerprints that agree on one block more where that cuts finely
  enough, is searched by its own members.  Then the fingerprints outside the
  shard's largest component go through the trees of all its parts, in tiles
  of bounded size.
* All trees together grow with the input, so they are not broadcast to all
  executors: a tree meets the queries of its shard in a task, by their key.
* A task returns the components of what it has seen, at most one row a
  fingerprint, so a family in which all are linked with all costs no pairs.

Nothing is capped, and every link between different fingerprints counts.

Defined results: a null or wordless text has fingerprint zero, linked like any
other.  Rows of one doc_id are separate documents; a component is the smallest
doc_id among its rows, null if all are null.  Repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospan.llm.common import Scratch, byte_table, configured, per_slice, table
from chronospan.llm.components import components

SHINGLE, RADIUS, HASH_SEED = 4, 4, 42
#: Fingerprints of a tree, about; fingerprints that a usual shard has, at most, when the blocks are chosen.
TREE, USUAL = 2048, 512
#: Pairs of a query and a node that are looked at together; rows of a run of shards.
FRONT, RUN = 1 << 18, 1 << 15
#: Keys that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 400_000

WORDS = byte_table(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The bits that over half of the hashes of a text's shingles have; zero without a word."""
    words = (text or b"").translate(WORDS).split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate((np.zeros(1, np.int64), ends[: len(words) - width] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    of_byte = hashes.view(np.uint8).reshape(-1, 8)  # little-endian: byte k holds bits 8k and up
    counts = np.concatenate([np.bincount(of_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (a signed long) of each row of ``docs``."""

    def make() -> Callable[..., list]:
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64).view(np.int64)]

    return per_slice(docs, make, "fingerprint long")


class Forest(NamedTuple):
    """BK-trees side by side: node k is fps[k]; ``edges`` are sorted, each 65 * parent + distance, and lead to ``children``."""

    fps: np.ndarray
    edges: np.ndarray
    children: np.ndarray


def grown(fps: np.ndarray, roots: np.ndarray) -> Forest:
    """The trees of runs of distinct fingerprints; ``roots``: for each its run's first."""
    at, items = roots.copy(), np.flatnonzero(roots != np.arange(len(fps)))
    edges, children = [], []
    while len(items):
        edge = at[items] * 65 + np.bitwise_count(fps[items] ^ fps[at[items]])
        order = np.argsort(edge, kind="stable")
        items, edge = items[order], edge[order]
        new = np.ones(len(edge), bool)
        np.not_equal(edge[1:], edge[:-1], out=new[1:])
        edges.append(edge[new])
        children.append(items[new])
        at[items] = items[new][np.cumsum(new) - 1]  # the others hang below the first of their edge
        items = items[~new]
    edges, children = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (edges, children))
    order = np.argsort(edges)
    return Forest(fps, edges[order], children[order])


def searched(forest: Forest, queries: np.ndarray, roots: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query numbers, nodes) within the radius; each query begins at its root, whose tree has so many nodes."""
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(1, int(sizes.sum()) // FRONT + 1) * FRONT) if len(sizes) else []
    for part in np.split(np.arange(len(queries)), np.unique(cuts)):
        q, node = part, roots[part]
        while len(q):
            d = np.bitwise_count(queries[q] ^ forest.fps[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            lo = np.searchsorted(forest.edges, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(forest.edges, node * 65 + np.minimum(d + radius, 64), "right") - lo
            q, first = np.repeat(q, n), np.repeat(lo - np.concatenate((np.zeros(1, np.int64), np.cumsum(n)[:-1])), n)
            node = forest.children[first + np.arange(len(q))]


class Merged:
    """Components of the links seen so far among n nodes."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[u], label[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label[:] = label[label]


def run_starts(keys: np.ndarray) -> np.ndarray:
    """For each of sorted keys the place where its run begins."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return np.repeat(first, np.diff(np.append(first, len(keys))))


def linked_members(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within the runs of sorted keys: a fingerprint of the component, and another."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    roots = run_starts(keys)
    sizes = np.bincount(roots, minlength=len(roots))[roots]
    merged = Merged(len(fps))
    for q, node in searched(grown(fps, roots), fps, roots, sizes, radius):
        merged.link(q[q < node], node[q < node])
    other = np.flatnonzero(merged.label != np.arange(len(fps)))
    return fps[merged.label[other]], fps[other]


def linked_queries(keys: np.ndarray, fps: np.ndarray, query: np.ndarray, component: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``linked_members`` for rows of which some are queries and the others a tree; links inside a known component are left out."""
    order = np.lexsort((fps, query, keys))  # a run's tree lies before its queries
    keys, fps, query, component = keys[order], fps[order], query[order], component[order]
    starts = run_starts(keys)
    members, asking = np.flatnonzero(~query), np.flatnonzero(query & ~query[starts])
    number = np.cumsum(~query) - 1  # of a member among the members
    forest = grown(fps[members], number[starts[members]])
    sizes = np.bincount(starts[members], minlength=len(keys) + 1)[starts[asking]]
    merged = Merged(len(fps))
    for q, node in searched(forest, fps[asking], number[starts[asking]], sizes, radius):
        u, v = asking[q], members[node]
        apart = component[u] != component[v]
        merged.link(u[apart], v[apart])
    other = np.flatnonzero(merged.label != np.arange(len(fps)))
    return fps[merged.label[other]], fps[other]


def by_run(rows: DataFrame, find: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """a and b (long) of ``find`` for the columns of ``rows``, a run of whole groups of the first column at a time."""
    key = rows.columns[0]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            a, b = find(*(np.concatenate(c) for c in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (a, b)], ["a", "b"])

        held: list[list[np.ndarray]] = []
        n = 0
        for part in parts:
            own = [c.to_numpy(zero_copy_only=False) for c in part.columns]
            if not len(own[0]):
                continue
            if n + len(own[0]) > RUN and held:
                # what is held goes with the rest of its last group, if that ends here
                cut = int(np.searchsorted(own[0] != held[-1][0][-1], True)) if (own[0] != held[-1][0][-1]).any() else len(own[0])
                if cut < len(own[0]):
                    held.append([c[:cut] for c in own])
                    yield found(held)
                    held, n, own = [], 0, [c[cut:] for c in own]
            held.append(own)
            n += len(own[0])
        if held:
            yield found(held)

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(batches, "a long, b long")


def masks(n: int, radius: int) -> list[tuple[int, int]]:
    """For each table the mask of the blocks that a shard agrees on, and that of one block more; for about n fingerprints."""
    more = 1
    while more < 8 and n > USUAL << 64 * more // (radius + more):
        more += 1
    blocks = radius + more
    ends = [64 * k // blocks for k in range(blocks + 1)]
    of_block = [(1 << ends[k + 1]) - (1 << ends[k]) for k in range(blocks)]
    out = []
    for own in combinations(range(blocks), more):
        after = next(k % blocks for k in range(own[-1] + 1, own[-1] + blocks + 1) if k % blocks not in own)
        out.append((sum(of_block[k] for k in own), of_block[after]))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sharded(nodes: DataFrame, radius: int, n: int) -> DataFrame:
    """shard, finer (the shard and one block more) and fp: a row for each table."""
    fp = F.col("fp")
    each = [F.struct(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed(own)))).alias("shard"), fp.bitwiseAND(F.lit(signed(after))).alias("after")) for k, (own, after) in enumerate(masks(n, radius))]
    return nodes.select("fp", F.explode(F.array(*each)).alias("x")).select("x.shard", F.xxhash64("x.shard", "x.after").alias("finer"), "fp")


def beside(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def similar_fingerprints(nodes: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """node and component for each of the distinct fingerprints ``nodes`` (fp long) that has a link."""
    n = nodes.count()
    rows = sharded(nodes, radius, n)
    large = scratch.saved(rows.groupBy("shard").agg(F.count("*").alias("members")).where(F.col("members") > TREE), "large")
    if large.isEmpty():
        links = by_run(rows.select("shard", "fp"), lambda keys, fps: linked_members(keys, fps.view(np.uint64), radius))
        return components(links, scratch)
    inside = scratch.saved(rows.join(beside(large), "shard"), "inside")
    finer = inside.groupBy("finer").agg(F.ceil(F.count("*") / TREE).alias("cuts"))
    parts = inside.join(finer, "finer").select(F.xxhash64("finer", F.pmod(F.xxhash64("fp"), F.col("cuts"))).alias("key"), "fp")
    usual = rows.join(beside(large.select("shard")), "shard", "left_anti").select(F.col("shard").alias("key"), "fp")
    links = scratch.saved(by_run(usual.unionByName(parts), lambda keys, fps: linked_members(keys, fps.view(np.uint64), radius)).distinct(), "links")
    first = components(links, scratch, "first").withColumnRenamed("node", "fp")
    known = inside.join(first, "fp", "left").select("shard", "fp", F.coalesce("component", "fp").alias("component"))
    # the parts of a large shard among each other
    each = known.groupBy("shard", "component").agg(F.count("*").alias("k"))
    main = each.groupBy("shard").agg(F.max_by("component", "k").alias("main"), F.sum("k").alias("members"), (F.sum("k") - F.max("k")).alias("queries")).where("queries > 0")
    blocks = lambda c: F.ceil(F.col(c) / TREE).cast("int")
    pick = lambda seed, c: F.pmod(F.xxhash64("fp", F.lit(seed)), blocks(c)).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    own = scratch.saved(known.join(beside(main), "shard"), "open")
    asking = own.where("component <> main").select("shard", "fp", "component", F.lit(True).alias("query"), pick(1, "queries").alias("i"), upto("members").alias("j"))
    asked = own.select("shard", "fp", "component", F.lit(False).alias("query"), pick(2, "members").alias("j"), upto("queries").alias("i"))
    tiles = asking.unionByName(asked).select(F.xxhash64("shard", "i", "j").alias("key"), "fp", "query", "component")
    more = by_run(tiles, lambda keys, fps, query, component: linked_queries(keys, fps.view(np.uint64), query, component, radius))
    out = components(links.unionByName(more), scratch)
    scratch.drop("large", "inside", "links", "open")
    return out


def join_fingerprints(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    base = scratch.saved(fingerprints(docs, shingle), "fingerprints").withColumnRenamed("fingerprint", "fp")
    nodes = scratch.saved(base.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "nodes")
    found = similar_fingerprints(nodes.select("fp"), scratch, radius).withColumnRenamed("node", "fp")
    placed = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = placed.join(least, "component").select("fp", "component_id")
    hex16: Column = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return base.join(named, "fp").select("doc_id", hex16.alias("fingerprint"), "component_id")


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the fingerprint and the component of every document."""
    return join_fingerprints(table(configured(spark), sf_dir, "documents"))
