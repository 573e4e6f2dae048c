"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Documents are tokenised once, ended by id 0, and cut into pieces only where they
are longer than a sequence: all pieces but the first are then full.  Full pieces
are sequences of their own.  The others are dealt by hash into blocks of about
BLOCK pieces; in each block, pieces go in decreasing length to the open bin that
they fit best.  Local search then goes from the fullest underfull bin to the
least: each takes documents from less filled ones, by moves or by exchanges of one or two
for one or two, whichever fills it most.  The sum of squared fills
grows with each change, and the room gathers in the last bins until they are
empty.  Half of each block's pieces, those of the least filled bins first, are
gathered from all blocks and packed again, in half as many blocks, until one
block holds them all, whatever the lengths are.

Tokens: ids are those of the ``tokenizers`` file.  A text is cut before each
space that a character other than white space follows, where the tokenizer cuts
too, so that a task encodes each stretch that it meets often only once.
Stretches of Latin letters go through the same vocabulary in ``tiktoken``, all
others, and texts with other white space after a space, through ``tokenizers``.

Defined results: a null or empty text is the piece of id 0 alone.  Repeated
rows are packed each on their own, a null doc_id is carried, an empty table
gives an empty result, other columns are ignored.  A task holds one block or a
few texts; block sizes don't depend on the data.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections import Counter
from zlib import crc32

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospan.llm.common import Scratch, configured, per_text, table

CAPACITY, BLOCK = 2048, 8192
#: Stretches whose ids a task keeps, and characters of the longest of them.
KEPT, KEPT_CHARS = 120_000, 64
TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
_LATIN_END = "ɐ"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer: str = TOKENIZER, ranks: str = RANKS, kept: int = KEPT):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(ranks, "rb") as lines:
            self.latin = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
        self.kept, self.at = kept, {}

    def plain(self, text: str) -> bytes:
        ids = self.latin.encode_ordinary(text) if text.isascii() or max(text) < _LATIN_END else self.whole.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        found = list(map(self.at.get, rest))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    s = rest[i]
                    if not s or s[0].isspace():
                        return self.plain(text)
                    x = self.at.get(s)
                    if x is None:
                        x = self.plain(" " + s)
                        if len(self.at) < self.kept and len(s) <= KEPT_CHARS:
                            self.at[s] = x
                    found[i] = x
        return (self.plain(first) if first else b"") + b"".join(found)


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n ids: only the first may be shorter than a sequence."""
    return [n] if n <= capacity else [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def make():
        encode = Encoder()

        def one(text: bytes | None) -> tuple:
            data = (encode(text.decode("utf-8", "replace")) if text else b"") + b"\0\0\0\0"
            lengths, at, out = cut(len(data) // 4, capacity), 0, []
            for n in lengths:
                part = data[at : at + 4 * n]
                out.append((crc32(part), list(array("I", part)) if with_ids else None))
                at += 4 * n
            return lengths, [c for c, _ in out], [i for _, i in out] if with_ids else None

        return one

    rows = per_text(docs, make, "lengths array<int>, crcs array<long>, ids array<array<int>>")
    each = rows.select("doc_id", F.posexplode("lengths").alias("piece", "length"), "lengths", "crcs", "ids")
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("lengths")[0] + (F.col("piece") - 1) * capacity)
    own = [F.col("ids")[F.col("piece")].alias("ids")] if with_ids else []
    return each.select("doc_id", "piece", start.cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.col("crcs")[F.col("piece")].alias("ids_crc32"), *own)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in ``lengths``: longest first, each to the bin with the least room that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


class Pool:
    """Underfull bins by the lengths that they hold, alone or as sums of two, each with a bit mask of what there is.

    A bin of ``capacity`` has at most the square root of twice that many
    different lengths, so its pairs are as many as it has ids, at most.
    """

    def __init__(self, bins: list[list[int]], capacity: int):
        self.bins, self.fill = bins, [sum(b) for b in bins]
        self.ones: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.twos: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.ones_mask = self.twos_mask = 0
        for b in range(len(bins)):
            self.add(b)

    @staticmethod
    def pairs(lengths: list[int]) -> dict[int, tuple[int, int]]:
        """Each sum of two of the lengths, and a pair that has it."""
        n = Counter(lengths)
        own = sorted(n)
        return {x + y: (x, y) for k, x in enumerate(own) for y in own[k + (n[x] < 2) :]}

    def add(self, b: int) -> None:
        for n in set(self.bins[b]):
            self.ones[n].add(b)
            self.ones_mask |= 1 << n
        for n in self.pairs(self.bins[b]):
            self.twos[n].add(b)
            self.twos_mask |= 1 << n

    def take(self, b: int) -> None:
        for n in set(self.bins[b]):
            self.ones[n].discard(b)
            if not self.ones[n]:
                self.ones_mask &= ~(1 << n)
        for n in self.pairs(self.bins[b]):
            self.twos[n].discard(b)
            if not self.twos[n]:
                self.twos_mask &= ~(1 << n)


def _gain(pool: Pool, own: list[int], room: int) -> tuple[int, tuple[int, ...], int, bool]:
    """The change that fills the room of a bin most: gain, lengths that leave it, what comes in, and whether that is two lengths.

    Tried: one or two come in; one or two for one, one or two for two.
    """
    best = (0, (), 0, False)
    out = [((), 0), *(((x,), x) for x in set(own)), *((p, x) for x, p in Pool.pairs(own).items())]
    for gone, x in out:
        upto = (1 << (x + room + 1)) - 1
        for two in (False, True):
            y = ((pool.twos_mask if two else pool.ones_mask) & upto).bit_length() - 1
            if y - x > best[0]:
                best = (y - x, gone, y, two)
                if best[0] == room:
                    return best
    return best


def improved(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over all underfull bins until no change is left: places of ``lengths`` in bins, as in ``bins``.

    From the fullest bin to the least, each takes from those after it, which are no
    fuller, by the change that fills it most, until none does: a change
    makes the sum of squared fills grow.  The room gathers in the last bins,
    which empty.  A pass without a change ends the search.
    """
    where: dict[int, list[int]] = {}
    for b in bins:
        for i in b:
            where.setdefault(lengths[i], []).append(i)
    state = [[lengths[i] for i in b] for b in bins]
    full = [b for b in state if sum(b) == capacity]
    state = [b for b in state if sum(b) < capacity]
    changed = True
    while changed:
        changed = False
        state.sort(key=sum, reverse=True)
        pool = Pool(state, capacity)
        for p in range(len(state)):
            pool.take(p)
            while pool.fill[p] < capacity and pool.bins[p]:
                gain, gone, y, two = _gain(pool, pool.bins[p], capacity - pool.fill[p])
                if not gain:
                    break
                q = min((pool.twos if two else pool.ones)[y], key=lambda b: (pool.fill[b], b))
                pool.take(q)
                for n in pool.pairs(pool.bins[q])[y] if two else (y,):
                    pool.bins[q].remove(n)
                    pool.bins[p].append(n)
                for n in gone:
                    pool.bins[p].remove(n)
                    pool.bins[q].append(n)
                pool.fill[p], pool.fill[q] = pool.fill[p] + gain, pool.fill[q] - gain
                pool.add(q)
                changed = True
        full += [b for b in state if sum(b) == capacity]
        state = [b for b in state if 0 < sum(b) < capacity]
    return [[where[n].pop() for n in b] for b in full + state]


def pack_block(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return improved(best_fit(lengths, capacity), lengths, capacity)


def reopened(bins: list[list[int]], lengths: list[int], capacity: int) -> set[int]:
    """The bins of a block that are packed again with those of other blocks, up to half of the pieces, one in any case.

    First those that are not full, the least filled first; then full ones here and there, whose
    short documents let the search fill up what long ones leave.
    """
    fill = [sum(lengths[i] for i in own) for own in bins]
    order = sorted(range(len(bins)), key=lambda b: (fill[b] == capacity, (b * 0x9E3779B1) % (1 << 32) if fill[b] == capacity else fill[b]))
    out: set[int] = set()
    pieces = 0
    for b in order:
        pieces += len(bins[b])
        if out and 2 * pieces > len(lengths):
            break
        out.add(b)
    return out


def pack(rows: DataFrame, scratch: Scratch, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """sequence_id and offset for each row of ``rows`` (row: unique long, length: 1 to capacity)."""
    done = rows.where(F.col("length") >= capacity).select("row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level = rows.where(F.col("length") < capacity).select("row", "length"), 1

    def packer(level: int, last: bool):
        def pack_one(part: pd.DataFrame) -> pd.DataFrame:
            rows, lengths, number, out = part["row"].tolist(), part["length"].tolist(), int(part["block"].iat[0]), []
            bins = pack_block(lengths, capacity)
            again = set() if last else reopened(bins, lengths, capacity)
            for b, own in enumerate(bins):
                at = 0
                for i in own:
                    out.append((rows[i], lengths[i], (level << 56) | (number << 20) | b, at, b in again))
                    at += lengths[i]
            return pd.DataFrame(out, columns=["row", "length", "sequence_id", "offset", "again"])

        return pack_one

    n = rest.count()
    while n:
        blocks = max(1, math.ceil(n / max(block, 64)))
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)))
        packed = scratch.saved(dealt.groupBy("block").applyInPandas(packer(level, blocks == 1), "row long, length long, sequence_id long, offset long, again boolean"), f"packed{level}")
        done = done.unionByName(packed.where("NOT again").select("row", "sequence_id", "offset"))
        rest, level = packed.where("again").select("row", "length"), level + 1
        n = 0 if blocks == 1 else rest.count()
    return done


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """Each piece of each document with its place: sequence_id and offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    own = scratch.saved(pieces(docs, capacity, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return own.join(pack(own.select("row", "length"), scratch, capacity, block), "row").drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pieces packed with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents in sequences of 2048 ids."""
    return pack_documents(table(configured(spark), sf_dir, "documents"))
