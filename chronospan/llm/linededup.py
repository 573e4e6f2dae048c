"""Line dedup by pairwise alignment of overlapping documents.

Texts are wrapped anew into lines whose starts their words set, so that a passage
has the same lines wherever it is set in: of the windows of half a block that
begin at so many neighbouring words, the one with the least hash begins a line.
The hash of a line is that of the window's words; it may reach over the starts that
follow.  A stretch of BLOCK_WORDS words, 30, that two documents share holds a line
of both, whatever stands around it.  A text of fewer words is one line of all its words.

Documents overlap if they share a line.  A line of at most RARE places links each
of its documents to all earlier ones; a more frequent one links each to the first
holder, to the first that has the same line after it, and to the first that has
the same line before it.  No two documents are ever listed for a line that many hold.
Rows meet by line in one exchange; lines that a sample of documents tells to be very
frequent are dealt out by salt too, and the first places of all salts meet after that.

Each pair of linked documents is aligned by patience diff over the lines that it
shares: lines that occur once in either are matched along a longest increasing
sequence, and between them again.  Shared lines off that path, of moved and repeated
passages, are matched where they stand.  Matched lines that continue each other are
one block.  It is checked on its words, grows word by word at both ends, and goes
from the later document if it has BLOCK_WORDS words then, or is a whole text.

So of every stretch of 30 words that an earlier document holds, a line's holder is
compared; with at most RARE places of the line, all holders are, and all its words go.
Words are what stands between ASCII white space.  Only lines that two documents
share are brought together, never whole documents, so a long document, or one that
thousands repeat, costs what it shares.

Defined results: a null text stays null, an empty one empty; a text of fewer than
BLOCK_WORDS words changes only if an earlier one has the same words and no others, and is empty
then.  Rows with a null doc_id are carried unchanged.  Rows of one doc_id are not
compared with each other, only with documents of smaller ids, and repeated rows
give repeated results.  An empty table gives an empty result; other columns are
ignored, or kept by ``with_own_lines``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chronospan.llm.common import Scratch, Texts, byte_table, configured, per_slice, places_of, table, windows, with_columns, word_hashes

BLOCK_WORDS = 30
#: Places of a line up to which each of its documents is linked to every earlier one.
RARE = 4
#: One document of so many is asked for frequent lines; places of a line there from which it is salted; places of a salt, about; salted lines, at most.
SAMPLE, FREQUENT, SALTED, MOST_SALTED = 64, 16, 2000, 100_000
#: Rows of whole lines that a task works on at once.
RUN = 1 << 15
#: Blocks whose places, 50 bytes each, are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_BLOCKS = 400_000
WORDS = byte_table(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D), lower=False)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(x: np.ndarray, width: int, op: np.ufunc, rest: np.uint64) -> np.ndarray:
    """op over x[i:i + width] for each i, with ``rest`` after the end: from running values of blocks of that width, forwards and backwards."""
    whole = np.concatenate((x, np.full(-len(x) % width + width, rest, x.dtype))).reshape(-1, width)
    ahead = op.accumulate(whole, axis=1).ravel()
    back = op.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: len(x)], ahead[width - 1 : width - 1 + len(x)])


def widths(block_words: int) -> tuple[int, int]:
    """Words of a line, and neighbouring windows of which the least begins one: a stretch of so many words holds a line."""
    line = max(1, (block_words + 1) // 2)
    return line, block_words - line + 1


def line_starts(hashes: np.ndarray, firsts: np.ndarray, words: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that begin a line, and the hashes of the lines; text k has the words firsts[k] to firsts[k + 1].

    A text with fewer windows than ``window`` has the least of them.
    """
    n = len(hashes)
    if n < words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = np.diff(firsts)
    room = np.repeat(firsts[1:], size) - np.arange(n)
    own = np.full(n, _MOST)
    own[: n - words + 1] = windows(hashes, words)
    own[room < words] = _MOST
    whole = room >= words + window - 1
    begins = firsts[:-1][size >= words]
    whole[begins] = True
    least = sliding(own, window, np.minimum, _MOST)
    least[~whole] = 0
    # a start is the least of some window: the largest of the least values of all windows over it is its own
    over = sliding(least[::-1], window, np.maximum, np.uint64(0))[::-1]
    at = np.flatnonzero((over == own) & (room >= words))
    return at, own[at]


def wrapped(docs: DataFrame, block_words: int) -> DataFrame:
    """row, doc_id, starts and hashes of the lines of each document (row, doc_id, text), and the halves of the hashes of the lines before and after each."""
    words, window = widths(block_words)

    def make() -> Callable[..., list]:
        def of_slice(texts: pa.Array) -> list:
            hashes, firsts = word_hashes(Texts.of(texts), WORDS)
            at, lines = line_starts(hashes, firsts, words, window)
            size = np.diff(firsts)
            long = np.repeat(size, size)[at] >= block_words
            at, lines = at[long], lines[long]
            short = np.flatnonzero((size > 0) & (size < block_words))
            whole = np.array([windows(hashes[firsts[k] : firsts[k + 1]], size[k])[0] ^ np.uint64(size[k]) for k in short], np.uint64)
            lines = np.concatenate((lines, whole))
            at = np.concatenate((at, firsts[short]))
            order = np.argsort(at, kind="stable")
            at, lines = at[order], lines[order]
            cut = np.searchsorted(at, firsts)
            begin = np.repeat(firsts[:-1], np.diff(cut))
            half = (lines >> np.uint64(32)).astype(np.uint32).view(np.int32)
            before, after = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
            same = np.flatnonzero(begin[1:] == begin[:-1])
            before[same + 1], after[same] = half[same], half[same + 1]
            offsets = pa.array(cut, pa.int32())
            return [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((at - begin).astype(np.int32), lines.view(np.int64), before, after)]

        return of_slice

    return per_slice(docs, make, "starts array<int>, lines array<long>, before array<int>, after array<int>", keys={"row": F.col("row"), "doc_id": F.col("doc_id")})


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, sorted by their first, in which the second rises too."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back[k] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (i, j) of a patience diff, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i >= i2 or j >= j2:
            continue
        n_a, n_b = Counter(a[i:i2]), Counter(b[j:j2])
        once = {x for x in n_a if x in n_b and n_a[x] == n_b[x] == 1}
        if not once:  # no line occurs once in both: first places of the lines that occur in both
            once = n_a.keys() & n_b.keys()
            if not once:
                continue
        first_b: dict[int, int] = {}
        for k in range(j, j2):
            if b[k] in once:
                first_b.setdefault(b[k], k)
        pairs, seen = [], set()
        for k in range(i, i2):
            if a[k] in once and a[k] not in seen:
                seen.add(a[k])
                pairs.append((k, first_b[a[k]]))
        anchors = _increasing(pairs)
        out += anchors
        for (p, q), (p2, q2) in zip([(i - 1, j - 1), *anchors], [*anchors, (i2, j2)], strict=True):
            if p2 - p > 1 and q2 - q > 1:
                todo.append((p + 1, p2, q + 1, q2))
    return sorted(out)


def blocks(matches: list[tuple[int, int, int]], words: int) -> list[tuple[int, int, int, int]]:
    """Common blocks (start and end in the later document, in the earlier one) from its shared lines (start, start in the earlier one, line).

    First those of a patience diff over both documents' shared lines, then those
    of the lines that it leaves over, joined where they keep their distance.
    """
    own, earlier = {(i, x) for i, _, x in matches}, {(j, x) for _, j, x in matches}
    a, b = sorted(own), sorted(earlier)
    on_path = [(a[i][0], b[j][0]) for i, j in patience([x for _, x in a], [x for _, x in b])]
    held = {i for i, _ in on_path}
    left = sorted({(i, j) for i, j, _ in matches if i not in held}, key=lambda m: (m[0] - m[1], m[0]))
    runs: list[list[int]] = []
    for i, j in on_path + left:
        if runs and i - runs[-1][1] == j - runs[-1][3] and 0 <= i - runs[-1][1] <= words:
            runs[-1][1], runs[-1][3] = i, j
        else:
            runs.append([i, i, j, j])
    return [(i, i2 + words, j, j2 + words) for i, i2, j, j2 in outermost(runs, words)]


def outermost(runs: list[list[int]], margin: int) -> list[list[int]]:
    """The runs that no other one holds with ``margin`` words to spare at either end: another goes whole with the one that holds it, however it grows."""
    order = sorted(runs)
    out, k, reach = [], 0, -1
    for run in order:
        while order[k][0] <= run[0] - margin:
            reach, k = max(reach, order[k][1]), k + 1
        if reach < run[1] + margin:
            out.append(run)
    return out


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def linked(line: np.ndarray, salt: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, before: np.ndarray, after: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Later places, the earlier ones that they are linked to, and the first place of each group; rows are sorted by (line, salt, doc_id, row, start)."""

    def firsts(*keys: np.ndarray) -> np.ndarray:
        """For each row the first one of the same keys."""
        order = np.lexsort(keys[::-1])  # stable: rows of equal keys stay in order
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        out = np.empty(len(order), np.int64)
        out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        return out

    group = firsts(line, salt)
    every = np.arange(len(line))
    later, earlier = [every, every, every], [group, firsts(group, after), firsts(group, before)]
    few = np.bincount(group, minlength=len(line))[group] <= rare
    for d in range(1, rare):
        i = np.flatnonzero(few[d:] & (group[d:] == group[:-d])) + d
        if not len(i):
            break
        later.append(i)
        earlier.append(i - d)
    i, j = np.concatenate(later), np.concatenate(earlier)
    ahead = doc[j] < doc[i]
    return *np.unique(np.stack((i[ahead], j[ahead])), axis=1), np.unique(group)


def meeting(places: DataFrame, rare: int) -> DataFrame:
    """row, start, earlier_row, earlier_start, line, doc_id of the links among ``places`` of one line and salt; the first place of each salted group comes too, without an earlier one."""
    schema = T.StructType.fromDDL("row long, start int, earlier_row long, earlier_start int, line long, doc_id long")
    arrow = to_arrow_schema(schema)
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            own = [np.concatenate(c) for c in zip(*held, strict=True)]
            order = np.lexsort(own[4::-1])
            own = [c[order] for c in own]
            line, salt, doc, row, start = own[:5]
            i, j, first = linked(*own, rare)
            first = first[salt[first] > 0]
            none = pa.nulls
            columns = [np.concatenate((c[i], c[first])) for c in (row, start, line, doc)]
            back = [pa.concat_arrays([pa.array(c[j]), none(len(first), t)]) for c, t in ((row, pa.int64()), (start, pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), *back, pa.array(columns[2]), pa.array(columns[3])], schema=arrow)

        held: list[list[np.ndarray]] = []
        n = 0
        for part in parts:
            own = [c.to_numpy(zero_copy_only=False) for c in part.columns]
            if not len(own[0]):
                continue
            if held and n + len(own[0]) > RUN:
                # what is held goes with the rest of its last line, if that ends here
                other = own[0] != held[-1][0][-1]
                if other.any():
                    cut = int(np.argmax(other))
                    held.append([c[:cut] for c in own])
                    yield made(held)
                    held, n, own = [], 0, [c[cut:] for c in own]
            held.append(own)
            n += len(own[0])
        if held:
            yield made(held)

    rows = places.select("line", "salt", "doc_id", "row", "start", "before", "after")
    # one long key is sorted by radix
    return rows.repartition("line", "salt").sortWithinPartitions("line").mapInArrow(batches, schema)


def links(lines: DataFrame, scratch: Scratch, rare: int) -> DataFrame:
    """row, start, earlier_row, earlier_start, line: each shared line of a document and its place in an earlier one."""
    kept = ["starts", "lines", "before", "after"]
    each = lines.where("doc_id IS NOT NULL").select("row", "doc_id", F.explode(F.arrays_zip(*kept)).alias("x")).select("row", "doc_id", F.col("x.starts").alias("start"), F.col("x.lines").alias("line"), "x.before", "x.after")
    # a line that one document in so many tells to be frequent is dealt out; which ones are decides on balance alone
    sampled = each.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    hot = scratch.saved(sampled.orderBy(F.desc("n"), "line").limit(MOST_SALTED).select("line", F.ceil(F.col("n") * SAMPLE / SALTED).alias("salts")), "hot")
    salt = F.coalesce(1 + F.pmod(F.xxhash64("row", "start"), F.col("salts")), F.lit(0)).cast("int")
    met = scratch.saved(meeting(each.join(F.broadcast(hot), "line", "left").withColumn("salt", salt), rare), "met")
    heads = met.where("earlier_row IS NULL").select("line", F.lit(0).alias("salt"), "doc_id", "row", "start", F.lit(0).alias("before"), F.lit(0).alias("after"))
    return met.where("earlier_row IS NOT NULL").unionByName(meeting(heads, rare)).drop("doc_id")


def aligned(found: DataFrame, words: int) -> DataFrame:
    """row, start, stop, earlier_row, earlier_start and earlier_stop of each common block."""
    pairs = found.groupBy("row", "earlier_row").agg(F.collect_set(F.struct("start", "earlier_start", "line")).alias("m"))
    schema = T.StructType.fromDDL("row long, start int, stop int, earlier_row long, earlier_start int, earlier_stop int")
    arrow = to_arrow_schema(schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = part.column(2)
            values = [own.flatten().field(k).to_pylist() for k in range(3)]
            ends = (own.offsets.to_numpy() - own.offsets[0].as_py()).tolist()
            rows = []
            for row, earlier, lo, hi in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), ends[:-1], ends[1:], strict=True):
                rows += [(row, i, i2, earlier, j, j2) for i, i2, j, j2 in blocks(list(zip(*(v[lo:hi] for v in values), strict=True)), words)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 6, arrow, strict=True)], schema=arrow)

    return pairs.mapInArrow(batches, schema)


def contexts(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """For each block of an earlier document the digest of its words, and up to window - 1 words before and after it."""
    each = found.select("earlier_row", "earlier_start", "earlier_stop").distinct()
    wanted = each.groupBy("earlier_row").agg(F.collect_list(F.struct("earlier_start", "earlier_stop")).alias("at"))
    near = F.broadcast(wanted) if each.count() <= BROADCAST_BLOCKS else wanted
    holders = docs.join(near, docs["row"] == near["earlier_row"])

    def make() -> Callable[..., list]:
        def one(text: bytes, at: list[dict]) -> list[tuple]:
            words, w = words_of(text), window - 1
            out = []
            for x in at:
                i, j = x["earlier_start"], x["earlier_stop"]
                out.append((i, j, digest(words[i:j]), b" ".join(words[max(0, i - w) : i]), b" ".join(words[j : j + w])))
            return out

        return lambda texts, at: [[one(*x) for x in zip(texts.to_pylist(), at.to_pylist(), strict=True)]]

    kind = "own array<struct<earlier_start: int, earlier_stop: int, digest: binary, before: binary, after: binary>>"
    return per_slice(holders, make, kind, {"at": F.col("at")}, {"earlier_row": F.col("earlier_row")}).select("earlier_row", F.explode("own").alias("x")).select("earlier_row", "x.*")


#: A block (start, stop), the digest of its words, and the earlier document's words before and after it.
Cut = tuple[int, int, bytes, bytes, bytes]


def reach(low: bytes, starts: list[int], ends: list[int], cuts: list[Cut], least: int) -> list[tuple[int, int]]:
    """Ranges of words to delete: blocks whose words are the earlier document's, with as many words around as both have; of ``least`` words, or of all.

    ``low`` is a text with spaces for white space, whose words lie from ``starts`` to ``ends``.
    """
    out, n = set(), len(starts)
    digests: dict[tuple[int, int], bytes] = {}
    for i, stop, same, before, after in cuts:
        j = min(stop, n)
        if (i, j) not in digests:
            digests[i, j] = digest(low[starts[i] : ends[j - 1]].split())
        if digests[i, j] != same:
            continue
        for w in reversed(before.split()):
            if not i or low[starts[i - 1] : ends[i - 1]] != w:
                break
            i -= 1
        for w in after.split():
            if j >= n or low[starts[j] : ends[j]] != w:
                break
            j += 1
        if j - i >= min(least, n):
            out.add((i, j))
    return sorted(out)


def without(text: bytes, low: bytes, starts: list[int], ends: list[int], cuts: list[Cut], least: int) -> tuple[bytes, int]:
    """The text without the blocks, each with the white space after it, and the number of words deleted; the others as in ``reach``."""
    out, at, last, gone = [], 0, 0, 0
    for i, j in reach(low, starts, ends, cuts, least):
        if j <= last:
            continue
        i = max(i, last)
        out.append(text[at : starts[i]] if at < starts[i] else b"")
        at = starts[j] if j < len(starts) else len(text)
        gone, last = gone + j - i, j
    return b"".join([*out, text[at:]]), gone


def cuts_of(docs: DataFrame, block_words: int = BLOCK_WORDS, rare: int = RARE) -> DataFrame:
    """row and cuts: for each document that an earlier one overlaps, the blocks and what the earlier document has around them.

    ``docs`` has doc_id and text; a row is their hash.
    """
    line, window = widths(block_words)
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    lines = scratch.saved(wrapped(rows, block_words).where(F.size("starts") > 0), "lines")
    found = scratch.saved(aligned(links(lines, scratch, rare), line), "blocks")
    scratch.drop("lines", "hot", "met")
    own = found.join(contexts(rows, found, window), ["earlier_row", "earlier_start", "earlier_stop"])
    cuts = scratch.saved(own.groupBy("row").agg(F.collect_set(F.struct("start", "stop", "digest", "before", "after")).alias("cuts")), "cuts")
    scratch.drop("blocks")
    return cuts


def shortened(docs: DataFrame, block_words: int = BLOCK_WORDS, rare: int = RARE) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with rest (the text without the common blocks), n_words before and n_removed, as ``with_columns`` gives them."""

    def make() -> Callable[..., list]:
        def of_slice(texts: pa.Array, cuts: pa.Array) -> list:
            own = Texts.of(texts)
            low, starts, ends, firsts = places_of(own, WORDS)
            rest, gone = texts.to_pylist(), [0] * len(texts)
            # the blocks' fields side by side: a row's are those from one offset to the next
            flat = cuts.flatten()
            fields = [flat.field(c).to_pylist() for c in ("start", "stop", "digest", "before", "after")]
            places = np.concatenate((np.zeros(1, np.int64), np.cumsum(pc.fill_null(pc.list_value_length(cuts), 0).to_numpy(zero_copy_only=False))))
            for k in np.flatnonzero(np.diff(places)).tolist():
                if rest[k]:
                    at, words, part = own.offsets[k], slice(firsts[k], firsts[k + 1]), slice(places[k], places[k + 1])
                    each = list(zip(*(f[part] for f in fields), strict=True))
                    rest[k], gone[k] = without(rest[k], low[at : own.offsets[k + 1]].tobytes(), (starts[words] - at).tolist(), (ends[words] - at).tolist(), each, block_words)
            return [pa.array(rest, pa.binary()).cast(pa.string()), np.diff(firsts), gone]

        return of_slice

    return with_columns(docs, make, "rest string, n_words long, n_removed long", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), cuts_of(docs, block_words, rare))


def without_lines(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, text without the common blocks, n_words before, n_removed words, for each row of ``docs``."""
    rows, _ = shortened(docs.select("doc_id", "text"), **bounds)
    return rows.select(F.col("c0").alias("doc_id"), F.col("rest").alias("text"), "n_words", "n_removed")


def with_own_lines(docs: DataFrame, **bounds: int) -> DataFrame:
    """The rows of ``docs``, all columns, with the common blocks deleted from ``text``; rows of which nothing is left go.

    A column n_chars is set to the length of what is left.
    """
    rows, named = shortened(docs, **bounds)
    return named(rows.where("n_removed = 0 OR n_removed < n_words"), text=F.col("rest"), n_chars=F.length("rest"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents without the blocks that earlier documents hold."""
    return without_lines(table(configured(spark), sf_dir, "documents"))
