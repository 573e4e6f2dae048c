"""Language identification by cross-parsing entropy.

From labelled texts each language gets a suffix automaton over running text.  A
text is parsed from left to right into the longest stretches that an automaton
holds, over word borders; the language that needs the fewest phrases wins, each
count normalised by the logarithm of its automaton's text, with which matches grow.

Texts are folded before: lower case, and whatever is no letter is one space.
Segments are parsed side by side, in arrays, a step for all of them at once, and
then joined to the parse of the whole text (see ``phrases``).

Fitting reads a bounded sample: at most SAMPLE_DOCS labelled documents of each
language, the distinct texts with the smallest hashes, and of those
TRAIN_BYTES.  Prediction reads whole texts and nothing but the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
languages with equally few phrases: the first in alphabetical order, score 0.
With no labelled text at all, every text is ``und``.  More than MOST_LANGS labels are an
error: that column holds something else.  Repeated rows give repeated results, a null
doc_id is carried, an empty table gives an empty result, other columns are
ignored, or kept by ``in_known_language``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronospan.llm.common import bucket, byte_table, configured, per_slice, table, with_columns

#: Bounds of the sample, of an automaton's text, and of the labels.
SAMPLE_DOCS, TRAIN_BYTES, MOST_LANGS = 300, 20_000, 64
#: Bytes of a stretch that is parsed on its own.
SEGMENT = 256

_ASCII = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)])
LETTERS = byte_table(_ASCII + bytes(range(0x80, 0x100)))
_NOT_ASCII = bytes(b for b in range(256) if b not in _ASCII)

#: The text of each language's automaton, in alphabetical order of the languages.
Model = dict[str, bytes]


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``: it holds exactly the stretches of the text; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Tables(NamedTuple):
    """All automata as one array ``step``: a state is the place of its row, which has its transitions by code.

    A transition that isn't there leads to 0, whose row is empty.  ``start`` has
    each language's transitions from its start; ``code`` is the column of each
    byte, 0 for those that no training text has.
    """

    code: np.ndarray
    step: np.ndarray
    start: np.ndarray


@lru_cache(2)
def tables(texts: tuple[bytes, ...]) -> Tables:
    used = sorted(set(b"".join(texts)))
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    width, made, first = len(used) + 1, [automaton(t) for t in texts], 1
    step = np.zeros((1 + sum(map(len, made)), width), np.int32)  # row 0: no phrase is open
    start = np.zeros((len(texts), width), np.int32)
    for k, rows in enumerate(made):
        for s, row in enumerate(rows):
            for c, to in row.items():
                step[first + s, code[c]] = (first + to) * width
        start[k] = step[first]
        first += len(rows)
    return Tables(code, step.ravel(), start)


def folded(text: bytes | None) -> bytes:
    """The words of a text, in lower case, between single spaces; empty without a letter of any script."""
    if not text or (not text.translate(None, _NOT_ASCII) and not any(c.isalpha() for c in text.decode("utf-8", "replace"))):
        return b""
    lower = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return b" %s " % b" ".join(lower.translate(LETTERS).split())


def parsed_on(text: bytes, lang: int, t: Tables) -> int:
    """Phrases of one folded text in one language, byte by byte."""
    state, n = 0, 0
    for c in t.code[np.frombuffer(text, np.uint8)].tolist():
        to = int(t.step[state + c])
        if not to:
            n, to = n + 1, int(t.start[lang, c])
        state = to
    return n


def phrases(texts: list[bytes], t: Tables) -> np.ndarray:
    """Phrases of each folded text, a row, in each language, a column: the longest matches, one after another, that spell it.

    Segments of SEGMENT bytes are parsed side by side, each as if a phrase began
    with it.  Then the parse of each segment goes on into the next until both begin a
    phrase at the same byte, after which they are one: the phrases up to there
    are those of the parse that came in.  Where that isn't so within a segment, the text is
    parsed byte by byte.
    """
    sizes = np.array([-(-len(x) // SEGMENT) for x in texts])
    whole = b"".join(x.ljust(n * SEGMENT, b"\0") for x, n in zip(texts, sizes.tolist(), strict=True))
    codes = np.ascontiguousarray(t.code[np.frombuffer(whole, np.uint8)].reshape(-1, SEGMENT).T).astype(np.int64)
    langs = len(t.start)
    state = np.zeros((langs, codes.shape[1]), np.int64)
    begun = np.empty((SEGMENT, *state.shape), bool)
    to = np.empty(state.shape, np.int32)
    for c, missing in zip(codes, begun, strict=True):
        state += c
        np.take(t.step, state, out=to, mode="clip")
        np.equal(to, 0, out=missing)
        to += missing * t.start[:, c]
        state[...] = to
    n = begun.sum(axis=0, dtype=np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    # what goes on from the segment before: pairs (language, segment), fewer with each byte
    lang, at = (x.ravel() for x in np.meshgrid(np.arange(langs), np.flatnonzero(of[1:] == of[:-1]) + 1, indexing="ij"))
    on = state[lang, at - 1]
    for c, own in zip(codes, begun, strict=True):
        if not len(on):
            break
        to = t.step[on + c[at]].astype(np.int64)
        missing, there = to == 0, own[lang, at]
        to += missing * t.start[lang, c[at]]
        np.add.at(n, (lang, at), missing.astype(np.int64) - there)
        apart = ~(missing & there)
        lang, at, on = lang[apart], at[apart], to[apart]
    out = np.stack([np.bincount(of, row, len(texts)) for row in n], axis=1).astype(np.int64)
    out -= (sizes * SEGMENT - np.array([len(x) for x in texts]))[:, None]  # each byte of padding was a phrase
    for k, j in set(zip(of[at].tolist(), lang.tolist(), strict=True)):
        out[k, j] = parsed_on(texts[k], j, t)
    return out


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """The training text of each value of ``lang`` in ``labelled`` (lang, text)."""
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count_distinct("h").alias("n")).limit(MOST_LANGS + 1).collect()}
    if not counts:
        return {}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"lang has more than {MOST_LANGS} values")
    # enough hashes for half as many distinct texts again as wanted; only those reach the window
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * sample_docs / n + 50 / n)))])
    near = known.where(F.pmod("h", F.lit(1 << 30)) < F.try_element_at(share, "lang") * (1 << 30)).dropDuplicates(["lang", "h"])
    first = near.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= sample_docs)
    seen: dict[str, bytes] = {k: b"" for k in counts}
    for r in first.orderBy("lang", "h").select("lang", F.left("text", F.lit(train_bytes)).alias("text")).toLocalIterator():
        if len(seen[r["lang"]]) < train_bytes:
            seen[r["lang"]] += folded(r["text"].encode())
    return {k: x[:train_bytes] for k, x in sorted(seen.items())}


def predictor(model: Model) -> Callable[[pa.Array], list]:
    """From a slice of texts to the language and the score of each."""
    langs, t = list(model), tables(tuple(model.values()))
    # a match grows with the logarithm of the text that it is looked for in
    size = np.log([len(x) + 2 for x in model.values()]) if langs else np.zeros(0)
    weight = size / size.max() if langs else size

    def of_slice(texts: pa.Array) -> list:
        own = [folded(x) for x in texts.to_pylist()] if langs else [b""] * len(texts)
        at = [k for k, x in enumerate(own) if x]
        names, scores = ["und"] * len(own), [0.0] * len(own)
        if at:
            n = phrases([own[k] for k in at], t) * weight
            order = np.argsort(n, axis=1, kind="stable")
            for k, row, by in zip(at, n, order, strict=True):
                names[k] = langs[by[0]]
                scores[k] = float(1 - row[by[0]] / row[by[1]]) if len(by) > 1 else 1.0
        return [names, scores]

    return of_slice


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id with lang_pred and score of each row of ``docs``."""
    return per_slice(docs, lambda: predictor(model), "lang_pred string, score double")


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is one of those that its own labelled rows teach.

    Texts that are null or have no letter go; with no labelled row nothing is
    known and all rows stay.
    """
    model = fit(docs.select("lang", "text"))
    if not model:
        return docs
    rows, named = with_columns(docs, lambda: predictor(model), "lang_pred string, score double")
    return named(rows.where("lang_pred <> 'und'"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the language of all documents, learned from three of the four folds."""
    docs = table(configured(spark), sf_dir, "documents")
    held_out = bucket(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held_out).select("lang", "text"))
    return identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
