"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its words hashed into BUCKETS, each with its count over the
root of the sum of squared counts; STATS statistics of the text's structure;
and the logarithm of the n_chars column (the text's own length where that is
null or missing) as metadata.  Pairwise interactions have rank RANK and take
linear time: half of the square of the sum less the sum of the squares.

Fitting reads a bounded sample: at most SAMPLE_DOCS labelled documents of each
label, by hash of the id; both labels weigh the same in the loss, so a score is
the chance of label 1 where both are as common.  Scoring reads whole texts of
all rows.

Defined results: a null or empty text has no word features and zero statistics
and is scored like any other.  With labels of one kind or none, the score is
the share of label 1, or 0.5.  A document labelled twice has its largest label.
Repeated rows give repeated results, a null doc_id is carried and not held out,
an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospan.llm.common import bucket, byte_table, configured, per_text, table

BUCKETS, RANK = 1 << 15, 4
SAMPLE_DOCS, BATCH, STEPS, RATE, L2, SEED = 3000, 32, 1200, 0.05, 1e-5, 5
THRESHOLD = 0.3
#: Words whose bucket a task keeps, and bytes of the longest of them.
KEPT_WORDS, KEPT_BYTES = 200_000, 64

# Names of the statistics, in order.
STATS = ("words", "word_length", "distinct", "upper", "digits", "symbols", "stops", "bars", "lines", "repeated_lines", "shout", "bytes_a_char", "n_chars")
_SPACES = byte_table(bytes(range(33, 256)))
_UPPER, _DIGITS, _SYMBOLS = bytes(range(0x41, 0x5B)), b"0123456789", b"#*$%&<>"
#: Bytes of a UTF-8 character after its first.
_TAILS = bytes(range(0x80, 0xC0))


class Model(NamedTuple):
    """Weights over BUCKETS hashed words, then the statistics, each after centring and scaling."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


class Extractor:
    """Features of one text; keeps the buckets of the words that it meets first."""

    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}

    def buckets(self, words: list[bytes]) -> list[int]:
        out = list(map(self.at.get, words))
        if None in out:
            for i, b in enumerate(out):
                if b is None:
                    w = words[i]
                    b = out[i] = crc32(w) % BUCKETS
                    if len(self.at) < KEPT_WORDS and len(w) <= KEPT_BYTES:
                        self.at[w] = b
        return out

    def __call__(self, text: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct buckets, their values, and the statistics."""
        text = text or b""
        words = text.translate(_SPACES).split()
        n, size = max(1, len(words)), max(1, len(text))
        share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
        lines = [x for x in text.split(b"\n") if x.strip()]
        points = len(text.translate(None, _TAILS))
        chars = n_chars if n_chars is not None and n_chars >= 0 else points
        stats = (
            math.log1p(len(words)), size / n, len(set(words)) / n, share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(b".,"), share(b"|"), math.log1p(len(lines)),
            1 - len(set(lines)) / max(1, len(lines)), share(b"!?"), size / max(1, points), math.log1p(chars),
        )
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(len(STATS))
        ids, counts = np.unique(np.array(self.buckets(words), np.int32), return_counts=True)
        return ids, (counts / math.sqrt((counts.astype(np.float64) ** 2).sum())).astype(np.float32), np.array(stats)


def interactions(factors: np.ndarray, values: np.ndarray) -> float:
    """Sum over pairs i < j of <v_i, v_j> x_i x_j, in time linear in the number of features."""
    vx = factors * values[:, None]
    return float(0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx**2).sum()))


def assembled(ids: np.ndarray, values: np.ndarray, stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = np.clip((stats - mean) / scale, -4, 4) / math.sqrt(len(stats))
    return np.concatenate((ids, np.arange(BUCKETS, BUCKETS + len(stats)))), np.concatenate((values, z))


def score(model: Model, ids: np.ndarray, values: np.ndarray, stats: np.ndarray) -> float:
    at, x = assembled(ids, values, stats, model.mean, model.scale)
    logit = model.bias + float(model.linear[at] @ x) + interactions(model.factors[at], x)
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, logit))))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], weight: dict[int, float]) -> Model:
    """Adagrad on the weighted log loss; rows are (buckets, values, statistics, label)."""
    rng = np.random.default_rng(SEED)
    dims = BUCKETS + len(STATS)
    linear, factors = np.zeros(dims), rng.normal(0, 0.01, (dims, RANK))
    mean, scale = np.zeros(len(STATS)), np.ones(len(STATS))
    share = sum(weight[r[3]] for r in rows if r[3] == 1) / max(1e-9, sum(weight[r[3]] for r in rows)) if rows else 0.5
    bias = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    if len({r[3] for r in rows}) < 2:
        return Model(bias if rows else 0.0, linear, factors * 0, mean, scale)
    stats = np.array([r[2] for r in rows])
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    data = [(*assembled(i, v, s, mean, scale), y) for i, v, s, y in rows]
    seen_l, seen_f = np.full(dims, 1e-3), np.full((dims, RANK), 1e-3)
    for _ in range(max(3, STEPS * BATCH // len(data))):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), BATCH):
            part = [data[i] for i in order[lo : lo + BATCH]]
            at, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            cut = np.cumsum([0] + [len(p[0]) for p in part[:-1]])
            size = np.diff(np.append(cut, len(at)))
            vx = factors[at] * x[:, None]
            total = np.add.reduceat(vx, cut)
            logit = bias + np.add.reduceat(linear[at] * x, cut) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), cut))
            y = np.array([p[2] for p in part])
            g = (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - y) * np.array([weight[k] for k in y]) / len(part)
            each = np.repeat(g, size)
            bias -= RATE * g.sum()
            # gradients of one feature in a batch add up before the step
            own, back = np.unique(at, return_inverse=True)
            gl = np.bincount(back, each * x, len(own)) + L2 * linear[own]
            seen_l[own] += gl**2
            linear[own] -= RATE * gl / np.sqrt(seen_l[own])
            gf = (each * x)[:, None] * (np.repeat(total, size, axis=0) - vx)
            gf = np.stack([np.bincount(back, gf[:, k], len(own)) for k in range(RANK)], axis=1) + L2 * factors[own]
            seen_f[own] += gf**2
            factors[own] -= RATE * gf / np.sqrt(seen_f[own])
    return Model(float(bias), linear.astype(np.float32), factors.astype(np.float32), mean, scale)


def n_chars_of(docs: DataFrame) -> dict:
    return {"n_chars": F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")}


def extract():
    own = Extractor()

    def one(text: bytes | None, n_chars: int | None) -> tuple:
        ids, values, stats = own(text, n_chars)
        return ids.tolist(), values.tolist(), stats.tolist()

    return one


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from ``labels`` (doc_id, label 0 or 1), joined with ``docs``."""
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], {})
    h = F.xxhash64("doc_id")
    some = None
    for y in counts:
        part = known.where(F.col("label") == y).orderBy(h, "doc_id").limit(sample_docs)
        some = part if some is None else some.unionByName(part)
    ids = F.broadcast(some.select(F.col("doc_id").alias("label_id"), "label"))  # at most 2 * sample_docs rows
    near = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), n_chars_of(docs)["n_chars"].alias("n_chars")).join(ids, F.col("doc_id") == F.col("label_id"))
    # of several texts of one id that of the least hash
    chosen = near.groupBy("doc_id").agg(F.min_by(F.struct("text", "n_chars"), F.struct(F.xxhash64("text"), "text", "n_chars")).alias("x")).select("doc_id", "x.*")
    rows = per_text(chosen, extract, "ids array<int>, x array<float>, stats array<double>", n_chars_of(docs)).join(ids, F.col("doc_id") == F.col("label_id")).orderBy("label_id")
    data = [(np.array(r["ids"], np.int32), np.array(r["x"], np.float32), np.array(r["stats"]), r["label"]) for r in rows.toLocalIterator()]
    used = {y: sum(1 for r in data if r[3] == y) for y in counts}
    return train(data, {y: len(data) / (2 * max(1, used[y])) for y in counts})


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""

    def make():
        own = Extractor()
        return lambda text, n_chars: (score(model, *own(text, n_chars)),)

    return per_text(docs, make, "score double", n_chars_of(docs))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: quality of all documents, learned from four of the five folds."""
    docs = table(configured(spark), sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    held_out = bucket(F.col("doc_id"), 5) == 0
    out = scored(docs, fit(docs, labels.where(~held_out)))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
