"""Fill-in-the-middle transformation, in Arrow-batched pandas UDFs.

A text is cut into units, by default its lines; the ends of all units lie in one
compact array.  Four seeds come from the digest of the document's id, so the
result depends on id and text alone: two choose how many units the prefix and
the prefix with the middle have, one whether the text is transformed, one the
order of the parts.  Two lookups in the array of ends then slice the text.

``psm`` is prefix, suffix, middle; ``spm`` suffix, prefix, middle; ``plain`` the
text as it is: an empty one, one that holds a mark, or one outside the rate.  No
part of a transformed text holds a mark, so ``restore`` finds the parts again.

Defined results: a null text is empty, hence plain; a null id counts as no
digits; rows are transformed each on its own, so repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospan.llm.common import configured, id_and_text, table

MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
LINES = r"[^\n]*\n|[^\n]+"


class Formed(NamedTuple):
    """A document as it is trained on; the lengths are None if it is plain."""

    n: int
    form: str
    output: str
    prefix_chars: int | None
    middle_chars: int | None


def seeds(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def formed(text: str, doc_id: int | None, units: regex.Pattern, marks: tuple[str, str, str], seed: int, rate: int, spm: int) -> Formed:
    ends = array("Q", (m.end() for m in units.finditer(text)))
    n = len(ends)
    h1, h2, h3, h4 = seeds(seed, doc_id)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return Formed(n, "plain", text, None, None)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    p, s, m = marks
    if h4 % 100 < spm:
        return Formed(n, "spm", "".join((s, text[b:], p, text[:a], m, text[a:b])), a, b - a)
    return Formed(n, "psm", "".join((p, text[:a], s, text[b:], m, text[a:b])), a, b - a)


def restore(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text that ``output`` was made of."""
    if form == "plain":
        return output
    p, s, m = marks
    body, middle = output.split(m)
    if form == "spm":
        suffix, prefix = body.removeprefix(s).split(p)
    else:
        prefix, suffix = body.removeprefix(p).split(s)
    return f"{prefix}{middle}{suffix}"


def fill_in_middle(docs: DataFrame, units: str = LINES, marks: tuple[str, str, str] = MARKS, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (units), form, output, prefix_chars and middle_chars of each row of ``docs``.

    ``rate`` per cent of the texts are transformed, ``spm`` per cent of those to
    ``spm``.  ``units`` must match every text from end to end.
    """

    @F.pandas_udf("n long, form string, output string, prefix_chars long, middle_chars long")
    def each(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(units)
        for ids, texts in parts:
            rows = [formed(text or "", None if i is None else int(i), pattern, marks, seed, rate, spm) for i, text in zip(ids, texts, strict=True)]
            yield pd.DataFrame(rows, columns=list(Formed._fields)).astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    # ids travel as text: a batch with a null would carry numbers as floats
    return id_and_text(docs).select("doc_id", each(F.col("doc_id").cast("string"), "text").alias("f")).select("doc_id", "f.*")


def digested(outputs: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """SHA-256 of the outputs and of the texts restored from them, in place of the outputs."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def digests(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in parts:
            both = [(hashlib.sha256(o.encode()).hexdigest(), hashlib.sha256(restore(o, form, marks).encode()).hexdigest()) for o, form in zip(outputs, forms, strict=True)]
            yield pd.DataFrame(both, columns=["output_sha256", "restored_sha256"], dtype="object")

    kept = [c for c in outputs.columns if c != "output"]
    return outputs.select(*kept, digests("output", "form").alias("d")).select(*kept, "d.*")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document cut by lines, transformed and restored."""
    return digested(fill_in_middle(table(configured(spark), sf_dir, "documents")))


OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
         CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS u FROM documents),
s AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= {RATE} THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(u[greatest(x, y) + 1:], '') AS suffix FROM s)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
