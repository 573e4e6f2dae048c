"""Domain scalars as Column expressions (SCL-1 to SCL-8, SCL-11 to SCL-16, SRC-4)."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSENT, ACTIONABLE = "ABSENT", ("PATHOGENIC", "LIKELY_PATHOGENIC", "BENIGN", "LIKELY_BENIGN")
TOWARD_PATHOGENIC, TOWARD_BENIGN = ("PATHOGENIC", "LIKELY_PATHOGENIC"), ("BENIGN", "LIKELY_BENIGN")
OPEN_END = "9999-12-31"
FLANK = 5000

# Terms of significance and their buckets.
SIGNIFICANCE = {
    "pathogenic": "PATHOGENIC",
    "pathogenic/likely_pathogenic": "PATHOGENIC",
    "pathogenic/likely_pathogenic/pathogenic_low_penetrance": "PATHOGENIC",
    "likely_pathogenic": "LIKELY_PATHOGENIC",
    "likely_pathogenic_low_penetrance": "LIKELY_PATHOGENIC",
    "uncertain_significance": "UNCERTAIN",
    "uncertain_risk_allele": "UNCERTAIN",
    "likely_benign": "LIKELY_BENIGN",
    "benign": "BENIGN",
    "benign/likely_benign": "BENIGN",
    "conflicting_interpretations_of_pathogenicity": "CONFLICTING",
    "conflicting_classifications_of_pathogenicity": "CONFLICTING",
}
# Weight of the buckets that can be ranked.
WEIGHT = {"PATHOGENIC": 2, "LIKELY_PATHOGENIC": 1, "UNCERTAIN": 0, "LIKELY_BENIGN": 1, "BENIGN": 2}
# Review status and stars; any other has none.
STARS = {
    "practice_guideline": 4,
    "reviewed_by_expert_panel": 3,
    "criteria_provided,_multiple_submitters,_no_conflicts": 2,
    "criteria_provided,_single_submitter": 1,
    "criteria_provided,_conflicting_interpretations": 1,
    "criteria_provided,_conflicting_classifications": 1,
}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def bucket(significance: Column) -> Column:
    """SCL-1: of the terms between bars or commas the weightiest, the first of equals; else CONFLICTING, else OTHER."""
    terms = F.transform(F.split(F.coalesce(significance, F.lit("")), "[|,]"), lambda t: F.lower(F.trim(t)))
    known = F.filter(F.transform(terms, lambda t: F.try_element_at(_map(SIGNIFICANCE), t)), lambda b: b.isNotNull())
    ranked = F.filter(F.transform(known, lambda b, i: F.struct(F.try_element_at(_map(WEIGHT), b).alias("w"), (-i).alias("i"), b.alias("b"))), lambda x: x["w"].isNotNull())
    return F.coalesce(F.array_max(ranked)["b"], F.when(F.array_contains(known, "CONFLICTING"), F.lit("CONFLICTING")), F.lit("OTHER"))


def stars(status: Column) -> Column:
    """SCL-2: stars of a whole review status; it holds commas, so it is never split."""
    return F.coalesce(F.try_element_at(_map(STARS), F.lower(F.trim(status))), F.lit(0)).cast("byte")


def contig(name: Column) -> Column:
    """SCL-5: without ``chr``, in upper case, M as MT."""
    bare = F.upper(F.regexp_replace(F.trim(name), "(?i)^chr", ""))
    return F.when(bare.isin("M", "MT"), F.lit("MT")).otherwise(bare)


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for each row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(pos: Column, ref: Column, alt: Column) -> Column:
    """SCL-6: struct (pos, ref, alt) in upper case without shared suffix, then prefix; each keeps a base.

    Each step is bound by ``_with``: as plain columns the shared ends would be searched anew at every use, inside each other's loops.
    """
    # equal ends of lengths 1..k are nested, so their number is the length of the longest
    shared = lambda x, part: F.size(F.filter(_upto(F.least(F.length(x["a"]), F.length(x["b"])) - 1), lambda i: part(x["a"], i) == part(x["b"], i)))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    without_tail = lambda x: _with(shared(x, F.right), lambda n: pair(F.left(x["a"], F.length(x["a"]) - n), F.left(x["b"], F.length(x["b"]) - n)))
    without_head = lambda x: _with(
        shared(x, F.left), lambda n: F.struct((pos + n).alias("pos"), F.substring(x["a"], n + 1, F.length(x["a"])).alias("ref"), F.substring(x["b"], n + 1, F.length(x["b"])).alias("alt"))
    )
    return _with(_with(pair(F.upper(ref), F.upper(alt)), without_tail), without_head)


def sha512t24u(data: Column) -> Column:
    """SCL-7: first 24 bytes of SHA-512 in URL-safe base64."""
    return F.translate(F.base64(F.unhex(F.substring(F.sha2(data, 512), 1, 48))), "+/", "-_")


def allele_id(assembly: str, contig_: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """SCL-8: the identity of an allele; null where a base is missing or is none of ACGTN."""
    text = _with(trimmed(pos, ref, alt), lambda t: F.concat_ws("\t", F.lit(assembly), contig(contig_), t["pos"].cast("string"), t["ref"], t["alt"]))
    digest = sha512t24u(text.cast("binary"))
    valid = ref.rlike("^[ACGTNacgtn]+$") & alt.rlike("^[ACGTNacgtn]+$") & pos.isNotNull() & contig_.isNotNull()
    return F.when(valid, F.concat(F.lit("chronospan:VA."), digest))


def info_map(info: Column) -> Column:
    """SCL-3: keys and values between semicolons; a flag has an empty value, the last of equal keys holds."""
    items = F.filter(F.split(info, ";"), lambda x: x != "")
    pairs = F.transform(items, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("").alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["key"] == p["key"])))


def first_gene(geneinfo: Column) -> Column:
    """SCL-4: the first symbol of a gene list; null if empty."""
    return F.when(geneinfo != "", F.substring_index(geneinfo, ":", 1))


def condition(name: Column) -> Column:
    """SCL-4: a condition for reading, of 300 characters at most."""
    return F.left(F.replace(F.replace(name, F.lit("_"), F.lit(" ")), F.lit("|"), F.lit("; ")), F.lit(300))


def padded(start: Column, end: Column, flank: int = FLANK) -> Column:
    """SCL-11: a region with flanks, from 1."""
    return F.struct(F.greatest(F.lit(1), start - flank).alias("start"), (end + flank).alias("end"))


def like_escaped(text: Column) -> Column:
    """SCL-12: the text with LIKE's wildcards taken literally."""
    for c in ("\\", "%", "_"):
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def strict_date(text: Column) -> Column:
    """SCL-13: a date written yyyy-mm-dd, else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def ratio(part: Column, whole: Column) -> Column:
    """SCL-19, PRJ-5: a share, 0 of nothing."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def vcf_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC-4: records of text lines; headers, short lines, several or symbolic alternatives go."""
    cols = F.split(F.rtrim(F.regexp_replace(F.col(column), r"[\r\n]+$", "")), "\t")
    rows = lines.where(F.col(column) != "").where(~F.startswith(F.col(column), F.lit("#"))).select(cols.alias("c")).where(F.size("c") >= 8)
    c = [F.get("c", F.lit(i)) for i in range(8)]  # filters may run in any order, so a missing column reads as null
    pos = F.when(F.trim(c[1]).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(c[1]).cast("long"))
    own = rows.select(c[2].alias("variation_id"), c[0].alias("contig"), pos.alias("pos"), c[3].alias("ref"), c[4].alias("alt"), info_map(c[7]).alias("info"))
    own = own.where("pos IS NOT NULL").where(~F.col("alt").contains(",") & ~F.startswith("alt", F.lit("<")) & ~F.col("alt").isin(".", "") & ~F.col("ref").isin(".", ""))
    field = lambda k: F.try_element_at("info", F.lit(k))
    raw = own.withColumn("clnsig_raw", field("CLNSIG")).withColumn("clnrevstat_raw", field("CLNREVSTAT"))
    return raw.select("variation_id", "contig", "pos", "ref", "alt", first_gene(field("GENEINFO")).alias("gene"), bucket(F.col("clnsig_raw")).alias("bucket"), stars(F.col("clnrevstat_raw")).alias("stars"), "clnsig_raw", "clnrevstat_raw", condition(field("CLNDN")).alias("condition"))
