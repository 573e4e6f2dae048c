"""License scan: ordered signature rules behind a keyword prefilter.

A text is reduced to its words; a rule is a regex over the words joined by one
space, so punctuation, line breaks and case don't matter.  A rule names groups of
words, one of each of which any match must contain; a text with a word of the
rule's rarest group and of all others meets the regex.  Of
the detections, those of higher priority, then longer ones, then earlier ones
go first, and one whose interval lies inside an accepted interval is dropped.

Defined results: a null or empty text has no words, no detections, score 0.
Rows are independent: repeated rows give repeated results, a null doc_id is
carried, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from chronospan.llm.common import byte_table, configured, per_text, table
from chronospan.llm.license_rules import NOTICES, TEXTS

#: Word bytes: 0-9, a-z, and all of non-ASCII UTF-8.
WORDS = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))

# The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label | SPDX identifier in words | pattern of its name in words | keywords of each match.
FAMILIES = """
apache-2.0 | apache 2 0 | apache (?:software )?license(?: version)? 2(?: 0)? | apache
apache-1.1 | apache 1 1 | apache (?:software )?license(?: version)? 1 1 | apache
mit | mit | (?:mit|expat) licen[cs]e | mit/expat
x11 | x11 | x11 licen[cs]e | x11
mit-0 | mit 0 | mit no attribution | mit
bsd-2-clause | bsd 2 clause | (?:bsd 2 clause|simplified bsd|freebsd) licen[cs]e | bsd/freebsd
bsd-3-clause | bsd 3 clause | (?:bsd 3 clause|new bsd|modified bsd|revised bsd) licen[cs]e | bsd
bsd-4-clause | bsd 4 clause | (?:bsd 4 clause|original bsd) licen[cs]e | bsd
0bsd | 0bsd | zero clause bsd | bsd
isc | isc | isc licen[cs]e | isc
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib
libpng | libpng | libpng licen[cs]e | libpng
bsl-1.0 | bsl 1 0 | boost software licen[cs]e(?: version)?(?: 1 0)? | boost
gpl-1.0 | gpl 1 0(?: only| or later)? | (?:gnu general public licen[cs]e(?: version)? 1|gpl ?v1)(?: 0)? | gnu/gpl/gplv1
gpl-2.0 | gpl 2 0(?: only| or later)? | (?:gnu general public licen[cs]e(?: version)? 2|gpl ?v2)(?: 0)? | gnu/gpl/gplv2
gpl-3.0 | gpl 3 0(?: only| or later)? | (?:gnu general public licen[cs]e(?: version)? 3|gpl ?v3)(?: 0)? | gnu/gpl/gplv3
lgpl-2.0 | lgpl 2 0(?: only| or later)? | gnu library general public licen[cs]e(?: version)? 2(?: 0)? | library
lgpl-2.1 | lgpl 2 1(?: only| or later)? | (?:gnu lesser general public licen[cs]e(?: version)? 2 1|lgpl ?v2 1) | gnu/lgpl/lgplv2
lgpl-3.0 | lgpl 3 0(?: only| or later)? | (?:gnu lesser general public licen[cs]e(?: version)? 3|lgpl ?v3)(?: 0)? | gnu/lgpl/lgplv3
agpl-3.0 | agpl 3 0(?: only| or later)? | (?:gnu affero general public licen[cs]e(?: version)? 3|agpl ?v3)(?: 0)? | gnu/agpl/agplv3
gfdl-1.2 | gfdl 1 2(?: only| or later)? | gnu free documentation licen[cs]e(?: version)? 1 2 | documentation
gfdl-1.3 | gfdl 1 3(?: only| or later)? | gnu free documentation licen[cs]e(?: version)? 1 3 | documentation
mpl-1.1 | mpl 1 1 | mozilla public licen[cs]e(?: version)? 1 1 | mozilla
mpl-2.0 | mpl 2 0 | mozilla public licen[cs]e(?: version)? 2(?: 0)? | mozilla
epl-1.0 | epl 1 0 | eclipse public licen[cs]e(?: version)? 1(?: 0)? | eclipse
epl-2.0 | epl 2 0 | eclipse public licen[cs]e(?: version)? 2(?: 0)? | eclipse
cddl-1.0 | cddl 1 0 | common development and distribution licen[cs]e(?: version)?(?: 1 0)? | development
cddl-1.1 | cddl 1 1 | common development and distribution licen[cs]e(?: version)? 1 1 | development
cpl-1.0 | cpl 1 0 | common public licen[cs]e(?: version)?(?: 1 0)? | common
ipl-1.0 | ipl 1 0 | ibm public licen[cs]e(?: version)?(?: 1 0)? | ibm
eupl-1.1 | eupl 1 1 | european union public licen[cs]e(?: version)? 1 1 | european
eupl-1.2 | eupl 1 2 | european union public licen[cs]e(?: version)? 1 2 | european
artistic-1.0 | artistic 1 0 | artistic licen[cs]e(?: version)? 1(?: 0)? | artistic
artistic-2.0 | artistic 2 0 | artistic licen[cs]e(?: version)? 2(?: 0)? | artistic
ms-pl | ms pl | microsoft public licen[cs]e | microsoft
ms-rl | ms rl | microsoft reciprocal licen[cs]e | microsoft
unlicense | unlicense | (?:the )?unlicense | unlicense
wtfpl | wtfpl | do what the fuck you want to public licen[cs]e | fuck
cc0-1.0 | cc0 1 0 | (?:cc0(?: 1 0)?(?: universal)?|creative commons zero) | cc0/creative
cc-by-2.0 | cc by 2 0 | (?:cc by 2 0|creative commons attribution 2 0) | cc/creative 2
cc-by-3.0 | cc by 3 0 | (?:cc by 3 0|creative commons attribution 3 0) | cc/creative 3
cc-by-4.0 | cc by 4 0 | (?:cc by 4 0|creative commons attribution 4 0) | cc/creative 4
cc-by-sa-2.0 | cc by sa 2 0 | (?:cc by sa 2 0|creative commons attribution share ?alike 2 0) | cc/creative 2
cc-by-sa-3.0 | cc by sa 3 0 | (?:cc by sa 3 0|creative commons attribution share ?alike 3 0) | cc/creative 3
cc-by-sa-4.0 | cc by sa 4 0 | (?:cc by sa 4 0|creative commons attribution share ?alike 4 0) | cc/creative 4
cc-by-nc-2.0 | cc by nc 2 0 | (?:cc by nc 2 0|creative commons attribution non ?commercial 2 0) | cc/creative 2
cc-by-nc-3.0 | cc by nc 3 0 | (?:cc by nc 3 0|creative commons attribution non ?commercial 3 0) | cc/creative 3
cc-by-nc-4.0 | cc by nc 4 0 | (?:cc by nc 4 0|creative commons attribution non ?commercial 4 0) | cc/creative 4
cc-by-nd-4.0 | cc by nd 4 0 | (?:cc by nd 4 0|creative commons attribution no ?deriv(?:ative)?s 4 0) | cc/creative 4
cc-by-nc-sa-3.0 | cc by nc sa 3 0 | (?:cc by nc sa 3 0|creative commons attribution non ?commercial share ?alike 3 0) | cc/creative 3
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | (?:cc by nc sa 4 0|creative commons attribution non ?commercial share ?alike 4 0) | cc/creative 4
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | (?:cc by nc nd 4 0|creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0) | cc/creative 4
odbl-1.0 | odbl 1 0 | open (?:data commons open )?database licen[cs]e | database
odc-by-1.0 | odc by 1 0 | open data commons attribution licen[cs]e | commons
pddl-1.0 | pddl 1 0 | public domain dedication and licen[cs]e | dedication
ofl-1.1 | ofl 1 1 | sil open font licen[cs]e(?: version)?(?: 1 1)? | font
python-2.0 | python 2 0 | python (?:software foundation )?licen[cs]e(?: version)?(?: 2)? | python
php-3.01 | php 3 01 | php licen[cs]e(?: version)?(?: 3 01)? | php
ruby | ruby | ruby licen[cs]e | ruby
postgresql | postgresql | postgresql licen[cs]e | postgresql
openssl | openssl | openssl licen[cs]e | openssl
vim | vim | vim licen[cs]e | vim
curl | curl | curl licen[cs]e | curl
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[cs]e | ncsa
upl-1.0 | upl 1 0 | universal permissive licen[cs]e(?: version)?(?: 1 0)? | permissive
ecl-2.0 | ecl 2 0 | educational community licen[cs]e(?: version)?(?: 2 0)? | educational
osl-3.0 | osl 3 0 | open software licen[cs]e(?: version)? 3(?: 0)? | open
afl-3.0 | afl 3 0 | academic free licen[cs]e(?: version)? 3(?: 0)? | academic
mulanpsl-2.0 | mulanpsl 2 0 | mulan permissive software licen[cs]e(?: version)?(?: 2)? | mulan
busl-1.1 | busl 1 1 | business source licen[cs]e(?: version)?(?: 1 1)? | business
sspl-1.0 | sspl 1 0 | server side public licen[cs]e(?: version)?(?: 1)? | server
elastic-2.0 | elastic 2 0 | elastic licen[cs]e(?: version)?(?: 2(?: 0)?)? | elastic
"""

# Forms in which a text names a licence: form | priority | relevance | pattern ({s} SPDX, {n} name) | keywords besides the name's.
FORMS = """
tag | 90 | 1.0 | spdx licen[cs]e identifier {s} | spdx identifier
grant | 80 | 0.95 | (?:licen[cs]ed|released|distributed|published|available|provided|redistributed|used) under (?:the )?(?:terms of (?:the )?)?{n} | under
name | 40 | 0.8 | (?:licen[cs]e (?:is |type |name )?)?{n} | -
"""


class Rule(NamedTuple):
    label: str
    priority: int
    relevance: float
    pattern: str
    words: tuple[frozenset[bytes], ...]  # each match has a word of each group


class Scan(NamedTuple):
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float
    spans: str


def _rows(text: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in text.strip().splitlines()]


def _groups(*keywords: str) -> tuple[frozenset[bytes], ...]:
    return tuple(frozenset(w.encode() for w in g.split("/")) for k in keywords if k != "-" for g in k.split())


def rules() -> list[Rule]:
    """All rules in order: those written out one by one, then each family's names in each form."""
    out = [Rule(label, int(p), float(r), pattern, _groups(need)) for label, p, r, pattern, need in _rows(TEXTS) + _rows(NOTICES)]
    for label, spdx, name, own in _rows(FAMILIES):
        for form, priority, relevance, pattern, need in _rows(FORMS):
            out.append(Rule(label, int(priority), float(relevance), pattern.format(s=spdx, n=f"(?:{name})"), _groups(need, "-" if form == "tag" else own)))
    return out


class Compiled(NamedTuple):
    """The rules with their patterns, and the numbers of the rules that each word of an anchor, a rule's rarest group, opens."""

    rules: tuple[tuple[Rule, re.Pattern[bytes]], ...]
    opened: dict[bytes, list[int]]
    anchors: frozenset[bytes]


@lru_cache(1)
def compiled() -> Compiled:
    own = tuple((r, re.compile(rb"(?<= )(?:" + r.pattern.encode() + rb")(?= )")) for r in rules())
    opened: dict[bytes, list[int]] = {}
    for k, (rule, _) in enumerate(own):
        # a long word is rarer than a short one, and one word than several
        for w in min(rule.words, key=lambda g: (sum(1 / (1 + len(w) ** 3) for w in g), sorted(g))):
            opened.setdefault(w, []).append(k)
    return Compiled(own, opened, frozenset(opened))


def detections(words: list[bytes]) -> tuple[bytes, list[tuple[int, int, int, Rule]]]:
    """The words in one line, and (start, end, number of the rule, rule) of each match in it: a rule meets the line if it has a word of each of its groups."""
    c = compiled()
    vocabulary = set(words)
    line = b" " + b" ".join(words) + b" "
    found = []
    for k in sorted({k for w in c.anchors.intersection(vocabulary) for k in c.opened[w]}):
        rule, pattern = c.rules[k]
        if all(not g.isdisjoint(vocabulary) for g in rule.words):
            found += [(m.start(), m.end(), k, rule) for m in pattern.finditer(line)]
    return line, found


def suppressed(found: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, number of the rule, rule) left after containment suppression, by start.

    Accepted intervals are kept so that no one contains another: starts and ends
    both rise, and one binary search tells whether an interval lies inside any.
    """
    kept: list[tuple[int, int, Rule]] = []
    spans: list[tuple[int, int]] = []  # maximal accepted intervals
    for start, end, _, rule in sorted(found, key=lambda x: (-x[3].priority, x[0] - x[1], x[0], x[2])):
        at = bisect_right(spans, (start, float("inf")))
        if at and spans[at - 1][1] >= end:
            continue
        kept.append((start, end, rule))
        lo = bisect_left(spans, (start, -1))
        hi = lo
        while hi < len(spans) and spans[hi][1] <= end:
            hi += 1
        del spans[lo:hi]
        insort(spans, (start, end))
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].label))


def scan(text: bytes | None) -> Scan:
    """Scans one whole UTF-8 text."""
    words = (text or b"").translate(WORDS).split()
    n = len(words)
    if compiled().anchors.isdisjoint(words) and b"license" not in words:
        return Scan(n, 0, None, None, "", "", 0.0, "")
    base, base_labels = [], set()
    if b"license" in words:
        for i, w in enumerate(words):
            if w == b"license" and i:
                for phrase, label in BASE:
                    own = phrase.encode().split()
                    at = i + 1 - len(own)
                    if at >= 0 and words[at : i + 1] == own:
                        base.append(at)
                        base_labels.add(label)
    line, found = detections(words)
    kept = suppressed(found)
    # byte offsets in the line become word numbers: a word starts after each space
    spans = ",".join(f"{r.label}:{line.count(b' ', 0, s) - 1}:{line.count(b' ', 0, e)}" for s, e, r in kept) if kept else ""
    labels = sorted(base_labels | {r.label for _, _, r in kept})
    score = max([r.relevance for _, _, r in kept], default=0.0)
    return Scan(n, len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(labels), max(score, 0.9 if base else 0.0), spans)


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, all labels, score and word spans of the detections."""
    return per_text(docs, lambda: scan, COLUMNS)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the scan of all documents."""
    return scan_licenses(table(configured(spark), sf_dir, "documents"))
