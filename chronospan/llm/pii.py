"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole candidate segments.  Each place where digits, an address,
an account or a secret may stand proposes segments with several starts, ends and
types: every run of neighbouring digit groups of a fitting size, every shorter
domain, every whole number of account groups.  Features look at the whole span
(digit counts, check sums, alphabet, shape), at the words around it and at
what a boundary would cut off.  A dynamic programme over the lattice of
segments picks boundaries and types jointly: text outside segments scores 0, no
two chosen segments overlap, and a segment that begins within NEAR characters
of the one before also has a weight for the pair of their types.  Segments of the
fixed patterns are forced; candidates that touch one of them leave the lattice.
Entities are bounded: at most MAX_GROUPS groups or MAX_SPAN characters; secrets
have no bound.  They are runs of one kind of character, tokens with a published beginning,
web tokens of two or three parts, private key blocks, and what a word such as password assigns.

The weights are trained here, by stochastic gradient steps on the
log-likelihood (forward-backward over the lattice), on sentences drawn from
templates with a fixed seed: TRAIN_SENTENCES of them, whatever the corpus.

Defined results: a null or empty text has no spans and the hash of the empty
string.  Rows are independent: repeated rows give repeated results, a null
doc_id is carried, an empty table gives an empty result, other columns are
ignored.  Long texts are scanned whole; no pattern backtracks over more than a
bounded stretch.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from chronospan.llm.common import configured, per_text, table

#: Kinds in the order in which spans with one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
ORDER = {k: i for i, k in enumerate(KINDS)}
TRAIN_SENTENCES, EPOCHS, RATE, DECAY, SEED = 2400, 6, 0.15, 1e-4, 20
#: Bounds of an entity, in code points and in groups; how near a segment must be to the one before for their types to count.
MAX_SPAN, MAX_GROUPS, NEAR = 130, 7, 40

Span = tuple[int, int, str]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|::|[(\[]at[)\]]| dot |[A-Za-z_/+-]{16}|[:=]| (?:is|ist|es|est) ")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each @: the local part runs left to the last match or the first other character."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                out.append((start, end, "email"))
                at = end - 1
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Matches of the four fixed patterns that pass their checks, in listed order."""
    out = emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


# Loose patterns that propose segments: kind, text that must be there, pattern.
PROPOSE = (
    ("email", "@", re.compile(r"(?<![\w.%+-])\w[\w.%+-]{0,63}@\w[\w-]{0,62}(?:\.\w[\w-]{0,62}){1,5}")),
    ("email", "at", re.compile(r"(?<![\w.%+-])\w[\w.%+-]{0,40} ?[(\[]at[)\]] ?\w[\w-]{0,40}(?:(?:\.| ?[(\[]dot[)\]] ?)\w[\w-]{0,40}){1,4}")),
    ("ip", ":", re.compile(r"(?<![\w:])(?:(?=[0-9A-Fa-f:]{0,40}::)[0-9A-Fa-f]{0,4}(?:::?[0-9A-Fa-f]{1,4}){1,8}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7})(?![\w:])")),
    ("iban", "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("email", " at ", re.compile(r"(?<![\w.%+-])\w[\w.%+-]{0,40} at \w[\w-]{0,40}(?: dot \w[\w-]{0,20}){1,3}(?![\w-])")),
    ("secret", "", re.compile(r"(?<![\w/+-])[A-Za-z0-9_/+-]{16,}+={0,2}(?![\w/+-])")),
    ("secret", "eyJ", re.compile(r"(?<![\w-])eyJ[\w-]{8,}+\.[\w-]{8,}+(?:\.[\w-]++)?")),
    ("secret", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]++-----END [A-Z ]{0,30}PRIVATE KEY-----")),
)
# Beginnings of tokens that their issuers publish.
PREFIXES = "ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk_live_ sk_test_ rk_live_ pk_live_ whsec_ xoxb- xoxp- xoxa- xoxs- AKIA ASIA AIza ya29. npm_ pypi- hf_ dop_v1_ shpat_ SG. sk-".split()
_PREFIXED = re.compile(rf"(?<![\w-])(?:{'|'.join(map(re.escape, PREFIXES))})[\w.-]*\w")
# Words that name a secret, what assigns it, and the value, of any length from 6 on.
_ASSIGNED = re.compile(r"(?i)(?<![^\W_])(?:password|passwd|passwort|passphrase|pwd|contraseña|mot de passe|secret|token|api[_-]?key)(?:\"|')?(?: ?[:=]+ ?| is | ist | es | est )[\"']?([^\s\"'<>]{6,128})")
_ASSIGNS = re.compile(r"(?:password|passwd|passwort|passphrase|pwd|contraseña|mot de passe|secret|token|api[_-]?key)[\"']?(?: ?[:=]+ ?| is | ist | es | est )[\"']?$")
_GROUP = re.compile(r"[0-9]+")
#: What may stand between two groups of digits of one number.
_BETWEEN = re.compile(r"[ ./-]|\) ?|[ -]\(")
# Words that tell a kind when they stand before a span, in the corpus's four languages.
CUES = {
    "email": "mail email e-mail contact correo courriel",
    "ip": "ip host server address serveur adresse servidor",
    "card": "card visa mastercard amex karte carte tarjeta credit payment",
    "phone": "phone tel call mobile fax telefon telefono téléphone teléfono appelez anruf",
    "iban": "iban account konto compte cuenta bank banque banco",
    "secret": "token key secret password passwd pwd apikey api_key bearer credential auth",
    "ssn": "ssn social security",
}
_CUE = {w: k for k, ws in CUES.items() for w in ws.split()}
_WORD = re.compile(r"[\w-]+")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[ ./-][01]?[0-9][ ./-][0-3]?[0-9]|[0-3]?[0-9][ ./-][01]?[0-9][ ./-](?:19|20)[0-9]{2}")


def features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Names of the features of one whole segment, each joined with its kind."""
    span, before, after = text[start:end], text[max(0, start - 32) : start].lower(), text[end : end + 16].lower()
    digits = sum(c.isdigit() for c in span)
    said = {_CUE[w] for w in _WORD.findall(before)[-4:] if w in _CUE}
    # a secret may tell itself, by what it begins with or what assigns it
    known = kind == "secret" and (_PREFIXED.match(span) or span.startswith(("eyJ", "-----BEGIN")))
    assigned = kind == "secret" and _ASSIGNS.search(before)
    out = ["bias", f"digits{min(digits, 20)}", "known" if known else "cue" if kind in said or assigned else "other_cue" if said else "no_cue", f"long{min(len(span), 64) // 8}"]
    if kind in {_CUE[w] for w in _WORD.findall(after)[:2] if w in _CUE}:
        out.append("cue_after")
    if before[-1:] in "\"'=:":
        out.append("quoted")
    # digits that the boundary leaves outside, a separator away
    out += ["cut_left"] * bool(_CUT_LEFT.search(before)) + ["cut_right"] * bool(_CUT_RIGHT.match(after))
    if "commit" in before or "sha" in before or "version" in before or "isbn" in before:
        out.append("code")
    if digits == len(span):
        out.append("all_digits")
    if kind == "card":
        out.append("luhn" if luhn(_NOT_DIGIT.sub("", span)) else "no_luhn")
    elif kind == "iban":
        n = "".join(str(int(c, 36)) for c in (span.replace(" ", "")[4:] + span[:4]))
        out.append("mod97" if int(n) % 97 == 1 else "no_mod97")
    elif kind == "secret":
        counts = Counter(span)
        h = -sum(c / len(span) * math.log2(c / len(span)) for c in counts.values())
        out += [f"entropy{int(h * 2)}", "hex" if not set(span) - set("0123456789abcdef") else "mixed" if re.search("[A-Z]", span) and re.search("[a-z]", span) else "one_case"]
        if len(_WORD.findall(span.replace("-", " "))) > 2 or "/" in span:
            out.append("pieces")
        out += ["token"] * span.startswith("eyJ") + ["block"] * span.startswith("-----BEGIN") + ["assigned"] * bool(assigned) + ["short"] * (len(span) < 16) + ["no_digit"] * (not digits)
        if assigned:
            out.append(f"signs{len({'a' if c.islower() else 'A' if c.isupper() else '0' if c.isdigit() else '!' for c in span})}")
    elif kind == "phone":
        groups = _GROUP.findall(span)
        out += ["date"] * bool(_DATE.fullmatch(span)) + ["trunk"] * span.startswith(("0", "(")) + ["trunk_inside"] * any(len(g) > 2 and g[0] == "0" for g in groups[1:]) + ["trunk_after"] * bool(_TRUNK_NEXT.match(after)) + [f"groups{len(groups)}", f"last{min(len(groups[-1]), 6)}", f"seps{len(set(_NOT_DIGIT.findall(span)))}"]
    elif kind == "ssn":
        out += ["spaces"] * (" " in span)
    elif kind == "email":
        out += ["at"] * ("@" in span) + ["spelled"] * ("@" not in span) + ["in_words"] * (" at " in span) + ["dots"] * (span.count(" dot ") > 1) + ["more_labels"] * bool(re.match(r"\.\w", after))
    elif kind == "ip":
        out += ["double"] * ("::" in span) + [f"colons{min(span.count(':'), 7)}"] + ["hex_letters"] * bool(re.search("[A-Fa-f]", span))
    return [f"{kind}|{x}" for x in out]


_TRUNK_NEXT = re.compile(r"[ ./-]{1,2}0[0-9]{2}")
_CUT_LEFT, _CUT_RIGHT = re.compile(r"[0-9][ ./()-]{1,2}$"), re.compile(r"[ ./()-]{1,2}[0-9]")


def numbers(text: str) -> Iterator[Span]:
    """Runs of neighbouring digit groups that may be a phone number, a card or a social security number, from each group on."""
    groups = [m.span() for m in _GROUP.finditer(text)]
    for k, (start, _) in enumerate(groups):
        if start and (text[start - 1].isalnum() or text[start - 1] in "_+"):
            continue
        sizes: list[int] = []
        for n in range(k, min(len(groups), k + MAX_GROUPS)):
            if n > k and not _BETWEEN.fullmatch(text, groups[n - 1][1], groups[n][0]):
                break
            end = groups[n][1]
            sizes.append(end - groups[n][0])
            digits = sum(sizes)
            if digits > 19:
                break
            if text[end : end + 1].isalnum() or text[end : end + 1] == "_":
                continue
            seps = {text[groups[i - 1][1] : groups[i][0]] for i in range(k + 1, n + 1)}
            if digits >= 12 and (len(sizes) == 1 or (len(seps) == 1 and sizes[:-1] == [4] * (len(sizes) - 1))):
                yield start, end, "card"
            if 8 <= digits <= 15 and len(sizes) > 1 and max(sizes) <= 6:
                yield start - (start > 0 and text[start - 1] == "("), end, "phone"
            if sizes == [3, 2, 4] and seps in ({"-"}, {" "}):
                yield start, end, "ssn"


def lattice(text: str) -> list[Span]:
    """Candidate segments, by end: each proposal with its possible starts and ends."""
    found: set[Span] = set(numbers(text))
    found |= {(m.start(), m.end(), "secret") for m in _PREFIXED.finditer(text) if m.end() - m.start() >= 16}
    for m in _ASSIGNED.finditer(text):
        value = m[1].rstrip(".,;:)]}")
        if len(value) >= 6:
            found.add((m.start(1), m.start(1) + len(value), "secret"))
    for kind, need, pattern in PROPOSE:
        if need in text:
            for m in pattern.finditer(text):
                start, end = m.span()
                if kind == "secret" and m[0][0] != "-" and "." not in m[0]:
                    if not (any(c.isdigit() for c in m[0]) or any(c.islower() for c in m[0]) and any(c.isupper() for c in m[0])):
                        continue
                    found |= {(start, end, kind), (start, start + len(m[0].rstrip("=/+-_")), kind)}
                elif kind == "iban":
                    ends = [start + x.end() for x in re.finditer("[A-Z0-9]+", m[0])]
                    found |= {(start, e, kind) for e in ends if 15 <= len(text[start:e].replace(" ", "")) <= 34}
                elif kind == "email":
                    labels = [start + x.start() for x in re.finditer(r"\.(?=\w)", m[0]) if x.start() > m[0].rfind("@")][1:] if "@" in m[0] else []
                    found |= {(start, e, kind) for e in (*labels, end) if e - start <= MAX_SPAN}
                else:
                    found.add((start, end, kind))
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


class Chain(NamedTuple):
    """For each segment the segments that may come before it: the first back[i] end more than NEAR before it, and those up to upto[i] end nearer."""

    back: list[int]
    upto: list[int]


def chain(segments: list[Span]) -> Chain:
    ends = [s[1] for s in segments]
    return Chain([bisect_left(ends, s[0] - NEAR) for s in segments], [bisect_left(ends, s[0] + 1) for s in segments])


def follows(a: Span, b: Span) -> str:
    """The name of the feature of two neighbouring segments."""
    return f"{a[2]}>{b[2]}"


def best(segments: list[Span], scores: list[float], weights: dict[str, float] | None = None) -> list[Span]:
    """The highest-scoring set of segments that don't overlap; at equal scores, fewer of them."""
    weights, links = weights or {}, chain(segments)
    top = [(0.0, -1)]  # best of the first i segments as the last one, and which; -1: none
    own: list[float] = []
    before: list[int] = []
    for i, s in enumerate(segments):
        choice = top[links.back[i]]
        if choice[1] < 0:
            choice = (0.0, -1)
        for j in range(links.back[i], links.upto[i]):
            x = own[j] + weights.get(follows(segments[j], s), 0.0)
            if x > choice[0]:
                choice = (x, j)
        own.append(choice[0] + scores[i])
        before.append(choice[1])
        top.append(max(top[-1], (own[i], i), key=lambda x: x[0]))
    out, i = [], top[-1][1]
    while i >= 0:
        out.append(segments[i])
        i = before[i]
    return out[::-1]


def marginals(segments: list[Span], scores: list[float], weights: dict[str, float] | None = None) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Probability of each segment under the field, and of each pair of near neighbours, by forward and backward sums over the lattice."""
    n, weights, links = len(segments), weights or {}, chain(segments)
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
    pair = {(j, i): weights.get(follows(segments[j], s), 0.0) for i, s in enumerate(segments) for j in range(links.back[i], links.upto[i])}
    ahead: list[float] = []  # log-sum over all that ends with segment i
    total = [0.0]  # over all that ends with one of the first i, or nothing
    for i in range(n):
        x = total[links.back[i]]
        for j in range(links.back[i], links.upto[i]):
            x = add(x, ahead[j] + pair[j, i])
        ahead.append(x + scores[i])
        total.append(add(total[-1], ahead[i]))
    nexts: list[list[int]] = [[] for _ in range(n)]
    for j, i in pair:
        nexts[j].append(i)
    behind = [0.0] * n  # log-sum over what follows segment i, or nothing
    far = [-math.inf] * (n + 1)  # over what begins with a segment to which exactly the first k are far
    rest = 0.0  # over nothing, and what begins with a segment to which i is far
    for i in range(n - 1, -1, -1):
        rest = add(rest, far[i + 1])
        x = rest
        for k in nexts[i]:
            x = add(x, pair[i, k] + scores[k] + behind[k])
        behind[i] = x
        far[links.back[i]] = add(far[links.back[i]], scores[i] + behind[i])
    z = total[-1]
    return [math.exp(ahead[i] + behind[i] - z) for i in range(n)], {(j, i): math.exp(ahead[j] + w + scores[i] + behind[i] - z) for (j, i), w in pair.items()}


def sentences(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Training sentences with their spans: templates, cue words, and lookalikes that are no personal data."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(("an", "ti", "re", "on", "ver", "el", "que", "sch", "mo", "la")) for _ in range(rng.randint(1, 4)))
    mixed = lambda k: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(k))
    letters = lambda k: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def card() -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(("", " ", "-", "."))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def no_card() -> str:
        d = digits(15)
        d += rng.choice([c for c in "0123456789" if not luhn(d + c)])
        sep = rng.choice(("", "", " ", "-"))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def iban() -> str:
        body, country = digits(18), rng.choice(("DE", "FR", "ES", "GB"))
        n = int(body + "".join(str(int(c, 36)) for c in country) + "00")
        s = f"{country}{98 - n % 97:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    make = {
        "email": lambda: rng.choice((f"{word()}.{word()}@{word()}.com", f"{word()} (at) {word()}.org", f"{word()}[at]{word()}[dot]net", f"{word()}@{word()}é.fr", f"{word()} at {word()} dot com", f"{word()}.{word()} at {word()} dot {word()} dot org")),
        "ip": lambda: rng.choice((f"{hexes(4)}:{hexes(4)}::{hexes(2)}", ":".join(hexes(4) for _ in range(8)), f"fe80::{hexes(4)}", f"fe80::{hexes(1)}", f"{hexes(4)}:{hexes(3)}::1")),
        "card": card,
        "phone": lambda: rng.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(2)} {digits(4)} {digits(3)}", f"0{digits(3)} {digits(rng.randint(3, 4))} {digits(rng.randint(3, 4))}", f"0{digits(3)} {digits(rng.randint(5, 6))}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"00{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"0{digits(3)}/{digits(6)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}")),
        "iban": iban,
        "secret": lambda: rng.choice((hexes(40), hexes(32), mixed(24), mixed(40), f"{rng.choice(PREFIXES)}{mixed(rng.randint(16, 40))}", f"{rng.choice(PREFIXES)}{mixed(rng.randint(16, 40))}", f"{rng.choice(PREFIXES)}{mixed(rng.randint(16, 20)).upper()}", f"{rng.choice(PREFIXES)}{hexes(32)}", mixed(rng.randint(130, 400)), f"eyJ{mixed(20)}.eyJ{mixed(60)}.{mixed(43)}", f"eyJ{mixed(30)}.{mixed(50)}", letters(rng.randint(24, 130)),
            f"-----BEGIN {rng.choice(('', 'RSA ', 'EC '))}PRIVATE KEY-----\n{mixed(64)}\n{mixed(64)}\n-----END PRIVATE KEY-----")),
        "password": lambda: "".join(rng.choice((word(), word(), word().capitalize(), digits(2), digits(4), rng.choice("!#$%&*?-_"))) for _ in range(rng.randint(3, 5)))[:15] + rng.choice("0123456789!#$"),
        "ssn": lambda: rng.choice("- ").join((digits(3), digits(2), digits(4))),
    }
    decoys = (
        lambda: f"commit {hexes(40)}", lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}.{digits(3)}", lambda: f"20{digits(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}",
        lambda: f"1{rng.randint(0, 9)}.0{rng.randint(1, 9)}.20{digits(2)}", lambda: f"isbn 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{word()}-{word()}-{word()}-{word()}{digits(1)}",
        lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: "/".join([word(), word(), word(), word() + digits(2)]), lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(3)}", lambda: digits(rng.randint(5, 11)), no_card, no_card,
        lambda: f"{digits(2)} {digits(2)} {digits(2)}", lambda: f"sha {hexes(32)}", lambda: f"{word()} at {word()} dot", lambda: f"{word()} at {word()} {word()}", lambda: f"password is {word()}", lambda: f"token: {word()}{word()}{word()}",
        lambda: f"secret {word()}{word()}{word()}", lambda: f"the password: {word()} {word()}", lambda: f"{word().capitalize()}{word().capitalize()}{word().capitalize()}{word().capitalize()}{word().capitalize()}", lambda: f"{digits(3)} {digits(2)} {digits(4)} {word()}",
        lambda: f"{word()}_{word()}_{word()}_{word()}_{word()}", lambda: f"id {hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}",
    )
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(2, 6))) + " "
            if rng.random() < 0.6:
                kind = rng.choice(KINDS)
                value = make[kind]()
                known = kind == "secret" and (value.startswith(("eyJ", "-----", *PREFIXES)))
                if kind == "secret" and rng.random() < 0.25:
                    value = make["password"]()
                    text += rng.choice(("password", "passwd", "Passwort", "pwd", "mot de passe", "contraseña", "secret")) + rng.choice((": ", "=", " = ", ' = "', " is ", " est ", " es "))
                elif rng.random() < (0.4 if known else 0.75) or kind == "phone" or (kind == "secret" and not known) or (kind == "ssn" and " " in value):
                    text += rng.choice(CUES[kind].split()) + rng.choice((" ", ": ", ' = "' if kind == "secret" else " "))
                spans.append((len(text), len(text) + len(value), kind))
                text += value + rng.choice((" ", ". ", ", ")) if not text.endswith('"') else value + '" '
                if kind in ("phone", "card", "email") and rng.random() < 0.4:  # another of the kind, or a plain number, right after it
                    text = text.rstrip() + " "
                    if rng.random() < 0.6:
                        value = make[kind]()
                        spans.append((len(text), len(text) + len(value), kind))
                        text += value + " "
                    else:
                        text += f"{digits(rng.randint(1, 3))} "
            else:
                text += rng.choice(decoys)() + " "
        out.append((text, spans))
    return out


@lru_cache(4)
def trained(n: int = TRAIN_SENTENCES, seed: int = SEED) -> dict[str, float]:
    """Weights of the field."""
    rng, weights = random.Random(seed), {}
    data = []
    for text, spans in sentences(n, seed):
        if segments := lattice(text):
            gold = sorted(s for s in spans if s in set(segments))  # what no proposal holds teaches nothing; ``recall`` counts it
            data.append((segments, [features(text, *s) for s in segments], gold))
    for epoch in range(EPOCHS):
        rng.shuffle(data)
        rate = RATE / (1 + epoch)
        for segments, names, gold in data:
            scores = [sum(weights.get(f, 0.0) for f in fs) for fs in names]
            single, double = marginals(segments, scores, weights)
            step: dict[str, float] = {}
            for p, s, fs in zip(single, segments, names, strict=True):
                for f in fs:
                    step[f] = step.get(f, 0.0) + (s in gold) - p
            for (j, i), p in double.items():
                f = follows(segments[j], segments[i])
                step[f] = step.get(f, 0.0) - p
            for a, b in pairwise(gold):
                if b[0] - a[1] <= NEAR:
                    step[follows(a, b)] = step.get(follows(a, b), 0.0) + 1
            for f, g in step.items():
                w = weights.get(f, 0.0)
                weights[f] = w + rate * g - rate * DECAY * w
    return weights


def recall(weights: dict[str, float], n: int, seed: int) -> dict[str, tuple[int, int, int]]:
    """By kind, of fresh sentences: spans there are, spans found whole with their kind, spans reported."""
    out = {k: [0, 0, 0] for k in KINDS}
    for text, spans in sentences(n, seed):
        _, got = find(text, weights)
        for _, _, k in spans:
            out[k][0] += 1
        for s in got:
            out[s[2]][2] += 1
            out[s[2]][1] += s in spans
    return {k: tuple(v) for k, v in out.items()}


def find(text: str, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of one whole text."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    segments = lattice(text)
    if base and segments:
        merged: list[list[int]] = []
        for s, e, _ in base:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        starts = [m[0] for m in merged]
        free = lambda s: not ((i := bisect_left(starts, s[1])) and merged[i - 1][1] > s[0])
        segments = [s for s in segments if free(s)]
    added = best(segments, [sum(weights.get(f, 0.0) for f in features(text, *s)) for s in segments], weights)
    return base, sorted(base + added, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


COLUMNS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def scan(text: bytes | None, weights: dict[str, float]) -> tuple:
    base, spans = find(text.decode("utf-8", "replace") if text else "", weights)
    n = Counter(k for _, _, k in base)
    return n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans)


def find_pii(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """A row per document: base counts, hash of the base spans, all spans as kind:start:end in code points, and their number."""
    weights = trained() if weights is None else weights

    def make():
        return lambda text: scan(text, weights)

    return per_text(docs, make, COLUMNS)


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stays."""
    out, at = [], 0
    for s, e, k in sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
            at = -e
    return "".join(out) + text[at:]


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: personal data of all documents."""
    return find_pii(table(configured(spark), sf_dir, "documents"))
