"""Personal data behind disguises, reported at the source's own offsets.

Plain identifiers are found by pattern.  Then two transducers rewrite the text: in the first
look-alike letters and foreign digits become ASCII and invisible characters go, in the second
spelled digits become digits, and ``[at]``, ``at`` and ``dot`` disguises become ``@`` and ``.``.
Each keeps, for every rewritten piece, the source range it came from.  The same patterns run over the rewritten text, and what they find beyond the
plain matches is mapped back to source characters.  Texts without any trigger skip the rewriting.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import with_columns
from tessera.llm.spans import Span, counts, sha256, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The guard in front of the digits only spares the quadratic retries inside one long run of digits.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """The check digit of payment card numbers."""
    turned = [int(d) for d in reversed(digits)]
    return (sum(turned[::2]) + sum(sum(divmod(2 * d, 10)) for d in turned[1::2])) % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ so that runs without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def plain(text: str) -> list[Span]:
    """Identifiers in the text as it stands."""
    out = _emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NOT_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


# Letters of other scripts that look like the ASCII letter below them.
ALIKE = str.maketrans(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁɡһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινυαρ",
    "ABESIJKMHOPCTYXaesijopcyxdghqwABEZHIKMNOPTYXoivuap",
)
# Spelled digits of the four languages.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# How the four languages say @ and the dot of an address.
AT_WORDS, DOT_WORDS = "at|ät|klammeraffe|arobase|arobas|arroba", "dot|punkt|point|punto"
# Generic endings of addresses; two letters that are words too, so that they end an address
# only where no word follows or the address has more dots; what stands before "at" in prose.
GENERIC = frozenset("com org net edu gov mil int info biz name pro io dev app ai co xyz online site shop store cloud tech club me tv de fr es it nl ch at eu uk us".split())
WORDLIKE = frozenset("ad ag al am an as au be by do du en et go he if in is la le li lo ma mi my na ne ni no of on or pa sa se si so su ta te to tu un up va we".split())
PROSE = frozenset("a about all am and are available be book buy call check closed due early find found get go good hello help her here hers him his hosted i in info information is it later located look looked looking looks meet me more now off on online only open or order out page read see seen shop shown site start starts store that the them there this time us visit was website were where".split())

WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
UNITS = f"(?:{WORD}|[0-9]+)"
ODD = re.compile("[\u00ad\u0250-\U0010ffff]")
# Letters that match ASCII ones where case is ignored, though lower() leaves them.
FOLDED = re.compile("[\u0130\u0131\u017f]")
BRACKETED = r"\s?[\[({{<]\s?(?:{})\s?[\])}}>]\s?"
# Found, in lower case, in each text without ODD or FOLDED characters that the transducer would change.
CLUE = re.compile(rf"[\[({{<]\s?(?:{AT_WORDS}|{DOT_WORDS}|@|\.)\s?[\])}}>]| (?:{DOT_WORDS}) | (?:{AT_WORDS}) [a-z0-9-]+\.|\b(?:{WORD})[ -]{UNITS}\b|[0-9][ -](?:{WORD})\b|\bplus ?{UNITS}\b")
GONE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")
AT = re.compile(rf"(?P<bracket>{BRACKETED.format(AT_WORDS + '|@')})|(?P<word>\ (?:{AT_WORDS})(?=\ ))|@", re.IGNORECASE)
DOT = re.compile(rf"(?P<bracket>{BRACKETED.format(DOT_WORDS + r'|\.')})|(?P<word>\ (?:{DOT_WORDS})(?=\ ))|\.", re.IGNORECASE)
LABEL = re.compile(r"[A-Za-z0-9-]+")
OF_LOCAL = LOCAL - {"."}
SPELLING = re.compile(rf"(?:\bplus\ ?)?\b{UNITS}(?:(?:[\ -]|\ (?:{DOT_WORDS})\ ){UNITS}\b)+", re.IGNORECASE)
UNIT = re.compile(rf"plus\ ?|\ (?:{DOT_WORDS})\ |[\ -]|{UNITS}", re.IGNORECASE)
DOTS, AND_MORE = frozenset(DOT_WORDS.split("|")), re.compile(r"\ [^\W\d_]")


def alike(text: str) -> str:
    """Look-alikes, width variants and decimal digits as ASCII, character for character."""
    text = text.translate(ALIKE)

    def one(m: re.Match) -> str:
        c = m[0]
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            return str(digit)
        plain = unicodedata.normalize("NFKC", c)
        return plain if len(plain) == 1 and plain.isascii() else c

    return ODD.sub(one, text)


#: A replaced range: start, end, what stands there instead.
Edit = tuple[int, int, str]


def _separators(pattern: re.Pattern, text: str) -> list[tuple[int, int, bool]]:
    """Start, end and whether it is plain, of each; a word's spaces belong to it."""
    return [(m.start(), m.end() + (m.lastgroup == "word"), m.lastgroup is None) for m in pattern.finditer(text)]


def _addresses(text: str) -> list[tuple[int, int, list[Edit]]]:
    """Disguised addresses and their separators, walked from each @ in either direction.

    Any number of labels of any length; a walk that finds no ending is not begun again inside itself.
    """
    ats = _separators(AT, text)
    if not ats:
        return []
    dots = _separators(DOT, text)
    by_start, by_end = {d[0]: d for d in dots}, {d[1]: d for d in dots}
    out, done, barren = [], 0, 0
    for start, end, plain_at in ats:
        if start < max(done, barren):
            continue
        used, first, at = [], start, start
        while True:
            while at > done and text[at - 1] in OF_LOCAL:
                at -= 1
            if at == first:
                break
            first = at
            dot = by_end.get(at)
            if dot is None or dot[0] <= done or text[dot[0] - 1] not in OF_LOCAL:
                break
            used.append(dot)
            at = dot[0]
        if first == start:
            continue
        between, stop, m = [], end, LABEL.match(text, end)
        while m:
            stop = m.end()
            dot = by_start.get(stop)
            m = LABEL.match(text, dot[1]) if dot else None
            if m:
                between.append(dot)
        barren = stop
        # Back from the last label to one that can end an address.
        words = text[start:end].strip(" ").isalpha()
        while between:
            ending = text[between[-1][1] : stop].lower()
            disguise = any(not d[2] for d in [*used, *between]) or not plain_at
            bare = words and all(d[2] for d in between)
            more = len(between) + len(used) > 1 or not AND_MORE.match(text, stop)
            fits = between[-1][2] and not words or ending in GENERIC or len(ending) == 2 and ending.isalpha() and not bare and (more or ending not in WORDLIKE)
            if fits and disguise and not (bare and not used and text[first:start].lower() in PROSE):
                edits = [*((a, b, ".") for a, b, p in [*used, *between] if not p), *([] if plain_at else [(start, end, "@")])]
                out.append((first, stop, sorted(edits)))
                done = barren = stop
                break
            stop = between.pop()[0]
    return out


def _edits(text: str) -> list[Edit]:
    """What the transducer replaces, in order, none overlapping another."""
    found = _addresses(text)
    held = [(a, b) for a, b, _ in found]
    edits = [e for _, _, own in found for e in own]
    taken = {e[0] for e in edits}

    def free(start: int, end: int) -> bool:
        i = bisect_right(held, (start, len(text) + 1)) - 1
        return (i < 0 or held[i][1] <= start) and (i + 1 >= len(held) or held[i + 1][0] >= end)

    for pattern, new in ((AT, "@"), (DOT, ".")):
        edits += [(m.start(), m.end(), new) for m in pattern.finditer(text) if m.lastgroup == "bracket" and m.start() not in taken]
    for m in SPELLING.finditer(text):
        if any(c.isalpha() for c in m[0]) and free(m.start(), m.end()):
            for x in UNIT.finditer(text, m.start(), m.end()):
                word = x[0].strip(" ").lower()
                edits.append((x.start(), x.end(), "." if word in DOTS else "+" if word == "plus" else "" if word in ("", "-") else SPELLED.get(word, word)))
    out, done = [], 0
    for e in sorted(edits):
        if e[0] >= done:
            out.append(e)
            done = e[1]
    return out


def rewrite(text: str, edits: list[Edit]) -> tuple[str, list[tuple[int, int, int]]]:
    """The edited text and its pieces (start there, source start, source end), in order.

    A piece whose two lengths agree maps character for character, any other as a whole.
    """
    out: list[str] = []
    pieces: list[tuple[int, int, int]] = []
    size = done = 0
    for start, end, new in [*edits, (len(text), len(text), "")]:
        if start > done:
            pieces.append((size, done, start))
            out.append(text[done:start])
            size += start - done
        if new:
            pieces.append((size, start, end))
            out.append(new)
            size += len(new)
        done = end
    return "".join(out), pieces


def _origin(pieces: list[tuple[int, int, int]], starts: list[int], size: int, at: int, last: bool) -> int:
    """The source place of a character's start, or with ``last`` of its end."""
    i = bisect_right(starts, at) - 1
    to, a, b = pieces[i]
    end = starts[i + 1] if i + 1 < len(starts) else size
    return (a + at - to + last) if end - to == b - a else (b if last else a)


def disguised(text: str, found: list[Span]) -> list[Span]:
    """Identifiers that only the normalised text shows, at source offsets.

    One that reaches past a plain identifier of its kind stands beside it; one inside it is dropped.
    """
    odd = not text.isascii() and (ODD.search(text) or FOLDED.search(text)) is not None
    if not odd and not CLUE.search(text.lower()):
        return []
    source = alike(text) if odd else text
    steps = [rewrite(source, [(m.start(), m.end(), "") for m in GONE.finditer(source)])] if odd else [(source, [(0, 0, len(source))])]
    steps.append(rewrite(steps[0][0], _edits(steps[0][0])))
    maps = [(pieces, [p[0] for p in pieces], len(x)) for x, pieces in reversed(steps)]
    new = steps[-1][0]

    def origin(at: int, last: bool) -> int:
        for pieces, starts, size in maps:
            at = _origin(pieces, starts, size, at - 1 if last else at, last)
        return at

    taken: dict[int, list[tuple[int, int]]] = {}
    for a, k, b in found:
        taken.setdefault(k, []).append((a, b))
    out = []
    for a, k, b in plain(new):
        start, end = origin(a, False), origin(b, True)
        if new[a:b] != text[start:end] and not any(x <= start and end <= y for x, y in taken.get(k, ())):
            out.append((start, k, end))
    return out


def personal_data(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """Personal data in every whole text.

    Returns ``ids``; ``n_email``, ``n_ip``, ``n_card`` and ``n_phone``, the plain identifiers;
    ``base_sha256``, the digest of their written spans; ``spans``, these and the disguised ones
    written together; ``n_disguised``.  A null text counts as empty: zeros and an empty string.
    Rows, repeated ones too, stay one for one; columns beyond ``ids`` and ``text`` are not read,
    and ``ids`` must not be named like a result.
    """

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for x in part.column("text_of").to_pylist():
            base = plain(x or "")
            more = disguised(x, base) if x else []
            rows.append((*counts(base, 4), sha256(written(base, KINDS)), written(base + more, KINDS), len(more)))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_disguised", T.LongType())]
    return with_columns(docs.select(*ids, F.col(text).alias("text_of")), "text_of", compute, fields)
