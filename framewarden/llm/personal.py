"""Personal data in texts: plain identifiers, and disguised ones found in a normalised text and mapped back to the source.

Plain identifiers are found in the text as it is (`plain_spans`). Then transducers rewrite the text: look-alike characters
become ASCII, invisible ones go, digits written as words become digits, and written-out or bracketed signs for "at", "dot",
"plus" and "dash" become the signs. The output keeps, segment by segment, where in the source it came from, so what is found in
it is reported at its place in the source. Words that are also prose ("at", "dot", a point between spaces) become marks of their
own; an address that needs one must end in a known top-level domain.

Every pattern is read from a sign ('@', '+') or from the start of a run of digits, so the time is linear in the text, whatever it
holds.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import text_batches
from .words import give_back, text_slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

#: Marks for an "at", a "dot" and a sign between spaces, which may be prose. Texts can't hold them: the transducer rewrites them first.
WORD_AT, SOFT_DOT, WIDE_AT = "\ue000", "\ue001", "\ue002"
DIGITS = re.compile("[0-9]+")
IP = re.compile(rf"(?<![0-9])([0-9]++)[.{SOFT_DOT}]([0-9]++)[.{SOFT_DOT}]([0-9]++)[.{SOFT_DOT}]([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(rf"[A-Za-z0-9-]++(?:[.{SOFT_DOT}][A-Za-z0-9-]++)+")
POINT = re.compile(f"[.{SOFT_DOT}]")
SIGN = re.compile(f"[@{WORD_AT}{WIDE_AT}]")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-" + SOFT_DOT)

#: Endings of addresses that are taken when the address was written with words or spaces.
ENDINGS = frozenset(
    "com org net edu gov mil int info biz name pro io ai dev app cloud online site shop mail email xyz tech example test invalid local"
    " uk de fr es it eu us ca au nz ch nl be lu pl cz se dk fi pt br mx ar cl ru ua jp cn kr tw hk sg ie gr tr za".split()
) - {"it", "be"}

#: Digits as words in English, German, French and Spanish.
NUMERALS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "fuenf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}

#: Letters of other scripts that look like ASCII ones, and signs that look like ASCII signs.
LOOKALIKES = (
    dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсухѕһԁԛԝ", "ABESIJKMHOPCTYXaeijopcyxshdqw", strict=True))
    | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαρυ", "ABEZHIKMNOPTYXoviapu", strict=True))
    | dict(zip("ɑɡı\u217cǀ", "agill", strict=True))
    | dict(zip("‐‑‒–—―−﹘⁃", "---------", strict=True))
    | dict(zip("․‧·•∙。｡", ".......", strict=True))
    | {"\xa0": " ", "З": "3"}
    | dict.fromkeys((WORD_AT, SOFT_DOT, WIDE_AT), "\ufffd")
)


class _Glyphs(dict):
    """Code point -> one character, found when first met: of the list, a digit of any script, or what compatibility forms are."""

    def __missing__(self, code: int) -> str:
        own = chr(code)
        plain = LOOKALIKES.get(own)
        if plain is None:
            digit = unicodedata.digit(own, None)
            form = unicodedata.normalize("NFKC", own)
            plain = str(digit) if digit is not None else form if len(form) == 1 and form.isascii() else own
        self[code] = plain
        return plain


GLYPHS = _Glyphs()
ODD = re.compile("[\xa0\xad\xb2\xb3\xb7\xb9ıǀɐ-\U0010ffff]")

#: The other words that stand for signs.
WORDS = (
    dict.fromkeys(("at", "arroba", "chez", "ät"), WORD_AT)
    | dict.fromkeys(("dot", "point", "punkt", "punto"), SOFT_DOT)
    | dict.fromkeys(("dash", "hyphen", "minus", "bindestrich", "tiret", "guion"), "-")
    | {"underscore": "_", "plus": "+"}
)
INVISIBLE = re.compile("[\xad\u180e\u200b-\u200f\u2060-\u2064\ufeff]+")
ENTITY = re.compile("&(?:#64|#x40|commat|#46|#x2e|period);|%40", re.IGNORECASE)
BRACKET = re.compile(r"[\[({<][ \t]{0,2}(?:(@|at|ät|arroba|chez)|\.|dot|point|punkt|punto)[ \t]{0,2}[\])}>]", re.IGNORECASE)
WIDE = re.compile(r"[ \t]{1,3}([@.])[ \t]{1,3}|[ \t]{1,3}@|@[ \t]{1,3}")
MIXED = re.compile("(?<![A-Za-z0-9])(?:[0-9]++[OoIl]|[OoIl]++[0-9])[0-9OoIl]*+(?![A-Za-z0-9])")
ZERO_ONE = str.maketrans("OoIl", "0011")
WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Bytes of a text as lower-case words, to see whether there is a word to rewrite at all: "at" alone changes nothing.
LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
TELLING = frozenset(w.encode() for w in {**NUMERALS, **WORDS} if WORDS.get(w) != WORD_AT)
Rewrite = tuple[int, int, str]


def _gaps(text: str, a: int, b: int) -> Span:
    """The span with up to three blanks on each side."""
    start, end = a, b
    while start > 0 and a - start < 3 and text[start - 1] in " \t":
        start -= 1
    while end < len(text) and end - b < 3 and text[end] in " \t":
        end += 1
    return start, end


def _between(text: str, a: int, b: int) -> bool:
    return a > 0 and b < len(text) and text[a - 1] in ALNUM and text[b] in ALNUM


def _word_rewrites(text: str) -> Iterator[Rewrite]:
    """Words that stand for signs, between letters or digits, and digits as words, two at least or beside a plus or a dot."""
    run: list[tuple[int, int, str]] = []  # numerals with one or two blanks or hyphens between
    dots: set[int] = set()  # places beside a dot

    def numerals() -> Iterator[Rewrite]:
        if len(run) > 1 or run and (text[run[0][0] - 1 : run[0][0]] == "+" or run[0][0] in dots or _dot_after(text, run[0][1])):
            for i, (a, b, digit) in enumerate(run):
                yield (run[i - 1][1] if i else a), b, digit

    plus = -1
    for m in WORD.finditer(text):
        word, (a, b) = m[0].lower(), m.span()
        if word in NUMERALS and (m.end() == len(text) or text[b] not in "0123456789"):
            if run and not (a - run[-1][1] <= 2 and not text[run[-1][1] : a].strip(" \t-")):
                yield from numerals()
                run = []
            run.append((a, b, str(NUMERALS[word])))
            if len(run) == 1 and plus == a:
                dots.add(a)
            continue
        sign = WORDS.get(word)
        if not sign:
            continue
        start, end = _gaps(text, a, b)
        if sign == "+":
            if start < a or a == 0 or text[a - 1] in "([\n":
                yield a, end, "+"
                plus = end
        elif start < a and b < end and _between(text, start, end):
            yield start, end, sign
            if sign == SOFT_DOT:
                dots.add(end)
        elif sign in (WORD_AT, SOFT_DOT) and text[a - 1 : a] in ("_", "*", "-") and text[b : b + 1] == text[a - 1] and _between(text, a - 1, b + 1):
            yield a - 1, b + 1, sign
            if sign == SOFT_DOT:
                dots.add(b + 1)
    yield from numerals()


def _dot_after(text: str, b: int) -> bool:
    m = WORD.match(text, _gaps(text, b, b)[1])
    return bool(m) and WORDS.get(m[0].lower()) == SOFT_DOT


def _rewrites(text: str) -> list[Rewrite]:
    out: list[Rewrite] = []
    if not text.isascii():
        out += ((*m.span(), "") for m in INVISIBLE.finditer(text))
    if "&" in text or "%40" in text:
        out += ((*m.span(), "." if m[0].lower() in ("&#46;", "&#x2e;", "&period;") else "@") for m in ENTITY.finditer(text))
    for m in BRACKET.finditer(text):
        out.append((*_gaps(text, *m.span()), "@" if m[1] else "."))
    if " @" in text or "@ " in text or " . " in text:
        out += ((*m.span(), SOFT_DOT if m[1] == "." else WIDE_AT) for m in WIDE.finditer(text) if _between(text, *m.span()))
    if not TELLING.isdisjoint(text.encode("utf-8", "surrogatepass").translate(LETTERS).split()):
        out += _word_rewrites(text)
    for m in MIXED.finditer(text):
        if 2 * len("".join(DIGITS.findall(m[0]))) >= len(m[0]):
            out.append((*m.span(), m[0].translate(ZERO_ONE)))
    return sorted(out)


class Normalised:
    """A rewritten text and its segments: rewritten place -> source place; a segment is a copy or stands for all its source."""

    def __init__(self, text: str) -> None:
        plain = text.translate(GLYPHS) if not text.isascii() and ODD.search(text) else text
        rewrites = _rewrites(plain)
        self.text, self.changed = plain, bool(rewrites) or plain != text
        if not self.changed:
            return
        out: list[str] = []
        self.at, self.start, self.end = [], [], []  # rewritten start, source start and end; a copy has an end of -1
        size = done = 0
        for a, b, sign in [*rewrites, (len(plain), len(plain), "")]:
            if a < done:  # an earlier rewrite holds it
                continue
            for piece, start, end in ((plain[done:a], done, -1), (sign, a, b)):
                if piece:
                    out.append(piece)
                    self.at.append(size)
                    self.start.append(start)
                    self.end.append(-1 if len(piece) == end - start else end)
                    size += len(piece)
            done = b
        self.text = "".join(out)

    def back(self, a: int, b: int) -> Span:
        """The source span of a span of the rewritten text."""
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        start = self.start[i] if self.end[i] >= 0 else self.start[i] + a - self.at[i]
        end = self.end[j] if self.end[j] >= 0 else self.start[j] + b - self.at[j]
        return start, end


def _address_end(text: str, a: int, sign: int) -> int:
    """End of the address whose local part starts at a; 0 if there is none. Signs that may be prose ask for a known ending, the
    word "at" for a written-out dot as well ("look at example.com")."""
    m = DOMAIN.match(text, sign + 1)
    if not m:
        return 0
    soft, dotted = text[sign] != "@", SOFT_DOT in text[a:sign]
    if not soft and not dotted and SOFT_DOT not in m[0]:
        return m.end()
    best, start = 0, m.start()
    ends = [p.start() for p in POINT.finditer(text, start, m.end())]
    for point, end in zip(ends, [*ends[1:], m.end()], strict=True):
        dotted = dotted or text[point] == SOFT_DOT
        if text[point + 1 : end].lower() in ENDINGS if soft or dotted else True:
            best = end if dotted or text[sign] != WORD_AT else 0
    return best


def emails(text: str) -> Iterator[Span]:
    done = 0
    for m in SIGN.finditer(text):
        sign = a = m.start()
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < sign and (end := _address_end(text, a, sign)):
            yield a, end
            done = end


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def identifiers(text: str) -> Iterator[tuple[int, int, int]]:
    """(number of the kind, start, end), leftmost and not overlapping by kind; a match that fails its test is dropped."""
    for a, b in emails(text):
        yield 0, a, b
    if not DIGITS.search(text):
        return
    for m in IP.finditer(text):
        if all(len(g := part.lstrip("0")) <= 3 and int(g or 0) <= 255 for part in m.groups()):
            yield 1, *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield 2, *m.span()
    for m in PHONE.finditer(text):
        if 9 <= sum(map(len, DIGITS.findall(m[0]))) <= 15:
            yield 3, *m.span()


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    if not text.isascii():
        for mark in (WORD_AT, SOFT_DOT, WIDE_AT):
            text = text.replace(mark, "\ufffd")
    return sorted(identifiers(text))


CLEAR = str.maketrans({WORD_AT: "@", WIDE_AT: "@", SOFT_DOT: "."})


def added_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """Identifiers of the rewritten text that lie in no plain one of their kind, at their place in the source, in clear."""
    new = Normalised(text)
    if not new.changed:
        return []
    out = []
    for kind, a, b in identifiers(new.text):
        start, end = new.back(a, b)
        clear = new.text[a:b].translate(CLEAR)
        if text[start:end] != clear and not any(k == kind and s <= start and end <= e for k, s, e in plain):
            out.append((kind, start, end, clear))
    return out


SPANS = "array<struct<kind:string,start:long,end:long,added:boolean,value:string>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (kind, start, end in code points, added, value), by kind, start and end.

    Plain spans have added = false; those of disguised identifiers are added, with the identifier in clear as their value. An
    added span can hold a plain one of its kind (look-alikes in the middle of an address) but none lies inside one. Null and empty
    texts have no spans. Rows that repeat are searched each; a null doc_id is carried through; other columns are not read.
    """
    text_batches(docs.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_()), ("value", pa.string())])

    def spans(text: str) -> list[tuple]:
        plain = plain_spans(text)
        found = [(k, a, b, False, text[a:b]) for k, a, b in plain]
        found += [(k, a, b, True, clear) for k, a, b, clear in added_spans(text, plain)]
        return [(KINDS[k], *rest) for k, *rest in sorted(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                yield pa.record_batch([part.column("doc_id"), pa.array([spans(t) for t in texts], pa.list_(kind))], ["doc_id", "spans"])
        give_back()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"doc_id long, spans {SPANS}")


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each kind, base_sha256 of the plain spans, spans as text (kind:start:end)."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    plain = F.filter("spans", lambda s: ~s["added"])
    return found.select("doc_id", *map(number, KINDS), F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(plain)).cast("long").alias("n_added"))
