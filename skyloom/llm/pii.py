"""Personal data in texts, also where it is disguised.

Base detectors find e-mail addresses, IPv4-like addresses, payment card numbers and telephone numbers in the text as it
stands. Where a text may hold disguises, transducers rewrite it, one after the other:

* characters: homoglyphs and styled letters become ASCII, decimal digits of any script become ASCII digits, and
  characters that do not show go;
* digits: the names of digits in four languages become digits, in runs of any length and next to written ones;
* signs: bracketed or spelled "at" and "dot" of these languages become signs. A spelled English "at" is one only before
  a spelled dot and a known top-level domain, or between a local part that no word looks like and a known domain.

Every output character carries the start and end of the source characters that it came from, through all transducers.
The same detectors then run on the rewritten text, and what they find is mapped back and added where it touches no base
span, or where it is an e-mail address that goes on beyond a base one. Where numbers are set apart by commas, both readings
are tried: the numbers joined, then each by itself.

Defined cases: a null or empty text has no spans; repeated rows each have their own result; an empty table gives an
empty result; further columns are ignored by ``pii_spans`` and kept by ``masked_documents``. Time is linear in the text:
no pattern can start inside a run that an earlier attempt has gone through.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Letters of other scripts that look like ASCII letters, one for one.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһкмт" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαρυχκ" "ıɡɑ",
        "ABESIJKMHOPCTYXaesijopcyxdqwhkmt" "ABEZHIKMNOPTYXoviapuxk" "iga",
        strict=True,
    )
)
# Signs that stand for @ and the full stop.
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "﹒": ".", "。": ".", "․": ".", "＋": "+", "﹢": "+", "－": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-"}
# Characters that do not show.
HIDDEN = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
# The names of the digits in English, German, French and Spanish.
DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def narrow(c: str) -> str:
    """The ASCII character that c stands for, or c."""
    if c in LOOKALIKES or c in SIGNS:
        return LOOKALIKES.get(c) or SIGNS[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    if "！" <= c <= "～" or "\U0001d400" <= c <= "\U0001d7ff":
        plain = unicodedata.normalize("NFKC", c)
        return plain if len(plain) == 1 and plain.isascii() else c
    return c


_DIGIT = "|".join(sorted(DIGITS, key=len, reverse=True))
ODD = re.compile(f"[{''.join(LOOKALIKES)}{''.join(SIGNS)}{HIDDEN}！-～\U0001d400-\U0001d7ff]|(?![0-9])\\d")
_UNIT = rf"(?:(?:{_DIGIT})(?!\w)|[0-9]++(?!\w))"
# Names of the full stop and of @ in English, German, French and Spanish; the latter without the English one, which is a common word.
_DOT = "dot|punkt|point|punto"
_AT = "arroba|arobase|arobas|klammeraffe|ät"
# Top-level domains that are no common words of these languages.
TOP = frozenset("com org net edu gov mil info biz io co uk de fr eu ch nl pl se dk fi cz jp cn kr ru br au nz ca us mx cl pe ve tv app dev xyz online site tech".split())
_BETWEEN = rf"(?:[ ]{{1,2}}(?:{_DOT})[ ]{{1,2}}|[ ,.()-]{{1,3}})"
#: Spelled and written digits next to each other, in runs of any length; whether they are personal data is up to the detectors.
SPELLED = re.compile(rf"(?<!\w)(?:plus[ ,.-]{{1,3}})?{_UNIT}(?:{_BETWEEN}{_UNIT})*+", re.I)
SPELLED_DIGIT = re.compile(rf"(?<!\w)(?:{_DIGIT})(?!\w)", re.I)
PART = re.compile(rf"(plus[ ,.-]{{1,3}})|({_DIGIT})(?!\w)|([0-9]++)|({_BETWEEN})", re.I)
BRACKET_AT = re.compile(rf"[ ]{{0,2}}[\[({{<][ ]{{0,2}}(?:at|@|{_AT})[ ]{{0,2}}[\])}}>][ ]{{0,2}}", re.I)
BRACKET_DOT = re.compile(rf"[ ]{{0,2}}[\[({{<][ ]{{0,2}}(?:{_DOT}|\.)[ ]{{0,2}}[\])}}>][ ]{{0,2}}", re.I)
_LABEL = r"[A-Za-z0-9-]{1,63}"
_SAID_DOT = rf"(?:[ ]{{1,2}}(?:{_DOT})[ ]{{1,2}}|[ ]{{0,2}}[\[({{<][ ]{{0,2}}(?:{_DOT})[ ]{{0,2}}[\])}}>][ ]{{0,2}})"
#: What follows a spelled "at": a domain with a spelled dot, or any domain; the last label is group 1.
_SAID = rf"(?={_LABEL}(?:(?:{_SAID_DOT}|\.){_LABEL}){{0,4}}(?:{_SAID_DOT})({_LABEL})(?![\w-]))"
_ANY = rf"(?={_LABEL}(?:(?:{_SAID_DOT}|\.){_LABEL}){{0,4}}(?:{_SAID_DOT}|\.)({_LABEL})(?![\w-]))"
WORD_AT = re.compile(rf"(?<=[A-Za-z0-9])[ ]{{1,2}}at[ ]{{1,2}}{_SAID}", re.I)
ANY_AT = re.compile(rf"(?<=[A-Za-z0-9])[ ]{{1,2}}at[ ]{{1,2}}{_ANY}", re.I)
#: The end of a local part with a digit or a sign inside of it, which no word has.
ODD_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])(?:[A-Za-z]+[0-9]|[A-Za-z0-9]+[._+-][A-Za-z0-9])[A-Za-z0-9._%+-]*\Z")
FOREIGN_AT = re.compile(rf"(?<=[A-Za-z0-9])[ ]{{1,2}}(?:{_AT})[ ]{{1,2}}{_ANY}", re.I)
#: Spelled dots before a label.
WORD_DOT = re.compile(rf"(?<=[A-Za-z0-9])[ ]{{1,2}}(?:{_DOT})[ ]{{1,2}}(?={_LABEL}(?![\w-]))", re.I)
WORD_DOT_LAST = re.compile(rf"({_LABEL})(?![\w-])", re.I)

DIGIT_DOT = re.compile(rf"(?<=[0-9])[ ]{{1,2}}(?:{_DOT})[ ]{{1,2}}(?=[0-9])", re.I)
QUICK_DOT = re.compile(rf" (?:{_DOT}) ")
QUICK_AT = re.compile(" (?=(?:" + "|".join(f"{w}|{w.capitalize()}|{w.upper()}" for w in ("at", *_AT.split("|"))) + ") )")

#: Quick test for spelled digits.
DIGIT_WORDS, SPACED = frozenset(w.encode() for w in DIGITS), bytes.maketrans(b",.()-+[]{}<>:;!?/\"'", b" " * 19)
#: No detector matches fewer digits (an address has four).
FEWEST = 4

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @, dotted domain: a match holds one @, so each @ is tried once."""
    found, last, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(t, start - 1):
            start -= 1
        m = DOMAIN.match(t, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = t.find("@", max(last, at + 1))
    return found


def detect(t: str) -> list[Span]:
    """Spans by kind, then start."""
    out: list[Span] = [("email", a, b) for a, b in emails(t)] if "@" in t else []
    if not re.search("[0-9]", t):
        return out
    for m in IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(t):
        if 13 <= len(m[0]) and 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


class Mapped:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def copy(self) -> Mapped:
        other = Mapped("")
        other.text, other.start, other.end = self.text, list(self.start), list(self.end)
        return other

    def rewrite(self, pattern: re.Pattern, by) -> None:
        """Replaces each match m by the string by(m); the new characters all stand for the whole match."""
        self.replace((*m.span(), by(m)) for m in pattern.finditer(self.text))

    def replace(self, edits) -> None:
        """Puts new for the text from a to b, for each (a, b, new) in order."""
        parts, starts, ends, last = [], [], [], 0
        for a, b, new in edits:
            if a == b:
                continue
            parts += [self.text[last:a], new]
            starts += self.start[last:a] + [self.start[a]] * len(new)
            ends += self.end[last:a] + [self.end[b - 1]] * len(new)
            last = b
        if last:
            self.text = "".join([*parts, self.text[last:]])
            self.start, self.end = starts + self.start[last:], ends + self.end[last:]


def spelled(t: str) -> Iterator[tuple[int, int, str]]:
    """Edits that make digits of the spelled ones in t, and join them with digits next to them.

    Written digits of more than one place keep what stands between them, as the detectors know it. A full stop or "dot"
    stays one if no space follows the stop; else it ends a sentence.
    """
    for run in SPELLED.finditer(t):
        parts = list(PART.finditer(t, *run.span()))
        single = [bool(p[2]) or bool(p[3]) and len(p[3]) == 1 for p in parts]
        if not any(p[2] for p in parts) and not (parts[0][1] and all(one for one, p in zip(single, parts, strict=True) if p[3])):
            continue
        for k, p in enumerate(parts):
            if p[1]:
                yield *p.span(), "+"
            elif p[2]:
                yield *p.span(), DIGITS[p[2].lower()]
            elif p[4] and (p[4].strip().isalpha() or p[4] == "."):
                yield *p.span(), "."
            elif p[4] and (parts[k - 1][2] or parts[k + 1][2] or single[k - 1] and single[k + 1]):
                yield *p.span(), ""


def at_signs(t: str) -> Iterator[tuple[int, int, str]]:
    """Edits that make signs of the spelled "at"s in t, in order."""
    last = 0
    for at in QUICK_AT.finditer(t):
        start = at.start() - (t[at.start() - 1 : at.start()] == " ")
        m = FOREIGN_AT.match(t, start)
        if not m:
            m = WORD_AT.match(t, start) or ANY_AT.match(t, start)
            if not m or m[1].lower() not in TOP or m.re is ANY_AT and not ODD_LOCAL.search(t, max(0, start - 65), start):
                continue
        if start >= last:
            yield *m.span(), "@"
            last = m.end()


def dot_signs(t: str) -> Iterator[tuple[int, int, str]]:
    """Edits that make full stops of spelled dots in domains that end in a known top level."""
    chain: list[tuple[int, int]] = []
    end, label = -1, ""
    for m in WORD_DOT.finditer(t):
        if m.start() != end:
            if label in TOP:
                yield from ((a, b, ".") for a, b in chain)
            chain = []
        chain.append(m.span())
        last = WORD_DOT_LAST.match(t, m.end())
        end, label = last.end(), last[1].lower()
    if label in TOP:
        yield from ((a, b, ".") for a, b in chain)


def rewritten(m: Mapped) -> Mapped:
    """m through the transducers of signs."""
    m.rewrite(BRACKET_AT, lambda _: "@")
    m.replace(at_signs(m.text))
    m.rewrite(BRACKET_DOT, lambda _: ".")
    if "@" in m.text:
        m.replace(dot_signs(m.text))
    if re.search("[0-9]", m.text):
        m.rewrite(DIGIT_DOT, lambda _: ".")
    return m


def readings(t: str, odd: bool, named: bool) -> Iterator[Mapped]:
    """t through all transducers, with numbers joined over commas, and if there are such, with each by itself."""
    m = Mapped(t)
    if odd:
        m.rewrite(ODD, lambda x: "" if x[0] in HIDDEN else narrow(x[0]))
    edits = list(spelled(m.text)) if named else []
    kept = [e for e in edits if e[2] or "," not in m.text[e[0] : e[1]]]
    apart = m.copy() if len(kept) < len(edits) else None
    m.replace(edits)
    yield rewritten(m)
    if apart:
        apart.replace(kept)
        yield rewritten(apart)


def disguised(t: str, base: list[Span]) -> list[Span]:
    """Spans found only after rewriting, in source positions."""
    odd, low = not t.isascii() and bool(ODD.search(t)), t.lower()
    named = "plus " in low or not DIGIT_WORDS.isdisjoint(low.encode().translate(SPACED).split())
    named = named and len(SPELLED_DIGIT.findall(t)) + len(re.findall(r"\d", t)) >= FEWEST
    signs = any(c in t for c in "[({<") and (BRACKET_AT.search(t) or BRACKET_DOT.search(t))
    signs = signs or (QUICK_DOT.search(low) and ("@" in t or re.search("[0-9]", t))) or next(at_signs(t), None)
    if not (odd or named or signs):
        return []
    taken, out = [(a, b) for _, a, b in base], []
    mails = [(a, b) for kind, a, b in base if kind == "email"]
    for m in readings(t, odd, named):
        for kind, a, b in detect(m.text):
            x, y = m.start[a], m.end[b - 1]
            touched = [s for s in taken if x < s[1] and s[0] < y]
            beyond = kind == "email" and all(s in mails and x <= s[0] and s[1] <= y and s != (x, y) for s in touched)
            if m.text[a:b] != t[x:y] and (not touched or beyond):
                out.append((kind, x, y))
                taken.append((x, y))
    return out


def listed(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def find(t: str) -> tuple[list[Span], list[Span]]:
    base = detect(t)
    return base, disguised(t, base)


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts and digest of base spans, and all spans."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [find(b.decode()) for b in T.texts(batch.column("text"))]
        out = {"doc_id": batch.column("doc_id")}
        out |= {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS}
        out["base_sha256"] = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
        out["spans"] = pa.array([listed(base + more) for base, more in found], pa.string())
        return out | {"n_added": pa.array([len(more) for _, more in found], pa.int64())}

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return T.per_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def masked(t: str) -> str:
    """t with each span replaced by its kind in angle brackets; of overlapping spans the first, longest one counts."""
    base, more = find(t)
    out, last = [], 0
    for kind, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [t[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join([*out, t[last:]])


def masked_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs with personal data masked in text, and n_chars following it where there is one."""

    @F.pandas_udf("string")
    def mask(column):
        return column.map(lambda t: t if t is None else masked(t))

    out = docs.withColumn("text", mask(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
