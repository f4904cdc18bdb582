"""Personal information in free text: found by kind, replaced by typed placeholders.

Numbers are validated and replaced by format-preserving pseudonyms: a keyed Feistel network permutes the digits (and letters) within
their format, so equal values, however they are written, get equal pseudonyms in all documents, and who holds the key can go back.
Dates go the same way where the caller asks for them. E-mail addresses, street addresses and names get a keyed digest of their normal
form. Which words are names is learned from the documents (``names``). Everything else in the text stays as it is.

Defined results: null and empty texts hold nothing; positions count code points, the end is excluded; spans don't overlap (where kinds compete
an e-mail address wins over an address, then a phone number, an id number, a name); texts are read whole; equal rows give equal rows.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.names import FIRMS, SP, TITLES, NameModel, fit_names

# Words of street addresses.
STREETS = "road street lane close avenue parade row rise walk way drive square court terrace place crescent boulevard hill".split()

SPACES = " \n\t\u00a0\u202f"
AT = r"(?:@|\s?[\[({<]\s?at\s?[\])}>]\s?|\s[aA][tT]\s(?=\S+\s?(?:[\[({]\s?)?dot\b))"
DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s)"
EMAIL = re.compile(rf"(?i)(?<![\w.+-])[^\W_][\w.+%'-]*{AT}[^\W_](?:[\w-]*[^\W_])?(?:{DOT}[^\W_](?:[\w-]*[^\W_])?)+")
SEP = r"[ .\-/\u00a0\u202f]"
#: A phone number or a citizen number by its first character; what stands before that is looked at from behind it.
NUMBER = re.compile(
    rf"[\d+(](?<![\w+/_].)(?<!\w[.\-].)(?:(?:(?<=\+)\d{{3}}{SEP}?\(?\d{{2}}\)?|(?<=0)0\d{{3}}{SEP}?\(?\d{{2}}\)?|(?<=\()0\d{{2}}\)|(?<=0)\d{{2}}){SEP}?\d{{3}}{SEP}?\d{{2}}{SEP}?\d{{2}}(?!\d)(?!{SEP}\d)"
    rf"|(?<=[1-9])\d{{3}}{SEP}?\d{{4}}{SEP}?\d{{2}}(?!\w)(?![-./]\d))"
)
TAX = re.compile(rf"(?i)TX[A-Z]{SEP}?\d{{5}}{SEP}?[A-Z](?!\w)")
#: The digits of a passport number; its letter stands before them.
PASSPORT = re.compile(rf"\d{{3}}{SEP}?\d{{4}}(?!\w)(?![-./]\d)")
START = re.compile(
    rf"(?i)(?<![\w/-])(?:P\.?{SP}?O\.?{SP}?Box{SP}+\d+|(?:Post{SP}?)?Box{SP}+(?:No\.?{SP}*)?\d+|Flat{SP}+(?:No\.?{SP}*)?\d+\w*|Plot{SP}+(?:No\.?{SP}*)?\d+[\w-]*|House{SP}+(?:No\.?{SP}*)?\d+\w*(?:/\w+)?"
    rf"|\d{{1,4}}[A-Z]?,?{SP}+(?:[^\W\d_][\w'’-]*{SP}+){{1,3}}?(?:{'|'.join(STREETS)})\b)"
)
#: From the start to the postcode: words, small numbers and commas, over at most two line ends.
MIDDLE = re.compile(r"[^\d.;:?!\n]*(?:\n[^\d.;:?!\n]*)?(?:\d{1,4}[A-Za-z]?(?![\d])(?:/\d+)?[^\d.;:?!\n]*(?:\n[^\d.;:?!\n]*)?){0,3}")
POSTCODE = re.compile(r"\d{5}(?<![\d.,/-].....)(?![\d/]|[-.,]\d)")
#: One of these stands in every address.
PLACES = re.compile("box|flat|plot|house|" + "|".join(STREETS))
REACH = 140
KINDS = ("email", "address", "phone", "id_number", "name")
#: Dates are found only if asked for.
EVERY = (*KINDS, "date")
DATE = re.compile(r"(?<![\w./-])(?:(\d{4})-(\d{2})-(\d{2})|(\d{2})([./-])(\d{2})\5(\d{4}))(?![\w/-])")
NAME = r"(?:[^\W\d_]['’])?[^\W\d_]{2,}(?:[-'’][^\W\d_]+)*"
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), 73_049


def _day(m: re.Match) -> int | None:
    """Days since FIRST_DAY of a date as it is written; None if there is no such day, or it lies outside."""
    y, mo, d = (m[1], m[2], m[3]) if m[1] else (m[7], m[6], m[4])
    try:
        n = (datetime.date(int(y), int(mo), int(d)) - FIRST_DAY).days
    except ValueError:
        return None
    return n if 0 <= n < DAYS else None


class Finder:
    """Finds spans of ``kinds``. ``names`` says which words are names, ``titles`` and ``firms`` what stands before and behind them."""

    def __init__(self, names: NameModel | None = None, titles=tuple(TITLES), firms=tuple(FIRMS), kinds=KINDS) -> None:
        import ahocorasick

        self.model, self.kinds = names or NameModel(), tuple(kinds)
        self.words = ahocorasick.Automaton()
        for g in self.model.given:
            self.words.add_word(g, ("given", len(g)))
        for t in titles:
            self.words.add_word(t + " ", ("title", len(t) + 1))
            self.words.add_word(t + ". ", ("title", len(t) + 2))
        self.words.make_automaton()
        self.right = re.compile(rf"{SP}(?:([A-Za-z]\.){SP})?({NAME})(?!\w)")
        self.second = re.compile(rf"(?:{SP}[A-Z]\.(?!\w))?")
        self.left = re.compile(rf"(?<![\w@.+-])({NAME}),{SP}$")
        self.dotted = re.compile(r"[A-Za-z]\.(?!\w*@)")
        self.initials = re.compile(rf"(?:{SP}?[A-Z]\.)?({SP}?)({NAME})(?![\w@])")
        self.before = re.compile(rf"(?<![\w@.+-])({NAME}),{SP}$")
        self.firm = re.compile(rf"(?i){SP}(?:{'|'.join(firms)})\b")
        self.titled = re.compile(rf"(?:[A-Z][a-zà-ÿ]+|[A-Z]\.){SP}(?:[A-Z]\.{SP})?[A-Z][a-zà-ÿ]{{2,}}(?:-[A-Z][a-zà-ÿ]+)?(?!\w)")

    def emails(self, t: str, low: str) -> list[tuple[int, int]]:
        if "@" in t or "at)" in low or "at]" in low or "at }" in low or "at ]" in low or "at )" in low or "at}" in low or "at>" in low or (" dot " in low and " at " in low):
            return [(m.start(), m.end()) for m in EMAIL.finditer(t)]
        return []

    def addresses(self, t: str, low: str) -> list[tuple[int, int]]:
        out, last = [], 0
        for p in POSTCODE.finditer(t):
            end = p.start()
            lo = max(last, end - REACH)
            if t[end - 1 : end] in SPACES and PLACES.search(low, lo, end):
                for s in START.finditer(t, lo, end):
                    m = MIDDLE.match(t, s.end(), end)
                    if m and m.end() == end:
                        out.append((s.start(), p.end()))
                        break
            last = p.end()
        return out

    def numbers(self, t: str, low: str) -> list[tuple[str, int, int]]:
        out = [("id_number" if t[m.start()] in "123456789" else "phone", m.start(), m.end()) for m in NUMBER.finditer(t)]
        i = low.find("tx")
        while i >= 0:
            if (i == 0 or not (t[i - 1].isalnum() or t[i - 1] in "_-")) and (m := TAX.match(t, i)):
                out.append(("id_number", i, m.end()))
            i = low.find("tx", i + 2)
        for m in PASSPORT.finditer(t):
            i = m.start() - 1
            if i > 0 and t[i] in SPACES + ".-/":
                i -= 1
            if i >= 0 and low[i] in "kns" and (i == 0 or not (t[i - 1].isalnum() or t[i - 1] in "_-")):
                out.append(("id_number", i, m.end()))
        return out

    def names(self, t: str, low: str) -> list[tuple[int, int]]:
        out = []
        for end, (kind, n) in self.words.iter(low):
            a, b = end + 1 - n, end + 1
            if a and (low[a - 1].isalnum() or low[a - 1] in "_@+.-"):
                continue
            if kind == "title":
                m = self.titled.match(t, b)
                if m and not self.firm.match(t, m.end()):
                    out.append((b, m.end()))
                continue
            if b < len(t) and (low[b].isalnum() or low[b] in "_@-" or low[b] == "." and low[b + 1 : b + 2].isalnum()):
                continue
            if (m := self.right.match(t, b)) is not None and not (m.end() < len(t) and t[m.end()] == "@"):
                shaped = t[a].isupper() and (m[2][1:].islower() or not m[2].isupper() or t[a:b].isupper())
                if self.model.surname(m[2], shaped) and not self.firm.match(t, m.end()):
                    out.append((a, m.end()))
            if t[max(0, a - 2) : a - 1] == "," and (m := self.left.search(t, max(0, a - 48), a)) is not None and self.model.surname(m[1], False):
                out.append((m.start(), self.second.match(t, b).end()))
        for d in self.dotted.finditer(t):
            a, b = d.span()
            if a and (t[a - 1].isalnum() or t[a - 1] in "_@.+-"):
                continue
            m = self.initials.match(t, b)
            if m and (t[a].isupper() or m[1]) and m[2][0].isupper() == t[a].isupper() and self.model.surname(m[2], False) and not self.firm.match(t, m.end()):
                out.append((a, m.end()))
            elif t[max(0, a - 2) : a - 1] == "," and t[a].isupper() and not t[b : b + 1].isalnum() and (m := self.before.search(t, max(0, a - 48), a)) is not None and self.model.surname(m[1], False):
                out.append((m.start(), b))
        out.sort(key=lambda s: (s[0] - s[1], s[0]))  # longer ones first
        kept: list[tuple[int, int]] = []
        for x in out:
            if all(x[1] <= k[0] or x[0] >= k[1] for k in kept):
                kept.append(x)
        return sorted(kept)

    def dates(self, t: str, low: str) -> list[tuple[int, int]]:
        return [m.span() for m in DATE.finditer(t) if _day(m) is not None]

    def spans(self, t: str) -> list[tuple[str, int, int]]:
        low = t.lower()
        if len(low) != len(t):  # positions must agree
            low = "".join(x if len(x := c.lower()) == 1 else c for c in t)
        finds = {"email": self.emails, "address": self.addresses, "name": self.names, "date": self.dates}
        every = [(k, *x) for k, find in finds.items() if k in self.kinds for x in find(t, low)] + [x for x in self.numbers(t, low) if x[0] in self.kinds]
        if len(every) < 2:
            return every
        every.sort(key=lambda s: (EVERY.index(s[0]), s[1], -s[2]))
        kept: list[tuple[str, int, int]] = []
        for s in every:
            if all(s[2] <= k[1] or s[1] >= k[2] for k in kept):
                kept.append(s)
        return sorted(kept, key=lambda s: s[1])


def _round(key: bytes, n: int, value: int, size: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{n}:{size}:{value}".encode(), key=key, digest_size=8).digest(), "big")


def permute(key: bytes, value: int, size: int, back: bool = False, rounds: int = 8) -> int:
    """A keyed permutation of range(size): a Feistel network on two halves, repeated until the result lies in the range."""
    half = math.isqrt(size - 1) + 1
    while True:
        a, b = divmod(value, half)
        if back:
            for n in reversed(range(rounds)):
                a, b = (b - _round(key, n, a, size)) % half, a
        else:
            for n in range(rounds):
                a, b = b, (a + _round(key, n, b, size)) % half
        value = a * half + b
        if value < size:
            return value


def _laid(text: str, at: list[int], new: str) -> str:
    """``text`` with other characters at the given places; the case of letters stays."""
    out = list(text)
    for i, c in zip(at, new):
        out[i] = c.lower() if text[i].islower() else c
    return "".join(out)


def pseudonym(key: bytes, kind: str, text: str, back: bool = False) -> str:
    """The permuted value in the layout of ``text``: prefix, separators and brackets stay, however the number is written.

    Phone numbers: the last nine digits. Citizen numbers: ten digits, not beginning with 0. Tax and passport numbers: letters and digits. Dates: days
    of 1900 to 2099. Only what parses as such a number or day comes here.
    """
    if kind == "date":
        m = DATE.fullmatch(text)
        day = FIRST_DAY + datetime.timedelta(permute(key + b"d", _day(m), DAYS, back))
        return day.isoformat() if m[1] else day.strftime(f"%d{m[5]}%m{m[5]}%Y")
    at = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    chars = "".join(text[i] for i in at).upper()
    if kind == "phone":
        return _laid(text, at[-9:], f"{permute(key + b'p', int(chars[-9:]), 10**9, back):09d}")
    if chars.isdigit():
        return _laid(text, at, str(permute(key + b"c", int(chars) - 10**9, 9 * 10**9, back) + 10**9))
    if chars.startswith("TX"):
        v = (ord(chars[2]) - 65) * 26 + ord(chars[8]) - 65
        letters, digits = divmod(permute(key + b"t", v * 10**5 + int(chars[3:8]), 676 * 10**5, back), 10**5)
        return _laid(text, at, f"TX{chr(65 + letters // 26)}{digits:05d}{chr(65 + letters % 26)}")
    v = permute(key + b"n", "KNS".index(chars[0]) * 10**7 + int(chars[1:]), 3 * 10**7, back)
    return _laid(text, at, f"{'KNS'[v // 10**7]}{v % 10**7:07d}")


def _normal(kind: str, text: str) -> str:
    t = " ".join(text.lower().split())
    if kind == "email":
        t = re.sub(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s", "@", t)
        return re.sub(r"\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s", ".", t)
    if kind == "name" and "," in t:
        a, b = t.split(",", 1)
        return f"{b.strip()} {a}"
    return t


def placeholder(key: bytes, kind: str, text: str) -> str:
    """[KIND pseudonym]: numbers and dates permuted within their format, the rest as a keyed digest of 128 bits of its normal form."""
    if kind in ("phone", "id_number", "date"):
        return f"[{kind.upper()} {pseudonym(key, kind, text)}]"
    return f"[{kind.upper()} {hashlib.blake2b(_normal(kind, text).encode(), key=key, digest_size=16).hexdigest()}]"


SPANS = "array<struct<pii_kind:string,start_pos:int,end_pos:int,placeholder:string>>"


def _annotated(batches: Iterator[pd.DataFrame], key: bytes, sent, with_text: bool) -> Iterator[pd.DataFrame]:
    finder, holder = Finder(**sent.value), lru_cache(maxsize=100_000)(placeholder)
    for b in batches:
        every, texts = [], []
        for t in b["text"]:
            found = [(k, lo, hi, holder(key, k, t[lo:hi])) for k, lo, hi in finder.spans(t)] if t else []
            every.append(found)
            if with_text:
                parts, at = [], 0
                for _, lo, hi, new in found:
                    parts += [t[at:lo], new]
                    at = hi
                texts.append("".join([*parts, t[at:]]) if found else t)
        out = {"doc_id": b["doc_id"], "spans": [[dict(zip(("pii_kind", "start_pos", "end_pos", "placeholder"), x)) for x in e] for e in every]}
        yield pd.DataFrame(out | ({"redacted": texts} if with_text else {}))


def annotate(docs: DataFrame, key: bytes, finder: dict | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, spans (kind, start, end and placeholder of each), and redacted if ``with_text``; no shuffle.

    ``finder``: arguments of Finder; by default its names are fitted on a sample of the documents.
    """
    finder = {"names": fit_names(docs)} if finder is None else finder
    sent = docs.sparkSession.sparkContext.broadcast(finder)
    schema = f"doc_id long, spans {SPANS}" + (", redacted string" if with_text else "")
    return docs.select("doc_id", "text").mapInPandas(lambda it: _annotated(it, key, sent, with_text), schema)


def find_pii(docs: DataFrame, key: bytes, finder: dict | None = None) -> DataFrame:
    """doc_id, pii_kind, start_pos, end_pos, placeholder."""
    rows = annotate(docs.filter("text is not null and doc_id is not null"), key, finder)
    return rows.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def redact(docs: DataFrame, key: bytes, finder: dict | None = None) -> DataFrame:
    """Every document with its text redacted (doc_id, redacted, n_found)."""
    return annotate(docs, key, finder, True).select("doc_id", "redacted", F.size("spans").alias("n_found"))


def pii_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("pii_kind").agg(F.count(F.lit(1)).alias("n_spans"), F.count_distinct("doc_id").alias("n_docs"))
