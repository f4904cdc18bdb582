"""Scalar functions on text: all built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in keyword overlap and in answer selection, and boilerplate of web pages.
KEYWORD_STOPS = "about after against among and are can does for from how into must of on or the to under what when which with would".split()
ANSWER_STOPS = "about and are can does for from how must of on or require required requirement requirements the to under what when which with".split()
CHROME = "skip to main content|not pressed|search the website|organisation structure"
LIFECYCLES = "ACTIVE AMENDED SUPERSEDED WITHDRAWN REPEALED REVIEW_REQUIRED UNKNOWN".split()

#: Where a sentence ends; \x01 is the mark at which it is then split, as not every engine looks behind.
_END, _MARK = r"([.!?])\s+", "\x01"


def normalise(c: Column) -> Column:
    """Without note marks, differences of space, and case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"\[\^\d{1,3}\]", ""), r"\s+", " ")))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(normalise(c), F.lit("[a-z0-9]+"), F.lit(0))


def terms(c: Column, stops: list[str] | None = None) -> Column:
    """The different words of three letters or more, less the stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in stops])) if stops else found


def keywords(c: Column) -> Column:
    return terms(c, KEYWORD_STOPS)


def query_terms(c: Column) -> Column:
    return terms(c, ANSWER_STOPS)


def word_overlap(asked: Column, span: Column) -> Column:
    """Share of the question's words that also stand in the passage."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    n = F.size(words(asked))
    return F.when(n > 0, F.round(F.size(F.array_intersect(words(asked), words(span))) / n, 3)).otherwise(0.0)


def sentences(c: Column) -> Column:
    return F.split(F.regexp_replace(c, _END, f"$1{_MARK}"), _MARK)


def clean_sentence(c: Column) -> Column:
    """Without the chapter, paragraph heading and item marks before it."""
    lead = r"(?i)^(?:chapter [ivxlc]+:\s*)?(?:\d+\.\s+[^.]+?\s+(?=[ivxlcdm]+\.\s))?(?:[ivxlcdm]+\.\s+)?"
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), lead, "")


def comparable(c: Column) -> Column:
    """Text as versions of a page are compared."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def canonical_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def title_stem(c: Column) -> Column:
    """Title without years, brackets, dashes and case: what a re-issue keeps."""
    out = F.regexp_replace(F.lower(c), r"\([^)]*\)|\d{4}(-\d{2,4})?", " ")
    return F.trim(F.regexp_replace(F.translate(out, "–—-", "   "), r"\s+", " "))


# Document types by the titles they are known by, the first that fits.
DOCUMENT_TYPES = [
    (r"\bfaqs?\b|frequently asked questions", "faq"),
    (r"\bamendment\b", "amendment"),
    (r"^master direction", "master_direction"),
    (r"^master circular", "master_circular"),
    (r"\bdirections?,?\s+\d{4}\b", "directions"),
    (r"\bregulations,?\s+\d{4}\b", "regulations"),
]


def document_type(title: Column) -> Column:
    """By the printed title; other titles are circulars, no title gives none."""
    found = F.coalesce(*[F.when(F.lower(title).rlike(p), F.lit(k)) for p, k in DOCUMENT_TYPES], F.lit("circular"))
    return F.when(F.coalesce(title, F.lit("")) != "", found)


def parse_date(c: Column) -> Column:
    """First date written 'May 8, 2025', else one written day first with points or slashes; impossible dates give null."""
    month = F.regexp_extract(c, r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December) +\d{1,2},? +\d{4})\b", 1)
    worded = F.to_date(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(month, ",", ""), " +", " "), F.lit("MMMM d yyyy")))
    numeric = F.regexp_extract(c, r"\b(\d{2}[./]\d{2}[./]\d{4})\b", 1)
    return F.coalesce(worded, F.to_date(F.try_to_timestamp(F.regexp_replace(numeric, "/", "."), F.lit("dd.MM.yyyy"))))


def short_year(c: Column) -> Column:
    return F.regexp_replace(c, r"\b(\d{4})-\d{2}(\d{2})\b", "$1-$2")


def department_reference(c: Column) -> Column:
    """One comparable key for a department's reference: its dotted parts without spaces and without the word No."""
    bare = lambda part: F.regexp_replace(F.regexp_replace(part, r"(?i)(?:^|\s)\s*no\s*$", ""), r"\s", "")
    parts = F.filter(F.transform(F.split(c, r"\."), bare), lambda x: x != "")
    return short_year(F.upper(F.array_join(parts, ".")))


def source_key(url: Column) -> Column:
    """Lower-case scheme, host and path, without www. and fragment; parameters in order; no scheme counts as https."""
    whole = F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    bare = F.regexp_replace(whole, r"#.*$", "")
    base = F.regexp_replace(F.lower(F.substring_index(bare, "?", 1)), r"://www\.", "://")
    query = F.when(F.contains(bare, F.lit("?")), F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise("")
    params = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.when(params == "", base).otherwise(F.concat(base, F.lit("?"), params))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host only; the path keeps its case and loses its last slash."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*", "")
    return F.concat(head, F.regexp_replace(rest, r"/$", ""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def owned_by(url: Column, domain: str) -> Column:
    """Whether the host is the domain or below it (a longer name that ends alike is not)."""
    h = host(url)
    return F.coalesce((h == domain) | h.endswith("." + domain), F.lit(False))


def stable_id(prefix: str, length: int, *parts: Column, sep: str = ":") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, length))


def written_day(d: Column, none: str = "an unknown date") -> Column:
    return F.coalesce(F.date_format(d, "d MMMM yyyy"), F.lit(none))


def midpoint(a: Column, b: Column) -> Column:
    return F.date_add(a, F.floor(F.datediff(b, a) / 2).cast("int"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two vectors of unit length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def model_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1_000_000, 8)


def citation_ids(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[(chunk_[a-f0-9]{20})\]"), F.lit(1))


def lines(c: Column) -> Column:
    """The different lines that are not blank, without outer space."""
    return F.array_distinct(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
