"""What documents say about their own start, their replacement, what they replace, and what they change; registers of withdrawn documents.

All scalar patterns are built-in expressions; only the tables of annexes and registers, whose rows span lines, are read in Python.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import segmentation as S

DATE = r"(?:(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}|\d{2}[./]\d{2}[./]\d{4})"
#: A clause in which the document itself, not a part of it, starts to apply; group 1 is what follows.
STARTS = r"(?i)\b(?:these|this|the)\s+(?:revised\s+)?(?:amendment\s+)?(?:master\s+)?(?:directions?|instructions|circular|guidelines|framework|regulations)\b[^.]{0,60}?\bshall\s+(?:come\s+into\s+(?:force|effect)|be(?:come)?\s+effective|be\s+applicable)\b([^.]{0,80})"
AT_ONCE = r"(?i)^\s*(?:(?:with\s+)?immediate|on\s+the\s+(?:day|date)\s+(?:of\s+(?:issue|this)|(?:it|they)\s+(?:is|are)\s+placed))"
#: An old document that names what replaced it; group 1 is the rest of the line.
REPLACED_BY = r"(?i)\b(?:this\s+(?:master\s+)?(?:circular|directions?|document)\b[^.\n]{0,100}?\b(?:superseded|replaced)\s+(?:by|with)\b|(?:the|this)\s+(?:master\s+)?(?:circular|directions?|notification)\s+has\s+been\s+(?:repealed|withdrawn|superseded)\.?\s*please\s+refer\s+to\s+)([^\n]{0,300})"
#: An amendment names its base by title; group 1 is the title.
BASE = r"(?i)please refer to\s+(?:the\s+)?([^\n]{10,300}?)\s*\(hereinafter[^)\n]*\)"


def commencement(text: Column) -> Column:
    """The day on which a document says that it, as a whole, starts to apply; null if it says nothing, or at once."""
    rest = F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit(STARTS), F.lit(1))
    dated = F.transform(rest, lambda r: F.regexp_extract(r, rf"(?i)^\s*(?:from|on|with\s+effect\s+from)\s+({DATE})", 1))
    first = F.filter(F.arrays_zip(rest.alias("r"), dated.alias("d")), lambda x: (x["d"] != "") | x["r"].rlike(AT_ONCE))
    return T.parse_date(F.get(first, F.lit(0))["d"])


def replacements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, targets, title: statements in which a document names its own replacement by number, else by title."""
    tails = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(REPLACED_BY), F.lit(1))).alias("place", "tail")).filter(F.trim("tail") != "")
    named = F.regexp_extract("tail", r"^(.*?)(?:\.\s|\.$|$)", 1)
    title = F.trim(F.regexp_replace(F.substring_index(named, " dated ", 1), r"^[\s.:;]+|[\s.:;]+$", ""))
    targets = S.references(F.col("tail"))
    return tails.select(key, "place", targets.alias("targets"), F.when(F.size(targets) == 0, F.nullif(F.substring(title, 1, 200), F.lit(""))).alias("title"))


def amendment_base(text: Column, head: int = 3000) -> Column:
    """The title of the document that an amendment changes, as its head names it; null for other documents."""
    top = F.substring(text, 1, head)
    title = F.trim(F.regexp_replace(F.regexp_extract(top, BASE, 1), r"(?i)\s*\((?:as )?updated[^)]*\)\s*$", ""))
    return F.when(top.rlike(r"\bAmendment\b") & top.rlike(r"(?i)\bmodif(?:y|ies)\b|\bamend(?:s|ed)?\b"), F.nullif(title, F.lit("")))


ANNEX = re.compile(r"(?i)Annex(?:ure)?\s*[-–]?\s*[IVX\d]+\s*:?\s*List of (?:circulars|instructions|directions|master directions)[^\n]*repeal[^\n]*\n")
HEADINGS = {"s.no.", "sr. no.", "sr.no.", "circular no.", "circular number", "date", "subject", "sl. no."}
ROW = re.compile(rf"\s*(\d+)\.[ \t]*\n((?:(?!\s*\d+\.[ \t]*\n)(?!\s*\d{{2}}[./]\d{{2}}[./]\d{{4}}[ \t]*\n)[^\n]*\n){{1,4}})\s*(\d{{2}}[./]\d{{2}}[./]\d{{4}})[ \t]*\n(?!\s*\d+\.[ \t]*\n)[ \t]*(\S[^\n]*)(?:\n\s*|$)")


def _annex_rows(text: str) -> Iterator[tuple[int, str, str, str]]:
    for heading in ANNEX.finditer(text):
        at = heading.end()
        while (line := re.compile(r"[^\n]*\n").match(text, at)) and (line[0].strip().lower() in HEADINGS or not line[0].strip()):
            at = line.end()
        while m := ROW.match(text, at):  # the table ends at the first line that is no row
            yield int(m[1]), " ".join(m[2].split()), m[3], m[4].strip()
            at = m.end()


def repealed_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, row_no, targets, dated, title: the rows (number, numbers, date, subject) of annexes that list what is repealed."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, t in zip(b[key], b[text]) for r in _annex_rows(t)]
            yield pd.DataFrame(rows, columns=[key, "row_no", "numbers", "dated", "title"])

    found = docs.filter(F.col(text).rlike("(?i)annex") & F.col(text).rlike("(?i)repeal")).select(key, text).mapInPandas(run, f"{key} {kind}, row_no int, numbers string, dated string, title string")
    return found.select(key, "row_no", S.references(F.col("numbers")).alias("targets"), T.parse_date(F.col("dated")).alias("dated"), "title")


def register_rows(pages: DataFrame, key: str, page: str) -> DataFrame:
    """key, row_no, number, title, issued, url: the rows of four cells (no., number, title, date) of the tables of a page."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(page, F.lit(r"(?is)<tr\b[^>]*>.*?</tr\s*>"), F.lit(0))).alias("row_no", "tr"))
    rows = rows.withColumn("td", F.regexp_extract_all("tr", F.lit(r"(?is)<td\b[^>]*>(.*?)</td\s*>"), F.lit(1))).filter(F.size("td") == 4)
    plain = lambda i: F.trim(F.regexp_replace(_unescaped(F.regexp_replace(F.get("td", F.lit(i)), r"(?s)<[^>]+>", " ")), r"\s+", " "))
    url = F.nullif(F.substring_index(_unescaped(F.regexp_extract(F.get("td", F.lit(1)), r"(?is)\bhref\s*=\s*[\"']([^\"']+)", 1)), "#", 1), F.lit(""))
    return rows.select(key, "row_no", plain(1).alias("number"), plain(2).alias("title"), T.parse_date(plain(3)).alias("issued"), url.alias("url"))


def _unescaped(c: Column) -> Column:
    for name in ("lt", "gt", "quot", "#39", "nbsp", "amp"):
        c = F.regexp_replace(c, f"&{name};", html.unescape(f"&{name};"))
    return c


def index_entries(listings: DataFrame, *order: Column) -> DataFrame:
    """Of the entries of an index (page_id, ...) the first per page."""
    return listings.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy(*order))).filter("_n = 1").drop("_n")


def core_title(title: Column) -> Column:
    """A title without its note of the last update, for comparison: dashes, spaces and case are alike."""
    bare = F.regexp_replace(title, r"(?i)\s*\(updated as on[^)]*\)", "")
    return F.lower(F.trim(F.regexp_replace(F.translate(bare, "–—", "--"), r"\s+", " ")))


def matched_files(files: DataFrame, entries: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """file_id, page_id: the one index entry whose title, size and date a file agrees with; the longest title wins, a tie has no answer.

    ``files``: file_id, title_text, size_kb, updated_on; ``entries``: page_id, title, size_kb, updated_on. They meet on date and words of the
    title, not pair by pair.
    """
    e = entries.select("page_id", core_title(F.col("title")).alias("core"), F.col("size_kb").alias("want_kb"), F.coalesce("updated_on", F.lit("1700-01-01").cast("date")).alias("day"))
    e = e.withColumn("words", F.split("core", " ")).withColumn("rare", F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    f = files.select("file_id", core_title(F.col("title_text")).alias("printed"), "size_kb", F.coalesce("updated_on", F.lit("1700-01-01").cast("date")).alias("day"))
    f = f.withColumn("rare", F.explode(F.array_distinct(F.split("printed", " "))))
    fits = f.join(e, ["day", "rare"]).filter(F.contains("printed", F.col("core")) & (F.col("want_kb") > 0) & (F.abs(F.col("size_kb") - F.col("want_kb")) <= F.col("want_kb") * tolerance))
    by = Window.partitionBy("file_id")
    longest = fits.withColumn("long", F.max(F.length("core")).over(by)).filter(F.length("core") == F.col("long")).groupBy("file_id").agg(F.count_distinct("page_id").alias("n"), F.min("page_id").alias("page_id"))
    return longest.filter("n = 1").select("file_id", "page_id")


def sentence_at(text: Column, pos: Column) -> Column:
    """The sentence or line around a position (from 0): an exact part of the text, without outer space."""
    before = F.regexp_extract(F.substring(text, F.lit(1), pos), r"(?s)^(?:.*(?:\n|\. ))?(.*)$", 1)
    after = F.regexp_extract(F.substring(text, pos + 1, F.length(text)), r"(?s)^(.*?(?:\n|\.(?= )|$))", 1)
    return F.trim(F.regexp_replace(F.concat(before, after), r"^\s+|\s+$", ""))


def matching_sentence(text: Column, title: Column, most: int = 400) -> Column:
    """The sentence that shares most keywords with a title (the first of equals), cut to ``most`` characters."""
    marked = F.split(F.regexp_replace(text, r"([.;:])\s+", "$1\x01"), "\x01")
    parts = F.filter(F.transform(marked, lambda x: F.trim(x)), lambda x: x != "")
    scored = F.transform(parts, lambda s, i: F.struct(F.size(F.array_intersect(T.keywords(title), T.keywords(s))).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.substring(F.coalesce(F.array_max(scored)["s"], text), 1, most)


def title_from_name(name: Column) -> Column:
    """A readable title from a file's name."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), r"[-_\s]+", " ")))
