"""Versions of pages: latest, previous, changed, and what changed; statuses found in text; decisions on links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text as T

# What counts as a number and as a date when versions are compared.
NUMBER = r"\b\d+(?:\.\d+)?%?\b"
DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\w+ \d{1,2},? \d{4}\b"
# Methods that read an explicit statement of repeal or supersession, and statuses in which a document no longer rules.
EXPLICIT = ("repeal_annex", "repeal_sentence", "supersession_sentence", "superseded_by_statement")
NON_OPERATIVE = ("WITHDRAWN", "REPEALED", "SUPERSEDED")


def observed(log: DataFrame, key: str, order: list[Column], content: str) -> DataFrame:
    """Every observation with the one before: NEW, MODIFIED or UNCHANGED, and its version number (no-change rows get none)."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = log.withColumn("previous", F.lag(F.struct(F.col(content).alias("c"))).over(w))
    kind = F.when(F.col("previous").isNull(), "NEW").when(F.col("previous.c").eqNullSafe(F.col(content)), "UNCHANGED").otherwise("MODIFIED")
    rows = rows.withColumn("change", kind).drop("previous")
    counted = F.sum(F.when(F.col("change") != "UNCHANGED", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("version_no", F.when(F.col("change") != "UNCHANGED", counted))


def closed(versions: DataFrame, key: str, start: str) -> DataFrame:
    """Each version ends where the next begins."""
    return versions.withColumn("closed_at", F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def diff(old: Column, new: Column) -> Column:
    """Added and removed lines, and the numbers and dates that stand in one text only; all sorted."""
    found = lambda c, p: F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    either = lambda p: F.array_sort(F.array_union(F.array_except(found(old, p), found(new, p)), F.array_except(found(new, p), found(old, p))))
    return F.struct(
        F.array_sort(F.array_except(T.lines(new), T.lines(old))).alias("added"),
        F.array_sort(F.array_except(T.lines(old), T.lines(new))).alias("removed"),
        either(NUMBER).alias("changed_numbers"),
        either(DATE).alias("changed_dates"),
    )


def materiality(d: Column) -> Column:
    return F.when((F.size(d["changed_numbers"]) > 0) | (F.size(d["changed_dates"]) > 0), "HIGH").otherwise("MEDIUM")


#: What a text says about itself, the strongest first.
STATED = [
    ("WITHDRAWN", r"(?:^|\n)[ \t]*withdrawn[ \t]*(?:\n|$)|\bwithdrawn[ \t]*[.?!]?\s*$|\bthis (?:master )?(?:circular|directions?)\b[^\n]{0,80}\b(?:is|stands?) withdrawn\b"),
    ("SUPERSEDED", r"\bthis (?:master )?(?:circular|directions?)\b[^\n]{0,80}\bsuperseded\b"),
    ("REPEALED", r"\bthis (?:master )?(?:circular|directions?)\b[^\n]{0,80}\b(?:is|stands?) repealed\b"),
]


def stated_lifecycle(text: Column) -> Column:
    """Only what the text states: withdrawn before superseded before repealed; everything else needs review."""
    return F.coalesce(*[F.when(F.lower(text).rlike(p), F.lit(k)) for k, p in STATED], F.lit("REVIEW_REQUIRED"))


def watermark_lifecycle(html: Column) -> Column:
    return F.when(html.rlike(r"(?i)background\s*:\s*url\([^)]*withdrawn[^)]*\)"), "WITHDRAWN").otherwise("REVIEW_REQUIRED")


def settled(official: Column, stored: Column, approved: Column) -> Column:
    """An official negative finding wins; else the stored status if it is settled; else the curated one; else review."""
    known = lambda c: F.when(c.isNotNull() & ~c.isin("REVIEW_REQUIRED", "UNKNOWN"), c)
    return F.coalesce(F.when(official.isin(*NON_OPERATIVE), official), known(stored), known(approved), F.lit("REVIEW_REQUIRED"))


def trust_reasons(domain: str, auto: bool = True) -> Column:
    """Codes of all the conditions that a link fails. Columns: relation, scope, method, evidence_quote, n_matched, new_* and old_* url, day, status and id."""
    c = F.col
    dated = c("new_day").isNotNull() & c("old_day").isNotNull()
    holds = {  # a null answer is a failure, unless the condition says otherwise
        "automatic": F.lit(auto),
        "replaces": c("relation") == "SUPERSEDES",
        "whole": c("scope") == "WHOLE",
        "explicit": c("method").isin(*EXPLICIT),
        "quoted": F.trim("evidence_quote") != "",
        "one_match": c("n_matched") == 1,
        "official": T.owned_by(c("new_url"), domain) & T.owned_by(c("old_url"), domain),
        "dated": dated,
        "later": ~dated | (c("new_day") > c("old_day")),
        "operative": ~F.coalesce(c("new_status").isin(*NON_OPERATIVE), F.lit(False)),
        "another": ~c("new_id").eqNullSafe(c("old_id")),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(f"not {code}")) for code, test in holds.items()]))


def switch_over(old_end: Column, successor_start: Column, today: Column) -> Column:
    """The end of an old rule once its successor starts: never later than it was; null if the switch is not due."""
    return F.when(successor_start <= today, F.least(old_end, successor_start)).otherwise(old_end)


def insert_if_absent(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The old rows as they are, and the new ones whose key is not there."""
    fresh = new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh)


def upsert(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old ones whose key they don't have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")
