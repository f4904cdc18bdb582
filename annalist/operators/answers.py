"""Answers as rows: headings that their claims bear out, checked claims, rendering, answers still being written, and texts put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text as T

# Words of a heading that say nothing about its subject, the heading of unnamed provisions, and marks of claims that a checker doesn't pass.
PLAIN = "a an and are as at be by for from in is of on or the to with key requirements requirement supporting provisions provision changes change rules rule modifications".split()
UNNAMED = "Supporting provisions"
FLAGS = {"partially_supported": " _(only partly supported by the cited text)_", "not_supported": " _(not supported by the cited text)_"}


def subject(c: Column) -> Column:
    """The different words of a heading or text that name a subject, without plural s."""
    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*PLAIN))
    return F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, "s+$", "")))


def aligned_heading(heading: Column, body: Column, cited: Column) -> Column:
    """The heading, if all its subject words stand in the claims and in the cited text; else the unnamed one. A heading without such words stays."""
    own = subject(heading)
    held = (F.size(F.array_except(own, subject(body))) == 0) & (F.size(F.array_except(own, subject(cited))) == 0)
    return F.when(held, heading).otherwise(F.lit(UNNAMED))


def flagged(support: Column) -> Column:
    return F.coalesce(*[F.when(support == k, F.lit(v)) for k, v in FLAGS.items()], F.lit(""))


def markdown(claims: DataFrame, key: list[str]) -> DataFrame:
    """key, markdown: the claims of an answer (key, place, text, citations, support) in order; the first is the direct answer. An answer is a few claims long."""
    line = F.concat("text", F.lit(" "), F.array_join(F.transform("citations", lambda c: F.concat(F.lit("["), c, F.lit("]"))), " "), flagged(F.col("support")))
    rows = claims.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("ls"))
    rest = F.transform(F.slice("ls", F.lit(2), F.greatest(F.lit(0), F.size("ls") - 1)), lambda x: F.concat(F.lit("- "), x["line"]))
    parts = F.concat(F.array(F.lit("### Direct answer"), F.get("ls", F.lit(0))["line"]), F.when(F.size(rest) > 0, F.concat(F.array(F.lit(f"### {UNNAMED}")), rest)).otherwise(F.array().cast("array<string>")))
    return rows.select(*key, F.array_join(parts, "\n\n").alias("markdown"))


def partial_answer(content: Column) -> Column:
    """The direct answer's text so far, out of a JSON answer that is still being written; null before it begins. An escape cut in two is left out."""
    raw = F.regexp_extract(content, r'"direct_answer"\s*:\s*\{\s*(?:"title"\s*:\s*(?:null|"(?:[^"\\]|\\.)*")\s*,\s*)?"text"\s*:\s*"((?:[^"\\]|\\.)*\\?)', 1)
    begun = content.rlike(r'"direct_answer"\s*:\s*\{\s*(?:"title"\s*:\s*(?:null|"(?:[^"\\]|\\.)*")\s*,\s*)?"text"\s*:\s*"')
    whole = F.regexp_replace(raw, r"(?<!\\)((?:\\\\)*)\\(?:u[0-9a-fA-F]{0,3})?$", "$1")
    return F.when(begun, F.from_json(F.concat(F.lit('{"t":"'), whole, F.lit('"}')), "t string")["t"])


def reassembled(windows: DataFrame, key: str, place: str, text: str, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(key, text of windows of words that overlap; keys with a boundary where the words disagree or a window is missing)."""
    w = Window.partitionBy(key).orderBy(place)
    rows = windows.select(key, place, F.split(text, " ").alias("w")).withColumn("before", F.lag("w").over(w)).withColumn("n", F.row_number().over(w))
    fits = F.col("before").isNull() | ((F.slice("before", -overlap, overlap) == F.slice("w", 1, overlap)) & (F.col(place) == F.col("n") - 1))
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False)) & ((F.col("n") > 1) | (F.col(place) == 0)))
    own = F.when(F.col("n") == 1, F.col("w")).otherwise(F.slice("w", F.lit(overlap + 1), F.greatest(F.lit(0), F.size("w") - overlap)))
    whole = rows.groupBy(key).agg(F.every("fits").alias("good"), F.array_sort(F.collect_list(F.struct(place, own.alias("w")))).alias("ws"))
    return whole.filter("good").select(key, F.array_join(F.flatten(F.transform("ws", lambda x: x["w"])), " ").alias("text")), whole.filter("not good").select(key)


def checked(claims: DataFrame) -> Column:
    """The verdict after the rules: no citation or no verdict is not supported; a quote that isn't found lowers full support to partial."""
    v, found = F.col("verdict"), F.coalesce("found", F.lit(False))
    return F.when((F.col("n_cited") == 0) | v.isNull(), "not_supported").when((v == "supported") & ~found, "partially_supported").otherwise(v)


def resolved(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """name, entity: the entity whose alias comes first in the list (entity, alias, place); hyphens count."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9-]+", " "))
    a = aliases.select(key(F.col("alias")).alias("_k"), "entity", "place").groupBy("_k").agg(F.min_by("entity", "place").alias("entity"))
    return names.withColumn("_k", key(F.col(name))).join(a, "_k", "left").select(name, "entity")
