"""From what texts state about other documents to links between records, and from links to periods in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import segmentation as S
from annalist.sources.shared import bounded

#: Aliases that may be broadcast; more are joined without a hint.
MOST_ALIASES = 100_000

#: Words of a sentence that say what it does to the documents it names, the strongest first.
RELATIONS = (("SUPERSEDES", r"\b(?:supersed\w*|repeal\w*|replac\w*|withdrawn)\b"), ("AMENDS", r"\b(?:amend\w*|modif\w*|substitut\w*)\b"))


#: A line that is only a date, as the data's country prints it.
DATE_LINE = r"^\s*(?:(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}|\d{2}[./]\d{2}[./]\d{4})\s*$"
_NUMBER = f"(?:{S.DEPARTMENT}|{S.SERIES})"


def header_facts(text: Column, head: int = 3000) -> Column:
    """(numbers, issued, title, first_line) as a page prints them.

    numbers: the first reference number that begins in the first ``head`` characters (later ones are citations) and any printed directly
    after it, in reading order. issued: the first of the five lines after them that is only a date. title: the first of these lines that
    is neither blank nor a date, if the numbers stand on lines of their own. No number, no date and no title; the rest of the text is never cut.
    """
    found = rf"(?s)^(.{{0,{head - 1}}}?)({_NUMBER}(?:\s*{_NUMBER})*)"
    before, own = F.regexp_extract(text, found, 1), F.regexp_extract(text, found, 2)
    after = F.slice(F.split(F.substring(text, F.length(before) + F.length(own) + F.lit(1), F.length(text)), r"\r?\n"), 1, 5)
    dated = F.get(F.filter(after, lambda x: x.rlike(DATE_LINE)), F.lit(0))
    titled = F.get(F.filter(after, lambda x: (F.trim(x) != "") & ~x.rlike(DATE_LINE)), F.lit(0))
    alone = (own != "") & before.rlike(r"(?:^|\n)[ \t]*\z") & (F.trim(F.get(after, F.lit(0))) == "")
    numbers = F.transform(F.regexp_extract_all(own, F.lit(_NUMBER), F.lit(0)), T.department_reference)
    return F.struct(numbers.alias("numbers"), F.when(own != "", T.parse_date(dated)).alias("issued"), F.when(alone, F.trim(titled)).alias("title"), F.substring_index(text, "\n", 1).alias("first_line"))


#: Numbers printed side by side name one document.
_GROUP = rf"{_NUMBER}(?:[\s,;/]*{_NUMBER})*"
#: A statement about a part of a document; a number that only tells where something was announced; a date right after a number.
PART = r"(?i)\b(?:paragraphs?|paras?|clauses?|sub-clauses?|sections?|chapters?|annex(?:ure)?s?|items?)\b[^.\n]{0,40}\b(?:of|in|from)\b"
MESSENGER = r"(?i)\b(?:communicated|notified|announced|conveyed|advised)\s+(?:vide|in|through|by)\s+(?:the\s+)?(?:circular|notification|press\s+release)?\s*(?:no\.?)?\s*$"
DATED = r"^\W{0,3}(?:dated|issued on|of)?\s*((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}|\d{2}[./]\d{2}[./]\d{4})"


def statements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, relation, scope, target, dated, quote: every sentence that names other documents and says what it does to them.

    A document's own numbers (of its head) are no target, nor is a number that only announced the change; of numbers printed side by side the
    first is the target. scope: PARTIAL where a part is named before the number. dated: the date printed right after the numbers.
    """
    rows = docs.select(key, text, header_facts(F.col(text)).alias("facts")).select(key, F.col("facts.numbers").alias("own"), F.posexplode(T.sentences(F.col(text))).alias("place", "quote"))
    low, relation = F.lower("quote"), F.lit(None).cast("string")
    for name, pattern in reversed(RELATIONS):
        relation = F.when(low.rlike(pattern), name).otherwise(relation)
    rows = rows.withColumn("relation", relation).filter(F.col("relation").isNotNull() & F.col("quote").rlike(_NUMBER))
    groups, between = F.regexp_extract_all("quote", F.lit(_GROUP), F.lit(0)), F.split("quote", _GROUP)
    each = F.transform(groups, lambda g, i: F.struct(T.department_reference(F.regexp_extract(g, _NUMBER, 0)).alias("target"), F.get(between, i).alias("before"), F.get(between, i + 1).alias("after")))
    rows = rows.select(key, "own", "place", "relation", "quote", F.explode(each).alias("g")).filter(~F.array_contains("own", F.col("g.target")) & ~F.col("g.before").rlike(MESSENGER))
    part = F.when(F.substring("g.before", -120, 120).rlike(PART), "PARTIAL").otherwise("WHOLE")
    dated = F.when(F.col("g.after").rlike(DATED), T.parse_date(F.regexp_extract("g.after", DATED, 1)))
    first = rows.select(key, "place", "relation", part.alias("scope"), F.col("g.target").alias("target"), dated.alias("dated"), "quote")
    return first.dropDuplicates([key, "place", "relation", "scope", "target", "dated"])


def references_within(passages: DataFrame) -> DataFrame:
    """source, target: a row for each time a passage names another numbered paragraph of its document that exists.

    ``passages``: chunk_id, document_id, document_title, paragraph_ref, chunk_index, text. The first passage with a number answers to it.
    An amendment's paragraph numbers are those of the document it amends, so amendments are left out.
    """
    first = passages.groupBy("document_id", F.col("paragraph_ref").alias("label")).agg(F.min_by("chunk_id", F.struct("chunk_index", "chunk_id")).alias("target"))
    own = passages.filter(~F.coalesce(F.lower("document_title").rlike(r"\bamendment\b"), F.lit(False)))
    return S.paragraph_references(own).join(first, ["document_id", "label"]).filter("target <> chunk_id").select(F.col("chunk_id").alias("source"), "target")


def references_across(passages: DataFrame, register: DataFrame) -> DataFrame:
    """source, target: a row for each time a passage prints a number of another registered document (the first by id that bears it).

    ``register``: id, numbers (comparable keys).
    """
    bearer = register.select("id", F.explode("numbers").alias("number")).groupBy("number").agg(F.min("id").alias("target"))
    named = passages.select("chunk_id", F.lower(F.trim("document_id")).alias("own"), F.explode(S.references(F.col("text"))).alias("number"))
    return named.join(bearer, "number").filter(~F.col("target").eqNullSafe(F.col("own"))).select(F.col("chunk_id").alias("source"), "target")


def proposals(stated: DataFrame, key: str, register: DataFrame) -> DataFrame:
    """Links to propose: statements whose target is the printed number of registered documents, with how many it fits.

    ``register``: id, numbers (comparable keys). link_id depends on relation, ends and method only, so a repeated run proposes the same links.
    """
    numbers = register.select(F.col("id").alias("old_id"), F.explode("numbers").alias("target")).distinct()
    fits = numbers.groupBy("target").agg(F.count(F.lit(1)).alias("n_matched"), F.min("old_id").alias("old_id"))
    rows = stated.groupBy(key, "relation", "target").agg(F.min("place").alias("place")).join(fits, "target")
    return rows.withColumn("link_id", T.stable_id("link_", 20, F.col("relation"), F.col("old_id"), F.col(key).cast("string"), F.lit("sentence"), sep="|"))


def in_force_periods(documents: DataFrame, successors: DataFrame, removals: DataFrame) -> DataFrame:
    """Each document's period with the earliest of its ends: its own, its successor's start, its removal. ``ended_by`` says which.

    ``documents``: id, starts, ends; ``successors``: id, at; ``removals``: id, at. Ends only ever move earlier.
    """
    s = successors.groupBy("id").agg(F.min("at").alias("replaced_at"))
    r = removals.groupBy("id").agg(F.min("at").alias("removed_at"))
    rows = documents.join(s, "id", "left").join(r, "id", "left")
    end = F.least("ends", "replaced_at", "removed_at")
    why = F.when(end.isNull(), "open").when(end == F.col("replaced_at"), "successor").when(end == F.col("removed_at"), "removal").otherwise("own end")
    return rows.select("id", "starts", end.alias("ends"), why.alias("ended_by"))


def candidate_successors(documents: DataFrame) -> DataFrame:
    """For every document that no longer rules the most similar later one of its department: old_id, new_id, shared.

    ``documents``: id, department, issued, title, retired. Documents of a department with the same title words are one class; classes, not
    documents, meet on their words, and of a class the first document after a day is looked up in the order of days.
    """
    docs = documents.filter("department is not null and issued is not null").select("id", "department", F.col("issued").alias("day"), "retired", F.array_sort(T.keywords(F.col("title"))).alias("ws")).filter("size(ws) > 0")
    docs = docs.withColumn("class", F.sha2(F.concat_ws("|", "department", F.array_join("ws", " ")), 256))
    words = docs.groupBy("class", "retired").agg(F.any_value("department").alias("department"), F.any_value("ws").alias("ws")).select("class", "retired", "department", F.explode("ws").alias("w"))
    old = words.filter("retired").select(F.col("class").alias("old_class"), "department", "w")
    new = words.filter("not retired").select("class", "department", "w")
    pairs = old.join(new, ["department", "w"]).groupBy("old_class", "class").agg(F.count(F.lit(1)).alias("shared"))
    asked = docs.filter("retired").select(F.col("class").alias("old_class"), "day").distinct().join(pairs, "old_class").select("class", "day", F.lit(0).alias("kind"), "old_class", "shared", F.lit(None).cast("string").alias("new_id"))
    there = docs.filter("not retired").groupBy("class", "day").agg(F.min("id").alias("new_id")).select("class", "day", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("old_class"), F.lit(None).cast("long").alias("shared"), "new_id")
    # from the last day back: what was seen last before a question is the first document after its day
    back = Window.partitionBy("class").orderBy(F.desc("day"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("kind") == 1, F.struct(F.col("day").alias("new_day"), "new_id")), ignorenulls=True).over(back)
    rows = asked.unionByName(there).withColumn("n", found).filter("kind = 0 and n is not null")
    best = rows.groupBy("old_class", "day").agg(F.min(F.struct((-F.col("shared")).alias("less"), F.col("n.new_day").alias("new_day"), F.col("n.new_id").alias("new_id"))).alias("b"))
    own = docs.filter("retired").select(F.col("id").alias("old_id"), F.col("class").alias("old_class"), "day")
    return own.join(best, ["old_class", "day"]).select("old_id", F.col("b.new_id").alias("new_id"), (-F.col("b.less")).alias("shared"))


def quotes_found(links: DataFrame, passages: DataFrame, least: int = 12) -> DataFrame:
    """link_id and whether its quote (of ``least`` characters or more) stands in a passage of its document. links: link_id, id, quote; passages: id, text."""
    q = links.filter(F.length(F.trim("quote")) >= least).select("link_id", "id", T.normalise(F.col("quote")).alias("q")).distinct()
    p = passages.select("id", T.normalise(F.col("text")).alias("t"))
    return q.join(p, "id", "left").groupBy("link_id").agg(F.coalesce(F.bool_or(F.contains("t", "q")), F.lit(False)).alias("found"))


def mentions(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """key, entity: whole phrases of an alias table (entity, alias) in texts, of any number of words.

    Texts and aliases meet on the alias's longest word; only then the phrase is looked for.
    """
    names = aliases.select("entity", T.canonical_name(F.col("alias")).alias("alias")).filter("alias <> ''").distinct()
    names = names.withColumn("word", F.array_max(F.transform(F.split("alias", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    rows = texts.select(key, T.canonical_name(F.col(text)).alias("t")).withColumn("word", F.explode(F.array_distinct(F.split("t", " "))))
    space = F.lit(" ")
    found = rows.join(bounded(names, MOST_ALIASES), "word").filter(F.contains(F.concat(space, "t", space), F.concat(space, "alias", space)))
    return found.select(key, "entity").distinct()


def one_setting_apart(rungs: list[dict]) -> bool:
    """Whether every configuration of an experiment differs from the one before in exactly one setting."""
    return all(sum(a.get(k) != b.get(k) for k in a.keys() | b.keys()) == 1 for a, b in zip(rungs, rungs[1:]))
