"""Which words are people's names: a list of common given names, and a small classifier of surnames fitted on the corpus itself.

Titles and common given names label the words that follow them; the other words of the same documents are the counter-examples. A
logistic regression on hashed letter groups learns from these what surnames look like there, so that they are also known behind
initials, in lower case and before the given name. It is fitted on a bounded sample of documents, has a fixed size, and is broadcast.

Defined results: without a fit (or from documents without names) only given names of the list, followed by a capitalised word that is no
common word, make a name; nulls and empty texts teach nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common given names of many countries, titles, and words that make a firm or a place of what stands before them. All are parameters.
GIVEN = (
    "ahmed aisha alan alejandro alexander ali alice amir amina amit ana andrea andrei andrew anika anil anita anna anne antonio arjun asha barbara ben bruno carlos carmen "
    "catherine charles chen chloe christina clara claire daniel david deepak dev diego dmitri edward elena elizabeth emily emma eric erik eva farah fatima felix fernando "
    "francesca francisco frank gabriel george giovanni greta hana hans hassan helen henry hugo ibrahim igor ines ingrid isabel ivan ivo jack jacob james jan jane javier "
    "jennifer joan john jose joseph juan julia juno karim karl kavya kenji klaus lars laura leila li liam linda lisa lucas lucia luis maria marie mario mark marta martin mary mateo "
    "matthew mei michael miguel mina mohammed monica nadia nina noel oliver olga omar oscar pablo patricia paul pavel pedro peter petra pierre priya rachel rafael rahul "
    "raj richard robert rosa ruth sam samuel sana sara sergei sofia sonja stefan susan tilda thomas tomas uma viktor wanda wei william xenia yuki yusuf zara zoe"
).split()
TITLES = "mr mrs ms dr prof herr frau madame monsieur mme señora señor don doña".split()
FIRMS = (
    "mills committee leasing finance bank ltd limited inc llp plc group partners fund trust holdings foundation street road lane avenue square hill bridge act board agency "
    "company corporation council court office report university industries services insurance department ministry"
).split()
NO_SURNAMES = frozenset(FIRMS + "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday and or the said".split())

SPACES = "   "
SP = rf"[{SPACES}]"
CAP = r"[^\W\d_a-z][^\W\d_]+"
#: Documents and different words that the classifier is fitted on.
SAMPLE_DOCS, SAMPLE_WORDS = 10_000, 60_000
SLOTS, ROUNDS = 1 << 16, 60
SEED = 11


def _features(word: str) -> np.ndarray:
    w = f"^{word}$"
    return np.unique([zlib.crc32(w[i : i + n].encode()) % SLOTS for n in (2, 3, 4, 5, 6) for i in range(len(w) - n + 1)] or [0])


class NameModel:
    """Given names, words that are none, and the weights of the surname classifier."""

    def __init__(self, given=tuple(GIVEN), weights: np.ndarray | None = None, bias: float = -1.0, common: frozenset = frozenset()) -> None:
        self.given, self.weights, self.bias, self.common = frozenset(given), weights, bias, common
        self.score = lru_cache(maxsize=1_000_000)(self._score)

    def __reduce__(self):
        return NameModel, (tuple(self.given), self.weights, self.bias, self.common)

    def _score(self, word: str) -> float:
        if self.weights is None or word in NO_SURNAMES or len(word) < 2:
            return -9.0
        f = _features(word)
        return float(self.weights[f].sum() / np.sqrt(len(f)) + self.bias)

    def surname(self, word: str, after_given: bool) -> bool:
        """``word`` as it is written; each part of a double name must be one. After a listed given name a capitalised word that is no common word is enough."""
        parts = [p for p in re.split("[-'’]", word) if len(p) > 1] or [word]
        if all(self.score(p.lower()) > 0 for p in parts):
            return True
        return after_given and word[0].isupper() and all(p.lower() not in self.common and p.lower() not in NO_SURNAMES for p in parts)


@lru_cache(maxsize=4)
def _patterns(given: tuple[str, ...], titles: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    # given names by a short look ahead for a capital, then a set lookup
    titled = re.compile(rf"(?<!\w)(?:{'|'.join(t.capitalize() for t in titles)})\.?{SP}({CAP}|[A-Z]\.){SP}(?:[A-Z]\.{SP})?({CAP})(?:-({CAP}))?")
    pair = re.compile(rf"(?<![\w@.-])({CAP}){SP}(?:[A-Z]\.{SP})?(?=({CAP})(?:-({CAP}))?)")
    turned = re.compile(rf"(?<![\w@.-])({CAP}),{SP}({CAP})(?!\w)")
    return titled, pair, turned


def _seen(batches: Iterator[pd.DataFrame], given: tuple[str, ...], titles: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """Per word how often it stood as given name after a title, as surname, in lower case, and in all."""
    titled, pair, turned = _patterns(given, titles)
    known, word = frozenset(given), re.compile(r"[^\W\d_]{2,}")
    counts: dict[str, Counter] = {k: Counter() for k in ("given", "surname", "low", "every")}
    for b in batches:
        for t in b["text"]:
            for m in titled.finditer(t):
                if m[1][1] != ".":
                    counts["given"][m[1].lower()] += 1
                counts["surname"].update(x.lower() for x in m.groups()[1:] if x)
            for m in pair.finditer(t):
                if m[1].lower() in known:
                    counts["surname"].update(x.lower() for x in m.groups()[1:] if x)
            for m in turned.finditer(t):
                if m[2].lower() in known:
                    counts["surname"][m[1].lower()] += 1
            for w in word.findall(t):
                low = w.lower()
                counts["every"][low] += 1
                if w == low:
                    counts["low"][low] += 1
    rows = [(w, counts["given"][w], counts["surname"][w], counts["low"][w], n) for w, n in counts["every"].items()]
    yield pd.DataFrame(rows, columns=["word", "given", "surname", "low", "every"])


def fit(words: pd.DataFrame, given=tuple(GIVEN)) -> NameModel:
    """``words``: word, given, surname, low, every (counts). Full-batch gradient steps, so equal input gives an equal model."""
    names = words[(words["surname"] > 0) & (words["surname"] >= 0.2 * words["every"]) & ~words["word"].isin(NO_SURNAMES)]
    others = words[(words["surname"] == 0) | (words["surname"] < 0.02 * words["every"])]
    found = words[(words["given"] > 1) & (words["given"] >= 0.02 * words["every"]) & (words["low"] < 0.5 * words["every"]) & ~words["word"].isin(NO_SURNAMES)]["word"]
    common = frozenset(words[(words["low"] > 0.5 * words["every"])]["word"])
    given = tuple(sorted({*given, *found} - set(names["word"])))
    if names.empty or others.empty:
        return NameModel(given, common=common)
    x = [_features(w) for w in [*names["word"], *others["word"]]]
    y = np.r_[np.ones(len(names)), np.zeros(len(others))]
    each = np.where(y == 1, len(y) / (2 * len(names)), len(y) / (2 * len(others)))
    row, col = np.repeat(np.arange(len(x)), [len(f) for f in x]), np.concatenate(x)
    scale = 1 / np.sqrt(np.array([len(f) for f in x]))
    weights, bias, square = np.zeros(SLOTS), 0.0, np.full(SLOTS, 1e-6)
    for _ in range(ROUNDS):
        z = np.bincount(row, weights[col], len(x)) * scale + bias
        g = (1 / (1 + np.exp(-z)) - y) * each / len(y)
        step = np.bincount(col, (g * scale)[row], SLOTS)
        square += step * step
        weights -= 0.5 * step / np.sqrt(square)
        bias -= 2.0 * g.sum()
    return NameModel(given, weights.astype(np.float32), bias, common)


def fit_names(docs: DataFrame, given=tuple(GIVEN), titles=tuple(TITLES), sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> NameModel:
    """Fit on about ``sample_docs`` documents (by a hash of their ids); at most ``sample_words`` rows come to the driver."""
    rows = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    every = max(1, -(-docs.count() // sample_docs))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(every)) == 0)
    seen = sample.select("text").mapInPandas(lambda it: _seen(it, tuple(given), tuple(titles)), "word string, given long, surname long, low long, every long")
    sums = seen.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("given", "surname", "low", "every")])
    top = sums.orderBy((F.col("surname") + F.col("given") > 0).desc(), F.desc("every"), "word").limit(sample_words)
    return fit(top.toPandas().sort_values("word", kind="stable").reset_index(drop=True), tuple(given))
