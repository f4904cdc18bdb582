"""Splitting oversized texts at natural boundaries, by content-defined chunking.

A rolling hash over the tokens sets landmarks that depend on the words around them only. From the start of a piece the first
landmark between the least and the largest size counts (if there is none, the place with the smallest hash), and the cut goes to the
nearest natural boundary between these sizes: a paragraph, line (heading, item, table row) or sentence. So an edit moves the
cuts near it and no others. Only where no boundary lies between the sizes is the cut made at the landmark itself.

Defined results: a token is a maximal run of characters other than space, tab, line feed, carriage return and no-break space; null and
empty texts give no piece; a text within the limit is one piece without overlap; any stated token count is ignored; equal rows give equal pieces.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, LEAST, OVERLAP = 320, 96, 32
#: Tokens in the rolling window; a landmark is a hash divisible by EVERY.
WINDOW, EVERY = 12, 48
SPACE = " \t\n\r\u00a0"
TOKEN = re.compile(f"[^{SPACE}]+")
#: Words whose full stop ends no sentence.
SHORT = frozenset("no nos rs mr mrs ms dr st vs e.g i.e cf art para sec p.o ca approx etc fig bzw z.b nr art. núm sr sra m mme".split())
ENDS = re.compile(r"[.!?…][\"'”’»)\]]*$")
PARAGRAPH, LINE, SENTENCE = 3, 2, 1
PIECES = "piece_no int, n_pieces int, start_pos int, end_pos int, token_count int, overlap_tokens int, piece string"


def _boundaries(text: str, spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Places (numbers of the token after the cut) of natural boundaries, and their kinds."""
    at, kind = [], []
    for i in range(1, len(spans)):
        end, start = spans[i - 1][1], spans[i][0]
        gap = text[end:start]
        if "\n" in gap or "\r" in gap:
            at.append(i)
            kind.append(PARAGRAPH if gap.count("\n") > 1 else LINE)
        elif text[end - 1] in ".!?…\"'”’»)]":
            word = text[spans[i - 1][0] : end]
            bare = word.rstrip(".").lower()
            if ENDS.search(word) and bare not in SHORT and not (len(bare) == 1 and word.endswith(".")) and not text[start].islower():
                at.append(i)
                kind.append(SENTENCE)
    return at, kind


def _landmarks(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Rolling hash of the tokens before each place."""
    h = np.array([zlib.crc32(text[a:b].encode()) for a, b in spans], dtype=np.uint64)
    out = np.zeros(len(h) + 1, dtype=np.uint64)
    for back in range(1, WINDOW + 1):
        out[back:] = out[back:] + h[: len(h) + 1 - back] * np.uint64(pow(0x9E3779B1, back, 2**32))
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out >> np.uint64(33)


def cuts(text: str, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP) -> tuple[list[tuple[int, int]], list[int]]:
    """Token spans, and the places where pieces begin (before their overlap), the first being 0."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    if len(spans) <= limit:
        return spans, [0]
    at, kind = _boundaries(text, spans)
    marks = _landmarks(text, spans)
    starts, start = [0], 0
    while True:
        most = limit - (overlap if start else 0)
        if len(spans) - start <= most:
            return spans, starts
        lo, hi = start + least, start + most
        window = marks[lo : hi + 1]
        hits = np.flatnonzero(window % np.uint64(EVERY) == 0)
        mark = lo + int(hits[0] if len(hits) else window.argmin())
        i, j = bisect_left(at, lo), bisect_left(at, hi + 1)
        if i < j:
            start = at[min(range(i, j), key=lambda x: (abs(at[x] - mark), -kind[x], at[x]))]
        else:
            start = mark
        starts.append(start)


def _split(batches: Iterator[pd.DataFrame], limit: int, least: int, overlap: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        kept, rows = [], []
        for n, text in enumerate(b["_text"]):
            spans, starts = cuts(text, limit, least, overlap)
            for i, s in enumerate(starts):
                if not spans:
                    continue
                end = starts[i + 1] if i + 1 < len(starts) else len(spans)
                first = max(0, s - overlap) if i else s
                lo, hi = spans[first][0], spans[end - 1][1]
                kept.append(n)
                rows.append((i, len(starts), lo, hi, end - first, s - first, text[lo:hi]))
        out = b.drop(columns="_text").iloc[kept].reset_index(drop=True)
        yield pd.concat([out, pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])], axis=1)


def n_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda t: t != ""))


def split_texts(df: DataFrame, text: str, keep: list[str], limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP, only_oversized: bool = False) -> DataFrame:
    """Pieces of every text, with the columns ``keep``. Texts too short to exceed the limit never leave the JVM.

    n tokens need n characters and n - 1 between them, so only longer texts go to Python, whole.
    """
    if not 0 <= overlap < least <= limit - overlap:
        raise ValueError("need overlap < least size <= limit - overlap")
    rows = df.filter(F.length(text) > 0)
    long = F.length(text) > 2 * limit
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", " + PIECES
    parts = rows.filter(long).select(*keep, F.col(text).alias("_text")).mapInPandas(lambda it: _split(it, limit, least, overlap), schema)
    if only_oversized:
        return parts.filter("n_pieces > 1")
    bare = F.regexp_replace(F.col(text), f"^[{SPACE}]+|[{SPACE}]+$", "")
    lead = F.length(F.regexp_extract(F.col(text), f"^[{SPACE}]*", 0)).cast("int")
    short = rows.filter(~long & (F.length(bare) > 0)).select(
        *keep, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), lead.alias("start_pos"), (lead + F.length(bare)).cast("int").alias("end_pos"), n_tokens(F.col(text)).alias("token_count"), F.lit(0).alias("overlap_tokens"), bare.alias("piece")
    )
    return parts.unionByName(short)
