"""Evaluation texts that leaked into a corpus, found by q-gram lemma filtering.

Texts become streams of the letters and digits of any script: case, spacing, punctuation, hyphenation, note marks and tags leave no trace.
A passage of n words with at most e of them altered, dropped or added keeps all q-grams of the stream that no edit touches, and an edit
of a word of k letters touches at most k + q - 1 of them. So for each evaluation text there is a least number of q-grams that every leak
of it shares with the document; q is chosen so that this number is worth counting, and texts of very short words get a smaller q of their
own. The shared q-grams are counted in overlapping bands of diagonals (place in the document minus place in the text), which are wide
enough for the words that edits add or drop, and (document, text) pairs with a band that reaches the number are verified: an alignment of
words, banded around the diagonals of the shared word pairs, must show n >= least_words consecutive words with at most n / 5 edits.

The evaluation set is a stated query set against all documents. It is broadcast in blocks of a bounded size (one block, unless it is very
large); documents never shuffle.

Defined results: null and empty texts contain nothing; texts with fewer than least_words words can't leak; an item repeated in the set counts
once; a word is a run without white space (hyphenated words are one; digits at the end of a word count as note marks); a document is
reported once per item, however often it occurs in it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, ONE_IN = 15, 5
#: The longest q for which a text keeps at least KEEP shared q-grams is used; texts that allow COMMON_Q or more share one.
LONGEST_Q, COMMON_Q, KEEP = 12, 6, 6
#: Width of a band is twice this many letters, overlapping by half: more than the words that edits add or drop.
BAND = 96
#: Letters of the evaluation texts that are broadcast at once; a larger set takes several passes over the documents.
BLOCK_LETTERS = 20_000_000
#: Added to a diagonal so that it is never negative.
OFFSET = 1 << 24
HASH_BITS = 22

MARKS = re.compile(r"\[\^?[^\[\]\n]{0,16}\]|</?[A-Za-z][^<>\n]{0,60}>|[¹²³⁰-⁹₀-₉†‡]")
HYPHENS = re.compile(r"[-­‐-‒]\s*\n\s*|[-­​-‍‐-―﻿]")
WORD = re.compile(r"[^\W_]+")
#: What the ASCII form of a decomposed text would lose: other letters, and white space that parts words.
OTHER = re.compile("[^\\W\x00-\x7f]|[\x85\u1680\u2028\u2029]")
SPACES = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ENTITIES = {"&amp;": " ", "&nbsp;": " ", "&quot;": " ", "&#39;": "", "&shy;": "", "&lt;": " ", "&gt;": " "}


def _plain(t: str) -> str:
    """Without note marks, tags and hyphenation; letters with marks as their base letters."""
    if "&" in t:
        for a, b in ENTITIES.items():
            t = t.replace(a, b)
    if not t.isascii() or "[" in t or "<" in t:
        t = MARKS.sub(" ", t)
    if "-" in t or not t.isascii():
        t = HYPHENS.sub("", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t.lower())
        if not t.isascii() and not OTHER.search(t):
            t = t.encode("ascii", "ignore").decode()
    return t


@lru_cache(maxsize=1)
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Per code point of the basic plane its lower-case form (0 for what leaves no trace), and whether it is white space."""
    fold = np.zeros(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        x = chr(c)
        if x.isalnum():
            low = x.lower()
            fold[c] = ord(low[0])
    space = np.zeros(0x10000, dtype=bool)
    space[[ord(x) for x in SPACES]] = True
    return fold, space


def stream_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of some texts one after the other, and where each text's end. Digits count in words that begin with one only."""
    plain = [_plain(t) for t in texts]
    sizes = np.cumsum([len(t) + 1 for t in plain])
    whole = "\n".join([*plain, ""])
    fold, space = _symbols()
    if whole.isascii():
        low = np.frombuffer(whole.encode(), dtype=np.uint8)
        x = fold[:128].astype(np.uint8)[low]
    else:
        c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low = np.minimum(c, 0xFFFF)
        x = np.where(c < 0x10000, fold[low], c)  # beyond the basic plane letters have no case that matters here
        far = np.unique(c[c >= 0x10000])
        x[np.isin(c, far[[not chr(f).isalnum() for f in far]])] = 0
    digit = (x >= 48) & (x <= 57)
    if digit.any():
        at = np.arange(len(x))
        begin = np.maximum.accumulate(np.where(space[low], at, -1))  # the white space before
        counted = np.flatnonzero(x > 0)
        first = np.full(len(x) + 1, len(x))
        first[begin[counted[::-1]] + 1] = counted[::-1]  # the first symbol of each word, by where the word begins
        x = np.where(digit & ~digit[np.minimum(first[begin + 1], len(x) - 1)], 0, x)
    kept = x > 0
    return x[kept], np.cumsum(kept)[sizes - 1]


def words(t: str) -> list[str]:
    """Words of letters and digits; digits at the end of a word that begins with a letter are note marks and not part of it."""
    t = _plain(t).lower().replace("'", "").replace("’", "")
    out = []
    for w in t.split():
        w = "".join(WORD.findall(w))
        if w and not "0" <= w[0] <= "9":
            w = w.rstrip("0123456789") or w
        if w:
            out.append(w)
    return out


def _whole(lengths: list[int], least: int) -> list[tuple[int, int]]:
    """(edits, letters of the words that are left when the longest are edited, at the worst place) per window size.

    Windows from ``least`` to twice as many words are enough: a longer leak has a part of such a size with as few edits.
    """
    out = []
    for n in range(least, min(2 * least, len(lengths) + 1)):
        e = n // ONE_IN
        w = np.sort(np.lib.stride_tricks.sliding_window_view(np.array(lengths), n), axis=1)
        out.append((e, int(w[:, : n - e].sum(axis=1).min())))
    return out


def _bound(whole: list[tuple[int, int]], q: int) -> int:
    """The least number of q-grams that a leak keeps: k letters and e edits leave k - (q - 1)(e + 1)."""
    return min(k - (q - 1) * (e + 1) for e, k in whole)


class Grams:
    """The q-grams of some texts (parts): where each stands, and how many of them a leak keeps."""

    def __init__(self, parts: list[int], streams: list[np.ndarray], needs: list[int], span: int, q: int) -> None:
        self.q, self.span = q, span
        self.numbers, self.need = np.array(parts, dtype=np.int64), np.array(needs, dtype=np.int64)
        grams = [self.grams(x) for x in streams]
        g = np.concatenate(grams)
        order = np.argsort(g, kind="stable")
        g = g[order]
        self.part = np.repeat(np.arange(len(grams), dtype=np.int32), [len(x) for x in grams])[order]
        self.place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in grams])[order]
        self.keys, self.first = np.unique(g, return_index=True)
        self.many = np.diff(np.append(self.first, len(g)))

    def ready(self) -> None:
        """On an executor: the bit table, which is made there and not sent."""
        self.table = np.zeros(1 << HASH_BITS, dtype=bool)
        self.table[self.slot(self.keys)] = True

    @staticmethod
    def slot(g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)

    def grams(self, s: np.ndarray) -> np.ndarray:
        """A polynomial hash of every q-gram of a stream; equal q-grams have equal hashes, so a clash can only add a candidate."""
        n = len(s) - self.q + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        shift = lambda size: np.uint64(pow(0x100000001B3, size, 1 << 64))
        # doubling: grams of 1, 2, 4, ... symbols put together
        parts, size, left = {1: s.astype(np.uint64)}, 1, self.q
        while size * 2 <= left:
            a = parts[size]
            parts[size * 2] = a[:-size] * shift(size) + a[size:]
            size *= 2
        out, at = None, 0
        for size in sorted(parts, reverse=True):
            if left & size:
                p = parts[size][at : at + n]
                out = p if out is None else out * shift(size) + p
                at += size
        return out

    def candidates(self, s: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(number of the document, part) with a band of diagonals that holds enough shared q-grams."""
        none = np.zeros((0, 2), dtype=np.int64)
        g = self.grams(s)
        at = np.flatnonzero(self.table[self.slot(g)])
        if not len(at):
            return none
        g = g[at]
        k = np.searchsorted(self.keys, g)
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == g
        at, k = at[hit], k[hit]
        if not len(at):
            return none
        doc = np.searchsorted(ends, at, side="right")
        whole = at + self.q <= ends[doc]  # not across two texts
        at, k, doc = at[whole], k[whole], doc[whole]
        # the q-grams that a leak keeps stand close together in the document
        few = int(self.need.min()) - 1
        if len(at) <= few:
            return none
        close = (at[few:] - at[: len(at) - few] <= self.span) & (doc[few:] == doc[: len(at) - few])
        near = np.zeros(len(at) + 1, dtype=np.int64)
        np.add.at(near, np.flatnonzero(close), 1)
        np.add.at(near, np.flatnonzero(close) + few + 1, -1)
        near = np.cumsum(near[:-1]) > 0
        at, k, doc = at[near], k[near], doc[near]
        if not len(at):
            return none
        n = self.many[k]
        hit = np.repeat(np.arange(len(k)), n)
        which = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        part, place = self.part[which].astype(np.int64), self.place[which].astype(np.int64)
        begin = np.append(0, ends[:-1])
        band = ((at - begin[doc])[hit] - place + OFFSET) // BAND
        pairs, pair = np.unique(doc[hit] * len(self.numbers) + part, return_inverse=True)
        key = (((pair << 19) + band) << 20) + place  # fewer than 2^24 pairs, 2^19 bands and 2^20 places
        key = np.sort(np.concatenate([key, key - (1 << 20)]))  # every band overlaps the next by half, so each hit counts in two
        key = key[np.append(True, key[1:] != key[:-1])] >> 20  # a q-gram of the item counts once
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        shared = np.diff(np.append(heads, len(key)))
        pair = pairs[key[heads] >> 19]
        pair = np.unique(pair[shared >= self.need[pair % len(self.numbers)]])
        return np.stack([pair // len(self.numbers), self.numbers[pair % len(self.numbers)]], axis=1)


class Probe:
    """The q-grams of a block of texts, and what verifies a candidate. ``texts``: (item id, text)."""

    def __init__(self, texts: list[tuple[int, str]], least: int = LEAST_WORDS) -> None:
        self.least = least
        seen, self.items, self.words = set(), [], []
        for item, t in texts:
            w = words(t)
            if len(w) >= least and (item, tuple(w)) not in seen:
                seen.add((item, tuple(w)))
                self.items.append(item)
                self.words.append(w)
        counted = lambda x: x if "0" <= x[0] <= "9" else re.sub("[0-9]", "", x)  # what the stream keeps of a word
        lengths = [[len(counted(x)) for x in w] for w in self.words]
        self.vocabulary = {x for w in self.words for x in w}
        self.double = {a + b: (a, b) for w in self.words for a, b in zip(w, w[1:])}
        ids: dict[tuple[str, str], int] = {}
        twos = [(ids.setdefault(x, len(ids)), n, i) for n, w in enumerate(self.words) for i, x in enumerate(zip(w, w[1:]))]
        t = np.array(sorted(twos), dtype=np.int64).reshape(-1, 3)
        self.two_ids, self.two_part, self.two_place = ids, t[:, 1], t[:, 2]
        self.two_many = np.bincount(t[:, 0], minlength=len(ids))
        self.two_first = np.cumsum(self.two_many) - self.two_many
        #: Of each text the longest q that leaves enough shared q-grams; 1 always does, as at most a fifth of the words is lost.
        whole = [_whole(x, least) for x in lengths]
        best = [next((q for q in range(LONGEST_Q, 1, -1) if _bound(x, q) >= KEEP), 1) for x in whole]
        common = min((q for q in best if q >= COMMON_Q), default=COMMON_Q)
        best = [min(q, common) for q in best]
        self.tables = []
        for q in sorted(set(best)):
            own = [n for n, b in enumerate(best) if b == q]
            streams = [np.array([ord(c) for x in self.words[n] for c in counted(x)], dtype=np.uint64) for n in own]
            span = max(sum(sorted(lengths[n])[-2 * least :]) for n in own) + BAND  # no leak window is longer in the document, edits included
            self.tables.append(Grams(own, streams, [max(1, _bound(whole[n], q)) for n in own], span, q))

    def ready(self) -> None:
        for t in self.tables:
            t.ready()

    def pairs(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(number of the text, number of the item's part) of candidates whose alignment holds."""
        s, ends = stream_of(texts)
        found = np.concatenate([t.candidates(s, ends) for t in self.tables])
        for d in np.unique(found[:, 0]):
            yield from ((int(d), p) for p in self.leaks(texts[d], found[found[:, 0] == d, 1]))

    def leaks(self, text: str, parts: np.ndarray) -> Iterator[int]:
        """Of the candidate parts those that an alignment confirms; it runs only where their pairs of neighbouring words stand on like diagonals."""
        doc = respaced(words(text), self.vocabulary, self.double)
        at = [(j, i) for j, x in enumerate(zip(doc, doc[1:])) if (i := self.two_ids.get(x)) is not None]
        if not at:
            return
        j, k = np.array(at).T
        n = self.two_many[k]
        which = np.repeat(self.two_first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        j, part, i = np.repeat(j, n), self.two_part[which], self.two_place[which]
        wanted = np.zeros(len(self.items), dtype=bool)
        wanted[parts] = True
        own = wanted[part]
        j, part, i = j[own], part[own], i[own]
        band = (j - i + OFFSET) // (2 * self.least // ONE_IN)  # edits move the diagonal by fewer
        key = (((part << 32) + band) << 20) + i
        order = np.argsort(np.concatenate([key, key - (1 << 20)]))
        key, i, j = np.concatenate([key, key - (1 << 20)])[order] >> 20, np.concatenate([i, i])[order], np.concatenate([j, j])[order]
        other = np.append(True, key[1:] != key[:-1])
        heads = np.flatnonzero(other)
        tails = np.append(heads[1:], len(key))
        shared = np.add.reduceat((other | np.append(True, i[1:] != i[:-1])).astype(np.int64), heads)
        sizes = [(n, n - 2 * (n // ONE_IN) - 1) for n in range(self.least, 2 * self.least)]  # pairs of neighbours that n words keep
        keep = np.flatnonzero(shared >= min(m for _, m in sizes))
        done: set[int] = set()
        for h in keep[np.argsort(-shared[keep], kind="stable")]:
            p = int(key[heads[h]] >> 32)
            if self.items[p] in done:
                continue
            own_i, own_j = i[heads[h] : tails[h]], j[heads[h] : tails[h]]
            u = own_i[np.append(True, own_i[1:] != own_i[:-1])]
            if not any(len(u) >= m and (u[m - 1 :] - u[: len(u) - m + 1]).min() <= n - 2 for n, m in sizes):
                continue
            far = 2 * self.least
            if aligned(self.words[p], doc, max(0, own_i[0] - far), own_i[-1] + far, int((own_j - own_i).min()), int((own_j - own_i).max()), self.least):
                done.add(self.items[p])
                yield p


def respaced(doc: list[str], vocabulary: set[str], double: dict[str, tuple[str, str]]) -> list[str]:
    """Words that were run together or torn apart in the document as they are in the items; ``double``: two successive words of an item, joined."""
    out, i = [], 0
    while i < len(doc):
        w = doc[i]
        if w not in vocabulary:
            if w in double:
                out += double[w]
                i += 1
                continue
            n = next((n for n in (2, 3, 4) if i + n <= len(doc) and "".join(doc[i : i + n]) in vocabulary), 1)
            out.append("".join(doc[i : i + n]))
            i += n
        else:
            out.append(w)
            i += 1
    return out


def aligned(item: list[str], doc: list[str], lo: int, hi: int, low: int, high: int, least: int = LEAST_WORDS) -> bool:
    """Whether n >= least consecutive words of item[lo:hi] stand in the document with at most n / 5 edits (n up to twice least is enough).

    The table is banded: only diagonals (place in the document minus place in the item) from ``low`` to ``high`` and as many more as edits can add.
    """
    most = (2 * least - 1) // ONE_IN
    item = item[lo:hi]
    low, width = low + lo - most, high - low + 2 * most + 1
    if len(item) < least:
        return False
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in item])
    before, after = max(0, -low), max(0, low + len(item) + width - len(doc))
    first = max(0, low)
    b = np.array([-1] * before + [ids.get(w, -1) for w in doc[first : low + len(item) + width]] + [-1] * after)
    inside = np.arange(low, low + len(b)) < len(doc)
    inside &= np.arange(low, low + len(b)) >= 0
    starts = np.arange(len(a) - least + 1)
    cols = np.arange(width + 1)
    row = np.zeros((len(starts), width + 1), dtype=np.int32)  # a window may begin on any diagonal of the band
    row[:, -1] = 1 << 20
    left = np.minimum(len(a) - starts, 2 * least - 1)
    for n in range(1, 2 * least):
        live = left >= n
        at = np.minimum(starts + n - 1, len(a) - 1)
        place = at[:, None] + cols[None, :-1]  # in b, of the word that the item's word meets on each diagonal
        place = np.minimum(place, len(b) - 1)
        wrong = (b[place] != a[at][:, None]) | ~inside[place]
        step = np.full_like(row, 1 << 20)
        np.minimum(row[:, :-1] + wrong, row[:, 1:] + 1, out=step[:, :-1])
        row = np.minimum.accumulate(step - cols, axis=1) + cols  # words added
        row[:, -1] = 1 << 20
        if n >= least and (row[:, :-1].min(axis=1)[live] <= n // ONE_IN).any():
            return True
        if n < least and row.min() > most:
            return False
    return False


def _search(batches: Iterator[pd.DataFrame], sent) -> Iterator[pd.DataFrame]:
    probe = sent.value
    probe.ready()
    for b in batches:
        rows: list[tuple[int, int]] = []
        if len(probe.items):
            ids, all_texts = b["doc_id"].tolist(), b["text"].tolist()
            for i in range(0, len(ids), 500):
                rows += [(ids[i + d], probe.items[p]) for d, p in probe.pairs(all_texts[i : i + 500])]
        yield pd.DataFrame(rows, columns=["doc_id", "item_id"])


def _blocks(parts: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The evaluation texts in blocks of at most ``most`` letters (or one text); one block at a time is on the driver."""
    block, size = [], 0
    for r in parts.toLocalIterator():
        if block and size + len(r["t"]) > most:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["t"]))
        size += len(r["t"])
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, fields: list[str], least_words: int = LEAST_WORDS, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """doc_id, item_id: the documents that hold at least ``least_words`` consecutive words of one of the item's fields."""
    spark = docs.sparkSession
    parts = items.select("item_id", F.explode(F.array(*fields)).alias("t")).filter("item_id is not null and t is not null").distinct()
    rows = docs.select("doc_id", "text").filter("doc_id is not null and length(text) > 0")
    found, passes = spark.createDataFrame([], "doc_id long, item_id long"), 0
    for block in _blocks(parts, block_letters):
        probe = Probe(block, least_words)
        if not probe.items:
            continue
        sent = spark.sparkContext.broadcast(probe)
        one = rows.mapInPandas(lambda b, sent=sent: _search(b, sent), "doc_id long, item_id long")
        found, passes = (one, 1) if passes == 0 else (found.unionByName(one), passes + 1)
    return found.distinct()
