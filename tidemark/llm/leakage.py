"""Evaluation texts leaking into training texts, by a prefix-filtered join of word shingles."""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from tidemark.session import durable

#: Words of a shingle, and words in a row that make a leak.
SHINGLE, RUN = 5, 12
#: Words of one block of items; a block's index (about 60 MB) goes to all workers, and larger test sets take
#: one scan of the documents for each block.
BLOCK_WORDS = 500_000

_TAG = re.compile(r"</?[a-z][^<>]{0,200}>")
_MARK = re.compile("[̀-ͯ]+")
_OTHER = re.compile(r"[^\w\s]|_")
# Dashes between words count as a space, other typographic signs as nothing.
_SIGNS = {ord(c): " " for c in "–—―"} | {ord(c): None for c in "‘’‚‛“”„‟‐‑­​‌‍⁠﻿′″•·«»´`"}
_ASCII = bytes(32 if c < 33 or chr(c) in "/|" else c for c in range(256))
_DROP = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "/|")


def plain_words(text: str | None) -> list[str]:
    """Words of a text apart from case, punctuation, accents, markup and line breaks; null and '' have none.

    Words are what blanks separate; inside them everything but letters and digits is dropped, so "Owl's", "owls" and
    "**Owls**" are one word.
    """
    if not text:
        return []
    t = text.lower()
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "&" in t:
        t = html.unescape(t).lower()
    if not t.isascii():
        t = _MARK.sub("", unicodedata.normalize("NFKD", t))
        if not t.isascii():
            t = t.translate(_SIGNS)
            if not t.isascii():
                return _OTHER.sub("", t.replace("/", " ").replace("|", " ")).split()
    return t.encode().translate(_ASCII, _DROP).decode().split()


def _words_of(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in pdfs:
        yield p.assign(text=[plain_words(t) for t in p["text"]]).rename(columns={"text": "words"})


def own_words(items: DataFrame, item: str, text: str, shared_by: int = 3) -> DataFrame:
    """(item, words): the wording of each item without the instruction it starts with.

    The instruction is the longest run of first sentences that each stand in at least ``shared_by`` items.
    """
    s = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])\s+")).alias("p", "text"))
    s = durable(s.mapInPandas(_words_of, f"item {dict(s.dtypes)['item']}, p int, words array<string>"))
    common = s.groupBy("words").agg(F.count_distinct("item").alias("n")).where(F.col("n") >= shared_by).select("words", F.lit(True).alias("shared"))
    s = s.join(common, "words", "left")
    start = s.where("shared is null").groupBy("item").agg(F.min("p").alias("p0"))
    own = s.join(start, "item").where("p >= p0").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("p", "words"))).alias("l"))
    return own.select("item", F.flatten(F.transform("l", lambda x: x["words"])).alias("words"))


class Index:
    """Prefix shingles of a block of items, with what is needed to verify their windows in place.

    Shingles are ordered by rarity: in how many items they stand, then how many times their rarest word is used in
    the items, then by their words. Of each window of ``run`` words only the first in this order, its prefix, is
    indexed, with all the windows (item, offset) it stands for and its place in them. A document that holds a window holds its
    prefix at the same place, so any order is exact; a rare prefix is found seldom.
    """

    _P = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, texts: list[tuple[object, list[str]]], run: int, shingle: int):
        self.k, self.run = shingle, run
        uses = Counter(w for _, t in texts for w in t)
        self.number = {w: i + 1 for i, w in enumerate(uses)}
        rank = [0] + [uses[w] for w in self.number]
        self.items = [i for i, _ in texts]
        self.words = [np.array([self.number[w] for w in t], dtype=np.int64) for _, t in texts]
        parts = [[tuple(t[i : i + shingle].tolist()) for i in range(len(t) - shingle + 1)] for t in self.words]
        held = Counter(s for p in parts for s in set(p))
        order = {s: (n, min(rank[x] for x in s), s) for s, n in held.items()}
        need = run - shingle + 1
        windows: dict[tuple, list[tuple[int, int, int]]] = defaultdict(list)
        for i, p in enumerate(parts):
            for at in range(len(p) - need + 1):
                delta = min(range(need), key=lambda d: order[p[at + d]])
                windows[p[at + delta]].append((i, at, delta))
        ids = np.array(list(windows), dtype=np.int64).reshape(-1, shingle)
        key = self._key(ids)
        by = np.argsort(key, kind="stable")
        self.keys, self.ids = key[by], ids[by]
        self.windows = [windows[tuple(s)] for s in self.ids.tolist()]
        if len(np.unique(self.keys)) < len(self.keys):
            raise RuntimeError("two shingles have one key; choose another multiplier")

    def _key(self, ids: np.ndarray) -> np.ndarray:
        h = np.zeros(len(ids), dtype=np.uint64)
        for j in range(self.k):
            h = (h ^ ids[:, j].astype(np.uint64)) * self._P
            h ^= h >> np.uint64(32)
        return h

    def prefixes(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and rows of the prefix shingles of a sequence of word numbers (0: a word of no item); exact."""
        k = self.k
        if len(numbers) < k or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = np.concatenate([[0], np.cumsum(numbers > 0)])
        at = np.flatnonzero(known[k:] - known[:-k] == k)
        ids = numbers[at[:, None] + np.arange(k)]
        row = np.minimum(np.searchsorted(self.keys, self._key(ids)), len(self.keys) - 1)
        ok = (self.ids[row] == ids).all(axis=1)
        return at[ok], row[ok]

    def found(self, numbers: np.ndarray, start: int, end: int, at: np.ndarray, row: np.ndarray) -> dict[int, set[int]]:
        """Item number to offsets of its windows that stand whole in numbers[start:end], from the prefixes there."""
        out: dict[int, set[int]] = defaultdict(set)
        for pos, r in zip(at.tolist(), row.tolist()):
            for item, off, delta in self.windows[r]:
                first = pos - delta
                if first < start or first + self.run > end or off in out[item]:
                    continue  # length and position
                if (numbers[first : first + self.run] == self.words[item][off : off + self.run]).all():
                    out[item].add(off)
        return {i: o for i, o in out.items() if o}


def _longest(offsets: set[int], run: int) -> int:
    """Most words in a row that windows at these offsets of an item cover."""
    best = n = 0
    last = None
    for o in sorted(offsets):
        n = n + 1 if last is not None and o == last + 1 else 1
        best, last = max(best, n), o
    return best + run - 1


def _scan(shared, run: int, item_type: pa.DataType):
    class Numbers(dict):
        def __missing__(self, word: str) -> int:
            return 0

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(shared.value)
        number = Numbers(index.number).__getitem__
        for b in batches:
            who, start, sequence, n = [], [], [], 0
            for i, t in enumerate(b.column("text").to_pylist()):
                words = plain_words(t)
                if len(words) >= run:
                    who.append(i)
                    start.append(n)
                    sequence.append(np.fromiter(map(number, words), dtype=np.int64, count=len(words)))
                    sequence.append(np.zeros(1, np.int64))  # no window spans two documents
                    n += len(words) + 1
            if not who:
                continue
            numbers, start = np.concatenate(sequence), np.array([*start, n])
            at, row = index.prefixes(numbers)
            d = np.searchsorted(start, at, side="right") - 1
            rows = []
            for x in np.unique(d).tolist():
                mine = slice(*np.searchsorted(d, [x, x + 1]))
                for item, offsets in index.found(numbers, int(start[x]), int(start[x + 1]) - 1, at[mine], row[mine]).items():
                    rows.append((who[x], index.items[item], sorted(offsets)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc").take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], item_type), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["doc", "item", "offsets"]
                )

    return go


def _runs(pdfs: Iterator[pd.DataFrame], run: int) -> Iterator[pd.DataFrame]:
    for p in pdfs:
        offs = [set(o) for o in p["offsets"]]
        yield pd.DataFrame({"doc": p["doc"], "item": p["item"], "windows": [len(o) for o in offs], "longest": [_longest(o, run) for o in offs]})


def _leaks_of(docs: DataFrame, texts: list[tuple], item_type: str, run: int, shingle: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(Index(texts, run, shingle)))  # by value: workers need no copy of the package
    types, arrow = dict(docs.dtypes), to_arrow_type(_parse_datatype_string(item_type))
    hits = docs.mapInArrow(_scan(shared, run, arrow), f"doc {types['doc']}, item {item_type}, offsets array<int>")
    # Rows of one id are one document; hits are few, one row for each document and item.
    hits = hits.groupBy("doc", "item").agg(F.array_distinct(F.flatten(F.collect_list("offsets"))).alias("offsets"))
    return hits.mapInPandas(lambda pdfs: _runs(pdfs, run), f"doc {types['doc']}, item {item_type}, windows bigint, longest int")


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, run: int = RUN, shingle: int = SHINGLE, block: int = BLOCK_WORDS) -> DataFrame:
    """(doc, item, windows, longest): documents that hold at least ``run`` words in a row of an item's own wording.

    windows counts the item's windows of ``run`` words found (each once), longest the most words in a row.

    An item's windows are sets of shingles that a document must hold completely, so one necessary shingle is enough
    as prefix; shingles are ordered by rarity among the items and only the rarest of each window is looked for, which
    takes one scan of the documents (rarity in the corpus would take two). A hit fixes where the window must start:
    starts outside the document are dropped (length and position), and where one is left the whole window of the item
    is compared word by word where the document is read. Words are equal only if their letters are, so this is exact.

    The test set is taken in blocks of bounded size, each against all documents. Documents or items without ``run``
    words have no leak; repeated documents are all reported; null ids are ignored; equal ids count as one document.
    """
    d = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    own = durable(own_words(items, item, item_text).where(F.size("words") >= run).groupBy("item").agg(F.min("words").alias("words")))
    field = dict(own.dtypes)["item"]
    total = own.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block))
    out = None
    for b in range(blocks):
        texts = [(r["item"], r["words"]) for r in own.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item").collect()]
        if texts or out is None:
            part = _leaks_of(d, texts, field, run, shingle)
            out = part if out is None else out.unionByName(part)
    return out
