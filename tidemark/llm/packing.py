"""Filling fixed-capacity windows with texts, by conflict-constrained best fit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable

#: Vocabulary of the public tokenizer (ranks) and the pattern that splits a text before merging; fixed values.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: One packing task takes at most about so many tokens and so many pieces.
GROUP_TOKENS, GROUP_PIECES = 4_000_000, 20_000
#: Share of a bin that may stay empty for the sake of its sources.
LOOSE = 0.02
#: Words whose token number a worker remembers; beyond, it forgets all and starts again.
REMEMBER = 1_000_000


def token_counter(vocabulary: str | bytes, pattern: str = PATTERN):
    """Function from text to its number of tokens; ``vocabulary`` is the ranks file or its content. Merges never cross
    the pattern's pieces, so the number is the sum over the pieces, and the numbers of pieces seen before are remembered."""
    import regex
    import tiktoken

    if isinstance(vocabulary, str):
        with open(vocabulary, "rb") as f:
            vocabulary = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    find = regex.compile(pattern).findall

    class Known(dict):
        def __missing__(self, piece: str) -> int:
            if len(self) > REMEMBER:
                self.clear()
            self[piece] = n = len(encode(piece))
            return n

    known = Known()

    def count(text: str) -> int:
        return sum(map(known.__getitem__, find(text)))

    return count


def _count(vocabulary, pattern: str):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(vocabulary.value, pattern)
        for p in pdfs:
            yield pd.DataFrame({"doc": p["doc"], "source": p["source"], "cluster": p["cluster"], "tokens": np.fromiter((count(t) for t in p["text"]), dtype=np.int64, count=len(p))})

    return run


class Bins:
    """Open bins in order of their residual, each with a bitmap of the sources and of the duplicate clusters in it."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by residual
        self.filled = 0  # bit r: some bin has residual r
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def tightest(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        """(residual, place) of the tightest bin with room for ``size`` that has neither the source nor the cluster.

        From successor to successor among the residuals in use, until a bin is compatible.
        """
        left = self.filled >> size
        r = size - 1
        while left:
            step = (left & -left).bit_length()
            r += step
            left >>= step
            for k, b in enumerate(self.at[r]):
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    return r, k
        return None

    def put(self, size: int, source: int, cluster: int) -> int:
        where = self.tightest(size, source, cluster)
        if where is None:
            b, r = len(self.sources), self.capacity
            self.sources.append(source)
            self.clusters.append(cluster)
        else:
            r, k = where
            bins = self.at[r]
            b, bins[k] = bins[k], bins[-1]
            bins.pop()
            if not bins:
                self.filled &= ~(1 << r)
            self.sources[b] |= source
            self.clusters[b] |= cluster
        if r > size:
            self.at[r - size].append(b)
            self.filled |= 1 << (r - size)
        return b


def _fit(sizes: np.ndarray, sid: np.ndarray, parts: np.ndarray, cluster_bits: list[int], capacity: int) -> np.ndarray:
    """Bin of each piece, largest first; the pieces of source s are dealt out in turn to its ``parts`` bits."""
    bins, out = Bins(capacity), np.empty(len(sizes), np.int64)
    first, turn, parts = (np.cumsum(parts) - parts).tolist(), [0] * len(parts), parts.tolist()
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    for i, size, s in zip(order.tolist(), sizes[order].tolist(), sid[order].tolist()):
        out[i] = bins.put(size, 1 << (first[s] + turn[s] % parts[s]), cluster_bits[i])
        turn[s] += 1
    return out


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece. Pieces come largest first; each goes to the tightest bin that holds neither its source nor
    a copy of it, else to a new bin.

    A source with more pieces than bins are needed at least can't have each in a bin of its own without waste: it is
    dealt out in turn to so many parts (pieces over bins, rounded up) that each part can, and a bin holds at most one
    piece of each part. All other sources are one part. Bins that stay emptier than ``LOOSE`` allows because of this
    (those of small pieces, of which many fit in a bin) are packed again with twice as many parts, and so on, as
    long as that saves bins. Copies never share a bin.
    """
    n = len(sizes)
    if not n:
        return np.empty(0, np.int64)
    _, sid = np.unique(sources, return_inverse=True)
    _, cid, many = np.unique(clusters, return_inverse=True, return_counts=True)
    slot = (np.cumsum(many > 1) - 1).tolist()
    bits = [1 << slot[c] if m > 1 else 0 for c, m in zip(cid.tolist(), many[cid].tolist())]
    least = -(-int(sizes.sum()) // capacity)
    parts = -(-np.bincount(sid) // max(1, least))
    out = _fit(sizes, sid, parts, bits, capacity)
    while parts.max() < n:
        parts = parts * 2
        load = np.bincount(out, weights=sizes)
        again = np.flatnonzero(load[out] < capacity * (1 - LOOSE))
        before = len(np.unique(out[again]))
        if before <= -(-int(sizes[again].sum()) // capacity):
            break
        new = _fit(sizes[again], sid[again], parts, [bits[i] for i in again.tolist()], capacity)
        if new.max() + 1 < before:
            out[again] = out.max() + 1 + new
    return np.unique(out, return_inverse=True)[1]


def _pack(capacity: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["doc", "piece"], kind="stable").reset_index(drop=True)
        b = best_fit(p["tokens"].to_numpy(), p["source_h"].to_numpy(), p["cluster"].to_numpy(), capacity)
        return pd.DataFrame({"doc": p["doc"], "piece": p["piece"], "tokens": p["tokens"], "source_h": p["source_h"], "cluster": p["cluster"], "window": "g" + p["group"].astype(str) + "-" + pd.Series(b).astype(str)})

    return run


def pack(docs: DataFrame, doc: str, text: str, source: str, capacity: int = 2048, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc, piece, start, tokens, source_h, cluster, window): every text in windows of ``capacity`` tokens.

    Texts longer than a window are cut, and only these: pieces 0.. of exactly ``capacity`` tokens, each a window of
    its own, and the rest; start is the token where the piece begins. The other pieces are packed by best fit, in
    groups of bounded size by a hash of the document; a group wastes at most its last windows. Copies of one text
    (equal apart from outer blanks) never share a window; source_h and cluster are hashes of source and text. Nor do
    pieces of one source, unless a source has more pieces than windows are needed or windows would stay loose for
    it (see ``best_fit``). Empty and null texts take no room and give no row, null ids neither;
    of repeated ids one text is taken. ``vocabulary`` is a file where the driver runs; workers get its content.
    """
    spark = docs.sparkSession
    d = docs.where(F.col(doc).isNotNull() & (F.length(F.trim(F.col(text))) > 0))
    d = d.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.xxhash64(F.trim(F.col(text))).alias("cluster"))
    key = dict(d.dtypes)["doc"]
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    counted = d.mapInPandas(_count(ranks, pattern), f"doc {key}, source string, cluster bigint, tokens bigint")
    counted = durable(counted.groupBy("doc").agg(F.max(F.struct("tokens", "cluster", "source")).alias("x")).select("doc", "x.*"))
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((tokens - 1) div {capacity} as int)"))))
    start = F.col("piece").cast("long") * capacity
    pieces = pieces.select("doc", "piece", F.least(F.lit(capacity), F.col("tokens") - start).cast("long").alias("tokens"), F.xxhash64("source").alias("source_h"), "cluster")
    full = pieces.where(F.col("tokens") == capacity).withColumn("window", F.concat_ws("-", F.lit("d"), F.col("doc").cast("string"), F.col("piece").cast("string")))
    rest = pieces.where(F.col("tokens") < capacity)
    total, n = rest.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-int(total) // GROUP_TOKENS), -(-int(n) // GROUP_PIECES))
    rest = rest.withColumn("group", F.pmod(F.xxhash64("doc"), F.lit(groups)).cast("int"))
    packed = rest.groupBy("group").applyInPandas(_pack(capacity), f"doc {key}, piece int, tokens bigint, source_h bigint, cluster bigint, window string")
    return full.unionByName(packed).select("doc", "piece", start.alias("start"), "tokens", "source_h", "cluster", "window")
