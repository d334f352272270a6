"""All similar pairs between set-valued records, by multi-index binary sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sets import hash_family, lists, mix
from tidemark.operators.skew import salted_join
from tidemark.session import durable, release, shuffled

#: Bits of one segment. 2**20 values keep unrelated sets apart; segments are added until the recall is met.
SEGMENT_BITS = 20
#: Records with one segment value that form a chunk; a task compares two chunks.
SEGMENT_ROWS = 20_000
#: Copies of one record per task when pairs of copies are listed.
COPY_ROWS = 2_000
#: Rows (records times segments) of one round.
ROUND_ROWS = 4_000_000
#: 64-bit words of the code compared by Hamming distance.
CODE_WORDS = 2


def calibrate(threshold: float, miss: float = 0.001, bits: int = SEGMENT_BITS, words: int = CODE_WORDS) -> tuple[int, int]:
    """(segments, radius) for pairs of Jaccard similarity ``threshold``.

    A bit of two one-bit minhash codes agrees with probability p = (1 + J) / 2. Segments are added until all of them
    differ with probability under ``miss``; the radius is the distance that a pair exceeds with probability under
    ``miss`` (normal tail).
    """
    p = (1 + threshold) / 2
    segments = math.ceil(math.log(miss) / math.log(1 - p**bits))
    n, z = 64 * words, 3.4
    return segments, min(n, math.ceil(n * (1 - p) + z * math.sqrt(n * p * (1 - p))))


def _bits(values: np.ndarray, off: np.ndarray, family: tuple[np.ndarray, np.ndarray], which: range, hashes: np.ndarray | None) -> np.ndarray:
    """One-bit minhashes (rows, which) of sets given as hashes, or as places in ``hashes``."""
    mul, add = family
    uniq, inv = np.unique(values, return_inverse=True)
    u = mix((uniq if hashes is None else hashes[uniq]).view(np.uint64))
    code = np.empty((len(off) - 1, len(which)), dtype=np.uint8)
    for k, h in enumerate(which):
        hashed = (mix(u * mul[h] + add[h]) >> np.uint64(32)).astype(np.uint32)
        code[:, k] = np.minimum.reduceat(hashed[inv], off[:-1]) & np.uint32(1)
    return code


def _codes(total: int, words: int, seed: int, hashes: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = hash_family(total, seed)
        for b in batches:
            if b.num_rows:
                packed = np.packbits(_bits(*lists(b.column("hashes")), family, range(64 * words), hashes).reshape(-1, words, 64), axis=2).view(np.int64).reshape(-1, words)
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("items"), *[pa.array(np.ascontiguousarray(packed[:, w])) for w in range(words)]], names=["rep", "items", *[f"c{w}" for w in range(words)]])

    return run


def _segments(which: range, bits: int, total: int, words: int, seed: int, hashes: np.ndarray | None, hot: dict[int, int]):
    """Rows (segment, part, side, size, c.., rep) of the segments ``which``. A hot segment has its records in ``hot`` many
    chunks; each pair of chunks is a part of its own, ``side`` tells its two chunks apart (2 where it is one chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = hash_family(total, seed)
        keys = np.array(sorted(hot), dtype=np.int64)
        chunks = np.array([hot[k] for k in sorted(hot)], dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            values, off = lists(b.column("hashes"))
            code = _bits(values, off, family, range(which.start * bits, which.stop * bits), hashes)
            seg = code.reshape(-1, len(which), bits).astype(np.int64) @ (1 << np.arange(bits)).astype(np.int64)
            seg = (seg + (np.arange(which.start, which.stop, dtype=np.int64)[None, :] << bits)).ravel()
            row = np.repeat(np.arange(b.num_rows), len(which))
            part, side = np.zeros(len(seg), dtype=np.int32), np.full(len(seg), 2, dtype=np.int8)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, seg), len(keys) - 1)
                g = np.where(keys[at] == seg, chunks[at], 1)
                chunk = (b.column("c0").to_numpy() ^ np.arange(b.num_rows)).view(np.uint64)[row] % g.astype(np.uint64)
                first = np.repeat(np.arange(len(g)), g)
                other, own = np.arange(len(first)) - np.repeat(np.cumsum(g) - g, g), chunk[first].astype(np.int64)
                part, side = (np.minimum(own, other) * g[first] + np.maximum(own, other)).astype(np.int32), (own > other).astype(np.int8)
                side[own == other] = 2
                seg, row = seg[first], row[first]
            size = np.diff(off).astype(np.int32)
            out = pa.RecordBatch.from_arrays([pa.array(seg), pa.array(part), pa.array(side), pa.array(size[row])], names=["segment", "part", "side", "size"])
            yield pa.RecordBatch.from_arrays([*out.columns, *[b.column(c).take(pa.array(row)) for c in (*[f"c{w}" for w in range(words)], "rep")]], names=[*out.schema.names, *[f"c{w}" for w in range(words)], "rep"])

    return run


def _meet(threshold: float, radius: int, words: int):
    """Pairs (x, y) of records with one (segment, part) that may be similar, from rows sorted by these."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        seg, part, side, size = (t.column(c).to_numpy() for c in ("segment", "part", "side", "size"))
        codes, rep = [t.column(f"c{w}").to_numpy().view(np.uint64) for w in range(words)], t.column("rep")
        starts = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (part[1:] != part[:-1])]))
        end = np.repeat(np.append(starts[1:], len(seg)), np.diff(np.append(starts, len(seg))))
        i, d, found, n = np.arange(len(seg)), 1, [], 0
        while len(i := i[i + d < end[i]]):
            j = i + d
            near = sum(np.bitwise_count(c[i] ^ c[j]).astype(np.int16) for c in codes) <= radius
            x, y = i[near], j[near]
            ok = (np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9) & ((side[x] != side[y]) | (side[x] == 2))
            found.append((x[ok], y[ok]))
            n, d = n + int(ok.sum()), d + 1
            if n > 500_000:
                yield from out(rep, found)
                found, n = [], 0
        if n:
            yield from out(rep, found)

    def out(rep, found) -> Iterator[pa.RecordBatch]:
        x, y = (np.concatenate(z) for z in zip(*found))
        yield from pa.table({"x": rep.take(pa.array(x)), "y": rep.take(pa.array(y))}).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for b in batches:
            kept.append(b)
            n += b.num_rows
            last = b.slice(b.num_rows - 1).to_pydict() if b.num_rows else None
            first = kept[0].slice(0, 1).to_pydict() if kept[0].num_rows else None
            if n < 100_000 or not last or not first or (last["segment"], last["part"]) == (first["segment"], first["part"]):
                continue
            t = pa.Table.from_batches(kept).combine_chunks()
            same = (t.column("segment").to_numpy() == last["segment"][0]) & (t.column("part").to_numpy() == last["part"][0])
            cut = int(np.flatnonzero(same)[0])  # the last run may go on in the next batch
            yield from pairs(t.slice(0, cut))
            kept = t.slice(cut).to_batches()
            n = t.num_rows - cut
        if n:
            yield from pairs(pa.Table.from_batches(kept).combine_chunks())

    return run


def similar_classes(sets: DataFrame, threshold: float = 0.8, miss: float = 0.001, seed: int = 17, hashes: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and all pairs of classes with Jaccard similarity >= threshold.

    ``sets``: (key, items) with sorted distinct items, keys distinct; items are names, or places in ``hashes`` (see
    ``coded_sets``). Returns ``members`` (key, rep, size) with rep the smallest key of the class, and ``pairs`` (rep_a,
    rep_b, similarity), rep_a < rep_b, similarity < 1. Empty sets are in no class and have no partner.

    Copies collapse before anything is joined, so a group of equal records costs one sketch. Sketches that share a
    code segment meet in one task; what lies beyond the calibrated radius or cannot reach the threshold by size is
    dropped there; the rest is verified on the original sets, so no reported pair is false and a true one is missed
    with probability of about ``miss`` at the threshold, less above. Segments come in rounds of about ROUND_ROWS rows
    that are made anew from the sets, so the disk holds the rows of one round and not of all. Large segment groups are
    cut into chunks, and pairs of chunks go to different tasks; no table of records or segments is broadcast.
    """
    segments, radius = calibrate(threshold, miss)
    s = durable(sets.where(F.size("items") > 0).select("key", "items", F.unhex(F.md5(F.concat_ws("\u0001", F.col("items").cast("array<string>")))).alias("h")))
    reps = s.groupBy("h").agg(F.min("key").alias("rep"), F.min(F.size("items")).alias("size"))
    members = durable(s.select("key", "h").join(shuffled(reps), "h").select("key", "rep", "size"))
    chosen = s.join(shuffled(members.where("key = rep").select("key")), "key", "left_semi").select(F.col("key").alias("rep"), "items")
    names = [f"c{w}" for w in range(CODE_WORDS)]
    kinds, words = dict(chosen.dtypes), ", ".join(f"{c} bigint" for c in names)
    hashed = F.col("items") if hashes is not None else F.transform("items", lambda x: F.xxhash64(x))
    total = max(segments * SEGMENT_BITS, 64 * CODE_WORDS)
    sketch = durable(chosen.withColumn("hashes", hashed).mapInArrow(_codes(total, CODE_WORDS, seed, hashes), f"rep {kinds['rep']}, items {kinds['items']}, {words}"))
    release(s)
    n = sketch.count()
    full = sketch.select("rep", *names, hashed.alias("hashes"))
    schema = f"segment bigint, part int, side tinyint, size int, {words}, rep {kinds['rep']}"
    rows = lambda df, which, hot: df.mapInArrow(_segments(which, SEGMENT_BITS, total, CODE_WORDS, seed, hashes, hot), schema)
    # How large a group is only decides on its chunks, so a part of the records is enough to tell.
    part = max(1, min(16, SEGMENT_ROWS // 100, n // 10_000))
    some = rows(full.where(F.pmod(F.xxhash64("rep"), F.lit(part)) == 0), range(segments), {}) if n > SEGMENT_ROWS else None
    large = some.groupBy("segment").count().where(F.col("count") * part > SEGMENT_ROWS).collect() if some is not None else []
    hot = {r["segment"]: -(-r["count"] * part // SEGMENT_ROWS) for r in large}
    step = max(1, min(segments, ROUND_ROWS // max(1, n)))
    found = []
    for low in range(0, segments, step):
        which = range(low, min(segments, low + step))
        r = rows(full, which, {k: g for k, g in hot.items() if k >> SEGMENT_BITS in which}).repartition("segment", "part").sortWithinPartitions("segment", "part")
        near = r.mapInArrow(_meet(threshold, radius, CODE_WORDS), f"x {kinds['rep']}, y {kinds['rep']}")
        found.append(durable(near.select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b")).distinct()))
    cand = found[0]
    for f in found[1:]:
        cand = cand.union(f)
    cand = durable(cand.distinct())
    release(*found)
    ia = sketch.select(F.col("rep").alias("rep_a"), F.col("items").alias("ia"))
    ib = sketch.select(F.col("rep").alias("rep_b"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    union = F.size("ia") + F.size("ib") - both
    pairs = cand.join(shuffled(ia), "rep_a").join(shuffled(ib), "rep_b").select("rep_a", "rep_b", (both / union).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    pairs = durable(pairs)
    release(cand, sketch)
    return members, pairs


def similar_pairs(sets: DataFrame, threshold: float = 0.8, hashes: np.ndarray | None = None) -> DataFrame:
    """(key_a, key_b, similarity) of all pairs of distinct records, key_a < key_b: equal sets and class pairs expanded.

    A set that n records share gives n * (n - 1) / 2 rows here; ``similarity_links`` and ``similar_classes`` do not.
    """
    members, pairs = similar_classes(sets, threshold, hashes=hashes)
    m = members.select("key", "rep")
    many = m.join(shuffled(m.groupBy("rep").count().where("count > 1").select("rep")), "rep", "left_semi")
    same = salted_join(many.select("rep", F.col("key").alias("key_a")), many.select("rep", F.col("key").alias("key_b")), ["rep"], ["key_a"], rows_per_task=COPY_ROWS)
    same = same.where("key_a < key_b").select("key_a", "key_b", F.lit(1.0).alias("similarity"))
    ma = m.select(F.col("rep").alias("rep_a"), F.col("key").alias("ka"))
    mb = m.select(F.col("rep").alias("rep_b"), F.col("key").alias("kb"))
    cross = pairs.join(shuffled(ma), "rep_a").join(shuffled(mb), "rep_b").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "similarity")
    return same.unionByName(cross)


def similarity_links(sets: DataFrame, threshold: float = 0.8, hashes: np.ndarray | None = None) -> DataFrame:
    """(key, class_key, copies, links): one row per record; links counts the other records at least that similar.

    Empty sets: no class, 0 copies, 0 links.
    """
    members, pairs = similar_classes(sets, threshold, hashes=hashes)
    n = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")).union(pairs.select("rep_b", "rep_a"))
    outer = both.join(shuffled(n.select(F.col("rep").alias("other"), F.col("copies").alias("m"))), "other").groupBy("rep").agg(F.sum("m").alias("outer"))
    per = n.join(shuffled(outer), "rep", "left").select("rep", "copies", (F.col("copies") - 1 + F.coalesce("outer", F.lit(0))).alias("links"))
    r = sets.select("key").join(shuffled(members.select("key", "rep").join(shuffled(per), "rep")), "key", "left")
    return r.select("key", F.col("rep").alias("class_key"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
