"""Set-valued records: canonical sets and numpy kernels over list columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import name_key

#: Spellings of names that travel to the tasks; with more of them sets keep their names.
SPELLINGS = 1_000_000


def canonical_set(col: Column) -> Column:
    """Sorted distinct name keys of an array; null and blank elements are no members, a null array is empty."""
    keys = F.transform(F.coalesce(col, F.array().cast("array<string>")), name_key)
    return F.array_sort(F.array_distinct(F.filter(keys, lambda x: x.isNotNull() & (x != ""))))


def record_sets(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, items): one row per non-null key; repeated rows count once (of differing rows the smallest set)."""
    d = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), canonical_set(F.col(values)).alias("items"))
    return d.groupBy("key").agg(F.min("items").alias("items"))


def _places(raws: list[str], place: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(raws, pa.string())
        for b in batches:
            column = b.column("values")
            off = column.offsets.to_numpy()
            values, off = column.values.slice(off[0], off[-1] - off[0]), off - off[0]
            at = pc.index_in(values.cast(pa.string()), value_set=known).fill_null(len(raws)).to_numpy()
            row, at = np.repeat(np.arange(b.num_rows), np.diff(off)), place[at]
            both = np.unique((row * len(place) + at)[at >= 0])
            ends = np.searchsorted(both // len(place), np.arange(b.num_rows + 1)).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(ends), pa.array((both % len(place)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("key"), items], names=["key", "items"])

    return run


def coded_sets(df: DataFrame, key: str, values: str) -> tuple[DataFrame, list[str] | None, np.ndarray | None]:
    """``record_sets`` with each item as its place among the sorted names; the names and their hashes (xxhash64).

    Names are normalised once per spelling, and a shuffled set takes a few bytes an item instead of its text. Places
    keep the order of names. With more than SPELLINGS spellings the sets hold names, and the others are None.
    """
    spelt = df.select(F.explode(values).alias("raw")).where("raw is not null").distinct().select("raw", name_key(F.col("raw")).alias("name")).where("name <> ''")
    found = spelt.select("raw", "name", F.xxhash64("name").alias("h")).limit(SPELLINGS + 1).collect()
    if len(found) > SPELLINGS:
        return record_sets(df, key, values), None, None
    hashes = {r["name"]: r["h"] for r in found}
    names = sorted(hashes, key=lambda x: x.encode())
    at = {n: i for i, n in enumerate(names)}
    place = np.array([*(at[r["name"]] for r in found), -1], dtype=np.int64)  # the last is for blanks
    d = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(values, F.array().cast("array<string>")).alias("values"))
    d = d.mapInArrow(_places([r["raw"] for r in found], place), f"key {dict(d.dtypes)['key']}, items array<int>")
    return d.groupBy("key").agg(F.min("items").alias("items")), names, np.array([hashes[n] for n in names], dtype=np.int64)


def lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column of a batch, starting at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of n hash functions on 64-bit values."""
    r = np.random.default_rng(seed)
    return r.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def mix(v: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values, so that all upper bits depend on all input bits."""
    v = v ^ (v >> np.uint64(31))
    v = v * np.uint64(0x9E3779B97F4A7C15)
    return v ^ (v >> np.uint64(29))
