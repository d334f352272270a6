"""Items that appear together far more often than chance, with blocking of large baskets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable, shuffled

#: A basket with more items is split into chunks of about half as many, whose pairs are spread over tasks.
CHUNK = 24


def _numbered(baskets: DataFrame, basket: list[str], item: str, normalise: Callable[[Column], Column] | None) -> tuple[DataFrame, DataFrame]:
    """Distinct (k0.., i) of baskets and item numbers, and the names (i, name) of the numbers.

    Spellings are normalised once each and not once per row. Numbers are drawn once and stored, so they are stable.
    """
    rows = baskets.select(*[F.col(c).alias(f"k{n}") for n, c in enumerate(basket)], F.col(item).alias("raw")).dropna()
    spelt = rows.select("raw").distinct()
    spelt = durable(spelt.select("raw", (normalise(F.col("raw")) if normalise else F.col("raw")).alias("name")).where("name <> ''"))
    names = durable(spelt.select("name").distinct().select("name", F.monotonically_increasing_id().alias("i")))
    number = durable(spelt.join(names, "name").select("raw", "i"))  # joined by its true size: sent to all tasks only if small
    return durable(rows.join(number, "raw").drop("raw").distinct()), names


def cooccurring(
    baskets: DataFrame, basket: list[str], item: str, min_count: int = 5, min_share: int = 500, min_lift: float = 6.0, chunk: int = CHUNK, normalise: Callable[[Column], Column] | None = None
) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, pmi), item_a < item_b, for pairs with n_ab >= min_count,
    n_ab * min_share >= n and n_ab * n >= min_lift * n_a * n_b; n is the number of baskets.

    ``baskets``: one row per basket and item, repetitions count once; rows with a null in item or basket are ignored,
    as is item ''. ``normalise`` makes one name of the spellings of an item. Items that cannot reach the pair minimum
    alone are dropped before pairing, which loses no pair; at most min_share times the mean basket size of items remain.
    Ordinary baskets form their pairs in place; a basket of more than ``chunk`` remaining items is split by item hash
    into chunks, and each pair of its chunks is a row of its own, so no task forms all pairs of a huge basket.
    """
    k = [f"k{n}" for n in range(len(basket))]
    d, names = _numbered(baskets, basket, item, normalise)
    n = int(d.select(*k).distinct().count())
    least = max(min_count, -(-n // min_share))
    freq = durable(d.groupBy("i").agg(F.count(F.lit(1)).alias("n_i")).where(F.col("n_i") >= least))
    d = d.join(freq.select("i"), "i").select(*k, "i")
    huge = d.groupBy(*k).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > chunk)
    d = d.join(shuffled(huge.select(*k, F.ceil(F.col("size") / (chunk / 2)).cast("int").alias("chunks"))), k, "left")
    d = d.withColumn("chunk", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("i"), F.col("chunks"))).cast("int"))
    packed = durable(d.groupBy(*k, "chunk").agg(F.array_sort(F.collect_list("i")).alias("items")))
    # Pairs inside a list: each item with the ones behind it.
    inside = packed.select(F.posexplode("items").alias("p", "a"), "items").select("a", F.explode(F.slice("items", F.col("p") + 2, F.size("items"))).alias("b"))
    # Pairs across two chunks of one huge basket; the chunk pairs are spread by a repartition.
    big = packed.where("chunk is not null")
    other = big.select(*k, F.col("chunk").alias("chunk2"), F.col("items").alias("items2"))
    across = big.join(shuffled(other), k).where("chunk < chunk2").select("items", "items2", F.xxhash64(*k, "chunk", "chunk2").alias("h")).repartition("h")
    across = across.select(F.explode("items").alias("x"), "items2").select("x", F.explode("items2").alias("y"))
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = inside.unionByName(across).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") >= least)
    known = durable(freq.join(names, "i"))
    for x in ("a", "b"):
        pairs = pairs.join(known.select(F.col("i").alias(x), F.struct("name", "n_i").alias(f"{x}_")), x)
    first, second = F.least("a_", "b_"), F.greatest("a_", "b_")
    r = pairs.select(first["name"].alias("item_a"), second["name"].alias("item_b"), "n_ab", first["n_i"].alias("n_a"), second["n_i"].alias("n_b"), F.lit(n).cast("long").alias("n"))
    num = F.col("n_ab").cast("double") * F.col("n")
    den = F.col("n_a").cast("double") * F.col("n_b")
    r = r.where(num >= min_lift * den).withColumn("lift", num / den)
    return r.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", "lift", F.log("lift").alias("pmi"))
