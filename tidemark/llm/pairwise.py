"""One global ranking from pairwise comparisons, by the stationary distribution of a comparison chain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import durable

#: Up to so many items the chain is a dense matrix of one task (32 MB); above, each step is a join.
DENSE_ITEMS = 2_000
#: Steps of the joined chain between two durable states, and share of steps on which the walker stays.
STEPS, LAZY = 10, 0.1


def plan_id(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), "_", "-")


def pair_records(cells: DataFrame, cell: str, subject: Column, opponent: Column, wins: str, losses: str, context: list[str]) -> DataFrame:
    """(a, b, wins, games), a < b: results of a against b, each match-up counted once.

    A match-up may be stored from both sides: among the cells of one pair and context, a result that occurs x times
    seen from a and y times seen from b counts max(x, y) times. Repeated cells (same id) count once. Cells with null
    wins or losses, without games, of an item against itself or without ids are no evidence; negative counts neither.
    """
    d = cells.select(F.col(cell).alias("c"), subject.alias("s"), opponent.alias("o"), F.col(wins).cast("long").alias("w"), F.col(losses).cast("long").alias("l"), *[F.col(x).alias(f"x{i}") for i, x in enumerate(context)])
    d = d.where("s is not null and o is not null and s <> o and s <> '' and o <> '' and w >= 0 and l >= 0 and w + l > 0").dropDuplicates()
    first = F.col("s") < F.col("o")
    d = d.select(
        F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"), F.when(first, F.col("w")).otherwise(F.col("l")).alias("w"), (F.col("w") + F.col("l")).alias("n"), first.alias("first"), *[f"x{i}" for i in range(len(context))]
    )
    once = d.groupBy("a", "b", "w", "n", *[f"x{i}" for i in range(len(context))]).agg(F.greatest(F.count_if("first"), F.count_if(~F.col("first"))).alias("k"))
    return once.groupBy("a", "b").agg(F.sum(F.col("w") * F.col("k")).alias("wins"), F.sum(F.col("n") * F.col("k")).alias("games"))


def _chain(pairs: DataFrame, smoothing: float) -> DataFrame:
    """(i, j, rate): losses of i to j with smoothing, the chain's weight from i to the winner j."""
    w = F.col("wins") + F.lit(smoothing)
    l = F.col("games") - F.col("wins") + F.lit(smoothing)  # noqa: E741
    both = F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), l.alias("rate")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"), w.alias("rate")))
    return pairs.select(F.explode(both).alias("e")).select("e.*")


def _dense(max_rounds: int, tolerance: float):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = pd.concat(list(pdfs), ignore_index=True)
        ids = np.array(sorted(set(e["i"]) | set(e["j"])))
        i, j = np.searchsorted(ids, e["i"]), np.searchsorted(ids, e["j"])
        m = np.zeros((len(ids), len(ids)))
        np.add.at(m, (i, j), e["rate"].to_numpy())
        m = m / m.sum(axis=1, keepdims=True) * (1 - LAZY) + np.eye(len(ids)) * LAZY
        x = np.full(len(ids), 1.0 / len(ids))
        for _ in range(max_rounds):
            x, old = x @ m, x
            if np.abs(x - old).sum() < tolerance:
                break
        yield pd.DataFrame({"id": ids, "mass": x})

    return run


def _stationary(chain: DataFrame, max_rounds: int, tolerance: float) -> DataFrame:
    """(id, mass): stationary distribution of the lazy chain by power iteration; each step is a join and a sum."""
    out = chain.groupBy("i").agg(F.sum("rate").alias("out"))
    p = chain.join(out, "i").select("i", "j", (F.col("rate") / F.col("out") * (1 - LAZY)).alias("p"))
    p = durable(p.union(out.select("i", "i", F.lit(LAZY))))
    x = out.select(F.col("i").alias("id"))
    x = durable(x.withColumn("mass", F.lit(1.0 / max(1, x.count()))))
    for _ in range(0, max_rounds, STEPS):
        y = x
        for _ in range(STEPS):
            y = p.join(y, p["i"] == y["id"]).groupBy(F.col("j").alias("id")).agg(F.sum(F.col("p") * F.col("mass")).alias("mass"))
        y = durable(y)
        gap = y.join(x.withColumnRenamed("mass", "old"), "id").agg(F.sum(F.abs(F.col("mass") - F.col("old")))).first()[0]
        x = y
        if gap is None or gap < tolerance:
            break
    return x


def _places(s: DataFrame) -> DataFrame:
    """``s`` (id, strength, ...) with its place by falling strength, ties to the smaller id: ranks inside sorted
    ranges plus the rows of the ranges before, so no task holds more than a range."""
    s = durable(s.repartitionByRange(F.desc("strength"), "id").withColumn("part", F.spark_partition_id()))
    before = s.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))  # one row for each range
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("strength"), "id"))
    return s.join(F.broadcast(before.select("part", "before")), "part").withColumn("place", (rank + F.col("before")).cast("long")).drop("part", "before")


def rank_items(pairs: DataFrame, smoothing: float = 0.5, max_rounds: int = 5_000, tolerance: float = 1e-10, dense_items: int = DENSE_ITEMS) -> DataFrame:
    """(id, strength, games, place) of all items of ``pairs`` (a, b, wins, games).

    A walker on an item moves to the ones that beat it, in proportion to the smoothed number of its losses to them
    (each rate normalised by all rates of the item, one step in ten lazy). The stationary mass of an item divided
    by its expected time of stay, i.e. by the sum of its outgoing rates over its games, is its strength: an item met
    often is not stronger for that. Strengths are scaled to sum 1 and ties in place go to the smaller id. Smoothing
    gives every met pair a small rate both ways, so an item without a loss keeps a finite strength. Items that no
    chain of comparisons connects are ranked by their mass within their own part. No pairs: no rows.

    The pair table has at most items**2 rows whatever the number of games. Up to ``dense_items`` items (counted
    first) one task iterates a dense matrix; above, each step is a join and a sum. Both give the same strengths.
    """
    pairs = durable(pairs)
    chain = _chain(pairs, smoothing)
    out = chain.groupBy(F.col("i").alias("id")).agg(F.sum("rate").alias("out"))
    per = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), "games"), F.struct(F.col("b").alias("id"), "games"))).alias("e")).select("e.*").groupBy("id").agg(F.sum("games").alias("games"))
    few = 0 < per.count() <= dense_items
    mass = chain.coalesce(1).mapInPandas(_dense(max_rounds, tolerance), "id string, mass double") if few else _stationary(chain, max_rounds, tolerance)
    s = mass.join(out, "id").select("id", (F.col("mass") / F.col("out")).alias("s")).join(per, "id")
    s = durable(s)
    total = s.agg(F.sum("s")).first()[0]
    return _places(s.select("id", (F.col("s") / F.lit(total)).alias("strength"), "games")).select("id", "strength", "games", "place")
