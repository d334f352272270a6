"""Connected components by minimum labels (used by the llm operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable, shuffled


def _round(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v)."""
    # large star: link larger neighbours to the smallest of the neighbourhood
    both = e.union(e.select("v", "u"))
    m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    e = both.where("v > u").join(shuffled(m), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # small star: link smaller neighbours and the vertex itself to the smallest
    m = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(shuffled(m), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def min_label_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, label) of every vertex with an edge; label is the smallest id of its component.

    Alternates large-star and small-star steps until the edges are stars, so the rounds grow with the logarithm of
    the longest path and no vertex gathers its neighbours in one task: each step is a minimum per key and an
    equi-join. Loops and null ends are ignored, repeated edges count once. Raises if not done in max_rounds.
    """
    given = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    e = given.where("u <> v")
    for _ in range(max_rounds):
        # Stars: every vertex either has one edge to a root or is a root, which has none.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
        if ends.where("down > 1 or (down > 0 and up > 0)").isEmpty():
            break
        e = durable(_round(e))
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("label")).union(e.select("u", "v"))
    loops = given.where("u = v").select(F.col("u").alias("id"), F.col("v").alias("label"))
    return roots.union(loops).groupBy("id").agg(F.min("label").alias("label"))
