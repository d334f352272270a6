"""Lists next to what their label plays: locked and free cards, swaps by value, analogues of new cards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import spread

# Fixed values.
LOCKED, LEAST_GAIN, RESISTANCE, ROUNDS, MOST_COPIES = 0.65, 0.02, 0.08, 8, 4
BORROWED, OWN, EACH = 0.65, 0.35, 0.25


def partition(lists: DataFrame, freq: DataFrame, by: str, least: float = LOCKED) -> DataFrame:
    """(by, name, copies, inclusion, locked): cards of a list; those in at least 65% of the label's decks are locked."""
    f = freq.select(by, "name", "inclusion")
    x = lists.join(f, [by, "name"], "left").withColumn("inclusion", F.coalesce("inclusion", F.lit(0.0)))
    return x.select(by, "name", "copies", "inclusion", (F.round("inclusion", 9) >= least).alias("locked"))


def swap_pool(decks: DataFrame, cards: DataFrame, by: str = "archetype") -> DataFrame:
    """(by, name): main-board cards seen in a label's decks."""
    return cards.where("board = 'main'").join(decks.where(F.col(by).isNotNull()).select(by, "tournament_id", "deck_idx"), ["tournament_id", "deck_idx"]).select(by, "name").distinct()


def tune(parts: DataFrame, pool: DataFrame, values: DataFrame, by: str = "archetype", rounds: int = ROUNDS, most: int = MOST_COPIES) -> DataFrame:
    """(by, round, cut, added, gain): swaps of single copies of a list, the best one each round.

    ``parts``: (by, name, copies, inclusion, locked); ``pool``: (by, name); ``values``: (name, value), 0 if missing. A swap takes a
    free card out and puts in a card of the pool that has fewer than ``most`` copies and is not locked; its gain must exceed
    0.02 and 0.08 times the inclusion of what goes (ties: smaller names). A list and its pool are a few hundred rows.
    """
    v = values.select("name", "value")
    rows = parts.join(v, "name", "left").select(by, "name", "copies", "inclusion", "locked", F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(False).alias("pool"))
    more = pool.join(v, "name", "left").select(by, "name", F.lit(0).alias("copies"), F.lit(0.0).alias("inclusion"), F.lit(False).alias("locked"), F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(True).alias("pool"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        mine, offer = p[~p["pool"]], p[p["pool"]]
        have = dict(zip(mine["name"], mine["copies"]))
        locked, inclusion = set(mine.loc[mine["locked"], "name"]), dict(zip(mine["name"], mine["inclusion"]))
        value = dict(zip(p["name"], p["value"]))
        free, names, out = {n for n in have if n not in locked}, sorted(offer["name"], key=lambda n: (-value[n], n)), []
        for r in range(1, rounds + 1):
            best = None
            for cut in sorted(n for n in free if have.get(n, 0) > 0):
                need = max(LEAST_GAIN, RESISTANCE * inclusion.get(cut, 0.0))
                add = next((n for n in names if n != cut and n not in locked and have.get(n, 0) < most), None)  # the most valuable one
                gain = value[add] - value[cut] if add is not None else 0.0
                if gain > need and (best is None or (-gain, cut, add) < best):
                    best = (-gain, cut, add)
            if best is None:
                break
            gain, cut, add = best
            have[cut] -= 1
            have[add] = have.get(add, 0) + 1
            free.add(add)
            out.append((p[by].iloc[0], r, cut, add, -gain))
        return pd.DataFrame(out, columns=[by, "round", "cut", "added", "gain"])

    return spread(rows.unionByName(more), by).groupBy(by).applyInPandas(run, f"{by} string, round int, cut string, added string, gain double")


def grounded_cells(windowed: DataFrame, full: DataFrame, least: int = 8) -> DataFrame:
    """(a, b, wins, n, source): the cell of the window if it has at least ``least`` games, else that of the longer one."""
    w = windowed.select("a", "b", F.col("wins").alias("ww"), F.col("n").alias("wn"))
    g = full.select("a", "b", "wins", "n").join(w, ["a", "b"], "left")
    ok = F.coalesce(F.col("wn") >= least, F.lit(False))
    return g.select("a", "b", F.when(ok, F.col("ww")).otherwise(F.col("wins")).alias("wins"), F.when(ok, F.col("wn")).otherwise(F.col("n")).alias("n"), F.when(ok, "window").otherwise("full").alias("source"))


def _jaccard(x: Column, y: Column) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(1.0)


def analogues(targets: DataFrame, pool: DataFrame, k: int = 5) -> DataFrame:
    """(target, name, similarity): the ``k`` cards of a target's type bucket most like it: a quarter each for the overlap of
    colours, roles and keywords (empty unions 1), and 1 / (1 + difference of cost); ties by name.

    Both: (name, bucket, colors, roles, keywords, cmc). Targets are a stated few against all cards of their bucket.
    """
    t = targets.select(F.col("name").alias("target"), "bucket", F.col("colors").alias("tc"), F.col("roles").alias("tr"), F.col("keywords").alias("tk"), F.col("cmc").alias("tm"))
    x = t.join(pool, "bucket").where("name <> target")
    s = EACH * (_jaccard(F.col("tc"), F.col("colors")) + _jaccard(F.col("tr"), F.col("roles")) + _jaccard(F.col("tk"), F.col("keywords")) + 1 / (1 + F.abs(F.col("tm") - F.col("cmc"))))
    x = x.withColumn("similarity", s)
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.round("similarity", 12).desc(), "name"))
    return x.withColumn("place", place).where(F.col("place") <= k).select("target", "name", "similarity")


def forecast(found: DataFrame, lifts: DataFrame, intrinsic: DataFrame, least: int = 30) -> DataFrame:
    """(target, borrowed, forecast, analogues): mean lift of a target's analogues with enough games, weighted by similarity,
    blended 65 to 35 with its own score less a half; without one the own score alone.

    ``lifts``: (name, lift, n); ``intrinsic``: (target, score).
    """
    g = found.join(lifts.where(F.col("n") >= least).select("name", "lift"), "name").groupBy("target").agg(F.sum(F.col("similarity") * F.col("lift")).alias("sl"), F.sum("similarity").alias("s"), F.count(F.lit(1)).alias("analogues"))
    x = intrinsic.join(g, "target", "left").withColumn("borrowed", F.when(F.col("analogues") > 0, F.coalesce(F.col("sl") / F.nullif("s", F.lit(0.0)), F.lit(0.0))))
    blend = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + BORROWED * F.col("borrowed") + OWN * (F.col("score") - 0.5)))
    return x.select("target", "borrowed", F.when(F.col("borrowed").isNotNull(), blend).otherwise(F.col("score")).alias("forecast"), F.coalesce("analogues", F.lit(0)).alias("analogues"))
