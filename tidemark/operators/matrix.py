"""Head-to-head matrices: rectangular, adaptive by horizon, with priors over camps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import STRENGTH, interval_udf, shrink, tier, wilson
from tidemark.operators.matches import directed, marginals, tallies

#: Share of all match sides that a label needs for a row, and games from which a cell is shown.
ROW_SHARE, SHOWN = 0.02, 30


def rectangular(resolved: DataFrame, min_row_share: float = ROW_SHARE) -> DataFrame:
    """Every directed cell between the labels with a row: wins, n, p_raw (null without games), p_shrunk towards the
    row's shrunk marginal, Wilson interval (null without games), tier, shown. Mirrors are 0.5 without an interval.

    There are at most 1 / min_row_share labels, so the grid is small whatever the number of matches.
    """
    m = marginals(resolved)
    total = m.agg(F.sum("n").alias("t"))
    keep = m.join(F.broadcast(total)).where(F.col("n") >= min_row_share * F.col("t")).select("a", shrink(F.col("wins"), F.col("n")).alias("prior"))
    mirror = resolved.where("status = 'mirror'").groupBy("a").agg(F.count(F.lit(1)).alias("mirrors"))
    grid = keep.join(F.broadcast(keep.select(F.col("a").alias("b"))))  # labels with a row on both sides
    g = grid.join(tallies(resolved), ["a", "b"], "left").join(mirror, "a", "left")
    own = F.col("a") == F.col("b")
    n = F.when(own, F.coalesce("mirrors", F.lit(0))).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    wins = F.when(own, F.floor(F.coalesce("mirrors", F.lit(0)) / 2)).otherwise(F.coalesce("wins", F.lit(0))).cast("long")
    g = g.select("a", "b", wins.alias("wins"), n.alias("n"), "prior", own.alias("mirror"))
    lo, hi = wilson(F.col("wins"), F.col("n"))
    blank = F.col("mirror") | (F.col("n") == 0)
    return g.select(
        "a", "b", "wins", "n",
        F.when(F.col("mirror"), 0.5).when(F.col("n") > 0, F.col("wins") / F.col("n")).alias("p_raw"),
        F.when(F.col("mirror"), 0.5).otherwise(shrink(F.col("wins"), F.col("n"), F.col("prior"))).alias("p_shrunk"),
        F.when(~blank, lo).alias("lo"), F.when(~blank, hi).alias("hi"),
        tier(F.col("n")).alias("tier"), (F.col("n") >= SHOWN).alias("shown"),
    )


def with_intervals(cells: DataFrame) -> DataFrame:
    """Cells with Jeffreys or Wilson intervals, computed on the distinct (wins, n) only."""
    k = cells.select("wins", "n").distinct()
    k = k.withColumn("ci", interval_udf(F.col("wins").cast("double"), F.col("n").cast("double"))).select("wins", "n", "ci.lo", "ci.hi")
    return cells.join(k, ["wins", "n"])


def adaptive(resolved: DataFrame, horizons: DataFrame) -> DataFrame:
    """(a, b, since, wins, n, wins_before, n_before): each pair over the window from the later of both horizons.

    ``horizons``: (archetype, valid_since); null or missing is open. One pass with conditional sums in place of a scan
    per horizon.
    """
    h = lambda x, c: horizons.select(F.col("archetype").alias(x), F.col("valid_since").alias(c))
    d = directed(resolved).join(h("a", "ha"), "a", "left").join(h("b", "hb"), "b", "left").withColumn("since", F.greatest("ha", "hb"))
    inside = F.col("since").isNull() | (F.col("date") >= F.col("since"))
    one = lambda c, v: F.sum(F.when(c, v).otherwise(0)).cast("long")
    before = ~F.coalesce(inside, F.lit(False))
    inside = F.coalesce(inside, F.lit(False))
    return d.groupBy("a", "b", "since").agg(one(inside, F.col("win")).alias("wins"), one(inside, F.lit(1)).alias("n"), one(before, F.col("win")).alias("wins_before"), one(before, F.lit(1)).alias("n_before"))


def cross_boundary(cells: DataFrame, thin: int = 100) -> DataFrame:
    """Adaptive cells; a thin cell that was cut shrinks to its own rate before the cut, others to 0.5."""
    prior = shrink(F.col("wins_before"), F.col("n_before"))
    cut = F.col("since").isNotNull() & (F.col("n") < thin) & (F.col("n_before") > 0)
    return cells.withColumn("p_shrunk", F.when(cut, shrink(F.col("wins"), F.col("n"), prior)).otherwise(shrink(F.col("wins"), F.col("n")))).withColumn("prior_source", F.when(cut, "before").otherwise("even"))


def camp_cells(resolved: DataFrame) -> DataFrame:
    """Cells of camps against parents with the leave-camp-out prior: (a, camp, b, wins, n, prior, p_shrunk).

    Camp-grain sums come first; the parent's cell is their roll-up, and what other camps of the parent did, shrunk to
    the parent's rate over all opponents, is the prior. A deck without a camp is 'unlabeled'.
    """
    d = directed(resolved).withColumn("camp", F.coalesce("va", F.lit("unlabeled")))
    camp = d.groupBy("a", "camp", "b").agg(F.sum("win").alias("wins"), F.count(F.lit(1)).alias("n"))
    parent = camp.groupBy("a", "b").agg(F.sum("wins").alias("pw"), F.sum("n").alias("pn"))
    whole = camp.groupBy("a").agg(F.sum("wins").alias("tw"), F.sum("n").alias("tn"))
    g = camp.join(parent, ["a", "b"]).join(whole, "a")
    base = shrink(F.col("tw"), F.col("tn"))
    prior = shrink(F.col("pw") - F.col("wins"), F.col("pn") - F.col("n"), base)
    return g.select("a", "camp", "b", "wins", "n", prior.alias("prior"), shrink(F.col("wins"), F.col("n"), prior, STRENGTH).alias("p_shrunk"))


def pool(cells: DataFrame, cluster: Column) -> DataFrame:
    """DerSimonian-Laird pooling of the cells of each (a, cluster of b), with heterogeneity and concentration.

    Members without games are left out. mu is the pooled logit, variance its variance, p_pooled its rate; tau2, q, i2 (null with one member)
    describe the spread; hhi, m_eff and top_share the concentration of games.
    """
    c = cells.where("n > 0").select("a", cluster.alias("cluster"), F.col("wins").cast("double").alias("w"), F.col("n").cast("double").alias("n")).where("cluster is not null")
    x, y = F.col("w") + 0.5, F.col("n") - F.col("w") + 0.5
    c = c.withColumn("y", F.log(x / y)).withColumn("v", 1 / x + 1 / y).withColumn("iv", 1 / F.col("v"))
    g = c.groupBy("a", "cluster").agg(
        F.count(F.lit(1)).alias("k"), F.sum("iv").alias("s1"), F.sum(F.col("iv") * F.col("iv")).alias("s2"), F.sum(F.col("iv") * F.col("y")).alias("sy"), F.sum(F.col("iv") * F.col("y") * F.col("y")).alias("syy"),
        F.sum("n").alias("games"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.max("n").alias("top"),
    )
    q = F.greatest(F.lit(0.0), F.col("syy") - F.col("sy") * F.col("sy") / F.col("s1"))
    g = g.withColumn("q", q).withColumn("tau2", F.when(F.col("k") > 1, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / (F.col("s1") - F.col("s2") / F.col("s1")))).otherwise(0.0))
    r = c.join(g.select("a", "cluster", "tau2"), ["a", "cluster"]).withColumn("u", 1 / (F.col("v") + F.col("tau2")))
    r = r.groupBy("a", "cluster").agg(F.sum("u").alias("su"), F.sum(F.col("u") * F.col("y")).alias("suy"))
    g = g.join(r, ["a", "cluster"]).withColumn("mu", F.col("suy") / F.col("su")).withColumn("p_pooled", 1 / (1 + F.exp(-F.col("mu"))))
    n_eff = F.least(F.col("games"), F.col("su") / (F.col("p_pooled") * (1 - F.col("p_pooled"))))
    return g.select(
        "a", "cluster", F.col("k").alias("members"), F.col("games").cast("long").alias("games"), "q", "tau2", F.when(F.col("k") > 1, F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q"))).otherwise(0.0)).alias("i2"),
        "p_pooled", "mu", (1 / F.col("su")).alias("variance"), n_eff.alias("n_eff"), (F.col("nn") / (F.col("games") * F.col("games"))).alias("hhi"), (F.col("top") / F.col("games")).alias("top_share"),
    )
