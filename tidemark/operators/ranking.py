"""Fields and rankings in them: custom and restricted fields, covered cells, draws of all decks, card-adjusted rates,
comparisons of configurations. Frames have a row per pair of labels."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.stats import shrink
from tidemark.operators.advice import GAMMA, NO_DATA, PRIOR
from tidemark.operators.matrix import SHOWN
from tidemark.session import spread

# Fixed values.
NUDGE_MOST, NUDGE_SCALE, RISK_QUANTILE, RESTRICT_UNDER = 0.05, 0.5, 0.25, 0.85


def custom_field(spark: SparkSession, shares: Mapping[str, float], known: DataFrame, counts: Mapping[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Field (archetype, share, n) of given shares, scaled to 1, and the given labels (archetype) that ``known`` lacks.

    Negative shares and a sum of 0 raise.
    """
    total = sum(shares.values())
    if min(shares.values(), default=0) < 0 or total <= 0:
        raise ValueError("shares must not be negative and must have a sum")
    f = spark.createDataFrame([(a, s / total, float((counts or {}).get(a, 0))) for a, s in sorted(shares.items())], "archetype string, share double, n double")
    k = known.select("archetype").distinct()
    return f.join(k, "archetype", "left_semi"), f.join(k, "archetype", "left_anti").select("archetype")


def restricted(field: DataFrame, keep: DataFrame, *by: str) -> DataFrame:
    """The field (by, archetype, share) on the labels of ``keep`` (by, archetype), scaled to 1, with the excluded mass."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    f = field.withColumn("whole", F.sum("share").over(w)) if "whole" not in field.columns else field
    k = f.join(keep.select(*by, "archetype").distinct(), [*by, "archetype"], "left_semi")
    part = F.sum("share").over(w)
    return k.select(*by, "archetype", (F.col("share") / part).alias("share"), (F.col("whole") - part).alias("excluded"))


def covered(cells: DataFrame, field: DataFrame, least: int = SHOWN) -> DataFrame:
    """(a, archetype, share, covered): for each subject every label of the field; covered is a mirror or a shown cell."""
    s = cells.select("a").distinct().join(F.broadcast(field.select("archetype", "share")))  # subjects x labels of the field
    n = cells.select("a", F.col("b").alias("archetype"), "n")
    return s.join(n, ["a", "archetype"], "left").select("a", "archetype", "share", ((F.col("a") == F.col("archetype")) | (F.coalesce("n", F.lit(0)) >= least)).alias("covered"))


def covered_fields(cells: DataFrame, field: DataFrame) -> DataFrame:
    """(a, coverage, archetype, share, excluded): each subject's field on its covered labels; coverage is the shown share
    of the non-mirror field (1 if there is none)."""
    c = covered(cells, field)
    other = F.col("a") != F.col("archetype")
    cov = c.groupBy("a").agg((F.sum(F.when(other & F.col("covered"), F.col("share")).otherwise(0.0)) / F.nullif(F.sum(F.when(other, F.col("share")).otherwise(0.0)), F.lit(0.0))).alias("coverage"))
    r = restricted(c.select("a", "archetype", "share"), c.where("covered"), "a")
    return r.join(cov, "a").select("a", F.coalesce("coverage", F.lit(1.0)).alias("coverage"), "archetype", "share", "excluded")


def score_draws(cells: DataFrame, field: DataFrame, draws: int = 20_000, seed: int = 7, robust: bool = False) -> DataFrame:
    """(a, s): the score of each subject in every draw. Shares of the field are drawn once for all subjects, so draws can be
    compared; a label without games is drawn around the mean (``robust``: the least) of the subject's known rates."""
    rows = field.select("archetype", "share", "n").orderBy("archetype").collect()  # one row for each label of the field
    names, counts, plain = [r[0] for r in rows], np.array([float(r[2] or 0) for r in rows]), np.array([float(r[1]) for r in rows])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a = p["a"].iloc[0]
        w = np.random.default_rng(seed).dirichlet(GAMMA + counts, draws) if counts.any() else np.tile(plain, (draws, 1))
        rng = np.random.default_rng([seed, *a.encode()])
        have = {b: (x, n) for b, x, n in zip(p["b"], p["wins"], p["n"]) if n > 0 and b != a}
        known = [x / n for b, (x, n) in have.items() if b in set(names)]
        centre = float((min if robust else np.mean)(known)) if known else 0.5
        centre = min(max(centre, 1e-3), 1 - 1e-3)
        rate = np.empty((draws, len(names)))
        for i, b in enumerate(names):
            if b == a:
                rate[:, i] = 0.5
            elif b in have:
                rate[:, i] = rng.beta(have[b][0] + PRIOR, have[b][1] - have[b][0] + PRIOR, draws)
            else:
                rate[:, i] = rng.beta(NO_DATA * centre, NO_DATA * (1 - centre), draws)
        return pd.DataFrame({"a": [a], "s": [(w * rate).sum(axis=1)]})

    return spread(cells.select("a", "b", "wins", "n"), "a").groupBy("a").applyInPandas(run, "a string, s array<double>")


def rank_decks(draws: DataFrame, quantile: float = RISK_QUANTILE) -> DataFrame:
    """(a, mean, lo, hi, quantile, p_best, place) from ``draws`` (a, s). p_best is the share of draws that a subject leads,
    ties split; places go by the lower quantile, then the name."""
    long = draws.select("a", F.posexplode("s").alias("d", "v"))
    top = long.groupBy("d").agg(F.max("v").alias("top"))
    lead = long.join(top, "d").where("v = top")
    credit = lead.join(lead.groupBy("d").agg(F.count(F.lit(1)).alias("ties")), "d").groupBy("a").agg(F.sum(1 / F.col("ties")).alias("c"))
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975), F.lit(quantile)))
    g = long.groupBy("a").agg(F.avg("v").alias("mean"), q.alias("q"), F.count(F.lit(1)).alias("n")).join(credit, "a", "left")
    g = g.select("a", "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), F.col("q")[2].alias("quantile"), (F.coalesce("c", F.lit(0.0)) / F.col("n")).alias("p_best"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("quantile"), "a")))  # one row for each subject


def pairwise(draws: DataFrame) -> DataFrame:
    """(x, y, p): share of draws in which x scores more than y, equal draws counted half."""

    @F.pandas_udf("double")
    def more(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float((np.asarray(u) > np.asarray(v)).mean() + 0.5 * (np.asarray(u) == np.asarray(v)).mean()) for u, v in zip(x, y)])

    two = draws.select(F.col("a").alias("x"), F.col("s").alias("sx")).join(F.broadcast(draws.select(F.col("a").alias("y"), F.col("s").alias("sy")))).where("x <> y")  # labels x labels
    return two.select("x", "y", more("sx", "sy").alias("p"))


def row_points(cells: DataFrame, field: DataFrame) -> DataFrame:
    """(a, b, share, rate, n, imputed): shrunk rate of each subject against every label of the field; mirrors 0.5, labels
    without games the mean of the subject's known rates, or 0.5."""
    s = cells.select("a").distinct().join(F.broadcast(field.select(F.col("archetype").alias("b"), "share")))  # subjects x labels of the field
    k = cells.where("n > 0 and a <> b").select("a", "b", shrink(F.col("wins"), F.col("n")).alias("p"), "n")
    g = s.join(k, ["a", "b"], "left")
    mean = F.avg("p").over(Window.partitionBy("a"))
    mirror = F.col("a") == F.col("b")
    return g.select("a", "b", "share", F.when(mirror, 0.5).otherwise(F.coalesce("p", mean, F.lit(0.5))).alias("rate"), F.coalesce("n", F.lit(0)).alias("n"), (~mirror & F.col("p").isNull()).alias("imputed"))


def config_points(points: DataFrame, modes: DataFrame, lifts: DataFrame | None = None) -> DataFrame:
    """(config, b, share, base, adjusted, mode, n, imputed): a configuration plays, against each label, its best mode.

    ``points``: row_points; ``modes``: (config, a); ``lifts``: (config, a, b, lift), added to the rate and clipped. The base
    is the best rate without lifts, apart from which mode wins with them (ties: the smaller name).
    """
    m = points.join(modes.distinct(), "a")
    if lifts is not None:
        m = m.join(lifts, ["config", "a", "b"], "left")
    else:
        m = m.withColumn("lift", F.lit(0.0))
    m = m.withColumn("adj", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rate") + F.coalesce("lift", F.lit(0.0)))))
    g = m.groupBy("config", "b", "share").agg(F.max("rate").alias("base"), F.min(F.struct((-F.col("adj")).alias("o"), "a", "n", "imputed")).alias("m"))
    return g.select("config", "b", "share", "base", (-F.col("m.o")).alias("adjusted"), F.col("m.a").alias("mode"), F.col("m.n").alias("n"), F.col("m.imputed").alias("imputed"))


def compare_configs(points: DataFrame, first: str, second: str, targets: DataFrame | None = None) -> DataFrame:
    """One row: expected rates of two configurations (of config_points) without and with lifts, their difference, the shown
    share of the field of each, and the lift on the ``targets`` (b) that the first would need to draw level."""
    ev = points.groupBy("config").agg(F.sum(F.col("share") * F.col("base")).alias("base"), F.sum(F.col("share") * F.col("adjusted")).alias("adjusted"), F.coalesce(F.sum(F.when(F.col("n") >= SHOWN, F.col("share"))), F.lit(0.0)).alias("shown"))
    one = lambda c, p: ev.where(F.col("config") == c).select(*[F.col(x).alias(f"{p}_{x}") for x in ("base", "adjusted", "shown")])
    g = one(first, "first").join(F.broadcast(one(second, "second")))  # one row each
    if targets is not None:
        t = points.where(F.col("config") == first).join(targets.distinct(), "b").agg(F.sum("share").alias("target"))
        g = g.join(F.broadcast(t))
    else:
        g = g.withColumn("target", F.lit(None).cast("double"))
    need = F.when((F.col("first_base") < F.col("second_adjusted")) & (F.col("target") > 0), (F.col("second_adjusted") - F.col("first_base")) / F.col("target"))
    return g.select(*[c for c in g.columns if c != "target"], (F.col("first_adjusted") - F.col("second_adjusted")).alias("difference"), need.alias("break_even"))


def paired_configs(cells: DataFrame, field: DataFrame, modes: Mapping[str, list[str]], draws: int = 20_000, seed: int = 7) -> DataFrame:
    """(config, mean, lo, hi, p_first): Monte-Carlo scores of two configurations over the same draws of field and cells; each
    takes the best of its modes label by label. p_first: how often the first scores more, ties half."""
    names = sorted({a for m in modes.values() for a in m})
    spark = cells.sparkSession
    rows = field.select("archetype", "share", "n").orderBy("archetype").collect()  # one row for each label of the field
    opp, counts, plain = [r[0] for r in rows], np.array([float(r[2] or 0) for r in rows]), np.array([float(r[1]) for r in rows])
    mine = {(r["a"], r["b"]): (r["wins"], r["n"]) for r in cells.where(F.col("a").isin(names) & (F.col("n") > 0)).collect()}  # rows of a few subjects
    rng = np.random.default_rng(seed)
    w = rng.dirichlet(GAMMA + counts, draws) if counts.any() else np.tile(plain, (draws, 1))
    rate = {}
    for a in names:
        known = [x / n for (p, b), (x, n) in mine.items() if p == a and b != a]
        centre = min(max(float(np.mean(known)) if known else 0.5, 1e-3), 1 - 1e-3)
        r = np.empty((draws, len(opp)))
        for i, b in enumerate(opp):
            x = mine.get((a, b))
            r[:, i] = 0.5 if a == b else rng.beta(x[0] + PRIOR, x[1] - x[0] + PRIOR, draws) if x else rng.beta(NO_DATA * centre, NO_DATA * (1 - centre), draws)
        rate[a] = r
    s = {c: (w * np.maximum.reduce([rate[a] for a in m])).sum(axis=1) for c, m in modes.items()}
    x, y = list(s.values())
    p = float((x > y).mean() + 0.5 * (x == y).mean())
    return spark.createDataFrame([(c, float(v.mean()), float(np.quantile(v, 0.025)), float(np.quantile(v, 0.975)), p) for c, v in s.items()], "config string, mean double, lo double, hi double, p_first double")


def card_adjusted(points: DataFrame, deck: DataFrame, values: DataFrame, least: int = 30) -> DataFrame:
    """(a, b, share, rate, nudge, adjusted): rates of row_points moved by the cards of the subject's list.

    ``deck``: (a, name, copies), nonland cards; ``values``: (name, b, lift, n), lift of a card against b over its own rate.
    The mean lift per copy over cells of enough games, times a half, within 5 points; clipped to [0, 1]; mirrors have none.
    """
    total = deck.groupBy("a").agg(F.sum("copies").alias("total"))
    v = values.where(F.col("n") >= least).select("name", "b", "lift")
    s = deck.join(v, "name").groupBy("a", "b").agg(F.sum(F.col("lift") * F.col("copies")).alias("s")).join(total, "a")
    nudge = F.greatest(F.lit(-NUDGE_MOST), F.least(F.lit(NUDGE_MOST), F.coalesce(F.col("s") / F.col("total") * NUDGE_SCALE, F.lit(0.0))))
    g = points.where("a <> b").join(s, ["a", "b"], "left").withColumn("nudge", nudge)
    return g.select("a", "b", "share", "rate", "nudge", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rate") + F.col("nudge"))).alias("adjusted"))


def nonland(deck: DataFrame, lands: DataFrame) -> DataFrame:
    """Cards of a list that are no land; ``lands``: (name)."""
    return deck.join(lands.select("name").distinct(), "name", "left_anti")


def share_bounds(field: DataFrame, quantile: float = 0.25, groups: DataFrame | None = None) -> DataFrame:
    """(archetype or group, share, tail): lower quantile of the share under the field's Dirichlet draws: a Beta quantile of
    the label's, or of a group's summed, weight. ``groups``: (grp, archetype)."""
    from tidemark.functions.stats import beta_ppf

    k = field.count()
    total = field.agg(F.sum("n").alias("t"))
    f = field.join(F.broadcast(total)).select("archetype", "share", (F.col("n") + GAMMA).alias("alpha"), (F.col("t") + GAMMA * k).alias("all"))
    key = "archetype"
    if groups is not None:
        key = "grp"
        f = f.join(groups, "archetype").groupBy("grp").agg(F.sum("share").alias("share"), F.sum("alpha").alias("alpha"), F.max("all").alias("all"))

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([beta_ppf(quantile, x, y) if y > 0 else 1.0 for x, y in zip(a, b)])

    return f.select(key, "share", tail("alpha", F.col("all") - F.col("alpha")).alias("tail"))


def draw_probability(copies: Column, deck: int = 60, seen: int = 24) -> Column:
    """Chance to see at least one of the copies among ``seen`` cards of a deck."""
    miss = F.lit(1.0)
    for i in range(8):
        miss = F.when(copies > i, miss * max(0.0, (deck - seen - i) / (deck - i))).otherwise(miss)
    return 1 - miss
