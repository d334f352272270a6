"""Cells pooled over clusters of labels: gates, priors, licences, imputed cells and what to show.

Frames here have a row per pair of labels, so they stay small whatever the number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import Z95, chi2_sf_udf, interval_udf, tier
from tidemark.operators.matrix import SHOWN, pool

# Fixed values of the gates.
LEAST_EFFECTIVE, MOST_SHARE = 2.0, 0.60
SPREAD, SPREAD_GAMES, HET_MEMBERS, HET_GAMES = 0.25, 10, 2, 5
I2_FREE, I2_REFUSE = 0.40, 0.75
PRIOR_LEAST, PRIOR_MOST, PRIOR_MEMBERS, PRIOR_GAMES = 5.0, 30.0, 3, 30
LICENCE_COLUMNS, LICENCE_MEMBERS, LICENCE_GAMES, LICENCE_SHARE, LICENCE_ALPHA = 3, 2, 12, 0.25, 0.05
IMPUTE_GAMES = 25


def member_rows(cells: DataFrame, members: DataFrame) -> DataFrame:
    """(subject, cluster, member, wins, n, definer, intra): cells (a, b, wins, n) against the members of each cluster.

    ``members``: (cluster, member, definer). intra: the subject is in the cluster itself.
    """
    m = members.select("cluster", "member", "definer").distinct()
    rows = cells.where("n > 0").select(F.col("a").alias("subject"), F.col("b").alias("member"), "wins", "n").join(m, "member")
    home = m.select(F.col("member").alias("subject"), F.col("cluster").alias("home")).groupBy("subject").agg(F.min("home").alias("home"))
    r = rows.join(home, "subject", "left")
    return r.select("subject", "cluster", "member", "wins", "n", "definer", (F.coalesce(F.col("home") == F.col("cluster"), F.lit(False))).alias("intra"))


def _band(k5: Column, low: Column, high: Column, k10: Column, i2: Column) -> Column:
    """Heterogeneity: not-computable, refused (spread or I2), labelled or free."""
    return (
        F.when(k5 < HET_MEMBERS, "not-computable")
        .when((k10 >= 2) & (high - low >= SPREAD), "refused")
        .when(i2.isNull(), "not-computable")
        .when(i2 > I2_REFUSE, "refused")
        .when(i2 > I2_FREE, "labelled")
        .otherwise("free")
    )


def pooled_cells(rows: DataFrame, *extra: str) -> DataFrame:
    """Pooled cell of each (subject, cluster, *extra) from rows (subject, cluster, member, wins, n, definer, intra).

    The subject's own mirror and members that do not define their cluster are left out of the rate; fewer than two
    contributors refuse, as does heterogeneity; a failed concentration gate is only noted. reason is null where the
    number is served; p, lo, hi are null where it is refused. strength is that of the cell as a prior, between 5 and
    30 by members, median games and visible dispersion; ``admissible`` cells are served, concentrated enough and computable.
    """
    keys = ["subject", "cluster", *extra]
    ident = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys])
    rows = rows.withColumn("key", ident)
    contributes = F.col("definer") & (F.col("member") != F.col("subject"))
    base = rows.groupBy("key", *keys).agg(
        F.count_if(contributes).alias("contributors"),
        F.coalesce(F.sum(F.when(F.col("member") == F.col("subject"), F.col("n"))), F.lit(0)).alias("mirror_n"),
        F.coalesce(F.sum(F.when(contributes & F.col("intra"), F.col("n"))), F.lit(0)).alias("intra_n"),
    )
    c = rows.where(contributes).withColumn("rate", F.col("wins") / F.col("n"))
    stat = c.groupBy("key").agg(
        F.count_if(F.col("n") >= HET_GAMES).alias("k5"), F.count_if(F.col("n") >= SPREAD_GAMES).alias("k10"), F.median("n").alias("median_n"),
        F.min(F.when(F.col("n") >= SPREAD_GAMES, F.col("rate"))).alias("low"), F.max(F.when(F.col("n") >= SPREAD_GAMES, F.col("rate"))).alias("high"),
    )
    p = pool(c.select(F.col("key").alias("a"), F.col("member").alias("b"), "wins", "n"), F.lit("x")).withColumnRenamed("a", "key").drop("cluster")
    g = base.join(stat, "key", "left").join(p, "key", "left")
    g = g.withColumn("band", F.when(F.col("contributors") >= 2, _band(F.col("k5"), F.col("low"), F.col("high"), F.col("k10"), F.col("i2"))))
    pq = F.col("p_pooled") * (1 - F.col("p_pooled"))
    evidence = F.least(F.lit(1.0), F.col("members") / PRIOR_MEMBERS) * F.least(F.lit(1.0), F.col("median_n") / PRIOR_GAMES)
    ceiling = PRIOR_LEAST + (PRIOR_MOST - PRIOR_LEAST) * evidence
    moment = F.when((F.col("tau2") > 0) & (pq > 0), 1 / (F.col("tau2") * pq) - 1)
    served = (F.col("contributors") >= 2) & (F.col("band") != "refused")
    concentrated = (1 / F.col("hhi") >= LEAST_EFFECTIVE) & (F.col("top_share") < MOST_SHARE)
    half = Z95 * F.sqrt("variance")
    rate = lambda x: 1 / (1 + F.exp(-x))
    several = F.col("contributors") >= 2
    g = g.withColumns(
        {
            "served": served,
            "p": F.when(served, F.col("p_pooled")),
            "lo": F.when(served, rate(F.col("mu") - half)),
            "hi": F.when(served, rate(F.col("mu") + half)),
            "tier": F.when(several, tier(F.round("n_eff"))),
            "passed": F.when(several, concentrated),
            "strength": F.when(several, F.least(F.lit(PRIOR_MOST), F.greatest(F.lit(PRIOR_LEAST), F.coalesce(F.least(ceiling, moment), ceiling)))),
            "reason": F.when(F.col("contributors") == 0, "no contributor").when(F.col("contributors") == 1, "single member").when(~served, "heterogeneity"),
            "admissible": F.coalesce(served & concentrated & (F.col("band") != "not-computable"), F.lit(False)),
            "intra_share": F.when(several, (F.col("intra_n") + F.col("mirror_n")) / (F.col("games") + F.col("mirror_n"))),
        }
    )
    return g.select(*keys, "contributors", "games", "mirror_n", "p", "lo", "hi", F.when(several, F.col("n_eff")).alias("n_eff"), "tier", "band", "passed", "strength", "intra_share", "reason", "admissible")


def column_divergence(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, evaluable, chi2, p, spread): do defining members differ in one column? rows: (keys, wins, n, definer).

    Over members of enough games; columns without a win or without a loss have p 1; two members with Yates' correction.
    """
    q = rows.where(F.col("definer") & (F.col("n") >= LICENCE_GAMES))
    t = q.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum("wins").alias("tw"), F.sum("n").alias("tn"), (F.max(F.col("wins") / F.col("n")) - F.min(F.col("wins") / F.col("n"))).alias("spread")
    ).where(F.col("k") >= LICENCE_MEMBERS)
    x = q.join(t, list(keys))
    rate = F.col("tw") / F.col("tn")
    off = F.abs(F.col("wins") - F.col("n") * rate)
    off = F.when(F.col("k") == 2, off - F.least(F.lit(0.5), off)).otherwise(off)
    x = x.groupBy(*keys, "k", "spread", "tw", "tn").agg(F.sum(F.when((rate > 0) & (rate < 1), off * off / (F.col("n") * rate * (1 - rate))).otherwise(0.0)).alias("chi2"))
    return x.select(*keys, F.lit(True).alias("evaluable"), "chi2", chi2_sf_udf("chi2", (F.col("k") - 1).cast("double")).alias("p"), "spread")


def licences(cells: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, columns, divergent, tau, granted): may members of a cluster stand in for each other?

    A column is an opponent outside the cluster; at least three must be comparable and at most a quarter of these
    may differ by chi-squared. tau is the median spread of the comparable columns.
    """
    rows = member_columns(cells, members).where("not inside")
    d = column_divergence(rows, "cluster", "opponent")
    g = d.groupBy("cluster").agg(F.count(F.lit(1)).alias("columns"), F.count_if(F.col("p") < LICENCE_ALPHA).alias("divergent"), F.median("spread").alias("tau"))
    g = members.select("cluster").distinct().join(g, "cluster", "left")
    n, k = F.coalesce("columns", F.lit(0)), F.coalesce("divergent", F.lit(0))
    return g.select("cluster", n.alias("columns"), k.alias("divergent"), "tau", ((n >= LICENCE_COLUMNS) & (k <= LICENCE_SHARE * n)).alias("granted"))


def member_columns(cells: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, opponent, member, wins, n, definer, inside): what each member of a cluster did against each opponent."""
    m = members.select("cluster", "member", "definer").distinct()
    rows = cells.where("n > 0").select(F.col("a").alias("member"), F.col("b").alias("opponent"), "wins", "n").join(m, "member")
    own = m.select("cluster", F.col("member").alias("opponent"), F.lit(True).alias("own"))
    return rows.join(own, ["cluster", "opponent"], "left").select("cluster", "opponent", "member", "wins", "n", "definer", F.coalesce("own", F.lit(False)).alias("inside"))


def imputed_cells(pairs: DataFrame, cells: DataFrame, members: DataFrame) -> DataFrame:
    """Imputed cell of each (subject, opponent) of ``pairs`` whose subject is in a cluster, from what its siblings did.

    reason names the first refusal: intra-family, licence, no siblings, veto (the column differs), thin; null where p
    is given. lo and hi are the interval of the pooled rate, widened by half of the licence's tau on each side.
    """
    m = members.select("cluster", "member", "definer").distinct()
    home = m.groupBy(F.col("member").alias("subject")).agg(F.min("cluster").alias("cluster"))
    base = pairs.select("subject", "opponent").join(home, "subject")
    columns = member_columns(cells, members)
    sib = base.join(columns, ["cluster", "opponent"]).where("definer and member <> subject")
    total = sib.groupBy("subject", "opponent").agg(F.sum("wins").alias("w"), F.sum("n").alias("pool_n"), F.count(F.lit(1)).alias("siblings"))
    veto = column_divergence(sib, "subject", "opponent").where(F.col("p") < LICENCE_ALPHA).select("subject", "opponent", F.lit(True).alias("veto"))
    inside = m.select("cluster", F.col("member").alias("opponent"), F.lit(True).alias("inside"))
    g = base.join(inside, ["cluster", "opponent"], "left").join(licences(cells, members).select("cluster", "granted", "tau"), "cluster")
    g = g.join(total, ["subject", "opponent"], "left").join(veto, ["subject", "opponent"], "left")
    reason = (
        F.when(F.coalesce("inside", F.lit(False)) | (F.col("subject") == F.col("opponent")), "intra-family")
        .when(~F.col("granted"), "licence")
        .when(F.col("siblings").isNull(), "no siblings")
        .when(F.coalesce("veto", F.lit(False)), "veto")
        .when(F.col("pool_n") < IMPUTE_GAMES, "thin")
    )
    g = g.withColumn("reason", reason)
    ci = g.where("reason is null").select("w", "pool_n").distinct().withColumn("ci", interval_udf(F.col("w").cast("double"), F.col("pool_n").cast("double")))
    g = g.join(ci, ["w", "pool_n"], "left")
    pad, ok = F.col("tau") / 2, F.col("reason").isNull()
    return g.select(
        "subject", "opponent", "cluster", F.coalesce("siblings", F.lit(0)).alias("siblings"), F.coalesce("pool_n", F.lit(0)).alias("pool_n"), F.when(ok, F.col("w") / F.col("pool_n")).alias("p"),
        F.when(ok, F.greatest(F.lit(0.0), F.col("ci.lo") - pad)).alias("lo"), F.when(ok, F.least(F.lit(1.0), F.col("ci.hi") + pad)).alias("hi"), "reason",
    )


def prior_rungs(pairs: DataFrame, cells: DataFrame, members: DataFrame) -> DataFrame:
    """(subject, opponent, rung, mean, strength): prior of a pair from its clusters, without the pair's own games.

    Rung 1 pools the subject against the opponent's cluster without the opponent; rung 2 the siblings of the
    subject against it; the first admissible one is taken, pairs without one have no row.
    """
    m = members.select("cluster", "member", "definer").distinct()
    home = m.groupBy("member").agg(F.min("cluster").alias("cluster"))
    there = home.select(F.col("member").alias("opponent"), "cluster")
    mine = home.select(F.col("member").alias("subject"), F.col("cluster").alias("family"))
    p = pairs.where("subject <> opponent").select("subject", "opponent").join(there, "opponent").join(mine, "subject", "left")
    rows = cells.where("n > 0").select("a", F.col("b").alias("member"), "wins", "n").join(m, "member")
    one = p.join(rows.withColumnRenamed("a", "subject"), ["subject", "cluster"]).where("member <> opponent").withColumn("intra", F.coalesce(F.col("family") == F.col("cluster"), F.lit(False)))
    first = pooled_cells(one.select("subject", "cluster", "opponent", "member", "wins", "n", "definer", "intra"), "opponent").where("admissible")
    sib = m.where("definer").select(F.col("cluster").alias("family"), F.col("member").alias("sibling"))
    two = p.join(first.select("subject", "opponent"), ["subject", "opponent"], "left_anti").join(sib, "family").where("sibling <> subject")
    two = two.join(rows.withColumnRenamed("a", "sibling"), ["sibling", "cluster"]).where("member <> opponent and member <> subject and member <> sibling")
    two = two.groupBy("subject", "opponent", "cluster", "family", F.concat_ws(" > ", "sibling", "member").alias("member")).agg(F.sum("wins").alias("wins"), F.sum("n").alias("n"), F.max("definer").alias("definer"))
    second = pooled_cells(two.withColumn("intra", F.coalesce(F.col("family") == F.col("cluster"), F.lit(False))).drop("family"), "opponent").where("admissible")
    pick = lambda f, r: f.select("subject", "opponent", F.lit(r).alias("rung"), F.col("p").alias("mean"), "strength")
    return pick(first, 1).unionByName(pick(second, 2))


def display_ladder(pairs: DataFrame, cells: DataFrame, members: DataFrame, gate: int = SHOWN) -> DataFrame:
    """(subject, opponent, kind, p, refused): what a pair shows: measured, imputed, pooled or none, in this order.

    refused lists why finer kinds were not shown. A pooled cell needs an effective n of ``gate``.
    """
    m = members.select("cluster", "member").distinct()
    there = m.groupBy(F.col("member").alias("opponent")).agg(F.min("cluster").alias("cluster"))
    own = cells.select(F.col("a").alias("subject"), F.col("b").alias("opponent"), "wins", "n")
    g = pairs.select("subject", "opponent").join(own, ["subject", "opponent"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    imp = imputed_cells(pairs, cells, members).select("subject", "opponent", F.col("p").alias("ip"), F.coalesce("reason", F.lit("")).alias("ireason"))
    pooled = pooled_cells(member_rows(cells, members)).select("subject", "cluster", F.col("p").alias("pp"), "n_eff", F.col("reason").alias("preason"))
    g = g.join(imp, ["subject", "opponent"], "left").join(there, "opponent", "left").join(pooled, ["subject", "cluster"], "left")
    measured, imputed = F.col("n") >= gate, F.col("ip").isNotNull()
    shown = F.coalesce(F.col("pp").isNotNull() & (F.col("n_eff") >= gate), F.lit(False))
    kind = F.when(measured, "measured").when(imputed, "imputed").when(shown, "pooled").otherwise("none")
    why_imputed = F.when(F.col("ireason").isNull(), "imputed: no cluster").when(F.col("ireason") != "", F.concat(F.lit("imputed: "), "ireason"))
    why_pooled = F.when(F.col("cluster").isNull(), "pooled: no cluster").when(F.col("n_eff").isNull() | F.col("preason").isNotNull(), F.concat(F.lit("pooled: "), F.coalesce("preason", F.lit("no games")))).otherwise("pooled: thin")
    refused = F.array_compact(F.array(F.when(~measured, "measured: thin"), F.when(~measured & ~imputed, why_imputed), F.when(~measured & ~imputed & ~shown, why_pooled)))
    p = F.when(measured, F.col("wins") / F.col("n")).when(imputed, F.col("ip")).when(shown, F.col("pp"))
    return g.select("subject", "opponent", kind.alias("kind"), p.alias("p"), F.array_join(refused, "; ").alias("refused"))
