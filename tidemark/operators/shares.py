"""Shares of the field: definitions, regimes, venues, movers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.stats import tier
from tidemark.operators.matches import unique_names

#: Share under which a label is fringe, top-cut size, and thresholds of the tier list; fixed values.
FRINGE, CUT = 0.02, 8
TIERS = ((0.10, "S"), (0.05, "A"), (0.02, "B"))


def raw_counts(decks: DataFrame, *by: str) -> DataFrame:
    return decks.where("archetype is not null").groupBy(*by, "archetype").agg(F.count(F.lit(1)).alias("n"))


def shares(counts: DataFrame, *by: str, weight: str = "n") -> DataFrame:
    """share of each label (within ``by``), tier of n, fringe flag."""
    total = counts.groupBy(*by).agg(F.sum(weight).alias("__t")) if by else counts.agg(F.sum(weight).alias("__t"))
    s = counts.join(total, list(by)) if by else counts.join(F.broadcast(total))
    return s.withColumn("share", F.col(weight) / F.col("__t")).withColumn("tier", tier(F.col("n"))).withColumn("fringe", F.col("share") < FRINGE).drop("__t")


def fold_other(shared: DataFrame) -> DataFrame:
    """Fringe labels as one row Other; Unknown and Conflict labels never fold."""
    never = F.lower("archetype").rlike(r"^(unknown$|conflict($|\())")
    label = F.when(F.col("fringe") & ~never, "Other").otherwise(F.col("archetype"))
    g = shared.groupBy(label.alias("archetype")).agg(F.sum("n").alias("n"), F.sum("share").alias("share"), F.bool_or("fringe").alias("fringe"))
    return g.withColumn("tier", tier(F.col("n")))


def topcut_counts(decks: DataFrame, standings: DataFrame, cut: int = CUT) -> DataFrame:
    """Decks in the top cut; names that occur twice among decks or standings of an event are left out."""
    u = unique_names(decks).where("n = 1 and archetype is not null")
    s = standings.groupBy("tournament_id", "norm").agg(F.count(F.lit(1)).alias("k"), F.min("rank").alias("rank")).where((F.col("k") == 1) & (F.col("rank") <= cut))
    return u.join(s, ["tournament_id", "norm"]).groupBy("archetype").agg(F.count(F.lit(1)).alias("n"))


def winrate_weighted(counts: DataFrame, marginal: DataFrame) -> DataFrame:
    """share times win rate, renormalised; labels without games are left out. n is the number of games."""
    total = counts.agg(F.sum("n").alias("t"))
    w = counts.withColumnRenamed("n", "d").join(F.broadcast(total)).join(marginal.withColumnRenamed("a", "archetype"), "archetype").where("n > 0")
    w = w.select("archetype", "n", (F.col("d") / F.col("t") * F.col("wins") / F.col("n")).alias("w"))
    return w.join(F.broadcast(w.agg(F.sum("w").alias("sw")))).select("archetype", "n", (F.col("w") / F.col("sw")).alias("share"))


def blend(by_part: DataFrame, part: str, weights: dict[str, float]) -> DataFrame:
    """Weighted mix of shares over the parts that are present, weights rescaled, then renormalised."""
    w = by_part.sparkSession.createDataFrame(list(weights.items()), f"{part} string, w double")
    here = by_part.join(F.broadcast(w), part)
    present = here.select(part, "w").distinct().agg(F.sum("w").alias("sw"))
    m = here.join(F.broadcast(present)).groupBy("archetype").agg(F.sum(F.col("share") * F.col("w") / F.col("sw")).alias("x"))
    return m.join(F.broadcast(m.agg(F.sum("x").alias("sx")))).select("archetype", (F.col("x") / F.col("sx")).alias("share"))


def regimes(spark, dates: list[str]) -> DataFrame:
    """(regime, since, until): half-open windows between the dates, first and last open."""
    d = sorted(set(dates))
    rows = [(i, a, b) for i, (a, b) in enumerate(zip([None, *d], [*d, None]))]
    return spark.createDataFrame(rows, "regime int, since string, until string").select("regime", F.col("since").cast("date").alias("since"), F.col("until").cast("date").alias("until"))


def in_regimes(decks: DataFrame, reg: DataFrame) -> DataFrame:
    """Decks with their regime; the windows are one row per change date and are broadcast."""
    r = F.broadcast(reg)
    return decks.where("date is not null").join(r, (r["since"].isNull() | (decks["date"] >= r["since"])) & (r["until"].isNull() | (decks["date"] < r["until"])))


def trends(decks: DataFrame, reg: DataFrame, min_events: int = 4, min_days: int = 14) -> DataFrame:
    """Shares per regime; a regime with few events or days is thin and never claims an established tier."""
    x = in_regimes(decks, reg)
    stat = x.groupBy("regime").agg(F.count_distinct("tournament_id").alias("events"), F.date_diff(F.max("date"), F.min("date")).alias("days"))
    s = shares(raw_counts(x, "regime"), "regime").join(stat, "regime")
    thin = (F.col("events") < min_events) | (F.col("days") < min_days)
    return s.select("regime", "archetype", "n", "share", F.when(thin & (F.col("tier") == "established"), "evolving").otherwise(F.col("tier")).alias("tier"), thin.alias("thin"))


def movers(trend: DataFrame, top: int = 10) -> DataFrame:
    """(regime, archetype, share_before, share_after, delta): the ``top`` labels whose share changed most from a regime to the
    next one (regime is the later one); missing is 0, ties by name."""
    a = trend.select((F.col("regime") + 1).alias("regime"), "archetype", F.col("share").alias("share_before"))
    b = trend.select("regime", "archetype", F.col("share").alias("share_after"))
    both = a.select("regime").distinct().join(b.select("regime").distinct(), "regime")  # regimes that follow another one
    m = a.join(b, ["regime", "archetype"], "full").join(F.broadcast(both), "regime").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("share_before", "share_after")})
    m = m.withColumn("delta", F.round(F.col("share_after") - F.col("share_before"), 9))
    place = F.row_number().over(Window.partitionBy("regime").orderBy(F.abs("delta").desc(), "archetype"))
    return m.withColumn("k", place).where(F.col("k") <= top).select("regime", "archetype", "share_before", "share_after", "delta")


def venue_divergence(by_venue: DataFrame, venues: list[str], least: float = 0.0) -> DataFrame:
    """Highest and lowest share of each label over the venues (missing is 0) and where they are."""
    p = by_venue.groupBy("archetype").pivot("provenance", venues).agg(F.first("share")).na.fill(0.0, venues)
    items = F.array(*[F.struct(F.col(v).alias("s"), F.lit(v).alias("v")) for v in venues])
    p = p.withColumn("hi", F.greatest(*venues)).withColumn("lo", F.least(*venues))
    pick = lambda c: F.array_min(F.transform(F.filter(items, lambda x: x["s"] == F.col(c)), lambda x: x["v"]))
    return p.select("archetype", pick("hi").alias("venue_hi"), pick("lo").alias("venue_lo"), "hi", "lo", (F.col("hi") - F.col("lo")).alias("spread")).where(F.col("spread") >= least)


def tier_list(shared: DataFrame) -> DataFrame:
    t = F.lit(None).cast("string")
    for low, name in reversed(TIERS):
        t = F.when(F.col("share") >= low, name).otherwise(t)
    return shared.select("archetype", "share", t.alias("grade")).where("grade is not null")


def ban_horizon(decks: DataFrame, cards: DataFrame, reg: DataFrame, bans: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(archetype, valid_since): the latest ban before which at least ``threshold`` of the archetype's decks of the
    preceding regime ran a banned card."""
    x = in_regimes(decks.where("archetype is not null"), reg)
    base = x.groupBy("archetype", "regime").agg(F.count(F.lit(1)).alias("n"))
    nxt = reg.select("regime", F.col("until").alias("ban_date")).where("ban_date is not null")
    ran = x.join(F.broadcast(nxt), "regime").join(F.broadcast(bans.select(F.col("date").alias("ban_date"), F.col("card").alias("name"))), "ban_date")
    ran = ran.join(cards.select("tournament_id", "deck_idx", "name").distinct(), ["tournament_id", "deck_idx", "name"], "left_semi")
    ran = ran.groupBy("archetype", "regime", "ban_date").agg(F.count_distinct("tournament_id", "deck_idx").alias("k"))
    hit = ran.join(base, ["archetype", "regime"]).where(F.col("k") >= threshold * F.col("n"))
    return hit.groupBy("archetype").agg(F.max("ban_date").alias("valid_since"))


def weekly_ema(decks: DataFrame, span: int = 4, least: int = 1) -> DataFrame:
    """Share per Monday week and label with its exponential mean (alpha 2 / (span + 1), seeded by the first value),
    folded over the label's ordered weeks; weeks under ``least`` decks are dropped, a missing week counts 0."""
    w = decks.where("archetype is not null and date is not null").withColumn("week", F.date_trunc("week", "date").cast("date"))
    n = w.groupBy("week", "archetype").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("week").agg(F.sum("n").alias("t")).where(F.col("t") >= least)
    grid = total.join(F.broadcast(n.select("archetype").distinct()))  # labels are few
    s = grid.join(n, ["week", "archetype"], "left").select("archetype", "week", (F.coalesce("n", F.lit(0)) / F.col("t")).alias("share"))
    a = 2.0 / (span + 1)
    line = s.groupBy("archetype").agg(F.array_sort(F.collect_list(F.struct("week", "share"))).alias("l"))
    first = F.struct(F.col("l")[0]["week"].alias("week"), F.col("l")[0]["share"].alias("share"), F.col("l")[0]["share"].alias("ema"))
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["week"].alias("week"), x["share"].alias("share"), (a * x["share"] + (1 - a) * F.element_at(acc, -1)["ema"]).alias("ema"))))
    return line.select("archetype", F.explode(F.aggregate(F.slice("l", 2, F.size("l")), F.array(first), step)).alias("x")).select("archetype", "x.*")


def player_records(decks: DataFrame, resolved: DataFrame, standings: DataFrame, cut: int = CUT) -> DataFrame:
    """Per name: events, wins, losses, draws, finishes in the cut, shrunk win rate and its tier."""
    from tidemark.functions.stats import shrink

    ev = decks.where("norm is not null").groupBy("norm").agg(F.count_distinct("tournament_id").alias("events"))
    m = resolved.where("status in ('mirror', 'decisive', 'no_winner') and s1 is not null and s2 is not null")
    both = F.array(F.struct(F.col("p1").alias("norm"), F.col("s1").alias("x"), F.col("s2").alias("y")), F.struct(F.col("p2").alias("norm"), F.col("s2").alias("x"), F.col("s1").alias("y")))
    r = m.select(F.explode(both).alias("e")).select("e.*").groupBy("norm").agg(F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") < F.col("y")).alias("losses"), F.count_if(F.col("x") == F.col("y")).alias("draws"))
    top = standings.where((F.col("rank") <= cut) & F.col("norm").isNotNull()).groupBy("norm").agg(F.count(F.lit(1)).alias("top"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    p = ev.join(r, "norm", "left").join(top, "norm", "left").select("norm", "events", z("wins"), z("losses"), z("draws"), z("top"))
    n = F.col("wins") + F.col("losses")
    return p.withColumn("rate", shrink(F.col("wins"), n)).withColumn("tier", tier(n))


