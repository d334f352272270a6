"""Eras of entities: series, composition and share breaks with permutation p, merging, acceptance, attribution, horizons.

Series have a row per entity and bucket of weeks; the detectors get the few buckets of one entity per task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.stats import optimal_partition
from tidemark.operators.eras import KERNEL_LEAST, KERNEL_PENALTY, SHARE_LEAST, SHARE_PENALTY, _entities, accept_fdr, presence_regimes, spans
from tidemark.session import durable, spread

# Fixed values of the run.
FLEX_LOW, FLEX_HIGH, COMPOSITION_DECKS, PERMUTATIONS = 0.10, 0.95, 10, 199
LEAST_BUCKETS, MERGE_BUCKETS, LEAST_AFTER = 8, 2, 30
WIN_MATCHES, WIN_SHIFT = 30, 0.05
PLAUSIBLE, TOLERANCE_DAYS, FIELD_SHARE, FIELD_DECKS = 0.25, 14, 0.02, 500


def entity_series(decks: DataFrame) -> DataFrame:
    """(entity, parent, start, idx, complete, decks, field_decks): buckets of observed weeks whose width follows the
    entity's density; a last bucket of fewer weeks than the others is incomplete."""
    w = spans(decks)
    b = w.groupBy("entity", "start").agg(F.sum("decks").alias("decks"), F.sum("field_decks").alias("field_decks"), F.count(F.lit(1)).alias("weeks"))
    seq = Window.partitionBy("entity")
    b = b.withColumn("idx", F.row_number().over(seq.orderBy("start")) - 1).withColumn("complete", F.col("weeks") == F.max("weeks").over(seq))
    return b.select("entity", F.element_at(F.split("entity", " / "), 1).alias("parent"), "start", "idx", "complete", "decks", "field_decks")


def flex_series(decks: DataFrame, cards: DataFrame) -> DataFrame:
    """(entity, name, start, k): decks of an entity with a card per bucket, for cards in 10 to 95% of its decks."""
    e = _entities(decks)
    n = e.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    week = cards.select("tournament_id", "deck_idx", "name").distinct().join(e, ["tournament_id", "deck_idx"]).groupBy("entity", "name", "week").agg(F.count(F.lit(1)).alias("k"))
    flex = week.groupBy("entity", "name").agg(F.sum("k").alias("s")).join(n, "entity").where((F.col("s") >= FLEX_LOW * F.col("n")) & (F.col("s") <= FLEX_HIGH * F.col("n"))).select("entity", "name")
    return week.join(flex, ["entity", "name"]).join(spans(decks).select("entity", "week", "start"), ["entity", "week"]).groupBy("entity", "name", "start").agg(F.sum("k").alias("k"))


def _line_gains(x: np.ndarray) -> np.ndarray:
    """Gain in squared error of each split of a series."""
    n = len(x)
    s, k = np.cumsum(x)[:-1], np.arange(1, n)
    t = x.sum()
    return s * s / k + (t - s) ** 2 / (n - k) - t * t / n


def _kernel_gains(g: np.ndarray) -> np.ndarray:
    """Gain in kernel cost of each split, from the matrix of similarities."""
    n = len(g)
    c = g.cumsum(0).cumsum(1)
    k = np.arange(1, n)
    left, row, total = c[k - 1, k - 1], c[k - 1, n - 1], c[-1, -1]
    return left / k + (total - 2 * row + left) / (n - k) - total / n


def permutation_p(gains: Callable[[np.ndarray], float], best: Callable[[np.ndarray], float], n: int, permutations: int, seed: int) -> float:
    """p of a split: how often the best split of the shuffled points gains as much. ``gains`` takes the identity order
    and gives the gain of the split itself, ``best`` an order and gives the most any admissible split gains."""
    rng, seen = np.random.default_rng(seed), gains(np.arange(n))
    return (1 + sum(best(rng.permutation(n)) >= seen - 1e-12 for _ in range(permutations))) / (permutations + 1)


def _cuts(edges: list[int], least: int, gains_of: Callable[[int, int, np.ndarray], np.ndarray], seed: int) -> list[tuple[int, float]]:
    out = []
    for a, c, b in zip(edges, edges[1:], edges[2:]):
        at = c - a

        def top(o: np.ndarray, a: int = a, b: int = b) -> float:
            return float(gains_of(a, b, o)[least - 1 : (b - a) - least].max())

        out.append((c, permutation_p(lambda o, a=a, b=b, at=at: float(gains_of(a, b, o)[at - 1]), top, b - a, PERMUTATIONS, seed)))
    return out


def share_candidates(series: DataFrame, seed: int = 0) -> DataFrame:
    """(entity, start, signal, name, magnitude, p) of breaks in the arcsine share over complete buckets."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p[p["complete"]].sort_values("start").reset_index(drop=True)
        rows = []
        if len(p) >= max(LEAST_BUCKETS, 2 * SHARE_LEAST):
            share = (p["decks"] / p["field_decks"].where(p["field_decks"] > 0)).fillna(0.0).to_numpy()
            x = 2 * np.arcsin(np.sqrt(np.clip(share, 0, 1)))
            s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
            cuts = optimal_partition(lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i), len(x), SHARE_PENALTY, SHARE_LEAST)
            edges = [0, *cuts, len(x)]
            found = _cuts(edges, SHARE_LEAST, lambda a, b, o: _line_gains(x[a:b][o]), seed)
            rows = [(p["entity"][0], p["start"][c], "share", None, abs(float(share[c:b].mean() - share[a:c].mean())), pv) for (c, pv), a, b in zip(found, edges, edges[2:])]
        return pd.DataFrame(rows, columns=["entity", "start", "signal", "name", "magnitude", "p"])

    return spread(series, "entity").groupBy("entity").applyInPandas(run, "entity string, start date, signal string, name string, magnitude double, p double")


def composition_candidates(series: DataFrame, flex: DataFrame, seed: int = 0) -> DataFrame:
    """(entity, start, signal, name, magnitude, p) of breaks in the inclusion of flex cards: kernel segmentation with cosine
    similarity over complete buckets of enough decks. name is the card that changed most."""
    per = flex.groupBy("entity", "start").agg(F.map_from_entries(F.collect_list(F.struct("name", "k"))).alias("held"))
    rows = series.where(F.col("complete") & (F.col("decks") >= COMPOSITION_DECKS)).join(per, ["entity", "start"], "left").select("entity", "start", "decks", F.to_json("held").alias("held"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        import json

        p = p.sort_values("start").reset_index(drop=True)
        held = [json.loads(h) if h else {} for h in p["held"]]
        names, rows = sorted({n for h in held for n in h}), []
        if len(p) >= max(LEAST_BUCKETS, 2 * KERNEL_LEAST) and names:
            v = np.array([[h.get(n, 0) / d for n in names] for h, d in zip(held, p["decks"])])
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            u = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
            g = u @ u.T
            np.fill_diagonal(g, 1.0)
            c = np.zeros((len(g) + 1, len(g) + 1))
            c[1:, 1:] = g.cumsum(0).cumsum(1)
            cost = lambda i, j: (j - i) - (c[j, j] - c[i, j] - c[j, i] + c[i, i]) / (j - i)
            edges = [0, *optimal_partition(cost, len(g), KERNEL_PENALTY, KERNEL_LEAST), len(g)]
            found = _cuts(edges, KERNEL_LEAST, lambda a, b, o: _kernel_gains(g[a:b, a:b][np.ix_(o, o)]), seed)
            for (at, pv), a, b in zip(found, edges, edges[2:]):
                whole = cost(a, b)
                gain = whole - cost(a, at) - cost(at, b)
                delta = np.abs(v[at:b].mean(0) - v[a:at].mean(0))
                rows.append((p["entity"][0], p["start"][at], "composition", names[int(delta.argmax())], gain / whole if whole else gain, pv))
        return pd.DataFrame(rows, columns=["entity", "start", "signal", "name", "magnitude", "p"])

    return spread(rows, "entity").groupBy("entity").applyInPandas(run, "entity string, start date, signal string, name string, magnitude double, p double")


def presence_candidates(decks: DataFrame, cards: DataFrame) -> DataFrame:
    """(entity, start, signal, name, magnitude, p) of adopted and dropped cards."""
    x = presence_regimes(decks, cards)
    return x.select("entity", "start", F.when(F.col("after") > F.col("before"), "presence-adopt").otherwise("presence-drop").alias("signal"), "name", F.abs(F.col("after") - F.col("before")).alias("magnitude"), "p")


def corroborate(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Candidates (entity, start, ..) with rate_before, rate_after and corroborated: both sides have 30 matches and the
    rates differ by 0.05. ``results``: (entity, date, win), one row per side of a match."""
    k = ["entity", "start"]
    d = results.groupBy("entity", "date").agg(F.sum("win").alias("w"), F.count(F.lit(1)).alias("n"))  # days of an entity are few
    x = candidates.select(*k).distinct().join(d, "entity")
    late = F.col("date") >= F.col("start")
    one = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0))
    x = x.groupBy(*k).agg(one(~late, "w").alias("wb"), one(~late, "n").alias("nb"), one(late, "w").alias("wa"), one(late, "n").alias("na"))
    before, after = F.col("wb") / F.nullif("nb", F.lit(0)), F.col("wa") / F.nullif("na", F.lit(0))
    sure = (F.col("nb") >= WIN_MATCHES) & (F.col("na") >= WIN_MATCHES) & (F.round(F.abs(after - before), 12) >= WIN_SHIFT)
    return candidates.join(x.select(*k, before.alias("rate_before"), after.alias("rate_after"), sure.alias("corroborated")), k, "left").withColumn("corroborated", F.coalesce("corroborated", F.lit(False)))


def merge_candidates(candidates: DataFrame, buckets: DataFrame, tolerance: int = MERGE_BUCKETS) -> DataFrame:
    """(entity, start, p, signals): candidates of an entity chained by gaps of at most ``tolerance`` of its buckets become
    one boundary, that of the smallest p (ties: the earliest). ``buckets``: (entity, start, idx)."""
    c = candidates.join(buckets.select("entity", "start", "idx"), ["entity", "start"])
    seq = Window.partitionBy("entity").orderBy("idx", "p", "signal")
    c = c.withColumn("new", F.when(F.col("idx") - F.lag("idx").over(seq) <= tolerance, 0).otherwise(1)).withColumn("group", F.sum("new").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    g = c.groupBy("entity", "group").agg(F.min(F.struct("p", "idx", "start")).alias("b"), F.count(F.lit(1)).alias("signals"))
    return g.select("entity", "b.start", "b.p", "signals")


def derive(boundaries: DataFrame, series: DataFrame, parents: DataFrame, alpha: float = 0.05, least_after: int = LEAST_AFTER) -> DataFrame:
    """(entity, stable_since, inherited): the last boundary that false-discovery control over all entities accepts and
    that has ``least_after`` decks from it on. A camp without one takes its parent's; else the later of both holds.

    ``series``: (entity, start, decks); ``parents``: (entity, parent) of all entities.
    """
    b = accept_fdr(boundaries, alpha=alpha).where("accepted").select("entity", "start")
    after = b.join(series.select("entity", F.col("start").alias("at"), "decks"), "entity").where("at >= start").groupBy("entity", "start").agg(F.sum("decks").alias("after")).where(F.col("after") >= least_after)
    own = after.groupBy("entity").agg(F.max("start").alias("own"))
    up = own.select(F.col("entity").alias("parent"), F.col("own").alias("above"))
    x = parents.join(own, "entity", "left").join(up, "parent", "left")
    camp = F.col("entity") != F.col("parent")
    return x.select("entity", F.when(camp, F.greatest("own", "above")).otherwise(F.col("own")).alias("stable_since"), F.coalesce(camp & F.col("own").isNull() & F.col("above").isNotNull(), F.lit(False)).alias("inherited"))


def first_seen(decks: DataFrame, cards: DataFrame) -> DataFrame:
    """(name, first): first event date of each card."""
    return cards.select("tournament_id", "deck_idx", "name").join(decks.where("date is not null").select("tournament_id", "deck_idx", "date"), ["tournament_id", "deck_idx"]).groupBy("name").agg(F.min("date").alias("first"))


def attribute(boundaries: DataFrame, events: DataFrame, inclusion: DataFrame, adopted: DataFrame | None = None, released: DataFrame | None = None, days: int = TOLERANCE_DAYS) -> DataFrame:
    """(entity, start, kind, card): what a boundary may come from.

    ``events`` (date, card): of the date nearest to the boundary (ties: earlier) all cards are ranked: included in at
    least 25% of the entity's decks before, then unknown, then less; higher inclusion, then name. If the first is not
    of the last kind, it is a 'ban'. Else a card adopted at the boundary (entity, start, name) whose release (name,
    first) is as near is a 'release'; else 'unattributed'. ``inclusion``: (entity, name, day, k, n) with running counts
    before each day's end, of which the last before the boundary is taken.
    """
    day = lambda c: F.floor(F.unix_date(c) / days).cast("int")
    b = boundaries.select("entity", "start").where("start is not null").distinct()
    near = b.withColumn("slot", F.explode(F.sequence(day("start") - 1, day("start") + 1)))
    e = events.where("date is not null and card is not null").select("date", "card").distinct().withColumn("slot", day("date"))
    x = near.join(e, "slot").withColumn("dist", F.abs(F.date_diff("start", "date"))).where(F.col("dist") <= days).drop("slot")
    best = x.groupBy("entity", "start").agg(F.min(F.struct("dist", "date")).alias("m")).select("entity", "start", "m.date")
    x = x.join(best, ["entity", "start", "date"]).select("entity", "start", "card").distinct()
    rate = x.join(inclusion.withColumnRenamed("name", "card"), ["entity", "card"]).where("day < start").groupBy("entity", "start", "card").agg(F.max_by(F.col("k") / F.col("n"), "day").alias("rate"))
    x = x.join(rate, ["entity", "start", "card"], "left")
    rank = F.when(F.col("rate") >= PLAUSIBLE, 0).when(F.col("rate").isNull(), 1).otherwise(2)
    first = x.groupBy("entity", "start").agg(F.min(F.struct(rank.alias("t"), (-F.coalesce("rate", F.lit(0.0))).alias("r"), "card")).alias("f"))
    r = b.join(first.where("f.t < 2").select("entity", "start", F.col("f.card").alias("ban")), ["entity", "start"], "left")
    if adopted is not None and released is not None:
        y = adopted.select("entity", "start", "name").join(released, "name").where(F.abs(F.date_diff("first", "start")) <= days)
        r = r.join(y.groupBy("entity", "start").agg(F.min("name").alias("release")), ["entity", "start"], "left")
    else:
        r = r.withColumn("release", F.lit(None).cast("string"))
    return r.select("entity", "start", F.when(F.col("ban").isNotNull(), "ban").when(F.col("release").isNotNull(), "release").otherwise("unattributed").alias("kind"), F.coalesce("ban", "release").alias("card"))


def running_inclusion(decks: DataFrame, cards: DataFrame) -> DataFrame:
    """(entity, name, day, k, n): decks of the entity with the card, and all its decks, up to and with each day on which
    it had the card."""
    e = decks.where("archetype is not null and date is not null")
    names = F.array_compact(F.array("archetype", F.when(F.col("variant").isNotNull(), F.concat_ws(" / ", "archetype", "variant"))))
    e = e.select("tournament_id", "deck_idx", F.explode(names).alias("entity"), F.col("date").alias("day"))
    until = lambda *k: Window.partitionBy(*k).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    n = e.groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.sum("n").over(until("entity")))  # days of an entity
    k = cards.select("tournament_id", "deck_idx", "name").distinct().join(e, ["tournament_id", "deck_idx"]).groupBy("entity", "name", "day").agg(F.count(F.lit(1)).alias("k"))
    return k.withColumn("k", F.sum("k").over(until("entity", "name"))).join(n, ["entity", "day"])


def horizons(labels: DataFrame, eras: DataFrame, bans: DataFrame) -> DataFrame:
    """(label, since, source): from when an entity's results count: its own era row, else its parent's, else the ban
    horizon of its parent. ``labels``: (label, parent); ``eras``: (entity, stable_since); ``bans``: (archetype, valid_since)."""
    own = eras.select(F.col("entity").alias("label"), F.col("stable_since").alias("own"), F.lit(True).alias("has"))
    up = eras.select(F.col("entity").alias("parent"), F.col("stable_since").alias("above"), F.lit(True).alias("has_above"))
    x = labels.join(own, "label", "left").join(up, "parent", "left").join(bans.select(F.col("archetype").alias("parent"), "valid_since"), "parent", "left")
    has, above = F.coalesce("has", F.lit(False)), F.coalesce("has_above", F.lit(False)) & (F.col("label") != F.col("parent"))
    return x.select("label", F.when(has, F.col("own")).when(above, F.col("above")).otherwise(F.col("valid_since")).alias("since"), F.when(has, "era").when(above, "era-parent").otherwise("ban-only").alias("source"))


def field_era(decks: DataFrame, eras: DataFrame, regime_start, least_share: float = FIELD_SHARE, least_decks: int = FIELD_DECKS) -> DataFrame:
    """One row (since, source): the latest boundary of a parent with at least 2% of all decks, if it is later than the
    start of the current regime and enough decks follow; else that start."""
    spark = decks.sparkSession
    total = decks.where("archetype is not null").groupBy("archetype").agg(F.count(F.lit(1)).alias("k"))
    n = total.agg(F.sum("k").alias("n"))
    big = total.join(F.broadcast(n)).where(F.round(F.col("k") / F.col("n"), 12) >= least_share).select(F.col("archetype").alias("entity"))
    late = eras.join(big, "entity", "left_semi").agg(F.max("stable_since").alias("late"))  # one row
    after = decks.where("date is not null").groupBy("date").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(late)).where("date >= late").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("after"))
    start = spark.createDataFrame([(regime_start,)], "start string").select(F.col("start").cast("date").alias("start"))
    x = start.join(F.broadcast(late)).join(F.broadcast(after))
    source = F.when(F.col("late").isNull(), "regime: no disturbance").when(F.col("late") <= F.col("start"), "regime: none later").when(F.col("after") < least_decks, "regime: thin").otherwise("boundary")
    return x.select(F.when(source == "boundary", F.col("late")).otherwise(F.col("start")).alias("since"), source.alias("source"))


def run(decks: DataFrame, cards: DataFrame, results: DataFrame, events: DataFrame, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(entity, parent, stable_since, inherited, boundaries): the whole pipeline. boundaries is an array of (start, p,
    accepted, kind, card, corroborated)."""
    decks = durable(decks)
    series = durable(entity_series(decks))
    cands = presence_candidates(decks, cards).unionByName(share_candidates(series, seed)).unionByName(composition_candidates(series, flex_series(decks, cards), seed))
    cands = durable(cands)
    merged = durable(accept_fdr(merge_candidates(cands, series), alpha=alpha))
    eras = derive(merged.drop("accepted"), series, series.select("entity", "parent").distinct(), alpha)
    adopted = cands.where("signal = 'presence-adopt'").select("entity", "start", "name")
    what = attribute(merged, events, running_inclusion(decks, cards), adopted, first_seen(decks, cards))
    notes = corroborate(merged, results).join(what, ["entity", "start"])
    notes = notes.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("start", F.round("p", 9).alias("p"), "accepted", "kind", "card", "corroborated"))).alias("boundaries"))
    return eras.join(series.select("entity", "parent").distinct(), "entity").join(notes, "entity", "left").select("entity", "parent", "stable_since", "inherited", "boundaries")
