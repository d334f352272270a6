"""Change points of entity series: buckets, presence crossings, share and composition breaks, alarms, attribution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.stats import bocpd, fisher_udf, optimal_partition
from tidemark.session import spread

# Fixed values of the detectors.
PRESENT, ABSENT = 0.25, 0.05
SHARE_PENALTY, SHARE_LEAST = 0.003, 2
KERNEL_PENALTY, KERNEL_LEAST = 0.5, 3


def buckets(decks: DataFrame, weeks: int = 1) -> DataFrame:
    """(entity, bucket, start, decks, field_decks): decks per entity in buckets of ``weeks`` weeks that hold decks at
    all; entities are archetypes and their camps ('archetype / camp'), so a deck counts for both."""
    d = decks.where("archetype is not null and date is not null").withColumn("start", F.date_trunc("week", "date").cast("date"))
    if weeks > 1:
        epoch = F.lit("1970-01-05").cast("date")
        d = d.withColumn("start", F.date_add(epoch, (F.floor(F.date_diff("start", epoch) / (7 * weeks)) * 7 * weeks).cast("int")))
    field = d.groupBy("start").agg(F.count(F.lit(1)).alias("field_decks"))
    names = F.array_compact(F.array("archetype", F.when(F.col("variant").isNotNull(), F.concat_ws(" / ", "archetype", "variant"))))
    e = d.select("start", F.explode(names).alias("entity")).groupBy("entity", "start").agg(F.count(F.lit(1)).alias("decks"))
    grid = e.select("entity").distinct().join(F.broadcast(field))  # weeks are few
    return grid.join(e, ["entity", "start"], "left").select("entity", "start", F.coalesce("decks", F.lit(0)).cast("long").alias("decks"), "field_decks")


def _entities(decks: DataFrame) -> DataFrame:
    """(tournament_id, deck_idx, entity, week): a deck for its archetype and, if it has one, its camp."""
    d = decks.where("archetype is not null and date is not null")
    names = F.array_compact(F.array("archetype", F.when(F.col("variant").isNotNull(), F.concat_ws(" / ", "archetype", "variant"))))
    return d.select("tournament_id", "deck_idx", F.explode(names).alias("entity"), F.date_trunc("week", "date").cast("date").alias("week"))


def spans(decks: DataFrame) -> DataFrame:
    """(entity, week, decks, field_decks, start): observed weeks with the start of the entity's bucket; a median of at
    least 10 weekly decks (zeros included) gives buckets of one observed week, of 5 two, less four."""
    w = buckets(decks).withColumnRenamed("start", "week")
    m = w.groupBy("entity").agg(F.median("decks").alias("m"))
    m = m.select("entity", F.when(F.col("m") >= 10, 1).when(F.col("m") >= 5, 2).otherwise(4).alias("weeks"))
    # each entity has all observed weeks
    k = F.row_number().over(Window.partitionBy("entity").orderBy("week")) - 1
    x = w.join(m, "entity").withColumn("bucket", F.floor(k / F.col("weeks")))
    return x.select("entity", "week", "decks", "field_decks", F.min("week").over(Window.partitionBy("entity", "bucket")).alias("start"))


def adaptive_buckets(decks: DataFrame) -> DataFrame:
    """(entity, start, decks, field_decks) in buckets of 1, 2 or 4 observed weeks, by the entity's density."""
    return spans(decks).groupBy("entity", "start").agg(F.sum("decks").alias("decks"), F.sum("field_decks").alias("field_decks"))


def presence_regimes(decks: DataFrame, cards: DataFrame, jump: float = 0.5, pooled: int = 4, least: int = 40) -> DataFrame:
    """(entity, name, start, before, after, p): crossings of archetypes and camps between successive adaptive buckets
    that hold decks. A crossing is confirmed by its jump or by the next bucket, and holds for up to ``pooled`` buckets
    of at least ``least`` decks on each side together, whose counts give Fisher's p."""
    at = spans(decks).select("entity", "week", "start", "decks")
    b = at.groupBy("entity", "start").agg(F.sum("decks").alias("decks")).where("decks > 0")
    n = cards.select("tournament_id", "deck_idx", "name").distinct().join(_entities(decks), ["tournament_id", "deck_idx"]).groupBy("entity", "name", "week").agg(F.count(F.lit(1)).alias("k"))
    n = n.join(at.drop("decks"), ["entity", "week"]).groupBy("entity", "name", "start").agg(F.sum("k").alias("k"))
    seen = n.join(b, ["entity", "start"]).where(F.col("k") >= PRESENT * F.col("decks")).select("entity", "name").distinct()  # a crossing needs such a bucket
    x = seen.join(b, "entity").join(n, ["entity", "name", "start"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    w = Window.partitionBy("entity", "name").orderBy("start")
    rate = F.col("k") / F.col("decks")
    x = x.withColumns({"before": F.lag(rate).over(w), "after": rate, "next": F.lead(rate).over(w)})
    for side, rows in (("b", w.rowsBetween(-pooled, -1)), ("a", w.rowsBetween(0, pooled - 1))):
        x = x.withColumns({f"k{side}": F.sum("k").over(rows), f"n{side}": F.sum("decks").over(rows)})
    pb, pa = F.col("kb") / F.col("nb"), F.col("ka") / F.col("na")
    sure = F.abs(F.col("after") - F.col("before")) >= jump
    gone = (F.col("before") >= PRESENT) & (F.col("after") < ABSENT) & (sure | (F.col("next") < ABSENT)) & (pb >= PRESENT) & (pa < ABSENT)
    come = (F.col("before") < ABSENT) & (F.col("after") >= PRESENT) & (sure | (F.col("next") >= PRESENT)) & (pb < ABSENT) & (pa >= PRESENT)
    x = x.where((F.least("nb", "na") >= least) & (gone | come))
    return x.select("entity", "name", "start", "before", "after", fisher_udf("kb", F.col("nb") - F.col("kb"), "ka", F.col("na") - F.col("ka")).alias("p"))


def presence(decks: DataFrame, cards: DataFrame, weeks: int = 4, least: int = 5) -> DataFrame:
    """(entity, name, start, before, after): cards whose inclusion crosses from at least 25% to under 5% or back
    between successive buckets of at least ``least`` decks of the entity."""
    b = buckets(decks, weeks).where(F.col("decks") >= least).select("entity", "start", "decks")
    b = b.withColumn("prev", F.lag("start").over(Window.partitionBy("entity").orderBy("start"))).withColumn("prev_decks", F.lag("decks").over(Window.partitionBy("entity").orderBy("start")))
    epoch = F.lit("1970-01-05").cast("date")
    d = decks.where("archetype is not null and date is not null").select("tournament_id", "deck_idx", F.col("archetype").alias("entity"), F.date_add(epoch, (F.floor(F.date_diff("date", epoch) / (7 * weeks)) * 7 * weeks).cast("int")).alias("start"))
    n = cards.select("tournament_id", "deck_idx", "name").distinct().join(d, ["tournament_id", "deck_idx"]).groupBy("entity", "name", "start").agg(F.count(F.lit(1)).alias("k"))
    seen = n.join(b.select("entity", "start"), ["entity", "start"], "left_semi").select("entity", "name").distinct()
    pair = seen.join(b.where("prev is not null"), "entity").join(n, ["entity", "name", "start"], "left").join(n.select("entity", "name", F.col("start").alias("prev"), F.col("k").alias("pk")), ["entity", "name", "prev"], "left")
    before, after = F.coalesce("pk", F.lit(0)) / F.col("prev_decks"), F.coalesce("k", F.lit(0)) / F.col("decks")
    x = pair.select("entity", "name", "start", before.alias("before"), after.alias("after"))
    return x.where(((F.col("before") >= PRESENT) & (F.col("after") < ABSENT)) | ((F.col("before") < ABSENT) & (F.col("after") >= PRESENT)))


def _share(p: pd.DataFrame) -> pd.DataFrame:
    p = p.sort_values("start").reset_index(drop=True)
    x = np.arcsin(np.sqrt(p["decks"].to_numpy() / p["field_decks"].to_numpy()))
    s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    cuts = optimal_partition(lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i), len(x), SHARE_PENALTY * max(1.0, np.log(len(x) + 1)), SHARE_LEAST)
    edges = [0, *cuts, len(x)]
    return pd.DataFrame([(p["entity"][0], p["start"][c], float(x[a:c].mean()), float(x[c:b].mean())) for a, c, b in zip(edges, cuts, edges[2:])], columns=["entity", "start", "before", "after"])


def share_breaks(series: DataFrame) -> DataFrame:
    """(entity, start, before, after): breaks of an entity's arcsine share, exact penalised segmentation per entity.
    A series has one point per bucket, so a task holds few rows whatever the number of decks."""
    return spread(series, "entity").groupBy("entity").applyInPandas(_share, "entity string, start date, before double, after double")


def _alarm(p: pd.DataFrame) -> pd.DataFrame:
    p = p.sort_values("start").reset_index(drop=True)
    prob = bocpd(p["decks"].to_numpy(), p["field_decks"].to_numpy())
    return pd.DataFrame({"entity": p["entity"], "start": p["start"], "p_change": np.round(prob, 9)})


def drift_alarms(series: DataFrame, least_share: float = 0.02) -> DataFrame:
    """(entity, p_change, alarm): highest probability of a fresh run in the last three buckets; alarm from 0.5 if the
    recent share is worth it."""
    probs = spread(series, "entity").groupBy("entity").applyInPandas(_alarm, "entity string, start date, p_change double")
    last = Window.partitionBy("entity").orderBy(F.col("start").desc())
    x = probs.join(series, ["entity", "start"]).withColumn("k", F.row_number().over(last)).where("k <= 3")
    x = x.groupBy("entity").agg(F.max("p_change").alias("p_change"), (F.sum("decks") / F.sum("field_decks")).alias("share"))
    return x.select("entity", "p_change", ((F.col("p_change") >= 0.5) & (F.col("share") >= least_share)).alias("alarm"))


def accept_fdr(candidates: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg over all candidates: the largest p at or under alpha * rank / m is the threshold.

    Ranks come from counts per distinct p (ties share the highest rank), added up along the sorted partitions, so
    no task holds all candidates. Null p is never accepted.
    """
    c = candidates.where(F.col(p).isNotNull())
    m = c.count()
    counts = c.groupBy(F.col(p).alias("v")).agg(F.count(F.lit(1)).alias("n")).sort("v").rdd
    sizes = dict(counts.mapPartitionsWithIndex(lambda i, it: [(i, sum(r["n"] for r in it))]).collect())
    offset = {i: sum(n for j, n in sizes.items() if j < i) for i in sizes}

    def best(i, it):
        rank, top = offset.get(i, 0), None
        for r in it:
            rank += r["n"]
            if r["v"] <= alpha * rank / m:
                top = r["v"]
        return [] if top is None else [top]

    found = counts.mapPartitionsWithIndex(best).collect() if m else []
    limit = max(found, default=None)
    return candidates.withColumn("accepted", F.coalesce(F.col(p) <= F.lit(limit).cast("double"), F.lit(False)))


def nearest_event(boundaries: DataFrame, events: DataFrame, days: int = 14) -> DataFrame:
    """Boundaries (id, at) with the nearest event date within ``days`` (ties to the earlier); a boundary is joined to
    the few day buckets around it, not to all events."""
    day = lambda c: F.floor(F.date_diff(F.col(c), F.lit("1970-01-01").cast("date")) / days).cast("int")
    b = boundaries.where("at is not null").withColumn("k", F.explode(F.sequence(day("at") - 1, day("at") + 1)))
    e = events.select(F.col("date").alias("event_date")).where("event_date is not null").distinct().withColumn("k", day("event_date"))
    x = b.join(e, "k").withColumn("dist", F.abs(F.date_diff("at", "event_date"))).where(F.col("dist") <= days)
    best = x.groupBy("id").agg(F.min(F.struct("dist", "event_date")).alias("m"))
    return boundaries.join(best, "id", "left").select("id", "at", F.col("m.event_date").alias("event_date"))
