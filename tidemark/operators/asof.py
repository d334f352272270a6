"""Attributes as known at event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.skew import ROWS_PER_TASK, salted_join
from tidemark.session import durable

_DAY = 86_400_000_000


def as_known(
    events: DataFrame,
    history: DataFrame,
    *,
    event_id: str,
    event_entity: Column,
    event_at: Column,
    history_id: str,
    history_entity: Column,
    valid_from: Column,
    known_at: Column,
    bucket_days: int = 28,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """For each event the history row that held for its entity then, as far as it was known then.

    A history row can be used from max(known_at, valid_from) on; among usable rows the latest ``valid_from`` wins
    (null: since ever, the earliest), then the latest ``known_at``, then the largest id. Successive change times give
    half-open validity intervals; these are cut at time buckets, so the join is an equi-join on entity and bucket
    with a containment test, and values known later can never match.

    No step takes a whole entity into one task: the running best is taken inside (entity, bucket), and between
    buckets over one summary row per bucket. Hot (entity, bucket) groups of events are salted. At most 4,096 buckets
    are used; wider spans get wider buckets.

    Result: event_id, history_id; one row per distinct event with a match. Events without entity or readable time,
    history rows without entity or ``known_at``, and events before any usable row give none. Repeated rows count
    once; further columns of the inputs are ignored.
    """
    us = lambda c: F.unix_micros(c)
    hist = history.select(
        _entity(history_entity).alias("e"), us(known_at).alias("known"), us(valid_from).alias("since"), F.col(history_id).alias("id")
    ).where("e is not null and known is not null and id is not null")
    hist = hist.select("e", F.greatest("known", "since").alias("t"), F.struct(F.coalesce("since", F.lit(-(2**62))).alias("s"), "known", "id").alias("best"))
    changes = durable(hist.groupBy("e", "t").agg(F.max("best").alias("best")))  # one per entity and instant
    ev = events.select(F.col(event_id).alias("ev"), _entity(event_entity).alias("e"), us(event_at).alias("at"))
    ev = ev.where("ev is not null and e is not null and at is not null").distinct()

    lo, hi = changes.agg(F.min("t"), F.max("t")).first()
    if lo is None:  # no usable history
        return ev.select(F.col("ev").alias(event_id), F.lit(None).cast(history.schema[history_id].dataType).alias(history_id)).where("false")
    width = max(bucket_days * _DAY, (hi - lo) // 4096 + 1)
    bucket = lambda c: F.expr(f"cast(({c} - {lo}L) div {width}L as int)")
    last = (hi - lo) // width

    changes = changes.withColumn("b", bucket("t"))
    # What holds at the start of each later bucket: the best so far, exploded up to the next bucket with a change.
    per_bucket = changes.groupBy("e", "b").agg(F.max("best").alias("best"))
    seq = Window.partitionBy("e").orderBy("b")
    carried = per_bucket.select(
        "e",
        F.max("best").over(seq.rowsBetween(Window.unboundedPreceding, 0)).alias("best"),
        F.sequence(F.col("b") + 1, F.coalesce(F.lead("b").over(seq), F.lit(int(last) + 1))).alias("later"),
    ).select("e", "best", F.explode("later").alias("b"))
    opening = carried.select("e", (F.col("b").cast("long") * F.lit(width) + F.lit(lo)).alias("t"), "best", "b")
    inside = Window.partitionBy("e", "b").orderBy("t")
    cut = changes.unionByName(opening).groupBy("e", "b", "t").agg(F.max("best").alias("best"))
    intervals = cut.select(
        "e", "b", F.col("t").alias("from"), F.lead("t").over(inside).alias("to"), F.max("best").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("best")
    )
    # Events after the last change all belong to the open bucket behind it.
    ev = durable(ev.withColumn("b", F.least(bucket("at"), F.lit(int(last) + 1))))
    hit = salted_join(ev, intervals, ["e", "b"], ["ev", "at"], rows_per_task=rows_per_task)
    hit = hit.where((F.col("at") >= F.col("from")) & (F.col("to").isNull() | (F.col("at") < F.col("to"))))
    return hit.select(F.col("ev").alias(event_id), F.col("best.id").alias(history_id))


def _entity(c: Column) -> Column:
    """An empty entity is no entity."""
    return F.when(F.length(c) > 0, c)

