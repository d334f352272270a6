"""Queries of the general training-data problems (1 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import label_key, time_text
from tidemark.operators.asof import as_known
from tidemark.operators.skew import eager_join_rollup, latest_state
from tidemark.plans.sql import sql_label, sql_time
from tidemark.session import table


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return as_known(
        table(spark, sf, "card_events"),
        table(spark, sf, "entity_eras"),
        event_id="event_id",
        event_entity=label_key(F.col("entity")),
        event_at=time_text(F.col("date")),
        history_id="era_id",
        history_entity=label_key(F.col("entity")),
        valid_from=time_text(F.col("stable_since")),
        known_at=time_text(F.col("run_at")),
    )


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, era_id): the era row that held for the announcement's entity on its date, as known then."""
    return _known(spark, sf).select("event_id", "era_id")


def p1_event_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Announcements with the attributes of their era row."""
    eras = table(spark, sf, "entity_eras").groupBy("era_id").agg(F.min(F.struct("parent", "stable_since", "post_boundary_decks", "alarm_fired")).alias("a"))
    ev = table(spark, sf, "card_events").groupBy("event_id").agg(F.min("kind").alias("kind"))
    return (
        _known(spark, sf)
        .join(eras, "era_id")
        .join(ev, "event_id")
        .select("event_id", "kind", "era_id", label_key(F.col("a.parent")).alias("parent"), F.col("a.post_boundary_decks").alias("post_boundary_decks"), F.col("a.alarm_fired").alias("alarm_fired"))
    )


_P1_BEST = f"""
WITH ev AS (SELECT DISTINCT event_id, {sql_label('entity')} AS e, {sql_time('date')} AS ts FROM card_events),
er AS (SELECT DISTINCT era_id, {sql_label('entity')} AS e, {sql_time('stable_since')} AS since, {sql_time('run_at')} AS known FROM entity_eras),
r AS (SELECT event_id, era_id, row_number() OVER (PARTITION BY event_id ORDER BY since DESC NULLS LAST, known DESC, era_id DESC) AS k
      FROM ev JOIN er ON ev.e = er.e AND known <= ts AND (since IS NULL OR since <= ts) WHERE ts IS NOT NULL AND ev.e <> '')
"""

P1_SQL = {
    "p1_found": _P1_BEST + "SELECT event_id, era_id FROM r WHERE k = 1",
    "p1_event_attributes": _P1_BEST
    + f"""SELECT r.event_id, c.kind, r.era_id, {sql_label('x.parent')} AS parent, x.post_boundary_decks, x.alarm_fired
FROM r JOIN (SELECT DISTINCT era_id, parent, post_boundary_decks, alarm_fired FROM entity_eras) x USING (era_id)
JOIN (SELECT event_id, min(kind) AS kind FROM card_events GROUP BY 1) c USING (event_id) WHERE k = 1""",
}


def _latest_assignments(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "variant_incremental_assignments").select("tournament_id", "deck_idx", label_key(F.col("parent")).alias("parent"), "camp", time_text(F.col("assigned_at")).alias("at"))
    return latest_state(v, ["tournament_id", "deck_idx"], "at", ["camp", "parent"])


def _registered(spark: SparkSession, sf: str) -> DataFrame:
    """One row per registered deck."""
    d = table(spark, sf, "archetype_decks")
    return d.groupBy("tournament_id", "deck_idx").agg(F.min(label_key(F.col("archetype"))).alias("archetype"), F.max(F.size(F.array_distinct(F.coalesce("cards", F.array())))).alias("names"))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """One row per registered deck with a label: parent (the label key), names (distinct names on the list)."""
    d = _registered(spark, sf).where("archetype is not null and archetype <> ''")
    return d.select(F.col("archetype").alias("parent"), "names")


def p7_parent_results(spark: SparkSession, sf: str) -> DataFrame:
    """Per parent and camp: assigned decks, registered decks of that label, pairs of the two, names on the registered lists.

    Joined on the label, where a few keys hold most rows on both sides: row by row the join would give ``pairs`` rows.
    """
    r = eager_join_rollup(_latest_assignments(spark, sf), _labels(spark, sf), ["parent"], ["parent", "camp"], {}, {"names_met": F.col("names"), "pairs": F.lit(1)}, how="left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return r.select(
        "parent", "camp", F.col("n_left").alias("decks"), (zero("pairs") / F.col("n_left")).cast("long").alias("registered"), zero("pairs").alias("pairs"), (zero("names_met") / F.col("n_left")).cast("long").alias("names")
    )


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """(parent, camp): the camp with the most decks of each parent, ties to the smaller camp.

    Camps are compared by decks with and without the registered decks of the label: both orders are the same, as all
    camps of a parent meet the same registered decks.
    """
    r = p7_parent_results(spark, sf)
    top = r.groupBy("parent").agg(F.min(F.struct((-F.col("decks") - F.col("pairs")).alias("d"), "camp")).alias("s"))
    return top.select("parent", F.col("s.camp").alias("camp"))


def p7_archetype_results(spark: SparkSession, sf: str) -> DataFrame:
    """Per archetype as label key: decks, decks with card rows, card rows and copies on all their boards."""
    decks = _registered(spark, sf).withColumn("archetype", F.coalesce("archetype", F.lit("")))
    cards = table(spark, sf, "deck_cards").where("tournament_id is not null and deck_idx is not null")
    r = eager_join_rollup(decks, cards, ["tournament_id", "deck_idx"], ["archetype"], {}, {"copies": F.col("count"), "card_rows": F.lit(1)}, how="left")
    return r.select("archetype", F.col("n_left").alias("decks"), F.coalesce("card_rows", F.lit(0)).cast("long").alias("card_rows"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))


_P7_LATEST = f"""
WITH v AS (SELECT tournament_id, deck_idx, {sql_label('parent')} AS parent, camp, row_number() OVER (PARTITION BY tournament_id, deck_idx ORDER BY {sql_time('assigned_at')} DESC NULLS LAST, camp, {sql_label('parent')}) AS k FROM variant_incremental_assignments),
l AS (SELECT * FROM v WHERE k = 1),
d AS (SELECT tournament_id, deck_idx, min({sql_label('archetype')}) AS archetype, max(len(list_distinct(coalesce(cards, [])))) AS names FROM archetype_decks GROUP BY ALL)
"""

P7_SQL = {
    "p7_found": _P7_LATEST + "SELECT parent, camp FROM (SELECT parent, camp, row_number() OVER (PARTITION BY parent ORDER BY count(*) DESC, camp) AS r FROM l GROUP BY parent, camp) WHERE r = 1",
    "p7_parent_results": _P7_LATEST
    + """, g AS (SELECT parent, camp, count(*) AS decks FROM l GROUP BY 1, 2),
e AS (SELECT archetype, count(*) AS registered, sum(names) AS names FROM d WHERE archetype <> '' GROUP BY 1)
SELECT parent, camp, decks::BIGINT AS decks, coalesce(registered, 0)::BIGINT AS registered, (decks * coalesce(registered, 0))::BIGINT AS pairs, coalesce(names, 0)::BIGINT AS names FROM g LEFT JOIN e ON parent = archetype""",
    "p7_archetype_results": _P7_LATEST
    + """, c AS (SELECT tournament_id, deck_idx, count(*) AS card_rows, sum("count") AS copies FROM deck_cards GROUP BY ALL)
SELECT coalesce(archetype, '') AS archetype, count(*)::BIGINT AS decks, coalesce(sum(card_rows), 0)::BIGINT AS card_rows, coalesce(sum(copies), 0)::BIGINT AS copies FROM d LEFT JOIN c USING (tournament_id, deck_idx) GROUP BY 1""",
}

QUERIES = {
    "p1_found": p1_found,
    "p1_event_attributes": p1_event_attributes,
    "p7_found": p7_found,
    "p7_parent_results": p7_parent_results,
    "p7_archetype_results": p7_archetype_results,
}
SQL = P1_SQL | P7_SQL
