"""The given tables as decks, cards, rounds and standings, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import label_key, name_key, time_text
from tidemark.operators.skew import latest_state
from tidemark.plans.sql import sql_label, sql_name, sql_time
from tidemark.session import durable, exists, stored, table

RESULTS = ("2-0", "2-1", "1-2", "0-2", "1-1", "2-1", "W-L")
#: Keys of one range when seats are counted.
KEY_RANGE = 65_536
#: Dates that cut the corpus into regimes, as (date, card) of announcements.
BANS = (("2023-03-01", "anvilcrown ravager"), ("2024-06-10", "marrowhorn conduit"), ("2025-05-20", "bramblehook basin"))


#: Silver tables of this process, by application, folder and name.
_SILVER: dict[tuple[str, str, str], tuple[DataFrame, str]] = {}


def _silver(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A cleaned table, built once for all queries of a session over one folder and stored with its keys normalised.

    The given tables do not change while a session reads them.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SILVER or not exists(spark, _SILVER[key][1]):
        _SILVER[key] = stored(build(spark, sf))
    return _SILVER[key][0]


def decks(spark: SparkSession, sf: str) -> DataFrame:
    return _silver(spark, sf, "decks", _decks)


def cards(spark: SparkSession, sf: str) -> DataFrame:
    return _silver(spark, sf, "cards", _cards)


def _decks(spark: SparkSession, sf: str) -> DataFrame:
    """tournament_id, deck_idx, deck_key, archetype, norm, variant, date, provenance: one row per deck of a known event."""
    t = table(spark, sf, "tournaments").groupBy(F.col("id").alias("tournament_id")).agg(F.min(time_text(F.col("date"))).cast("date").alias("date"), F.min("provenance").alias("provenance"))
    d = table(spark, sf, "archetype_decks").groupBy("tournament_id", "deck_idx").agg(
        F.min("deck_key").alias("deck_key"), F.min(F.nullif(label_key(F.col("archetype")), F.lit(""))).alias("archetype"), F.min(F.lower(F.trim("player"))).alias("norm")
    )
    v = table(spark, sf, "variant_incremental_assignments").select("tournament_id", "deck_idx", label_key(F.col("parent")).alias("parent"), "camp", time_text(F.col("assigned_at")).alias("at"))
    v = latest_state(v, ["tournament_id", "deck_idx"], "at", ["camp", "parent"])
    d = d.join(t, "tournament_id").join(v, ["tournament_id", "deck_idx"], "left")
    return d.select("tournament_id", "deck_idx", "deck_key", "archetype", "norm", F.when(F.col("parent") == F.col("archetype"), F.col("camp")).alias("variant"), "date", "provenance")


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    """tournament_id, deck_idx, board, name (key), copies: rows of a card on one board are summed, blank counts are 1.

    Names are normalised once per spelling.
    """
    raw = table(spark, sf, "deck_cards").where("name is not null")
    spelt = durable(raw.select("name").distinct().select(F.col("name").alias("raw"), name_key(F.col("name")).alias("name")).where("name <> ''"))
    c = raw.dropDuplicates().withColumnRenamed("name", "raw").join(spelt, "raw").select("tournament_id", "deck_idx", label_key(F.col("board")).alias("board"), "name", F.coalesce("count", F.lit(1)).alias("copies"))
    return c.groupBy("tournament_id", "deck_idx", "board", "name").agg(F.sum("copies").cast("int").alias("copies"))


def rounds(d: DataFrame) -> DataFrame:
    """tournament_id, match_idx, p1, p2, result: neighbours at the tables; the last of an odd number has a bye."""
    a = d.where("deck_idx % 2 = 0").select("tournament_id", (F.col("deck_idx") / 2).cast("int").alias("match_idx"), F.col("norm").alias("p1"), F.get(F.array(*[F.lit(r) for r in RESULTS]), (F.col("deck_key") % 7).cast("int")).alias("result"))
    b = d.where("deck_idx % 2 = 1").select("tournament_id", ((F.col("deck_idx") - 1) / 2).cast("int").alias("match_idx"), F.col("norm").alias("p2"))
    return a.join(b, ["tournament_id", "match_idx"], "left").select("tournament_id", "match_idx", "p1", F.coalesce("p2", F.lit("")).alias("p2"), "result")


def standings(d: DataFrame) -> DataFrame:
    """tournament_id, rank, norm: seats in the order of deck_key.

    Ranks are counted inside ranges of keys and added up over the ranges before, so that no task holds a whole event.
    """
    x = d.select("tournament_id", "deck_key", "norm", F.floor(F.col("deck_key") / KEY_RANGE).alias("range"))
    n = x.groupBy("tournament_id", "range").agg(F.count(F.lit(1)).alias("n"))
    n = n.select("tournament_id", "range", (F.sum("n").over(Window.partitionBy("tournament_id").orderBy("range")) - F.col("n")).alias("before"))
    seat = F.row_number().over(Window.partitionBy("tournament_id", "range").orderBy("deck_key"))
    return x.join(n, ["tournament_id", "range"]).select("tournament_id", (F.col("before") + seat).cast("int").alias("rank"), "norm")


_T = f"(min({sql_time('date')}) AT TIME ZONE 'UTC')::DATE"
SQL_DECKS = f"""
WITH tt AS (SELECT id, {_T} AS date, min(provenance) AS provenance FROM tournaments GROUP BY id),
dk AS (SELECT tournament_id, deck_idx, min(deck_key) AS deck_key, min(nullif({sql_label('archetype')}, '')) AS archetype, min(lower(trim(player))) AS norm FROM archetype_decks GROUP BY 1, 2),
va AS (SELECT * FROM (SELECT tournament_id, deck_idx, {sql_label('parent')} AS parent, camp, row_number() OVER (PARTITION BY tournament_id, deck_idx ORDER BY {sql_time('assigned_at')} DESC NULLS LAST, camp, {sql_label('parent')}) AS k FROM variant_incremental_assignments) WHERE k = 1),
d AS (SELECT dk.*, CASE WHEN va.parent = dk.archetype THEN camp END AS variant, date, provenance FROM dk JOIN tt ON tt.id = dk.tournament_id LEFT JOIN va ON va.tournament_id = dk.tournament_id AND va.deck_idx = dk.deck_idx),
r AS (SELECT a.tournament_id, a.deck_idx // 2 AS match_idx, a.norm AS p1, coalesce(b.norm, '') AS p2, list_extract(['2-0', '2-1', '1-2', '0-2', '1-1', '2-1', 'W-L'], (a.deck_key % 7)::INT + 1) AS result FROM d a LEFT JOIN d b ON a.tournament_id = b.tournament_id AND b.deck_idx = a.deck_idx + 1 WHERE a.deck_idx % 2 = 0),
st AS (SELECT tournament_id, row_number() OVER (PARTITION BY tournament_id ORDER BY deck_key) AS rank, norm FROM d),
cd AS (SELECT tournament_id, deck_idx, {sql_label('board')} AS board, {sql_name('name')} AS name, sum(coalesce("count", 1))::INT AS copies FROM (SELECT DISTINCT * FROM deck_cards) WHERE name IS NOT NULL AND {sql_name('name')} <> '' GROUP BY ALL),
reg AS (SELECT since, lead(since) OVER (ORDER BY since NULLS FIRST) AS until, card FROM (VALUES (NULL::DATE, NULL), {', '.join(f"('{x}'::DATE, '{c}')" for x, c in BANS)}) AS v(since, card)),
uq AS (SELECT tournament_id, norm, count(*) AS n, min(archetype) AS archetype, min(variant) AS variant, min(date) AS date, min(provenance) AS provenance, min(deck_idx) AS deck_idx FROM d WHERE norm IS NOT NULL GROUP BY 1, 2),
m AS (SELECT r.*, x.archetype AS a, y.archetype AS b, x.variant AS va, y.variant AS vb, coalesce(x.date, y.date) AS date, x.deck_idx AS ia, y.deck_idx AS ib,
  try_cast(split_part(result, '-', 1) AS INT) AS s1, try_cast(split_part(result, '-', 2) AS INT) AS s2,
  CASE WHEN p2 = '' OR p1 = '' THEN 'bye' WHEN x.n > 1 OR y.n > 1 THEN 'ambiguous' WHEN x.archetype IS NULL OR y.archetype IS NULL THEN 'unmatched' WHEN s1 IS NULL OR s2 IS NULL OR s1 = s2 THEN 'no_winner' WHEN x.archetype = y.archetype THEN 'mirror' ELSE 'decisive' END AS status
  FROM r LEFT JOIN uq x ON x.tournament_id = r.tournament_id AND x.norm = p1 LEFT JOIN uq y ON y.tournament_id = r.tournament_id AND y.norm = p2),
dir AS (SELECT a, b, va, vb, date, tournament_id, ia, ib, (s1 > s2)::INT AS win FROM m WHERE status = 'decisive' UNION ALL SELECT b, a, vb, va, date, tournament_id, ib, ia, (s2 > s1)::INT FROM m WHERE status = 'decisive'),
cell AS (SELECT a, b, sum(win)::BIGINT AS wins, count(*)::BIGINT AS n FROM dir GROUP BY 1, 2),
mar AS (SELECT a, sum(w)::BIGINT AS wins, sum(k)::BIGINT AS n FROM (SELECT a, win AS w, 1 AS k FROM dir UNION ALL SELECT a, 1, 2 FROM m WHERE status = 'mirror') GROUP BY 1)
"""
