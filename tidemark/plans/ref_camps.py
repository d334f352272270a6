"""Queries on camps inside archetypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import camps as Q
from tidemark.plans.adapters import BANS, SQL_DECKS, cards, decks
from tidemark.session import durable


def _pool(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = durable(decks(spark, sf).where("archetype is not null").select("archetype", "tournament_id", "deck_idx", "date", "variant"))
    return d, durable(cards(spark, sf).where("board = 'main'").select("tournament_id", "deck_idx", "name", "copies"))


def camp_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Gates of the camps of every archetype."""
    d, c = _pool(spark, sf)
    return Q.discover(d, c, since=BANS[-1][0])[0].withColumn("stability", F.round("stability", 6))


def camp_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Every deck with its nearest new camp."""
    d, c = _pool(spark, sf)
    return Q.discover(d, c, resamples=1)[1]


def _earlier(d: DataFrame) -> DataFrame:
    """Camps of the earlier assignment as clusters, numbered by name."""
    from pyspark.sql.window import Window

    v = d.where("variant is not null")
    n = v.select("archetype", "variant").distinct().withColumn("cluster", F.dense_rank().over(Window.partitionBy("archetype").orderBy("variant")) - 1)
    return v.join(n, ["archetype", "variant"]).select(F.col("archetype").alias("parent"), "tournament_id", "deck_idx", "cluster")


def camp_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """How the earlier camps differ in mean copies."""
    d, c = _pool(spark, sf)
    return Q.signatures(_earlier(d), c).withColumn("delta", F.round("delta", 6))


def camp_names(spark: SparkSession, sf: str) -> DataFrame:
    """What the earlier camps would be named."""
    d, c = _pool(spark, sf)
    return Q.camp_names(Q.signatures(_earlier(d), c))


def camp_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Size, median date and current share of the earlier camps."""
    d, _ = _pool(spark, sf)
    p = Q.camp_profiles(_earlier(d), d, BANS[-1][0])
    return p.withColumns({"median_date": F.col("median_date").cast("string"), "current": F.round("current", 6)})


_D = SQL_DECKS
_ER = f"""{_D}, e AS (SELECT archetype AS parent, tournament_id, deck_idx, date, (dense_rank() OVER (PARTITION BY archetype ORDER BY variant) - 1)::INT AS cluster FROM d WHERE archetype IS NOT NULL AND variant IS NOT NULL)"""
_SG = f"""{_ER}, n AS (SELECT parent, cluster, count(*) AS n FROM e GROUP BY 1, 2), c AS (SELECT parent, cluster, name, sum(copies) AS c FROM e JOIN cd ON cd.tournament_id = e.tournament_id AND cd.deck_idx = e.deck_idx WHERE board = 'main' GROUP BY 1, 2, 3), tc AS (SELECT parent, name, sum(c) AS t FROM c GROUP BY 1, 2), tn AS (SELECT parent, sum(n) AS t FROM n GROUP BY 1),
sg AS (SELECT n.parent, n.cluster, tc.name, round(coalesce(c.c, 0) / n.n::DOUBLE - coalesce((tc.t - coalesce(c.c, 0)) / nullif(tn.t - n.n, 0)::DOUBLE, 0), 9) AS delta FROM n JOIN tc ON tc.parent = n.parent JOIN tn ON tn.parent = n.parent LEFT JOIN c ON c.parent = n.parent AND c.cluster = n.cluster AND c.name = tc.name)"""
SQL = {
    "camp_signatures": f"{_SG} SELECT parent, cluster, name, round(delta, 6) AS delta FROM sg",
    "camp_names": f"""{_SG}, t AS (SELECT parent, cluster, arg_min(name, (-abs(delta), name)) AS an, arg_min(delta, (-abs(delta), name)) AS ad, arg_min(name, (-delta, name)) FILTER (WHERE delta > 0) AS up FROM sg GROUP BY 1, 2), k AS (SELECT parent, count(*) AS k, arg_min(an, cluster) AS fn, arg_min(ad, cluster) AS fd, min(cluster) AS fc FROM t GROUP BY 1),
w AS (SELECT t.parent, cluster, CASE WHEN k = 1 THEN 'single-cluster' WHEN k = 2 THEN CASE WHEN (fd > 0) = (cluster = fc) THEN fn ELSE 'non-' || fn END ELSE coalesce(up, 'camp-' || cluster) END AS camp FROM t JOIN k ON k.parent = t.parent)
SELECT parent, cluster, CASE WHEN row_number() OVER (PARTITION BY parent, camp ORDER BY cluster) > 1 THEN camp || ' (' || cluster || ')' ELSE camp END AS camp FROM w""",
    "camp_profiles": f"{_ER} SELECT parent, cluster, count(*)::BIGINT AS n, CASE WHEN count(*) >= 100 THEN 'established' WHEN count(*) >= 30 THEN 'evolving' ELSE 'speculative' END AS tier, (DATE '1970-01-01' + floor(quantile_cont(date_diff('day', DATE '1970-01-01', date), 0.5))::INT)::DATE::VARCHAR AS median_date, round(avg(coalesce(date >= DATE '{BANS[-1][0]}', FALSE)::INT), 6) AS current FROM e GROUP BY 1, 2",
}
QUERIES = {k: globals()[k] for k in ("camp_splits", "camp_assignments", "camp_signatures", "camp_names", "camp_profiles")}
