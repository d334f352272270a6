"""Queries on families of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import label_key, name_key
from tidemark.operators import families as A
from tidemark.operators.cards import core_sets
from tidemark.plans.adapters import cards, decks
from tidemark.plans.sql import sql_label, sql_name
from tidemark.session import durable, table


def _earlier(spark: SparkSession, sf: str) -> DataFrame:
    """Compositions of an earlier run, one per label: archetype, core_n, stripped, definer, cluster."""
    t = table(spark, sf, "archetype_compositions").where("archetype is not null")
    keys = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), name_key), lambda x: x.isNotNull() & (x != ""))))
    t = t.select(label_key(F.col("archetype")).alias("archetype"), F.size(keys("core")).alias("core_n"), keys("stripped_core").alias("stripped"), F.col("is_definer").alias("definer"), F.col("cluster_id").alias("cluster"))
    return t.groupBy("archetype").agg(F.min("core_n").alias("core_n"), F.min("stripped").alias("stripped"), F.max("definer").alias("definer"), F.min("cluster").alias("cluster"))


def _cores(spark: SparkSession, sf: str) -> DataFrame:
    c = core_sets(decks(spark, sf), cards(spark, sf).where("board = 'main'"))
    return durable(c.where("definer and not staple").select("archetype", "name"))


def family_support(spark: SparkSession, sf: str) -> DataFrame:
    """Branches of the tree over the cores of all defining labels with their bootstrap support."""
    labels, m = A.core_matrix(_cores(spark, sf))
    if len(labels) < 2:
        return spark.createDataFrame([], "node int, members array<int>, height double, bp double, au double")
    return A.branch_support(spark, m)


def family_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Supported families of defining labels."""
    return A.families(_cores(spark, sf))


def family_remainder(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that define nothing, with the earlier cluster they are nearest to."""
    e = _earlier(spark, sf)
    r = A.assign_remainder(e, e.where("definer and cluster is not null").select("cluster", F.col("archetype").alias("member")))
    return r.withColumn("distance", F.round("distance", 6))


def _now(spark: SparkSession, sf: str) -> DataFrame:
    """Labels grouped by their last word."""
    a = decks(spark, sf).where("archetype is not null").select("archetype").distinct()
    return a.select(F.element_at(F.split("archetype", " "), -1).alias("cluster"), F.col("archetype").alias("member"))


def family_churn(spark: SparkSession, sf: str) -> DataFrame:
    """Labels grouped by their last word against the earlier clusters."""
    old = _earlier(spark, sf).where("cluster is not null").select("cluster", F.col("archetype").alias("member"))
    return A.membership_churn(_now(spark, sf), old).withColumn("agreement", F.round("agreement", 6))


def family_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Which group by last word keeps the id of which earlier cluster."""
    old = _earlier(spark, sf).where("cluster is not null").select("cluster", F.col("archetype").alias("member"))
    return A.match_identities(_now(spark, sf), old)


def family_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Groups by last word, overruled by the earlier clusters' definers as if these were curated."""
    e = _earlier(spark, sf).where("definer and cluster is not null").select("cluster", F.col("archetype").alias("member"))
    return A.merge_curated(_now(spark, sf), e)


_E = f"""WITH e0 AS (SELECT {sql_label('archetype')} AS archetype, list_sort(list_distinct(list_filter(list_transform(coalesce(core, []), lambda x: {sql_name('x')}), lambda x: x IS NOT NULL AND x <> ''))) AS core, list_sort(list_distinct(list_filter(list_transform(coalesce(stripped_core, []), lambda x: {sql_name('x')}), lambda x: x IS NOT NULL AND x <> ''))) AS st, is_definer, cluster_id FROM archetype_compositions WHERE archetype IS NOT NULL),
e AS (SELECT archetype, min(len(core)) AS core_n, min(st) AS st, bool_or(is_definer) AS definer, min(cluster_id) AS cluster FROM e0 GROUP BY 1)"""
_NOW = f"""tt AS (SELECT DISTINCT id FROM tournaments), nw AS (SELECT DISTINCT archetype AS member, list_extract(string_split(archetype, ' '), -1) AS cluster FROM (SELECT tournament_id, deck_idx, min(nullif({sql_label('archetype')}, '')) AS archetype FROM archetype_decks GROUP BY 1, 2) JOIN tt ON tt.id = tournament_id WHERE archetype IS NOT NULL)"""
SQL = {
    "family_remainder": f"""{_E}, s AS (SELECT a.archetype, d.cluster, avg(1 - len(list_intersect(a.st, d.st)) / len(list_distinct(list_concat(a.st, d.st)))::DOUBLE) AS distance FROM e a, e d WHERE NOT a.definer AND d.definer AND d.cluster IS NOT NULL AND a.core_n >= 5 AND len(a.st) > 0 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY round(distance, 12), cluster) AS r FROM s)
SELECT e.archetype, CASE WHEN distance < 1 - 1e-12 THEN b.cluster END AS cluster, CASE WHEN distance < 1 - 1e-12 THEN round(distance, 6) END AS distance, CASE WHEN core_n < 5 THEN 'small core' WHEN len(st) = 0 THEN 'staples only' WHEN NOT coalesce(distance < 1 - 1e-12, FALSE) THEN 'shares nothing' END AS reason FROM e LEFT JOIN b ON b.archetype = e.archetype AND r = 1 WHERE NOT definer""",
    "family_churn": f"""{_E}, {_NOW}, j AS (SELECT n.member AS m, n.cluster AS x, e.cluster AS y FROM nw n JOIN e ON e.archetype = n.member WHERE e.cluster IS NOT NULL), p AS (SELECT count(*) AS t, count(*) FILTER (WHERE (a.x = b.x) = (a.y = b.y)) AS g FROM j a JOIN j b ON a.m < b.m)
SELECT (SELECT count(*) FROM j)::BIGINT AS comparable, round(g / t::DOUBLE, 6) AS agreement, (SELECT count(*) FROM j WHERE x <> y)::BIGINT AS moves, (SELECT count(*) FROM nw WHERE member NOT IN (SELECT archetype FROM e WHERE cluster IS NOT NULL))::BIGINT AS arrivals, (SELECT count(*) FROM e WHERE cluster IS NOT NULL AND archetype NOT IN (SELECT member FROM nw))::BIGINT AS departures FROM p""",
    "family_registry": f"""{_E}, {_NOW}, c AS (SELECT cluster, archetype AS member FROM e WHERE definer AND cluster IS NOT NULL)
SELECT c.cluster, c.member, 'curated' AS provenance, nw.cluster AS derived_cluster FROM c LEFT JOIN nw ON nw.member = c.member UNION ALL SELECT cluster, member, 'derived', cluster FROM nw WHERE member NOT IN (SELECT member FROM c)""",
}
QUERIES = {k: globals()[k] for k in ("family_support", "family_clusters", "family_remainder", "family_churn", "family_identities", "family_registry")}
