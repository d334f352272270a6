"""Queries on comparisons, names and set-valued records (problems 2 to 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import label_key, name_key
from tidemark.llm.aliases import alias_pairs, link_aliases
from tidemark.llm.cooccur import cooccurring
from tidemark.llm.density import core_groups, describe
from tidemark.llm.pairwise import pair_records, plan_id, rank_items
from tidemark.llm.sets import coded_sets
from tidemark.llm.setjoin import similar_pairs, similarity_links
from tidemark.plans.sql import sql_name
from tidemark.session import table


# --- 2: global ranking ---
def _plan_pairs(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "strategic_plan_cells")
    return pair_records(cells, "cell_id", plan_id(F.col("subject_id")), plan_id(F.col("opponent_id")), "wins", "losses", ["window_start", "provenance"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """(subject_id): the twelve strongest plans."""
    return rank_items(_plan_pairs(spark, sf)).where("place <= 12").select(F.col("id").alias("subject_id"))


def _ranking(r: DataFrame) -> DataFrame:
    return r.select(F.col("id").alias("subject_id"), F.round("strength", 6).alias("strength"), "games", "place")


def p2_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """All plans with strength, games and place."""
    return _ranking(rank_items(_plan_pairs(spark, sf)))


def p2_ranking_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same by joins, the way for more items than one task's matrix holds."""
    return _ranking(rank_items(_plan_pairs(spark, sf), tolerance=1e-8, dense_items=0))


def p2_pair_records(spark: SparkSession, sf: str) -> DataFrame:
    """Results of each pair of plans, every match-up counted once."""
    return _plan_pairs(spark, sf)


_PLAN = "replace(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), '_', '-')"
P2_SQL = f"""
WITH c AS (SELECT DISTINCT cell_id, window_start, provenance, {_PLAN.format('subject_id')} AS s, {_PLAN.format('opponent_id')} AS o, wins::BIGINT AS w, losses::BIGINT AS l FROM strategic_plan_cells),
v AS (SELECT *, least(s, o) AS a, greatest(s, o) AS b, CASE WHEN s < o THEN w ELSE l END AS wa FROM c WHERE s <> o AND s <> '' AND o <> '' AND w >= 0 AND l >= 0 AND w + l > 0),
g AS (SELECT a, b, window_start, provenance, wa, w + l AS n, greatest(count(*) FILTER (WHERE s < o), count(*) FILTER (WHERE s > o)) AS k FROM v GROUP BY ALL)
SELECT a, b, sum(wa * k)::BIGINT AS wins, sum(n * k)::BIGINT AS games FROM g GROUP BY a, b"""
_RANK = f"""
WITH RECURSIVE pr AS ({P2_SQL}),
e AS (SELECT a AS i, b AS j, games - wins + 0.5 AS rate, games FROM pr UNION ALL SELECT b, a, wins + 0.5, games FROM pr),
o AS (SELECT i, sum(rate)::DOUBLE AS out, sum(games)::BIGINT AS games FROM e GROUP BY 1),
p AS (SELECT e.i, j, rate / out / 2 AS p FROM e JOIN o ON e.i = o.i UNION ALL SELECT i, i, 0.5 FROM o),
x AS (SELECT 0 AS r, i AS id, 1.0::DOUBLE / (SELECT count(*) FROM o) AS mass FROM o UNION ALL SELECT x.r + 1, j, sum(mass * p)::DOUBLE FROM x JOIN p ON p.i = x.id WHERE x.r < 300 GROUP BY 1, 2),
s AS (SELECT id, mass / out AS s, games FROM x JOIN o ON id = i WHERE r = 300),
z AS (SELECT id AS subject_id, s / (SELECT sum(s) FROM s) AS v, games FROM s)
SELECT subject_id, round(v, 6) AS strength, games, row_number() OVER (ORDER BY v DESC, subject_id) AS place FROM z"""


# --- 3: spellings of names ---
def _entities(spark: SparkSession, sf: str) -> DataFrame:
    return link_aliases(table(spark, sf, "player_aliases"), "alias_id", "handle_norm", "player_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """(alias_id_a, alias_id_b): all pairs of handles of one player or team."""
    return alias_pairs(_entities(spark, sf)).select(F.col("a").alias("alias_id_a"), F.col("b").alias("alias_id_b"))


def p3_entities(spark: SparkSession, sf: str) -> DataFrame:
    """One row per handle with the entity it belongs to."""
    return _entities(spark, sf).select(F.col("id").alias("alias_id"), F.col("entity").alias("entity_id"))


# --- 4: similar pairs ---
def _deck_sets(spark: SparkSession, sf: str):
    return coded_sets(table(spark, sf, "archetype_decks"), "deck_key", "cards")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """(deck_key_a, deck_key_b): pairs of decks with Jaccard similarity of at least 0.8."""
    sets, _, hashes = _deck_sets(spark, sf)
    return similar_pairs(sets, hashes=hashes).select(F.col("key_a").alias("deck_key_a"), F.col("key_b").alias("deck_key_b"))


def p4_links(spark: SparkSession, sf: str) -> DataFrame:
    """One row per deck: class of equal lists, its size, and the number of similar decks."""
    sets, _, hashes = _deck_sets(spark, sf)
    return similarity_links(sets, hashes=hashes).select(F.col("key").alias("deck_key"), "class_key", "copies", "links")


_SETS_SQL = f"""
WITH d AS (SELECT deck_key, min(items) AS items FROM (SELECT deck_key, list_sort(list_distinct(list_filter(list_transform(coalesce(cards, []), lambda x: {sql_name('x')}), lambda x: x IS NOT NULL AND x <> ''))) AS items FROM archetype_decks WHERE deck_key IS NOT NULL) GROUP BY 1),
i AS (SELECT deck_key, len(items) AS n, unnest(items) AS item FROM d),
j AS (SELECT a.deck_key AS deck_key_a, b.deck_key AS deck_key_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM i a JOIN i b ON a.item = b.item AND a.deck_key < b.deck_key GROUP BY 1, 2),
p AS (SELECT deck_key_a, deck_key_b, k = na AND k = nb AS equal FROM j WHERE k * 10 >= 8 * (na + nb - k))
"""
P4_SQL = {
    "p4_found": _SETS_SQL + "SELECT deck_key_a, deck_key_b FROM p",
    "p4_links": _SETS_SQL
    + """, u AS (SELECT deck_key_a AS k, deck_key_b AS o, equal FROM p UNION ALL SELECT deck_key_b, deck_key_a, equal FROM p)
SELECT deck_key, CASE WHEN len(any_value(items)) > 0 THEN least(deck_key, coalesce(min(o) FILTER (WHERE equal), deck_key)) END AS class_key,
CASE WHEN len(any_value(items)) > 0 THEN 1 + count(*) FILTER (WHERE equal) ELSE 0 END::BIGINT AS copies, count(o)::BIGINT AS links
FROM d LEFT JOIN u ON d.deck_key = u.k GROUP BY deck_key""",
}


# --- 5: items together ---
def _together(spark: SparkSession, sf: str) -> DataFrame:
    main = table(spark, sf, "deck_cards").where(label_key(F.col("board")) == "main")
    return cooccurring(main, ["tournament_id", "deck_idx"], "name", normalise=name_key)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """(name_a, name_b): names that meet in main boards far more often than chance."""
    return _together(spark, sf).select(F.col("item_a").alias("name_a"), F.col("item_b").alias("name_b"))


def p5_pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with their counts, lift and pointwise mutual information."""
    return _together(spark, sf).select(F.col("item_a").alias("name_a"), F.col("item_b").alias("name_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


_P5 = f"""
WITH d AS (SELECT DISTINCT tournament_id, deck_idx, {sql_name('name')} AS name FROM deck_cards WHERE regexp_replace(lower(board), '^\\s+|\\s+$', '', 'g') = 'main' AND name IS NOT NULL AND tournament_id IS NOT NULL AND deck_idx IS NOT NULL),
e AS (SELECT * FROM d WHERE name <> ''),
t AS (SELECT count(*) AS n FROM (SELECT DISTINCT tournament_id, deck_idx FROM e)),
f AS (SELECT name, count(*) AS c FROM e GROUP BY 1),
p AS (SELECT a.name AS name_a, b.name AS name_b, count(*) AS n_ab FROM e a JOIN e b ON a.tournament_id = b.tournament_id AND a.deck_idx = b.deck_idx AND a.name < b.name GROUP BY 1, 2 HAVING count(*) >= 5),
r AS (SELECT name_a, name_b, n_ab, fa.c AS n_a, fb.c AS n_b, n FROM p JOIN f fa ON fa.name = name_a JOIN f fb ON fb.name = name_b, t WHERE n_ab * 500 >= n AND n_ab * n >= 6 * fa.c * fb.c)
"""
P5_SQL = {
    "p5_found": _P5 + "SELECT name_a, name_b FROM r",
    "p5_pair_scores": _P5 + "SELECT *, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b), 6) AS lift, round(ln(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b)), 6) AS pmi FROM r",
}


# --- 6: groups with a common core ---
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """(deck_key, cluster_key): decks of groups built on one core."""
    sets, names, hashes = _deck_sets(spark, sf)
    groups, _ = core_groups(sets, names=names, hashes=hashes)
    return groups.select(F.col("key").alias("deck_key"), "cluster_key")


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups with size, core, typical decks, and the earlier run's archetype whose stripped core is nearest."""
    sets, names, hashes = _deck_sets(spark, sf)
    g = describe(*core_groups(sets, names=names, hashes=hashes))
    old = table(spark, sf, "archetype_compositions").where("archetype is not null")
    old = old.select(F.col("archetype").alias("earlier"), F.col("n_decks").alias("earlier_decks"), F.explode_outer("stripped_core").alias("card"))
    old = old.select("earlier", "earlier_decks", name_key(F.col("card")).alias("card")).distinct()
    near = g.select("cluster_key", F.explode("core").alias("card")).join(old, "card").groupBy("cluster_key", "earlier", "earlier_decks").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    near = near.groupBy("cluster_key").agg(F.min(F.struct((-F.col("n")).alias("o"), "earlier", "earlier_decks")).alias("e"))
    return g.join(near, "cluster_key", "left").select("cluster_key", "n_records", "core", "typical", F.col("e.earlier").alias("earlier"), F.col("e.earlier_decks").alias("earlier_decks"))


QUERIES = {
    "p2_found": p2_found,
    "p2_ranking": p2_ranking,
    "p2_ranking_joined": p2_ranking_joined,
    "p2_pair_records": p2_pair_records,
    "p3_found": p3_found,
    "p3_entities": p3_entities,
    "p4_found": p4_found,
    "p4_links": p4_links,
    "p5_found": p5_found,
    "p5_pair_scores": p5_pair_scores,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
}
SQL = {"p2_found": f"SELECT subject_id FROM ({_RANK}) WHERE place <= 12", "p2_ranking": _RANK, "p2_ranking_joined": _RANK, "p2_pair_records": P2_SQL} | P4_SQL | P5_SQL
