"""Queries on labels. The ruleset comes from the compositions of an earlier run, which are few."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import label_key, name_key
from tidemark.operators import labels as L
from tidemark.plans.adapters import SQL_DECKS, cards, decks
from tidemark.plans.sql import sql_label, sql_name
from tidemark.session import table


def _cores(spark: SparkSession, sf: str) -> list[tuple[str, list[str]]]:
    """(label, distinct names of the stripped core) of each composition, in the order of labels; curated, a hundred rows."""
    t = table(spark, sf, "archetype_compositions").where("archetype is not null")
    keys = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("stripped_core", F.array().cast("array<string>")), name_key), lambda x: x.isNotNull() & (x != ""))))
    t = t.select(label_key(F.col("archetype")).alias("label"), keys.alias("core")).groupBy("label").agg(F.min("core").alias("core"))
    return [(r["label"], list(r["core"])) for r in t.orderBy("label").collect()]


def _rules(spark: SparkSession, sf: str) -> list[dict]:
    """A deck of a label holds its first core name and two of the first six; a variant holds the last one too, none of its
    own has it on the side board."""
    c = lambda kind, names: {"type": kind, "cards": list(names)}
    return [
        {
            "name": name, "color": False, "conditions": [c("InMainboard", core[:1]), c("TwoOrMoreInMainboard", core[1:6]), c("DoesNotContainSideboard", core[1:2])],
            "variants": [{"name": name + " full", "conditions": [c("InMainboard", core[-1:]), c("OneOrMoreInMainOrSideboard", core[2:4])]}],
        }
        for name, core in _cores(spark, sf) if len(core) >= 6
    ]


def label_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Decks that meet each type of condition over the core of each composition."""
    return L.condition_counts(cards(spark, sf), _cores(spark, sf))


def rule_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label and kind of every deck by rules alone."""
    d = L.classify(L.deck_lists(cards(spark, sf)), _rules(spark, sf))
    return d.select("tournament_id", "deck_idx", "label", "kind")


def batch_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Final labels of every deck: rules, else the core with most copies as pile, else Unknown."""
    piles = [(n, c) for n, c in _cores(spark, sf) if c]
    variant_rules = [{"parent": n, "name": "with " + c[-1], "conditions": [{"type": "InMainOrSideboard", "cards": [c[-1]]}]} for n, c in piles]
    r = L.label_decks(cards(spark, sf), _rules(spark, sf), piles, variant_rules=variant_rules, defaults={n: "plain" for n, _ in piles})
    return r.select("tournament_id", "deck_idx", "label", "kind", "variant")


def split_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Decks per archetype and variant after the earlier camps were written to their members."""
    d = decks(spark, sf).where("archetype is not null").select("tournament_id", "deck_idx", "archetype", F.lit(None).cast("string").alias("variant"))
    v = table(spark, sf, "variant_incremental_assignments").select("tournament_id", "deck_idx", label_key(F.col("parent")).alias("parent"), "camp")
    return L.apply_split(d, v).groupBy("archetype", "variant").agg(F.count(F.lit(1)).alias("decks"))


_CORE = f"""co AS (SELECT label, min(core) AS core FROM (SELECT {sql_label('archetype')} AS label, list_sort(list_distinct(list_filter(list_transform(coalesce(stripped_core, []), lambda x: {sql_name('x')}), lambda x: x IS NOT NULL AND x <> ''))) AS core FROM archetype_compositions WHERE archetype IS NOT NULL) GROUP BY 1),
dl AS (SELECT tournament_id, deck_idx, list(DISTINCT name) FILTER (WHERE board = 'main') AS mn, list(DISTINCT name) FILTER (WHERE board = 'side') AS sd FROM cd GROUP BY 1, 2),
d2 AS (SELECT tournament_id, deck_idx, coalesce(mn, []) AS mn, coalesce(sd, []) AS sd FROM dl)"""
_RL = f"""{_CORE}, ok AS (SELECT tournament_id, deck_idx, label,
 len(core) > 0 AND list_contains(mn, core[len(core)]) AND (list_has_any(mn, core[3:4]) OR list_has_any(sd, core[3:4])) AS full_
 FROM d2, co WHERE len(core) >= 6 AND list_contains(mn, core[1]) AND len(list_intersect(mn, core[2:6])) >= 2 AND NOT list_contains(sd, core[2])),
rl AS (SELECT d2.tournament_id, d2.deck_idx, count(label) AS k, string_agg(CASE WHEN full_ THEN label || ' full' ELSE label END, ',' ORDER BY label) AS l, bool_or(full_) AS f FROM d2 LEFT JOIN ok ON ok.tournament_id = d2.tournament_id AND ok.deck_idx = d2.deck_idx GROUP BY 1, 2),
rk AS (SELECT tournament_id, deck_idx, CASE WHEN k = 1 THEN l WHEN k > 1 THEN 'Conflict(' || l || ')' END AS label, CASE WHEN k = 0 THEN 'unknown' WHEN k > 1 THEN 'conflict' WHEN f THEN 'variant' ELSE 'archetype' END AS kind FROM rl)"""
_D = SQL_DECKS
SQL = {
    "label_conditions": f"""{_D}, {_CORE}, x AS (SELECT label, list_contains(mn, core[1]) AS a, list_contains(sd, core[1]) AS b, len(core) AS n, len(list_intersect(mn, core)) AS nm, len(list_intersect(sd, core)) AS ns, len(list_filter(core, lambda c: list_contains(mn, c) OR list_contains(sd, c))) AS ny FROM d2, co),
y AS (SELECT label, unnest(['InMainboard', 'InSideboard', 'InMainOrSideboard', 'DoesNotContain', 'DoesNotContainMainboard', 'DoesNotContainSideboard', 'OneOrMoreInMainboard', 'OneOrMoreInSideboard', 'OneOrMoreInMainOrSideboard', 'TwoOrMoreInMainboard', 'TwoOrMoreInSideboard', 'TwoOrMoreInMainOrSideboard']) AS type,
unnest([n = 0 OR a, n = 0 OR b, n = 0 OR a OR b, n = 0 OR NOT (a OR b), n = 0 OR NOT a, n = 0 OR NOT b, n = 0 OR nm >= 1, n = 0 OR ns >= 1, n = 0 OR ny >= 1, n = 0 OR nm >= 2, n = 0 OR ns >= 2, n = 0 OR nm + ns >= 2]) AS ok FROM x)
SELECT label, type, count(*)::BIGINT AS decks FROM y WHERE ok GROUP BY 1, 2""",
    "rule_labels": f"{_D}, {_RL} SELECT * FROM rk",
    "batch_labels": f"""{_D}, {_RL}, cr AS (SELECT tournament_id, deck_idx, name, copies FROM cd), nr AS (SELECT tournament_id, deck_idx, count(*) AS n FROM cd GROUP BY 1, 2),
w AS (SELECT c.tournament_id, c.deck_idx, co.label, len(co.core) AS size, sum(copies) AS w FROM cr c JOIN co ON list_contains(core, c.name) GROUP BY 1, 2, 3, 4),
b AS (SELECT *, row_number() OVER (PARTITION BY tournament_id, deck_idx ORDER BY w DESC, size, label) AS r FROM w),
fb AS (SELECT b.tournament_id, b.deck_idx, b.label FROM b JOIN nr ON nr.tournament_id = b.tournament_id AND nr.deck_idx = b.deck_idx WHERE r = 1 AND w / n::DOUBLE > 0.1),
f AS (SELECT rk.tournament_id, rk.deck_idx, coalesce(rk.label, fb.label, 'Unknown') AS label, CASE WHEN rk.kind = 'unknown' AND fb.label IS NOT NULL THEN 'fallback' ELSE rk.kind END AS kind FROM rk LEFT JOIN fb ON fb.tournament_id = rk.tournament_id AND fb.deck_idx = rk.deck_idx AND rk.kind = 'unknown')
SELECT f.tournament_id, f.deck_idx, f.label, f.kind, CASE WHEN len(co.core) > 0 THEN CASE WHEN list_contains(mn, core[len(core)]) OR list_contains(sd, core[len(core)]) THEN 'with ' || core[len(core)] ELSE 'plain' END END AS variant FROM f JOIN d2 ON d2.tournament_id = f.tournament_id AND d2.deck_idx = f.deck_idx LEFT JOIN co ON co.label = f.label""",
    "split_applied": f"""{_D}, mm AS (SELECT tournament_id, deck_idx, {sql_label('parent')} AS parent, min(camp) AS camp FROM variant_incremental_assignments GROUP BY 1, 2, 3)
SELECT archetype, camp AS variant, count(*)::BIGINT AS decks FROM d LEFT JOIN mm ON mm.tournament_id = d.tournament_id AND mm.deck_idx = d.deck_idx AND mm.parent = d.archetype WHERE archetype IS NOT NULL GROUP BY 1, 2""",
}
QUERIES = {k: f for k, f in globals().items() if k in SQL}
