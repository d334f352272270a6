"""Queries on fields and rankings in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import shrink
from tidemark.operators import cards as C
from tidemark.operators import matches as M
from tidemark.operators import ranking as K
from tidemark.operators import shares as S
from tidemark.plans.adapters import SQL_DECKS, cards, decks, rounds
from tidemark.plans.ref_matches import _CW, _SH, _SHRINK
from tidemark.session import durable


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _base(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Decks, resolved matches, cells, and the field of labels that are no fringe."""
    d = durable(decks(spark, sf))
    r = durable(M.resolve(rounds(d), d))
    return d, r, durable(M.tallies(r)), S.shares(S.raw_counts(d)).where("not fringe").select("archetype", "n", "share")


def covered_cells(spark: SparkSession, sf: str) -> DataFrame:
    _, _, c, f = _base(spark, sf)
    return _r(K.covered(c, f), "share")


def covered_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Each subject's field on the labels it has cells of ten games against."""
    _, _, c, f = _base(spark, sf)
    x = K.covered(c, f, 10)
    return _r(K.restricted(x.select("a", "archetype", "share"), x.where("covered"), "a"), "share", "excluded")


def restricted_field(spark: SparkSession, sf: str) -> DataFrame:
    """The field on the labels that have camps."""
    d, _, _, f = _base(spark, sf)
    return _r(K.restricted(f.select("archetype", "share"), d.where("variant is not null").select("archetype")), "share", "excluded")


def row_points(spark: SparkSession, sf: str) -> DataFrame:
    _, _, c, f = _base(spark, sf)
    return _r(K.row_points(c, f), "share", "rate")


def _modes(p: DataFrame) -> DataFrame:
    """Every subject is a configuration together with the one before it by name."""
    from pyspark.sql.window import Window

    a = p.select("a").distinct()
    a = a.withColumn("prev", F.lag("a").over(Window.partitionBy(F.lit(1)).orderBy("a")))  # one row for each label
    return a.select(F.col("a").alias("config"), F.explode(F.array_compact(F.array("a", "prev"))).alias("a"))


def config_points(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of labels as configurations with two modes; the smaller mode is lifted by two points everywhere."""
    _, _, c, f = _base(spark, sf)
    p = durable(K.row_points(c, f))
    m = _modes(p)
    lifts = m.where("a < config").join(p.select("a", "b"), "a").select("config", "a", "b", F.lit(0.02).alias("lift"))
    return _r(K.config_points(p, m, lifts), "share", "base", "adjusted")


def config_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The first and the last label by name as configurations; the lift is on the field's largest label."""
    _, _, c, f = _base(spark, sf)
    p = durable(K.row_points(c, f))
    lo, hi = p.agg(F.min("a"), F.max("a")).first()
    if lo is None:
        lo = hi = ""
    pts = K.config_points(p, _modes(p))
    big = f.orderBy(F.col("n").desc(), "archetype").limit(1).select(F.col("archetype").alias("b"))  # the largest label is the feature
    return _r(K.compare_configs(pts, lo, hi, big), "first_base", "first_adjusted", "first_shown", "second_base", "second_adjusted", "second_shown", "difference", "break_even")


def deck_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """All subjects by the lower quartile of their drawn scores."""
    _, _, c, f = _base(spark, sf)
    return _r(K.rank_decks(durable(K.score_draws(c, f))), "mean", "lo", "hi", "quantile", "p_best")


def deck_duels(spark: SparkSession, sf: str) -> DataFrame:
    """How often each label of the field scores more than each other one."""
    _, _, c, f = _base(spark, sf)
    c = c.join(f.select(F.col("archetype").alias("a")), "a", "left_semi")
    return _r(K.pairwise(durable(K.score_draws(c, f))), "p")


def paired_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The two most played labels as configurations, over shared draws."""
    _, _, c, f = _base(spark, sf)
    top = [r[0] for r in f.orderBy(F.col("n").desc(), "archetype").limit(2).collect()]  # two labels
    if len(top) < 2:
        return spark.createDataFrame([], "config string, mean double, lo double, hi double, p_first double")
    return K.paired_configs(c, f, {x: [x] for x in top})


def card_adjusted_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of every label with a consensus list, moved by the lifts of its cards."""
    d, r, c, f = _base(spark, sf)
    cd = durable(cards(spark, sf))
    w = durable(M.card_winrates(r, cd.where("board = 'main'")))
    own = w.where("b is null").select("name", shrink(F.col("wins"), F.col("n")).alias("own"))
    v = w.where("b is not null").join(own, "name").select("name", "b", (shrink(F.col("wins"), F.col("n"), F.col("own")) - F.col("own")).alias("lift"), "n")
    deck = C.frequencies(d.where("archetype is not null"), cd.where("board = 'main'"), "archetype").where(F.round("inclusion", 9) >= 0.5).select(F.col("archetype").alias("a"), "name", F.col("modal").alias("copies"))
    return _r(K.card_adjusted(K.row_points(c, f), deck, v, least=5), "share", "rate", "nudge", "adjusted")


def share_tails(spark: SparkSession, sf: str) -> DataFrame:
    """Lower quartile of each label's share."""
    _, _, _, f = _base(spark, sf)
    return _r(K.share_bounds(f), "share", "tail")


_F = f"{SQL_DECKS}, {_SH}, fd AS (SELECT archetype, n, share FROM sh WHERE share >= 0.02), ca AS (SELECT DISTINCT a FROM cell)"
_RP = f"""{_F}, kn AS (SELECT a, b, {_SHRINK.format(w='wins', n='n')} AS p, n FROM cell WHERE a <> b), rp AS (SELECT ca.a, fd.archetype AS b, share, CASE WHEN ca.a = fd.archetype THEN 0.5::DOUBLE ELSE coalesce(p, avg(p) OVER (PARTITION BY ca.a), 0.5::DOUBLE) END AS rate, coalesce(kn.n, 0)::BIGINT AS n, ca.a <> fd.archetype AND p IS NULL AS imputed FROM ca CROSS JOIN fd LEFT JOIN kn ON kn.a = ca.a AND kn.b = fd.archetype),
md AS (SELECT config, unnest(l) AS a FROM (SELECT a AS config, list_filter([a, lag(a) OVER (ORDER BY a)], lambda x: x IS NOT NULL) AS l FROM ca))"""


def _cp(lift: str) -> str:
    return f"ad AS (SELECT config, rp.*, least(1::DOUBLE, greatest(0::DOUBLE, rate + {lift})) AS adj FROM rp JOIN md ON md.a = rp.a), cp AS (SELECT config, b, share, base, adj AS adjusted, a AS mode, n, imputed FROM (SELECT *, max(rate) OVER (PARTITION BY config, b) AS base, row_number() OVER (PARTITION BY config, b ORDER BY adj DESC, a) AS r FROM ad) WHERE r = 1)"


SQL = {
    "covered_cells": f"{_F} SELECT ca.a, archetype, round(share, 6) AS share, ca.a = archetype OR coalesce(cell.n, 0) >= 30 AS covered FROM ca CROSS JOIN fd LEFT JOIN cell ON cell.a = ca.a AND cell.b = archetype",
    "covered_fields": f"{_F}, x AS (SELECT ca.a, archetype, share FROM ca CROSS JOIN fd LEFT JOIN cell ON cell.a = ca.a AND cell.b = archetype WHERE ca.a = archetype OR coalesce(cell.n, 0) >= 10) SELECT a, archetype, round(share / sum(share) OVER (PARTITION BY a), 6) AS share, round((SELECT sum(share) FROM fd) - sum(share) OVER (PARTITION BY a), 6) AS excluded FROM x",
    "restricted_field": f"{_F}, x AS (SELECT * FROM fd WHERE archetype IN (SELECT archetype FROM d WHERE variant IS NOT NULL)) SELECT archetype, round(share / sum(share) OVER (), 6) AS share, round((SELECT sum(share) FROM fd) - sum(share) OVER (), 6) AS excluded FROM x",
    "row_points": f"{_RP} SELECT a, b, round(share, 6) AS share, round(rate, 6) AS rate, n, imputed FROM rp",
    "config_points": f"{_RP}, {_cp('CASE WHEN rp.a < config THEN 0.02::DOUBLE ELSE 0 END')} SELECT config, b, round(share, 6) AS share, round(base, 6) AS base, round(adjusted, 6) AS adjusted, mode, n, imputed FROM cp",
    "config_comparison": f"""{_RP}, {_cp('0')}, ev AS (SELECT config, sum(share * base) AS base, sum(share * adjusted) AS adj, coalesce(sum(share) FILTER (WHERE n >= 30), 0) AS shown FROM cp GROUP BY 1), x AS (SELECT f.base AS fb, f.adj AS fa, f.shown AS fs, s.base AS sb, s.adj AS sa, s.shown AS ss, (SELECT share FROM fd ORDER BY n DESC, archetype LIMIT 1) AS t FROM ev f, ev s WHERE f.config = (SELECT min(a) FROM ca) AND s.config = (SELECT max(a) FROM ca))
SELECT round(fb, 6) AS first_base, round(fa, 6) AS first_adjusted, round(fs, 6) AS first_shown, round(sb, 6) AS second_base, round(sa, 6) AS second_adjusted, round(ss, 6) AS second_shown, round(fa - sa, 6) AS difference, CASE WHEN fb < sa THEN round((sa - fb) / t, 6) END AS break_even FROM x""",
    "card_adjusted_rates": f"""{_RP}, {_CW.replace('WHERE board', 'WHERE board')}, ow AS (SELECT name, {_SHRINK.format(w='wins', n='n')} AS own FROM cm WHERE board = 'main'), vl AS (SELECT name, b, (15 * own + wins) / (15::DOUBLE + n) - own AS lift FROM cw JOIN ow USING (name) WHERE board = 'main' AND n >= 5),
pn AS (SELECT archetype, count(*) AS n FROM d WHERE archetype IS NOT NULL GROUP BY 1), fq AS (SELECT archetype, name, copies, count(*) AS k FROM d JOIN cd ON cd.tournament_id = d.tournament_id AND cd.deck_idx = d.deck_idx WHERE board = 'main' AND archetype IS NOT NULL GROUP BY 1, 2, 3),
dk2 AS (SELECT fq.archetype AS a, name, arg_max(copies, (k, copies)) AS copies FROM fq JOIN pn ON pn.archetype = fq.archetype GROUP BY 1, 2 HAVING round(sum(k) / any_value(pn.n)::DOUBLE, 9) >= 0.5),
nu AS (SELECT a, b, sum(lift * copies) / (SELECT sum(copies) FROM dk2 t WHERE t.a = dk2.a) * 0.5::DOUBLE AS s FROM dk2 JOIN vl USING (name) GROUP BY 1, 2), z AS (SELECT rp.*, greatest(-0.05::DOUBLE, least(0.05::DOUBLE, coalesce(s, 0))) AS nudge FROM rp LEFT JOIN nu ON nu.a = rp.a AND nu.b = rp.b WHERE rp.a <> rp.b)
SELECT a, b, round(share, 6) AS share, round(rate, 6) AS rate, round(nudge, 6) AS nudge, round(least(1::DOUBLE, greatest(0::DOUBLE, rate + nudge)), 6) AS adjusted FROM z""",
}
QUERIES = {k: f for k, f in globals().items() if callable(f) and (k in SQL or k in ("deck_ranking", "deck_duels", "paired_comparison", "share_tails"))}
