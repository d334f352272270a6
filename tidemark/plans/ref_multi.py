"""Queries on camps against parents and on rankings over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import era_run as R
from tidemark.operators import multi as Y
from tidemark.operators import pooling as P
from tidemark.operators import shares as S
from tidemark.operators.matches import resolve
from tidemark.plans.adapters import SQL_DECKS, cards, decks, rounds
from tidemark.plans.ref_eras import _LAST, _latest
from tidemark.plans.ref_matches import _HZ, _SH, _bans, _reg
from tidemark.plans.ref_pooling import _members
from tidemark.session import durable

_CELL = ("p_raw", "prior", "p_shrunk", "lo", "hi")


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _base(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = durable(decks(spark, sf))
    parents = d.where("archetype is not null and variant is not null").select(F.col("archetype").alias("parent")).distinct()
    return d, durable(resolve(rounds(d), d)), parents


def _horizons(spark: SparkSession, sf: str, d: DataFrame) -> DataFrame:
    a = d.where("archetype is not null")
    camp = F.concat(F.col("archetype"), F.lit(" ["), F.coalesce("variant", F.lit("unlabeled")), F.lit("]"))
    labels = a.select(F.col("archetype").alias("label"), F.col("archetype").alias("parent")).union(a.select(camp, "archetype")).distinct()
    eras = _latest(spark, sf).select(F.regexp_replace("entity", "^(.*) / (.*)$", "$1 [$2]").alias("entity"), "stable_since")
    return R.horizons(labels, eras, S.ban_horizon(d, cards(spark, sf), _reg(spark), _bans(spark)))


def multi_split_cells(spark: SparkSession, sf: str) -> DataFrame:
    _, r, p = _base(spark, sf)
    return _r(Y.multi_split(r, p), *_CELL)


def multi_split_mirrors(spark: SparkSession, sf: str) -> DataFrame:
    _, r, p = _base(spark, sf)
    return Y.multi_split_mirrors(r, p)


def adaptive_multi_cells(spark: SparkSession, sf: str) -> DataFrame:
    d, r, p = _base(spark, sf)
    return _r(Y.adaptive_multi_split(r, p, _horizons(spark, sf, d)), *_CELL).withColumn("since", F.col("since").cast("string"))


def adaptive_multi_family(spark: SparkSession, sf: str) -> DataFrame:
    """The same with priors from families for unsplit labels."""
    d, r, p = _base(spark, sf)
    c = durable(Y.multi_split(r, p))
    pairs = c.where("subject not like '%]'").select("subject", "opponent")
    rungs = P.prior_rungs(pairs, Y.ranking_view(c), _members(spark, sf))
    return _r(Y.adaptive_multi_split(r, p, _horizons(spark, sf, d), rungs), *_CELL).withColumn("since", F.col("since").cast("string"))


def best_call_ranking(spark: SparkSession, sf: str) -> DataFrame:
    d, r, p = _base(spark, sf)
    field = S.shares(S.raw_counts(d)).select("archetype", "share")
    return _r(Y.best_call(Y.multi_split(r, p), field), "mean", "floor", "agency", "coverage")


def prior_errors(spark: SparkSession, sf: str) -> DataFrame:
    """How far family priors and own rates are from measured cells."""
    _, r, p = _base(spark, sf)
    c = durable(Y.multi_split(r, p, 0.005))
    pairs = c.where("subject not like '%]'").select("subject", "opponent")
    return _r(Y.leave_one_out_error(c, P.prior_rungs(pairs, Y.ranking_view(c), _members(spark, sf)), truth=5), "error")


_TIER = "CASE WHEN n >= 100 THEN 'established' WHEN n >= 30 THEN 'evolving' ELSE 'speculative' END"
_SHR = "(15 * {p} + {w}) / (15::DOUBLE + {n})"
_SIDES = f"""{SQL_DECKS}, pr AS (SELECT DISTINCT archetype AS parent FROM d WHERE archetype IS NOT NULL AND variant IS NOT NULL),
cm AS (SELECT CASE WHEN pa.parent IS NOT NULL THEN a || ' [' || coalesce(va, 'unlabeled') || ']' ELSE a END AS x, a AS px, CASE WHEN pb.parent IS NOT NULL THEN b || ' [' || coalesce(vb, 'unlabeled') || ']' ELSE b END AS y, b AS py, date, (s1 > s2)::INT AS w FROM m LEFT JOIN pr pa ON pa.parent = a LEFT JOIN pr pb ON pb.parent = b WHERE status IN ('decisive', 'mirror')),
sd AS (SELECT x, px, y, py, date, w AS win, 1 AS k FROM cm WHERE x <> y UNION ALL SELECT y, py, x, px, date, 1 - w, 1 FROM cm WHERE x <> y UNION ALL SELECT x, px, y, py, date, 1, 2 FROM cm WHERE x = y),
mg AS (SELECT x, px, sum(win) AS mw, sum(k) AS mn FROM sd GROUP BY 1, 2), bs AS (SELECT px, sum(mw) AS bw, sum(mn) AS bn FROM mg GROUP BY 1), rw AS (SELECT px FROM bs WHERE bn >= 0.02::DOUBLE * (SELECT sum(bn) FROM bs)),
su AS (SELECT mg.*, bw, bn, x <> mg.px AS camp FROM mg JOIN bs ON bs.px = mg.px WHERE x <> mg.px OR mg.px IN (SELECT px FROM rw)), gr AS (SELECT su.*, rw.px AS y FROM su JOIN rw ON rw.px <> su.px)"""


def _cells(po: str) -> str:
    return f"""lc AS (SELECT su.px, po.y, sum(wins) AS pw, sum(n) AS pn FROM {po} po JOIN su ON su.x = po.x WHERE camp GROUP BY 1, 2),
g0 AS (SELECT gr.*, coalesce(po.wins, 0)::BIGINT AS wins, coalesce(po.n, 0)::BIGINT AS n, coalesce(pw, 0) AS pw, coalesce(pn, 0) AS pn, po.* EXCLUDE (x, y, wins, n) FROM gr LEFT JOIN {po} po ON po.x = gr.x AND po.y = gr.y LEFT JOIN lc ON lc.px = gr.px AND lc.y = gr.y),
g1 AS (SELECT *, CASE WHEN camp THEN {_SHR.format(p='(7.5::DOUBLE + bw) / (15::DOUBLE + bn)', w='(pw - wins)', n='(pn - n)')} ELSE (7.5::DOUBLE + mw) / (15::DOUBLE + mn) END AS pr0, CASE WHEN camp THEN 'leave-camp-out' ELSE 'marginal' END AS so0 FROM g0)"""


_OUT = f"""SELECT x AS subject, y AS opponent, wins, n, CASE WHEN n > 0 THEN round(wins / n::DOUBLE, 6) END AS p_raw, round(prior, 6) AS prior, prior_source, round({_SHR.format(p='prior', w='wins', n='n')}, 6) AS p_shrunk,
CASE WHEN n > 0 THEN round(greatest(0::DOUBLE, (wins / n::DOUBLE + z * z / (2 * n) - z * sqrt(wins / n::DOUBLE * (1 - wins / n::DOUBLE) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) END AS lo, CASE WHEN n > 0 THEN round(least(1::DOUBLE, (wins / n::DOUBLE + z * z / (2 * n) + z * sqrt(wins / n::DOUBLE * (1 - wins / n::DOUBLE) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) END AS hi, {_TIER} AS tier, n >= 30 AS shown"""
_FULL = f"{_SIDES}, po AS (SELECT x, py AS y, sum(win) AS wins, count(*) AS n FROM sd WHERE px <> py GROUP BY 1, 2), {_cells('po')}, g2 AS (SELECT *, pr0 AS prior, so0 AS prior_source, 1.959963984540054::DOUBLE AS z FROM g1)"
SQL = {
    "multi_split_cells": f"{_FULL} {_OUT} FROM g2",
    "multi_split_mirrors": f"{_SIDES} SELECT x AS subject, count(*)::BIGINT AS n FROM sd WHERE x = y GROUP BY 1",
    "adaptive_multi_cells": f"""{_SIDES}, {_HZ}, {_LAST}, le AS (SELECT regexp_replace(entity, '^(.*) / (.*)$', '\\1 [\\2]') AS entity, stable_since FROM ls),
lb AS (SELECT DISTINCT archetype AS label, archetype AS parent FROM d WHERE archetype IS NOT NULL UNION SELECT DISTINCT archetype || ' [' || coalesce(variant, 'unlabeled') || ']', archetype FROM d WHERE archetype IS NOT NULL),
ho AS (SELECT label, CASE WHEN o.entity IS NOT NULL THEN o.stable_since WHEN u.entity IS NOT NULL AND label <> lb.parent THEN u.stable_since ELSE valid_since END AS since, o.entity IS NOT NULL OR (u.entity IS NOT NULL AND label <> lb.parent) AS era FROM lb LEFT JOIN le o ON o.entity = label LEFT JOIN le u ON u.entity = lb.parent LEFT JOIN hz ON hz.archetype = lb.parent),
w0 AS (SELECT sd.*, greatest(hx.since, hy.since) AS since, coalesce((hx.since = greatest(hx.since, hy.since) AND hx.era) OR (hy.since = greatest(hx.since, hy.since) AND hy.era), FALSE) AS era FROM sd LEFT JOIN ho hx ON hx.label = x LEFT JOIN ho hy ON hy.label = py WHERE px <> py),
w1 AS (SELECT *, since IS NULL OR coalesce(date >= since, FALSE) AS ins FROM w0), po AS (SELECT x, py AS y, sum(CASE WHEN ins THEN win ELSE 0 END) AS wins, count(*) FILTER (WHERE ins) AS n, sum(CASE WHEN ins THEN 0 ELSE win END) AS bw_, count(*) FILTER (WHERE NOT ins) AS bn_, any_value(era) AS era, any_value(since) AS since FROM w1 GROUP BY 1, 2),
{_cells('po')}, g2 AS (SELECT *, coalesce(era AND n < 100 AND bn_ > 0, FALSE) AS cut, CASE WHEN coalesce(era AND n < 100 AND bn_ > 0, FALSE) THEN (7.5::DOUBLE + bw_) / (15::DOUBLE + bn_) ELSE pr0 END AS prior, CASE WHEN coalesce(era AND n < 100 AND bn_ > 0, FALSE) THEN 'before the cut' ELSE so0 END AS prior_source, 1.959963984540054::DOUBLE AS z FROM g1)
{_OUT}, since::VARCHAR AS since FROM g2""",
    "best_call_ranking": f"""{_FULL}, {_SH}, tp AS (SELECT archetype, share / sum(share) OVER () AS s FROM (SELECT * FROM sh ORDER BY round(share, 12) DESC, archetype LIMIT 10)), q AS (SELECT x, s, n, {_SHR.format(p='prior', w='wins', n='n')} AS p FROM g2 JOIN tp ON tp.archetype = y),
rr AS (SELECT x, sum(s * p) / sum(s) AS mean, min(p) AS floor_, sum(CASE WHEN n >= 8 THEN s ELSE 0 END) AS cov, count(*) FILTER (WHERE n >= 8) AS k FROM q GROUP BY 1) SELECT x AS subject, round(mean, 6) AS mean, round(floor_, 6) AS floor, round(least(mean, floor_), 6) AS agency, round(cov, 6) AS coverage, k::BIGINT AS cells, round(cov, 12) >= 0.5 AS grounded FROM rr""",
}
QUERIES = {k: f for k, f in globals().items() if callable(f) and (k in SQL or k in ("adaptive_multi_family", "prior_errors"))}
