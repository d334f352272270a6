"""Queries on pooled cells, licences and the display ladder. Clusters are those of an earlier run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import label_key
from tidemark.operators import matrix as X
from tidemark.operators import pooling as P
from tidemark.operators import shares as S
from tidemark.operators.matches import marginals, resolve
from tidemark.plans.adapters import SQL_DECKS, cards, decks, rounds
from tidemark.plans.ref_matches import _HZ, _bans, _reg
from tidemark.plans.sql import sql_label
from tidemark.session import durable, table


def _members(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "archetype_compositions").where("archetype is not null and cluster_id is not null")
    return t.groupBy(label_key(F.col("archetype")).alias("member")).agg(F.min("cluster_id").alias("cluster"), F.max("is_definer").alias("definer")).select("cluster", "member", "definer")


def _cells(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Cells of pairs over the window from the later horizon of both, and the pairs of labels with a row."""
    d = decks(spark, sf)
    r = resolve(rounds(d), d)
    cells = durable(X.adaptive(r, S.ban_horizon(d, cards(spark, sf), _reg(spark), _bans(spark))).where("n > 0").select("a", "b", "wins", "n"))
    m = marginals(r)
    keep = durable(m.join(F.broadcast(m.agg(F.sum("n").alias("t")))).where(F.col("n") >= 0.01 * F.col("t")).select("a"))  # at most a hundred labels
    pairs = keep.select(F.col("a").alias("subject")).join(F.broadcast(keep.select(F.col("a").alias("opponent")))).where("subject <> opponent")
    return cells, pairs


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def opponent_pools(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with the opponents pooled to their cluster: plain sums."""
    cells, _ = _cells(spark, sf)
    return P.member_rows(cells, _members(spark, sf)).groupBy("subject", "cluster").agg(F.sum("wins").alias("wins"), F.sum("n").alias("n"))


def pooled_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells, _ = _cells(spark, sf)
    r = P.pooled_cells(P.member_rows(cells, _members(spark, sf)))
    return _r(r, "p", "lo", "hi", "n_eff", "strength", "intra_share").drop("games")


def imputation_licences(spark: SparkSession, sf: str) -> DataFrame:
    cells, _ = _cells(spark, sf)
    return _r(P.licences(cells, _members(spark, sf)), "tau")


def imputed_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells, pairs = _cells(spark, sf)
    return _r(P.imputed_cells(pairs, cells, _members(spark, sf)), "p").drop("lo", "hi")


def imputed_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Imputed cells with their padded intervals."""
    cells, pairs = _cells(spark, sf)
    return _r(P.imputed_cells(pairs, cells, _members(spark, sf)).where("p is not null"), "p", "lo", "hi").select("subject", "opponent", "p", "lo", "hi")


def prior_rungs(spark: SparkSession, sf: str) -> DataFrame:
    cells, pairs = _cells(spark, sf)
    return _r(P.prior_rungs(pairs, cells, _members(spark, sf)), "mean", "strength")


def display_ladder(spark: SparkSession, sf: str) -> DataFrame:
    cells, pairs = _cells(spark, sf)
    return _r(P.display_ladder(pairs, cells, _members(spark, sf)), "p")


#: 95% points of chi-squared with 1, 2, .. degrees of freedom.
_CRITICAL = "[3.841458820694124, 5.991464547107979, 7.814727903251179, 9.487729036781154, 11.070497693516351, 12.591587243743977, 14.067140449340169, 15.507313055865453, 16.918977604620448, 18.307038053275146, 19.67513757268249, 21.02606981748307, 22.362032494826934, 23.684791304840576, 24.995790139728616, 26.29622760486423, 27.58711163827534, 28.869299430392623, 30.14352720564616, 31.410432844230918]"
_BASE = f"""{SQL_DECKS}, {_HZ},
aw AS (SELECT dir.a, dir.b, win, dir.date, greatest(ha.valid_since, hb.valid_since) AS since FROM dir LEFT JOIN hz ha ON ha.archetype = a LEFT JOIN hz hb ON hb.archetype = b),
ac AS (SELECT a, b, sum(win)::BIGINT AS wins, count(*)::BIGINT AS n FROM aw WHERE since IS NULL OR date >= since GROUP BY 1, 2),
kp AS (SELECT a FROM mar WHERE n >= 0.01 * (SELECT sum(n) FROM mar)), pp AS (SELECT x.a AS subject, y.a AS opponent FROM kp x, kp y WHERE x.a <> y.a),
mb AS (SELECT {sql_label('archetype')} AS member, min(cluster_id) AS cluster, bool_or(is_definer) AS definer FROM archetype_compositions WHERE archetype IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1),
mr AS (SELECT a AS subject, mb.cluster, b AS member, wins, n, mb.definer, coalesce(h.cluster = mb.cluster, FALSE) AS intra, '' AS opponent FROM ac JOIN mb ON mb.member = b LEFT JOIN mb h ON h.member = a)"""


def _pooled(src: str, p: str) -> str:
    """CTEs {p}0.. to {p} with the pooled cells of the member rows ``src``."""
    k = "subject, cluster, opponent"
    return f"""{p}0 AS (SELECT *, definer AND member <> subject AS co, ln((wins + 0.5::DOUBLE) / (n - wins + 0.5::DOUBLE)) AS y, 1 / (wins + 0.5::DOUBLE) + 1 / (n - wins + 0.5::DOUBLE) AS v, wins / n::DOUBLE AS rate FROM {src}),
{p}1 AS (SELECT {k}, count(*) FILTER (WHERE co)::BIGINT AS contributors, coalesce(sum(n) FILTER (WHERE member = subject), 0)::BIGINT AS mirror_n, coalesce(sum(n) FILTER (WHERE co AND intra), 0)::BIGINT AS intra_n, count(*) FILTER (WHERE co AND n >= 5) AS k5, count(*) FILTER (WHERE co AND n >= 10) AS k10, median(n) FILTER (WHERE co) AS mn,
 max(rate) FILTER (WHERE co AND n >= 10) - min(rate) FILTER (WHERE co AND n >= 10) AS spread, sum(1 / v) FILTER (WHERE co) AS s1, sum(1 / v / v) FILTER (WHERE co) AS s2, sum(y / v) FILTER (WHERE co) AS sy, sum(y * y / v) FILTER (WHERE co) AS syy, sum(n) FILTER (WHERE co)::DOUBLE AS games, sum(n * n) FILTER (WHERE co)::DOUBLE AS nn, max(n) FILTER (WHERE co) AS top FROM {p}0 GROUP BY ALL),
{p}2 AS (SELECT *, greatest(0::DOUBLE, syy - sy * sy / s1) AS q FROM {p}1), {p}3 AS (SELECT *, CASE WHEN contributors > 1 THEN greatest(0::DOUBLE, (q - (contributors - 1)) / (s1 - s2 / s1)) ELSE 0::DOUBLE END AS tau2, CASE WHEN contributors > 1 THEN CASE WHEN q > 0 THEN greatest(0::DOUBLE, (q - (contributors - 1)) / q) ELSE 0 END END AS i2 FROM {p}2),
{p}4 AS (SELECT {k}, sum(1 / (v + tau2)) AS su, sum(y / (v + tau2)) AS suy FROM {p}0 JOIN {p}3 USING ({k}) WHERE co GROUP BY ALL),
{p}5 AS (SELECT {p}3.*, su, suy / su AS mu, 1 / (1 + exp(-suy / su)) AS pr FROM {p}3 LEFT JOIN {p}4 USING ({k})),
{p}6 AS (SELECT *, CASE WHEN contributors >= 2 THEN CASE WHEN k5 < 2 THEN 'not-computable' WHEN k10 >= 2 AND spread >= 0.25 THEN 'refused' WHEN i2 > 0.75 THEN 'refused' WHEN i2 > 0.4 THEN 'labelled' ELSE 'free' END END AS band, least(games, su / (pr * (1 - pr))) AS ne, games * games / nn >= 2 AND top / games < 0.6 AS conc, 5 + 25 * least(1::DOUBLE, contributors / 3::DOUBLE) * least(1::DOUBLE, mn / 30::DOUBLE) AS ceil_, CASE WHEN tau2 > 0 THEN 1 / (tau2 * pr * (1 - pr)) - 1 END AS mom FROM {p}5),
{p} AS (SELECT {k}, contributors, mirror_n, coalesce(contributors >= 2 AND band <> 'refused', FALSE) AS served, pr, mu, su, ne, band, conc, least(30::DOUBLE, greatest(5::DOUBLE, coalesce(least(ceil_, mom), ceil_))) AS st, (intra_n + mirror_n) / (games + mirror_n)::DOUBLE AS ish, CASE WHEN contributors = 0 THEN 'no contributor' WHEN contributors = 1 THEN 'single member' WHEN band = 'refused' THEN 'heterogeneity' END AS reason FROM {p}6)"""


def _divergence(src: str, p: str, k: str) -> str:
    return f"""{p}0 AS (SELECT * FROM {src} WHERE definer AND n >= 12), {p}1 AS (SELECT {k}, count(*) AS k, sum(wins) AS tw, sum(n) AS tn, max(wins / n::DOUBLE) - min(wins / n::DOUBLE) AS spread FROM {p}0 GROUP BY ALL HAVING count(*) >= 2),
{p}2 AS (SELECT {p}0.*, k, spread, tw / tn::DOUBLE AS rate, abs(wins - n * (tw / tn::DOUBLE)) AS off FROM {p}0 JOIN {p}1 USING ({k})),
{p} AS (SELECT {k}, any_value(k) AS k, any_value(spread) AS spread, sum(CASE WHEN rate > 0 AND rate < 1 THEN pow(CASE WHEN k = 2 THEN off - least(0.5::DOUBLE, off) ELSE off END, 2) / (n * rate * (1 - rate)) ELSE 0 END) > list_extract({_CRITICAL}, any_value(k) - 1) AS differs FROM {p}2 GROUP BY ALL)"""


_LIC = f"""mc AS (SELECT m.cluster, a AS member, b AS opponent, wins, n, m.definer, o.cluster IS NOT NULL AS inside FROM ac JOIN mb m ON m.member = a LEFT JOIN mb o ON o.member = b AND o.cluster = m.cluster),
mo AS (SELECT * FROM mc WHERE NOT inside), {_divergence('mo', 'dv', 'cluster, opponent')},
lg AS (SELECT cluster, count(*) AS c, count(*) FILTER (WHERE differs) AS d, median(spread) AS tau FROM dv GROUP BY 1),
li AS (SELECT x.cluster, coalesce(c, 0)::BIGINT AS columns, coalesce(d, 0)::BIGINT AS divergent, tau, coalesce(c, 0) >= 3 AND coalesce(d, 0) <= 0.25 * coalesce(c, 0) AS granted FROM (SELECT DISTINCT cluster FROM mb) x LEFT JOIN lg ON lg.cluster = x.cluster)"""
_IMP = f"""{_LIC}, ib AS (SELECT subject, opponent, mb.cluster FROM pp JOIN mb ON mb.member = subject),
sb AS (SELECT ib.subject, ib.opponent, mc.member, wins, n, definer FROM ib JOIN mc ON mc.cluster = ib.cluster AND mc.opponent = ib.opponent WHERE definer AND member <> subject), {_divergence('sb', 'dx', 'subject, opponent')},
sx AS (SELECT subject, opponent, sum(wins) AS w, sum(n) AS pool_n, count(*) AS siblings FROM sb GROUP BY 1, 2),
ic AS (SELECT ib.subject, ib.opponent, ib.cluster, coalesce(siblings, 0)::BIGINT AS siblings, coalesce(pool_n, 0)::BIGINT AS pool_n, w, CASE WHEN o.cluster = ib.cluster THEN 'intra-family' WHEN NOT granted THEN 'licence' WHEN siblings IS NULL THEN 'no siblings' WHEN differs THEN 'veto' WHEN pool_n < 25 THEN 'thin' END AS reason
 FROM ib LEFT JOIN mb o ON o.member = ib.opponent JOIN li ON li.cluster = ib.cluster LEFT JOIN sx ON sx.subject = ib.subject AND sx.opponent = ib.opponent LEFT JOIN dx ON dx.subject = ib.subject AND dx.opponent = ib.opponent)"""
_RUNG = f"""r1 AS (SELECT pp.subject, o.cluster, pp.opponent, b AS member, wins, n, m.definer, coalesce(h.cluster = o.cluster, FALSE) AS intra FROM pp JOIN mb o ON o.member = pp.opponent LEFT JOIN mb h ON h.member = pp.subject JOIN mb m ON m.cluster = o.cluster JOIN ac ON a = pp.subject AND b = m.member WHERE b <> pp.opponent),
{_pooled('r1', 'pa')}, f1 AS (SELECT * FROM pa WHERE served AND conc AND band <> 'not-computable'),
r2 AS (SELECT pp.subject, o.cluster, pp.opponent, s.member || ' > ' || b AS member, sum(wins) AS wins, sum(n) AS n, bool_or(m.definer) AS definer, any_value(h.cluster = o.cluster) AS intra FROM pp JOIN mb o ON o.member = pp.opponent JOIN mb h ON h.member = pp.subject JOIN mb s ON s.cluster = h.cluster AND s.definer AND s.member <> pp.subject JOIN mb m ON m.cluster = o.cluster
 JOIN ac ON a = s.member AND b = m.member WHERE b <> pp.opponent AND b <> pp.subject AND b <> s.member AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.subject = pp.subject AND f1.opponent = pp.opponent) GROUP BY ALL),
{_pooled('r2', 'pb')}, f2 AS (SELECT * FROM pb WHERE served AND conc AND band <> 'not-computable')"""
SQL = {
    "opponent_pools": f"{_BASE} SELECT subject, cluster, sum(wins)::BIGINT AS wins, sum(n)::BIGINT AS n FROM mr GROUP BY 1, 2",
    "pooled_cells": f"""{_BASE}, {_pooled('mr', 'pc')} SELECT subject, cluster, contributors, mirror_n, CASE WHEN served THEN round(pr, 6) END AS p, CASE WHEN served THEN round(1 / (1 + exp(-(mu - 1.959963984540054::DOUBLE / sqrt(su)))), 6) END AS lo, CASE WHEN served THEN round(1 / (1 + exp(-(mu + 1.959963984540054::DOUBLE / sqrt(su)))), 6) END AS hi,
CASE WHEN contributors >= 2 THEN round(ne, 6) END AS n_eff, CASE WHEN contributors >= 2 THEN CASE WHEN round(ne) >= 100 THEN 'established' WHEN round(ne) >= 30 THEN 'evolving' ELSE 'speculative' END END AS tier, band, CASE WHEN contributors >= 2 THEN conc END AS passed, CASE WHEN contributors >= 2 THEN round(st, 6) END AS strength, CASE WHEN contributors >= 2 THEN round(ish, 6) END AS intra_share, reason, coalesce(served AND conc AND band <> 'not-computable', FALSE) AS admissible FROM pc""",
    "imputation_licences": f"{_BASE}, {_LIC} SELECT cluster, columns, divergent, round(tau, 6) AS tau, granted FROM li",
    "imputed_cells": f"{_BASE}, {_IMP} SELECT subject, opponent, cluster, siblings, pool_n, CASE WHEN reason IS NULL THEN round(w / pool_n::DOUBLE, 6) END AS p, reason FROM ic",
    "prior_rungs": f"{_BASE}, {_RUNG} SELECT subject, opponent, 1 AS rung, round(pr, 6) AS mean, round(st, 6) AS strength FROM f1 UNION ALL SELECT subject, opponent, 2, round(pr, 6), round(st, 6) FROM f2",
    "display_ladder": f"""{_BASE}, {_IMP}, {_pooled('mr', 'pc')}, g AS (SELECT pp.*, coalesce(ac.n, 0) AS n, ac.wins, ic.subject IS NOT NULL AS has, ic.reason AS ir, CASE WHEN ic.subject IS NOT NULL AND ic.reason IS NULL THEN ic.w / ic.pool_n::DOUBLE END AS ip, o.cluster, pc.served, pc.pr, pc.ne, pc.reason AS pre, pc.contributors FROM pp LEFT JOIN ac ON a = subject AND b = opponent LEFT JOIN ic ON ic.subject = pp.subject AND ic.opponent = pp.opponent LEFT JOIN mb o ON o.member = pp.opponent LEFT JOIN pc ON pc.subject = pp.subject AND pc.cluster = o.cluster),
h AS (SELECT *, n >= 30 AS me, ip IS NOT NULL AS im, coalesce(served AND ne >= 30, FALSE) AS po FROM g)
SELECT subject, opponent, CASE WHEN me THEN 'measured' WHEN im THEN 'imputed' WHEN po THEN 'pooled' ELSE 'none' END AS kind, round(CASE WHEN me THEN wins / n::DOUBLE WHEN im THEN ip WHEN po THEN pr END, 6) AS p,
concat_ws('; ', CASE WHEN NOT me THEN 'measured: thin' END, CASE WHEN NOT me AND NOT im THEN CASE WHEN NOT has THEN 'imputed: no cluster' ELSE 'imputed: ' || ir END END, CASE WHEN NOT me AND NOT im AND NOT po THEN CASE WHEN cluster IS NULL THEN 'pooled: no cluster' WHEN coalesce(contributors, 0) < 2 OR pre IS NOT NULL THEN 'pooled: ' || coalesce(pre, 'no games') ELSE 'pooled: thin' END END) AS refused FROM h""",
}
QUERIES = {k: f for k, f in globals().items() if callable(f) and (k in SQL or k == "imputed_intervals")}
