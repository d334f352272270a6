"""Queries on matches, matrices, shares and players."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import fisher_udf, shrink, tier
from tidemark.operators import matches as M
from tidemark.operators import matrix as X
from tidemark.operators import shares as S
from tidemark.plans.adapters import BANS, SQL_DECKS, cards, decks, rounds, standings

VENUES = ["online", "paper", "unknown"]
_TIER = "CASE WHEN {0} >= 100 THEN 'established' WHEN {0} >= 30 THEN 'evolving' ELSE 'speculative' END"


def _resolved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = decks(spark, sf)
    return d, M.resolve(rounds(d), d)


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _reg(spark: SparkSession) -> DataFrame:
    return S.regimes(spark, [d for d, _ in BANS])


def _bans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BANS), "date string, card string").select(F.col("date").cast("date").alias("date"), "card")


def meta_share_raw(spark, sf):
    return _r6(S.shares(S.raw_counts(decks(spark, sf))), "share").select("archetype", "n", "share", "tier", "fringe")


def meta_share_other_folded(spark, sf):
    return _r6(S.fold_other(S.shares(S.raw_counts(decks(spark, sf)))), "share").select("archetype", "n", "share", "tier")


def meta_share_by_variant(spark, sf):
    d = decks(spark, sf).where("archetype is not null")
    c = d.groupBy("archetype", "variant").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.when(F.col("variant").isNull(), F.col("archetype")).otherwise(F.concat_ws(" / ", "archetype", "variant")))
    return _r6(S.shares(c), "share").select("label", "n", "share")


def unlabeled_coverage(spark, sf):
    return decks(spark, sf).groupBy("provenance").agg(F.count(F.lit(1)).alias("decks"), F.count_if(F.col("archetype").isNull()).alias("unlabeled"))


def freshness(spark, sf):
    return decks(spark, sf).groupBy("provenance").agg(F.max("date").cast("string").alias("latest"), F.count(F.lit(1)).alias("decks"))


def dup_guard_names(spark, sf):
    return M.unique_names(decks(spark, sf)).where("n > 1").select("tournament_id", "norm", "n")


def match_resolve_status(spark, sf):
    return _resolved(spark, sf)[1].groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def score_parse(spark, sf):
    r = rounds(decks(spark, sf))
    a, b = M.score(F.col("result"))
    win = F.when(a > b, "p1").when(a < b, "p2").when(a == b, "draw")
    return r.groupBy("result", win.alias("winner")).agg(F.count(F.lit(1)).alias("n"))


def directed_tallies(spark, sf):
    return M.tallies(_resolved(spark, sf)[1])


def marginal_records(spark, sf):
    m = M.marginals(_resolved(spark, sf)[1])
    return m.select("a", "wins", "n", F.round(shrink(F.col("wins"), F.col("n")), 6).alias("rate"), tier(F.col("n")).alias("tier"))


def mirror_counts(spark, sf):
    return _resolved(spark, sf)[1].where("status = 'mirror'").groupBy("a").agg(F.count(F.lit(1)).alias("n"))


def matchup_matrix_rect(spark, sf):
    return _r6(X.rectangular(_resolved(spark, sf)[1]), "p_raw", "p_shrunk", "lo", "hi")


def head_to_head(spark, sf):
    """The directed cells of the two most met labels (ties by name)."""
    t = M.tallies(_resolved(spark, sf)[1])
    top = t.groupBy("a").agg(F.sum("n").alias("g")).orderBy(F.col("g").desc(), "a").limit(2).select("a")
    return t.join(F.broadcast(top), "a", "left_semi").join(F.broadcast(top.withColumnRenamed("a", "b")), "b", "left_semi").select("a", "b", "wins", "n")


def jeffreys_ci(spark, sf):
    return _r6(X.with_intervals(M.tallies(_resolved(spark, sf)[1])), "lo", "hi").select("a", "b", "wins", "n", "lo", "hi")


def topcut_share(spark, sf):
    d = decks(spark, sf)
    return _r6(S.shares(S.topcut_counts(d, standings(d))), "share").select("archetype", "n", "share")


def win_rate_weighted_share(spark, sf):
    d, r = _resolved(spark, sf)
    return _r6(S.winrate_weighted(S.raw_counts(d), M.marginals(r)), "share")


def blend_share(spark, sf):
    s = S.shares(S.raw_counts(decks(spark, sf), "provenance"), "provenance")
    return _r6(S.blend(s, "provenance", {"online": 0.5, "paper": 0.3, "unknown": 0.2}), "share")


def regime_trends(spark, sf):
    return _r6(S.trends(decks(spark, sf), _reg(spark)), "share")


def biggest_movers(spark, sf):
    return _r6(S.movers(S.trends(decks(spark, sf), _reg(spark))), "share_before", "share_after", "delta")


def venue_divergence(spark, sf):
    s = S.shares(S.raw_counts(decks(spark, sf), "provenance"), "provenance")
    return _r6(S.venue_divergence(s, VENUES), "hi", "lo", "spread")


def tier_list(spark, sf):
    return _r6(S.tier_list(S.shares(S.raw_counts(decks(spark, sf)))), "share")


def weekly_share_ema(spark, sf):
    return _r6(S.weekly_ema(decks(spark, sf)), "share", "ema").withColumn("week", F.col("week").cast("string"))


def ban_horizon(spark, sf):
    return S.ban_horizon(decks(spark, sf), cards(spark, sf), _reg(spark), _bans(spark)).withColumn("valid_since", F.col("valid_since").cast("string"))


def _horizons(spark, sf, d):
    return S.ban_horizon(d, cards(spark, sf), _reg(spark), _bans(spark))


def adaptive_matrix(spark, sf):
    d, r = _resolved(spark, sf)
    return _r6(X.cross_boundary(X.adaptive(r, _horizons(spark, sf, d))), "p_shrunk").withColumn("since", F.col("since").cast("string"))


def leave_camp_out_prior(spark, sf):
    return _r6(X.camp_cells(_resolved(spark, sf)[1]), "prior", "p_shrunk")


def multi_split_matrix(spark, sf):
    d = M.directed(_resolved(spark, sf)[1])
    label = F.concat(F.col("a"), F.lit(" ["), F.coalesce("va", F.lit("unlabeled")), F.lit("]"))
    return d.groupBy(label.alias("subject"), "b").agg(F.sum("win").alias("wins"), F.count(F.lit(1)).alias("n"))


def dersimonian_laird(spark, sf):
    """Each label against the clusters of opponents that share the last word of their name."""
    return _r6(X.pool(M.tallies(_resolved(spark, sf)[1]), F.element_at(F.split("b", " "), -1)).drop("mu", "variance"), "q", "tau2", "i2", "p_pooled", "n_eff", "hhi", "top_share")


def card_winrate_cells(spark, sf):
    return M.card_winrates(_resolved(spark, sf)[1], cards(spark, sf)).where("b is not null").select("name", "board", "b", "wins", "n")


def card_winrate_marginal(spark, sf):
    return M.card_winrates(_resolved(spark, sf)[1], cards(spark, sf)).where("b is null").select("name", "board", "wins", "n")


def card_value_lift(spark, sf):
    """Lift of each card against an opponent over the card's own shrunk rate, and whether the signs disagree."""
    w = M.card_winrates(_resolved(spark, sf)[1], cards(spark, sf))
    own = w.where("b is null").select("name", "board", shrink(F.col("wins"), F.col("n")).alias("own"))
    c = w.where("b is not null").join(own, ["name", "board"]).withColumn("lift", shrink(F.col("wins"), F.col("n"), F.col("own")) - F.col("own"))
    return _r6(c.select("name", "board", "b", "n", "lift", ((F.col("own") - 0.5) * F.col("lift") < 0).alias("conflict")), "lift")


def slot_contrast(spark, sf):
    return M.slot_contrast(_resolved(spark, sf)[1], cards(spark, sf))


def slot_contrast_fisher(spark, sf):
    c = M.slot_contrast(_resolved(spark, sf)[1], cards(spark, sf)).where("n_with >= 2 and n_without >= 2")
    return c.withColumn("p", F.round(fisher_udf("wins_with", F.col("n_with") - F.col("wins_with"), "wins_without", F.col("n_without") - F.col("wins_without")), 9))


def player_records(spark, sf):
    d, r = _resolved(spark, sf)
    return _r6(S.player_records(d, r, standings(d)), "rate")


def strong_players(spark, sf):
    d, r = _resolved(spark, sf)
    p = S.player_records(d, r, standings(d))
    return p.where("events >= 2 and rate >= 0.5").select("norm", "events", "wins", "losses")


def player_regime_history(spark, sf):
    x = S.in_regimes(decks(spark, sf).where("norm is not null"), _reg(spark))
    return x.groupBy("norm", "regime", "archetype").agg(F.count(F.lit(1)).alias("decks"))


def alias_stem_candidates(spark, sf):
    """Pairs of names with equal first four letters that never play the same event."""
    d = decks(spark, sf).where("norm is not null and length(norm) >= 4").select("tournament_id", "norm").distinct()
    n = d.select("norm", F.substring("norm", 1, 4).alias("stem")).distinct()
    p = n.select("stem", F.col("norm").alias("x")).join(n.select("stem", F.col("norm").alias("y")), "stem").where("x < y").select("x", "y")
    met = d.select("tournament_id", F.col("norm").alias("x")).join(d.select("tournament_id", F.col("norm").alias("y")), "tournament_id").where("x < y and substring(x, 1, 4) = substring(y, 1, 4)").select("x", "y").distinct()
    return p.join(met, ["x", "y"], "left_anti")


_SH = "raw AS (SELECT archetype, count(*)::BIGINT AS n FROM d WHERE archetype IS NOT NULL GROUP BY 1), sh AS (SELECT *, n / (SELECT sum(n) FROM raw)::DOUBLE AS share FROM raw)"
_SHRINK = "(7.5::DOUBLE + {w}) / (15::DOUBLE + {n})"
_VEN = "vs AS (SELECT provenance, archetype, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY provenance) AS share FROM d WHERE archetype IS NOT NULL GROUP BY 1, 2)"
_REGD = "(SELECT row_number() OVER (ORDER BY since NULLS FIRST) - 1 AS regime, since, until FROM reg) g"
_XR = f"xr AS (SELECT d.*, g.regime, g.since, g.until FROM d JOIN {_REGD} ON (g.since IS NULL OR d.date >= g.since) AND (g.until IS NULL OR d.date < g.until) WHERE d.date IS NOT NULL)"
_TR = (
    _XR
    + ", rs AS (SELECT regime, count(DISTINCT tournament_id) AS events, date_diff('day', min(date), max(date)) AS days FROM xr GROUP BY 1), "
    + "tr AS (SELECT regime, archetype, count(*)::BIGINT AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY regime) AS share FROM xr WHERE archetype IS NOT NULL GROUP BY 1, 2)"
)
_HZ = (
    _XR
    + """, ba AS (SELECT archetype, regime, count(*) AS n FROM xr WHERE archetype IS NOT NULL GROUP BY 1, 2),
hz AS (SELECT archetype, max(until) AS valid_since FROM (SELECT xr.archetype, xr.regime, xr.until, count(DISTINCT (xr.tournament_id, xr.deck_idx)) AS k, any_value(ba.n) AS n FROM xr JOIN ba ON ba.archetype = xr.archetype AND ba.regime = xr.regime
 JOIN reg b ON b.since = xr.until JOIN cd ON cd.tournament_id = xr.tournament_id AND cd.deck_idx = xr.deck_idx AND cd.name = b.card GROUP BY 1, 2, 3) WHERE k >= 0.25 * n GROUP BY 1)"""
)
_CW = "cw AS (SELECT name, board, b, sum(win)::BIGINT AS wins, count(*)::BIGINT AS n FROM dir JOIN cd ON cd.tournament_id = dir.tournament_id AND cd.deck_idx = dir.ia GROUP BY 1, 2, 3), cm AS (SELECT name, board, sum(wins)::BIGINT AS wins, sum(n)::BIGINT AS n FROM cw GROUP BY 1, 2)"
_PR = """ev AS (SELECT norm, count(DISTINCT tournament_id)::BIGINT AS events FROM d WHERE norm IS NOT NULL GROUP BY 1),
pm AS (SELECT p1 AS norm, s1 AS x, s2 AS y FROM m WHERE status IN ('mirror', 'decisive', 'no_winner') AND s1 IS NOT NULL AND s2 IS NOT NULL UNION ALL SELECT p2, s2, s1 FROM m WHERE status IN ('mirror', 'decisive', 'no_winner') AND s1 IS NOT NULL AND s2 IS NOT NULL),
pw AS (SELECT norm, count(*) FILTER (WHERE x > y) AS wins, count(*) FILTER (WHERE x < y) AS losses, count(*) FILTER (WHERE x = y) AS draws FROM pm GROUP BY 1),
tp AS (SELECT norm, count(*) AS top FROM st WHERE rank <= 8 AND norm IS NOT NULL GROUP BY 1),
pr AS (SELECT ev.norm, events, coalesce(wins, 0)::BIGINT AS wins, coalesce(losses, 0)::BIGINT AS losses, coalesce(draws, 0)::BIGINT AS draws, coalesce(top, 0)::BIGINT AS top FROM ev LEFT JOIN pw ON pw.norm = ev.norm LEFT JOIN tp ON tp.norm = ev.norm)"""
_D = SQL_DECKS
SQL = {
    "meta_share_raw": f"{_D}, {_SH} SELECT archetype, n, round(share, 6) AS share, {_TIER.format('n')} AS tier, share < 0.02 AS fringe FROM sh",
    "meta_share_other_folded": f"{_D}, {_SH}, o AS (SELECT CASE WHEN share < 0.02 AND NOT regexp_matches(lower(archetype), '^(unknown$|conflict($|\\())') THEN 'Other' ELSE archetype END AS archetype, n, share FROM sh), p AS (SELECT archetype, sum(n)::BIGINT AS n, sum(share) AS share FROM o GROUP BY 1) SELECT archetype, n, round(share, 6) AS share, {_TIER.format('n')} AS tier FROM p",
    "meta_share_by_variant": f"{_D}, g AS (SELECT archetype, variant, count(*)::BIGINT AS n FROM d WHERE archetype IS NOT NULL GROUP BY 1, 2) SELECT CASE WHEN variant IS NULL THEN archetype ELSE archetype || ' / ' || variant END AS label, n, round(n / (SELECT sum(n) FROM g)::DOUBLE, 6) AS share FROM g",
    "unlabeled_coverage": f"{_D} SELECT provenance, count(*)::BIGINT AS decks, count(*) FILTER (WHERE archetype IS NULL)::BIGINT AS unlabeled FROM d GROUP BY 1",
    "freshness": f"{_D} SELECT provenance, max(date)::VARCHAR AS latest, count(*)::BIGINT AS decks FROM d GROUP BY 1",
    "dup_guard_names": f"{_D} SELECT tournament_id, norm, n::BIGINT AS n FROM uq WHERE n > 1",
    "match_resolve_status": f"{_D} SELECT status, count(*)::BIGINT AS n FROM m GROUP BY 1",
    "score_parse": f"{_D} SELECT result, CASE WHEN s1 > s2 THEN 'p1' WHEN s1 < s2 THEN 'p2' WHEN s1 = s2 THEN 'draw' END AS winner, count(*)::BIGINT AS n FROM m GROUP BY 1, 2",
    "directed_tallies": f"{_D} SELECT * FROM cell",
    "marginal_records": f"{_D} SELECT a, wins, n, round({_SHRINK.format(w='wins', n='n')}, 6) AS rate, {_TIER.format('n')} AS tier FROM mar",
    "mirror_counts": f"{_D} SELECT a, count(*)::BIGINT AS n FROM m WHERE status = 'mirror' GROUP BY 1",
    "matchup_matrix_rect": f"""{_D}, kp AS (SELECT a, {_SHRINK.format(w='wins', n='n')} AS prior FROM mar WHERE n >= 0.02 * (SELECT sum(n) FROM mar)), mi AS (SELECT a, count(*) AS k FROM m WHERE status = 'mirror' GROUP BY 1),
g AS (SELECT x.a, y.a AS b, x.prior, x.a = y.a AS mirror, (CASE WHEN x.a = y.a THEN coalesce(mi.k, 0) // 2 ELSE coalesce(c.wins, 0) END)::BIGINT AS wins, (CASE WHEN x.a = y.a THEN coalesce(mi.k, 0) ELSE coalesce(c.n, 0) END)::BIGINT AS n FROM kp x CROSS JOIN kp y LEFT JOIN cell c ON c.a = x.a AND c.b = y.a LEFT JOIN mi ON mi.a = x.a),
w AS (SELECT *, wins / n::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM g)
SELECT a, b, wins, n, CASE WHEN mirror THEN 0.5::DOUBLE WHEN n > 0 THEN round(p, 6) END AS p_raw, round(CASE WHEN mirror THEN 0.5::DOUBLE ELSE (prior * 15 + wins) / (15::DOUBLE + n) END, 6) AS p_shrunk,
CASE WHEN NOT mirror AND n > 0 THEN round(greatest(0::DOUBLE, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) END AS lo,
CASE WHEN NOT mirror AND n > 0 THEN round(least(1::DOUBLE, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) END AS hi, {_TIER.format('n')} AS tier, n >= 30 AS shown FROM w""",
    "head_to_head": f"{_D}, top AS (SELECT a FROM cell GROUP BY a ORDER BY sum(n) DESC, a LIMIT 2) SELECT * FROM cell WHERE a IN (SELECT a FROM top) AND b IN (SELECT a FROM top)",
    "topcut_share": f"{_D}, su AS (SELECT tournament_id, norm, min(rank) AS rank FROM st GROUP BY 1, 2 HAVING count(*) = 1), tc AS (SELECT archetype, count(*)::BIGINT AS n FROM uq JOIN su ON su.tournament_id = uq.tournament_id AND su.norm = uq.norm WHERE uq.n = 1 AND archetype IS NOT NULL AND rank <= 8 GROUP BY 1) SELECT archetype, n, round(n / (SELECT sum(n) FROM tc)::DOUBLE, 6) AS share FROM tc",
    "win_rate_weighted_share": f"{_D}, {_SH}, w AS (SELECT archetype, mar.n, share * mar.wins / mar.n AS w FROM sh JOIN mar ON mar.a = archetype WHERE mar.n > 0) SELECT archetype, n, round(w / (SELECT sum(w) FROM w), 6) AS share FROM w",
    "blend_share": f"{_D}, {_VEN}, w AS (SELECT * FROM (VALUES ('online', 0.5::DOUBLE), ('paper', 0.3::DOUBLE), ('unknown', 0.2::DOUBLE)) AS v(provenance, w) WHERE provenance IN (SELECT provenance FROM vs)), x AS (SELECT archetype, sum(share * w / (SELECT sum(w) FROM w)) AS s FROM vs JOIN w USING (provenance) GROUP BY 1) SELECT archetype, round(s / (SELECT sum(s) FROM x), 6) AS share FROM x",
    "regime_trends": f"{_D}, {_TR} SELECT regime::INT AS regime, archetype, n, round(share, 6) AS share, CASE WHEN (events < 4 OR days < 14) AND n >= 100 THEN 'evolving' ELSE {_TIER.format('n')} END AS tier, events < 4 OR days < 14 AS thin FROM tr JOIN rs USING (regime)",
    "biggest_movers": f"{_D}, {_TR}, rx AS (SELECT DISTINCT regime FROM tr), mv AS (SELECT coalesce(x.regime + 1, y.regime) AS regime, coalesce(x.archetype, y.archetype) AS archetype, coalesce(x.share, 0::DOUBLE) AS share_before, coalesce(y.share, 0::DOUBLE) AS share_after FROM tr x FULL JOIN tr y ON x.archetype = y.archetype AND y.regime = x.regime + 1), mk AS (SELECT *, round(share_after - share_before, 9) AS dl, row_number() OVER (PARTITION BY regime ORDER BY abs(round(share_after - share_before, 9)) DESC, archetype) AS k FROM mv WHERE regime IN (SELECT regime FROM rx) AND regime - 1 IN (SELECT regime FROM rx)) SELECT regime::INT AS regime, archetype, round(share_before, 6) AS share_before, round(share_after, 6) AS share_after, round(dl, 6) AS delta FROM mk WHERE k <= 10",
    "venue_divergence": f"{_D}, {_VEN}, al AS (SELECT DISTINCT archetype FROM vs), x AS (SELECT a.archetype, v.v, coalesce(s.share, 0::DOUBLE) AS share FROM al a CROSS JOIN (VALUES ('online'), ('paper'), ('unknown')) v(v) LEFT JOIN vs s ON s.archetype = a.archetype AND s.provenance = v.v), y AS (SELECT archetype, max(share) AS hi, min(share) AS lo FROM x GROUP BY 1) SELECT y.archetype, min(v) FILTER (WHERE share = hi) AS venue_hi, min(v) FILTER (WHERE share = lo) AS venue_lo, round(any_value(hi), 6) AS hi, round(any_value(lo), 6) AS lo, round(any_value(hi - lo), 6) AS spread FROM x JOIN y ON x.archetype = y.archetype GROUP BY 1",
    "tier_list": f"{_D}, {_SH} SELECT archetype, round(share, 6) AS share, CASE WHEN share >= 0.10 THEN 'S' WHEN share >= 0.05 THEN 'A' ELSE 'B' END AS grade FROM sh WHERE share >= 0.02",
    "weekly_share_ema": _D.replace("WITH tt AS", "WITH RECURSIVE tt AS", 1)
    + ", wn AS (SELECT date_trunc('week', date)::DATE AS week, archetype, count(*) AS n FROM d WHERE archetype IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2), wt AS (SELECT week, sum(n) AS t FROM wn GROUP BY 1), wg AS (SELECT a.archetype, wt.week, coalesce(wn.n, 0) / wt.t::DOUBLE AS share, row_number() OVER (PARTITION BY a.archetype ORDER BY wt.week) AS k FROM wt CROSS JOIN (SELECT DISTINCT archetype FROM wn) a LEFT JOIN wn ON wn.week = wt.week AND wn.archetype = a.archetype), em AS (SELECT archetype, week, share, k, share AS ema FROM wg WHERE k = 1 UNION ALL SELECT g.archetype, g.week, g.share, g.k, 0.4::DOUBLE * g.share + 0.6::DOUBLE * e.ema FROM em e JOIN wg g ON g.archetype = e.archetype AND g.k = e.k + 1) SELECT archetype, week::VARCHAR AS week, round(share, 6) AS share, round(ema, 6) AS ema FROM em",
    "ban_horizon": f"{_D}, {_HZ} SELECT archetype, valid_since::VARCHAR AS valid_since FROM hz",
    "adaptive_matrix": f"""{_D}, {_HZ}, x AS (SELECT dir.*, greatest(ha.valid_since, hb.valid_since) AS since FROM dir LEFT JOIN hz ha ON ha.archetype = a LEFT JOIN hz hb ON hb.archetype = b),
y AS (SELECT a, b, since, coalesce(sum(win) FILTER (WHERE since IS NULL OR date >= since), 0)::BIGINT AS wins, count(*) FILTER (WHERE since IS NULL OR date >= since)::BIGINT AS n, count(*)::BIGINT AS al, sum(win)::BIGINT AS alw FROM x GROUP BY 1, 2, 3), z AS (SELECT a, b, since, wins, n, alw - wins AS wins_before, al - n AS n_before FROM y)
SELECT * REPLACE (since::VARCHAR AS since), round(CASE WHEN since IS NOT NULL AND n < 100 AND n_before > 0 THEN (15 * {_SHRINK.format(w='wins_before', n='n_before')} + wins) / (15::DOUBLE + n) ELSE {_SHRINK.format(w='wins', n='n')} END, 6) AS p_shrunk, CASE WHEN since IS NOT NULL AND n < 100 AND n_before > 0 THEN 'before' ELSE 'even' END AS prior_source FROM z""",
    "leave_camp_out_prior": f"""{_D}, c AS (SELECT a, coalesce(va, 'unlabeled') AS camp, b, sum(win)::BIGINT AS wins, count(*)::BIGINT AS n FROM dir GROUP BY 1, 2, 3),
x AS (SELECT *, sum(wins) OVER (PARTITION BY a, b) AS pw, sum(n) OVER (PARTITION BY a, b) AS pn, sum(wins) OVER (PARTITION BY a) AS tw, sum(n) OVER (PARTITION BY a) AS tn FROM c),
y AS (SELECT *, (15 * ({_SHRINK.format(w='tw', n='tn')}) + pw - wins) / (15::DOUBLE + pn - n) AS prior FROM x) SELECT a, camp, b, wins, n, round(prior, 6) AS prior, round((15 * prior + wins) / (15::DOUBLE + n), 6) AS p_shrunk FROM y""",
    "multi_split_matrix": f"{_D} SELECT a || ' [' || coalesce(va, 'unlabeled') || ']' AS subject, b, sum(win)::BIGINT AS wins, count(*)::BIGINT AS n FROM dir GROUP BY 1, 2",
    "dersimonian_laird": f"""{_D}, c AS (SELECT a, list_extract(string_split(b, ' '), -1) AS cluster, wins::DOUBLE AS w, n::DOUBLE AS n, ln((wins + 0.5::DOUBLE) / (n - wins + 0.5::DOUBLE)) AS y, 1 / (wins + 0.5::DOUBLE) + 1 / (n - wins + 0.5::DOUBLE) AS v FROM cell),
g AS (SELECT a, cluster, count(*) AS k, sum(1 / v) AS s1, sum(1 / v / v) AS s2, sum(y / v) AS sy, sum(y * y / v) AS syy, sum(n) AS games, sum(n * n) AS nn, max(n) AS top FROM c GROUP BY 1, 2),
h AS (SELECT *, greatest(0::DOUBLE, syy - sy * sy / s1) AS q FROM g), t AS (SELECT *, CASE WHEN k > 1 THEN greatest(0::DOUBLE, (q - (k - 1)) / (s1 - s2 / s1)) ELSE 0::DOUBLE END AS tau2 FROM h),
pw AS (SELECT c.a, c.cluster, sum(1 / (v + tau2)) AS su, sum(y / (v + tau2)) AS suy FROM c JOIN t ON t.a = c.a AND t.cluster = c.cluster GROUP BY 1, 2), f AS (SELECT t.*, su, 1 / (1 + exp(-suy / su)) AS p FROM t JOIN pw ON pw.a = t.a AND pw.cluster = t.cluster)
SELECT a, cluster, k::BIGINT AS members, games::BIGINT AS games, round(q, 6) AS q, round(tau2, 6) AS tau2, CASE WHEN k > 1 THEN round(CASE WHEN q > 0 THEN greatest(0::DOUBLE, (q - (k - 1)) / q) ELSE 0 END, 6) END AS i2, round(p, 6) AS p_pooled, round(least(games, su / (p * (1 - p))), 6) AS n_eff, round(nn / (games * games), 6) AS hhi, round(top / games, 6) AS top_share FROM f""",
    "card_winrate_cells": f"{_D}, {_CW} SELECT * FROM cw",
    "card_winrate_marginal": f"{_D}, {_CW} SELECT * FROM cm",
    "card_value_lift": f"{_D}, {_CW}, o AS (SELECT name, board, {_SHRINK.format(w='wins', n='n')} AS own FROM cm), l AS (SELECT name, board, b, n, own, (15 * own + wins) / (15::DOUBLE + n) - own AS lift FROM cw JOIN o USING (name, board)) SELECT name, board, b, n, round(lift, 6) AS lift, (own - 0.5::DOUBLE) * lift < 0 AS conflict FROM l",
    "slot_contrast": f"{_D}, hs AS (SELECT a, b, name, sum(win)::BIGINT AS wins_with, count(*)::BIGINT AS n_with FROM dir JOIN cd ON cd.tournament_id = dir.tournament_id AND cd.deck_idx = dir.ia WHERE board = 'main' GROUP BY 1, 2, 3) SELECT hs.*, wins - wins_with AS wins_without, n - n_with AS n_without FROM hs JOIN cell USING (a, b)",
    "player_records": f"{_D}, {_PR} SELECT *, round({_SHRINK.format(w='wins', n='(wins + losses)')}, 6) AS rate, {_TIER.format('(wins + losses)')} AS tier FROM pr",
    "strong_players": f"{_D}, {_PR} SELECT norm, events, wins, losses FROM pr WHERE events >= 2 AND {_SHRINK.format(w='wins', n='(wins + losses)')} >= 0.5",
    "player_regime_history": f"{_D}, {_XR} SELECT norm, regime::INT AS regime, archetype, count(*)::BIGINT AS decks FROM xr WHERE norm IS NOT NULL GROUP BY 1, 2, 3",
    "alias_stem_candidates": f"{_D}, e AS (SELECT DISTINCT tournament_id, norm FROM d WHERE norm IS NOT NULL AND length(norm) >= 4), n AS (SELECT DISTINCT norm FROM e) SELECT x.norm AS x, y.norm AS y FROM n x JOIN n y ON substr(x.norm, 1, 4) = substr(y.norm, 1, 4) AND x.norm < y.norm WHERE NOT EXISTS (SELECT 1 FROM e p JOIN e q ON p.tournament_id = q.tournament_id WHERE p.norm = x.norm AND q.norm = y.norm)",
}
QUERIES = {k: f for k, f in globals().items() if callable(f) and (k in SQL or k in ("jeffreys_ci", "slot_contrast_fisher"))}
