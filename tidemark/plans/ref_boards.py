"""Queries on whole lists, backtests, plans, players and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import shrink
from tidemark.operators import boards as B
from tidemark.operators import cards as C
from tidemark.operators import matches as M
from tidemark.operators import shares as S
from tidemark.operators.advice import top_finishers
from tidemark.plans.adapters import BANS, SQL_DECKS, cards, decks, rounds, standings
from tidemark.plans.ref_eras import _LAST, _latest
from tidemark.plans.ref_matches import _HZ, _SH, _SHRINK, _TR, _XR, _bans, _horizons, _reg
from tidemark.session import durable, table


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return durable(decks(spark, sf)), durable(cards(spark, sf))


def _consensus(d: DataFrame, c: DataFrame) -> DataFrame:
    d = d.where("archetype is not null")
    f = lambda b: durable(C.frequencies(d, c.where(F.col("board") == b), "archetype"))
    return B.consensus_boards(f("main"), f("side"))


def consensus_boards(spark, sf):
    d, c = _both(spark, sf)
    return _consensus(d, c)


def composition_totals(spark, sf):
    """Copies of each card on the main boards of each archetype."""
    d, c = _both(spark, sf)
    return c.where("board = 'main'").join(d.where("archetype is not null").select("tournament_id", "deck_idx", "archetype"), ["tournament_id", "deck_idx"]).groupBy("archetype", "name").agg(F.sum("copies").alias("copies"))


def transferable_cards(spark, sf):
    """Cards next to each archetype's core that pay against the field."""
    d, c = _both(spark, sf)
    m = c.where("board = 'main'")
    r = M.resolve(rounds(d), d)
    w = durable(M.card_winrates(r, m))
    own = w.where("b is null").select("name", shrink(F.col("wins"), F.col("n")).alias("own"))
    v = w.where("b is not null").join(own, "name").select("name", "b", (shrink(F.col("wins"), F.col("n"), F.col("own")) - F.col("own")).alias("lift"), "n")
    cores = C.core_sets(d, m).where("not staple").select("archetype", "name")
    field = S.shares(S.raw_counts(d)).where("not fringe")
    return _r(B.transferable(C.adjacency_all(d, m, durable(cores)), v, field, least=10), "value", "pmi")


def event_composition(spark, sf):
    return B.event_composition(decks(spark, sf))


def events_in_scope(spark, sf):
    """Events at least half of whose decks are of labels that are no fringe."""
    d = durable(decks(spark, sf))
    return B.in_scope(B.event_composition(d), S.shares(S.raw_counts(d)).where("not fringe"))


def _finishers(d: DataFrame) -> DataFrame:
    return durable(top_finishers(d, standings(d)).where("archetype is not null"))


def observed_side_cards(spark, sf):
    d, c = _both(spark, sf)
    return _r(B.observed(_finishers(d), c), "frequency")


def observed_side_copies(spark, sf):
    d, c = _both(spark, sf)
    return B.observed_copies(_finishers(d), c)


def _tests(spark, sf) -> tuple[DataFrame, DataFrame]:
    d, c = _both(spark, sf)
    f = _finishers(d)
    return durable(B.backtest(_consensus(d, c).where("board = 'side'"), B.observed(f, c))), f.groupBy("archetype").agg(F.count(F.lit(1)).alias("n"))


def board_backtest(spark, sf):
    """The consensus side board of each archetype against its top finishers."""
    return _r(_tests(spark, sf)[0], "frequency")


def _tags(t: DataFrame) -> DataFrame:
    """A card's tag is the first word of its name, if it has several words."""
    return t.select("name").distinct().where("name like '% %'").select("name", F.element_at(F.split("name", " "), 1).alias("tag"))


def sweep_clusters(spark, sf):
    """Divergences of all archetypes by direction and tag."""
    t, n = _tests(spark, sf)
    return _r(B.divergences(t, _tags(t), n), "adoption").drop("members")


def sweep_ranked(spark, sf):
    """The same in order, after near duplicates were merged."""
    t, n = _tests(spark, sf)
    c = durable(B.divergences(t, _tags(t), n))
    merged = B.merge_near(c).select("direction", F.explode(F.split("tag", r"\+")).alias("tag"), F.col("tag").alias("merged"))
    top = B.rank_divergences(c).join(merged, ["direction", "tag"])
    return _r(top.select("place", "direction", "tag", "merged", "solid", "archetypes", "adoption"), "adoption")


def archetype_counts(spark, sf):
    """Labelled decks per archetype, without unknown ones, of at least five decks."""
    d = decks(spark, sf).where("archetype is not null and archetype <> 'unknown' and archetype not like 'conflict%'")
    return d.groupBy("archetype").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


def _plans(d: DataFrame) -> DataFrame:
    """Plan of an archetype: the last word of its name, for archetypes of two words or more."""
    a = d.where("archetype like '% %'").select("archetype").distinct()
    return a.select("archetype", F.element_at(F.split("archetype", " "), -1).alias("plan"))


def plan_results(spark, sf):
    d = durable(decks(spark, sf))
    return _r(B.plan_cells(M.resolve(rounds(d), d), durable(_plans(d))), "raw", "shrunk")


def archetype_plan_results(spark, sf):
    d = durable(decks(spark, sf))
    return B.label_against_plans(M.tallies(M.resolve(rounds(d), d)), durable(_plans(d)))


def plan_gaps(spark, sf):
    """Archetypes without a plan."""
    d = durable(decks(spark, sf))
    return B.unplanned(d.where("archetype is not null"), _plans(d))


def horizon_explained(spark, sf):
    d, c = _both(spark, sf)
    return _r(B.explain_horizon(d, c, _reg(spark), _bans(spark)), "share").withColumn("date", F.col("date").cast("string"))


def pair_windows(spark, sf):
    """Window start of each pair of archetypes that met: the later of both ban horizons."""
    d = durable(decks(spark, sf))
    h = _horizons(spark, sf, d)
    k = M.tallies(M.resolve(rounds(d), d)).select("a", "b")
    s = lambda x: h.select(F.col("archetype").alias(x), F.col("valid_since").alias(f"h{x}"))
    return k.join(s("a"), "a", "left").join(s("b"), "b", "left").select("a", "b", F.greatest("ha", "hb").cast("string").alias("since"))


def era_windows(spark, sf):
    """Window of each archetype and camp: its era, else its parent's, else the current regime."""
    d = durable(decks(spark, sf)).where("archetype is not null")
    labels = d.select(F.col("archetype").alias("label"), F.col("archetype").alias("parent")).union(d.where("variant is not null").select(F.concat_ws(" / ", "archetype", "variant"), "archetype")).distinct()
    e = _latest(spark, sf)
    x = labels.join(e.select(F.col("entity").alias("label"), F.col("stable_since").alias("own")), "label", "left").join(e.select(F.col("entity").alias("parent"), F.col("stable_since").alias("above")), "parent", "left")
    return x.select("label", F.coalesce("own", "above", F.lit(BANS[-1][0]).cast("date")).cast("string").alias("since"))


def topcut_unlabeled(spark, sf):
    """Decks of the top cut per provenance, and those without a label."""
    d = durable(decks(spark, sf))
    s = standings(d).groupBy("tournament_id", "norm").agg(F.count(F.lit(1)).alias("k"), F.min("rank").alias("rank")).where("k = 1 and rank <= 8")
    x = M.unique_names(d).where("n = 1").join(s, ["tournament_id", "norm"])
    return x.groupBy("provenance").agg(F.count(F.lit(1)).alias("decks"), F.count_if(F.col("archetype").isNull()).alias("unlabeled"))


def shares_by_definition(spark, sf):
    """Raw, top-cut and win-rate-weighted shares in one table."""
    d = durable(decks(spark, sf))
    raw = S.raw_counts(d)
    part = lambda n, x: x.select(F.lit(n).alias("definition"), "archetype", F.round("share", 6).alias("share"))
    return part("raw", S.shares(raw)).union(part("topcut", S.shares(S.topcut_counts(d, standings(d))))).union(part("wrw", S.winrate_weighted(raw, M.marginals(M.resolve(rounds(d), d)))))


def venue_shares(spark, sf):
    """Share of each archetype per provenance."""
    return _r(S.shares(S.raw_counts(decks(spark, sf), "provenance"), "provenance"), "share").select("provenance", "archetype", "n", "share")


def trend_lines(spark, sf):
    """One row per archetype: its share in every regime, null where it has none."""
    t = S.trends(decks(spark, sf), _reg(spark))
    return t.groupBy("archetype").pivot("regime", list(range(len(BANS) + 1))).agg(F.round(F.first("share"), 6)).select("archetype", *[F.col(str(i)).alias(f"regime_{i}") for i in range(len(BANS) + 1)])


def heatmap(spark, sf):
    """Shrunk rates of the rectangular matrix, blank where a cell is not shown."""
    from tidemark.operators.matrix import rectangular

    d = durable(decks(spark, sf))
    r = rectangular(M.resolve(rounds(d), d))
    return r.select("a", "b", F.when(F.col("shown"), F.round("p_shrunk", 6)).alias("value"))


def regime_rates(spark, sf):
    """Per regime and archetype: games, plain and field-weighted mean of shrunk rates over its opponents."""
    d = durable(decks(spark, sf))
    t = S.trends(d, _reg(spark)).select("regime", F.col("archetype").alias("b"), "share")
    x = S.in_regimes(M.directed(M.resolve(rounds(d), d)), _reg(spark)).groupBy("regime", "a", "b").agg(F.sum("win").alias("w"), F.count(F.lit(1)).alias("n"))
    x = x.withColumn("p", shrink(F.col("w"), F.col("n"))).join(t, ["regime", "b"])
    g = x.groupBy("regime", F.col("a").alias("archetype")).agg(F.sum("n").alias("n"), F.avg("p").alias("plain"), (F.sum(F.col("p") * F.col("share")) / F.sum("share")).alias("weighted"))
    return _r(g, "plain", "weighted")


def rounds_by_provenance(spark, sf):
    d = durable(decks(spark, sf))
    e = d.groupBy("tournament_id").agg(F.min("provenance").alias("provenance"))
    return rounds(d).join(e, "tournament_id").groupBy("provenance").agg(F.count(F.lit(1)).alias("rounds"))


def camp_records(spark, sf):
    """Wins and games of each camp, and of the decks without one, against all others."""
    d = durable(decks(spark, sf))
    x = M.directed(M.resolve(rounds(d), d))
    return x.groupBy(F.col("a").alias("archetype"), F.coalesce("va", F.lit("unlabeled")).alias("camp")).agg(F.sum("win").alias("wins"), F.count(F.lit(1)).alias("n"))


def resolved_players(spark, sf):
    """Decks and events per player, handles joined by the curated ids."""
    a = table(spark, sf, "player_aliases").select(F.lower(F.trim("handle_norm")).alias("norm"), F.col("player_id").alias("player"))
    r = B.resolve_players(decks(spark, sf).where("norm is not null"), a)
    return r.groupBy("player").agg(F.count(F.lit(1)).alias("decks"), F.count_distinct("tournament_id").alias("events"), F.count_distinct("norm").alias("handles"))


_D = SQL_DECKS
_FREQ = """pn AS (SELECT archetype, count(*) AS pool FROM d WHERE archetype IS NOT NULL GROUP BY 1), fc AS (SELECT archetype, board, name, copies, count(*) AS k FROM d JOIN cd ON cd.tournament_id = d.tournament_id AND cd.deck_idx = d.deck_idx WHERE archetype IS NOT NULL GROUP BY 1, 2, 3, 4),
fq AS (SELECT fc.archetype, board, name, round(sum(k) / any_value(pool)::DOUBLE, 9) AS inc, arg_max(copies, (k, copies)) AS modal FROM fc JOIN pn ON pn.archetype = fc.archetype GROUP BY 1, 2, 3)"""
_BOARDS = f"""{_FREQ}, f1 AS (SELECT *, CASE board WHEN 'main' THEN 60 ELSE 15 END AS target, coalesce(sum(modal) OVER (PARTITION BY archetype, board ORDER BY inc DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM fq),
f2 AS (SELECT *, least(modal, target - bf) AS c FROM f1 WHERE least(modal, target - bf) > 0), dp AS (SELECT x.archetype, x.name, y.inc > x.inc AS to_side FROM f2 x JOIN f2 y ON x.archetype = y.archetype AND x.name = y.name AND x.board = 'main' AND y.board = 'side'),
f3 AS (SELECT f2.* FROM f2 LEFT JOIN dp ON dp.archetype = f2.archetype AND dp.name = f2.name WHERE dp.name IS NULL OR (board = 'side') = to_side), hv AS (SELECT archetype, board, sum(c) AS have FROM f3 GROUP BY 1, 2),
m1 AS (SELECT f1.*, target - have AS room, coalesce(sum(modal) OVER (PARTITION BY f1.archetype ORDER BY inc DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b2 FROM f1 JOIN hv ON hv.archetype = f1.archetype AND hv.board = f1.board WHERE f1.board = 'main' AND target > have AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.archetype = f1.archetype AND f3.name = f1.name)),
m2 AS (SELECT archetype, name, least(modal, room - b2) AS c FROM m1 WHERE least(modal, room - b2) > 0),
s1_ AS (SELECT f1.*, target - have AS room, coalesce(sum(modal) OVER (PARTITION BY f1.archetype ORDER BY inc DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b2 FROM f1 JOIN hv ON hv.archetype = f1.archetype AND hv.board = f1.board WHERE f1.board = 'side' AND target > have AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.archetype = f1.archetype AND f3.name = f1.name) AND NOT EXISTS (SELECT 1 FROM m2 WHERE m2.archetype = f1.archetype AND m2.name = f1.name)),
cb AS (SELECT archetype, board, name, c::INT AS copies FROM f3 UNION ALL SELECT archetype, 'main', name, c::INT FROM m2 UNION ALL SELECT archetype, 'side', name, least(modal, room - b2)::INT FROM s1_ WHERE least(modal, room - b2) > 0)"""
_FIN = """sz AS (SELECT tournament_id, count(*) AS players FROM st GROUP BY 1), su AS (SELECT tournament_id, norm, min(rank) AS rank FROM st GROUP BY 1, 2 HAVING count(*) = 1),
fi AS (SELECT uq.tournament_id, uq.deck_idx, archetype FROM uq JOIN su ON su.tournament_id = uq.tournament_id AND su.norm = uq.norm JOIN sz ON sz.tournament_id = uq.tournament_id WHERE uq.n = 1 AND archetype IS NOT NULL AND su.rank <= greatest(1, ceil(0.25 * players))), fn AS (SELECT archetype, count(*) AS n FROM fi GROUP BY 1),
ob AS (SELECT fi.archetype, name, count(DISTINCT (fi.tournament_id, fi.deck_idx))::BIGINT AS decks, any_value(fn.n) AS n FROM fi JOIN cd ON cd.tournament_id = fi.tournament_id AND cd.deck_idx = fi.deck_idx JOIN fn ON fn.archetype = fi.archetype WHERE board = 'side' GROUP BY 1, 2)"""
_BT = f"""{_BOARDS}, {_FIN}, rc AS (SELECT DISTINCT archetype, name FROM cb WHERE board = 'side' AND archetype IN (SELECT archetype FROM ob)),
bt AS (SELECT * FROM (SELECT coalesce(rc.archetype, ob.archetype) AS archetype, coalesce(rc.name, ob.name) AS name, coalesce(decks / n::DOUBLE, 0) AS f, CASE WHEN rc.name IS NOT NULL AND round(coalesce(decks / n::DOUBLE, 0), 9) >= 0.2 THEN 'overlap' WHEN rc.name IS NOT NULL THEN 'scorer_only' WHEN round(decks / n::DOUBLE, 9) >= 0.2 THEN 'winners_only' END AS verdict FROM rc FULL JOIN ob ON ob.archetype = rc.archetype AND ob.name = rc.name) WHERE verdict IS NOT NULL)"""
_PL = "pl AS (SELECT DISTINCT archetype, list_extract(string_split(archetype, ' '), -1) AS plan FROM d WHERE archetype LIKE '% %')"
SQL = {
    "consensus_boards": f"{_D}, {_BOARDS} SELECT * FROM cb",
    "composition_totals": f"{_D} SELECT archetype, name, sum(copies)::BIGINT AS copies FROM d JOIN cd ON cd.tournament_id = d.tournament_id AND cd.deck_idx = d.deck_idx WHERE archetype IS NOT NULL AND board = 'main' GROUP BY 1, 2",
    "event_composition": f"{_D} SELECT tournament_id, archetype, count(*)::BIGINT AS n FROM d WHERE archetype IS NOT NULL GROUP BY 1, 2",
    "events_in_scope": f"{_D}, {_SH} SELECT tournament_id FROM d JOIN sh ON sh.archetype = d.archetype GROUP BY 1 HAVING count(*) FILTER (WHERE share >= 0.02) >= 0.5 * count(*)",
    "observed_side_cards": f"{_D}, {_FIN} SELECT archetype, name, decks, n::BIGINT AS n, round(decks / n::DOUBLE, 6) AS frequency FROM ob",
    "observed_side_copies": f"{_D}, {_FIN}, x AS (SELECT fi.archetype, fi.tournament_id, fi.deck_idx, name, sum(copies) AS copies FROM fi JOIN cd ON cd.tournament_id = fi.tournament_id AND cd.deck_idx = fi.deck_idx WHERE board = 'side' GROUP BY ALL) SELECT archetype, name, copies::BIGINT AS copies, count(*)::BIGINT AS decks FROM x GROUP BY 1, 2, 3",
    "board_backtest": f"{_D}, {_BT} SELECT archetype, name, verdict, round(f, 6) AS frequency FROM bt",
    "sweep_clusters": f"{_D}, {_BT} SELECT verdict AS direction, CASE WHEN name LIKE '% %' THEN split_part(name, ' ', 1) ELSE 'unclassified' END AS tag, count(DISTINCT bt.archetype)::BIGINT AS archetypes, count(DISTINCT bt.archetype) FILTER (WHERE fn.n >= 30)::BIGINT AS solid, round(sum(f), 6) AS adoption FROM bt JOIN fn ON fn.archetype = bt.archetype WHERE verdict <> 'overlap' GROUP BY 1, 2",
    "archetype_counts": f"{_D} SELECT archetype, count(*)::BIGINT AS n FROM d WHERE archetype IS NOT NULL AND archetype <> 'unknown' AND archetype NOT LIKE 'conflict%' GROUP BY 1 HAVING count(*) >= 5",
    "plan_results": f"""{_D}, {_PL}, x AS (SELECT pa.plan AS pa, pb.plan AS pb, status, (s1 > s2)::INT AS w FROM m JOIN pl pa ON pa.archetype = a JOIN pl pb ON pb.archetype = b WHERE status IN ('decisive', 'mirror')), y AS (SELECT pa AS s, pb AS o, w FROM x WHERE pa <> pb UNION ALL SELECT pb, pa, 1 - w FROM x WHERE pa <> pb), z AS (SELECT s, o, sum(w)::BIGINT AS w, count(*) AS n FROM y GROUP BY 1, 2), q AS (SELECT pa, count(*) FILTER (WHERE status = 'decisive') AS o, count(*) FILTER (WHERE status = 'mirror') AS mi FROM x WHERE pa = pb GROUP BY 1), k AS (SELECT DISTINCT plan FROM pl)
SELECT u.plan AS subject, v.plan AS opponent, coalesce(w, 0)::BIGINT AS wins, (coalesce(n, 0) - coalesce(w, 0))::BIGINT AS losses, coalesce(n, 0)::BIGINT AS n, CASE WHEN u.plan = v.plan THEN 0.5::DOUBLE WHEN n > 0 THEN round(w / n::DOUBLE, 6) END AS raw, CASE WHEN u.plan = v.plan THEN 0.5::DOUBLE WHEN n > 0 THEN round({_SHRINK.format(w='w', n='n')}, 6) END AS shrunk, u.plan <> v.plan AND coalesce(n, 0) >= 30 AS measured, u.plan = v.plan AS same_plan, CASE WHEN u.plan = v.plan THEN coalesce(q.o, 0) ELSE coalesce(n, 0) END::BIGINT AS observed_n, CASE WHEN u.plan = v.plan THEN coalesce(mi, 0) ELSE 0 END::BIGINT AS mirror_n FROM k u CROSS JOIN k v LEFT JOIN z ON z.s = u.plan AND z.o = v.plan LEFT JOIN q ON q.pa = u.plan""",
    "archetype_plan_results": f"{_D}, {_PL}, t AS (SELECT a, plan, sum(wins) AS wins, sum(n) AS n FROM cell JOIN pl ON pl.archetype = b GROUP BY 1, 2) SELECT x.archetype, k.plan, coalesce(wins, 0)::BIGINT AS wins, coalesce(n, 0)::BIGINT AS n FROM pl x CROSS JOIN (SELECT DISTINCT plan FROM pl) k LEFT JOIN t ON t.a = x.archetype AND t.plan = k.plan",
    "plan_gaps": f"{_D}, {_PL} SELECT DISTINCT archetype FROM d WHERE archetype IS NOT NULL AND archetype NOT IN (SELECT archetype FROM pl)",
    "horizon_explained": f"""{_D}, {_XR}, ba AS (SELECT archetype, until, count(*) AS n FROM xr WHERE archetype IS NOT NULL AND until IS NOT NULL GROUP BY 1, 2), rn AS (SELECT xr.archetype, xr.until, b.card, count(DISTINCT (xr.tournament_id, xr.deck_idx)) AS k FROM xr JOIN reg b ON b.since = xr.until JOIN cd ON cd.tournament_id = xr.tournament_id AND cd.deck_idx = xr.deck_idx AND cd.name = b.card WHERE xr.archetype IS NOT NULL GROUP BY 1, 2, 3)
SELECT ba.archetype, ba.until::VARCHAR AS date, b.card, coalesce(k, 0)::BIGINT AS ran, n::BIGINT AS decks, round(coalesce(k, 0) / n::DOUBLE, 6) AS share, coalesce(k, 0) >= 0.25 * n AS affected FROM ba JOIN reg b ON b.since = ba.until LEFT JOIN rn ON rn.archetype = ba.archetype AND rn.until = ba.until AND rn.card = b.card""",
    "pair_windows": f"{_D}, {_HZ} SELECT a, b, greatest(x.valid_since, y.valid_since)::VARCHAR AS since FROM cell LEFT JOIN hz x ON x.archetype = a LEFT JOIN hz y ON y.archetype = b",
    "era_windows": f"{_D}, {_LAST}, lb AS (SELECT DISTINCT archetype AS label, archetype AS parent FROM d WHERE archetype IS NOT NULL UNION SELECT DISTINCT archetype || ' / ' || variant, archetype FROM d WHERE archetype IS NOT NULL AND variant IS NOT NULL) SELECT label, coalesce(o.stable_since, u.stable_since, DATE '{BANS[-1][0]}')::VARCHAR AS since FROM lb LEFT JOIN ls o ON o.entity = label LEFT JOIN ls u ON u.entity = lb.parent",
    "topcut_unlabeled": f"{_D}, su AS (SELECT tournament_id, norm, min(rank) AS rank FROM st GROUP BY 1, 2 HAVING count(*) = 1) SELECT provenance, count(*)::BIGINT AS decks, count(*) FILTER (WHERE archetype IS NULL)::BIGINT AS unlabeled FROM uq JOIN su ON su.tournament_id = uq.tournament_id AND su.norm = uq.norm WHERE uq.n = 1 AND rank <= 8 GROUP BY 1",
    "shares_by_definition": f"""{_D}, {_SH}, su AS (SELECT tournament_id, norm, min(rank) AS rank FROM st GROUP BY 1, 2 HAVING count(*) = 1), tc AS (SELECT archetype, count(*) AS n FROM uq JOIN su ON su.tournament_id = uq.tournament_id AND su.norm = uq.norm WHERE uq.n = 1 AND archetype IS NOT NULL AND rank <= 8 GROUP BY 1), w AS (SELECT archetype, share * mar.wins / mar.n AS w FROM sh JOIN mar ON mar.a = archetype WHERE mar.n > 0)
SELECT 'raw' AS definition, archetype, round(share, 6) AS share FROM sh UNION ALL SELECT 'topcut', archetype, round(n / (SELECT sum(n) FROM tc)::DOUBLE, 6) FROM tc UNION ALL SELECT 'wrw', archetype, round(w / (SELECT sum(w) FROM w), 6) FROM w""",
    "venue_shares": f"{_D} SELECT provenance, archetype, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY provenance), 6) AS share FROM d WHERE archetype IS NOT NULL GROUP BY 1, 2",
    "trend_lines": f"{_D}, {_TR} SELECT archetype, " + ", ".join(f"round(max(share) FILTER (WHERE regime = {i}), 6) AS regime_{i}" for i in range(len(BANS) + 1)) + " FROM tr GROUP BY 1",
    "heatmap": f"{_D}, kp AS (SELECT a, {_SHRINK.format(w='wins', n='n')} AS prior FROM mar WHERE n >= 0.02 * (SELECT sum(n) FROM mar)), mi AS (SELECT a, count(*) AS k FROM m WHERE status = 'mirror' GROUP BY 1) SELECT x.a, y.a AS b, CASE WHEN x.a = y.a THEN CASE WHEN coalesce(mi.k, 0) >= 30 THEN 0.5::DOUBLE END WHEN coalesce(c.n, 0) >= 30 THEN round((15 * x.prior + wins) / (15::DOUBLE + n), 6) END AS value FROM kp x CROSS JOIN kp y LEFT JOIN cell c ON c.a = x.a AND c.b = y.a LEFT JOIN mi ON mi.a = x.a",
    "regime_rates": f"{_D}, {_TR}, rg AS (SELECT g.regime, dir.a, dir.b, sum(win) AS w, count(*) AS n FROM dir JOIN (SELECT row_number() OVER (ORDER BY since NULLS FIRST) - 1 AS regime, since, until FROM reg) g ON (g.since IS NULL OR dir.date >= g.since) AND (g.until IS NULL OR dir.date < g.until) WHERE dir.date IS NOT NULL GROUP BY 1, 2, 3) SELECT rg.regime::INT AS regime, rg.a AS archetype, sum(rg.n)::BIGINT AS n, round(avg({_SHRINK.format(w='rg.w', n='rg.n')}), 6) AS plain, round(sum({_SHRINK.format(w='rg.w', n='rg.n')} * share) / sum(share), 6) AS weighted FROM rg JOIN tr ON tr.regime = rg.regime AND tr.archetype = rg.b GROUP BY 1, 2",
    "rounds_by_provenance": f"{_D}, e AS (SELECT tournament_id, min(provenance) AS provenance FROM d GROUP BY 1) SELECT provenance, count(*)::BIGINT AS rounds FROM r JOIN e ON e.tournament_id = r.tournament_id GROUP BY 1",
    "camp_records": f"{_D} SELECT a AS archetype, coalesce(va, 'unlabeled') AS camp, sum(win)::BIGINT AS wins, count(*)::BIGINT AS n FROM dir GROUP BY 1, 2",
    "resolved_players": f"{_D}, al AS (SELECT lower(trim(handle_norm)) AS norm, min(player_id) AS player FROM player_aliases WHERE player_id <> '' GROUP BY 1) SELECT coalesce(player, d.norm) AS player, count(*)::BIGINT AS decks, count(DISTINCT tournament_id)::BIGINT AS events, count(DISTINCT d.norm)::BIGINT AS handles FROM d LEFT JOIN al ON al.norm = d.norm WHERE d.norm IS NOT NULL GROUP BY 1",
}
QUERIES = {k: f for k, f in globals().items() if callable(f) and (k in SQL or k in ("transferable_cards", "sweep_ranked"))}
