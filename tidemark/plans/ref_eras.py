"""Queries on eras of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import label_key, name_key, time_text
from tidemark.operators import era_run as R
from tidemark.operators import shares as S
from tidemark.operators.matches import directed, resolve
from tidemark.operators.skew import latest_state
from tidemark.plans.adapters import BANS, SQL_DECKS, cards, decks, rounds
from tidemark.plans.ref_matches import _HZ, _bans, _reg
from tidemark.plans.sql import sql_label, sql_name, sql_time
from tidemark.session import durable, table


def _text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def _main(spark: SparkSession, sf: str) -> DataFrame:
    return cards(spark, sf).where("board = 'main'")


def _results(spark: SparkSession, d: DataFrame) -> DataFrame:
    """(entity, date, win): decisive matches of archetypes from both sides."""
    return directed(resolve(rounds(d), d)).where("date is not null").select(F.col("a").alias("entity"), "date", "win")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "card_events").where("kind = 'ban'")
    return e.select(time_text(F.col("date")).cast("date").alias("date"), name_key(F.col("card")).alias("card")).distinct()


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Boundaries (entity, start, p, signal) out of the history of runs, as candidates of a fleet."""
    t = table(spark, sf, "entity_eras").where("stable_since is not null and alarm_p_change is not null")
    t = t.select(label_key(F.col("entity")).alias("entity"), time_text(F.col("stable_since")).cast("date").alias("start"), ((1 - F.col("alarm_p_change")) / 8).alias("p"))
    return t.where("start is not null and entity <> ''").groupBy("entity", "start").agg(F.min("p").alias("p")).withColumn("signal", F.lit("run"))


def _weeks(c: DataFrame) -> DataFrame:
    """(entity, start, idx): a boundary's bucket is its week."""
    return c.select("entity", "start", F.floor(F.unix_date("start") / 7).alias("idx")).distinct()


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, parent, stable_since) of each entity's last run (ties: the smaller row)."""
    t = table(spark, sf, "entity_eras").select(label_key(F.col("entity")).alias("entity"), time_text(F.col("run_at")).alias("at"), label_key(F.col("parent")).alias("parent"), time_text(F.col("stable_since")).cast("date").alias("stable_since"))
    return latest_state(t.where("at is not null and entity <> ''"), ["entity"], "at", ["stable_since", "parent"])


def era_series(spark: SparkSession, sf: str) -> DataFrame:
    return _text(R.entity_series(decks(spark, sf)), "start")


def era_flex_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _text(R.flex_series(decks(spark, sf), _main(spark, sf)), "start")


def era_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of all three detectors over all entities, with permutation p."""
    d = decks(spark, sf)
    c = _main(spark, sf)
    s = durable(R.entity_series(d))
    return R.presence_candidates(d, c).unionByName(R.share_candidates(s)).unionByName(R.composition_candidates(s, R.flex_series(d, c)))


def era_run(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pipeline over all decks."""
    d = durable(decks(spark, sf))
    return R.run(d, _main(spark, sf), _results(spark, d), _events(spark, sf))


def era_merged(spark: SparkSession, sf: str) -> DataFrame:
    c = durable(_history(spark, sf))
    m = R.merge_candidates(c, _weeks(c), tolerance=26)
    return _text(m.withColumn("p", F.round("p", 9)), "start")


def era_derived(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted eras of the history's boundaries, with the floor of decks and inheritance from the parent."""
    c = durable(_history(spark, sf))
    m = durable(R.merge_candidates(c, _weeks(c), tolerance=26))
    parents = table(spark, sf, "entity_eras").groupBy(label_key(F.col("entity")).alias("entity")).agg(F.min(label_key(F.col("parent"))).alias("parent")).where("entity <> ''")
    series = decks(spark, sf).where("date is not null").groupBy(F.col("archetype").alias("entity"), F.col("date").alias("start")).agg(F.count(F.lit(1)).alias("decks"))
    return _text(R.derive(m, series, parents, alpha=0.2, least_after=3), "stable_since")


def era_corroborated(spark: SparkSession, sf: str) -> DataFrame:
    d = decks(spark, sf)
    r = R.corroborate(_history(spark, sf).select("entity", "start"), _results(spark, d))
    return _text(r.withColumns({c: F.round(c, 6) for c in ("rate_before", "rate_after")}), "start")


def era_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """What the boundaries of the history may come from; a card's first event date stands for its release."""
    d, c = durable(decks(spark, sf)), _main(spark, sf)
    b = durable(_history(spark, sf).select("entity", "start"))
    held = R.running_inclusion(d, c)
    adopted = b.join(held.select("entity", "name").distinct(), "entity")
    return _text(R.attribute(b, _events(spark, sf), held, adopted, R.first_seen(d, c)), "start")


def card_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return _text(R.first_seen(decks(spark, sf), cards(spark, sf)), "first")


def stable_since_map(spark: SparkSession, sf: str) -> DataFrame:
    return _text(_latest(spark, sf), "stable_since")


def era_horizons(spark: SparkSession, sf: str) -> DataFrame:
    """Horizon of every archetype and camp."""
    d = durable(decks(spark, sf))
    a = d.where("archetype is not null")
    labels = a.select(F.col("archetype").alias("label"), F.col("archetype").alias("parent")).union(a.where("variant is not null").select(F.concat_ws(" / ", "archetype", "variant"), "archetype")).distinct()
    h = R.horizons(labels, _latest(spark, sf), S.ban_horizon(d, cards(spark, sf), _reg(spark), _bans(spark)))
    return _text(h, "since")


def field_era(spark: SparkSession, sf: str) -> DataFrame:
    e = _latest(spark, sf).where("entity = parent").select("entity", "stable_since")
    return _text(R.field_era(decks(spark, sf), e, BANS[-1][0]), "since")


_T = "({} AT TIME ZONE 'UTC')::DATE"
_HIST = f"""hs AS (SELECT entity, start, min(p) AS p FROM (SELECT {sql_label('entity')} AS entity, {_T.format(sql_time('stable_since'))} AS start, (1 - alarm_p_change) / 8 AS p FROM entity_eras WHERE alarm_p_change IS NOT NULL) WHERE start IS NOT NULL AND entity <> '' GROUP BY 1, 2)"""
_MERGED = f"""{_HIST}, h1 AS (SELECT *, floor(date_diff('day', DATE '1970-01-01', start) / 7.0)::BIGINT AS idx FROM hs), h2 AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY entity ORDER BY idx, p) <= 26 THEN 0 ELSE 1 END AS nw FROM h1),
h3 AS (SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY idx, p ROWS UNBOUNDED PRECEDING) AS g FROM h2), h4 AS (SELECT *, row_number() OVER (PARTITION BY entity, g ORDER BY p, idx, start) AS r, count(*) OVER (PARTITION BY entity, g) AS signals FROM h3), mg AS (SELECT entity, start, p, signals::BIGINT AS signals FROM h4 WHERE r = 1)"""
_LAST = f"""ls AS (SELECT entity, stable_since, parent FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY at_ DESC, stable_since NULLS FIRST, parent) AS r FROM (SELECT {sql_label('entity')} AS entity, {sql_time('run_at')} AS at_, {sql_label('parent')} AS parent, {_T.format(sql_time('stable_since'))} AS stable_since FROM entity_eras) WHERE at_ IS NOT NULL AND entity <> '') WHERE r = 1)"""
_ENT = """dd AS (SELECT * FROM d WHERE archetype IS NOT NULL AND date IS NOT NULL), en AS (SELECT tournament_id, deck_idx, date, date_trunc('week', date)::DATE AS week, archetype AS entity FROM dd UNION ALL SELECT tournament_id, deck_idx, date, date_trunc('week', date)::DATE, archetype || ' / ' || variant FROM dd WHERE variant IS NOT NULL)"""
_SPAN = f"""{_ENT}, fw AS (SELECT date_trunc('week', date)::DATE AS week, count(*) AS f FROM dd GROUP BY 1), ew AS (SELECT entity, week, count(*) AS k FROM en GROUP BY 1, 2), gr AS (SELECT e.entity, fw.week, fw.f, coalesce(ew.k, 0) AS k, row_number() OVER (PARTITION BY e.entity ORDER BY fw.week) - 1 AS i FROM (SELECT DISTINCT entity FROM en) e CROSS JOIN fw LEFT JOIN ew ON ew.entity = e.entity AND ew.week = fw.week),
md AS (SELECT entity, CASE WHEN median(k) >= 10 THEN 1 WHEN median(k) >= 5 THEN 2 ELSE 4 END AS w FROM gr GROUP BY 1), sp AS (SELECT gr.entity, week, f, k, min(week) OVER (PARTITION BY gr.entity, i // w) AS start FROM gr JOIN md ON md.entity = gr.entity)"""
_D = SQL_DECKS
SQL = {
    "era_series": f"{_D}, {_SPAN}, s AS (SELECT entity, start, sum(k)::BIGINT AS decks, sum(f)::BIGINT AS field_decks, count(*) AS w FROM sp GROUP BY 1, 2) SELECT entity, list_extract(string_split(entity, ' / '), 1) AS parent, start::VARCHAR AS start, (row_number() OVER (PARTITION BY entity ORDER BY start) - 1)::INT AS idx, w = max(w) OVER (PARTITION BY entity) AS complete, decks, field_decks FROM s",
    "era_flex_counts": f"{_D}, {_SPAN}, mc AS (SELECT DISTINCT tournament_id, deck_idx, name FROM cd WHERE board = 'main'), wk AS (SELECT entity, name, week, count(*) AS k FROM en JOIN mc ON mc.tournament_id = en.tournament_id AND mc.deck_idx = en.deck_idx GROUP BY 1, 2, 3), nn AS (SELECT entity, count(*) AS n FROM en GROUP BY 1), fl AS (SELECT wk.entity, name FROM wk JOIN nn ON nn.entity = wk.entity GROUP BY 1, 2 HAVING sum(k) >= 0.10::DOUBLE * any_value(n) AND sum(k) <= 0.95::DOUBLE * any_value(n)) SELECT wk.entity, wk.name, sp.start::VARCHAR AS start, sum(wk.k)::BIGINT AS k FROM wk JOIN fl ON fl.entity = wk.entity AND fl.name = wk.name JOIN sp ON sp.entity = wk.entity AND sp.week = wk.week GROUP BY 1, 2, 3",
    "era_merged": f"WITH {_MERGED} SELECT entity, start::VARCHAR AS start, round(p, 9) AS p, signals FROM mg",
    "era_derived": f"""{_D}, {_MERGED}, rk AS (SELECT p, count(*) OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM mg), li AS (SELECT max(p) AS lim FROM rk WHERE p <= 0.2::DOUBLE * k / m), ac AS (SELECT entity, start FROM mg, li WHERE p <= lim),
sr AS (SELECT archetype AS entity, date, count(*) AS k FROM d WHERE date IS NOT NULL GROUP BY 1, 2), ow AS (SELECT entity, max(start) AS own FROM (SELECT ac.entity, ac.start FROM ac JOIN sr ON sr.entity = ac.entity AND sr.date >= ac.start GROUP BY 1, 2 HAVING sum(k) >= 3) GROUP BY 1), pa AS (SELECT {sql_label('entity')} AS entity, min({sql_label('parent')}) AS parent FROM entity_eras GROUP BY 1)
SELECT pa.entity, (CASE WHEN pa.entity <> pa.parent THEN greatest(o.own, u.own) ELSE o.own END)::VARCHAR AS stable_since, coalesce(pa.entity <> pa.parent AND o.own IS NULL AND u.own IS NOT NULL, FALSE) AS inherited FROM pa LEFT JOIN ow o ON o.entity = pa.entity LEFT JOIN ow u ON u.entity = pa.parent WHERE pa.entity <> ''""",
    "era_corroborated": f"""{_D}, {_HIST}, x AS (SELECT hs.entity, start, sum(win) FILTER (WHERE dir.date < start) AS wb, count(*) FILTER (WHERE dir.date < start) AS nb, sum(win) FILTER (WHERE dir.date >= start) AS wa, count(*) FILTER (WHERE dir.date >= start) AS na FROM hs JOIN dir ON dir.a = entity WHERE dir.date IS NOT NULL GROUP BY 1, 2)
SELECT hs.entity, hs.start::VARCHAR AS start, round(wb / nullif(nb, 0)::DOUBLE, 6) AS rate_before, round(wa / nullif(na, 0)::DOUBLE, 6) AS rate_after, coalesce(nb >= 30 AND na >= 30 AND round(abs(wa / nullif(na, 0)::DOUBLE - wb / nullif(nb, 0)::DOUBLE), 12) >= 0.05, FALSE) AS corroborated FROM hs LEFT JOIN x ON x.entity = hs.entity AND x.start = hs.start""",
    "era_attribution": f"""{_D}, {_HIST}, {_ENT}, ev AS (SELECT DISTINCT {_T.format(sql_time('date'))} AS date, {sql_name('card')} AS card FROM card_events WHERE kind = 'ban'), mc AS (SELECT DISTINCT tournament_id, deck_idx, name FROM cd WHERE board = 'main'),
nr AS (SELECT hs.entity, start, arg_min(ev.date, (abs(date_diff('day', ev.date, start)), ev.date)) AS nd FROM hs JOIN ev ON abs(date_diff('day', ev.date, start)) <= 14 AND card IS NOT NULL GROUP BY 1, 2),
cr AS (SELECT DISTINCT nr.entity, start, card FROM nr JOIN ev ON ev.date = nd WHERE card IS NOT NULL),
hd AS (SELECT en.entity, date, name FROM en JOIN mc ON mc.tournament_id = en.tournament_id AND mc.deck_idx = en.deck_idx),
ld AS (SELECT cr.entity, cr.start, card, max(hd.date) AS last, count(*) AS k FROM cr JOIN hd ON hd.entity = cr.entity AND hd.name = card AND hd.date < cr.start GROUP BY 1, 2, 3),
rt AS (SELECT ld.entity, ld.start, card, any_value(k) / count(*)::DOUBLE AS rate FROM ld JOIN en ON en.entity = ld.entity AND en.date <= last GROUP BY 1, 2, 3),
rn AS (SELECT cr.entity, cr.start, cr.card, rate, row_number() OVER (PARTITION BY cr.entity, cr.start ORDER BY CASE WHEN rate >= 0.25 THEN 0 WHEN rate IS NULL THEN 1 ELSE 2 END, coalesce(rate, 0) DESC, cr.card) AS r FROM cr LEFT JOIN rt ON rt.entity = cr.entity AND rt.start = cr.start AND rt.card = cr.card),
fs AS (SELECT name, min(date) AS first FROM mc JOIN d ON d.tournament_id = mc.tournament_id AND d.deck_idx = mc.deck_idx WHERE date IS NOT NULL GROUP BY 1), rl AS (SELECT hs.entity, start, min(fs.name) AS name FROM hs JOIN (SELECT DISTINCT entity, name FROM hd) h ON h.entity = hs.entity JOIN fs ON fs.name = h.name AND abs(date_diff('day', first, start)) <= 14 GROUP BY 1, 2),
bn AS (SELECT * FROM rn WHERE r = 1 AND (rate IS NULL OR rate >= 0.25))
SELECT hs.entity, hs.start::VARCHAR AS start, CASE WHEN bn.card IS NOT NULL THEN 'ban' WHEN rl.name IS NOT NULL THEN 'release' ELSE 'unattributed' END AS kind, coalesce(bn.card, rl.name) AS card FROM hs LEFT JOIN bn ON bn.entity = hs.entity AND bn.start = hs.start LEFT JOIN rl ON rl.entity = hs.entity AND rl.start = hs.start""",
    "card_first_seen": f"{_D} SELECT name, min(date)::VARCHAR AS first FROM cd JOIN d ON d.tournament_id = cd.tournament_id AND d.deck_idx = cd.deck_idx WHERE date IS NOT NULL GROUP BY 1",
    "stable_since_map": f"WITH {_LAST} SELECT entity, parent, stable_since::VARCHAR AS stable_since FROM ls",
    "era_horizons": f"""{_D}, {_HZ}, {_LAST}, lb AS (SELECT DISTINCT archetype AS label, archetype AS parent FROM d WHERE archetype IS NOT NULL UNION SELECT DISTINCT archetype || ' / ' || variant, archetype FROM d WHERE archetype IS NOT NULL AND variant IS NOT NULL)
SELECT label, (CASE WHEN o.entity IS NOT NULL THEN o.stable_since WHEN u.entity IS NOT NULL AND label <> lb.parent THEN u.stable_since ELSE valid_since END)::VARCHAR AS since, CASE WHEN o.entity IS NOT NULL THEN 'era' WHEN u.entity IS NOT NULL AND label <> lb.parent THEN 'era-parent' ELSE 'ban-only' END AS source FROM lb LEFT JOIN ls o ON o.entity = label LEFT JOIN ls u ON u.entity = lb.parent LEFT JOIN hz ON hz.archetype = lb.parent""",
    "field_era": f"""{_D}, {_LAST}, sh AS (SELECT archetype, count(*) / sum(count(*)) OVER ()::DOUBLE AS s FROM d WHERE archetype IS NOT NULL GROUP BY 1), lt AS (SELECT max(stable_since) AS late FROM ls JOIN sh ON sh.archetype = entity AND round(s, 12) >= 0.02 WHERE entity = parent), af AS (SELECT count(*) AS k FROM d, lt WHERE date >= late),
x AS (SELECT late, CASE WHEN late IS NULL THEN 'regime: no disturbance' WHEN late <= DATE '{BANS[-1][0]}' THEN 'regime: none later' WHEN k < 500 THEN 'regime: thin' ELSE 'boundary' END AS source FROM lt, af) SELECT (CASE WHEN source = 'boundary' THEN late ELSE DATE '{BANS[-1][0]}' END)::VARCHAR AS since, source FROM x""",
}
QUERIES = {k: f for k, f in globals().items() if callable(f) and (k in SQL or k in ("era_candidates", "era_run"))}
