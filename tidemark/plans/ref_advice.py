"""Queries on eras, positioning, coverage, costs and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import shrink
from tidemark.functions.text import time_text
from tidemark.operators import advice as A
from tidemark.operators import cards as C
from tidemark.operators import eras as E
from tidemark.operators import matches as M
from tidemark.operators import shares as S
from tidemark.plans.adapters import SQL_DECKS, cards, decks, rounds, standings
from tidemark.plans.ref_matches import _CW, _SH, _SHRINK
from tidemark.plans.sql import sql_time
from tidemark.session import table
from tidemark.sources.decklists import parse_lists

#: Least share of an archetype's decks that run a side card which counts as an answer of it.
ADOPTED = 0.05


def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _day(df, *cols):
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def _cells(spark, sf):
    d = decks(spark, sf)
    return M.tallies(M.resolve(rounds(d), d))


def _field(spark, sf):
    return S.shares(S.raw_counts(decks(spark, sf))).where("not fringe").select("archetype", "n", "share")


def era_buckets(spark, sf):
    return _day(E.buckets(decks(spark, sf)).where("decks > 0"), "start")


def presence_crossings(spark, sf):
    return _r6(_day(E.presence(decks(spark, sf), cards(spark, sf).where("board = 'main'")), "start"), "before", "after")


def presence_regimes(spark, sf):
    """Confirmed crossings of archetypes and camps, in buckets by density."""
    return _r6(_day(E.presence_regimes(decks(spark, sf), cards(spark, sf).where("board = 'main'")), "start"), "before", "after", "p")


def era_share_breaks(spark, sf):
    return _day(E.share_breaks(E.adaptive_buckets(decks(spark, sf))), "start")


def drift_alarms(spark, sf):
    """On weekly buckets whatever the density, as the alarm is about what is recent."""
    return E.drift_alarms(E.buckets(decks(spark, sf)))


def fdr_accept(spark, sf):
    """Benjamini-Hochberg over the change probabilities of all era rows, as p = 1 - probability, at alpha 0.2."""
    p = table(spark, sf, "entity_eras").where("alarm_p_change is not null").groupBy("era_id").agg((1 - F.max("alarm_p_change")).alias("p"))
    return _r6(E.accept_fdr(p, alpha=0.2), "p")


def ban_attribution(spark, sf):
    b = table(spark, sf, "entity_eras").groupBy(F.col("era_id").alias("id")).agg(F.min(time_text(F.col("stable_since"))).cast("date").alias("at"))
    e = table(spark, sf, "card_events").where("kind = 'ban'").select(time_text(F.col("date")).cast("date").alias("date"))
    return _day(E.nearest_event(b, e), "at", "event_date")


def delta_variance(spark, sf):
    return _r6(A.position(_cells(spark, sf), _field(spark, sf)), "variance", "coverage").withColumn("score", F.round("score", 5))


def gap_score(spark, sf):
    f = _field(spark, sf)
    return A.gaps(A.position(_cells(spark, sf), f), f).select("a", *[F.round(c, 5).alias(c) for c in ("score", "share", "gap")])


def best_deck_vs_best_call(spark, sf):
    return _r6(A.best_deck_or_call(_cells(spark, sf), _field(spark, sf)), "plain", "var", "weighted")


def positioning_mc(spark, sf):
    return A.positioning_draws(_cells(spark, sf), _field(spark, sf))


def field_weighted_value(spark, sf):
    d = decks(spark, sf)
    w = M.card_winrates(M.resolve(rounds(d), d), cards(spark, sf))
    own = w.where("b is null").select("name", "board", shrink(F.col("wins"), F.col("n")).alias("own"))
    lift = w.where("b is not null").join(own, ["name", "board"]).select("name", "board", "b", "n", (shrink(F.col("wins"), F.col("n"), F.col("own")) - F.col("own")).alias("lift"))
    return _r6(A.field_value(lift, _field(spark, sf), least=5), "value")


def top_finishers(spark, sf):
    d = decks(spark, sf)
    return A.top_finishers(d, standings(d))


def board_overlap(spark, sf):
    """Inclusion of side cards among top finishers and among all decks, per archetype."""
    d = decks(spark, sf).where("archetype is not null")
    side = cards(spark, sf).where("board = 'side'").drop("board")
    top = C.frequencies(A.top_finishers(d, standings(decks(spark, sf))).where("archetype is not null"), side, "archetype").select("archetype", "name", F.col("inclusion").alias("top"))
    return _r6(C.frequencies(d, side, "archetype").select("archetype", "name", F.col("inclusion").alias("everyone")).join(top, ["archetype", "name"]), "top", "everyone")


def coverage_model(spark, sf):
    """All labels of the field, and all side cards that at least ADOPTED of an archetype's decks run, which answer it;
    at most 1 / share least labels of at most 15 / ADOPTED cards."""
    field = _field(spark, sf)
    side = C.frequencies(decks(spark, sf).join(F.broadcast(field.select("archetype")), "archetype", "left_semi"), cards(spark, sf).where("board = 'side'").drop("board"), "archetype")
    covers = side.where(F.col("decks") >= ADOPTED * F.col("pool")).groupBy("name").agg(F.collect_set("archetype").alias("archetypes")).collect()
    return A.Coverage({r["archetype"]: r["share"] for r in field.collect()}, {r["name"]: set(r["archetypes"]) for r in covers})


def _coverage(spark, sf, exact):
    """A board of 8 copies for the field."""
    model = coverage_model(spark, sf)
    board, proven = model.exact(8) if exact else (model.greedy(8), False)
    return spark.createDataFrame([(c, n, round(model.value(board), 6), proven) for c, n in sorted(board.items())], "name string, copies int, value double, proven boolean")


def sideboard_greedy(spark, sf):
    return _coverage(spark, sf, False)


def sideboard_exact(spark, sf):
    return _coverage(spark, sf, True)


def _printings(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("printing"), F.when(F.col("p_retailprice") > 0, F.col("p_retailprice")).alias("price"))


def _lists(spark, sf):
    """Orders as lists of part names."""
    return table(spark, sf, "lineitem").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name")), "l_partkey").groupBy(F.col("l_orderkey").alias("deck"), "name").agg(F.sum(F.col("l_quantity").cast("int")).alias("copies"))


def cheapest_printing(spark, sf):
    return A.cheapest(_printings(spark, sf))


def deck_cost(spark, sf):
    return _r6(A.deck_cost(_lists(spark, sf), A.cheapest(_printings(spark, sf))), "total")


def _owned(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.sum("p_size").alias("owned"))


def allocation_contention(spark, sf):
    return A.contention(_lists(spark, sf), _owned(spark, sf))


def buildability(spark, sf):
    return A.buildable(_lists(spark, sf), _owned(spark, sf))


def decklist_parse(spark, sf):
    """Copies on both boards of the lists inside documents."""
    d = table(spark, sf, "documents").where("doc_type = 'decklist'").select(F.col("doc_id").alias("id"), "text")
    return parse_lists(d).groupBy("id", "board").agg(F.count(F.lit(1)).alias("lines"), F.sum("copies").alias("copies"))


def event_hourly_windows(spark, sf):
    """Tumbling hour windows per event type: the batch form of the streaming aggregation."""
    e = table(spark, sf, "events")
    w = F.window("ts", "1 hour")
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "value")


_FI = _SH + ", fi AS (SELECT archetype, share FROM sh WHERE share >= 0.02)"
_PO = (
    _FI
    + f""", kn AS (SELECT a, b, wins, n, {_SHRINK.format(w='wins', n='n')} AS p FROM cell), mn2 AS (SELECT a, avg(p) AS mean FROM kn GROUP BY 1),
gr AS (SELECT m2.a, fi.archetype AS b, fi.share, CASE WHEN m2.a = fi.archetype THEN 0.5::DOUBLE ELSE coalesce(p, mean) END AS q, n FROM mn2 m2 CROSS JOIN fi LEFT JOIN kn ON kn.a = m2.a AND kn.b = fi.archetype),
po AS (SELECT a, sum(share * q) / sum(share) AS score, coalesce(sum(share * share * q * (1 - q) / n) FILTER (WHERE n > 0), 0) AS variance, coalesce(coalesce(sum(share) FILTER (WHERE n >= 30 AND a <> b), NULL) / nullif(sum(share) FILTER (WHERE a <> b), 0), 0) AS coverage FROM gr GROUP BY 1)"""
)
_BK = """wd AS (SELECT *, date_trunc('week', date)::DATE AS start FROM d WHERE archetype IS NOT NULL AND date IS NOT NULL), fd AS (SELECT start, count(*)::BIGINT AS field_decks FROM wd GROUP BY 1),
en AS (SELECT archetype AS entity, start FROM wd UNION ALL SELECT archetype || ' / ' || variant, start FROM wd WHERE variant IS NOT NULL), bk AS (SELECT entity, start, count(*)::BIGINT AS decks FROM en GROUP BY 1, 2)"""
_TOP = """ps AS (SELECT tournament_id, count(*) AS players FROM st GROUP BY 1), su AS (SELECT tournament_id, norm, min(rank) AS rank FROM st GROUP BY 1, 2 HAVING count(*) = 1),
tf AS (SELECT uq.tournament_id, uq.deck_idx, uq.archetype, su.rank FROM uq JOIN su ON su.tournament_id = uq.tournament_id AND su.norm = uq.norm JOIN ps ON ps.tournament_id = uq.tournament_id WHERE uq.n = 1 AND rank <= greatest(1, ceil(0.25 * players)))"""
_LI = 'WITH pp AS (SELECT p_name AS name, p_partkey AS printing, CASE WHEN p_retailprice > 0 THEN p_retailprice END AS price, p_size FROM part), li AS (SELECT l_orderkey AS deck, p_name AS name, sum(l_quantity::INT)::BIGINT AS copies FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), ow AS (SELECT name, sum(p_size)::BIGINT AS owned FROM pp GROUP BY 1), ch AS (SELECT name, min(price) AS price, arg_min(printing, (price, printing)) FILTER (WHERE price IS NOT NULL) AS printing FROM pp GROUP BY 1)'
_D = SQL_DECKS
SQL = {
    "era_buckets": f"{_D}, {_BK} SELECT entity, start::VARCHAR AS start, decks, field_decks FROM bk JOIN fd USING (start)",
    "presence_crossings": f"""{_D}, wd AS (SELECT *, DATE '1970-01-05' + (floor(date_diff('day', DATE '1970-01-05', date) / 28)::INT * 28) AS start FROM d WHERE archetype IS NOT NULL AND date IS NOT NULL),
bk AS (SELECT archetype AS entity, start, count(*) AS decks FROM wd GROUP BY 1, 2 HAVING count(*) >= 5), bp AS (SELECT *, lag(start) OVER w AS prev, lag(decks) OVER w AS prev_decks FROM bk WINDOW w AS (PARTITION BY entity ORDER BY start)),
nn AS (SELECT archetype AS entity, name, start, count(*) AS k FROM wd JOIN (SELECT DISTINCT tournament_id, deck_idx, name FROM cd WHERE board = 'main') USING (tournament_id, deck_idx) GROUP BY 1, 2, 3),
se AS (SELECT DISTINCT entity, name FROM nn WHERE (entity, start) IN (SELECT (entity, start) FROM bk)), x AS (SELECT se.entity, se.name, bp.start, coalesce(q.k, 0) / prev_decks::DOUBLE AS before, coalesce(n.k, 0) / decks::DOUBLE AS after FROM se JOIN bp ON bp.entity = se.entity AND prev IS NOT NULL LEFT JOIN nn n ON n.entity = se.entity AND n.name = se.name AND n.start = bp.start LEFT JOIN nn q ON q.entity = se.entity AND q.name = se.name AND q.start = bp.prev)
SELECT entity, name, start::DATE::VARCHAR AS start, round(before, 6) AS before, round(after, 6) AS after FROM x WHERE (before >= 0.25 AND after < 0.05) OR (before < 0.05 AND after >= 0.25)""",
    "fdr_accept": "WITH c AS (SELECT era_id, 1 - max(alarm_p_change) AS p FROM entity_eras WHERE alarm_p_change IS NOT NULL GROUP BY 1), r AS (SELECT p, count(*) OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM c), t AS (SELECT max(p) AS lim FROM r WHERE p <= 0.2::DOUBLE * k / m) SELECT era_id, round(p, 6) AS p, coalesce(p <= lim, false) AS accepted FROM c, t",
    "ban_attribution": f"WITH b AS (SELECT era_id AS id, (min({sql_time('stable_since')}) AT TIME ZONE 'UTC')::DATE AS at_ FROM entity_eras GROUP BY 1), e AS (SELECT DISTINCT ({sql_time('date')} AT TIME ZONE 'UTC')::DATE AS event_date FROM card_events WHERE kind = 'ban'), n AS (SELECT id, arg_min(event_date, (abs(date_diff('day', event_date, at_)), event_date)) AS event_date FROM b JOIN e ON abs(date_diff('day', event_date, at_)) <= 14 GROUP BY 1) SELECT b.id, at_::VARCHAR AS \"at\", event_date::VARCHAR AS event_date FROM b LEFT JOIN n ON n.id = b.id",
    "delta_variance": f"{_D}, {_PO} SELECT a, round(score, 5) AS score, round(variance, 6) AS variance, round(coverage, 6) AS coverage FROM po",
    "gap_score": f"{_D}, {_PO} SELECT a, round(score, 5) AS score, round(coalesce(share, 0), 5) AS share, round(score - coalesce(share, 0), 5) AS gap FROM po LEFT JOIN fi ON archetype = a",
    "best_deck_vs_best_call": f"{_D}, {_FI}, c AS (SELECT a, {_SHRINK.format(w='wins', n='n')} AS p, share FROM cell JOIN fi ON archetype = b), g AS (SELECT a, avg(p) AS plain, var_pop(p) AS var, sum(p * share) / sum(share) AS weighted FROM c GROUP BY 1) SELECT a, round(plain, 6) AS plain, round(var, 6) AS var, round(weighted, 6) AS weighted, CASE WHEN round(var, 9) <= 0.02 AND round(plain, 9) >= 0.52 THEN 'BEST_DECK' WHEN round(weighted, 9) >= 0.52 THEN 'BEST_CALL' ELSE 'NEITHER' END AS verdict FROM g",
    "field_weighted_value": f"{_D}, {_FI}, {_CW}, o AS (SELECT name, board, {_SHRINK.format(w='wins', n='n')} AS own FROM cm), l AS (SELECT name, board, b, n, (15 * own + wins) / (15::DOUBLE + n) - own AS lift FROM cw JOIN o USING (name, board)) SELECT name, board, round(sum(share * lift), 6) AS value, count(*)::BIGINT AS cells FROM l JOIN fi ON archetype = b WHERE n >= 5 AND lift > 0 GROUP BY 1, 2",
    "top_finishers": f"{_D}, {_TOP} SELECT tournament_id, deck_idx, archetype, rank FROM tf",
    "board_overlap": f"{_D}, {_TOP}, si AS (SELECT * FROM cd WHERE board = 'side'), lb AS (SELECT * FROM d WHERE archetype IS NOT NULL), na AS (SELECT archetype, count(*) AS n FROM lb GROUP BY 1), nt AS (SELECT archetype, count(*) AS n FROM tf WHERE archetype IS NOT NULL GROUP BY 1), fa AS (SELECT archetype, name, count(*) AS k FROM si JOIN lb USING (tournament_id, deck_idx) GROUP BY 1, 2), ft AS (SELECT archetype, name, count(*) AS k FROM si JOIN tf USING (tournament_id, deck_idx) WHERE archetype IS NOT NULL GROUP BY 1, 2) SELECT archetype, name, round(fa.k / na.n::DOUBLE, 6) AS everyone, round(ft.k / nt.n::DOUBLE, 6) AS top FROM fa JOIN ft USING (archetype, name) JOIN na USING (archetype) JOIN nt USING (archetype)",
    "cheapest_printing": f"{_LI} SELECT name, printing, price FROM ch",
    "deck_cost": f"{_LI} SELECT deck, round(coalesce(sum(copies * price), 0), 6) AS total, count(*) FILTER (WHERE price IS NULL)::BIGINT AS unpriced FROM li LEFT JOIN ch USING (name) GROUP BY 1",
    "allocation_contention": f"{_LI}, w AS (SELECT name, sum(copies)::BIGINT AS wanted, count(DISTINCT deck)::BIGINT AS decks FROM li GROUP BY 1) SELECT name, wanted, coalesce(owned, 0)::BIGINT AS owned, decks FROM w LEFT JOIN ow USING (name) WHERE wanted > coalesce(owned, 0)",
    "buildability": f"{_LI} SELECT deck, sum(greatest(0, copies - coalesce(owned, 0)))::BIGINT AS missing FROM li LEFT JOIN ow USING (name) GROUP BY 1",
    "decklist_parse": r"""WITH l AS (SELECT doc_id AS id, i, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_type = 'decklist' AND text IS NOT NULL)),
s AS (SELECT id, min(i) AS cut FROM l WHERE regexp_matches(lower(line), '^sideboard:?[\s\x{a0}]*$') GROUP BY 1),
p AS (SELECT l.id, CASE WHEN i > cut THEN 'side' ELSE 'main' END AS board, try_cast(regexp_extract(line, '^([0-9]{1,3})x? +([^0-9 ].*)$', 1) AS INT) AS copies FROM l LEFT JOIN s ON s.id = l.id WHERE regexp_matches(line, '^[0-9]{1,3}x? +[^0-9 ].*$'))
SELECT id, board, count(*)::BIGINT AS lines, sum(copies)::BIGINT AS copies FROM p GROUP BY 1, 2""",
    "event_hourly_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
}
QUERIES = {k: f for k, f in globals().items() if callable(f) and (k in SQL or k in ("presence_regimes", "era_share_breaks", "drift_alarms", "positioning_mc", "sideboard_greedy", "sideboard_exact"))}
