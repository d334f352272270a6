"""Queries on card statistics, compositions, camps and cores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cards as C
from tidemark.plans.adapters import SQL_DECKS, cards, decks

#: The signature card and the second card that the queries ask about.
SIGNATURE, OTHER = "marrowhorn conduit", "copperquarry courier"


def _main(spark, sf):
    return cards(spark, sf).where("board = 'main'").drop("board")


def _labelled(spark, sf):
    return decks(spark, sf).where("archetype is not null")


def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def card_frequency_modal(spark, sf):
    f = C.frequencies(_labelled(spark, sf), _main(spark, sf), "archetype")
    return _r6(f, "inclusion").select("archetype", "name", "decks", "pool", "inclusion", "modal")


def copy_histogram(spark, sf):
    return C.copy_histogram(_labelled(spark, sf), _main(spark, sf), "archetype")


def consensus_fill(spark, sf):
    f = C.frequencies(_labelled(spark, sf), _main(spark, sf), "archetype")
    return _r6(C.consensus(f, 60, "archetype"), "inclusion").select("archetype", "name", "copies", "inclusion")


def deck_vs_field(spark, sf):
    """Every deck whose key is divisible by 100 against all decks of its archetype."""
    d, m = _labelled(spark, sf), _main(spark, sf)
    asked = d.where("deck_key % 100 = 0").select("deck_key", "archetype", "tournament_id", "deck_idx")
    return _r6(C.decks_vs_field(asked, m, C.frequencies(d, m, "archetype"), C.copy_histogram(d, m, "archetype"), "deck_key", "archetype"), "share")


def subgroup_split(spark, sf):
    """Each archetype split by the card that about half of its decks have."""
    d, c = _labelled(spark, sf), cards(spark, sf)
    sig = C.middle_cards(C.frequencies(d, _main(spark, sf), "archetype"), "archetype")
    return _r6(C.subgroups(d, c, sig, "archetype"), "with_avg", "without_avg", "delta")


def _core(spark, sf):
    return C.core_sets(decks(spark, sf), _main(spark, sf))


def cohort_exists(spark, sf):
    """Decks with at least 2 copies of one card and exactly 1 of another: one aggregation in place of EXISTS."""
    m = _main(spark, sf).where(F.col("name").isin(SIGNATURE, OTHER))
    h = m.groupBy("tournament_id", "deck_idx").agg(F.bool_or((F.col("name") == SIGNATURE) & (F.col("copies") >= 2)).alias("a"), F.bool_or((F.col("name") == OTHER) & (F.col("copies") == 1)).alias("b"))
    return decks(spark, sf).join(h.where("a and b"), ["tournament_id", "deck_idx"], "left_semi").groupBy("archetype").agg(F.count(F.lit(1)).alias("decks"))


def _camps(spark, sf):
    return _labelled(spark, sf).where("variant is not null").select("archetype", "tournament_id", "deck_idx", "variant")


def tfidf_l2(spark, sf):
    """The decks with a camp of all archetypes, each archetype by itself."""
    return _r6(C.tfidf(_camps(spark, sf), _main(spark, sf), parent="archetype"), "weight")


def camp_centroid(spark, sf):
    p = _camps(spark, sf)
    return _r6(C.centroids(C.tfidf(p, _main(spark, sf), parent="archetype"), p, "variant", "archetype"), "weight")


def nearest_camp(spark, sf):
    p = _camps(spark, sf)
    v = C.tfidf(p, _main(spark, sf), parent="archetype")
    return _r6(C.nearest(v, C.centroids(v, p, "variant", "archetype"), "variant", parent="archetype"), "similarity")


def pmi_adjacency(spark, sf):
    """Cards adjacent to the core of every archetype."""
    d, m = decks(spark, sf), _main(spark, sf)
    return _r6(C.adjacency_all(d, m, C.core_sets(d, m).where("not staple").select("archetype", "name")), "pmi")


def core_sets_staples(spark, sf):
    return _core(spark, sf)


def jaccard_pairs(spark, sf):
    return _r6(C.core_jaccard(_core(spark, sf)), "jaccard")


_MN = "mn AS (SELECT tournament_id, deck_idx, name, copies FROM cd WHERE board = 'main'), lb AS (SELECT * FROM d WHERE archetype IS NOT NULL)"
_FQ = _MN + ", pl AS (SELECT archetype, count(*)::BIGINT AS pool FROM lb GROUP BY 1), fk AS (SELECT archetype, name, copies, count(*)::BIGINT AS k FROM mn JOIN lb USING (tournament_id, deck_idx) GROUP BY 1, 2, 3), fq AS (SELECT archetype, name, sum(k)::BIGINT AS decks, arg_max(copies, (k, copies)) AS modal FROM fk GROUP BY 1, 2)"
_CS = _MN + """, cn AS (SELECT archetype, count(*) AS n FROM lb GROUP BY 1), cc AS (SELECT archetype, name, count(*) AS k, any_value(n) AS n FROM mn JOIN lb USING (tournament_id, deck_idx) JOIN cn USING (archetype) GROUP BY 1, 2 HAVING count(*) >= 0.5 * any_value(n)),
cz AS (SELECT archetype, max(n) >= 30 AND count(*) >= 8 AS definer FROM cc GROUP BY 1), cs AS (SELECT archetype, name, definer FROM cc JOIN cz USING (archetype)),
sp AS (SELECT name FROM cs WHERE definer GROUP BY 1 HAVING count(*) >= 0.3 * (SELECT count(DISTINCT archetype) FROM cs WHERE definer)), co AS (SELECT archetype, name, name IN (SELECT name FROM sp) AS staple, definer FROM cs)"""
_TP = _MN + """, pp AS (SELECT * FROM lb WHERE variant IS NOT NULL), pn AS (SELECT archetype, count(*) AS n FROM pp GROUP BY 1), pc AS (SELECT mn.*, archetype, variant FROM mn JOIN pp USING (tournament_id, deck_idx)),
df AS (SELECT archetype, name, count(*) AS df, any_value(n) AS n FROM pc JOIN pn USING (archetype) GROUP BY 1, 2 HAVING count(*) BETWEEN 0.10 * any_value(n) AND 0.95 * any_value(n)),
tw AS (SELECT archetype, tournament_id, deck_idx, variant, name, copies * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM pc JOIN df USING (archetype, name)), tv AS (SELECT archetype, tournament_id, deck_idx, variant, name, w / sqrt(sum(w * w) OVER (PARTITION BY tournament_id, deck_idx)) AS weight FROM tw),
ct AS (SELECT archetype, variant, name, sum(weight) / any_value(n) AS w FROM tv JOIN (SELECT archetype, variant, count(*) AS n FROM pp GROUP BY 1, 2) USING (archetype, variant) GROUP BY 1, 2, 3), cv AS (SELECT archetype, variant, name, w / sqrt(sum(w * w) OVER (PARTITION BY archetype, variant)) AS weight FROM ct)"""
_D = SQL_DECKS
SQL = {
    "deck_vs_field": f"{_D}, {_FQ}, o AS (SELECT deck_key, archetype, tournament_id, deck_idx FROM lb WHERE deck_key % 100 = 0), h AS (SELECT archetype, name, copies, k FROM fk UNION ALL SELECT archetype, name, 0, pool - decks FROM fq JOIN pl USING (archetype) WHERE decks < pool), me AS (SELECT deck_key, archetype, name, copies AS own FROM mn JOIN o USING (tournament_id, deck_idx)), b AS (SELECT deck_key, o.archetype, name, modal FROM o JOIN fq ON fq.archetype = o.archetype), j AS (SELECT coalesce(b.deck_key, me.deck_key) AS deck_key, coalesce(b.archetype, me.archetype) AS archetype, coalesce(b.name, me.name) AS name, coalesce(own, 0) AS own, coalesce(modal, 0) AS modal FROM b FULL JOIN me ON me.deck_key = b.deck_key AND me.name = b.name), s AS (SELECT j.*, coalesce(k / pool::DOUBLE, 0) AS share FROM j JOIN pl ON pl.archetype = j.archetype LEFT JOIN h ON h.archetype = j.archetype AND h.name = j.name AND h.copies = own) SELECT deck_key, name, own, modal, own - modal AS delta, round(share, 6) AS share, share < 0.2 AND own <> modal AS outlier FROM s",
    "subgroup_split": f"{_D}, {_FQ}, sg AS (SELECT archetype, arg_min(name, (round(abs(decks / pool::DOUBLE - 0.5), 9), name)) AS signature FROM fq JOIN pl USING (archetype) GROUP BY 1), p AS (SELECT lb.archetype, signature, lb.tournament_id, lb.deck_idx, EXISTS (SELECT 1 FROM mn WHERE mn.tournament_id = lb.tournament_id AND mn.deck_idx = lb.deck_idx AND name = signature) AS has FROM lb JOIN sg ON sg.archetype = lb.archetype), n AS (SELECT archetype, count(*) FILTER (WHERE has) AS n1, count(*) FILTER (WHERE NOT has) AS n0 FROM p GROUP BY 1), g AS (SELECT archetype, any_value(signature) AS signature, name, sum(copies) FILTER (WHERE has) AS c1, sum(copies) FILTER (WHERE NOT has) AS c0 FROM mn JOIN p USING (tournament_id, deck_idx) GROUP BY 1, 3), x AS (SELECT g.*, coalesce(c1 / nullif(n1, 0)::DOUBLE, 0) AS a, coalesce(c0 / nullif(n0, 0)::DOUBLE, 0) AS b FROM g JOIN n USING (archetype)) SELECT archetype, signature, name, round(a, 6) AS with_avg, round(b, 6) AS without_avg, round(a - b, 6) AS delta FROM x",
    "tfidf_l2": f"{_D}, {_TP} SELECT archetype, tournament_id, deck_idx, name, round(weight, 6) AS weight FROM tv",
    "camp_centroid": f"{_D}, {_TP} SELECT archetype, variant, name, round(weight, 6) AS weight FROM cv",
    "nearest_camp": f"{_D}, {_TP}, dt AS (SELECT tv.archetype, tournament_id, deck_idx, cv.variant, round(sum(tv.weight * cv.weight), 9) AS s FROM tv JOIN cv ON cv.archetype = tv.archetype AND cv.name = tv.name GROUP BY 1, 2, 3, 4), b AS (SELECT *, row_number() OVER (PARTITION BY tournament_id, deck_idx ORDER BY s DESC, variant) AS k FROM dt) SELECT archetype, tournament_id, deck_idx, CASE WHEN s >= 0.35 THEN variant END AS variant, round(s, 6) AS similarity FROM b WHERE k = 1",
    "pmi_adjacency": f"{_D}, {_CS}, cr AS (SELECT archetype, name FROM co WHERE NOT staple), kk AS (SELECT archetype, greatest(3, ceil(0.6 * count(*))) AS k FROM cr GROUP BY 1), sl AS (SELECT cr.archetype, tournament_id, deck_idx FROM mn JOIN cr USING (name) JOIN kk ON kk.archetype = cr.archetype GROUP BY 1, 2, 3 HAVING count(*) >= any_value(kk.k)), ns AS (SELECT archetype, count(*) AS ns FROM sl GROUP BY 1), nx AS (SELECT name, count(*) AS n_x FROM mn GROUP BY 1), x AS (SELECT archetype, name, count(*) AS n_xs FROM sl JOIN mn USING (tournament_id, deck_idx) WHERE (archetype, name) NOT IN (SELECT (archetype, name) FROM cr) GROUP BY 1, 2) SELECT archetype, name, n_x, n_xs, round(ln(n_xs::DOUBLE * (SELECT count(*) FROM d) / (n_x::DOUBLE * ns)), 6) AS pmi FROM x JOIN nx USING (name) JOIN ns USING (archetype) WHERE n_xs >= 5",
    "card_frequency_modal": f"{_D}, {_FQ} SELECT archetype, name, decks, pool, round(decks / pool::DOUBLE, 6) AS inclusion, modal FROM fq JOIN pl USING (archetype)",
    "copy_histogram": f"{_D}, {_FQ} SELECT archetype, name, copies, k AS decks FROM fk UNION ALL SELECT archetype, name, 0, pool - decks FROM fq JOIN pl USING (archetype) WHERE decks < pool",
    "consensus_fill": f"{_D}, {_FQ}, x AS (SELECT archetype, name, modal, decks / pool::DOUBLE AS inclusion, coalesce(sum(modal) OVER (PARTITION BY archetype ORDER BY round(decks / pool::DOUBLE, 9) DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fq JOIN pl USING (archetype)) SELECT archetype, name, greatest(0, least(modal, 60 - before))::INT AS copies, round(inclusion, 6) AS inclusion FROM x WHERE least(modal, 60 - before) > 0",
    "cohort_exists": f"{_D}, {_MN} SELECT archetype, count(*)::BIGINT AS decks FROM d WHERE EXISTS (SELECT 1 FROM mn WHERE mn.tournament_id = d.tournament_id AND mn.deck_idx = d.deck_idx AND name = '{SIGNATURE}' AND copies >= 2) AND EXISTS (SELECT 1 FROM mn WHERE mn.tournament_id = d.tournament_id AND mn.deck_idx = d.deck_idx AND name = '{OTHER}' AND copies = 1) GROUP BY 1",
    "core_sets_staples": f"{_D}, {_CS} SELECT * FROM co",
    "jaccard_pairs": f"{_D}, {_CS}, c AS (SELECT archetype, name FROM co WHERE NOT staple), n AS (SELECT archetype, count(*) AS n FROM c GROUP BY 1), k AS (SELECT x.archetype AS x, y.archetype AS y, count(*) AS k FROM c x JOIN c y ON x.name = y.name AND x.archetype < y.archetype GROUP BY 1, 2) SELECT x, y, round(k / (a.n + b.n - k)::DOUBLE, 6) AS jaccard FROM k JOIN n a ON a.archetype = x JOIN n b ON b.archetype = y",
}
QUERIES = {k: f for k, f in globals().items() if callable(f) and k in SQL}
