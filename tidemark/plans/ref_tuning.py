"""Queries on lists next to what their label plays, and on boards beside the best one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import shrink
from tidemark.operators import cards as C
from tidemark.operators import matches as M
from tidemark.operators import shares as S
from tidemark.operators import tuning as T
from tidemark.operators.advice import field_value
from tidemark.plans.adapters import SQL_DECKS, rounds
from tidemark.plans.ref_advice import coverage_model
from tidemark.plans.ref_boards import _BOARDS, _both, _consensus
from tidemark.plans.ref_pooling import _BASE, _cells
from tidemark.session import durable


def _parts(spark, sf):
    d, c = _both(spark, sf)
    lists = _consensus(d, c).where("board = 'main'").select("archetype", "name", "copies")
    return d, c, T.partition(lists, C.frequencies(d.where("archetype is not null"), c.where("board = 'main'"), "archetype"), "archetype")


def flex_partition(spark, sf):
    """Locked and free cards of each archetype's consensus list."""
    return _parts(spark, sf)[2].withColumn("inclusion", F.round("inclusion", 6))


def swap_pools(spark, sf):
    d, c = _both(spark, sf)
    return T.swap_pool(d, c)


def tuned_swaps(spark, sf):
    """Swaps that each archetype's consensus list would make by the value of cards against the field."""
    d, c, parts = _parts(spark, sf)
    w = durable(M.card_winrates(M.resolve(rounds(d), d), c))
    own = w.where("b is null").select("name", "board", shrink(F.col("wins"), F.col("n")).alias("own"))
    lifts = w.where("b is not null").join(own, ["name", "board"]).select("name", "board", "b", "n", (shrink(F.col("wins"), F.col("n"), F.col("own")) - F.col("own")).alias("lift"))
    v = field_value(lifts, S.shares(S.raw_counts(d)).where("not fringe"), least=5).where("board = 'main'").select("name", F.round("value", 9).alias("value"))
    return T.tune(parts, T.swap_pool(d, c), v)


def grounded_cells(spark, sf):
    """Cells over the window of a pair where it has eight games, else over all."""
    from tidemark.plans.adapters import decks

    d = decks(spark, sf)
    return T.grounded_cells(_cells(spark, sf)[0], M.tallies(M.resolve(rounds(d), d)))


def hedged_board(spark, sf):
    """Six copies for the field, and what two slots of insurance would hold."""
    m = coverage_model(spark, sf)
    core = m.greedy(6)
    rows = [("core", c, n) for c, n in sorted(core.items())] + [("hedge", c, n) for c, n in sorted(m.hedge(core, 8).items())]
    return spark.createDataFrame(rows, "part string, name string, copies int")


def considering_cards(spark, sf):
    """What would gain most beside the greedy board of 8 copies."""
    m = coverage_model(spark, sf)
    return spark.createDataFrame([(c, round(g, 6)) for c, g in m.considering(m.greedy(8))], "name string, gain double")


SQL = {
    "flex_partition": f"{SQL_DECKS}, {_BOARDS} SELECT cb.archetype, cb.name, cb.copies, round(coalesce(inc, 0), 6) AS inclusion, coalesce(inc, 0) >= 0.65 AS locked FROM cb LEFT JOIN fq ON fq.archetype = cb.archetype AND fq.name = cb.name AND fq.board = 'main' WHERE cb.board = 'main'",
    "swap_pools": f"{SQL_DECKS} SELECT DISTINCT archetype, name FROM d JOIN cd ON cd.tournament_id = d.tournament_id AND cd.deck_idx = d.deck_idx WHERE archetype IS NOT NULL AND board = 'main'",
    "grounded_cells": f"{_BASE} SELECT c.a, c.b, CASE WHEN ac.n >= 8 THEN ac.wins ELSE c.wins END::BIGINT AS wins, CASE WHEN ac.n >= 8 THEN ac.n ELSE c.n END::BIGINT AS n, CASE WHEN ac.n >= 8 THEN 'window' ELSE 'full' END AS source FROM cell c LEFT JOIN ac ON ac.a = c.a AND ac.b = c.b",
}
QUERIES = {k: globals()[k] for k in ("flex_partition", "swap_pools", "tuned_swaps", "grounded_cells", "hedged_board", "considering_cards")}
