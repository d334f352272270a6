"""Whole lists per label: consensus of both boards, transferable cards, backtests of boards, divergences, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.stats import shrink, tier
from tidemark.operators.components import min_label_components

_DECK = ["tournament_id", "deck_idx"]
# Fixed values.
MAIN, SIDE, OBSERVED, SCOPE, NEAR, GROUND = 60, 15, 0.20, 0.5, 0.8, 30


def fill(freq: DataFrame, target: Column, *by: str) -> DataFrame:
    """Copies of each card when boards of ``target`` cards are filled in order of inclusion (ties by name)."""
    w = Window.partitionBy(*by).orderBy(F.round("inclusion", 9).desc(), "name").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("modal").over(w), F.lit(0))
    return freq.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("modal"), target - before)).cast("int")).where("copies > 0")


def consensus_boards(main: DataFrame, side: DataFrame, key: str = "archetype", main_size: int = MAIN, side_size: int = SIDE) -> DataFrame:
    """(key, board, name, copies): consensus of both boards of every label.

    ``main``, ``side``: (key, name, modal, inclusion). Each board is filled in order; a card on both stays where more decks
    have it (ties: main); what that frees is filled from cards on neither board.
    """
    m, s = fill(main, F.lit(main_size), key), fill(side, F.lit(side_size), key)
    k = [key, "name"]
    both = m.select(*k, F.col("inclusion").alias("im")).join(s.select(*k, F.col("inclusion").alias("is")), k)
    lose_main, lose_side = both.where("round(is, 9) > round(im, 9)").select(*k), both.where("round(is, 9) <= round(im, 9)").select(*k)
    m, s = m.join(lose_main, k, "left_anti"), s.join(lose_side, k, "left_anti")
    used = m.select(*k).union(s.select(*k))

    def topped(board: DataFrame, freq: DataFrame, size: int, taken: DataFrame) -> DataFrame:
        have = board.groupBy(key).agg(F.sum("copies").alias("have"))
        rest = freq.join(taken, k, "left_anti").join(have, key).withColumn("room", size - F.col("have"))
        return board.select(*k, "copies").union(fill(rest.where("room > 0"), F.col("room"), key).select(*k, "copies"))

    m2 = topped(m, main, main_size, used)
    s2 = topped(s, side, side_size, used.union(m2.select(*k)).distinct())
    return m2.withColumn("board", F.lit("main")).union(s2.withColumn("board", F.lit("side"))).select(key, "board", "name", "copies")


def transferable(adjacent: DataFrame, values: DataFrame, field: DataFrame, least: int = 100, top: int = 5) -> DataFrame:
    """(archetype, name, value, n, pmi): cards next to a label's core whose lifts against the field carry over.

    ``adjacent``: (archetype, name, pmi); ``values``: (name, b, lift, n), of which positive lifts over at least ``least``
    games count, weighted by the share of b. The ``top`` of each label by value, games, name.
    """
    v = values.where((F.col("n") >= least) & (F.col("lift") > 0)).join(F.broadcast(field.select(F.col("archetype").alias("b"), "share")), "b")
    v = v.groupBy("name").agg(F.sum(F.col("share") * F.col("lift")).alias("value"), F.sum("n").alias("n"))
    x = adjacent.join(v, "name")
    place = F.row_number().over(Window.partitionBy("archetype").orderBy(F.round("value", 9).desc(), F.desc("n"), "name"))
    return x.withColumn("place", place).where(F.col("place") <= top).select("archetype", "name", "value", "n", "pmi")


def event_composition(decks: DataFrame) -> DataFrame:
    """(tournament_id, archetype, n) of labelled decks."""
    return decks.where("archetype is not null").groupBy("tournament_id", "archetype").agg(F.count(F.lit(1)).alias("n"))


def in_scope(composition: DataFrame, field: DataFrame, least: float = SCOPE) -> DataFrame:
    """(tournament_id): events at least half of whose labelled decks are of the field."""
    c = composition.join(field.select("archetype", F.lit(1).alias("f")).distinct(), "archetype", "left")
    g = c.groupBy("tournament_id").agg(F.sum(F.when(F.col("f") == 1, F.col("n")).otherwise(0)).alias("k"), F.sum("n").alias("t"))
    return g.where(F.col("k") >= least * F.col("t")).select("tournament_id")


def observed(finishers: DataFrame, cards: DataFrame) -> DataFrame:
    """(archetype, name, decks, n, frequency): share of the finishers' decks with a card on the side board."""
    n = finishers.groupBy("archetype").agg(F.count(F.lit(1)).alias("n"))
    s = cards.where("board = 'side'").join(finishers.select(*_DECK, "archetype"), _DECK)
    return s.groupBy("archetype", "name").agg(F.count_distinct(*_DECK).alias("decks")).join(n, "archetype").withColumn("frequency", F.col("decks") / F.col("n"))


def observed_copies(finishers: DataFrame, cards: DataFrame) -> DataFrame:
    """(archetype, name, copies, decks) on the finishers' side boards."""
    s = cards.where("board = 'side'").join(finishers.select(*_DECK, "archetype"), _DECK)
    s = s.groupBy("archetype", *_DECK, "name").agg(F.sum("copies").alias("copies"))
    return s.groupBy("archetype", "name", "copies").agg(F.count(F.lit(1)).alias("decks"))


def backtest(recommended: DataFrame, seen: DataFrame, least: float = OBSERVED) -> DataFrame:
    """(archetype, name, verdict, frequency): a recommended card against what at least ``least`` of the finishers run:
    overlap, scorer_only or winners_only. Labels without finishers have no rows."""
    r = recommended.select("archetype", "name", F.lit(True).alias("rec")).distinct().join(seen.select("archetype").distinct(), "archetype", "left_semi")
    x = r.join(seen.select("archetype", "name", "frequency"), ["archetype", "name"], "full")
    often, rec = F.coalesce(F.round("frequency", 9) >= least, F.lit(False)), F.coalesce("rec", F.lit(False))
    v = F.when(rec & often, "overlap").when(rec, "scorer_only").when(often, "winners_only")
    return x.select("archetype", "name", v.alias("verdict"), F.coalesce("frequency", F.lit(0.0)).alias("frequency")).where("verdict is not null")


def divergences(tests: DataFrame, tags: DataFrame, counts: DataFrame) -> DataFrame:
    """(direction, tag, archetypes, solid, adoption, members): divergent cards by direction and tag (name, tag; untagged
    ones 'unclassified'). ``counts``: (archetype, n) finishers; solid counts labels that are not speculative."""
    x = tests.where("verdict <> 'overlap'").join(tags, "name", "left").join(counts.select("archetype", (tier(F.col("n")) != "speculative").alias("solid")), "archetype")
    return x.groupBy(F.col("verdict").alias("direction"), F.coalesce("tag", F.lit("unclassified")).alias("tag")).agg(
        F.count_distinct("archetype").alias("archetypes"), F.count_distinct(F.when(F.col("solid"), F.col("archetype"))).alias("solid"), F.sum("frequency").alias("adoption"), F.array_sort(F.collect_set(F.concat_ws(" @ ", "name", "archetype"))).alias("members")
    )


def merge_near(clusters: DataFrame, least: float = NEAR) -> DataFrame:
    """(direction, tag, tags, members): clusters of one direction whose members overlap by 0.8 become one, transitively.

    Only clusters that share a member are compared.
    """
    c = clusters.select("direction", "tag", "members").withColumn("id", F.xxhash64("direction", "tag"))
    e = c.select("direction", "id", F.size("members").alias("n"), F.explode("members").alias("m"))
    p = e.select("direction", "m", F.col("id").alias("a"), F.col("n").alias("na")).join(e.select("direction", "m", F.col("id").alias("b"), F.col("n").alias("nb")), ["direction", "m"]).where("a < b")
    p = p.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b")
    label = min_label_components(p.union(c.select(F.col("id").alias("a"), F.col("id").alias("b"))))
    g = c.join(label, "id").groupBy("direction", "label").agg(F.array_sort(F.collect_set("tag")).alias("t"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"))
    return g.select("direction", F.array_join("t", "+").alias("tag"), F.size("t").alias("tags"), "members")


def rank_divergences(clusters: DataFrame) -> DataFrame:
    """Clusters in order: most solid labels, then least adoption of what only the scorer has (most of what only winners
    have), most labels, direction, tag; with their place."""
    adoption = F.when(F.col("direction") == "scorer_only", F.round("adoption", 9)).otherwise(-F.round("adoption", 9))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("solid"), adoption, F.desc("archetypes"), "direction", "tag")  # one row for each direction and tag
    return clusters.withColumn("place", F.row_number().over(w))


def plan_cells(resolved: DataFrame, plans: DataFrame, ground: int = GROUND) -> DataFrame:
    """(subject, opponent, wins, losses, n, raw, shrunk, measured, same_plan, observed_n, mirror_n) of all pairs of plans.

    ``plans``: (archetype, plan). Matches of labels without a plan are left out; a plan against itself has no result
    (0.5), only the games observed between its labels and their mirrors.
    """
    p = lambda c, n: plans.select(F.col("archetype").alias(c), F.col("plan").alias(n))
    m = resolved.where("status in ('decisive', 'mirror')").join(p("a", "pa"), "a").join(p("b", "pb"), "b").withColumn("w", (F.col("s1") > F.col("s2")).cast("int"))
    m = m.groupBy("pa", "pb", "status").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    both = m.where("pa <> pb").select(F.col("pa").alias("subject"), F.col("pb").alias("opponent"), "w", "n").union(m.where("pa <> pb").select("pb", "pa", F.col("n") - F.col("w"), "n"))
    both = both.groupBy("subject", "opponent").agg(F.sum("w").alias("wins"), F.sum("n").alias("n"))
    own = m.where("pa = pb").groupBy(F.col("pa").alias("subject")).agg(F.sum(F.when(F.col("status") == "decisive", F.col("n")).otherwise(0)).alias("o"), F.sum(F.when(F.col("status") == "mirror", F.col("n")).otherwise(0)).alias("mi"))
    k = plans.select("plan").distinct()
    g = k.select(F.col("plan").alias("subject")).join(F.broadcast(k.select(F.col("plan").alias("opponent"))))  # plans are few
    g = g.join(both, ["subject", "opponent"], "left").join(own, "subject", "left")
    same = F.col("subject") == F.col("opponent")
    n, w = F.coalesce("n", F.lit(0)), F.coalesce("wins", F.lit(0))
    return g.select(
        "subject", "opponent", w.alias("wins"), (n - w).alias("losses"), n.alias("n"), F.when(same, 0.5).when(n > 0, w / n).alias("raw"), F.when(same, 0.5).when(n > 0, shrink(w, n)).alias("shrunk"),
        (~same & (n >= ground)).alias("measured"), same.alias("same_plan"), F.when(same, F.coalesce("o", F.lit(0))).otherwise(n).alias("observed_n"), F.when(same, F.coalesce("mi", F.lit(0))).otherwise(0).alias("mirror_n"),
    )


def label_against_plans(cells: DataFrame, plans: DataFrame) -> DataFrame:
    """(archetype, plan, wins, n) of every label with a plan against every plan, 0 where they never met. ``cells``: (a, b,
    wins, n); games inside a label's own plan count as any other."""
    t = cells.join(plans.select(F.col("archetype").alias("b"), "plan"), "b").groupBy(F.col("a").alias("archetype"), "plan").agg(F.sum("wins").alias("wins"), F.sum("n").alias("n"))
    grid = plans.select("archetype").distinct().join(F.broadcast(plans.select("plan").distinct()))  # plans are few
    return grid.join(t, ["archetype", "plan"], "left").select("archetype", "plan", F.coalesce("wins", F.lit(0)).alias("wins"), F.coalesce("n", F.lit(0)).alias("n"))


def unplanned(labels: DataFrame, plans: DataFrame) -> DataFrame:
    """(archetype): labels without a plan."""
    return labels.select("archetype").distinct().join(plans.select("archetype"), "archetype", "left_anti")


def composition_diff(one: DataFrame, two: DataFrame, *by: str) -> DataFrame:
    """(by, name, one, two, delta): mean copies of two groups side by side; a card that a group lacks is at 0."""
    k = [*by, "name"]
    j = one.select(*k, F.col("avg").alias("one")).join(two.select(*k, F.col("avg").alias("two")), k, "full")
    return j.select(*k, F.coalesce("one", F.lit(0.0)).alias("one"), F.coalesce("two", F.lit(0.0)).alias("two")).withColumn("delta", F.col("one") - F.col("two"))


def explain_horizon(decks: DataFrame, cards: DataFrame, reg: DataFrame, bans: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(archetype, date, card, ran, decks, share, affected): for every ban, how many of a label's decks of the regime before
    ran the card, and whether a quarter did."""
    from tidemark.operators.shares import in_regimes

    x = in_regimes(decks.where("archetype is not null"), reg)
    base = x.groupBy("archetype", "regime").agg(F.count(F.lit(1)).alias("decks"))
    b = F.broadcast(bans.select(F.col("date").alias("until"), F.col("card").alias("name")))  # bans are curated
    prior = base.join(F.broadcast(reg.select("regime", "until")), "regime").join(b, "until")
    held = x.join(cards.select(*_DECK, "name").distinct().join(b.select("name").distinct(), "name", "left_semi"), _DECK)
    ran = held.groupBy("archetype", "regime", "name").agg(F.count(F.lit(1)).alias("ran"))
    r = prior.join(ran, ["archetype", "regime", "name"], "left").withColumn("ran", F.coalesce("ran", F.lit(0)))
    return r.select("archetype", F.col("until").alias("date"), F.col("name").alias("card"), "ran", "decks", (F.col("ran") / F.col("decks")).alias("share"), (F.col("ran") >= threshold * F.col("decks")).alias("affected"))


def resolve_players(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``names`` (.., norm) with player: the id of an alias map (norm, player), of several the smallest; a name outside the
    map is its own."""
    a = aliases.where("player is not null and player <> ''").groupBy("norm").agg(F.min("player").alias("player"))
    return names.join(a, "norm", "left").withColumn("player", F.coalesce("player", "norm"))
