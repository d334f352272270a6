"""Match outcomes: who met whom, directed tallies, coverage, win rates of cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score(result: Column) -> tuple[Column, Column]:
    """Games of both sides of a score like 2-1; null where a token is missing or no number. Third tokens are ignored."""
    t = F.split(result, "-")
    return F.get(t, F.lit(0)).try_cast("int"), F.get(t, F.lit(1)).try_cast("int")


def unique_names(decks: DataFrame) -> DataFrame:
    """Per event and name: the deck, and how often the name occurs; only names that occur once can be attributed."""
    return decks.where("norm is not null").groupBy("tournament_id", "norm").agg(
        F.count(F.lit(1)).alias("n"), F.min("archetype").alias("archetype"), F.min("variant").alias("variant"), F.min("date").alias("date"), F.min("provenance").alias("provenance"), F.min("deck_idx").alias("deck_idx")
    )


def resolve(rounds: DataFrame, decks: DataFrame) -> DataFrame:
    """Every pairing with both sides' labels and a status, decided in this order: bye, ambiguous, unmatched,
    no_winner (draw or unreadable), mirror, decisive."""
    u = unique_names(decks)
    side = lambda p, x: u.select("tournament_id", F.col("norm").alias(p), F.col("n").alias(f"n{x}"), F.col("archetype").alias(x), F.col("variant").alias(f"v{x}"), F.col("date").alias(f"d{x}"), F.col("deck_idx").alias(f"i{x}"))
    m = rounds.join(side("p1", "a"), ["tournament_id", "p1"], "left").join(side("p2", "b"), ["tournament_id", "p2"], "left")
    s1, s2 = score(F.col("result"))
    m = m.withColumn("s1", s1).withColumn("s2", s2).withColumn("date", F.coalesce("da", "db"))
    status = (
        F.when((F.col("p1") == "") | (F.col("p2") == ""), "bye")
        .when((F.col("na") > 1) | (F.col("nb") > 1), "ambiguous")
        .when(F.col("a").isNull() | F.col("b").isNull(), "unmatched")
        .when(F.col("s1").isNull() | F.col("s2").isNull() | (F.col("s1") == F.col("s2")), "no_winner")
        .when(F.col("a") == F.col("b"), "mirror")
        .otherwise("decisive")
    )
    return m.withColumn("status", status)


def directed(resolved: DataFrame) -> DataFrame:
    """Both directions of decisive matches: a, b, their variants and decks, date, win."""
    one = F.struct("a", "b", "va", "vb", "ia", "ib", (F.col("s1") > F.col("s2")).cast("int").alias("win"))
    two = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("vb").alias("va"), F.col("va").alias("vb"), F.col("ib").alias("ia"), F.col("ia").alias("ib"), (F.col("s2") > F.col("s1")).cast("int").alias("win"))
    return resolved.where("status = 'decisive'").select("tournament_id", "date", F.explode(F.array(one, two)).alias("x")).select("tournament_id", "date", "x.*")


def tallies(resolved: DataFrame) -> DataFrame:
    """(a, b, wins, n) of decisive matches; mirrors are no cell."""
    return directed(resolved).groupBy("a", "b").agg(F.sum("win").alias("wins"), F.count(F.lit(1)).alias("n"))


def marginals(resolved: DataFrame) -> DataFrame:
    """(a, wins, n) over all opponents; each mirror adds one win and one loss."""
    d = directed(resolved).select("a", F.col("win").cast("long").alias("w"), F.lit(1).cast("long").alias("k"))
    mirror = resolved.where("status = 'mirror'").select("a", F.lit(1).cast("long").alias("w"), F.lit(2).cast("long").alias("k"))
    return d.union(mirror).groupBy("a").agg(F.sum("w").alias("wins"), F.sum("k").alias("n"))


def card_winrates(resolved: DataFrame, cards: DataFrame) -> DataFrame:
    """(name, board, b, wins, n): each decisive match credits every distinct card of a deck once against the other's
    label; b null is the total over all opponents. One pass: cells first, then their roll-up."""
    held = cards.select("tournament_id", F.col("deck_idx").alias("ia"), "board", "name").distinct()
    cells = directed(resolved).join(held, ["tournament_id", "ia"]).groupBy("name", "board", "b").agg(F.sum("win").alias("w"), F.count(F.lit(1)).alias("k"))
    total = cells.groupBy("name", "board").agg(F.sum("w").alias("wins"), F.sum("k").alias("n")).select("name", "board", F.lit(None).cast("string").alias("b"), "wins", "n")
    return cells.select("name", "board", "b", F.col("w").alias("wins"), F.col("k").alias("n")).unionByName(total)


def slot_contrast(resolved: DataFrame, cards: DataFrame, board: str = "main") -> DataFrame:
    """(a, b, name, wins_with, n_with, wins_without, n_without): record of a against b with and without a card.

    Without is the whole cell less the part with the card, so no deck is paired with the cards it lacks.
    """
    held = cards.where(F.col("board") == board).select("tournament_id", F.col("deck_idx").alias("ia"), "name").distinct()
    d = directed(resolved)
    cell = d.groupBy("a", "b").agg(F.sum("win").alias("w"), F.count(F.lit(1)).alias("k"))
    has = d.join(held, ["tournament_id", "ia"]).groupBy("a", "b", "name").agg(F.sum("win").alias("wins_with"), F.count(F.lit(1)).alias("n_with"))
    return has.join(cell, ["a", "b"]).select("a", "b", "name", "wins_with", "n_with", (F.col("w") - F.col("wins_with")).alias("wins_without"), (F.col("k") - F.col("n_with")).alias("n_without"))
