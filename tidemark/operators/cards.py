"""Statistics of cards in pools of decks: inclusion, copies, consensus, contrasts of groups, adjacency, features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_DECK = ["tournament_id", "deck_idx"]


def frequencies(pool: DataFrame, cards: DataFrame, *by: str) -> DataFrame:
    """(by, name, decks, pool, inclusion, modal): share of the pool's decks with the card, most common number of
    copies (ties: more copies). The denominator is all decks of the pool, with or without card rows."""
    size = pool.groupBy(*by).agg(F.count_distinct(*_DECK).alias("pool")) if by else pool.agg(F.count_distinct(*_DECK).alias("pool"))
    c = cards.join(pool.select(*_DECK, *by), _DECK).groupBy(*by, "name", "copies").agg(F.count(F.lit(1)).alias("k"))
    c = c.groupBy(*by, "name").agg(F.sum("k").alias("decks"), F.max_by("copies", F.struct("k", "copies")).alias("modal"))
    c = c.join(size, list(by)) if by else c.join(F.broadcast(size))
    return c.withColumn("inclusion", F.col("decks") / F.col("pool"))


def copy_histogram(pool: DataFrame, cards: DataFrame, *by: str) -> DataFrame:
    """(by, name, copies, decks) with a row for 0 copies, the decks without the card."""
    f = frequencies(pool, cards, *by)
    some = cards.join(pool.select(*_DECK, *by), _DECK).groupBy(*by, "name", "copies").agg(F.count(F.lit(1)).alias("decks"))
    none = f.where("decks < pool").select(*by, "name", F.lit(0).alias("copies"), (F.col("pool") - F.col("decks")).alias("decks"))
    return some.unionByName(none)


def consensus(freq: DataFrame, target: int, *by: str) -> DataFrame:
    """Copies of each card when a board of ``target`` cards is filled in order of inclusion (ties by name)."""
    w = Window.partitionBy(*by).orderBy(F.round("inclusion", 9).desc(), "name")
    before = F.coalesce(F.sum("modal").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return freq.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("modal"), F.lit(target) - before)).cast("int")).where("copies > 0")


def decks_vs_field(decks: DataFrame, cards: DataFrame, freq: DataFrame, hist: DataFrame, key: str, by: str) -> DataFrame:
    """(key, name, own, modal, delta, share, outlier): each list of ``decks`` (key, by, deck) against its pool: difference to
    the mode, share of the pool with as many copies, outlier if under 0.2 and not the mode. Cards of the pool that a list
    lacks count 0 copies."""
    mine = cards.join(decks, _DECK).select(key, by, "name", F.col("copies").alias("own"))
    pool = decks.select(key, by).join(freq.select(by, "name", "modal"), by)
    size = freq.groupBy(by).agg(F.max("pool").alias("pool"))
    j = pool.join(mine, [key, by, "name"], "full").select(key, by, "name", F.coalesce("modal", F.lit(0)).alias("modal"), F.coalesce("own", F.lit(0)).alias("own"))
    j = j.join(hist.select(by, "name", F.col("copies").alias("own"), F.col("decks").alias("k")), [by, "name", "own"], "left").join(size, by)
    j = j.withColumn("share", F.coalesce(F.col("k") / F.col("pool"), F.lit(0.0)))
    return j.select(key, "name", "own", "modal", (F.col("own") - F.col("modal")).alias("delta"), "share", ((F.col("share") < 0.2) & (F.col("own") != F.col("modal"))).alias("outlier"))


def subgroups(pool: DataFrame, cards: DataFrame, signatures: DataFrame, by: str, board: str = "main") -> DataFrame:
    """(by, signature, name, with_avg, without_avg, delta): mean copies of each card in the decks of a pool (by, deck) with and
    without its signature card (by, signature); the decks of the group are the denominator."""
    c = cards.where(F.col("board") == board).select(*_DECK, "name", "copies")
    p = pool.select(by, *_DECK).distinct().join(signatures, by)
    has = c.select(*_DECK, F.col("name").alias("signature"), F.lit(1).alias("has")).distinct()
    p = p.join(has, [*_DECK, "signature"], "left").withColumn("has", F.coalesce("has", F.lit(0)))
    n = p.groupBy(by, "signature").agg(F.sum("has").alias("n1"), F.sum(1 - F.col("has")).alias("n0"))
    g = c.join(p, _DECK).groupBy(by, "name").agg(F.sum(F.when(F.col("has") == 1, F.col("copies"))).alias("c1"), F.sum(F.when(F.col("has") == 0, F.col("copies"))).alias("c0")).join(n, by)
    avg = lambda x, y: F.coalesce(F.col(x) / F.nullif(F.col(y), F.lit(0)), F.lit(0.0))
    return g.select(by, "signature", "name", avg("c1", "n1").alias("with_avg"), avg("c0", "n0").alias("without_avg")).withColumn("delta", F.col("with_avg") - F.col("without_avg"))


def middle_cards(freq: DataFrame, by: str) -> DataFrame:
    """(by, signature): of each pool the card whose inclusion is nearest to a half (ties by name)."""
    g = freq.groupBy(by).agg(F.min(F.struct(F.round(F.abs(F.col("inclusion") - 0.5), 9).alias("d"), "name")).alias("m"))
    return g.select(by, F.col("m.name").alias("signature"))


def adjacency_all(decks: DataFrame, cards: DataFrame, cores: DataFrame, least: int = 5) -> DataFrame:
    """(archetype, name, n_x, n_xs, pmi): adjacency to each archetype's core (archetype, name), k = max(3, ceil(0.6 core))."""
    held = cards.select(*_DECK, "name").distinct()
    n = decks.select(*_DECK).distinct().agg(F.count(F.lit(1)).alias("n"))
    k = cores.groupBy("archetype").agg(F.greatest(F.lit(3), F.ceil(F.count(F.lit(1)) * 6 / 10)).alias("k"))
    shell = held.join(cores, "name").groupBy("archetype", *_DECK).agg(F.count(F.lit(1)).alias("h")).join(k, "archetype").where(F.col("h") >= F.col("k")).select("archetype", *_DECK)
    ns = shell.groupBy("archetype").agg(F.count(F.lit(1)).alias("ns"))
    nx = held.groupBy("name").agg(F.count(F.lit(1)).alias("n_x"))
    x = shell.join(held, _DECK).groupBy("archetype", "name").agg(F.count(F.lit(1)).alias("n_xs")).where(F.col("n_xs") >= least)
    x = x.join(cores, ["archetype", "name"], "left_anti").join(nx, "name").join(ns, "archetype").join(F.broadcast(n))
    return x.select("archetype", "name", "n_x", "n_xs", F.log(F.col("n_xs").cast("double") * F.col("n") / (F.col("n_x").cast("double") * F.col("ns"))).alias("pmi"))


def tfidf(pool: DataFrame, cards: DataFrame, lo: float = 0.10, hi: float = 0.95, parent: str | None = None) -> DataFrame:
    """(deck, name, weight): copies times smoothed idf over the flex cards (inclusion in [lo, hi]), unit length; with
    ``parent`` as first column and all counts within it, if given."""
    by = [parent] if parent else []
    member = pool.select(*by, *_DECK).distinct()
    n = member.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    c = cards.join(member, _DECK)
    df = c.groupBy(*by, "name").agg(F.count_distinct(*_DECK).alias("df"))
    df = (df.join(n, by) if by else df.join(F.broadcast(n))).where((F.col("df") >= lo * F.col("n")) & (F.col("df") <= hi * F.col("n")))
    w = c.join(df, [*by, "name"]).select(*by, *_DECK, "name", (F.col("copies") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy(*by, *_DECK).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return w.join(norm, [*by, *_DECK]).select(*by, *_DECK, "name", (F.col("w") / F.col("l")).alias("weight"))


def centroids(vectors: DataFrame, member: DataFrame, label: str, parent: str | None = None) -> DataFrame:
    """(label, name, weight): mean of the members' unit vectors, scaled to unit length, within each parent if given."""
    by = [parent] if parent else []
    v = vectors.join(member, [*by, *_DECK])
    n = member.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    c = v.groupBy(*by, label, "name").agg(F.sum("weight").alias("s")).join(n, [*by, label]).select(*by, label, "name", (F.col("s") / F.col("n")).alias("w"))
    norm = c.groupBy(*by, label).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return c.join(norm, [*by, label]).select(*by, label, "name", (F.col("w") / F.col("l")).alias("weight"))


def nearest(vectors: DataFrame, centre: DataFrame, label: str, least: float = 0.35, parent: str | None = None) -> DataFrame:
    """(deck, label, similarity): the centroid, of the deck's parent if given, with the highest cosine (ties by label),
    null under ``least``."""
    by = [parent] if parent else []
    dot = vectors.join(centre.withColumnRenamed("weight", "cw"), [*by, "name"]).groupBy(*by, *_DECK, label).agg(F.round(F.sum(F.col("weight") * F.col("cw")), 9).alias("s"))
    best = dot.groupBy(*by, *_DECK).agg(F.min(F.struct((-F.col("s")).alias("o"), F.col(label).alias("label"))).alias("b"))
    return best.select(*by, *_DECK, F.when(-F.col("b.o") >= least, F.col("b.label")).alias(label), (-F.col("b.o")).alias("similarity"))


def core_sets(decks: DataFrame, cards: DataFrame, inclusion: float = 0.5, definer_decks: int = 30, definer_core: int = 8, staple: float = 0.3) -> DataFrame:
    """(archetype, name, staple, definer): cards in at least half of an archetype's decks; archetypes with enough decks
    and core cards define, and cards core to 30% of the definers are staples."""
    d = decks.where("archetype is not null").select(*_DECK, "archetype")
    n = d.groupBy("archetype").agg(F.count(F.lit(1)).alias("n"))
    c = cards.select(*_DECK, "name").distinct().join(d, _DECK).groupBy("archetype", "name").agg(F.count(F.lit(1)).alias("k")).join(n, "archetype").where(F.col("k") >= inclusion * F.col("n"))
    size = c.groupBy("archetype").agg(F.count(F.lit(1)).alias("core"), F.max("n").alias("decks"))
    c = c.join(size.select("archetype", ((F.col("decks") >= definer_decks) & (F.col("core") >= definer_core)).alias("definer")), "archetype")
    m = c.where("definer").agg(F.count_distinct("archetype").alias("m"))
    s = c.where("definer").groupBy("name").agg(F.count(F.lit(1)).alias("s")).join(F.broadcast(m)).where(F.col("s") >= staple * F.col("m")).select("name", F.lit(True).alias("st"))
    return c.join(s, "name", "left").select("archetype", "name", F.coalesce("st", F.lit(False)).alias("staple"), "definer")


def core_jaccard(cores: DataFrame) -> DataFrame:
    """(x, y, jaccard), x < y: archetypes whose stripped cores share a card; pairs that share none are at 0."""
    c = cores.where("not staple").select("archetype", "name")
    n = c.groupBy("archetype").agg(F.count(F.lit(1)).alias("n"))
    k = c.select(F.col("archetype").alias("x"), "name").join(c.select(F.col("archetype").alias("y"), "name"), "name").where("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"))
    k = k.join(n.select(F.col("archetype").alias("x"), F.col("n").alias("nx")), "x").join(n.select(F.col("archetype").alias("y"), F.col("n").alias("ny")), "y")
    return k.select("x", "y", (F.col("k") / (F.col("nx") + F.col("ny") - F.col("k"))).alias("jaccard"))
