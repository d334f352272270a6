"""Camps inside an archetype: reduced features, density clusters, their names, stability and gates.

Clusters are fitted on at most ``FIT_DECKS`` decks of a parent (those with the smallest hash), which bounds what one task
holds; every deck of the parent is then assigned to the nearest camp by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.stats import tier
from tidemark.operators.cards import centroids, nearest, tfidf
from tidemark.session import durable, spread

_DECK = ["tournament_id", "deck_idx"]
#: Decks of a parent that the clusters are fitted on, resamples of the stability, and dimensions of the features.
FIT_DECKS, RESAMPLES, DIMENSIONS = 1_500, 50, 10
# Fixed values of the gates.
LEAST_CLUSTER, CLUSTER_SHARE, NEIGHBOURS, STABLE, DELTA, SIGNATURES, GAP_DAYS = 30, 0.10, 10, 0.90, 0.75, 2, 120


def reduce_dims(x: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Coordinates along the leading singular vectors; narrower matrices stay as they are."""
    if x.shape[1] <= dimensions:
        return x
    _, _, v = np.linalg.svd(x, full_matrices=False)
    return x @ v[: min(dimensions, len(v))].T


def density_clusters(x: np.ndarray, least: int, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Cluster of each point, -1 for noise: hierarchical density clustering.

    Distances are raised to the distance of either point's ``neighbours``-th nearest (itself included); the tree of their
    minimum spanning tree is condensed to clusters of at least ``least`` points, of which the most persistent, apart from
    the root, are taken (excess of mass).
    """
    n = len(x)
    if n < 2 * least:
        return np.full(n, -1)
    sq = (x * x).sum(1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0.0))
    core = np.partition(d, min(neighbours, n) - 1, axis=1)[:, min(neighbours, n) - 1]
    np.maximum(d, core[:, None], out=d)
    np.maximum(d, core[None, :], out=d)
    # minimum spanning tree from point 0
    near, frm, left = d[0].copy(), np.zeros(n, int), np.ones(n, bool)
    left[0] = False
    edges = np.empty((n - 1, 3))
    for k in range(n - 1):
        j = int(np.where(left, near, np.inf).argmin())
        edges[k] = frm[j], j, near[j]
        left[j] = False
        closer = left & (d[j] < near)
        near[closer], frm[closer] = d[j][closer], j
    edges = edges[np.argsort(edges[:, 2], kind="stable")]
    root, child, size, height = list(range(2 * n - 1)), {}, [1] * n + [0] * (n - 1), [0.0] * (2 * n - 1)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (a, b, w) in enumerate(edges):
        a, b, c = find(int(a)), find(int(b)), n + k
        child[c], size[c], height[c] = (a, b), size[a] + size[b], w
        root[a] = root[b] = c

    def leaves(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            y = todo.pop()
            if y < n:
                out.append(y)
            else:
                todo += child[y]
        return out

    birth, gain, parent, fell = [0.0], [0.0], [-1], np.zeros(n, int)
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            fell[node] = c
            continue
        lam = 1.0 / height[node] if height[node] > 0 else 1e12
        big = [k for k in child[node] if size[k] >= least]
        if len(big) == 2:
            gain[c] += (lam - birth[c]) * size[node]
            for k in child[node]:
                birth.append(lam)
                gain.append(0.0)
                parent.append(c)
                todo.append((k, len(birth) - 1))
            continue
        for k in child[node]:
            if k in big:
                todo.append((k, c))
            else:
                gain[c] += (lam - birth[c]) * size[k]
                fell[leaves(k)] = c
    take = [True] * len(birth)
    best = list(gain)
    for c in range(len(birth) - 1, -1, -1):
        below = [k for k in range(c + 1, len(birth)) if parent[k] == c]
        if below and (c == 0 or sum(best[k] for k in below) > gain[c]):
            take[c], best[c] = False, sum(best[k] for k in below)
    take[0] = False
    label, ids = [-1] * len(birth), 0
    for c in range(1, len(birth)):
        p = parent[c]
        if label[p] >= 0:
            label[c] = label[p]  # inside a taken cluster
        elif take[c]:
            label[c], ids = ids, ids + 1
    return np.array([label[c] for c in fell])


def _agreement(x: np.ndarray, base: np.ndarray, least: int, seed: int) -> float | None:
    """Share of pairs of points, in clusters both times, that a clustering of a resample puts together or apart as before.

    Counted from the cross table of both labellings.
    """
    n = len(base)
    idx = np.random.default_rng(seed).integers(0, n, n)
    got = density_clusters(x[idx], least, min(NEIGHBOURS, least))
    first = np.unique(idx, return_index=True)
    a, b = base[first[0]], got[first[1]]
    ok = (a >= 0) & (b >= 0)
    a, b = a[ok], b[ok]
    if len(a) < 2:
        return None
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda v: float((v * (v - 1) / 2).sum())
    total = len(a) * (len(a) - 1) / 2
    return (total - pairs(table.sum(1)) - pairs(table.sum(0)) + 2 * pairs(table)) / total


def fit_camps(vectors: DataFrame, parent: str = "archetype", fit: int = FIT_DECKS) -> DataFrame:
    """One row per parent: keys, cluster of each key (-1 noise), points (reduced, flattened), dims, least.

    ``vectors``: (parent, deck, name, weight). Parents with fewer than two flex cards or too few decks have only noise.
    """
    decks = vectors.select(parent, *_DECK).distinct()
    chosen = decks.withColumn("r", F.row_number().over(Window.partitionBy(parent).orderBy(F.xxhash64(*_DECK), *_DECK))).where(F.col("r") <= fit).drop("r")
    rows = vectors.join(chosen, [parent, *_DECK])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([*_DECK, "name"])
        key = p[_DECK].apply(tuple, axis=1)
        keys = list(dict.fromkeys(key))
        ki, names = {k: i for i, k in enumerate(keys)}, sorted(set(p["name"]))
        x = np.zeros((len(keys), len(names)))
        x[[ki[k] for k in key], np.searchsorted(names, p["name"])] = p["weight"]
        least = max(LEAST_CLUSTER, round(CLUSTER_SHARE * len(keys)))
        r = reduce_dims(x)
        label = density_clusters(r, least, min(NEIGHBOURS, least)) if len(names) > 1 else np.full(len(keys), -1)
        return pd.DataFrame({"parent": [p[parent].iloc[0]], "tournaments": [[k[0] for k in keys]], "decks": [[int(k[1]) for k in keys]], "cluster": [label.tolist()], "points": [r.ravel().tolist()], "dims": [r.shape[1]], "least": [least]})

    return spread(rows, parent).groupBy(parent).applyInPandas(run, "parent string, tournaments array<string>, decks array<int>, cluster array<int>, points array<double>, dims int, least int")


def stability(fits: DataFrame, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """(parent, stability): mean agreement over resamples, each a row of the job; 0 if none can be compared."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            out = [_agreement(np.asarray(q, float).reshape(-1, d), np.asarray(c), k, seed + int(b) + 1) for q, d, c, k, b in zip(p["points"], p["dims"], p["cluster"], p["least"], p["b"])]
            yield pd.DataFrame({"parent": p["parent"], "agree": out})

    some = fits.where(F.array_max("cluster") >= 0).select("parent", "points", "dims", "cluster", "least", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    return spread(some, "parent", "b").mapInPandas(run, "parent string, agree double").groupBy("parent").agg(F.coalesce(F.avg("agree"), F.lit(0.0)).alias("stability"))


def members(fits: DataFrame) -> DataFrame:
    """(parent, tournament_id, deck_idx, cluster) of the fitted decks."""
    z = F.explode(F.arrays_zip("tournaments", "decks", "cluster")).alias("z")
    return fits.select("parent", z).select("parent", F.col("z.tournaments").alias("tournament_id"), F.col("z.decks").alias("deck_idx"), F.col("z.cluster").alias("cluster"))


def signatures(member: DataFrame, cards: DataFrame) -> DataFrame:
    """(parent, cluster, name, delta): mean copies of a card in a cluster less those in all other clusters of the parent."""
    m = member.where("cluster >= 0")
    n = m.groupBy("parent", "cluster").agg(F.count(F.lit(1)).alias("n"))
    c = cards.join(m, _DECK).groupBy("parent", "cluster", "name").agg(F.sum("copies").alias("c"))
    total = c.groupBy("parent", "name").agg(F.sum("c").alias("tc"))
    whole = n.groupBy("parent").agg(F.sum("n").alias("tn"))
    g = n.join(total, "parent").join(c, ["parent", "cluster", "name"], "left").join(whole, "parent").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = (F.col("tc") - F.col("c")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0))
    return g.select("parent", "cluster", "name", F.round(F.col("c") / F.col("n") - F.coalesce(rest, F.lit(0.0)), 9).alias("delta"))


def camp_names(signature: DataFrame) -> DataFrame:
    """(parent, cluster, camp): named by the card that sets it apart most (ties by name); of two camps the other is
    'non-<card>'; where several share a name, later ones add their number."""
    top = signature.groupBy("parent", "cluster").agg(
        F.min(F.struct((-F.abs("delta")).alias("o"), "name", "delta")).alias("any"), F.min(F.when(F.col("delta") > 0, F.struct((-F.col("delta")).alias("o"), "name"))).alias("up")
    )
    k = top.groupBy("parent").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("cluster", "any")).alias("first"))
    t = top.join(k, "parent")
    lead, up = F.col("first.any.name"), F.col("first.any.delta") > 0
    mine = up == (F.col("cluster") == F.col("first.cluster"))
    two = F.when(mine, lead).otherwise(F.concat(F.lit("non-"), lead))
    name = F.when(F.col("k") == 1, "single-cluster").when(F.col("k") == 2, two).otherwise(F.coalesce("up.name", F.concat(F.lit("camp-"), F.col("cluster").cast("string"))))
    t = t.select("parent", "cluster", name.alias("camp"))
    again = F.row_number().over(Window.partitionBy("parent", "camp").orderBy("cluster"))
    return t.withColumn("again", again).select("parent", "cluster", F.when(F.col("again") > 1, F.concat("camp", F.lit(" ("), F.col("cluster").cast("string"), F.lit(")"))).otherwise(F.col("camp")).alias("camp"))


def camp_profiles(member: DataFrame, decks: DataFrame, since: str | None = None) -> DataFrame:
    """(parent, cluster, n, tier, median_date, current): size, median date of the members and share from ``since`` on."""
    d = member.where("cluster >= 0").join(decks.select(*_DECK, "date"), _DECK)
    day = F.unix_date("date")
    g = d.groupBy("parent", "cluster").agg(F.count(F.lit(1)).alias("n"), F.percentile(day, F.lit(0.5)).alias("m"), F.avg(F.coalesce(F.col("date") >= F.lit(since).cast("date"), F.lit(False)).cast("int")).alias("c"))
    return g.select("parent", "cluster", "n", tier(F.col("n")).alias("tier"), F.date_from_unix_date(F.floor("m").cast("int")).alias("median_date"), (F.col("c") if since else F.lit(None).cast("double")).alias("current"))


def gates(fits: DataFrame, stable: DataFrame, profiles: DataFrame, signature: DataFrame) -> DataFrame:
    """(parent, camps, noise, stability, gate_a, gate_b, gap_days, mixed, passed).

    A: stability of at least 0.9. B: two camps or more, each of 30 decks and with two cards that differ by 0.75 copies.
    Camps whose median dates lie 120 days apart are flagged as mixed in time, which fails nothing.
    """
    base = fits.select("parent", F.size(F.filter("cluster", lambda c: c < 0)).alias("noise"), F.size(F.array_distinct(F.filter("cluster", lambda c: c >= 0))).alias("camps"))
    sig = signature.where(F.abs("delta") >= DELTA).groupBy("parent", "cluster").agg(F.count(F.lit(1)).alias("sig"))
    per = profiles.join(sig, ["parent", "cluster"], "left").groupBy("parent").agg(
        F.min((F.col("tier") != "speculative") & (F.coalesce("sig", F.lit(0)) >= SIGNATURES)).alias("b"), F.date_diff(F.max("median_date"), F.min("median_date")).alias("gap_days")
    )
    g = base.join(stable, "parent", "left").join(per, "parent", "left")
    several = F.col("camps") >= 2
    a = F.coalesce(F.col("stability") >= STABLE, F.lit(False))
    b = several & F.coalesce("b", F.lit(False))
    gap = F.when(several, F.col("gap_days"))
    return g.select("parent", "camps", "noise", F.coalesce("stability", F.lit(0.0)).alias("stability"), a.alias("gate_a"), b.alias("gate_b"), gap.alias("gap_days"), F.coalesce(gap >= GAP_DAYS, F.lit(False)).alias("mixed"), (several & a & b).alias("passed"))


def discover(pool: DataFrame, cards: DataFrame, resamples: int = RESAMPLES, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Splits (as ``gates``) and assignments (parent, tournament_id, deck_idx, camp, similarity) of all decks of ``pool``
    (archetype, tournament_id, deck_idx, date); camp is null where no camp is near enough."""
    v = durable(tfidf(pool, cards, parent="archetype"))
    fits = durable(fit_camps(v))
    m = durable(members(fits))
    sig = durable(signatures(m, cards))
    split = gates(fits, stability(fits, resamples), camp_profiles(m, pool, since), sig)
    named = m.where("cluster >= 0").join(camp_names(sig), ["parent", "cluster"]).select(F.col("parent").alias("archetype"), *_DECK, "camp")
    centre = durable(centroids(v, named, "camp", "archetype"))
    near = nearest(v, centre, "camp", parent="archetype")
    return split, near.withColumnRenamed("archetype", "parent")
