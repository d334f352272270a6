"""Families of labels: average linkage over their cores with multiscale bootstrap, cut, remainder, registry.

There are at most a few hundred labels with a core, so their matrix is small. What is large, the replicates of the
bootstrap, are rows that Spark spreads over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the cut and of the bootstrap.
SCALES = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4)
REPLICATES, AU_LEAST, BP_LEAST, ASSIGNEE_CORE = 200, 0.95, 0.30, 5


def weighted_dissimilarity(m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """1 less weighted Jaccard similarity of the rows of a 0/1 matrix; two rows without weight are at 1."""
    both = (m * weights) @ m.T
    own = np.diag(both)
    union = own[:, None] + own[None, :] - both
    d = np.ones_like(union)
    np.divide(union - both, union, out=d, where=union > 0)
    np.fill_diagonal(d, 0.0)
    return np.clip(d, 0.0, 1.0)


def average_linkage(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (node, node, height) by mean distance; leaves are 0..n-1, the k-th merge is node n + k. Of equal
    distances the pair that comes first is merged."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    node, size, out = list(range(n)), np.ones(n), []
    for k in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        out.append((node[i], node[j], float(d[i, j])))
        mean = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = mean, mean
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        node[i] = n + k
    return out


def leaf_sets(merges: list[tuple[int, int, float]], n: int) -> dict[int, frozenset[int]]:
    """Leaves under each merge."""
    sets = {i: frozenset([i]) for i in range(n)}
    for k, (a, b, _) in enumerate(merges):
        sets[n + k] = sets[a] | sets[b]
    return {i: s for i, s in sets.items() if i >= n}


def fit_au(bp: Sequence[float], scales: Sequence[float], replicates: int) -> float:
    """Approximately unbiased p of a branch: weighted fit of its normal quantiles on the scales; with fewer than three
    scales that are neither 0 nor 1, the mean."""
    nd, x, y, w = NormalDist(), [], [], []
    for r, p in zip(scales, bp):
        if 1e-9 < p < 1 - 1e-9:
            z = -nd.inv_cdf(p)
            x.append([1 / math.sqrt(r), math.sqrt(r)])
            y.append(z)
            w.append(math.sqrt(replicates * nd.pdf(z) ** 2 / (p * (1 - p))))
    if len(x) < 3:
        return float(np.mean(bp))
    w = np.array(w)
    c, d = np.linalg.lstsq(np.array(x) * w[:, None], np.array(y) * w, rcond=None)[0]
    return 1 - nd.cdf(d - c)


def _drawn(cards: int, size: int, *seed: int) -> np.ndarray:
    return np.bincount(np.random.default_rng(list(seed)).integers(0, cards, size), minlength=cards).astype(float)


def branch_support(spark: SparkSession, m: np.ndarray, replicates: int = REPLICATES, seed: int = 0, scales: Sequence[float] = SCALES) -> DataFrame:
    """(node, members, height, bp, au) of each branch of the tree over the rows of ``m``: how often resampled columns
    give the same branch, by scale, and at scale 1. One row of the job is one replicate."""
    n, cards = m.shape
    merges = average_linkage(weighted_dissimilarity(m, np.ones(cards)))
    base = leaf_sets(merges, n)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            rows = []
            for i in p["id"]:
                s, b = divmod(int(i), replicates)
                weights = _drawn(cards, max(1, round(scales[s] * cards)), seed, s, b)
                found = set(leaf_sets(average_linkage(weighted_dissimilarity(m, weights)), n).values())
                rows += [(node, s) for node, leaves in base.items() if leaves in found]
            yield pd.DataFrame(rows, columns=["node", "scale"])

    hits = spark.range(len(scales) * replicates).repartition(max(8, len(scales) * 4)).mapInPandas(run, "node int, scale int").groupBy("node", "scale").agg(F.count(F.lit(1)).alias("k"))
    bp = {x: [0.0] * len(scales) for x in base}
    for r in hits.collect():  # one row for each branch and scale
        bp[r["node"]][r["scale"]] = r["k"] / replicates
    one = scales.index(1.0) if 1.0 in scales else len(scales) // 2
    height = {n + k: h for k, (_, _, h) in enumerate(merges)}
    rows = [(x, sorted(base[x]), height[x], bp[x][one], float(fit_au(bp[x], scales, replicates))) for x in sorted(base)]
    return spark.createDataFrame(rows, "node int, members array<int>, height double, bp double, au double")


def supported(merges: list[tuple[int, int, float]], n: int, support: dict[int, tuple[float, float]], au: float = AU_LEAST, bp: float = BP_LEAST) -> tuple[list[int], list[int]]:
    """Branches to keep and single leaves: from the root's children down, the first branch of each path whose (au, bp)
    suffice. The root itself is never one."""
    if n < 2:
        return [], list(range(n))
    child = {n + k: (a, b) for k, (a, b, _) in enumerate(merges)}
    todo, keep, single = list(child[n + len(merges) - 1]), [], []
    while todo:
        x = todo.pop()
        if x < n:
            single.append(x)
        elif support[x][0] > au and support[x][1] >= bp:
            keep.append(x)
        else:
            todo += child[x]
    return sorted(keep), sorted(single)


def cut_tree(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Partition into k groups by undoing the last merges."""
    label = np.arange(n)
    sets = {i: [i] for i in range(n)}
    for j, (a, b, _) in enumerate(merges):
        sets[n + j] = sets[a] + sets[b]
        if j < n - k:
            label[sets[n + j]] = min(sets[n + j])
    return label


def partition_stability(spark: SparkSession, m: np.ndarray, partition: np.ndarray, replicates: int = 50, seed: int = 0) -> float:
    """Mean share of pairs of rows on which a tree over resampled columns, cut into as many groups, agrees."""
    n, cards = m.shape
    k = len(set(partition.tolist()))
    if n < 2 or k < 2 or replicates <= 0:
        return 1.0
    same, upper = partition[:, None] == partition[None, :], np.triu_indices(n, 1)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            out = []
            for i in p["id"]:
                g = cut_tree(average_linkage(weighted_dissimilarity(m, _drawn(cards, cards, seed, 9_999, int(i)))), n, k)
                out.append(float(((g[:, None] == g[None, :]) == same)[upper].mean()))
            yield pd.DataFrame({"agree": out})

    return spark.range(replicates).repartition(8).mapInPandas(run, "agree double").agg(F.avg("agree")).first()[0]


def core_matrix(cores: DataFrame) -> tuple[list[str], np.ndarray]:
    """Labels in order and their 0/1 matrix over the names of ``cores`` (archetype, name)."""
    rows = [(r["archetype"], r["name"]) for r in cores.select("archetype", "name").distinct().collect()]  # a few hundred labels
    labels, names = sorted({a for a, _ in rows}), sorted({b for _, b in rows})
    i, j = {x: k for k, x in enumerate(labels)}, {x: k for k, x in enumerate(names)}
    m = np.zeros((len(labels), len(names)))
    for a, b in rows:
        m[i[a], j[b]] = 1.0
    return labels, m


def families(cores: DataFrame, replicates: int = REPLICATES, seed: int = 0, au: float = AU_LEAST, bp: float = BP_LEAST) -> DataFrame:
    """(cluster, member, au, bp, height) of the defining labels; cores: (archetype, name) of their stripped cores.

    The cluster is named by its first member. Labels in no supported branch are alone, with null au.
    """
    spark = cores.sparkSession
    labels, m = core_matrix(cores)
    schema = "cluster string, member string, au double, bp double, height double"
    if len(labels) < 2:
        return spark.createDataFrame([(x, x, None, None, None) for x in labels], schema)
    info = {r["node"]: r for r in branch_support(spark, m, replicates, seed).collect()}
    merges = average_linkage(weighted_dissimilarity(m, np.ones(m.shape[1])))
    keep, single = supported(merges, len(labels), {x: (r["au"], r["bp"]) for x, r in info.items()}, au, bp)
    rows = [(labels[min(info[x]["members"])], labels[i], info[x]["au"], info[x]["bp"], info[x]["height"]) for x in keep for i in info[x]["members"]]
    return spark.createDataFrame(rows + [(labels[i], labels[i], None, None, None) for i in single], schema)


def assign_remainder(compositions: DataFrame, clusters: DataFrame, least_core: int = ASSIGNEE_CORE) -> DataFrame:
    """(archetype, cluster, distance, reason) of the labels that define nothing: the cluster to whose definers the mean
    Jaccard dissimilarity is smallest (ties: smaller cluster).

    ``compositions``: (archetype, core_n, stripped, definer), stripped an array of distinct names; ``clusters``: (cluster,
    member). No cluster, with a reason, for small cores, cores of staples only, and those that share nothing with any.
    """
    d = clusters.join(compositions.where("definer").select(F.col("archetype").alias("member"), F.col("stripped").alias("other")), "member")
    size = d.groupBy("cluster").agg(F.count(F.lit(1)).alias("definers"))
    rest = compositions.where("not definer").select("archetype", "core_n", "stripped")
    can = rest.where((F.col("core_n") >= least_core) & (F.size("stripped") > 0))
    # Only pairs that share a name are formed; all others are at 1.
    a = can.select("archetype", F.explode("stripped").alias("name"))
    b = d.select("cluster", "member", F.explode("other").alias("name"))
    both = a.join(b, "name").groupBy("archetype", "cluster", "member").agg(F.count(F.lit(1)).alias("k"))
    both = both.join(can.select("archetype", F.size("stripped").alias("na")), "archetype").join(d.select("member", F.size("other").alias("nb")).distinct(), "member")
    near = both.groupBy("archetype", "cluster").agg(F.sum(F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("s")).join(size, "cluster")
    best = near.groupBy("archetype").agg(F.min(F.struct(F.round(1 - F.col("s") / F.col("definers"), 12).alias("distance"), "cluster")).alias("b"))
    r = rest.join(best, "archetype", "left")
    reason = F.when(F.col("core_n") < least_core, "small core").when(F.size("stripped") == 0, "staples only").when(F.col("b").isNull(), "shares nothing")
    return r.select("archetype", "b.cluster", "b.distance", reason.alias("reason"))


def merge_curated(derived: DataFrame, curated: DataFrame) -> DataFrame:
    """(cluster, member, provenance, derived_cluster): a curated (cluster, member) wins over the derived one; derived
    clusters lose these members and vanish if none is left."""
    c = curated.select("cluster", "member").distinct().join(derived.select("member", F.col("cluster").alias("derived_cluster")), "member", "left")
    kept = derived.select("cluster", "member").join(curated.select("member"), "member", "left_anti")
    return c.select("cluster", "member", F.lit("curated").alias("provenance"), "derived_cluster").unionByName(kept.select("cluster", "member", F.lit("derived").alias("provenance"), F.col("cluster").alias("derived_cluster")))


def match_identities(new: DataFrame, previous: DataFrame) -> DataFrame:
    """(cluster, identity, status): clusters keep the id of the previous one they share most members with, taken
    greedily by overlap (ties: smaller new, then smaller previous name); others are 'new', ids without a successor 'retired'."""
    spark = new.sparkSession
    o = new.select("cluster", "member").join(previous.select(F.col("cluster").alias("old"), "member"), "member").groupBy("cluster", "old").agg(F.count(F.lit(1)).alias("n"))
    overlap = sorted(((-r["n"], r["cluster"], r["old"]) for r in o.collect()))  # pairs of clusters of labels
    took, used = {}, set()
    for _, c, p in overlap:
        if c not in took and p not in used:
            took[c] = p
            used.add(p)
    names = [r[0] for r in new.select("cluster").distinct().orderBy("cluster").collect()]
    old = [r[0] for r in previous.select("cluster").distinct().orderBy("cluster").collect()]
    rows, n = [], 1
    for c in names:
        if c in took:
            rows.append((c, took[c], "kept"))
            continue
        while f"F{n}" in old:
            n += 1
        rows.append((c, f"F{n}", "new"))
        n += 1
    return spark.createDataFrame(rows + [(None, p, "retired") for p in old if p not in used], "cluster string, identity string, status string")


def membership_churn(new: DataFrame, previous: DataFrame) -> DataFrame:
    """One row: members in both, pairs of them on which both partitions agree, moves, arrivals, departures.

    Agreeing pairs come from the counts of the cross table, so no pairs are formed.
    """
    j = new.select("member", F.col("cluster").alias("x")).join(previous.select("member", F.col("cluster").alias("y")), "member", "full")
    both = j.where("x is not null and y is not null")
    pairs = lambda *k: both.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("s_" + "".join(k)))
    side = j.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("comparable"), F.count_if(F.col("y").isNull()).alias("arrivals"), F.count_if(F.col("x").isNull()).alias("departures"), F.count_if(F.col("x") != F.col("y")).alias("moves"))
    g = side.join(F.broadcast(pairs("x"))).join(F.broadcast(pairs("y"))).join(F.broadcast(pairs("x", "y")))  # one row each
    total = F.col("comparable") * (F.col("comparable") - 1) / 2
    agree = F.when(total > 0, (total - F.col("s_x") - F.col("s_y") + 2 * F.col("s_xy")) / total)
    return g.select("comparable", agree.alias("agreement"), "moves", "arrivals", "departures")
