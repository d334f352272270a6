"""Positioning in a field, gaps, coverage models and their solvers, values of cards against a field, costs."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import shrink
from tidemark.session import spread

#: Concentration of share draws, prior of cell draws, strength of a cell without data; fixed values.
GAMMA, PRIOR, NO_DATA = 0.5, 0.5, 2.0


def position(cells: DataFrame, field: DataFrame) -> DataFrame:
    """(a, score, variance, coverage): share-weighted shrunk rate of each subject over the field (mirror 0.5, no cell:
    the mean of its known cells), its delta-method variance and the shown share of the non-mirror field."""
    s = cells.select("a").distinct().join(F.broadcast(field.select(F.col("archetype").alias("b"), "share")))  # the field is few labels
    known = cells.withColumn("p", shrink(F.col("wins"), F.col("n")))
    g = s.join(known, ["a", "b"], "left")
    mean = known.groupBy("a").agg(F.avg("p").alias("mean"))
    g = g.join(mean, "a").withColumn("q", F.when(F.col("a") == F.col("b"), 0.5).otherwise(F.coalesce("p", "mean")))
    w, mirror = F.col("share"), F.col("a") == F.col("b")
    return g.groupBy("a").agg(
        (F.sum(w * F.col("q")) / F.sum(w)).alias("score"),
        F.coalesce(F.sum(F.when(F.col("n") > 0, w * w * F.col("q") * (1 - F.col("q")) / F.col("n"))), F.lit(0.0)).alias("variance"),
        F.coalesce(F.sum(F.when((F.col("n") >= 30) & ~mirror, w)) / F.nullif(F.sum(F.when(~mirror, w)), F.lit(0.0)), F.lit(0.0)).alias("coverage"),
    )


def gaps(positions: DataFrame, field: DataFrame, weight: float = 1.0) -> DataFrame:
    """Score less weighted share: what does well and is played little."""
    p = positions.join(field.select(F.col("archetype").alias("a"), "share"), "a", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return p.select("a", "score", "share", (F.col("score") - weight * F.col("share")).alias("gap"))


def best_deck_or_call(cells: DataFrame, field: DataFrame, spread: float = 0.02, mean: float = 0.52) -> DataFrame:
    """BEST_DECK: even rates with a high plain mean; BEST_CALL: a high mean weighted by the field."""
    c = cells.withColumn("p", shrink(F.col("wins"), F.col("n"))).join(F.broadcast(field.select(F.col("archetype").alias("b"), "share")), "b")
    g = c.groupBy("a").agg(F.avg("p").alias("plain"), F.var_pop("p").alias("var"), (F.sum(F.col("p") * F.col("share")) / F.sum("share")).alias("weighted"))
    verdict = F.when((F.round("var", 9) <= spread) & (F.round("plain", 9) >= mean), "BEST_DECK").when(F.round("weighted", 9) >= mean, "BEST_CALL").otherwise("NEITHER")
    return g.withColumn("verdict", verdict)


def positioning_draws(cells: DataFrame, field: DataFrame, draws: int = 20_000, seed: int = 7) -> DataFrame:
    """(a, mean, lo, hi, quarter): Monte-Carlo score of each subject; field draws are shared by seed, cell draws are
    seeded by the subject's name, so results depend neither on partitions nor on order."""
    shares = {r["archetype"]: (float(r["share"]), float(r["n"])) for r in field.select("archetype", "share", "n").collect()}  # one row per label
    names = sorted(shares)
    alpha = np.array([GAMMA + shares[k][1] for k in names])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a = p["a"].iloc[0]
        w = np.random.default_rng(seed).dirichlet(alpha, draws)
        rng = np.random.default_rng([seed, *a.encode()])
        have = {b: (x, n) for b, x, n in zip(p["b"], p["wins"], p["n"])}
        known = [(x + PRIOR) / (n + 2 * PRIOR) for x, n in have.values()]
        base = float(np.mean(known)) if known else 0.5
        rate = np.empty((draws, len(names)))
        for i, b in enumerate(names):
            if b == a:
                rate[:, i] = 0.5
            elif b in have:
                rate[:, i] = rng.beta(have[b][0] + PRIOR, have[b][1] - have[b][0] + PRIOR, draws)
            else:
                rate[:, i] = rng.beta(NO_DATA * base, NO_DATA * (1 - base), draws)
        s = (w * rate).sum(axis=1)
        return pd.DataFrame({"a": [a], "mean": [s.mean()], "lo": [np.quantile(s, 0.025)], "hi": [np.quantile(s, 0.975)], "quarter": [np.quantile(s, 0.25)]})

    return spread(cells.select("a", "b", "wins", "n"), "a").groupBy("a").applyInPandas(run, "a string, mean double, lo double, hi double, quarter double")


class Coverage:
    """Small maximum-coverage model: elements with weights, cards with the elements they answer, copies per card.

    An element answered by k copies is worth weight * (1 - 0.5**k).
    """

    def __init__(self, weight: dict[str, float], covers: dict[str, set[str]], caps: dict[str, int] | None = None):
        self.weight, self.covers = weight, {c: sorted(e & set(weight)) for c, e in sorted(covers.items())}
        self.caps = caps or {}

    def cap(self, card: str) -> int:
        return self.caps.get(card, 4)

    def value(self, copies: dict[str, int]) -> float:
        k: dict[str, int] = {}
        for c, n in copies.items():
            for e in self.covers[c]:
                k[e] = k.get(e, 0) + n
        return sum(self.weight[e] * (1 - 0.5**n) for e, n in k.items())

    def greedy(self, budget: int) -> dict[str, int]:
        """Best marginal gain first, ties by name."""
        k, out = dict.fromkeys(self.weight, 0), {}
        for _ in range(budget):
            best = max(((sum(self.weight[e] * 0.5 ** (k[e] + 1) for e in es), c) for c, es in self.covers.items() if out.get(c, 0) < self.cap(c)), key=lambda x: (round(x[0], 12), [-ord(ch) for ch in x[1]]), default=None)
            if best is None or best[0] <= 0:
                break
            out[best[1]] = out.get(best[1], 0) + 1
            for e in self.covers[best[1]]:
                k[e] += 1
        return out

    def _answered(self, copies: dict[str, int]) -> dict[str, int]:
        k: dict[str, int] = {}
        for c, n in copies.items():
            for e in self.covers.get(c, ()):
                k[e] = k.get(e, 0) + n
        return k

    def hedge(self, core: dict[str, int], budget: int, blend: float = 0.4) -> dict[str, int]:
        """Single copies of cards outside ``core`` for the slots it leaves, by marginal gain under weights blended towards
        their mean (ties by name), while one gains."""
        some = {e: w for e, w in self.weight.items() if w > 0}
        if not some:
            return {}
        mean, k, out = sum(some.values()) / len(some), self._answered(core), {}
        wide = {e: (1 - blend) * w + blend * mean for e, w in some.items()}
        for _ in range(max(0, budget - sum(core.values()))):
            gains = [(-round(sum(wide[e] * 0.5 ** (k.get(e, 0) + 1) for e in es if e in wide), 12), c) for c, es in self.covers.items() if c not in core and c not in out]
            best = min(gains, default=(0.0, ""))
            if best[0] >= 0:
                break
            out[best[1]] = 1
            for e in self.covers[best[1]]:
                k[e] = k.get(e, 0) + 1
        return out

    def considering(self, board: dict[str, int], cap: int = 15) -> list[tuple[str, float]]:
        """Cards that would still gain beside a board, best first (ties by name), at most ``cap`` of them as a report."""
        k = self._answered(board)
        gains = [(c, sum(self.weight[e] * 0.5 ** (k.get(e, 0) + 1) for e in es)) for c, es in self.covers.items() if board.get(c, 0) < self.cap(c)]
        return sorted(((c, g) for c, g in gains if g > 0), key=lambda x: (-round(x[1], 12), x[0]))[:cap]

    def share_covered(self, board: dict[str, int]) -> float:
        """Weight of the elements that any card of a board answers."""
        return sum(self.weight[e] for e in self._answered(board))

    def undominated(self, budget: int) -> list[str]:
        """Cards that some best board may need. A card is left out if cards that answer all it answers (of equal ones,
        those before it by name) have ``budget`` copies together: one of them always has a copy to put in its place."""
        sets = {c: frozenset(e for e in es if self.weight[e] > 0) for c, es in self.covers.items()}
        over = lambda d, c: sets[c] < sets[d] or sets[c] == sets[d] and d < c
        return [c for c in sets if sets[c] and sum(self.cap(d) for d in sets if over(d, c)) < budget]

    def exact(self, budget: int, nodes: int = 200_000) -> tuple[dict[str, int], bool]:
        """Branch and bound over the undominated cards; the bound adds the best remaining marginal gains, which is an
        upper bound as gains only fall. Returns the board and whether it is proven best of all cards within the node
        limit."""
        cards = sorted(self.undominated(budget), key=lambda c: (-sum(self.weight[e] for e in self.covers[c]), c))
        start = self.greedy(budget)
        best, best_v = start, self.value(start)
        queue, count = [(-1e18, 0, 0, {}, 0)], 1
        seen = 0
        while queue:
            bound, i, _, chosen, used = heapq.heappop(queue)
            if -bound <= best_v + 1e-9 and bound > -1e17:
                return best, True
            seen += 1
            if seen > nodes:
                return best, False
            if i == len(cards) or used == budget:
                continue
            for n in range(min(self.cap(cards[i]), budget - used) + 1):
                c = {**chosen, cards[i]: n} if n else chosen
                k: dict[str, int] = {}
                for x, m in c.items():
                    for e in self.covers[x]:
                        k[e] = k.get(e, 0) + m
                v = sum(self.weight[e] * (1 - 0.5**m) for e, m in k.items())
                if v > best_v + 1e-12:
                    best, best_v = dict(c), v
                gains = [g * 0.5**t for x in cards[i + 1 :] if (g := sum(self.weight[e] * 0.5 ** (k.get(e, 0) + 1) for e in self.covers[x])) > 0 for t in range(self.cap(x))]
                gains_up = sum(heapq.nlargest(budget - used - n, [sum(self.weight[e] * 0.5 ** (k.get(e, 0) + 1) for e in self.covers[x]) for x in cards[i + 1 :] for _ in range(self.cap(x))])) if gains else 0.0
                if v + gains_up > best_v + 1e-9:
                    count += 1
                    heapq.heappush(queue, (-(v + gains_up), i + 1, count, c, used + n))
        return best, True


def field_value(lifts: DataFrame, field: DataFrame, least: int = 30) -> DataFrame:
    """(name, board, value, cells): share-weighted positive lift of a card over the opponents of the field with
    enough games."""
    x = lifts.where((F.col("n") >= least) & (F.col("lift") > 0)).join(F.broadcast(field.select(F.col("archetype").alias("b"), "share")), "b")
    return x.groupBy("name", "board").agg(F.sum(F.col("share") * F.col("lift")).alias("value"), F.count(F.lit(1)).alias("cells"))


def top_finishers(decks: DataFrame, standings: DataFrame, quantile: float = 0.25) -> DataFrame:
    """Decks (unique names only) with a rank up to max(1, ceil(quantile * players)) of their event."""
    from tidemark.operators.matches import unique_names

    size = standings.groupBy("tournament_id").agg(F.count(F.lit(1)).alias("players"))
    s = standings.groupBy("tournament_id", "norm").agg(F.count(F.lit(1)).alias("k"), F.min("rank").alias("rank")).where("k = 1").join(size, "tournament_id")
    s = s.where(F.col("rank") <= F.greatest(F.lit(1), F.ceil(quantile * F.col("players"))))
    return unique_names(decks).where("n = 1").join(s.select("tournament_id", "norm", "rank"), ["tournament_id", "norm"]).select("tournament_id", "deck_idx", "archetype", "rank")


def cheapest(printings: DataFrame) -> DataFrame:
    """(name, printing, price): cheapest priced printing of each name, ties to the smaller printing; unpriced names
    stay with null."""
    p = printings.groupBy("name").agg(F.min(F.when(F.col("price").isNotNull(), F.struct("price", "printing"))).alias("m"))
    return p.select("name", F.col("m.printing").alias("printing"), F.col("m.price").alias("price"))


def deck_cost(demand: DataFrame, prices: DataFrame) -> DataFrame:
    """(deck, total, unpriced): cost of a list at the cheapest printings, and how many of its names have no price."""
    d = demand.join(prices, "name", "left")
    return d.groupBy("deck").agg(F.coalesce(F.sum(F.col("copies") * F.col("price")), F.lit(0.0)).alias("total"), F.count_if(F.col("price").isNull()).alias("unpriced"))


def contention(demand: DataFrame, owned: DataFrame) -> DataFrame:
    """(name, wanted, owned, decks): cards that all lists together need more often than they are owned."""
    w = demand.groupBy("name").agg(F.sum("copies").alias("wanted"), F.count_distinct("deck").alias("decks"))
    return w.join(owned, "name", "left").select("name", "wanted", F.coalesce("owned", F.lit(0)).cast("long").alias("owned"), "decks").where("wanted > owned")


def buildable(demand: DataFrame, owned: DataFrame) -> DataFrame:
    """(deck, missing): copies that a list lacks."""
    j = demand.join(owned, "name", "left")
    return j.groupBy("deck").agg(F.sum(F.greatest(F.lit(0), F.col("copies") - F.coalesce("owned", F.lit(0)))).cast("long").alias("missing"))
