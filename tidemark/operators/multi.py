"""Camps against parents: all split labels at once, full or with a window per pair, and rankings over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import shrink, tier, wilson
from tidemark.operators.matrix import ROW_SHARE, SHOWN

#: Games under which a cell counts as thin.
THIN = 100


def base_label(label: Column) -> Column:
    """The parent of 'parent [camp]'; other labels are their own."""
    return F.regexp_replace(label, r" \[[^\]]*\]$", "")


def split_label(label: Column, variant: Column, split: Column) -> Column:
    """'parent [camp]' for labels that are split, 'parent [unlabeled]' without a camp."""
    return F.when(split, F.concat(label, F.lit(" ["), F.coalesce(variant, F.lit("unlabeled")), F.lit("]"))).otherwise(label)


def camp_sides(resolved: DataFrame, parents: DataFrame) -> DataFrame:
    """(x, px, y, py, date, win, k): sides of matches with a winner at the grain of camps; two decks of one camp are a
    mirror, which gives one row with y = x, win 1 and k 2. ``parents``: (parent), the labels that are split."""
    p = parents.select("parent").distinct()
    side = lambda c: p.select(F.col("parent").alias(c), F.lit(True).alias(f"s{c}"))
    m = resolved.where("status in ('decisive', 'mirror')").join(side("a"), "a", "left").join(side("b"), "b", "left")
    lab = lambda c: split_label(F.col(c), F.col(f"v{c}"), F.coalesce(f"s{c}", F.lit(False)))
    m = m.select(lab("a").alias("x"), F.col("a").alias("px"), lab("b").alias("y"), F.col("b").alias("py"), "date", (F.col("s1") > F.col("s2")).cast("int").alias("w"))
    one = F.struct("x", "px", "y", "py", F.col("w").alias("win"), F.lit(1).alias("k"))
    two = F.struct(F.col("y").alias("x"), F.col("py").alias("px"), F.col("x").alias("y"), F.col("px").alias("py"), (1 - F.col("w")).alias("win"), F.lit(1).alias("k"))
    same = F.struct("x", "px", "y", "py", F.lit(1).alias("win"), F.lit(2).alias("k"))
    return m.select("date", F.explode(F.when(F.col("x") == F.col("y"), F.array(same)).otherwise(F.array(one, two))).alias("e")).select("e.*", "date")


def _frame(sides: DataFrame, parents: DataFrame, min_row_share: float) -> tuple[DataFrame, DataFrame]:
    """Grid (x, px, camp, y, prior inputs) of subjects and opponents, without a subject's own parent.

    Subjects are all camps and the unsplit labels with a row; opponents are base labels with a row.
    """
    marginal = sides.groupBy("x", "px").agg(F.sum("win").alias("mw"), F.sum("k").alias("mn"))
    base = marginal.groupBy("px").agg(F.sum("mw").alias("bw"), F.sum("mn").alias("bn"))
    total = base.agg(F.sum("bn").alias("t"))  # one row: both sides of all matches
    rowed = base.join(F.broadcast(total)).where(F.col("bn") >= min_row_share * F.col("t")).select("px")
    s = marginal.join(base, "px").withColumn("camp", F.col("x") != F.col("px"))
    s = s.join(rowed.withColumn("has", F.lit(True)), "px", "left").where(F.col("camp") | F.col("has")).drop("has")
    grid = s.join(F.broadcast(rowed.select(F.col("px").alias("y")))).where("y <> px")  # at most 1 / min_row_share opponents
    return grid, s


def _cell(g: DataFrame, prior: Column, source: Column) -> DataFrame:
    lo, hi = wilson(F.col("wins"), F.col("n"))
    some = F.col("n") > 0
    return g.withColumns({"prior": prior, "prior_source": source}).select(
        F.col("x").alias("subject"), F.col("y").alias("opponent"), "wins", "n", F.when(some, F.col("wins") / F.col("n")).alias("p_raw"), "prior", "prior_source",
        shrink(F.col("wins"), F.col("n"), F.col("prior")).alias("p_shrunk"), F.when(some, lo).alias("lo"), F.when(some, hi).alias("hi"), tier(F.col("n")).alias("tier"), (F.col("n") >= SHOWN).alias("shown"),
    )


def _pooled(sides: DataFrame, inside: Column) -> DataFrame:
    """(x, y, wins, n): games of a subject against a base label, without those of its own parent."""
    one = lambda v: F.sum(F.when(inside, v).otherwise(0)).cast("long")
    return sides.where("px <> py").groupBy("x", F.col("py").alias("y")).agg(one(F.col("win")).alias("wins"), one(F.lit(1)).alias("n"))


def _lco(pooled: DataFrame, subjects: DataFrame) -> DataFrame:
    """(px, y, pw, pn): sums over all camps of a parent, from which a camp's own games are taken off."""
    return pooled.join(subjects.where("camp").select("x", "px"), "x").groupBy("px", "y").agg(F.sum("wins").alias("pw"), F.sum("n").alias("pn"))


def _prior() -> tuple[Column, Column]:
    own = shrink(F.col("mw"), F.col("mn"))
    others = shrink(F.coalesce("pw", F.lit(0)) - F.col("wins"), F.coalesce("pn", F.lit(0)) - F.col("n"), shrink(F.col("bw"), F.col("bn")))
    return F.when(F.col("camp"), others).otherwise(own), F.when(F.col("camp"), "leave-camp-out").otherwise("marginal")


def multi_split(resolved: DataFrame, parents: DataFrame, min_row_share: float = ROW_SHARE) -> DataFrame:
    """Cells of every camp (of ``parents``) and every unsplit label with a row against every base label with a row.

    A camp's prior is what the other camps of its parent did against the opponent, shrunk to the parent's rate; an
    unsplit label's is its own rate. A subject has no cell against its own parent. All from one pass over the matches.
    """
    sides = camp_sides(resolved, parents)
    grid, s = _frame(sides, parents, min_row_share)
    pooled = _pooled(sides, F.lit(True))
    g = grid.join(pooled, ["x", "y"], "left").join(_lco(pooled, s), ["px", "y"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("wins", "n")})
    return _cell(g, *_prior())


def multi_split_mirrors(resolved: DataFrame, parents: DataFrame) -> DataFrame:
    """(subject, n): matches of a camp or label against itself."""
    return camp_sides(resolved, parents).where("x = y").groupBy(F.col("x").alias("subject")).agg(F.count(F.lit(1)).alias("n"))


def adaptive_multi_split(resolved: DataFrame, parents: DataFrame, horizons: DataFrame, rungs: DataFrame | None = None, min_row_share: float = ROW_SHARE, thin: int = THIN) -> DataFrame:
    """The same with a window per pair, from the later horizon of both; ``horizons``: (label, since, source), labels as
    'parent [camp]' or parents; missing ones are open.

    A thin cell that an era cut (source other than 'ban-only') shrinks to its own games before the cut. Else a camp's
    prior leaves it out of its parent; unsplit labels take the mean and strength of ``rungs`` (subject, opponent,
    mean, strength) if given, then their own rate. Windowed and earlier games are two sums of one pass.
    """
    h = lambda c, n: horizons.select(F.col("label").alias(c), F.col("since").alias(f"{n}_since"), F.col("source").alias(f"{n}_source"))
    sides = camp_sides(resolved, parents)
    grid, s = _frame(sides, parents, min_row_share)
    d = sides.where("px <> py").join(h("x", "x"), "x", "left").join(h("py", "y"), "py", "left").withColumn("since", F.greatest("x_since", "y_since"))
    inside = F.col("since").isNull() | F.coalesce(F.col("date") >= F.col("since"), F.lit(False))
    era = ((F.col("x_since") == F.col("since")) & (F.col("x_source") != "ban-only")) | ((F.col("y_since") == F.col("since")) & (F.col("y_source") != "ban-only"))
    one = lambda c, v: F.sum(F.when(c, v).otherwise(0)).cast("long")
    pooled = d.groupBy("x", F.col("py").alias("y")).agg(
        one(inside, F.col("win")).alias("wins"), one(inside, F.lit(1)).alias("n"), one(~inside, F.col("win")).alias("before_w"), one(~inside, F.lit(1)).alias("before_n"), F.first(F.coalesce(era, F.lit(False))).alias("era"), F.first("since").alias("since")
    )
    g = grid.join(pooled, ["x", "y"], "left").join(_lco(pooled.select("x", "y", "wins", "n"), s), ["px", "y"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("wins", "n", "before_w", "before_n")})
    prior, source = _prior()
    if rungs is not None:
        g = g.join(rungs.select(F.col("subject").alias("x"), F.col("opponent").alias("y"), "mean"), ["x", "y"], "left")
        free = ~F.col("camp") & F.col("mean").isNotNull()
        prior, source = F.when(free, F.col("mean")).otherwise(prior), F.when(free, "family").otherwise(source)
    cut = F.coalesce("era", F.lit(False)) & (F.col("n") < thin) & (F.col("before_n") > 0)
    c = _cell(g, F.when(cut, shrink(F.col("before_w"), F.col("before_n"))).otherwise(prior), F.when(cut, "before the cut").otherwise(source))
    return c.join(pooled.select(F.col("x").alias("subject"), F.col("y").alias("opponent"), "since"), ["subject", "opponent"], "left")


def ranking_view(cells: DataFrame) -> DataFrame:
    """Cells (subject, opponent, ..) as (a, b, wins, n) for the rankers."""
    return cells.where("n > 0").select(F.col("subject").alias("a"), F.col("opponent").alias("b"), "wins", "n")


def best_call(cells: DataFrame, field: DataFrame, top: int = 10, cover: float = 0.5, ground: int = 8) -> DataFrame:
    """(subject, mean, floor, agency, coverage, cells, grounded): share-weighted rate of a subject over the ``top`` labels
    of the field, its worst cell, and what share of the field has a cell of at least ``ground`` games; grounded if that
    reaches ``cover``. ``field``: (archetype, share)."""
    from pyspark.sql.window import Window

    few = field.orderBy(F.round("share", 12).desc(), "archetype").limit(top)  # the top of the field is the feature
    few = few.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy(F.lit(1)))).select(F.col("archetype").alias("opponent"), "share")
    c = cells.join(F.broadcast(few), "opponent").withColumn("ok", F.col("n") >= ground)
    g = c.groupBy("subject").agg(
        (F.sum(F.col("share") * F.col("p_shrunk")) / F.sum("share")).alias("mean"), F.min("p_shrunk").alias("floor"), F.sum(F.when(F.col("ok"), F.col("share")).otherwise(0.0)).alias("coverage"), F.count_if("ok").alias("cells")
    )
    return g.select("subject", "mean", "floor", F.least("mean", "floor").alias("agency"), "coverage", "cells", (F.round("coverage", 12) >= cover).alias("grounded"))


def leave_one_out_error(cells: DataFrame, rungs: DataFrame, truth: int = 30) -> DataFrame:
    """(prior, cells, error): mean absolute error against measured cells of the family prior and of the label's own rate,
    over the same cells. ``cells``: (subject, opponent, wins, n, prior)."""
    x = cells.where(F.col("n") >= truth).join(rungs.select("subject", "opponent", "mean"), ["subject", "opponent"]).withColumn("p", F.col("wins") / F.col("n"))
    e = x.select(F.explode(F.array(F.struct(F.lit("family").alias("prior"), F.abs(F.col("mean") - F.col("p")).alias("e")), F.struct(F.lit("marginal").alias("prior"), F.abs(F.col("prior") - F.col("p")).alias("e")))).alias("s")).select("s.*")
    return e.groupBy("prior").agg(F.count(F.lit(1)).alias("cells"), F.avg("e").alias("error"))
