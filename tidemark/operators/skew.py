"""Joins and aggregations whose keys are very unevenly filled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable, shuffled

#: Rows of one key that one task may take in a salted join.
ROWS_PER_TASK = 500_000


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Equi-join of a large ``left`` with ``right``; keys with more than ``rows_per_task`` left rows are split.

    Only hot keys get salts, by a hash of ``spread`` on the left and by repetition on the right. They are counted
    first (``left`` is evaluated twice: pass what is cheap to evaluate); without hot keys it is a plain join. Neither
    side is ever broadcast, the hot keys only if their table is small. Null keys match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    on = list(on)
    hot = left.groupBy(on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_task)
    hot = durable(hot.select(*on, F.ceil(F.col("__n") / rows_per_task).cast("int").alias("__salts")))
    if hot.isEmpty():
        return left.join(shuffled(right), on, how)
    salts = F.coalesce("__salts", F.lit(1))
    lhs = left.join(hot, on, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("__salts")
    rhs = right.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return lhs.join(shuffled(rhs), [*on, "__salt"], how).drop("__salt")


def eager_join_rollup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    by: Sequence[str],
    left_sums: dict[str, Column],
    right_sums: dict[str, Column] | None = None,
    right_by: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Per-group sums over ``left JOIN right`` without ever forming the joined rows.

    Both inputs are first reduced by join key (and the grouping columns of that side) to compact states: a row count
    and the partial sums. The states are joined; a left sum is multiplied by the right row count and a right sum by
    the left row count, which equals summing over all joined rows; the roll-up to ``by + right_by`` combines on the
    map side. A key holding most rows thus arrives at the shuffle as one state per task.

    Result: by + right_by, ``n_left`` (left rows of the states met; without right_by each left row once), ``n_rows``
    (joined rows), the left and right sums. With how='left' an unmatched left state
    counts once and its right sums add 0 (as in a left outer join). Null join keys match nothing; null summands are
    skipped; a group whose summands are all null has sum null. Empty inputs give an empty result.
    """
    on, by, right_by, right_sums = list(on), list(by), list(right_by), right_sums or {}
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    names = [*by, *right_by, "n_left", "n_rows", *left_sums, *right_sums]
    if len(set(names)) < len(names):
        raise ValueError(f"clashing column names: {names}")
    lkeys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(on)]
    lby = [F.col(c).alias(f"__b{i}") for i, c in enumerate(by)]
    rby = [F.col(c).alias(f"__rb{i}") for i, c in enumerate(right_by)]
    ls = left.groupBy(*lkeys, *lby).agg(F.count(F.lit(1)).alias("__nl"), *[F.sum(v).alias(f"__l{i}") for i, v in enumerate(left_sums.values())])
    rs = right.groupBy(*lkeys, *rby).agg(F.count(F.lit(1)).alias("__nr"), *[F.sum(v).alias(f"__r{i}") for i, v in enumerate(right_sums.values())])
    joined = ls.join(rs, [f"__k{i}" for i in range(len(on))], how)
    nr = F.coalesce("__nr", F.lit(1))
    return joined.groupBy(
        *[F.col(f"__b{i}").alias(c) for i, c in enumerate(by)], *[F.col(f"__rb{i}").alias(c) for i, c in enumerate(right_by)]
    ).agg(
        F.sum("__nl").alias("n_left"),
        F.sum(F.col("__nl") * nr).alias("n_rows"),
        *[F.sum(F.col(f"__l{i}") * nr).alias(c) for i, c in enumerate(left_sums)],
        *[F.sum(F.col(f"__r{i}") * F.col("__nl")).alias(c) for i, c in enumerate(right_sums)],
    )


def latest_state(df: DataFrame, key: Sequence[str], at: str, keep: Sequence[str]) -> DataFrame:
    """Of each key the ``keep`` values of the row with the latest timestamp ``at``, ties to the smallest values.

    Combines on the map side. Rows whose ``at`` is null come before all others; nulls in ``keep`` sort first.
    """
    order = F.struct((-F.coalesce(F.unix_micros(at), F.lit(-(2**62)))).alias("__o"), *keep)
    return df.groupBy(*key).agg(F.min(order).alias("__s")).select(*key, *[F.col(f"__s.{c}").alias(c) for c in keep])
