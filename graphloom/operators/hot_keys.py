"""Per-key results over inputs where a handful of keys hold most rows.

Eager aggregation through a join: each input is aggregated by the *join* key
before it is joined, so a key that holds a third of all rows becomes one state
per map task before anything is shuffled. The join then pairs compact states,
counts multiply, sums are scaled by the other side's count, and the roll-up to
the coarser key adds states again. No task ever sees the rows of one key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    by: Sequence[str],
    left_sums: Mapping[str, Column] | None = None,
    right_sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Aggregate ``left JOIN right ON on`` by ``by`` without building the join.

    ``on`` pairs column names of the two inputs, ``by`` names left columns out of
    ``on``. Result: ``by``, ``left_rows``, ``right_rows`` (every stored row of
    either input, matched or not), ``pairs`` (rows of the inner join) and for each
    entry of ``left_sums``/``right_sums`` the sum over the joined rows.

    Nulls: rows with a null key are counted under that null key, and a null joins
    nothing, as in SQL; null measures add nothing, and a sum without any value is
    null. Repeated rows and ties count as often as stored. Empty inputs give an
    empty result. Other columns of the inputs are never read, so clashing names
    are harmless.
    """
    names = [l for l, _ in on]
    unknown = [b for b in by if b not in names]
    if unknown:
        raise ValueError(f"roll-up columns must be join columns: {unknown}")
    left_sums, right_sums = dict(left_sums or {}), dict(right_sums or {})
    keys = [f"_k{i}" for i in range(len(on))]

    def states(df: DataFrame, columns: list[str], n: str, sums: Mapping[str, Column]) -> DataFrame:
        picked = df.select(
            *[F.col(f"`{c}`").alias(k) for k, c in zip(keys, columns)],
            *[expr.alias(f"_m_{alias}") for alias, expr in sums.items()],
        )
        return picked.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(n), *[F.sum(f"_m_{a}").alias(f"_s_{a}") for a in sums]
        )

    a = states(left, names, "_ln", left_sums).alias("a")
    b = states(right, [r for _, r in on], "_rn", right_sums).alias("b")
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    matched = F.lit(True)
    for k in keys:
        matched = matched & F.col(f"a.{k}").isNotNull()
    ln, rn = F.coalesce("_ln", F.lit(0)), F.coalesce("_rn", F.lit(0))
    joined = a.join(b, condition, "full_outer").select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
        ln.alias("_ln"),
        rn.alias("_rn"),
        F.when(matched, ln * rn).otherwise(F.lit(0)).alias("_pairs"),
        *[F.when(matched & (rn > 0), F.col(f"_s_{x}") * rn).alias(f"_s_{x}") for x in left_sums],
        *[F.when(matched & (ln > 0), F.col(f"_s_{x}") * ln).alias(f"_s_{x}") for x in right_sums],
    )
    positions = {n: k for n, k in zip(names, keys)}
    return joined.groupBy(*[F.col(positions[c]).alias(c) for c in by]).agg(
        F.sum("_ln").alias("left_rows"),
        F.sum("_rn").alias("right_rows"),
        F.sum("_pairs").alias("pairs"),
        *[F.sum(f"_s_{x}").alias(x) for x in (*left_sums, *right_sums)],
    )


def hot_keys(rolled: DataFrame, key: str, left_name: str, right_name: str, percent: int = 5) -> DataFrame:
    """Keys of a roll-up that hold at least ``percent`` % of all rows of an input.

    ``rolled`` comes from :func:`eager_join_aggregate`. The comparison is exact
    (integers). Rows under a null key count in the total; the null key itself is
    no case.
    """
    stacked = rolled.select(
        F.col(key),
        F.explode(
            F.array(
                F.struct(F.lit(left_name).alias("table_name"), F.col("left_rows").alias("n")),
                F.struct(F.lit(right_name).alias("table_name"), F.col("right_rows").alias("n")),
            )
        ).alias("x"),
    ).select(key, "x.*")
    totals = stacked.groupBy("table_name").agg(F.sum("n").alias("total"))
    return (
        stacked.filter(F.col(key).isNotNull() & (F.col("n") > 0))
        .join(totals, "table_name")
        .filter(F.col("n") * 100 >= F.col("total") * percent)
        .select("table_name", key)
    )
