"""Order statistics of large groups, in two levels, so that no group meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.sources.shared import materialise


def prefix_sums(groups: DataFrame, keys: list[str], order: Column, bucket: Column, columns: list[str]) -> DataFrame:
    """groups with `<column>_above`, the sum over all rows of the same keys that come before, and `<column>_all`.

    bucket is an integer that grows along order."""
    marked = groups.withColumn("_bucket", bucket)
    totals = marked.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(c) for c in columns])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(c).over(before), zero).alias(f"_{c}_before") for c in columns],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in columns],
    )
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = marked.join(offsets, same).withColumns({f"{c}_above": F.col(f"_{c}_before") + F.coalesce(F.sum(c).over(inside), zero) for c in columns})
    return out.drop("_bucket", "_b", *[f"_k{i}" for i in range(len(keys))], *[f"_{c}_before" for c in columns])


def order_key(order: list[Column]) -> Column:
    """The order columns as one value, nulls least; comparable with the `_edge` of edge_rows."""
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])


def edge_rows(rows: DataFrame, keys: list[str], room: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """For each group, where its first `room` rows end: keys, `_edge` (order, as a struct, of the last of them), `_left` (how
    many of the rows with that very order belong) and `<sum>_above` for each of sums, over the rows that come before.

    room is a column that is the same for all rows of a group and at least 1; a group with fewer rows has no edge. Rows alike
    in order are summed up first, the others dealt by ranges of it, so one order key may hold any share of all rows."""
    keyed = rows.withColumn("_edge", order_key(order))
    alike = keyed.groupBy(*keys, room, "_edge").agg(F.count("*").alias("_n"), *[c.alias(name) for name, c in sums.items()])
    # written, as the ranges come from a sample and must not move between the two readings
    dealt = materialise(alike.repartitionByRange(*keys, "_edge").withColumn("_range", F.spark_partition_id()), "ranges")
    placed = prefix_sums(dealt, keys, F.col("_edge"), F.col("_range"), ["_n", *sums])
    left = F.col(room) - F.col("_n_above")
    return placed.where((left > 0) & (left <= F.col("_n"))).select(*keys, "_edge", left.alias("_left"), *[f"{name}_above" for name in sums])
