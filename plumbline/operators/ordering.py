"""Positions in a global order, and seeded permutations of them."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.scratch import materialize


def global_index(df: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """``df`` with the position (from 0) of each row in the given order.

    Rows are range-partitioned and sorted, then each partition's positions are shifted by the sizes of those before it, so nothing is
    sorted in one task; what goes through the driver is a number for each partition. The order must not leave ties open.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low 33 bits of the id count rows within the partition, the bits above are the partition
    held = materialize(sorted_.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    sizes = held.groupBy(part.alias("p")).count().orderBy("p").collect()
    before, at = {}, 0
    for p, n in sizes:
        before[p], at = at, at + n
    if not before:
        return held.withColumn(name, F.lit(0).cast("long")).drop("_id")
    starts = F.array(*(F.lit(before.get(p, 0)).cast("long") for p in range(max(before) + 1)))
    return held.withColumn(name, F.element_at(starts, (part + 1).cast("int")) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def running_sums(df: DataFrame, by: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with the sums of ``values`` over the rows of the same ``by`` up to each row, itself included, in the given order.

    Rows are range-partitioned and sorted by group and order, so a group may span many partitions. Windows are within a partition's part of a
    group, and over a group's partitions, of which there are as many as the session shuffles into. Nulls in ``by`` are a group; nulls
    of ``values`` count as zero. The order must not leave ties open within a group.
    """
    names = list(values)
    sorted_ = df.withColumns(values).fillna(0, names).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    held = materialize(sorted_.withColumn("_id", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_id", 33))
    parts = held.groupBy("_part", *by).agg(*(F.sum(n).alias(f"_{n}") for n in names))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_part", *(F.col(b).alias(f"_by_{b}") for b in by), *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in names))
    same = F.col("_part") == F.col("_p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    within = Window.partitionBy("_part", *by).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = held.withColumns({n: F.sum(n).over(within) for n in names})
    joined = summed.join(before.withColumnRenamed("_part", "_p"), same)
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}") for n in names}).select(*df.columns, *(n for n in names if n not in df.columns))


def path_order(path: str | Column) -> Column:
    """The key by which paths sort part by part, as directories are listed."""
    return F.split(path, "/")


def seeded_permutation(n: int, seed: int) -> list[int]:
    """The order into which ``random.Random(seed)`` shuffles n things: entry k is what comes k-th."""
    held = list(range(n))
    random.Random(seed).shuffle(held)
    return held
