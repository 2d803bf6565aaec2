"""Positions inside ordered groups, and paging of long lists, without putting a whole group into one task.

A plain ``row_number() over (partition by group order by x)`` sorts a whole group in one task. Here a group is cut
into blocks of consecutive order values; blocks are counted, the counts are summed up, and rows are numbered inside
their block. Only the block counts, thousands of times fewer than rows, meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwitable.session import materialise, settled

BLOCK = 4096
PAGE = 1000


def block_of(order: str, width: int = BLOCK) -> Column:
    """The block of consecutive order values a row belongs to."""
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def ordered_index(
    df: DataFrame, keys: Sequence[str], order: str, out: str, width: int = BLOCK
) -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by an integer column."""
    keys = list(keys)
    blocked = df.withColumn("_block", block_of(order, width))
    counts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_block").orderBy(order)
    numbered = blocked.withColumn("_rank", F.row_number().over(within))
    return (
        numbered.join(offsets, [*keys, "_block"])
        .withColumn(out, (F.col("_offset") + F.col("_rank") - 1).cast("long"))
        .drop("_block", "_offset", "_rank")
    )


def ordered_position(df: DataFrame, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by a column of any kind; of equal rows any comes first.

    A group of at most ``BLOCK`` rows is numbered in one task. The rows of larger ones are dealt out by ranges of group and
    order and written, so a group of any size spreads; rows are numbered in their part of a group, and only the counts of the
    parts are summed up. All rows are counted by group first.
    """
    keys = list(keys)
    large = settled(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK).select(*keys), "large")
    usual = Window.partitionBy(*keys).orderBy(order)
    if large.isEmpty():
        return df.withColumn(out, (F.row_number().over(usual) - 1).cast("long"))
    same = [F.col(f"_d.{k}").eqNullSafe(F.col(f"_l.{k}")) for k in keys]
    rest = df.alias("_d").join(large.alias("_l"), same, "left_anti").select(df.columns)
    return rest.withColumn(out, (F.row_number().over(usual) - 1).cast("long")).unionByName(
        _spread_position(df.alias("_d").join(large.alias("_l"), same, "left_semi").select(df.columns), keys, order, out))


def _spread_position(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """``ordered_position`` for groups that are too large for a task."""
    dealt = df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    further = settled(offsets.filter(F.col("_offset") > 0), "offsets")
    within = Window.partitionBy(*keys, "_part").orderBy(order)
    same = [F.col(f"_d.{k}").eqNullSafe(F.col(f"_o.{k}")) for k in [*keys, "_part"]]
    numbered = dealt.withColumn("_rank", F.row_number().over(within)).alias("_d").join(further.alias("_o"), same, "left")
    position = F.coalesce("_offset", F.lit(0)) + F.col("_rank") - 1
    return numbered.select(*[F.col(f"_d.{c}") for c in df.columns], position.cast("long").alias(out))


def paged(df: DataFrame, keys: Sequence[str], by: Sequence[str | Column], page_size: int = PAGE) -> DataFrame:
    """Add a ``page`` to each row so that a page of a group holds about ``page_size`` rows.

    A group that fits one page gets page 0 throughout. Larger groups are spread by a hash of ``by``, so collecting
    ``(keys, page)`` into a list stays bounded and no row is left out. Only the sizes of the larger groups are joined
    back; there cannot be many of them. The result is partitioned by group and page: without that, an aggregation on
    top could reuse the join's partitioning by group alone.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = settled(sizes.filter(F.col("_n") > page_size), "large")
    pages = F.ceil(F.col("_n") / F.lit(page_size)).cast("long")
    return (
        df.join(large, keys, "left")
        .withColumn("page", F.coalesce(F.pmod(F.xxhash64(*by), pages), F.lit(0)).cast("long"))
        .drop("_n")
        .repartition(*keys, "page")
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], prefix: str = "prev_", width: int = BLOCK
) -> DataFrame:
    """Add the values of the preceding row (order value one less) under prefixed names.

    The last row of each block is also sent to the next block, so the window never spans more than one block.
    """
    keys = list(keys)
    row = F.struct(*[F.col(c) for c in df.columns])
    is_last = F.pmod(F.col(order), F.lit(width)) == width - 1
    block = block_of(order, width)
    own, ahead = F.struct(block.alias("b"), F.lit(False).alias("context")), F.struct(
        (block + 1).alias("b"), F.lit(True).alias("context")
    )
    copies = F.explode(F.when(is_last, F.array(own, ahead)).otherwise(F.array(own)))
    spread = df.select(row.alias("r"), copies.alias("c")).select("r.*", F.col("c.b").alias("_block"), "c.context")
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    consecutive = F.lag(order).over(w) == F.col(order) - 1
    return (
        spread.select(
            "*", *[F.when(consecutive, F.lag(c).over(w)).alias(f"{prefix}{c}") for c in columns]
        )
        .filter(~F.col("context"))
        .drop("_block", "context")
    )
