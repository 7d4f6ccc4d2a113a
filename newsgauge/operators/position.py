"""Row numbers over a whole table, or over groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgauge.session import cut

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition here
BROADCAST_ROWS = 200_000
FILE_ROWS = 500_000
FILE_BYTES = 64_000_000


def with_position(df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "position",
                  row_id: str | Sequence[str] | None = None, using: Sequence[str] = ()) -> DataFrame:
    """Add the 1-based place of each row in ``order``, counted within ``group`` columns.

    ``row_number`` would sort each group in one task. Here rows are range-partitioned on (group, order),
    sorted locally and written with their place in their partition; to it are added the rows of the same group in
    earlier partitions, which are counted per partition.

    With ``row_id``, columns that tell all rows apart, and ``using``, those that ``order`` reads, only these are ranked: they are
    written once, so that finding the range bounds runs nothing upstream again, and the places are joined to the rows by id.
    """
    group = group or []
    if row_id is None:
        return _placed(df, order, group, name)
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    narrow = list(dict.fromkeys([*ids, *group, *using]))
    placed = _placed(cut(df.select(*narrow)), order, group, name)
    if set(narrow) == set(df.columns):
        return placed.select(*df.columns, name)
    placed = placed.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)], F.col(name).alias("_place"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_id{i}")) for i, c in enumerate(ids)])
    return df.join(placed, same).select(*df.columns, F.col("_place").alias(name))


def _placed(df: DataFrame, order: list[Column], group: list[str], name: str) -> DataFrame:
    keys = [F.col(g).asc() for g in group] + list(order)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = cut(ranged.select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND((1 << _LOCAL_BITS) - 1).alias("_local"),
    ))
    by_part = ranged.groupBy("_part", *group).agg(F.min("_local").alias("_first"), F.count("*").alias("_n"))
    # one row per partition, or per group and partition it reaches
    earlier = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(by_part.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    ))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # at most partitions + groups rows: few enough to broadcast unless there are very many groups
    if starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return ranged.join(starts, same).select(*df.columns, (F.col("_local") + F.col("_shift") + 1).alias(name))


def in_files(df: DataFrame, position: str, rows: int, file_rows: int = FILE_ROWS, size: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Deal ``rows`` numbered rows, of ``size`` bytes in all, to partitions of as many rows each that follow the numbers.

    There are enough of them for ``file_rows`` and, on average, ``file_bytes`` each; no bounds have to be found.
    """
    parts = max(1, -(-rows // file_rows), min(rows, -(-size // file_bytes)))
    at = F.floor((F.col(position) - 1) * parts / max(1, rows)).cast("int")
    return df.repartitionById(parts, at).sortWithinPartitions(position)
