"""Join shapes that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 16


def salt_of(c: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")


def attach(left: DataFrame, right: DataFrame, on: str | list[str], spread_by: str, how: str = "left",
           salts: int = SALTS, hint: str | None = None) -> DataFrame:
    """Join a wide table to a narrow lookup with unique keys, spreading each key over ``salts`` tasks.

    Spark broadcasts the lookup when its measured size is under ``spark.sql.autoBroadcastJoinThreshold``;
    above it both sides shuffle, and the salt keeps a hot key from landing in one task. Only the lookup
    is repeated, so keep it narrow. ``hint`` names the join to use instead, for lookups much larger in memory than stored.
    """
    on = [on] if isinstance(on, str) else on
    left = left.withColumn("_salt", salt_of(F.col(spread_by), salts))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint(hint) if hint else right, [*on, "_salt"], how).drop("_salt")


def is_small(df: DataFrame, text: str, max_rows: int = 200_000, max_chars: int = 64_000_000) -> bool:
    """Whether the counted rows of a table and the length of its text column allow a broadcast.

    For tables that Spark cannot estimate, joined to one too large to shuffle for their sake.
    """
    rows, chars = df.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    return rows <= max_rows and chars <= max_chars
