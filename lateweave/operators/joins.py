"""Equi joins that survive hot keys, and last-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lateweave.session import write_scratch

HOT_ROWS = 200_000


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the row with the greatest ``order``.

    ``max_by`` combines before the shuffle, so a key held by very many rows sends one
    row per map task, and the result is partitioned by the key for a following join.
    """
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
            .select(*keys, "_row.*"))


def left_join_hot(left: DataFrame, right: DataFrame, key: str,
                  row_key: list[str] | None = None, hot_rows: int = HOT_ROWS,
                  last_by: list[str] | None = None, how: str = "left",
                  count_on: DataFrame | None = None) -> DataFrame:
    """Join on ``key`` where some keys may hold a large share of the left rows.

    Keys with more than ``hot_rows`` left rows are spread over salts of a quarter of that, as many
    as their count asks for, small enough that salts meeting in one partition even out. Only their
    right rows are repeated, once per salt. Counting combines before its shuffle and reads the key
    alone, of ``left`` or of a cheaper table ``count_on`` with the same keys; it runs at once. The
    list of hot keys is written, so Spark knows its size: it is broadcast while it is small and
    joined by a shuffle otherwise. Without hot keys this is a plain join.

    Left rows without a key match nothing. They never reach the join: an inner join leaves them
    out, a left join adds them again by union.

    ``last_by`` first reduces the right side to the last row per key in the order of
    those columns. That happens on the salted key, so the one shuffle of the right side
    serves both the reduction and the join.

    ``row_key`` names columns that tell left rows apart; without it the salt is
    ``monotonically_increasing_id``, which repeats exactly on a task retry only when
    ``left`` comes from a scan or a checkpoint.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"a {how} join would repeat right rows with every salt")
    counts = (left if count_on is None else count_on).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    special = write_scratch(counts.where((F.col("_n") > hot_rows) | F.col(key).isNull()), "hot-keys")
    some = special.agg(F.count(key).alias("hot"), F.count(F.lit(1)).alias("rows")).first()

    keyed = left.where(F.col(key).isNotNull())
    if some["hot"]:
        hot = special.where(F.col(key).isNotNull()).select(
            key, F.ceil(4 * F.col("_n") / hot_rows).cast("int").alias("_salts"))
        spread = F.xxhash64(*row_key) if row_key else F.monotonically_increasing_id()
        left_side = (keyed.withColumn("_spread", spread).join(hot, key, "left")
                     .withColumn("_salt", F.coalesce(F.pmod("_spread", F.col("_salts")), F.lit(0)).cast("int"))
                     .drop("_salts", "_spread"))
        right_side = (right.join(hot, key, "left")
                      .withColumn("_salt", F.explode(F.sequence(
                          F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))))
                      .drop("_salts"))
        on = [key, "_salt"]
    else:
        left_side, right_side, on = keyed, right, [key]
    if last_by:
        right_side = last_wins(right_side, on, [F.col(c) for c in last_by]).drop(*last_by)
    joined = left_side.join(right_side, on, how).drop("_salt")
    if how == "inner" or some["rows"] == some["hot"]:
        return joined
    return joined.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)
