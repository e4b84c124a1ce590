"""Reports over the long-lived step log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_STEPS = 100_000


def trailing_mean(log: DataFrame, k: int, run: list[str] | None = None, step: str = "step",
                  value: str = "loss", chunk: int = CHUNK_STEPS) -> DataFrame:
    """Mean of ``value`` over the last ``k`` rows, fewer at the start of a run.

    Steps rise inside a run and may have gaps; rows without a step are left out. Rows are numbered
    by chunks of steps first, from the chunks' counts. A run is then cut into chunks of ``chunk``
    rows, each also receiving the ``k - 1`` rows before it, so that one long run spreads over
    many tasks instead of being sorted in one.
    """
    run = run or []
    rows = log.select(*run, step, value, F.floor(F.col(step) / chunk).alias("_c")).where(F.col(step).isNotNull())
    earlier = Window.partitionBy(*run).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*run, "_c"]
    base = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .select(*[F.col(c).alias(f"_b_{c}") for c in keys],
                    F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")))
    same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in keys]
    inside = Window.partitionBy(*keys).orderBy(step)
    numbered = rows.join(base, same).withColumn("_row", F.col("_base") + F.row_number().over(inside) - 1)
    own = F.floor(F.col("_row") / chunk)
    last_needed_by = F.floor((F.col("_row") + (k - 1)) / chunk)
    spread = numbered.select(*run, step, value, "_row", own.alias("_own"),
                             F.explode(F.sequence(own, last_needed_by)).alias("_chunk"))
    window = Window.partitionBy(*run, "_chunk").orderBy("_row").rowsBetween(-(k - 1), 0)
    return (spread.withColumn("trailing_mean", F.avg(value).over(window))
            .where(F.col("_own") == F.col("_chunk")).select(*run, step, value, "trailing_mean"))


def every_kth(log: DataFrame, k: int, step: str = "step") -> DataFrame:
    """The rows of a report or checkpoint stride; 0 disables it."""
    if not k:
        return log.where(F.lit(False))
    return log.where(F.col(step) % k == 0)
