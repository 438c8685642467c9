"""Gapless numbers without a window over all rows, or over all rows of a key.

Rows are sorted over ranges and kept; the driver gets one row for each range, how many rows it
has. Rows that are equal in the whole order are dealt over ranges, too.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources.landing import kept

ROWS_A_RUN = 50_000


def ranked(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df, sorted and kept, with its ranks from 0 in the order."""
    salted = df.withColumn("_salt", F.rand(11))
    placed = kept(salted.repartitionByRange(*order, "_salt").sortWithinPartitions(*order).drop("_salt").withColumn(name, F.monotonically_increasing_id()))
    parts = sorted(placed.groupBy(F.shiftright(name, 33).alias("p")).count().collect())
    starts = accumulate((k for _, k in parts), initial=0)
    first = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(parts, starts)], "_p long, _s long")
    own = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_p", F.shiftright(name, 33)).join(F.broadcast(first), "_p").withColumn(name, own + F.col("_s")).drop("_p", "_s")


def positions(df: DataFrame, name: str, keys: list[str], *order: str | Column, run: int | None = None) -> DataFrame:
    """df with the place of each row among those of its keys, from 0, in the order (null keys are equal).

    Ranks over all keys are cut into runs. A key's first rank is found within a run by a window; of keys that go on over a
    border between runs, of which there are fewer than runs, it is broadcast. So a key of any number of rows spreads over tasks.
    """
    run = run or ROWS_A_RUN
    rows = ranked(df, "_rank", *keys, *order).withColumn("_run", F.expr(f"_rank div {run}"))
    same = [F.col(k) for k in keys]
    ends = rows.groupBy("_run", *same).agg(F.min("_rank").alias("_low"), F.max("_rank").alias("_high"))
    over = ends.where(f"_low % {run} = 0 or _high % {run} = {run - 1}").groupBy(*same).agg(F.min("_low").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    sent = over.select(F.struct(*same).alias("_of"), "_first")
    rows = rows.withColumn("_own", F.min("_rank").over(Window.partitionBy("_run", *same)))
    rows = rows.join(F.broadcast(sent), F.struct(*same).eqNullSafe(F.col("_of")), "left")
    return rows.withColumn(name, F.col("_rank") - F.coalesce("_first", "_own")).drop("_rank", "_run", "_own", "_of", "_first")
