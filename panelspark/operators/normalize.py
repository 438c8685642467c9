"""Robust scaling and the dense [date, ticker, feature] cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.scalar import clip, quarter_end
from panelspark.operators.quantiles import WHOLE, exact_quantiles, literal, quantiles_by_key
from panelspark.operators.ranks import ranked
from panelspark.operators.windows import forward_fill
from panelspark.sources.landing import kept

#: Of quantile sketches: the rank error is at most 1 / ACCURACY of the rows.
ACCURACY = 100_000


def _quantiles(df: DataFrame, columns: list[str], probabilities: list[float], approximate: bool) -> dict[str, list[float | None]]:
    if not approximate:
        return exact_quantiles(df, columns, probabilities)
    found = df.agg(*[F.percentile_approx(c, probabilities, ACCURACY).alias(c) for c in columns]).head()
    return {c: found[c] or [None] * len(probabilities) for c in columns}


def fill_medians(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """NULLs become the column's median, 0 where there is none. df is kept: exact medians are selected in a few passes over it, ``approximate`` ones are one pass of sketches."""
    df = kept(df)
    found = _quantiles(df, columns, [0.5], approximate)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(found[c][0] if found[c][0] is not None else 0.0)) for c in columns})


def _scaled(c: str, low: Column, middle: Column, high: Column) -> Column:
    spread = high - low
    return (F.col(c) - middle) / F.when(spread == 0, 1.0).otherwise(spread)


def robust_scale(df: DataFrame, columns: list[str], per_key: list[str] = (), key: str = "ticker", bound: float = 5.0, approximate: bool = False, keep: bool = True, whole: int = WHOLE) -> DataFrame:
    """(x - median) / interquartile range, over all rows, or for ``per_key`` columns over the key's rows and kept within the bound; a range of 0 counts as 1.

    What goes over all rows is selected exactly in a few passes over the kept df, or by one pass of sketches if ``approximate``.
    What goes over a key's rows is an aggregate by key, or is selected over sorted ranges where a key has over ``whole`` rows. ``keep=False`` where df is kept already.
    """
    everywhere = [c for c in columns if c not in per_key]
    df = kept(df) if keep else df
    out = df
    if everywhere:
        found = _quantiles(df, everywhere, [0.25, 0.5, 0.75], approximate)
        out = out.withColumns({c: _scaled(c, *[literal(v) for v in found[c]]) for c in everywhere})
    if per_key:
        own = quantiles_by_key(df, key, per_key, [0.25, 0.5, 0.75], whole)
        own = own.select(key, *[F.col(c).alias(f"_q_{c}") for c in per_key])
        out = out.join(own, key).withColumns({c: clip(_scaled(c, *[F.col(f"_q_{c}")[k] for k in range(3)]), -bound, bound) for c in per_key}).drop(*[f"_q_{c}" for c in per_key])
    return out


def quarter_grid(df: DataFrame, columns: list[str], key: str = "ticker", date: str = "date", spread: bool = False) -> DataFrame:
    """Every key at every quarter end from the first to the last of all, with its last values at or before it."""
    ends = df.agg(quarter_end(F.min(date)).alias("_a"), quarter_end(F.max(date)).alias("_b"))
    steps = ends.select(F.explode(F.sequence(F.trunc("_a", "quarter"), F.trunc("_b", "quarter"), F.expr("interval 3 months"))).alias("_d")).select(quarter_end("_d").alias(date))
    grid = df.select(key).distinct().crossJoin(F.broadcast(steps)).withColumn("_grid", F.lit(1))
    facts = df.select(key, date, *columns).withColumn("_grid", F.lit(0))
    both = grid.unionByName(facts, allowMissingColumns=True).withColumn("_order", F.struct(date, "_grid"))
    return forward_fill(both, key, "_order", columns, spread, F.year(date)).where("_grid = 1").select(key, date, *columns)


def cube(grid: DataFrame, columns: list[str], key: str = "ticker", date: str = "date") -> DataFrame:
    """One row for each date: a matrix of assets (sorted) by features, 0 for gaps."""
    vector = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    cells = grid.groupBy(date).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), vector.alias("v")))).alias("cells"))
    return cells.select(date, F.transform("cells", lambda x: x["k"]).alias("tickers"), F.transform("cells", lambda x: x["v"]).alias("matrix"))


#: Assets in a row of the blocked cube.
ASSETS = 4096


def asset_axis(df: DataFrame, key: str = "ticker", size: int = ASSETS) -> DataFrame:
    """key, position (from 0, in order of the keys), block, offset: where each asset stands in every date's cross-section."""
    keys = ranked(df.select(key).where(F.col(key).isNotNull()).distinct(), "position", key)
    return kept(keys.select(key, "position", F.expr(f"position div {size}").alias("block"), F.expr(f"cast(position % {size} as int)").alias("offset")))


def cube_blocks(grid: DataFrame, axis: DataFrame, columns: list[str], key: str = "ticker", date: str = "date") -> DataFrame:
    """date, block, offsets, matrix: the cube in rows of one date and one block of assets each, so that no row holds a whole cross-section. 0 for gaps; assets that a date lacks have no offset there."""
    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    cells = grid.join(axis, key).groupBy(date, "block").agg(F.array_sort(F.collect_list(F.struct("offset", vector.alias("v")))).alias("cells"))
    return cells.select(date, "block", F.transform("cells", lambda x: x["offset"]).alias("offsets"), F.transform("cells", lambda x: x["v"]).alias("matrix"))


def cube_rows(blocks: DataFrame, axis: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """date, key, vector of every cell of a blocked cube."""
    each = blocks.select(date, "block", F.explode(F.arrays_zip(F.col("offsets").alias("offset"), F.col("matrix").alias("vector"))).alias("x")).select(date, "block", "x.*")
    return each.join(axis.select(key, "block", "offset"), ["block", "offset"]).select(date, key, "vector")
