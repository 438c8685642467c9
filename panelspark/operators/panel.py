"""The panel: merge, resample, splits, row state, imputation and scaling fitted on training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import feature_columns, period_tag
from panelspark.operators.quantiles import exact_quantiles
from panelspark.operators.windows import by, resample_daily

KEYS = ["ticker", "time_range"]


@dataclass(frozen=True)
class PanelConfig:
    freq: str = "quarterly"
    sequence_length: int = 16
    min_points: int = 1
    horizon: int = 4
    train: float = 0.7
    val: float = 0.15
    test: float = 0.15
    fill_stories: bool = True
    fill_indicators: bool = False
    approximate_medians: bool = False


def valid_ratios(train: str | Column, val: str | Column, test: str | Column) -> Column:
    """Whether split ratios are non-negative and add up to 1."""
    a, b, c = (F.col(x) if isinstance(x, str) else x for x in (train, val, test))
    return (F.least(a, b, c) >= 0) & (F.abs(a + b + c - 1) <= 1e-6)


def check_ratios(train: float, val: float, test: float) -> None:
    if min(train, val, test) < 0 or abs(train + val + test - 1) > 1e-6:
        raise ValueError(f"split ratios must be non-negative and add up to 1: {train}, {val}, {test}")


def average_by_period(df: DataFrame, key: str = "ticker", date: str = "date", freq: str = "quarterly", end: str = "quarter_end_date") -> DataFrame:
    """Means of all numeric columns by key and period, and the last date."""
    values = feature_columns(df, [key, date])
    tagged = df.where(F.col(key).isNotNull() & F.col(date).isNotNull()).withColumn("time_range", period_tag(date, freq))
    return tagged.groupBy(key, "time_range").agg(F.max(date).alias(end), *[F.avg(F.col(c).cast("double")).alias(c) for c in values])


def merge_panel(fundamental: DataFrame, story: DataFrame | None = None, economics: DataFrame | None = None, technical: DataFrame | None = None) -> DataFrame:
    """Fundamentals with stories and technicals of the same (ticker, time_range) and macro of the same time_range, all left.

    Dates of the right sides are dropped before the joins. Macro has one row a period; Spark broadcasts it if its size allows that.
    """
    out = fundamental
    dates = lambda df: [c for c in df.columns if c not in KEYS and (c == "date" or c.endswith("_date") or c.startswith("quarter_end_date"))]
    if story is not None:
        out = out.join(story.drop(*dates(story)), KEYS, "left")
    if economics is not None:
        econ = economics.drop(*dates(economics))
        out = out.join(econ, "time_range", "left")
    if technical is not None:
        out = out.join(technical.drop(*dates(technical)), KEYS, "left")
    return out


def drop_merge_helpers(df: DataFrame, prefix: str = "quarter_end_date_") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0.0, subset=[c for c in columns if c in df.columns])


def split_boundaries(df: DataFrame, date: str, train: float, val: float) -> DataFrame:
    """One row: train_end and val_end, from the distinct dates of all keys. At least one date trains, one validates if there are over two, one is left to test."""
    days = df.select(F.col(date).alias("d")).where("d is not null").distinct()
    ranked = days.withColumn("k", F.row_number().over(Window.orderBy("d"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    tr0 = F.greatest(F.lit(1), F.floor(F.col("n") * train))
    va0 = F.when(F.col("n") > 2, F.greatest(F.lit(1), F.floor(F.col("n") * val))).otherwise(0)
    over = tr0 + va0 >= F.col("n")
    va1 = F.when(over, F.greatest(F.lit(0), F.col("n") - tr0 - 1)).otherwise(va0)
    still = tr0 + va1 >= F.col("n")
    tr = F.when(still, F.greatest(F.lit(1), F.col("n") - 1)).otherwise(tr0)
    va = F.when(still, 0).otherwise(va1)
    marked = ranked.withColumns({"tr": tr, "va": va})
    return marked.agg(F.max(F.when(F.col("k") == F.col("tr"), F.col("d"))).alias("train_end"), F.max(F.when(F.col("k") == F.col("tr") + F.col("va"), F.col("d"))).alias("val_end"))


def split_of(date: str | Column, train_end: str | Column = "train_end", val_end: str | Column = "val_end") -> Column:
    d, a, b = (F.col(x) if isinstance(x, str) else x for x in (date, train_end, val_end))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(d <= a, "train").when(d <= b, "val").otherwise("test"))


def assign_splits(df: DataFrame, boundaries: DataFrame, date: str) -> DataFrame:
    """df with ``split``; the one row of boundaries is broadcast."""
    return df.crossJoin(F.broadcast(boundaries)).withColumn("split", split_of(date)).drop("train_end", "val_end")


def annotate_rows(df: DataFrame, sequence_length: int, min_points: int, horizon: int, key: str = "ticker", date: str = "quarter_end_date") -> DataFrame:
    """Index in the key's history, whether a window fits before it, whether a target may follow."""
    n = F.count("*").over(Window.partitionBy(key))
    index = F.row_number().over(by(key, date)) - 1
    df = df.withColumns({"ticker_history_index": index, "_n": n})
    return df.withColumns({
        "window_ready": F.col("ticker_history_index") + 1 >= max(sequence_length, min_points),
        "horizon_target_ready": F.col("ticker_history_index") + horizon < F.col("_n"),
    }).drop("_n")


def fit_medians(df: DataFrame, columns: list[str], split: str = "split", approximate: bool = False) -> DataFrame:
    """One row: medians of the training rows (of all rows if none train), 0 where there is no value.

    df is read in a few passes, so it should be a table or kept: exact medians are selected, ``approximate`` ones are one pass of sketches.
    """
    train = df.where(F.col(split) == "train")
    rows = df if train.isEmpty() else train
    if approximate:
        return rows.agg(*[F.coalesce(F.percentile_approx(c, 0.5, 100_000), F.lit(0.0)).alias(c) for c in columns])
    found = exact_quantiles(rows, columns, [0.5])
    return df.sparkSession.range(1).select(*[F.lit(found[c][0] if found[c][0] is not None else 0.0).alias(c) for c in columns])


def impute(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    one = fitted.select(*[F.col(c).alias(f"_m_{c}") for c in columns])
    return df.crossJoin(F.broadcast(one)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}).drop(*one.columns)


def fit_scaling(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """One row: training mean and population deviation of each column; a deviation of about 0 becomes 1."""
    train = df.where(F.col(split) == "train")
    parts = [F.struct(F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"), F.when(F.coalesce(F.stddev_pop(c), F.lit(0.0)) > 1e-8, F.stddev_pop(c)).otherwise(1.0).alias("std")).alias(c) for c in columns]
    return train.agg(*parts)


def standardize(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    one = fitted.select(*[F.col(c).alias(f"_s_{c}") for c in columns])
    return df.crossJoin(F.broadcast(one)).withColumns({c: (F.col(c) - F.col(f"_s_{c}")["mean"]) / F.col(f"_s_{c}")["std"] for c in columns}).drop(*one.columns)


def fitted_long(fitted: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value) rows of a one-row table of fitted values."""
    return fitted.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))).alias("feature", "value"))


def counters(panel: DataFrame, key: str = "ticker", date: str = "quarter_end_date") -> DataFrame:
    """Rows, distinct keys, dates and periods, and rows by split: one row."""
    return panel.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("tickers"), F.countDistinct(date).alias("dates"), F.countDistinct("time_range").alias("periods"), *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "val", "test")])


def to_daily(panel: DataFrame, key: str = "ticker", date: str = "quarter_end_date") -> DataFrame:
    """The panel by day, filled forward; time_range becomes the day."""
    return resample_daily(panel, key, date).withColumn("time_range", period_tag(date, "daily"))
