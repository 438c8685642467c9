"""Macro and technical indicators: value choice, period ends, wide tables, lookback checks, request planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import available_periods, period_tag, slug, to_day, to_double
from panelspark.operators.stories import distinct_names
from panelspark.operators.windows import last_per_period

OHLCV = ["date", "open", "high", "low", "close", "volume"]
SYNONYMS = ["value", "close", "price", "index"]


def value_field(fields: list[str], wanted: str | None = None) -> str:
    """The payload field that holds an indicator's value: the wanted one, else the only one that isn't a price bar's, else a known synonym."""
    if wanted and wanted in fields:
        return wanted
    rest = [f for f in fields if f not in OHLCV]
    if len(rest) == 1:
        return rest[0]
    for s in SYNONYMS:
        if s in fields:
            return s
    raise ValueError(f"no value field among {fields}")


def resolved_value(values: str | Column, wanted: str | Column) -> Column:
    """The same choice for rows with a map of field values and the wanted field; NULL where there is none."""
    v = F.col(values) if isinstance(values, str) else values
    want = F.col(wanted) if isinstance(wanted, str) else wanted
    rest = F.map_filter(v, lambda k, _: ~k.isin(*OHLCV))
    return F.coalesce(F.try_element_at(v, want), F.when(F.size(rest) == 1, F.map_values(rest)[0]), *[F.try_element_at(v, F.lit(s)) for s in SYNONYMS])


def technical_name(name: str | Column, period: str | Column, timeframe: str | Column) -> Column:
    return F.concat_ws("_", F.lit("tech"), slug(name), F.col(period).cast("string") if isinstance(period, str) else period, slug(timeframe))


def indicator_fits(config: DataFrame, start: Column, end: Column, period: str = "period", timeframe: str = "timeframe") -> DataFrame:
    """Indicators whose lookback is no longer than the periods in the window; unknown timeframes stay."""
    there = available_periods(timeframe, start, end)
    return config.where(there.isNull() | (F.col(period) <= there))


def _last_values(clean: DataFrame, keys: list[str], names: list[str] | None) -> DataFrame:
    """(keys, date, _name, _v) -> keys, the last date, and the last value of each name: one shuffle. Without ``names`` a pass over the data finds them."""
    names = distinct_names(clean, "_name") if names is None else names
    own = lambda c, n: F.when(F.col("_name") == n, F.col(c))
    return clean.groupBy(*keys).agg(F.max("date").alias("date"), *[F.max_by(own("_v", n), own("date", n)).alias(n) for n in names])


def economics_table(long: DataFrame, names: list[str] | None = None, freq: str = "quarterly", name: str = "name", date: str = "date", value: str = "value") -> DataFrame:
    """(name, date, value) -> date, time_range and one econ_* column a name: the last value of each period. One shuffle instead of a join for each series."""
    clean = long.select(F.concat(F.lit("econ_"), slug(name)).alias("_name"), to_day(date).alias("date"), to_double(value).alias("_v")).where("date is not null and _v is not null")
    return _last_values(clean.withColumn("time_range", period_tag("date", freq)), ["time_range"], names)


def technical_table(long: DataFrame, names: list[str] | None = None, freq: str = "quarterly", key: str = "ticker", date: str = "date", value: str = "value") -> DataFrame:
    """(ticker, name, period, timeframe, date, value) -> ticker, date, time_range and one tech_* column an indicator."""
    clean = long.select(key, technical_name("name", "period", "timeframe").alias("_name"), to_day(date).alias("date"), to_double(value).alias("_v")).where("date is not null and _v is not null")
    return _last_values(clean.withColumn("time_range", period_tag("date", freq)), [key, "time_range"], names)


def outer_join_series(series: dict[str, DataFrame], date: str = "date") -> DataFrame:
    """Series (date, value) by full outer joins on date, a column each: the direct form for a few wide inputs."""
    out = None
    for name, df in sorted(series.items()):
        one = df.select(date, F.col("value").alias(name))
        out = one if out is None else out.join(one, date, "full_outer")
    return out


def last_by_period(df: DataFrame, keys: list[str], values: list[str], date: str = "date", freq: str = "quarterly") -> DataFrame:
    """For each key and period the last non-null of each value, and the last date."""
    return last_per_period(df.withColumn("time_range", period_tag(date, freq)), [*keys, "time_range"], date, values)


def request_windows(ranges: DataFrame, days: int, start: str = "start", end: str = "end") -> DataFrame:
    """Each range cut into windows of ``days``; a window ends a minute before the next begins, the last at the range's end."""
    at = F.explode(F.when(F.col(start) < F.col(end), F.sequence(start, end, F.make_interval(days=F.lit(days)))).otherwise(F.array(start)))
    cut = ranges.withColumn("window_start", at).where((F.col("window_start") < F.col(end)) | (F.col(start) >= F.col(end)))
    w = Window.partitionBy(*ranges.columns).orderBy("window_start")
    after = F.lead("window_start").over(w)
    return cut.withColumns({"window": F.row_number().over(w) - 1, "window_end": F.coalesce(after - F.expr("interval 1 minute"), F.col(end))})


def allocate_limits(windows: DataFrame, total: int, keys: list[str] = ()) -> DataFrame:
    """A row budget dealt over each range's windows, the remainder to the first; windows of no budget are left out."""
    n = F.count("*").over(Window.partitionBy(*keys))
    share = F.floor(F.lit(total) / n) + F.when(F.col("window") < F.lit(total) % n, 1).otherwise(0)
    return windows.withColumn("row_limit", share.cast("int")).where("row_limit > 0")


def fetch_summary(planned: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Windows planned, windows with a landed file, articles landed: one row."""
    got = landed.groupBy(*keys).agg(F.sum("articles").alias("articles"))
    return planned.join(got, keys, "left").agg(F.count("*").alias("planned"), F.count("articles").alias("executed"), F.coalesce(F.sum("articles"), F.lit(0)).cast("long").alias("articles"))


def indicator_configs(spark: SparkSession, raw: list[str | dict]) -> DataFrame:
    """Names, or mappings with name and column -> (name, column)."""
    rows = [(r, None) if isinstance(r, str) else (r["name"], r.get("column")) for r in raw]
    return spark.createDataFrame(rows, "name string, column string")
