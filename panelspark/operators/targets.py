"""Prices at period ends and calendar-exact forward targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import forward_return, period_end, period_tag, return_class, shift_period


def period_prices(prices: DataFrame, freq: str = "quarterly", key: str = "ticker", date: str = "date", price: str = "price", end: str = "quarter_end_date") -> DataFrame:
    """The last price of each key in each period, under the period's calendar end."""
    clean = prices.where(F.col(key).isNotNull() & F.col(date).isNotNull() & F.col(price).isNotNull())
    return clean.groupBy(key, period_end(date, freq).alias(end)).agg(F.max_by(price, F.struct(F.col(date), F.col(price))).alias("quarter_price")).withColumn("time_range", period_tag(end, freq))


def _ahead(prices: DataFrame, horizons: list[int], threshold: float, freq: str, key: str, end: str) -> DataFrame:
    """prices with a struct _t{h} of future_date, future_price, future_return, class_target for each horizon.

    A frame holds just the period h after, by its number, so all horizons share one window.
    """
    number = F.unix_date(end) if period_is_day(freq) else F.year(end) * 4 + F.quarter(end)
    over = Window.partitionBy(key).orderBy(number)
    found = prices.withColumns({f"_p{h}": F.max("quarter_price").over(over.rangeBetween(h, h)) for h in horizons})
    back = {h: forward_return("quarter_price", f"_p{h}") for h in horizons}
    made = {f"_t{h}": F.struct(F.when(F.col(f"_p{h}").isNotNull(), shift_period(end, h, freq)).alias("future_date"), F.col(f"_p{h}").alias("future_price"), back[h].alias("future_return"), return_class(back[h], threshold).alias("class_target")) for h in horizons}
    return found.withColumns(made).drop(*[f"_p{h}" for h in horizons])


def future_prices(prices: DataFrame, horizons: list[int], threshold: float = 0.02, freq: str = "quarterly", key: str = "ticker", end: str = "quarter_end_date") -> DataFrame:
    """Long form: one row for each period price and horizon with future_date, future_price, future_return, class_target; NULL where no row lies exactly there.

    prices has one row for each key and period, as ``period_prices`` gives them.
    """
    wide = _ahead(prices, horizons, threshold, freq, key, end)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_t{h}").alias("t")) for h in horizons]))
    return wide.withColumn("_t", each).select(*prices.columns, "_t.horizon", "_t.t.*")


def attach_targets(prices: DataFrame, horizons: list[int], threshold: float = 0.02, freq: str = "quarterly", key: str = "ticker", end: str = "quarter_end_date") -> DataFrame:
    """Wide form: for each horizon h future_quarter_end_date_t{h}, future_price_t{h}, future_return_t{h}, class_target_t{h}. One shuffle, by key."""
    wide = _ahead(prices, horizons, threshold, freq, key, end)
    names = {"future_date": "future_quarter_end_date", "future_price": "future_price", "future_return": "future_return", "class_target": "class_target"}
    return wide.select(key, end, "time_range", "quarter_price", *[F.col(f"_t{h}.{c}").alias(f"{n}_t{h}") for h in horizons for c, n in names.items()])


def with_targets(panel: DataFrame, targets: DataFrame, end: str = "quarter_end_date") -> DataFrame:
    return panel.join(targets, ["ticker", end, "time_range"], "left")


def universe_prices(prices: DataFrame, panel: DataFrame, horizons: list[int], freq: str = "quarterly", strict_window: bool = False, end: str = "quarter_end_date") -> DataFrame:
    """Prices of the panel's keys from its first date to its last target date.

    The window starts at the first day of the first period, so that its last price is in; with ``strict_window`` it starts at
    the first period end itself.
    """
    ends = panel.agg(F.min(end).alias("_a"), F.max(end).alias("_b"))
    first = F.col("_a") if strict_window or period_is_day(freq) else F.trunc("_a", "quarter")
    bounds = ends.select(first.alias("_a"), shift_period("_b", max(horizons), freq).alias("_b"))
    kept = prices.join(panel.select("ticker").distinct(), "ticker", "left_semi").crossJoin(F.broadcast(bounds))
    return kept.where(F.col("date").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def period_is_day(freq: str) -> bool:
    from panelspark.functions.scalar import frequency

    return frequency(freq) == "daily"
