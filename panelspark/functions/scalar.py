"""Column functions. Missing values are NULL throughout, never NaN; all are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-8

# ---- arithmetic ------------------------------------------------------------------


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def divide(n: str | Column, d: str | Column) -> Column:
    """n / d, NULL where d is 0."""
    return F.try_divide(col(n), col(d))


def ieee_divide(n: str | Column, d: str | Column) -> Column:
    """n / d with a signed infinity where only d is 0, NULL for 0 / 0: for comparisons of ratios."""
    n, d = col(n), col(d)
    return F.when(d != 0, n / d).when((d == 0) & (n > 0), F.lit(float("inf"))).when((d == 0) & (n < 0), F.lit(float("-inf")))


def clip(x: str | Column, low: Column | float | None, high: Column | float | None) -> Column:
    """x within [low, high]; NULL stays NULL, and a NULL bound does nothing."""
    x = col(x)
    out = x
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    return F.when(x.isNotNull(), out)


def finite(x: str | Column) -> Column:
    """NaN and infinities become NULL."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def first_of(df: DataFrame, names: list[str], default: float | None = None) -> Column:
    """The first non-null of those columns that df has, else the default."""
    there = [F.col(f"`{n}`").cast("double") for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(default).cast("double"))


def with_floor(x: str | Column, floor: float) -> Column:
    """Values under the floor become NULL."""
    return F.when(col(x) >= floor, col(x))


def forward_return(now: str | Column, then: str | Column) -> Column:
    return divide(col(then) - col(now), now)


def growth(now: str | Column, then: str | Column) -> Column:
    """then / now, with now at least EPS."""
    return F.when(col(now).isNotNull(), col(then) / F.greatest(col(now), F.lit(EPS)))


def return_class(r: str | Column, threshold: float) -> Column:
    """0 below -threshold, 2 above threshold, 1 between and on the borders; NULL for NULL."""
    r = col(r)
    return F.when(r < -threshold, 0).when(r > threshold, 2).when(r.isNotNull(), 1)


def drawdown(g: str | Column) -> Column:
    return F.greatest(1 - col(g), F.lit(0.0))


def to_double(x: str | Column) -> Column:
    """A number where the text is one, else NULL."""
    return finite(col(x).try_cast("double"))


# ---- dates and periods -----------------------------------------------------------

_FREQUENCIES = {"d": "daily", "day": "daily", "daily": "daily", "q": "quarterly", "quarter": "quarterly", "quarterly": "quarterly"}


def frequency(name: str) -> str:
    """daily or quarterly, from any of its names; an error otherwise."""
    try:
        return _FREQUENCIES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown frequency {name!r}: one of {sorted(_FREQUENCIES)}") from None


def period_tag(d: str | Column, freq: str = "quarterly") -> Column:
    """q1y2024, or the ISO day."""
    d = col(d)
    if frequency(freq) == "daily":
        return F.date_format(d, "yyyy-MM-dd")
    return F.when(d.isNotNull(), F.concat(F.lit("q"), F.quarter(d), F.lit("y"), F.year(d)))


def quarter_end(d: str | Column) -> Column:
    return F.last_day(F.add_months(F.trunc(col(d), "quarter"), 2))


def previous_quarter_end(d: str | Column) -> Column:
    return F.date_sub(F.trunc(col(d), "quarter"), 1)


def period_end(d: str | Column, freq: str) -> Column:
    return F.to_date(col(d)) if frequency(freq) == "daily" else quarter_end(d)


def shift_period(d: str | Column, h: Column | int, freq: str) -> Column:
    """The period end h quarters (or days) after the period end d."""
    h = h if isinstance(h, Column) else F.lit(h)
    return F.date_add(col(d), h) if frequency(freq) == "daily" else F.last_day(F.add_months(col(d), h * 3))


def api_timestamp(s: str | Column) -> Column:
    return F.try_to_timestamp(col(s), F.lit("yyyyMMdd'T'HHmm"))


def published_timestamp(s: str | Column) -> Column:
    return F.try_to_timestamp(col(s), F.lit("yyyyMMdd'T'HHmmss"))


def format_api_timestamp(t: str | Column) -> Column:
    return F.date_format(col(t), "yyyyMMdd'T'HHmm")


def api_date(t: str | Column) -> Column:
    return F.date_format(col(t), "yyyy-MM-dd")


def to_day(s: str | Column) -> Column:
    """A date where the text starts with one, else NULL."""
    return F.coalesce(F.expr("null").cast("date"), F.to_date(F.try_to_timestamp(F.substring(col(s).cast("string"), 1, 10), F.lit("yyyy-MM-dd"))))


def available_periods(timeframe: str | Column, start: str | Column, end: str | Column) -> Column:
    """How many periods of e.g. 15min, 4hour, 1day or 1month lie in [start, end]; NULL for other names."""
    t, a, b = F.lower(F.trim(col(timeframe))), col(start).cast("timestamp"), col(end).cast("timestamp")
    n = F.regexp_extract(t, r"^(\d+)(min|hour|day|month)$", 1).try_cast("int")
    unit = F.regexp_extract(t, r"^(\d+)(min|hour|day|month)$", 2)
    days = F.datediff(b, a) + 1
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) + 1
    span = F.when(unit == "month", months).when(unit == "day", days).when(unit == "hour", days * 24).when(unit == "min", days * 1440)
    return F.when(n > 0, F.floor(span / n)).cast("int")


# ---- text ------------------------------------------------------------------------


def topic_slug(s: str | Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(col(s))), "[^0-9a-z]+", "_"), F.lit("_"))


def slug(s: str | Column) -> Column:
    t = topic_slug(s)
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("value")).otherwise(t)


def is_bullish(label: str | Column) -> Column:
    return F.contains(F.lower(F.coalesce(col(label), F.lit(""))), F.lit("bullish"))


def is_bearish(label: str | Column) -> Column:
    return F.contains(F.lower(F.coalesce(col(label), F.lit(""))), F.lit("bearish"))


def sample_key(split: str | Column, period: str | Column, d: str | Column) -> Column:
    return F.concat_ws("__", col(split), col(period), F.date_format(col(d), "yyyy-MM-dd"))


def strategy_label(run_id: str | Column, family: str | Column, risk: str | Column, concentration: str | Column) -> Column:
    return F.format_string("%s | run %s | risk=%s | conc=%s", col(family), col(run_id).cast("string"), col(risk).cast("string"), col(concentration).cast("string"))


def model_family(name: str | Column, target: str | Column) -> Column:
    """The configured name, else the last part of the class path, in lower case."""
    return F.coalesce(F.nullif(F.trim(col(name)), F.lit("")), F.lower(F.regexp_extract(col(target), r"([^.]+)$", 1)))


_TOPIC = "struct<topic:string,relevance_score:string>"


def topics(json: str | Column) -> Column:
    """array<struct<topic, score>> of a JSON list; other items and other JSON are skipped, bad scores are 0."""
    items = F.coalesce(F.from_json(col(json), "array<string>"), F.array().cast("array<string>"))
    parsed = F.filter(F.transform(items, lambda x: F.from_json(x, _TOPIC)), lambda t: F.coalesce(t["topic"], F.lit("")) != "")
    return F.transform(parsed, lambda t: F.struct(topic_slug(t["topic"]).alias("topic"), F.coalesce(to_double(t["relevance_score"]), F.lit(0.0)).alias("score")))


# ---- arrays ----------------------------------------------------------------------


def arg_max(values: str | Column) -> Column:
    """The place of the first largest value, from 0."""
    return (F.array_position(col(values), F.array_max(col(values))) - 1).cast("int")


def linear(features: str | Column, weights: list[float], bias: float) -> Column:
    """w . x + b of an array column."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(col(features), w, lambda a, b: a * b), F.lit(float(bias)), lambda s, x: s + x)


def log_sum_exp(values: str | Column) -> Column:
    v = col(values)
    top = F.array_max(v)
    return top + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def pad_sequence(sequence: str | Column, length: int, width: int) -> Column:
    """A sequence of feature vectors, with vectors of zeros up to ``length``."""
    s = col(sequence)
    zero = F.array_repeat(F.lit(0.0), width)
    return F.concat(s, F.array_repeat(zero, F.greatest(F.lit(length) - F.size(s), F.lit(0))))


def mask(sequence: str | Column, length: int) -> Column:
    """True where a padded sequence holds data."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i <= F.size(col(sequence)))


# ---- schemas ---------------------------------------------------------------------


def feature_columns(df: DataFrame, exclude: list[str] = (), wanted: list[str] | None = None, exclude_prefixes: tuple[str, ...] = ()) -> list[str]:
    """The wanted columns, or all numeric and boolean ones; less the excluded. An error names wanted columns that are missing or not numeric."""
    number = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType | T.BooleanType)}
    drop = lambda c: c in set(exclude) or c.startswith(tuple(exclude_prefixes) or ("\0",))
    if wanted:
        if bad := [c for c in wanted if c not in number]:
            raise ValueError(f"not numeric columns of the table: {bad}")
        return [c for c in wanted if not drop(c)]
    return [c for c in df.columns if c in number and not drop(c)]


def feature_profile(names: list[str]) -> dict[str, int]:
    """How many features each family has, by prefix."""
    families = {"economics": "econ_", "technical": "tech_", "topics": "topic_relevance_"}
    return {k: sum(n.startswith(p) for n in names) for k, p in families.items()} | {"all": len(names)}
