"""Exact quantiles of whole columns by distributed selection: no task and no buffer ever holds a column's values.

A wanted quantile is one or two order statistics. For each of them a sketch names two
pivots close around it, and a pass counts the values before, at, between and behind them. A
rank that falls on a pivot is found; otherwise it goes on within the open interval where it
lies, about ``1 / accuracy`` of the values. An interval of at most ``gather`` values
is gathered and sorted. All columns and ranks share the passes: two for up to
gather * accuracy / 6 rows (33 million by default), two more for each factor of accuracy / 6
beyond. Every pass takes a pivot out of its interval, so repeated values of any number can't stop it.

``quantiles_by_key`` does it for the rows of each key, over sorted ranges where a key is long.

NaN counts as missing for whole columns, and as the largest value by key. The rank of a quantile p among n values is p * (n - 1); between two
values it is interpolated, as ``percentile`` does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.ranks import positions

GATHER = 20_000
ACCURACY = 10_000
#: Up to so many rows the engine's own exact percentile is taken: its buffers hold no more values than that.
WHOLE = 100_000
#: So many intervals are counted and gathered in one aggregate.
TOGETHER = 32


@dataclass
class _Interval:
    """The values of a column between low and high (neither included; None is open), and the ranks that are looked for in it."""

    column: str
    low: float | None
    high: float | None
    before: int  # values up to low
    count: int
    ranks: list[int]
    pivots: tuple[float, float] | None = None
    values: list[float] | None = field(default=None, repr=False)


def _value(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _within(x: Column, low: float | None, high: float | None) -> Column:
    ok = x.isNotNull()
    if low is not None:
        ok = ok & (x > F.lit(low))
    return ok & (x < F.lit(high)) if high is not None else ok


def _around(places: list[float], accuracy: int) -> list[float]:
    """For each place in an interval (0 to 1) the two that surely lie on either side of it by a sketch of that accuracy."""
    return [min(1.0, max(0.0, p + d / accuracy)) for p in places for d in (-2, 2)]


def _aggregates(df: DataFrame, columns: list[Column]) -> list:
    out: list = []
    for k in range(0, len(columns), TOGETHER):
        out += df.agg(*[c.alias(f"_{i}") for i, c in enumerate(columns[k : k + TOGETHER])]).head()
    return out


def _split(i: _Interval, counts, found: dict[tuple[str, int], float]) -> list[_Interval]:
    """The parts of an interval that still hold ranks; ranks that fall on a pivot are found."""
    a, b = i.pivots
    ends = [(i.low, a, counts["below"]), (a, a, counts["first"]), (a, b, counts["between"]), (b, b, counts["second"])]
    ends.append((b, i.high, i.count - sum(n for _, _, n in ends)))
    out, before = [], i.before
    for low, high, n in ends:
        own = [r for r in i.ranks if before <= r < before + n]
        if own and low is not None and low == high:
            found |= {(i.column, r): low for r in own}
        elif own:
            part = _Interval(i.column, low, high, before, n, own)
            part.values = counts["values"] if (low, high) == (a, b) and len(counts["values"]) == n else None
            out.append(part)
        before += n
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], gather: int = GATHER, accuracy: int = ACCURACY, whole: int = WHOLE) -> dict[str, list[float | None]]:
    """The quantiles of each column, None where it has no values. df is read once in every pass, so it should be a table or kept.

    A table of at most ``whole`` rows takes one pass.
    """
    if df.limit(whole + 1).count() <= whole:
        got = _aggregates(df, [F.percentile(_value(c), F.array(*[F.lit(p) for p in probabilities])) for c in columns])
        return {c: list(q) if q is not None else [None] * len(probabilities) for c, q in zip(columns, got, strict=True)}
    places = _around(probabilities, accuracy)
    first = _aggregates(df, [F.struct(F.count(_value(c)).alias("n"), F.percentile_approx(_value(c), places, accuracy).alias("p")) for c in columns])
    counts = {c: r["n"] for c, r in zip(columns, first, strict=True)}
    at = lambda c, p: p * (counts[c] - 1)
    found: dict[tuple[str, int], float] = {}
    todo: list[_Interval] = []
    for c, r in zip(columns, first, strict=True):
        if not r["n"]:
            continue
        if r["n"] <= gather:
            todo.append(_Interval(c, None, None, 0, r["n"], sorted({f(at(c, p)) for p in probabilities for f in (math.floor, math.ceil)})))
            continue
        for k, p in enumerate(probabilities):
            todo.append(_Interval(c, None, None, 0, r["n"], sorted({math.floor(at(c, p)), math.ceil(at(c, p))}), (r["p"][2 * k], r["p"][2 * k + 1])))
    while todo:
        rough = [i for i in todo if i.count > gather and i.pivots is None]
        if rough:
            where = lambda i: F.when(_within(_value(i.column), i.low, i.high), _value(i.column))
            spots = [_around([(i.ranks[0] - i.before) / i.count, (i.ranks[-1] - i.before) / i.count], accuracy) for i in rough]
            for i, p in zip(rough, _aggregates(df, [F.percentile_approx(where(i), [s[0], s[3]], accuracy) for i, s in zip(rough, spots, strict=True)]), strict=True):
                i.pivots = (p[0], p[1])
        asked = [i for i in todo if i.values is None]
        wanted = []
        for i in asked:
            x, inside = _value(i.column), _within(_value(i.column), i.low, i.high)
            if i.count <= gather:
                wanted.append(F.collect_list(F.when(inside, x)))
                continue
            a, b = (F.lit(p) for p in i.pivots)
            between = inside & (x > a) & (x < b)
            values = F.collect_list(F.when(between, x)) if 6 * i.count <= gather * accuracy else F.array().cast("array<double>")
            wanted.append(F.struct(F.count_if(inside & (x < a)).alias("below"), F.count_if(inside & (x == a)).alias("first"), F.count_if(between).alias("between"), F.count_if(inside & (x == b) & (a != b)).alias("second"), values.alias("values")))
        later = [i for i in todo if i.values is not None]
        for i, got in zip(asked, _aggregates(df, wanted), strict=True):
            if i.count <= gather:
                i.values = got
                later.append(i)
            else:
                later += _split(i, got, found)
        todo = []
        for i in later:
            if i.values is None:
                todo.append(i)
                continue
            ordered = sorted(i.values)
            found |= {(i.column, r): ordered[r - i.before] for r in i.ranks}
    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = []
        for p in probabilities:
            if not counts[c]:
                out[c].append(None)
                continue
            pos = at(c, p)
            low, high = found[c, math.floor(pos)], found[c, math.ceil(pos)]
            out[c].append(low if low == high else (math.ceil(pos) - pos) * low + (pos - math.floor(pos)) * high)
    return out


def quantiles_by_key(df: DataFrame, key: str, columns: list[str], probabilities: list[float], whole: int = WHOLE) -> DataFrame:
    """One row a key (no null): an array of quantiles for each column, null where the key has no values of it. df is read three times, so it should be a table or kept.

    Where no key has over ``whole`` rows, this is an aggregate by key. Otherwise values are placed within (key, column) over
    sorted ranges, and met by place with the one or two places that each quantile lies between: no task and no buffer holds
    a key's values, and keys of any length spread over tasks.
    """
    df = df.where(F.col(key).isNotNull())
    rows = df.groupBy(key).count()
    if (rows.agg(F.max("count")).head()[0] or 0) <= whole:
        return df.groupBy(key).agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probabilities])).alias(c) for c in columns])
    item = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])).alias("_i")
    placed = positions(df.select(key, item).select(key, "_i.*").where("_v is not null"), "_place", [key, "_c"], "_v")
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("_at")) for k, p in enumerate(probabilities)])).alias("_q")
    wanted = placed.groupBy(key, "_c").agg(F.count("*").alias("_n")).select(key, "_c", asked).select(key, "_c", "_q.*")
    wanted = wanted.withColumn("_place", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    found = placed.join(wanted, [key, "_c", "_place"]).groupBy(key, "_c", "_k").agg(F.first("_at").alias("_at"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    between = (F.ceil("_at") - F.col("_at")) * F.col("_low") + (F.col("_at") - F.floor("_at")) * F.col("_high")
    found = found.withColumn("_v", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between))
    one = lambda i, k: F.max(F.when((F.col("_c") == i) & (F.col("_k") == k), F.col("_v")))
    wide = found.groupBy(key).agg(*[F.array(*[one(i, k) for k in range(len(probabilities))]).alias(c) for i, c in enumerate(columns)])
    return rows.drop("count").join(wide, key, "left").select(key, *[F.when(F.col(c)[0].isNotNull(), F.col(c)).alias(c) for c in columns])


def literal(x: float | None) -> Column:
    return F.lit(x).cast("double")
