"""As-of joins, trailing windows, forward fill and spines, all partitioned by entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.ranks import positions
from panelspark.sources.landing import kept


def by(keys: list[str] | str, *order: str | Column):
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*order)


def trailing(keys: list[str] | str, order: str, rows: int):
    return by(keys, order).rowsBetween(-(rows - 1), 0)


def history(keys: list[str] | str, order: str):
    return by(keys, order).rowsBetween(Window.unboundedPreceding, 0)


#: Rows of a key are carried on within a block of time, and from block to block. Numbers are cut into blocks of so many units, dates and times into years.
UNITS = 1024


def time_block(df: DataFrame, time: str) -> Column:
    kind = df.schema[time].dataType.typeName()
    return F.year(time) if kind in ("date", "timestamp", "timestamp_ntz") else F.floor(F.col(time) / UNITS) if kind in ("byte", "short", "integer", "long", "float", "double", "decimal") else F.lit(0)


def scanned(df: DataFrame, keys: list[str], order: list[str], block: Column, columns: dict[str, str], local: Callable[[str], Column], carry: Callable[[str], Column], join: Callable[[Column, Column], Column]) -> DataFrame:
    """df with running values (``columns``: result -> input) of each key in the order, a prefix scan in two steps.

    ``local`` runs within (key, block of time). The value at the end of each block is carried over the blocks before by
    ``carry``, one row for each block, and ``join`` puts both together. So a key's rows are spread over tasks by block. df is
    kept, as it is read for the ends and for the result.
    """
    df = kept(df)
    w = by([*keys, "_block"], *order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(by([*keys, "_block"], *order))
    run = df.withColumn("_block", block).withColumns({f"_l_{out}": local(c).over(w) for out, c in columns.items()} | {"_place": place})
    ends = run.groupBy(*keys, "_block").agg(*[F.max_by(f"_l_{out}", "_place").alias(f"_l_{out}") for out in columns])
    back = by(keys, "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.struct(*keys, "_block").alias("_of"), *[carry(f"_l_{out}").over(back).alias(f"_c_{out}") for out in columns])
    joined = run.withColumn("_own", F.struct(*keys, "_block")).join(before, F.col("_own").eqNullSafe(F.col("_of")), "left")
    done = joined.withColumns({out: join(F.col(f"_l_{out}"), F.col(f"_c_{out}")) for out in columns})
    return done.drop("_block", "_place", "_own", "_of", *[f"_{x}_{out}" for out in columns for x in "lc"])


def last_values(df: DataFrame, keys: list[str], order: list[str], block: Column, columns: dict[str, str]) -> DataFrame:
    """df with the last non-null value of each column up to every row of its key."""
    last = lambda c: F.last(c, ignorenulls=True)
    return scanned(df, keys, order, block, columns, last, last, lambda own, before: F.coalesce(own, before))


def as_of(probe: DataFrame, facts: DataFrame, key: str, probe_time: str, fact_time: str, value: str, out: str, spread: bool = False) -> DataFrame:
    """probe with the last non-null ``value`` of its key at or before its time: one shuffle and one sort by (key, time).

    Facts and probes are put in one stream, facts first within a time, and the last value is carried on. ``spread`` deals a
    key's rows over tasks by blocks of time, for keys that hold much of all rows.
    """
    columns = probe.columns
    tagged = probe.withColumn("_t", F.col(probe_time)).withColumn("_tag", F.lit(1)).withColumn("_v", F.lit(None).cast(facts.schema[value].dataType))
    given = facts.select(F.col(key), F.col(fact_time).alias("_t"), F.lit(0).alias("_tag"), F.col(value).alias("_v"))
    both = tagged.unionByName(given, allowMissingColumns=True)
    both = both.drop(out)
    if spread:
        merged = last_values(both, [key], ["_t", "_tag"], time_block(both, "_t"), {out: "_v"})
    else:
        merged = both.withColumn(out, F.last("_v", ignorenulls=True).over(by(key, "_t", "_tag").rowsBetween(Window.unboundedPreceding, 0)))
    return merged.where("_tag = 1").select(*[c for c in columns if c != out], out)


def first_per_key(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row for each key: the first by the order."""
    return df.withColumn("_n", F.row_number().over(by(keys, *order))).where("_n = 1").drop("_n")


def last_per_period(df: DataFrame, keys: list[str], time: str, values: list[str], out_time: str | None = None) -> DataFrame:
    """For each key the last non-null of every value, and the largest time."""
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in values]
    return df.groupBy(*keys).agg(F.max(time).alias(out_time or time), *last)


def forward_fill(df: DataFrame, key: str, time: str, columns: list[str], spread: bool = False, block: Column | None = None) -> DataFrame:
    """Each column's last non-null value up to the row. ``spread`` deals a key's rows over tasks by blocks of time (of ``time``, if no other block is given)."""
    if not spread:
        w = history(key, time)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    filled = last_values(df, [key], [time], time_block(df, time) if block is None else block, {f"_f_{c}": c for c in columns})
    return filled.select(*[F.col(f"_f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def calendar_spine(df: DataFrame, key: str, time: str) -> DataFrame:
    """Every day from a key's first to its last."""
    ends = df.groupBy(key).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    return ends.select(key, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(time))


def resample_daily(panel: DataFrame, key: str, time: str, spread: bool = False) -> DataFrame:
    """One row for each key and day, filled forward; of several rows for a day the last one (by all columns) counts."""
    values = [c for c in panel.columns if c not in (key, time)]
    kept = first_per_key(panel, [key, time], *[F.col(c).desc_nulls_last() for c in values])
    return forward_fill(calendar_spine(panel, key, time).join(kept, [key, time], "left"), key, time, values, spread).select(panel.columns)


#: So many rows of a key are compared with each other in one group.
BLOCK = 1024


def _smaller_before(rows: DataFrame, group: list[str], first: str, then: str, out: str) -> DataFrame:
    """_id and how many rows of its group come before it by ``first`` and by ``then``. Groups are at most a block."""
    each = F.struct(F.col(first).alias("a"), F.col(then).alias("b"), "_id")
    lists = rows.groupBy(*group).agg(F.collect_list(each).alias("l"))
    found = F.transform("l", lambda x: F.struct(x["_id"].alias("_id"), F.size(F.filter("l", lambda y: (y["a"] < x["a"]) & (y["b"] < x["b"]))).cast("long").alias(out)))
    return lists.select(F.explode(found).alias("x")).select("x.*")


def _smaller_in_history(rows: DataFrame, column: str, key: str, block: int) -> DataFrame:
    """rows (_id, key, _pos, column) -> _id, n: the number of earlier rows of the key with a smaller value. For NULL all values are smaller.

    Rows have a place by time, and one by value, later ones first among equal values: so a row counts if it comes before
    in both. Both are cut into blocks. Rows of the same block by time are compared there; those of earlier blocks are
    compared within the same block by value, and the rest are whole cells, earlier in both, whose counts are summed.
    """
    points = positions(rows.select("_id", key, "_pos", column, (-F.col("_pos")).alias("_back")), "_v", [key], F.asc_nulls_last(column), "_back")
    points = kept(points.select("_id", key, "_pos", "_v", F.expr(f"_pos div {block}").alias("i"), F.expr(f"_v div {block}").alias("j")))
    here = _smaller_before(points, [key, "i"], "_pos", "_v", "n")
    aside = _smaller_before(points, [key, "j"], "i", "_v", "n")
    cells = points.groupBy(key, "i", "j").agg(F.count("*").alias("k"))
    ends = points.groupBy(key).agg(F.max("i").alias("i"), F.max("j").alias("j")).where("i > 0")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), c))
    grid = ends.withColumn("i", upto("i")).repartition(key, "i").withColumn("j", upto("j"))
    grid = grid.join(cells, [key, "i", "j"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("k", F.sum("k").over(before(by([key, "j"], "i")))).withColumn("n", F.sum("k").over(before(by([key, "i"], "j"))))
    behind = points.join(grid.where("n > 0").select(key, "i", "j", "n"), [key, "i", "j"]).select("_id", "n")
    return here.unionByName(aside).unionByName(behind).groupBy("_id").agg(F.sum("n").alias("n"))


def historical_percentiles(df: DataFrame, columns: list[str], key: str, time: str, block: int = BLOCK) -> DataFrame:
    """df with each column replaced by the share of the key's rows up to this one whose value is below this one's: 0 for NULL, and NULL before the first value.

    Rows of equal time are ordered by the columns. Where no key has more than ``block`` rows, each key's rows are compared in
    one group, in one shuffle. Otherwise only key, time and the columns are sorted, by time and by value, and the comparison is dealt over
    blocks (``_smaller_in_history``): its work for a key of n rows is n * block + (n / block) ** 2, spread over tasks. Rows
    without key count as one key.
    """
    rows = kept(df.withColumn("_id", F.monotonically_increasing_id()))
    longest = rows.groupBy(key).count().agg(F.max("count")).head()[0] or 0
    names = [f"_x{k}" for k in range(len(columns))]
    values = [F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]
    if longest <= block:

        def share(c: str, x: Column, i: Column) -> Column:
            before = F.slice("l", 1, i)
            return F.when(x[c].isNotNull(), F.size(F.filter(before, lambda y: y[c] < x[c])) / (i + 1)).when(F.exists(before, lambda y: y[c].isNotNull()), 0.0).alias(c)

        own = [c for c in df.columns if c not in columns]
        whole = F.struct(F.col(time).alias("_time"), *values, "_id", F.struct(*own).alias("_own"))
        lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(whole)).alias("l")).select("l")
        found = lists.select(F.explode(F.transform("l", lambda x, i: F.struct(x["_own"].alias("_own"), *[share(c, x, i) for c in names]))).alias("x")).select("x._own.*", *[F.col(f"x.{n}").alias(n) for n in names])
        return found.select(*[F.col(names[columns.index(c)]).alias(c) if c in columns else F.col(c) for c in df.columns])
    narrow = rows.select("_id", F.struct(key).alias("_key"), F.col(time).alias("_time"), *values)
    placed = kept(positions(narrow, "_pos", ["_key"], "_time", *names, "_id"))
    done = placed
    for k, c in enumerate(names):
        less = _smaller_in_history(placed, c, "_key", block).select(F.col("_id").alias(f"_i{k}"), F.col("n").alias(f"_n{k}"))
        done = done.join(less, F.col("_id") == F.col(f"_i{k}"))
    done = done.select(F.col("_id").alias("_at"), *[F.when(F.col(c).isNotNull(), F.col(f"_n{k}") / (F.col("_pos") + 1)).when(F.col(f"_n{k}") > 0, 0.0).alias(c) for k, c in enumerate(names)])
    out = rows.join(done, F.col("_id") == F.col("_at"))
    return out.select(*[F.col(names[columns.index(c)]).alias(c) if c in columns else F.col(c) for c in df.columns])


def rolling_zscore(x: str, keys: str, time: str, rows: int = 12, least: int = 1) -> Column:
    w = trailing(keys, time, rows)
    z = F.try_divide(F.col(x) - F.avg(x).over(w), F.stddev_samp(x).over(w))
    return F.when(F.count(x).over(w) >= least, z)


def cumulative_product(df: DataFrame, x: str, keys: list[str], date: str, then: str, out: str, spread: bool = False) -> DataFrame:
    """df with the product of x over all rows of its keys up to this one, by date and then another column. ``spread`` deals the keys' rows over tasks by year."""
    if spread:
        return scanned(df, list(keys), [date, then], time_block(df, date), {out: x}, F.product, F.product, lambda own, before: own * F.coalesce(before, F.lit(1.0)))
    over = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(date, then)
    return df.withColumn(out, F.product(x).over(over.rowsBetween(Window.unboundedPreceding, 0)))
