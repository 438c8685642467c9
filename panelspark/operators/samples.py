"""Model-ready samples: sequences, cross-sections, batches, and their diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import growth
from panelspark.operators.ranks import positions
from panelspark.operators.windows import trailing
from panelspark.sources.landing import kept

SPLITS = ["train", "val", "test"]


def with_sequences(panel: DataFrame, features: list[str], length: int, key: str = "ticker", date: str = "quarter_end_date", out: str = "sequence") -> DataFrame:
    """panel with the feature vectors of the last ``length`` rows of the key, this one last; split borders don't matter. Shorter at the start."""
    vector = F.struct(F.array(*[F.col(c).cast("double") for c in features]).alias("v"))
    return panel.withColumn(out, F.transform(F.collect_list(vector).over(trailing(key, date, length)), lambda s: s["v"]))


def sequence_samples(panel: DataFrame, features: list[str], horizons: list[int], length: int, date: str = "quarter_end_date") -> DataFrame:
    """One row for each eligible panel row (with targets attached): window and horizon ready, all prices and classes there."""
    df = with_sequences(panel, features, length, date=date)
    prices, classes = [F.col(f"future_price_t{h}") for h in horizons], [F.col(f"class_target_t{h}") for h in horizons]
    ready = F.coalesce("window_ready", F.lit(False)) & F.coalesce("horizon_target_ready", F.lit(False)) & (F.size("sequence") == length)
    for c in [*prices, *classes]:
        ready = ready & c.isNotNull()
    return df.where(ready).select(
        "split", "ticker", "time_range", date, F.lit(length).alias("sequence_length"), F.col("sequence").cast("array<array<float>>").alias("features"),
        F.array(*prices).cast("array<float>").alias("price_targets"), F.array(*classes).cast("array<int>").alias("class_targets"),
    )


def window_samples(panel: DataFrame, features: list[str], length: int, date: str = "quarter_end_date") -> DataFrame:
    """The plain form: every full window of a key with enough rows, NULL features as 0, target 0."""
    filled = panel.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}).withColumn("_n", F.count("*").over(Window.partitionBy("ticker")))
    df = with_sequences(filled.where(F.col("_n") >= length), features, length, date=date)
    return df.where(F.size("sequence") == length).select("split", "ticker", "time_range", date, F.col("sequence").alias("features"), F.lit(0.0).alias("target"))


def portfolio_members(panel: DataFrame, features: list[str], horizon: int, length: int, date: str = "quarter_end_date") -> DataFrame:
    """The eligible rows, one for each asset of a sample: flags true (NULL is false), current price, target price and target date there."""
    df = with_sequences(panel, features, length, date=date)
    ok = F.coalesce("window_ready", F.lit(False)) & F.coalesce("horizon_target_ready", F.lit(False))
    for c in ("quarter_price", f"future_price_t{horizon}", f"future_quarter_end_date_t{horizon}"):
        ok = ok & F.col(c).isNotNull()
    return df.where(ok & (F.size("sequence") == length)).select("split", "time_range", date, F.col(f"future_quarter_end_date_t{horizon}").alias("future_quarter_end_date"), "ticker", F.lit(length).alias("sequence_length"), F.col("sequence").alias("features"), F.col("quarter_price").alias("current_price"), F.col(f"future_price_t{horizon}").alias("future_price"))


#: Assets in a row of the blocked portfolio samples, and rows of a key in a row of the sequence store.
ASSETS, ROWS = 4096, 1024


def portfolio_blocks(members: DataFrame, size: int = ASSETS, date: str = "quarter_end_date") -> DataFrame:
    """The samples in rows of at most ``size`` assets: split, time_range, date, block, future_quarter_end_date, ticker_count (of the block), members in order of ticker.

    Assets are numbered over sorted ranges, so a sample of any number of assets spreads over tasks; a block with several
    target dates is an error, and so is a sample (its blocks' dates are compared, one row a block).
    """
    sample = ["split", "time_range", date]
    fields = ["ticker", "sequence_length", "features", "current_price", "future_price"]
    placed = positions(members, "_place", sample, "ticker").withColumn("block", F.expr(f"_place div {size}"))
    out = placed.groupBy(*sample, "block").agg(F.min("future_quarter_end_date").alias("future_quarter_end_date"), F.max("future_quarter_end_date").alias("_last"), F.count("*").cast("int").alias("ticker_count"), F.array_sort(F.collect_list(F.struct(*fields))).alias("members"))
    over = Window.partitionBy(*sample)
    one = F.assert_true(F.min("future_quarter_end_date").over(over) == F.max("_last").over(over), F.lit("a sample has several target dates"))
    return out.withColumn("_ok", one).where("_ok is null").drop("_ok", "_last")


def sequence_store(panel: DataFrame, features: list[str], rows: int = ROWS, key: str = "ticker", date: str = "quarter_end_date") -> tuple[DataFrame, DataFrame]:
    """Feature rows stored once, and where each panel row stands in them -> (store, placed).

    store: key, block, vectors (32-bit; the key's rows in order of date, ``rows`` a block). placed: the panel with block and
    offset of its vector. What is stored doesn't depend on how long sequences are.
    """
    placed = kept(positions(panel, "_place", [key], date).withColumns({"block": F.expr(f"_place div {rows}"), "offset": F.expr(f"cast(_place % {rows} as int)")}).drop("_place"))
    vector = F.array(*[F.col(c).cast("float") for c in features])
    lists = placed.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("offset", vector.alias("v")))).alias("l"))
    return lists.select(key, "block", F.transform("l", lambda x: x["v"]).alias("vectors")), placed


def stored_samples(placed: DataFrame, horizons: list[int], length: int, rows: int = ROWS, key: str = "ticker", date: str = "quarter_end_date") -> DataFrame:
    """The eligible samples (as ``sequence_samples`` has them) with block and offset of their last vector in place of features."""
    df = placed.withColumn("_before", F.col("block") * rows + F.col("offset") + 1)
    prices, classes = [F.col(f"future_price_t{h}") for h in horizons], [F.col(f"class_target_t{h}") for h in horizons]
    ready = F.coalesce("window_ready", F.lit(False)) & F.coalesce("horizon_target_ready", F.lit(False)) & (F.col("_before") >= length)
    for c in [*prices, *classes]:
        ready = ready & c.isNotNull()
    return df.where(ready).select("split", key, "time_range", date, F.lit(length).alias("sequence_length"), "block", "offset", F.array(*prices).cast("array<float>").alias("price_targets"), F.array(*classes).cast("array<int>").alias("class_targets"))


def expanded(found: DataFrame, store: DataFrame, length: int, rows: int = ROWS, key: str = "ticker") -> DataFrame:
    """stored samples with their features: the last ``length`` vectors up to each one's place, from as many blocks as they reach into. For readers; only blocks that samples ask for are joined."""
    back = -(-(length - 1) // rows)
    out = found.withColumn("_v", F.array().cast("array<array<float>>"))
    for k in range(back + 1):
        part = store.select(F.col(key).alias("_key"), (F.col("block") + k).alias("_block"), F.col("vectors").alias("_more"))
        joined = out.join(part, F.col(key).eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")), "left")
        stop = F.col("offset") + 1 if k == 0 else F.lit(rows)
        need = F.least(F.lit(length) - F.size("_v"), stop)
        piece = F.when(need > 0, F.slice(F.coalesce("_more", F.array().cast("array<array<float>>")), stop - need + 1, need)).otherwise(F.array().cast("array<array<float>>"))
        out = joined.withColumn("_v", F.concat(piece, "_v")).drop("_key", "_block", "_more")
    return out.withColumn("features", F.col("_v")).drop("_v", "block", "offset")


def portfolio_samples(members: DataFrame, date: str = "quarter_end_date") -> DataFrame:
    """One row for each (split, period, date), assets sorted by ticker; an error if a sample has several target dates."""
    fields = ["ticker", "sequence_length", "features", "current_price", "future_price"]
    out = members.groupBy("split", "time_range", date).agg(
        F.min("future_quarter_end_date").alias("future_quarter_end_date"), F.max("future_quarter_end_date").alias("_last"),
        F.count("*").cast("int").alias("ticker_count"), F.array_sort(F.collect_list(F.struct(*fields))).alias("members"),
    )
    one = F.assert_true(F.col("future_quarter_end_date") == F.col("_last"), F.lit("a sample has several target dates"))
    return out.withColumn("_ok", one).where("_ok is null").drop("_ok", "_last")


def batches(df: DataFrame, size: int, order: list[str], split: str = "split") -> DataFrame:
    """batch_id: rows of a split in order, ``size`` at a time. Rows are numbered over sorted ranges: no split and no date is numbered in one task."""
    return positions(df, "_place", [split], *order).withColumn("batch_id", F.floor(F.col("_place") / size).cast("int")).drop("_place")


def _with_all_splits(df: DataFrame) -> DataFrame:
    spine = df.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return spine.join(df, "split", "left")


def row_groups(df: DataFrame, date: str = "quarter_end_date") -> DataFrame:
    return df.groupBy("time_range", date).agg(F.countDistinct("ticker").alias("tickers"))


def target_availability(df: DataFrame, horizon: int, date: str = "quarter_end_date") -> DataFrame:
    """By date: tickers, current prices and future prices that are there."""
    return df.groupBy("time_range", date).agg(F.countDistinct("ticker").alias("tickers"), F.count("quarter_price").alias("current_prices"), F.count(f"future_price_t{horizon}").alias("future_prices"))


def samples_per_split(samples: DataFrame, date: str = "quarter_end_date") -> DataFrame:
    """Samples and the list of their dates, for all three splits."""
    got = samples.groupBy("split").agg(F.count("*").alias("samples"), F.array_join(F.array_sort(F.collect_set(F.date_format(date, "yyyy-MM-dd"))), ", ").alias("dates"))
    return _with_all_splits(got).select("split", F.coalesce("samples", F.lit(0)).cast("long").alias("samples"), F.coalesce("dates", F.lit("")).alias("dates"))


def target_matches(df: DataFrame, horizon: int) -> DataFrame:
    """For each split: rows, current prices, target prices, rows with both, eligible rows, and two rates; zeros for empty splits."""
    now, then = F.col("quarter_price").isNotNull(), F.col(f"future_price_t{horizon}").isNotNull()
    ready = F.coalesce("window_ready", F.lit(False)) & F.coalesce("horizon_target_ready", F.lit(False))
    got = df.groupBy("split").agg(F.count("*").alias("rows"), F.count_if(now).alias("current"), F.count_if(then).alias("target"), F.count_if(now & then).alias("matched"), F.count_if(now & then & ready).alias("eligible"))
    names = ["rows", "current", "target", "matched", "eligible"]
    filled = _with_all_splits(got).select("split", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    rate = lambda n: F.coalesce(F.try_divide(n, F.col("rows")), F.lit(0.0))
    return filled.withColumns({"match_rate": rate(F.col("matched")), "eligible_rate": rate(F.col("eligible"))})


def sample_quality(members: DataFrame, date: str = "quarter_end_date") -> DataFrame:
    """For each split: samples, assets, mean assets a sample, and smallest, largest, mean and deviation of asset growth."""
    g = growth("current_price", "future_price")
    got = members.groupBy("split").agg(F.countDistinct("time_range", date).alias("samples"), F.count("*").alias("asset_targets"), F.min(g).alias("growth_min"), F.max(g).alias("growth_max"), F.avg(g).alias("growth_mean"), F.stddev_pop(g).alias("growth_std"))
    out = _with_all_splits(got)
    out = out.withColumn("tickers_mean", F.try_divide(F.col("asset_targets"), F.col("samples")))
    return out.select("split", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("samples", "asset_targets")], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("tickers_mean", "growth_min", "growth_max", "growth_mean", "growth_std")])


def data_summary(panel: DataFrame, samples: DataFrame) -> DataFrame:
    """For each split: panel rows, samples, tickers with samples, mean sequence length."""
    raw = panel.groupBy("split").agg(F.count("*").alias("raw_rows"))
    got = samples.groupBy("split").agg(F.count("*").alias("samples"), F.countDistinct("ticker").alias("tickers"), F.avg("sequence_length").alias("sequence_length"))
    out = _with_all_splits(raw).join(got, "split", "left")
    return out.select("split", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("raw_rows", "samples", "tickers")], F.coalesce("sequence_length", F.lit(0.0)).alias("sequence_length"))


def seeded_sample(df: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """n rows by the MD5 of their keys as text and the seed: the same draw on every run and in every engine. Each task keeps its first n."""
    mark = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.orderBy(mark, *keys).limit(n)


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).dropDuplicates(keys)


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of all splits' rows, tagged; missing columns are NULL."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def scope_rows(df: DataFrame, scope: str) -> DataFrame:
    """Rows of a scope: ``val`` or ``all``."""
    if scope not in ("val", "all"):
        raise ValueError(f"unknown scope {scope!r}: val or all")
    return (df.where(F.col("split") == "val") if scope == "val" else df).withColumn("evaluation_scope", F.lit(scope))
