"""Numbers and historical shares of keys that hold most rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import samples, windows
from panelspark.operators.ranks import positions, ranked


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def skewed(spark, n):
    """A key with most of the rows, a null one, and small ones; values with ties and gaps; equal times."""
    k = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None).otherwise(F.concat(F.lit("k"), F.col("id") % 23))
    v = F.when(F.col("id") % 6 != 0, F.round(F.rand(2) * 40))
    return spark.range(n).select(k.alias("k"), F.floor(F.col("id") / 3).alias("t"), v.alias("a"), F.when(F.col("id") > n // 2, F.rand(3)).alias("b"), F.col("id").alias("row")).repartition(5).persist()


def test_positions(uncoalesced):
    df = skewed(uncoalesced, 900)
    for run in (7, 50_000):
        got = positions(df, "p", ["k"], "t", "row", run=run).toPandas().sort_values(["t", "row"])
        assert (got["p"] == got.groupby("k", dropna=False).cumcount()).all() and len(got) == 900
    assert [r.r for r in ranked(df, "r", F.desc("row")).orderBy("row").collect()] == list(range(899, -1, -1))
    hot = uncoalesced.range(4000).select(F.lit(1).alias("same"))
    spread = [r["count"] for r in positions(hot, "p", ["same"], run=500).groupBy(F.spark_partition_id()).count().collect()]
    assert len(spread) > 2 and max(spread) < 3000
    assert positions(df.limit(0), "p", ["k"], "t").collect() == []


def shares(df):
    """pandas: the share of the key's rows up to this one that are below it."""
    p = df.toPandas().sort_values(["t", "a", "b", "row"], na_position="first")
    out = {}
    for _, g in p.groupby("k", dropna=False):
        for c in ("a", "b"):
            seen = []
            for row, v in zip(g["row"], g[c], strict=True):
                seen.append(v)
                values = [x for x in seen if pd.notna(x)]
                out[row, c] = sum(x < v for x in values) / len(seen) if pd.notna(v) else (0.0 if values else None)
    return out


@pytest.mark.parametrize("block", [1024, 16, 3])
def test_historical_percentiles(spark, block):
    df = skewed(spark, 400)
    df = df.withColumn("t", F.struct("t", "a", "b", "row"))  # no order is left open
    want = shares(df.select("k", F.col("t.t").alias("t"), "a", "b", "row"))
    got = windows.historical_percentiles(df, ["a", "b"], "k", "t", block)
    assert got.columns == df.columns and "Python" not in got._jdf.queryExecution().toString() and "MapInArrow" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        for c in ("a", "b"):
            x, y = r[c], want[r.row, c]
            assert (x is None and y is None) or abs(x - y) < 1e-12, (r.row, c, x, y)
    assert windows.historical_percentiles(df.limit(0), ["a"], "k", "t", block).collect() == []


def test_a_long_key_spreads(uncoalesced):
    df = uncoalesced.range(20_000).select(F.lit("one").alias("k"), F.col("id").alias("t"), F.rand(1).alias("a"))
    got = windows.historical_percentiles(df, ["a"], "k", "t", 256)
    per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) >= 4 and max(per_task) < 8000
    p = df.toPandas()["a"]
    some = {r.t: r.a for r in got.where("t % 997 = 0").collect()}
    assert all(abs(some[t] - (p[: t + 1] < p[t]).sum() / (t + 1)) < 1e-12 for t in some)


def test_batches_of_one_hot_date(uncoalesced):
    df = uncoalesced.range(1000).select(F.lit("train").alias("split"), F.lit("d").alias("date"), F.col("id").alias("ticker"))
    got = samples.batches(df, 64, ["date", "ticker"])
    assert all(r.batch_id == r.ticker // 64 for r in got.collect())


def test_carried_values_of_a_long_key(uncoalesced):
    """A key with most rows over forty years: the same as one window by key, in several tasks."""
    day = F.date_add(F.lit("1980-01-01").cast("date"), (F.col("id") % 15_000).cast("int"))
    k = F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, None).otherwise("cold")
    df = uncoalesced.range(15_000).select(k.alias("k"), day.alias("d"), F.when(F.rand(1) < 0.01, F.rand(2)).alias("v"), (1 + F.rand(3) / 1000).alias("g"), F.lit("s").alias("s"), "id").persist()
    w = windows.history("k", "d")
    want = {r.id: (r.f, r.p) for r in df.select("id", F.last("v", ignorenulls=True).over(w).alias("f"), F.product("g").over(w).alias("p")).collect()}
    filled = windows.forward_fill(df, "k", "d", ["v"], spread=True)
    assert filled.columns == df.columns and {r.id: r.v for r in filled.collect()} == {i: f for i, (f, _) in want.items()}
    product = windows.cumulative_product(df, "g", ["k"], "d", "s", "p", spread=True)
    assert all(abs(r.p / want[r.id][1] - 1) < 1e-9 for r in product.collect())
    for out in (filled, product):
        per = [r["count"] for r in out.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
        assert len(per) >= 4 and max(per) < 6000
    facts = df.where("v is not null").select("k", F.col("d").alias("at"), "v")
    probe = df.select("k", "d", "id")
    for spread in (False, True):
        got = {r.id: r.v for r in windows.as_of(probe, facts, "k", "d", "at", "v", "v", spread).collect()}
        assert got == {i: f for i, (f, _) in want.items()}
    assert windows.forward_fill(df.limit(0), "k", "d", ["v"], spread=True).collect() == []
    everything = windows.cumulative_product(df.where("k = 'cold'"), "g", [], "d", "s", "p", spread=True).collect()
    assert all(abs(r.p / want[r.id][1] - 1) < 1e-9 for r in everything)
