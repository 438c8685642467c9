"""Exact quantiles against the engine's own exact percentile, and under a small heap."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelspark.operators.quantiles import exact_quantiles, quantiles_by_key

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def same(df, columns, **how):
    want = df.agg(*[F.percentile(F.when(~F.isnan(c), F.col(c)), F.array(*[F.lit(p) for p in PROBABILITIES])).alias(c) for c in columns]).head()
    got = exact_quantiles(df, columns, PROBABILITIES, whole=0, **how)
    assert exact_quantiles(df, columns, PROBABILITIES) == got
    for c in columns:
        assert got[c] == (want[c] or [None] * len(PROBABILITIES)), c


@pytest.mark.parametrize(("gather", "accuracy"), [(20_000, 10_000), (50, 100), (1, 7), (300, 20)])
def test_like_percentile(spark, gather, accuracy):
    x = F.rand(3)
    df = spark.range(5000).select(
        x.alias("even"), F.exp(20 * F.rand(4)).alias("wide"), F.floor(x * 3).cast("double").alias("few"), F.lit(2.5).alias("one"), F.when(F.rand(5) < 0.98, 7.0).otherwise(F.rand(6) + 7).alias("hot"),
        F.when(F.col("id") < 3, F.col("id").cast("double")).alias("rare"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") % 9 == 0, float("nan")).when(F.col("id") % 11 == 0, float("inf")).otherwise(-F.col("id")).alias("odd"),
    ).persist()
    same(df, df.columns, gather=gather, accuracy=accuracy)


def test_empty(spark):
    assert exact_quantiles(spark.range(0).select(F.col("id").alias("a")), ["a"], [0.5]) == {"a": [None]}


def test_by_key(spark):
    """Long keys over sorted ranges give what the engine's percentile by key gives: a key with most rows, keys without values, null keys, ties, NaN."""
    key = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 == 0, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).when(F.col("id") == 3, "alone")
    df = spark.range(3000).select(key.alias("k"), F.rand(3).alias("even"), (F.col("id") % 4).alias("few"), F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.rand(4)).alias("odd"), F.when(F.col("id") != 3, F.rand(5)).alias("gaps")).persist()
    columns = ["even", "few", "odd", "gaps"]
    want, got = ({r.k: r for r in quantiles_by_key(df, "k", columns, PROBABILITIES, whole).collect()} for whole in (10**6, 100))
    assert None not in got and set(got) == set(want) and got["alone"].gaps is None
    for k in want:
        for c in columns:
            assert str(got[k][c]) == str(want[k][c]), (k, c)
    assert quantiles_by_key(df.limit(0), "k", columns, [0.5]).count() == 0


SMALL = """
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from panelspark.operators.quantiles import exact_quantiles, quantiles_by_key
conf = {"spark.driver.memory": "512m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
n = 10_000_000
df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"))
print(exact_quantiles(df, ["a", "b"], [0.01, 0.5, 0.99]))
"""


def test_ten_million_distinct_values_under_a_small_heap():
    done = subprocess.run([sys.executable, "-c", SMALL], capture_output=True, text=True, cwd=Path(__file__).parents[1], timeout=600)
    last = 9_999_999
    want = {"a": [0.01 * last, 0.5 * last, 0.99 * last], "b": [-0.99 * last, -0.5 * last, -0.01 * last]}
    got = eval(done.stdout.strip().splitlines()[-1])  # noqa: S307
    assert all(abs(x - y) < 1e-6 for c in want for x, y in zip(got[c], want[c], strict=True)), done.stderr[-2000:]
