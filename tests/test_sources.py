"""Landed files in, sinks out, and the stream beside its batch form."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelspark.plans.registry import QUERIES
from panelspark.sources import readers, sinks
from panelspark.sources.landing import write_bundles, write_news
from panelspark.streaming.stories import story_stream


def test_prices(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Ticker;Date;Adj. Close\nNA;2024-01-02;1.5\nA;bad;2\nA;2024-01-03;x\n")
    assert [tuple(r) for r in readers.prices(spark, str(tmp_path / "p.csv")).collect()] == [("NA", dt.date(2024, 1, 2), 1.5)]
    with pytest.raises(ValueError, match="Close"):
        readers.prices(spark, str(tmp_path / "p.csv"), "Close")


def test_cleaned_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("ticker,date,a\nA,2024-01-05,1\nA,2024-02-05,3\nA,,5\n")
    r = readers.fundamental(spark, str(tmp_path / "f.csv")).head()
    assert (r.time_range, r.quarter_end_date, r.a) == ("q1y2024", dt.date(2024, 2, 5), 2.0)
    (tmp_path / "s.csv").write_text('ticker,date,overall_sentiment_score,summary\nA,2024-01-05,0.5,"two\nlines"\nA,x,1,b\n')
    assert readers.stories(spark, str(tmp_path / "s.csv")).head().summary == "two\nlines"
    assert readers.economics(spark, str(tmp_path / "none.csv")).columns == ["time_range", "date"]
    (tmp_path / "e.csv").write_text("date,econ_x\n2024-01-01,1\n2024-02-01,\n")
    assert readers.economics(spark, str(tmp_path / "e.csv")).head().econ_x == 1.0
    (tmp_path / "v.csv").write_text("ticker,quarter_end_date,a,window_ready\nA,2023-10-31,1,True\n")
    r = readers.split_file(spark, str(tmp_path / "v.csv"), "val").head()
    assert (r.quarter_end_date, r.time_range, r.split, r.window_ready) == (dt.date(2023, 12, 31), "q4y2023", "val", True)


def test_payloads(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "GDP.json").write_text(json.dumps([{"date": "2024-01-01", "value": 3}]))
    assert tuple(readers.indicator_payloads(spark, str(tmp_path / "e")).head()) == ("GDP", "2024-01-01", "3")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "A__RSI__14__1day.json").write_text(json.dumps([{"date": "2024-01-01", "close": 3, "rsi": 50.5}]))
    r = readers.technical_payloads(spark, str(tmp_path / "t")).head()
    assert (r.ticker, r["name"], r.period, r.date, r["values"]) == ("A", "RSI", 14, "2024-01-01", {"close": 3.0, "rsi": 50.5})


def test_bundled_payloads(spark, tmp_path):
    rows = spark.createDataFrame([("A__RSI__14__1day", "2024-01-01", "50.5"), ("A__RSI__14__1day", "2024-01-02", "x"), ("B__SMA__5__1day", "2024-01-01", "7")], "name string, date string, rsi string")
    where = write_bundles(rows, F.col("name"), F.struct("date", F.lit("3").alias("close"), "rsi"), str(tmp_path / "b"))
    (tmp_path / "b" / "broken.txt").write_text('{"name": "C__RSI__14__1day", "payl')
    got = sorted(tuple(r) for r in readers.technical_payloads(spark, where, bundled=True).collect())
    a, b = ("A", "RSI", 14, "1day"), ("B", "SMA", 5, "1day")
    assert got == [(*a, "2024-01-01", {"close": 3.0, "rsi": 50.5}), (*a, "2024-01-02", {"close": 3.0}), (*b, "2024-01-01", {"close": 3.0, "rsi": 7.0})]


def test_no_file_a_series(spark):
    """The driver lists every landed file: their number must not follow the number of series."""
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(shared.glob("payloads-*"))
    series = QUERIES["landed_technical_payloads"](spark, "/root/testdata/sf0.001").select("ticker", "name").distinct().count()
    (made,) = set(shared.glob("payloads-*")) - before
    assert len(list(made.rglob("part-*.txt"))) < series


def longest_and_all(folder):
    lines = [len(x) for f in folder.rglob("part=*/part-*.txt") for x in f.read_bytes().splitlines()]
    return max(lines), sum(lines)


@pytest.mark.parametrize(("query", "folder"), [("landed_news", "news-*"), ("partial_sources", "intake-*")])
def test_no_window_is_one_value(spark, query, folder):
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(shared.glob(folder))
    assert QUERIES[query](spark, "/root/testdata/sf0.001").count()
    (made,) = set(shared.glob(folder)) - before
    longest, total = longest_and_all(made)
    assert longest * 20 < total


def test_news_by_line(spark, tmp_path):
    feeds = spark.createDataFrame([("a", "u1"), ("a", "u2\nu3"), ("b", "u4")], "window string, url string")
    where = write_news(feeds, F.col("window"), F.to_json(F.struct(F.array(F.struct("url")).alias("feed"))), str(tmp_path / "n"))
    assert sorted(r.url for r in readers.news(spark, f"{where}/*", lines=True).select(F.explode("feed.url").alias("url")).collect()) == ["u1", "u2\nu3", "u4"]
    (tmp_path / "n/part=a/bad.txt").write_text('{"feed": [{"title": ')
    assert readers.news(spark, f"{where}/*", lines=True).where("feed is not null").count() == 3
    assert readers.news(spark, f"{where}/part=b", strict=True, lines=True).count() == 1
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.news(spark, f"{where}/part=a", strict=True, lines=True).collect()


def test_sweep_and_saved(spark, tmp_path):
    for k in ("1", "2", "notes"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "run.json").write_text(json.dumps({"model_family": "attention", "risk_penalty": 0.1}))
    assert sorted(r.run_id for r in readers.sweep_runs(spark, str(tmp_path)).collect()) == [1, 2]
    with pytest.raises(FileNotFoundError):
        readers.available_scopes(spark, str(tmp_path), "weights")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.date(2024, 3, 31), "train", 1.0)], "ticker string, quarter_end_date date, split string, x double")
    sinks.panel(df, str(tmp_path / "panel"))
    assert spark.read.parquet(str(tmp_path / "panel")).where("split = 'train'").count() == 1
    sinks.metadata(df.agg(F.count("*").alias("rows")), str(tmp_path / "meta"))
    assert json.loads(spark.read.text(str(tmp_path / "meta")).head()[0]) == {"rows": 1}
    with pytest.raises(ValueError, match="unknown"):
        sinks.evaluation({"x": df}, str(tmp_path))
    sinks.predictions(df.select(F.col("x").alias("prediction"), F.col("x").alias("target")), str(tmp_path / "pred"))
    sinks.epochs(df.select(F.lit(1).alias("epoch"), F.lit(2.0).alias("b"), F.lit(1.0).alias("a")), str(tmp_path / "ep"))
    assert spark.read.option("header", True).csv(str(tmp_path / "ep")).columns == ["epoch", "a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("A", at, "u1", "Bullish", 0.5), ("A", at, "u1", "Bullish", 0.5), ("A", at + dt.timedelta(hours=3), "u2", "Bearish", 0.1), ("B", at + dt.timedelta(days=1), "u3", "x", 1.0)]
    schema = "ticker string, published timestamp, url string, overall_sentiment_label string, overall_sentiment_score double"
    batch = spark.createDataFrame(rows, schema)
    late = spark.createDataFrame([("A", at + dt.timedelta(days=9), "u9", "x", 1.0)], schema)
    for k, df in enumerate((batch, late)):
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = story_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("stories_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("stories_out").collect()}
    want = {tuple(r) for r in story_stream(batch).collect()}
    assert got == want and len(want) == 2


def test_one_file_makes_many_tasks(spark, tmp_path):
    lines = [f"T{k % 50};2024-01-{k % 28 + 1:02d};{k}.5;{k};note {k}" for k in range(60_000)]
    lines[30_000] = 'T1;2024-01-02;"broken'  # a field with a break falls apart, and out
    lines.insert(30_001, 'in two";1;x')
    (tmp_path / "p.csv").write_text("Ticker;Date;Adj. Close;Volume;Note\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = readers.prices(spark, str(tmp_path / "p.csv"))
        assert df.rdd.getNumPartitions() >= 8
        assert df.count() == 59_999 and df.agg(F.sum("price")).head()[0] == sum(k + 0.5 for k in range(60_000) if k != 30_000)
        schema = df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].splitlines()[0]
        assert "Volume" not in schema and "Note" not in schema and "Date" in schema
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "s.csv").write_text('ticker,date,overall_sentiment_score,summary\nA,2024-01-05,0.5,"two\nlines"\n')
    landed = readers.landed_text(spark, str(tmp_path / "s.csv"), str(tmp_path / "s"))
    assert readers.stories(spark, landed, landed=True).head().summary == "two\nlines"
