"""Hand cases, and pandas as a second opinion."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import checks, indicators, panel, portfolio, predictions, samples, statements, stories, targets, windows
from panelspark.plans import jobs


def rows(df):
    return [tuple(r) for r in df.collect()]


def day(s):
    return dt.date.fromisoformat(s)


@pytest.fixture
def quarters(spark):
    ends = ["2020-03-31", "2020-06-30", "2020-09-30", "2020-12-31", "2021-03-31"]
    return spark.createDataFrame([("A", day(e), p) for e, p in zip(ends, [100.0, 101.0, 98.0, 100.0, 120.0], strict=True)], "ticker string, date date, price double")


def test_targets(quarters):
    t = targets.attach_targets(targets.period_prices(quarters), [1, 2]).orderBy("quarter_end_date").collect()
    assert (t[0].future_price_t1, t[0].future_price_t2) == (101, 98)
    assert (t[0].class_target_t1, t[0].class_target_t2) == (1, 1)
    assert t[3].class_target_t1 == 2
    assert t[4].future_price_t1 is None and t[4].class_target_t1 is None and t[4].future_quarter_end_date_t1 is None


def test_missing_quarter_has_no_target(quarters):
    gap = quarters.where("date <> DATE '2020-06-30'")
    t = targets.attach_targets(targets.period_prices(gap), [1]).orderBy("quarter_end_date").collect()
    assert t[0].future_price_t1 is None and t[1].future_price_t1 == 100


def test_daily_horizons(spark):
    p = spark.createDataFrame([("A", day(d), v) for d, v in [("2024-01-01", 100.0), ("2024-01-02", 101.0), ("2024-01-08", 107.0), ("2024-01-31", 130.0)]], "ticker string, date date, price double")
    t = targets.future_prices(targets.period_prices(p, "daily"), [1, 7, 30], freq="daily").where("quarter_end_date = DATE '2024-01-01'").orderBy("horizon")
    assert [r.future_price for r in t.collect()] == [101, 107, 130]


def test_strict_window(spark):
    p = spark.createDataFrame([("A", day("2024-03-28"), 1.0), ("A", day("2024-06-28"), 2.0)], "ticker string, date date, price double")
    f = spark.createDataFrame([("A", day("2024-03-31"))], "ticker string, quarter_end_date date")
    assert targets.universe_prices(p, f, [1]).count() == 2
    assert targets.universe_prices(p, f, [1], strict_window=True).count() == 1


def test_as_of(spark):
    f = spark.createDataFrame([("A", 1, 10.0), ("A", 3, None), ("A", 5, 50.0)], "k string, t int, v double")
    p = spark.createDataFrame([("A", 0), ("A", 3), ("A", 5), ("B", 9)], "k string, at int")
    assert sorted(rows(windows.as_of(p, f, "k", "at", "t", "v", "v")), key=str) == sorted([("A", 0, None), ("A", 3, 10.0), ("A", 5, 50.0), ("B", 9, None)], key=str)


def test_windows_like_pandas(spark):
    v = [None, 3.0, 1.0, None, 5.0, 5.0, 2.0]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(v)], "k string, t int, v double")
    s = pd.Series(v, dtype=float)
    z = (s - s.rolling(3, 1).mean()) / s.rolling(3, 1).std()
    share = s.expanding(1).apply(lambda w: (w < w.iloc[-1]).sum() / len(w))
    df = df.withColumn("z", windows.rolling_zscore("v", "k", "t", 3)).withColumn("p", F.col("v"))
    got = windows.historical_percentiles(df, ["p"], "k", "t").orderBy("t").collect()
    for r, a, b in zip(got, z, share, strict=True):
        assert (r.z is None) == math.isnan(a) and (r.z is None or abs(r.z - a) < 1e-12)
        assert (r.p is None) == math.isnan(b) and (r.p is None or abs(r.p - b) < 1e-12)


def test_daily_resample(spark):
    df = spark.createDataFrame([("A", day("2024-01-01"), 1.0, "x"), ("A", day("2024-01-03"), None, "y"), ("A", day("2024-01-03"), 2.0, "y")], "ticker string, d date, v double, s string")
    assert rows(windows.resample_daily(df, "ticker", "d").orderBy("d")) == [("A", day("2024-01-01"), 1, "x"), ("A", day("2024-01-02"), 1, "x"), ("A", day("2024-01-03"), 2, "y")]


def test_story_aggregation(spark):
    s = spark.createDataFrame(
        [("A", "q1y2024", "2024-01-02", 0.2, 0.1, 0.5, "Bullish", '[{"topic":"Earnings","relevance_score":"0.9"},{"topic":"IPO","relevance_score":"0.4"}]'), ("A", "q1y2024", "2024-01-03", 0.0, -0.1, 0.5, "Bearish", '[{"topic":"Earnings","relevance_score":"0.5"}]')],
        "ticker string, time_range string, date string, overall_sentiment_score double, ticker_sentiment_score double, ticker_relevance_score double, overall_sentiment_label string, topics_json string",
    )
    r = stories.story_features(s).head()
    assert (r.story_count, r.overall_sentiment_mean, r.ticker_sentiment_mean) == (2, 0.1, 0.0)
    assert abs(r.bullish_bearish_ratio - 1) < 1e-6
    assert (r.topic_relevance_earnings, r.topic_relevance_ipo) == (0.7, 0.2)
    one = spark.createDataFrame([("A", "p", '[{"topic":"X","relevance_score":"1"},{"topic":"x","relevance_score":"0.5"}]')], "ticker string, time_range string, topics_json string")
    assert stories.topic_relevance(one).head().relevance == 0.5


def test_story_rows_and_dedup(spark, tmp_path):
    import json

    from panelspark.sources import readers

    mention = lambda t: {"ticker": t, "relevance_score": "0.5", "ticker_sentiment_score": "0.1", "ticker_sentiment_label": "Neutral"}
    article = lambda u, at, *t: {"title": "t", "url": u, "time_published": at, "overall_sentiment_score": 0.3, "authors": ["a"], "topics": [{"topic": "IPO", "relevance_score": "1"}], "ticker_sentiment": [mention(x) for x in t]}
    feed = {"feed": [article("u1", "20240102T030405", "AAA", "BBB"), article("u1", "20240102T030405", "AAA"), article("u2", "20240103T000000", "ZZZ"), article("u3", "later", "AAA"), article("u4", None, "AAA"), article("u5", "20240103T000000", "")]}
    (tmp_path / "w.json").write_text(json.dumps(feed))
    payload = readers.news(spark, str(tmp_path))
    got = stories.deduplicate_stories(stories.story_rows(payload))
    assert sorted(r.ticker for r in got.collect()) == ["AAA", "BBB", "ZZZ"]
    assert got.where("ticker = 'AAA'").head().overall_sentiment_score == 0.3
    assert [r.url for r in stories.bad_stories(payload).collect()] == ["u3"]
    assert got.columns == stories.STORY_COLUMNS


@pytest.mark.parametrize(("days", "total", "limits"), [(300, 100, [10] * 10), (90, 10, [4, 3, 3]), (0, 5, [5])])
def test_request_windows(spark, days, total, limits):
    a = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([("x", a, a + dt.timedelta(days=days))], "name string, start timestamp, end timestamp")
    got = indicators.allocate_limits(indicators.request_windows(r, 30), total, ["name"]).orderBy("window").collect()
    assert [x.row_limit for x in got] == limits
    assert got[-1].window_end == a + dt.timedelta(days=days)
    if len(got) > 1:
        assert got[0].window_end == a + dt.timedelta(days=30, minutes=-1)


def test_value_field():
    assert indicators.value_field(["date", "close", "rsi"], None) == "rsi"
    assert indicators.value_field(["date", "close", "a", "b"], "b") == "b"
    assert indicators.value_field(["date", "open", "close"]) == "close"
    with pytest.raises(ValueError, match="value field"):
        indicators.value_field(["date", "a", "b"])


def test_macro_last_per_period(spark):
    m = spark.createDataFrame([("GDP", "2024-01-01", "1"), ("GDP", "2024-03-01", "x"), ("GDP", "2024-02-01", "2"), ("CPI x", "2024-05-01", "7")], "name string, date string, value string")
    got = {r.time_range: (r.econ_gdp, r.econ_cpi_x) for r in indicators.economics_table(m).collect()}
    assert got == {"q1y2024": (2.0, None), "q2y2024": (None, 7.0)}


def test_indicator_fits(spark):
    c = spark.createDataFrame([(20, "1day"), (40, "1day"), (2, "1month"), (5, "?")], "period int, timeframe string")
    got = indicators.indicator_fits(c, F.lit("2024-01-01"), F.lit("2024-01-31"))
    assert sorted(rows(got)) == [(5, "?"), (20, "1day")]


def test_split_boundaries(spark):
    ends = ["2024-03-31", "2024-06-30", "2024-09-30", "2024-12-31", "2025-03-31"]
    df = spark.createDataFrame([(day(e),) for e in ends], "d date")
    assert rows(panel.split_boundaries(df, "d", 0.6, 0.2)) == [(day("2024-09-30"), day("2024-12-31"))]
    assert rows(panel.split_boundaries(df.limit(3), "d", 0.7, 0.15)) == [(day("2024-06-30"), day("2024-06-30"))]
    assert rows(panel.split_boundaries(df.limit(0), "d", 0.7, 0.15)) == [(None, None)]
    with pytest.raises(ValueError, match="add up"):
        panel.check_ratios(0.5, 0.1, 0.1)


def test_preprocess(spark):
    ends = ["2024-03-31", "2024-06-30", "2024-09-30", "2024-12-31"]
    f = spark.createDataFrame([(t, f"q{k}y2024", day(e), float(k), None if k == 1 else 2.0) for t in "AB" for k, e in enumerate(ends, 1)], "ticker string, time_range string, quarter_end_date date, a double, b double")
    story = spark.createDataFrame([("A", "q1y2024", day("2024-02-01"), 1.0)], "ticker string, time_range string, story_date date, story_count double")
    econ = spark.createDataFrame([("q1y2024", day("2024-03-31"), 5.0)], "time_range string, date date, econ_x double")
    out, fitted = jobs.preprocess(f, story, econ, None, panel.PanelConfig(sequence_length=2, horizon=1, train=0.5, val=0.25, test=0.25))
    got = out.collect()
    assert sorted(r.split for r in got) == ["test"] * 2 + ["train"] * 4 + ["val"] * 2
    assert sum(r.window_ready for r in got) == 6 and sum(r.horizon_target_ready for r in got) == 6
    train = [r for r in got if r.split == "train"]
    for c in ("a", "story_count"):
        assert abs(sum(r[c] for r in train)) < 1e-12 and abs(sum(r[c] ** 2 for r in train) / 4 - 1) < 1e-12
    z = next(r.story_count for r in train if r.ticker == "B")
    assert abs(z + 0.5773502691896258) < 1e-12
    assert {r.b for r in got} == {0.0} and fitted["medians"].head().b == 2.0


def test_samples(spark):
    ends = pd.date_range("2020-03-31", periods=9, freq="QE").date
    p = spark.createDataFrame([("A", f"q{k}", e, float(k), True, k < 8, "train" if k < 6 else "val", 10.0 + k, 11.0 + k, e, 1) for k, e in enumerate(ends)], "ticker string, time_range string, quarter_end_date date, x double, window_ready boolean, horizon_target_ready boolean, split string, quarter_price double, future_price_t1 double, future_quarter_end_date_t1 date, class_target_t1 int")
    s = samples.sequence_samples(p, ["x"], [1], 4).orderBy("quarter_end_date").collect()
    assert len(s) == 5 and s[0].features == [[0], [1], [2], [3]] and s[0].price_targets == [14]
    m = samples.portfolio_members(p, ["x"], 1, 4)
    q = samples.portfolio_samples(m).orderBy("quarter_end_date").collect()
    assert [x.ticker_count for x in q] == [1] * 5 and q[0].members[0].future_price == 14
    with pytest.raises(Exception, match="several target dates"):
        samples.portfolio_samples(m.withColumn("quarter_end_date", F.lit("2020-01-01").cast("date")).withColumn("time_range", F.lit("q")).withColumn("split", F.lit("val"))).collect()
    counts = {r.split: r.samples for r in samples.samples_per_split(m).collect()}
    assert counts == {"train": 3, "val": 2, "test": 0}
    assert samples.window_samples(p, ["x"], 10).count() == 0
    assert samples.batches(p, 4, ["quarter_end_date"]).agg(F.max("batch_id")).head()[0] == 1
    assert samples.seeded_sample(p, 3, ["quarter_end_date"]).collect() == samples.seeded_sample(p, 3, ["quarter_end_date"]).collect()


@pytest.fixture
def two_runs(spark):
    w = [(1, "attention", "X", 0.3), (1, "attention", "Y", 0.7), (2, "bilstm", "X", 0.6), (2, "bilstm", "Y", 0.4)]
    price = {"X": (100.0, 120.0), "Y": (100.0, 90.0)}
    rows_ = [("val", "val", r, 0.0, 0.0, f, f, "k", "q1y2024", day("2024-03-31"), day("2024-06-30"), t, x, *price[t]) for r, f, t, x in w]
    return spark.createDataFrame(rows_, "evaluation_scope string, source_split string, run_id int, risk_penalty double, concentration_penalty double, model_family string, model_target string, sample_key string, time_range string, quarter_end_date date, future_quarter_end_date date, ticker string, weight double, current_price double, future_price double")


def test_ensemble(two_runs):
    e = portfolio.ensemble(two_runs, 1, 2)
    assert sorted(round(r.weight, 9) for r in e.collect()) == [0.45, 0.55]
    s = portfolio.sample_summary(e).head()
    assert abs(s.portfolio_growth - 1.035) < 1e-12 and abs(s.benchmark_growth - 1.05) < 1e-12 and abs(s.growth_alpha + 0.015) < 1e-12
    for bad in (two_runs.where("not (run_id = 2 and ticker = 'Y')"), two_runs.unionByName(two_runs.where("run_id = 1")), two_runs.where("run_id = 1")):
        with pytest.raises(Exception, match="one to one"):
            portfolio.ensemble(bad, 1, 2).collect()
    assert portfolio.ensemble(two_runs.where("not (run_id = 2 and ticker = 'Y')"), 1, 2, check=False).count() == 1
    assert tuple(portfolio.pair_report(two_runs.where("not (run_id = 2 and ticker = 'Y')"), 1, 2).head()) == (2, 1, 1, 1, 0, 0)
    assert portfolio.ensemble(two_runs.limit(0), 1, 2).count() == 0


def test_evaluation(two_runs):
    both = two_runs.unionByName(two_runs.withColumn("evaluation_scope", F.lit("all")))
    out = jobs.evaluate(both, 1, 1)
    best = out["top_strategies"].where("evaluation_scope = 'val'").head()
    assert best.run_id == 2 and abs(best.mean_portfolio_growth - 1.08) < 1e-12
    assert {r.ticker for r in out["top_holdings"].collect()} == {"X"}
    nav = {(r.source_split, str(r.quarter_end_date)): r.nav for r in out["strategy_nav"].where("evaluation_scope = 'val'").collect()}
    assert nav[("base", "2023-12-31")] == 1.0 and abs(nav[("val", "2024-03-31")] - 1.08) < 1e-12
    saved = jobs.saved_ensemble(portfolio.weight_rows(two_runs), portfolio.run_summary(portfolio.sample_summary(portfolio.weight_rows(two_runs))), ("attention", "bilstm"))
    assert saved["summary"].head().sample_count == 1 and saved["member_nav"].count() == 4
    with pytest.raises(ValueError, match="lstm2"):
        portfolio.best_per_family(out["run_summary"], ["attention", "lstm2"])


def test_softmax_and_loss(spark):
    s = spark.createDataFrame([("k", "A", 1.0, True), ("k", "B", 800.0, True), ("k", "C", 5.0, False)], "sample string, ticker string, score double, valid boolean")
    w = {r.ticker: r.weight for r in portfolio.softmax_weights(s, ["sample"], valid="valid").collect()}
    assert w == {"A": 0.0, "B": 1.0}
    p = spark.createDataFrame([("k", 0.5, 100.0, 120.0), ("k", 0.5, 100.0, 60.0)], "sample string, weight double, current_price double, future_price double")
    loss = portfolio.growth_loss(p, ["sample"], False, 1.0, 2.0).head()
    assert abs(loss.loss - (0.1 + 0.1 + 2 * 0.5)) < 1e-12


def test_weighted_loss(spark):
    p = spark.createDataFrame([([1.0, 3.0], [0.0, 0.0], [[0.0, 0.0]] * 2, [0, 1])], "price_predictions array<double>, price_targets array<double>, class_logits array<array<double>>, class_targets array<int>")
    got = predictions.multitask_loss(p, 2, [1.0, 3.0]).head()
    assert got.regression_loss == 7.0 and abs(got.classification_loss - math.log(2)) < 1e-12
    with pytest.raises(ValueError, match="horizon weights"):
        predictions.horizon_weights(2, [1.0])


def test_epochs(spark):
    s = spark.createDataFrame([(1, "train", 0, "loss", 2.0), (1, "train", 1, "loss", 4.0), (1, "train", 1, "mae", 6.0), (1, "val", 0, "loss", 1.0), (2, "val", 0, "loss", 1.0)], "epoch int, phase string, step int, name string, value double")
    e = predictions.epoch_metrics(s)
    r = e.where("epoch = 1").head()
    assert (r.train_loss, r.train_mae, r.val_loss, r.train_steps) == (3.0, 3.0, 1.0, 2)
    assert predictions.best_epoch(e).head().epoch == 1
    assert predictions.epoch_summary(e).columns == predictions.EPOCH_SUMMARY


def test_preflight(spark):
    s = spark.createDataFrame([("train", 1.0, 2.0, 4), ("val", float("nan"), 0.0, 4)], "split string, x double, price double, sequence_length int")
    got = {r.check: r.passed for r in checks.preflight(s, ["x"], ["price"]).collect()}
    assert got == {"features": True, "training_rows": True, "finite": False, "positive_prices": False, "positive_lengths": True}
    with pytest.raises(ValueError, match="finite"):
        checks.require(checks.preflight(s, ["x"], ["price"]))
    assert checks.reserved_features(["update_count", "date", "quarter_end_date", "quarter_end_date_story", "quarter_end_date_x"]) == ["quarter_end_date_story", "quarter_end_date_x"]
    for names, passed in ((["update_count"], True), (["quarter_end_date_technical"], False), ([], False)):
        named = s.select("*", *[F.lit(1.0).alias(n) for n in names])
        assert {r.check: r.passed for r in checks.preflight(named, names, ["price"]).collect()}["features"] == passed
    val = s.where("split = 'val'").withColumns({"quarter_price": F.lit(1.0), "future_price_t4": F.lit(None).cast("double"), "window_ready": F.lit(True), "horizon_target_ready": F.lit(True)})
    with pytest.raises(ValueError, match=r"training_rows.*horizon=4, train_rows=0, train_current=0"):
        checks.require(checks.preflight(val, ["x"], ["price"]), ["x"], samples.target_matches(val, 4), horizon=4)
    assert checks.bad_rows(s, ["x"], ["split"]).count() == 1
    m = spark.createDataFrame([(1.0, True), (float("-inf"), False)], "score double, valid boolean")
    assert checks.score_report(m).head().passed


def test_aliases(spark):
    w = spark.createDataFrame([("BRK-B",), ("ABC",), ("X.Y",)], "ticker string")
    listed = spark.createDataFrame([("BRK.B",), ("X-Y",)], "ticker string")
    assert dict(rows(statements.pick_alias(w, listed))) == {"BRK-B": "BRK.B", "ABC": None, "X.Y": "X-Y"}


def test_scores_by_hand(spark):
    base = dict(rev=100.0, ni=10.0, gp=40.0, op_cash=12.0, assets=200.0, liabilities=80.0, curr_assets=60.0, curr_liab=30.0, receivables=10.0, ppe=50.0, dep_amort=5.0, cogs=60.0, sga=20.0)
    now = base | dict(rev=120.0, ni=15.0, gp=54.0)
    from panelspark.functions import scores

    df = spark.createDataFrame([(base, now)], "p struct<" + ",".join(f"{k}:double" for k in base) + ">, q struct<" + ",".join(f"{k}:double" for k in base) + ">")
    r = df.select(scores.f_score(F.col("q"), F.col("p")).alias("f"), scores.m_score(F.col("q"), F.col("p")).alias("m"), scores.o_score(F.col("q"), F.col("p")).alias("o")).head()
    assert r.f == 5.0  # profit, cash, better return, margin and turnover
    dsri, gmi, sgi, sgai = (10 / 120) / (10 / 100), 0.4 / 0.5, 1.2, (20 / 120) / (20 / 100)
    assert abs(r.m - (-4.84 + 0.92 * dsri + 0.528 * gmi + 0.404 + 0.892 * sgi + 0.115 - 0.172 * sgai - 0.327)) < 1e-9
    o = -1.32 - 0.407 * math.log(200) + 6.03 * 0.4 - 1.43 * 0.15 + 0.0757 * 0.5 - 2.37 * 0.075 - 1.83 * 0.15 - 0.521 * 0.2
    assert abs(r.o - 1 / (1 + math.exp(-o))) < 1e-9


@pytest.mark.parametrize(("length", "block"), [(1, 4), (4, 3), (4, 100), (9, 2)])
def test_stored_sequences_are_the_sequences(spark, length, block):
    ends = pd.date_range("2018-03-31", periods=14, freq="QE").date
    rows_ = [(t, f"q{k}", e, float(k + 100 * n), None if k == 5 else 1.0, True, k < 12, "train", 1.0, 10.0 + k, 1) for n, t in enumerate(["A", "B", None]) for k, e in enumerate(ends[: 14 - 3 * n])]
    p = spark.createDataFrame(rows_, "ticker string, time_range string, quarter_end_date date, x double, y double, window_ready boolean, horizon_target_ready boolean, split string, quarter_price double, future_price_t1 double, class_target_t1 int").repartition(3)
    store, placed = samples.sequence_store(p, ["x", "y"], block)
    assert store.agg(F.sum(F.size("vectors"))).head()[0] == len(rows_) and store.agg(F.max(F.size("vectors"))).head()[0] <= block
    got = samples.expanded(samples.stored_samples(placed, [1], length, block), store, length, block)
    want = samples.sequence_samples(p, ["x", "y"], [1], length)
    key = lambda r: (str(r.ticker), r.quarter_end_date)
    assert [tuple(r[c] for c in want.columns) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]
    assert want.count() > 5


def test_blocked_cross_sections(spark):
    from panelspark.operators import normalize

    g = spark.range(230).select(F.concat(F.lit("T"), F.col("id") % 23).alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 23).cast("int")).alias("date"), F.when(F.col("id") % 7 != 0, F.col("id") * 1.0).alias("a"), F.lit(2.0).alias("b"))
    axis = normalize.asset_axis(g, size=5)
    blocks = normalize.cube_blocks(g, axis, ["a", "b"])
    assert blocks.agg(F.max(F.size("matrix"))).head()[0] == 5 and blocks.count() == 50
    rebuilt = {}
    for r in normalize.cube_rows(blocks, axis).collect():
        rebuilt.setdefault(r.date, {})[r.ticker] = r.vector
    assert {r.date: dict(zip(r.tickers, r.matrix, strict=True)) for r in normalize.cube(g, ["a", "b"]).collect()} == rebuilt
    day_ = lambda d: F.lit(d).cast("date")
    m = g.select(F.lit("train").alias("split"), F.lit("q").alias("time_range"), F.col("date").alias("quarter_end_date"), day_("2021-01-01").alias("future_quarter_end_date"), "ticker", F.lit(1).alias("sequence_length"), F.array(F.array("b")).alias("features"), F.lit(1.0).alias("current_price"), F.lit(2.0).alias("future_price"))
    whole = {r.quarter_end_date: r.members for r in samples.portfolio_samples(m).collect()}
    parts = sorted(samples.portfolio_blocks(m, 4).collect(), key=lambda r: (r.quarter_end_date, r.block))
    assert max(len(r.members) for r in parts) == 4
    assert {d: [x for r in parts if r.quarter_end_date == d for x in r.members] for d in whole} == whole
    odd = m.withColumn("future_quarter_end_date", F.when(F.col("ticker") == "T9", day_("2022-01-01")).otherwise(F.col("future_quarter_end_date")))
    with pytest.raises(Exception, match="several target dates"):
        samples.portfolio_blocks(odd, 1).collect()


def test_targets_take_one_shuffle(quarters):
    plan = targets.attach_targets(targets.period_prices(quarters).persist(), [1, 2, 3, 4])
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert text.count("Exchange hashpartitioning") <= 2 and "Join" not in text and "Generate" not in text and "Aggregate" not in text


def test_evaluation_reads_the_weights_once(two_runs, tmp_path):
    from panelspark.sources import sinks

    two_runs.withColumn("evaluation_scope", F.lit("all")).write.parquet(str(tmp_path / "w"))
    out = jobs.evaluate(two_runs.sparkSession.read.parquet(str(tmp_path / "w")), 1, 1)
    assert set(out) == set(sinks.EVALUATION_TABLES)
    for name, df in out.items():
        assert "parquet" not in df._jdf.queryExecution().optimizedPlan().toString(), name
