"""Registered queries of whole jobs, of column functions, and of checks and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import scalar
from panelspark.operators import checks, indicators, panel, portfolio, predictions, samples, statements, stories, targets
from panelspark.plans import jobs
from panelspark.plans import stand_ins as S
from panelspark.plans.queries import _CONFIG, _JOINED, _MEMBERS, _P, _SPLIT, _STEPS, _STORY_AGG, _SUM, _TOPICS, _W, _epochs, _joined, _members, _samples, _state, _summary, _unfolded, query, rounded

# ---- whole jobs --------------------------------------------------------------------

_ALL_FOUR = f"""{_SPLIT}, {S.SQL_PRICES}, {S.SQL_TECHNICAL}, {S.SQL_STORIES}, {_STORY_AGG}, {_TOPICS}, {S.SQL_MACRO},
econ AS (SELECT {S.SQL_TAG.format("date")} AS time_range, arg_max(v, date) AS econ_order_value FROM months GROUP BY 1),
tech AS (SELECT ticker, {S.SQL_TAG.format("date")} AS time_range, arg_max(sma, date) AS tech_sma FROM technical GROUP BY 1, 2),
wide AS (SELECT st.*, coalesce(story_count, 0)::DOUBLE AS story_count, coalesce(overall_sentiment_mean, 0) AS sentiment, coalesce(t.relevance, 0) AS earnings, coalesce(econ_order_value, 0) AS econ, coalesce(tech_sma, 0) AS tech
  FROM st LEFT JOIN agg ON agg.ticker = st.ticker AND agg.time_range = st.time_range LEFT JOIN topic t ON t.ticker = st.ticker AND t.time_range = st.time_range AND t.topic = 'earnings'
  LEFT JOIN econ ON econ.time_range = st.time_range LEFT JOIN tech ON tech.ticker = st.ticker AND tech.time_range = st.time_range)
"""
_NUMBERS = ["f1", "f3", "story_count", "sentiment", "earnings", "econ", "tech"]


@query(f"""{_ALL_FOUR}, sc AS (SELECT {", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in _NUMBERS)} FROM wide WHERE split = 'train')
SELECT ticker, quarter_end_date, split, {", ".join(f"round(({c} - a_{c}) / CASE WHEN s_{c} > 1e-8 THEN s_{c} ELSE 1 END, 6) AS {c}" for c in _NUMBERS)} FROM wide, sc""")
def preprocessed_with_all(spark, sf):
    """The preprocess job with stories, macro and technical columns, gaps of all three filled with zeros."""
    story = stories.story_features(S.stories(spark, sf), ["earnings", "life_sciences"])
    econ = indicators.economics_table(S.macro(spark, sf), ["econ_order_value", "econ_order_count"], "Q")
    tech = indicators.technical_table(S.technical(spark, sf), ["tech_sma_5_1day", "tech_rsi_14_1day"])
    config = panel.PanelConfig(sequence_length=_CONFIG.sequence_length, horizon=_CONFIG.horizon, fill_indicators=True)
    rows, _ = jobs.preprocess(S.panel(spark, sf), story, econ, tech, config)
    names = {"sentiment": "overall_sentiment_mean", "earnings": "topic_relevance_earnings", "econ": "econ_order_value", "tech": "tech_sma_5_1day"}
    return rows.select("ticker", "quarter_end_date", "split", *[F.round(names.get(c, c), 6).alias(c) for c in _NUMBERS])


@query(_JOINED + ", t AS (SELECT *, sum(f1) OVER w AS a, sum(f3) OVER w AS b, count(*) OVER w AS length FROM j WINDOW w AS (PARTITION BY ticker ORDER BY quarter_end_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT split, ticker, quarter_end_date, round(a + b, 5) AS total, round(p1, 7) AS p1, round(p2, 7) AS p2 FROM t WHERE window_ready AND horizon_target_ready AND length = 4 AND p1 IS NOT NULL AND p2 IS NOT NULL")
def sequence_dataset(spark, sf):
    """The sequence job over the panel, with an explicit list of features."""
    got = jobs.sequence_dataset(_state(spark, sf), S.prices(spark, sf), [1, 2], 4, features=["f1", "f3"])
    total = F.aggregate(F.flatten("features"), F.lit(0.0), lambda s, x: s + x.cast("double"))
    # features and targets are 32-bit in samples: they are compared to what 32 bits hold of such sums
    exact = samples.with_sequences(_state(spark, sf), ["f1", "f3"], 4).select("ticker", "quarter_end_date", F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda s, x: s + x).alias("t"))
    prices = targets.attach_targets(targets.period_prices(S.prices(spark, sf)), [1, 2]).select("ticker", "quarter_end_date", "future_price_t1", "future_price_t2")
    near = lambda a, b, digits=7: F.when(F.abs(a - b) <= 1e-6 * F.abs(b), F.round(b, digits))
    both = got.join(exact, ["ticker", "quarter_end_date"]).join(prices, ["ticker", "quarter_end_date"])
    return both.select("split", "ticker", "quarter_end_date", near(total, F.col("t"), 5).alias("total"), *[near(F.col("price_targets")[k], F.col(f"future_price_t{k + 1}")).alias(f"p{k + 1}") for k in (0, 1)])


@query(_MEMBERS + " SELECT split, quarter_end_date, count(*)::INT AS ticker_count, round(sum(p1 / quarter_price) / count(*), 6) AS mean_growth FROM m GROUP BY 1, 2")
def portfolio_dataset(spark, sf):
    made = jobs.portfolio_dataset(_state(spark, sf), S.prices(spark, sf), 1, 4, features=["f1", "f3"])
    mean = F.aggregate("members", F.lit(0.0), lambda s, m: s + scalar.growth(m["current_price"], m["future_price"])) / F.col("ticker_count")
    return made["samples"].select("split", "quarter_end_date", "ticker_count", F.round(mean, 6).alias("mean_growth"))


@query(f"""{_SPLIT}, {S.SQL_STORIES}, {_STORY_AGG}, {_TOPICS}, w AS (SELECT st.split, st.ticker, st.quarter_end_date, n, sum(coalesce(f2, 0)) OVER o AS f2, sum(coalesce(story_count, 0)) OVER o AS stories, count(*) OVER o AS length
  FROM st LEFT JOIN agg ON agg.ticker = st.ticker AND agg.time_range = st.time_range WINDOW o AS (PARTITION BY st.ticker ORDER BY st.quarter_end_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT split, ticker, quarter_end_date, round(f2, 3) AS f2, stories::DOUBLE AS stories, 0::DOUBLE AS target FROM w WHERE n >= 6 AND length = 6""")
def window_dataset(spark, sf):
    """The plain windows: no macro or technical columns, no scaling, missing features as zeros."""
    got = jobs.window_dataset(S.panel(spark, sf), S.stories(spark, sf), 6)
    names = scalar.feature_columns(panel.merge_panel(S.panel(spark, sf), stories.story_features(S.stories(spark, sf))))
    total = lambda c: F.aggregate("features", F.lit(0.0), lambda s, v: s + v[names.index(c)])
    return got.select("split", "ticker", "quarter_end_date", F.round(total("f2"), 3).alias("f2"), total("story_count").alias("stories"), "target")


@query(f"""WITH {S.SQL_PANEL}, m AS (SELECT median(f1) AS m1 FROM panel), fl AS (SELECT ticker, quarter_end_date AS date, coalesce(f1, m1) AS f1 FROM panel, m), q AS (SELECT quantile_cont(f1, [0.25, 0.5, 0.75]) AS q FROM fl),
sc AS (SELECT ticker, date, (f1 - q.q[2]) / (CASE WHEN q.q[3] = q.q[1] THEN 1 ELSE q.q[3] - q.q[1] END) AS f1 FROM fl, q),
ends AS (SELECT DISTINCT last_day(d) AS date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS d FROM sc) WHERE month(d) % 3 = 0)
SELECT g.date, count(*)::BIGINT AS tickers, round(sum(coalesce(sc.f1, 0)), 4) AS total FROM (SELECT * FROM (SELECT DISTINCT ticker FROM sc), ends) g ASOF LEFT JOIN sc ON sc.ticker = g.ticker AND sc.date <= g.date GROUP BY 1""")
def normalized_cube(spark, sf):
    made = jobs.normalized_cube(S.panel(spark, sf).select("ticker", F.col("quarter_end_date").alias("date"), "f1"), ["f1"])
    return made.select("date", F.size("tickers").cast("long").alias("tickers"), F.round(F.aggregate(F.flatten("matrix"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


# ---- portfolios --------------------------------------------------------------------


@query(_SUM + "SELECT model_family, risk_penalty, round(avg(mean_effective_holdings) FILTER (WHERE concentration_penalty = 0), 4) AS conc_0_0, round(avg(mean_effective_holdings) FILTER (WHERE concentration_penalty = 0.1), 4) AS conc_0_1 FROM run_sum GROUP BY 1, 2")
def holdings_heatmap(spark, sf):
    return rounded(portfolio.heatmap(_summary(spark, sf), "mean_effective_holdings", [0.0, 0.1]), 4)


@query(_W + "SELECT run_id, risk_penalty, concentration_penalty, source_split, quarter_end_date, round(avg(portfolio_growth), 6) AS growth FROM s GROUP BY 1, 2, 3, 4, 5")
def strategy_curve(spark, sf):
    return rounded(portfolio.strategy_curve(_samples(spark, sf)), 6)


@query(_SUM + "SELECT run_id, sample_count, NULL::VARCHAR AS skip_reason FROM run_sum WHERE run_id % 2 = 0 UNION ALL SELECT run_id, NULL, 'no samples' FROM run_sum WHERE run_id % 2 = 1")
def skipped_runs(spark, sf):
    """A run summary when only the even runs have samples."""
    each = _samples(spark, sf)
    all_runs = each.select("run_id", *portfolio.RUN).distinct()
    return portfolio.run_summary(each.where("run_id % 2 = 0"), all_runs).select("run_id", "sample_count", "skip_reason")


_VALID = "v AS (SELECT *, ticker::INT % 3 <> 0 AS valid FROM scores WHERE run_id = 3)"


@query(_W + f", {_VALID}, x AS (SELECT *, exp(score - max(score) OVER o) AS e FROM v WHERE valid WINDOW o AS (PARTITION BY quarter_end_date)) SELECT ticker, quarter_end_date, round(e / sum(e) OVER (PARTITION BY quarter_end_date), 8) AS weight FROM x")
def masked_weights(spark, sf):
    """Softmax over the valid members; a third of the tickers is masked, with scores of minus infinity."""
    valid = F.col("ticker").cast("int") % 3 != 0
    s = S.scores(spark, sf).where("run_id = 3").withColumn("valid", valid).withColumn("score", F.when(valid, F.col("score")).otherwise(F.lit(float("-inf"))))
    return portfolio.softmax_weights(s, portfolio.SAMPLE, valid="valid").select("ticker", "quarter_end_date", F.round("weight", 8).alias("weight"))


@query(_W + f", {_VALID} SELECT count(*) FILTER (WHERE ticker::INT % 11 = 0) AS nan, count(*) FILTER (WHERE ticker::INT % 3 <> 0 AND (ticker::INT % 11 = 0 OR ticker::INT % 7 = 0)) AS valid_not_finite, count(*) FILTER (WHERE ticker::INT % 3 = 0 AND ticker::INT % 7 = 0 AND ticker::INT % 11 <> 0) AS masked_infinite FROM v")
def score_report(spark, sf):
    """Scores with NaN for every 11th ticker and infinity for every 7th; every third is masked."""
    t = F.col("ticker").cast("int")
    score = F.when(t % 11 == 0, F.lit(float("nan"))).when(t % 7 == 0, F.lit(float("inf"))).otherwise(F.col("score"))
    s = S.scores(spark, sf).where("run_id = 3").withColumns({"valid": t % 3 != 0, "score": score})
    return checks.score_report(s).select("nan", "valid_not_finite", "masked_infinite")


# ---- checks ------------------------------------------------------------------------


@query(f"WITH {S.SQL_PANEL} SELECT count(*) FILTER (WHERE f2 IS NULL) AS nulls, count(*) FILTER (WHERE ticker::INT % 5 = 0) AS nan, count(*) FILTER (WHERE ticker::INT % 5 = 1) AS infinite, count(*) FILTER (WHERE ticker::INT % 5 > 1) AS finite FROM panel")
def not_finite_values(spark, sf):
    """f1 is NaN for every fifth ticker and infinite for the next one: the report counts them, ``finite`` takes them out."""
    t = F.col("ticker").cast("int") % 5
    p = S.panel(spark, sf).withColumn("f1", F.when(t == 0, F.lit(float("nan"))).when(t == 1, F.lit(float("-inf"))).otherwise(F.col("f1")))
    one = checks.finite_report(p, ["f1", "f2"]).agg(F.max(F.when(F.col("column") == "f2", F.col("null"))).alias("nulls"), F.max("nan").alias("nan"), F.max("infinite").alias("infinite"))
    return one.crossJoin(p.agg(F.count(scalar.finite("f1")).alias("finite")))


_FLAGS = "ticker::INT % 5 = 0 AND quarter_end_date >= DATE '1997-01-01'"


@query(_MEMBERS + f""", x AS (SELECT 'clean' AS suite, * FROM m UNION ALL SELECT 'broken', * FROM m WHERE split <> 'train'),
names AS (SELECT * FROM (VALUES ('clean', 'update_count'), ('clean', 'candidate_value'), ('broken', 'update_count'), ('broken', 'quarter_end_date_story'), ('broken', 'quarter_end_date_other')) v(suite, name)),
c AS (SELECT suite, count(*) FILTER (WHERE split = 'train') > 0 AS t, count(*) FILTER (WHERE suite = 'broken' AND {_FLAGS}) = 0 AS f, count(*) FILTER (WHERE quarter_price <= 0 OR p1 <= 0 OR suite = 'broken' AND ticker::INT % 7 = 0) = 0 AS p, count(*) > 0 AND bool_and(suite = 'clean' OR ticker::INT % 3 <> 1) AS n FROM x GROUP BY 1)
SELECT suite, 'features' AS "check", bool_and(NOT starts_with(name, 'quarter_end_date_')) AS passed FROM names GROUP BY 1 UNION ALL SELECT suite, 'training_rows', t FROM c UNION ALL SELECT suite, 'finite', f FROM c
UNION ALL SELECT suite, 'positive_prices', p FROM c UNION ALL SELECT suite, 'positive_lengths', n FROM c""")
def preflight(spark, sf):
    """Samples as they are, with feature names that merely hold "date"; and samples without training rows, with values that aren't finite, prices and lengths that aren't positive, and helper columns of a merge among the features."""
    t = F.col("ticker").cast("int")
    m = _members(spark, sf).withColumns({"update_count": F.col("current_price"), "candidate_value": F.lit(1.0)})
    broken = m.where("split <> 'train'").withColumns({
        "update_count": F.when((t % 5 == 0) & (F.col("quarter_end_date") >= F.lit("1997-01-01").cast("date")), F.lit(float("inf"))).otherwise(F.lit(1.0)), "quarter_end_date_story": F.lit(1.0), "quarter_end_date_other": F.lit(1.0),
        "future_price": F.when(t % 7 == 0, 0.0).otherwise(F.col("future_price")), "sequence_length": F.when(t % 3 == 1, 0).otherwise(F.col("sequence_length")),
    })
    prices = ["current_price", "future_price"]
    good = checks.preflight(m, ["update_count", "candidate_value"], prices).withColumn("suite", F.lit("clean"))
    bad = checks.preflight(broken, ["update_count", "quarter_end_date_story", "quarter_end_date_other"], prices).withColumn("suite", F.lit("broken"))
    return good.unionByName(bad)


@query("""WITH r AS (SELECT n_nationkey, round((n_nationkey % 10 * 0.1)::DOUBLE, 1) AS train, round((n_regionkey * 0.1)::DOUBLE, 1) AS val FROM nation), t AS (SELECT *, CASE WHEN n_nationkey % 3 = 0 THEN 0.2 ELSE round(1 - train - val, 1) END AS test FROM r)
SELECT n_nationkey, train, val, test, least(train, val, test) >= 0 AND abs(train + val + test - 1) <= 1e-6 AS valid FROM t""")
def split_ratios(spark, sf):
    """Ratios of each nation's keys: some are negative, some don't add up to 1."""
    n = S.read(spark, sf, "nation")
    r = n.select("n_nationkey", F.round((F.col("n_nationkey") % 10) * 0.1, 1).alias("train"), F.round(F.col("n_regionkey") * 0.1, 1).alias("val"))
    r = r.withColumn("test", F.when(F.col("n_nationkey") % 3 == 0, 0.2).otherwise(F.round(1 - F.col("train") - F.col("val"), 1)))
    return r.withColumn("valid", panel.valid_ratios("train", "val", "test"))


@query(_W + """, two AS (SELECT run_id, ticker, quarter_end_date FROM w WHERE run_id = 3 AND ticker::INT % 10 <> 1 UNION ALL SELECT run_id, ticker, quarter_end_date FROM w WHERE run_id = 6 AND ticker::INT % 10 <> 2 UNION ALL SELECT run_id, ticker, quarter_end_date FROM w WHERE run_id = 6 AND ticker::INT % 10 = 5),
k AS (SELECT ticker, quarter_end_date, count(*) FILTER (WHERE run_id = 3) AS a, count(*) FILTER (WHERE run_id = 6) AS b FROM two GROUP BY 1, 2)
SELECT sum(a)::BIGINT AS rows_one, sum(b)::BIGINT AS rows_other, count(*) FILTER (WHERE a = 1 AND b = 1) AS matched, count(*) FILTER (WHERE b = 0) AS only_one, count(*) FILTER (WHERE a = 0) AS only_other, count(*) FILTER (WHERE a > 1 OR b > 1) AS repeated FROM k""")
def ensemble_pairs(spark, sf):
    """How far two runs match that lack each other's rows of some tickers, one of them with other rows twice."""
    w, t = S.weights(spark, sf), F.col("ticker").cast("int") % 10
    one, other = w.where((F.col("run_id") == 3) & (t != 1)), w.where((F.col("run_id") == 6) & (t != 2))
    return portfolio.pair_report(one.unionByName(other).unionByName(other.where(t == 5)), 3, 6)


@query(_STEPS.join(["WITH ", ", b AS (SELECT * FROM ep ORDER BY epoch DESC LIMIT 5) SELECT epoch, round(val_loss - train_loss, 7) AS loss_gap, round(val_price_mae - train_price_mae, 7) AS mae_gap FROM b"]))
def last_gaps(spark, sf):
    """Generalization gaps of the last five epochs, from a history pieced together of snapshots."""
    e = _epochs(spark, sf)
    whole = predictions.snapshot_history(e.where("epoch % 2 = 0"), None, e.where("epoch % 2 = 1").select(*[c for c in e.columns if c != "val_steps"]))
    last = predictions.last_epochs(whole, 5).withColumns({"train_class_accuracy": F.lit(0.5), "val_class_accuracy": F.lit(0.25)})
    return rounded(predictions.generalization_gaps(last), 7).select("epoch", "loss_gap", "mae_gap")


@query(f"WITH {_STEPS} SELECT epoch, train_steps, val_steps, round(train_loss, 8) AS train_loss, NULL::DOUBLE AS val_class_accuracy FROM ep")
def epoch_summary(spark, sf):
    got = rounded(predictions.epoch_summary(_epochs(spark, sf)))
    return got.select("epoch", "train_steps", "val_steps", "train_loss", "val_class_accuracy")


_DRAWN = "SELECT DISTINCT vec_id, split, quarter_end_date, md5(concat_ws('|', split, vec_id::VARCHAR, 'q1y2020', quarter_end_date::VARCHAR, '3')) AS mark FROM err ORDER BY mark LIMIT 40"


@query(_P + f", k AS ({_DRAWN}) SELECT split, vec_id::VARCHAR AS ticker, quarter_end_date, horizon, round(p, 6) AS predicted_price, true AS again FROM k JOIN err USING (vec_id, split, quarter_end_date)")
def sampled_predictions(spark, sf):
    """Forty seeded sample keys with their predictions of both horizons, and whether a second draw, from rows dealt otherwise, has the key, too."""
    rows = _unfolded(spark, sf)
    keys = samples.distinct_keys(rows, predictions.KEYS)
    draw = lambda df: samples.seeded_sample(df, 40, predictions.KEYS, 3)
    again = draw(keys.repartition(3)).withColumn("again", F.lit(True))
    found = predictions.sampled_predictions(draw(keys), rows).join(again, predictions.KEYS, "left")
    return found.select("split", "ticker", "quarter_end_date", "horizon", F.round("predicted_price", 6).alias("predicted_price"), F.coalesce("again", F.lit(False)).alias("again"))


# ---- columns -----------------------------------------------------------------------


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M') AS sent_at, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::TIMESTAMP END AS parsed,
o_orderstatus || '__q1__' || strftime(o_orderdate, '%Y-%m-%d') AS sample_key, CASE WHEN o_orderkey % 2 = 0 THEN 'named' ELSE lower(replace(o_orderpriority, ' ', '')) END AS family,
'fam | run ' || o_custkey || ' | risk=0.5 | conc=0.1' AS label, CASE WHEN o_orderkey % 3 = 0 THEN -1.0 ELSE o_totalprice END AS first_value FROM orders""")
def column_functions(spark, sf):
    """Times as an API writes and reads them (every fourth unreadable), sample keys, labels, families, and the first of several columns."""
    o = S.read(spark, sf, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    o = o.withColumn("sent_at", scalar.format_api_timestamp("ts")).withColumn("a", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    back = scalar.api_timestamp(F.when(F.col("o_orderkey") % 4 != 0, F.col("sent_at")).otherwise(F.concat(F.lit("at "), "sent_at")))
    family = scalar.model_family(F.when(F.col("o_orderkey") % 2 == 0, "named").otherwise(" "), F.concat(F.lit("models.nets."), F.replace("o_orderpriority", F.lit(" "), F.lit(""))))
    return o.select(
        "o_orderkey", "sent_at", scalar.api_date("ts").alias("day"), back.cast("timestamp_ntz").alias("parsed"), scalar.sample_key("o_orderstatus", F.lit("q1"), "ts").alias("sample_key"), family.alias("family"),
        scalar.strategy_label("o_custkey", F.lit("fam"), F.lit(0.5), F.lit(0.1)).alias("label"), scalar.first_of(o, ["not there", "a"], -1.0).alias("first_value"),
    )


@query(f"WITH {S.SQL_PRICES} SELECT ticker, date, price FROM prices WHERE date >= DATE '1997-01-01'")
def chosen_close(spark, sf):
    """The first column that is named after a close, from a start date with an open end."""
    p = S.prices(spark, sf).select("ticker", "date", F.lit(0.0).alias("Open"), F.col("price").alias("Adj. Close"), F.lit(1.0).alias("Close"))
    return statements.between_dates(p, "date", "1997-01-01", None).select("ticker", "date", F.col(f"`{statements.close_column(p.columns)}`").alias("price"))


@query(f"""WITH {S.SQL_PANEL}, {S.SQL_MACRO}, {S.SQL_PRICES}, {S.SQL_TECHNICAL}, {S.SQL_STORIES}, {_TOPICS}, n AS (SELECT count(*) AS rows FROM panel),
f AS (SELECT 'economics' AS family, count(DISTINCT name) AS features FROM macro UNION ALL SELECT 'technical', (count(sma) > 0)::BIGINT + (count(rsi) > 0)::BIGINT FROM technical UNION ALL SELECT 'topics', count(DISTINCT topic) FROM topic)
SELECT family, features, rows FROM f, n UNION ALL SELECT 'all', sum(features)::BIGINT + 2, any_value(rows) FROM f, n""")
def feature_profile(spark, sf):
    """The features of each family of the merged panel, whose columns come from the names in the data, after a merge's helper columns are dropped; f2 is excluded."""
    p = S.panel(spark, sf)
    topics = stories.widen(stories.topic_relevance(S.stories(spark, sf)), ["ticker", "time_range"], "topic", "relevance", prefix="topic_relevance_")
    wide = panel.merge_panel(p, topics, indicators.economics_table(S.macro(spark, sf)), indicators.technical_table(S.technical(spark, sf)))
    clean = panel.drop_merge_helpers(wide.withColumn("quarter_end_date_econ", F.lit(1)))
    names = scalar.feature_columns(clean, exclude=["f2"], exclude_prefixes=("future_",))
    counted = scalar.feature_profile(names)
    return clean.agg(F.count("*").alias("rows"), F.array(*[F.struct(F.lit(k).alias("family"), F.lit(v).cast("long").alias("features")) for k, v in counted.items()]).alias("f")).select("rows", F.explode("f").alias("f")).select("f.family", "f.features", "rows")


@query("""WITH ranges AS (SELECT o_orderpriority AS name, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1), w AS (SELECT name, unnest(generate_series(a, b, INTERVAL 90 DAY)) AS s, b FROM ranges),
k AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY s) - 1 AS win FROM w WHERE s < b)
SELECT count(*) AS planned, count(*) FILTER (WHERE win % 2 = 0) AS executed, (3 * count(*) FILTER (WHERE win % 2 = 0))::BIGINT AS articles FROM k""")
def fetch_counters(spark, sf):
    """Every other planned request window has landed, with three articles in two files."""
    ranges = S.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.min("o_orderdate").cast("timestamp").alias("start"), F.max("o_orderdate").cast("timestamp").alias("end"))
    planned = indicators.request_windows(ranges, 90)
    landed = planned.where("window % 2 = 0").select("name", "window", F.explode(F.array(F.lit(1), F.lit(2))).alias("articles"))
    return indicators.fetch_summary(planned, landed, ["name", "window"])


@query("""SELECT p_partkey, 'sma' AS name, coalesce(v.c, 'sma') AS resolved, CASE WHEN v.c = 'close' THEN p_retailprice ELSE p_size END::DOUBLE AS value FROM part, (VALUES (NULL), ('close')) v(c)""")
def indicator_values(spark, sf):
    """Indicators configured by name alone, or with a column: the value of each part's payload."""
    config = indicators.indicator_configs(spark, ["sma", {"name": "sma", "column": "close"}])
    fields = F.create_map(F.lit("close"), F.col("p_retailprice").cast("double"), F.lit("sma"), F.col("p_size").cast("double"))
    rows = S.read(spark, sf, "part").select("p_partkey", fields.alias("values")).crossJoin(F.broadcast(config))
    wanted = F.coalesce("column", F.lit(indicators.value_field(["date", "close", "sma"])))
    return rows.select("p_partkey", "name", wanted.alias("resolved"), indicators.resolved_value("values", wanted).alias("value"))


@query(_SPLIT + "SELECT ticker, quarter_end_date, 'val' AS evaluation_scope, f1 FROM st WHERE split = 'val' UNION ALL SELECT ticker, quarter_end_date, 'all', f1 FROM st")
def scope_rows(spark, sf):
    p = _state(spark, sf)
    both = samples.scope_rows(p, "val").unionByName(samples.scope_rows(p, "all"))
    return both.select("ticker", "quarter_end_date", "evaluation_scope", "f1")
