"""The engine's input tables, made at query time from the driver's tables, and the same in SQL.

Values are rounded where they are made, so that both engines go on from equal numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.scalar import period_tag, quarter_end


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ticker() -> F.Column:
    return F.col("l_suppkey").cast("string").alias("ticker")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(_ticker(), F.to_date("l_shipdate").alias("date")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 9).alias("price"))


SQL_QE = "last_day(date_trunc('quarter', {0})::DATE + INTERVAL 2 MONTH)"
SQL_TAG = "'q' || quarter({0}) || 'y' || year({0})"
SQL_PRICES = "prices AS (SELECT l_suppkey::VARCHAR AS ticker, l_shipdate::DATE AS date, round(avg(l_extendedprice / l_quantity), 9) AS price FROM lineitem GROUP BY 1, 2)"


def statements(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    li = read(spark, sf_dir, "lineitem").withColumn("report_date", quarter_end(F.to_date("l_shipdate")))
    e, d, t, q = (F.col(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity"))
    made = lambda rows, cols: rows.groupBy(_ticker(), "report_date").agg(*[F.round(x, 6).alias(n) for n, x in cols.items()])
    net = F.sum(e * (1 - d - t)) - 0.9 * F.sum(e)
    return {
        "income": made(li.where("l_returnflag <> 'R'"), {"rev": F.sum(e), "ni": net, "gp": 0.5 * F.sum(e * (1 - d)), "op_inc": 1.2 * net, "rnd": F.sum(e * t), "shares_diluted": 100 * F.sum(q), "shares_basic": 90 * F.sum(q), "dep_amort": 10 * F.sum(q), "cogs": 0.6 * F.sum(e), "sga": 0.1 * F.sum(e * (1 + d))}),
        "balance": made(li.where("l_linestatus = 'F'"), {"assets": 2 * F.sum(e), "liabilities": 1.1 * F.sum(e * (1 - d)), "curr_assets": 0.8 * F.sum(e), "curr_liab": 10 * F.sum(e * t), "equity": F.sum(e) * 0.9, "receivables": F.sum(e * d), "ppe": 100 * F.sum(q)}),
        "cashflow": made(li.where("l_returnflag = 'A'"), {"op_cash": 0.3 * F.sum(e * (1 - d)) - 0.28 * F.sum(e), "change_ppe": -5 * F.sum(q), "div_paid": -0.1 * F.sum(e * d), "repurchase": -0.2 * F.sum(e * t)}),
    }


_NET = "(sum(l_extendedprice * (1 - l_discount - l_tax)) - 0.9 * sum(l_extendedprice))"


def _made(where: str, cols: dict[str, str]) -> str:
    return f"SELECT l_suppkey::VARCHAR AS ticker, {SQL_QE.format('l_shipdate')} AS report_date, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in cols.items()) + f" FROM lineitem WHERE {where} GROUP BY 1, 2"


SQL_STATEMENTS = ",\n".join([
    "income AS (" + _made("l_returnflag <> 'R'", {"rev": "sum(l_extendedprice)", "ni": _NET, "gp": "0.5 * sum(l_extendedprice * (1 - l_discount))", "op_inc": f"1.2 * {_NET}", "rnd": "sum(l_extendedprice * l_tax)", "shares_diluted": "100 * sum(l_quantity)", "dep_amort": "10 * sum(l_quantity)", "cogs": "0.6 * sum(l_extendedprice)", "sga": "0.1 * sum(l_extendedprice * (1 + l_discount))"}) + ")",
    "balance AS (" + _made("l_linestatus = 'F'", {"assets": "2 * sum(l_extendedprice)", "liabilities": "1.1 * sum(l_extendedprice * (1 - l_discount))", "curr_assets": "0.8 * sum(l_extendedprice)", "curr_liab": "10 * sum(l_extendedprice * l_tax)", "equity": "sum(l_extendedprice) * 0.9", "receivables": "sum(l_extendedprice * l_discount)", "ppe": "100 * sum(l_quantity)"}) + ")",
    "cashflow AS (" + _made("l_returnflag = 'A'", {"op_cash": "0.3 * sum(l_extendedprice * (1 - l_discount)) - 0.28 * sum(l_extendedprice)", "change_ppe": "-5 * sum(l_quantity)", "div_paid": "-0.1 * sum(l_extendedprice * l_discount)", "repurchase": "-0.2 * sum(l_extendedprice * l_tax)"}) + ")",
])


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One story for each order line: the return flag is its label, the discount its score."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_orderkey", "l_linenumber")
    label = F.when(F.col("l_returnflag") == "A", "Somewhat-Bullish").when(F.col("l_returnflag") == "R", "Bearish").otherwise("Neutral")
    topic = lambda name, score: F.struct(F.lit(name).alias("topic"), score.cast("string").alias("relevance_score"))
    listed = F.when(F.col("l_linestatus") == "O", F.array(topic("Earnings", F.col("l_tax")), topic("Life Sciences", F.col("l_discount")))).otherwise(F.array(topic("Earnings", F.col("l_discount"))))
    day = F.to_date("l_shipdate")
    return li.select(
        _ticker(), day.alias("date"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("time_published"), F.concat(F.lit("o"), F.pmod("l_orderkey", F.lit(50))).alias("url"),
        F.round(F.col("l_discount") * 10 - 0.5, 4).alias("overall_sentiment_score"), label.alias("overall_sentiment_label"),
        F.col("l_tax").alias("ticker_relevance_score"), F.round(F.col("l_tax") - F.col("l_discount"), 4).alias("ticker_sentiment_score"), F.to_json(listed).alias("topics_json"), period_tag(day).alias("time_range"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
    )


SQL_STORIES = f"""stories AS (SELECT l_suppkey::VARCHAR AS ticker, l_shipdate::DATE AS date, l_shipdate AS published, 'o' || (l_orderkey % 50) AS url, round(l_discount * 10 - 0.5, 4) AS overall_sentiment_score,
  CASE l_returnflag WHEN 'A' THEN 'up' WHEN 'R' THEN 'down' ELSE 'flat' END AS label, l_tax AS ticker_relevance_score, round(l_tax - l_discount, 4) AS ticker_sentiment_score,
  l_linestatus, l_tax, l_discount, {SQL_TAG.format("l_shipdate")} AS time_range, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem)"""


def news(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Payloads (window, feed) by user: an article for each event, which mentions two tickers. With ``gaps``, every 11th article has no time and every 7th names no ticker first."""
    e = read(spark, sf_dir, "events")
    text = lambda n: F.lit("x").alias(n)
    first = F.when(F.lit(gaps) & (F.col("event_id") % 7 == 0), "").otherwise(F.col("user_id").cast("string"))
    mention = lambda t, k: F.struct(t.alias("ticker"), F.lit("0.5").alias("relevance_score"), F.round(F.col("value") / (k + 2), 4).cast("string").alias("ticker_sentiment_score"), F.lit("Neutral").alias("ticker_sentiment_label"))
    mentions = F.array(mention(first, 0)) if gaps else F.array(mention(first, 0), mention((F.col("user_id") + 1).cast("string"), 1))
    at = F.when(~F.lit(gaps) | (F.col("event_id") % 11 != 0), F.date_format("ts", "yyyyMMdd'T'HHmmss"))
    window = F.pmod("user_id", F.lit(5)).cast("string")
    article = F.struct(text("title"), text("summary"), window.alias("source"), text("source_domain"), text("category_within_source"), F.concat(F.lit("first-" if gaps else ""), F.col("event_id").cast("string")).alias("url"), at.alias("time_published"), F.col("value").cast("string").alias("overall_sentiment_score"), text("overall_sentiment_label"), F.array(F.lit("a")).alias("authors"), F.array(F.struct(F.lit("t").alias("topic"), F.lit("0.1").alias("relevance_score"))).alias("topics"), text("banner_image"), mentions.alias("ticker_sentiment"))
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.any_value(window).alias("window"), F.collect_list(article).alias("feed"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly series (name, date, value) of the orders."""
    months = read(spark, sf_dir, "orders").groupBy(F.to_date(F.trunc("o_orderdate", "month")).alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.count("*").cast("double").alias("n"))
    return months.select(F.explode(F.array(F.struct(F.lit("Order Value").alias("name"), "date", "value"), F.struct(F.lit("order-count").alias("name"), "date", F.col("n").alias("value")))).alias("r")).select("r.*")


SQL_MACRO = """months AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, round(sum(o_totalprice), 2) AS v, count(*)::DOUBLE AS n FROM orders GROUP BY 1),
macro AS (SELECT 'order_value' AS name, date, v AS value FROM months UNION ALL SELECT 'order_count', date, n FROM months)"""


def technical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series (ticker, name, period, timeframe, date, value): the price, and its square root."""
    p = prices(spark, sf_dir)
    series = F.array(F.struct(F.lit("SMA").alias("name"), F.lit(5).alias("period"), F.col("price").alias("value")), F.struct(F.lit("RSI").alias("name"), F.lit(14).alias("period"), F.round(F.sqrt("price"), 7).alias("value")))
    return p.select("ticker", "date", F.explode(series).alias("r")).select("ticker", "r.name", "r.period", F.lit("1day").alias("timeframe"), "date", "r.value")


SQL_TECHNICAL = "technical AS (SELECT ticker, date, price AS sma, round(sqrt(price), 7) AS rsi FROM prices)"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly features by ticker, with one quarter in seven of f2 missing."""
    li = read(spark, sf_dir, "lineitem").withColumn("quarter_end_date", quarter_end(F.to_date("l_shipdate")))
    out = li.groupBy(_ticker(), "quarter_end_date").agg(F.round(F.avg("l_extendedprice"), 8).alias("f1"), F.round(F.sum("l_quantity"), 3).alias("f2"), F.round(F.avg("l_discount"), 9).alias("f3"))
    gap = (F.month("quarter_end_date") + F.year("quarter_end_date") + F.col("ticker").cast("int")) % 7 == 0
    return out.withColumn("f2", F.when(~gap, F.col("f2"))).withColumn("time_range", period_tag("quarter_end_date"))


SQL_PANEL = f"""panel AS (SELECT ticker, quarter_end_date, f1, CASE WHEN (month(quarter_end_date) + year(quarter_end_date) + ticker::INT) % 7 = 0 THEN NULL ELSE f2 END AS f2, f3, {SQL_TAG.format("quarter_end_date")} AS time_range
  FROM (SELECT l_suppkey::VARCHAR AS ticker, {SQL_QE.format("l_shipdate")} AS quarter_end_date, round(avg(l_extendedprice), 8) AS f1, round(sum(l_quantity), 3) AS f2, round(avg(l_discount), 9) AS f3 FROM lineitem GROUP BY 1, 2))"""

def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each nation, with penalties from its keys."""
    n = read(spark, sf_dir, "nation")
    penalties = [F.round(F.col("n_regionkey") * 0.05, 2).alias("risk_penalty"), F.round((F.col("n_nationkey") % 3) * 0.1, 1).alias("concentration_penalty")]
    family = F.when(F.col("n_nationkey") % 2 == 0, "attention").otherwise("bilstm").alias("model_family")
    return n.select(F.col("n_nationkey").alias("run_id"), *penalties, family, F.concat(F.lit("models."), "n_name").alias("model_target"))


#: Runs of the stand-in sweep: id, family, risk and concentration penalty, weight of the score.
RUNS = [(1, "attention", 0.0, 0.0, 1.0), (2, "attention", 0.1, 0.0, -1.0), (3, "attention", 0.0, 0.1, 2.0), (4, "bilstm", 0.0, 0.0, 0.5), (5, "bilstm", 0.1, 0.1, -0.5), (6, "bilstm", 0.1, 0.0, 3.0)]


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNS, "run_id int, model_family string, risk_penalty double, concentration_penalty double, tilt double").withColumn("model_target", F.concat(F.lit("models."), "model_family"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each run for each (quarter, ticker), with current and next quarter's price; the last six quarters validate."""
    from panelspark.operators.targets import attach_targets, period_prices

    p = attach_targets(period_prices(prices(spark, sf_dir)), [1]).where("future_price_t1 is not null")
    split = F.when(F.col("quarter_end_date") >= F.lit("2000-01-01").cast("date"), "val").otherwise("train")
    rows = p.select("ticker", "time_range", "quarter_end_date", F.col("future_quarter_end_date_t1").alias("future_quarter_end_date"), F.col("quarter_price").alias("current_price"), F.col("future_price_t1").alias("future_price"), split.alias("source_split"))
    r = rows.crossJoin(F.broadcast(runs(spark)))
    key = F.concat_ws("__", "source_split", "time_range", F.date_format("quarter_end_date", "yyyy-MM-dd"))
    return r.withColumns({"score": F.col("tilt") * F.col("current_price") / 1000, "sample_key": key, "evaluation_scope": F.lit("all")}).drop("tilt")


SQL_RUNS = "runs(run_id, model_family, risk_penalty, concentration_penalty, tilt) AS (VALUES " + ", ".join(f"({a}, '{b}', {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE)" for a, b, c, d, e in RUNS) + ")"
SQL_QUARTERS = f"quarters AS (SELECT ticker, {SQL_QE.format('date')} AS quarter_end_date, arg_max(price, date) AS quarter_price FROM prices GROUP BY 1, 2)"
SQL_SCORES = f"""{SQL_PRICES}, {SQL_QUARTERS}, {SQL_RUNS},
scores AS (SELECT q.ticker, q.quarter_end_date, f.quarter_end_date AS future_quarter_end_date, q.quarter_price AS current_price, f.quarter_price AS future_price, {SQL_TAG.format("q.quarter_end_date")} AS time_range,
  CASE WHEN q.quarter_end_date >= DATE '2000-01-01' THEN 'val' ELSE 'train' END AS source_split, runs.*, tilt * q.quarter_price / 1000 AS score
  FROM quarters q JOIN quarters f ON f.ticker = q.ticker AND f.quarter_end_date = last_day(q.quarter_end_date + INTERVAL 3 MONTH), runs),
soft AS (SELECT *, exp(score - max(score) OVER s) / sum(exp(score - top)) OVER s AS weight FROM (SELECT *, max(score) OVER (PARTITION BY run_id, quarter_end_date) AS top FROM scores) WINDOW s AS (PARTITION BY run_id, quarter_end_date)),
w AS (SELECT *, 1.0 / count(*) OVER s AS equal_weight, sum(weight * future_price) OVER s / sum(weight * current_price) OVER s AS portfolio_growth, sum(future_price) OVER s / sum(current_price) OVER s AS benchmark_growth,
  max(weight) OVER s AS max_weight, 1 / sum(weight * weight) OVER s AS effective_holdings, future_price / greatest(current_price, 1e-8) - 1 AS ticker_return FROM soft WINDOW s AS (PARTITION BY run_id, quarter_end_date)),
s AS (SELECT run_id, model_family, risk_penalty, concentration_penalty, source_split, time_range, quarter_end_date, count(*) AS ticker_count, any_value(portfolio_growth) AS portfolio_growth, any_value(benchmark_growth) AS benchmark_growth,
  any_value(portfolio_growth) - any_value(benchmark_growth) AS growth_alpha, any_value(max_weight) AS max_weight, any_value(effective_holdings) AS effective_holdings FROM w GROUP BY ALL),
run_sum AS (SELECT run_id, model_family, risk_penalty, concentration_penalty, count(*) AS sample_count, avg(portfolio_growth) AS mean_portfolio_growth, avg(benchmark_growth) AS mean_benchmark_growth, avg(growth_alpha) AS mean_growth_alpha,
  avg(max_weight) AS mean_max_weight, avg(effective_holdings) AS mean_effective_holdings, avg(ticker_count) AS mean_ticker_count, product(portfolio_growth) AS cumulative_growth, product(benchmark_growth) AS benchmark_cumulative_growth FROM s GROUP BY ALL)"""
SQL_SCORES = SQL_SCORES.replace("GROUP BY ALL),\nrun_sum", "GROUP BY run_id, model_family, risk_penalty, concentration_penalty, source_split, time_range, quarter_end_date),\nrun_sum")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.operators.portfolio import SAMPLE, softmax_weights

    return softmax_weights(scores(spark, sf_dir), SAMPLE).drop("score")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector: two price predictions and targets, and logits and classes for both horizons, from its components and label."""
    v = read(spark, sf_dir, "embeddings")
    x = lambda k: F.round(F.get("embedding", F.lit(k)).cast("double"), 4)
    logits = lambda k: F.array(x(k), x(k + 1), x(k + 2))
    day = F.date_add(F.lit("2020-03-31").cast("date"), F.pmod("vec_id", F.lit(5)).cast("int"))
    return v.select(
        F.when(F.col("vec_id") % 3 == 0, "val").otherwise("train").alias("split"), F.col("vec_id").cast("string").alias("ticker"), F.lit("q1y2020").alias("time_range"), day.alias("quarter_end_date"),
        F.array(10 + x(6), 20 + x(7)).alias("price_predictions"), F.array(10 + x(8), 20 + x(9)).alias("price_targets"), F.array(logits(0), logits(3)).alias("class_logits"),
        F.array((F.col("label") % 3).cast("int"), ((F.col("label") + 1) % 3).cast("int")).alias("class_targets"),
    )


def _x(k: int) -> str:
    return f"round(embedding[{k + 1}]::DOUBLE, 4)"


SQL_PREDICTIONS = f"""vectors AS (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 'val' ELSE 'train' END AS split, DATE '2020-03-31' + (vec_id % 5)::INT AS quarter_end_date, {", ".join(f"{_x(k)} AS x{k}" for k in range(10))} FROM embeddings),
pred AS (SELECT vec_id, split, quarter_end_date, 1 AS horizon, 10 + x6 AS p, 10 + x8 AS t, x0 AS a, x1 AS b, x2 AS c, label % 3 AS y FROM vectors
  UNION ALL SELECT vec_id, split, quarter_end_date, 4, 20 + x7, 20 + x9, x3, x4, x5, (label + 1) % 3 FROM vectors),
err AS (SELECT *, p - t AS e, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS cls, ln(exp(a) + exp(b) + exp(c)) - CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS ce FROM pred)"""
