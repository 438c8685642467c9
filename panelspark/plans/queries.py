"""The registered queries: each applies operators to the driver's tables, beside the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import scalar
from panelspark.operators import checks, indicators, normalize, portfolio, predictions, samples, statements, stories, targets, windows
from panelspark.operators import panel as panels
from panelspark.plans import jobs
from panelspark.plans import stand_ins as S
from panelspark.streaming.stories import story_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded; other columns as they are."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema])


def r(*names: str, digits: int = 8) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n.split('.')[-1]}" for n in names)


# ---- prices and targets ----------------------------------------------------------


@query(f"WITH {S.SQL_PRICES}, {S.SQL_QUARTERS} SELECT ticker, quarter_end_date, quarter_price, {S.SQL_TAG.format('quarter_end_date')} AS time_range FROM quarters")
def quarter_prices(spark, sf):
    return targets.period_prices(S.prices(spark, sf))


_TARGETS = f"""WITH {S.SQL_PRICES}, {S.SQL_QUARTERS},
t AS (SELECT q.ticker, q.quarter_end_date, h AS horizon, q.quarter_price, f.quarter_end_date AS future_date, f.quarter_price AS future_price, (f.quarter_price - q.quarter_price) / q.quarter_price AS ret
  FROM quarters q CROSS JOIN (VALUES (1), (2), (3), (4)) v(h) LEFT JOIN quarters f ON f.ticker = q.ticker AND f.quarter_end_date = last_day(q.quarter_end_date + to_months(3 * h))),
c AS (SELECT *, CASE WHEN ret < -0.02 THEN 0 WHEN ret > 0.02 THEN 2 WHEN ret IS NOT NULL THEN 1 END AS class_target FROM t)
"""


@query(_TARGETS + "SELECT ticker, quarter_end_date, horizon, quarter_price, future_date, future_price, round(ret, 9) AS future_return, class_target FROM c")
def future_targets(spark, sf):
    long = targets.future_prices(targets.period_prices(S.prices(spark, sf)), [1, 2, 3, 4])
    return rounded(long.select("ticker", "quarter_end_date", "horizon", "quarter_price", "future_date", "future_price", "future_return", "class_target"), 9)


@query(_TARGETS + """SELECT ticker, quarter_end_date, max(future_price) FILTER (WHERE horizon = 1) AS future_price_t1, max(future_price) FILTER (WHERE horizon = 4) AS future_price_t4,
max(future_date) FILTER (WHERE horizon = 4) AS future_quarter_end_date_t4, max(class_target) FILTER (WHERE horizon = 1) AS class_target_t1, round(max(ret) FILTER (WHERE horizon = 4), 9) AS future_return_t4 FROM c GROUP BY 1, 2""")
def wide_targets(spark, sf):
    wide = targets.attach_targets(targets.period_prices(S.prices(spark, sf)), [1, 2, 3, 4])
    return rounded(wide.select("ticker", "quarter_end_date", "future_price_t1", "future_price_t4", "future_quarter_end_date_t4", "class_target_t1", "future_return_t4"), 9)


@query(f"""WITH {S.SQL_PRICES.replace("AS (", "AS MATERIALIZED (", 1)}, asked AS MATERIALIZED (SELECT ticker, date, h AS horizon, (date + h)::DATE AS future FROM prices, (SELECT unnest([1, 7, 30]) AS h))
SELECT a.ticker, a.date AS quarter_end_date, a.horizon, f.price AS future_price FROM asked a LEFT JOIN prices f ON f.ticker = a.ticker AND f.date = a.future""")
def daily_targets(spark, sf):
    daily = targets.period_prices(S.prices(spark, sf), "daily")
    return targets.future_prices(daily, [1, 7, 30], freq="daily").select("ticker", "quarter_end_date", "horizon", "future_price")


@query(f"""WITH {S.SQL_PRICES}, {S.SQL_PANEL}, u AS (SELECT * FROM panel WHERE ticker::INT % 2 = 0 AND quarter_end_date BETWEEN DATE '1996-06-30' AND DATE '1999-12-31'),
b AS (SELECT date_trunc('quarter', min(quarter_end_date)) AS a, last_day(max(quarter_end_date) + INTERVAL 12 MONTH) AS z FROM u)
SELECT prices.* FROM prices, b WHERE ticker IN (SELECT ticker FROM u) AND date BETWEEN a AND z""")
def universe_prices(spark, sf):
    universe = S.panel(spark, sf).where("cast(ticker AS int) % 2 = 0 AND quarter_end_date BETWEEN DATE '1996-06-30' AND DATE '1999-12-31'")
    return targets.universe_prices(S.prices(spark, sf), universe, [1, 4])


# ---- statements ------------------------------------------------------------------

_FILED = f"""WITH {S.SQL_PRICES}, {S.SQL_STATEMENTS},
filed AS (SELECT i.*, b.* EXCLUDE (ticker, report_date), c.* EXCLUDE (ticker, report_date) FROM income i JOIN balance b USING (ticker, report_date) LEFT JOIN cashflow c USING (ticker, report_date)),
rec AS (SELECT filed.*, p.price AS close, p.price * shares_diluted AS cap, -coalesce(change_ppe, 0) AS capex, coalesce(op_cash + coalesce(change_ppe, 0), 0) AS fcf
  FROM filed ASOF LEFT JOIN prices p ON p.ticker = filed.ticker AND p.date <= filed.report_date),
ttm AS (SELECT *, {", ".join(f"sum({'coalesce(' + c + ', 0)' if c in ('rnd', 'div_paid', 'repurchase') else c}) OVER w AS ttm_{c}" for c in statements.FLOWS)}, {", ".join(f"avg({c}) OVER w AS ttm_{c}" for c in statements.STOCKS)}
  FROM rec WINDOW w AS (PARTITION BY ticker ORDER BY report_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
"""


def _records(spark, sf) -> DataFrame:
    s = S.statements(spark, sf)
    return statements.raw_records(statements.align_statements(s["income"], s["balance"], s["cashflow"]), S.prices(spark, sf))


@query(_FILED + "SELECT ticker, report_date, rev, ni, assets, op_cash FROM filed")
def aligned_statements(spark, sf):
    s = S.statements(spark, sf)
    return statements.align_statements(s["income"], s["balance"], s["cashflow"]).select("ticker", "report_date", "rev", "ni", "assets", "op_cash")


@query(_FILED + "SELECT ticker, report_date, close, cap AS mkt_cap, capex, round(fcf, 6) AS fcf FROM rec")
def as_of_market_cap(spark, sf):
    return _records(spark, sf).select("ticker", "report_date", "close", "mkt_cap", "capex", F.round("fcf", 6).alias("fcf"))


@query(_FILED + f"SELECT ticker, report_date, {r(*[f'ttm_{c}' for c in statements.FLOWS + statements.STOCKS], digits=7)} FROM ttm")
def trailing_values(spark, sf):
    t = statements.trailing_values(_records(spark, sf))
    return rounded(t.select("ticker", "report_date", *[f"ttm_{c}" for c in statements.FLOWS + statements.STOCKS]), 7)


_RATIOS = _FILED + """, ratio AS (SELECT ticker, report_date, ttm_gp / nullif(ttm_rev, 0) AS gross_margin, ttm_ni / nullif(ttm_rev, 0) AS net_margin, ttm_ni / nullif(ttm_assets, 0) AS roa, ttm_rev / nullif(ttm_assets, 0) AS asset_turnover,
  ttm_curr_assets / nullif(ttm_curr_liab, 0) AS current_ratio, ttm_liabilities / nullif(ttm_equity, 0) AS debt_to_equity, ttm_fcf / nullif(mkt_cap, 0) AS fcf_yield, ttm_rnd / nullif(ttm_rev, 0) AS rd_intensity, ttm_capex / nullif(ttm_rev, 0) AS capex_to_sales,
  mkt_cap / nullif(ttm_ni, 0) AS pe_ratio, mkt_cap / nullif(ttm_rev, 0) AS ps_ratio, (mkt_cap + ttm_liabilities) / nullif(op_inc + coalesce(dep_amort, 0), 0) AS ev_ebitda, (abs(ttm_repurchase) + abs(ttm_div_paid)) / nullif(mkt_cap, 0) AS buyback_yield,
  (ttm_rev - lag(ttm_rev) OVER w) / nullif(lag(ttm_rev) OVER w, 0) AS revenue_growth_yoy, (ttm_ni - lag(ttm_ni) OVER w) / nullif(lag(ttm_ni) OVER w, 0) AS eps_growth_yoy,
  1.2 * (ttm_curr_assets - ttm_curr_liab) / nullif(ttm_assets, 0) + 1.4 * ttm_ni / nullif(ttm_assets, 0) AS altman_zscore
  FROM (SELECT *, CASE WHEN cap >= 1e6 THEN cap END AS mkt_cap FROM ttm) WINDOW w AS (PARTITION BY ticker ORDER BY report_date))
"""
_RATIO_NAMES = ["gross_margin", "net_margin", "roa", "asset_turnover", "current_ratio", "debt_to_equity", "fcf_yield", "rd_intensity", "capex_to_sales", "pe_ratio", "ps_ratio", "ev_ebitda", "buyback_yield", "revenue_growth_yoy", "eps_growth_yoy", "altman_zscore"]


def _features(spark, sf) -> DataFrame:
    return statements.ratio_features(statements.trailing_values(_records(spark, sf)))


@query(_RATIOS + f"SELECT ticker, report_date, {r(*_RATIO_NAMES, digits=4)} FROM ratio")
def ratio_features(spark, sf):
    return rounded(_features(spark, sf).select("ticker", "report_date", *_RATIO_NAMES), 4)


_BEFORE = ["rev", "ni", "gp", "op_cash", "assets", "liabilities", "curr_assets", "curr_liab", "receivables", "ppe", "dep_amort", "cogs", "sga"]


@query(_FILED + f""", p AS (SELECT *, {", ".join(f"lag({c}) OVER w AS p_{c}" for c in _BEFORE)}, row_number() OVER w AS k FROM rec WINDOW w AS (PARTITION BY ticker ORDER BY report_date)),
f AS (SELECT ticker, report_date, (ni / assets > 0)::INT + coalesce(op_cash > 0, false)::INT + (ni / assets > p_ni / p_assets)::INT + coalesce(op_cash > ni, false)::INT + (liabilities / assets < p_liabilities / p_assets)::INT
  + coalesce(curr_assets / nullif(curr_liab, 0) > p_curr_assets / nullif(p_curr_liab, 0), curr_liab = 0 AND p_curr_liab > 0)::INT + (gp / rev > p_gp / p_rev)::INT + (rev / assets > p_rev / p_assets)::INT AS f,
  least(greatest(CASE WHEN p_receivables > 0 THEN (receivables / rev) / (p_receivables / p_rev) ELSE 1 END, 0.01), 10) AS dsri,
  least(greatest(CASE WHEN rev - cogs > 0 THEN ((p_rev - p_cogs) / p_rev) / ((rev - cogs) / rev) ELSE 1 END, 0.01), 10) AS gmi,
  (1 - (curr_assets + ppe) / assets) / (1 - (p_curr_assets + p_ppe) / p_assets) AS aqi, rev / p_rev AS sgi,
  (p_dep_amort / (p_ppe + p_dep_amort)) / (dep_amort / (ppe + dep_amort)) AS depi, (sga / rev) / (p_sga / p_rev) AS sgai, (liabilities / assets) / (p_liabilities / p_assets) AS lvgi,
  -1.32 - 0.407 * ln(assets) + 6.03 * liabilities / assets - 1.43 * (curr_assets - curr_liab) / assets + 0.0757 * curr_liab / curr_assets - 1.72 * (liabilities > assets)::INT - 2.37 * ni / assets - 1.83 * op_cash / liabilities
  + 0.285 * (ni < 0 AND p_ni < 0)::INT - 0.521 * (ni - p_ni) / (abs(ni) + abs(p_ni)) AS o FROM p WHERE k > 1)
SELECT ticker, report_date, f::DOUBLE AS piotroski_fscore, round(-4.84 + 0.920 * dsri + 0.528 * gmi + 0.404 * least(greatest(aqi, 0.01), 10) + 0.892 * least(greatest(sgi, 0.01), 10) + 0.115 * least(greatest(depi, 0.01), 10) - 0.172 * least(greatest(sgai, 0.01), 10) - 0.327 * least(greatest(lvgi, 0.01), 10), 4) AS beneish_mscore,
round(CASE WHEN o <= 709.78 THEN exp(o) / (1 + exp(o)) END, 4) AS ohlson_oscore FROM f""")
def accounting_scores(spark, sf):
    first = F.row_number().over(windows.by("ticker", "report_date"))
    scored = _features(spark, sf).withColumn("k", first).where("k > 1")
    return rounded(scored.select("ticker", "report_date", "piotroski_fscore", "beneish_mscore", "ohlson_oscore"), 4)


@query(_RATIOS + """, q AS (SELECT quantile_cont(roa, 0.01) AS a, quantile_cont(roa, 0.99) AS b, quantile_cont(pe_ratio, 0.01) AS c, quantile_cont(pe_ratio, 0.99) AS d FROM ratio)
SELECT ticker, report_date, round(CASE WHEN roa IS NOT NULL THEN least(greatest(roa, a), b) END, 8) AS roa, round(CASE WHEN pe_ratio IS NOT NULL THEN least(greatest(pe_ratio, c), d) END, 3) AS pe_ratio FROM ratio, q""")
def winsorized(spark, sf):
    w = statements.winsorize(_features(spark, sf).select("ticker", "report_date", "roa", "pe_ratio"), ["roa", "pe_ratio"])
    return w.select("ticker", "report_date", F.round("roa", 8).alias("roa"), F.round("pe_ratio", 3).alias("pe_ratio"))


_WINSOR = ", ".join(f"quantile_cont({c}, 0.01) AS {c}_a, quantile_cont({c}, 0.99) AS {c}_b" for c in _RATIO_NAMES if c in statements.WINSORIZED)
_CLIPPED = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, {c}_b), {c}_a) END AS {c}" if c in statements.WINSORIZED else c for c in _RATIO_NAMES)
_Z = ", ".join(f"round(({c} - avg({c}) OVER z) / nullif(stddev_samp({c}) OVER z, 0), 3) AS {c}" for c in statements.Z_SCORED)


@query(_RATIOS + f""", q AS (SELECT {_WINSOR} FROM ratio), w AS (SELECT ticker, report_date, {_CLIPPED} FROM ratio, q),
n AS (SELECT a.ticker, a.report_date, count(*) AS rows, count(b.pe_ratio) AS seen, count(*) FILTER (WHERE b.pe_ratio < a.pe_ratio) AS lower FROM w a JOIN w b ON b.ticker = a.ticker AND b.report_date <= a.report_date GROUP BY 1, 2)
SELECT w.ticker, w.report_date, round(gross_margin, 4) AS gross_margin, round(altman_zscore, 4) AS altman_zscore, {_Z}, round(CASE WHEN seen > 0 THEN lower / rows END, 8) AS pe_ratio FROM w JOIN n USING (ticker, report_date)
WINDOW z AS (PARTITION BY ticker ORDER BY report_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def fundamental_dataset(spark, sf):
    s = S.statements(spark, sf)
    out = statements.fundamental_dataset(s["income"], s["balance"], s["cashflow"], S.prices(spark, sf))
    z = [F.round(c, 3).alias(c) for c in statements.Z_SCORED]
    return out.select("ticker", "report_date", F.round("gross_margin", 4).alias("gross_margin"), F.round("altman_zscore", 4).alias("altman_zscore"), *z, F.round("pe_ratio", 8).alias("pe_ratio"))


@query("""SELECT 'S-' || s_suppkey AS ticker, CASE WHEN s_suppkey % 3 = 0 THEN 'S.' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'S-' || s_suppkey END AS listed_as FROM supplier""")
def symbol_aliases(spark, sf):
    k = S.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    wanted = k.select(F.concat(F.lit("S-"), "k").alias("ticker"))
    listed = k.where("k % 3 < 2").select(F.explode(F.when(F.col("k") % 3 == 0, F.array(F.concat(F.lit("S."), "k"))).otherwise(F.array(F.concat(F.lit("S."), "k"), F.concat(F.lit("S-"), "k")))).alias("ticker"))
    return statements.pick_alias(wanted, listed)


# ---- stories ---------------------------------------------------------------------


@query(f"WITH {S.SQL_STORIES}, d AS (SELECT *, row_number() OVER (PARTITION BY ticker, published, url ORDER BY ordinal) AS k FROM stories) SELECT ticker, date, url, ordinal FROM d WHERE k = 1")
def deduplicated_stories(spark, sf):
    return stories.deduplicate_stories(S.stories(spark, sf), "ordinal").select("ticker", "date", "url", "ordinal")


_STORY_AGG = """agg AS (SELECT ticker, time_range, max(date) AS story_date, count(*) AS story_count, avg(overall_sentiment_score) AS overall_sentiment_mean, avg(ticker_sentiment_score) AS ticker_sentiment_mean, avg(ticker_relevance_score) AS ticker_relevance_mean,
  count(*) FILTER (WHERE label = 'up') AS bullish_count, count(*) FILTER (WHERE label = 'down') AS bearish_count, count(*) FILTER (WHERE label = 'flat') AS neutral_count FROM stories GROUP BY 1, 2)"""


@query(f"WITH {S.SQL_STORIES}, {_STORY_AGG} SELECT ticker, time_range, story_date, story_count, {r('overall_sentiment_mean', 'ticker_sentiment_mean', 'ticker_relevance_mean')}, bullish_count, bearish_count, neutral_count, round(bullish_count / (bearish_count + 1e-8), 4) AS bullish_bearish_ratio FROM agg")
def story_aggregates(spark, sf):
    return rounded(stories.aggregate_stories(S.stories(spark, sf))).withColumn("bullish_bearish_ratio", F.round("bullish_bearish_ratio", 4))


_TOPICS = """topic AS (SELECT ticker, time_range, 'earnings' AS topic, sum(CASE l_linestatus WHEN 'O' THEN l_tax ELSE l_discount END) / count(*) AS relevance FROM stories GROUP BY 1, 2
  UNION ALL SELECT ticker, time_range, 'life_sciences', sum(l_discount) FILTER (WHERE l_linestatus = 'O') / count(*) FROM stories GROUP BY 1, 2 HAVING count(*) FILTER (WHERE l_linestatus = 'O') > 0)"""


@query(f"WITH {S.SQL_STORIES}, {_TOPICS} SELECT ticker, time_range, topic, round(relevance, 8) AS relevance FROM topic")
def topic_relevance(spark, sf):
    return rounded(stories.topic_relevance(S.stories(spark, sf)))


@query("""SELECT (user_id + k)::VARCHAR AS ticker, event_id::VARCHAR AS url, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time_published, value AS overall_sentiment_score, round(value / (k + 2), 4) AS ticker_sentiment_score
FROM events, (VALUES (0), (1)) v(k)""")
def news_rows(spark, sf):
    payload = S.news(spark, sf)
    return stories.story_rows(payload).select("ticker", "url", "date", "time_published", "overall_sentiment_score", "ticker_sentiment_score")


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, user_id::VARCHAR AS ticker, count(*) AS story_count, round(avg(value), 8) AS overall_sentiment_mean, count(*) FILTER (WHERE event_type = 'purchase') AS bullish_count, count(*) FILTER (WHERE event_type = 'error') AS bearish_count
FROM (SELECT DISTINCT ON (user_id, ts, event_id % 7) * FROM events) GROUP BY 1, 2""")
def windowed_stories(spark, sf):
    label = F.when(F.col("event_type") == "purchase", "Bullish").when(F.col("event_type") == "error", "Bearish").otherwise("Neutral")
    e = S.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("timestamp").alias("published"), F.col("event_id") % 7, label.alias("overall_sentiment_label"), F.col("value").alias("overall_sentiment_score"))
    e = e.withColumnRenamed("(event_id % 7)", "url")
    out = rounded(story_stream(e))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# ---- indicators and panel --------------------------------------------------------


@query(f"WITH {S.SQL_MACRO} SELECT max(date) AS date, {S.SQL_TAG.format('date')} AS time_range, arg_max(v, date) AS econ_order_value, arg_max(n, date) AS econ_order_count FROM months GROUP BY 2")
def economics_table(spark, sf):
    return indicators.economics_table(S.macro(spark, sf))  # finds the names itself


@query(f"WITH {S.SQL_PRICES}, {S.SQL_TECHNICAL} SELECT ticker, max(date) AS date, {S.SQL_TAG.format('date')} AS time_range, arg_max(sma, date) AS tech_sma_5_1day, arg_max(rsi, date) AS tech_rsi_14_1day FROM technical GROUP BY 1, 3")
def technical_table(spark, sf):
    return _technical(spark, sf)


def _technical(spark, sf) -> DataFrame:
    return indicators.technical_table(S.technical(spark, sf), ["tech_sma_5_1day", "tech_rsi_14_1day"])


@query(f"""WITH {S.SQL_PRICES}, {S.SQL_TECHNICAL}, {S.SQL_STORIES}, {_STORY_AGG}, {S.SQL_MACRO}, {S.SQL_PANEL},
econ AS (SELECT {S.SQL_TAG.format("date")} AS time_range, arg_max(v, date) AS econ_order_value, arg_max(n, date) AS econ_order_count FROM months GROUP BY 1),
tech AS (SELECT ticker, {S.SQL_TAG.format("date")} AS time_range, arg_max(sma, date) AS tech_sma_5_1day, arg_max(rsi, date) AS tech_rsi_14_1day FROM technical GROUP BY 1, 2)
SELECT p.ticker, p.time_range, p.quarter_end_date, f1, f2, coalesce(story_count, 0) AS story_count, round(coalesce(overall_sentiment_mean, 0), 9) AS overall_sentiment_mean, econ_order_value, econ_order_count, tech_sma_5_1day, tech_rsi_14_1day
FROM panel p LEFT JOIN agg ON agg.ticker = p.ticker AND agg.time_range = p.time_range LEFT JOIN econ ON econ.time_range = p.time_range LEFT JOIN tech ON tech.ticker = p.ticker AND tech.time_range = p.time_range""")
def merged_panel(spark, sf):
    out = panels.merge_panel(S.panel(spark, sf), stories.aggregate_stories(S.stories(spark, sf)), indicators.economics_table(S.macro(spark, sf), ["econ_order_value", "econ_order_count"]), _technical(spark, sf))
    out = panels.zero_fill(out, ["story_count", "overall_sentiment_mean"])
    return rounded(out.select("ticker", "time_range", "quarter_end_date", "f1", "f2", "story_count", "overall_sentiment_mean", "econ_order_value", "econ_order_count", "tech_sma_5_1day", "tech_rsi_14_1day"), 9)


@query(f"""WITH {S.SQL_PANEL}, spine AS (SELECT ticker, unnest(generate_series(min(quarter_end_date), max(quarter_end_date), INTERVAL 1 DAY))::DATE AS d FROM panel GROUP BY 1),
f AS (SELECT spine.ticker, d, last_value(f1 IGNORE NULLS) OVER w AS f1, last_value(f2 IGNORE NULLS) OVER w AS f2 FROM spine LEFT JOIN panel p ON p.ticker = spine.ticker AND p.quarter_end_date = d WINDOW w AS (PARTITION BY spine.ticker ORDER BY d))
SELECT ticker, year(d)::INT AS y, count(*) AS days, count(f2) AS filled, round(sum(f1), 2) AS f1, round(sum(f2), 2) AS f2 FROM f GROUP BY 1, 2""")
def daily_panel(spark, sf):
    daily = panels.to_daily(S.panel(spark, sf).select("ticker", "quarter_end_date", "f1", "f2"))
    return daily.groupBy("ticker", F.year("quarter_end_date").alias("y")).agg(F.count("*").alias("days"), F.count("f2").alias("filled"), F.round(F.sum("f1"), 2).alias("f1"), F.round(F.sum("f2"), 2).alias("f2"))


_SPLIT = f"""WITH {S.SQL_PANEL}, d AS (SELECT quarter_end_date AS d, row_number() OVER (ORDER BY quarter_end_date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT quarter_end_date FROM panel)),
b AS (SELECT max(d) FILTER (WHERE k = greatest(1, floor(n * 0.7))) AS train_end, max(d) FILTER (WHERE k = greatest(1, floor(n * 0.7)) + greatest(1, floor(n * 0.15))) AS val_end FROM d),
rows AS (SELECT panel.*, CASE WHEN quarter_end_date <= train_end THEN 'train' WHEN quarter_end_date <= val_end THEN 'val' ELSE 'test' END AS split, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n
  FROM panel, b WINDOW w AS (PARTITION BY ticker ORDER BY quarter_end_date)),
st AS (SELECT *, i + 1 >= 4 AS window_ready, i + 2 < n AS horizon_target_ready FROM rows)
"""
_CONFIG = panels.PanelConfig(sequence_length=4, horizon=2)


def _state(spark, sf) -> DataFrame:
    p = S.panel(spark, sf)
    return panels.assign_splits(panels.annotate_rows(p, 4, 1, 2), panels.split_boundaries(p, "quarter_end_date", 0.7, 0.15), "quarter_end_date")


@query(_SPLIT + "SELECT ticker, quarter_end_date, split, i::INT AS ticker_history_index, window_ready, horizon_target_ready FROM st")
def split_rows(spark, sf):
    return _state(spark, sf).select("ticker", "quarter_end_date", "split", "ticker_history_index", "window_ready", "horizon_target_ready")


@query(_SPLIT + "SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, count(DISTINCT quarter_end_date) AS dates, count(DISTINCT time_range) AS periods, count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'val') AS val_rows, count(*) FILTER (WHERE split = 'test') AS test_rows FROM st")
def panel_counters(spark, sf):
    return panels.counters(_state(spark, sf))


@query(_SPLIT + """, m AS (SELECT median(f1) FILTER (WHERE split = 'train') AS m1, median(f2) FILTER (WHERE split = 'train') AS m2, median(f3) FILTER (WHERE split = 'train') AS m3 FROM st),
im AS (SELECT ticker, quarter_end_date, split, coalesce(f1, m1) AS f1, coalesce(f2, m2) AS f2, coalesce(f3, m3) AS f3 FROM st, m),
sc AS (SELECT avg(f1) AS a1, stddev_pop(f1) AS s1, avg(f2) AS a2, stddev_pop(f2) AS s2, avg(f3) AS a3, stddev_pop(f3) AS s3 FROM im WHERE split = 'train')
SELECT ticker, quarter_end_date, split, round((f1 - a1) / s1, 8) AS f1, round((f2 - a2) / s2, 8) AS f2, round((f3 - a3) / s3, 8) AS f3 FROM im, sc""")
def preprocessed_panel(spark, sf):
    rows, _ = jobs.preprocess(S.panel(spark, sf), None, None, None, _CONFIG)
    return rounded(rows.select("ticker", "quarter_end_date", "split", "f1", "f2", "f3"))


@query(f"""WITH {S.SQL_PANEL} SELECT ticker, quarter_end_date, round((f1 - avg(f1) OVER w) / nullif(stddev_samp(f1) OVER w, 0), 8) AS z, (SELECT count(*) FILTER (WHERE b.f1 < panel.f1) / count(*) FROM panel b WHERE b.ticker = panel.ticker AND b.quarter_end_date <= panel.quarter_end_date) AS share
FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY quarter_end_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def history_features(spark, sf):
    p = S.panel(spark, sf)
    scored = p.select("ticker", "quarter_end_date", F.round(windows.rolling_zscore("f1", "ticker", "quarter_end_date"), 8).alias("z"), F.col("f1").alias("share"))
    return windows.historical_percentiles(scored, ["share"], "ticker", "quarter_end_date")


@query("""WITH ranges AS (SELECT o_orderpriority AS name, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1),
w AS (SELECT name, b, unnest(generate_series(a, b, INTERVAL 90 DAY)) AS s FROM ranges),
k AS (SELECT name, s AS window_start, row_number() OVER o - 1 AS win, coalesce(lead(s) OVER o - INTERVAL 1 MINUTE, b) AS window_end, count(*) OVER (PARTITION BY name) AS n FROM w WHERE s < b WINDOW o AS (PARTITION BY name ORDER BY s)),
l AS (SELECT *, (100 // n + CASE WHEN win < 100 % n THEN 1 ELSE 0 END)::INT AS row_limit FROM k)
SELECT name, win::INT AS win, window_start, window_end, row_limit FROM l WHERE row_limit > 0""")
def request_windows(spark, sf):
    ranges = S.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.min("o_orderdate").cast("timestamp").alias("start"), F.max("o_orderdate").cast("timestamp").alias("end"))
    cut = indicators.allocate_limits(indicators.request_windows(ranges, 90), 100, ["name"])
    return cut.select("name", F.col("window").cast("int").alias("win"), F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "row_limit")


@query("""SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN '2day' WHEN 1 THEN '1month' ELSE '12hour' END AS timeframe FROM part
WHERE p_size <= CASE p_partkey % 3 WHEN 0 THEN 60 // 2 WHEN 1 THEN 2 ELSE 60 * 24 // 12 END""")
def fitting_indicators(spark, sf):
    tf = F.when(F.col("p_partkey") % 3 == 0, "2day").when(F.col("p_partkey") % 3 == 1, "1month").otherwise("12hour")
    config = S.read(spark, sf, "part").select("p_partkey", "p_size", tf.alias("timeframe"))
    return indicators.indicator_fits(config, F.lit("2024-01-01"), F.lit("2024-02-29"), "p_size")


# ---- samples ---------------------------------------------------------------------

_JOINED = _SPLIT + f""", {S.SQL_PRICES}, {S.SQL_QUARTERS},
j AS (SELECT st.*, q.quarter_price, f.quarter_price AS p1, f.quarter_end_date AS d1, g.quarter_price AS p2 FROM st LEFT JOIN quarters q ON q.ticker = st.ticker AND q.quarter_end_date = st.quarter_end_date
  LEFT JOIN quarters f ON f.ticker = st.ticker AND f.quarter_end_date = last_day(st.quarter_end_date + INTERVAL 3 MONTH) LEFT JOIN quarters g ON g.ticker = st.ticker AND g.quarter_end_date = last_day(st.quarter_end_date + INTERVAL 6 MONTH)),
seq AS (SELECT *, sum(f1) OVER w AS s1, sum(f3) OVER w AS s3, count(*) OVER w AS length, arg_min(f1, quarter_end_date) OVER w AS oldest FROM j WINDOW w AS (PARTITION BY ticker ORDER BY quarter_end_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
"""


def _joined(spark, sf) -> DataFrame:
    return targets.with_targets(_state(spark, sf), targets.attach_targets(targets.period_prices(S.prices(spark, sf)), [1, 2]))


@query(_JOINED + "SELECT split, ticker, quarter_end_date, 4 AS sequence_length, round(s1 + s3, 5) AS total, round(oldest, 5) AS oldest, p1, p2 FROM seq WHERE window_ready AND horizon_target_ready AND length = 4 AND p1 IS NOT NULL AND p2 IS NOT NULL")
def sequence_samples(spark, sf):
    got = samples.sequence_samples(_joined(spark, sf), ["f1", "f3"], [1, 2], 4)
    return got.select("split", "ticker", "quarter_end_date", "sequence_length").join(_sequence_sums(spark, sf), ["ticker", "quarter_end_date"])


def _sequence_sums(spark, sf) -> DataFrame:
    df = samples.with_sequences(_joined(spark, sf), ["f1", "f3"], 4)
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return df.select("ticker", "quarter_end_date", F.round(add(F.flatten("sequence")), 5).alias("total"), F.round(F.col("sequence")[0][0], 5).alias("oldest"), F.col("future_price_t1").alias("p1"), F.col("future_price_t2").alias("p2"))


_MEMBERS = _JOINED + ", m AS (SELECT * FROM seq WHERE window_ready AND horizon_target_ready AND length = 4 AND quarter_price IS NOT NULL AND p1 IS NOT NULL)"


def _members(spark, sf) -> DataFrame:
    return samples.portfolio_members(_joined(spark, sf), ["f1", "f3"], 1, 4)


@query(_MEMBERS + " SELECT split, time_range, quarter_end_date, min(d1) AS future_quarter_end_date, count(*)::INT AS ticker_count, min(ticker) AS first_ticker, round(sum(quarter_price), 5) AS current, round(sum(p1), 5) AS future FROM m GROUP BY 1, 2, 3")
def portfolio_samples(spark, sf):
    got = samples.portfolio_samples(_members(spark, sf))
    add = lambda f: F.round(F.aggregate("members", F.lit(0.0), lambda s, x: s + x[f]), 5)
    return got.select("split", "time_range", "quarter_end_date", "future_quarter_end_date", "ticker_count", F.col("members")[0]["ticker"].alias("first_ticker"), add("current_price").alias("current"), add("future_price").alias("future"))


_THREE = "(VALUES ('train'), ('val'), ('test')) v(split)"


@query(_JOINED + f""", c AS (SELECT split, count(*) AS rows, count(quarter_price) AS current, count(p1) AS target, count(*) FILTER (WHERE quarter_price IS NOT NULL AND p1 IS NOT NULL) AS matched, count(*) FILTER (WHERE quarter_price IS NOT NULL AND p1 IS NOT NULL AND window_ready AND horizon_target_ready) AS eligible FROM j GROUP BY 1)
SELECT split, coalesce(rows, 0) AS rows, coalesce(current, 0) AS current, coalesce(target, 0) AS target, coalesce(matched, 0) AS matched, coalesce(eligible, 0) AS eligible, round(coalesce(matched / rows, 0), 8) AS match_rate, round(coalesce(eligible / rows, 0), 8) AS eligible_rate FROM {_THREE} LEFT JOIN c USING (split)""")
def target_matches(spark, sf):
    return rounded(samples.target_matches(_joined(spark, sf), 1))


@query(_MEMBERS + f""", c AS (SELECT split, count(DISTINCT quarter_end_date) AS samples, count(*) AS asset_targets, min(p1 / quarter_price) AS a, max(p1 / quarter_price) AS b, avg(p1 / quarter_price) AS c, stddev_pop(p1 / quarter_price) AS d FROM m GROUP BY 1)
SELECT split, coalesce(samples, 0) AS samples, coalesce(asset_targets, 0) AS asset_targets, round(coalesce(asset_targets / samples, 0), 8) AS tickers_mean, round(coalesce(a, 0), 8) AS growth_min, round(coalesce(b, 0), 8) AS growth_max, round(coalesce(c, 0), 8) AS growth_mean, round(coalesce(d, 0), 8) AS growth_std FROM {_THREE} LEFT JOIN c USING (split)""")
def sample_quality(spark, sf):
    return rounded(samples.sample_quality(_members(spark, sf)))


@query(_MEMBERS + f""", c AS (SELECT split, count(*) AS n, string_agg(DISTINCT strftime(quarter_end_date, '%Y-%m-%d'), ', ' ORDER BY strftime(quarter_end_date, '%Y-%m-%d')) AS dates FROM m GROUP BY 1)
SELECT split, coalesce(n, 0) AS samples, coalesce(dates, '') AS dates FROM {_THREE} LEFT JOIN c USING (split)""")
def samples_per_split(spark, sf):
    return samples.samples_per_split(_members(spark, sf))


@query(_JOINED + "SELECT time_range, quarter_end_date, count(DISTINCT ticker) AS tickers, count(quarter_price) AS current_prices, count(p1) AS future_prices FROM j GROUP BY 1, 2")
def target_availability(spark, sf):
    return samples.target_availability(_joined(spark, sf), 1)


@query(_SPLIT + "SELECT ticker, quarter_end_date, split, ((row_number() OVER (PARTITION BY split ORDER BY quarter_end_date, ticker) - 1) // 32)::INT AS batch_id FROM st")
def batches(spark, sf):
    return samples.batches(_state(spark, sf), 32, ["quarter_end_date", "ticker"]).select("ticker", "quarter_end_date", "split", "batch_id")


@query(f"WITH {S.SQL_PANEL} SELECT * FROM panel ORDER BY md5(concat_ws('|', ticker, quarter_end_date::VARCHAR, '3')), ticker, quarter_end_date LIMIT 50")
def seeded_sample(spark, sf):
    return samples.seeded_sample(S.panel(spark, sf), 50, ["ticker", "quarter_end_date"], 3)


@query(f"""WITH {S.SQL_PANEL} SELECT 'f1' AS column, count(*) FILTER (WHERE f1 IS NULL) AS "null", 0::BIGINT AS nan, 0::BIGINT AS infinite FROM panel UNION ALL SELECT 'f2', count(*) FILTER (WHERE f2 IS NULL), 0, 0 FROM panel""")
def finite_report(spark, sf):
    return checks.finite_report(S.panel(spark, sf), ["f1", "f2"])


# ---- portfolios ------------------------------------------------------------------

_W = f"WITH {S.SQL_SCORES} "
_SAMPLE_NUMBERS = ["portfolio_growth", "benchmark_growth", "growth_alpha", "max_weight", "effective_holdings"]


def _samples(spark, sf) -> DataFrame:
    return portfolio.sample_summary(portfolio.weight_rows(S.weights(spark, sf)))


def _summary(spark, sf, split: str | None = None) -> DataFrame:
    s = _samples(spark, sf)
    return portfolio.run_summary(s.where(F.col("source_split") == split) if split else s)


_SUM = _W.replace("FROM s GROUP BY ALL)", "FROM s GROUP BY run_id, model_family, risk_penalty, concentration_penalty)")
_VAL = _SUM.replace("FROM s GROUP BY run_id", "FROM s WHERE source_split = 'val' GROUP BY run_id")


@query(_W + f"SELECT run_id, ticker, quarter_end_date, {r('weight', 'equal_weight', 'ticker_return', 'portfolio_growth', 'benchmark_growth', 'max_weight', 'effective_holdings', digits=5)} FROM w")
def weight_rows(spark, sf):
    rows = portfolio.weight_rows(S.weights(spark, sf))
    return rounded(rows.select("run_id", "ticker", "quarter_end_date", "weight", "equal_weight", "ticker_return", "portfolio_growth", "benchmark_growth", "max_weight", "effective_holdings"), 5)


@query(_W + f"SELECT run_id, quarter_end_date, source_split, ticker_count::INT AS ticker_count, {r(*_SAMPLE_NUMBERS, digits=5)} FROM s")
def sample_summary(spark, sf):
    return rounded(_samples(spark, sf).select("run_id", "quarter_end_date", "source_split", "ticker_count", *_SAMPLE_NUMBERS), 5)


_RUN_NUMBERS = [*[f"mean_{c}" for c in _SAMPLE_NUMBERS], "mean_ticker_count"]


@query(_SUM + f"SELECT run_id, model_family, sample_count, {r(*_RUN_NUMBERS, digits=5)}, round(ln(cumulative_growth), 6) AS log_growth, round(ln(benchmark_cumulative_growth), 6) AS log_benchmark FROM run_sum")
def run_summary(spark, sf):
    numbers = [F.round(c, 5).alias(c) for c in _RUN_NUMBERS]
    logs = [F.round(F.log(c), 6).alias(n) for c, n in (("cumulative_growth", "log_growth"), ("benchmark_cumulative_growth", "log_benchmark"))]
    return _summary(spark, sf).select("run_id", "model_family", "sample_count", *numbers, *logs)


@query(_VAL + "SELECT run_id, row_number() OVER (ORDER BY mean_growth_alpha DESC, run_id)::INT AS strategy_rank FROM run_sum QUALIFY strategy_rank <= 3")
def top_strategies(spark, sf):
    return portfolio.top_runs(_summary(spark, sf, "val"), 3).select("run_id", "strategy_rank")


@query(_VAL + "SELECT model_family, arg_max(run_id, mean_growth_alpha) AS run_id FROM run_sum GROUP BY 1")
def best_per_family(spark, sf):
    return portfolio.best_per_family(_summary(spark, sf, "val")).select("model_family", "run_id")


@query(_W + "SELECT run_id, quarter_end_date, ticker, row_number() OVER (PARTITION BY run_id, quarter_end_date ORDER BY round(weight, 9) DESC, ticker)::INT AS holding_rank FROM w QUALIFY holding_rank <= 5")
def top_holdings(spark, sf):
    rows = portfolio.weight_rows(S.weights(spark, sf)).withColumn("weight", F.round("weight", 9))
    return portfolio.top_holdings(rows, 5).select("run_id", "quarter_end_date", "ticker", "holding_rank")


_NAV = """SELECT run_id, quarter_end_date, source_split, round(sum(ln(portfolio_growth)) OVER (PARTITION BY run_id ORDER BY quarter_end_date), 6) AS log_nav FROM s
UNION ALL SELECT run_id, (date_trunc('quarter', min(quarter_end_date)) - INTERVAL 1 DAY)::DATE, 'base', 0.0 FROM s GROUP BY 1"""


@query(_W + _NAV)
def strategy_nav(spark, sf):
    curve = portfolio.nav(_samples(spark, sf), ["run_id"], "portfolio_growth")
    return curve.select("run_id", "quarter_end_date", "source_split", F.round(F.log("nav"), 6).alias("log_nav"))


@query(_W + """, b AS (SELECT quarter_end_date, source_split, avg(benchmark_growth) AS g FROM s GROUP BY 1, 2)
SELECT 'all' AS evaluation_scope, quarter_end_date, source_split, round(exp(sum(ln(g)) OVER (ORDER BY quarter_end_date)), 4) AS nav FROM b UNION ALL SELECT 'all', (date_trunc('quarter', min(quarter_end_date)) - INTERVAL 1 DAY)::DATE, 'base', 1.0 FROM b""")
def benchmark_nav(spark, sf):
    return rounded(portfolio.nav(portfolio.benchmark_curve(_samples(spark, sf)), ["evaluation_scope"]), 4)


@query(_SUM + "SELECT model_family, risk_penalty, round(avg(mean_growth_alpha) FILTER (WHERE concentration_penalty = 0), 5) AS conc_0_0, round(avg(mean_growth_alpha) FILTER (WHERE concentration_penalty = 0.1), 5) AS conc_0_1 FROM run_sum GROUP BY 1, 2")
def alpha_heatmap(spark, sf):
    return rounded(portfolio.heatmap(_summary(spark, sf), "mean_growth_alpha", [0.0, 0.1]), 5)


@query(_W + """, e AS (SELECT a.ticker, a.quarter_end_date, a.current_price, a.future_price, (a.weight + b.weight) / 2 AS weight FROM w a JOIN w b ON b.ticker = a.ticker AND b.quarter_end_date = a.quarter_end_date WHERE a.run_id = 3 AND b.run_id = 6)
SELECT quarter_end_date, count(*)::INT AS ticker_count, round(sum(weight * future_price) / sum(weight * current_price), 5) AS portfolio_growth, round(sum(future_price) / sum(current_price), 5) AS benchmark_growth, round(max(weight), 5) AS max_weight, round(1 / sum(weight * weight), 4) AS effective_holdings FROM e GROUP BY 1""")
def ensemble(spark, sf):
    s = portfolio.sample_summary(portfolio.ensemble(S.weights(spark, sf), 3, 6))  # asserts that the runs match one to one
    return s.select("quarter_end_date", "ticker_count", *[F.round(c, 5).alias(c) for c in ("portfolio_growth", "benchmark_growth", "max_weight")], F.round("effective_holdings", 4).alias("effective_holdings"))


@query(_W + """, g AS (SELECT run_id, quarter_end_date, greatest(sum(weight * future_price / greatest(current_price, 1e-8)), 1e-8) AS g, sum(weight * weight) AS q FROM w GROUP BY 1, 2)
SELECT count(*) AS samples, round(avg(ln(g)), 8) AS gain, round(avg(greatest(1 - g, 0)), 8) AS drawdown, round(avg(q), 8) AS squares, round(-avg(ln(g)) + 0.5 * avg(greatest(1 - g, 0)) + 0.1 * avg(q), 8) AS loss FROM g""")
def growth_loss(spark, sf):
    return rounded(portfolio.growth_loss(S.weights(spark, sf), portfolio.SAMPLE, True, 0.5, 0.1))


@query(_W + "SELECT round(avg(portfolio_growth), 8) AS portfolio_growth, round(avg(benchmark_growth), 8) AS benchmark_growth, round(avg(growth_alpha), 8) AS growth_alpha, round(avg(max_weight), 8) AS max_weight, round(avg(effective_holdings), 5) AS effective_holdings, round(avg(ln(portfolio_growth)), 8) AS log_growth, round(avg(greatest(1 - portfolio_growth, 0)), 8) AS drawdown, round(avg(ticker_count), 8) AS ticker_count FROM s")
def batch_metrics(spark, sf):
    return rounded(portfolio.batch_metrics(S.weights(spark, sf), portfolio.SAMPLE)).withColumn("effective_holdings", F.round("effective_holdings", 5))


# ---- normalization ---------------------------------------------------------------

_FILLED = f"WITH {S.SQL_PANEL}, m AS (SELECT median(f1) AS m1, median(f2) AS m2 FROM panel), fl AS (SELECT ticker, quarter_end_date AS date, coalesce(f1, m1) AS f1, coalesce(f2, m2) AS f2 FROM panel, m), "
_SCALED = _FILLED + """q AS (SELECT quantile_cont(f1, [0.25, 0.5, 0.75]) AS q FROM fl), k AS (SELECT ticker, quantile_cont(f2, [0.25, 0.5, 0.75]) AS q FROM fl GROUP BY 1),
sc AS (SELECT fl.ticker, date, (f1 - q.q[2]) / (CASE WHEN q.q[3] = q.q[1] THEN 1 ELSE q.q[3] - q.q[1] END) AS f1, greatest(least((f2 - k.q[2]) / (CASE WHEN k.q[3] = k.q[1] THEN 1 ELSE k.q[3] - k.q[1] END), 5), -5) AS f2 FROM fl JOIN k USING (ticker), q)
"""


def _scaled(spark, sf) -> DataFrame:
    p = normalize.fill_medians(S.panel(spark, sf).select("ticker", F.col("quarter_end_date").alias("date"), "f1", "f2"), ["f1", "f2"])
    return normalize.robust_scale(p, ["f1", "f2"], ["f2"])


@query(_SCALED + "SELECT ticker, date, round(f1, 8) AS f1, round(f2, 8) AS f2 FROM sc")
def robust_scaled(spark, sf):
    return rounded(_scaled(spark, sf).select("ticker", "date", "f1", "f2"))


@query(_SCALED + """, thin AS (SELECT * FROM sc WHERE month(date) <> 6), ends AS (SELECT DISTINCT last_day(d) AS date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS d FROM thin) WHERE month(d) % 3 = 0)
SELECT g.ticker, g.date, round(thin.f1, 8) AS f1 FROM (SELECT * FROM (SELECT DISTINCT ticker FROM thin), ends) g ASOF LEFT JOIN thin ON thin.ticker = g.ticker AND thin.date <= g.date""")
def quarter_grid(spark, sf):
    return rounded(normalize.quarter_grid(_scaled(spark, sf).where(F.month("date") != 6), ["f1"]).select("ticker", "date", "f1"))


@query(_SCALED + "SELECT date, count(*) AS tickers, round(sum(f1 + f2), 3) AS total FROM sc GROUP BY 1")
def cube(spark, sf):
    got = normalize.cube(_scaled(spark, sf), ["f1", "f2"])
    return got.select("date", F.size("tickers").cast("long").alias("tickers"), F.round(F.aggregate(F.flatten("matrix"), F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query(_SCALED + ", axis AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS position FROM (SELECT DISTINCT ticker FROM sc)) SELECT date, position // 7 AS block, count(*)::INT AS assets, min(ticker) AS first, round(sum(f1 + f2), 3) AS total FROM sc JOIN axis USING (ticker) GROUP BY 1, 2")
def cube_blocks(spark, sf):
    """The cube in rows of seven assets; the first one's name is found by the axis."""
    grid = _scaled(spark, sf)
    axis = normalize.asset_axis(grid, size=7)
    got = normalize.cube_blocks(grid, axis, ["f1", "f2"]).withColumn("offset", F.col("offsets")[0])
    named = got.join(axis.select("block", "offset", F.col("ticker").alias("first")), ["block", "offset"])
    return named.select("date", "block", F.size("offsets").alias("assets"), "first", F.round(F.aggregate(F.flatten("matrix"), F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query(_MEMBERS + ", blk AS (SELECT *, (row_number() OVER (PARTITION BY split, quarter_end_date ORDER BY ticker) - 1) // 9 AS block FROM m) SELECT split, quarter_end_date, block, min(d1) AS future_quarter_end_date, count(*)::INT AS ticker_count, min(ticker) AS first_ticker, round(sum(p1), 5) AS future FROM blk GROUP BY 1, 2, 3")
def portfolio_blocks(spark, sf):
    got = samples.portfolio_blocks(_members(spark, sf), 9)
    future = F.round(F.aggregate("members", F.lit(0.0), lambda s, x: s + x["future_price"]), 5)
    return got.select("split", "quarter_end_date", "block", "future_quarter_end_date", "ticker_count", F.col("members")[0]["ticker"].alias("first_ticker"), future.alias("future"))


@query(_JOINED + ", lists AS (SELECT *, list(f1::FLOAT) OVER w AS a, list(f3::FLOAT) OVER w AS b FROM j WINDOW w AS (PARTITION BY ticker ORDER BY quarter_end_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT split, ticker, quarter_end_date, a AS first_feature, b AS second_feature, p1::FLOAT AS p1, p2::FLOAT AS p2 FROM lists WHERE window_ready AND horizon_target_ready AND len(a) = 4 AND p1 IS NOT NULL AND p2 IS NOT NULL")
def stored_sequences(spark, sf):
    """Sequences of four rows from a store of blocks of three, expanded by the reader."""
    store, placed = samples.sequence_store(_joined(spark, sf), ["f1", "f3"], 3)
    got = samples.expanded(samples.stored_samples(placed, [1, 2], 4, 3), store, 4, 3)
    of = lambda k: F.transform("features", lambda v: v[k])
    return got.select("split", "ticker", "quarter_end_date", of(0).alias("first_feature"), of(1).alias("second_feature"), F.col("price_targets")[0].alias("p1"), F.col("price_targets")[1].alias("p2"))


# ---- predictions -----------------------------------------------------------------

_P = f"WITH {S.SQL_PREDICTIONS} "
_REPORT = "count(*) AS rows, round(avg(abs(e)), 8) AS mae, round(sqrt(avg(e * e)), 8) AS rmse, round(1 - sum(e * e) / (var_pop(t) * count(t)), 5) AS r2, round(avg((cls = y)::INT), 8) AS accuracy, round(avg(p), 8) AS mean_predicted, round(avg(t), 8) AS mean_target"


def _unfolded(spark, sf) -> DataFrame:
    return predictions.unfold(S.predictions(spark, sf), [1, 4])


@query(_P + f"SELECT horizon, {_REPORT} FROM err GROUP BY 1")
def prediction_report(spark, sf):
    return rounded(predictions.report_by_horizon(_unfolded(spark, sf))).withColumn("r2", F.round("r2", 5))


@query(_P + f"SELECT {_REPORT}, count(DISTINCT vec_id) AS samples FROM err")
def prediction_overall(spark, sf):
    return rounded(predictions.report_overall(_unfolded(spark, sf))).withColumn("r2", F.round("r2", 5))


@query(_P + "SELECT vec_id::VARCHAR AS ticker, round(avg(abs(e)), 8) AS mae, round(sqrt(avg(e * e)), 8) AS rmse FROM err GROUP BY 1")
def prediction_samples(spark, sf):
    return rounded(predictions.report_by_sample(_unfolded(spark, sf)).select("ticker", "mae", "rmse"))


@query(_P + """, o AS (SELECT vec_id, sum(CASE horizon WHEN 1 THEN 0.25 ELSE 0.75 END * CASE WHEN abs(e) < 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END) AS reg, sum(CASE horizon WHEN 1 THEN 0.25 ELSE 0.75 END * ce) AS cls FROM err GROUP BY 1)
SELECT round(avg(reg), 8) AS regression_loss, round(avg(cls), 8) AS classification_loss, round(2 * avg(reg) + avg(cls), 8) AS loss FROM o""")
def multitask_loss(spark, sf):
    return rounded(predictions.multitask_loss(S.predictions(spark, sf), 2, [1.0, 3.0], 2.0, 1.0, smooth=True))


@query(_P + "SELECT round(avg(abs(e)), 8) AS price_mae, round(avg((cls = y)::INT), 8) AS class_accuracy, round(avg((cls = y)::INT) FILTER (WHERE horizon = 1), 8) AS class_accuracy_t1, round(avg((cls = y)::INT) FILTER (WHERE horizon = 4), 8) AS class_accuracy_t4 FROM err")
def multitask_metrics(spark, sf):
    return rounded(predictions.multitask_metrics(_unfolded(spark, sf), [1, 4]))


@query(_P + "SELECT vec_id, round(0.5 * x0 - x1 + 2 * x2 + 0.25, 8) AS score FROM vectors")
def linear_scores(spark, sf):
    x = F.transform(F.slice("embedding", 1, 3), lambda v: F.round(v.cast("double"), 4))
    return S.read(spark, sf, "embeddings").select("vec_id", F.round(scalar.linear(x, [0.5, -1.0, 2.0], 0.25), 8).alias("score"))


_STEPS = "steps AS (SELECT day(ts)::INT AS epoch, CASE WHEN user_id % 3 = 0 THEN 'val' ELSE 'train' END AS phase, event_id AS step, CASE WHEN event_type IN ('view', 'click') THEN 'loss' ELSE 'price_mae' END AS name, value FROM events), n AS (SELECT epoch, phase, count(DISTINCT step) AS n FROM steps GROUP BY 1, 2), e AS (SELECT epoch, phase, name, sum(value) / any_value(n) AS v, any_value(n) AS n FROM steps JOIN n USING (epoch, phase) GROUP BY 1, 2, 3), ep AS (SELECT epoch, max(n) FILTER (WHERE phase = 'train')::INT AS train_steps, max(n) FILTER (WHERE phase = 'val')::INT AS val_steps, " + ", ".join(f"max(v) FILTER (WHERE phase = '{p}' AND name = '{m}') AS {p}_{m}" for p in ("train", "val") for m in ("loss", "price_mae")) + " FROM e GROUP BY 1)"


def _epochs(spark, sf) -> DataFrame:
    name = F.when(F.col("event_type").isin("view", "click"), "loss").otherwise("price_mae")
    steps = S.read(spark, sf, "events").select(F.dayofmonth("ts").alias("epoch"), F.when(F.col("user_id") % 3 == 0, "val").otherwise("train").alias("phase"), F.col("event_id").alias("step"), name.alias("name"), "value")
    return predictions.epoch_metrics(steps)


@query(f"WITH {_STEPS} SELECT epoch, train_steps, val_steps, {r('train_loss', 'train_price_mae', 'val_loss', 'val_price_mae')} FROM ep")
def epoch_metrics(spark, sf):
    return rounded(_epochs(spark, sf))


@query(f"WITH {_STEPS} SELECT epoch, round(val_loss, 8) AS val_loss FROM ep WHERE val_loss IS NOT NULL ORDER BY ep.val_loss, epoch LIMIT 1")
def best_epoch(spark, sf):
    return rounded(predictions.best_epoch(_epochs(spark, sf)).select("epoch", "val_loss"))


# ---- further forms ---------------------------------------------------------------


@query(f"""WITH {S.SQL_STORIES}, {_TOPICS}, k AS (SELECT ticker, time_range, count(*) AS story_count FROM stories GROUP BY 1, 2)
SELECT k.*, round(coalesce(a.relevance, 0), 8) AS topic_relevance_earnings, round(coalesce(b.relevance, 0), 8) AS topic_relevance_life_sciences FROM k
LEFT JOIN topic a ON a.ticker = k.ticker AND a.time_range = k.time_range AND a.topic = 'earnings' LEFT JOIN topic b ON b.ticker = k.ticker AND b.time_range = k.time_range AND b.topic = 'life_sciences'""")
def story_features(spark, sf):
    wide = stories.story_features(S.stories(spark, sf), ["earnings", "life_sciences"])
    return rounded(wide.select("ticker", "time_range", "story_count", "topic_relevance_earnings", "topic_relevance_life_sciences"))


@query(_SPLIT + "SELECT time_range, quarter_end_date, count(DISTINCT ticker) AS tickers FROM st GROUP BY 1, 2")
def row_groups(spark, sf):
    return samples.row_groups(_state(spark, sf))


@query(_JOINED + f""", s AS (SELECT split, count(*) AS n, count(DISTINCT ticker) AS k FROM seq WHERE window_ready AND horizon_target_ready AND length = 4 AND p1 IS NOT NULL AND p2 IS NOT NULL GROUP BY 1), a AS (SELECT split, count(*) AS n FROM st GROUP BY 1)
SELECT split, coalesce(a.n, 0) AS raw_rows, coalesce(s.n, 0) AS samples, coalesce(s.k, 0) AS tickers, CASE WHEN s.n > 0 THEN 4.0::DOUBLE ELSE 0::DOUBLE END AS sequence_length FROM {_THREE} LEFT JOIN a USING (split) LEFT JOIN s USING (split)""")
def data_summary(spark, sf):
    return samples.data_summary(_state(spark, sf), samples.sequence_samples(_joined(spark, sf), ["f1", "f3"], [1, 2], 4))


@query(_P + "SELECT count(*) AS count, round(avg(abs(e)), 8) AS mean_absolute_error, round(avg(e * e), 8) AS mean_squared_error FROM err WHERE horizon = 1")
def simple_evaluation(spark, sf):
    return rounded(predictions.simple_evaluation(_unfolded(spark, sf).where("horizon = 1"), "predicted_price", "target_price"))


@query(f"WITH {S.SQL_PRICES} SELECT ticker, strftime(date, '%Y-%m-%d') AS date, price FROM prices WHERE date BETWEEN DATE '1998-12-31' AND DATE '2000-12-31'")
def recent_prices(spark, sf):
    return statements.normalize_date_column(statements.recent_prices(S.prices(spark, sf), "2000-12-31", 2), "date")


@query(f"WITH {S.SQL_PANEL}, w AS (SELECT ticker, quarter_end_date, count(*) OVER o AS n, sum(f1) OVER o AS total FROM panel WINDOW o AS (PARTITION BY ticker ORDER BY quarter_end_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) SELECT ticker, quarter_end_date, 6 AS padded, n::INT AS valid, round(total, 5) AS total FROM w")
def padded_sequences(spark, sf):
    df = samples.with_sequences(S.panel(spark, sf), ["f1"], 6)
    padded = scalar.pad_sequence("sequence", 6, 1)
    valid = F.size(F.filter(scalar.mask("sequence", 6), lambda x: x))
    return df.select("ticker", "quarter_end_date", F.size(padded).alias("padded"), valid.alias("valid"), F.round(F.aggregate(F.flatten(padded), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"WITH {S.SQL_MACRO} SELECT coalesce(a.date, b.date) AS date, a.v AS a, b.n AS b FROM (SELECT date, v FROM months WHERE month(date) <= 8) a FULL JOIN (SELECT date, n FROM months WHERE month(date) >= 5) b ON a.date = b.date")
def outer_series(spark, sf):
    m = S.macro(spark, sf)
    return indicators.outer_join_series({"a": m.where("name = 'Order Value' AND month(date) <= 8"), "b": m.where("name = 'order-count' AND month(date) >= 5")})


@query("""WITH runs AS (SELECT n_nationkey AS run_id, round((n_regionkey * 0.05)::DOUBLE, 2) AS risk_penalty, round(((n_nationkey % 3) * 0.1)::DOUBLE, 1) AS concentration_penalty FROM nation)
SELECT row_number() OVER (ORDER BY risk_penalty, concentration_penalty, run_id)::INT AS place, run_id, risk_penalty, concentration_penalty FROM runs""")
def sweep_index(spark, sf):
    order = Window.orderBy("risk_penalty", "concentration_penalty", "run_id")  # a row for each run
    used = portfolio.sweep_index(S.sweep(spark, sf).unionByName(S.sweep(spark, sf)))
    return used.select(F.row_number().over(order).alias("place"), "run_id", "risk_penalty", "concentration_penalty")
