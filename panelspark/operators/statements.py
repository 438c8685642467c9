"""Fundamentals: filings joined with prices, trailing windows, ratios, scores, winsorized and ranked against history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import scores
from panelspark.functions.scalar import clip, with_floor
from panelspark.operators.quantiles import exact_quantiles, literal
from panelspark.operators.windows import as_of, by, first_per_key, historical_percentiles, history, rolling_zscore, trailing
from panelspark.sources.landing import kept

# The schema of the fundamental dataset, and which of its columns are summed, averaged, clipped, scored and ranked.
FLOWS = ["rev", "ni", "gp", "op_inc", "capex", "rnd", "fcf", "div_paid", "repurchase"]
STOCKS = ["assets", "liabilities", "curr_assets", "curr_liab", "equity"]
WINSORIZED = ["fcf_yield", "buyback_yield", "pe_ratio", "ps_ratio", "ev_ebitda", "beneish_mscore", "altman_zscore", "gross_margin", "net_margin", "roa", "asset_turnover", "current_ratio", "debt_to_equity", "revenue_growth_yoy", "eps_growth_yoy"]
Z_SCORED = ["revenue_growth_yoy", "eps_growth_yoy", "rd_intensity", "capex_to_sales"]
RANKED = ["pe_ratio", "ps_ratio"]
FEATURES = [
    "piotroski_fscore", "beneish_mscore", "ohlson_oscore", "altman_zscore", "gross_margin", "net_margin", "roa", "asset_turnover", "current_ratio", "debt_to_equity", "fcf_yield",
    "revenue_growth_yoy", "eps_growth_yoy", "rd_intensity", "capex_to_sales", "pe_ratio", "ps_ratio", "ev_ebitda", "buyback_yield",
]


@dataclass(frozen=True)
class FundamentalConfig:
    ttm_rows: int = 4
    z_rows: int = 12
    z_least: int = 1
    winsor_low: float = 0.01
    winsor_high: float = 0.99
    market_cap_min: float = 1e6


def align_statements(income: DataFrame, balance: DataFrame, cashflow: DataFrame, key: str = "ticker", date: str = "report_date") -> DataFrame:
    """Income with balance (inner) and cash flow (left) of the same key and date; of repeated filings the first by all columns."""
    keys = [key, date]
    once = lambda df: first_per_key(df, keys, *[c for c in df.columns if c not in keys])
    return once(income).join(once(balance), keys).join(once(cashflow), keys, "left")


def raw_records(filings: DataFrame, prices: DataFrame, price: str = "price", key: str = "ticker", date: str = "report_date", price_date: str = "date", spread: bool = False) -> DataFrame:
    """Market value from the last close at or before the report date, capital spending and free cash flow; missing extras are 0."""
    priced = as_of(filings, prices, key, date, price_date, price, "close", spread)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    capex = -zero("change_ppe")
    return priced.withColumns({
        "mkt_cap": F.col("close") * F.coalesce("shares_diluted", "shares_basic"),
        "capex": capex,
        "fcf": F.coalesce(F.col("op_cash") - capex, F.lit(0.0)),
        "ebit": F.col("op_inc"),
        **{c: zero(c) for c in ("rnd", "div_paid", "repurchase", "dep_amort")},
    })


def trailing_values(records: DataFrame, rows: int = 4, key: str = "ticker", date: str = "report_date") -> DataFrame:
    """ttm_*: sums of flows and means of stocks over the last rows (fewer at the start)."""
    w = trailing(key, date, rows)
    return records.withColumns({f"ttm_{c}": F.sum(c).over(w) for c in FLOWS} | {f"ttm_{c}": F.avg(c).over(w) for c in STOCKS})


def padded_change(x: str, key: str, date: str):
    """One-row relative change of x carried forward over gaps; use after ``carry``."""
    before = F.lag(f"_{x}").over(by(key, date))
    return F.try_divide(F.col(f"_{x}") - before, before)


def ratio_features(trailed: DataFrame, market_cap_min: float = 1e6, key: str = "ticker", date: str = "report_date") -> DataFrame:
    """All ratios, growth of trailing revenue and income, and the four scores."""
    carry = {f"_{c}": F.last(c, ignorenulls=True).over(history(key, date)) for c in ("ttm_rev", "ttm_ni")}
    fields = ["rev", "ni", "gp", "op_cash", "assets", "liabilities", "curr_assets", "curr_liab", "receivables", "ppe", "dep_amort", "cogs", "sga"]
    now = F.struct(*fields)
    df = trailed.withColumn("mkt_cap", with_floor("mkt_cap", market_cap_min)).withColumns(carry)
    df = df.withColumn("_now", now).withColumn("_before", F.lag("_now").over(by(key, date)))
    q, p = F.col("_now"), F.col("_before")
    return df.withColumns(scores.ratios() | {
        "revenue_growth_yoy": padded_change("ttm_rev", key, date),
        "eps_growth_yoy": padded_change("ttm_ni", key, date),
        "piotroski_fscore": scores.f_score(q, p),
        "beneish_mscore": scores.m_score(q, p),
        "ohlson_oscore": scores.o_score(q, p),
        "altman_zscore": scores.altman("ttm_curr_assets", "ttm_curr_liab", "ttm_ni", "ttm_assets"),
    }).drop("_now", "_before", "_ttm_rev", "_ttm_ni")


def winsorize(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, approximate: bool = False) -> DataFrame:
    """Values beyond the column's quantiles become the quantiles.

    df is computed once and kept; the exact quantiles are selected in a few passes over it. ``approximate`` takes one pass
    of quantile sketches instead.
    """
    df = kept(df)
    if approximate:
        found = df.agg(*[F.percentile_approx(c, [low, high], 100_000).alias(c) for c in columns]).head().asDict()
    else:
        found = exact_quantiles(df, columns, [low, high])
    bounds = {c: [literal(v) for v in (found[c] or (None, None))] for c in columns}
    return df.withColumns({c: clip(c, *bounds[c]) for c in columns})


def against_history(df: DataFrame, rows: int = 12, least: int = 1, key: str = "ticker", date: str = "report_date") -> DataFrame:
    """Rolling z-scores of growth and intensity; historical percentiles of the price ratios."""
    scored = df.withColumns({c: rolling_zscore(c, key, date, rows, least) for c in Z_SCORED})
    return historical_percentiles(scored, RANKED, key, date)


def fundamental_dataset(income: DataFrame, balance: DataFrame, cashflow: DataFrame, prices: DataFrame, config: FundamentalConfig = FundamentalConfig()) -> DataFrame:
    """ticker, report_date and the 19 features. Winsorizing comes before z-scores and percentiles."""
    records = raw_records(align_statements(income, balance, cashflow), prices)
    features = ratio_features(trailing_values(records, config.ttm_rows), config.market_cap_min)
    kept = features.select("ticker", "report_date", *FEATURES)
    return against_history(winsorize(kept, WINSORIZED, config.winsor_low, config.winsor_high), config.z_rows, config.z_least)


def pick_alias(wanted: DataFrame, listed: DataFrame, key: str = "ticker") -> DataFrame:
    """wanted with ``listed_as``: the first of the symbol, its dotted form and its dashed form that is listed, else NULL."""
    forms = F.array(F.col(key), F.regexp_replace(key, "-", "."), F.regexp_replace(key, r"\.", "-"))
    tried = wanted.select(key).distinct().select(key, F.posexplode(forms).alias("_k", "_form"))
    hit = tried.join(listed.select(F.col(key).alias("_form")).distinct(), "_form").groupBy(key).agg(F.min_by("_form", "_k").alias("listed_as"))
    return wanted.join(hit, key, "left")


def recent_prices(prices: DataFrame, as_of_date: str, years: int, date: str = "date") -> DataFrame:
    """The last years before a date."""
    day = F.to_date(F.lit(as_of_date))
    return prices.where(F.col(date).between(F.add_months(day, -12 * years), day))


def close_column(columns: list[str]) -> str | None:
    """The first column whose name holds "Close"."""
    return next((c for c in columns if "Close" in c), None)


def between_dates(df: DataFrame, date: str, start: str | None, end: str | None) -> DataFrame:
    """Rows from start to end, both included; an open side is None."""
    if start:
        df = df.where(F.col(date) >= F.to_date(F.lit(start)))
    return df.where(F.col(date) <= F.to_date(F.lit(end))) if end else df


def normalize_date_column(df: DataFrame, source: str, key: str = "ticker") -> DataFrame:
    """The source column as ISO text under ``date``, keys first."""
    rest = [c for c in df.columns if c not in (source, key, "date")]
    return df.select(*([key] if key in df.columns else []), F.date_format(source, "yyyy-MM-dd").alias("date"), *rest)
