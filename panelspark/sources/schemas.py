"""Schemas of the landed files, and the columns' names inside the engine."""

from __future__ import annotations

FEED = (
    "feed array<struct<title:string,summary:string,source:string,source_domain:string,category_within_source:string,url:string,time_published:string,"
    "overall_sentiment_score:string,overall_sentiment_label:string,authors:array<string>,topics:array<struct<topic:string,relevance_score:string>>,banner_image:string,"
    "ticker_sentiment:array<struct<ticker:string,relevance_score:string,ticker_sentiment_score:string,ticker_sentiment_label:string>>>>"
)
# The column names of the landed statement files.
INCOME = {"Ticker": "ticker", "Report Date": "report_date", "Revenue": "rev", "Net Income": "ni", "Gross Profit": "gp", "Operating Income (Loss)": "op_inc", "Research & Development": "rnd", "Shares (Diluted)": "shares_diluted", "Shares (Basic)": "shares_basic", "Depreciation & Amortization": "dep_amort", "Cost of Revenue": "cogs", "Selling, General & Administrative": "sga"}
BALANCE = {"Ticker": "ticker", "Report Date": "report_date", "Total Assets": "assets", "Total Liabilities": "liabilities", "Total Current Assets": "curr_assets", "Total Current Liabilities": "curr_liab", "Total Equity": "equity", "Accounts & Notes Receivable": "receivables", "Property, Plant & Equipment, Net": "ppe"}
CASHFLOW = {"Ticker": "ticker", "Report Date": "report_date", "Net Cash from Operating Activities": "op_cash", "Change in Fixed Assets & Intangibles": "change_ppe", "Dividends Paid": "div_paid", "Cash from (Repurchase of) Equity": "repurchase"}
EVALUATION = "evaluation_scope string, source_split string, run_id string, risk_penalty double, concentration_penalty double, model_family string, model_target string, sample_key string, time_range string, quarter_end_date date, future_quarter_end_date date, ticker string, weight double, equal_weight double, current_price double, future_price double, ticker_return double, portfolio_growth double, benchmark_growth double, growth_alpha double, max_weight double, effective_holdings double"
RUN = "run_id string, risk_penalty double, concentration_penalty double, model_family string, model_target string"
