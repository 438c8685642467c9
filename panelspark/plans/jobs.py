"""Jobs: fundamentals, cleaning, preprocessing, samples, evaluation, normalization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.scalar import feature_columns
from panelspark.operators import normalize, panel, portfolio, samples, targets
from panelspark.operators.indicators import economics_table, technical_table
from panelspark.operators.panel import PanelConfig
from panelspark.operators.statements import FundamentalConfig, between_dates, fundamental_dataset
from panelspark.operators.stories import deduplicate_stories, story_features, story_rows
from panelspark.sources.landing import kept

STATE = ["ticker_history_index", "window_ready", "horizon_target_ready"]


def clean(tables: dict[str, DataFrame], news: DataFrame | None, macro: DataFrame | None, technical: DataFrame | None, start: str | None = None, end: str | None = None, freq: str = "quarterly", config: FundamentalConfig = FundamentalConfig()) -> dict[str, DataFrame]:
    """The cleaned tables. Fundamentals are dated after their features are made, so that history counts; a source that isn't there is left out."""
    fundamentals = fundamental_dataset(tables["income"], tables["balance"], tables["cashflow"], tables["prices"], config)
    out = {"fundamental": between_dates(fundamentals.withColumnRenamed("report_date", "date"), "date", start, end)}
    if news is not None:
        out["story"] = deduplicate_stories(story_rows(news))
    if macro is not None:
        out["economics"] = economics_table(macro, freq=freq)
    if technical is not None:
        out["technical"] = technical_table(technical, freq=freq)
    return out


def clean_counters(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, tickers) of the cleaned tables."""
    out = None
    for name, df in sorted(tables.items()):
        n = F.countDistinct("ticker") if "ticker" in df.columns else F.lit(0).cast("long")
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), n.alias("tickers"))
        out = one if out is None else out.unionByName(one)
    return out


def preprocess(fundamental: DataFrame, story: DataFrame | None, economics: DataFrame | None, technical: DataFrame | None, config: PanelConfig = PanelConfig(), date: str = "quarter_end_date") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Merge, resample, fill, split, impute by training medians, scale by training means and deviations -> panel and the fitted tables.

    The merged panel with its splits is kept in the shared folder: medians, scaling and the result each read it from there. It is
    returned with the fitted tables, as ``merged``.
    """
    panel.check_ratios(config.train, config.val, config.test)
    merged = panel.merge_panel(fundamental, story, economics, technical)
    if config.freq == "daily":
        merged = panel.to_daily(merged, date=date)
    if story is not None and config.fill_stories:
        merged = panel.zero_fill(merged, [c for c in story.columns if c not in panel.KEYS])
    if config.fill_indicators:
        merged = panel.zero_fill(merged, [c for c in merged.columns if c.startswith(("econ_", "tech_"))])
    merged = kept(merged)
    boundaries = panel.split_boundaries(merged, date, config.train, config.val)
    rows = panel.assign_splits(panel.annotate_rows(merged, config.sequence_length, config.min_points, config.horizon, date=date), boundaries, date)
    features = feature_columns(rows, STATE)
    rows = kept(rows.withColumns({c: F.col(c).cast("double") for c in features}))
    medians = panel.fit_medians(rows, features, approximate=config.approximate_medians)
    filled = panel.impute(rows, medians, features)
    scaling = panel.fit_scaling(filled, features)
    return panel.standardize(filled, scaling, features), {"boundaries": boundaries, "medians": medians, "scaling": scaling, "merged": rows}


def sequence_dataset(rows: DataFrame, prices: DataFrame, horizons: list[int], length: int, threshold: float = 0.02, freq: str = "quarterly", features: list[str] | None = None) -> DataFrame:
    """The panel's rows with targets, as sequence samples."""
    found = targets.attach_targets(targets.period_prices(prices, freq), horizons, threshold, freq)
    names = feature_columns(rows, STATE, features)
    return samples.sequence_samples(targets.with_targets(rows, found), names, horizons, length)


def portfolio_dataset(rows: DataFrame, prices: DataFrame, horizon: int, length: int, freq: str = "quarterly", strict_window: bool = False, features: list[str] | None = None) -> dict[str, DataFrame]:
    """members, samples, matches and quality of the cross-sectional samples."""
    near = targets.universe_prices(prices, rows, [horizon], freq, strict_window)
    joined = targets.with_targets(rows, targets.attach_targets(targets.period_prices(near, freq), [horizon], 0.02, freq))
    members = samples.portfolio_members(joined, feature_columns(rows, STATE, features), horizon, length)
    return {"members": members, "samples": samples.portfolio_samples(members), "matches": samples.target_matches(joined, horizon), "quality": samples.sample_quality(members)}


def window_dataset(fundamental: DataFrame, stories: DataFrame, length: int, train: float = 0.7, val: float = 0.15, date: str = "quarter_end_date") -> DataFrame:
    """The plain samples: fundamentals and stories, no scaling."""
    merged = panel.merge_panel(fundamental, story_features(stories))
    split = panel.assign_splits(merged, panel.split_boundaries(merged, date, train, val), date)
    return samples.window_samples(split, feature_columns(split), length, date)


def in_scopes(rows: DataFrame) -> DataFrame:
    """Rows of the scope ``all``, those of validation for the scope ``val`` once more."""
    val = F.array(F.lit("all"), F.lit("val"))
    return rows.withColumn("evaluation_scope", F.explode(F.when(F.col("source_split") == "val", val).otherwise(F.array(F.lit("all")))))


def evaluate(weights: DataFrame, top_k: int = 5, holdings: int = 10) -> dict[str, DataFrame]:
    """All tables of an evaluation from the weight rows of the scope ``all``; the ranking comes from validation alone.

    The metrics of a sample are the same in every scope, so they are computed once, over the rows of ``all`` (others are left
    out), and kept with the sample summary; both scopes and all tables are made of these two.
    """
    rows = kept(portfolio.weight_rows(weights.where("evaluation_scope = 'all'")))
    each = kept(portfolio.sample_summary(rows))
    scoped = in_scopes(each)
    summary = portfolio.run_summary(scoped, by=["evaluation_scope"])
    top = kept(portfolio.top_runs(summary.where("evaluation_scope = 'val'"), top_k))
    return {
        "weights": in_scopes(rows),
        "sample_summary": scoped,
        "run_summary": summary,
        "top_strategies": portfolio.of_runs(summary.drop("strategy_label"), top),
        "top_holdings": in_scopes(portfolio.top_holdings(portfolio.of_runs(rows, top), holdings)),
        "strategy_nav": portfolio.nav(portfolio.of_runs(scoped, top), ["evaluation_scope", "run_id", "strategy_label"], "portfolio_growth"),
        "benchmark_nav": portfolio.nav(portfolio.benchmark_curve(scoped), ["evaluation_scope"]),
    }


def saved_ensemble(weights: DataFrame, run_summary: DataFrame, families: tuple[str, str], holdings: int = 10) -> dict[str, DataFrame]:
    """The 50/50 ensemble of the best run of each of two families, from saved weight rows: rows, samples, summary, curve, holdings, and the members' curves."""
    best = {r.model_family: r.run_id for r in portfolio.best_per_family(run_summary, list(families)).select("model_family", "run_id").collect()}
    rows = portfolio.ensemble(weights, best[families[0]], best[families[1]])
    each = portfolio.sample_summary(rows)
    members = portfolio.sample_summary(weights.where(F.col("run_id").isin(list(best.values()))))
    return {
        "weights": rows,
        "sample_summary": each,
        "summary": portfolio.scope_summary(each),
        "nav": portfolio.nav(each, ["evaluation_scope", "run_id"], "portfolio_growth"),
        "member_nav": portfolio.nav(members, ["evaluation_scope", "run_id", "model_family"], "portfolio_growth"),
        "top_holdings": portfolio.top_holdings(rows, holdings),
    }


def normalized_cube(df: DataFrame, columns: list[str], per_key: list[str] = ()) -> DataFrame:
    """Medians for gaps, robust scaling, a grid of quarter ends, a matrix for each date."""
    scaled = normalize.robust_scale(normalize.fill_medians(df, columns), columns, list(per_key), keep=False)
    return normalize.cube(normalize.quarter_grid(scaled, columns), columns)
