"""Portfolios: weights, sample metrics, run summaries, curves, rankings, ensembles, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import EPS, drawdown, growth, previous_quarter_end, strategy_label
from panelspark.operators.windows import by, cumulative_product, first_per_key

# The keys of an evaluation sample and of a run.
SAMPLE = ["evaluation_scope", "source_split", "run_id", "sample_key", "time_range", "quarter_end_date", "future_quarter_end_date"]
RUN = ["risk_penalty", "concentration_penalty", "model_family", "model_target"]


def _over(keys: list[str]):
    return Window.partitionBy(*keys)


def softmax_weights(scores: DataFrame, sample: list[str], score: str = "score", valid: str | None = None) -> DataFrame:
    """Scores of the valid members of a sample to weights that add up to 1."""
    df = scores.where(F.coalesce(valid, F.lit(False))) if valid else scores
    df = df.withColumn("_e", F.exp(F.col(score) - F.max(score).over(_over(sample))))
    return df.withColumn("weight", F.col("_e") / F.sum("_e").over(_over(sample))).drop("_e")


def renormalize(df: DataFrame, sample: list[str], weight: str = "weight") -> DataFrame:
    return df.withColumn(weight, F.col(weight) / F.greatest(F.sum(weight).over(_over(sample)), F.lit(EPS)))


def weight_rows(weights: DataFrame, sample: list[str] = SAMPLE) -> DataFrame:
    """Each weight row with its sample's metrics: renormalized and equal weight, value growth, benchmark growth, alpha, largest weight, effective holdings, asset return."""
    over = _over(sample)
    df = renormalize(weights, sample).withColumn("equal_weight", 1 / F.count("*").over(over))
    value = lambda w: F.sum(F.col(w) * F.col("future_price")).over(over) / F.greatest(F.sum(F.col(w) * F.col("current_price")).over(over), F.lit(EPS))
    df = df.withColumns({
        "portfolio_growth": value("weight"),
        "benchmark_growth": value("equal_weight"),
        "max_weight": F.max("weight").over(over),
        "effective_holdings": 1 / F.greatest(F.sum(F.col("weight") * F.col("weight")).over(over), F.lit(EPS)),
        "ticker_return": growth("current_price", "future_price") - 1,
    })
    return df.withColumn("growth_alpha", F.col("portfolio_growth") - F.col("benchmark_growth"))


METRICS = ["portfolio_growth", "benchmark_growth", "growth_alpha", "max_weight", "effective_holdings"]


def sample_summary(rows: DataFrame, sample: list[str] = SAMPLE) -> DataFrame:
    """One row for each sample from its weight rows, whose metrics repeat."""
    also = [c for c in RUN if c in rows.columns and c not in sample]
    return rows.groupBy(*sample).agg(F.count("*").cast("int").alias("ticker_count"), *[F.any_value(c).alias(c) for c in [*also, *METRICS]])


def run_summary(samples: DataFrame, runs: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """One row for each run (and each value of the columns ``by``): samples, six means, compounded growth of portfolio and benchmark, their difference, label; runs without samples get a reason."""
    out = samples.groupBy("run_id", *RUN, *by).agg(
        F.count("*").alias("sample_count"), *[F.avg(c).alias(f"mean_{c}") for c in METRICS], F.avg("ticker_count").alias("mean_ticker_count"),
        F.product("portfolio_growth").alias("cumulative_growth"), F.product("benchmark_growth").alias("benchmark_cumulative_growth"),
    )
    out = out.withColumn("cumulative_alpha", F.col("cumulative_growth") - F.col("benchmark_cumulative_growth")).withColumn("strategy_label", strategy_label("run_id", "model_family", "risk_penalty", "concentration_penalty"))
    if runs is None:
        return out
    skipped = runs.join(out, "run_id", "left_anti").withColumn("skip_reason", F.lit("no samples"))
    return out.withColumn("skip_reason", F.lit(None).cast("string")).unionByName(skipped, allowMissingColumns=True)


def rank_runs(summary: DataFrame) -> DataFrame:
    """Runs by mean alpha, best first; equal ones by run_id."""
    return summary.orderBy(F.desc("mean_growth_alpha"), "run_id")


def top_runs(validation: DataFrame, k: int) -> DataFrame:
    """The k best runs of the validation summary, with their rank: used in every scope."""
    best = rank_runs(validation).limit(k)
    return best.select("run_id", "strategy_label", F.row_number().over(Window.orderBy(F.desc("mean_growth_alpha"), "run_id")).alias("strategy_rank"))


def best_per_family(summary: DataFrame, families: list[str] | None = None) -> DataFrame:
    """The best run of each model family; an error if a family that is asked for has none."""
    best = first_per_key(summary, ["model_family"], F.desc("mean_growth_alpha"), "run_id")
    if families:
        have = {r[0] for r in best.select("model_family").collect()}
        if missing := sorted(set(families) - have):
            raise ValueError(f"no run of the model families {missing}")
        best = best.where(F.col("model_family").isin(families))
    return best


def of_runs(rows: DataFrame, top: DataFrame) -> DataFrame:
    """Rows of the chosen runs with label and rank; the chosen runs are few (top k)."""
    return rows.join(F.broadcast(top.select("run_id", "strategy_label", "strategy_rank")), "run_id")


def top_holdings(rows: DataFrame, k: int) -> DataFrame:
    """The k largest weights of each (run, date, split), equal ones by ticker."""
    w = by(["run_id", "quarter_end_date", "source_split"], F.desc("weight"), "ticker")
    return rows.withColumn("holding_rank", F.row_number().over(w)).where(F.col("holding_rank") <= k)


def benchmark_curve(samples: DataFrame) -> DataFrame:
    """Mean benchmark growth over runs by scope, split, date and period."""
    return samples.groupBy("evaluation_scope", "source_split", "quarter_end_date", "time_range").agg(F.avg("benchmark_growth").alias("growth"))


def strategy_curve(samples: DataFrame) -> DataFrame:
    return samples.groupBy("run_id", "risk_penalty", "concentration_penalty", "source_split", "quarter_end_date").agg(F.avg("portfolio_growth").alias("growth"))


def nav(curve: DataFrame, keys: list[str], value: str = "growth", date: str = "quarter_end_date", split: str = "source_split", spread: bool = False) -> DataFrame:
    """Compounded value by date, with a row of 1.0 at the quarter end before the first date (split ``base``)."""
    path = cumulative_product(curve, value, keys, date, split, "nav", spread)
    path = path.select(*keys, date, split, "nav")
    base = curve.groupBy(*keys).agg(F.min(date).alias(date)).withColumns({date: previous_quarter_end(date), split: F.lit("base"), "nav": F.lit(1.0)})
    return path.unionByName(base.select(*keys, date, split, "nav"))


def heatmap(summary: DataFrame, value: str, penalties: list[float]) -> DataFrame:
    """Means by model family and risk penalty (rows) and concentration penalty (columns)."""
    wide = summary.groupBy("model_family", "risk_penalty").pivot("concentration_penalty", penalties).agg(F.avg(value))
    return wide.select("model_family", "risk_penalty", *[F.col(f"`{p}`").alias(f"conc_{str(p).replace('.', '_')}") for p in penalties])


#: What a weight row of one run has in common with that of another.
PAIR = ["evaluation_scope", "source_split", "sample_key", "time_range", "quarter_end_date", "future_quarter_end_date", "ticker"]


def paired(rows: DataFrame, one: str | int, other: str | int, keys: list[str] = PAIR) -> DataFrame:
    """One row for each key that either run has: how many rows each has of it (n1, n2), their weights (w1, w2) and the prices. One shuffle, by sample."""
    own = lambda run, c: F.max(F.when(F.col("run_id") == run, F.col(c)))
    both = rows.where(F.col("run_id").isin(one, other)).repartition(*[k for k in keys if k != "ticker"])
    return both.groupBy(*keys).agg(F.count_if(F.col("run_id") == one).alias("n1"), F.count_if(F.col("run_id") == other).alias("n2"), own(one, "weight").alias("w1"), own(other, "weight").alias("w2"), *[F.coalesce(own(one, c), own(other, c)).alias(c) for c in ("current_price", "future_price")])


def pair_report(rows: DataFrame, one: str | int, other: str | int, keys: list[str] = PAIR) -> DataFrame:
    """One row: how far the rows of two runs match: matched keys, keys of one run only, and keys that come several times."""
    n1, n2 = F.col("n1"), F.col("n2")
    return paired(rows, one, other, keys).agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("rows_one"), F.coalesce(F.sum("n2"), F.lit(0)).alias("rows_other"), F.count_if((n1 == 1) & (n2 == 1)).alias("matched"), F.count_if(n2 == 0).alias("only_one"), F.count_if(n1 == 0).alias("only_other"), F.count_if((n1 > 1) | (n2 > 1)).alias("repeated"))


def ensemble(rows: DataFrame, one: str | int, other: str | int, label: str = "ensemble", keys: list[str] = PAIR, check: bool = True) -> DataFrame:
    """Half the weights of one run and half of the other, renormalized, with the metrics of the blend.

    Both runs must have the same rows, one for each key. ``check`` asserts that on the aggregate that pairs them, in the same
    pass: reading the result fails with the first key that doesn't match (``pair_report`` counts them all). Without it,
    keys of one run only are left out.
    """
    both = paired(rows, one, other, list(keys))
    fits = (F.col("n1") == 1) & (F.col("n2") == 1)
    weight = (F.col("w1") + F.col("w2")) / 2
    if check:
        at = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
        said = F.concat(F.lit("the runs' rows don't match one to one: "), F.col("n1").cast("string"), F.lit(" and "), F.col("n2").cast("string"), F.lit(" rows of "), at)
        weight = F.when(F.assert_true(fits, said).isNull(), weight)
    else:
        both = both.where("n1 > 0 and n2 > 0")
    blend = both.withColumn("weight", weight).withColumns({"run_id": F.lit(label), "model_family": F.lit(label), "model_target": F.lit(label), "risk_penalty": F.lit(None).cast("double"), "concentration_penalty": F.lit(None).cast("double")})
    return weight_rows(blend.drop("w1", "w2", "n1", "n2"))


def scope_summary(samples: DataFrame) -> DataFrame:
    """One row: means and compounded growth of an ensemble's samples."""
    return samples.agg(F.count("*").alias("sample_count"), *[F.avg(c).alias(f"mean_{c}") for c in METRICS], F.product("portfolio_growth").alias("cumulative_growth"), F.product("benchmark_growth").alias("benchmark_cumulative_growth")).withColumn("cumulative_alpha", F.col("cumulative_growth") - F.col("benchmark_cumulative_growth"))


def growth_loss(weights: DataFrame, sample: list[str], log: bool = True, risk: float = 0.0, concentration: float = 0.0) -> DataFrame:
    """One row: minus mean log growth (or mean return), plus risk times mean drawdown, plus concentration times mean sum of squared weights. Growth here is the weighted mean of the assets' growth."""
    each = weights.groupBy(*sample).agg(F.greatest(F.sum(F.col("weight") * growth("current_price", "future_price")), F.lit(EPS)).alias("g"), F.sum(F.col("weight") * F.col("weight")).alias("squares"))
    gain = F.avg(F.log("g")) if log else F.avg(F.col("g") - 1)
    return each.agg(F.count("*").alias("samples"), gain.alias("gain"), F.avg(drawdown("g")).alias("drawdown"), F.avg("squares").alias("squares")).withColumn("loss", -F.col("gain") + risk * F.col("drawdown") + concentration * F.col("squares"))


def batch_metrics(weights: DataFrame, sample: list[str]) -> DataFrame:
    """One row: means over samples of growth, benchmark, alpha, largest weight, holdings, log growth, drawdown, assets."""
    s = sample_summary(weight_rows(weights, sample), sample)
    return s.agg(*[F.avg(c).alias(c) for c in METRICS], F.avg(F.log(F.greatest("portfolio_growth", F.lit(EPS)))).alias("log_growth"), F.avg(drawdown("portfolio_growth")).alias("drawdown"), F.avg("ticker_count").alias("ticker_count"))


def sweep_index(runs: DataFrame) -> DataFrame:
    """One row for each run in the order of its penalties."""
    return runs.select("run_id", *RUN).dropDuplicates(["run_id"]).orderBy("risk_penalty", "concentration_penalty", "run_id")
