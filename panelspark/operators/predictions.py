"""Predictions against targets: reports, multi-task loss and metrics, epoch histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.scalar import arg_max, log_sum_exp

KEYS = ["split", "ticker", "time_range", "quarter_end_date"]


def unfold(predictions: DataFrame, horizons: list[int], keys: list[str] = KEYS) -> DataFrame:
    """Arrays over horizons to a row each, with errors and correctness."""
    zipped = F.arrays_zip(F.array(*[F.lit(h) for h in horizons]).alias("horizon"), F.col("price_predictions").alias("predicted_price"), F.col("price_targets").alias("target_price"), F.col("class_logits").alias("logits"), F.col("class_targets").alias("target_class"))
    rows = predictions.select(*keys, F.explode(zipped).alias("r")).select(*keys, "r.*")
    rows = rows.withColumn("predicted_class", arg_max("logits"))
    return rows.withColumns({"price_error": F.col("predicted_price") - F.col("target_price"), "absolute_error": F.abs(F.col("predicted_price") - F.col("target_price")), "correct_class": F.col("predicted_class") == F.col("target_class")})


def _report(rows_by) -> list[Column]:
    e, t = F.col("price_error"), F.col("target_price")
    spread = F.var_pop(t) * F.count(t)
    return [F.count("*").alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), spread)).alias("r2"), F.avg(F.col("correct_class").cast("double")).alias("accuracy"), F.avg("predicted_price").alias("mean_predicted"), F.avg(t).alias("mean_target")]


def report_by_horizon(rows: DataFrame) -> DataFrame:
    return rows.groupBy("horizon").agg(*_report(rows))


def report_overall(rows: DataFrame) -> DataFrame:
    return rows.agg(*_report(rows), F.countDistinct("ticker", "quarter_end_date").alias("samples"))


def report_by_sample(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    e = F.col("price_error")
    return rows.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("predicted_price").alias("mean_predicted"), F.avg("target_price").alias("mean_target"))


def horizon_weights(n: int, weights: list[float] | None = None) -> list[float]:
    """Weights of the horizons, adding up to 1; equal by default."""
    weights = weights or [1.0] * n
    if len(weights) != n or sum(weights) <= 0:
        raise ValueError(f"{n} horizon weights with a positive sum are needed: {weights}")
    return [w / sum(weights) for w in weights]


def multitask_loss(predictions: DataFrame, n: int, weights: list[float] | None = None, regression: float = 1.0, classification: float = 1.0, smooth: bool = False) -> DataFrame:
    """One row: weighted regression and cross-entropy losses over horizons, averaged over samples, and their sum."""
    w = F.array(*[F.lit(x) for x in horizon_weights(n, weights)])
    error = F.zip_with("price_predictions", "price_targets", lambda p, t: p - t)
    piece = lambda e: F.when(F.abs(e) < 1, 0.5 * e * e).otherwise(F.abs(e) - 0.5) if smooth else e * e
    reg = F.aggregate(F.zip_with(error, w, lambda e, v: v * piece(e)), F.lit(0.0), lambda s, x: s + x)
    entropy = F.zip_with("class_logits", "class_targets", lambda z, t: log_sum_exp(z) - F.get(z, t))
    cls = F.aggregate(F.zip_with(entropy, w, lambda e, v: v * e), F.lit(0.0), lambda s, x: s + x)
    one = predictions.agg(F.avg(reg).alias("regression_loss"), F.avg(cls).alias("classification_loss"))
    return one.withColumn("loss", regression * F.col("regression_loss") + classification * F.col("classification_loss"))


def multitask_metrics(rows: DataFrame, horizons: list[int]) -> DataFrame:
    """One row: price MAE, class accuracy, and accuracy of each horizon."""
    right = F.col("correct_class").cast("double")
    return rows.agg(F.avg("absolute_error").alias("price_mae"), F.avg(right).alias("class_accuracy"), *[F.avg(F.when(F.col("horizon") == h, right)).alias(f"class_accuracy_t{h}") for h in horizons])


def simple_evaluation(rows: DataFrame, prediction: str, target: str) -> DataFrame:
    e = F.col(prediction) - F.col(target)
    return rows.agg(F.count("*").alias("count"), F.avg(F.abs(e)).alias("mean_absolute_error"), F.avg(e * e).alias("mean_squared_error"))


def epoch_metrics(steps: DataFrame, phases: list[str] = ("train", "val")) -> DataFrame:
    """Step logs (epoch, phase, step, name, value) -> one row for each epoch with {phase}_{name}: sums over the phase's steps divided by all its steps."""
    n = steps.groupBy("epoch", "phase").agg(F.countDistinct("step").alias("n"))
    mean = steps.groupBy("epoch", "phase", "name").agg(F.sum("value").alias("v")).join(n, ["epoch", "phase"])
    names = [r[0] for r in steps.select("name").distinct().orderBy("name").collect()]
    columns = [F.max(F.when((F.col("phase") == p) & (F.col("name") == m), F.col("v") / F.col("n"))).alias(f"{p}_{m}") for p in phases for m in names]
    count = [F.coalesce(F.max(F.when(F.col("phase") == p, F.col("n"))), F.lit(0)).cast("int").alias(f"{p}_steps") for p in phases]
    return mean.groupBy("epoch").agg(*count, *columns)


def best_epoch(epochs: DataFrame, first: str = "val_regression_loss", fallback: str = "val_loss") -> DataFrame:
    """The first epoch of the smallest validation loss: one row."""
    loss = F.coalesce(*[F.col(c) for c in (first, fallback) if c in epochs.columns])
    return epochs.withColumn("_loss", loss).where("_loss is not null").orderBy("_loss", "epoch").limit(1).drop("_loss")


def last_epochs(epochs: DataFrame, n: int) -> DataFrame:
    return epochs.orderBy(F.desc("epoch")).limit(n)


def generalization_gaps(epochs: DataFrame) -> DataFrame:
    gap = lambda a, b: F.col(a) - F.col(b)
    return epochs.select("epoch", gap("val_loss", "train_loss").alias("loss_gap"), gap("val_price_mae", "train_price_mae").alias("mae_gap"), gap("train_class_accuracy", "val_class_accuracy").alias("accuracy_gap"))


EPOCH_SUMMARY = ["epoch", "train_steps", "val_steps", "train_loss", "val_loss", "train_price_mae", "val_price_mae", "train_class_accuracy", "val_class_accuracy"]


def epoch_summary(epochs: DataFrame, columns: list[str] = EPOCH_SUMMARY) -> DataFrame:
    """Fixed columns, NULL where the history lacks them."""
    return epochs.select(*[F.col(c) if c in epochs.columns else F.lit(None).cast("double").alias(c) for c in columns])


def snapshot_history(*records: DataFrame | None) -> DataFrame | None:
    """The union of those histories that are there, by epoch."""
    out = None
    for df in records:
        if df is not None:
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out if out is None else out.orderBy("epoch")


def sampled_predictions(keys: DataFrame, rows: DataFrame) -> DataFrame:
    return keys.join(rows, KEYS, "left")
