"""Data quality before training."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_finite(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def finite_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null, nan, infinite) in one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("null"), F.count_if(F.isnan(c)).alias("nan"), F.count_if(F.abs(F.col(c)) == float("inf")).alias("infinite")) for c in columns]
    return df.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def bad_rows(df: DataFrame, columns: list[str], keys: list[str], n: int = 5) -> DataFrame:
    """The first n rows (by key) with a value that isn't finite."""
    return df.where(reduce(lambda a, b: a | b, (not_finite(c) for c in columns))).orderBy(*keys).limit(n)


# Columns that a merge leaves behind, which no model may see, and the prefix of all such.
RESERVED = ["quarter_end_date_story", "quarter_end_date_economics", "quarter_end_date_technical"]
RESERVED_PREFIX = "quarter_end_date_"


def reserved_features(features: list[str]) -> list[str]:
    """The features that are helper columns of a merge."""
    return sorted(f for f in features if f in RESERVED or f.startswith(RESERVED_PREFIX))


def preflight(samples: DataFrame, features: list[str], prices: list[str], length: str = "sequence_length", split: str = "split") -> DataFrame:
    """(check, passed): features there and none a helper column of a merge, training rows there, all finite, prices positive, lengths positive."""
    schema_ok = bool(features) and not reserved_features(features)
    finite = reduce(lambda a, b: a | b, (not_finite(c) for c in [*features, *prices]), F.lit(False))
    checks = [
        ("features", F.lit(schema_ok)),
        ("training_rows", F.count_if(F.col(split) == "train") > 0),
        ("finite", F.count_if(finite) == 0),
        ("positive_prices", F.count_if(reduce(lambda a, b: a | b, (F.col(p) <= 0 for p in prices), F.lit(False))) == 0),
        ("positive_lengths", F.coalesce(F.min(length) > 0, F.lit(False))),
    ]
    parts = [F.struct(F.lit(n).alias("check"), c.alias("passed")) for n, c in checks]
    return samples.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def require(report: DataFrame, features: list[str] = (), matches: DataFrame | None = None, **said: object) -> None:
    """An error that names the failed checks and reserved features, and, where no row trains, the training split's row of ``matches`` (as ``target_matches`` gives it) and what else is said."""
    failed = [r.check for r in report.where("not passed").collect()]
    if not failed:
        return
    message = f"failed checks: {failed}"
    if bad := reserved_features(list(features)):
        message += f"; helper columns among the features: {bad}"
    if "training_rows" in failed and matches is not None:
        train = matches.where("split = 'train'").head()
        facts = {**said, **({f"train_{k}": v for k, v in train.asDict().items() if k != "split"} if train else {})}
        message += "; targets: " + ", ".join(f"{k}={v}" for k, v in facts.items())
    raise ValueError(message)


def score_report(scores: DataFrame, score: str = "score", valid: str = "valid") -> DataFrame:
    """One row: NaN anywhere, values of valid members that aren't finite; masked members may be minus infinity."""
    ok = F.coalesce(F.col(valid), F.lit(False))
    return scores.agg(F.count_if(F.isnan(score)).alias("nan"), F.count_if(ok & not_finite(score)).alias("valid_not_finite"), F.count_if(~ok & (F.col(score) == float("inf"))).alias("masked_infinite")).withColumn("passed", (F.col("nan") == 0) & (F.col("valid_not_finite") == 0) & (F.col("masked_infinite") == 0))
