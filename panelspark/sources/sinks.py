"""Sinks: parquet first, CSV where people read it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The names of an evaluation's tables.
EVALUATION_TABLES = ["weights", "sample_summary", "run_summary", "top_strategies", "top_holdings", "strategy_nav", "benchmark_nav"]


def table(df: DataFrame, path: str, partition: str | None = None, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    w = w.partitionBy(partition) if partition else w
    (w.option("header", True).csv if fmt == "csv" else w.parquet)(path)


def panel(df: DataFrame, path: str, keys: list[str] = ("ticker", "quarter_end_date")) -> None:
    """The panel, one folder a split, sorted within files so that readers skip by key."""
    df.repartition("split", keys[0]).sortWithinPartitions("split", *keys).write.partitionBy("split").parquet(path)


def metadata(one_row: DataFrame, path: str) -> None:
    """A one-row table as one JSON object."""
    one_row.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def evaluation(tables: dict[str, DataFrame], root: str) -> None:
    """The tables of an evaluation under their fixed names, by scope."""
    if unknown := set(tables) - set(EVALUATION_TABLES):
        raise ValueError(f"unknown evaluation tables {sorted(unknown)}")
    for name, df in tables.items():
        df.write.partitionBy("evaluation_scope").parquet(f"{root}/{name}")


def predictions(df: DataFrame, path: str, prediction: str = "prediction", target: str = "target") -> None:
    df.select(prediction, target).write.option("header", True).csv(path)


def epochs(df: DataFrame, path: str) -> None:
    """Epoch rows, columns sorted by name after epoch."""
    rest = sorted(c for c in df.columns if c != "epoch")
    df.select("epoch", *rest).write.option("header", True).csv(path)
