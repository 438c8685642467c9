"""Taking in landed sources one by one, with a recorded outcome of each.

A source has parts (request windows, files, tickers), each a function that gives a DataFrame.
It is first read as a whole. If that fails, its parts are read one by one, and what can be
read is kept: a source is ``complete``, ``partial`` or ``failed``. Every table is written
before a failure is raised or passed over, so nothing that was read is lost:

* a required source, and any source under ``on_error="stop"``, ends the intake with
  ``IntakeError`` after what it gave is saved; later sources are ``not_read``;
* under ``on_error="keep"`` the job goes on with the rows there are, or with an empty table of the
  source's schema.

Outcomes are a table: source, status, parts, parts_read, rows, skipped_after_error, error. Broken files
show only when they are read, so a part counts as read once it is written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.sources import sinks

Part = Callable[[], DataFrame]
FAILURES = (PySparkException, Py4JError, OSError, ValueError)
OUTCOME = "source string, status string, parts int, parts_read int, rows long, skipped_after_error boolean, error string"


@dataclass(frozen=True)
class Source:
    """name, parts, the schema of the table they make together (DDL or type), whether the job can't do without it, and what is made of all parts' rows."""

    name: str
    parts: list[Part]
    schema: str | T.StructType
    required: bool = False
    finish: Callable[[DataFrame], DataFrame] | None = None


class IntakeError(RuntimeError):
    """A source that the job needs could not be read whole. ``outcomes`` and ``tables`` hold what was."""

    def __init__(self, message: str, tables: dict[str, DataFrame], outcomes: DataFrame):
        super().__init__(message)
        self.tables, self.outcomes = tables, outcomes


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _first_line(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error).strip().splitlines()[0] if str(error).strip() else ''}"[:300]


def _landed(spark: SparkSession, source: Source, root: str) -> tuple[list[str], list[str]]:
    """Where the source's rows were written, and the errors of the parts that could not be."""
    whole = f"{root}/{source.name}/raw/all"
    try:
        if source.parts:
            sinks.table(_union([part() for part in source.parts]), whole)
            return [whole], []
    except FAILURES as error:
        if len(source.parts) == 1:
            return [], [_first_line(error)]
    paths, errors = [], []
    for k, part in enumerate(source.parts):
        try:
            sinks.table(part(), f"{root}/{source.name}/raw/{k}")
            paths.append(f"{root}/{source.name}/raw/{k}")
        except FAILURES as error:
            errors.append(_first_line(error))
    return paths, errors


def take_in(spark: SparkSession, sources: list[Source], root: str, on_error: str = "stop") -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of all sources, as saved under ``{root}/{name}/table``, and the outcomes."""
    if on_error not in ("stop", "keep"):
        raise ValueError(f"unknown policy {on_error!r}: stop or keep")
    tables: dict[str, DataFrame] = {}
    rows: list[tuple] = []
    for place, source in enumerate(sources):
        paths, errors = _landed(spark, source, root)
        good = len(source.parts) - len(errors)
        where = f"{root}/{source.name}/table"
        if paths:
            raw = _union([spark.read.parquet(p) for p in paths])
            try:
                sinks.table(source.finish(raw) if source.finish else raw, where)
            except FAILURES as error:
                errors, good, paths = [*errors, _first_line(error)], 0, []
        if not paths:
            where += "-empty"
            sinks.table(spark.createDataFrame([], source.schema), where)
        tables[source.name] = spark.read.parquet(where)
        status = "failed" if errors and not good else "partial" if errors else "complete"
        n = tables[source.name].count() if paths else 0
        stop = bool(errors) and (source.required or on_error == "stop")
        rows.append((source.name, status, len(source.parts), good, n, bool(errors) and not stop, errors[0] if errors else None))
        if stop:
            rows += [(s.name, "not_read", len(s.parts), 0, 0, False, None) for s in sources[place + 1 :]]
            raise IntakeError(f"{source.name}: {good} of {len(source.parts)} parts could be read; {errors[0]}", tables, spark.createDataFrame(rows, OUTCOME))
    return tables, spark.createDataFrame(rows, OUTCOME)


def outcome_counters(tables: dict[str, DataFrame], outcomes: DataFrame, key: str = "ticker") -> DataFrame:
    """The outcomes with the number of distinct keys of each table that has them."""
    per = [df.agg(F.lit(name).alias("source"), (F.countDistinct(key) if key in df.columns else F.lit(0).cast("long")).alias("tickers")) for name, df in tables.items()]
    return outcomes.join(_union(per), "source", "left") if per else outcomes.withColumn("tickers", F.lit(0).cast("long"))
