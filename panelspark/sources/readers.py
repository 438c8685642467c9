"""Readers. Text columns are cast with NULL on failure, so one bad cell never stops a scan."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.scalar import period_end, period_tag, to_day, to_double
from panelspark.operators.panel import average_by_period
from panelspark.operators.stories import STORY_COLUMNS
from panelspark.operators.windows import last_per_period
from panelspark.sources import schemas


def csv(spark: SparkSession, path: str, sep: str = ",", breaks: bool = False) -> DataFrame:
    """All columns as text, by the header. One file is read by as many tasks as its size asks for, and only the columns that are used are parsed.

    ``breaks``: quoted fields may hold line breaks; then one task reads a file from end to end. Without it, the pieces of such
    a field are rows of their own, which lack what the readers need and are left out.
    """
    return spark.read.option("header", True).option("sep", sep).option("multiLine", breaks).option("escape", '"').csv(path)


def landed_text(spark: SparkSession, path: str, to: str, sep: str = ",") -> str:
    """The landing step of a file whose fields may hold line breaks: read once and written as parquet, which later scans split and prune. Gives ``to``."""
    csv(spark, path, sep, breaks=True).repartition(spark.sparkContext.defaultParallelism).write.parquet(to)
    return to


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds anything to read there, in any file system."""
    try:
        return bool(spark.read.format("binaryFile").load(path).limit(1).count())
    except AnalysisException:
        return False


def need(df: DataFrame, columns: list[str], what: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks the columns {missing}; it has {df.columns}")


def prices(spark: SparkSession, path: str, field: str = "Adj. Close", sep: str = ";") -> DataFrame:
    """Daily prices: ticker, date, price; rows without any of them are left out."""
    df = csv(spark, path, sep)
    need(df, ["Ticker", "Date", field], "the price file")
    return df.select(F.col("Ticker").alias("ticker"), to_day("Date").alias("date"), to_double(F.col(f"`{field}`")).alias("price")).dropna()


def renamed(spark: SparkSession, path: str, names: dict[str, str], sep: str = ";") -> DataFrame:
    """A statement file with the engine's names; columns that the file lacks are NULL."""
    df = csv(spark, path, sep)
    need(df, ["Ticker", "Report Date"], "the statement file")
    kind = lambda old, new: F.col(f"`{old}`") if new == "ticker" else to_day(f"`{old}`") if new == "report_date" else to_double(f"`{old}`")
    picked = [(kind(old, new) if old in df.columns else F.lit(None).cast("double")).alias(new) for old, new in names.items()]
    return df.select(*picked).dropna(subset=["ticker", "report_date"])


def statements(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """income, balance, cashflow, companies and prices of a folder of bulk files, all tickers at once."""
    return {
        "income": renamed(spark, f"{folder}/income.csv", schemas.INCOME),
        "balance": renamed(spark, f"{folder}/balance.csv", schemas.BALANCE),
        "cashflow": renamed(spark, f"{folder}/cashflow.csv", schemas.CASHFLOW),
        "companies": csv(spark, f"{folder}/companies.csv", ";", breaks=True),
        "prices": prices(spark, f"{folder}/shareprices.csv"),
    }


def _typed(df: DataFrame, text: list[str], dates: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in text else to_day(c).alias(c) if c in dates else to_double(F.col(f"`{c}`")).alias(c) for c in df.columns])


def fundamental(spark: SparkSession, path: str, ticker: str = "ticker", date: str = "date", freq: str = "quarterly") -> DataFrame:
    """Cleaned fundamentals by ticker and period: means and last date."""
    df = csv(spark, path)
    need(df, [ticker, date], "the fundamental file")
    df = df.withColumnsRenamed({ticker: "ticker", date: "date"})
    return average_by_period(_typed(df, ["ticker"], ["date"]), freq=freq)


def stories(spark: SparkSession, path: str, ticker: str = "ticker", date: str = "date", freq: str = "quarterly", landed: bool = False) -> DataFrame:
    """Cleaned story rows with their period, from the CSV file, or from the table that ``landed_text`` made of it."""
    df = spark.read.parquet(path) if landed else csv(spark, path, breaks=True)
    need(df, [ticker, date], "the story file")
    df = df.withColumnsRenamed({ticker: "ticker", date: "date"})
    scores = [c for c in df.columns if c.endswith("_score")]
    df = df.withColumns({c: to_double(c) for c in scores} | {"date": to_day("date")}).where("ticker is not null and date is not null")
    return df.withColumn("time_range", period_tag("date", freq))


def _optional(spark: SparkSession, path: str, keys: list[str], date: str, freq: str) -> DataFrame:
    schema = ", ".join([*(f"{k} string" for k in keys), "time_range string", "date date"])
    empty = lambda: spark.createDataFrame([], schema)
    if not exists(spark, path):
        return empty()
    df = csv(spark, path)
    if date not in df.columns or any(k not in df.columns for k in keys):
        return empty()
    df = _typed(df.withColumnsRenamed({date: "date"}), [*keys, "time_range"], ["date"]).where("date is not null")
    values = [c for c in df.columns if c not in (*keys, "date", "time_range")]
    if not values:
        return empty()
    return last_per_period(df.withColumn("time_range", period_tag("date", freq)), [*keys, "time_range"], "date", values)


def economics(spark: SparkSession, path: str, date: str = "date", freq: str = "quarterly") -> DataFrame:
    """Macro columns by period; a missing, empty or unusable file is an empty table."""
    return _optional(spark, path, [], date, freq)


def technical(spark: SparkSession, path: str, ticker: str = "ticker", date: str = "date", freq: str = "quarterly") -> DataFrame:
    return _optional(spark, path, [ticker], date, freq)


def split_file(spark: SparkSession, path: str, split: str, freq: str = "quarterly", date: str = "quarter_end_date") -> DataFrame:
    """A split's file, tagged; dates are moved to the calendar period end."""
    df = csv(spark, path)
    need(df, ["ticker", date], "the split file")
    text, flags = ["ticker", "time_range", "split"], ["window_ready", "horizon_target_ready"]
    cast = lambda c: F.col(c) if c in text else to_day(c) if c.endswith("_date") else F.col(c).try_cast("boolean") if c in flags else to_double(F.col(f"`{c}`"))
    df = df.select(*[cast(c).alias(c) for c in df.columns])
    return df.withColumns({date: period_end(date, freq), "split": F.lit(split)}).withColumn("time_range", period_tag(date, freq))


#: The name of a landed {name}.json, a file or a folder of part files (a partition's folder, too).
_LANDED = r"/(?:[^/=]*=)?([^/=]+)\.json(?:/[^/]*)?$"


def news(spark: SparkSession, path: str, strict: bool = False, lines: bool = False) -> DataFrame:
    """Landed news payloads, one JSON document a file; any number of request windows. A broken document has no articles, or, if ``strict``, is an error when it is read.

    ``lines``: files hold a document a line (``landing.write_news``), and many tasks read one file. Without it a document, and so a file, must fit a task's memory.
    """
    return spark.read.schema(schemas.FEED).option("multiLine", not lines).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def indicator_payloads(spark: SparkSession, path: str, field: str = "value") -> DataFrame:
    """Landed [{date, value}] payloads, one {name}.json (a file, or a folder of part files) an indicator -> name, date, value."""
    df = spark.read.schema(f"date string, `{field}` string").option("multiLine", True).json(path)
    name = F.regexp_extract("_metadata.file_path", _LANDED, 1)
    return df.select(name.alias("name"), "date", F.col(f"`{field}`").alias("value"))


def technical_payloads(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Landed technical payloads under {ticker}__{name}__{period}__{timeframe}.json -> those keys, date, and a map of all values.

    ``bundled``: files hold many payloads, a line each under that name (``landing.write_bundles``). Without it the driver holds an entry for each file.
    """
    if bundled:
        landed = spark.read.schema("name string, payload array<map<string,string>>").json(path).select("name", "payload")
    else:
        lines = spark.read.option("wholetext", True).text(path)
        landed = lines.select(F.regexp_extract("_metadata.file_path", _LANDED, 1).alias("name"), F.from_json("value", "array<map<string,string>>").alias("payload"))
    part = F.split("name", "__")
    rows = landed.select(part[0].alias("ticker"), part[1].alias("name"), part[2].try_cast("int").alias("period"), part[3].alias("timeframe"), F.explode("payload").alias("m"))
    numbers = F.map_filter(F.transform_values(F.map_filter("m", lambda k, _: k != "date"), lambda _, v: to_double(v)), lambda _, v: v.isNotNull())
    return rows.select("ticker", "name", "period", "timeframe", F.try_element_at("m", F.lit("date")).alias("date"), numbers.alias("values"))


def saved_evaluation(spark: SparkSession, folder: str, table: str, scopes: list[str] = ("val", "all")) -> DataFrame:
    """A saved evaluation table of all scopes that are there ({folder}/{scope}/{table}.csv), tagged with scope; an error if there is none."""
    out = None
    for scope in available_scopes(spark, folder, table, scopes):
        df = spark.read.schema(schemas.EVALUATION).option("header", True).csv(f"{folder}/{scope}/{table}.csv").withColumn("evaluation_scope", F.lit(scope))
        out = df if out is None else out.unionByName(df)
    return out


def available_scopes(spark: SparkSession, folder: str, table: str, scopes: list[str] = ("val", "all")) -> list[str]:
    found = [s for s in scopes if exists(spark, f"{folder}/{s}/{table}.csv")]
    if not found:
        raise FileNotFoundError(f"{folder} holds {table} for none of the scopes {list(scopes)}")
    return found


def sweep_runs(spark: SparkSession, root: str, file: str = "run.json") -> DataFrame:
    """The numbered run folders of a sweep, with their JSON; run_id is the folder."""
    df = spark.read.option("multiLine", True).json(f"{root}/*/*{file}")
    run = F.regexp_extract("_metadata.file_path", r"/(?:[^/=]*=)?(\d+)/(?:[^/=]*=)?" + re.escape(file) + "(?:/[^/]*)?$", 1)
    return df.withColumn("run_id", run.try_cast("int")).where("run_id is not null")


def sweep_artifacts(spark: SparkSession, root: str, config: str = "config.json", metrics: str = "metrics.json") -> DataFrame:
    """The numbered run folders of a sweep: the config and the metrics of each run, joined by run_id; NULL metrics for runs that have none."""
    return sweep_runs(spark, root, config).join(sweep_runs(spark, root, metrics), "run_id", "left")


def story_template(spark: SparkSession) -> DataFrame:
    """An empty story table: what a source that has nothing gives."""
    return spark.createDataFrame([], ", ".join(f"{c} {'double' if c.endswith('_score') else 'string'}" for c in STORY_COLUMNS))
