"""Sources that fail in part or as a whole, and what the job goes on with."""

import json

import pytest
from pyspark.sql import functions as F

from panelspark.plans import intake
from panelspark.sources import readers

SCHEMA = "ticker string, x long"


def part(spark, k):
    return lambda: spark.createDataFrame([(f"T{k}", k), (f"T{k}", k + 10)], SCHEMA)


def broken_when_read(spark):
    return lambda: spark.createDataFrame([("B", 1)], SCHEMA).withColumn("x", F.raise_error(F.lit("broken file")).cast("long"))


def missing(spark):
    return lambda: spark.read.schema(SCHEMA).parquet("/nowhere/at/all")


def outcomes(df):
    return {r.source: (r.status, r.parts, r.parts_read, r.rows, r.skipped_after_error) for r in df.collect()}


def test_keep_what_there_is(spark, tmp_path):
    sources = [
        intake.Source("whole", [part(spark, 0), part(spark, 1)], SCHEMA),
        intake.Source("half", [part(spark, 2), broken_when_read(spark), missing(spark), part(spark, 3)], SCHEMA, finish=lambda df: df.where("x < 10")),
        intake.Source("gone", [missing(spark)], SCHEMA),
        intake.Source("nothing", [], SCHEMA),
        intake.Source("unfinished", [part(spark, 5)], SCHEMA, finish=lambda df: df.select("no_such_column")),
    ]
    tables, found = intake.take_in(spark, sources, str(tmp_path), on_error="keep")
    assert outcomes(found) == {"whole": ("complete", 2, 2, 4, False), "half": ("partial", 4, 2, 2, True), "gone": ("failed", 1, 0, 0, True), "nothing": ("complete", 0, 0, 0, False), "unfinished": ("failed", 1, 0, 0, True)}
    assert sorted(tuple(r) for r in tables["half"].collect()) == [("T2", 2), ("T3", 3)]
    assert tables["gone"].columns == ["ticker", "x"] and tables["gone"].count() == 0
    counted = {r.source: r.tickers for r in intake.outcome_counters(tables, found).collect()}
    assert counted == {"whole": 2, "half": 2, "gone": 0, "nothing": 0, "unfinished": 0}


@pytest.mark.parametrize(("policy", "required"), [("stop", False), ("keep", True)])
def test_stop_after_saving(spark, tmp_path, policy, required):
    sources = [intake.Source("half", [part(spark, 2), missing(spark)], SCHEMA, required=required), intake.Source("later", [part(spark, 1)], SCHEMA)]
    with pytest.raises(intake.IntakeError, match="1 of 2 parts") as caught:
        intake.take_in(spark, sources, str(tmp_path), on_error=policy)
    assert outcomes(caught.value.outcomes) == {"half": ("partial", 2, 1, 2, False), "later": ("not_read", 1, 0, 0, False)}
    assert spark.read.parquet(str(tmp_path / "half" / "table")).count() == 2
    with pytest.raises(ValueError, match="policy"):
        intake.take_in(spark, sources, str(tmp_path), on_error="maybe")


def test_broken_news(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"feed": [{"url": "u"}]}))
    (tmp_path / "bad.json").write_text('{"feed": [{"url": ')
    assert readers.news(spark, str(tmp_path)).where("feed is not null").count() == 1
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.news(spark, str(tmp_path / "bad.json"), strict=True).collect()
