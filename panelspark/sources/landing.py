"""Folders for landed files, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder is set under a local master (tests), and on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, for what reads it several times."""
    where = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return path


def write_news(df: DataFrame, window: Column, document: Column, path: str) -> str:
    """News payloads as they come, a JSON document a line, landed by request window as {path}/part={window}: a window of any size is never one value."""
    df.select(window.alias("part"), document.alias("value")).write.partitionBy("part").text(path)
    return path


def write_payloads(df: DataFrame, name: Column, fields: Column, path: str) -> str:
    """One JSON list a name, landed as {path}/name={name}.json."""
    lists = df.groupBy(F.concat(name, F.lit(".json")).alias("name")).agg(F.to_json(F.collect_list(fields)).alias("value"))
    lists.repartition("name").write.partitionBy("name").text(path)
    return path


def write_bundles(df: DataFrame, name: Column, fields: Column, path: str) -> str:
    """One JSON list a name, landed as lines {"name": ..., "payload": [...]}, many names a file: with a file a name, the driver holds an entry for each of them."""
    lists = df.groupBy(name.alias("name")).agg(F.collect_list(fields).alias("payload"))
    lists.select(F.to_json(F.struct("name", "payload")).alias("value")).write.text(path)
    return path
