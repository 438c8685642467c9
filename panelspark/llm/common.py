"""What several operators share: tables, the shared folder, gapless ranks."""

from __future__ import annotations

import re
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_A_RUN = 50_000
#: A key with more rows isn't looked up in one task; so many of the heaviest are broadcast, so that any other has at most that share of the rows.
HOT_ROWS, HOT_KEYS = 250_000, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one is set under a local master (tests); on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder that ``fresh_dir`` named."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes not to clash with a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def heaviest(sizes: DataFrame, on: list[str], rows: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys of a table of sizes with over ``hot_rows`` rows, at most ``HOT_KEYS`` of them."""
    return sizes.where(F.col(rows) > hot_rows).orderBy(F.desc(rows)).limit(HOT_KEYS).select(*on)


def looked_up(rows: DataFrame, found: DataFrame, on: list[str], heavy: DataFrame, alone: Column | None = None) -> DataFrame:
    """rows with the columns of a table that has one row a key, null where it has none.

    Rows of heavy keys (at most ``HOT_KEYS``) get theirs from a broadcast and go on in any task, and so do rows that stand
    ``alone``, which get null; all others meet the table by key. The first column of the key is a long.
    """
    values = [c for c in found.columns if c not in on]
    few = found.join(F.broadcast(heavy), on, "left_semi").select(*on, F.struct(*values).alias("_few"))
    out = rows.join(F.broadcast(few), on, "left")
    alone = F.coalesce(alone, F.lit(False)) if alone is not None else F.lit(False)
    out = out.withColumn("_alone", alone).withColumn("_key", F.when(F.col("_alone") | F.col("_few").isNotNull(), F.monotonically_increasing_id()).otherwise(F.col(on[0])))
    rest = found.select(F.col(on[0]).alias("_key"), *on[1:], F.struct(*values).alias("_rest"))
    out = out.join(rest, ["_key", *on[1:]], "left")
    got = F.when(~F.col("_alone"), F.coalesce("_few", "_rest"))
    return out.select(*rows.columns, *[got[c].alias(c) for c in values])


def together(df: DataFrame, key: str) -> DataFrame:
    """df with all rows of a key in one task, for code that walks a task's rows.

    ``repartition(key)`` doesn't hold for that: after a join by the same key Spark leaves it out, and then may turn that
    join into a broadcast one that reads its shuffle by mapper. A repartition by another expression stays.
    """
    return df.repartition(F.xxhash64(key))


def numbered(df: DataFrame, name: str, *by: str | Column) -> DataFrame:
    """df with a column of gapless ranks from 0 in the order ``by``: rows are sorted over ranges, and a row for each range comes to the driver.

    Rows that are equal in all of ``by`` are dealt over ranges, too, so no number of them lands in one task.
    """
    salt = free_name(df, "_salt")
    ranged = df.withColumn(salt, F.rand(11)).repartitionByRange(*by, salt).sortWithinPartitions(*by).drop(salt)
    placed = cut(ranged.withColumn(name, F.monotonically_increasing_id()))
    parts = sorted(placed.groupBy(F.shiftright(name, 33).alias("p")).count().collect())
    starts = accumulate((k for _, k in parts), initial=0)
    first = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(parts, starts)], "_p long, _s long")
    own = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_p", F.shiftright(name, 33)).join(F.broadcast(first), "_p").withColumn(name, own + F.col("_s")).drop("_p", "_s")


def occurrences(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df with a column of gapless numbers from 0 among the rows that are equal in keys (null equals null), in any order.

    Rows are ranked over all keys and dealt to runs of ranks; only keys that go on over the border of a run have their
    first rank sent, and there are fewer of them than runs. So a key of any number of rows is spread over tasks.
    """
    ranked = numbered(df, "_rank", *keys).withColumn("_run", F.expr(f"_rank div {ROWS_A_RUN}"))
    same = [F.col(k) for k in keys]
    over = ranked.groupBy("_run", *same).agg(F.min("_rank").alias("_low"), F.max("_rank").alias("_high"))
    over = over.where(f"_low % {ROWS_A_RUN} = 0 or _high % {ROWS_A_RUN} = {ROWS_A_RUN - 1}").groupBy(*same).agg(F.min("_low").alias("_first"), F.count("*").alias("_runs")).where("_runs > 1")
    sent = over.select(F.struct(*same).alias("_key"), "_first")
    found = ranked.withColumn("_own", F.min("_rank").over(Window.partitionBy("_run", *same)))
    found = found.join(F.broadcast(sent), F.struct(*same).eqNullSafe(F.col("_key")), "left")
    return found.withColumn(name, F.col("_rank") - F.coalesce("_first", "_own")).drop("_rank", "_run", "_own", "_key", "_first")
