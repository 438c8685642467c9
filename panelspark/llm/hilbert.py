"""Sharding along a Hilbert curve over metadata dimensions.

Four dimensions are quantised to ``BITS`` bits each: language and source by their
rank among the values (order of UTF-8 bytes, which is that of code points; null last), text size by its logarithm, and
doc_id by its place between the smallest and the largest. A document's cell lies on a
Hilbert curve through the grid; documents ordered by cell are cut into runs, the
shards. Neighbours on the curve are neighbours in every dimension, so the bounds of a
shard's columns (``shard_bounds``) let readers skip files on any of them.

A rank over all rows needs no single sort: rows (ids, sizes and checksums) are sorted by
(cell, doc_id, checksum) over ranges, and a range's ranks follow from the counts of those
before it. A cell, a null or repeated id, or repeated rows of any number are dealt over as
many ranges as they need. ``law="rows"`` cuts by number of rows: shard sizes differ by
one row at most. Only row keys and the distinct languages and sources are shuffled,
never texts.

Edge cases: a null text has no bytes and the checksum of no bytes; null doc_ids count
as the smallest; equal rows take neighbouring places in any order; no rows, no result;
with fewer rows than shards, some shards are empty.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import cut, free_name, numbered, occurrences, table

SHARDS = 24
BITS = 4


def curve_index(x: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of x (n points x d dimensions), by Gray code and axis rotations bit by bit."""
    x = x.T.astype(np.int64).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            turn = (x[i] & q) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turn, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[d - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_column(bits: int, *dims: Column) -> Column:
    @F.arrow_udf("int")
    def place(*cols: pa.Array) -> pa.Array:
        return pa.array(curve_index(np.stack([c.to_numpy(zero_copy_only=False) for c in cols], 1), bits), pa.int32())

    return place(*dims)


def ranks(df: DataFrame, column: str, bits: int) -> Column:
    """The rank of a column's value among its distinct values, scaled to ``bits`` bits; null has the last cell.

    One rule for any number of values: they are sorted over ranges and numbered, and of them only those come to the
    driver at which a new cell begins, at most ``2 ** bits - 1``. A value's cell is the number of these up to it.
    """
    cells = 1 << bits
    value = F.col(column).cast("binary")  # the order of code points, whatever the column's collation
    values = df.select(value.alias("v")).where(F.col("v").isNotNull()).distinct().repartitionByRange("v").sortWithinPartitions("v")
    values = cut(values.select("v", F.monotonically_increasing_id().alias("at")))  # partition * 2 ** 33 + place in it
    parts = sorted(values.groupBy(F.shiftright("at", 33)).count().collect())
    starts = [0, *accumulate(k for _, k in parts)]
    firsts = [-(-c * (starts[-1] + 1) // cells) for c in range(1, cells)]  # the rank at which cell c begins
    found = [(k, bisect_right(starts, k) - 1) for k in firsts if k < starts[-1]]
    at = [(parts[i][0] << 33) + k - starts[i] for k, i in found]
    borders = {r.at: r.v for r in values.where(F.col("at").isin(at)).collect()} if at else {}
    cell = reduce(add, [(value >= F.lit(borders[x])).cast("int") for x in at], F.lit(0))
    return F.when(F.col(column).isNull(), cells - 1).otherwise(cell)


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", bits: int = BITS) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, cell, law, shard, slot, grown_shard."""
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = cut(rows)
    top = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).head()
    n, cells = top.n, 1 << bits
    low, span = top.low or 0, max(1, (top.high or 0) - (top.low or 0) + 1)
    by_size = F.least(F.lit(cells - 1), F.floor(F.log2(F.col("size").cast("double") / 8) * cells / 20)).cast("int")
    by_id = F.least(F.lit(cells - 1), ((F.coalesce("doc_id", F.lit(low)) - F.lit(low)).cast("double") / span * cells).cast("int"))
    keyed = rows.select("doc_id", "size", "text_crc32", curve_column(bits, ranks(rows, "lang", bits), ranks(rows, "source", bits), by_size, by_id).alias("cell"))
    ranked = numbered(cut(keyed), "rank", "cell", "doc_id", "text_crc32", "size")
    number = F.expr(f"rank * {shards} div {max(n, 1)}")
    begin = F.expr(f"(shard * {max(n, 1)} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", number.cast("int")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cell")


def place_rows(docs: DataFrame, placed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row (a struct of the columns of docs), shard and slot of each document; null and repeated ids find theirs, too.

    Rows equal in doc_id and text have numbers on both sides, so that each meets one; rows of one key and number are alone.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("c"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("s"), F.struct("*").alias("row"))
    where = placed.select(F.col("doc_id").alias("i2"), F.col("text_crc32").alias("c2"), F.col("size").alias("s2"), "shard", "slot")
    rows, where = occurrences(rows, "k", "i", "c", "s"), occurrences(where, "k2", "i2", "c2", "s2")
    same = F.col("i").eqNullSafe(F.col("i2")) & (F.col("c") == F.col("c2")) & (F.col("s") == F.col("s2")) & (F.col("k") == F.col("k2"))
    return rows.join(where, same).select("row", "shard", "slot", F.col("s").alias("size"))


def shard_bounds(docs: DataFrame, placed: DataFrame, doc_id: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Rows, bytes, bounds and numbers of nulls of each shard, for pruning: a row for each shard. A reader that looks for nulls keeps the shards that count some."""
    rows = place_rows(docs, placed, doc_id, text)
    stats = [f(c).alias(f"{n}_{k}") for n, c in [("size", F.col("size")), *((c, F.col(f"row.`{c}`")) for c in columns)] for k, f in (("min", F.min), ("max", F.max), ("nulls", lambda c: F.count_if(c.isNull())))]
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *stats)


def write_shards(docs: DataFrame, placed: DataFrame, to: str, doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes the documents into a folder for each shard, in slot order, and returns the name of the folders' column: ``shard``, or another one if docs has that.

    Rows are dealt over ranges of (shard, slot), so a large shard is written by several tasks, as several files in order.
    """
    name = free_name(docs, "shard")
    rows = place_rows(docs, placed, doc_id, text).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(to)
    return name


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
