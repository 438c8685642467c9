"""Labelled rows for the classifiers that are trained here."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_DOCS = 400


def held_out(doc_id: str | Column) -> Column:
    """True for the fifth of the ids that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(-1)).cast("string").cast("binary")) % 5 == 0


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, columns: list[str], max_docs: int, max_bytes: int, doc_id: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """_id, _y (the label), _place (from 0, in a seeded order of doc_id), text and columns of at most max_docs labelled rows of at most max_bytes of text together, without held-out ids.

    Both bounds are parameters, so what a task or the driver gets of it doesn't grow with the input. Texts come whole. Those of over
    1 / LEAST_DOCS of max_bytes are taken after all others, the shortest first, as far as both bounds leave room: a long
    text never keeps another one out. Null labels and ids are left out, and so are labels without a row in docs; of
    several labels for a doc_id the largest counts; of several rows for it, one of the shortest is taken.

    The choice is made on ids and sizes; only the texts chosen are shuffled.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_b")
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"), F.first(F.xxhash64("_id", F.lit(seed))).alias("_o"))
    sizes = docs.select(F.col(doc_id).alias("_id"), size).groupBy("_id").agg(F.min("_b").alias("_b"))
    picked = known.join(sizes, "_id").orderBy(F.greatest("_b", F.lit(max_bytes // LEAST_DOCS)), "_o", "_id").limit(max_docs)
    first = picked.collect()
    chosen = sorted((r for r, n in zip(first, accumulate(r["_b"] for r in first), strict=True) if n <= max_bytes), key=lambda r: (r["_o"], r["_id"]))
    places = [(r["_id"], r["_y"], r["_b"], k) for k, r in enumerate(chosen)]
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    wanted = docs.sparkSession.createDataFrame(places, f"_id {kinds['_id']}, _y int, _b long, _place int")
    rows = docs.select(F.col(doc_id).alias("_id"), size, *[F.col(c) for c in dict.fromkeys([text, *columns])]).join(F.broadcast(wanted), ["_id", "_b"])
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy(text))).where("_n = 1").drop("_n", "_b")


def sample(docs: DataFrame, labels: DataFrame, label: str, columns: list[str], max_docs: int, max_bytes: int, doc_id: str = "doc_id", text: str = "text", seed: int = 7) -> list:
    """The rows of ``sample_rows`` in their order, on the driver."""
    return sorted(sample_rows(docs, labels, label, columns, max_docs, max_bytes, doc_id, text, seed).collect(), key=lambda r: r["_place"])
