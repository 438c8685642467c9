"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code point order (null last) weigh WEIGHTS over and over. Together they are
to give SHARE of all words; a source gives at most twice its own, and what that cuts
off is shared again by weight among the others until none is above.

A source's target is met from below:

1. whole repeats: as often as the source fits into its target, every document is taken;
2. the rest is a subset sum over lengths. Documents are counted by exact length. Each
   length first gives its proportional share, then, from long to short, what still
   fits. Then documents are put back, the shortest first, until at least ``SWAPS`` are
   and there is room for ``CAPACITY`` words and for twice the longest document, and
   bounded-knapsack dynamic programming over the counts left fills that room: sums that
   can be reached are the bits of a number, and halving the counts leads back from the
   best one. Where that leaves a gap and the rest is at most ``CELLS`` words, dynamic
   programming runs over the whole rest, so the result is the best there is. Beyond, the
   gap is what no choice among the documents put back fills. Only where the room itself is
   over ``CELLS`` words, that is for a document of over 33 million words, it is counted in
   units of several words, lengths rounded up: never over, and under by less than a unit
   for each document that fills the room;
3. of each length, the documents with the smallest seeded hashes are taken.

Rows (ids, sizes and hashes, no texts) are ranked by source, length and hash, in ranges; runs
of ranks are the buckets by which a source, a length or repeated rows of any number are
counted and joined with their quotas, so none of them meets in one task. Sources are ranked and their targets found
in a table, so their number has no bound; a task plans one source from its distinct
lengths.

Edge cases: a null or empty text has size 0 and is taken at no cost; a source of no
words has target 0; repeated rows are documents of their own; no rows, no result.
Reruns agree, as all order comes from doc_id and text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import cut, numbered, occurrences, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
CAPACITY = 1 << 15
CELLS = 1 << 26
SWAPS = 16
ROWS_A_BUCKET = 50_000
SPACES = r"[^\x20\x09-\x0D]+"


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """totals (key, total), null sources last by key -> (key, target).

    The water level is raised until no further source is full; a round is one aggregate over the sources.
    """
    ranked = numbered(totals, "rank", "key")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("total"))
    ranked = cut(ranked)
    top = ranked.agg((share * F.sum("total")).alias("words"), F.sum("weight").alias("weight")).head()
    level, before = (top.words / top.weight if top.weight else 0.0), 0
    while True:
        full = F.col("weight") * level > F.col("cap")
        r = ranked.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("open")).head()
        if r.n == before or not r.open:
            break
        before, level = r.n, (top.words - r.cap) / r.open
    share_of = F.col("weight") * level
    return ranked.select("key", F.when(share_of > F.col("cap"), F.col("cap")).otherwise(share_of).alias("target"))


def _reach(adds: list[int], limit: int) -> tuple[int, int]:
    """The sums up to limit that some of adds give, as the bits of a number, and how many of adds were looked at until limit was among them."""
    mask, sums, used = (1 << (limit + 1)) - 1, 1, 0
    for a in adds:
        sums |= (sums << a) & mask
        used += 1
        if sums >> limit:
            break
    return sums, used


def _bits(x: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take for the largest sum up to budget: dynamic programming over sums, counts split in powers of two.

    The way back from the best sum halves the parts: of both halves' sums one pair adds up to it, and each half goes on with its own.
    """
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return take
    parts: list[tuple[int, int, int]] = []
    for k, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        left, part = min(count, budget // length) if length > 0 else 0, 1
        while left > 0:
            part = min(part, left)
            parts.append((part * length, k, part))
            left, part = left - part, part * 2
    sums, used = _reach([a for a, _, _ in parts], budget)
    todo = [(parts[:used], sums.bit_length() - 1)]
    while todo:
        some, goal = todo.pop()
        if not goal:
            continue
        if len(some) == 1:
            take[some[0][1]] += some[0][2]
            continue
        one, two = some[: len(some) // 2], some[len(some) // 2 :]
        a, b = (_bits(_reach([x for x, _, _ in half], goal)[0], goal + 1) for half in (one, two))
        first = int(np.argmax(a & b[::-1]))
        todo += [(one, first), (two, goal - first)]
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, capacity: int = CAPACITY, cells: int = CELLS) -> np.ndarray:
    """How many documents of each length to take, so that their words come nearest to budget from below; the best there is if budget is at most ``cells``."""
    order = np.argsort(-lengths, kind="stable")
    size, n = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((size * n).sum())
    take = n * budget // total if total else n.copy()
    take[size == 0] = n[size == 0]
    left = budget - int((size * take).sum())
    for k in range(len(size)):
        if size[k] and left >= size[k]:
            more = min(int(n[k] - take[k]), left // int(size[k]))
            take[k] += more
            left -= more * int(size[k])
    room, put = max(capacity, 2 * int(size.max(initial=0))), 0
    for k in range(len(size) - 1, -1, -1):
        if size[k] and (left < room or put < SWAPS):
            back = min(int(take[k]), max(SWAPS - put, -(-(room - left) // int(size[k]))))
            take[k] -= back
            left, put = left + back * int(size[k]), put + back
    unit = max(1, -(-left // cells))
    take += knapsack(-(-size[::-1] // unit), (n - take)[::-1], left // unit)[::-1]
    if int((size * take).sum()) < min(budget, total) and budget <= cells:
        take = knapsack(size[::-1], n[::-1], budget)[::-1]
        take[size == 0] = n[size == 0]
    out = np.empty_like(take)
    out[order] = take
    return out


def _plan(capacity: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        """The counts of one source by length -> rounds (whole repeats) and chosen (documents of each length taken once more)."""
        size, n = pdf["size"].to_numpy(), pdf["n"].to_numpy()
        total, target = int((size * n).sum()), float(pdf["target"].iloc[0])
        rounds = int(target // total) if total else 0
        rest = round(target - rounds * total)
        chosen = fit_budget(size, n, rest, capacity) if rest > 0 else np.zeros(len(n), np.int64)
        return pd.DataFrame({"key": pdf["key"], "size": size, "rounds": rounds, "chosen": chosen, "target": target, "source_size": total})

    return plan


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, capacity: int = CAPACITY) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, source, text_hash."""
    key = F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), "source"))  # null last
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    rows = cut(rows)  # texts are read once, not again for the borders of the ranges
    rows = rows.withColumn("key", key).withColumn("hash", F.xxhash64("doc_id", "text_hash", F.lit(seed)))
    ranked = numbered(rows, "rank", "key", "size", "hash", "doc_id", "text_hash").withColumn("bucket", F.expr(f"rank div {ROWS_A_BUCKET}"))
    counts = cut(ranked.groupBy("key", "size", "bucket").agg(F.count("*").alias("k"), F.min("rank").alias("low")))
    totals = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("k")).alias("total"))
    goals = targets(totals, weights, share)

    by_size = counts.groupBy("key", "size").agg(F.sum("k").alias("n"), F.min("low").alias("first"))
    plan = by_size.join(goals, "key").groupBy("key").applyInPandas(_plan(capacity), "key string, size long, rounds long, chosen long, target double, source_size long")
    quotas = counts.select("key", "size", "bucket").join(plan.join(by_size.select("key", "size", "first"), ["key", "size"]), ["key", "size"])
    taken = F.col("size") * (F.col("rounds") + (F.col("rank") - F.col("first") < F.col("chosen")).cast("long"))
    return ranked.join(quotas, ["key", "size", "bucket"]).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "text_hash")


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with each document as often as the mix takes it; all columns stay, whatever their names.

    Rows without doc_id, and documents of no words, stay once. Rows that share doc_id and text are told apart by their
    number only: together they come as often as the mix takes them together.
    """
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(1)
    chosen = mix(docs, doc_id=doc_id, text=text, **how).where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.sum(times).alias("times"), F.count("*").alias("n"))
    chosen = cut(chosen)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.struct("*").alias("row"))
    one = rows.join(chosen.where("n = 1"), ["doc_id", "text_hash"], "left")
    again = chosen.where("n > 1")
    if not again.isEmpty():
        one = one.join(again.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti")
        several = occurrences(rows.join(again, ["doc_id", "text_hash"]), "own", "doc_id", "text_hash")
        times = F.expr("times div n") + (F.col("own") < F.expr("times % n")).cast("long")
        one = one.unionByName(several.withColumn("times", times).drop("own"))
    all_ = one.withColumn("times", F.coalesce("times", F.lit(1)))
    return all_.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
