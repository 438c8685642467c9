"""Mixing, sharding, nearest neighbours, classifiers, and the pipeline."""

import itertools
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from helpers import docs, odd_texts, rng, sentence, words
from pyspark.sql import functions as F

from panelspark.llm import common, hilbert, mixing, multi_index, quality, toxicity
from panelspark.llm import text as text_module
from panelspark.llm.labelled import held_out, sample

SPACE_RE = r"[^\x20\x09-\x0D]+"


def water_level(totals, weights=(5, 2, 1), share=1.5, most=2.0):
    """source -> target, by raising the level source by source."""
    rows = sorted(totals, key=lambda r: (r[0] is None, r[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(rows)}
    cap, left = {s: most * n for s, n in rows}, share * sum(n for _, n in rows)
    out, free = {}, [s for s, _ in rows]
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > cap[s]]
        if not full:
            return out | {s: weight[s] * level for s in free}
        out |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        free = [s for s in free if s not in out]
    return out


@pytest.mark.parametrize("totals", [[("b", 100), (None, 1000), ("a", 10), ("c", 0)], [(f"s{k * 37 % 101}", k * k) for k in range(101)], [("a", 0)], []])
def test_targets(spark, totals):
    table = spark.createDataFrame([("~" if s is None else "=" + s, n) for s, n in totals], "key string, total long").repartition(3)
    got = {None if r.key == "~" else r.key[1:]: r.target for r in mixing.targets(table).collect()}
    want = water_level(totals)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)
    assert abs(sum(got.values()) - 1.5 * sum(n for _, n in totals)) < 1e-6 and all(got[s] <= 2 * n for s, n in totals)


def test_knapsack():
    r = rng(1)
    for _ in range(100):
        size = np.array(r.sample(range(1, 30), 4))
        n = np.array([r.randrange(4) for _ in size])
        budget = r.randrange(80)
        best = max(s for c in itertools.product(*(range(k + 1) for k in n)) if (s := int(np.dot(c, size))) <= budget)
        take = mixing.knapsack(size, n, budget)
        assert (take <= n).all() and int(take @ size) == best
        fit = mixing.fit_budget(size, n, min(budget, int(n @ size)))
        assert (fit <= n).all() and (fit >= 0).all() and int(fit @ size) == min(best, int(n @ size))


def test_budget_of_long_documents():
    assert int(mixing.fit_budget(np.array([40_000, 50_000, 70_000]), np.ones(3, np.int64), 90_000) @ [40_000, 50_000, 70_000]) == 90_000
    r = rng(12)
    for _ in range(25):
        size = np.array(sorted(r.sample(range(32_769, 400_000), 5)))
        n = np.array([r.randrange(1, 3) for _ in size])
        budget = r.randrange(40_000, int(n @ size))
        best = max(s for c in itertools.product(*(range(k + 1) for k in n)) if (s := int(np.dot(c, size))) <= budget)
        fit = mixing.fit_budget(size, n, budget)
        assert (fit <= n).all() and best - 1 <= int(fit @ size) <= budget
        coarse = mixing.fit_budget(size, n, budget, cells=20_000)  # in units of some words
        assert (coarse <= n).all() and int(coarse @ size) <= budget


def bitset_best(size, n, budget):
    sums = 1
    for a, k in zip(size.tolist(), n.tolist(), strict=True):
        for _ in range(k):
            sums |= sums << a
    return (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1


def test_budget_is_the_best_there_is():
    assert int(mixing.fit_budget(np.array([5000001, 4000003, 3000007]), np.ones(3, np.int64), 9000004) @ [5000001, 4000003, 3000007]) == 9000004
    r = rng(31)
    for low, high, kinds in ((1000, 90_000, 40), (1000, 90_000, 6), (4_000_000, 7_000_000, 5), (1, 300, 80)):
        for _ in range(12):
            size = np.array(sorted(r.sample(range(low, high), kinds)))
            n = np.array([r.randrange(1, 4) for _ in size])
            budget = r.randrange(low, min(int(n @ size), mixing.CELLS))
            fit = mixing.fit_budget(size, n, budget)
            assert (fit <= n).all() and (fit >= 0).all() and int(fit @ size) == bitset_best(size, n, budget)


def test_occurrences(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_A_RUN", 7)
    rows = [("hot", 1)] * 100 + [(None, 2)] * 30 + [(f"k{k}", k % 3) for k in range(40)] + [("hot", 2)] * 3
    df = spark.createDataFrame(rows, "a string, b long").withColumn("_salt", F.lit(1)).repartition(6)
    got = common.occurrences(df, "k", "a", "b").collect()
    assert sorted(((x.a, x.b), x.k) for x in got if x.a) + sorted(((x.a, x.b), x.k) for x in got if not x.a) == sorted((key, k) for key, c in Counter(x for x in rows if x[0]).items() for k in range(c)) + [((None, 2), k) for k in range(30)]
    spread = df.sparkSession.createDataFrame([(None,)] * 3000, "i long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = common.numbered(spread, "k", "i").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r_["count"] for r_ in counts) < 1500
    assert common.occurrences(df.limit(0), "k", "a").collect() == []


def test_mix(spark):
    r = rng(2)
    texts = [(t or "")[:400] for t in odd_texts()] + [None] + [sentence(r, r.randrange(1, 60)) for _ in range(300)]
    df = docs(spark, texts).withColumn("taken", F.lit(1)).withColumn("size", F.lit(1))
    got = mixing.mix(df).collect()
    assert len(got) == len(texts)
    by = {}
    for x in got:
        assert x["size"] == len(words(texts[x.doc_id], SPACE_RE)) and x.taken in (0, x["size"], 2 * x["size"])
        by.setdefault(x.source, []).append(x)
    goal = water_level([(s, sum(x["size"] for x in v)) for s, v in by.items()])
    for s, v in by.items():
        assert v[0].source_size == sum(x["size"] for x in v) and abs(v[0].target - goal[s]) < 1e-6
        assert abs(sum(x.taken for x in v) - goal[s]) <= 1
    again = {x.doc_id: x.taken for x in mixing.mix(df.repartition(5)).collect()}
    assert again == {x.doc_id: x.taken for x in got}
    assert mixing.mix(df.limit(0)).count() == 0
    df = df.withColumn("_times", F.lit(3)).withColumn("row", F.lit(4)).withColumn("copy", F.lit(5)).withColumn("n", F.lit(5)).withColumn("text_hash", F.lit("x"))
    copies = mixing.apply_mix(df)
    assert copies.columns == df.columns
    times = {r_.doc_id: r_["count"] for r_ in copies.groupBy("doc_id").count().collect()}
    assert all(times.get(x.doc_id, 0) == (x.taken // x["size"] if x["size"] else 1) for x in got)


def test_mix_of_repeated_rows(spark):
    df = docs(spark, ["a b", "a b", "a b", "c d e", None, "f"] * 4, [1, 1, 1, 1, 2, None] * 4, ["s"] * 24)
    got = mixing.mix(df).collect()
    copies = mixing.apply_mix(df).collect()
    want = sum(x.taken // x["size"] for x in got if x.doc_id == 1)
    assert sum(x.doc_id == 1 for x in copies) == want and sum(x.doc_id != 1 for x in copies) == 8
    assert mixing.apply_mix(df.limit(0)).count() == 0


def test_mix_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 7)
    r = rng(3)
    df = docs(spark, ["same number of words"] * 100 + [sentence(r, 9) for _ in range(20)], sources=["hot"] * 100 + ["b"] * 20)
    got = mixing.mix(df).collect()
    for s in ("hot", "b"):
        v = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in v) - v[0].target) <= 9


def test_curve():
    for bits, d in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        at = hilbert.curve_index(grid, bits)
        assert sorted(at) == list(range(len(grid)))
        assert set(np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(1)) == {1}


@pytest.mark.parametrize("run", [50_000, 9])
def test_shards(spark, monkeypatch, run):
    monkeypatch.setattr(common, "ROWS_A_RUN", run)
    r = rng(4)
    texts = odd_texts() + [sentence(r, r.randrange(1, 80)) for _ in range(90)] + ["copy"] * 40
    ids = [*range(len(texts) - 2), None, 3]
    df = docs(spark, texts, ids).withColumn("shard", F.lit(1)).withColumn("cell", F.lit(1))
    got = hilbert.shard(df, 24).collect()
    count = {k: [x.slot for x in got if x.shard == k] for k in range(24)}
    assert len(got) == len(texts) and max(map(len, count.values())) - min(map(len, count.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in count.values())
    crc = sorted((str(i), zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in zip(ids, texts, strict=True))
    assert sorted((str(x.doc_id), x.text_crc32, x["size"]) for x in got) == crc
    assert hilbert.shard(df.limit(0)).count() == 0
    assert sorted(x.shard for x in hilbert.shard(df.limit(3), 24).collect()) == [0, 8, 16]


@pytest.mark.parametrize("n", [0, 1, 3, 40, 1500])
def test_shard_ranks(spark, n):
    names = sorted([f"https://www.site{k * 7919 % 100003}.org/é" for k in range(n)], key=str.encode)
    df = spark.createDataFrame([(v,) for v in [*names, *names[:50], None]], "source string").repartition(3)
    got = {(r.source, r.cell) for r in df.select("source", hilbert.ranks(df, "source", 4).alias("cell")).collect()}
    assert got == {(v, k * 16 // (n + 1)) for k, v in enumerate(names)} | {(None, 15)}


def test_shard_files(spark, tmp_path):
    r = rng(5)
    texts = [sentence(r, 5) for _ in range(50)] + ["twice", "twice", None, None]
    df = docs(spark, texts, [*range(48), None, None, 7, 7, 8, None]).withColumn("shard", F.lit("own")).withColumn("slot", F.lit(1)).withColumn("row", F.lit(2))
    placed = hilbert.shard(df, 4)
    bounds = hilbert.shard_bounds(df, placed).collect()
    assert sum(x["rows"] for x in bounds) == 54 and sum(x.doc_id_nulls for x in bounds) == 3 and sum(x.source_nulls for x in bounds) == 8
    name = hilbert.write_shards(df, placed, str(tmp_path / "s"))
    out = spark.read.parquet(str(tmp_path / "s"))
    assert name == "shard_" and out.columns == [*df.columns, name]
    key = lambda x: (str(x.doc_id), str(x.text), str(x.source), x.shard)
    assert sorted(map(key, out.collect())) == sorted(map(key, df.collect()))
    assert {x[name]: x["count"] for x in out.groupBy(name).count().collect()} == {x.shard: x["rows"] for x in bounds}
    hilbert.write_shards(df.limit(0), hilbert.shard(df.limit(0)), str(tmp_path / "none"))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, cell int")


def brute_nearest(rows, k):
    """[(query id, its neighbours)] for each query row."""
    ok = [(i, v) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ids = np.array([i for i, _ in ok])
    x = np.array([v for _, v in ok], np.float32).astype(float)
    out = []
    for at, (i, q) in enumerate(zip(ids, x, strict=True)):
        if i % 20 == 0:
            s = np.zeros(len(ids))
            for d in range(x.shape[1]):
                s += q[d] * x[:, d]
            o = [j for j in np.lexsort((ids, -s)) if j != at][:k]
            out.append((int(i), [(int(ids[j]), s[j]) for j in o]))
    return out


def found_nearest(df):
    got = {}
    for x in df.orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    return got


def test_nearest_ties_and_bad_vectors(spark):
    r = np.random.Generator(np.random.PCG64(3))
    rows = [(k, [float(x) for x in r.normal(size=6).astype(np.float32)], 0.0, 1) for k in range(150)]
    rows += [(200 + k, rows[7][1], 0.0, 1) for k in range(60)]
    rows += [(401, None, 0.0, 1), (421, [0.0] * 6, 0.0, 1), (441, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0.0, 1), (460, [float("nan")] * 6, 0.0, 1), (480, [], 0.0, 1), (None, rows[0][1], 0.0, 1), (21, rows[21][1], 0.0, 1), (21, rows[20][1], 0.0, 1)]
    got = found_nearest(multi_index.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20, recall=1.0))
    want = dict(brute_nearest(rows, 20))
    assert set(got) == set(want)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len({v for v, _ in want[q]}) for q in want]) > 0.95
    for q, v in got.items():
        assert v == sorted(v, key=lambda t: (-t[1], t[0])) and len(v) == 20 and q not in {i for i, _ in v}
    tied = [v for v, s in got[0] if s == dict(want[0]).get(7, None)]
    assert tied == sorted(tied)


def test_nearest_with_repeated_query_ids(spark):
    rows = [(20, [1.0, 0.0], 0.0, 1), (20, [0.0, 1.0], 0.0, 1), (1, [1.0, 1.0], 0.0, 1)]
    got = multi_index.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == sorted((q, k + 1, *v) for q, near in brute_nearest(rows, 20) for k, v in enumerate(near))


def test_nearest_over_blocks_at_the_default_recall(spark):
    """Several blocks, several Arrow batches of queries, the default recall."""
    r = np.random.Generator(np.random.PCG64(6))
    x = r.normal(size=(4000, 16)) + 2 * r.normal(size=(40, 16))[r.integers(40, size=4000)]
    rows = [(k, [float(c) for c in v], 0.0, 1) for k, v in enumerate(x.astype(np.float32))]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = found_nearest(multi_index.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 20 == 0, block_rows=300))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = dict(brute_nearest(rows, 20))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_nearest_few(spark):
    rows = [(k, [1.0, float(k)], 0.0, 1) for k in range(4)]
    got = multi_index.nearest_neighbours(vectors(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [x.vec_id for x in got] == [1, 2, 3] and [x.rank for x in got] == [1, 2, 3]
    assert multi_index.nearest_neighbours(vectors(spark, rows).limit(0), F.col("vec_id") == 0).count() == 0


def test_recall():
    r = np.random.Generator(np.random.PCG64(5))
    x = r.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = multi_index.train(x, len(x))
    count = np.bincount(index.cells(x), minlength=len(index.left) * len(index.right))
    cell, found = index.cells(x), []
    for q in x[:40]:
        seen = np.isin(cell, index.traverse(q, count, int(index.share * len(x))))
        top = np.argsort(-(x @ q))[1:21]
        found.append(seen[top].mean())
    assert np.mean(found) > 0.9


def labelled(spark, n=500):
    r = rng(9)
    texts = [sentence(r, 30) + (" vilewordx " + sentence(r, 10) if k % 5 == 0 else "") for k in range(n)]
    return docs(spark, texts), spark.createDataFrame([(k, int(k % 5 == 0), int(k % 5 != 0)) for k in range(n)], "doc_id long, toxic int, quality int")


def test_toxicity(spark):
    df, labels = labelled(spark)
    net = toxicity.toxicity_model(df, labels)
    out = df.withColumn("threshold", F.lit(1)).select("doc_id", toxicity.toxicity(spark, F.col("text"), F.col("lang"), net).alias("r")).collect()
    assert np.mean([(x.r.score >= 0.5) == (x.doc_id % 5 == 0) for x in out]) > 0.97
    odd = docs(spark, odd_texts())
    s = [x[0] for x in odd.select(toxicity.toxicity(spark, odd["text"], odd["lang"], net)["score"]).collect()]
    assert all(0 <= x <= 1 for x in s)
    none = toxicity.toxicity_model(df, labels.limit(0))
    assert {x[0] for x in odd.select(toxicity.toxicity(spark, odd["text"], odd["lang"], none)["score"]).collect()} == {0.0}
    assert toxicity.drop_toxic(odd, labels.limit(0)).count() == odd.count()


def test_long_texts_keep_no_other_out(spark):
    df, labels = labelled(spark, 300)
    order = [r.id for r in spark.range(300).where(~held_out("id")).orderBy(F.xxhash64("id", F.lit(7))).collect()]
    long = F.when(F.col("doc_id") == order[0], F.repeat(F.lit("a "), 100_000)).when(F.col("doc_id") == order[1], F.repeat(F.lit("b "), 20_000))
    df = df.withColumn("text", F.coalesce(long, "text"))
    known = labels.unionByName(labels.select((F.col("doc_id") + 1000).alias("doc_id"), "toxic", "quality"))
    pick = lambda docs, n, size: [r["_id"] for r in sample(docs, known, "toxic", ["lang"], n, size)]
    assert pick(df, 1000, 150_000) == order[1:]
    assert pick(df, 1000, 60_000) == order[2:]
    assert pick(df, 100, 150_000) == order[2:102]
    assert pick(df.union(df), 1000, 1_000_000) == order
    assert pick(df.where(F.col("doc_id").isin(order[:2])), 1000, 50_000) == order[1:2]
    assert toxicity.toxicity_model(df, labels, max_bytes=150_000).constant is None
    assert quality.quality_model(df, labels, max_bytes=150_000).join is not None


def test_threshold():
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1.0, 1, 0, 0])) == 0.5
    assert toxicity.best_threshold(np.array([0.5, 0.5]), np.array([0.0, 0])) == 0.5


def test_quality(spark):
    r = rng(11)
    texts = [sentence(r, 30) if k % 4 else " ".join("SPAM!!" for _ in range(r.randrange(5, 40))) for k in range(400)]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(300)], "doc_id long, quality int")
    model = quality.quality_model(df, labels)
    out = df.select("doc_id", quality.quality(df, model).alias("s")).collect()
    assert np.mean([(x.s >= 0.5) == (x.doc_id % 4 != 0) for x in out]) > 0.97
    odd = docs(spark, odd_texts())
    assert all(0 <= x[0] <= 1 for x in odd.select(quality.quality(odd, model)).collect())
    assert {x[0] for x in odd.select(quality.quality(odd, quality.quality_model(odd, labels.limit(0)))).collect()} == {0.5}
    assert odd.limit(0).select(quality.quality(odd.limit(0), model)).count() == 0


SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    given = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, str(SF)).collect()
    assert {x.doc_id for x in out} <= {r.doc_id for r in given.select("doc_id").collect()}
    per = [sum(x.shard == k for x in out) for k in range(24)]
    assert max(per) - min(per) <= 1 and len(out) > 100
    for (name, stage), columns in zip(corpus_pipeline.STAGES[:-1], [given.columns] * 4, strict=True):
        assert stage(spark, given, str(SF)).columns == columns, name


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names


def naive_score(net, ids):
    """The network word by word."""
    pooled = np.full(len(net.bias), -np.inf)
    at = 0
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            for i in range(len(ids)):
                total = sum(float(net.filters[:, at + j * toxicity.FILTERS + f] @ sum(net.table[x] for x in ids[i + j])) for j in range(width) if i + j < len(ids))
                pooled[k * toxicity.FILTERS + f] = max(pooled[k * toxicity.FILTERS + f], total)
        at += width * toxicity.FILTERS
    pooled = pooled if len(ids) else np.zeros(len(net.bias))
    z = float(np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias)
    return 1 / (1 + np.exp(-(net.scale * z + net.offset)))


def test_convolution_by_a_naive_one(monkeypatch):
    monkeypatch.setattr(toxicity, "STEP", 7)  # texts go through in many steps
    r = rng(13)
    texts = ["", "one", sentence(r, 2), sentence(r, 40), "", sentence(r, 7), sentence(r, 8)]
    net = toxicity.Net.new(np.random.Generator(np.random.PCG64(4)))
    net.scale, net.offset = 1.5, -0.25
    ((_, w),) = toxicity.words(toxicity.pa.array(texts), toxicity.ALNUM)
    ids = toxicity.word_ids(w)
    got = net.scores(ids, w.first)
    want = [naive_score(net, ids[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert np.allclose(got, want, atol=1e-5)


def test_held_out_labels_change_no_score(spark):
    df, labels = labelled(spark, 200)
    other = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda given: [x[0] for x in df.select("doc_id", toxicity.toxicity(spark, df["text"], df["lang"], toxicity.toxicity_model(df, given))["score"].alias("s")).orderBy("doc_id").select("s").collect()]
    assert score(labels) == score(other)
    assert toxicity.drop_toxic(df.limit(0), labels).count() == 0


def test_co_training_exchanges_and_gains():
    """Few labels and two views that each know the class only in part: rounds hand labels over, and beat the first round."""
    r = np.random.Generator(np.random.PCG64(2))
    y = (r.random(3000) < 0.5).astype(int)
    view = lambda: (np.where(r.random((3000, 30)) < 0.3, y[:, None], r.integers(0, 2, (3000, 30)))).astype(np.float32)
    a, b = view(), view()
    known, pool, new = slice(0, 60), slice(60, 1500), slice(1500, 3000)
    right = {}
    for rounds in (0, 4):
        model = quality.co_train((a[known], b[known]), y[known], (a[pool], b[pool]), rounds=rounds)
        right[rounds] = np.mean((model.score(a[new], b[new]) >= 0.5) == y[new])
        assert (min(model.exchanged) > 100) == (rounds > 0)
    assert right[4] > right[0]


def naive_content(text):
    """The measures of view one word by word, and its hashed shapes."""
    raw = (text or "").encode()
    found = [m.group() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    out = np.zeros(quality.MEASURES + 2 * quality.BUCKETS)
    if not found:
        return out
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in found]
    upper = [sum(65 <= c <= 90 for c in x) for x in found]
    lower = [sum(97 <= c <= 122 for c in x) for x in found]
    marks = [sum(32 < c < 128 and not chr(c).isalnum() for c in x) for x in found]
    size, mean = [len(x) for x in found], lambda v: sum(v) / len(found)
    short = mean([min(n, 40) for n in size]) / 10
    out[:11] = [
        mean([k > 0 and low[k] == low[k - 1] for k in range(len(low))]), len(set(low)) / len(low), mean([u > 1 and n == 0 for u, n in zip(upper, lower, strict=True)]), mean([min(m, 4) for m in marks]), mean([m > 1 for m in marks]),
        mean([m == n for m, n in zip(marks, size, strict=True)]), short, max(0, mean([min(n, 40) ** 2 for n in size]) / 100 - short**2) ** 0.5, mean([x[-1:] in (b".", b"!", b"?") for x in found]), mean([65 <= x[0] <= 90 for x in found]), mean([x[-1] >= 128 for x in found]),
    ]
    for x, y in zip(found, low, strict=True):
        for k, code in enumerate((y[-1] * 256 + (y[-2] if len(y) > 1 else y[-1]), x[0] * 64 + min(len(x), 63))):
            bucket = int(text_module.mix(np.array([code + (k << 32)], np.uint64))[0]) >> 55
            out[quality.MEASURES + k * quality.BUCKETS + bucket] += 1 / len(found)
    out[quality.MEASURES :] **= 0.5
    return out


def naive_page(text, lang, source):
    t, out = text or "", np.zeros(18 + 2 * quality.META_BUCKETS)
    lines = t.split("\n")
    chars, longest = len(t), max(map(len, lines))
    out[:6] = [np.log1p(chars) / 10, len(t.encode()) / max(chars, 1) - 1, np.log1p(len(lines)) / 5, np.log1p(chars / len(lines)) / 5, np.log1p(longest) / 5, longest / max(chars, 1)]
    out[6 + min(int(np.log2(1 + chars / len(lines))), 11)] = 1
    for k, v in enumerate((lang, source)):
        out[18 + k * quality.META_BUCKETS + zlib.crc32(f"{k}{'' if v is None else '=' + v}".encode()) % quality.META_BUCKETS] = 1
    return out


def test_quality_features_by_plain_loops(spark):
    r = rng(17)
    texts = [*odd_texts(), "Word word WORD. x! ?? é1 Été's", "a\nbb\n\nccc d", *[" ".join(r.choice(["Ab", "ab", "AB", "c-d", "!?", "é", "e.", "12", "x" * 50]) for _ in range(r.randrange(1, 60))) for _ in range(40)]]
    got = quality._content(texts)
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, naive_content(text), atol=2e-5), text
    df = docs(spark, texts)
    rows = df.select("lang", "source", *quality.layout(F.col("text")), "text").collect()
    page = quality.page_features([x.lang for x in rows], [x.source for x in rows], np.array([[x.chars, x["size"], x.lines, x.longest] for x in rows]))
    for row, x in zip(page, rows, strict=True):
        assert np.allclose(row, naive_page(x.text, x.lang, x.source), atol=1e-5), x.text


def test_logistic_by_gradient_descent():
    """The fit against many plain steps down the same loss."""
    g = np.random.Generator(np.random.PCG64(3))
    x = g.normal(size=(300, 3))
    y = (x @ [1.5, -1.0, 0.0] + g.normal(size=300) > 0.3).astype(float)
    w = np.where(np.arange(300) % 3 == 0, 0.5, 1.0)
    line = quality.logistic(x, y, w, rounds=2000)
    z = (x - x.mean(0)) / (x.std(0) + 1e-2)
    weight, bias = np.zeros(3), 0.0
    for _ in range(20_000):
        e = (1 / (1 + np.exp(-(z @ weight + bias))) - y) * w / w.sum()
        weight, bias = weight - 0.5 * (e @ z + 2e-4 * weight), bias - 0.5 * e.sum()
    assert np.allclose(line.weight, weight, atol=0.02) and abs(line.bias - bias) < 0.02


def test_held_out_quality_labels_change_no_score(spark):
    r = rng(23)
    df = docs(spark, [sentence(r, 30) if k % 4 else "BUY !!! " * 10 for k in range(300)])
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(200)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.quality_model(df, labels), quality.quality_model(df, turned)
    score = lambda m: {x.doc_id: x.s for x in df.select("doc_id", quality.quality(df, m).alias("s")).collect()}
    assert score(one) == score(two) and one.join is not None


def edge_tables(spark, where, docs_rows, labels, benchmark):
    for name, df in (("documents", docs_rows), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{where}/{name}.parquet")
    return str(where)


def test_pipeline_edge_cases(spark, tmp_path):
    """All five stages over null, empty, repeated and very long rows and clashing extra columns; with empty tables; and what each stage decides."""
    import corpus_pipeline

    r = rng(29)
    plain = [sentence(r, 40, 4000) for _ in range(40)]
    item = sentence(r, 30, 9000)
    texts = [None, "", " \n", *plain, plain[0], plain[1] + " once more", f"{plain[2]} {item}", f"{item}", "long " * 60_000, plain[3], plain[3]]
    ids = [*range(len(texts) - 4), None, None, 7, 7]
    df = docs(spark, texts, ids)
    for name in ("taken", "size", "kept", "n_shingles", "shard", "slot", "row", "hash", "rank", "bucket", "copy", "_i", "found", "text_hash"):
        df = df.withColumn(name, F.lit("own"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([("b1", item), ("b2", None), (None, "x"), ("b3", "")], "item_id string, text string")
    sf = edge_tables(spark, tmp_path / "some", df, labels, benchmark)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf)
        assert after.columns == df.columns, name
        after.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now.select("doc_id", "text", "copy").collect()
        assert all(x["copy"] == "own" for x in seen[name])
    texts_of = lambda name: Counter(x.text for x in seen[name])
    assert texts_of("toxicity") == Counter(texts)  # no labels, nothing is toxic
    kept = texts_of("near_dedup")
    assert kept[plain[0]] == 1 and plain[1] + " once more" not in kept and kept["long " * 60_000] == 1 and kept[None] == kept[""] == 1
    clean = texts_of("decontamination")
    assert item not in clean and f"{plain[2]} {item}" not in clean and clean[plain[2]] == 1 and sum(clean.values()) == sum(kept.values()) - 2
    assert set(texts_of("mixing")) <= set(clean) and texts_of("mixing")[None] == 1
    placed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    per = Counter(x.shard for x in placed)
    assert len(placed) == len(seen["mixing"]) and max(per.values()) - min(per.get(k, 0) for k in range(24)) <= 1
    assert corpus_pipeline.run(spark, sf).count() == len(placed)

    none = edge_tables(spark, tmp_path / "none", df.limit(0), labels, benchmark.limit(0))
    assert corpus_pipeline.run(spark, none).count() == 0
    bare = edge_tables(spark, tmp_path / "bare", df, labels, benchmark.limit(0))
    assert corpus_pipeline.run(spark, bare).count() >= len(placed)
