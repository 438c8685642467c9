"""Decontamination, near-duplicates, line dedup: against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, odd_texts, rng, sentence, words
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, line_dedup, near_dups
from panelspark.llm.common import heaviest, looked_up
from panelspark.llm.components import connected
from panelspark.llm.text import ALNUM, NOT_SPACE, Words, pieces
from panelspark.llm.text import words as split_words

ALNUM_RE, SPACE_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize(("kind", "pattern"), [(ALNUM, ALNUM_RE), (NOT_SPACE, SPACE_RE)])
def test_words(kind, pattern):
    texts = [t or "" for t in odd_texts()] + ["Ab-c\x00d_e ÉÀ", "trailing "]
    values = {}
    for _, w in split_words(pa.array(texts), kind):
        for k in range(len(w.first) - 1):
            i, j = w.first[k], w.first[k + 1]
            got = [w.text(x, x + 1).decode() for x in range(i, j)]
            assert got == words(texts[k], pattern)
            for text, v in zip(got, w.value[i:j].tolist(), strict=True):
                assert values.setdefault(text, v) == v
    assert len(set(values.values())) == len(values)


def test_pieces_cover_all_rows():
    col = pa.array(["ab", None, "", "c" * 50, "d"]).slice(1)
    assert [(r, raw.tobytes(), b.tolist()) for r, raw, b in pieces(col, 3)] == [(0, b"", [0, 0, 0]), (2, b"c" * 50, [0, 50]), (3, b"d", [0, 1])]


def test_word_prefix():
    raw = np.frombuffer(b"lowest lower low", np.uint8)
    w = Words(raw, np.array([0, len(raw)]), NOT_SPACE)
    a, b, c = w.prefix(4)
    assert a == b != c and c == w.value[2]


def brute_contamination(text, items, width=13):
    w = words(text, ALNUM_RE)
    hit, found = set(), set()
    for item, t in items:
        p = words(t, ALNUM_RE)
        m = min(width, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(item)
    ids = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize(("block_windows", "group_bytes"), [(250_000, 1), (8, 64 << 20), (8, 1)])
def test_contamination(spark, block_windows, group_bytes):
    r = rng(2)
    items = [(10, sentence(r, 20, 5)), (9, sentence(r, 15, 5)), (2, "w1 w2"), (3, ""), (4, None), (5, sentence(r, 14)), (11, sentence(r, 13, 3))]
    texts = [sentence(r, 120, 5) for _ in range(15)] + [sentence(r, 30) + " " + items[5][1].upper() + ", tail", sentence(r, 3000, 4), *odd_texts()]
    df = docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    c = decontaminate.contamination(spark, df["text"], bench, block_windows=block_windows, group_bytes=group_bytes)
    got = {x.doc_id: tuple(x.r[k] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for x in df.select("doc_id", c.alias("r")).collect()}
    assert got == {k: brute_contamination(t, items) for k, t in enumerate(texts)}
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not v[4] for v in got.values())


def test_contamination_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    df = docs(spark, ["a b", None])
    assert [x.r.n_hit for x in df.select(decontaminate.contamination(spark, df["text"], bench).alias("r")).collect()] == [0, 0]
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0


def test_blocks_outside_batches_inside(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"a{k} b{k} c{k}") for k in range(6)], "item_id long, text string")
    folder, names = decontaminate.write_blocks(items, "item_id", "text", 13, 2)
    assert len(names) > 2
    texts = [pa.array([f"x a{k} b{k} c{k}", None]) for k in range(6)]
    opened = []

    def block(where, name):
        opened.append(name)
        return real(where, name)

    real = decontaminate._block
    monkeypatch.setattr(decontaminate, "_block", block)
    for group_bytes, opens in ((1 << 20, 1), (1, len(texts))):
        opened.clear()
        got = [x for part in decontaminate._search(folder, names, group_bytes).func(iter(texts)) for x in part.to_pylist()]
        assert [x["item_ids"] for x in got] == [y for k in range(6) for y in ([str(k)], [])]
        assert sum(a != b for a, b in zip(opened, [None, *opened])) == opens * len(names)


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = words(t, SPACE_RE)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                up[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(s), str(None if i is None else least[find(k)]), i is None or i == least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(r, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("how", [{}, {"node_rows": 8, "block_rows": 10}, {"block_shingles": 400}, {"block_rows": 3}, {"block_rows": 3, "hot_rows": 4}, {"hot_rows": 0}])
def test_near_duplicates(spark, how):
    r = rng(4)
    texts = [*odd_texts(), "a b c d e f g h", "A  b c\nd e f g H"]
    for n in (6, 40, 250):
        base = sentence(r, n)
        texts += near_copies(r, base, 40, max(2, n // 18)) + [base] * 5
    texts += [sentence(r, 60) for _ in range(60)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    ids[5] = None
    ids[-1], texts[-1] = ids[-2], texts[-2]
    got = near_dups.near_duplicates(docs(spark, texts, ids), **how).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in got) == brute_components(list(zip(ids, texts, strict=True)), 4, 80)


def test_drop_near_duplicates(spark):
    df = docs(spark, ["a b c d e", "a b c d e", "other words stand here now", None, "", "a b c d e"], [1, 1, 3, 4, None, 0])
    kept = near_dups.drop_near_duplicates(df)
    assert sorted(kept.select("doc_id").collect(), key=str) == [(0,), (3,), (4,), (None,)] and kept.columns == df.columns
    assert near_dups.near_duplicates(df.limit(0)).count() == 0


def test_other_text_under_a_dropped_id(spark):
    df = docs(spark, ["a b c d e", "a b c d e", "none of these words is in another text"], [1, 2, 2]).withColumn("row", F.lit(1))
    assert sorted((x.doc_id, x.text) for x in near_dups.drop_near_duplicates(df).collect()) == [(1, "a b c d e"), (2, "none of these words is in another text")]


def test_likely_links_of_a_large_node():
    """Pairs at exactly 80 %: what one visit to a node of thousands of unlike sets finds, and what the sketches let pass."""
    r = np.random.Generator(np.random.PCG64(8))
    sets = []
    for _ in range(1500):
        both = r.integers(1, 2**64, 440, dtype=np.uint64)
        sets += [np.sort(both[:400]), np.sort(np.concatenate((both[:360], both[400:])))]  # 360 of 440 values shared
    sk = near_dups.sketch(sets)
    least = 0.8 - near_dups.SLACK
    assert (near_dups.likeness(sk[::2], sk[1::2]) >= least).all()
    forest = near_dups.Forest()
    near_dups.search_node(np.arange(len(sets)), sk, least, forest, 5)
    assert np.mean([forest.find(k) == forest.find(k + 1) for k in range(0, len(sets), 2)]) > 0.75


def test_likely_links_beside_a_large_node(spark):
    """Where a node is too large, the members of all other ones still meet, whatever joins Spark picks while it runs: each pair here has a node of its own."""
    r = np.random.Generator(np.random.PCG64(9))
    n = 400
    sketches = r.integers(1, 256, (n, near_dups.BINS), dtype=np.uint8)
    rows = [(k + n * half, sketches[k].tobytes(), [10 * k + 1, *([5] if k < 100 else [])]) for half in (0, 1) for k in range(n)]
    vertices = spark.createDataFrame(rows, "id long, sketch binary, nodes array<long>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = dict(connected(near_dups.likely_links(vertices, node_rows=150)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {k + n * half: k for half in (0, 1) for k in range(n)}


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(0, 60) if k % 10] + [(100, 3), (3, 3), (None, 4)], "a long, b long")
    got = dict(connected(e).collect())
    assert got == {k: k - k % 10 + (1 if k % 10 else -9) for k in range(1, 61)} | {100: 1}
    assert connected(e.limit(0)).count() == 0
    assert dict(connected(e, hot_rows=1).collect()) == got


def test_hubs(spark):
    e = spark.range(1, 300).select((F.col("id") % 3).alias("a"), (F.col("id") + 10).alias("b")).union(spark.createDataFrame([(0, 1), (500, 501)], "a long, b long"))
    want = {k + 10: (0 if k % 3 < 2 else 2) for k in range(1, 300)} | {0: 0, 1: 0, 2: 2, 500: 500, 501: 500}
    for hot_rows in (50, 10**6):
        assert dict(connected(e, hot_rows).collect()) == want


def test_looked_up(spark):
    """A heavy key's rows, and those that stand alone, are spread; each row stays, with its key's values or null."""
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), F.lit(1).alias("j"), "id").repartition(4, "k", "j")
    found = spark.range(3500).select(F.col("id").alias("k"), F.lit(1).alias("j"), F.when(F.col("id") != 9, -F.col("id")).alias("v"))
    sizes = rows.groupBy("k", "j").agg(F.count("*").alias("n"))
    out = looked_up(rows, found, ["k", "j"], heaviest(sizes, ["k", "j"], "n", 100), F.col("id") % 50 == 0)
    assert out.columns == ["k", "j", "id", "v"]
    got = sorted((r.id, r.k, r.v) for r in out.collect())
    key = lambda i: 7 if i < 3000 else i
    assert got == [(i, key(i), None if i % 50 == 0 or key(i) >= 3500 else -key(i)) for i in range(4000)]
    assert heaviest(sizes, ["k"], "n", 5000).count() == 0
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        out = looked_up(rows, found, ["k", "j"], heaviest(sizes, ["k", "j"], "n", 100), F.col("id") % 50 == 0)
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 4000 and max(tasks) < 1500, tasks  # the heavy key alone has 3,000 rows
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def brute_lines(rows, least_chars=20, least_docs=3):
    def key(x):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))

    n, holder = {}, {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least_chars:
                n[k] = n.get(k, 0) + 1
                holder[k] = max((h for h in (i, holder.get(k)) if h is not None), default=None)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if n.get(key(x), 0) < least_docs or holder[key(x)] == i]
        out.append((str(i), len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


def line_texts(r):
    pool = [sentence(r, 6) for _ in range(12)] + ["short", "", "   ", "ééééééééééééééééééé", "éééééééééééééééééééé", "Line with UPPER letters and more"]
    forms = (lambda x: x, str.upper, lambda x: f"  {x}\t", lambda x: x + "\r")
    return ["\n".join(forms[r.randrange(4)](pool[r.randrange(len(pool))]) for _ in range(r.randrange(1, 6))) for _ in range(60)] + odd_texts() + ["\n\n"]


@pytest.mark.parametrize("how", [{}, {"filter_bytes": 0}, {"filter_bytes": 0, "most_hot": 2}, {"most_hot": 5}])
def test_line_dedup(spark, monkeypatch, how):
    """Filters broadcast or met in their shards; nearly all, some or nearly no keys settled as hot ones."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    texts = line_texts(rng(6))
    ids = [*range(len(texts) - 4), None, None, None, 3]
    texts[-3] = texts[-4] = texts[0]
    got = line_dedup.dedup_lines(docs(spark, texts, ids), **how).collect()
    assert sorted((str(x.doc_id), x.n_lines, x.n_dropped, x.kept or "") for x in got) == brute_lines(list(zip(ids, texts, strict=True)))
    assert line_dedup.dedup_lines(docs(spark, texts).limit(0), **how).count() == 0


@pytest.mark.parametrize("how", [{}, {"filter_bytes": 0}])
def test_line_dedup_by_kept_filters(spark, how):
    """Documents come and go; the filters are updated, and dedup_lines goes through them."""
    texts = line_texts(rng(8))
    a, b = texts[:40], texts[40:]
    first, more = docs(spark, a), docs(spark, b, range(1000, 1000 + len(b)))
    key = lambda refs: refs.where("n >= 3").select("hi", "lo")
    refs = line_dedup.reference_counts(first)
    old = line_dedup.build_filters(key(refs), 4)
    both = line_dedup.insert(refs, more)
    filters = line_dedup.update_filters(old, key(both), key(both).subtract(key(refs)), key(refs).subtract(key(both)), 4)
    back = line_dedup.delete(both, first, more)
    filters = line_dedup.update_filters(filters, key(back), key(back).subtract(key(both)), key(both).subtract(key(back)), 4)
    got = line_dedup.dedup_lines(more, back, filters, 4, most_hot=2, **how).collect()
    assert sorted((str(x.doc_id), x.n_lines, x.n_dropped, x.kept or "") for x in got) == brute_lines(list(zip(range(1000, 1000 + len(b)), b, strict=True)))


def test_line_dedup_is_reversible(spark):
    texts = line_texts(rng(7))
    a, b = docs(spark, texts), docs(spark, texts[::2], range(1000, 1000 + len(texts[::2])))
    refs = line_dedup.reference_counts(a)
    more = line_dedup.insert(refs, b)
    rows = lambda df: sorted(tuple(x) for x in df.select("hi", "lo", "n", "holder").collect())
    assert rows(more) == rows(line_dedup.reference_counts(a.unionByName(b)))
    assert rows(line_dedup.delete(more, b, a)) == rows(refs)
    assert rows(line_dedup.delete(more, a, b)) == rows(line_dedup.reference_counts(b))
    posted = line_dedup.postings(a.unionByName(b)).persist()
    assert rows(line_dedup.delete(more, b, posted=posted)) == rows(refs)
    assert rows(line_dedup.delete(more, a, posted=posted)) == rows(line_dedup.reference_counts(b))
    some, rest = a.where("doc_id % 3 = 0"), a.where("doc_id % 3 <> 0")
    assert rows(line_dedup.delete(refs, some, posted=line_dedup.postings(a))) == rows(line_dedup.reference_counts(rest))
    odd = docs(spark, ["the same line of text"] * 6 + [None, ""], [None, None, 3, 3, 5, 9, 1, None])
    gone = odd.where("doc_id = 9 or doc_id = 5")
    assert rows(line_dedup.delete(line_dedup.reference_counts(odd), gone, posted=line_dedup.postings(odd))) == rows(line_dedup.reference_counts(odd.where("doc_id is null or doc_id < 5")))


def test_filters(spark):
    r = np.random.Generator(np.random.PCG64(1))
    hi, lo = r.integers(0, 2**64, (2, 3000), dtype=np.uint64)
    f = line_dedup._filled(hi[:2000], lo[:2000])
    assert f.contains(hi[:2000], lo[:2000]).all() and f.contains(hi[2000:], lo[2000:]).mean() < 0.01
    f = line_dedup.CuckooFilter(0, line_dedup.CuckooFilter.from_bytes(f.to_bytes()).slots.copy())
    f.remove(hi[:1000], lo[:1000])
    assert f.contains(hi[1000:2000], lo[1000:2000]).all() and f.contains(hi[:1000], lo[:1000]).mean() < 0.01
    keys = lambda a, b: spark.createDataFrame([(int(x), int(y)) for x, y in zip(hi[a:b].view(np.int64), lo[a:b].view(np.int64), strict=True)], "hi long, lo long")
    old = line_dedup.build_filters(keys(0, 500), 4)
    new = line_dedup.update_filters(old, keys(100, 900), keys(500, 900), keys(0, 100), 4).collect()
    assert len(new) == 4
    for x in new:
        own = ((hi >> np.uint64(32)) % np.uint64(4)).astype(int) == x.shard
        f = line_dedup.CuckooFilter.from_bytes(bytes(x["filter"]))
        assert f.contains(hi[100:900][own[100:900]], lo[100:900][own[100:900]]).all() and f.contains(hi[:100][own[:100]], lo[:100][own[:100]]).mean() < 0.1


def test_line_dedup_columns(spark):
    df = docs(spark, ["a line of over twenty characters"] * 3).withColumn("kept", F.lit(1)).withColumn("keys", F.lit(2))
    assert sorted(x.n_dropped for x in line_dedup.dedup_lines(df).collect()) == [0, 1, 1]
