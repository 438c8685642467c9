"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

A line's key is the line without white space at both ends, A-Z lower-cased; keys of at
least ``least_chars`` code points take part. The exact table (``reference_counts``)
holds for each key the number of documents with it and its holder, the largest doc_id
among them. Keys in at least ``least_docs`` documents lose their lines in every
document but the holder.

* ``reference_counts`` pre-aggregates keys within each Arrow batch, then by key.
  ``insert`` adds documents' counts to a table; ``delete`` takes them off again, and
  looks up a new holder only for keys whose holder went, in the table of ``postings``. So a table after inserting
  and deleting the same documents is the table before.
* ``build_filters`` puts the repeated keys of each shard (a range of the key's hash,
  at most SHARD_KEYS keys on average) into one cuckoo filter: buckets of 4 16-bit
  fingerprints, which can be taken out again (``update_filters``).
* ``dedup_lines`` asks the filters first, so that of all lines only those that may be
  repeated go to the exact table. Up to MOST_FILTER_BYTES in all, the filters are
  broadcast, and lines ask them where they are; more filters than that are met by the
  lines in their own shards: (key, doc_id) of each line goes to its shard's task, which
  holds one filter at a time. The exact table settles what passes.
* A key in a third of all documents meets nowhere: the keys that hold at least
  1 / MOST_HOT of all repeated lines (so there are at most MOST_HOT of them) are
  broadcast with their holders, and settled where a text is rewritten.

Keys are 128-bit hash values. Edge cases: each row is a document, so repeated rows
count as often as they come, and all rows with the holder's doc_id keep the line; a
null doc_id is no holder unless all are null, and such rows are joined by their texts; a null or empty text is one empty line;
lines may end in \\r; no rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import cut, table
from panelspark.llm.text import LOWER, NOT_SPACE, U64, mix, pieces, powers

LEAST_CHARS, LEAST_DOCS = 20, 3
SHARD_KEYS = 100_000
MOST_FILTER_BYTES = 64 << 20
MOST_HOT = 1000

_CODES = np.random.Generator(np.random.PCG64(77)).integers(1, 2**64, (2, 256), dtype=U64)


class Lines:
    """The lines of some rows: bounds in ``raw``, number of code points and 128-bit value of each key."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        self.raw, rows, n = raw, len(bounds) - 1, len(raw)
        breaks = np.flatnonzero(raw == 10)
        count = np.diff(np.searchsorted(breaks, bounds)) + 1
        self.first = np.concatenate(([0], np.cumsum(count)))
        self.end = np.empty(self.first[-1], np.int64)
        last = self.first[1:] - 1
        inner = np.ones(len(self.end), bool)
        inner[last] = False
        self.end[last], self.end[inner] = bounds[1:], breaks
        self.start = np.empty_like(self.end)
        self.start[1:] = self.end[:-1] + 1
        self.start[self.first[:-1]] = bounds[:-1]
        self.row = np.repeat(np.arange(rows), count)
        low = LOWER[raw]
        solid = np.flatnonzero(NOT_SPACE[raw])
        a, b = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end) - 1
        some = a <= b
        begin, stop = np.zeros_like(a), np.zeros_like(a)
        if len(solid):
            begin[some], stop[some] = solid[a[some]], solid[b[some]] + 1
        heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        self.chars = heads[stop] - heads[begin]
        up, down = powers(max(n, 1))
        self.value = []
        for codes in _CODES:
            total = np.zeros(n + 1, U64)
            np.cumsum(codes[low] * up[:n], out=total[1:])
            self.value.append(mix((total[stop] - total[begin]) * down[np.minimum(begin, n - 1)] if n else np.zeros(len(a), U64)))


def _partial(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text -> counts of the batch's keys."""
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            his, los, rows = [], [], []
            for row, raw, bounds in pieces(batch.column(1)):
                x = Lines(raw, bounds)
                ok = x.chars >= least_chars
                his.append(x.value[0][ok]), los.append(x.value[1][ok]), rows.append(x.row[ok] + row)
            if not his:
                continue
            hi, lo, row = map(np.concatenate, (his, los, rows))
            if not len(hi):
                continue
            order = np.lexsort((row, lo, hi))
            hi, lo, row = hi[order], lo[order], row[order]
            key = np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
            doc = key | np.concatenate(([True], row[1:] != row[:-1]))
            at = np.flatnonzero(key)
            n = np.add.reduceat(doc.astype(np.int64), at)
            low = np.iinfo(np.int64).min
            holder = np.maximum.reduceat(np.where(known[row], ids[row], low), at)
            some = np.maximum.reduceat(known[row], at)
            yield pa.RecordBatch.from_arrays([pa.array(hi[at].view(np.int64)), pa.array(lo[at].view(np.int64)), pa.array(n), pa.array(holder, mask=~some)], names=["hi", "lo", "n", "holder"])

    return run


def reference_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """The exact table of some documents: hi, lo (the key), n (documents with it), holder (largest doc_id)."""
    parts = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(_partial(least_chars), "hi long, lo long, n long, holder long")
    return parts.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))


def insert(refs: DataFrame, docs: DataFrame, **how) -> DataFrame:
    """The table after ``docs`` came in."""
    return refs.unionByName(reference_counts(docs, **how)).groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))


def _posted(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text -> (hi, lo, doc_id) of each text's distinct keys."""
        for batch in batches:
            ids = batch.column(0)
            for row, raw, bounds in pieces(batch.column(1)):
                x = Lines(raw, bounds)
                ok = x.chars >= least_chars
                hi, lo, at = x.value[0][ok], x.value[1][ok], x.row[ok] + row
                order = np.lexsort((lo, hi, at))
                hi, lo, at = hi[order], lo[order], at[order]
                new = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (at[1:] != at[:-1]))[: len(at)]
                yield pa.RecordBatch.from_arrays([pa.array(hi[new].view(np.int64)), pa.array(lo[new].view(np.int64)), ids.take(pa.array(at[new]))], names=["hi", "lo", "doc_id"])

    return run


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """hi, lo, doc_id, n: how many rows of each doc_id hold each key. Kept beside the reference counts, it makes deletions cheap."""
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(_posted(least_chars), "hi long, lo long, doc_id long")
    return rows.groupBy("hi", "lo", "doc_id").agg(F.count("*").alias("n"))


def delete(refs: DataFrame, gone: DataFrame, left: DataFrame | None = None, posted: DataFrame | None = None, **how) -> DataFrame:
    """The table after the documents ``gone`` went. Keys that no document holds go.

    Only keys whose holder went need another one. It is looked up in ``posted`` (the ``postings`` before the deletion), of which
    just the rows of these keys are taken; or, without that table, in ``left``, the documents that stay, which are all read.
    """
    off = reference_counts(gone, **how).select("hi", "lo", F.col("n").alias("off"), F.col("holder").alias("went"))
    now = cut(refs.join(off, ["hi", "lo"], "left").withColumn("n", F.col("n") - F.coalesce("off", F.lit(0))).where("n > 0"))
    lost = now.where("off is not null and holder <=> went").select("hi", "lo")
    if posted is not None:
        less = postings(gone, **how).withColumn("n", -F.col("n"))
        still = posted.join(lost, ["hi", "lo"], "left_semi").unionByName(less).groupBy("hi", "lo", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
        found = still.groupBy("hi", "lo").agg(F.max("doc_id").alias("new")).join(lost, ["hi", "lo"], "left_semi").withColumn("changed", F.lit(True))
    else:
        found = reference_counts(left, **how).join(lost, ["hi", "lo"], "left_semi").select("hi", "lo", F.col("holder").alias("new"), F.lit(True).alias("changed"))
    return now.join(found, ["hi", "lo"], "left").select("hi", "lo", "n", F.when(F.col("changed"), F.col("new")).otherwise(F.col("holder")).alias("holder"))


class CuckooFilter:
    """Fingerprints of 128-bit keys in buckets of four. Grows by rebuilding when a key finds no place."""

    def __init__(self, keys: int, slots: np.ndarray | None = None):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / 4 / 0.85 + 1))))
        self.slots = np.zeros((buckets, 4), np.uint16) if slots is None else slots

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        """A filter to ask; ``copy`` its slots to change it."""
        return cls(0, np.frombuffer(raw, np.uint16).reshape(-1, 4))

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        mark = (lo % U64(65535)).astype(np.uint16) + np.uint16(1)
        one = (hi & U64(len(self.slots) - 1)).astype(np.int64)
        return mark, one, one ^ self._turn(mark)

    def _turn(self, mark):
        return (mix(np.atleast_1d(mark).astype(U64)) & U64(len(self.slots) - 1)).astype(np.int64)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(hi, lo)
        return ((self.slots[one] == mark[:, None]) | (self.slots[two] == mark[:, None])).any(1)

    def add(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if a key found no place; the filter is then to be rebuilt with more room."""
        rng = np.random.Generator(np.random.PCG64(5))
        for mark, one, two in zip(*self.places(hi, lo), strict=True):
            for at in (one, two):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = mark
                    break
            else:
                for _ in range(500):
                    k = int(rng.integers(4))
                    mark, self.slots[at, k] = self.slots[at, k], mark
                    at = int(at ^ self._turn(mark)[0])
                    free = np.flatnonzero(self.slots[at] == 0)
                    if len(free):
                        self.slots[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for mark, one, two in zip(*self.places(hi, lo), strict=True):
            for at in (one, two):
                k = np.flatnonzero(self.slots[at] == mark)
                if len(k):
                    self.slots[at, k[0]] = 0
                    break


def _filled(hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
    room = len(hi)
    while True:
        f = CuckooFilter(room)
        if f.add(hi, lo):
            return f
        room = max(16, room * 2)


def _shard(shards: int):
    return F.pmod(F.shiftrightunsigned("hi", 32), F.lit(shards)).cast("int")


def _values(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return t["hi"].to_numpy().view(U64), t["lo"].to_numpy().view(U64)


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """keys (hi, lo, distinct) -> shard, filter."""

    def build(t: pa.Table) -> pa.Table:
        return pa.table({"shard": pa.array([t["shard"][0].as_py()], pa.int32()), "filter": pa.array([_filled(*_values(t)).to_bytes()], pa.binary())})

    return keys.select(_shard(shards).alias("shard"), "hi", "lo").groupBy("shard").applyInArrow(build, "shard int, filter binary")


def update_filters(filters: DataFrame, keys: DataFrame, added: DataFrame, removed: DataFrame, shards: int) -> DataFrame:
    """Filters after keys became repeated (``added``) or stopped being so (``removed``); ``keys``: all repeated keys now, for shards that need more room."""
    what = added.select("hi", "lo", F.lit(1).alias("w")).union(removed.select("hi", "lo", F.lit(-1).alias("w"))).union(keys.select("hi", "lo", F.lit(0).alias("w")))

    def update(old: pa.Table, t: pa.Table) -> pa.Table:
        shard = (t if t.num_rows else old)["shard"][0].as_py()
        f = CuckooFilter(0, CuckooFilter.from_bytes(old["filter"][0].as_py()).slots.copy()) if old.num_rows else CuckooFilter(16)
        if t.num_rows:
            w, (hi, lo) = t["w"].to_numpy(), _values(t)
            f.remove(hi[w < 0], lo[w < 0])
            if not f.add(hi[w > 0], lo[w > 0]):
                f = _filled(hi[w == 0], lo[w == 0])
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([f.to_bytes()], pa.binary())})

    return filters.groupBy("shard").cogroup(what.withColumn("shard", _shard(shards)).groupBy("shard")).applyInArrow(update, "shard int, filter binary")


def _at_filters(shards: int):
    """(shard, kind, filter, doc_id, part, hi, lo), each shard's filter before its lines -> the lines that their filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero((np.diff(shard, prepend=-1) != 0) | (kind == 0)).tolist()
            for k, stop in zip(starts, [*starts[1:], len(shard)], strict=True):
                begin = k
                if kind[k] == 0:
                    now, held, begin = shard[k], CuckooFilter.from_bytes(batch.column(2)[k].as_py()), k + 1
                if now == shard[k] and stop > begin:
                    part = batch.slice(begin, stop - begin)
                    hit = held.contains(part.column(5).to_numpy().view(U64), part.column(6).to_numpy().view(U64))
                    yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(hit)) for c in (3, 4, 5, 6)], names=["doc_id", "part", "hi", "lo"])

    return run


def _is_hot(hot: tuple[np.ndarray, dict], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which keys are among the hot ones."""
    out = np.isin(hi, hot[0])
    at = np.flatnonzero(out)
    out[at] = [k in hot[1] for k in zip(hi[at].view(np.int64).tolist(), lo[at].view(np.int64).tolist(), strict=True)]
    return out


def dedup_lines(docs: DataFrame, refs: DataFrame | None = None, filters: DataFrame | None = None, shards: int | None = None, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, filter_bytes: int = MOST_FILTER_BYTES, most_hot: int = MOST_HOT) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_dropped, kept (the text that stays).

    refs: the exact table; by default that of ``docs``. filters, shards: the filters of its repeated keys, as ``build_filters``
    and ``update_filters`` give them; by default they are built.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0))
    if refs is None:
        refs = reference_counts(docs, least_chars=least_chars)
    repeated = cut(refs.where(F.col("n") >= least_docs).select("hi", "lo", "n", "holder"))
    n, n_lines = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    hot_rows = repeated.where(F.col("n") * most_hot >= n_lines).collect()  # at most most_hot rows
    hot = spark.sparkContext.broadcast((np.array([r.hi for r in hot_rows], np.int64).view(U64), {(r.hi, r.lo): r.holder for r in hot_rows}))
    if filters is None:
        shards = max(1, -(-n // SHARD_KEYS))
        filters = build_filters(repeated, shards)
    filters = cut(filters)
    bound = filters.agg(F.sum(F.octet_length("filter") + 64)).head()[0] or 0
    sent = spark.sparkContext.broadcast({r.shard: bytes(r.filter) for r in filters.collect()}) if bound <= filter_bytes else None

    @F.arrow_udf("array<struct<hi:long,lo:long>>")
    def maybe_repeated(col: pa.Array) -> pa.Array:
        """The keys of each text that their filters may hold, or all keys if the filters aren't here; without the hot ones."""
        here = sent and {s: CuckooFilter.from_bytes(b) for s, b in sent.value.items()}
        his, los, count = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for _, raw, bounds in pieces(col):
            x = Lines(raw, bounds)
            ok = np.flatnonzero(x.chars >= least_chars)
            hi, lo, row = x.value[0][ok], x.value[1][ok], x.row[ok]
            if here is not None:
                shard = ((hi >> U64(32)) % U64(shards)).astype(int)
                hit = np.zeros(len(ok), bool)
                for s in np.unique(shard).tolist():
                    own = shard == s
                    hit[own] = s in here and here[s].contains(hi[own], lo[own])
                hi, lo, row = hi[hit], lo[hit], row[hit]
            cold = ~_is_hot(hot.value, hi, lo)
            hi, lo, row = hi[cold], lo[cold], row[cold]
            order = np.lexsort((lo, hi, row))
            hi, lo, row = hi[order], lo[order], row[order]
            new = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (row[1:] != row[:-1]))[: len(row)]
            his.append(hi[new]), los.append(lo[new]), count.append(np.bincount(row[new], minlength=len(bounds) - 1))
        keys = pa.StructArray.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (his, los)], names=["hi", "lo"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(count))), pa.int32()), keys)

    lines = docs.select("doc_id", "part", F.explode(maybe_repeated("text")).alias("k")).select("doc_id", "part", "k.hi", "k.lo")
    if sent is None:
        columns = ["shard", "kind", "filter", "doc_id", "part", "hi", "lo"]
        asking = lines.select(_shard(shards).alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("filter"), "doc_id", "part", "hi", "lo")
        answering = filters.select("shard", F.lit(0).alias("kind"), "filter", *[F.lit(None).cast("long").alias(c) for c in columns[3:]])
        meeting = asking.unionByName(answering).repartition("shard").sortWithinPartitions("shard", "kind")
        lines = meeting.mapInArrow(_at_filters(shards), "doc_id long, part long, hi long, lo long")
    drops = lines.join(repeated.select("hi", "lo", "holder"), ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    drops = drops.groupBy(F.col("doc_id").alias("id"), F.col("part").alias("id_part")).agg(F.collect_set(F.struct("hi", "lo")).alias("keys"))

    @F.arrow_udf("struct<n_lines:long,n_dropped:long,kept:string>")
    def rewrite(ids: pa.Array, col: pa.Array, keys: pa.Array) -> pa.Array:
        ids, keys = ids.to_pylist(), keys.to_pylist()
        n_lines, n_dropped, kept = [], [], []
        for row, raw, bounds in pieces(col):
            x = Lines(raw, bounds)
            data = raw.tobytes()
            n_lines += np.diff(x.first).tolist()
            hot_line = (x.chars >= least_chars) & _is_hot(hot.value, *x.value)
            some_hot = np.add.reduceat(hot_line, x.first[:-1]).tolist() if len(hot_line) else []
            for r in range(len(bounds) - 1):
                own = keys[row + r]
                if not own and not some_hot[r]:
                    n_dropped.append(0), kept.append(data[bounds[r] : bounds[r + 1]])
                    continue
                gone = {(k["hi"], k["lo"]) for k in own or ()}
                lines = range(x.first[r], x.first[r + 1])
                hi, lo = (v[x.first[r] : x.first[r + 1]].view(np.int64).tolist() for v in x.value)
                stay = [k for k, h, b in zip(lines, hi, lo, strict=True) if x.chars[k] < least_chars or not ((h, b) in gone or hot_line[k] and hot.value[1][h, b] != ids[row + r])]
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(data[x.start[k] : x.end[k]] for k in stay))
        return pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["n_lines", "n_dropped", "kept"])

    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops["id"]) & (docs["part"] == drops["id_part"]), "left")
    return joined.select("doc_id", rewrite("doc_id", "text", "keys").alias("r")).select("doc_id", "r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY 1 HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
m AS (SELECT doc_id, line, i, holder IS NOT NULL AND holder <> doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
