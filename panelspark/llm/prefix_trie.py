"""Conversation prefixes as double-array tries, one for each shard of the sorted conversations.

A node is a distinct sequence of first turns (role and text). Turns are known by 120 bits
of their SHA-256, written as ``SYMBOL`` characters, so a conversation is a path of fixed-width
symbols, and sorting paths as text puts every subtree in one run.

1. Equal conversations become one sequence with their number, their smallest id and the
   hash of their ids (``_digests``), so a group of copies, however large, is one path. The
   ids are sorted over ranges and joined to chunks there; a task then hashes the chunks of a
   sequence one after another, and never holds its ids.
2. Sequences are cut into ranges of the sorted paths, the prefix shards, at most about
   ``SHARD_TURNS`` turns each. A hot first turn is only a longer run, cut like any other.
3. A shard's task numbers its distinct turns densely, packs its trie into BASE and CHECK
   arrays (child of s by turn c: BASE[s] + c, and CHECK of it is s), and traverses them once
   for every sequence to count members, and once backwards for the sums over subtrees.
4. Only the nodes on the common path of the last sequence of one shard and the first of the
   next lie in several shards. They are the shared upper nodes: a shard gives partial sums
   for them under a name that all shards agree on, and one aggregate merges them. What must
   count once (a child, a text's bytes) is counted by the first shard that has the node; such
   a node is never a leaf, as equal sequences are one. The other nodes are final; those under a
   shared one find its smallest id by (shard, name), so that no join has a hot key.

A conversation is one row of about 25 bytes a turn from its grouping on; a task holds that of one shard.

Edge cases: rows without conversation id are left out; null role or text is empty; turns
are ordered by turn (null first), then role, then text, and repeated ones stay; a conversation
of no turns is a member of the root only; no conversations, no nodes (nor a root).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import cut, table

SYMBOL = 20
SHARD_TURNS = 500_000
CHUNK = 1 << 16
TRIES = 256
GROUP, HEADS = 5, 9
NOTHING = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 0), symbol, bytes (of the text) of every turn."""
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    pos = F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("t"), "r", "x")) - 1
    whole = F.concat(F.octet_length("r").cast("string"), F.lit(":"), "r", "x").cast("binary")
    symbol = F.base64(F.unhex(F.substring(F.sha2(whole, 256), 1, SYMBOL * 3 // 2)))
    return rows.select("conv", pos.alias("pos"), symbol.alias("symbol"), F.octet_length("x").cast("long").alias("bytes"))


def rebuilt_turns(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """turns with the first h of conversation c - c % group in place of each conversation's own first h, where h = crc32(c) % heads.

    A head has fewer than ``heads`` turns and goes to the conversations of one group, so the join has no hot key.
    """
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % heads
    first = turns.where((F.col("conv") % group == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv", "leader")
    convs = turns.select("conv").distinct().select("conv", h("conv").alias("h"), (F.col("conv") - F.col("conv") % group).alias("leader"))
    copied = convs.join(first, "leader").where("pos < h").select("conv", "pos", "symbol", "bytes")
    return turns.where(F.col("pos") >= h("conv")).unionByName(copied)


def sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, path (all symbols in order), sizes (bytes of each turn), of all ``convs``, with turns or without."""
    none = convs.select("conv", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("long").alias("bytes"))
    rows = turns.select("conv", "pos", "symbol", "bytes").unionByName(none).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "symbol", "bytes"))).alias("a"))
    a = F.filter("a", lambda x: x["pos"] >= 0)
    return rows.select("conv", F.array_join(F.transform(a, lambda x: x["symbol"]), "").alias("path"), F.transform(a, lambda x: x["bytes"]).alias("sizes"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, conv) sorted -> name, lo, n, ids: runs of a sequence's ids, at most CHUNK of them, joined by commas."""
    now, ids = None, []

    def flush(out):
        if ids:
            out.append((now, ids[0], len(ids), ",".join(map(str, ids))))

    for batch in batches:
        out: list[tuple] = []
        for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != now or len(ids) >= CHUNK:
                flush(out)
                now, ids = name, []
            ids.append(conv)
        yield _batch(out, ["name", "lo", "n", "ids"], [pa.string(), pa.int64(), pa.int64(), pa.string()])
    out = []
    flush(out)
    yield _batch(out, ["name", "lo", "n", "ids"], [pa.string(), pa.int64(), pa.int64(), pa.string()])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each sequence in order -> lo (its smallest id), n, ends."""
    now, lo, n, h = None, 0, 0, hashlib.sha256()
    names, kinds = ["lo", "n", "ends"], [pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        out: list[tuple] = []
        for name, first, k, ids in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
            if name != now:
                if now is not None:
                    out.append((lo, n, h.hexdigest()))
                now, lo, n, h = name, first, 0, hashlib.sha256()
            h.update((b"," if n else b"") + ids.encode())
            n += k
        yield _batch(out, names, kinds)
    if now is not None:
        yield _batch([(lo, n, h.hexdigest())], names, kinds)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _digests(seqs: DataFrame) -> DataFrame:
    """One row for each distinct sequence: lo, n, ends (SHA-256 of its conversations' ids in order)."""
    named = seqs.select(F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 32).alias("name"), "conv")
    chunks = named.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv").mapInArrow(_chunks, "name string, lo long, n long, ids string")
    return chunks.repartition("name").sortWithinPartitions("name", "lo").mapInArrow(_hashed, "lo long, n long, ends string")


class DoubleArray:
    """A static trie over codes from 1 on: the child of slot s by code c is ``base[s] + c`` if ``check`` of that is s."""

    def __init__(self, children: list[list[int]]):
        """children[k]: the codes of node k's children, whose nodes are numbered in the order of their parents and codes, from the root, 0. ``slot[k]``: where node k is."""
        self.base, self.check, self.slot = [0], [0], [0]
        free = 1
        for k, codes in enumerate(children):
            if not codes:
                continue
            s, at, tries = self.slot[k], free, 0
            while not all(self._is_free(at - codes[0] + c) for c in codes):
                tries += 1
                at = self._next_free(at + 1) if tries < TRIES else len(self.check)
            self.base[s] = at - codes[0]
            for c in codes:
                t = self.base[s] + c
                while t >= len(self.check):
                    self.base.append(0), self.check.append(-1)
                self.check[t] = s
                self.slot.append(t)
            free = self._next_free(free)

    def _is_free(self, t: int) -> bool:
        return t >= len(self.check) or self.check[t] < 0

    def _next_free(self, t: int) -> int:
        while not self._is_free(t):
            t += 1
        return t

    def child(self, s: int, code: int) -> int:
        """The slot of the child, -1 if there is none."""
        t = self.base[s] + code
        return t if 0 < t < len(self.check) and self.check[t] == s else -1


def dense(paths: list[str]) -> list[list[int]]:
    """Each path as codes: 1, 2, ... for the symbols in their order."""
    flat = np.frombuffer("".join(paths).encode(), f"S{SYMBOL}")
    codes = (np.unique(flat, return_inverse=True)[1].ravel() + 1).tolist()
    ends = np.cumsum([len(p) // SYMBOL for p in paths]).tolist()
    return [codes[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def packed(seqs: list[list[int]]) -> DoubleArray:
    """The double array of sorted sequences, level by level: a node is a run of sequences."""
    children: list[list[int]] = []
    level = [(0, len(seqs), 0)]
    while level:
        below = []
        for lo, hi, d in level:
            codes: list[int] = []
            k = lo
            while k < hi and len(seqs[k]) <= d:
                k += 1
            while k < hi:
                c, first = seqs[k][d], k
                while k < hi and seqs[k][d] == c:
                    k += 1
                codes.append(c)
                below.append((first, k, d + 1))
            children.append(codes)
        level = below
    return DoubleArray(children)


_NODE = {"pid": pa.int32(), "node": pa.string(), "above": pa.string(), "conv": pa.int64(), "depth": pa.int64(), "parent": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved": pa.int64(), "ends": pa.string()}


def shard_nodes(paths: list[str], sizes: list[list[int]], lo: list[int], n: list[int], ends: list[str], pid: int, up: int, down: int) -> Iterator[tuple]:
    """The nodes of a shard of sorted sequences. up, down: how deep the first path is shared with the shard before and the last with the one after; -1 where there is none."""
    seqs = dense(paths)
    trie = packed(seqs)
    count: dict[int, int] = {}
    low, depth, size, ended = {}, {}, {}, {}
    order: list[int] = []  # parents before children
    name: dict[int, str] = {}
    theirs: set[int] = set()
    for k, codes in enumerate(seqs):
        s = 0
        shared = max(up if k == 0 else -1, down if k == len(seqs) - 1 else -1)
        h = hashlib.blake2b(digest_size=16)
        for d in range(len(codes) + 1):
            if d:
                s = trie.child(s, codes[d - 1])
                if shared >= d:
                    h.update(paths[k][(d - 1) * SYMBOL : d * SYMBOL].encode())
            if s not in count:
                order.append(s)
                count[s], low[s], depth[s], size[s] = 0, lo[k], d, sizes[k][d - 1] if d else 0
            count[s] += n[k]
            low[s] = min(low[s], lo[k])
            if d <= shared:
                name[s] = f"{d}:{h.copy().hexdigest()}"
            if k == 0 and d <= up:
                theirs.add(s)
        ended[s] = ends[k]
    kids, leaves, saved = dict.fromkeys(order, 0), dict.fromkeys(order, 0), dict.fromkeys(order, 0)
    for s in reversed(order):
        saved[s] += size[s] * (count[s] - (s not in theirs))
        if not leaves[s] and s not in name:
            leaves[s] = 1
        if s:
            p = trie.check[s]
            saved[p] += saved[s]
            leaves[p] += leaves[s]
            kids[p] += s not in theirs
    for s in order:
        p = trie.check[s] if s else None
        yield pid, name.get(s), name.get(p) if s else None, low[s], depth[s], low[p] if s else None, count[s], kids[s], leaves[s], saved[s], ended.get(s)


def _nodes_of_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, sizes, lo, n, ends, pid, up, down: a whole shard in order -> its nodes."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    columns = [t.column(k).to_pylist() for k in range(5)]
    one = [t.column(k)[0].as_py() for k in range(5, 8)]
    out = []
    for row in shard_nodes(*columns, *one):
        out.append(row)
        if len(out) == 20_000:
            yield _batch(out, list(_NODE), list(_NODE.values()))
            out = []
    yield _batch(out, list(_NODE), list(_NODE.values()))


@F.arrow_udf(T.IntegerType())
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many symbols two paths begin with in common; -1 where one is null."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if x is None or y is None:
            out.append(-1)
            continue
        n = min(len(x), len(y))
        p, q = (np.frombuffer(v[:n].encode(), np.uint8) for v in (x, y))
        differ = np.flatnonzero(p != q)
        out.append(int(differ[0] if len(differ) else n) // SYMBOL)
    return pa.array(out, pa.int32())


def prefix_nodes(turns: DataFrame, convs: DataFrame, shard_turns: int = SHARD_TURNS, shards: int | None = None) -> DataFrame:
    """The nodes of all conversations' prefixes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv, pos, symbol, bytes as ``ordered_turns`` gives them; convs: conv, all of them. shards: how many ranges at least, by default spark.sql.shuffle.partitions.
    """
    spark = turns.sparkSession
    seqs = cut(sequences(turns, convs))
    reps = _digests(seqs).join(seqs, F.col("lo") == F.col("conv")).select("path", "sizes", "lo", "n", "ends")
    reps = cut(reps)
    total = reps.agg(F.sum(F.size("sizes") + 1)).head()[0] or 0
    shards = max(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_turns))
    placed = cut(reps.repartitionByRange(shards, "path").sortWithinPartitions("path").withColumn("pid", F.spark_partition_id()))
    ends = placed.groupBy("pid").agg(F.min("path").alias("first"), F.max("path").alias("last"))  # a row for each shard
    w = Window.orderBy("pid")
    borders = ends.select("pid", "first", "last", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"))
    borders = borders.select(F.col("pid").alias("b"), _common("first", "before").alias("up"), _common("last", "after").alias("down"))
    shard = placed.join(F.broadcast(borders), placed["pid"] == borders["b"]).select("path", "sizes", "lo", "n", "ends", "pid", "up", "down")
    made = cut(shard.mapInArrow(_nodes_of_shard, "pid int, node string, above string, conv long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends string"))

    parts = made.where("node is not null")
    top = cut(parts.groupBy("node").agg(F.max("above").alias("above"), F.min("conv").alias("conv"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("ends").alias("ends")))
    here = parts.select("pid", "node").join(top.select("node", "conv"), "node").select(F.col("pid").alias("q"), F.col("node").alias("m"), F.col("conv").alias("found"))
    under = made.where("node is null and above is not null").join(here, (F.col("pid") == F.col("q")) & (F.col("above") == F.col("m"))).withColumn("parent", F.col("found"))
    over = top.join(top.select(F.col("node").alias("m"), F.col("conv").alias("parent")), F.col("above") == F.col("m"), "left")
    own = made.where("node is null and above is null")
    fields = ["conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    out = own.select(*fields).unionByName(under.select(*fields)).unionByName(over.select(*fields))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str | Column = "role", text: str = "text", **how) -> DataFrame:
    """The nodes of the conversations as they are."""
    turns = cut(ordered_turns(conversations, conv_id, turn, role, text))
    return prefix_nodes(turns, turns.select("conv").distinct(), **how)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = cut(ordered_turns(table(spark, sf_dir, "conversations")))
    return prefix_nodes(rebuilt_turns(turns), turns.select("conv").distinct())


ORACLE_SQL = f"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS leader, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, b: xor(s // 256, t[xor(s % 256, b)::INT + 1])), 4294967295) % {HEADS} AS h
      FROM (SELECT DISTINCT conv_id FROM o), crc),
r AS (SELECT h.conv_id, pos, role, text FROM h JOIN o USING (conv_id) WHERE pos >= h UNION ALL SELECT h.conv_id, pos, role, text FROM h JOIN o ON o.conv_id = leader WHERE pos < h),
p AS (SELECT h.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS path FROM h LEFT JOIN r USING (conv_id) GROUP BY 1),
m AS (SELECT conv_id, path, d, list_slice(path, 1, d) AS node FROM p, LATERAL (SELECT unnest(range(len(path) + 1)) AS d)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(strlen(list_extract(node, d).t), 0) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(path) = d), '')) AS ends FROM m GROUP BY 1, 2),
c AS (SELECT list_slice(node, 1, d - 1) AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
s AS (SELECT list_slice(u.node, 1, k) AS node, sum((n_convs - 1) * size)::BIGINT AS saved, count(*) FILTER (WHERE c.node IS NULL) AS leaves FROM n u LEFT JOIN c ON c.node = u.node, LATERAL (SELECT unnest(range(u.d + 1)) AS k) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN c ON c.node = n.node LEFT JOIN n up ON up.node = list_slice(n.node, 1, n.d - 1) AND n.d = up.d + 1
"""
