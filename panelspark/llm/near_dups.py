"""Near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct shingles of ``width`` words. Documents whose
sets have a Jaccard similarity of ``percent`` or more are linked; a component is
what links connect.

1. ``describe`` turns each text into its set, and keeps of it: its size, a 128-bit
   digest, a sketch of ``BINS`` bytes (the smallest value of each bin of the hash
   range) and the nodes of the first level. Equal sets become one vertex, so copies
   cost one row each.
2. The chosen path: each of ``TREES`` independent trees picks coordinates, on
   average 1/similarity of them, and sends a document to the nodes of the minwise
   tokens it has there. Inside a task a node is compared exhaustively if it is
   small or nearly connected; else it branches on coordinates of the sketch chosen
   by the node, and the recursion goes on. Nodes of over ``NODE_ROWS`` documents
   never meet in one task: they branch on, level by level, as rows; what doesn't
   fall apart is compared in pairs of blocks. Only a spanning forest of likely
   links leaves a task, not all pairs of a group.
3. The components of likely links are families. A family is dealt into blocks of at
   most ``BLOCK_ROWS`` rows, each with the family's first member as a pivot, and all
   pairs of a block are confirmed on the full sets. Mostly the pivot joins the blocks.
   Where a family still has several parts, the members outside its largest part meet
   all others once more, block by block, so every pair of different parts is compared.
   A text is read once, and again only for such pairs.

Every step before the last only picks candidates; a wrong candidate costs time, and the
confirmation passes no pair by. A pair at the threshold is missed if it shares no
first-level node, a chance of (1 - similarity) ** 10, about 1e-7; if its sketches agree
on under ``percent`` - SLACK of the bins, about 2e-6 at 64 bins; or if every node that
has both is so large that it branches, and parts them: a visit to a node of over 2,900
unlike sets finds about 80 % of such pairs, which leaves 4e-5 of pairs that share no
smaller node. Links through other members join most of these all the same.

Edge cases: null, empty and blank texts have an empty set and stay alone; texts of
fewer words than a shingle count as one shingle; rows are linked by their texts, so
repeated rows share a component; a row without doc_id counts in no component, its
component_id is null and it is kept; no rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import HOT_ROWS, cut, heaviest, looked_up, table, together
from panelspark.llm.components import connected
from panelspark.llm.text import NOT_SPACE, U64, Words, mix, words

WIDTH, PERCENT = 4, 80
TREES = 8
BINS = 64
#: A pair is likely if its sketches agree on so many of the bins in use: five deviations under the threshold.
SLACK = 0.26
NODE_ROWS = 40_000
LEVELS = 6
LEAF = 96
#: Most vertices and shingles of a block when links are confirmed.
BLOCK_ROWS, BLOCK_SHINGLES = 128, 1_000_000
#: Ids of texts to read are broadcast up to this number (8 bytes each), so that other texts aren't shuffled.
MOST_IDS = 500_000

_POLY = U64(0x9E3779B97F4A7C15 | 1)


def shingles(w: Words, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle values of each row."""
    size = np.diff(w.first)
    v = w.value
    n_full = max(0, len(v) - width + 1)
    full = np.zeros(n_full, U64)
    for k in range(width):
        full = full * _POLY + v[k : k + n_full]
    full = mix(full)
    out = []
    for a, n in zip(w.first[:-1].tolist(), size.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(full[a : a + n - width + 1]))
        elif n:
            short = np.zeros(1, U64)
            for k in range(n):
                short = short * _POLY + v[a + k]
            out.append(mix(short + U64(n)))
        else:
            out.append(np.zeros(0, U64))
    return out


def _coordinates(trees: int, percent: int) -> np.ndarray:
    """A random odd factor for each coordinate that a tree picks at its root."""
    rng = np.random.Generator(np.random.PCG64(11))
    picks = np.floor(rng.random(trees) + 100 / percent).astype(int)
    while picks.sum() < round(trees * 100 / percent):
        picks[rng.integers(trees)] += 1
    return rng.integers(1, 2**63, int(picks.sum()), dtype=U64) * U64(2) + U64(1)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS bytes for each set, 0 for an empty bin."""
    out = np.zeros((len(sets), BINS), np.uint8)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    if len(flat):
        key = np.repeat(np.arange(len(sets)), sizes) * BINS + (flat >> U64(58)).astype(np.int64)
        head = np.flatnonzero(np.diff(key, prepend=-1))
        out.reshape(-1)[key[head]] = (flat[head] >> U64(20)) % U64(255) + U64(1)
    return out


def likeness(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The estimated similarity of sketches, row by row."""
    used = np.count_nonzero((one | many), axis=-1)
    return np.count_nonzero((one == many) & (many != 0), axis=-1) / np.maximum(used, 1)


def _describe(width: int, trees: int, percent: int):
    @F.arrow_udf("struct<n:long,hi:long,lo:long,sketch:binary,nodes:array<long>>")
    def describe(col: pa.Array) -> pa.Array:
        factors = _coordinates(trees, percent)
        n_all, hi, lo, sk, nodes = [], [], [], [], []
        for _, w in words(col, NOT_SPACE):
            sets = shingles(w, width)
            n = np.array([len(s) for s in sets])
            some = np.flatnonzero(n)
            rows = len(sets)
            a, b = np.zeros(rows, U64), np.zeros(rows, U64)
            low = np.zeros((rows, len(factors)), U64)
            if len(some):
                flat = np.concatenate(sets)
                at = (np.cumsum(n) - n)[some]
                a[some] = np.add.reduceat(mix(flat ^ U64(0x5851F42D4C957F2D)), at)
                b[some] = np.add.reduceat(mix(flat ^ U64(0x14057B7EF767814F)), at)
                for c, f in enumerate(factors):
                    low[some, c] = np.minimum.reduceat(flat * f, at)
                low = mix(low ^ (np.arange(1, len(factors) + 1, dtype=U64) * U64(0xA0761D6478BD642F)))
            n_all.append(n), hi.append(a), lo.append(b)
            sk += [s.tobytes() if k else None for s, k in zip(sketch(sets), n, strict=True)]
            nodes += [row if k else None for row, k in zip(low.view(np.int64), n, strict=True)]
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(flat(n_all), pa.int64()), pa.array(flat(hi).view(np.int64)), pa.array(flat(lo).view(np.int64)), pa.array(sk, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
            names=["n", "hi", "lo", "sketch", "nodes"],
        )

    return describe


class Forest:
    """Disjoint sets of integers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _branch(node: int, depth: int) -> np.ndarray:
    """The bins on which a node branches: 1 or 2 of them, 1.25 on average."""
    rng = np.random.Generator(np.random.PCG64([node & (2**63 - 1), depth]))
    return rng.choice(BINS, 1 + int(rng.random() < 0.25), replace=False)


def search_node(ids: np.ndarray, sk: np.ndarray, least: float, forest: Forest, node: int, depth: int = 0) -> None:
    """Joins in ``forest`` what is likely linked among the vertices of one node."""
    n = len(ids)
    root = np.array([forest.find(i) for i in ids.tolist()])
    kinds, count = np.unique(root, return_counts=True)
    if len(kinds) == 1:
        return
    rest = np.flatnonzero(root != kinds[count.argmax()])
    if n <= LEAF or len(rest) * n <= 1 << 23 or depth >= 12:
        for i in rest.tolist():  # all pairs, but for those within the largest part
            for j in np.flatnonzero((likeness(sk[i], sk) >= least) & (root != root[i])).tolist():
                forest.join(int(ids[i]), int(ids[j]))
        return
    for i in np.random.Generator(np.random.PCG64([node & (2**63 - 1), 1])).choice(n, 4, replace=False).tolist():
        for j in np.flatnonzero(likeness(sk[i], sk) >= least).tolist():
            forest.join(int(ids[i]), int(ids[j]))
    for c in _branch(node, depth).tolist():
        order = np.argsort(sk[:, c], kind="stable")
        cuts = np.searchsorted(sk[order, c], np.arange(257))
        for value in range(256):
            part = order[cuts[value] : cuts[value + 1]]
            if len(part) > 1:
                search_node(ids[part], sk[part], least, forest, (node * 1_000_003 + c * 256 + value) & (2**63 - 1), depth + 1)


def _sketches(col: pa.Array) -> np.ndarray:
    begin = np.frombuffer(col.buffers()[1], np.int32)[col.offset]
    return np.frombuffer(col.buffers()[2], np.uint8)[begin : begin + len(col) * BINS].reshape(len(col), BINS)


def _match(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node, id, sketch, sorted by node -> a forest of likely links."""
        forest = Forest()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def work(node: np.ndarray, ids: np.ndarray, sk: np.ndarray) -> None:
            first = np.flatnonzero(np.diff(node, prepend=node[0] - 1 if node[0] > -(2**63) else node[0] + 1))
            size = np.diff(first, append=len(node))
            small = np.repeat(size <= 16, size)
            for d in range(1, 16):
                i = np.flatnonzero((node[:-d] == node[d:]) & small[d:]) if d < len(node) else ()
                if not len(i):
                    break
                for k in range(0, len(i), 1 << 15):
                    x = i[k : k + (1 << 15)]
                    x = x[likeness(sk[x], sk[x + d]) >= least]
                    for a, b in zip(ids[x].tolist(), ids[x + d].tolist(), strict=True):
                        forest.join(a, b)
            for a, n in zip(first[size > 16].tolist(), size[size > 16].tolist(), strict=True):
                search_node(ids[a : a + n], sk[a : a + n], least, forest, int(node[a]))

        for batch in batches:
            if not batch.num_rows:
                continue
            node, ids = (batch.column(k).to_numpy() for k in (0, 1))
            held.append((node, ids, _sketches(batch.column(2))))
            last = np.searchsorted(node, node[-1])  # what may go on in the next batch
            if last:
                parts = [*held[:-1], tuple(x[:last] for x in held[-1])]
                work(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                held = [tuple(x[last:].copy() for x in held[-1])]
        if held:
            work(*(np.concatenate(x) for x in zip(*held, strict=True)))
        ids = sorted(forest.up)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([forest.find(i) for i in ids], pa.int64())], names=["a", "b"])

    return run


def _children(depth: int):
    @F.arrow_udf("array<long>")
    def children(node: pa.Array, sk: pa.Array) -> pa.Array:
        out = []
        for x, s in zip(node.to_pylist(), sk.to_pylist(), strict=True):
            out.append([int(mix(np.array([(x * 1_000_003 + int(c) * 256 + s[c]) & (2**64 - 1)], U64)).view(np.int64)[0]) for c in _branch(x, 100 + depth)])
        return pa.array(out, pa.list_(pa.int64()))

    return children


def block_pairs(rows: DataFrame, group: str, block: Column, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks that its block is in; ``gid`` names the pair."""
    rows = rows.withColumn("_b", block).withColumn("_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("gid", F.xxhash64(group, F.least("_b", "_j"), F.greatest("_b", "_j"))).drop("_b", "_j")


def likely_links(vertices: DataFrame, percent: int = PERCENT, node_rows: int = NODE_ROWS) -> DataFrame:
    """vertices (id, sketch, nodes) -> forests of likely links (a, b)."""
    rows = vertices.select("id", "sketch", F.explode("nodes").alias("node"))
    match = _match(percent / 100 - SLACK)
    search = lambda x: together(x, "node").sortWithinPartitions("node").select("node", "id", "sketch").mapInArrow(match, "a long, b long")
    found = None
    for depth in range(LEVELS + 1):
        large = rows.groupBy("node").count().where(F.col("count") > node_rows)
        large = cut(large)  # fewer than one in ``node_rows`` rows, so it is broadcast
        n_large = large.count()
        small = rows.join(F.broadcast(large), "node", "left_anti") if n_large else rows
        found = search(small) if found is None else found.union(search(small))
        if not n_large:
            return found
        rows = rows.join(F.broadcast(large), "node")
        if depth < LEVELS:
            rows = cut(rows.select("id", "sketch", F.explode(_children(depth)("node", "sketch")).alias("node")))
    half = max(1, node_rows // 2)
    blocks = F.ceil(F.col("count") / half).cast("int")
    pairs = block_pairs(rows, "node", F.pmod(F.xxhash64("id"), blocks).cast("int"), blocks)
    return found.union(search(pairs.select("id", "sketch", F.col("gid").alias("node")).distinct()))


def linked(a: int, b: int, inter, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def confirm(sets: list[np.ndarray], percent: int, part: np.ndarray | None = None) -> np.ndarray:
    """The part of each set after all links among them are confirmed on the full sets; parts are named by their first member.

    part: the parts known before; sets of one part aren't compared.
    """
    n = len(sets)
    part = np.arange(n) if part is None else part.copy()
    size = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    wide = -(-len(values) // 64)
    bits = None
    if n * wide <= 1 << 23:
        bits = np.zeros((n, wide), U64)
        np.bitwise_or.at(bits, (np.repeat(np.arange(n), size), place >> 6), U64(1) << (place & 63).astype(U64))
    step = max(1, (1 << 20) // wide)
    for i in range(n - 1):
        ok = (part[i + 1 :] != part[i]) & (100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :]))
        cand = i + 1 + np.flatnonzero(ok)
        for k in range(0, len(cand), step):
            c = cand[k : k + step]
            if bits is None:
                inter = np.array([_common(sets[i], sets[j]) if part[i] != part[j] else 0 for j in c.tolist()])
            else:
                inter = np.bitwise_count(bits[c] & bits[i]).sum(1, dtype=np.int64)
            for j in c[linked(size[i], size[c], inter, percent)].tolist():
                if part[i] != part[j]:
                    part[part == max(part[i], part[j])] = min(part[i], part[j])
    return part


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """gid, id, hi, lo, part, text, sorted by gid and id -> (a, b): b is the first vertex of a's part within the group."""
        group, ids, sets, parts = None, [], [], []

        def close() -> pa.RecordBatch:
            _, first, inverse = np.unique(np.array(parts), return_index=True, return_inverse=True)
            part = confirm(sets, percent, first[inverse])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([ids[p] for p in part], pa.int64())], names=["a", "b"])

        for batch in batches:
            gid, vid, hi, lo, known = (batch.column(k).to_numpy() for k in range(5))
            for row, w in words(batch.column(5), NOT_SPACE):
                for k, s in enumerate(shingles(w, width), row):
                    if not len(s) or np.add.reduce(mix(s ^ U64(0x5851F42D4C957F2D))) != hi[k].view(U64) or np.add.reduce(mix(s ^ U64(0x14057B7EF767814F))) != lo[k].view(U64):
                        continue  # another text under the same doc_id
                    if gid[k] != group:
                        if ids:
                            yield close()
                        group, ids, sets, parts = gid[k], [], [], []
                    if not ids or vid[k] != ids[-1]:
                        ids.append(int(vid[k])), sets.append(s), parts.append(int(known[k]))
        if ids:
            yield close()

    return run


def _links(docs: DataFrame, placed: DataFrame, width: int, percent: int) -> DataFrame:
    """placed (gid, id, rep, hi, lo, part) -> confirmed links (a, b) within each group."""
    placed = cut(placed)
    ids = placed.select(F.col("rep").alias("doc_id")).distinct()
    if ids.limit(MOST_IDS + 1).count() <= MOST_IDS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    read = docs.join(placed, docs["doc_id"] == placed["rep"]).select("gid", "id", "hi", "lo", "part", "text")
    return together(read, "gid").sortWithinPartitions("gid", "id").mapInArrow(_confirm(width, percent), "a long, b long")


def _dealt(rows: Column, shingle_count: Column, block_rows: int, block_shingles: int) -> Column:
    return F.greatest(F.ceil(rows / block_rows), F.ceil(shingle_count / block_shingles)).cast("int")


def confirmed(docs: DataFrame, vertices: DataFrame, likely: DataFrame, width: int, percent: int, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The parts (id, root) that links confirmed on full sets make of the families of likely links."""
    families = connected(likely, hot_rows).withColumnRenamed("root", "family")
    members = vertices.select("id", "rep", "hi", "lo", "n").join(families, "id")
    sizes = members.groupBy("family").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    several = cut(sizes.select("family", "rows", _dealt(F.col("rows"), F.col("shingles"), block_rows, block_shingles).alias("blocks")).where("blocks > 1"))
    members = looked_up(members, several.drop("rows"), ["family"], heaviest(several, ["family"], "rows", hot_rows))
    members = cut(members.withColumn("blocks", F.coalesce("blocks", F.lit(1))))
    columns = ["gid", "id", "rep", "hi", "lo", "part"]
    gid = lambda *c: F.xxhash64(*c).alias("gid")
    own = members.select(gid("family", F.pmod(F.xxhash64("id"), "blocks")), "id", "rep", "hi", "lo", F.col("id").alias("part"))
    large = members.where("blocks > 1")
    if not large.limit(1).count():
        return cut(_links(docs, own, width, percent).select(F.col("a").alias("id"), F.col("b").alias("root")))
    pivots = large.where("id = family").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pivots = pivots.select(gid("family", F.col("b").cast("long")), "id", "rep", "hi", "lo", F.col("id").alias("part"))
    # The pivot has the least id of its family and is all that blocks share, so a part's first member names it across blocks.
    parts = cut(_links(docs, own.unionByName(pivots.select(columns)), width, percent).distinct().select(F.col("a").alias("id"), F.col("b").alias("root")))

    now = large.join(parts, "id").withColumnRenamed("root", "part")
    by_part = now.groupBy("family", "part").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    split = by_part.groupBy("family").agg(F.max(F.struct("k", "part", "s")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("k"), F.sum("s").alias("s")).where("parts > 1")
    dealt = lambda rows, shingle_count: _dealt(rows, shingle_count, block_rows, block_shingles)
    split = split.select("family", F.col("main.part").alias("main"), dealt(F.col("k"), F.col("s")).alias("all_blocks"), dealt(F.col("k") - F.col("main.k"), F.col("s") - F.col("main.s")).alias("out_blocks"))
    split = cut(split.withColumn("z", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1))))  # all_blocks is what ``blocks`` was
    open_ = cut(now.withColumn("z", F.pmod(F.xxhash64("id"), "blocks").cast("int")).join(split, ["family", "z"]))
    if not open_.limit(1).count():
        return parts
    block = lambda seed, blocks: F.pmod(F.xxhash64("id", F.lit(seed)), blocks).cast("int")
    every = open_.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1))).withColumn("y", block(1, F.col("all_blocks")))
    rest = open_.where("part <> main").withColumn("x", block(2, F.col("out_blocks"))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)))
    placed = every.unionByName(rest).select(gid("family", "x", "y"), "id", "rep", "hi", "lo", "part")
    met = _links(docs, placed, width, percent)
    of = lambda c: parts.select(F.col("id").alias(c), F.col("root").alias(f"{c}_part"))
    joined = connected(met.where("a <> b").join(of("a"), "a").join(of("b"), "b").select(F.col("a_part").alias("a"), F.col("b_part").alias("b")), hot_rows)
    joined = joined.select(F.col("id").alias("part"), F.col("root").alias("whole"))
    return cut(parts.withColumnRenamed("root", "part").join(joined, "part", "left").select("id", F.coalesce("whole", "part").alias("root")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, trees: int = TREES, node_rows: int = NODE_ROWS, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept, text_hash."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _describe(width, trees, percent)("text").alias("r")).select("doc_id", "text_hash", "r.*")
    base = cut(described)
    alive = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    vertices = base.where(alive).groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"), F.count("*").alias("copies"))
    vertices = cut(vertices.withColumn("id", F.monotonically_increasing_id()))
    parts = confirmed(docs, vertices.drop("copies"), likely_links(vertices.drop("copies"), percent, node_rows), width, percent, block_rows, block_shingles, hot_rows)

    named = parts.join(vertices.select("id", "rep"), "id")
    least = cut(named.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("members")))
    named = looked_up(named, least.drop("members"), ["root"], heaviest(least, ["root"], "members", hot_rows)).select("id", "least")
    ids = cut(vertices.select("id", "hi", "lo", "rep", "copies").join(named, "id", "left").select("hi", "lo", F.coalesce("least", "rep").alias("least"), "copies"))
    out = looked_up(base.select("doc_id", "n", "hi", "lo", "text_hash"), ids.drop("copies"), ["hi", "lo"], heaviest(ids, ["hi", "lo"], "copies", hot_rows), ~alive)
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one document of each component; all columns stay. Rows are known by doc_id and text: of rows equal in both one stays, and another text under a dropped row's id is judged by itself."""
    found = cut(near_duplicates(docs, doc_id, text, **how).select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), "kept"))
    rows = docs.select(F.col(doc_id).cast("long").alias("_i"), F.xxhash64(text).alias("_h"), F.struct("*").alias("row"))
    out = rows.join(found.where("not kept").select("_i", "_h").distinct(), ["_i", "_h"], "left_anti")
    again = cut(found.where("kept and _i is not null").groupBy("_i", "_h").count().where("count > 1").select("_i", "_h"))
    if not again.count():
        return out.select("row.*")
    once = rows.join(again, ["_i", "_h"]).dropDuplicates(["_i", "_h"])
    return out.join(again, ["_i", "_h"], "left_anti").select("row.*").unionByName(once.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), {WIDTH}) - 1), ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, g.b FROM reach JOIN g ON g.a = reach.r),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""
