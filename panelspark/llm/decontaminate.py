"""Benchmark decontamination by Wu-Manber multi-pattern search.

A window is ``width`` consecutive words of an item; an item of fewer words, but
not none, is one window. The windows are the patterns, words the alphabet:

* patterns of one length form an automaton. A shift table, indexed by a hash of
  a block of two words (one for patterns of one word), says how far a position
  may jump; most jumps skip nearly a whole pattern;
* where the shift is 0, the hash of the last block picks a bucket of patterns;
* word values of those patterns are compared with the text's, and what agrees is
  compared byte by byte before it counts.

Texts are scanned as many lanes of ``LANE`` words side by side, so each step is a
few numpy calls over all lanes. The benchmark's windows are built into blocks of at
most ``BLOCK_WINDOWS`` windows by tasks, and written to the shared folder. A worker
holds one block at a time: with several blocks it takes a batch of texts through each
in turn. So neither the driver nor a worker ever holds the whole benchmark, whatever
its size, and time grows with texts times blocks. There is no shuffle.

Item ids may be of any type; they are carried as text. Edge cases: null or empty texts have no words and no hits; null or wordless items
have no windows; items with equal ids count once; null item ids are left out;
repeated rows give repeated results; an empty benchmark gives no hits.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import fresh_dir, table
from panelspark.llm.text import ALNUM, U64, Words, ramp, words

WIDTH = 13
LANE = 64
BLOCK_WINDOWS = 250_000


class Automaton:
    """Wu-Manber tables for word patterns of one length. ``texts[i]``: pattern i in bytes."""

    def __init__(self, patterns: np.ndarray, texts: list[bytes]):
        self.patterns, self.texts = patterns, texts
        n, self.m = patterns.shape
        self.b = 1 if self.m == 1 else 2
        self.bits = max(10, min(22, int(n * self.m * 4).bit_length()))
        most = self.m - self.b + 1
        self.shift = np.full(1 << self.bits, most, np.int32)
        for end in range(self.b - 1, self.m):
            np.minimum.at(self.shift, self.block(patterns, end), self.m - 1 - end)
        last = self.block(patterns, self.m - 1)
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.searchsorted(last[self.order], np.arange((1 << self.bits) + 1))

    def block(self, a: np.ndarray, end: int) -> np.ndarray:
        return self.hash(a[:, end], a[:, end - 1] if self.b == 2 else None)

    def hash(self, last: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        x = last if before is None else last * U64(0x9E3779B97F4A7C15) + before
        return ((x ^ (x >> U64(29))) * U64(0xD6E8FEB86659FD93) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, first word) of all occurrences. Each lane tries the windows that end in its own words."""
        size = np.diff(w.first)
        rows = np.flatnonzero(size >= self.m)
        lanes = -(-(size[rows] - self.m + 1) // LANE)
        pos = np.repeat(w.first[rows], lanes) + ramp(lanes) * LANE + self.m - 1
        stop = np.minimum(pos + LANE, np.repeat(w.first[rows] + size[rows], lanes))
        v, found, at = w.value, [], []
        while len(pos):
            key = self.hash(v[pos], v[pos - 1] if self.b == 2 else None)
            jump = self.shift[key]
            hit = np.flatnonzero(jump == 0)
            if len(hit):
                lo = self.bucket[key[hit]]
                count = self.bucket[key[hit] + 1] - lo
                cand = self.order[np.repeat(lo, count) + ramp(count)]
                where = np.repeat(pos[hit], count) - self.m + 1
                for k in range(self.m - 1, -1, -1):
                    same = self.patterns[cand, k] == v[where + k]
                    cand, where = cand[same], where[same]
                found.append(cand)
                at.append(where)
            pos = pos + np.maximum(jump, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cand, where = np.concatenate(found), np.concatenate(at)
        same = np.fromiter((w.text(i, i + self.m) == self.texts[p] for p, i in zip(cand.tolist(), where.tolist(), strict=True)), bool, len(cand))
        return cand[same], where[same]


class Block:
    """The automata of some windows, by pattern length, each with the item ids of its patterns."""

    def __init__(self, windows: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]]):
        self.automata = [(Automaton(np.array([v for v, _ in p.values()], U64), list(p)), [sorted(s) for _, s in p.values()]) for _, p in sorted(windows.items())]


def write_blocks(benchmark: DataFrame, item_id: str, text: str, width: int, block_windows: int) -> tuple[str, list[str]]:
    """Builds the blocks in tasks and writes each to a file of the shared folder: the folder and the files' names.

    A block has at most ``block_windows`` windows; a long item is spread over several. Only names come to the driver.
    A task that runs again writes files of other names, so nothing is ever overwritten.
    """
    folder = fresh_dir(benchmark.sparkSession, "benchmark-blocks")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]] = {}
        held = 0

        def close() -> pa.RecordBatch:
            fs, to = pafs.FileSystem.from_uri(folder)
            fs.create_dir(to, recursive=True)
            name = f"{uuid.uuid4().hex}.block"
            with fs.open_output_stream(f"{to}/{name}") as out:
                out.write(pickle.dumps(Block(windows)))
            windows.clear()
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, w in words(batch.column(1), ALNUM):
                for k in range(len(w.first) - 1):
                    begin, n = int(w.first[k]), int(w.first[k + 1] - w.first[k])
                    m = min(width, n)
                    for i in range(begin, begin + n - m + 1 if m else begin):
                        known = windows.setdefault(m, {})
                        key = w.text(i, i + m)
                        held += key not in known
                        known.setdefault(key, (w.value[i : i + m].copy(), set()))[1].add(ids[row + k])
                        if held >= block_windows:
                            yield close()
                            held = 0
        if windows:
            yield close()

    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    return folder, sorted(r.name for r in items.mapInArrow(build, "name string").collect())


#: Where there are several blocks, a worker takes so many bytes of texts through one after the other.
GROUP_BYTES = 64 << 20

_open: dict[str, Block] = {}


def _block(folder: str, name: str) -> Block:
    """A block from its file. A worker holds one block at a time, and reads it again only if there are several."""
    key = f"{folder}/{name}"
    if key not in _open:
        _open.clear()
        fs, where = pafs.FileSystem.from_uri(folder)
        with fs.open_input_file(f"{where}/{name}") as f:
            _open[key] = pickle.loads(f.read())
    return _open[key]


_FOUND = "struct<n_words:long,n_hit:long,n_items:long,items_sha256:string,item_ids:array<string>,span_start:array<int>,span_end:array<int>>"


class _Hits:
    """What was found in one batch of texts: their words, the runs of hit words over all blocks, the items."""

    def __init__(self, col: pa.Array):
        self.col = col
        self.n_words = np.zeros(len(col), np.int64)
        self.found: dict[int, set[str]] = {}
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def take(self, automata) -> None:
        for row, w in words(self.col, ALNUM):
            self.n_words[row : row + len(w.first) - 1] = np.diff(w.first)
            delta, rows = np.zeros(len(w.value) + 1, np.int32), set()
            for auto, ids in automata:
                cand, where = auto.find(w)
                np.add.at(delta, where, 1)
                np.add.at(delta, where + auto.m, -1)
                for r, p in zip((np.searchsorted(w.first, where, "right") - 1).tolist(), cand.tolist(), strict=True):
                    rows.add(r)
                    self.found.setdefault(row + r, set()).update(ids[p])
            hit = np.cumsum(delta)[:-1] > 0
            for r in rows:
                edge = np.diff(np.concatenate(([0], hit[w.first[r] : w.first[r + 1]].view(np.int8), [0])))
                self.runs.setdefault(row + r, []).extend(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))

    def result(self) -> pa.StructArray:
        out = []
        for k, n in enumerate(self.n_words.tolist()):
            spans: list[list[int]] = []
            for a, b in sorted(self.runs.get(k, ())):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            ids = sorted(self.found.get(k, ()))
            out.append((n, sum(b - a for a, b in spans), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), ids, [a for a, _ in spans], [b for _, b in spans]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names_ = ["n_words", "n_hit", "n_items", "items_sha256", "item_ids", "span_start", "span_end"]
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names_)


def _search(folder: str, names: list[str], group_bytes: int):
    def through(group: list[pa.Array]) -> Iterator[pa.StructArray]:
        hits = [_Hits(col) for col in group]
        for name in names or [None]:
            for h in hits:
                h.take(_block(folder, name).automata if name else ())
        return (h.result() for h in hits)

    @F.arrow_udf(_FOUND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Blocks outside, batches inside: a block is opened once for a group of batches, of ``group_bytes`` of texts. A single block stays open, so batches then go through one by one."""
        group, held = [], 0
        for col in batches:
            group.append(col)
            held += col.nbytes
            if len(names) < 2 or held >= group_bytes:
                yield from through(group)
                group, held = [], 0
        yield from through(group)

    return search


def contamination(spark: SparkSession, text: Column, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_windows: int = BLOCK_WINDOWS, group_bytes: int = GROUP_BYTES) -> Column:
    """A struct column for a text column: n_words, n_hit, n_items, items_sha256, item_ids (as text), span_start and span_end (runs of hit words), contaminated."""
    found = _search(*write_blocks(benchmark, item_id, item_text, width, block_windows), group_bytes)(text)
    fields = ["n_words", "n_hit", "n_items", "items_sha256", "item_ids", "span_start", "span_end"]
    return F.struct(*[found[f].alias(f) for f in fields], ((found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs without the contaminated rows; all columns stay."""
    flag = contamination(docs.sparkSession, docs[text], benchmark, **how)["contaminated"]
    return docs.where(~flag)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = contamination(spark, docs["text"], table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", found.alias("r")).select("doc_id", "r.n_words", "r.n_hit", "r.n_items", "r.items_sha256", "r.contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS m, list_slice(w, i, i + least(len(w), {WIDTH}) - 1) AS p
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
pos AS (SELECT doc_id, m, i, list_slice(w, i, i + m - 1) AS p FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
occ AS (SELECT doc_id, item_id, i, m FROM pos JOIN win USING (m, p)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM occ) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
