"""Spelling variants: pairs of words one edit apart, by composing finite-state machines.

Words are runs of letters with counts over all texts; of every word, the most frequent
near word that is ``RATIO`` times as frequent is its form, and following forms to the last
gives its root.

A pair (x, y) with y of x's length or one longer is accepted by the composition of the
vocabulary's acceptor, a transducer that replaces or inserts exactly one code point, and the
acceptor again. The composition is not built over the whole vocabulary: where the edit lies
in a range [lo, hi) of x, both words have the same first lo and last code points. These two
name an initial state of the composition, from which only the middle parts are left to read.
So words are dealt to initial states: each to the edits in its first half and in its second
half, both as the shorter word and as the longer one: four rows a word.

* ``Machines`` holds the minimised acceptors of middle parts, states interned by their arcs,
  so that equal ends are one state in all partitions of a task. States count the words they
  accept, so a word is known by its rank, and results are runs of ranks: (i, j, length).
* Before the edit both tapes have read the same, so a replacement starts at (s, s) and goes on
  from (s by a, s by b) to the words that both ends accept; that is found once for a pair of
  states. An insertion starts at (p, q), and stays where it is at p.
* Of an insertion beside equal letters there are several alignments; only that with the
  inserted one as far left as it goes is accepted, and only in the range it falls into. So
  each pair is accepted once, in one partition, and near words can be counted by sums.
* A partition of more than ``MOST`` words is split: its words go on to the two halves of its
  range, in a next round. Ranges of one code point aren't split: what such a partition holds
  is bounded by the alphabet. A task holds one partition of at most that size.

A partition returns for its words the number of near ones and the best, never the pairs.
Counting is pre-aggregated in each Arrow batch; runs and partial counts are exact (no hashes).

Edge cases: null and empty texts have no words; a null doc_id reads as an empty one in the
hash that marks deletions; repeated rows count as often as they come; runs and words may be
of any length; no words, no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import cut, table
from panelspark.llm.text import LOWER, pieces, ramp

LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
MODULUS = 199
MOST = 4096
MOST_STATES = 200_000
LONG = 64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True  # 0xC3 begins U+00C0 to U+00FF, and nothing else


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (t & np.uint32(1)))
    return t


_CRC = _crc_table()


def crc_after(states: np.ndarray, low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc32 of what led to ``states`` followed by low[start : start + size], for many at once."""
    order = np.argsort(-size, kind="stable")
    s, at, n = states[order] ^ np.uint32(0xFFFFFFFF), start[order], size[order]
    for j in range(int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(-n, -j))  # so many are longer than j
        s[:k] = _CRC[(s[:k] ^ low[at[:k] + j]) & np.uint32(0xFF)] ^ (s[:k] >> np.uint32(8))
    out = np.empty_like(s)
    out[order] = s ^ np.uint32(0xFFFFFFFF)
    return out


def _strings(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    data = low[np.repeat(start, size) + ramp(size)]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data))


def runs_of(raw: np.ndarray, bounds: np.ndarray, ids: list[str], least_chars: int, modulus: int) -> tuple[pa.Array, list[str]]:
    """The lower-cased runs of at least least_chars code points of some rows; those that the hash marks apart, shortened by one."""
    lead = raw == 0xC3
    letter = _LETTER[raw]
    letter[1:] |= lead[:-1]
    edge = bounds[1:-1][bounds[1:-1] < len(raw)]
    before, after = np.append(False, letter[:-1]), np.append(letter[1:], False)
    before[edge], after[edge - 1] = False, False
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    leads = np.concatenate(([0], np.cumsum(lead)))
    chars = end - start - (leads[end] - leads[start])
    ok = chars >= least_chars
    start, size, chars = start[ok], (end - start)[ok], chars[ok]
    low = LOWER[raw]
    row = np.searchsorted(bounds, start, "right") - 1
    states = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)[row]
    crc = np.empty(len(start), np.uint32)
    short = size <= LONG
    crc[short] = crc_after(states[short], low, start[short], size[short])
    for k in np.flatnonzero(~short).tolist():
        crc[k] = zlib.crc32(low[start[k] : start[k] + size[k]], int(states[k]))
    marked = crc % np.uint32(modulus) == 0
    cut_ones = []
    for k in np.flatnonzero(marked & (chars > least_chars)).tolist():
        run = low[start[k] : start[k] + size[k]].tobytes().decode()
        at = int(crc[k]) % len(run)
        cut_ones.append(run[:at] + run[at + 1 :])
    return _strings(low, start[~marked], size[~marked]), cut_ones


def _counts(least_chars: int, modulus: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, text -> word, n: the counts of each batch."""
        for batch in batches:
            ids, parts = batch.column(0).fill_null("").to_pylist(), []
            for row, raw, bounds in pieces(batch.column(1)):
                if len(raw):
                    whole, shortened = runs_of(raw, bounds, ids[row : row + len(bounds) - 1], least_chars, modulus)
                    parts += [whole, pa.array(shortened, pa.string())]
            if parts:
                found = pc.value_counts(pa.concat_arrays(parts))
                yield from pa.table({"word": found.field(0), "n": found.field(1)}).to_batches(max_chunksize=20_000)

    return run


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, modulus: int = MODULUS) -> DataFrame:
    """word, n: the distinct words of at least least_chars code points that come at least least_count times."""
    rows = docs.select(F.col(doc_id).cast("string").alias("i"), F.col(text).alias("t"))
    counts = rows.mapInArrow(_counts(least_chars, modulus), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Machines:
    """Minimised acceptors of words of one length each, over one register of states. State 0 accepts the empty word."""

    def __init__(self):
        self.register: dict[tuple, int] = {(): 0}
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]  # letter: (state, words before it)
        self.count = [1]
        self.shared: dict[tuple[int, int], list] = {}
        self.replaced: dict[int, list] = {0: []}

    def state(self, arcs: list[tuple[str, int]]) -> int:
        key = tuple(arcs)
        s = self.register.get(key)
        if s is None:
            s = self.register[key] = len(self.arcs)
            own, n = {}, 0
            for a, p in arcs:
                own[a] = (p, n)
                n += self.count[p]
            self.arcs.append(own)
            self.count.append(n)
        return s

    def accept(self, words: list[str]) -> int:
        """The state that accepts just these words: distinct, sorted, of one length. Ends are interned as soon as no further word can change them."""
        path: list[list[tuple[str, int]]] = [[] for _ in range(len(words[0]) + 1)]
        last = ""
        for w in words:
            k = 0
            while k < len(last) and last[k] == w[k]:
                k += 1
            for d in range(len(last) - 1, k - 1, -1):
                path[d].append((last[d], self.state(path[d + 1])))
                path[d + 1] = []
            last = w
        for d in range(len(last) - 1, -1, -1):
            path[d].append((last[d], self.state(path[d + 1])))
        return self.state(path[0])

    def common(self, p: int, q: int) -> list[tuple[int, int, int]]:
        """Runs of the words that both states accept: (rank at p, rank at q, how many)."""
        if p == q:
            return [(0, 0, self.count[p])]
        out = self.shared.get((p, q))
        if out is None:
            out, stack = [], [(p, q, 0, 0)]
            while stack:
                p1, q1, i, j = stack.pop()
                if p1 == q1:
                    out.append((i, j, self.count[p1]))
                    continue
                other = self.arcs[q1]
                for a, (p2, k) in self.arcs[p1].items():
                    if a in other:
                        stack.append((p2, other[a][0], i + k, j + other[a][1]))
            self.shared[p, q] = out
        return out

    def replacements(self, root: int) -> list[tuple[int, int, int]]:
        """Runs of the pairs of a state's words that differ in one letter, each pair once."""
        stack = [root]
        while stack:
            s = stack[-1]
            own = list(self.arcs[s].values())
            missing = [p for p, _ in own if p not in self.replaced]
            if s not in self.replaced and missing:
                stack += missing
                continue
            stack.pop()
            if s in self.replaced:
                continue
            if len(own) == 1:
                self.replaced[s] = self.replaced[own[0][0]]
                continue
            out = []
            for k, (p, i) in enumerate(own):
                out += [(u + i, v + i, m) for u, v, m in self.replaced[p]]
                for q, j in own[k + 1 :]:
                    out += [(u + i, v + j, m) for u, v, m in self.common(p, q)]
            self.replaced[s] = out
        return self.replaced[root]

    def insertions(self, p: int, q: int, inner: bool) -> list[tuple[int, int, int]]:
        """Runs of the pairs (word of p, word of q) where one letter more makes the one the other; inner: not before the first letter."""
        out, stack = [], [(p, q, 0, 0, "", inner)]
        while stack:
            p, q, i, j, last, no = stack.pop()
            own = self.arcs[p]
            for b, (q2, k) in self.arcs[q].items():
                if b != last and not no:
                    out += [(u + i, v + j + k, m) for u, v, m in self.common(p, q2)]
                if b in own:
                    p2, k2 = own[b]
                    stack.append((p2, q2, i + k2, j + k, b, False))
        return out


def _key(size: int | Column, head: Column, tail: Column) -> Column:
    return F.concat_ws("|", size.cast("string"), head, tail)


def _dealt(vocab: DataFrame, least_chars: int) -> DataFrame:
    """Each word under its initial states: key (length of the shorter word, what stands before and after the range), longer, mid, n."""
    rows = []
    for longer in (0, 1):
        size = F.char_length("word") - longer
        half = F.expr(f"(char_length(word) - {longer}) div 2").cast("int")
        none, w = F.lit(""), F.col("word")
        head, rest = F.substring(w, F.lit(1), half), F.substring(w, half + 1, F.char_length("word"))
        start, tail = F.substring(w, F.lit(1), half + longer), F.substring(w, half + 1 + longer, F.char_length("word"))
        rows.append(F.struct(_key(size, none, tail).alias("key"), F.lit(longer).alias("longer"), start.alias("mid"), size.alias("size")))
        rows.append(F.struct(_key(size, head, none).alias("key"), F.lit(longer).alias("longer"), rest.alias("mid"), size.alias("size")))
    each = vocab.select("n", F.explode(F.array(*rows)).alias("r"))
    return each.where(F.col("r.size") >= least_chars).select("r.key", "r.longer", "r.mid", "n")


_OUT = "key string, longer int, mid string, n long, word string, n_near long, form string, form_n long"
_NAMES = [f.split()[0] for f in _OUT.split(", ")]
_KINDS = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def halves(key: str, rows: list[tuple[int, str, int]]) -> Iterator[tuple]:
    """A partition's rows under the two halves of its range."""
    size, head, tail = key.split("|")
    h = (int(size) - len(head) - len(tail)) // 2
    for longer, mid, n in rows:
        yield f"{size}|{head}|{mid[h + longer :]}{tail}", longer, mid[: h + longer], n
        yield f"{size}|{head}{mid[:h]}|{tail}", longer, mid[h:], n


def partition_pairs(m: Machines, key: str, rows: list[tuple[int, str, int]]) -> Iterator[tuple]:
    """word, n_near, form, form_n of the partition's words that have near words in it. rows: longer, mid, n, sorted."""
    _, head, tail = key.split("|")
    k = sum(not r[0] for r in rows)
    if not k or len(rows) < 2:
        return
    p = m.accept([r[1] for r in rows[:k]])
    runs = [(u, v, c) for u, v, c in m.replacements(p)] if k > 1 else []
    if k < len(rows):
        runs += [(u, v + k, c) for u, v, c in m.insertions(p, m.accept([r[1] for r in rows[k:]]), bool(head))]
    if not runs:
        return
    words = [f"{head}{r[1]}{tail}" for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][2], words[i]))
    rank = [0] * len(rows)
    for place, i in enumerate(order):
        rank[i] = place
    near, best = [0] * len(rows), [len(rows)] * len(rows)
    for u, v, c in runs:
        for i, j in zip(range(u, u + c), range(v, v + c), strict=True):
            near[i] += 1
            near[j] += 1
            best[i] = min(best[i], rank[j])
            best[j] = min(best[j], rank[i])
    for i, c in enumerate(near):
        if c:
            f = order[best[i]]
            yield words[i], c, words[f], rows[f][2]


def _enumerate(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key, longer, mid, n, sorted -> the results of small partitions, and the rows of large ones under their halves."""
        m, now, held, over, out = Machines(), None, [], False, []

        def settle() -> None:
            nonlocal m
            if held and over:
                out.extend((*r, None, None, None, None) for r in halves(now, held))
            elif held:
                out.extend((None, None, None, None, *r) for r in partition_pairs(m, now, held))
            if len(m.arcs) > MOST_STATES or len(m.shared) > MOST_STATES:
                m = Machines()
            held.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(_NAMES)
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=_NAMES)
            out.clear()
            return done

        for batch in batches:
            for key, longer, mid, n in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                if key != now:
                    settle()
                    now, over = key, False
                held.append((longer, mid, n))
                if len(held) > most and len(mid) - longer > 1:
                    over = True
                    settle()
                if len(out) >= 20_000:
                    yield flush()
        settle()
        yield flush()

    return run


def near_words(vocab: DataFrame, least_chars: int = LEAST_CHARS, most: int = MOST) -> DataFrame:
    """word, n, n_near, best, best_n of all words of vocab (word, n): how many are one edit away, and the most frequent of them (ties: the first in code-point order)."""
    todo, results = _dealt(vocab, least_chars), []
    while True:
        made = cut(todo.repartition("key").sortWithinPartitions("key", "longer", "mid").mapInArrow(_enumerate(most), _OUT))
        results.append(made.where("word is not null").select("word", F.lit(None).cast("long").alias("n"), "n_near", "form", "form_n"))
        todo = made.where("word is null").select("key", "longer", "mid", "n")
        if todo.isEmpty():
            break
    rows = vocab.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    for r in results:
        rows = rows.unionByName(r)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    all_ = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return all_.select("word", "n", "n_near", F.col("best.form").alias("best"), (-F.col("best.less")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """links (word, form) without cycles -> (word, root). Every round doubles how far each word has followed the forms; words that have arrived leave."""
    links = cut(links)
    at, done = links.select("word", F.col("form").alias("to")), []
    jumps = links.select(F.col("word").alias("w"), F.col("form").alias("next"))
    while True:
        step = cut(at.join(jumps, F.col("to") == F.col("w"), "left").select("word", "to", "next"))
        done.append(step.where("next is null").select("word", F.col("to").alias("root")))
        at = step.where("next is not null").select("word", F.col("next").alias("to"))
        if at.isEmpty():
            break
        twice = jumps.join(jumps.select(F.col("w").alias("v"), F.col("next").alias("after")), F.col("next") == F.col("v"), "left")
        jumps = cut(twice.select("w", F.coalesce("after", "next").alias("next")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, modulus: int = MODULUS, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    vocab = cut(vocabulary(docs, doc_id, text, least_chars, least_count, modulus))
    found = near_words(vocab, least_chars, most)
    has = F.col("best_n") >= ratio * F.col("n")
    words = cut(found.select("word", F.when(has, F.col("best")).alias("form"), "n", "n_near", F.when(has, F.col("best_n")).alias("form_n")))
    last = roots(words.where("form is not null").select("word", "form"))
    return words.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= {LEAST_CHARS} GROUP BY 1, 2),
bytes AS (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda s, b: xor(s // 256, t[xor(s % 256, b)::INT + 1])), 4294967295) AS h FROM bytes, crc),
v AS (SELECT CASE WHEN h % {MODULUS} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= {LEAST_CHARS} AND sum(k) >= {LEAST_COUNT}),
del AS (SELECT word, n, i, left(word, (i - 1)::INT) || '|' || substr(word, (i + 1)::INT) AS gap FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM del a JOIN del b ON a.gap = b.gap AND a.word <> b.word),
i AS (SELECT DISTINCT s.word AS short, s.n AS short_n, d.word AS long, d.n AS long_n FROM del d JOIN v s ON replace(d.gap, '|', '') = s.word),
near AS (SELECT * FROM p UNION ALL SELECT short, long, long_n FROM i UNION ALL SELECT long, short, short_n FROM i),
best AS (SELECT word, count(*) AS n_near, min({{'less': -m, 'other': other}}) AS b FROM near GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= {RATIO} * v.n THEN b.other END AS form, CASE WHEN -b.less >= {RATIO} * v.n THEN -b.less END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS r, 1 AS d FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form, d + 1 FROM walk JOIN f ON f.word = walk.r WHERE f.form IS NOT NULL)
SELECT f.word, f.form, coalesce((SELECT arg_max(r, d) FROM walk WHERE walk.word = f.word), f.word) AS root, f.n, f.n_near, f.form_n FROM f
"""
