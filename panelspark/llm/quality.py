"""Quality by co-training of two views.

View one is the text's content: shares of character kinds, repetition, word lengths,
and hashed word shapes (endings, and first byte with length). View two is the page's
metadata: language, source, and measures of size and layout (characters, bytes, lines,
their mean and longest length). Neither sees the other's columns.

Each view has a logistic classifier. In each round both are fitted on the labelled rows
and on the pseudo-labels they were given; then each names, among unlabelled rows, those
of which it is surest (at most ``EXCHANGE`` of the pool for each class, and only where
its calibrated confidence reaches ``SURE``), and hands them to the other. Last, each
view is calibrated by a line through its log odds on labelled rows set aside, and so is
their sum: its weights say how far each view is worth trusting.

What trains comes from bounded samples: at most MAX_DOCS labelled and POOL unlabelled
rows, of at most MAX_BYTES of text each; held-out ids are in neither. Every document is
scored, whole.

Edge cases: null and empty texts score by their (empty) features; null language or
source is a value of its own; with no labels or labels of one kind the score is that
kind's share (0.5 without labels); repeated rows give repeated results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import table
from panelspark.llm.labelled import held_out, sample_rows
from panelspark.llm.text import NOT_SPACE, U64, Words, mix, pieces

MAX_DOCS, POOL, MAX_BYTES = 6000, 3000, 25_000_000
ROUNDS, EXCHANGE, SURE = 4, 0.05, 0.95
BUCKETS = 512
#: Columns of view one before its hashed word shapes. All are shares or means: the size itself is a column of view two only.
MEASURES = 11
META_BUCKETS = 64


def content_features(w: Words, source_bytes: np.ndarray) -> np.ndarray:
    """rows x features of view one. source_bytes: the texts' bytes before lower-casing."""
    rows = len(w.first) - 1
    size = np.diff(w.first)
    row = np.repeat(np.arange(rows), size)
    out = np.zeros((rows, MEASURES + 2 * BUCKETS), np.float32)
    if not len(w.value):
        return out
    n = np.maximum(size, 1)
    per = lambda x: np.bincount(row, x, rows) / n
    length = w.end - w.start
    last, first = w.raw[w.end - 1], source_bytes[w.start]
    letters = np.concatenate(([0], np.cumsum((source_bytes >= 65) & (source_bytes <= 90))))
    low = np.concatenate(([0], np.cumsum((source_bytes >= 97) & (source_bytes <= 122))))
    marks = np.concatenate(([0], np.cumsum((source_bytes > 32) & (source_bytes < 128) & ~(((source_bytes | 32) >= 97) & ((source_bytes | 32) <= 122)) & ~((source_bytes >= 48) & (source_bytes <= 57)))))
    upper, lower, mark = letters[w.end] - letters[w.start], low[w.end] - low[w.start], marks[w.end] - marks[w.start]
    same = np.zeros(len(row))
    same[1:] = (w.value[1:] == w.value[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((w.value, row))
    v, r = w.value[order], row[order]
    new = np.concatenate(([True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])))
    out[:, 0] = per(same)
    out[:, 1] = np.bincount(r, new, rows) / n
    out[:, 2] = per((upper > 1) & (lower == 0))
    out[:, 3] = per(np.minimum(mark, 4))
    out[:, 4] = per(mark > 1)
    out[:, 5] = per(mark == length)
    out[:, 6] = per(np.minimum(length, 40)) / 10
    out[:, 7] = np.sqrt(np.maximum(per(np.minimum(length, 40) ** 2.0) / 100 - out[:, 6] ** 2, 0))
    out[:, 8] = per((last == 46) | (last == 33) | (last == 63))
    out[:, 9] = per((first >= 65) & (first <= 90))
    out[:, 10] = per(last >= 128)
    ends = w.raw[w.end - 1].astype(U64) * U64(256) + w.raw[np.maximum(w.end - 2, w.start)]
    begins = first.astype(U64) * U64(64) + np.minimum(length, 63).astype(U64)
    for k, x in enumerate((ends, begins)):
        at = row * BUCKETS + (mix(x + U64(k << 32)) >> U64(55)).astype(np.int64)
        out[:, MEASURES + k * BUCKETS : MEASURES + (k + 1) * BUCKETS] = np.sqrt(np.bincount(at, minlength=rows * BUCKETS).reshape(rows, BUCKETS) / n[:, None])
    return out


def _bucket(values: list[str | None], kind: int) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(f"{kind}{'' if v is None else '=' + v}".encode()) % META_BUCKETS for v in values], np.int64)


def page_features(lang: list[str | None], source: list[str | None], layout: np.ndarray) -> np.ndarray:
    """rows x features of view two. layout: characters, bytes, lines, longest line."""
    rows = len(lang)
    chars, size, lines, longest = np.maximum(layout.astype(float).T, 0)
    out = np.zeros((rows, 18 + 2 * META_BUCKETS), np.float32)
    out[:, 0] = np.log1p(chars) / 10
    out[:, 1] = size / np.maximum(chars, 1) - 1
    out[:, 2] = np.log1p(lines) / 5
    out[:, 3] = np.log1p(chars / np.maximum(lines, 1)) / 5
    out[:, 4] = np.log1p(longest) / 5
    out[:, 5] = longest / np.maximum(chars, 1)
    step = np.minimum((np.log2(1 + chars / np.maximum(lines, 1))).astype(int), 11)
    out[np.arange(rows), 6 + step] = 1
    for k, values in enumerate((lang, source)):
        out[np.arange(rows), 18 + k * META_BUCKETS + _bucket(values, k)] = 1
    return out


@dataclass
class Line:
    """A logistic classifier over scaled features."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 2e-4, rounds: int = 150) -> Line:
    """Adam on weighted cross-entropy over all rows."""
    mean, scale = x.mean(0), x.std(0) + 1e-2
    z = ((x - mean) / scale).astype(np.float32)
    weight, bias = np.zeros(x.shape[1], np.float32), float(np.log((y @ w + 1) / ((1 - y) @ w + 1)))
    m, v, mb, vb = np.zeros_like(weight), np.zeros_like(weight), 0.0, 0.0
    total = w.sum()
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ weight + bias, -30, 30)))
        g = ((p - y) * w / total).astype(np.float32)
        d, db = g @ z + ridge * weight, float(g.sum())
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        mb, vb = 0.9 * mb + 0.1 * db, 0.999 * vb + 0.001 * db * db
        rate = 0.05 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        weight -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        bias -= rate * mb / (vb**0.5 + 1e-8)
    return Line(mean, scale, weight, bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class CoTrained:
    content: Line | None = None
    page: Line | None = None
    join: Line | None = None
    constant: float = 0.5
    exchanged: tuple[int, int] = (0, 0)

    def score(self, content: np.ndarray, page: np.ndarray) -> np.ndarray:
        if self.join is None:
            return np.full(len(content), self.constant)
        return sigmoid(self.join.odds(np.stack([self.content.odds(content), self.page.odds(page)], 1).clip(-20, 20)).astype(float))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> CoTrained:
    """views, y: labelled rows; pool: the views of unlabelled rows."""
    if not len(y) or y.min() == y.max():
        return CoTrained(constant=float(y.mean()) if len(y) else 0.5)
    aside = np.zeros(len(y), bool)
    for kind in (0, 1):
        aside[np.flatnonzero(y == kind)[::4]] = True
    if y[~aside].min() == y[~aside].max():
        aside[:] = False
    learn, cal = ~aside, aside if aside.any() else np.ones(len(y), bool)
    given = [np.full(len(pool[0]), -1), np.full(len(pool[0]), -1)]  # pseudo-labels for each view, by the other
    lines: list[Line] = []
    for turn in range(rounds + 1):
        lines, sure = [], []
        for k in (0, 1):
            extra = given[k] >= 0
            x = np.concatenate([views[k][learn], pool[k][extra]])
            target = np.concatenate([y[learn], given[k][extra]]).astype(float)
            weight = np.concatenate([np.ones(learn.sum()), np.full(extra.sum(), 0.5)])
            line = logistic(x, target, weight)
            one = line.odds(views[k][cal]).clip(-20, 20)[:, None]
            fitted = logistic(one, y[cal].astype(float), np.ones(cal.sum()))
            lines.append(line)
            sure.append(sigmoid(fitted.odds(line.odds(pool[k]).clip(-20, 20)[:, None])) if len(pool[k]) else np.zeros(0))
        if turn == rounds:
            break
        most = int(EXCHANGE * len(pool[0]))
        for k in (0, 1):
            for kind, p in ((1, sure[k]), (0, 1 - sure[k])):
                ok = np.flatnonzero((p >= SURE) & (given[1 - k] < 0))
                given[1 - k][ok[np.argsort(-p[ok], kind="stable")[:most]]] = kind
    both = np.stack([line.odds(v[cal]) for line, v in zip(lines, views, strict=True)], 1).clip(-20, 20)
    return CoTrained(lines[0], lines[1], logistic(both, y[cal].astype(float), np.ones(cal.sum()), rounds=400), exchanged=(int((given[0] >= 0).sum()), int((given[1] >= 0).sum())))


LAYOUT = ("chars", "size", "lines", "longest")


def layout(text: Column) -> list[Column]:
    """The layout measures of view two."""
    t = F.coalesce(text, F.lit(""))
    return [F.length(t).alias("chars"), F.octet_length(t).alias("size"), (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.array_max(F.transform(F.split(t, "\n"), F.length)).alias("longest")]


def _content(texts: list[str | None]) -> np.ndarray:
    out = []
    for _, w, raw in with_raw(pa.array(texts, pa.string())):
        out.append(content_features(w, raw))
    return np.concatenate(out) if out else np.zeros((0, MEASURES + 2 * BUCKETS), np.float32)


def with_raw(col: pa.Array):
    for row, raw, bounds in pieces(col):
        yield row, Words(raw, bounds, NOT_SPACE), raw


def quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", max_docs: int = MAX_DOCS, pool: int = POOL, max_bytes: int = MAX_BYTES) -> CoTrained:
    """Fitted in one task over the two bounded samples; only the fitted weights come to the driver."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"), *layout(F.col(text)))
    columns = ["lang", "source", *LAYOUT]
    known = sample_rows(docs, labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias(label)), label, columns, max_docs, max_bytes)
    free = docs.select("doc_id").join(labels.select(F.col(doc_id).alias("doc_id")).distinct(), "doc_id", "left_anti").withColumn("y", F.lit(0))
    unknown = sample_rows(docs, free, "y", columns, pool, max_bytes)
    fields = ["_place", "_y", "text", F.col("lang").cast("string"), F.col("source").cast("string"), *LAYOUT]
    rows = known.select(F.lit(0).alias("pool"), *fields).unionByName(unknown.select(F.lit(1).alias("pool"), *fields))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted_on(got))], pa.binary())], names=["model"])

    made = rows.repartition(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(made[0].model) if made else co_train((_content([]), _page([])), np.zeros(0, int), (_content([]), _page([])))


def _page(rows: list[tuple]) -> np.ndarray:
    return page_features([r[4] for r in rows], [r[5] for r in rows], np.array([r[6:] for r in rows]).reshape(-1, 4))


def fitted_on(rows: list[tuple]) -> CoTrained:
    """The classifier of sampled rows (pool, place, label, text, lang, source, layout), the labelled ones first."""
    known, unknown = ([r for r in rows if r[0] == k] for k in (0, 1))
    views = lambda part: (_content([r[3] for r in part]), _page(part))
    return co_train(views(known), np.array([r[2] for r in known], int), views(unknown))


def quality(docs: DataFrame, model: CoTrained, text: str = "text", lang: str = "lang", source: str = "source") -> Column:
    """The score (0 to 1, higher: better) of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    @F.arrow_udf("double")
    def score(t: pa.Array, lang: pa.Array, source: pa.Array, *measures: pa.Array) -> pa.Array:
        shape = np.stack([m.to_numpy(zero_copy_only=False) for m in measures], 1)
        lang, source, out = lang.to_pylist(), source.to_pylist(), []
        for row, w, raw in with_raw(t):
            rows = slice(row, row + len(w.first) - 1)
            out.append(sent.value.score(content_features(w, raw), page_features(lang[rows], source[rows], shape[rows])))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score(docs[text], docs[lang].cast("string"), docs[source].cast("string"), *layout(docs[text]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), quality(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
