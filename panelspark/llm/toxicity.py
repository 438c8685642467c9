"""Toxicity by a convolutional text classifier, trained here in numpy.

A word's embedding is the sum of the rows that its hash and the hashes of its first
4, 5 and 6 bytes pick in four tables, so an unseen form of a known stem has most of
it. Filters of widths 1, 2 and 3 slide over the words of the whole text; the maximum
of each over the text, cut at zero, goes through a linear layer to a score from 0 to 1.

Training: Adagrad on cross-entropy over a bounded sample of labelled rows (at most
MAX_DOCS rows and MAX_BYTES of text; held-out ids never). A part of that sample is set
aside for calibration: it fits one scale and offset for the scores, and for each
language the threshold that gives the best F1 there (the common threshold where a
language has few labelled rows). Only those thresholds know the language; the score is
a function of the text alone.

Edge cases: null and empty texts have no words and get the score of the biases; with
no labels, or labels of one kind only, every score is that kind's share (0 without
labels); repeated rows give repeated results; a null language has the common threshold.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import table
from panelspark.llm.labelled import held_out, sample_rows
from panelspark.llm.text import ALNUM, U64, Words, words

MAX_DOCS, MAX_BYTES = 5000, 16_000_000
BUCKETS = 15
DIM, FILTERS, WIDTHS = 16, 8, (1, 2, 3)
STEMS = (4, 5, 6)
EPOCHS, BATCH, BATCH_WORDS = 5, 16, 20_000
FEW = 40
#: Words whose filter responses are held at once when texts are scored.
STEP = 8192


def word_ids(w: Words) -> np.ndarray:
    """For each word, its rows in the table of all embeddings."""
    kinds = [w.value, *map(w.prefix, STEMS)]
    return np.stack([(v >> U64(64 - BUCKETS)).astype(np.int32) + (k << BUCKETS) for k, v in enumerate(kinds)], 1)


@dataclass
class Net:
    table: np.ndarray
    filters: np.ndarray  # DIM x (for each width, for each place in it: FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    offset: float = 0.0
    constant: float | None = None
    threshold: float = 0.5
    by_lang: dict[str, float] = field(default_factory=dict)

    @classmethod
    def new(cls, rng: np.random.Generator) -> Net:
        n = len(WIDTHS) * FILTERS
        f32 = lambda x: x.astype(np.float32)
        return cls(f32(rng.normal(0, 0.1, ((1 + len(STEMS)) << BUCKETS, DIM))), f32(rng.normal(0, 0.3, (DIM, sum(WIDTHS) * FILTERS))), np.zeros(n, np.float32), f32(np.abs(rng.normal(0.5, 0.1, n))), -2.0)

    def embed(self, ids: np.ndarray) -> np.ndarray:
        e = self.table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            e += self.table[ids[:, k]]
        return e

    def responses(self, e: np.ndarray, left: np.ndarray) -> np.ndarray:
        """words x filters. left: words from this one to its text's end; past it is zero."""
        raw = e @ self.filters
        out, at = np.empty((len(e), len(WIDTHS) * FILTERS), np.float32), 0
        for k, width in enumerate(WIDTHS):
            r = raw[:, at : at + FILTERS].copy()
            for j in range(1, width):
                r[:-j] += raw[j:, at + j * FILTERS : at + (j + 1) * FILTERS] * (left[:-j, None] > j)
            out[:, k * FILTERS : (k + 1) * FILTERS] = r
            at += width * FILTERS
        return out

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The maxima are taken over STEP words at a time, so memory doesn't grow with the texts."""
        size = np.diff(first)
        pooled = np.full((len(size), len(self.bias)), -np.inf, np.float32)
        left = np.repeat(first[1:], size) - np.arange(len(ids))
        for a in range(0, len(ids), STEP):
            z, more = a + STEP, a + STEP + max(WIDTHS) - 1
            r = self.responses(self.embed(ids[a:more]), left[a:more])[:STEP]
            rows = np.flatnonzero((size > 0) & (first[:-1] < z) & (first[1:] > a))
            pooled[rows] = np.maximum(pooled[rows], np.maximum.reduceat(r, np.maximum(first[rows] - a, 0), axis=0))
        pooled[size == 0] = 0
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(ids, first).astype(float) + self.offset, -30, 30)))


def batches(docs: list[np.ndarray], order: Iterable[int]) -> Iterator[list[int]]:
    """Places of documents, at most BATCH of them and BATCH_WORDS words together; a longer one stands alone."""
    held, n = [], 0
    for i in order:
        if held and (len(held) == BATCH or n + len(docs[i]) > BATCH_WORDS):
            yield held
            held, n = [], 0
        held.append(i)
        n += len(docs[i])
    if held:
        yield held


def _train(docs: list[np.ndarray], y: np.ndarray, epochs: int, seed: int) -> Net:
    rng = np.random.Generator(np.random.PCG64(seed))
    net = Net.new(rng)
    weight = np.where(y == 1, min(4.0, max(1.0, (len(y) - y.sum()) / max(1, y.sum()) / 2)), 1.0)
    seen = {k: np.full(getattr(net, k).shape, 1e-3, np.float32) for k in ("filters", "bias", "out")}
    seen_rows, seen_bias = np.full(len(net.table), 1e-3, np.float32), 1e-3
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        rate = 0.08 * (1 - epoch / epochs) + 0.01
        for pick in batches(docs, (i for i in order.tolist() if len(docs[i]))):
            ids = np.concatenate([docs[i] for i in pick])
            size = np.array([len(docs[i]) for i in pick])
            first = np.concatenate(([0], np.cumsum(size)))
            left = np.repeat(first[1:], size) - np.arange(len(ids))
            e = net.embed(ids)
            r = net.responses(e, left)
            top = np.stack([r[a:z].argmax(0) + a for a, z in zip(first[:-1], first[1:], strict=True)])  # text x filter
            pre = np.take_along_axis(r, top, 0) + net.bias
            act = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ net.out + net.out_bias, -30, 30)))
            g = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            g_act = (g[:, None] * net.out) * (pre > 0)
            d_filters, d_rows, rows = np.zeros_like(net.filters), [], []
            col = 0
            for k, width in enumerate(WIDTHS):
                at, grad = top[:, k * FILTERS : (k + 1) * FILTERS], g_act[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(width):
                    ok = (left[at] > j) * grad
                    where = np.minimum(at + j, len(ids) - 1)
                    cols = slice(col, col + FILTERS)
                    d_filters[:, cols] = np.einsum("tf,tfd->df", ok, e[where])
                    used = ok != 0
                    rows.append(where[used])
                    d_rows.append(ok[used][:, None] * net.filters[:, cols].T[np.nonzero(used)[1]])
                    col += FILTERS
            for k, d in (("filters", d_filters), ("bias", g_act.sum(0)), ("out", act.T @ g)):
                seen[k] += d * d
                getattr(net, k)[...] -= rate * d / np.sqrt(seen[k])
            seen_bias += float(g.sum()) ** 2
            net.out_bias -= rate * float(g.sum()) / seen_bias**0.5
            where, d = np.concatenate(rows), np.concatenate(d_rows)
            if len(where):
                flat, inv = np.unique(ids[where].ravel(), return_inverse=True)
                total = np.zeros((len(flat), DIM), np.float32)
                np.add.at(total, inv, np.repeat(d, ids.shape[1], 0))
                seen_rows[flat] += (total * total).mean(1)
                net.table[flat] -= rate * total / np.sqrt(seen_rows[flat])[:, None]
    return net


def _scores(net: Net, docs: list[np.ndarray]) -> np.ndarray:
    """The scores of some documents, a few at a time."""
    out = []
    for pick in batches(docs, range(len(docs))):
        part = [docs[i] for i in pick]
        out.append(net.scores(np.concatenate(part), np.concatenate(([0], np.cumsum([len(d) for d in part])))))
    return np.concatenate(out) if out else np.zeros(0)


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1, halfway to the next lower score; 0.5 if there is nothing to find."""
    if not y.any():
        return 0.5
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores can't be told apart
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def fit(rows: list[tuple[str | None, str | None, int]], epochs: int = EPOCHS, seed: int = 3) -> Net:
    """rows: (text, language, label). Every fifth row calibrates."""
    y = np.array([r[2] for r in rows], float)
    if not len(rows) or y.min() == y.max():
        net = Net.new(np.random.Generator(np.random.PCG64(seed)))
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    docs: list[np.ndarray] = []
    for _, w in words(pa.array([r[0] for r in rows], pa.string()), ALNUM):
        ids = word_ids(w)
        docs += [ids[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    aside = np.zeros(len(rows), bool)
    for kind in (0, 1):
        aside[np.flatnonzero(y == kind)[::5]] = True
    learn = np.flatnonzero(~aside) if y[~aside].any() else np.arange(len(rows))
    net = _train([docs[i] for i in learn], y[learn], epochs, seed)
    cal = np.flatnonzero(aside)
    score = _scores(net, [docs[i] for i in cal])
    if len(cal) >= FEW:  # the best common threshold becomes a score of one half
        t = float(np.clip(best_threshold(score, y[cal]), 0.02, 0.98))
        net.offset = -float(np.log(t / (1 - t)))
        score = _scores(net, [docs[i] for i in cal])
    langs = np.array([rows[i][1] or "" for i in cal])
    for lang in sorted(set(langs) - {""}):
        own = langs == lang
        if own.sum() >= FEW and y[cal][own].sum() >= 5:
            net.by_lang[str(lang)] = float(np.clip(best_threshold(score[own], y[cal][own]), 0.2, 0.8))
    return net


def toxicity_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Net:
    """Fitted in one task over the bounded sample; only the fitted network comes to the driver."""
    rows = sample_rows(docs, labels, label, [lang], max_docs, max_bytes, doc_id, text)
    rows = rows.select(F.col("_place"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.col("_y"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1:] for r in got]))], pa.binary())], names=["net"])

    fitted = rows.repartition(1).mapInArrow(train, "net binary").collect()
    return pickle.loads(fitted[0].net) if fitted else fit([])


def toxicity(spark: SparkSession, text: Column, lang: Column, net: Net) -> Column:
    """A struct column: score, threshold (of the language), flagged."""
    sent = spark.sparkContext.broadcast(net)  # its size is fixed by BUCKETS and DIM

    @F.arrow_udf("double")
    def score(col: pa.Array) -> pa.Array:
        out = [sent.value.scores(word_ids(w), w.first) for _, w in words(col, ALNUM)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    pairs = [F.lit(x) for kv in sorted(net.by_lang.items()) for x in kv]
    threshold = F.coalesce(F.element_at(F.create_map(*pairs), lang), F.lit(net.threshold)) if pairs else F.lit(net.threshold)
    s = score(text)
    return F.struct(s.alias("score"), threshold.alias("threshold"), (s >= threshold).alias("flagged"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score reaches their language's threshold; all columns stay."""
    net = toxicity_model(docs, labels)
    return docs.where(~toxicity(docs.sparkSession, docs["text"], docs["lang"], net)["flagged"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity_model(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), toxicity(spark, docs["text"], docs["lang"], net).alias("r"))
    return out.select("doc_id", "held_out", "r.score", (F.col("r.score") >= 0.5).cast("int").alias("predicted"), "r.threshold", "r.flagged")
