"""Texts and brute-force forms for the tests."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long"


def docs(spark, texts, ids=None, sources=None, partitions=3):
    """A documents table with extra columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    sources = sources or [f"s{k % 3}" if k % 7 else None for k in range(len(texts))]
    rows = [(i, t, "en" if k % 2 else None, s, None if t is None else len(t), 0.5, k) for k, (i, t, s) in enumerate(zip(ids, texts, sources, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def sentence(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def odd_texts():
    return [None, "", " ", "\n", "one", "ONE  two\tthree\n\n four", "x" * 5000, "é à　ü 日本 語", "a " * 30000, "one"]


def words(text, pattern):
    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def rng(seed=1):
    return random.Random(seed)
