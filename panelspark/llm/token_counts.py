"""Token counts by a two-tier lookup on the map side.

A sentencepiece BPE model with the identity normalizer never merges across the
border between a non-space and a space, unless a piece holds a space after
another character; ``PieceCounter`` checks the model for such pieces. So a text
falls apart into pre-tokens (a run of spaces and what follows it), and its count
is the sum over them:

* tier 1: the ``TOP`` most frequent pre-tokens of a sample of texts (random rows of
  about ``SAMPLE_BYTES`` together, each of at most ``SAMPLE_TEXT`` bytes, so what comes
  to the driver is bounded) and their counts are broadcast as one table. Pre-tokens of
  over ``LONGEST`` characters are left out, so the table has a proven bound of
  TOP * LONGEST characters;
* tier 2: what tier 1 lacks is encoded by the library and kept in a worker's own
  cache, which starts anew at ``CACHE`` entries; pre-tokens of over ``KEPT`` characters
  aren't kept, so the cache holds at most CACHE * KEPT characters.

No pre-token ever moves between tasks, and nothing is shuffled. The sample and both
tiers change speed only, never a count: every pre-token of every text is counted.

Edge cases: null and empty texts have 0 tokens; texts with the model's own space
sign, and models that don't fulfil the condition, are encoded whole; texts of any
length are counted whole; repeated rows give repeated results; no rows, no result.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import table

TOP = 1 << 16
SAMPLE_BYTES, SAMPLE_TEXT = 16_000_000, 1 << 16
LONGEST = 32
CACHE, KEPT = 400_000, 64
LIMIT = 4096
MODEL = "piece_bpe_32k.model"
SPACE = "▁"

_chunk = re.compile(" +[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text after the model's leading space, each without its first space."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [c[1:] for c in _chunk.findall(" " + text)]
    return text.split(" ")


class PieceCounter:
    def __init__(self, path: str, frequent: dict[str, int], cache: int = CACHE):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        # A last space alone: the library gives nothing for an empty text, so its count is taken from two texts.
        self.frequent, self.limit = frequent | {"": len(self.model.encode("a ")) - len(self.model.encode("a"))}, len(frequent) + cache
        self.known = dict(self.frequent)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces) and self.lengths(["a  b"]) == [len(self.model.encode("a")) + len(self.model.encode(" b"))]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def count(self, text: str) -> int:
        if not self.splits or SPACE in text:
            return len(self.model.encode(text))
        parts, long = pre_tokens(text), 0
        known = self.known
        if new := [p for p in parts if p not in known]:
            new = list(dict.fromkeys(new))
            if any(len(p) > KEPT for p in new):
                apart = {p: len(self.model.encode(p)) for p in new if len(p) > KEPT}
                long = sum(apart.get(p, 0) for p in parts)
                parts, new = [p for p in parts if p not in apart], [p for p in new if p not in apart]
            if len(known) + len(new) > self.limit:
                known = self.known = dict(self.frequent)
                new = [p for p in dict.fromkeys(parts) if p not in known]
            known.update(zip(new, self.lengths(new), strict=True))
        return sum(map(known.__getitem__, parts)) + long


_counters: dict[tuple[str, int], PieceCounter] = {}


def _counter(path: str, frequent: Broadcast) -> PieceCounter:
    key = path, frequent._jbroadcast.id() if frequent._jbroadcast is not None else id(frequent.value)
    if key not in _counters:
        _counters.clear()
        _counters[key] = PieceCounter(path, frequent.value)
    return _counters[key]


def frequent_lengths(docs: DataFrame, text: str, path: str, top: int = TOP, sample_bytes: int = SAMPLE_BYTES) -> dict[str, int]:
    """The token counts of the most frequent pre-tokens of a sample of texts; at most ``top``."""
    sizes = docs.select(F.octet_length(text).alias("b")).where(F.col("b").between(1, SAMPLE_TEXT))
    share = sample_bytes / max(1, sizes.agg(F.sum("b")).head()[0] or 0)
    few = docs.select(F.col(text).alias("t")).where(F.octet_length("t").between(1, SAMPLE_TEXT) & (F.rand(7) < share))
    seen: Counter[str] = Counter()
    for r in few.collect():  # about sample_bytes
        seen.update(w for w in pre_tokens(r.t) if 0 < len(w) <= LONGEST)
    found = [w for w, _ in sorted(seen.most_common(top))]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return dict(zip(found, map(len, model.encode(found)), strict=True)) if found else {}


def token_count(docs: DataFrame, text: str = "text", path: str | None = None, top: int = TOP, sample_bytes: int = SAMPLE_BYTES) -> Column:
    """A column with the token count of each text of ``docs``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text, path, top, sample_bytes))

    @F.arrow_udf("long")
    def count(col: pa.Array) -> pa.Array:
        counter = _counter(path, sent)
        return pa.array([counter.count(t) if t else 0 for t in col.to_pylist()], pa.int64())

    return count(docs[text])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), token_count(docs).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
