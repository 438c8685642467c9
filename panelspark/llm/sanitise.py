"""Personal data, and the terms that give it away: information-theoretic sanitisation.

Emails, network addresses, card and phone numbers are found by pattern (``base_spans``); each
distinct value is a protected entity c. A term t (a word) that stands within ``RADIUS`` words
of c may reveal it. Over all documents,

    PMI(c; t) = log2(N n_ct / (n_c n_t)),  IC(c) = log2(N / n_c)

with N documents, n_c of them holding c, n_t holding t and n_ct holding t near c. The share
PMI / IC says how much of what there is to know about c is known from t: 1 if t is never
without c. A term whose share reaches ``GENERALISE`` is replaced by its class in documents
that hold c, and one that reaches ``REMOVE`` is taken out. Copies say nothing new, so a
pair counts only with ``LEAST_CONTEXTS`` different contexts; a context is the two smallest
hashes of the other words around, which most near copies of a passage share.

* One scan finds entities, the terms near them and where these stand, in tasks; texts aren't
  shuffled. Documents are known by a row number that is kept with this table.
* Pairs (c, t) are counted by pre-aggregated groups. Documents with t are counted in a second
  scan, only of terms that pass a Bloom filter of the candidates, whose size is fixed
  (``FILTER_BITS``); the exact join settles what passes. The more candidates, the more terms
  are shuffled, at most one row for each term and batch.
* Pairs that hold at least 1 / MOST_HOT of all pair rows (so at most MOST_HOT of them) are
  joined by broadcast; all others have few rows each, and meet by key.

Terms are known by 64-bit values (see ``text``), entities by 64-bit hashes. Edge cases: null
and empty texts hold nothing; each row is a document, repeated rows too; an entity that all
documents hold has nothing left to reveal; no rows, no result; where a document holds an
entity, all places of a term that discloses it count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import cut, free_name, table
from panelspark.llm.text import ALNUM, U64, Words, mix, pieces, words

KINDS = ("email", "ip", "card", "phone")
RADIUS = 10
GENERALISE, REMOVE = 0.75, 0.9
LEAST_CONTEXTS = 3
FILTER_BITS = 23
MOST_HOT = 1000

_LOCAL = np.zeros(256, bool)
_LOCAL[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._%+-"]] = True
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)


def emails(text: bytes) -> Iterator[tuple[int, int]]:
    """From each @ to both sides, so that time is linear: a part before it reaches back as far as letters go, but not into the email before."""
    done = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > done and _LOCAL[text[start - 1]]:
            start -= 1
        if start < at:
            done = m.end()
            yield start, done


def addresses(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip(b"0") for p in m.group().split(b".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().translate(None, _NO_DIGIT)
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(m.group().translate(None, _NO_DIGIT)) <= 15:
            yield m.span()


def base_spans(text: bytes, digits: int | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, by kind and start. digits: how many digits the text has, if that is known."""
    digits = len(text) if digits is None else digits
    out = []
    if b"@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if digits >= 4 and b"." in text:
        out += [(1, a, b) for a, b in addresses(text)]
    if digits >= 13:
        out += [(2, a, b) for a, b in cards(text)]
    if digits >= 9 and b"+" in text:
        out += [(3, a, b) for a, b in phones(text)]
    return out


def entity(kind: int, value: bytes) -> int:
    """The number of a protected value: the same for all ways to write a number or an email."""
    plain = value.lower() if kind < 2 else value.translate(None, _NO_DIGIT)
    return int.from_bytes(hashlib.blake2b(b"%d:%s" % (kind, plain), digest_size=8).digest(), "little", signed=True)


_FOUND = "struct<counts:array<long>,base:string,entities:array<long>,pairs:array<struct<entity:long,term:long,context:long>>,terms:array<struct<term:long,at:array<struct<start:int,end:int>>>>>"


def _found_in(text: bytes, raw: np.ndarray, spans: list[tuple[int, int, int]], radius: int) -> tuple[dict, list[dict], list[dict]]:
    """Entities, pairs and terms of a text that has base spans; places in code points."""
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    who = [entity(k, text[a:b]) for k, a, b in spans]
    w = Words(raw, np.array([0, len(raw)]), ALNUM)
    inside = np.zeros(len(raw) + 1, np.int32)
    for _, a, b in spans:
        inside[a] += 1
        inside[b] -= 1
    inside = np.concatenate(([0], np.cumsum(np.cumsum(inside)[:-1] > 0)))
    free = np.flatnonzero(inside[w.end] == inside[w.start])
    start, end, value = w.start[free], w.end[free], w.value[free]
    rank = mix(value ^ U64(0x5851F42D4C957F2D))
    pairs: dict[tuple[int, int], int] = {}
    for c, (_, a, _) in zip(who, spans, strict=True):
        k = int(np.searchsorted(start, a))
        v, r = value[max(0, k - radius) : k + radius], rank[max(0, k - radius) : k + radius]
        least = np.unique(r)[:3].tolist()
        for t, own in zip(v.view(np.int64).tolist(), r.tolist(), strict=True):
            pairs.setdefault((c, t), hash(tuple([x for x in least if x != own][:2])))
    known = np.unique(np.array([t for _, t in pairs], np.int64)).view(U64)
    places: dict[int, list[dict]] = {}
    for k in np.flatnonzero(np.isin(value, known)).tolist():
        places.setdefault(int(value[k : k + 1].view(np.int64)[0]), []).append({"start": int(point[start[k]]), "end": int(point[end[k]])})
    shown = [(k, int(point[a]), int(point[b])) for k, a, b in spans]
    one = {"counts": np.bincount([k for k, _, _ in spans], minlength=4).tolist(), "base": ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in shown), "entities": sorted(set(who))}
    return one, [{"entity": c, "term": t, "context": x} for (c, t), x in pairs.items()], [{"term": t, "at": at} for t, at in places.items()]


def find(radius: int = RADIUS):
    """A column function: what a text holds."""

    @F.arrow_udf(_FOUND)
    def found(col: pa.Array) -> pa.Array:
        nothing = {"counts": [0, 0, 0, 0], "base": "", "entities": [], "pairs": [], "terms": []}
        out = [nothing] * len(col)
        for row, raw, bounds in pieces(col):
            digits = np.concatenate(([0], np.cumsum((raw >= 48) & (raw <= 57))))
            ats = np.concatenate(([0], np.cumsum(raw == 64)))
            n_digits, n_ats = np.diff(digits[bounds]), np.diff(ats[bounds])
            data = raw.tobytes()
            for k in np.flatnonzero((n_digits >= 4) | (n_ats > 0)).tolist():
                text = data[bounds[k] : bounds[k + 1]]
                if spans := base_spans(text, int(n_digits[k])):
                    one, pairs, terms = _found_in(text, raw[bounds[k] : bounds[k + 1]], spans, radius)
                    out[row + k] = one | {"pairs": pairs, "terms": terms}
        place = pa.struct({"start": pa.int32(), "end": pa.int32()})
        pair = pa.struct({"entity": pa.int64(), "term": pa.int64(), "context": pa.int64()})
        kind = pa.struct({"counts": pa.list_(pa.int64()), "base": pa.string(), "entities": pa.list_(pa.int64()), "pairs": pa.list_(pair), "terms": pa.list_(pa.struct({"term": pa.int64(), "at": pa.list_(place)}))})
        return pa.array(out, kind)

    return found


def _bits(term: str, bits: int):
    return [F.col(term).bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(term, 64 - bits)]


def _holding(docs: DataFrame, text: str, terms: DataFrame, bits: int) -> DataFrame:
    """term, n: how many documents hold each of ``terms``, which are looked for through a Bloom filter of 2 ** bits bits."""
    spark = docs.sparkSession
    at = terms.select(F.explode(F.array(*_bits("term", bits))).alias("b"))
    found = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toPandas()  # at most 2 ** (bits - 6) rows
    filled = np.zeros(1 << (bits - 6), np.int64)
    filled[found["w"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(filled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitset = sent.value.view(U64)
        for batch in batches:
            each = []
            for _, w in words(batch.column(0), ALNUM):
                v, row = w.value, np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
                for place in (lambda v: v & U64((1 << bits) - 1), lambda v: v >> U64(64 - bits)):
                    p = place(v)
                    hit = (bitset[(p >> U64(6)).astype(np.int64)] >> (p & U64(63))) & U64(1) > 0
                    v, row = v[hit], row[hit]
                order = np.lexsort((row, v))
                v, row = v[order], row[order]
                new = np.append(True, (v[1:] != v[:-1]) | (row[1:] != row[:-1]))[: len(v)]
                each.append(v[new])
            if each:
                v, n = np.unique(np.concatenate(each), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n)], names=["term", "n"])

    counts = docs.select(F.col(text).alias("t")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counts.join(terms.select("term"), "term", "left_semi")


def disclosures(docs: DataFrame, found: DataFrame, text: str = "text", least_contexts: int = LEAST_CONTEXTS, threshold: float = GENERALISE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """entity, term, n_ct, n_c, n_t, share of all pairs that reach the threshold. found: a row for each document with its ``found``, kept."""
    n = found.count()
    n_c = found.select(F.explode("found.entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_c"))
    pairs = found.select(F.explode("found.pairs").alias("p")).select("p.*").groupBy("entity", "term").agg(F.count("*").alias("n_ct"), F.countDistinct("context").alias("contexts"))
    likely = cut(pairs.where(F.col("contexts") >= least_contexts).join(n_c, "entity"))
    n_t = _holding(docs, text, likely.select("term").distinct(), filter_bits).withColumnRenamed("n", "n_t")
    known = F.log2(F.lit(float(n)) / F.col("n_c"))
    told = F.log2(F.lit(float(n)) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    out = likely.join(n_t, "term").withColumn("share", F.when(known > 0, told / known))
    return cut(out.where(F.col("share") >= threshold).select("entity", "term", "n_ct", "n_c", "n_t", "share"))


def disclosing_terms(found: DataFrame, disclosed: DataFrame, most_hot: int = MOST_HOT) -> DataFrame:
    """row, disclosing (term, share) of the documents that hold a term near an entity that it discloses."""
    pairs = found.select("row", F.explode("found.pairs").alias("p")).select("row", "p.entity", "p.term")
    total = found.agg(F.sum(F.size("found.pairs"))).head()[0] or 0
    hot = F.col("n_ct") * most_hot >= total
    own = disclosed.select("entity", "term", "share", "n_ct")
    cold = pairs.join(own.where(~hot), ["entity", "term"])
    both = cold.unionByName(pairs.join(F.broadcast(own.where(hot)), ["entity", "term"]))
    each = both.groupBy("row", "term").agg(F.max("share").alias("share"))
    return each.groupBy("row").agg(F.collect_list(F.struct("term", "share")).alias("disclosing"))


def protected(docs: DataFrame, text: str = "text", radius: int = RADIUS, least_contexts: int = LEAST_CONTEXTS, threshold: float = GENERALISE, filter_bits: int = FILTER_BITS, most_hot: int = MOST_HOT, columns: list[str] | None = None) -> DataFrame:
    """docs (or only ``columns`` of it) with ``found``: counts (by kind), base (the base spans as text) and terms: start, end and share of the places of terms that disclose an entity of the document."""
    columns = docs.columns if columns is None else columns
    row, name = free_name(docs, "row"), free_name(docs, "found")
    kept = cut(docs.select(*columns, F.monotonically_increasing_id().alias(row), find(radius)(F.col(text)).alias(name)))
    found = kept.select(F.col(row).alias("row"), F.col(name).alias("found"))
    disclosed = disclosures(docs, found, text, least_contexts, threshold, filter_bits)
    marked = disclosing_terms(found, disclosed, most_hot).select(F.col("row").alias("_row"), F.map_from_entries("disclosing").alias("_share"))
    joined = kept.join(marked, F.col(row) == F.col("_row"), "left")
    some = F.filter(F.col(f"{name}.terms"), lambda t: F.map_contains_key("_share", t["term"]))
    places = F.flatten(F.transform(some, lambda t: F.transform(t["at"], lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.col("_share")[t["term"]].alias("share")))))
    out = F.struct(F.col(f"{name}.counts").alias("counts"), F.col(f"{name}.base").alias("base"), F.coalesce(F.array_sort(places), F.array()).alias("terms"))
    return joined.select(*columns, out.alias(name))


def sanitised(docs: DataFrame, text: str = "text", remove: float = REMOVE, **how) -> DataFrame:
    """docs with personal data replaced by its kind, disclosing terms by their class ([number], [name] for a capital, else [term]), and those that reach ``remove`` taken out."""
    held = protected(docs, text, **how)
    names, at = docs.columns, docs.columns.index(text)

    def one(x: str, base: str, terms: list[dict]) -> str:
        spans = [(int(s), int(e), f"[{k}]") for k, s, e in (p.split(":") for p in base.split(","))] if base else []
        for p in terms:
            word = x[p["start"] : p["end"]]
            spans.append((p["start"], p["end"], "" if p["share"] >= remove else "[number]" if word.isdigit() else "[name]" if word[:1].isupper() else "[term]"))
        done, parts = 0, []
        for s, e, by in sorted(spans):
            if e > done:
                parts += [x[done:s], by] if s >= done else []
                done = e
        return "".join([*parts, x[done:]])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = [one(x, f["base"], f["terms"]) if f["base"] else x for x, f in zip(texts, found, strict=True)]
            columns = [pa.array(new, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return held.mapInArrow(rewrite, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = protected(table(spark, sf_dir, "documents"), columns=["doc_id"])
    base, terms = F.col("found.base"), F.col("found.terms")
    extra = F.array_join(F.transform(terms, lambda p: F.concat_ws(":", F.lit("term"), p["start"].cast("string"), p["end"].cast("string"))), ",")
    counts = [F.col("found.counts")[k].alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return held.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.when(base != "", base), F.when(F.size(terms) > 0, extra)).alias("spans"))
