"""Personal data against plain patterns, and disclosing terms against plain counts."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from helpers import docs, odd_texts, rng
from pyspark.sql import functions as F

from panelspark.llm import sanitise

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if k % 2 == 0 else sum(map(int, str(2 * x))) for k, x in enumerate(d)) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_patterns():
    r = rng(3)
    texts = ["".join(r.choice(["1", "23", "255", "256", "007", ".", "..", "@", "a", "b.c", "-", " ", "+", "(", ")", "é", "4111 1111-1111 1111", "+1 (20) 555", "x@y.z", "%", "\n"]) for _ in range(r.randrange(1, 40))) for _ in range(6000)]
    texts += ["a@b@c.d", "x@y.z@w.v", "@a.b", "a@b..c", "1.2.3.4.5.6.7.8", "999.1.1.1.1", "4111111111111111", "+123456789", "+12", "é@é.é a@b.é"]
    kinds = list(PLAIN)
    for t in texts:
        raw = t.encode()
        points = lambda b: len(raw[:b].decode())  # noqa: B023, E731
        assert [(kinds[k], points(a), points(b)) for k, a, b in sanitise.base_spans(raw)] == plain(t), t


def test_long_texts_take_linear_time():
    for unit in (b"x", b"1", b"1.", b"+", b"x@", b"+1(", b"a.", b"1-"):
        sanitise.base_spans(unit * 400_000)


def query_rows(df):
    base = F.col("found.base")
    return df.select("doc_id", "text", F.col("found.counts").alias("counts"), base.alias("base"), F.col("found.terms").alias("terms")).collect()


def disclosing_texts(r):
    """Documents in which a name goes with an email, among others; copies of one document; words that are everywhere."""
    common = [f"w{k}" for k in range(60)]
    some = lambda n: " ".join(r.choice(common) for _ in range(n))
    texts = [f"{some(30)} Zorblax mail zo@x.org {some(30)}" for _ in range(6)]
    texts += [f"{some(12)} unique{k} +1 (20) 555 {k:04d} {some(5)}" for k in range(20)]
    texts += ["copied passage quibble with qu@x.org inside it"] * 7
    texts += [f"{some(40)}" for _ in range(150)] + [f"Zorblax alone {some(10)}", "zorblax x@zo.org"]
    return texts + odd_texts()


def brute_terms(texts, radius, least, threshold):
    """The shares by plain counting; terms are lower-cased runs of letters, digits and all that isn't ASCII."""
    held, near, contexts = defaultdict(set), defaultdict(set), defaultdict(set)
    with_term = defaultdict(set)
    for i, t in enumerate(texts):
        t = t or ""
        low = t.translate({c: c + 32 for c in range(65, 91)})
        tokens = [(m.start(), m.end(), m.group()) for m in re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)]
        for _, _, w in tokens:
            with_term[w].add(i)
        spans = plain(t)
        tokens = [x for x in tokens if not any(a < x[1] and x[0] < b for _, a, b in spans)]
        for kind, a, b in spans:
            c = (kind, t[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", t[a:b]))
            held[c].add(i)
            k = sum(x[0] < a for x in tokens)
            window = [x[2] for x in tokens[max(0, k - radius) : k + radius]]
            for w in window:
                near[c, w].add(i)
                contexts[c, w].add(tuple(x for x in window if x != w))
    n, out = len(texts), defaultdict(dict)
    for (c, w), d in near.items():
        if len(contexts[c, w]) >= least and len(held[c]) < n:
            share = math.log2(n * len(d) / (len(held[c]) * len(with_term[w]))) / math.log2(n / len(held[c]))
            if share >= threshold:
                for i in d:
                    out[i][w] = max(share, out[i].get(w, 0))
    return out


@pytest.mark.parametrize("hot", [0, 1000])
def test_terms_that_disclose(spark, hot):
    texts = disclosing_texts(rng(8))
    rows = query_rows(sanitise.protected(docs(spark, texts), most_hot=hot))
    want = brute_terms(texts, sanitise.RADIUS, sanitise.LEAST_CONTEXTS, sanitise.GENERALISE)
    assert any("zorblax" in d for d in want.values()) and not any("quibble" in d for d in want.values())
    for r in rows:
        spans = plain(r.text)
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.counts == [sum(k == kind for k, _, _ in spans) for kind in PLAIN]
        got = {(r.text[p.start : p.end].lower(), round(p.share, 9)) for p in r.terms}
        assert got == {(w, round(s, 9)) for w, s in want.get(r.doc_id, {}).items()}
    assert [p.start for r in rows for p in r.terms] == [p for r in rows for p in sorted(p.start for p in r.terms)]


def test_sanitised(spark):
    texts = disclosing_texts(rng(8))
    got = {r.doc_id: r for r in sanitise.sanitised(docs(spark, texts)).collect()}
    assert sorted(got) == list(range(len(texts))) and all(r.score == 0.5 and r.id == r.doc_id for r in got.values())
    for k in range(6):
        assert "[email]" in got[k].text and "Zorblax" not in got[k].text
    alone = texts.index(next(t for t in texts if t and t.startswith("Zorblax alone")))
    assert got[alone].text == texts[alone]  # holds no entity
    softer = {r.doc_id: r.text for r in sanitise.sanitised(docs(spark, texts), remove=2.0).collect()}
    assert "[name]" in softer[0]
    assert all(not plain(r.text) for r in got.values())


def test_null_and_repeated_ids_and_empty(spark):
    texts = ["a@b.c and 1.2.3.4", "a@b.c and 1.2.3.4", None, ""]
    rows = query_rows(sanitise.protected(docs(spark, texts, [None, None, 1, 1]), columns=["doc_id", "text"]))
    assert sorted((r.doc_id is None, r.base) for r in rows) == [(False, ""), (False, ""), (True, "email:0:5,ip:10:17"), (True, "email:0:5,ip:10:17")]
    assert sanitise.protected(docs(spark, [], [])).collect() == []


def test_query(spark, tmp_path):
    texts = disclosing_texts(rng(8))
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    for r in sanitise.query(spark, str(tmp_path)).collect():
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert r.spans == spans or r.spans.startswith(spans + ",term:")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in spans.split(",")) for k in PLAIN)
