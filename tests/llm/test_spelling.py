"""Spelling variants against a comparison of all pairs."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import docs, odd_texts, rng

from panelspark.llm import spelling


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def counted(texts, ids, modulus, least_chars, least_count):
    n = Counter()
    for i, t in zip(ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_chars and k >= least_count}


def brute(n, ratio):
    found, forms = {}, {}
    for w in n:
        all_ = [x for x in n if x != w and near(w, x)]
        best = min(all_, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= ratio * n[w] else None
        found[w] = len(all_)
    out = []
    for w in n:
        r = w
        while forms[r]:
            r = forms[r]
        out.append((w, forms[w], r, n[w], found[w], n[forms[w]] if forms[w] else None))
    return sorted(out)


@pytest.mark.parametrize("most", [4, 4096])
def test_variants(spark, most):
    r = rng(most)
    words = ["".join(r.choice("aabé") for _ in range(r.randrange(3, 9))) for _ in range(900)]
    words = [w for w in words for _ in range(int(r.paretovariate(0.5)) % 200)] + ["Äbcdef×", "ABCDEFGÀ", "abcdefgà"] * 6
    r.shuffle(words)
    texts = [" ".join(words[k : k + 60]).replace(" ", r.choice([" ", "1", "\n", "ſ"]), 3) for k in range(0, len(words), 60)] + odd_texts() + ["x" * 300, "x" * 301, "x" * 299 + "y", "aax" * 900]
    ids = [None if k == 3 else k % 50 for k in range(len(texts))]
    n = counted(texts, ids, 7, 4, 1)
    got = spelling.variants(docs(spark, texts, ids), least_chars=4, least_count=1, ratio=2, modulus=7, most=most).collect()
    assert sorted(map(tuple, got)) == brute(n, 2)
    assert max(x[4] for x in got) > 20 and any(x[2] not in (x[0], x[1]) for x in got)


def test_pairs_are_accepted_once():
    """Every range of the edit, down to single code points, over all pairs."""
    r = rng(5)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(5, 9))) for _ in range(400)})
    for most in (1, 3, 50):
        todo, hits = [], Counter()
        for w in words:
            for longer in (0, 1):
                size = len(w) - longer
                h = size // 2
                todo += [(f"{size}||{w[h + longer:]}", longer, w[: h + longer], 1), (f"{size}|{w[:h]}|", longer, w[h:], 1)]
        while todo:
            groups, todo = defaultdict(list), sorted(todo)
            for key, *row in todo:
                groups[key].append(tuple(row))
            todo, m = [], spelling.Machines()
            for key, rows in groups.items():
                if len(rows) > most and len(rows[0][1]) - rows[0][0] > 1:
                    todo += spelling.halves(key, rows)
                else:
                    for w, c, _, _ in spelling.partition_pairs(m, key, rows):
                        hits[w] += c
        assert hits == Counter({w: c for w in words if (c := sum(near(w, x) for x in words if x != w))})


def test_acceptors_are_minimal():
    m = spelling.Machines()
    s = m.accept(sorted(a + b + c for a in "abc" for b in "xy" for c in "pq"))
    assert m.count[s] == 12 and len(m.arcs) == 4  # one state a length
    assert m.accept(["axp"]) != s and m.accept(sorted(a + b + c for a in "abc" for b in "xy" for c in "pq")) == s


def test_empty_and_repeated(spark):
    assert spelling.variants(docs(spark, [], [])).collect() == []
    assert spelling.variants(docs(spark, [None, "", "1 2"])).collect() == []
    got = spelling.variants(docs(spark, ["letters letters"] * 3, [1, 1, None]), modulus=1 << 31).collect()
    assert [tuple(x) for x in got] == [("letters", None, "letters", 6, 0, None)]
