"""Token counts and token files: against the libraries, and round trips."""

import io
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from helpers import docs, odd_texts
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from panelspark.llm import token_counts, token_files  # noqa: E402

PARTS = [" ", "  ", "   ", "a", "the", "é", "\n", "\n\n", "\t", "　", "x1", "<|endoftext|>", "<s>", "'s", "日", "\x00", " th", " of", "\x1c", "\x85", "!?", "▁", ". ", ",", "ª", "ɐ", "Straße", " naïve", "\nWord", "don", "\u01c5x"]


def fuzz(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(12))) for _ in range(n)]


def test_piece_counter():
    path = public_tokenizers.path(token_counts.MODEL)
    c = token_counts.PieceCounter(path, {"a": 1}, cache=50)
    assert c.splits
    for t in [*fuzz(1, 3000), "a " + "long" * 50 + "  " + "longer" * 4000 + " a"]:
        assert c.count(t) == len(c.model.encode(t)), repr(t)
        assert len(c.known) <= c.limit + 20 and max(map(len, c.known)) <= token_counts.KEPT


def test_token_counts(spark):
    texts = odd_texts() + fuzz(2, 40)
    df = docs(spark, texts).withColumn("t", F.lit(1)).withColumn("w", F.lit(1))
    model = token_counts.PieceCounter(public_tokenizers.path(token_counts.MODEL), {}).model
    for size in (16_000_000, 40):
        got = dict(df.select("doc_id", token_counts.token_count(df, top=20, sample_bytes=size)).collect())
        assert got == {k: len(model.encode(t)) if t else 0 for k, t in enumerate(texts)}
    flat = spark.range(3).select(F.lit("a text of words").alias("text"))
    assert "Exchange" not in flat.select(token_counts.token_count(flat))._jdf.queryExecution().executedPlan().toString()
    assert df.limit(0).select(token_counts.token_count(df.limit(0))).count() == 0


def test_encoder():
    e = token_files.Encoder(public_tokenizers.path(token_files.MODEL), cache=100)
    assert e.splits
    for t in [*fuzz(3, 5000), "a " + "long" * 50 + " \nb " + "longer" * 4000, "w" * 90 + " c\n" + "é!" * 60]:
        assert np.frombuffer(e.ids(t), e.dtype).tolist() == e.model.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_columns():
    e = token_files.Encoder(public_tokenizers.path(token_files.MODEL), cache=100)
    texts = [*fuzz(7, 3000), "dogs' don't-- x1... \"Straße\", (ɐ)", ""]
    want = e.raw(texts)
    assert list(e.encode(pa.array([*texts, None]))) == [*want, b""]
    assert list(e.encode(pa.array(texts, pa.large_string()).slice(5, 9))) == want[5:14]
    assert list(e.encode(pa.array([], pa.string()))) == []


def test_encoder_asks_the_library_once_for_a_word():
    e = token_files.Encoder(public_tokenizers.path(token_files.MODEL), cache=2000)
    merge, asked = e.merge, Counter()

    class Spy:
        def tokenize(self, s):
            asked.update(w for w in s.split(chr(256)) if w)  # chr(256): the byte-level letter of NUL
            return merge.tokenize(s)

    e.merge = Spy()
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(3300)]
    for k in range(60):
        text = "the " + " ".join(w + r.choice(["", "", ".", ",", "?!"]) for w in words[:300] + words[300 + 50 * k : 350 + 50 * k])
        assert e.ids(text) == e.raw([text])[0]
        assert len(e.inner) <= 2000
    assert len(asked) >= 3300 and max(asked.values()) == 1


def test_files_round_trip(spark, tmp_path):
    texts = odd_texts() + fuzz(4, 60)
    ids = [*range(100, 98 + len(texts)), None, 7]
    path = public_tokenizers.path(token_files.MODEL)
    model = token_files.Encoder(path).model
    df = docs(spark, texts, ids)
    where = str(tmp_path / "out")
    files = token_files.write_files(df, where, path, frame_ids=50, files=3)
    assert files.count() == 3
    got = token_files.read_files(files, where).collect()
    start, want = 0, []
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is None, x[0] or 0)):
        x = [*(model.encode(t, add_special_tokens=False).ids if t else []), 0]
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert token_files.write_files(df.limit(0), str(tmp_path / "none"), path).count() == 0


def test_hot_ids_take_several_files(spark, tmp_path):
    texts, ids = fuzz(6, 300), [5] * 120 + [None] * 120 + list(range(60))
    path, where = public_tokenizers.path(token_files.MODEL), str(tmp_path / "hot")
    (tmp_path / "hot").mkdir()
    (tmp_path / "hot" / "part-000000-of-a-lost-task.ids.zst").write_bytes(b"half a file")
    files = token_files.write_files(docs(spark, texts, ids), where, path, files=3, rows_a_file=50)
    assert {f.name for f in (tmp_path / "hot").iterdir() if f.suffix == ".zst"} == {r.file for r in files.collect()}
    assert files.agg(F.max("n_docs")).head()[0] < 100 and files.agg(F.sum("n_docs")).head()[0] == 300
    got = sorted(token_files.read_files(files, where).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: (i is None, i or 0))
    model = token_files.Encoder(path).model
    crc = lambda t: zlib.crc32(np.array([*(model.encode(t, add_special_tokens=False).ids if t else []), 0], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), crc(t)) for i, t in zip(ids, texts, strict=True))


def test_random_access_reads_one_frame():
    out = io.BytesIO()
    w = token_files.FileWriter(out, frame_ids=100)
    data = {k: np.arange(k * 7, k * 7 + 30 + k, dtype="<u4") for k in range(40)}
    for k, ids in data.items():
        w.add(k, ids)
    w.close()
    raw = out.getvalue()
    r = token_files.FileReader(io.BytesIO(raw), len(raw))
    assert len(r.frames) > 10
    assert r.find(17)[0].tolist() == data[17].tolist() and r.find(99) == []
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(x.tobytes() for x in data.values())
    frame = int(np.searchsorted(r.frame_first, r.first[17], "right")) - 1
    other = bytearray(raw)
    other[int(r.begin[frame + 1]) + 12] ^= 255  # damage in another frame isn't read
    assert token_files.FileReader(io.BytesIO(bytes(other)), len(raw)).find(17)[0].tolist() == data[17].tolist()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        bad = bytearray(raw)
        bad[int(r.begin[frame]) + 12] ^= 255
        token_files.FileReader(io.BytesIO(bytes(bad)), len(raw)).find(17)
    with pytest.raises(ValueError, match="seek table"):
        token_files.FileReader(io.BytesIO(raw[:-1]), len(raw) - 1)
