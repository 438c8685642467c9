"""Token ids in files of independent zstandard frames.

A file holds, one after another:

* data frames: each an independent zstandard frame over the ids (little-endian
  unsigned 32-bit) of whole documents, about ``FRAME_IDS`` ids each;
* a document table in a skippable frame: doc_id, whether it is null, and number
  of ids of each document, compressed as one frame;
* a seek table in a skippable frame at the very end: for each data frame its
  compressed size, its size and the low 32 bits of the XXH64 of its ids. This is
  the public zstandard seekable format, so other tools can read it.

A reader takes the last bytes, then the document table, then only the frames of
the documents asked for, and checks each frame against its checksum.

Documents lie in ascending doc_id order over all files (nulls last; rows with
equal doc_id by their ids). The range borders come from approximate quantiles of
doc_id alone, so each text is encoded once and only ids are shuffled. A doc_id (or
null) of more rows than a file holds is spread over several files by a hash of its
texts, so its rows are in order of (that hash, ids).

A task writes files of names that no other attempt uses, and the table of files names
those of the attempts that counted: a lost executor's task can run again on any file
system. What other attempts left is removed at the end.

Encoding: a byte-level BPE with the usual word pattern always has a border before
a space that follows a non-space or precedes one, and around a line break between two
non-spaces, so a text falls apart there; each worker keeps a bounded cache of the library's ids of such parts, and looks
up the distinct ones of some megabytes of texts at once.
Texts where the rule doesn't hold (spaces among other white space, special
strings), and tokenizers of other kinds, are encoded whole.

Edge cases: a null or empty text is the end id alone; no rows, no files, no result;
repeated rows are written as often as they come.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import fresh_dir, table

MODEL = "byte_bpe_50k.json"
FRAME_IDS = 1 << 16
ROWS_A_FILE = 500_000
#: Entries of a worker's cache, and the longest part in it.
CACHE, KEPT = 1_000_000, 64
#: Bytes of texts whose parts are looked up at once, and words that the merge model gets at once.
PIECE, TOGETHER = 1 << 22, 16
#: Marks that are no part of a word for the pattern.
MARKS = string.punctuation
# Fixed values of the zstandard seekable format.
SKIPPABLE_TABLE, SKIPPABLE_DOCS, SEEKABLE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1

# The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_LETTER = np.array([_LETTERS.get(b, b) for b in range(256)], "<u4")


def _is_word(w: str) -> bool:
    """Letters alone, of blocks that have been the same in all versions of Unicode."""
    return w.isalpha() and (w.isascii() or max(w) < "\u0250")


_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_space = re.compile(r"\s")
_odd_line = re.compile(r"\n(?:(?=\s)|(?<=\s\n))")
_odd_space = re.compile(r" (?:(?<=\s )(?=\s|\Z))")


def _strings(col: pa.Array) -> list[str]:
    """The strings of an array (large_string, not empty), none of which holds a space."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(col)], col), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")


def _after_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the UTF-8 byte at ``at`` ends a letter of Latin-1 (the last 64 code points, or ASCII)."""
    last, before = data[at], data[np.maximum(at - 1, 0)]
    return _ASCII_LETTER[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))


class Encoder:
    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())
        pre, merge = spec["pre_tokenizer"] or {}, spec["model"]
        self.splits = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["normalizer"] is None
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.dtype = "<u2" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        line = self.raw(["\n"])[0]
        self.line = int(np.frombuffer(line, self.dtype)[0]) if len(line) == np.dtype(self.dtype).itemsize else None
        self.line_ids = line
        self.merge = self.model.model
        self.nul = self._unmerged(merge, chr(_LETTERS[0])) if self.splits and self.line is not None else None
        #: Ids of parts, and those that were there before the last turn.
        self.inner: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.begin: dict[str, bytes] = {}
        self.cache = cache

    @staticmethod
    def _unmerged(model: dict, letter: str) -> int | None:
        """The id of a letter that no merge holds, so that the merge model leaves apart what stands on its two sides; else None."""
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "ignore_merges")):
            return None
        return None if any(letter in part for pair in model["merges"] for part in pair) else model["vocab"].get(letter)

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, words: list[str]) -> np.ndarray:
        """The library's merges of words, each one word for the pattern, with the id of a NUL between them."""
        lines = "\n".join(["\0".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)])
        letters = _LETTER[np.frombuffer(lines.encode(), np.uint8)].tobytes().decode("utf-32-le")
        flat: list[int] = []
        for line in letters.split(chr(_LETTERS[10])):
            flat += [x.id for x in self.merge.tokenize(line)]
            flat.append(self.nul)
        return np.array(flat[:-1], self.dtype)

    def _cut(self, parts: list[str], flat: np.ndarray, between: int) -> dict[str, bytes]:
        """The ids of parts, which lie in ``flat`` with an id between them; nothing if that id doesn't tell them apart."""
        cuts = np.flatnonzero(flat == between)
        if len(cuts) != len(parts) - 1:
            return {}
        raw, size, line = flat.tobytes(), flat.itemsize, self.line_ids
        ends = zip(parts, [0, *((cuts + 1) * size).tolist()], [*(cuts * size).tolist(), len(raw)], strict=True)
        return {p: line + raw[a:z] if p[0] == "\n" else raw[a:z] for p, a, z in ends}

    def learn(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts, which the library is asked for. A part stands after a space, or, if it begins with one, after a line break.

        A part of letters alone is one word for the pattern, so the library's merge model gets it directly, many at a time,
        with a letter between them that no merge holds. Other parts are encoded as lines of one text, as a line break
        between them is a token of its own.
        """
        found: dict[str, bytes] = {}
        words, plain, odd = [], [], []
        for p in parts:
            if self.nul is not None and _is_word(p[1:] if p[:1] == "\n" else p):
                words.append(p)
            else:
                (odd if self.line is None or not p or _space.search(p, p[0] == "\n") else plain).append(p)
        for some, flat, between in ((words, self._merged, self.nul), (plain, self._lines, self.line)):
            if some:
                cut = self._cut(some, flat([p[1:] if p[0] == "\n" else " " + p for p in some]), between)
                found |= cut
                odd += [] if cut else some
        if odd:
            found |= zip(odd, self.raw([p if p[:1] == "\n" else " " + p for p in odd]), strict=True)
        return [found[p] for p in parts]

    def _lines(self, lines: list[str]) -> np.ndarray:
        return np.frombuffer(self.raw(["\n".join(lines)])[0], self.dtype)

    def _part(self, text: str) -> bytes:
        """The ids of a text of its own, by a small cache."""
        if len(text) > KEPT:
            return self.raw([text])[0]
        if text not in self.begin:
            if len(self.begin) > self.cache // 8:
                self.begin.clear()
            self.begin[text] = self.raw([text])[0] if text else b""
        return self.begin[text]

    def _long(self, part: str) -> bytes:
        """The ids of a part that isn't kept."""
        return self.raw([part if part[0] == "\n" else " " + part])[0]

    def _known(self, parts: pa.Array) -> pa.Array:
        """The ids of distinct parts. ASCII marks at the end of a part, with a letter before them, are a word for the pattern, and looked up apart."""
        trimmed = pc.utf8_rtrim(parts, MARKS)
        ends = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
        data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)
        left = pc.binary_length(trimmed).to_numpy()
        last = ends[:-1] + left - 1
        marked = (left < np.diff(ends)) & (left > 0)
        marked[marked] = _after_letter(data, last[marked])
        stems = pc.if_else(pa.array(marked), trimmed, parts).dictionary_encode()
        found = pa.array(self._stems(_strings(stems.dictionary)), pa.large_binary()).take(stems.indices)
        behind: dict[bytes, int] = {b"": 0}
        which = np.zeros(len(parts), np.int64)
        which[marked] = [behind.setdefault(data[a:z].tobytes(), len(behind)) for a, z in zip((last[marked] + 1).tolist(), ends[1:][marked].tolist(), strict=True)]
        marks = pa.array([self._part(m.decode()) for m in behind], pa.large_binary()).take(pa.array(which))
        return pc.binary_join_element_wise(found, marks, pa.scalar(b"", pa.large_binary()))

    def _stems(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts, by the cache. If the newer half is full, it becomes the older one; what is asked for again moves on."""
        if len(self.inner) > self.cache // 2:
            self.older, self.inner = self.inner, {}
        inner, older = self.inner, self.older
        got = list(map(inner.get, parts))
        new, at = [], []
        for k in [k for k, x in enumerate(got) if x is None]:
            p = parts[k]
            if (x := older.get(p)) is not None:
                inner[p] = got[k] = x
            elif len(p) <= KEPT:
                new.append(p)
                at.append(k)
            else:
                got[k] = self._long(p)
        for p, k, x in zip(new, at, self.learn(new), strict=True):
            inner[p] = got[k] = x
        return got

    def _alone(self, text: str) -> bytes | None:
        """The ids of a text that doesn't fall apart at each of its spaces and line breaks, else None."""
        if not self.splits or _odd_space.search(text) or any(s in text for s in self.special):
            return self.raw([text])[0]
        if "\n" in text and (text[0] == "\n" or text[-1] == "\n" or _odd_line.search(text)):
            head, *parts = text.split(" ")
            return self._part(head) + b"".join([self._part(" " + p) for p in parts])
        return None

    def encode(self, col: pa.Array) -> Iterator[bytes]:
        """The ids of each text; a null has none. Parts are split and told apart by Arrow, in pieces of about ``PIECE`` bytes."""
        col = col.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(col).to_numpy())
        row = 0
        while row < len(col):
            stop = int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PIECE, "right"))
            stop = max(stop, row + 1)
            yield from self._piece(col.slice(row, stop - row))
            row = stop

    def _piece(self, col: pa.Array) -> list[bytes]:
        alone = [self._alone(t) if t else b"" for t in col.to_pylist()]
        col = col.filter(pa.array([x is None for x in alone], pa.bool_()))
        if not len(col):
            return alone
        lists = pc.split_pattern(pc.replace_substring(col, "\n", " \n"), " ")
        first, parts = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        known = self._known(parts.dictionary)
        heads = lists.values.take(pa.array(first[:-1])).to_pylist()
        at = parts.indices.to_numpy().copy()
        at[first[:-1]] = len(known) + np.arange(len(heads))
        ids = pa.concat_arrays([known, pa.array([self._part(h) for h in heads], pa.large_binary())]).take(pa.array(at))
        raw, cuts = ids.buffers()[2] or b"", np.frombuffer(ids.buffers()[1], np.int64)[first].tolist()
        found = iter([bytes(memoryview(raw)[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)])
        return [next(found) if x is None else x for x in alone]

    def ids(self, text: str) -> bytes:
        return next(self.encode(pa.array([text])))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


class FileWriter:
    """Collects documents into frames; ``close`` adds the document table and the seek table."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 3):
        self.out, self.frame_ids = out, frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[bytes] = []
        self.n_held = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.n_held and self.n_held + len(ids) > self.frame_ids:
            self._flush()
        self.held.append(ids.astype("<u4").tobytes())
        self.n_held += len(ids)
        self.docs.append((doc_id, len(ids)))

    def _flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._flush()
        ids = np.array([d or 0 for d, _ in self.docs], "<i8")
        nulls = np.array([d is None for d, _ in self.docs], np.uint8)
        sizes = np.array([n for _, n in self.docs], "<u4")
        docs = struct.pack("<Q", len(self.docs)) + self.zstd.compress(ids.tobytes() + nulls.tobytes() + sizes.tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_DOCS, len(docs)) + docs)
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(seek)) + seek)


class FileReader:
    """Random access to one file. ``f``: a seekable binary file; ``size``: its bytes."""

    def __init__(self, f, size: int):
        self.f = f
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        self.frames = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        at = int(self.begin[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != SKIPPABLE_DOCS:
            raise ValueError("no document table")
        body = self._at(at + 8, length)
        (m,) = struct.unpack("<Q", body[:8])
        raw = zstandard.ZstdDecompressor().decompress(body[8:])
        self.doc_ids = np.frombuffer(raw, "<i8", m)
        self.nulls = np.frombuffer(raw, np.uint8, m, 8 * m).astype(bool)
        self.sizes = np.frombuffer(raw, "<u4", m, 9 * m).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.frame_first = np.concatenate(([0], np.cumsum(self.frames[:, 1] // 4)))
        self.open: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def frame(self, k: int) -> np.ndarray:
        if self.open[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[k]), int(self.frames[k, 0])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.open = k, np.frombuffer(raw, "<u4")
        return self.open[1]

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's document i; reads its frame only."""
        k = int(np.searchsorted(self.frame_first, self.first[i], "right")) - 1
        a = self.first[i] - self.frame_first[k]
        return self.frame(k)[a : a + self.sizes[i]]

    def find(self, doc_id: int) -> list[np.ndarray]:
        return [self.document(i) for i in np.flatnonzero((self.doc_ids == doc_id) & ~self.nulls)]


def write_files(docs: DataFrame, to: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, frame_ids: int = FRAME_IDS, files: int | None = None, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """Writes the files into the folder ``to`` and returns one row for each: file, part, n_docs, n_tokens, start (ids in the files before)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    if files is None:
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // rows_a_file))
    cuts = [k / files for k in range(1, files)]
    borders = sorted(set(docs.select(F.percentile_approx("i", cuts, max(10_000, 50 * files))).head()[0] or ())) if cuts else []
    # A hot doc_id has a range of its own, as wide as the files it takes; there are at most rows / rows_a_file of them.
    heavy = {r.i: -(-r["count"] // rows_a_file) for r in docs.groupBy("i").count().where(F.col("count") > rows_a_file).collect()}
    borders = np.array(sorted({*borders, *(x - k for x in heavy if x is not None for k in (0, 1))}), np.int64)
    wide = np.ones(len(borders) + 1, np.int64)  # ids up to a border and over the one before; then nulls with the rest, or apart
    for x, k in heavy.items():
        if x is not None:
            wide[np.searchsorted(borders, x)] = k
    begin = np.append(0, np.cumsum(wide))
    n_parts = int(begin[-1]) + heavy.get(None, 0)

    @F.arrow_udf("struct<ids:binary,part:int>")
    def encode(col: pa.Array, ids: pa.Array, spread: pa.Array) -> pa.Array:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        spread = spread.to_numpy()
        at = np.searchsorted(borders, ids.fill_null(0).to_numpy())
        part = begin[at] + spread % wide[at]
        part[null] = begin[-1] + spread[null] % heavy[None] if None in heavy else begin[-1] - 1
        out = [x + end for x in enc.encode(col)]
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(part, pa.int32())], names=["ids", "part"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(to)
        writer = name = out = None
        n_tokens, part, dtype = 0, 0, encoder(path).dtype
        for batch in batches:
            for i, ids, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    part, name = p, f"part-{p:06d}-{uuid.uuid4().hex}.ids.zst"
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    writer = FileWriter(out, frame_ids)
                ids = np.frombuffer(ids, dtype)
                writer.add(i, ids)
                n_tokens += len(ids)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([len(writer.docs)], pa.int64()), pa.array([n_tokens], pa.int64())], names=["file", "part", "n_docs", "n_tokens"])

    coded = docs.select("i", encode("t", "i", F.pmod(F.xxhash64("t"), F.lit(1 << 40))).alias("r")).select("i", "r.ids", "r.part")
    placed = coded.repartitionById(n_parts, F.col("part")).sortWithinPartitions(F.col("i").asc_nulls_last(), "ids")
    written = placed.mapInArrow(write, "file string, part int, n_docs long, n_tokens long").collect()  # a row for each file
    _remove_others(to, {r.file for r in written})
    start, rows = 0, []
    for r in sorted(written, key=lambda r: r.part):
        rows.append((r.file, r.part, r.n_docs, r.n_tokens, start))
        start += r.n_tokens
    return spark.createDataFrame(rows, "file string, part int, n_docs long, n_tokens long, start long")


def _remove_others(to: str, names: set[str]) -> None:
    """Removes from the folder what attempts left whose result didn't count."""
    fs, folder = pafs.FileSystem.from_uri(to)
    for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if f.base_name.endswith(".ids.zst") and f.base_name not in names:
            fs.delete_file(f.path)


def read_files(files: DataFrame, where: str) -> DataFrame:
    """All documents of the files, decoded: doc_id, start, n_tokens, ids_crc32, file, frame."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(where)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{folder}/{r['file']}") as f:
                    reader = FileReader(f, f.size())
                    n = len(reader.sizes)
                    frame = np.searchsorted(reader.frame_first, reader.first[:-1], "right") - 1
                    for a in range(0, n, 8192):
                        b = min(n, a + 8192)
                        crc = [zlib.crc32(reader.document(i).tobytes()) for i in range(a, b)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.doc_ids[a:b], pa.int64(), mask=reader.nulls[a:b]), pa.array(r["start"] + reader.first[a:b], pa.int64()), pa.array(reader.sizes[a:b], pa.int64()), pa.array(crc, pa.int64()), pa.array([r["file"]] * (b - a)), pa.array(frame[a:b], pa.int32())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "frame"],
                        )

    n = max(1, files.count())
    return files.repartitionByRange(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, frame int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    to = fresh_dir(spark, "token-files")
    files = write_files(table(spark, sf_dir, "documents"), to, public_tokenizers.path(MODEL))
    return read_files(files, to).select("doc_id", "start", "n_tokens", "ids_crc32")
