"""Token-id files: fixed-size id blocks as bit or byte planes, each compressed, with an index.

File format (all integers little-endian):

* header: 8 bytes ``DLTOKPL2``; u32 ids in a block; u8 planes kind (1 bit, 8 byte);
  3 zero bytes; u64 position of the file's first id in the corpus, 0 where it isn't known
  yet (files are written at once; the manifest gives their order and sizes);
* one chunk per block: for each of its planes a zstandard frame;
* index: per block u64 offset, u32 number of ids, then u32 size of each plane's frame
  (32 sizes for bit planes, 4 for byte planes);
* document table: a zstandard frame of document ids (i64), their token counts (u64), and a
  byte each: 1, or 0 for a document without an id;
* footer: u64 index offset, u32 blocks, u64 table offset, u32 table size, u64 documents,
  8 bytes ``DLTOKEND``.

Files are cut from the corpus in ascending document id order and never split a document,
so a reader needs one file for a document and, by the index, only the blocks it covers.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RunPool, cut, fresh_path, materialise, pieces, small_batches, span_bytes, uncollected, word_spans
from .storage import list_files, open_input, publish

MAGIC, END = b"DLTOKPL2", b"DLTOKEND"
HEAD, FOOT = struct.Struct("<8sIB3xQ"), struct.Struct("<QIQIQ8s")
BIT, BYTE = 1, 8


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == BYTE:
        return [raw[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    if kind == BYTE:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class Writer:
    """Writes one file block by block; at most one block of ids is held."""

    def __init__(self, out, first: int, block: int = 1 << 16, kind: int = BIT, level: int = 3):
        import zstandard

        self.out, self.block, self.kind = out, block, kind
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held, self.at, self.index = 0, HEAD.size, []
        self.docs: list[int] = []
        self.counts: list[int] = []
        self.known: list[bool] = []
        out.write(HEAD.pack(MAGIC, block, kind, first))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            full = len(flat) // self.block * self.block
            for at in range(0, full, self.block):
                self._chunk(flat[at : at + self.block])
            self.held, self.n_held = [flat[full:]], len(flat) - full

    def _chunk(self, ids: np.ndarray) -> None:
        frames = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        self.index.append((self.at, len(ids), *map(len, frames)))
        for f in frames:
            self.out.write(f)
            self.at += len(f)

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        planes = 32 if self.kind == BIT else 4
        for row in self.index:
            self.out.write(struct.pack(f"<QI{planes}I", *row))
        where = self.at + len(self.index) * (12 + 4 * planes)
        tables = self.zip.compress(np.array(self.docs, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes() + bytes(self.known))
        self.out.write(tables)
        self.out.write(FOOT.pack(self.at, len(self.index), where, len(tables), len(self.docs), END))


class Reader:
    """Reads blocks by the index; ``f`` is a seekable binary file."""

    def __init__(self, f):
        import zstandard

        self.f, self.unzip = f, zstandard.ZstdDecompressor()
        magic, self.block, self.kind, self.first = HEAD.unpack(f.read(HEAD.size))
        size = f.seek(0, 2)
        f.seek(size - FOOT.size)
        at, blocks, where, table, n, end = FOOT.unpack(f.read(FOOT.size))
        if magic != MAGIC or end != END:
            raise ValueError("not a token-plane file")
        row = struct.Struct(f"<QI{32 if self.kind == BIT else 4}I")
        f.seek(at)
        self.index = list(row.iter_unpack(f.read(row.size * blocks)))
        f.seek(where)
        raw = self.unzip.decompress(f.read(table), max_output_size=17 * n) if n else b""
        self.docs, self.counts = np.frombuffer(raw[: 8 * n], "<i8"), np.frombuffer(raw[8 * n : 16 * n], "<u8")
        self.known = np.frombuffer(raw[16 * n :], np.uint8) > 0
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def chunk(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            at, n, *sizes = self.index[k]
            self.f.seek(at)
            self.kept = k, from_planes([self.unzip.decompress(self.f.read(s), max_output_size=4 * n) for s in sizes], n, self.kind)
        return self.kept[1]

    def document(self, i: int) -> np.ndarray:
        """Ids of the file's i-th document."""
        lo, hi = int(self.starts[i]), int(self.starts[i + 1])
        parts = [self.chunk(k)[max(0, lo - k * self.block) : hi - k * self.block] for k in range(lo // self.block, -(-hi // self.block))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


#: White space at which every text may be cut: space, tab, newline, carriage return.
_CUTS = np.zeros(256, bool)
_CUTS[[9, 10, 13, 32]] = True
#: Bytes of plain letters (0: ASCII, or Latin-1 in UTF-8), of ASCII marks (1), others (2).
_KINDS = np.full(256, 2, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = 0
_KINDS[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 1


def _odd(text: np.ndarray) -> np.ndarray:
    """Bytes that are neither plain letter nor mark, or end a sign of times or division or ``<|``."""
    odd = _KINDS[text] == 2
    odd[1:] |= (text[:-1] == 0xC3) & ((text[1:] == 0x97) | (text[1:] == 0xB7)) | (text[:-1] == 0x3C) & (text[1:] == 0x7C)
    return odd


class ChunkTokenizer:
    """The tokenizers library over texts, asked once per distinct run without white space.

    ``whole`` asks the library for whole texts. Else a text is cut at space, tab, newline
    and carriage return, which is right for a tokenizer whose pre-tokenizer drops white
    space and whose normaliser looks at no neighbours beyond it; that is verified on one
    text of every batch. Letters that end in marks are runs apart if no apostrophe or
    special token can tie them. Runs are known by their bytes; their ids lie in one pool of at
    most about ``memo`` bytes, from which whole batches are put together.
    """

    def __init__(self, path: str, memo: int = 112 << 20, whole: bool = False):
        from tokenizers import Tokenizer

        self.library, self.whole = Tokenizer.from_file(path), whole
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # pieces that end a word
        self.last[[i for p, i in vocabulary.items() if p.endswith("</w>")]] = True
        self.runs = RunPool(memo)

    def _asked(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids; its fast call leaves out only the offsets."""
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, text: np.ndarray, sizes: np.ndarray):
        """Ids of runs: those that are one word each in long lines, the rest one by one."""
        begins = np.cumsum(sizes) - sizes
        kind, odd = _KINDS[text], _odd(text)
        odd[begins] = kind[begins] == 2  # what stands before is another run
        one = (np.maximum.reduceat(kind, begins) == np.minimum.reduceat(kind, begins)) & ~np.maximum.reduceat(odd, begins)
        rest, whole = np.flatnonzero(~one), np.flatnonzero(one)
        for at in range(0, len(whole), 4000):
            lot = whole[at : at + 4000]
            long = sizes[lot]
            line = np.full(int(long.sum()) + len(lot), 32, np.uint8)
            line[np.arange(int(long.sum())) + np.repeat(np.arange(len(lot)), long)] = span_bytes(text, begins[lot], long)
            ids = self._asked([line.tobytes().decode()])[0]
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(lot):
                yield lot, ids, np.diff(stops, prepend=0)
            else:
                rest = np.append(rest, lot)
        rest = np.sort(rest)
        for at in range(0, len(rest), 4000):
            lot = rest[at : at + 4000]
            got = self._asked(cut(span_bytes(text, begins[lot], sizes[lot]), sizes[lot]))
            yield lot, np.concatenate(got), np.array([len(x) for x in got], np.int64)

    @staticmethod
    def _apart(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, counts: np.ndarray):
        """Runs of letters that end in marks as two runs: (begins, ends, counts)."""
        some = np.flatnonzero((_KINDS[raw[ends - 1]] == 1) & (_KINDS[raw[begins]] == 0)) if len(begins) else begins
        if not len(some):
            return begins, ends, counts
        sizes = ends[some] - begins[some]
        text = span_bytes(raw, begins[some], sizes)
        first = np.cumsum(sizes) - sizes
        kind, odd = _KINDS[text], _odd(text)
        odd[first] = kind[first] == 2  # what stands before is another run
        turn = np.append(False, kind[1:] != kind[:-1])  # a mark after a letter, or a letter after a mark
        turn[first] = False
        fit = np.flatnonzero(~np.maximum.reduceat(odd, first) & (np.add.reduceat(turn, first, dtype=np.int32) == 1))
        where = np.flatnonzero(turn)
        where = where[np.searchsorted(where, first[fit])]
        at = begins[some[fit]] + where - first[fit]
        doc = np.searchsorted(np.cumsum(counts), some[fit], "right")
        return np.sort(np.append(begins, at)), np.sort(np.append(ends, at)), counts + np.bincount(doc, minlength=len(counts))

    def encode_batch(self, column: pa.Array, end: int | None) -> list[np.ndarray]:
        """Ids of every text of a column, each followed by ``end``; nulls count as empty."""
        tail = [] if end is None else [end]
        if self.whole:
            return [np.array(e.ids + tail, np.uint32) for e in self.library.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        raw, *spans = word_spans(column, _CUTS)
        begins, ends, counts = self._apart(raw, *spans)
        got = self.runs.fill(raw, begins, ends, counts, self._learn, tail)
        k = len(counts) // 2
        if len(counts) and got[k].tolist() != self.library.encode(column[k].as_py() or "", add_special_tokens=False).ids + tail:
            raise AssertionError("this tokenizer doesn't treat runs between white space alone; use whole=True")
        return got


_TOKENIZERS: dict[tuple[str, bool], ChunkTokenizer] = {}


def write_tokens(docs: DataFrame, tokenizer: str, out_dir: str, end_id: int | None = 1, kind: int = BYTE, block: int = 1 << 16, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write the ids, ascending by document id; the manifest.

    Null texts count as empty (only the end id). Repeated ids are kept, ordered by their
    texts; rows with a null id come first and keep it. An empty table gives no file. The rows
    are dealt by ranges of (id, text hash), so neither a hot source nor long texts gather in
    one task. Files are published by rename under names of their own; only those of tasks
    that finished are in the manifest, and only those are read.
    Manifest: path, part (order of files), n_docs, n_tokens.
    """
    small_batches(docs)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = "path string, part long, n_docs long, n_tokens long, first_id long"

    def run(batches):
        from pyspark import TaskContext

        key = (tokenizer, whole)
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = ChunkTokenizer(tokenizer, whole=whole)
        part = TaskContext.get().partitionId()
        writer = None
        tokens = docs_n = 0
        first = None
        with uncollected():
            for b in pieces(batches, 1024, 4 << 20):
                if writer is None:
                    temp = publish(out_dir, f"part-{part:06d}-{uuid.uuid4().hex}.dlt")
                    out = temp.open()
                    writer, first = Writer(out, 0, block, kind), b.column(0)[0].as_py()
                for d, ids in zip(b.column(0).to_pylist(), _TOKENIZERS[key].encode_batch(b.column(1), end_id)):
                    writer.add(d, ids)
                    tokens += len(ids)
                docs_n += b.num_rows
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": temp.done(), "part": part, "n_docs": docs_n, "n_tokens": tokens, "first_id": first}])

    return materialise(dealt.mapInArrow(run, schema), "token-manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files of a manifest: place, size and crc32 of its ids.

    Files are read one task each; the start of a file is the number of ids in the files
    before it, summed over the manifest (one row a file).
    """
    spark = manifest.sparkSession
    files = sorted(manifest.collect(), key=lambda r: r.part)
    starts, at = [], 0
    for r in files:
        starts.append((r.path, at))
        at += r.n_tokens
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema.add("token_ids", T.ArrayType(T.LongType()))
    todo = spark.createDataFrame(starts, "path string, start long").repartition(max(1, len(starts)), "path") if starts else spark.createDataFrame([], "path string, start long")

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open_input(path) as f:
                    r = Reader(f)
                    for lo in range(0, len(r.docs), 2048):
                        hi = min(lo + 2048, len(r.docs))
                        ids = [r.document(i) for i in range(lo, hi)]
                        cols = [pa.array(r.docs[lo:hi], mask=~r.known[lo:hi]), pa.array(r.starts[lo:hi] + start), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids], pa.int64())]
                        if with_ids:
                            cols.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return todo.mapInArrow(run, schema)


def store_and_read(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Write the ids into the shared folder, and the documents as read back from there."""
    return read_tokens(write_tokens(docs, tokenizer, fresh_path(docs.sparkSession, "tokens"), **how))


def remove(manifest: DataFrame) -> None:
    for path in list_files([r.path for r in manifest.collect()]):
        path.delete()
