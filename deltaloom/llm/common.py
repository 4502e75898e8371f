"""Helpers that the operators share: shared storage, Arrow maps, vectorised words."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib
import re
import secrets
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The white space that separates words, as bytes: space, tab to carriage return.
WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space, control characters and ASCII punctuation: only letters, digits and all beyond ASCII make words.
LOOSE_SPACE = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests in one process) is a
    local folder made and set for the life of the SparkContext; a cluster without it is
    refused, as its executors couldn't see one another's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="deltaloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage durably."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> None:
    """Lets Spark hand at most 4 MB of rows to Python at a time, unless less is set."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name).rstrip("bB")) > 4 << 20:
        conf.set(name, str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def pieces(batches, max_rows: int = 512, max_bytes: int = 8 << 20):
    """Arrow batches cut into slices of at most ``max_rows`` rows, fewer if they are large."""
    try:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            step = max(1, min(max_rows, int(rows * max_bytes / max(batch.nbytes, 1))))
            for at in range(0, rows, step):
                yield batch.slice(at, step)
            del batch
    finally:
        _give_back()


@contextlib.contextmanager
def uncollected():
    """No garbage collection meanwhile: for work that makes many small lists, none in cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.collect()


def carried(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, str]:
    """(doc_id, text, then the carried columns), and the carried columns' schema."""
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) if carry else ""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[docs[c].alias(f"_carried_{i}") for i, c in enumerate(carry)]), fields


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BASE = 0x5851F42D4C957F2D
#: Words of at most so many bytes are hashed by table; longer ones one by one.
_SPAN = 48
#: Bytes that are hashed at a time.
_STRETCH = 1 << 17


@functools.lru_cache(maxsize=4)
def _random_table(key: bytes) -> np.ndarray:
    """A random number for each place in a word and each byte there, drawn from ``key``."""
    return np.frombuffer(hashlib.shake_128(key).digest(_SPAN * 256 * 8), np.uint64)


def new_key() -> bytes:
    """A key for hashes: drawn anew for each job, so that no text can be made to collide."""
    return secrets.token_bytes(16)


def _stretch(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, fold: np.ndarray, key: bytes) -> np.ndarray:
    sizes = ends - begins
    if int(sizes.max()) > _SPAN:
        out, short = np.empty(len(begins), np.uint64), sizes <= _SPAN
        if short.any():
            out[short] = _stretch(raw, begins[short], ends[short], fold, key)
        for i in np.flatnonzero(~short):
            out[i] = int.from_bytes(hashlib.blake2b(fold[raw[begins[i] : ends[i]]].tobytes(), digest_size=8, key=key).digest(), "little")
        return out
    lo, hi = int(begins[0]), int(ends[-1])
    place = np.arange(lo, hi, dtype=np.int32) - np.repeat(begins.astype(np.int32), np.diff(np.append(begins, hi)))
    np.minimum(place, _SPAN - 1, out=place)
    sums = np.zeros(hi - lo + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_random_table(key)[(place << 8) + fold[raw[lo:hi]]], out=sums[1:])
        return sums[ends - lo] - sums[begins - lo]


def word_spans(column: pa.Array, space: np.ndarray = WORD_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, where their words begin and end, and each text's word count.

    A word is a maximal run of bytes that ``space`` doesn't mark. Nulls and empty texts have
    no words.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n, none = len(column), np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint8), none, none, none
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    if not len(raw):
        return raw, none, none, np.zeros(n, np.int64)
    bounds = bounds - bounds[0]
    solid = ~space[raw]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    cuts = bounds[1:-1][bounds[1:-1] < len(raw)]
    start[cuts] = solid[cuts]
    end = np.zeros(len(raw), bool)
    end[:-1] = solid[:-1] & (~solid[1:] | start[1:])
    end[-1] = solid[-1]
    begins, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return raw, begins, ends, np.diff(np.searchsorted(begins, bounds))


def hash_spans(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, fold: np.ndarray, key: bytes) -> np.ndarray:
    """64-bit hashes of the words at these places, their bytes mapped by ``fold``.

    A hash is the sum, modulo 2**64, of random numbers, one for each place and byte: any two
    different words collide with a chance of 2**-64 over the choice of ``key``, whatever they
    are. Words longer than the table have a keyed BLAKE2b hash.
    """
    words = np.empty(len(begins), np.uint64)
    cuts = np.unique(np.searchsorted(begins, np.arange(0, len(raw), _STRETCH)))
    for i, j in zip(cuts, [*cuts[1:], len(begins)]):
        if i < j:
            words[i:j] = _stretch(raw, begins[i:j], ends[i:j], fold, key)
    return words


def word_hashes(column: pa.Array, key: bytes, space: np.ndarray = WORD_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every text's words, A-Z lower-cased, and each text's word count."""
    raw, begins, ends, counts = word_spans(column, space)
    return hash_spans(raw, begins, ends, _LOWER, key), counts


def span_bytes(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after the other."""
    kind = np.int32 if len(raw) < 1 << 31 else np.int64
    ahead = np.cumsum(sizes, dtype=kind)
    return raw[np.arange(int(ahead[-1]) if len(ahead) else 0, dtype=kind) + np.repeat(begins.astype(kind) - ahead + sizes.astype(kind), sizes)]


#: What to keep of an 8-byte word that holds so many bytes of a run.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _words_at(text: np.ndarray) -> np.ndarray:
    """The 8-byte words that begin at each byte of ``text``, as a view; the last 7 bytes begin none."""
    return np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))


class Places:
    """Numbers of distinct hashes: a table with open addressing that a whole batch probes at once."""

    def __init__(self, most: int):
        self.keys, self.slots, self.n = np.zeros(most, np.uint64), np.full(1 << 16, -1, np.int32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of hashes; -1 for those that aren't known."""
        mask, step = _U(len(self.slots) - 1), 0
        out = self.slots[hashes & mask]
        rest = np.flatnonzero((self.keys[out] != hashes) & (out >= 0))
        while len(rest):
            step += 1
            out[rest] = got = self.slots[(hashes[rest] + _U(step)) & mask]
            rest = rest[(self.keys[got] != hashes[rest]) & (got >= 0)]
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Enter hashes that aren't known; their numbers follow those there are, in any order."""
        self.n += len(hashes)
        if self.n > len(self.keys):
            self.keys = np.append(self.keys, np.zeros(self.n, np.uint64))
        self.keys[numbers] = hashes
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.n).bit_length(), -1, np.int32)
            numbers = np.arange(self.n, dtype=np.int32)
        mask, step = _U(len(self.slots) - 1), 0
        while len(numbers):
            slot = (self.keys[numbers] + _U(step)) & mask
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            numbers, step = numbers[self.slots[slot] != numbers], step + 1


class RunPool:
    """Ids of runs of bytes, kept in at most about ``limit`` bytes.

    Runs are looked up by 64-bit hashes under a random key, and every hit is confirmed: the
    run's own bytes are compared with those kept. If two runs ever had one hash, the pool is
    emptied and filled again under another key.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.key = new_key()
        self.size_keys = np.frombuffer(hashlib.shake_128(self.key).digest(8 * (_SPAN + 1)), np.uint64)
        # as large as the limit lets them get and a quarter more: pages that nothing is written to
        # take no memory, and arrays that don't grow are never held twice
        most = self.limit + self.limit // 4
        self.columns = {"ids": np.zeros(most // 4 + 8, np.uint32), "text": np.zeros(most + 8, np.uint8)} | {n: np.zeros(most // 32 + 8, np.int32) for n in ("at", "size", "text_at", "text_size")}
        self.places = Places(most // 32 + 8)
        self.n = self.n_ids = self.n_text = 0

    def _append(self, name: str, used: int, values: np.ndarray) -> None:
        have = self.columns[name]
        if used + len(values) + 8 > len(have):  # the last run's words reach beyond it
            grown = np.zeros(max(used + len(values) + 8, len(have) + (len(have) >> 1)), have.dtype)
            grown[:used] = have[:used]
            have = self.columns[name] = grown
        have[used : used + len(values)] = values

    def _add(self, text: np.ndarray, text_sizes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep runs, one after the other."""
        n = len(sizes)
        for name, used, values in (
            ("ids", self.n_ids, ids), ("text", self.n_text, text), ("at", self.n, self.n_ids + np.cumsum(sizes) - sizes), ("size", self.n, sizes),
            ("text_at", self.n, self.n_text + np.cumsum(text_sizes) - text_sizes), ("text_size", self.n, text_sizes),
        ):
            self._append(name, used, values)
        self.n, self.n_ids, self.n_text = self.n + n, self.n_ids + len(ids), self.n_text + len(text)

    def _hashes(self, raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keyed hashes of runs, a word of 8 bytes at a time; long ones have a BLAKE2b hash."""
        words = _words_at(raw)
        out = mix64((words[begins] & _KEEP[np.minimum(sizes, 8)]) ^ self.size_keys[np.minimum(sizes, _SPAN)])
        some = np.flatnonzero((sizes > 8) & (sizes <= _SPAN))
        for i in range(8, _SPAN, 8):
            out[some] = mix64(out[some] ^ (words[begins[some] + i] & _KEEP[np.minimum(sizes[some] - i, 8)]))
            some = some[sizes[some] > i + 8]
        for k in np.flatnonzero(sizes > _SPAN):
            out[k] = int.from_bytes(hashlib.blake2b(raw[begins[k] : begins[k] + sizes[k]].tobytes(), digest_size=8, key=self.key).digest(), "little")
        return out

    def _confirmed(self, raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> bool:
        """Whether each run's bytes are those kept at its place."""
        if not np.array_equal(self.columns["text_size"][place], sizes):
            return False
        text, at = self.columns["text"], self.columns["text_at"][place]
        words, kept = _words_at(raw), _words_at(text)
        if ((words[begins] ^ kept[at]) & _KEEP[np.minimum(sizes, 8)]).any():
            return False
        some = np.flatnonzero((sizes > 8) & (sizes <= _SPAN))
        for i in range(8, _SPAN, 8):
            if ((words[begins[some] + i] ^ kept[at[some] + i]) & _KEEP[np.minimum(sizes[some] - i, 8)]).any():
                return False
            some = some[sizes[some] > i + 8]
        return all(np.array_equal(raw[begins[k] : begins[k] + sizes[k]], text[at[k] : at[k] + sizes[k]]) for k in np.flatnonzero(sizes > _SPAN))

    def _find(self, raw, begins, ends, learn) -> np.ndarray:
        """Each run's number in the pool, once those not yet known are learned."""
        if 40 * self.n + 4 * self.n_ids + self.n_text > self.limit:
            self._forget()
        raw, sizes = np.append(raw, np.zeros(8, np.uint8)), ends - begins
        while True:
            hashes = self._hashes(raw, begins, sizes)
            place = self.places.find(hashes)
            new = np.flatnonzero(place < 0)
            if len(new):
                hashes, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
                at, fresh = new[first], np.empty(len(hashes), np.int32)
                text = span_bytes(raw, begins[at], sizes[at])
                starts = np.cumsum(sizes[at]) - sizes[at]
                for own, ids, counts in learn(text, sizes[at]):
                    fresh[own] = np.arange(self.n, self.n + len(own), dtype=np.int32)
                    self._add(span_bytes(text, starts[own], sizes[at[own]]), sizes[at[own]], ids, counts)
                self.places.add(hashes, fresh)
                place[new] = fresh[back]
            if self._confirmed(raw, begins, sizes, place):
                return place
            self._forget()

    def fill(self, raw, begins, ends, counts, learn, tail: list[int]) -> list[np.ndarray]:
        """Each text's ids, run after run, then ``tail``.

        ``learn`` gets the bytes of runs not yet known, one after the other, and their sizes,
        and yields (their numbers, ascending; their ids one after the other; how many each has).
        """
        place = self._find(raw, begins, ends, learn)
        start, size = self.columns["at"][place], self.columns["size"][place]
        ahead = np.cumsum(size, dtype=np.int32)  # a batch has fewer ids than bytes
        total, more = int(ahead[-1]) if len(ahead) else 0, len(tail)
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts) * more
        stops = np.append(0, ahead)[np.append(0, np.cumsum(counts))] + np.arange(len(counts) + 1) * more
        out = np.empty(total + len(counts) * more, np.uint32)
        step = np.arange(total, dtype=np.int32)
        out[step + np.repeat(doc, size)] = self.columns["ids"][step + np.repeat(start - ahead + size, size)]
        for k, t in enumerate(tail):
            out[stops[1:] - more + k] = t
        return [out[lo:hi] for lo, hi in zip(stops, stops[1:])]


def cut(text: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The strings whose bytes stand one after the other."""
    raw, ends = text.tobytes(), np.cumsum(sizes).tolist()
    return [raw[lo:hi].decode() for lo, hi in zip([0, *ends], ends)]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    width = min(width, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - width + 1, _U(width))
        for i in range(width):
            out = out * _U(_BASE) + words[i : len(words) - width + 1 + i]
            out ^= out >> _U(29)
        return mix64(out)
