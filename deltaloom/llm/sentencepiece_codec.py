"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding keeps a score-ordered agenda (a heap) of adjacent symbol pairs: the pair whose
joined piece has the highest score, leftmost on ties, is merged first. A text is first cut
wherever no piece of the vocabulary can span the cut; the agenda's result on each chunk is
then the same as on the whole text, so chunks can be kept in a bounded pool, where they are
known by their bytes. In every Arrow batch the chunks that are new to the pool and one whole
text are checked against the sentencepiece library, and all decoded texts.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import RunPool, cut, pieces, small_batches, uncollected, word_spans

SPACE = "▁"
_NOTHING = np.zeros(256, bool)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(field number, value) of a protobuf message; values are ints or bytes."""

    def varint(at):
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceCodec:
    """Encoder and decoder of one model file.

    Only what merge-type models with an identity normaliser need is built: other models
    are refused with ValueError when loaded.
    """

    def __init__(self, model_file: str, memo: int = 40 << 20, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        trainer, normaliser = {}, {}
        with open(model_file, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 2:
                    trainer = dict(_fields(value))
                elif number == 3:
                    normaliser = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type (BPE) model")
        if normaliser.get(2) or normaliser.get(4, 1) or trainer.get(24, 0):
            raise ValueError("only identity normalisation that keeps white space, with a prefix space, is supported")
        self.prefix = SPACE if normaliser.get(3, 1) else ""
        sp = self.library
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.ids, self.scores, self.byte_ids, self.unused = {}, {}, {}, set()
        self.byte_of: dict[int, int] = {}
        self.silent = set()
        self.unknown = sp.unk_id()
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[1:-1], 16)] = i
                self.byte_of[i] = int(p[1:-1], 16)
            elif sp.is_control(i):
                self.silent.add(i)
            elif not sp.is_unknown(i):
                self.ids[p], self.scores[p] = i, sp.get_score(i)
                if sp.is_unused(i):
                    raise ValueError("unused pieces are not supported")
        with_symbols = [v for n, v in _model_pieces(model_file) if n == USER_DEFINED]
        if with_symbols:
            raise ValueError("user-defined symbols are not supported")
        self.fallback = len(self.byte_ids) == 256
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: Whether no piece goes on with a space after something else, so that words stand alone.
        self.apart = not any(p[1] == SPACE != p[0] for p in self.inside)
        self.pool, self.runs, self.check = RunPool(memo), {}, check
        self.names = list(map(str, range(len(self.pieces))))
        #: What decoding shows of each id; a byte piece stands as a lone surrogate, which no piece
        #: holds, and a control piece as another, since it ends a run of bytes.
        self.shown = [p.replace(SPACE, " ") for p in self.pieces]
        for i, b in self.byte_of.items():
            self.shown[i] = chr(0xDC00 + b)
        for i in self.silent:
            self.shown[i] = _MUTE
        self.shown[self.unknown] = " ⁇ "

    def agenda(self, text: str) -> list[int]:
        """Ids of a run of symbols that no cut divides."""
        n, scores = len(text), self.scores
        if n == 1:
            return self._final(text)
        symbols: list[str | None] = list(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-scores[pair], i, pair) for i, pair in enumerate(map("".join, zip(text, text[1:]))) if pair in scores]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, joined = pop(heap)
            j = after[i]
            if symbols[i] is None or j < 0 or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                score = scores.get(pair := joined + symbols[k])
                if score is not None:
                    push(heap, (-score, i, pair))
            h = before[i]
            if h >= 0:
                score = scores.get(pair := symbols[h] + joined)
                if score is not None:
                    push(heap, (-score, h, pair))
        out, i = [], 0
        while i >= 0:
            out += self._final(symbols[i])
            i = after[i]
        return out

    def _final(self, symbol: str) -> list[int]:
        got = self.ids.get(symbol)
        if got is not None:
            return [got]
        if self.fallback:
            return [self.byte_ids[b] for b in symbol.encode()]
        return [self.unknown]

    def chunk(self, word: str) -> list[int]:
        """Ids of a chunk; cut further between characters that no piece has side by side."""
        inside, runs, out, at = self.inside, self.runs, [], 0
        for i in [*[i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inside], len(word)]:
            got = runs.get(run := word[at:i])
            if got is None:
                got = runs[run] = self.agenda(run)
            out += got
            at = i
        if not self.fallback:  # the library shows a run of unknown symbols as one
            out = [x for k, x in enumerate(out) if x != self.unknown or not k or out[k - 1] != x]
        return out

    def _learn(self, text: np.ndarray, sizes: np.ndarray):
        """Encode chunks for the pool, and check them against the library in one batch."""
        if len(self.runs) > 60_000:
            self.runs.clear()
        words = [w.replace(" ", SPACE) for w in cut(text, sizes)]
        new = [self.chunk(w) for w in words]
        if self.check and self.prefix:
            at = [i for i, w in enumerate(words) if w[0] == SPACE and w != SPACE]
            for i, said in zip(at, self.library.encode([words[i][1:].replace(SPACE, " ") for i in at], num_threads=1)):
                if said != new[i]:
                    raise AssertionError(f"agenda and library differ on {words[i]!r}: {new[i]} and {said}")
        sizes = np.fromiter(map(len, new), np.int32, len(new))
        yield np.arange(len(new)), np.fromiter((x for ids in new for x in ids), np.uint32, int(sizes.sum())), sizes

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; nulls count as empty."""
        # a run is spaces and what follows them up to the next space; literal piece spaces are the same
        column = pa.array([self.prefix.replace(SPACE, " ") + t.replace(SPACE, " ") if t else "" for t in texts], pa.large_string())
        raw, begins, ends, counts = word_spans(column, _NOTHING)
        if self.apart and len(raw):
            space = raw == 32
            cut = np.append(False, space[1:] & ~space[:-1])
            cut[begins] = False
            at = np.flatnonzero(cut)
            owner = np.searchsorted(begins, at, "right") - 1  # the text of each cut, among those not empty
            counts[np.flatnonzero(counts)] += np.bincount(owner, minlength=len(begins))
            begins, ends = np.sort(np.append(begins, at)), np.sort(np.append(ends, at))
        got = [ids.tolist() for ids in self.pool.fill(raw, begins, ends, counts, self._learn, [])]
        if not self.fallback:  # the library shows a run of unknown symbols as one
            got = [[x for k, x in enumerate(ids) if x != self.unknown or not k or ids[k - 1] != x] for ids in got]
        if self.check and texts:
            k = len(texts) // 2
            if got[k] != self.library.encode(texts[k] or ""):
                raise AssertionError(f"agenda and library differ on a whole text of {len(texts[k] or '')} characters")
        return got

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, the prefix space dropped."""
        shown = self.shown
        text = "".join([shown[i] for i in ids])
        mute = len(text) - len(text.lstrip(_MUTE))  # control pieces at its start
        if self.prefix and text[mute : mute + 1] == " " and ids[mute] != self.unknown:
            text = text[mute + 1 :]
        return text if text.isascii() else _HIDDEN.sub(_from_hidden, text)


def _model_pieces(model_file: str):
    with open(model_file, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                got = dict(_fields(value))
                yield got.get(3, NORMAL), got.get(1)


_MUTE = "\ud800"
_HIDDEN = re.compile("[\udc00-\udcff]+|\ud800+")


def _from_hidden(found: re.Match) -> str:
    """The text of byte pieces that stand side by side; none for control pieces."""
    run = found[0]
    return "" if run[0] == _MUTE else _from_bytes(run.encode("utf-16-le", "surrogatepass")[::2])


def _from_bytes(run: bytes) -> str:
    """Well-formed UTF-8 as text; each byte that isn't part of it as U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Token digests of every whole text, and of the text that its ids decode to.

    Null texts count as empty: no ids, digests of the empty string. Repeated rows each give
    a row; a null id stays null; other columns of ``docs`` are ignored. ``with_ids`` adds
    ``token_ids``, ``with_text`` adds ``decoded``.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        schema.add("token_ids", T.ArrayType(T.IntegerType()))
    if with_text:
        schema.add("decoded", T.StringType())

    def run(batches):
        own = codec(model_file)
        with uncollected():
            for b in pieces(batches, 512, 2 << 20):
                coded = own.encode_batch(b.column(1).to_pylist())
                back = [own.decode(ids) for ids in coded]
                if own.check and back != own.library.decode(coded):
                    raise AssertionError("decoded texts differ from the library's")
                cols = [
                    b.column(0).cast(pa.int64()),
                    pa.array(list(map(len, coded)), pa.int64()),
                    pa.array([hashlib.sha256(",".join([own.names[i] for i in ids]).encode()).hexdigest() for ids in coded], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                ]
                if with_ids:
                    cols.append(pa.array(coded, pa.list_(pa.int32())))
                if with_text:
                    cols.append(pa.array(back, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    small_batches(docs)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
