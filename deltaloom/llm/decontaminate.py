"""Benchmark decontamination: BM25 over the test items with block-max WAND.

The benchmark is the index, the corpus asks: every document is cut into overlapping
passages, each passage retrieves all index units whose BM25 score reaches a share of the
unit's score against itself, and a retrieved item counts only if the document also has its
question and its answer, by shared word shingles. Words are lower-cased runs of letters,
digits and characters beyond ASCII, so marks put around them don't hide a copy.

Block-max WAND: a term's postings are in order of units and cut into blocks; each block of
postings has its maximum impact, so there are never more maxima than postings. A passage
first meets the terms' overall maxima, then the block maxima; only blocks that can still
reach the threshold are entered, where cursors are moved by the usual pivot rule and only
pivots are scored.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOOSE_SPACE, fresh_path, materialise, new_key, pieces, shingle_hashes, small_batches, word_hashes
from .storage import open_input, publish

RESULT = "doc_id long, item_id long, score double, passage long, question_overlap double, answer_overlap double"


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): after the first question mark, else the last sentence; else none."""
    if (at := text.find("?")) >= 0:
        return text[: at + 1], text[at + 1 :]
    cuts = [m.end() for m in re.finditer(r"[.!…](?=\s)", text.rstrip())]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts else (text, "")


def _words(texts: list[str], key: bytes) -> list[np.ndarray]:
    words, counts = word_hashes(pa.array(texts, pa.string()), key, LOOSE_SPACE)
    return np.split(words, np.cumsum(counts)[:-1]) if texts else []


def _units(words: np.ndarray, unit: int) -> list[np.ndarray]:
    lots = -(-len(words) // unit)
    return np.array_split(words, lots) if lots else []


class BlockMaxIndex:
    """BM25 impacts of index units, each as a share of the unit's score against itself."""

    def __init__(self, items: list[tuple[int, str]], unit: int = 64, block: int = 8, k1: float = 1.2, b: float = 0.75, width: int = 5, key: bytes | None = None, whole: tuple | None = None):
        """``whole`` has (units, mean length, terms, document frequencies) of a benchmark of which these items are a part."""
        self.unit, self.block, self.width, self.key = unit, block, width, key or new_key()
        self.items = [i for i, _ in items]
        parts = [split_item(t) for _, t in items]
        texts, asked, answered = (_words(t, self.key) for t in ([t for _, t in items], [q for q, _ in parts], [a for _, a in parts]))
        # the width of each side's shingles; a shorter side is one shingle of all its words
        self.sides = [[(min(width, len(w)), np.unique(shingle_hashes(w, width))) if len(w) else None for w in (q, a)] for q, a in zip(asked, answered)]
        made = [(lot, i) for i, w in enumerate(texts) for lot in _units(w, unit)]
        # units with similar words next to each other make block maxima tight
        made.sort(key=lambda m: int(np.bitwise_and(m[0], np.uint64(0xFFFF)).min()))
        units, self.item_of = [m[0] for m in made], np.array([m[1] for m in made], np.int64)
        n = self.n = len(units)
        length = np.array([len(w) for w in units], float)
        words = np.concatenate(units) if n else np.zeros(0, np.uint64)
        self.terms, at = np.unique(words, return_inverse=True)
        pair, tf = np.unique(at * max(n, 1) + np.repeat(np.arange(n), length.astype(int)), return_counts=True)
        term, owner = pair // max(n, 1), pair % max(n, 1)  # by term, then unit
        if whole:
            all_units, mean = whole[:2]
            df = np.asarray(whole[3])[np.searchsorted(whole[2], self.terms)]
        else:
            all_units, mean, df = n, length.mean() if n else 1.0, np.bincount(term, minlength=len(self.terms))
        idf = np.log(1 + (all_units - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[owner] / max(mean, 1)))
        self.impact = impact / np.bincount(owner, impact, max(n, 1))[owner]
        self.owner = owner.astype(np.int32)
        self.blocks = max(1, -(-n // block))
        self.best = np.zeros(len(self.terms))
        np.maximum.at(self.best, term, self.impact)
        # blocks of postings: where they begin, their block of units and their maximum
        lead = np.append(len(term) > 0, (term[1:] != term[:-1]) | (owner[1:] // block != owner[:-1] // block))
        begins = np.flatnonzero(lead)
        self.at = np.append(begins, len(term)).astype(np.int32)
        self.of_block = (owner[begins] // block).astype(np.int32)
        self.block_best = np.maximum.reduceat(self.impact, begins) if len(begins) else np.zeros(0)
        self.starts = np.searchsorted(term[begins], np.arange(len(self.terms) + 1)).astype(np.int32)

    def nbytes(self) -> int:
        """Bytes of the index's arrays."""
        arrays = [self.terms, self.best, self.owner, self.impact, self.at, self.of_block, self.block_best, self.starts, self.item_of]
        return sum(a.nbytes for a in arrays) + sum(s[1].nbytes for pair in self.sides for s in pair if s)

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Term numbers of words; -1 for words that no unit has."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def wand(self, own: np.ndarray, least: float) -> list[tuple[int, float]]:
        """Units that score ``least`` or more against the terms of some blocks of postings.

        ``own`` are the terms' posting blocks of one and the same block of units.
        """
        none = self.n
        cursors = [[int(self.owner[self.at[i]]), int(self.at[i]), int(self.at[i + 1]), float(self.block_best[i])] for i in own]  # next unit, position, end, maximum
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += c[3]
                if total >= least - 1e-6:
                    pivot = i
                    break
            if pivot < 0:
                break
            unit = cursors[pivot][0]
            if cursors[0][0] == unit:
                # rounded, so that the order of the terms makes no difference
                score = round(sum(float(self.impact[c[1]]) for c in cursors if c[0] == unit), 9)
                if score >= least:
                    out.append((unit, score))
                target = unit + 1
            else:
                target = unit
            for c in cursors:
                if c[0] < target:
                    while c[1] < c[2] and self.owner[c[1]] < target:
                        c[1] += 1
                    c[0] = int(self.owner[c[1]]) if c[1] < c[2] else none
            cursors = [c for c in cursors if c[0] < none]
        return out

    def passages(self, words: np.ndarray, counts: np.ndarray, least: float):
        """(document, passage, unit, score) of all that reaches ``least``.

        ``words`` are the words of all documents one after the other. Passages are twice
        ``unit`` words long and start every ``unit`` words, so a copy of a unit lies whole
        in one of them.
        """
        step = self.unit
        doc = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        term = self.lookup(words)
        keep = np.flatnonzero(term >= 0)
        doc, lot, term = doc[keep], place[keep] // step, term[keep]
        lots = np.maximum(-(-counts // step), 1)
        base = np.cumsum(lots) - lots
        cell = base[doc] + lot  # half passages; passage c is the halves c and c + 1
        cells = int(lots.sum())
        # overall maxima, each term once in a half
        key = np.unique(cell * (len(self.terms) + 1) + term) if len(cell) else np.zeros(0, np.int64)
        cell, term = key // (len(self.terms) + 1), key % (len(self.terms) + 1)
        half = np.bincount(cell, self.best[term], cells)
        last = np.zeros(cells + 1, bool)
        last[(base + lots - 1)] = True
        both = half + np.where(last[:-1], 0, np.append(half[1:], 0))
        alive = np.flatnonzero(both >= least - 1e-6)
        if not len(alive):
            return
        begins = np.searchsorted(cell, np.arange(cells + 1))
        owner = np.repeat(np.arange(len(counts)), lots)
        for c in alive:
            end = begins[c + 1] if last[c] else begins[c + 2]
            terms = np.unique(term[begins[c] : end])
            if self.best[terms].sum() < least - 1e-6:
                continue
            sizes = self.starts[terms + 1] - self.starts[terms]
            ahead = np.cumsum(sizes)
            own = np.arange(ahead[-1]) + np.repeat(self.starts[terms] - ahead + sizes, sizes)
            block = self.of_block[own]
            for k in np.flatnonzero(np.bincount(block, self.block_best[own], self.blocks) >= least - 1e-6):
                for unit, score in self.wand(own[block == k], least):
                    yield int(owner[c]), int(c - base[owner[c]]), unit, score

    def overlaps(self, item: int, words: np.ndarray, made: dict) -> tuple[float, float]:
        """Shares of the item's question and answer shingles that a document has."""
        out = []
        for side in self.sides[item]:
            if side is None:
                out.append(1.0)
                continue
            width, shingles = side
            if width not in made:
                made[width] = np.unique(shingle_hashes(words, width)) if len(words) >= width else np.zeros(0, np.uint64)
            out.append(float(np.isin(shingles, made[width], assume_unique=True).mean()))
        return out[0], out[1]


def _frequencies(tests: DataFrame, unit: int, key: bytes) -> tuple[int, float, DataFrame]:
    """Units, their mean length, and (shard, term, df): each shard's terms with their number of units in all shards."""

    def run(batches):
        for b in pieces(batches):
            words = _words([t or "" for t in b.column(1).to_pylist()], key)
            for shard, w in zip(b.column(0).to_pylist(), words):
                found, n = np.unique(np.concatenate([np.unique(u) for u in _units(w, unit)]), return_counts=True) if len(w) else (w, w)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(found), pa.int64()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64)), pa.array([0] * len(found), pa.int64())], names=["shard", "term", "n", "words"])
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0]), pa.array([-(-len(w) // unit)]), pa.array([len(w)])], names=["shard", "term", "n", "words"])

    found = materialise(tests.select("shard", "text").mapInArrow(run, "shard long, term long, n long, words long").groupBy("shard", "term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "benchmark-terms")
    sums = found.where("shard = -1").first()
    totals = found.where("shard >= 0").groupBy("term").agg(F.sum("n").alias("df"))
    units, words = (sums.n, sums.words) if sums else (0, 0)
    return units, words / max(units, 1), materialise(found.where("shard >= 0").select("shard", "term").join(totals, "term"), "benchmark-frequencies")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, overlap: float = 0.75, unit: int = 64, shard_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, one row each.

    doc_id, item_id, score (share of the item unit's own score, the best of all passages),
    passage (number of that passage in the document), question_overlap and answer_overlap
    (shares of their shingles that the whole document has; both at least ``overlap``; an
    item without a second part has answer_overlap 1). Clean documents have no row. Null and
    empty texts and items match nothing; repeated documents and items each give their rows;
    an empty table gives none; other columns are ignored.

    The index goes to the tasks as a broadcast only if the benchmark's texts are at most
    ``shard_bytes``; its arrays are a few times as large as the texts. A larger benchmark is
    dealt by a hash of its ids into shards of about that size, indexed one after the other
    with the document frequencies of the whole benchmark and put into the shared folder.
    Documents are read and cut into words once, and every task takes the shards in turn.
    """
    small_batches(docs)
    spark, key = docs.sparkSession, new_key()
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and trim(text) <> ''")
    shards = max(1, -(-(tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    tests = tests.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    units, mean, frequencies = _frequencies(tests, unit, key) if shards > 1 else (0, 0.0, None)
    folder, indices = fresh_path(spark, "benchmark-index"), []
    for k in range(shards):
        lot, whole = tests.where(F.col("shard") == k).orderBy("item_id", "text").collect(), None
        if frequencies is not None:
            own = frequencies.where(F.col("shard") == k).select("term", "df").toArrow()
            terms = np.asarray(own["term"]).astype(np.int64).view(np.uint64)
            order = np.argsort(terms)
            whole = units, mean, terms[order], np.asarray(own["df"])[order]
        index = BlockMaxIndex([(r.item_id, r.text) for r in lot], unit, key=key, whole=whole)
        if shards == 1:
            indices.append(spark.sparkContext.broadcast(index))
        else:
            file = publish(folder, f"shard-{k:06d}")
            with file.open() as out:
                out.write(pickle.dumps(index, protocol=5))
            indices.append(file.done())
    return rows.mapInArrow(_searcher(indices, key, least, overlap), RESULT)


def _opened(index) -> BlockMaxIndex:
    if not isinstance(index, str):
        return index.value
    with open_input(index) as f:
        return pickle.loads(f.read())


def _searcher(indices: list, key: bytes, least: float, overlap: float):
    """Searches documents in all indices (broadcasts, or paths in the shared folder)."""
    # with several shards so many bytes of text are searched in each before the next is opened
    lot = (1 << 20) * (1 if len(indices) == 1 else 32)

    def run(batches):
        held, size = [], 0
        for b in pieces(batches, 4096, 1 << 20):
            held.append((b.column(0).to_pylist(), *word_hashes(b.column(1), key, LOOSE_SPACE)))
            size += b.nbytes
            if size >= lot:
                yield from search(held)
                held, size = [], 0
        if held:
            yield from search(held)

    def search(held):
        for index in indices:
            own = _opened(index)
            for ids, words, counts in held:
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for doc, passage, unit, score in own.passages(words, counts, least):
                    at = doc, int(own.item_of[unit])
                    if score > best.get(at, (0.0, 0))[0]:
                        best[at] = score, passage
                out, ends = [], np.cumsum(counts)
                last, made = -1, {}
                for (doc, item), (score, passage) in sorted(best.items()):
                    if doc != last:
                        last, made = doc, {}
                    q, a = own.overlaps(item, words[ends[doc] - counts[doc] : ends[doc]], made)
                    if q >= overlap and a >= overlap:
                        out.append((ids[doc], own.items[item], score, passage, q, a))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    return run
