"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the list of a language's most frequent n-grams (1 to 3 letters, words padded
by one space), best first. A document's own most frequent n-grams are compared with each
profile: the distance adds the difference of ranks, or the largest possible difference for
an n-gram that the profile lacks. The nearest profile wins.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, pieces, small_batches

UNDETERMINED = "und"
_BITS = 21


@functools.cache
def _letters() -> np.ndarray:
    """Code point to lower-case letter; 0 for what isn't a letter."""
    out = np.zeros(sys.maxunicode + 1, np.int64)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a whole text, with repeats; empty if there is no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    a = _letters()[points]
    keep = a != 0  # runs of what isn't a letter count as one space
    keep[1:] |= a[:-1] != 0
    a = np.concatenate([[0], a[keep], [0]])
    if not a.any():
        return a[:0]
    two = a[:-1] << _BITS | a[1:]
    three = two[:-1] << _BITS | a[2:]
    marked = three[(a[1:-1] != 0)]
    return np.concatenate([a[a != 0], two[two != 0] | 1 << 61, marked | 1 << 62])


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, best first; ties to the smaller code."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    counts = np.diff(np.append(first, len(codes)))
    if len(first) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        over, same = np.flatnonzero(counts > least), np.flatnonzero(counts == least)
        pick = np.concatenate([over, same[: top - len(over)]])
    else:
        pick = np.arange(len(first))
    order = np.lexsort((codes[first[pick]], -counts[pick]))
    return codes[first[pick[order]]]


def train_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 400) -> list[tuple[str, list[int]]]:
    """Each language's ``top`` n-grams over all rows with a language and a text.

    Counts are summed per task, then by (language, n-gram); only the profiles come to the
    driver: top numbers a language.
    """

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        def merged(parts):
            codes, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            got, back = np.unique(codes, return_inverse=True)
            return got, np.bincount(back, n, len(got)).astype(np.int64)

        for b in pieces(batches, 512, 1 << 20):
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(grams(text))
            for lang, parts in by.items():
                held[lang] = [merged([*held.get(lang, []), np.unique(np.concatenate(parts), return_counts=True)])]
        for lang, (x,) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x[0]), pa.string()), pa.array(x[0]), pa.array(x[1])], names=["lang", "gram", "n"])

    rows = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("place", place).where(F.col("place") <= top).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "gram"))).alias("g"))
    return sorted((r.lang, [x.gram for x in r.g]) for r in best.collect())


def identify(docs: DataFrame, profiles: list[tuple[str, list[int]]], id_col: str = "doc_id", text_col: str = "text", top: int = 400, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, lang_pred and score (0 to 1) of every whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned;
    ties go to the language whose name sorts first. The score is 1 less the distance's
    share of the largest distance possible. Repeated rows each give a row, null ids stay
    null, other columns are ignored. ``carry`` names columns of ``docs`` that each row takes
    along instead of doc_id.
    """
    names = [name for name, _ in profiles]
    known = np.unique(np.array([g for _, gs in profiles for g in gs], np.int64))
    ranks = np.full((len(names), len(known) + 1), -1, np.int32)
    for i, (_, gs) in enumerate(profiles):
        ranks[i, np.searchsorted(known, np.array(gs, np.int64))] = np.arange(len(gs))

    def run(batches):
        for b in pieces(batches):
            langs, scores = [], []
            for text in b.column(1).to_pylist():
                codes = grams(text) if text else ()
                if not len(codes) or not names:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                own = ranked(codes, top)
                at = np.searchsorted(known, own)
                at[at == len(known)] = 0
                at[known[at] != own] = len(known)
                theirs = ranks[:, at]
                apart = np.where(theirs < 0, top, np.abs(theirs - np.arange(len(own)))).sum(1)
                k = int(apart.argmin())
                langs.append(names[k])
                scores.append(float(max(0.0, 1 - apart[k] / (top * len(own)))))
            first = b.columns[2:] if carry else [b.column(0).cast(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *first], names=["lang_pred", "score", *(carry or ["doc_id"])])

    small_batches(docs)
    rows, fields = carried(docs, id_col, text_col, carry)
    return rows.mapInArrow(run, "lang_pred string, score double" + (fields or ", doc_id long"))


def held_out(column) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(column.cast("string").cast("binary")) % 5 == 0
