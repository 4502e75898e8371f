"""Toxicity scoring: gradient-boosted trees over dense text features, isotonic calibration.

Training reads a bounded sample of labelled rows (``max_rows``), dealt by id into three
folds: the lexicon is learned on the first (words and word beginnings whose share of toxic
documents is far above that of others), the trees on the second, the calibration on the
third. The model is a few kilobytes and goes to the tasks with their closure.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, materialise, pieces, small_batches

# Second-person words of the learned languages.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
# Symbols written for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "|": "l"})
_EDGE = ".,;:!?\"'()[]{}<>-_*#%&/\\…«»¿¡“”„"
_WORD, _BEGIN, _YOU, _CAPS, _DISGUISED, _SHOUT, _SINGLE = 1, 2, 4, 8, 16, 32, 64
BEGINNINGS = (3, 4, 5, 6)
FEATURES = ("word_hits", "begin_hits", "hits_per_word", "weight_per_word", "best_weight", "hits_log", "near_you", "you_rate", "caps_words", "upper_rate", "shout_rate", "punct_rate", "digit_rate", "disguised_rate", "disguised_hits", "singles_rate", "words_log")


def plain(token: str) -> tuple[str, bool]:
    """A token in lower case without edge punctuation and disguise; whether it was disguised."""
    core = token.strip(_EDGE).lower()
    if core.isalpha() or not core:
        return core, False
    if not any(c.isalpha() for c in core):
        return "", False
    made = "".join(c for c in core.translate(LOOKALIKES) if c.isalpha())
    return made, len(made) > 2


class Lexicon(dict):
    """Token to flags, filled as tokens come; ``weights`` are those of words and beginnings."""

    def __init__(self, words: dict[str, float], begins: dict[str, float], limit: int = 500_000):
        super().__init__()
        self.words, self.begins, self.limit = words, begins, limit
        self.weights: dict[str, float] = {}

    def __missing__(self, token: str) -> int:
        if len(self) > self.limit:
            self.clear()
            self.weights.clear()
        word, disguised = plain(token)
        flags, weight = _DISGUISED * disguised, 0.0
        if word in self.words:
            flags, weight = flags | _WORD, self.words[word]
        for n in BEGINNINGS:
            if len(word) > n and (w := self.begins.get(word[:n])) is not None:
                flags, weight = flags | _BEGIN, max(weight, w)
        if word in SECOND_PERSON:
            flags |= _YOU
        if len(word) == 1:
            flags |= _SINGLE
        if len(token) > 2 and token.isupper():
            flags |= _CAPS
        if "!!" in token or "??" in token or token.endswith("!"):
            flags |= _SHOUT
        if weight:
            self.weights[token] = weight
        self[token] = flags
        return flags

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        if len(self) > self.limit:
            self.clear()
            self.weights.clear()
        limit, self.limit = self.limit, 1 << 60
        flags = np.frombuffer(bytes(map(self.__getitem__, tokens)), np.uint8)
        self.limit = limit
        count = lambda bit: int(np.count_nonzero(flags & bit))
        at = np.flatnonzero(flags & (_WORD | _BEGIN))
        weights = [self.weights[tokens[i]] for i in at]
        you = np.flatnonzero(flags & _YOU)
        near = 0.0
        if len(at) and len(you):
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
            near = float(np.mean(1 / (1 + gap)))
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        size = len(raw)
        upper = np.count_nonzero((raw >= 65) & (raw <= 90)) / size
        digits = np.count_nonzero((raw >= 48) & (raw <= 57)) / size
        punct = (np.count_nonzero((raw >= 33) & (raw <= 47)) + np.count_nonzero((raw >= 58) & (raw <= 64))) / size
        return [count(_WORD), count(_BEGIN), len(at) / n, sum(weights) / n, max(weights, default=0.0), math.log1p(len(at)), near, len(you) / n, count(_CAPS) / n, upper, count(_SHOUT) / n, punct, digits, count(_DISGUISED) / n, int(np.count_nonzero(flags[at] & _DISGUISED)), count(_SINGLE) / n, math.log1p(n)]


def _bins(x: np.ndarray, most: int = 32) -> list[np.ndarray]:
    return [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, most + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> dict:
    """Boosted regression trees on the logistic loss, splits found on histograms.

    A tree is complete: per inner node (feature, threshold), per leaf a value.
    """
    cuts = _bins(x)
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
    width = max([len(c) for c in cuts], default=0) + 1
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = math.log(mean / (1 - mean))
    margin, trees = np.full(len(y), base), []
    for _ in range(rounds if len(np.unique(y)) == 2 else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), int)
        split = [(0, math.inf)] * (2**depth - 1)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                best = (1e-6, None)
                if len(rows) > 1:
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gs = np.cumsum(np.bincount(codes[rows, j], g[rows], width))[: len(c)]
                        hs = np.cumsum(np.bincount(codes[rows, j], h[rows], width))[: len(c)]
                        gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                        gain[(hs < least) | (total_h - hs < least)] = 0
                        b = int(gain.argmax())
                        if gain[b] > best[0]:
                            best = (gain[b], (j, float(c[b])), b)
                if best[1]:
                    split[k] = best[1]
                    node[rows] = 2 * k + 1 + (codes[rows, best[1][0]] > best[2])
                else:
                    node[rows] = 2 * k + 1
        leaf = node - (2**depth - 1)
        values = np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge) * rate
        margin += values[leaf]
        trees.append((split, values))
    return {"base": base, "depth": depth, "trees": trees}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for split, values in model["trees"]:
        feature, cut = np.array([s[0] for s in split]), np.array([s[1] for s in split])
        node = np.zeros(len(x), int)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        out += values[node - len(split)]
    return out


def fit_isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and their non-decreasing means."""
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []  # weight, sum of y, sum of x
    for a, b in zip(x[order], y[order]):
        blocks.append([1.0, float(b), float(a)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, s, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2] + t]
    return np.array([t / w for w, _, t in blocks]), np.array([(s + 0.01) / (w + 0.02) for w, s, _ in blocks])


class ToxicityModel:
    def __init__(self, words, begins, trees, calibration):
        self.words, self.begins, self.trees, self.calibration = words, begins, trees, calibration

    def score(self, features: np.ndarray) -> np.ndarray:
        m = margins(self.trees, features)
        raw = 1 / (1 + np.exp(-m))
        at, to = self.calibration
        if len(at) < 2:
            return raw
        # a trace of the margin keeps apart what calibration makes equal
        return np.clip(np.interp(m, at, np.maximum.accumulate(to)) * 0.999 + raw * 0.001, 0.0, 1.0)


def _labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled documents, those first by a hash of their ids.

    A document with several labels is toxic if one says so; null labels and ids are left
    out. The labels that are broadcast are at most ``max_rows`` rows of two numbers.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return rows.join(F.broadcast(marks), "doc_id").select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)).alias("fold"))


def _candidates(text: str) -> set[str]:
    out = set()
    for token in set(text.split()):
        word, _ = plain(token)
        if len(word) > 2:
            out.add("=" + word)
            out.update(word[:n] for n in BEGINNINGS if len(word) > n)
    return out


def _token_counts(rows: DataFrame, only: frozenset | None) -> DataFrame:
    def count(batches):
        found: Counter = Counter()
        for b in pieces(batches):
            for text in b.column(0).to_pylist():
                found.update(_candidates(text) if only is None else _candidates(text) & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["token", "n"])

    return rows.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, entries: int = 600, candidates: int = 20_000) -> ToxicityModel:
    """Fit lexicon, trees and calibration on at most ``max_rows`` labelled documents.

    The lexicon has at most ``entries`` words and beginnings, chosen among the ``candidates``
    that most toxic documents of the sample have (three at least; ties to the smaller one).
    An empty table, or one whose labels name no document, counts as one without labels.

    With no usable label the score is the even prior, 0.5 less a little; with one class
    only, near that class.
    """
    sample = materialise(_labelled(docs, labels, max_rows), "toxicity-sample")
    sizes = {(r.fold < 5, r.toxic): r.n for r in sample.groupBy((F.col("fold") < 5).alias("fold"), "toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get((True, 1), 0), sizes.get((True, 0), 0)
    words: dict[str, float] = {}
    begins: dict[str, float] = {}
    if bad and good:
        first = sample.where("fold < 5")
        seen = _token_counts(first.where("toxic = 1"), None).where("n >= 3").orderBy(F.desc("n"), "token").limit(candidates).collect()
        theirs = {r.token: r.n for r in seen}
        others = {r.token: r.n for r in _token_counts(first.where("toxic = 0"), frozenset(theirs)).collect()}
        odds = {t: math.log((n / bad) / ((others.get(t, 0) + 0.5) / good)) for t, n in theirs.items()}
        picked = sorted((t for t in odds if odds[t] > 2), key=lambda t: (-odds[t] * math.sqrt(theirs[t]), t))[:entries]
        words = {t[1:]: odds[t] for t in picked if t[0] == "="}
        begins = {t: odds[t] for t in picked if t[0] != "="}
    x, y, fold = collect_features(sample, words, begins)
    fit, keep = (fold >= 5) & (fold < 8), fold >= 8
    if len(np.unique(y[fit])) < 2:
        fit = fold >= 0
    trees = fit_trees(x[fit], y[fit])
    calibration = fit_isotonic(margins(trees, x[keep]), y[keep]) if len(np.unique(y[keep])) == 2 else (np.zeros(0), np.zeros(0))
    return ToxicityModel(words, begins, trees, calibration)


def collect_features(sample: DataFrame, words: dict, begins: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label and fold of the bounded sample, on the driver, in order of id."""

    def run(batches):
        lexicon = Lexicon(words, begins)
        for b in pieces(batches):
            x = [lexicon.features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "x"])

    got = sample.select("doc_id", "text", "toxic", "fold").mapInArrow(run, "doc_id long, toxic int, fold long, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return x, got["toxic"].to_numpy().astype(float), got["fold"].to_numpy()


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, score and predicted of every whole text.

    Null and empty texts are scored as texts without words. Repeated rows each give a row,
    null ids stay null, other columns are ignored. ``carry`` names columns of ``docs`` that
    each row takes along instead of doc_id.
    """

    def run(batches):
        lexicon = Lexicon(model.words, model.begins)
        for b in pieces(batches):
            s = model.score(np.array([lexicon.features(t) for t in b.column(1).to_pylist()], float))
            first = b.columns[2:] if carry else [b.column(0).cast(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array((s >= 0.5).astype(np.int32)), *first], names=["score", "predicted", *(carry or ["doc_id"])])

    small_batches(docs)
    rows, fields = carried(docs, id_col, text_col, carry)
    return rows.mapInArrow(run, "score double, predicted int" + (fields or ", doc_id long"))
