"""Top-k search and the n-gram join against brute force; components."""

import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare

from deltaloom.llm import ngram_join, pivot_search, queries
from deltaloom.llm.components import components

LOW = {i: i + 32 for i in range(65, 91)}


def brute_links(texts, percent=75, width=5):
    """(sizes, smallest index of each component) by comparing all pairs."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [len(s) for s in sets], [root(i) for i in range(len(sets))]


def family(rnd, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rnd.randrange(len(out))] = f"edit{rnd.randrange(10**6)}"
    return " ".join(out)


def corpus(seed):
    rnd = random.Random(seed)
    texts = ["", None, " \t ", "one", "One", "a b c", "A b\tC", "x y z w", "x y z w v", "x y z w v u"]
    passage = [f"shared{i}" for i in range(60)]
    for f in range(8):
        base = [f"w{f}_{rnd.randrange(400)}" for _ in range(rnd.randrange(20, 200))]
        texts += [family(rnd, base, e % 6) for e in range(rnd.randrange(1, 14))]
    for k in range(20):  # a common passage among little else
        own = [f"o{k}_{i}" for i in range(rnd.randrange(0, 30))]
        texts.append(" ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]))
    texts += [texts[12]] * 5 + [texts[-1]] * 3
    regular = "a"
    for _ in range(11):  # words that polynomial hashes modulo powers of two take for one
        regular += regular.translate({97: 98, 98: 97})
    texts += [regular, regular.translate({97: 98, 98: 97})]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,block,few", [(1, 1024, 64), (2, 4, 64), (3, 3, 1)])
def test_join_equals_brute_force(spark, seed, block, few, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", few)
    texts = corpus(seed)
    sizes, roots = brute_links(texts)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, sig string, key int").repartition(3)
    got = {r.doc_id: r for r in ngram_join.link_components(df, block=block, broadcast_rows=0 if seed == 2 else 10**6).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id) == (sizes[i], roots[i]), (i, texts[i])


def test_join_without_ids_and_rows(spark):
    kind = "doc_id long, text string"
    assert ngram_join.link_components(spark.createDataFrame([], kind)).count() == 0
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(None, t), (5, t), (4, t), (4, t), (9, None)]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.n_shingles) for r in ngram_join.link_components(spark.createDataFrame(rows, kind)).collect())
    assert got == [(-1, -1, 26), (4, 4, 26), (4, 4, 26), (5, 4, 26), (9, 9, 0)]


@pytest.mark.parametrize("parts", [1, 3])
def test_join_with_repeated_rows(spark, parts):
    """Rows that repeat an id and a text stand next to texts that share half of their shingles."""
    rows = []
    for f in range(6):
        w = [f"r{f}_{i}" for i in range(60)]
        half, near = w[: 30 + 2 * f] + [f"s{f}_{i}" for i in range(30)], [*w[:-1], "end"]
        rows += [(10 * f, " ".join(w))] * (2 + f) + [(10 * f + 1, " ".join(half))] * (1 + f % 2) + [(10 * f + 2, " ".join(near))] * (f % 3)
    texts = [t for _, t in rows]
    sizes, roots = brute_links(texts)
    want = sorted((i, n, rows[r][0]) for (i, _), n, r in zip(rows, sizes, roots))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_components(df).collect())
    assert got == want


def test_divide_skip_misses_nothing():
    rnd = np.random.default_rng(3)
    pool = rnd.integers(1, 1 << 60, 300, dtype=np.uint64)
    common = pool[:40]  # long lists
    sets = [np.unique(np.concatenate([common, rnd.choice(pool, rnd.integers(1, 60))])) for _ in range(80)]
    sizes = np.array([len(s) for s in sets])
    for mu in (0.001, 0.01, 10.0):
        index = ngram_join.DivideSkip(sets, sizes, 75, mu)
        for q in range(0, 80, 7):
            alive = np.arange(80) != q
            got = set(index.search(q, alive))
            want = {c for c in range(80) if c != q and len(np.intersect1d(sets[c], sets[q])) >= ngram_join.required(int(sizes[q]), 75)}
            assert got == want


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_top(rows, k=5, modulus=50, scale=256):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, qv in dict((i, v) for i, v in good if i % modulus == 0).items():
        best = sorted({(-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q and len(v) == len(qv)})[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("repeat", [1, 2])
def test_join_leaves_no_spent_steps(spark, repeat):
    """Steps that hold shingles are deleted once spent; rows that repeat an id change nothing but their number."""
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(t) for _ in range(20) for t in [[rnd.choice(words) for _ in range(80)]] for t in (t, [*t[:40], "other", *t[40:]], [*t[:78], "x", "y"])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * repeat, "doc_id long, text string")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    got = ngram_join.link_components(df, block=2).collect()
    sizes, least = brute_links(texts)
    assert sorted(tuple(r) for r in got) == sorted((i, sizes[i], least[i]) for i in range(len(texts)) for _ in range(repeat))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert "described" in left and not left & {"sets", "shared", "members", "large", "labelled", "leads", "stars"}


@pytest.mark.parametrize("block", [2048, 8])
def test_top_k_equals_brute_force(spark, block):
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, rnd.gauss(0, 1)]) for _ in range(6)]) for i in range(160)]
    rows += [(i, list(rows[i - 200][1])) for i in range(200, 240)]  # ties
    rows += [(300, None), (301, []), (350, [float("nan")] * 6), (351, [float("inf")] + [0.0] * 5), (352, [None] * 6), (None, [1.0] * 6), (400, [1.0, 2.0]), (403, [1.0, -2.0]), rows[100], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in pivot_search.top_k(df, block=block, pivots=5).collect()}
    assert got == brute_top(rows)


def test_top_k_behind_repeated_ids(spark):
    """One block whose best candidates are rows of one id, equal or not, more often than k."""
    rows = [(50, [1.0, 0.0])] + [(7, [9.0, 1.0])] * 8 + [(8, [7.0 - j / 8, 0.0]) for j in range(7)] + [(i, [6.0 - i / 8, 2.0]) for i in range(9, 20)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in pivot_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), pivots=3).collect())
    best = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -(10**9)), math.floor(256 * v[0]) * 256)
    want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert got == [(50, r, i, s) for r, (i, s) in enumerate(want, 1)]


def test_top_k_of_nothing(spark):
    assert pivot_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert pivot_search.top_k(one).count() == 0


@pytest.mark.parametrize("large", [1e6, 1e9])
def test_top_k_of_large_components(spark, large):
    """Components are never clipped: integers are exact as long as scores fit in 64 bits."""
    rnd = random.Random(4)
    rows = [(i, [large + rnd.random(), rnd.uniform(-1, 1) / 1e3, -rnd.random() * 1e3]) for i in range(1, 120)] + [(50, [1.0, 2.0, 3.0]), (100, [1e-3, large, 0.5])]
    rows = [r for k, r in enumerate(rows) if r[0] not in (50, 100) or k >= 119]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in pivot_search.top_k(df, block=16, pivots=4).collect()}
    assert got == brute_top(rows)
    with pytest.raises(Exception, match="64 bits"):
        pivot_search.top_k(spark.createDataFrame([(50, [1e12]), (1, [1e12])], df.schema)).collect()


def test_top_k_says_what_it_evaluated(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    n = df.count()
    got = pivot_search.top_k(df, with_work=True).select("query_id", "evaluated").distinct().collect()
    share = sum(r.evaluated for r in got) / (len(got) * (n - 1))
    print(f"evaluated {share:.3f} of all candidates")
    assert 0 < share < 1


def test_top_k_copies_no_queries(spark):
    """Blocks of queries aren't rows of an exchange, copied for each block of candidates."""
    rnd = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(600, 4)))]
    got = pivot_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_modulus=3, block=8, pivots=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == brute_top(rows, modulus=3)


def test_holds_are_bounded(monkeypatch):
    monkeypatch.setattr(pivot_search, "HOLD", 8 * 40)
    batches = [pa.RecordBatch.from_arrays([pa.array([j, j + 100]), pa.array([[0.5, 1.0], [1.0] * (1 + j % 2)])], names=["id", "v"]) for j in range(30)]
    holds = list(pivot_search._holds(batches, 256.0))
    assert max(sum(m.size for _, m in h.values()) for h in holds) < 44 and len(holds) > 2
    assert sorted(i for h in holds for ids, _ in h.values() for i in ids.tolist()) == sorted([*range(30), *range(100, 130)])


def test_bounds_spare_most_evaluations():
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(12, 16)) * 900
    x = np.floor(centres[rnd.integers(0, 12, 2000)] + rnd.normal(size=(2000, 16)) * 30).astype(np.int64)
    pivots = x[:24].astype(float)
    table = np.sqrt(((x[:, None].astype(float) - pivots) ** 2).sum(2)).astype(np.float32)
    (q, i, s), work = pivot_search.search_block(np.arange(10), x[:10], table[:10], np.arange(2000), x, table, 5)
    assert work.sum() < 0.3 * 10 * 2000
    for k in range(10):
        score = x @ x[k]
        order = [j for j in np.lexsort((np.arange(2000), -score)) if j != k][:5]
        assert i[q == k].tolist() == order and s[q == k].tolist() == score[order].tolist()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.01")


def test_members_are_sent_in_turns(spark):
    """Chains of near copies in blocks of two: nearly all members go to several blocks, in many exchanges."""
    rnd = random.Random(13)
    words = [rnd.choice([f"w{i}" for i in range(300)]) for _ in range(60)]
    texts = []
    for i in range(40):
        texts.append(" ".join(words))
        words = [*words[2 + i % 3 :], *[f"n{i}-{j}" for j in range(2 + i % 3)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, least = brute_links(texts)
    for turn in (1, 64 << 20):
        got = ngram_join.link_components(df, block=2, turn_bytes=turn).collect()
        assert sorted(tuple(r) for r in got) == [(i, sizes[i], least[i]) for i in range(len(texts))]


def test_members_that_cannot_link_meet_no_blocks(spark, monkeypatch):
    """Near copies, half of which share enough with others to go on but too little to link with any."""
    rnd = random.Random(14)
    base, texts = [f"w{i}" for i in range(104)], []
    for i in range(80):
        words = base.copy()
        for at in rnd.sample(range(8, 96, 8), 1 if i % 2 else 4):
            words[at] = f"other{i}-{at}"
        texts.append(" ".join(words))
    met, write = [], ngram_join.materialise

    def counted(df, name):
        out = write(df, name)
        if name == "meets":
            met.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    got = ngram_join.link_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=4).collect()
    sizes, least = brute_links(texts)
    assert sorted(tuple(r) for r in got) == [(i, sizes[i], least[i]) for i in range(len(texts))]
    assert len(set(least)) > 40 and met and met[0] < len(texts)
