"""Joins, leapers, aggregates, indices."""

import random

import pytest
from pyspark.sql import functions as F

from deltaloom.operators import ExtendAnti, ExtendWith, FilterAnti, Leaper, Relation, SecondaryIndex, Variable, aggregate, extend_into, fold, join_anti, join_helper, join_into, semi_join

KV = "k long, v long"


def rel(engine, rows, schema=KV):
    return Relation.from_rows(engine, rows, schema)


def var(engine, rows, schema=KV, stable=()):
    v = Variable(engine, schema)
    if stable:
        v.insert_rows(stable)
        v.changed()
    v.insert_rows(rows)
    v.changed()
    return v


def out(engine, schema=KV):
    return Variable(engine, schema)


THREE = ["l.k AS k", "l.v AS v", "r.v AS w"]


def pairs(seed, n, keys, values):
    rnd = random.Random(seed)
    return sorted({(rnd.randrange(keys), 100 + rnd.randrange(values)) for _ in range(n)})


def split(rows, seed):
    """Some rows to be stable, the rest to be recent."""
    rnd = random.Random(seed)
    first = [r for r in rows if rnd.random() < 0.5]
    return first, [r for r in rows if r not in first]


def test_join_helper(engine):
    a, b = pairs(21, 15, 8, 5), pairs(22, 15, 10, 5)
    ra, rb = rel(engine, a), rel(engine, b)
    assert join_helper(ra, rb, ["k"], THREE).rows() == sorted((k, v, w) for k, v in a for j, w in b if j == k)
    assert join_helper(ra, rb, F.expr("l.k < r.k AND l.v = r.v"), THREE).rows() == sorted({(k, v, w) for k, v in a for j, w in b if k < j and v == w})
    assert semi_join(ra, rb, "k").rows() == [r for r in a if r[0] in {j for j, _ in b}]
    null = rel(engine, [(None, 7)])
    assert join_helper(null, null, "k", THREE).is_empty()


@pytest.mark.parametrize("seed", [31, 32, 33])
def test_join_into_reads_deltas(engine, seed):
    """What joins with a recent tuple on either side, and nothing that is stable on both."""
    sides = [split(pairs(seed + i, 14, 5, 6), seed) for i in range(2)]
    o = out(engine, "k long, v long, w long")
    (sa, na), (sb, nb) = sides
    join_into(var(engine, na, stable=sa), var(engine, nb, stable=sb), "k", THREE, o)
    joined = lambda x, y: {(k, v, w) for k, v in x for j, w in y if j == k}
    assert o.complete().rows() == sorted(joined(na, sb) | joined(sa, nb) | joined(na, nb))


@pytest.mark.parametrize("seed", [41, 42])
def test_join_anti(engine, seed):
    (old, new), (fs, fn) = split(pairs(seed, 16, 9, 4), seed), split(pairs(seed + 7, 6, 9, 4), seed)
    o = out(engine)
    join_anti(var(engine, new, stable=old), var(engine, fn, stable=fs), "k", None, o)
    assert o.complete().rows() == [r for r in new if r[0] not in {k for k, _ in fs + fn}]  # only new tuples are read
    join_anti(var(engine, new), var(engine, fs + fn), ["k", "v"], None, o)
    assert o.complete().rows() == [r for r in new if r not in fs + fn]
    join_anti(var(engine, new), var(engine, []), "k", None, o)
    assert o.complete().rows() == new


def test_joins_equal_naive_ones(engine):
    rnd = random.Random(11)
    for _ in range(3):
        a, b = ([(rnd.randrange(6), rnd.randrange(9)) for _ in range(12)] for _ in range(2))
        got = join_helper(rel(engine, a), rel(engine, b), "k", THREE).rows()
        assert got == sorted({(k, v, w) for k, v in a for j, w in b if k == j})
        o = out(engine)
        join_anti(var(engine, a), var(engine, b), "k", None, o)
        assert o.complete().rows() == sorted({(k, v) for k, v in a if k not in {j for j, _ in b}})
        o = out(engine)
        extend_into(var(engine, [k for k, _ in a], "k long"), [ExtendWith(rel(engine, b), {"k": "t.k"}, "v")], ["t.k AS k", "v AS v"], o)
        assert o.complete().rows() == sorted({(k, w) for k, _ in a for j, w in b if k == j})


def extended(engine, source, *leapers):
    got = []
    for by_tuple in (False, True):
        o = out(engine)
        extend_into(var(engine, source, "k long"), list(leapers), ["t.k AS k", "v AS v"], o, by_tuple)
        got.append(o.complete().rows())
    assert got[0] == got[1]
    return got[0]


@pytest.mark.parametrize("seed", [51, 52, 53])
def test_extension(engine, seed):
    rels = [pairs(seed + i, 22, 7, 5) for i in range(4)]
    source = sorted({k for k, _ in rels[0]} | {99})
    ew, ea = (lambda rows, kind=kind: kind(rel(engine, rows), {"k": "t.k"}, "v") for kind in (ExtendWith, ExtendAnti))
    has = lambda rows: [(k, v) for k, v in sorted(set(rows)) if k in source]
    assert extended(engine, source, ew(rels[0]), ew(rels[1])) == has(set(rels[0]) & set(rels[1]))
    assert extended(engine, source, ew(rels[0]), ew(rels[1]), ew(rels[2])) == has(set(rels[0]) & set(rels[1]) & set(rels[2]))
    assert extended(engine, source, ew(rels[0]), ea(rels[3])) == has(set(rels[0]) - set(rels[3]))
    assert extended(engine, source, ea(rels[3])) == []  # nothing proposes
    barred = {k for k, v in rels[3] if v == 102}
    fa = FilterAnti(rel(engine, rels[3]), {"k": "t.k", "v": "102"})
    assert extended(engine, source, ew(rels[0]), fa) == [r for r in has(rels[0]) if r[0] not in barred]
    assert extended(engine, source, ew(rels[0]), FilterAnti(rel(engine, [], "k long"), {"k": "t.k"}), ea([])) == has(rels[0])
    assert extended(engine, source, ew([]), ea([])) == []
    tuples = engine.spark.createDataFrame([(k,) for k in source], "k long").select(F.struct("k").alias("t"))
    assert {r.t.k: r.n for r in ew(rels[0]).counted(tuples, "n").collect()} == {k: sum(j == k for j, _ in rels[0]) for k in source}


def test_custom_leaper(engine):
    class Below(Leaper):
        proposes = True

        def propose(self, tuples):
            return tuples.select("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t.k"))).alias("v"))

    class Even(Leaper):
        def intersect(self, pairs):
            return pairs.where("v % 2 = 0")

    assert extended(engine, [3], Below(), Even()) == [(3, 0), (3, 2)]


def test_aggregates_see_the_set(engine):
    r = rel(engine, [(1, 10), (1, 20), (2, 5), (2, 6), (3, 100), (1, 10)])
    assert aggregate(r, "k", v="sum(v)").rows() == [(1, 30), (2, 11), (3, 100)]
    assert aggregate(r, "k", n="count(1)").rows() == [(1, 2), (2, 2), (3, 1)]
    assert aggregate(r, "k", a="min(v)", b="max(v)").rows() == [(1, 10, 20), (2, 5, 6), (3, 100, 100)]
    assert aggregate(r, "v % 2 AS odd", n="count(1)").rows() == [(0, 4), (1, 1)]
    assert aggregate(rel(engine, []), "k", v="sum(v)").is_empty()
    got = fold(r, "k", F.lit(0).cast("long"), lambda acc, t: acc * 100 + t["v"], "x")
    assert got.rows() == [(1, 1020), (2, 506), (3, 100)]


def test_index(engine):
    for clustered in (False, True):
        ix = SecondaryIndex(engine, KV, "v", clustered)
        assert ix.get(1) is None
        ix.insert_rows([(1, 10), (2, 20)])
        ix.insert_rows([(3, 10), (3, 10)])
        assert ix.get(10).rows() == [(1, 10), (3, 10)] and len(ix.get(20)) == 1 and ix.get(11) is None
        assert len(ix.get_range(10, 20)) == 3 and ix.get_range(20, 10).is_empty() and ix.get_range(11, 19).is_empty()
    rnd = random.Random(5)
    rows = {(rnd.randrange(20), rnd.randrange(100)) for _ in range(50)}
    ix = SecondaryIndex.of(rel(engine, rows), ["k", "v"])
    for _ in range(3):
        lo, hi = sorted([(rnd.randrange(20), rnd.randrange(100)) for _ in range(2)])
        assert ix.get_range(lo, hi).rows() == sorted(r for r in rows if lo <= r <= hi)
