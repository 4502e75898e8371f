"""Variables, iterations, limits, incremental maintenance."""

import random

import pytest

from deltaloom.errors import MaxIterationsExceeded, NotStratified
from deltaloom.engine import Engine
from deltaloom.operators import Iteration, Relation, Variable, join_into
from deltaloom.plans import reachable_from, same_generation, stratify, transitive_closure
from deltaloom.streaming import feed


def values(df):
    return sorted(tuple(r) if len(r) > 1 else r[0] for r in df.collect())


def naive_closure(edges):
    out = set(edges)
    while True:
        new = {(a, d) for a, b in out for c, d in edges if b == c and b is not None} - out
        if not new:
            return sorted(out, key=repr)
        out |= new


def test_lifecycle(engine):
    v = Variable(engine, "v long")
    assert v.total_len() == 0 and not v.changed()
    v.insert_rows([1, 2, 3])
    assert v.total_len() == 3 and v.recent_count == 0
    assert v.changed() and values(v.recent) == [1, 2, 3] and v.total_len() == 3
    assert not v.changed() and v.recent_count == 0 and v.stable_count == 3
    v.insert_rows([1])
    assert v.total_len() == 4  # pending tuples count though known
    v.insert_rows([2, 3, 4, 5])
    assert v.changed() and values(v.recent) == [4, 5]
    v.insert_rows([1, 2, 3, 4, 5])
    assert not v.changed()
    done = v.complete()
    assert [x for (x,) in done.rows()] == [1, 2, 3, 4, 5] and len(done) == 5
    assert v.total_len() == 0 and v.complete().is_empty()


def test_new_tuples_are_held_against_all_batches(engine):
    v = Variable(engine, "v long")
    v.insert_rows(range(1, 9))
    v.changed()
    v.changed()
    v.insert_rows([2, 4])
    v.insert_rows([6, 8, 9, 9])
    assert v.changed() and values(v.recent) == [9]
    v.insert_rows([3, 5, 9, 11, 12])
    assert v.changed() and values(v.recent) == [11, 12]
    with pytest.raises(ValueError):
        v.insert(Relation.from_rows(engine, [(1, 2)], "a long, b long"))


def test_complete_without_a_round(engine):
    v = Variable(engine, "v long")
    v.insert_rows([3, 1])
    v.insert_rows([2, 3])
    assert v.complete().rows() == [(1,), (2,), (3,)]


def test_rounds_and_limits(engine):
    loop = Iteration(engine)
    a, b = loop.variable("v long"), loop.variable("v long")
    a.insert_rows([1, 2, 3])
    b.insert_rows([4, 5])
    assert loop.changed() and not loop.changed() and loop.rounds == 2
    loop.reset()
    assert loop.rounds == 0 and not loop.changed() and a.total_len() == 3
    short = Iteration(engine, 1)
    short.variable("v long").insert_rows([1])
    assert short.changed()
    with pytest.raises(MaxIterationsExceeded):
        short.changed()
    short.reset()
    assert not short.changed()
    with pytest.raises(MaxIterationsExceeded):  # k productive rounds need k + 1 calls
        transitive_closure(engine, Relation.from_rows(engine, [(i, i + 1) for i in range(4)], "a long, b long"), linear=True, max_iterations=4)
    assert Iteration(Engine(engine.spark, max_iterations=7)).max_iterations == 7


@pytest.mark.parametrize("linear", [True, False])
@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4)], [(1, 2), (1, 3), (2, 4), (3, 4)], [(1, 2), (2, 3), (3, 1)], []])
def test_closure(engine, edges, linear):
    got = transitive_closure(engine, Relation.from_rows(engine, edges, "a long, b long"), linear)
    assert got.rows() == naive_closure(edges)


def test_closure_with_nulls(engine):
    edges = [(1, 2), (2, 3), (3, 1), (2, None), (None, 1)]
    got = transitive_closure(engine, Relation.from_rows(engine, edges, "a long, b long"))
    assert sorted(got.rows(), key=repr) == naive_closure(edges) and len(got) == 16


def test_closure_of_random_graphs(engine):
    rnd = random.Random(3)
    for _ in range(3):
        edges = [(rnd.randrange(6), rnd.randrange(6)) for _ in range(10)]
        rel = Relation.from_rows(engine, edges, "a long, b long")
        assert transitive_closure(engine, rel).rows() == naive_closure(edges)


def test_candidates_probe_many_known_tuples(spark):
    """The scan of known tuples, and its limit, give what subtraction gives."""
    edges = [(1, 2), (2, 3), (3, 1), (2, None), (None, 1)]
    for most in (10**6, 3):
        probing = Engine(spark, probe_from=0, probe_most=most)
        got = transitive_closure(probing, Relation.from_rows(probing, edges, "a long, b long"))
        assert sorted(got.rows(), key=repr) == naive_closure(edges)


def test_long_chain_keeps_plans_small(engine):
    got = transitive_closure(engine, Relation.from_rows(engine, [(i, i + 1) for i in range(100)], "a long, b long"))
    assert len(got) == 5050


def test_results_do_not_depend_on_partitions(engine, spark):
    edges = Relation.from_rows(engine, [(i, i * 7 % 30) for i in range(30)], "a long, b long")
    want = transitive_closure(engine, edges).rows()
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert transitive_closure(engine, edges).rows() == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_same_generation_and_bound_reach(engine):
    parents = Relation.from_rows(engine, [(1, 2), (1, 3), (2, 4), (2, 5)], "p long, c long")
    seeds = Relation.from_rows(engine, [(i, i) for i in range(1, 6)], "x long, y long")
    assert len(same_generation(engine, parents, seeds)) == 9
    one = Relation.from_rows(engine, [2], "v long")
    assert reachable_from(engine, parents, one).rows() == [(2,), (4,), (5,)]


def test_incremental_closure(engine):
    loop = Iteration(engine)
    paths = loop.variable("a long, b long")
    step = lambda: join_into(paths, paths, {"b": "a"}, ["l.a AS a", "r.b AS b"], paths)
    paths.insert_rows([(1, 2), (2, 3)])
    loop.run(step)
    assert paths.total_len() == 3
    loop.reset()
    paths.insert_rows([(3, 4)])
    loop.run(step)
    assert paths.complete().rows() == naive_closure([(1, 2), (2, 3), (3, 4)])


def test_stream_feeds_a_fixpoint(engine, spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, 3)], "a long, b long").coalesce(1).write.parquet(str(tmp_path / "in"))
    loop, seen = Iteration(engine), []
    paths = loop.variable("a long, b long")
    step = lambda: join_into(paths, paths, {"b": "a"}, ["l.a AS a", "r.b AS b"], paths)
    for rows in (None, [(3, 4), (1, 2)]):
        if rows:
            spark.createDataFrame(rows, "a long, b long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("a long, b long").parquet(str(tmp_path / "in"))
        feed(stream, loop, paths, step, seen.append).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [0, 1] and paths.complete().rows() == naive_closure([(1, 2), (2, 3), (3, 4)])


def test_strata():
    rules = [("path", ["edge"], []), ("path", ["path", "edge"], []), ("open", ["path"], ["blocked"]), ("count", [], ["open"])]
    assert stratify(rules) == [["blocked", "edge", "path"], ["open"], ["count"]]
    with pytest.raises(NotStratified):
        stratify([("a", [], ["b"]), ("b", ["a"], [])])


def test_folded_batches_hold_the_same(spark):
    """A variable of many rounds: few batches, no tuple lost or doubled."""
    from deltaloom.engine import Engine

    v = Variable(Engine(spark, fold_at=3), "k long")
    for i in range(20):
        v.insert_rows([i, i + 1])
        assert v.changed()
    assert v.stable_count + v.recent_count == 21 and len(v._stable) <= 3 * 2
    assert sorted(r.k for r in v.known.collect()) == list(range(21))
    assert v.complete().count() == 21
    v.release()
