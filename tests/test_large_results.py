"""How results and steps that grow faster than their inputs are made."""

from pyspark.sql import functions as F

from deltaloom.operators import Relation, Variable, join_helper
from deltaloom.plans import closure, extend_closure, programs, same_generation, transitive_closure


def R(engine, schema, *rows):
    return Relation.from_rows(engine, rows, schema)


def no_rounds(self):
    raise AssertionError("pairs go through rounds")


def test_generations_of_a_forest_are_found_for_nodes(engine, monkeypatch):
    edges, seeds = [(i, i // 2) for i in range(2, 40)] + [(100 + i, 99 + i) for i in range(1, 5)] + [(7000, None)], [*range(1, 40, 3), 1, 100, 7000, None]
    want = {(s, s) for s in seeds}
    full = [e for e in edges if None not in e]
    while new := {(b, d) for x, y in want for b, a in full for d, c in full if a == x and c == y} - want:
        want |= new
    monkeypatch.setattr(Variable, "changed", no_rounds)
    got = same_generation(engine, R(engine, "p long, c long", *[(a, b) for b, a in edges]), R(engine, "x long, y long", *[(s, s) for s in seeds]))
    rows = [tuple(r) for r in got.df.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_classes_are_cut_into_blocks(engine, spark):
    nodes = [(i, i % 3, 1) for i in range(60)]
    got = [tuple(r) for r in closure._all_pairs(engine, spark.createDataFrame(nodes, "x long, t long, d int"), 4, 7).collect()]
    assert sorted(got) == [(x, y) for x in range(60) for y in range(60) if x % 3 == y % 3]


def test_generations_with_a_cycle_two_parents_or_a_null_child(engine):
    for edges in ([(1, 0), (2, 1), (0, 2), (3, 1)], [(2, 0), (2, 1), (3, 1), (4, 0), (4, 1)], [(1, 0), (2, 0), (None, 0)]):
        want = {(x, x) for x in range(5)}
        while new := {(b, d) for x, y in want for b, a in edges for d, c in edges if a == x and c == y} - want:
            want |= new
        got = same_generation(engine, R(engine, "p long, c long", *[(a, b) for b, a in edges]), R(engine, "x long, y long", *[(x, x) for x in range(5)]))
        assert sorted(got.rows(), key=repr) == sorted(want, key=repr)


def test_what_drugs_treat_is_not_made_for_their_effects(engine, monkeypatch):
    """Ten drugs and all of forty associations: of 400 pairs none is stored."""
    stored, write = [], engine.write_counted

    def counted(df, **measures):
        out = write(df, **measures)
        stored.append(out[1]["n"])
        return out

    monkeypatch.setattr(engine, "write_counted", counted)
    got = programs.ontology(engine, R(engine, "a long, b long", (2, 1)), R(engine, "a long, s long", (1, 5), (2, 6)), R(engine, "d long, p long", *[(d, 0) for d in range(10)]), R(engine, "p long, a long", *[(0, a) for a in range(1, 41)]))
    assert got["effect"].rows() == [(d, s) for d in range(10) for s in (5, 6)] and max(stored) <= 2
    assert len(got["treats"]) == 400


def test_pairs_of_a_condition_are_not_compared(engine):
    left = R(engine, "n long, a long", *[(i % 3, i) for i in range(20)], (1, 0), (2, 7), (None, 8))
    right = R(engine, "n long, b long", *[(i % 3, i) for i in range(0, 30, 2)], (0, 4), (2, 4), (0, None))
    got = [tuple(r) for r in join_helper(left, right, F.expr("l.n = r.n AND l.a < r.b"), ["l.a AS a", "r.b AS b"]).df.collect()]
    want = {(a, b) for n, a in left.rows() for m, b in right.df.collect() if n is not None and n == m and b is not None and a < b}
    assert len(got) == len(want) and set(got) == want
    none = join_helper(left.where("n = 0 AND a > 0"), right.where("n = 0 AND b <> 4"), F.expr("l.n = r.n AND l.a < r.b"), ["l.a AS a", "r.b AS b"])
    assert none.df.count() == len(set(none.df.collect()))
    shapes = [line for line in none.df._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.lstrip(" :+-").startswith(("Union", "Aggregate"))]
    assert shapes[0].startswith("Union")  # no aggregate above the join of single tuples


def test_paths_of_a_forest_are_not_compared(engine, monkeypatch):
    edges = [(i, i // 2) for i in range(2, 40)]
    want = {(a, a >> k) for a in range(2, 40) for k in range(1, 6) if a >> k}
    monkeypatch.setattr(Variable, "changed", no_rounds)
    assert set(transitive_closure(engine, R(engine, "a long, b long", *edges)).rows()) == want


def test_linear_paths_of_a_forest_are_not_compared(engine, monkeypatch):
    edges = [(i, i // 2) for i in range(2, 40)]
    want = {(a, a >> k) for a in range(2, 40) for k in range(1, 6) if a >> k}
    monkeypatch.setattr(Variable, "_unknown", no_rounds)
    assert set(transitive_closure(engine, R(engine, "a long, b long", *edges), linear=True).rows()) == want


def test_more_edges_extend_a_closure(engine):
    half, rest = [(2, 1), (4, 2), (6, 3), (8, 4)], [(3, 1), (5, 2), (7, 3), (9, 4), (1, 8), (2, 1)]
    whole = transitive_closure(engine, R(engine, "a long, b long", *half, *rest)).rows()
    got = extend_closure(engine, transitive_closure(engine, R(engine, "a long, b long", *half)), R(engine, "a long, b long", *rest))
    assert got.rows() == whole and got.df.count() == len(whole)


def test_finished_closures_are_not_written_again(engine, monkeypatch):
    """Reachability, dependencies and permissions read the closure where it is."""
    monkeypatch.setattr(Variable, "changed", no_rounds)
    link = R(engine, "a long, b long", (3, 2), (2, 1))
    assert programs.reachability(engine, link, R(engine, "a long, b long", (3, 1)))["allowed"].rows() == [(2, 1), (3, 2)]
    assert programs.dependencies(engine, link, R(engine, "a long, n long", (1, 5), (2, 6), (3, 7)))["total"].rows() == [(1, 5), (2, 11), (3, 18)]
    got = programs.access_control(engine, R(engine, "u long, r long", (9, 3), (8, 1)), link, R(engine, "r long, p long", (1, 70), (2, 71)), R(engine, "u long, p long", (9, 71)))
    assert got["effective"].rows() == [(8, 70), (9, 70)] and len(got["has_role"]) == 4
