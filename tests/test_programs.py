"""Whole programs on the small facts that their results are known for."""

from deltaloom.operators import Relation
from deltaloom.plans import programs as P


def R(engine, schema, *rows):
    return Relation.from_rows(engine, rows, schema)


def test_reachability(engine):
    link = R(engine, "a long, b long", (1, 2), (2, 3), (3, 4), (2, 5), (4, 6), (6, 5), (5, 7))
    blocked = R(engine, "a long, b long", (1, 3), (1, 4), (1, 7), (2, 4), (2, 7), (3, 7))
    got = P.reachability(engine, link, blocked)
    assert len(got["reachable"]) == 21
    assert got["allowed"].rows() == [(1, 2), (1, 5), (1, 6), (2, 3), (2, 5), (2, 6), (3, 4), (3, 5), (3, 6), (4, 5), (4, 6), (4, 7), (5, 7), (6, 5), (6, 7)]
    assert P.reach_from(engine, link, 4).rows() == [(4,), (5,), (6,), (7,)]


def test_ontology(engine):
    got = P.ontology(
        engine, R(engine, "a long, b long", (11, 10), (12, 11), (13, 10), (21, 20)), R(engine, "a long, s long", (10, 32), (11, 30), (11, 31), (12, 33), (13, 35), (20, 31), (21, 34)),
        R(engine, "d long, p long", (50, 40), (51, 41), (52, 42)), R(engine, "p long, a long", (40, 13), (40, 11), (41, 12), (41, 11), (42, 13), (42, 12)),
    )
    assert len(got["is_a"]) == 5 and (12, 10) in got["is_a"].rows()
    assert got["has"].rows() == [(10, 32), (11, 30), (11, 31), (11, 32), (12, 30), (12, 31), (12, 32), (12, 33), (13, 32), (13, 35), (20, 31), (21, 31), (21, 34)]
    assert got["treats"].rows() == [(50, 11), (50, 13), (51, 11), (51, 12), (52, 12), (52, 13)]
    assert len(got["effect"]) == 13


def test_lineage(engine):
    moves = R(engine, "a long, b long", (1, 2), (2, 3), (4, 5), (3, 6), (5, 6), (5, 7), (7, 8), (9, 10), (10, 11), (11, 12))
    got = P.lineage(engine, R(engine, "d long", (1,), (9,)), moves, R(engine, "a long, b long", (5, 7), (11, 12)), R(engine, "d long", (6,), (8,), (12,)))
    assert [d for (d,) in got["holds"].rows()] == [1, 2, 3, 6, 9, 10, 11]
    assert got["violation"].rows() == [(6,)] and got["clean"].rows() == [(8,), (12,)]


def test_access_control(engine):
    got = P.access_control(
        engine, R(engine, "u long, r long", (1, 10), (2, 20), (3, 40)), R(engine, "c long, p long", (20, 10), (30, 20), (40, 30)),
        R(engine, "r long, p long", (10, 100), (20, 110), (30, 120), (30, 130), (40, 140)), R(engine, "u long, p long", (3, 120)),
    )
    assert got["has_role"].rows() == [(1, 10), (2, 10), (2, 20), (3, 10), (3, 20), (3, 30), (3, 40)]
    assert len(got["can_access"]) == 8
    assert got["effective"].rows() == [(1, 100), (2, 100), (2, 110), (3, 100), (3, 110), (3, 130), (3, 140)]


def test_taint(engine):
    flow = R(engine, "a long, b long", (1, 3), (3, 4), (2, 5), (3, 5), (6, 7))
    got = P.taint(engine, R(engine, "v long", (1,), (2,)), flow, R(engine, "a long, b long", (3, 4)), R(engine, "s long, v long", (50, 5), (51, 4), (52, 3), (53, 7)))
    assert [v for (v,) in got["tainted"].rows()] == [1, 2, 3, 5]
    assert got["violation"].rows() == [(3, 52), (5, 50)] and got["safe"].rows() == [(51,), (53,)]


def test_dependencies(engine):
    direct = R(engine, "a long, b long", (1, 2), (1, 5), (2, 3), (2, 4), (3, 7), (7, 6), (7, 8), (6, 9), (4, 9), (5, 9))
    size = R(engine, "a long, n long", *enumerate([50, 200, 120, 80, 30, 150, 90, 20, 10], 1))
    got = P.dependencies(engine, direct, size)
    assert len(got["needs"]) == 24 and got["cycle"].is_empty()
    assert dict(got["total"].rows()) == {1: 750, 2: 670, 3: 390, 4: 90, 5: 40, 6: 160, 7: 270, 8: 20, 9: 10}
    assert [a for a, b in got["needs"].rows() if b == 9] == [1, 2, 3, 4, 5, 6, 7]
    # of two needed packages of one size, the size counts once
    same = P.dependencies(engine, R(engine, "a long, b long", (1, 2), (1, 3)), R(engine, "a long, n long", (1, 1), (2, 7), (3, 7)))
    assert dict(same["total"].rows())[1] == 8
