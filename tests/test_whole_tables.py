"""Queries over whole tables, against brute force."""

import random

import pytest
from test_fixpoint import naive_closure

from deltaloom.plans import catalogue

PARTS = 230


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd, d = random.Random(11), tmp_path_factory.mktemp("tables")
    made = {
        "part": ("p_partkey long, p_size int", [(i, rnd.randrange(1, 51)) for i in range(PARTS)]),
        "supplier": ("s_suppkey long, s_nationkey int", [(i, rnd.randrange(25)) for i in range(1, 13)]),
        "orders": ("o_orderkey long, o_custkey long", [(100 * i if i % 3 else i, i % 40) for i in range(1, 150)]),
        "lineitem": ("l_suppkey long, l_linenumber int, l_quantity int", [(rnd.choice([1, 3, 6, 50, 120, 200]), rnd.randrange(1, 8), 1) for _ in range(16)]),
        "customer": ("c_custkey long, c_nationkey int", [(i, rnd.randrange(25)) for i in range(0, 40, 2)]),
    }
    for name, (kind, rows) in made.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return str(d), {name: rows for name, (_, rows) in made.items()}


def above(i):
    """i and its ancestors in the part tree."""
    out = [i]
    while 1 < i < PARTS:
        i //= 2
        out.append(i)
    return out


def brute(name, t):
    keys = [i for i, _ in t["part"]]
    if name == "tc_cyclic":
        return naive_closure([(a, a // 50 * 50 + (a * 7 + 3) % 50) for a in keys])
    if name == "tc_nulls":
        return naive_closure([(a if a % 10 else None, a // 40 * 40 + (a * 3 + 1) % 40 if a % 7 else None) for a in keys])
    if name == "same_generation":
        return [(x, y) for x in keys for y in keys if x == y or x and y and x.bit_length() == y.bit_length()]
    if name == "rbac":
        has = {(u, r) for o, u in t["orders"] for r in above(o)}
        access = {(u, p) for u, r in has for s, p, _ in t["lineitem"] if s == r}
        return access - {(u, n % 7) for u, n in t["customer"]}
    size = dict(t["part"])
    return {(d, size[b]) for d, n in t["supplier"] for a in keys if a % 25 == n for b in above(a)}


@pytest.mark.parametrize("name", ["tc_cyclic", "tc_nulls", "same_generation", "rbac", "ontology"])
def test_whole_table_equals_brute_force(spark, tables, name):
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, tables[0]).collect()]
    want = set(brute(name, tables[1]))
    assert len(got) == len(want) and set(got) == want
