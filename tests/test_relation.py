"""Sets of tuples: construction, algebra, order, persistence."""

import json
import random

import pytest
from pyspark.sql import types as T

from deltaloom.errors import InvalidFormat, TooLarge, UnsupportedType, UnsupportedVersion
from deltaloom.operators import Relation

KV = "k long, v long"


def rel(engine, rows, schema=KV):
    return Relation.from_rows(engine, rows, schema)


def test_construction_sorts_and_merges_equal_tuples(engine):
    assert rel(engine, [5, 3, 3, 1, 5, 2, 1], "v long").rows() == [(1,), (2,), (3,), (5,)]
    assert rel(engine, [(2, 1), (1, 2), (1, 2), (1, 1)]).rows() == [(1, 1), (1, 2), (2, 1)]
    assert rel(engine, []).is_empty() and len(Relation.empty(engine, KV)) == 0


def test_merge_keeps_inputs(engine):
    a, b = rel(engine, [1, 3, 5], "v long"), rel(engine, [2, 3, 4], "v long")
    assert a.merge(b).rows() == [(i,) for i in range(1, 6)]
    assert len(a) == 3 and len(b) == 3
    with pytest.raises(ValueError):
        a.merge(rel(engine, [(1, 2)]))


def test_null_and_nan_are_one_value(engine):
    assert len(rel(engine, [(None, 1), (None, 1), (1, None)])) == 2
    assert len(rel(engine, [float("nan"), float("nan"), 0.0, -0.0], "x double")) == 2
    a = rel(engine, [(None, 1), (2, 2)])
    assert a.subtract(rel(engine, [(None, 1)])).rows() == [(2, 2)]
    assert a.intersect(rel(engine, [(None, 1)])).rows() == [(None, 1)]


def test_suffix(engine):
    odd = rel(engine, range(1, 16, 2), "v long")
    assert [len(odd.suffix_from(x)) for x in (6, 1, 20)] == [5, 8, 0]
    assert rel(engine, range(0, 2000, 2), "v long").suffix_from(1500).rows()[0] == (1500,)
    pairs = rel(engine, [(1, 5), (2, 1), (2, 3), (3, 0)])
    assert pairs.suffix_from(2, 2).rows() == [(2, 3), (3, 0)]
    assert pairs.suffix_from(2).rows() == [(2, 1), (2, 3), (3, 0)]


@pytest.mark.parametrize("rows,schema", [([(1, 10), (2, 20), (3, 30)], KV), ([3, 1, 2, 2], "v long"), ([(True, [1, 2], (1, 2.5))], "b boolean, a array<int>, s struct<x:int,y:double>")])
def test_save_and_load(engine, tmp_path, rows, schema):
    r = rel(engine, rows, schema)
    r.save(str(tmp_path / "r"))
    assert Relation.load(engine, str(tmp_path / "r")).rows() == r.rows()


def _stored(spark, path, rows, **head):
    """A folder as save() leaves it, with what the test wants to be wrong."""
    df = spark.createDataFrame(rows, KV)
    df.write.parquet(f"{path}/data-1")
    manifest = {"format": "deltaloom-relation", "version": 2, "rows": len(rows), "schema": df.schema.jsonValue(), "data": "data-1"} | head
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return str(path)


def test_load_normalises_and_checks_in_order(engine, spark, tmp_path):
    good = _stored(spark, tmp_path / "a", [(2, 20), (1, 10), (2, 20)])
    assert Relation.load(engine, good).rows() == [(1, 10), (2, 20)]
    assert len(Relation.load(engine, good, limit=3)) == 2
    with pytest.raises(TooLarge):  # the stored rows count, not the distinct ones
        Relation.load(engine, good, limit=2)
    with pytest.raises(InvalidFormat):
        Relation.load(engine, _stored(spark, tmp_path / "b", [], format="other", version=9), limit=0)
    with pytest.raises(UnsupportedVersion):
        Relation.load(engine, _stored(spark, tmp_path / "c", [(1, 1)], version=3), limit=0)
    assert Relation.load(engine, _stored(spark, tmp_path / "d", []), limit=0).rows() == []
    with pytest.raises(InvalidFormat):
        Relation.load(engine, str(tmp_path / "nothing"))
    with pytest.raises(InvalidFormat):
        Relation.load(engine, good, schema="k long, w long")


def test_unsupported_types(engine, spark, tmp_path):
    maps = T.StructType([T.StructField("m", T.MapType(T.StringType(), T.LongType()))])
    with pytest.raises(UnsupportedType):
        Relation.empty(engine, maps)
    with pytest.raises(UnsupportedType):
        Relation.load(engine, str(tmp_path / "none"), schema=maps)


def test_set_laws(engine):
    """Commutative, associative, idempotent, sorted, unique, round trip, on random sets."""
    rnd = random.Random(7)
    for _ in range(4):
        a, b, c = (rel(engine, [(rnd.randrange(8), rnd.randrange(8)) for _ in range(rnd.randrange(25))]) for _ in range(3))
        assert a.merge(b).rows() == b.merge(a).rows() == sorted(set(a.rows()) | set(b.rows()))
        assert a.merge(b).merge(c).rows() == a.merge(b.merge(c)).rows() == a.merge(b, c).rows()
        assert a.merge(a).rows() == a.rows() == sorted(set(a.rows()))


def test_saving_over_a_relation_is_safe(engine, tmp_path, monkeypatch):
    from deltaloom.sources import saved

    path = str(tmp_path / "over")
    Relation.from_rows(engine, [(1, 1)], "k long, v long").save(path)
    reading = Relation.load(engine, path)
    Relation.from_rows(engine, [(2, 2), (3, 3)], "k long, v long").save(path)
    assert Relation.load(engine, path).rows() == [(2, 2), (3, 3)] and reading.rows() == [(1, 1)]
    with monkeypatch.context() as m:  # a writer that dies before its manifest
        m.setattr(saved.json, "dumps", lambda *a, **b: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            Relation.from_rows(engine, [(4, 4)], "k long, v long").save(path)
    assert Relation.load(engine, path).rows() == [(2, 2), (3, 3)]
    saved.clean_relation(engine, path)
    assert Relation.load(engine, path).rows() == [(2, 2), (3, 3)] and len(list((tmp_path / "over").glob("data-*"))) == 1
