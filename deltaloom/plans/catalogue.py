"""Registered queries over the test tables, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import InvalidFormat, MaxIterationsExceeded, TooLarge
from ..operators import ExtendAnti, ExtendWith, FilterAnti, Iteration, Leaper, Relation, SecondaryIndex, Variable, aggregate, extend_into, fold, join_anti, join_helper, join_into, semi_join
from . import programs
from .closure import extend_closure, reachable_from, same_generation, transitive_closure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tree(spark, d) -> DataFrame:
    return _table(spark, d, "part").where("p_partkey > 1").selectExpr("p_partkey AS a", "p_partkey div 2 AS b")


def _supplied(spark, d, condition: str = "true") -> DataFrame:
    return _table(spark, d, "lineitem").where(condition).selectExpr("l_suppkey AS k", "l_partkey AS v")


def _recent(e: Engine, df: DataFrame) -> Variable:
    out = Variable(e, df.schema)
    out.insert(df)
    out.changed()
    return out


def relation_distinct(spark, d):
    return Relation(Engine(spark), _supplied(spark, d)).df


def relation_merge(spark, d):
    e = Engine(spark)
    return Relation(e, _supplied(spark, d, "l_returnflag = 'R'")).merge(Relation(e, _supplied(spark, d, "l_linestatus = 'O'"))).df


def relation_intersect(spark, d):
    e = Engine(spark)
    return Relation(e, _supplied(spark, d, "l_returnflag = 'R'")).intersect(Relation(e, _supplied(spark, d, "l_linestatus = 'O'"))).df


def variable_delta(spark, d):
    known = _recent(Engine(spark), _supplied(spark, d, "l_discount < 0.05"))
    known.insert(_supplied(spark, d, "l_discount >= 0.05"))
    known.changed()
    return known.recent


def variable_complete(spark, d):
    v = _recent(Engine(spark), _supplied(spark, d, "l_returnflag = 'R'"))
    v.insert(_supplied(spark, d, "l_linestatus = 'O'"))
    v.changed()
    v.insert(_supplied(spark, d, "l_quantity > 45"))
    return v.complete().df


def gallop_suffix(spark, d):
    return Relation(Engine(spark), _table(spark, d, "part").select("p_partkey")).suffix_from(1500).df


def gallop_tuple_suffix(spark, d):
    return Relation(Engine(spark), _supplied(spark, d)).suffix_from(50, 1000).df


def q_join_helper(spark, d):
    e = Engine(spark)
    left = Relation(e, _supplied(spark, d))
    right = Relation(e, _table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_nationkey AS n"))
    return join_helper(left, right, "k", ["r.n AS n", "l.v AS v"]).df


def q_join_into(spark, d):
    e = Engine(spark)
    nation = _recent(e, _table(spark, d, "supplier").selectExpr("s_suppkey", "s_nationkey"))
    lines = _recent(e, _table(spark, d, "lineitem").selectExpr("l_suppkey", "l_orderkey"))
    orders = _recent(e, _table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey"))
    middle, out = Variable(e, "s_nationkey int, l_orderkey bigint"), Variable(e, "s_nationkey int, o_custkey bigint")
    join_into(nation, lines, {"s_suppkey": "l_suppkey"}, ["l.s_nationkey AS s_nationkey", "r.l_orderkey AS l_orderkey"], middle)
    middle.changed()
    join_into(middle, orders, {"l_orderkey": "o_orderkey"}, ["l.s_nationkey AS s_nationkey", "r.o_custkey AS o_custkey"], out)
    return out.complete().df


def join_into_delta(spark, d):
    """Only what the second half of the lines adds to the join."""
    e = Engine(spark)
    lines = _recent(e, _supplied(spark, d, "l_linenumber <= 3"))
    nation = _recent(e, _table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_nationkey AS n"))
    nation.changed()
    lines.insert(_supplied(spark, d, "l_linenumber > 3"))
    lines.changed()
    out = Variable(e, "n int, v bigint")
    join_into(lines, nation, "k", ["r.n AS n", "l.v AS v"], out)
    return out.complete().df


def q_join_anti(spark, d):
    e = Engine(spark)
    customers = _recent(e, _table(spark, d, "customer").selectExpr("c_custkey"))
    urgent = _recent(e, _table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_custkey"))
    out = Variable(e, "c_custkey bigint")
    join_anti(customers, urgent, {"c_custkey": "o_custkey"}, None, out)
    return out.complete().df


def anti_whole_tuple(spark, d):
    e = Engine(spark)
    out = Variable(e, "k bigint, v bigint")
    join_anti(_recent(e, _supplied(spark, d, "l_returnflag = 'R'")), _recent(e, _supplied(spark, d, "l_linestatus = 'O'")), ["k", "v"], None, out)
    return out.complete().df


def q_semi_join(spark, d):
    e = Engine(spark)
    return semi_join(Relation(e, _supplied(spark, d)), Relation(e, _table(spark, d, "supplier").where("s_nationkey < 5").selectExpr("s_suppkey AS k")), "k").df


def theta_join(spark, d):
    e = Engine(spark)
    left = Relation(e, _table(spark, d, "supplier").selectExpr("s_nationkey AS n", "s_suppkey AS a"))
    right = Relation(e, _table(spark, d, "customer").selectExpr("c_nationkey AS n", "c_custkey AS b"))
    return join_helper(left, right, F.expr("l.n = r.n AND l.a < r.b"), ["l.a AS a", "r.b AS b"]).df


def _extended(spark, d, *leapers):
    e = Engine(spark)
    source = _recent(e, _table(spark, d, "supplier").selectExpr("s_suppkey AS k"))
    out = Variable(e, "k bigint, v bigint")
    extend_into(source, [make(e) for make in leapers], ["t.k AS k", "v AS v"], out)
    return out.complete().df


def extend_intersect(spark, d):
    return _extended(spark, d, lambda e: ExtendWith(Relation(e, _supplied(spark, d, "l_returnflag = 'R'")), {"k": "t.k"}, "v"), lambda e: ExtendWith(Relation(e, _supplied(spark, d, "l_linestatus = 'O'")), {"k": "t.k"}, "v"))


def extend_anti(spark, d):
    return _extended(spark, d, lambda e: ExtendWith(Relation(e, _supplied(spark, d, "l_returnflag = 'R'")), {"k": "t.k"}, "v"), lambda e: ExtendAnti(Relation(e, _supplied(spark, d, "l_linestatus = 'O'")), {"k": "t.k"}, "v"))


def filter_anti(spark, d):
    e = Engine(spark)
    source = _recent(e, _table(spark, d, "nation").selectExpr("n_nationkey AS n"))
    suppliers = Relation(e, _table(spark, d, "supplier").selectExpr("s_nationkey AS n", "s_suppkey AS s"))
    banned = Relation(e, _table(spark, d, "nation").where("n_regionkey = 1").selectExpr("n_nationkey AS n"))
    out = Variable(e, "n int, s bigint")
    extend_into(source, [ExtendWith(suppliers, {"n": "t.n"}, "s"), FilterAnti(banned, {"n": "t.n"})], ["t.n AS n", "v AS s"], out)
    return out.complete().df


def extend_only_anti(spark, d):
    return _extended(spark, d, lambda e: ExtendAnti(Relation(e, _supplied(spark, d)), {"k": "t.k"}, "v"))


def agg_sum(spark, d):
    rel = Relation(Engine(spark), _table(spark, d, "lineitem").selectExpr("l_suppkey AS k", "CAST(l_quantity AS BIGINT) AS q"))
    return aggregate(rel, "k", total="sum(q)").df


def agg_count(spark, d):
    return aggregate(Relation(Engine(spark), _supplied(spark, d)), "k", n="count(1)").df


def agg_minmax(spark, d):
    return aggregate(Relation(Engine(spark), _supplied(spark, d)), "k", low="min(v)", high="max(v)").df


def agg_derived_key(spark, d):
    return aggregate(Relation(Engine(spark), _supplied(spark, d)), "v % 10 AS g", n="count(1)").df


def agg_fold(spark, d):
    """A fold that no built-in says: a checksum that depends on the tuples' order."""
    rel = Relation(Engine(spark), _table(spark, d, "nation").selectExpr("n_regionkey AS k", "CAST(n_nationkey AS BIGINT) AS v"))
    return fold(rel, "k", F.lit(0).cast("long"), lambda acc, t: (acc * 31 + t["v"]) % 1000003, "value").df


def index_get(spark, d):
    return SecondaryIndex.of(Relation(Engine(spark), _supplied(spark, d)), "v").lookup(42).df


def index_range_inclusive(spark, d):
    return SecondaryIndex.of(Relation(Engine(spark), _supplied(spark, d)), "v").get_range(10, 20).df


def index_composite(spark, d):
    return SecondaryIndex.of(Relation(Engine(spark), _supplied(spark, d)), ["v", "k"]).get_range((10, 5), (12, 50)).df


def tc_tree(spark, d):
    return transitive_closure(Engine(spark), _tree(spark, d)).df


def tc_tree_linear(spark, d):
    return transitive_closure(Engine(spark), _tree(spark, d), linear=True).df


def reach_bound(spark, d):
    seeds = spark.createDataFrame([(1234,)], "v bigint")
    return reachable_from(Engine(spark), _tree(spark, d), seeds).df


def tc_cyclic(spark, d):
    """Every part: a cyclic graph on each 50 keys."""
    return transitive_closure(Engine(spark), _table(spark, d, "part").selectExpr("p_partkey AS a", "p_partkey div 50 * 50 + (p_partkey * 7 + 3) % 50 AS b")).df


def tc_nulls(spark, d):
    """Every part: a graph with nulls on each 40 keys."""
    edges = "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey END AS a", "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey div 40 * 40 + (p_partkey * 3 + 1) % 40 END AS b"
    return transitive_closure(Engine(spark), _table(spark, d, "part").selectExpr(*edges)).df


def q_same_generation(spark, d):
    """The whole part tree; the result has about a third of the square of the table's rows."""
    return same_generation(Engine(spark), _tree(spark, d).selectExpr("b AS p", "a AS c"), _table(spark, d, "part").selectExpr("p_partkey AS x", "p_partkey AS y")).df


def taint_blocked_reach(spark, d):
    e, part = Engine(spark), _table(spark, d, "part").where("p_partkey > 1").selectExpr("p_partkey div 2 AS a", "p_partkey AS b", "p_size")
    none = spark.createDataFrame([], "s bigint, v bigint")
    return programs.taint(e, Relation.from_rows(e, [1], "v bigint"), Relation(e, part.select("a", "b")), Relation(e, part.where("p_size % 5 = 0").select("a", "b")), Relation(e, none))["tainted"].df


def rbac(spark, d):
    """Every order a role of its customer, every part in the hierarchy, every line a permission."""
    e = Engine(spark)
    roles = _table(spark, d, "orders").selectExpr("o_custkey AS u", "o_orderkey AS r")
    above = _tree(spark, d).selectExpr("a AS c", "b AS p")
    perms = _table(spark, d, "lineitem").selectExpr("l_suppkey AS r", "l_linenumber AS p")
    denied = _table(spark, d, "customer").selectExpr("c_custkey AS u", "c_nationkey % 7 AS p")
    return programs.access_control(e, *[Relation(e, x) for x in (roles, above, perms, denied)])["effective"].df


def q_lineage(spark, d):
    e, part = Engine(spark), _table(spark, d, "part")
    moves = part.where("p_partkey > 1").selectExpr("p_partkey div 2 AS a", "p_partkey AS b", "p_size")
    rel = lambda df: Relation(e, df)
    return programs.lineage(e, rel(part.where("p_partkey BETWEEN 2 AND 5").selectExpr("p_partkey AS d")), rel(moves.select("a", "b")), rel(moves.where("p_size % 3 = 0").select("a", "b")), rel(part.where("p_partkey % 4 = 1").selectExpr("p_partkey AS d")))["violation"].df


def q_ontology(spark, d):
    """Every part has a trait and is associated."""
    e, part = Engine(spark), _table(spark, d, "part")
    rel = lambda df: Relation(e, df)
    return programs.ontology(e, rel(_tree(spark, d)), rel(part.selectExpr("p_partkey AS a", "CAST(p_size AS BIGINT) AS s")), rel(_table(spark, d, "supplier").selectExpr("s_suppkey AS d", "CAST(s_nationkey AS BIGINT) AS p")), rel(part.selectExpr("p_partkey % 25 AS p", "p_partkey AS a")))["effect"].df


def q_reachability(spark, d):
    e, part = Engine(spark), _table(spark, d, "part").where("p_partkey > 1")
    return programs.reachability(e, Relation(e, part.selectExpr("p_partkey AS a", "p_partkey div 2 AS b")), Relation(e, part.where("p_size % 2 = 0").selectExpr("p_partkey AS a", "p_partkey div 4 AS b")))["allowed"].df


def q_dependencies(spark, d):
    e, part = Engine(spark), _table(spark, d, "part")
    return programs.dependencies(e, Relation(e, _tree(spark, d)), Relation(e, part.selectExpr("p_partkey AS a", "CAST(p_size AS BIGINT) AS n")))["total"].df


def incremental_closure(spark, d):
    """Half of the edges to the fixpoint, then the rest; the same as all at once."""
    e = Engine(spark)
    half = transitive_closure(e, _tree(spark, d).where("a % 2 = 0"))
    return extend_closure(e, half, _tree(spark, d).where("a % 2 = 1")).df


def two_variables(spark, d):
    """Mutual recursion: nodes an even and an odd number of steps from the root."""
    loop = Iteration(Engine(spark))
    even, odd = loop.variable("v bigint"), loop.variable("v bigint")
    down = _recent(loop.engine, _tree(spark, d))
    down.changed()
    even.insert_rows([1])

    def step():
        join_into(even, down, {"v": "b"}, "r.a AS v", odd)
        join_into(odd, down, {"v": "b"}, "r.a AS v", even)

    loop.run(step)
    return even.complete().df.selectExpr("v", "0 AS parity").union(odd.complete().df.selectExpr("v", "1 AS parity"))


def recursion_limit(spark, d):
    """Rounds done before a limit of three stops the linear closure."""
    loop = Iteration(Engine(spark), 3)
    paths = loop.variable("a bigint, b bigint")
    edges = _recent(loop.engine, _tree(spark, d))
    edges.changed()
    paths.insert(_tree(spark, d))
    try:
        loop.run(lambda: join_into(paths, edges, {"b": "a"}, ["l.a AS a", "r.b AS b"], paths))
    except MaxIterationsExceeded:
        return paths.complete().df
    return spark.createDataFrame([], "a bigint, b bigint")


def saved_relation(spark, d):
    e = Engine(spark)
    path = f"{e.root}/saved-{uuid.uuid4().hex}"
    Relation(e, _supplied(spark, d)).save(path)
    return Relation.load(e, path).df


class _Below(Leaper):
    """Proposes all numbers from 0 to a tuple's own."""

    proposes = True

    def propose(self, tuples):
        return tuples.select("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t.n"))).alias("v"))


class _Even(Leaper):
    def intersect(self, pairs):
        return pairs.where("v % 2 = 0")


def custom_leaper(spark, d):
    e = Engine(spark)
    out = Variable(e, "n bigint, v bigint")
    extend_into(_recent(e, _table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS n")), [_Below(), _Even()], ["t.n AS n", "v AS v"], out)
    return out.complete().df


def extend_by_tuple(spark, d):
    """Each supplier's parts are proposed by whichever relation has the fewest for that supplier."""
    e = Engine(spark)
    leapers = [ExtendWith(Relation(e, _supplied(spark, d, c)), {"k": "t.k"}, "v") for c in ("l_returnflag = 'R'", "l_linestatus = 'O'", "l_quantity > 10")]
    out = Variable(e, "k bigint, v bigint")
    extend_into(_recent(e, _table(spark, d, "supplier").selectExpr("s_suppkey AS k")), leapers, ["t.k AS k", "v AS v"], out, by_tuple=True)
    return out.complete().df


def total_len(spark, d):
    """Tuples of a variable while some are stable, some recent and some pending."""
    v = _recent(Engine(spark), _supplied(spark, d, "l_returnflag = 'R'"))
    v.insert(_supplied(spark, d, "l_linestatus = 'O'"))
    v.changed()
    v.insert(_supplied(spark, d, "l_quantity > 45"))
    return spark.createDataFrame([(v.stable_count, v.recent_count, v.total_len())], "stable bigint, recent bigint, total bigint")


def load_checks(spark, d):
    """What loading says of good and bad folders; rows within the limit are counted."""
    e = Engine(spark)
    path, rows = f"{e.root}/saved-{uuid.uuid4().hex}", []
    saved = Relation(e, _supplied(spark, d))
    saved.save(path)
    n = saved.save(path)  # over itself
    kinds = {"missing": (f"{path}-none", None, None), "over the limit": (path, n - 1, None), "within the limit": (path, n, None), "other columns": (path, None, "k bigint, w bigint"), "no limit": (path, None, "k bigint, v bigint")}
    for name, (at, limit, schema) in kinds.items():
        try:
            rows.append((name, "rows", len(Relation.load(e, at, limit, schema))))
        except (InvalidFormat, TooLarge) as error:
            rows.append((name, type(error).__name__, 0))
    return spark.createDataFrame(rows, "name string, outcome string, n bigint")


def index_insert(spark, d):
    """Nations put into an index one tuple at a time, and those of one region."""
    ix = SecondaryIndex(Engine(spark), "r bigint, n bigint", "r")
    for r in _table(spark, d, "nation").selectExpr("CAST(n_regionkey AS BIGINT) AS r", "CAST(n_nationkey AS BIGINT) AS n").collect():
        ix.insert_rows([tuple(r)])
    return ix.get(2).df


def relation_sizes(spark, d):
    e = Engine(spark)
    pairs, none = Relation(e, _supplied(spark, d)), Relation.empty(e, "k bigint, v bigint")
    return spark.createDataFrame([(len(pairs), pairs.is_empty(), len(none), none.is_empty(), len(pairs.merge(none)))], "n bigint, is_empty boolean, n_none bigint, none_is_empty boolean, n_both bigint")


def tc_chain_linear(spark, d):
    """A chain of all nations by the linear rule: as many rounds as edges."""
    return transitive_closure(Engine(spark), _table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS a", "CAST(n_nationkey + 1 AS BIGINT) AS b"), linear=True).df


QUERIES = {
    "relation_distinct": relation_distinct, "relation_merge": relation_merge, "relation_intersect": relation_intersect, "variable_delta": variable_delta, "variable_complete": variable_complete,
    "gallop_suffix": gallop_suffix, "gallop_tuple_suffix": gallop_tuple_suffix, "join_helper": q_join_helper, "join_into": q_join_into, "join_into_delta": join_into_delta, "join_anti": q_join_anti,
    "anti_whole_tuple": anti_whole_tuple, "semi_join": q_semi_join, "theta_join": theta_join, "extend_intersect": extend_intersect, "extend_anti": extend_anti, "filter_anti": filter_anti,
    "extend_only_anti": extend_only_anti, "agg_sum": agg_sum, "agg_count": agg_count, "agg_minmax": agg_minmax, "agg_derived_key": agg_derived_key, "agg_fold": agg_fold, "index_get": index_get,
    "index_range_inclusive": index_range_inclusive, "index_composite": index_composite, "tc_tree": tc_tree, "tc_tree_linear": tc_tree_linear, "tc_cyclic": tc_cyclic, "tc_nulls": tc_nulls, "reach_bound": reach_bound,
    "same_generation": q_same_generation, "taint_blocked_reach": taint_blocked_reach, "rbac": rbac, "lineage": q_lineage, "ontology": q_ontology, "reachability": q_reachability, "dependencies": q_dependencies,
    "incremental_closure": incremental_closure, "two_variables": two_variables, "recursion_limit": recursion_limit, "saved_relation": saved_relation,
    "custom_leaper": custom_leaper, "extend_by_tuple": extend_by_tuple, "total_len": total_len, "load_checks": load_checks, "index_insert": index_insert, "relation_sizes": relation_sizes, "tc_chain_linear": tc_chain_linear,
}

_KV = "SELECT DISTINCT l_suppkey AS k, l_partkey AS v FROM lineitem"
_CLOSED = "r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"
_TREE = "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1)"

ORACLES = {
    "relation_distinct": _KV,
    "relation_merge": f"{_KV} WHERE l_returnflag = 'R' UNION {_KV} WHERE l_linestatus = 'O'",
    "relation_intersect": f"{_KV} WHERE l_returnflag = 'R' INTERSECT {_KV} WHERE l_linestatus = 'O'",
    "variable_delta": f"{_KV} WHERE l_discount >= 0.05 EXCEPT {_KV} WHERE l_discount < 0.05",
    "variable_complete": f"{_KV} WHERE l_returnflag = 'R' OR l_linestatus = 'O' OR l_quantity > 45",
    "gallop_suffix": "SELECT DISTINCT p_partkey FROM part WHERE p_partkey >= 1500",
    "gallop_tuple_suffix": f"{_KV} WHERE l_suppkey > 50 OR l_suppkey = 50 AND l_partkey >= 1000",
    "join_helper": "SELECT DISTINCT s_nationkey AS n, l_partkey AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "join_into": "SELECT DISTINCT s_nationkey, o_custkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey",
    "join_into_delta": f"SELECT DISTINCT s_nationkey AS n, v FROM ({_KV} WHERE l_linenumber > 3 EXCEPT {_KV} WHERE l_linenumber <= 3) JOIN supplier ON k = s_suppkey",
    "join_anti": "SELECT DISTINCT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "anti_whole_tuple": f"{_KV} WHERE l_returnflag = 'R' EXCEPT {_KV} WHERE l_linestatus = 'O'",
    "semi_join": f"{_KV} WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)",
    "theta_join": "SELECT DISTINCT s_suppkey AS a, c_custkey AS b FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey < c_custkey",
    "extend_intersect": f"SELECT k, v FROM ({_KV} WHERE l_returnflag = 'R' INTERSECT {_KV} WHERE l_linestatus = 'O') WHERE k IN (SELECT s_suppkey FROM supplier)",
    "extend_anti": f"SELECT k, v FROM ({_KV} WHERE l_returnflag = 'R' EXCEPT {_KV} WHERE l_linestatus = 'O') WHERE k IN (SELECT s_suppkey FROM supplier)",
    "filter_anti": "SELECT DISTINCT n_nationkey AS n, s_suppkey AS s FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE n_regionkey <> 1",
    "extend_only_anti": "SELECT s_suppkey AS k, s_suppkey AS v FROM supplier WHERE false",
    "agg_sum": "SELECT k, CAST(sum(q) AS BIGINT) AS total FROM (SELECT DISTINCT l_suppkey AS k, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY k",
    "agg_count": f"SELECT k, count(*) AS n FROM ({_KV}) GROUP BY k",
    "agg_minmax": "SELECT l_suppkey AS k, min(l_partkey) AS low, max(l_partkey) AS high FROM lineitem GROUP BY 1",
    "agg_derived_key": f"SELECT v % 10 AS g, count(*) AS n FROM ({_KV}) GROUP BY 1",
    "agg_fold": "SELECT n_regionkey AS k, list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey)), lambda a, x: (a * 31 + x) % 1000003) AS value FROM nation GROUP BY 1",
    "index_get": f"{_KV} WHERE l_partkey = 42",
    "index_range_inclusive": f"{_KV} WHERE l_partkey BETWEEN 10 AND 20",
    "index_composite": f"{_KV} WHERE (l_partkey > 10 OR l_partkey = 10 AND l_suppkey >= 5) AND (l_partkey < 12 OR l_partkey = 12 AND l_suppkey <= 50)",
    "tc_tree": f"{_TREE}, {_CLOSED} SELECT a, b FROM r",
    "tc_tree_linear": f"{_TREE}, {_CLOSED} SELECT a, b FROM r",
    "reach_bound": f"{_TREE}, r AS (SELECT CAST(1234 AS BIGINT) AS v UNION SELECT e.b FROM r JOIN e ON e.a = r.v) SELECT v FROM r",
    "taint_blocked_reach": """WITH RECURSIVE e AS (SELECT p_partkey // 2 AS a, p_partkey AS b FROM part WHERE p_partkey > 1 AND p_size % 5 <> 0),
        r AS (SELECT CAST(1 AS BIGINT) AS v UNION SELECT e.b FROM r JOIN e ON e.a = r.v) SELECT v FROM r""",
    "lineage": """WITH RECURSIVE e AS (SELECT p_partkey // 2 AS a, p_partkey AS b FROM part WHERE p_partkey > 1 AND p_size % 3 <> 0),
        r AS (SELECT p_partkey AS d FROM part WHERE p_partkey BETWEEN 2 AND 5 UNION SELECT e.b FROM r JOIN e ON e.a = r.d)
        SELECT d FROM r WHERE d IN (SELECT p_partkey FROM part WHERE p_partkey % 4 = 1)""",
    "reachability": f"{_TREE}, {_CLOSED} SELECT a, b FROM r EXCEPT SELECT p_partkey, p_partkey // 4 FROM part WHERE p_partkey > 1 AND p_size % 2 = 0",
    "dependencies": f"""{_TREE}, {_CLOSED}, n AS (SELECT a, CAST(sum(s) AS BIGINT) AS s FROM (SELECT DISTINCT r.a, CAST(p_size AS BIGINT) AS s FROM r JOIN part ON p_partkey = r.b) GROUP BY a)
        SELECT p_partkey AS a, CAST(p_size + coalesce(n.s, 0) AS BIGINT) AS n FROM part LEFT JOIN n ON n.a = p_partkey""",
    "incremental_closure": f"{_TREE}, {_CLOSED} SELECT a, b FROM r",
    "two_variables": f"{_TREE}, r AS (SELECT CAST(1 AS BIGINT) AS v, 0 AS parity UNION SELECT e.a, 1 - r.parity FROM r JOIN e ON e.b = r.v) SELECT v, CAST(parity AS INTEGER) AS parity FROM r",
    "recursion_limit": f"{_TREE}, r AS (SELECT a, b, 1 AS n FROM e UNION ALL SELECT r.a, e.b, n + 1 FROM r JOIN e ON r.b = e.a WHERE n < 4) SELECT DISTINCT a, b FROM r",
    "saved_relation": _KV,
    "tc_cyclic": f"WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 50 * 50 + (p_partkey * 7 + 3) % 50 AS b FROM part), {_CLOSED} SELECT a, b FROM r",
    "tc_nulls": f"WITH RECURSIVE e AS (SELECT DISTINCT CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey END AS a, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey // 40 * 40 + (p_partkey * 3 + 1) % 40 END AS b FROM part), {_CLOSED} SELECT a, b FROM r",
    "same_generation": f"""{_TREE}, sg AS (SELECT p_partkey AS x, p_partkey AS y FROM part
               UNION SELECT l.a, r.a FROM sg JOIN e l ON l.b = sg.x JOIN e r ON r.b = sg.y) SELECT x, y FROM sg""",
    "rbac": f"""{_TREE}, hr AS (SELECT o_custkey AS u, o_orderkey AS r FROM orders UNION SELECT hr.u, e.b FROM hr JOIN e ON e.a = hr.r),
        ca AS (SELECT DISTINCT u, l_linenumber AS p FROM hr JOIN (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem) ON l_suppkey = r)
        SELECT u, p FROM ca WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = ca.u AND c.c_nationkey % 7 = ca.p)""",
    "ontology": f"""{_TREE}, {_CLOSED},
        own AS (SELECT p_partkey AS a, CAST(p_size AS BIGINT) AS s FROM part),
        has AS (SELECT a, s FROM own UNION SELECT r.a, own.s FROM r JOIN own ON own.a = r.b),
        treats AS (SELECT DISTINCT s_suppkey AS d, p_partkey AS a FROM supplier JOIN part ON p_partkey % 25 = s_nationkey)
        SELECT DISTINCT d, s FROM treats JOIN has USING (a)""",
    "custom_leaper": "SELECT CAST(n_nationkey AS BIGINT) AS n, v FROM nation, LATERAL (SELECT unnest(range(0, n_nationkey + 1)) AS v) WHERE v % 2 = 0",
    "extend_by_tuple": f"SELECT k, v FROM ({_KV} WHERE l_returnflag = 'R' INTERSECT {_KV} WHERE l_linestatus = 'O' INTERSECT {_KV} WHERE l_quantity > 10) WHERE k IN (SELECT s_suppkey FROM supplier)",
    "total_len": f"""WITH s AS ({_KV} WHERE l_returnflag = 'R'), r AS ({_KV} WHERE l_linestatus = 'O' EXCEPT FROM s), p AS ({_KV} WHERE l_quantity > 45)
        SELECT (SELECT count(*) FROM s) AS stable, (SELECT count(*) FROM r) AS recent, (SELECT count(*) FROM s) + (SELECT count(*) FROM r) + (SELECT count(*) FROM p) AS total""",
    "load_checks": f"""WITH n AS (SELECT count(*) AS n FROM ({_KV}))
        SELECT name, outcome, CAST(CASE WHEN outcome = 'rows' THEN (SELECT n FROM n) ELSE 0 END AS BIGINT) AS n FROM (VALUES
        ('missing', 'InvalidFormat'), ('over the limit', 'TooLarge'), ('within the limit', 'rows'), ('other columns', 'InvalidFormat'), ('no limit', 'rows')) t(name, outcome)""",
    "index_insert": "SELECT CAST(n_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS n FROM nation WHERE n_regionkey = 2",
    "relation_sizes": f"WITH n AS (SELECT count(*) AS n FROM ({_KV})) SELECT n, n = 0 AS is_empty, CAST(0 AS BIGINT) AS n_none, true AS none_is_empty, n AS n_both FROM n",
    "tc_chain_linear": f"WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey + 1 AS BIGINT) AS b FROM nation), {_CLOSED} SELECT a, b FROM r",
}
