"""Whole programs: authorisation, lineage, taint, ontology, reachability, dependencies.

Each takes relations with the column names it documents and returns relations. Negation
always reads finished relations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import ExtendAnti, ExtendWith, Iteration, Relation, aggregate, anti_join, extend_into, join_helper, semi_join
from .closure import reachable_from, transitive_closure


def _minus(left: Relation, right: Relation, on) -> Relation:
    """Tuples of left without a partner in right, both finished; what is left needs no comparison."""
    return anti_join(left, right, on)


def access_control(engine: Engine, user_role: Relation, role_parent: Relation, role_perm: Relation, denied: Relation) -> dict[str, Relation]:
    """Roles (u, r) inherited along (c, p), permissions by (r, p), less denied (u, p).

    The hierarchy is closed by itself, and permissions go down to each role, so that users are
    joined once with what their own roles permit; the roles they inherit are only made if these
    are asked for.
    """
    above = transitive_closure(engine, role_parent)
    has = user_role.merge(join_helper(user_role, above, {"r": "a"}, ["l.u AS u", "r.b AS r"]))
    granted = role_perm.merge(join_helper(above, role_perm, {"b": "r"}, ["l.a AS r", "r.p AS p"])).stored()
    access = join_helper(user_role, granted, "r", ["l.u AS u", "r.p AS p"]).stored()
    return {"has_role": has, "can_access": access, "effective": _minus(access, denied, ["u", "p"])}


def lineage(engine: Engine, source: Relation, transform: Relation, anonymised: Relation, public: Relation) -> dict[str, Relation]:
    """Datasets (d) that hold personal data, along (a, b) unless (a, b) is anonymised.

    A public one among them is a violation.
    """
    loop = Iteration(engine)
    holds = loop.variable(source.schema)
    holds.insert(source)
    leapers = [ExtendWith(transform.stored(), {"a": "t.d"}, "b"), ExtendAnti(anonymised.stored(), {"a": "t.d"}, "b")]
    loop.run(lambda: extend_into(holds, leapers, "v AS d", holds))
    found = holds.complete().stored()
    bad = semi_join(found, public, "d")
    return {"holds": found, "violation": bad, "clean": _minus(public, bad, "d")}


def taint(engine: Engine, source: Relation, flow: Relation, sanitised: Relation, sink: Relation) -> dict[str, Relation]:
    """Variables (v) tainted along (a, b) that isn't sanitised; violations (v, s) by sink (s, v)."""
    loop = Iteration(engine)
    dirty = loop.variable(source.schema)
    dirty.insert(source)
    leapers = [ExtendWith(flow.stored(), {"a": "t.v"}, "b"), ExtendAnti(sanitised.stored(), {"a": "t.v"}, "b")]
    loop.run(lambda: extend_into(dirty, leapers, "v AS v", dirty))
    found = dirty.complete().stored()
    return {"tainted": found, "violation": join_helper(found, sink, "v", ["l.v AS v", "r.s AS s"]), "safe": _minus(sink, found, "v").select("s")}


def ontology(engine: Engine, is_a: Relation, has: Relation, targets: Relation, associated: Relation) -> dict[str, Relation]:
    """Closure of is_a (a, b); traits has (a, s) inherited from b; treats (d, a) by targets
    (d, p) and associated (p, a); effects (d, s) of what a drug treats.

    Effects are found by way of (p, s): what a drug treats is only made if it is asked for.
    """
    closure = transitive_closure(engine, is_a)
    inherited = join_helper(closure, has, {"b": "a"}, ["l.a AS a", "r.s AS s"])
    traits = has.merge(inherited)
    treats = join_helper(targets, associated, "p", ["l.d AS d", "r.a AS a"])
    through = join_helper(associated, traits, "a", ["l.p AS p", "r.s AS s"]).stored()
    return {"is_a": closure, "has": traits, "treats": treats, "effect": join_helper(targets, through, "p", ["l.d AS d", "r.s AS s"])}


def reachability(engine: Engine, link: Relation, blocked: Relation) -> dict[str, Relation]:
    """Closure of link (a, b), and what of it is not blocked (a, b)."""
    reach = transitive_closure(engine, link)
    return {"reachable": reach, "allowed": _minus(reach, blocked, ["a", "b"])}


def dependencies(engine: Engine, direct: Relation, size: Relation) -> dict[str, Relation]:
    """Closure of direct (a, b); cycles (a); total size of a's own and all needed packages.

    As relations are sets, two packages of one size count once among a package's sizes.
    """
    needs = transitive_closure(engine, direct)
    sizes = join_helper(needs, size, {"b": "a"}, ["l.a AS a", "r.n AS n"])
    needed = aggregate(sizes, "a", n="sum(n)")
    own = size.df.alias("s").join(needed.df.alias("t"), F.expr("s.a = t.a"), "left").select("s.a", (F.col("s.n") + F.coalesce("t.n", F.lit(0))).alias("n"))
    return {"needs": needs, "cycle": needs.where("a = b").select("a"), "needed": needed, "total": Relation(engine, own)}


def reach_from(engine: Engine, edges: Relation, node) -> Relation:
    """What one node reaches, the recursion seeded with it."""
    return reachable_from(engine, edges, Relation.from_rows(engine, [node], f"v {edges.schema[0].dataType.simpleString()}"))
