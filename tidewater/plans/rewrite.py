"""Logical rewrites that EXPLAIN shows. Queries run through Catalyst, which has its own and more of them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession

from tidewater.functions import registry as R
from tidewater.functions import types as T
from tidewater.plans import logical as L
from tidewater.plans.physical import column, conjuncts

TRUE = L.Const(True, T.BOOL)


def map_sources(p, fn):
    match p:
        case L.Join():
            return replace(p, left=fn(p.left), right=fn(p.right))
        case L.UnionAll():
            return replace(p, sources=[fn(s) for s in p.sources])
        case L.Project() | L.Filter() | L.Group() | L.Sort() | L.Limit() | L.Alias() | L.Negate() | L.Insert():
            return replace(p, source=fn(p.source))
    return p


def map_expressions(p, fn):
    match p:
        case L.Project():
            return replace(p, items=[(n, fn(e)) for n, e in p.items])
        case L.Group():
            return replace(p, keys=[fn(k) for k in p.keys], items=[(n, fn(e)) for n, e in p.items])
        case L.Filter():
            return replace(p, predicate=fn(p.predicate))
        case L.Join():
            return replace(p, on=fn(p.on))
        case L.Sort():
            return replace(p, keys=[(fn(e), up) for e, up in p.keys])
    return p


def everywhere(p, fn):
    """fn on all expressions of a plan."""
    return map_expressions(map_sources(p, lambda s: everywhere(s, fn)), fn)


def fold(spark: SparkSession, plan):
    """Calls of constants as their values, all found in one query."""
    found: dict = {}

    def constant(e) -> bool:
        return all(isinstance(x, L.Const) or (isinstance(x, L.Apply) and not x.aggregate) for x in L.parts(e))

    def collect(e):
        if isinstance(e, L.Apply) and constant(e):
            found.setdefault(e, None)
        elif isinstance(e, L.Apply):
            for a in e.args:
                collect(a)
        return e

    everywhere(plan, collect)
    if not found:
        return plan
    row = spark.range(1).select(*[column(e, []).cast(T.spark_type(e.type)).alias(f"c{i}") for i, e in enumerate(found)]).first()
    values = {e: L.Const(v, e.type) for e, v in zip(found, row, strict=True)}

    def put(e):
        if e in values:
            return values[e]
        return replace(e, args=tuple(map(put, e.args))) if isinstance(e, L.Apply) else e

    return everywhere(plan, put)


def conjunction(parts: list):
    parts = [p for p in parts if p != TRUE]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = L.Apply("and", (out, p), T.BOOL, R.resolve("and", [T.BOOL, T.BOOL]))
    return out


def inline(e, items):
    return L.rebuilt(e, lambda x: items[x.offset][1] if isinstance(x, L.Ref) else x)


def shift(e, by: int):
    return L.rebuilt(e, lambda x: L.Ref(x.offset + by, x.type) if isinstance(x, L.Ref) else x)


def push(plan, wanted: list | None = None):
    """Predicates as near to their sources as they go; `wanted`: those from above, over the plan's output."""
    wanted = list(wanted or ())
    match plan:
        case L.Filter():
            return push(plan.source, [*wanted, *conjuncts(plan.predicate)])
        case L.Sort() | L.Negate():
            return replace(plan, source=push(plan.source, wanted))
        case L.Project():
            return replace(plan, source=push(plan.source, [inline(w, plan.items) for w in wanted]))
        case L.UnionAll():
            return replace(plan, sources=[push(s, wanted) for s in plan.sources])
        case L.Join():
            width = len(plan.left.fields)
            side = lambda e: {r >= width for r in L.refs(e)}
            left, right, both, after = [], [], [], []
            for e in conjuncts(plan.on):
                where = side(e)
                if plan.kind == "left":
                    (right if where == {True} else both).append(e)
                else:
                    (left if where == {False} else right if where == {True} else both if where else left).append(e)
                    if not where:
                        right.append(e)
            for e in wanted:
                where = side(e)
                if where <= {False}:
                    left.append(e)
                    if not where and plan.kind == "inner":
                        right.append(e)
                elif plan.kind == "inner":
                    (right if where == {True} else both).append(e)
                else:
                    after.append(e)
            joined = replace(plan, left=push(plan.left, left), right=push(plan.right, [shift(e, -width) for e in right]), on=conjunction(both) or TRUE)
            return _filtered(joined, after)
    return _filtered(map_sources(plan, push), wanted)


def _filtered(plan, wanted: list):
    predicate = conjunction(wanted)
    return plan if predicate is None else L.Filter(predicate, plan)


def collapse(plan):
    """A projection of a projection as one."""
    plan = map_sources(plan, collapse)
    while isinstance(plan, L.Project) and isinstance(plan.source, L.Project):
        plan = L.Project([(n, inline(e, plan.source.items)) for n, e in plan.items], plan.source.source)
    return plan


def join_keys(plan):
    """Equalities between a join's sides as key columns in front of both."""
    plan = map_sources(plan, join_keys)
    if not isinstance(plan, L.Join):
        return plan
    width, keys, rest = len(plan.left.fields), [], []
    for e in conjuncts(plan.on):
        if isinstance(e, L.Apply) and e.name == "=":
            a, b = e.args
            sides = [{r >= width for r in L.refs(x)} for x in (a, b)]
            if sides in ([{False}, {True}], [{True}, {False}]):
                a, b = (a, b) if sides[0] == {False} else (b, a)
                keys.append((e, a, shift(b, -width)))
                continue
        rest.append(e)
    if not keys:
        return plan
    n = len(keys)

    def keyed(source, own):
        items = [(f"key_{i}", k) for i, k in enumerate(own)] + [(f.name, L.Ref(i, f.type)) for i, f in enumerate(source.fields)]
        return collapse(L.Project(items, source))

    def moved(e):
        return L.rebuilt(e, lambda x: L.Ref(x.offset + (n if x.offset < width else 2 * n), x.type) if isinstance(x, L.Ref) else x)

    on = [replace(e, args=(L.Ref(i, a.type), L.Ref(n + width + i, b.type))) for i, (e, a, b) in enumerate(keys)] + [moved(e) for e in rest]
    joined = L.Join(keyed(plan.left, [a for _, a, _ in keys]), keyed(plan.right, [b for _, _, b in keys]), plan.kind, conjunction(on))
    out = [(f.name, L.Ref(i + (n if i < width else 2 * n), f.type)) for i, f in enumerate(plan.fields)]
    return L.Project(out, joined)


def optimized(spark: SparkSession, plan):
    plan = fold(spark, push(fold(spark, plan)))
    return collapse(join_keys(collapse(plan)))
