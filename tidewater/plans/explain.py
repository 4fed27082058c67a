"""EXPLAIN: the rewritten logical plan as rows (tree, col_idx, datatype, expression)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewater.plans import logical as L
from tidewater.plans.rewrite import optimized

# operators' names in EXPLAIN.
NAMES = {L.Single: "SINGLE", L.Group: "GROUP", L.Project: "PROJECT", L.Sort: "SORT", L.Values: "VALUES", L.Table: "TABLE", L.Filter: "FILTER", L.Limit: "LIMIT", L.UnionAll: "UNION_ALL", L.Insert: "INSERT", L.Negate: "NEGATE", L.FileScan: "FILE_SCAN", L.Join: "JOIN"}


def explain(spark: SparkSession, plan) -> list[tuple[str, str, str, str]]:
    return list(_lines(optimized(spark, plan), ""))


def _lines(p, pad: str):
    alias = None
    if isinstance(p, L.Table):
        alias = p.name
    while isinstance(p, L.Alias):
        alias, p = alias or p.name, p.source
    yield f"{pad}{NAMES[type(p)]}{f'({alias})' if alias else ''}", "", "", ""
    pad += " |"
    if isinstance(p, (L.Project, L.Group)) and p.items:
        yield f"{pad}output_exprs:", "", "", ""
        for i, (name, e) in enumerate(p.items):
            yield f"{pad}  {name}", str(i), str(e.type), str(e)
    if isinstance(p, (L.Table, L.FileScan)):
        yield f"{pad}columns:", "", "", ""
        for i, f in enumerate(p.fields):
            yield f"{pad}  {f.name}", str(i), str(f.type), ""
    if isinstance(p, L.Limit):
        yield f"{pad}limit: {p.limit}", "", "", ""
        yield f"{pad}offset: {p.offset}", "", "", ""
    if isinstance(p, (L.Filter, L.Join)):
        e = p.predicate if isinstance(p, L.Filter) else p.on
        yield f"{pad}predicate:", "", "", ""
        yield pad, "", str(e.type), str(e)
    if isinstance(p, L.Group) and p.keys:
        yield f"{pad}group_keys:", "", "", ""
        for e in p.keys:
            yield pad, "", str(e.type), str(e)
    if isinstance(p, L.Sort):
        yield f"{pad}sort_exprs:", "", "", ""
        for e, up in p.keys:
            yield f"{pad}  ", "", str(e.type), f"{e} ({'ASC' if up else 'DESC'})"
    if isinstance(p, L.Join):
        sources = [("left", p.left), ("right", p.right)]
    elif isinstance(p, L.UnionAll):
        sources = [(f"source_{i}", s) for i, s in enumerate(p.sources)]
    else:
        sources = [("source", p.source)] if hasattr(p, "source") else []
    for name, s in sources:
        yield f"{pad}{name}:", "", "", ""
        yield from _lines(s, pad + "  ")
