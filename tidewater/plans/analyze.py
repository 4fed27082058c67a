"""From syntax to typed logical plans: names, stars, views, functions, types and the checks on them."""

from __future__ import annotations

from dataclasses import replace

from tidewater.functions import registry as R
from tidewater.functions import types as T
from tidewater.functions.types import SqlError, SqlType
from tidewater.plans import ast as A
from tidewater.plans import logical as L

# Server variables that clients ask for.
VARIABLES = {"@@max_allowed_packet": (16777215, T.INT), "@@socket": ("", T.TEXT)}
MAX_VIEWS = 64


class Analyzer:
    """`catalog` finds tables and views; `database` is where bare names are looked for."""

    def __init__(self, catalog, database: str, depth: int = 0):
        self.catalog, self.database, self.depth = catalog, database, depth

    # Expressions

    def expression(self, e, fields: list[L.Field], aggregates: bool = False):
        if isinstance(e, A.Literal):
            return L.Const(e.value, e.type)
        if isinstance(e, A.Name):
            if e.qualifier is None and e.name in VARIABLES:
                return L.Const(*VARIABLES[e.name])
            return self.column(e, fields)
        if isinstance(e, A.Cast):
            inner = self.expression(e.expr, fields, aggregates)
            return self.apply(R.CASTS[e.type.kind], [inner], e.type if e.type.kind == "decimal" else None)
        if isinstance(e, A.Call):
            args = [self.expression(a, fields, aggregates) for a in e.args]
            if e.name == "database" and not args:
                found = R.resolve("database", [])
                return L.Apply("database", (), T.TEXT, replace(found, build=lambda c, t, r, name=self.database: R.literal(name, T.TEXT)))
            made = self.apply(e.name, args)
            if made.aggregate:
                if not aggregates:
                    raise SqlError(f"Aggregate {e.name} is not allowed here")
                if any(map(L.has_aggregate, args)):
                    raise SqlError(f"Aggregate {e.name} of an aggregate")
            return made
        raise SqlError("A star is not an expression")

    def apply(self, name: str, args: list, returns: SqlType | None = None) -> L.Apply:
        found = R.resolve(name, [a.type for a in args])
        cast = []
        for a, want in zip(args, found.params, strict=True):
            if want not in ("any", a.type.kind) and a.type.kind != "null":
                a = self.apply(R.CASTS[want], [a])
            cast.append(a)
        types = [self._as_param(a.type, want) for a, want in zip(cast, found.params, strict=True)]
        return L.Apply(name, tuple(cast), returns or found.returns(types), found)

    @staticmethod
    def _as_param(t: SqlType, want: str) -> SqlType:
        if t.kind != "null" or want == "any":
            return t
        return T.decimal(1, 0) if want == "decimal" else SqlType(want)

    @staticmethod
    def column(name: A.Name, fields: list[L.Field]) -> L.Ref:
        hits = [i for i, f in enumerate(fields) if f.name == name.name and name.qualifier in (None, f.qualifier)]
        if not hits:
            raise SqlError(f"Field {name} not found, possible fields are ({', '.join(map(str, fields))})")
        if len(hits) > 1:
            raise SqlError(f"Field {name} is ambiguous, it may be any of ({', '.join(str(fields[i]) for i in hits)})")
        return L.Ref(hits[0], fields[hits[0]].type)

    def predicate(self, e, fields):
        made = self.expression(e, fields)
        if made.type.kind not in ("bool", "null"):
            raise SqlError(f"A predicate must be BOOLEAN, not {made.type}")
        return made

    # Queries

    def query(self, q):
        if isinstance(q, A.Union):
            sources = [self.select(b) for b in q.branches]
            first = [f.type for f in sources[0].fields]
            for s in sources[1:]:
                if [f.type for f in s.fields] != first:
                    raise SqlError(f"UNION ALL of different types: ({', '.join(map(str, first))}), ({', '.join(str(f.type) for f in s.fields)})")
            return L.UnionAll(sources)
        return self.select(q)

    def select(self, s: A.Select):
        plan = self.source(s.source)
        if s.where is not None:
            plan = L.Filter(self.predicate(s.where, plan.fields), plan)
        items = self.items(s.items, plan.fields)
        if s.group:
            keys = [self.expression(k, plan.fields) for k in s.group]
            plan = L.Group(keys, items, plan)
        elif any(L.has_aggregate(e) for _, e in items):
            plan = L.Group([], items, plan)
        else:
            plan = L.Project(items, plan)
        if s.order:
            plan = L.Sort([(self.expression(k, plan.fields), up) for k, up in s.order], plan)
        if s.limit is not None:
            plan = L.Limit(*s.limit, plan)
        return plan

    def items(self, items, fields):
        out = []
        for e, alias in items:
            if isinstance(e, A.Star):
                hits = [i for i, f in enumerate(fields) if e.qualifier in (None, f.qualifier)]
                if not hits and e.qualifier:
                    raise SqlError(f"Field {e.qualifier}.* not found, possible fields are ({', '.join(map(str, fields))})")
                out += [(fields[i].name, L.Ref(i, fields[i].type)) for i in hits]
            else:
                name = alias or (e.name if isinstance(e, A.Name) and not e.name.startswith("@@") else f"_col{len(out) + 1}")
                out.append((name, self.expression(e, fields, aggregates=True)))
        return out

    def source(self, s):
        if s is None:
            return L.Single()
        if isinstance(s, A.JoinRef):
            left, right = self.source(s.left), self.source(s.right)
            return L.Join(left, right, s.kind, self.predicate(s.on, [*left.fields, *right.fields]))
        if isinstance(s, A.Subquery):
            plan = self.query(s.select)
            return L.Alias(s.alias, plan) if s.alias else plan
        if isinstance(s, A.Directory):
            plan = L.FileScan(s.path, s.delimiter, replace(T.JSON, flat=True))
            return L.Alias(s.alias, plan) if s.alias else plan
        return self.table(s.database, s.name, s.alias)

    def table(self, database: str | None, name: str, alias: str | None = None):
        item = self.catalog.find(database or self.database, name)
        if item.sql is not None:
            if self.depth >= MAX_VIEWS:
                raise SqlError(f"Views of {name} go too deep")
            from tidewater.plans.parser import Parser

            inner = Analyzer(self.catalog, item.context, self.depth + 1)
            return L.Alias(alias or name, inner.query(Parser(item.sql).select()))
        plan = L.Table(item.name, item.columns, item.read)
        return L.Alias(alias, plan) if alias else plan

    def own_table(self, database: str | None, name: str) -> L.Table:
        plan = self.table(database, name)
        if not isinstance(plan, L.Table) or self.catalog.find(database or self.database, name).system:
            raise SqlError(f"{name} is not a table that can be written")
        return plan

    # Writes

    def insert(self, table, query) -> L.Insert:
        target, source = self.own_table(*table), self.query(query)
        want, have = [t for _, t in target.columns], [f.type for f in source.fields]
        if want != have:
            raise SqlError(f"Insert into ({', '.join(map(str, want))}) of ({', '.join(map(str, have))})")
        return L.Insert(target, source)

    def insert_values(self, table, rows) -> L.Insert:
        target = self.own_table(*table)
        want = [t for _, t in target.columns]
        out = []
        for row in rows:
            made = [self.expression(v, []) for v in row]
            have = [e.type for e in made]
            if len(have) != len(want) or any(h not in (w, T.NULL) for h, w in zip(have, want, strict=True)):
                raise SqlError(f"Insert into ({', '.join(map(str, want))}) of ({', '.join(map(str, have))})")
            out.append(tuple(made))
        return L.Insert(target, L.Values(target.columns, out))

    def delete(self, table, where, limit) -> L.Insert:
        target = self.own_table(*table)
        plan = target
        if where is not None:
            plan = L.Filter(self.predicate(where, plan.fields), plan)
        if limit is not None:
            plan = L.Limit(*limit, plan)
        return L.Insert(target, L.Negate(plan))
