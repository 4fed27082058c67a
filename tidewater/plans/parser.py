"""Recursive-descent parser of the dialect."""

from __future__ import annotations

import re
from decimal import Decimal

from tidewater.functions import types as T
from tidewater.functions.types import SqlError
from tidewater.plans import ast as A

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<number>\d+\.\d*|\.\d+|\d+)
      | (?P<word>[^\W\d][\w$@]*|[$@][\w$@]*)
      | (?P<quoted>`[^`]*`)
      | (?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
      | (?P<op>->>|->|<=|>=|!=|[=<>+\-*/(),.;])""",
    re.X | re.S,
)
# Words that cannot be a bare identifier where an alias may stand.
RESERVED = frozenset("from where order union limit group join left right inner outer full on is".split())
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}
_COMPARE = ("=", "!=", ">=", ">", "<=", "<")


def tokenize(sql: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"Cannot read the statement at: {sql[at : at + 30]!r}")
        kind = m.lastgroup
        if kind != "space":
            text = m.group()
            if kind == "string":
                text = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), text[1:-1], flags=re.S)
            elif kind == "quoted":
                text = text[1:-1].lower()
            elif kind == "word":
                text = text.lower()
            out.append((kind, text, at))
        at = m.end()
    return [*out, ("end", "", len(sql))]


def number(text: str) -> A.Literal:
    """Integers take the smallest type that holds them; all else is an exact decimal."""
    if "." not in text:
        value = int(text)
        if -(1 << 31) <= value < 1 << 31:
            return A.Literal(value, T.INT)
        if -(1 << 63) <= value < 1 << 63:
            return A.Literal(value, T.BIGINT)
        return A.Literal(Decimal(value), T.decimal(len(text.lstrip("-")), 0))
    value = Decimal(text)
    whole, _, part = text.lstrip("-").partition(".")
    digits = len(whole.lstrip("0")) + len(part)
    return A.Literal(value, T.decimal(max(1, digits, len(part)), len(part)))


class Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.i = sql, tokenize(sql), 0

    # Tokens

    def peek(self, *words: str) -> bool:
        """Whether the next tokens are these words or operators."""
        for k, w in enumerate(words):
            kind, text, _ = self.tokens[min(self.i + k, len(self.tokens) - 1)]
            if text != w or kind not in ("word", "op"):
                return False
        return True

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.take(*words):
            at = self.tokens[self.i][2]
            raise SqlError(f"Expected {' '.join(words).upper()} at: {self.sql[at : at + 30]!r}")

    def fail(self, what: str):
        at = self.tokens[self.i][2]
        raise SqlError(f"Expected {what} at: {self.sql[at : at + 30]!r}")

    def identifier(self) -> str:
        kind, text, _ = self.tokens[self.i]
        if kind == "quoted" or (kind == "word" and text not in RESERVED):
            self.i += 1
            return text
        self.fail("an identifier")

    def string(self) -> str:
        kind, text, _ = self.tokens[self.i]
        if kind != "string":
            self.fail("a string")
        self.i += 1
        return text

    def integer(self) -> int:
        kind, text, _ = self.tokens[self.i]
        if kind != "number" or "." in text:
            self.fail("an integer")
        self.i += 1
        return int(text)

    def alias(self) -> str | None:
        if self.take("as"):
            return self.identifier()
        kind, text, _ = self.tokens[self.i]
        if kind == "quoted" or (kind == "word" and text not in RESERVED):
            self.i += 1
            return text
        return None

    def end(self) -> None:
        self.take(";")
        if self.tokens[self.i][0] != "end":
            self.fail("the end of the statement")

    # Expressions, loosest first

    def expression(self):
        left = self.conjunction()
        while self.take("or"):
            left = A.Call("or", (left, self.conjunction()))
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("and"):
            left = A.Call("and", (left, self.negation()))
        return left

    def negation(self):
        if self.take("not"):
            return A.Call("not", (self.negation(),))
        return self.between()

    def between(self):
        value = self.comparison()
        if self.take("between"):
            low = self.comparison()
            self.expect("and")
            return A.Call("between", (value, low, self.comparison()))
        return value

    def comparison(self):
        left = self.sum()
        while True:
            if op := next((o for o in _COMPARE if self.take(o)), None):
                left = A.Call(op, (left, self.sum()))
            elif self.take("is"):
                negated = self.take("not")
                name = next((n for w, n in (("null", "isnull"), ("true", "istrue"), ("false", "isfalse")) if self.take(w)), None)
                if name is None:
                    self.fail("NULL, TRUE or FALSE")
                left = A.Call(name, (left,))
                left = A.Call("not", (left,)) if negated else left
            else:
                return left

    def _chain(self, ops, below):
        left = below()
        while op := next((o for o in ops if self.take(o)), None):
            left = A.Call(op, (left, below()))
        return left

    def sum(self):
        return self._chain(("+", "-"), self.product)

    def product(self):
        return self._chain(("*", "/"), self.path)

    def path(self):
        left = self.primary()
        while op := next((o for o in ("->>", "->") if self.take(o)), None):
            left = A.Call(op if op == "->>" else "->", (left, self.primary()))
        return left

    def primary(self):
        kind, text, _ = self.tokens[self.i]
        after = self.tokens[min(self.i + 1, len(self.tokens) - 1)]
        if kind == "number":
            self.i += 1
            return number(text)
        if kind == "op" and text == "-" and after[0] == "number":
            self.i += 2
            return number("-" + after[1])
        if kind == "string":
            self.i += 1
            return A.Literal(text, T.TEXT)
        if self.take("("):
            inner = self.expression()
            self.expect(")")
            return inner
        if kind == "word":
            if text in ("null", "true", "false"):
                self.i += 1
                return {"null": A.Literal(None, T.NULL), "true": A.Literal(True, T.BOOL), "false": A.Literal(False, T.BOOL)}[text]
            if text == "date" and after[0] == "string":
                self.i += 1
                return A.Cast(A.Literal(self.string(), T.TEXT), T.DATE)
            if text == "cast" and after[1] == "(":
                self.i += 2
                inner = self.expression()
                self.expect("as")
                kind_ = self.datatype()
                self.expect(")")
                return A.Cast(inner, kind_)
            if after[:2] == ("op", "(") and text not in RESERVED:
                self.i += 2
                if text == "count" and self.take("*"):
                    self.expect(")")
                    return A.Call("count", ())
                args = []
                if not self.take(")"):
                    args.append(self.expression())
                    while self.take(","):
                        args.append(self.expression())
                    self.expect(")")
                return A.Call(text, tuple(args))
        name = self.identifier()
        if self.peek(".") and self.tokens[self.i + 1][0] in ("word", "quoted"):
            self.i += 1
            return A.Name(name, self.identifier())
        return A.Name(None, name)

    def datatype(self) -> T.SqlType:
        kind, text, _ = self.tokens[self.i]
        self.i += 1
        if kind == "word" and text == "decimal":
            p, s = 28, 0
            if self.take("("):
                p = self.integer()
                s = self.integer() if self.take(",") else 0
                self.expect(")")
            return T.decimal(p, s)
        if kind == "word" and text in T.SPELLINGS:
            return T.SqlType(T.SPELLINGS[text])
        self.i -= 1
        self.fail("a type")

    # Queries

    def select(self):
        branches = [self.select_one()]
        while self.take("union", "all"):
            branches.append(self.select_one())
        return branches[0] if len(branches) == 1 else A.Union(branches)

    def select_one(self) -> A.Select:
        self.expect("select")
        s = A.Select([])
        if not (self.tokens[self.i][0] == "end" or any(self.peek(w) for w in ("from", "where", "group", "order", "limit", "union", ")", ";"))):
            s.items.append(self.item())
            while self.take(","):
                s.items.append(self.item())
        if self.take("from"):
            s.source = self.join_chain()
            while self.take(","):
                s.source = A.JoinRef(s.source, self.join_chain(), "inner", A.Literal(True, T.BOOL))
        if self.take("where"):
            s.where = self.expression()
        if self.take("group", "by"):
            s.group = [self.expression()]
            while self.take(","):
                s.group.append(self.expression())
        if self.take("order", "by"):
            s.order = [self.sort_key()]
            while self.take(","):
                s.order.append(self.sort_key())
        if self.take("limit"):
            s.limit = self.limit()
        return s

    def limit(self) -> tuple[int, int]:
        first = self.integer()
        if self.take(","):
            return first, self.integer()
        return (self.integer(), first) if self.take("offset") else (0, first)

    def sort_key(self):
        key = self.expression()
        return key, not self.take("desc") if not self.take("asc") else True

    def item(self):
        if self.take("*"):
            return A.Star(), None
        t = self.tokens
        if t[self.i][0] in ("word", "quoted") and t[self.i + 1][:2] == ("op", ".") and t[self.i + 2][:2] == ("op", "*"):
            self.i += 3
            return A.Star(t[self.i - 3][1]), None
        return self.expression(), self.alias()

    def join_chain(self):
        left = self.join_item()
        while True:
            if self.take("inner", "join") or self.take("join"):
                kind = "inner"
            elif self.take("left", "outer", "join") or self.take("left", "join"):
                kind = "left"
            else:
                return left
            right = self.join_item()
            self.expect("on")
            left = A.JoinRef(left, right, kind, self.expression())

    def join_item(self):
        if self.peek("directory") and self.tokens[self.i + 1][0] == "string":
            self.i += 1
            d = A.Directory(self.string())
            if self.take("with"):
                self.expect("(")
                self.expect("delimiter", "=")
                text = self.string()
                if not text:
                    self.fail("a delimiter")
                d.delimiter = text[0]
                self.expect(")")
            d.alias = self.alias()
            return d
        if self.take("("):
            inner = self.select()
            self.expect(")")
            return A.Subquery(inner, self.alias())
        database, name = self.table_name()
        return A.TableRef(database, name, self.alias())

    def table_name(self) -> tuple[str | None, str]:
        name = self.identifier()
        return (name, self.identifier()) if self.take(".") else (None, name)

    # Statements

    def statement(self) -> A.Statement:
        s = self.statement_inner()
        self.end()
        return s

    def statement_inner(self) -> A.Statement:
        S = A.Statement
        if self.peek("select"):
            return S("select", {"query": self.select()})
        if self.take("explain"):
            return S("explain", {"of": self.statement_inner()})
        if self.take("insert", "into"):
            table = self.table_name()
            if self.take("values") or self.take("value"):
                return S("insert_values", {"table": table, "rows": self.value_rows()})
            return S("insert", {"table": table, "query": self.select()})
        if self.take("delete", "from"):
            table = self.table_name()
            where = self.expression() if self.take("where") else None
            return S("delete", {"table": table, "where": where, "limit": self.limit() if self.take("limit") else None})
        if self.take("create", "database"):
            return S("create_database", {"name": self.identifier()})
        if self.take("create", "table"):
            table = self.table_name()
            self.expect("(")
            columns = [(self.identifier(), self.datatype())]
            while self.take(","):
                columns.append((self.identifier(), self.datatype()))
            self.expect(")")
            return S("create_table", {"table": table, "columns": columns})
        if self.take("create", "view"):
            table = self.table_name()
            self.expect("as")
            at = self.tokens[self.i][2]
            query = self.select()
            return S("create_view", {"table": table, "query": query, "sql": self.sql[at : self.tokens[self.i][2]].strip()})
        if self.take("drop", "database"):
            return S("drop_database", {"name": self.identifier()})
        if self.take("drop", "table"):
            return S("drop_table", {"table": self.table_name()})
        if self.take("use"):
            return S("use", {"name": self.identifier()})
        for what in ("functions", "databases", "tables"):
            if self.take("show", what):
                return S(f"show_{what}", {})
        if self.take("compact", "table"):
            return S("compact", {"table": self.table_name()})
        self.fail("a statement")

    def value_rows(self) -> list[list[A.Literal]]:
        rows = []
        while True:
            self.expect("(")
            row = []
            if not self.take(")"):
                while True:
                    row.append(self.literal())
                    if not self.take(","):
                        break
                self.expect(")")
            rows.append(row)
            if not self.take(","):
                return rows

    def literal(self):
        value = self.primary()
        if isinstance(value, A.Literal) or (isinstance(value, A.Cast) and isinstance(value.expr, A.Literal) and value.type == T.DATE):
            return value
        self.fail("a literal")


def parse(sql: str) -> A.Statement:
    return Parser(sql).statement()
