"""JSONPath in the manner of MySQL, over JSON kept as canonical text."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_STEP = re.compile(r"""\s*(?:\.\s*(?P<star>\*)|\[\s*(?P<all>\*)\s*\]|\[\s*(?P<index>-?\d+)\s*\]|\.\s*(?P<dot>\d+)(?![\w])|\[\s*"(?P<quoted>[^"]*)"\s*\]|\.\s*(?P<name>[^\W\d][\w$]*)|\.\s*"(?P<member>[^"]*)")""")


class Members(list):
    """A JSON object as its (key, value) pairs in order, repeated keys and all."""


def loads(text: str):
    return json.loads(text, parse_float=Decimal, parse_int=Decimal, parse_constant=_reject, object_pairs_hook=Members)


def _reject(name):
    raise ValueError(name)


def dumps(value) -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, Members):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dumps(v)}" for k, v in value) + "}"
    return "[" + ",".join(map(dumps, value)) + "]"


@lru_cache(4096)
def compile_path(path: str | None):
    """Steps ("all",) or ("at", text, index or None), or None where the path is not valid."""
    if path is None or not (text := path.strip()).startswith("$"):
        return None
    at, steps = 1, []
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            return None
        found = {k: v for k, v in m.groupdict().items() if v is not None}
        key, value = next(iter(found.items()))
        if key in ("star", "all"):
            steps.append(("all",))
        else:
            steps.append(("at", value, int(value) if re.fullmatch(r"-?\d+", value) else None))
        at = m.end()
    return tuple(steps)


def walk(value, steps):
    if not steps:
        yield value
        return
    step, rest = steps[0], steps[1:]
    if step[0] == "all":
        if isinstance(value, Members):
            for _, v in value:
                yield from walk(v, rest)
        elif isinstance(value, list):
            for v in value:
                yield from walk(v, rest)
    elif isinstance(value, Members):
        for k, v in value:
            if k.lower() == step[1].lower():
                yield from walk(v, rest)
                return
    elif isinstance(value, list) and step[2] is not None and 0 <= step[2] < len(value):
        yield from walk(value[step[2]], rest)


def extract(text: str | None, path: str | None) -> str | None:
    steps = compile_path(path)
    if text is None or steps is None:
        return None
    try:
        found = list(walk(loads(text), steps))
    except (ValueError, RecursionError):
        return None
    if ("all",) in steps:
        return dumps(found)
    return dumps(found[0]) if found else None


def unquote(text: str | None) -> str | None:
    return json.loads(text) if text is not None and text.startswith('"') else text


def canonical(text: str | None) -> str | None:
    try:
        return None if text is None else dumps(loads(text))
    except (ValueError, RecursionError):
        return None


def _extract_all(doc: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([extract(d, p) for d, p in zip(doc, path, strict=True)], dtype=object)


def _extract_unquote_all(doc: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([unquote(extract(d, p)) for d, p in zip(doc, path, strict=True)], dtype=object)


def _unquote_all(doc: pd.Series) -> pd.Series:
    return pd.Series([unquote(d) for d in doc], dtype=object)


def _canonical_all(doc: pd.Series) -> pd.Series:
    return pd.Series([canonical(d) for d in doc], dtype=object)


def json_extract(doc: Column, path: Column) -> Column:
    return F.pandas_udf(_extract_all, StringType())(doc, path)


def json_extract_unquote(doc: Column, path: Column) -> Column:
    return F.pandas_udf(_extract_unquote_all, StringType())(doc, path)


def json_unquote(doc: Column) -> Column:
    return F.pandas_udf(_unquote_all, StringType())(doc)


def json_canonical(doc: Column) -> Column:
    return F.pandas_udf(_canonical_all, StringType())(doc)
