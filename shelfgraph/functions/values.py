"""Property values: coercion of JSON to typed values, and predicates with two truth values on them.

A value in a plan is a ``Value``: Columns for its number, string, truth value and list, as far as its type allows each, and whether it is null.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfgraph.schema import BOOL, FLOAT, INT, LIST, STR, GraphError

#: Properties whose strings stay strings.
STRING_ONLY = ("price",)
_PLAIN = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?")
#: Constructs of the regex dialect of Java that the query language does not have.
_FOREIGN = re.compile(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k<|[*+?}]\+")


def scalar(prop: str, v: Any) -> tuple | None:
    """(t, b, i, d, s, l) of a JSON value, None for null and objects. Strings that are plain decimals become numbers, but for STRING_ONLY."""
    if isinstance(v, bool):
        return (BOOL, v, None, None, None, None)
    if isinstance(v, int):
        return (INT, None, v, float(v), None, None) if -(2**63) <= v < 2**63 else (FLOAT, None, None, float(v), None, None)
    if isinstance(v, float):
        return (FLOAT, None, None, v, None, None)
    if isinstance(v, str):
        if prop not in STRING_ONLY and _PLAIN.fullmatch(v):
            if "." not in v and -(2**63) <= int(v) < 2**63:
                return (INT, None, int(v), float(v), None, None)
            return (FLOAT, None, None, float(v), None, None)
        return (STR, None, None, None, v, None)
    if isinstance(v, list):
        return (LIST, None, None, None, None, [_text(scalar(prop, x)) for x in v])
    return None


def _text(x: tuple | None) -> str | None:
    if x is None:
        return None
    t, b, i, d, s, items = x
    if t == LIST:
        return json.dumps(items, ensure_ascii=False)
    return str(b).lower() if t == BOOL else str(i) if t == INT else repr(d) if t == FLOAT else s


def typed_props(props_json: str | None) -> dict[str, tuple]:
    """The typed properties of a node's JSON; none if it is not an object."""
    try:
        v = json.loads(props_json) if props_json else None
    except ValueError:
        return {}
    if not isinstance(v, dict):
        return {}
    found = {k: scalar(k, x) for k, x in v.items()}
    return {k: x for k, x in found.items() if x is not None}




@dataclass
class Value:
    null: Column
    num: Column | None = None
    str: Column | None = None
    bool: Column | None = None
    list: Column | None = None
    int: Column | None = None  # the exact integer, where it is one
    tag: Column | None = None  # for values of mixed type


def literal(v: Any) -> Value:
    no = F.lit(False)
    if isinstance(v, bool):
        return Value(no, bool=F.lit(v))
    if isinstance(v, (int, float)):
        return Value(no, num=F.lit(float(v)), int=F.lit(v) if isinstance(v, int) else None)
    return Value(no, str=F.lit(v))


def of_column(c: Column, kind: T.DataType) -> Value:
    if isinstance(kind, T.BooleanType):
        return Value(c.isNull(), bool=c)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Value(c.isNull(), num=c.cast("double"), int=c.cast("long"))
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Value(c.isNull(), num=c.cast("double"))
    if isinstance(kind, T.ArrayType):
        return Value(c.isNull(), list=c)
    return Value(c.isNull(), str=c.cast("string"))


def of_map(props: Column, prop: str) -> Value:
    v = props[prop]
    return Value(v["t"].isNull(), num=v["d"], str=v["s"], bool=v["b"], list=v["l"], int=v["i"], tag=v["t"])




def null_value() -> Value:
    return Value(F.lit(True))


def _either(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _typed(op: str, a: Value, b: Value) -> list[Column]:
    fn = {"=": lambda x, y: x == y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    return [fn(x, y) for x, y in ((a.num, b.num), (a.str, b.str), (a.bool, b.bool)) if x is not None and y is not None]


def compare(op: str, a: Value, b: Value) -> Column | None:
    """A comparison, null or true or false where it is not true (wrap it with ``total``); None where the types allow nothing."""
    if op == "<>":
        same = _typed("=", a, b)
        there = ~a.null & ~b.null
        return there & ~F.coalesce(_either([F.coalesce(s, F.lit(False)) for s in same]), F.lit(False)) if same else there
    parts = _typed(op, a, b)
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else _either([F.coalesce(p, F.lit(False)) for p in parts])


def total(c: Column | None) -> Column:
    return F.lit(False) if c is None else F.coalesce(c, F.lit(False))


def truthy(v: Value) -> Column:
    """Null is false, a truth value is itself, anything else is true."""
    return total(~v.null & F.coalesce(v.bool, F.lit(True))) if v.bool is not None else ~v.null


def text_match(op: str, v: Value, needle: str) -> Column | None:
    """starts, ends, contains and fuzzy, without regard to case; only strings match."""
    if v.str is None:
        return None
    low, needle = F.lower(v.str), needle.lower()
    if op == "starts":
        return low.startswith(needle)
    if op == "ends":
        return low.endswith(needle)
    if op == "contains" or len(needle) < 2:
        return low.contains(needle)
    return _either([low.contains(g) for g in sorted({needle[i : i + 2] for i in range(len(needle) - 1)})])


def regex_match(v: Value, pattern: str) -> Column | None:
    """An unanchored search with Unicode classes and case; ``$`` is the text's end."""
    java = translate_regex(pattern)
    return None if v.str is None else v.str.rlike(java)


def translate_regex(pattern: str) -> str:
    if m := _FOREIGN.search(re.sub(r"\\\\", "", pattern)):
        raise GraphError(f"invalid regex in =~ : {m[0]} is not supported")
    try:
        re.compile(re.sub(r"\\[pP](\{\^?\w+\}|\w)|\\z|\[\[:\w+:\]\]", "x", pattern))
    except re.error as e:
        raise GraphError(f"invalid regex in =~ : {e}") from e
    if re.match(r"\(\?[a-zA-Z]*m", pattern):
        return "(?dU)" + pattern
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        in_class = (in_class or c == "[") and c != "]"
        out.append(r"\z" if c == "$" and not in_class else c)
        i += 1
    return "(?dU)" + "".join(out)
