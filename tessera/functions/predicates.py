"""Predicates P and TextP as columns."""

from __future__ import annotations

import datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.steps import P, Token, UnsupportedTraversal

#: The Spark types of GType names.
TYPES = {"STRING": {"string"}, "BOOLEAN": {"boolean"}, "BYTE": {"tinyint"}, "SHORT": {"smallint"}, "INT": {"int"}, "INTEGER": {"int"}, "LONG": {"bigint"}, "FLOAT": {"float"}, "DOUBLE": {"double"}, "DATETIME": {"timestamp", "date", "timestamp_ntz"}, "BINARY": {"binary"}}
NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def literal(x: Any) -> Column:
    if isinstance(x, Token):
        return F.lit(x.name)
    if isinstance(x, (list, tuple, set)):
        return F.array(*map(literal, x))
    if isinstance(x, dict):
        return F.create_map(*(c for k, v in x.items() for c in (literal(k), literal(v))))
    return F.lit(x)


def comparable(kind: str, x: Any) -> bool:
    """Whether a value of a Spark type can be compared with a literal; if not, equality is false and so is any order."""
    if isinstance(x, Column) or x is None:
        return True
    if isinstance(x, bool):
        return kind == "boolean"
    if isinstance(x, (int, float, Decimal)):
        return kind in NUMBERS or kind.startswith("decimal")
    if isinstance(x, str):
        return kind == "string"
    if isinstance(x, datetime.datetime):
        return kind in ("timestamp", "date", "timestamp_ntz")
    return True


def no(c: Column) -> Column:
    """The opposite of a test."""
    return ~F.coalesce(c, F.lit(False))


def test(c: Column, p: Any, kind: str) -> Column:
    """Whether c, of Spark type `kind`, passes p: a predicate, or a literal to equal.

    Null stands for no, so that a plain comparison can be pushed to the scan; negate with no().
    """
    never = F.lit(False)
    if not isinstance(p, P):
        p = P("eq", (p,))
    op, args = p.op, p.args
    if op == "not":
        return no(test(c, args[0], kind))
    if op in ("and", "or"):
        a, b = (test(c, x, kind) for x in args)
        return a & b if op == "and" else a | b
    if op in ("within", "without"):
        found = never
        plain = [x for x in args if x is not None and comparable(kind, x)]
        if plain:
            found = c.isin(plain)
        if None in args:
            found = found | c.isNull()
        return found if op == "within" else no(found)
    if op == "typeOf":
        name = args[0].name if isinstance(args[0], Token) else str(args[0]).upper()
        if name == "NUMBER":
            return F.lit(kind in NUMBERS or kind.startswith("decimal")) & c.isNotNull()
        if name in ("BIGDECIMAL", "BIGINT", "BIGINTEGER"):
            return F.lit(kind.startswith("decimal")) & c.isNotNull()
        if name in ("LIST", "SET"):
            return F.lit(kind.startswith("array")) & c.isNotNull()
        if name == "MAP":
            return F.lit(kind.startswith(("map", "struct"))) & c.isNotNull()
        if name == "NULL":
            return c.isNull()
        if name not in TYPES:
            raise UnsupportedTraversal(f"typeOf({name})")
        return F.lit(kind in TYPES[name]) & c.isNotNull()
    x = args[0] if args else None
    if op in ("eq", "neq"):
        same = never if not comparable(kind, x) else c.eqNullSafe(literal(x) if not isinstance(x, Column) else x)
        return same if op == "eq" else ~same
    if any(not comparable(kind, y) for y in args):
        return never
    col = [y if isinstance(y, Column) else literal(y) for y in args]
    text = {
        "startingWith": lambda: c.startswith(col[0]),
        "endingWith": lambda: c.endswith(col[0]),
        "containing": lambda: c.contains(col[0]),
        "regex": lambda: c.rlike(args[0]),
    }
    if op[:3] == "not" and op[3].lower() + op[4:] in text:
        return ~text[op[3].lower() + op[4:]]()
    made = {
        "lt": lambda: c < col[0],
        "lte": lambda: c <= col[0],
        "gt": lambda: c > col[0],
        "gte": lambda: c >= col[0],
        "between": lambda: (c >= col[0]) & (c < col[1]),
        "inside": lambda: (c > col[0]) & (c < col[1]),
        "outside": lambda: (c < col[0]) | (c > col[1]),
    } | text
    if op not in made:
        raise UnsupportedTraversal(f"predicate {op}")
    return made[op]()
