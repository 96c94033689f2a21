"""Steps on single values and on lists, as columns of columns."""

from __future__ import annotations

import string
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.steps import Token, UnsupportedTraversal
from .predicates import literal, no, test

#: Fixed value: the white space that trim() removes.
SPACE = " \t\n\x0b\x0c\r"


def _substring(c: Column, start: int, end: int | None = None) -> Column:
    size = F.length(c)
    at = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
    to = size if end is None else F.lit(end) if end >= 0 else size + end
    return F.substr(c, at + 1, F.greatest(F.least(to, size) - at, F.lit(0)))


def _split(c: Column, sep: str | None = None) -> Column:
    if sep is None:
        return F.filter(F.split(c, r"\s+"), lambda x: x != "")
    if sep == "":
        return F.filter(F.split(c, ""), lambda x: x != "")
    return F.split(c, r"\Q" + sep + r"\E")


def _bool(c: Column, kind: str) -> Column:
    if kind == "string":
        low = F.lower(F.trim(c))
        return F.when(low == "true", True).when(low == "false", False).when(c.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("Can't parse "), c, F.lit(" as Boolean.")))).cast("boolean")
    return c.cast("boolean")


def _date(c: Column, kind: str) -> Column:
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return F.timestamp_millis(c.cast("bigint"))
    if kind in ("float", "double"):
        raise UnsupportedTraversal("asDate() of a floating point number")
    return c.cast("timestamp")


#: The Spark types that asNumber() can be told.
NUMBERS = {"BYTE": "tinyint", "SHORT": "smallint", "INT": "int", "INTEGER": "int", "LONG": "bigint", "FLOAT": "float", "DOUBLE": "double", "BIGINT": "decimal(38,0)", "BIGINTEGER": "decimal(38,0)", "BIGDECIMAL": "decimal(38,18)"}


def _number(c: Column, kind: str, to: Token | None = None) -> Column:
    if to is not None:
        return c.cast(NUMBERS[to.name])
    return c.cast("double") if kind == "string" else c


def _ascii(c: Column, upper: bool) -> Column:
    a, b = string.ascii_lowercase, string.ascii_uppercase
    return F.translate(c, a, b) if upper else F.translate(c, b, a)


#: name -> (column, its Spark type, arguments) -> column
VALUE: dict[str, Callable[..., Column]] = {
    "length": lambda c, k: F.length(c),
    "toUpper": lambda c, k: _ascii(c, True),
    "toLower": lambda c, k: _ascii(c, False),
    "trim": lambda c, k: F.trim(c, F.lit(SPACE)),
    "lTrim": lambda c, k: F.ltrim(c, F.lit(SPACE)),
    "rTrim": lambda c, k: F.rtrim(c, F.lit(SPACE)),
    "replace": lambda c, k, a, b: c if a is None or b is None else F.replace(c, F.lit(a), F.lit(b)),
    "substring": lambda c, k, *a: _substring(c, *a),
    "split": lambda c, k, sep=None: _split(c, sep),
    "asString": lambda c, k: c.cast("string"),
    "asNumber": _number,
    "asBool": _bool,
    "asDate": _date,
    "dateAdd": lambda c, k, unit, n: c + F.make_dt_interval(**{{"day": "days", "hour": "hours", "minute": "mins", "second": "secs"}[unit.name]: F.lit(n)}),
    "dateDiff": lambda c, k, other: (F.unix_millis(c.cast("timestamp")) - F.unix_millis(F.lit(other).cast("timestamp"))),
    "reverse": lambda c, k: F.reverse(c),
}


def concat(c: Column, parts: list[Column]) -> Column:
    """Parts joined, nulls left out; null if all are."""
    every = [c.cast("string"), *(p.cast("string") for p in parts)]
    some = every[0].isNotNull()
    for p in every[1:]:
        some = some | p.isNotNull()
    return F.when(some, F.concat_ws("", *every))


def _slice(c: Column, low: int, high: int) -> Column:
    return F.slice(c, low + 1, F.greatest(F.size(c) - low if high < 0 else F.lit(max(high - low, 0)), F.lit(0)))


def _tail(c: Column, n: int) -> Column:
    return F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), F.lit(n))


def _sum(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")))


#: Steps on a list with Scope.local: name -> (column, its element type, arguments) -> column
LOCAL: dict[str, Callable[..., Column]] = {
    "count": lambda c, k: F.size(c).cast("bigint"),
    "sum": lambda c, k: _sum(c).cast(k if k in ("bigint", "double") else "bigint" if k in ("int", "smallint", "tinyint") else "double"),
    "mean": lambda c, k: _sum(c) / F.size(c),
    "min": lambda c, k: F.array_min(c),
    "max": lambda c, k: F.array_max(c),
    "dedup": lambda c, k: F.array_distinct(c),
    "limit": lambda c, k, n: _slice(c, 0, n),
    "skip": lambda c, k, n: _slice(c, n, -1),
    "range": lambda c, k, a, b: _slice(c, a, b),
    "tail": lambda c, k, n=1: _tail(c, n),
    "order": lambda c, k, desc=False: F.sort_array(c, not desc),
}

#: Steps on a list with another list.
LISTS: dict[str, Callable[[Column, Column], Column]] = {
    "combine": lambda a, b: F.concat(a, b),
    "intersect": F.array_intersect,
    "difference": F.array_except,
    "disjunct": lambda a, b: F.array_union(F.array_except(a, b), F.array_except(b, a)),
    "merge": F.array_union,
    "product": lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array(x, y)))),
}


def quantified(name: str, c: Column, p: Any, kind: str) -> Column:
    """all, any and none of a list's members pass p."""
    if name == "all":
        return F.forall(c, lambda x: test(x, p, kind))
    some = F.exists(c, lambda x: test(x, p, kind))
    return some if name == "any" else no(some)


def conjoin(c: Column, sep: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


__all__ = ["LISTS", "LOCAL", "VALUE", "concat", "conjoin", "literal", "quantified"]
