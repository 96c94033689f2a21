"""GraphQL queries on a graph: a field for each vertex label, `out_x`, `in_x` and `both_x` for edges; where, sort, limit, offset.

The text becomes a traversal for the rows of the top field; nested fields are gathered as arrays of structs by joins on the id.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.lowering import Lowering
from .steps import P, Step, Token, Traversal, UnsupportedTraversal

LEX = re.compile(r"\s*(?:#[^\n]*\n\s*)*(\"(?:[^\"\\]|\\.)*\"|-?\d+\.?\d*(?:[eE][+-]?\d+)?|[A-Za-z_]\w*|@\w+|[{}()\[\]:,$!])\s*,?")
#: Operators of `where` and their predicates.
OPS = {"eq": "eq", "neq": "neq", "gt": "gt", "lt": "lt", "gte": "gte", "lte": "lte", "in": "within", "contains": "containing", "startsWith": "startingWith", "endsWith": "endingWith"}


class Field:
    def __init__(self, name: str, alias: str, args: dict[str, Any], fields: list[Field]):
        self.name, self.alias, self.args, self.fields = name, alias, args, fields


def parsed(text: str) -> list[Field]:
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = LEX.match(text, at)
        if not m:
            raise UnsupportedTraversal(f"GraphQL: cannot read {text[at : at + 20]!r}")
        tokens.append(m[1])
        at = m.end()
    place = 0

    def peek() -> str:
        return tokens[place] if place < len(tokens) else ""

    def take(wanted: str | None = None) -> str:
        nonlocal place
        if wanted is not None and peek() != wanted or not peek():
            raise UnsupportedTraversal(f"GraphQL: expected {wanted}, found {peek()!r}")
        place += 1
        return tokens[place - 1]

    def value() -> Any:
        t = take()
        if t == "{":
            out = {}
            while peek() != "}":
                k = take()
                take(":")
                out[k] = value()
            take("}")
            return out
        if t == "[":
            items = []
            while peek() != "]":
                items.append(value())
            take("]")
            return items
        if t[0] == '"':
            return t[1:-1].replace('\\"', '"')
        if re.match(r"-?\d", t):
            return float(t) if re.search(r"[.eE]", t) else int(t)
        return {"true": True, "false": False, "null": None}.get(t, t)

    def selection() -> list[Field]:
        take("{")
        out = []
        while peek() != "}":
            name = alias = take()
            if peek() == ":":
                take()
                name = take()
            args = {}
            if peek() == "(":
                take()
                while peek() != ")":
                    k = take()
                    take(":")
                    args[k] = value()
                take(")")
            out.append(Field(name, alias, args, selection() if peek() == "{" else []))
        take("}")
        return out

    if peek() == "query":
        take()
        while peek() != "{":
            take()
    return selection()


def _steps(f: Field) -> list[Step]:
    out = []
    for k, tests in (f.args.get("where") or {}).items():
        for op, x in (tests if isinstance(tests, dict) else {"eq": tests}).items():
            if op not in OPS:
                raise UnsupportedTraversal(f"GraphQL: operator {op}")
            out.append(Step("has", [k, P(OPS[op], tuple(x) if op == "in" else (x,))]))
    sort = f.args.get("sort")
    if sort:
        out.append(Step("order", bys=[[k, Token(str(v).lower())] for k, v in sort.items()]))
    if "offset" in f.args:
        out.append(Step("skip", [f.args["offset"]]))
    if "limit" in f.args:
        out.append(Step("limit", [f.args["limit"]]))
    return out


def query(graph: Graph, text: str) -> DataFrame:
    """A row for each vertex of the top field."""
    fields = parsed(text)
    if len(fields) != 1:
        raise UnsupportedTraversal("GraphQL: one top field")
    top = fields[0]
    if not graph.tables(top.name):
        raise UnsupportedTraversal(f"GraphQL: no label {top.name!r}")
    steps = [Step("V"), Step("hasLabel", [top.name]), *_steps(top)]
    low = Lowering(graph, Traversal(steps), collapse=False)
    s = low.chain(steps, None)
    return _selected(graph, low.attach(s).df, top.fields)[0].drop("__id")


def _selected(graph: Graph, df: DataFrame, fields: list[Field]) -> tuple[DataFrame, list[str]]:
    """(__id, a column for each field) of attached vertices."""
    types, plain, nested = dict(df.dtypes), [], []
    for f in fields:
        if f.fields:
            nested.append(f)
        elif f.name in ("id", "label"):
            plain.append(F.col(f.name).alias(f.alias))
        elif f.name == "__typename":
            plain.append(F.col("label").alias(f.alias))
        else:
            plain.append((F.col(f"`@{f.name}`") if f"@{f.name}" in types else F.lit(None)).alias(f.alias))
    out = df.select(F.col("id").alias("__id"), *plain)
    for f in nested:
        way, _, label = f.name.partition("_")
        if way not in ("out", "in", "both") or label not in graph.edges:
            raise UnsupportedTraversal(f"GraphQL: no edge field {f.name!r}")
        ids = df.select("id").distinct()
        hop = [Step(way, [label]), *_steps(f)]
        low = Lowering(graph, Traversal(hop), collapse=False)
        from ..operators.stream import Stream

        seed = ids.withColumn("k$0", F.col("id"))
        s = low.attach(low.chain(hop, Stream(seed, "vertex", scope=("k$0",), domain=seed.select("k$0"))))
        inner, names = _selected(graph, s.df.drop("k$0").dropDuplicates(["id"]), f.fields)
        pairs = s.df.select("k$0", "id").join(inner, F.col("id") == F.col("__id"))
        items = pairs.groupBy("k$0").agg(F.sort_array(F.collect_list(F.struct(*names))).alias(f.alias))
        kind = items.schema[f.alias].dataType
        out = out.join(items, F.col("__id") == F.col("k$0"), "left").drop("k$0").withColumn(f.alias, F.coalesce(f.alias, F.array().cast(kind)))
    return out.select("__id", *(f.alias for f in fields)), [f.alias for f in fields]
