"""Graphs as two CSV files, of vertices and of edges, with `~id ~label ~from ~to` or `:ID :LABEL :START_ID :END_ID :TYPE` headers.

An unquoted empty cell is absent, a quoted one is the empty string.  `read(spark, "x.csv")` reads x-vertices.csv and x-edges.csv.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, at, filed

#: The types of headers and their Spark types.
TYPES = {"string": "string", "str": "string", "bool": "boolean", "boolean": "boolean", "byte": "tinyint", "short": "smallint", "int": "int", "integer": "int", "long": "bigint", "float": "float", "double": "double", "date": "timestamp", "datetime": "timestamp"}
SYSTEM = {"~id": "id", ":ID": "id", "~label": "label", ":LABEL": "label", ":TYPE": "label", "~from": "src", ":START_ID": "src", "~to": "dst", ":END_ID": "dst"}
HEADERS = {v: k for k, v in TYPES.items() if k in ("string", "boolean", "byte", "short", "int", "long", "float", "double", "datetime")}


class CsvError(ValueError):
    """A graph or a file that the format can't hold."""


def names(path: str) -> tuple[str, str]:
    base = path[:-4] if path.endswith(".csv") else path
    return f"{base}-vertices.csv", f"{base}-edges.csv"


def _role(header: str) -> tuple[str | None, str, str, bool]:
    """(system column or None, key, Spark type, whether an array)."""
    plain = re.sub(r"\(.*\)$", "", header)
    if plain in SYSTEM:
        return SYSTEM[plain], plain, "string", False
    m = re.fullmatch(r"(.+?):(ID|LABEL|TYPE|START_ID|END_ID)", plain)
    if m:
        return SYSTEM[f":{m[2]}"], m[1], "string", False
    key, _, kind = header.partition(":")
    many = kind.endswith("[]")
    kind = kind.removesuffix("[]").split("(")[0].lower() or "string"
    if kind not in TYPES:
        raise CsvError(f"unknown type in header {header!r}")
    return None, key, TYPES[kind], many


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple]]:
    # an absent cell is null, a quoted empty one is the empty text
    raw = spark.read.csv(path, header=True, nullValue=None, emptyValue="", multiLine=True, escape='"', enforceSchema=False)
    return raw, [_role(c) for c in raw.columns]


def _column(raw: str, kind: str, many: bool) -> Column:
    c = F.col("`" + raw.replace("`", "``") + "`")
    if many:
        return F.transform(F.split(c, ";"), lambda x: F.struct(x.cast(kind).alias("value"), F.lit(None).cast("map<string,string>").alias("meta")))
    return c.cast(kind)


def read(spark: SparkSession, path: str) -> Graph:
    v_path, e_path = names(path)
    tables: dict[str, dict[str, DataFrame]] = {"v": {}, "e": {}}
    multi: set[str] = set()
    numeric = True
    for what, p in (("v", v_path), ("e", e_path)):
        raw, roles = _read(spark, p)
        system = {r[0]: c for c, r in zip(raw.columns, roles, strict=True) if r[0]}
        props = [(c, r) for c, r in zip(raw.columns, roles, strict=True) if not r[0]]
        if what == "v":
            numeric = raw.where(~F.col(f"`{system['id']}`").rlike(r"^-?\d{1,18}$")).isEmpty()
            multi = {r[1] for _, r in props if r[3]}
        ident = (lambda c: c.cast("long")) if numeric else F.xxhash64
        label = F.coalesce(F.col(f"`{system['label']}`"), F.lit("vertex" if what == "v" else "edge")) if "label" in system else F.lit("vertex")
        cols = [F.array_join(F.sort_array(F.split(label, "[;:]+")), "::").alias("_label")]
        if "id" in system:
            own = F.col(f"`{system['id']}`")
            cols.append((ident(own) if what == "v" or numeric else F.xxhash64(own)).alias("id"))
            if what == "v" and not numeric:
                cols.append(own.alias("uid"))
        else:
            cols.append(F.monotonically_increasing_id().alias("id"))
        if what == "e":
            cols += [ident(F.col(f"`{system[k]}`")).alias(k) for k in ("src", "dst")]
        cols += [_column(c, r[2], r[3]).alias(at(r[1])) for c, r in props]
        every = filed(raw.select(*cols))
        for (name,) in every.select("_label").distinct().collect():  # a row for each label
            tables[what][name] = every.where(F.col("_label") == name).drop("_label")
    return Graph(spark, tables["v"], tables["e"], multi=multi)


def _frame(frames: dict[str, DataFrame], multi: set[str], ends: bool) -> DataFrame:
    from ..graph import united

    out = []
    for label, df in frames.items():
        cols = [F.col("id").alias("~id"), F.lit(label.replace("::", ";")).alias("~label")]
        cols += [F.col("src").alias("~from"), F.col("dst").alias("~to")] if ends else []
        for c, kind in df.dtypes:
            if not c.startswith("@"):
                continue
            if c[1:] in multi:
                inner = kind.split("value:")[1].split(",")[0]
                cols.append(F.array_join(F.transform(F.col(f"`{c}`"), lambda x: x["value"].cast("string")), ";").alias(f"{c[1:]}:{HEADERS.get(inner, 'string')}[]"))
            elif kind.startswith(("array", "map", "struct")):
                raise CsvError(f"CSV can't hold {c[1:]}: {kind}")
            else:
                cols.append(F.col(f"`{c}`").alias(f"{c[1:]}:{HEADERS.get(kind, 'string')}"))
        out.append(df.select(*cols))
    return united(out)


def write(graph: Graph, path: str) -> None:
    for frames, p, ends in ((graph._typed(graph.vertices), names(path)[0], False), (graph._typed(graph.edges), names(path)[1], True)):
        if frames:
            _frame(frames, graph.multi, ends).write.mode("overwrite").csv(p, header=True, nullValue=None, emptyValue='""', escape='"')
