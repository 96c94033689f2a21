"""GraphSON adjacency lists: one vertex a line, its edges out inside.  Reads typed v2/v3 and untyped values, writes typed v3."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, at, buckets, filed, united

#: Spark types and their names in GraphSON.
NAMES = {"tinyint": "gx:Byte", "smallint": "gx:Int16", "int": "g:Int32", "bigint": "g:Int64", "float": "g:Float", "double": "g:Double", "timestamp": "g:Date"}
SPARK = {v: k for k, v in NAMES.items()} | {"g:UUID": "string", "g:Timestamp": "timestamp", "gx:BigDecimal": "double", "gx:BigInteger": "decimal(38,0)"}


def _plain(x: Any) -> Any:
    """A value without its type tags."""
    if isinstance(x, dict) and "@value" in x:
        return _plain(x["@value"])
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return x


def _kind(x: Any) -> str:
    if isinstance(x, dict) and "@type" in x:
        return SPARK.get(x["@type"], "string")
    return "boolean" if isinstance(x, bool) else "bigint" if isinstance(x, int) else "double" if isinstance(x, float) else "string"


def _text(x: Any) -> str | None:
    v = _plain(x)
    return None if v is None else v if isinstance(v, str) else json.dumps(v)


def _parsed(batches):
    """A line to rows (what, label, id, src, dst, properties as key -> list of (kind, text))."""
    import pandas as pd

    for pdf in batches:
        rows = []
        for line in pdf["value"]:
            if not line.strip():
                continue
            v = json.loads(line)
            vid = _plain(v["id"])
            props = {k: [(_kind(p["value"]), _text(p["value"]), {m: _text(x) for m, x in (p.get("properties") or {}).items()}) for p in many] for k, many in (v.get("properties") or {}).items()}
            label = v.get("label", "vertex")
            label = "::".join(sorted(label)) if isinstance(label, list) else label
            rows.append(("v", label, str(vid), None, None, json.dumps(props)))
            for name, many in (v.get("outE") or {}).items():
                for e in many:
                    p = {k: [(_kind(x), _text(x), {})] for k, x in (e.get("properties") or {}).items()}
                    rows.append(("e", name, str(_plain(e["id"])), str(vid), str(_plain(e["inV"])), json.dumps(p)))
        yield pd.DataFrame(rows, columns=["what", "label", "id", "src", "dst", "props"])


def read(spark: SparkSession, path: str) -> Graph:
    rows = filed(spark.read.text(path).mapInPandas(_parsed, "what string, label string, id string, src string, dst string, props string"))
    raw = rows.withColumn("p", F.from_json("props", "map<string, array<array<string>>>"))
    seen = raw.select("what", "label", F.explode("p").alias("key", "cells")).select("what", "label", "key", F.size("cells").alias("n"), F.explode("cells").alias("c"))
    found = seen.groupBy("what", "label", "key").agg(F.max("n").alias("n"), F.collect_set(F.col("c")[0]).alias("kinds"), F.max(F.length(F.col("c")[2]) > 2).alias("meta")).collect()  # a row for each label and key
    numeric = rows.where("what = 'v' and not id rlike '^-?[0-9]{1,18}$'").isEmpty()
    multi = {r.key for r in found if r.what == "v" and (r.n > 1 or r.meta)}

    def ident(c: str) -> Column:
        return F.col(c).cast("long") if numeric else F.xxhash64(c)

    def frame(what: str, label: str) -> DataFrame:
        own = raw.where((F.col("what") == what) & (F.col("label") == label))
        cols = [ident("id").alias("id")] if what == "v" else [(F.col("id").cast("long") if numeric else F.xxhash64("id")).alias("id"), ident("src").alias("src"), ident("dst").alias("dst")]
        if what == "v" and not numeric:
            cols.append(F.col("id").alias("uid"))
        for r in found:
            if r.what != what or r.label != label:
                continue
            kind = r.kinds[0] if len(r.kinds) == 1 else "string"
            cells = F.try_element_at("p", F.lit(r.key))
            if r.key in multi and what == "v":
                value = F.transform(F.coalesce(cells, F.array().cast("array<array<string>>")), lambda c: F.struct(_cast(c[1], kind).alias("value"), F.from_json(c[2], "map<string,string>").alias("meta")))  # noqa: B023
            else:
                value = _cast(F.try_element_at(cells, F.lit(1))[1], kind)
            cols.append(value.alias(at(r.key)))
        return own.select(*cols)

    labels = rows.select("what", "label").distinct().collect()
    return Graph(spark, {r.label: frame("v", r.label) for r in labels if r.what == "v"}, {r.label: frame("e", r.label) for r in labels if r.what == "e"}, multi=multi)


def _cast(c: Column, kind: str) -> Column:
    return F.timestamp_millis(c.cast("long")) if kind == "timestamp" else c.cast(kind)


def typed(c: Column, kind: str) -> Column:
    """A value as JSON text, tagged where its type isn't JSON's own."""
    if kind in NAMES:
        shown = F.unix_millis(c).cast("string") if kind == "timestamp" else c.cast("string")
        return F.concat(F.lit('{"@type":"' + NAMES[kind] + '","@value":'), shown, F.lit("}"))
    if kind == "boolean":
        return c.cast("string")
    return F.regexp_replace(F.to_json(F.struct(c.cast("string").alias("x"))), r"(?s)^\{\"x\":(.*)\}$", "$1")


def lines(graph: Graph) -> DataFrame:
    """A JSON line for each vertex."""
    long = "bigint"

    def props(df: DataFrame, vertex: bool) -> Column:
        cells = []
        for c, kind in df.dtypes:
            if not c.startswith("@"):
                continue
            col, name = F.col(f"`{c}`"), json.dumps(c[1:])
            if vertex and c[1:] in graph.multi:
                inner = kind.split("value:")[1].split(",")[0]
                each = F.transform(col, lambda x: F.concat(F.lit('{"value":'), typed(x["value"], inner), F.lit(',"properties":'), F.coalesce(F.to_json(x["meta"]), F.lit("{}")), F.lit("}")))  # noqa: B023
                cells.append(F.when(F.size(col) > 0, F.concat(F.lit(f"{name}:["), F.array_join(each, ","), F.lit("]"))))
            elif vertex:
                cells.append(F.when(col.isNotNull(), F.concat(F.lit(f'{name}:[{{"value":'), typed(col, kind), F.lit("}]"))))
            else:
                cells.append(F.when(col.isNotNull(), F.concat(F.lit(f"{name}:"), typed(col, kind))))
        return F.concat(F.lit("{"), F.concat_ws(",", *cells) if cells else F.lit(""), F.lit("}"))

    if not graph.vertices:
        return graph.nothing("value string")

    def grouped(label: str) -> DataFrame:
        """(src, part): edges travel as columns, and become text where their vertex is."""
        df = graph.edges[label].repartition(buckets(graph.spark), "src")
        text = F.concat(F.lit('{"id":'), typed(F.col("id"), long), F.lit(',"inV":'), typed(F.col("dst"), long), F.lit(',"properties":'), props(df, False), F.lit("}"))
        return df.select("src", text.alias("text")).groupBy("src").agg(F.concat(F.lit(f"{json.dumps(label)}:["), F.array_join(F.sort_array(F.collect_list("text")), ","), F.lit("]")).alias("part"))

    def head(label: str, df: DataFrame) -> Column:
        names = label.split("::")
        shown = json.dumps(names[0] if len(names) == 1 else names)
        return F.concat(F.lit('{"id":'), typed(F.col("id"), long), F.lit(f',"label":{shown},"properties":'), props(df, True))

    def joined(df: DataFrame, start: Column, labels: list[str]) -> DataFrame:
        parts = []
        for i, label in enumerate(sorted(labels, key=json.dumps)):
            df = df.join(grouped(label).toDF(f"_s{i}", f"_p{i}"), F.col("id") == F.col(f"_s{i}"), "left")
            parts.append(F.col(f"_p{i}"))
        out = F.concat_ws(",", *parts) if parts else F.lit("")
        return df.select(F.concat(start, F.when(out != "", F.concat(F.lit(',"outE":{'), out, F.lit("}"))).otherwise(""), F.lit("}")).alias("value"))

    if all(label in graph.ends for label in graph.edges):  # each vertex table meets only the edges that start in it
        return united([joined(df, head(label, df), [k for k in graph.edges if label in graph.ends[k][0]]) for label, df in graph.vertices.items()])
    every = united([df.select("id", head(label, df).alias("head")) for label, df in graph.vertices.items()])
    return joined(every, F.col("head"), list(graph.edges))


def write(graph: Graph, path: str) -> None:
    lines(graph).write.mode("overwrite").text(path, compression="gzip")
