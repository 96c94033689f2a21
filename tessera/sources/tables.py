"""The relational tables as a property graph: rows are vertices, foreign keys are edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, at

#: Natural keys of the tables overlap, so the id of a vertex is its label's place times STEP plus its key.
STEP = 1_000_000_000_000
LABELS = ("region", "nation", "customer", "supplier", "part", "orders", "user", "event")
#: Known schemas: a graph is made without reading a footer, so a query touches only the files that it needs.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def key(label: str, column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("long") + F.lit((LABELS.index(label) + 1) * STEP)


def _vertices(df: DataFrame, label: str, column: str) -> DataFrame:
    return df.select(key(label, column).alias("id"), *(F.col(c).alias(at(c)) for c in df.columns))


def _edges(df: DataFrame, ident: Column, src: Column, dst: Column, props: list[str]) -> DataFrame:
    return df.select(ident.alias("id"), src.alias("src"), dst.alias("dst"), *(F.col(c).alias(at(c)) for c in props))


def graph(spark: SparkSession, folder: str) -> Graph:
    """All tables of a folder.  Frames are plain scans: what a traversal doesn't read is never read."""
    t = {n: spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}.parquet") for n in (*KEYS, "lineitem", "events")}
    vertices = {n: _vertices(t[n], n, k) for n, k in KEYS.items()}
    vertices["user"] = t["events"].select(key("user", "user_id").alias("id"), F.col("user_id").alias(at("user_id"))).distinct()
    vertices["event"] = _vertices(t["events"], "event", "event_id")
    line = t["lineitem"]
    whole = F.xxhash64(*line.columns)  # lines have no key
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_linenumber"]
    located = t["customer"].select(key("customer", "c_custkey").alias("src"), "c_nationkey").unionAll(t["supplier"].select(key("supplier", "s_suppkey").alias("src"), "s_nationkey"))
    edges = {
        "in_region": _edges(t["nation"], F.col("n_nationkey").cast("long"), key("nation", "n_nationkey"), key("region", "n_regionkey"), []),
        "in_nation": located.select(F.col("src").alias("id"), "src", key("nation", "c_nationkey").alias("dst")),
        "placed": _edges(t["orders"], F.col("o_orderkey"), key("customer", "o_custkey"), key("orders", "o_orderkey"), ["o_orderdate"]),
        "contains": _edges(line, whole, key("orders", "l_orderkey"), key("part", "l_partkey"), cols),
        "fulfilled_by": _edges(line, whole, key("orders", "l_orderkey"), key("supplier", "l_suppkey"), ["l_quantity", "l_extendedprice"]),
        "did": _edges(t["events"], F.col("event_id"), key("user", "user_id"), key("event", "event_id"), ["ts", "value"]),
    }
    ends = {"in_region": ({"nation"}, {"region"}), "in_nation": ({"customer", "supplier"}, {"nation"}), "placed": ({"customer"}, {"orders"}), "contains": ({"orders"}, {"part"}), "fulfilled_by": ({"orders"}, {"supplier"}), "did": ({"user"}, {"event"})}
    return Graph(spark, vertices, edges, ends, name=folder)
