"""Small graphs for tests: modern, crew, loop and shapes."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..graph import Graph


def modern(spark: SparkSession) -> Graph:
    """Six vertices, six edges: people who know each other and the software that they created."""
    person = spark.createDataFrame([(1, "marko", 29), (2, "vadas", 27), (4, "josh", 32), (6, "peter", 35)], "id long, `@name` string, `@age` int")
    software = spark.createDataFrame([(3, "lop", "java"), (5, "ripple", "java")], "id long, `@name` string, `@lang` string")
    knows = spark.createDataFrame([(7, 1, 2, 0.5), (8, 1, 4, 1.0)], "id long, src long, dst long, `@weight` double")
    created = spark.createDataFrame([(9, 1, 3, 0.4), (10, 4, 5, 1.0), (11, 4, 3, 0.4), (12, 6, 3, 0.2)], "id long, src long, dst long, `@weight` double")
    ends = {"knows": ({"person"}, {"person"}), "created": ({"person"}, {"software"})}
    return Graph(spark, {"person": person, "software": software}, {"knows": knows, "created": created}, ends, name="modern")


def crew(spark: SparkSession) -> Graph:
    """People with several locations each, with meta-properties."""
    at = "array<struct<value: string, meta: map<string, int>>>"
    people = [
        (1, "marko", [("san diego", {"startTime": 1997, "endTime": 2001}), ("santa cruz", {"startTime": 2001, "endTime": 2004}), ("santa fe", {"startTime": 2005})]),
        (7, "stephen", [("centreville", {"startTime": 1990, "endTime": 2000}), ("purcellville", {"startTime": 2006})]),
        (8, "matthias", [("bremen", {"startTime": 2004, "endTime": 2007}), ("seattle", {"startTime": 2014})]),
        (9, "daniel", []),
    ]
    person = spark.createDataFrame(people, f"id long, `@name` string, `@location` {at}")
    software = spark.createDataFrame([(10, "gremlin"), (11, "tinkergraph")], "id long, `@name` string")
    develops = spark.createDataFrame([(13, 1, 10, 2009), (14, 1, 11, 2010), (17, 7, 10, 2010), (18, 7, 11, 2011), (21, 8, 10, 2012)], "id long, src long, dst long, `@since` int")
    uses = spark.createDataFrame([(15, 1, 10, 4), (16, 1, 11, 5), (19, 7, 10, 5), (20, 7, 11, 4), (22, 8, 10, 3), (24, 9, 10, 5)], "id long, src long, dst long, `@skill` int")
    ends = {"develops": ({"person"}, {"software"}), "uses": ({"person"}, {"software"})}
    return Graph(spark, {"person": person, "software": software}, {"develops": develops, "uses": uses}, ends, {"location"}, "crew")


def shape(spark: SparkSession, pairs: list[tuple[int, int]], more: list[int] | None = None) -> Graph:
    """Vertices n named by their numbers, edges `e` between pairs."""
    ids = sorted({x for p in pairs for x in p} | set(more or []))
    v = spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, `@name` string")
    e = spark.createDataFrame([(100 + i, a, b, 1.0) for i, (a, b) in enumerate(pairs)], "id long, src long, dst long, `@weight` double")
    return Graph(spark, {"n": v}, {"e": e}, {"e": ({"n"}, {"n"})}, name="shape")
