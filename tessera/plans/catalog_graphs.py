"""Registered algorithms, services and writes over whole tables, with SQL.  name -> (function, SQL or None).

Ranks and hubs run over the graph of all tables.  Triangles and cores need cycles: `trade` joins every part with the suppliers
that have sold it, so that each order line closes a triangle of order, part and supplier.  `successions` goes from the
first part of an urgent order to its last, a directed graph with cycles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import algorithms as A
from ..operators.run import run
from ..sources import tables
from ..sources.tables import LABELS, STEP, key

I = {n: (i + 1) * STEP for i, n in enumerate(LABELS)}  # noqa: E741


def _id(label: str, column: str) -> str:
    return f"(CAST({I[label]} AS BIGINT) + {column})"


VERTICES = " UNION ALL ".join(f"SELECT {_id(n, c)} AS id FROM {t}" for n, c, t in (("region", "r_regionkey", "region"), ("nation", "n_nationkey", "nation"), ("customer", "c_custkey", "customer"), ("supplier", "s_suppkey", "supplier"), ("part", "p_partkey", "part"), ("orders", "o_orderkey", "orders"), ("user", "user_id", "(SELECT DISTINCT user_id FROM events)"), ("event", "event_id", "events")))
EDGES = " UNION ALL ".join(f"SELECT {_id(a, x)} AS src, {_id(b, y)} AS dst FROM {t}" for a, x, b, y, t in (("nation", "n_nationkey", "region", "n_regionkey", "nation"), ("customer", "c_custkey", "nation", "c_nationkey", "customer"), ("supplier", "s_suppkey", "nation", "s_nationkey", "supplier"), ("customer", "o_custkey", "orders", "o_orderkey", "orders"), ("orders", "l_orderkey", "part", "l_partkey", "lineitem"), ("orders", "l_orderkey", "supplier", "l_suppkey", "lineitem"), ("user", "user_id", "event", "event_id", "events")))
WHOLE = f"WITH v AS MATERIALIZED ({VERTICES}), e AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM ({EDGES}) GROUP BY 1, 2)"


def trade(spark: SparkSession, folder: str) -> Graph:
    """Orders, parts and suppliers, and which supplier has sold which part."""
    g = tables.graph(spark, folder)
    line = spark.read.schema(tables.SCHEMAS["lineitem"]).parquet(f"{folder}/lineitem.parquet")
    sold = line.select(key("supplier", "l_suppkey").alias("src"), key("part", "l_partkey").alias("dst")).distinct()
    edges = {"contains": g.edges["contains"], "fulfilled_by": g.edges["fulfilled_by"], "sold": sold.select(F.xxhash64("src", "dst").alias("id"), "src", "dst")}
    ends = {"contains": g.ends["contains"], "fulfilled_by": g.ends["fulfilled_by"], "sold": ({"supplier"}, {"part"})}
    return Graph(spark, {n: g.vertices[n] for n in ("orders", "part", "supplier")}, edges, ends)


def successions(spark: SparkSession, folder: str) -> Graph:
    """Parts, and of each urgent order an edge from the part of its first line to that of its last."""
    g = tables.graph(spark, folder)
    line, orders = (spark.read.schema(tables.SCHEMAS[n]).parquet(f"{folder}/{n}.parquet") for n in ("lineitem", "orders"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    both = line.join(urgent, "l_orderkey").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("a"), F.max(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("b"))
    edge = both.select(F.col("l_orderkey").alias("id"), key("part", F.col("a.l_partkey")).alias("src"), key("part", F.col("b.l_partkey")).alias("dst"))
    return Graph(spark, {"part": g.vertices["part"]}, {"followed_by": edge}, {"followed_by": ({"part"}, {"part"})})


def _round(df: DataFrame, *names: str) -> DataFrame:
    for n in names or ("value",):
        df = df.withColumn(n, F.round(n, 9))
    return df


def _ranks(rounds: int) -> str:
    out = f"{WHOLE}, o AS MATERIALIZED (SELECT src, sum(w) AS total FROM e GROUP BY 1), n AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM v), s AS MATERIALIZED (SELECT e.src, dst, w / total AS share FROM e JOIN o ON e.src = o.src), r0 AS MATERIALIZED (SELECT id, 1 / n AS r FROM v, n)"
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        out += f", b{k} AS MATERIALIZED (SELECT (sum(0.15 * r) + sum(CASE WHEN src IS NULL THEN 0.85 * r ELSE 0 END)) / min(n) AS b FROM {p} LEFT JOIN o ON id = src, n), g{k} AS MATERIALIZED (SELECT dst, sum(0.85 * r * share) AS m FROM {p} JOIN s ON id = src GROUP BY 1), r{k} AS MATERIALIZED (SELECT id, b + coalesce(m, 0) AS r FROM {p} LEFT JOIN g{k} ON id = dst, b{k})"
    return f"{out} SELECT id, round(r, 9) AS value FROM r{rounds}"


def _article(rounds: int) -> str:
    out = f"{WHOLE}, m AS MATERIALIZED (SELECT (SELECT CAST(sum(w) AS DOUBLE) FROM e) / count(*) AS mean FROM v), o AS MATERIALIZED (SELECT src, sum(w) AS total FROM e GROUP BY 1), s AS MATERIALIZED (SELECT e.src, dst, w / (total + mean) AS share FROM e JOIN o ON e.src = o.src, m), r0 AS MATERIALIZED (SELECT id, 0.15 AS score, 0.15 AS delta FROM v)"
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        out += f", g{k} AS MATERIALIZED (SELECT dst, sum(0.85 * delta * share) AS m FROM {p} JOIN s ON id = src WHERE delta > 0 GROUP BY 1), r{k} AS MATERIALIZED (SELECT id, score + coalesce(m, 0) AS score, coalesce(m, 0) AS delta FROM {p} LEFT JOIN g{k} ON id = dst)"
    return f"{out} SELECT id, round(CAST(score AS DOUBLE), 9) AS value FROM r{rounds}"


def _hits(rounds: int) -> str:
    out = f"{WHOLE}, h0 AS MATERIALIZED (SELECT id, CAST(1 AS DOUBLE) AS hub, CAST(1 AS DOUBLE) AS authority FROM v)"
    for k in range(1, rounds + 1):
        out += f", a{k} AS MATERIALIZED (SELECT id, hub, coalesce(m, 0) AS x FROM h{k - 1} LEFT JOIN (SELECT dst, sum(hub * w) AS m FROM h{k - 1} JOIN e ON id = src GROUP BY 1) ON id = dst), b{k} AS MATERIALIZED (SELECT id, hub, x / (SELECT sqrt(sum(x * x)) FROM a{k}) AS authority FROM a{k})"
        out += f", c{k} AS MATERIALIZED (SELECT id, authority, coalesce(m, 0) AS x FROM b{k} LEFT JOIN (SELECT src, sum(authority * w) AS m FROM b{k} JOIN e ON id = dst GROUP BY 1) ON id = src), h{k} AS MATERIALIZED (SELECT id, authority, x / (SELECT sqrt(sum(x * x)) FROM c{k}) AS hub FROM c{k})"
    return f"{out} SELECT id, round(hub, 9) AS hub, round(authority, 9) AS authority FROM h{rounds}"


def _pressure(rounds: int) -> str:
    out = f"{WHOLE}, p0 AS MATERIALIZED (SELECT id, CAST(id AS VARCHAR) AS c FROM v)"
    for k in range(1, rounds + 1):
        out += f", q{k} AS MATERIALIZED (SELECT id, c, sum(w) AS n FROM (SELECT dst AS id, c, w FROM p{k - 1} JOIN e ON id = src UNION ALL SELECT id, c, 1 FROM p{k - 1}) GROUP BY 1, 2), p{k} AS MATERIALIZED (SELECT id, c FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY n DESC, c) AS r FROM q{k}) WHERE r = 1)"
    return f"{out} SELECT id, c AS value FROM p{rounds}"


_JOINED = f"SELECT {_id('user', 'user_id')} AS id, user_id AS u FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT {_id('event', 'event_id')}, user_id FROM events"
_REST = " UNION ALL ".join(f"SELECT {_id(n, c)} AS id, {p} AS u FROM {t}" for n, c, t, p in (("region", "r_regionkey", "region", "-1"), ("nation", "n_nationkey", "nation", "-1"), ("customer", "c_custkey", "customer", "-1"), ("supplier", "s_suppkey", "supplier", "-1"), ("orders", "o_orderkey", "orders", "-1"), ("part", "p_partkey", "part", "CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem) THEN -1 ELSE -2 - p_partkey END")))
_TRADE = f"SELECT {_id('orders', 'l_orderkey')} AS x, {_id('part', 'l_partkey')} AS y FROM lineitem UNION ALL SELECT {_id('orders', 'l_orderkey')}, {_id('supplier', 'l_suppkey')} FROM lineitem UNION ALL SELECT {_id('supplier', 'l_suppkey')}, {_id('part', 'l_partkey')} FROM lineitem"
_TRADED = f"SELECT {_id('orders', 'o_orderkey')} AS id FROM orders UNION ALL SELECT {_id('part', 'p_partkey')} FROM part UNION ALL SELECT {_id('supplier', 's_suppkey')} FROM supplier"
_TRIANGLES = f"s AS MATERIALIZED (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM ({_TRADE})), t AS MATERIALIZED (SELECT p.a AS x, p.b AS y, q.b AS z FROM s p JOIN s q ON p.b = q.a JOIN s r ON r.a = p.a AND r.b = q.b), c AS MATERIALIZED (SELECT id, count(*) AS n FROM (SELECT x AS id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY 1)"
_FOLLOWED = f"SELECT DISTINCT {_id('part', 'a')} AS src, {_id('part', 'b')} AS dst FROM (SELECT l_orderkey, min_by(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS a, max_by(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1)"
_TEXTS = {"region": ("r_name",), "nation": ("n_name",), "customer": ("c_name", "c_mktsegment"), "supplier": ("s_name",), "part": ("p_name", "p_brand", "p_type"), "orders": ("o_orderstatus", "o_orderpriority"), "events": ("event_type", "props")}
_COUNTS = {"region": "region", "nation": "nation", "customer": "customer", "supplier": "supplier", "part": "part", "orders": "orders", "event": "events", "user": "(SELECT DISTINCT user_id FROM events)"}
_EDGE_COUNTS = {"in_region": "nation", "in_nation": "(SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier)", "placed": "orders", "contains": "lineitem", "fulfilled_by": "lineitem", "did": "events"}


def _written(*texts: str) -> Callable[[SparkSession, str], DataFrame]:
    """The rows of the last traversal, each of the others on the graph that the one before leaves."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        g = tables.graph(spark, folder)
        for text in texts[:-1]:
            g = run(g, text).graph
        return run(g, texts[-1]).df.toDF("v")

    return query


GRAPHS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "algo_page_rank": (lambda s, d: _round(A.page_rank(tables.graph(s, d), rounds=8, epsilon=0.0)), _ranks(8)),
    "algo_article_rank": (lambda s, d: _round(A.article_rank(tables.graph(s, d), rounds=6, tolerance=0.0)), _article(6)),
    "algo_hits": (lambda s, d: _round(A.hits(tables.graph(s, d), rounds=5), "hub", "authority"), _hits(5)),
    "algo_peer_pressure": (lambda s, d: A.peer_pressure(tables.graph(s, d), rounds=4), _pressure(4)),
    "algo_wcc": (lambda s, d: A.components(tables.graph(s, d)), f"SELECT id, min(CAST(id AS VARCHAR)) OVER (PARTITION BY u) AS value FROM ({_JOINED} UNION ALL {_REST})"),
    "algo_scc": (lambda s, d: A.strong_components(successions(s, d)), f"WITH RECURSIVE e AS MATERIALIZED ({_FOLLOWED}), v AS MATERIALIZED (SELECT {_id('part', 'p_partkey')} AS id FROM part), reach(a, b) AS (SELECT id, id FROM v UNION SELECT a, dst FROM reach JOIN e ON b = src) SELECT p.a AS id, min(CAST(p.b AS VARCHAR)) AS value FROM reach p JOIN reach q ON p.a = q.b AND p.b = q.a GROUP BY 1"),
    "algo_triangles": (lambda s, d: A.triangles(trade(s, d)), f"WITH {_TRIANGLES} SELECT v.id, coalesce(n, 0) AS value FROM ({_TRADED}) v LEFT JOIN c ON c.id = v.id"),
    "algo_clustering": (lambda s, d: _round(A.clustering(trade(s, d))), f"WITH {_TRIANGLES}, k AS MATERIALIZED (SELECT id, count(*) AS d FROM (SELECT a AS id FROM s UNION ALL SELECT b FROM s) GROUP BY 1) SELECT v.id, round(CASE WHEN coalesce(d, 0) < 2 THEN 0 ELSE CAST(2 * coalesce(n, 0) AS DOUBLE) / (d * (d - 1)) END, 9) AS value FROM ({_TRADED}) v LEFT JOIN c ON c.id = v.id LEFT JOIN k ON k.id = v.id"),
    "algo_kcore": (lambda s, d: A.k_core(trade(s, d)), None),
    "algo_similarity": (lambda s, d: _round(A.node_similarity(trade(s, d), ["sold"]), "similarity"), f"WITH s AS MATERIALIZED (SELECT DISTINCT {_id('supplier', 'l_suppkey')} AS x, l_partkey AS p FROM lineitem), n AS MATERIALIZED (SELECT x, count(*) AS n FROM s GROUP BY 1) SELECT a.x AS node1, b.x AS node2, round(CAST(count(*) AS DOUBLE) / (min(m.n) + min(k.n) - count(*)), 9) AS similarity FROM s a JOIN s b ON a.p = b.p AND a.x <> b.x JOIN n m ON m.x = a.x JOIN n k ON k.x = b.x GROUP BY 1, 2"),
    "algo_degree": (lambda s, d: A.degree(tables.graph(s, d), "IN"), f"WITH v AS ({VERTICES}), e AS ({EDGES}) SELECT id, count(dst) AS value FROM v LEFT JOIN e ON id = dst GROUP BY 1"),
    "service_search": (lambda s, d: A.search(tables.graph(s, d), "Building").select("key", "v"), " UNION ALL ".join(f"SELECT '{c}' AS key, {c} AS v FROM {t} WHERE contains(lower({c}), 'building')" for t, cs in _TEXTS.items() for c in cs)),
    "service_schema": (lambda s, d: A.schema(tables.graph(s, d)).where("kind like '%Label'").select("kind", "label", "count"), " UNION ALL ".join([f"SELECT 'vertexLabel' AS kind, '{n}' AS label, count(*) AS count FROM {t}" for n, t in _COUNTS.items()] + [f"SELECT 'edgeLabel', '{n}', count(*) FROM {t}" for n, t in _EDGE_COUNTS.items()])),
    "strategy_subgraph": (lambda s, d: run(tables.graph(s, d), "g.withStrategies(new SubgraphStrategy(vertices: has('c_mktsegment', 'BUILDING').or().hasLabel('orders'))).V().hasLabel('customer').out('placed').count()").df.toDF("n"), "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "write_add_drop": (_written("g.addV('region').property('r_name', 'NEW')", "g.V().has('r_name', 'ASIA').drop()", "g.V().hasLabel('region').values('r_name')"), "SELECT r_name AS v FROM region WHERE r_name <> 'ASIA' UNION ALL SELECT 'NEW'"),
    "write_property": (_written("g.V().hasLabel('nation').has('n_nationkey', lt(5)).property('n_name', 'small')", "g.V().hasLabel('nation').values('n_name')"), "SELECT CASE WHEN n_nationkey < 5 THEN 'small' ELSE n_name END AS v FROM nation"),
    "write_add_edge": (_written("g.V().has('nation', 'n_nationkey', lt(3)).as('n').V().has('region', 'r_regionkey', 0).addE('near').from('n')", "g.V().hasLabel('nation').out('near').values('r_name')"), "SELECT r_name AS v FROM region, nation WHERE r_regionkey = 0 AND n_nationkey < 3"),
    "write_merge": (_written("g.mergeV([(T.label): 'region', r_name: 'ASIA'])", "g.mergeV([(T.label): 'region', r_name: 'MOON'])", "g.V().hasLabel('region').values('r_name')"), "SELECT r_name AS v FROM region UNION ALL SELECT 'MOON'"),
    "write_drop_property": (_written("g.V().hasLabel('supplier').has('s_acctbal', lt(0)).properties('s_name').drop()", "g.V().hasLabel('supplier').values('s_name')"), "SELECT s_name AS v FROM supplier WHERE s_acctbal >= 0"),
    "write_drop_edges": (_written("g.E().hasLabel('placed').has('o_orderdate', lt(datetime('1995-01-01T00:00:00Z'))).drop()", "g.V().hasLabel('customer').out('placed').count()"), "SELECT count(*) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'"),
}
