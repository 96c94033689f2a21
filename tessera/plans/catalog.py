"""The registered queries: Gremlin over the tables as a graph, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import algorithms as A
from ..operators.run import run
from ..sources import csv, graphson, tables
from ..sources.tables import LABELS, STEP
from .catalog_graphs import GRAPHS
from .catalog_steps import STEPS

I = {n: (i + 1) * STEP for i, n in enumerate(LABELS)}  # noqa: E741

#: name -> (traversal, names of the result's columns, SQL)
TEXTS: dict[str, tuple[str, list[str], str]] = {
    "flagship_brands": ("g.V().hasLabel('customer').out('placed').out('contains').groupCount().by('p_brand')", ["brand", "n"], "SELECT p_brand AS brand, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1"),
    "source_v_count": ("g.V().hasLabel('customer').count()", ["n"], "SELECT count(*) AS n FROM customer"),
    "source_e_count": ("g.E().hasLabel('contains').count()", ["n"], "SELECT count(*) AS n FROM lineitem"),
    "source_v_ids": (f"g.V({I['nation'] + 1}, {I['nation'] + 2}).values('n_name')", ["name"], "SELECT n_name AS name FROM nation WHERE n_nationkey IN (1, 2)"),
    "source_inject": ("g.inject(1, 2, 3).math('_ * 2')", ["x"], "SELECT CAST(x * 2 AS DOUBLE) AS x FROM (VALUES (1), (2), (3)) t(x)"),
    "source_union": ("g.union(V().hasLabel('region').values('r_name'), V().hasLabel('nation').values('n_name'))", ["name"], "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation"),
    "move_out": ("g.V().hasLabel('nation').out('in_region').values('r_name')", ["name"], "SELECT r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "move_in": ("g.V().hasLabel('region').in('in_region').values('n_name')", ["name"], "SELECT n_name AS name FROM nation"),
    "move_both_count": ("g.V().hasLabel('nation').both().count()", ["n"], "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n"),
    "move_out_e_in_v": ("g.V().hasLabel('orders').outE('contains').has('l_quantity', gt(45)).inV().dedup().count()", ["n"], "SELECT count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_quantity > 45"),
    "move_other_v": ("g.V().hasLabel('region').inE('in_region').otherV().values('n_name')", ["name"], "SELECT n_name AS name FROM nation"),
    "three_hops": ("g.V().hasLabel('region').in('in_region').in('in_nation').out('placed').count()", ["n"], "SELECT count(*) AS n FROM orders"),
    "four_hops_collapsed": ("g.V().hasLabel('part').in('contains').out('contains').count()", ["n"], "SELECT CAST(sum(c * c) AS BIGINT) AS n FROM (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1)"),
    "filter_has_p": ("g.V().has('customer', 'c_acctbal', gt(9000)).values('c_name')", ["name"], "SELECT c_name AS name FROM customer WHERE c_acctbal > 9000"),
    "filter_between": ("g.V().hasLabel('part').has('p_size', between(10, 20)).count()", ["n"], "SELECT count(*) AS n FROM part WHERE p_size >= 10 AND p_size < 20"),
    "filter_inside_outside": ("g.V().hasLabel('part').has('p_size', outside(10, 40).and(neq(5))).count()", ["n"], "SELECT count(*) AS n FROM part WHERE (p_size < 10 OR p_size > 40) AND p_size <> 5"),
    "filter_within": ("g.V().hasLabel('customer').has('c_mktsegment', within('BUILDING', 'MACHINERY')).count()", ["n"], "SELECT count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "filter_textp": ("g.V().hasLabel('part').has('p_brand', TextP.startingWith('Brand#1')).has('p_type', TextP.notContaining('STEEL')).count()", ["n"], "SELECT count(*) AS n FROM part WHERE starts_with(p_brand, 'Brand#1') AND NOT contains(p_type, 'STEEL')"),
    "filter_regex": ("g.V().hasLabel('part').has('p_brand', TextP.regex('#[12]$')).count()", ["n"], "SELECT count(*) AS n FROM part WHERE regexp_matches(p_brand, '#[12]$')"),
    "filter_has_not": ("g.V().hasNot('n_name').hasLabel('region').count()", ["n"], "SELECT count(*) AS n FROM region"),
    "filter_where_exists": ("g.V().hasLabel('customer').where(out('placed')).count()", ["n"], "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "filter_not": ("g.V().hasLabel('customer').not(out('placed')).count()", ["n"], "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "filter_where_count": ("g.V().hasLabel('customer').where(out('placed').count().is(gt(12))).values('c_custkey')", ["c"], "SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "filter_and_or": ("g.V().hasLabel('customer').and(has('c_acctbal', gt(0)), or(has('c_mktsegment', 'BUILDING'), out('placed').has('o_orderstatus', 'P'))).count()", ["n"], "SELECT count(*) AS n FROM customer WHERE c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))"),
    "filter_where_labels": ("g.V().hasLabel('customer').as('a').out('in_nation').in('in_nation').hasLabel('supplier').as('b').where('a', gt('b')).by('c_acctbal').by('s_acctbal').count()", ["n"], "SELECT count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > s_acctbal"),
    "dedup_by": ("g.V().hasLabel('part').dedup().by('p_brand').count()", ["n"], "SELECT count(DISTINCT p_brand) AS n FROM part"),
    "side_effect_within": ("g.V().hasLabel('supplier').aggregate('x').by('s_nationkey').V().hasLabel('nation').values('n_nationkey').dedup().where(without('x')).count()", ["n"], "SELECT CASE WHEN (SELECT count(*) FROM supplier) = 0 THEN 0 ELSE (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)) END AS n"),
    "read_values": ("g.V().hasLabel('region').values('r_regionkey', 'r_name')", ["v"], "SELECT CAST(r_regionkey AS VARCHAR) AS v FROM region UNION ALL SELECT r_name FROM region"),
    "read_element_map": ("g.V().hasLabel('region').elementMap('r_name')", ["id", "label", "name"], f"SELECT CAST({I['region']} + r_regionkey AS BIGINT) AS id, 'region' AS label, r_name AS name FROM region"),
    "read_properties": ("g.V().hasLabel('region').properties('r_name').value()", ["v"], "SELECT r_name AS v FROM region"),
    "read_project": ("g.V().hasLabel('nation').project('name', 'customers', 'region').by('n_name').by(__.in('in_nation').hasLabel('customer').count()).by(out('in_region').values('r_name'))", ["name", "customers", "region"], "SELECT n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "read_select": ("g.V().hasLabel('nation').as('a').out('in_region').as('b').select('a', 'b').by('n_name').by('r_name')", ["a", "b"], "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "reduce_sum": ("g.V().hasLabel('orders').outE('contains').values('l_quantity').sum()", ["x"], "SELECT sum(l_quantity) AS x FROM lineitem"),
    "reduce_min": ("g.V().hasLabel('customer').values('c_acctbal').min()", ["x"], "SELECT min(c_acctbal) AS x FROM customer"),
    "reduce_max": ("g.V().hasLabel('customer').values('c_acctbal').max()", ["x"], "SELECT max(c_acctbal) AS x FROM customer"),
    "reduce_mean": ("g.V().hasLabel('part').values('p_size').mean()", ["x"], "SELECT avg(p_size) AS x FROM part"),
    "reduce_fold": ("g.V().hasLabel('region').values('r_name').fold().count(local)", ["n"], "SELECT count(*) AS n FROM region"),
    "group_reduce": ("g.V().hasLabel('part').group().by('p_brand').by(values('p_size').max())", ["brand", "x"], "SELECT p_brand AS brand, max(p_size) AS x FROM part GROUP BY 1"),
    "group_child_count": ("g.V().hasLabel('nation').group().by('n_name').by(__.in('in_nation').count())", ["nation", "n"], "SELECT n_name AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation"),
    "group_count_label": ("g.V().hasLabel('region', 'nation', 'supplier').groupCount().by(T.label)", ["label", "n"], "SELECT 'region' AS label, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier"),
    "group_count_traversal": ("g.V().hasLabel('customer').groupCount().by(out('in_nation').out('in_region').values('r_name'))", ["region", "n"], "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "order_limit": ("g.V().hasLabel('orders').order().by('o_totalprice', desc).limit(10).values('o_orderkey')", ["o"], "SELECT o_orderkey AS o FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "order_range": ("g.V().hasLabel('customer').order().by('c_acctbal').by('c_custkey').range(5, 15).values('c_custkey')", ["c"], "SELECT c_custkey AS c FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5"),
    "order_tail": ("g.V().hasLabel('part').order().by('p_retailprice').tail(5).values('p_partkey')", ["p"], "SELECT p_partkey AS p FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 5"),
    "order_by_degree": ("g.V().hasLabel('customer').order().by(out('placed').count(), desc).limit(10).values('c_custkey')", ["c"], "SELECT c_custkey AS c FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY count(o_orderkey) DESC, c_custkey LIMIT 10"),
    "local_limit": ("g.V().hasLabel('customer').local(out('placed').order().by('o_totalprice', desc).limit(1)).values('o_orderkey')", ["o"], "SELECT o_orderkey AS o FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1"),
    "branch_union": ("g.V().hasLabel('nation').union(out('in_region').values('r_name'), values('n_name'))", ["name"], "SELECT r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_name FROM nation"),
    "branch_choose": ("g.V().hasLabel('customer').choose(has('c_acctbal', lt(0)), constant('debt'), constant('credit')).groupCount()", ["kind", "n"], "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS kind, count(*) AS n FROM customer GROUP BY 1"),
    "branch_options": ("g.V().hasLabel('orders').choose(values('o_orderstatus')).option('F', constant('done')).option('O', constant('open')).option(none, constant('other')).groupCount()", ["kind", "n"], "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS kind, count(*) AS n FROM orders GROUP BY 1"),
    "branch_coalesce": ("g.V().hasLabel('customer').coalesce(out('placed').has('o_orderstatus', 'P').values('o_orderkey'), constant(-1)).count()", ["n"], "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') + (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS n"),
    "branch_optional": ("g.V().hasLabel('customer').optional(out('placed')).count()", ["n"], "SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n"),
    "map_child": ("g.V().hasLabel('nation').map(__.in('in_nation').hasLabel('supplier').count())", ["n"], "SELECT (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation"),
    "repeat_times": ("g.V().hasLabel('orders').repeat(both('contains')).times(2).count()", ["n"], "SELECT CAST(sum(c * c) AS BIGINT) AS n FROM (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1)"),
    "repeat_emit": ("g.V().hasLabel('supplier').repeat(out('in_nation', 'in_region')).emit().times(2).groupCount().by(T.label)", ["label", "n"], "SELECT 'nation' AS label, count(*) AS n FROM supplier UNION ALL SELECT 'region', count(*) FROM supplier"),
    "repeat_until": ("g.V().hasLabel('customer').repeat(out('in_nation', 'in_region')).until(hasLabel('region')).groupCount().by('r_name')", ["region", "n"], "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "path_by": ("g.V().hasLabel('supplier').out('in_nation').out('in_region').path().by('s_name').by('n_name').by('r_name').conjoin('>')", ["p"], "SELECT s_name || '>' || n_name || '>' || r_name AS p FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "simple_path": ("g.V().hasLabel('nation').out('in_region').in('in_region').simplePath().count()", ["n"], "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"),
    "sack_mult": ("g.withSack(1.0).V().hasLabel('orders').outE('contains').sack(mult).by('l_extendedprice').sack(mult).by('l_discount').sack().sum()", ["x"], "SELECT sum(l_extendedprice * l_discount) AS x FROM lineitem"),
    "match_pattern": ("g.V().hasLabel('nation').match(__.as('n').out('in_region').as('r'), __.as('c').out('in_nation').as('n'), __.as('n').in('in_nation').hasLabel('supplier').as('c')).select('n', 'r').by('n_name').by('r_name')", ["n", "r"], "SELECT n_name AS n, r_name AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "gql_match": ("g.match('MATCH (s:supplier)-[:in_nation]->(n:nation)-[:in_region]->(r:region)').select('s', 'r').by('s_name').by('r_name')", ["s", "r"], "SELECT s_name AS s, r_name AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "scalar_strings": ("g.V().hasLabel('nation').values('n_name').substring(0, 3).toLower().concat('-', 'x')", ["v"], "SELECT lower(substr(n_name, 1, 3)) || '-x' AS v FROM nation"),
    "scalar_replace_length": ("g.V().hasLabel('part').values('p_brand').replace('Brand', 'B').length().sum()", ["x"], "SELECT CAST(sum(length(replace(p_brand, 'Brand', 'B'))) AS BIGINT) AS x FROM part"),
    "scalar_split": ("g.V().hasLabel('part').values('p_brand').split('#').count(local).sum()", ["x"], "SELECT CAST(sum(len(string_split(p_brand, '#'))) AS BIGINT) AS x FROM part"),
    "scalar_math": ("g.V().hasLabel('part').project('a', 'b').by('p_size').by('p_partkey').math('(a + 1) * 2 - b % 7')", ["x"], "SELECT CAST((p_size + 1) * 2 - p_partkey % 7 AS DOUBLE) AS x FROM part"),
    "scalar_format": ("g.V().hasLabel('nation').format('%{n_name} (%{n_nationkey})')", ["v"], "SELECT n_name || ' (' || n_nationkey || ')' AS v FROM nation"),
    "scalar_dates": ("g.V().hasLabel('orders').values('o_orderdate').dateAdd(DT.day, 2).max()", ["x"], "SELECT max(o_orderdate) + INTERVAL 2 DAY AS x FROM orders"),
    "list_ops": ("g.inject([1, 2, 2, 3]).union(dedup(local).count(local), sum(local), max(local), combine([9]).count(local), intersect([2, 3]).count(local), difference([2]).count(local), merge([7]).count(local), disjunct([3, 4]).count(local), product([1, 2]).count(local), reverse().limit(local, 1).sum(local))", ["x"], "SELECT CAST(x AS BIGINT) AS x FROM (VALUES (3), (8), (3), (5), (2), (2), (4), (3), (8), (3)) t(x)"),
    "list_quantifiers": ("g.inject([1, 2], [3, 4], [5, 6]).any(gt(3)).none(gt(5)).count()", ["n"], "SELECT CAST(1 AS BIGINT) AS n"),
    "graph_ql": ("", ["name", "region"], "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey < 10"),
}


TEXTS |= STEPS


def _text(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, names, _ = TEXTS[name]

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return run(tables.graph(spark, folder), text).df.toDF(*names)

    return query


def places(spark: SparkSession, folder: str) -> Graph:
    """Suppliers, nations and regions with their edges: a smaller graph for distances between all pairs, which are quadratic by definition."""
    g = tables.graph(spark, folder)
    keep = {"region", "nation", "supplier"}
    near = g.edges["in_nation"].where(F.col("src") >= I["supplier"]).where(F.col("src") < I["part"])
    return Graph(spark, {k: v for k, v in g.vertices.items() if k in keep}, {"in_region": g.edges["in_region"], "in_nation": near}, {"in_region": g.ends["in_region"], "in_nation": ({"supplier"}, {"nation"})})


def _graph_ql(spark: SparkSession, folder: str) -> DataFrame:
    from .graphql import query

    out = query(tables.graph(spark, folder), '{ nation(where: {n_nationkey: {lt: 10}}) { n_name out_in_region { r_name } } }')
    return out.select(F.col("n_name").alias("name"), F.explode("out_in_region.r_name").alias("region"))


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    return A.shortest_paths(places(spark, folder)).select("s", "id", "distance", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def _round(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


def _round_trip(form, suffix: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        import uuid

        from ..graph import shared_dir

        path = f"{shared_dir(spark)}/io-{uuid.uuid4().hex}{suffix}"
        form.write(tables.graph(spark, folder), path)
        return run(form.read(spark, path), "g.V().hasLabel('supplier').as('s').out('in_nation').as('n').select('s', 'n').by('s_name').by('n_name')").df.toDF("s", "n")

    return query


_PAIRS = "SELECT s_name AS s, n_name AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey"
_S, _N, _R = (f"(CAST({I[x]} AS BIGINT) + {k})" for x, k in (("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")))
_REACH = f"SELECT {_N} AS id, count(*) AS c, CAST(count(*) AS DOUBLE) AS d FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT CAST({I['region']} AS BIGINT) + n_regionkey, count(DISTINCT n_nationkey) + count(s_suppkey), CAST(count(DISTINCT n_nationkey) + 2 * count(s_suppkey) AS DOUBLE) FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"
_ALL = f"SELECT {_S} AS id FROM supplier UNION ALL SELECT {_N} FROM nation UNION ALL SELECT {_R} FROM region"

#: name -> (function, SQL or None)
MORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "algo_closeness": (lambda s, d: _round(A.closeness(places(s, d))), f"SELECT a.id, round(coalesce(c / d, 0), 6) AS value FROM ({_ALL}) a LEFT JOIN ({_REACH}) r ON a.id = r.id"),
    "algo_betweenness": (lambda s, d: _round(A.betweenness(places(s, d))), f"SELECT a.id, round(coalesce(CAST(c AS DOUBLE), 0), 6) AS value FROM ({_ALL}) a LEFT JOIN (SELECT {_N} AS id, count(*) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) b ON a.id = b.id"),
    "algo_shortest_paths": (_paths, f"WITH x AS ({_ALL}), y AS (SELECT {_S} AS s, {_N} AS n, CAST({I['region']} AS BIGINT) + n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT id AS s, id, CAST(0 AS DOUBLE) AS distance, CAST(id AS VARCHAR) AS path FROM x UNION ALL SELECT s, n, 1, s || '>' || n FROM y UNION ALL SELECT s, r, 2, s || '>' || n || '>' || r FROM y UNION ALL SELECT {_N}, CAST({I['region']} AS BIGINT) + n_regionkey, 1, {_N} || '>' || (CAST({I['region']} AS BIGINT) + n_regionkey) FROM nation"),
    "algo_harmonic": (lambda s, d: _round(A.harmonic(places(s, d))), f"SELECT a.id, round(coalesce(h, 0) / (SELECT count(*) - 1 FROM ({_ALL})), 6) AS value FROM ({_ALL}) a LEFT JOIN (SELECT {_N} AS id, CAST(count(*) AS DOUBLE) AS h FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT CAST({I['region']} AS BIGINT) + n_regionkey, count(DISTINCT n_nationkey) + count(s_suppkey) / 2.0 FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) b ON a.id = b.id"),
    "io_graphson": (_round_trip(graphson, ".json"), _PAIRS),
    "io_csv": (_round_trip(csv, ".csv"), _PAIRS),
    "graph_ql": (_graph_ql, TEXTS["graph_ql"][2]),
}


MORE |= GRAPHS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _text(n) for n, (t, _, _) in TEXTS.items() if t} | {n: f for n, (f, _) in MORE.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (t, _, sql) in TEXTS.items() if t} | {n: sql for n, (_, sql) in MORE.items() if sql}
