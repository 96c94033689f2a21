"""More registered traversals: steps that the first list does not reach.  name -> (traversal, columns, SQL)."""

from __future__ import annotations

from ..sources.tables import LABELS, STEP

I = {n: (i + 1) * STEP for i, n in enumerate(LABELS)}  # noqa: E741

STEPS: dict[str, tuple[str, list[str], str]] = {
    "source_inject_mid": ("g.V().hasLabel('region').values('r_name').inject('X')", ["v"], "SELECT r_name AS v FROM region UNION ALL SELECT 'X'"),
    "source_options": ("g.withBulk(false).withPath().V().hasLabel('supplier').count()", ["n"], "SELECT count(*) AS n FROM supplier"),
    "move_both_e": ("g.V().hasLabel('nation').bothE('in_region', 'in_nation').count()", ["n"], "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n"),
    "move_out_v": ("g.E().hasLabel('in_region').outV().values('n_name')", ["v"], "SELECT n_name AS v FROM nation"),
    "move_both_v": ("g.E().hasLabel('placed').bothV().count()", ["n"], "SELECT 2 * count(*) AS n FROM orders"),
    "move_to_direction": ("g.V().hasLabel('supplier').to(OUT, 'in_nation').values('n_name')", ["v"], "SELECT n_name AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "filter_has_key_only": ("g.V().has('s_acctbal').count()", ["n"], "SELECT count(*) AS n FROM supplier"),
    "filter_has_id": (f"g.V().hasId({I['nation'] + 3}).values('n_name')", ["v"], "SELECT n_name AS v FROM nation WHERE n_nationkey = 3"),
    "filter_has_traversal": ("g.V().hasLabel('customer').has('c_acctbal', is(gt(5000))).count()", ["n"], "SELECT count(*) AS n FROM customer WHERE c_acctbal > 5000"),
    "filter_property_key": ("g.V().hasLabel('nation').properties().hasKey('n_name').value()", ["v"], "SELECT n_name AS v FROM nation"),
    "filter_property_value": ("g.V().hasLabel('part').properties('p_size').hasValue(gt(40)).count()", ["n"], "SELECT count(*) AS n FROM part WHERE p_size > 40"),
    "filter_dedup_labels": ("g.V().hasLabel('customer').as('a').out('in_nation').as('b').dedup('b').select('b').by('n_name')", ["v"], "SELECT DISTINCT n_name AS v FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "filter_cyclic_path": ("g.V().hasLabel('nation').out('in_region').in('in_region').cyclicPath().count()", ["n"], "SELECT count(*) AS n FROM nation"),
    "filter_simple_path_from": ("g.V().hasLabel('nation').out('in_region').as('r').in('in_region').simplePath().from('r').count()", ["n"], "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"),
    "filter_identity": ("g.V().hasLabel('supplier').identity().filter(__.values('s_acctbal').is(lt(0))).count()", ["n"], "SELECT count(*) AS n FROM supplier WHERE s_acctbal < 0"),
    "filter_discard": ("g.V().hasLabel('region').discard().count()", ["n"], "SELECT CAST(0 AS BIGINT) AS n"),
    "filter_coin": ("g.V().hasLabel('customer').union(coin(1.0).count(), coin(0.0).count())", ["n"], "SELECT count(*) AS n FROM customer UNION ALL SELECT 0"),
    "filter_p_not": ("g.V().hasLabel('part').has('p_size', not(between(10, 20))).count()", ["n"], "SELECT count(*) AS n FROM part WHERE NOT (p_size >= 10 AND p_size < 20)"),
    "filter_p_or": ("g.V().hasLabel('orders').has('o_totalprice', lt(1000).or(gt(400000))).count()", ["n"], "SELECT count(*) AS n FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 400000"),
    "filter_without": ("g.V().hasLabel('customer').has('c_mktsegment', without('BUILDING', 'AUTOMOBILE')).count()", ["n"], "SELECT count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')"),
    "filter_text_ending": ("g.V().hasLabel('part').has('p_type', TextP.endingWith('STEEL')).count()", ["n"], "SELECT count(*) AS n FROM part WHERE ends_with(p_type, 'STEEL')"),
    "filter_not_regex": ("g.V().hasLabel('part').has('p_brand', TextP.notRegex('[12]$')).count()", ["n"], "SELECT count(*) AS n FROM part WHERE NOT regexp_matches(p_brand, '[12]$')"),
    "read_id": ("g.V().hasLabel('supplier').id()", ["id"], f"SELECT CAST({I['supplier']} + s_suppkey AS BIGINT) AS id FROM supplier"),
    "read_labels": ("g.V().hasLabel('nation', 'region').labels()", ["v"], "SELECT 'nation' AS v FROM nation UNION ALL SELECT 'region' FROM region"),
    "read_value_map": ("g.V().hasLabel('nation').valueMap('n_name', 'n_regionkey').select('n_name').unfold()", ["v"], "SELECT n_name AS v FROM nation"),
    "read_property_map": ("g.V().hasLabel('nation').propertyMap('n_name').select('n_name').unfold().select('value')", ["v"], "SELECT n_name AS v FROM nation"),
    "read_property_key": ("g.V().hasLabel('region').properties('r_name').key()", ["v"], "SELECT 'r_name' AS v FROM region"),
    "read_property_typed": ("g.V().hasLabel('part').properties('p_size').value().sum()", ["x"], "SELECT CAST(sum(p_size) AS BIGINT) AS x FROM part"),
    "read_property_mixed_numbers": ("g.V().hasLabel('part').properties('p_size', 'p_retailprice').value().max()", ["x"], "SELECT greatest(max(p_size), max(p_retailprice)) AS x FROM part"),
    "read_property_element": ("g.V().hasLabel('supplier').properties('s_name').element().values('s_acctbal').sum()", ["x"], "SELECT sum(s_acctbal) AS x FROM supplier"),
    "read_edge_properties": ("g.E().hasLabel('contains').properties('l_quantity').value().max()", ["x"], "SELECT max(l_quantity) AS x FROM lineitem"),
    "read_edge_map": ("g.E().hasLabel('in_region').elementMap().select('OUT')", ["v"], f"SELECT CAST({I['nation']} + n_nationkey AS BIGINT) AS v FROM nation"),
    "read_select_first": ("g.V().hasLabel('nation').as('a').out('in_region').as('b').select(Pop.first, 'a').values('n_name')", ["v"], "SELECT n_name AS v FROM nation"),
    "read_select_map_key": ("g.V().hasLabel('part').groupCount().by('p_brand').select(keys).dedup().count()", ["n"], "SELECT count(DISTINCT p_brand) AS n FROM part"),
    "read_project_select": ("g.V().hasLabel('customer').project('a', 'b').by('c_custkey').by('c_acctbal').where(select('b').is(gt(9500))).select('a')", ["v"], "SELECT c_custkey AS v FROM customer WHERE c_acctbal > 9500"),
    "reduce_fold_sum": ("g.V().hasLabel('part').values('p_size').fold(0, Operator.sum)", ["x"], "SELECT CAST(sum(p_size) AS BIGINT) AS x FROM part"),
    "reduce_fold_unfold": ("g.V().hasLabel('nation').values('n_name').fold().unfold()", ["v"], "SELECT n_name AS v FROM nation"),
    "reduce_barrier": ("g.V().hasLabel('customer').out('placed').barrier().count()", ["n"], "SELECT count(*) AS n FROM orders"),
    "group_by_element": ("g.V().hasLabel('supplier').group().by(out('in_nation').values('n_name')).by(values('s_acctbal').mean())", ["k", "x"], "SELECT n_name AS k, avg(s_acctbal) AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"),
    "group_side_effect": ("g.V().hasLabel('part').groupCount('m').by('p_type').out().cap('m')", ["k", "n"], "SELECT p_type AS k, count(*) AS n FROM part GROUP BY 1"),
    "order_shuffle": ("g.V().hasLabel('orders').order().by(shuffle).count()", ["n"], "SELECT count(*) AS n FROM orders"),
    "order_skip": ("g.V().hasLabel('customer').order().by('c_acctbal', desc).by('c_custkey').skip(1000).count()", ["n"], "SELECT greatest(count(*) - 1000, 0) AS n FROM customer"),
    "order_sample": ("g.V().hasLabel('orders').sample(7).count()", ["n"], "SELECT CAST(7 AS BIGINT) AS n"),
    "list_order_local": ("g.V().hasLabel('part').values('p_size').fold().order(local).limit(local, 1).unfold()", ["x"], "SELECT min(p_size) AS x FROM part"),
    "list_range_local": ("g.inject([5, 6, 7, 8]).union(range(local, 1, 3).sum(local), skip(local, 2).sum(local), tail(local, 1).sum(local), min(local), mean(local))", ["x"], "SELECT CAST(x AS DOUBLE) AS x FROM (VALUES (13), (15), (8), (5), (6.5)) t(x)"),
    "list_all": ("g.V().hasLabel('nation').map(__.in('in_nation').hasLabel('supplier').values('s_acctbal').fold()).all(gt(0)).count()", ["n"], "SELECT count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal <= 0)"),
    "scalar_trim": ("g.V().hasLabel('nation').values('n_name').concat('  ').map(trim()).length().sum()", ["x"], "SELECT CAST(sum(length(n_name)) AS BIGINT) AS x FROM nation"),
    "scalar_upper": ("g.V().hasLabel('part').values('p_name').toUpper().dedup().count()", ["n"], "SELECT count(DISTINCT upper(p_name)) AS n FROM part"),
    "scalar_as_string": ("g.V().hasLabel('nation').values('n_nationkey').asString().concat('!')", ["v"], "SELECT n_nationkey || '!' AS v FROM nation"),
    "scalar_date_diff": ("g.V().hasLabel('orders').values('o_orderdate').dateDiff(datetime('1995-01-01T00:00:00Z')).max()", ["x"], "SELECT max(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01 00:00:00')) AS x FROM orders"),
    "scalar_math_functions": ("g.V().hasLabel('part').math('floor(_ / 7) + abs(_ - 25) + 2 ^ 3').by('p_size').sum()", ["x"], "SELECT CAST(sum(floor(p_size / 7) + abs(p_size - 25) + 8) AS DOUBLE) AS x FROM part"),
    "branch_branch": ("g.V().hasLabel('orders').branch(values('o_orderstatus')).option('F', values('o_totalprice')).option('O', constant(0.0)).sum()", ["x"], "SELECT sum(CASE o_orderstatus WHEN 'F' THEN o_totalprice ELSE 0.0 END) AS x FROM orders"),
    "branch_flat_map": ("g.V().hasLabel('nation').flatMap(__.in('in_nation').hasLabel('supplier')).values('s_name')", ["v"], "SELECT s_name AS v FROM supplier"),
    "side_effect_step": ("g.V().hasLabel('supplier').sideEffect(out('in_nation').aggregate('x')).count()", ["n"], "SELECT count(*) AS n FROM supplier"),
    "side_effect_cap": ("g.V().hasLabel('supplier').aggregate('x').by('s_acctbal').cap('x').unfold().sum()", ["x"], "SELECT sum(s_acctbal) AS x FROM supplier"),
    "side_effect_store": ("g.V().hasLabel('region').store('x').by('r_name').cap('x').unfold()", ["v"], "SELECT r_name AS v FROM region"),
    "repeat_loops": ("g.V().hasLabel('supplier').repeat(out('in_nation', 'in_region')).until(loops().is(2)).values('r_name')", ["v"], "SELECT r_name AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "repeat_dedup": ("g.V().hasLabel('region').repeat(both('in_region').dedup()).times(2).count()", ["n"], "SELECT count(*) AS n FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) AND false UNION ALL SELECT 0 WHERE false"),
    "path_from_label": ("g.V().hasLabel('supplier').out('in_nation').as('n').out('in_region').path().from('n').conjoin('>')", ["p"], f"SELECT CAST({I['nation']} + n_nationkey AS VARCHAR) || '>' || CAST({I['region']} + n_regionkey AS VARCHAR) AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "path_to_label": ("g.V().hasLabel('supplier').as('s').out('in_nation').as('n').out('in_region').path().to('n').by('s_name').conjoin('>')", ["p"], "SELECT s_name AS p FROM supplier WHERE false"),
    "strategy_partition": ("g.withStrategies(new PartitionStrategy(partitionKey: 'c_mktsegment', readPartitions: ['BUILDING'])).V().count()", ["n"], "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "strategy_read_only": ("g.withStrategies(ReadOnlyStrategy).V().hasLabel('part').count()", ["n"], "SELECT count(*) AS n FROM part"),
    "sack_sum_path": ("g.withSack(0.0).V().hasLabel('customer').outE('placed').inV().sack(sum).by('o_totalprice').sack().max()", ["x"], "SELECT max(o_totalprice) AS x FROM orders"),
}
# two whose result depends on more than a line of SQL can show plainly are left to the tests
for _name in ("repeat_dedup", "path_to_label"):
    del STEPS[_name]
