"""Algorithms, services, writes, files, GQL and GraphQL."""

import json
import random

import pytest

from tessera.graph import Graph, dropped, looked_up, parted
from tessera.operators import algorithms as A
from tessera.operators.services import service
from tessera.operators.run import run
from tessera.operators.writes import WriteError
from tessera.plans.graphql import query
from tessera.plans.steps import UnsupportedTraversal
from tessera.sources import csv, graphson
from tessera.sources.fixtures import crew, modern, shape


def values(df):
    return {r[0]: r[1] for r in df.collect()}


@pytest.fixture(scope="module")
def g(spark):
    return modern(spark)


def test_page_rank_of_the_modern_graph(g):
    got = {k: round(v, 4) for k, v in values(A.page_rank(g)).items()}
    assert got == {1: 0.1138, 2: 0.146, 3: 0.3047, 4: 0.146, 5: 0.1758, 6: 0.1138}
    assert g.traverse("g.V().pageRank().order().by('gremlin.pageRankVertexProgram.pageRank', desc).limit(2).values('name')").rows() == ["lop", "ripple"]


class Plain:
    """A random directed graph, and its measures by the book."""

    def __init__(self, seed, n, m):
        rng = random.Random(seed)
        self.nodes = list(range(n))
        self.pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
        self.out = {v: {b for a, b in self.pairs if a == v and b != v} for v in self.nodes}
        self.near = {v: {x for p in self.pairs if v in p for x in p if x != v} for v in self.nodes}

    def dist(self, s, out=None):
        """Distances and numbers of shortest paths from s."""
        out, d, ways, front = out or self.out, {s: 0}, {s: 1}, [s]
        while front:
            new = {}
            for v in front:
                for w in out[v]:
                    if w not in d:
                        new[w] = new.get(w, 0) + ways[v]
            for w, k in new.items():
                d[w], ways[w] = d[front[0]] + 1, k
            front = list(new)
        return d, ways

    def least(self, classes):
        return {v: min(map(str, c)) for v in self.nodes for c in [classes[v]]}

    def core(self):
        out, left, k = {}, {v: set(x) for v, x in self.near.items()}, 0
        while left:
            low = [v for v in left if len(left[v]) <= k]
            if not low:
                k += 1
            for v in low:
                out[v] = k
                for w in left.pop(v):
                    left.get(w, set()).discard(v)
        return out


@pytest.mark.parametrize("seed,n,m", [(1, 14, 22), (2, 24, 60)])
def test_measures_match_plain_python(spark, seed, n, m):
    p = Plain(seed, n, m)
    g = shape(spark, p.pairs, p.nodes)
    every = {v: p.dist(v) for v in p.nodes}
    reach = {v: set(every[v][0]) for v in p.nodes}
    assert values(A.components(g)) == p.least({v: set(p.dist(v, p.near)[0]) for v in p.nodes})
    assert values(A.strong_components(g)) == p.least({v: {w for w in reach[v] if v in reach[w]} for v in p.nodes})
    to = {v: [d[v] for s, (d, _) in every.items() if s != v and v in d] for v in p.nodes}
    assert values(A.closeness(g)) == pytest.approx({v: len(x) / sum(x) if x else 0 for v, x in to.items()})
    assert values(A.harmonic(g)) == pytest.approx({v: sum(1 / d for d in x) / (n - 1) for v, x in to.items()})
    between = dict.fromkeys(p.nodes, 0.0)
    for s in p.nodes:
        d, ways = every[s]
        for t in d:
            for v in d:
                if v not in (s, t) and t in every[v][0] and d[v] + every[v][0][t] == d[t]:
                    between[v] += ways[v] * every[v][1][t] / ways[t]
    assert values(A.betweenness(g)) == pytest.approx(between)
    closed = {v: sum(b in p.near[a] for a in p.near[v] for b in p.near[v] if a < b) for v in p.nodes}
    assert values(A.triangles(g)) == closed
    assert values(A.clustering(g)) == pytest.approx({v: 2 * closed[v] / (k * (k - 1)) if (k := len(p.near[v])) > 1 else 0 for v in p.nodes})
    assert values(A.k_core(g)) == p.core()
    full = {v: {b for a, b in p.pairs if a == v} for v in p.nodes}
    want = {(x, y): len(full[x] & full[y]) / len(full[x] | full[y]) for x in p.nodes for y in p.nodes if x != y and full[x] & full[y]}
    assert {(r.node1, r.node2): r.similarity for r in A.node_similarity(g).collect()} == pytest.approx(want)
    assert values(A.degree(g)) == {v: sum(b == v for _, b in p.pairs) for v in p.nodes}


def test_components_of_a_long_chain(spark):
    assert set(values(A.components(shape(spark, [(i, i + 1) for i in range(40)]))).values()) == {"0"}


def test_paths(spark):
    g = shape(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)])
    got = sorted(r.path for r in A.shortest_paths(g).where("s = 1 and id = 5").collect())
    assert got == [[1, 2, 4, 5], [1, 3, 4, 5]]
    near = g.traverse("g.V(1).shortestPath().with('~tinkerpop.shortestPath.target', has('name', 'v4')).with('~tinkerpop.shortestPath.edges', outE())").rows()
    assert sorted(near) == [[1, 2, 4], [1, 3, 4]]
    assert {r.d for r in A.distances(g, limit=1.0).collect()} == {0.0, 1.0}


def test_votes_hubs_and_article_rank(g):
    assert values(A.peer_pressure(g)) == {1: "1", 2: "1", 3: "1", 4: "1", 5: "1", 6: "6"}
    hubs = {r.id: (r.hub, r.authority) for r in A.hits(g).collect()}
    assert hubs[1][0] == max(h for h, _ in hubs.values()) and hubs[3][1] == max(a for _, a in hubs.values())
    assert sum(a * a for _, a in hubs.values()) == pytest.approx(1)
    assert values(A.article_rank(g))[1] == pytest.approx(0.15)


def test_services(g, spark):
    assert {"pageRank", "schema", "tinker.search"} <= set(g.traverse("g.call()").rows())
    assert g.traverse("g.call('tinker.search', ['search': 'MAR']).element().values('age')").rows() == [29]
    kinds = {(r["kind"], r["label"], r["key"]): r["count"] for r in g.traverse("g.call('schema')").rows()}
    assert kinds["vertexLabel", "person", ""] == 4 and kinds["property", "software", "lang"] == 2

    @service("test.ids")
    def ids(graph, payload, params):
        return A.ids(graph)

    assert len(g.traverse("g.call('test.ids')").rows()) == 6
    other = shape(spark, [(1, 2)])
    assert run(g, "g.call('federate', ['graph': 'other', 'traversal': 'g.V().values(\"name\")'])", graphs={"other": other}).rows() == ["v1", "v2"]
    with pytest.raises(UnsupportedTraversal):
        g.traverse("g.call('nothing')")


def test_writes(g):
    w = g.traverse("g.addV('person').property('name', 'eve').property('age', 40)").graph
    assert w.traverse("g.V().has('name', 'eve').values('age')").rows() == [40] and g.traverse("g.V().count()").rows() == [6]
    w = w.traverse("g.V().has('name', 'eve').as('a').V().has('name', 'lop').addE('created').from('a').property('weight', 0.3)").graph
    assert w.traverse("g.V().has('name', 'eve').outE('created').values('weight')").rows() == [0.3]
    assert w.traverse("g.V().has('name', 'lop').in('created').count()").rows() == [4]
    w = w.traverse("g.V().has('name', 'lop').drop()").graph
    assert w.traverse("g.V().count()").rows() == [6] and w.traverse("g.E().count()").rows() == [3]
    w = g.traverse("g.V(1).property(list, 'name', 'mark')").graph
    assert sorted(w.traverse("g.V(1).values('name')").rows()) == ["mark", "marko"]
    assert g.traverse("g.V(1).property('age', null)").graph.traverse("g.V(1).hasNot('age').count()").rows() == [1]
    assert g.traverse("g.E(7).drop()").graph.traverse("g.V(1).out('knows').values('name')").rows() == ["josh"]
    assert g.traverse("g.V(1).properties('age').drop()").graph.traverse("g.V().values('age').count()").rows() == [3]
    w = g.traverse("g.V(1).addLabel('boss')").graph
    assert w.traverse("g.V().hasLabel('boss').values('name')").rows() == ["marko"] and w.traverse("g.V().hasLabel('person').count()").rows() == [4]
    with pytest.raises(WriteError):
        g.traverse("g.V(1).as('a').addE('x').from('a').to(__.out('nothing'))")
    with pytest.raises(WriteError):
        g.traverse("g.addV('person').property(T.id, 1)")


def test_merges(g):
    new = g.traverse("g.mergeV([(T.label): 'person', name: 'zed']).option(Merge.onCreate, [age: 9])").graph
    assert new.traverse("g.V().has('name', 'zed').values('age')").rows() == [9]
    old = g.traverse("g.mergeV([(T.label): 'person', name: 'marko']).option(Merge.onMatch, [age: 30])").graph
    assert old.traverse("g.V().has('name', 'marko').values('age')").rows() == [30] and old.traverse("g.V().count()").rows() == [6]
    edge = g.traverse("g.mergeE([(T.label): 'knows', (Direction.OUT): 2, (Direction.IN): 4])").graph
    assert edge.traverse("g.V(2).out('knows').values('name')").rows() == ["josh"]
    assert g.traverse("g.mergeE([(T.label): 'knows', (Direction.OUT): 1, (Direction.IN): 2])").graph.traverse("g.E().count()").rows() == [6]


QUESTIONS = ("g.V().count()", "g.E().count()", "g.V().hasLabel('person').values('name')", "g.V().out().values('name')", "g.V().values('age').sum()", "g.E().values('weight').sum()", "g.V().values('location')")


@pytest.mark.parametrize("make", [modern, crew])
@pytest.mark.parametrize("form,suffix", [(graphson, ".json"), (csv, ".csv")])
def test_files_round_trip(spark, tmp_path, make, form, suffix):
    g = make(spark)
    path = f"{tmp_path}/g{suffix}"
    g.traverse(f"g.io('{path}').write()")
    back = g.traverse(f"g.io('{path}').read()").graph
    for q in QUESTIONS:
        assert sorted(map(str, back.traverse(q).rows())) == sorted(map(str, g.traverse(q).rows()))


def test_typed_graphson(spark, tmp_path):
    line = {"id": {"@type": "g:Int64", "@value": 1}, "label": "person", "properties": {"name": [{"value": 'a "quoted" é'}], "age": [{"value": {"@type": "g:Int32", "@value": 3}}]}, "outE": {"knows": [{"id": 9, "inV": {"@type": "g:Int64", "@value": 2}, "properties": {"w": {"@type": "g:Double", "@value": 0.5}}}]}}
    (tmp_path / "x.json").write_text(json.dumps(line) + "\n\n" + json.dumps({"id": 2, "label": "person"}) + "\n")
    g = graphson.read(spark, str(tmp_path / "x.json"))
    assert dict(g.v().dtypes)["@age"] == "int" and g.traverse("g.V(1).out('knows').id()").rows() == [2]
    assert g.traverse("g.E().values('w')").rows() == [0.5] and g.traverse("g.V().values('name')").rows() == ['a "quoted" é']


def test_csv_headers(spark, tmp_path):
    (tmp_path / "n-vertices.csv").write_text('name:ID,age:int,tags:string[],note,:LABEL\nann,3,a;b,"",Person\nbob,,,x,Person;Boss\n')
    (tmp_path / "n-edges.csv").write_text(":START_ID,:END_ID,:TYPE,since:int\nann,bob,KNOWS,2001\n")
    g = csv.read(spark, str(tmp_path / "n.csv"))
    assert g.traverse("g.V().has('age').id()").rows() == ["ann"] and g.traverse("g.V().hasLabel('Boss').id()").rows() == ["bob"]
    assert sorted(g.traverse("g.V().values('tags')").rows()) == ["a", "b"]
    assert g.traverse("g.V('ann').out('KNOWS').id()").rows() == ["bob"]


def test_gql(g):
    rows = g.traverse("g.match('MATCH (a:person)-[:created]->(b {lang: \"java\"})<-[:created]-(c {name: \"peter\"})').select('a').by('name')").rows()
    assert sorted(rows) == ["josh", "marko", "peter"]
    with pytest.raises(UnsupportedTraversal):
        g.traverse("g.match('MATCH (a), (b)')")


def test_graphql(g):
    rows = query(g, '{ person(where: {age: {gte: 29}}, sort: {name: asc}) { who: name age out_created(sort: {name: asc}) { name in_created { name } } } }').collect()
    got = {r.who: [x.name for x in r.out_created] for r in rows}
    assert got == {"marko": ["lop"], "josh": ["lop", "ripple"], "peter": ["lop"]}
    with pytest.raises(UnsupportedTraversal):
        query(g, "{ nobody { name } }")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_similar_nodes_are_counted_where_lists_arrive(spark):
    p = Plain(3, 30, 120)
    df = A.node_similarity(shape(spark, p.pairs, p.nodes))
    plan = planned(df)
    assert "hashpartitioning(a#" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and x.split("hashpartitioning(")[1].count("#") > 1]
    hub = A.node_similarity(shape(spark, [(i, 99) for i in range(20)] + [(0, 98), (1, 98)]))
    got = {(r.node1, r.node2): r.similarity for r in hub.collect()}
    assert len(got) == 380 and got[0, 1] == 1 and got[2, 0] == got[0, 2] == pytest.approx(1 / 2) and got[5, 6] == 1


@pytest.mark.parametrize("op", ["gt", "gte", "lt", "lte"])
def test_pairs_of_labels_are_counted_without_making_them(spark, op):
    rng = random.Random(op)
    n = 60
    person = spark.createDataFrame([(i, rng.choice([None, 1.0, 2.5, -0.0, 0.0, float("nan")] + [rng.random()] * 5)) for i in range(n)], "id long, `@x` double")
    firm = spark.createDataFrame([(100 + i, rng.choice([None, *range(4)])) for i in range(n)], "id long, `@y` int")
    place = spark.createDataFrame([(200 + i,) for i in range(3)], "id long")
    at = lambda first: spark.createDataFrame([(first * 10 + i, first + i, 200 + rng.choice([0, 0, 0, 1, 2])) for i in range(n)] + [(first * 10 + n, first, 200)], "id long, src long, dst long")
    ends = {"lives": ({"person"}, {"place"}), "stands": ({"firm"}, {"place"})}
    g = Graph(spark, {"person": person, "firm": firm, "place": place}, {"lives": at(0), "stands": at(100)}, ends)
    text = f"g.V().hasLabel('person').as('a').out('lives').in('stands').has('y').as('b').where('a', {op}('b')).by('x').by('y')"
    plain = g.traverse(f"{text}.select('a', 'b').by('x').by('y')").df.count()
    counted = g.traverse(f"{text}.count()")
    assert counted.rows() == [plain] and plain > 0
    assert "_l#" not in planned(counted.df) and "_own#" in planned(counted.df)
    assert g.traverse(f"g.V().hasLabel('place').as('a').in('lives').in('stands').as('b').where('a', {op}('b')).by('x').by('y').count()").rows() == [0]


def test_kept_tables_meet_without_a_shuffle_and_can_go(spark):
    import os

    e = parted(spark.range(300).selectExpr("id % 70 as src", "id as dst"), "src")
    v = parted(spark.range(70), "id")
    df = looked_up(e, v, e["src"] == v["id"]).groupBy("src").count()
    assert "Exchange" not in planned(df) and df.count() == 70 and df.agg({"count": "sum"}).first()[0] == 300
    where = e._kept_at.removeprefix("file:")
    assert os.listdir(where) and not [t for t in spark.catalog.listTables() if t.name.startswith("parted_")]
    dropped(e)
    assert not os.path.exists(where)


def test_algorithms_broadcast_nothing_and_leave_the_session_as_it_was(spark):
    p = Plain(4, 20, 50)
    g = shape(spark, p.pairs, p.nodes)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for df in (A.strong_components(g), A.components(g), A.page_rank(g, rounds=2), A.clustering(g)):
        assert "Broadcast" not in planned(df)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


@pytest.mark.parametrize("form,suffix", [(graphson, ".json"), (csv, ".csv")])
def test_what_a_file_is_read_into_is_smaller_than_the_file(spark, tmp_path, form, suffix):
    from pathlib import Path

    from tessera.graph import shared_dir

    n = 20_000
    v = spark.range(n).selectExpr("id", "concat('name of ', id) as `@name`", "id % 7 as `@age`")
    e = spark.range(n).selectExpr("id", "id as src", "(id * 7) % 20000 as dst", "'a rather long and common note' as `@note`")
    g = Graph(spark, {"person": v}, {"knows": e}, {"knows": ({"person"}, {"person"})})
    (kept := Path(shared_dir(spark).removeprefix("file:"))).mkdir(parents=True, exist_ok=True)
    size = lambda p: sum(f.stat().st_size for f in p.rglob("*") if f.is_file())
    form.write(g, f"{tmp_path}/g{suffix}")
    text = sum(len(r.value) for r in spark.read.text([str(p) for p in tmp_path.iterdir()]).collect())
    before = size(kept)
    back = form.read(spark, f"{tmp_path}/g{suffix}")
    assert 0 < size(kept) - before < 0.5 * text
    assert back.traverse("g.V(3).out('knows').values('name')").rows() == ["name of 21"]
    assert suffix == ".csv" or size(tmp_path) < 0.2 * text
