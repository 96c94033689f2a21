import json

from tessera.streaming import changes


def test_feed_to_graph(spark, tmp_path):
    feed, log, mark = (str(tmp_path / x) for x in ("feed", "log", "mark"))
    (tmp_path / "feed").mkdir()

    def send(name, rows):
        (tmp_path / "feed" / name).write_text("\n".join(json.dumps(r) for r in rows))
        q = changes.follow(spark, feed, log, mark)
        q.awaitTermination(120)

    v = lambda seq, i, op="put", **p: {"seq": seq, "op": op, "kind": "vertex", "label": "person", "id": i, "props": {k: str(x) for k, x in p.items()}}
    e = lambda seq, i, a, b, op="put": {"seq": seq, "op": op, "kind": "edge", "label": "knows", "id": i, "src": a, "dst": b, "props": {}}
    send("a.json", [v(1, 1, name="ann", age=3), v(2, 2, name="bob"), e(3, 7, 1, 2), v(4, 3, name="cy")])
    g = changes.snapshot(spark, log, types={"age": "int"})
    assert g.traverse("g.V().out('knows').values('name')").rows() == ["bob"] and g.traverse("g.V().values('age').sum()").rows() == [3]
    send("b.json", [v(5, 1, name="anna"), v(6, 2, "drop"), v(6, 3, "drop"), v(5, 3, name="late")])
    g = changes.snapshot(spark, log)
    assert g.traverse("g.V().values('name')").rows() == ["anna"] and g.traverse("g.E().count()").rows() == [0]
    old = changes.snapshot(spark, log, upto=4)
    assert sorted(old.traverse("g.V().values('name')").rows()) == ["ann", "bob", "cy"]


def test_windows(spark):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0), ("2024-01-01 00:20:00", "b", 8.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("CAST(ts AS timestamp) AS ts", "event_type", "value")
    got = sorted((str(r.start), r.event_type, r.n, r.total) for r in changes.windowed(df).collect())
    assert got == [("2024-01-01 00:00:00", "a", 2, 3.0), ("2024-01-01 00:00:00", "b", 1, 8.0), ("2024-01-01 01:00:00", "a", 1, 4.0)]
