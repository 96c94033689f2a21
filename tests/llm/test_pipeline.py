import corpus_pipeline
from tessera.llm import decontaminate, mixing, pii, quality, simhash
from tessera.llm.queries import QUERIES

from .data import SCHEMA, documents, frame, sentence


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages_take_effect_one_after_another(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(i, sentence(rng, 70 + i), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, rows[7][1], "en", "s1", 1), (101, sentence(rng, 10), "en", "s1", 1)]
    rows += [(102, sentence(rng, 60) + " call +1 (555) 555-0199 or jo@ex.org " + sentence(rng, 20), "en", "s1", 1)]
    item = sentence(rng, 14)
    rows += [(103, sentence(rng, 50) + " " + item + " " + sentence(rng, 9), "en", "s2", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        seen.append({r.doc_id for r in docs.collect()})
    assert 101 not in seen[0] and len(seen[0]) >= len(rows) - 3
    assert seen[0] - seen[1] == {100}
    assert seen[1] - seen[2] == {103}
    assert seen[2] == seen[3] == seen[4]
    text = spark.read.parquet(f"{tmp_path}/stage3").where("doc_id = 102").first().text
    assert "[PHONE]" in text and "[EMAIL]" in text and "555" not in text
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("doc_id", "size", "source_size", "target").collect()) == sorted(tuple(r) for r in docs.select("doc_id", "size", "source_size", "target").collect())


def test_stages_on_hard_and_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    for rows in (documents(), []):
        docs = frame(spark, rows, clash=True)
        for out in (quality.reject(docs), simhash.dedup(docs), decontaminate.clean(docs, bench), pii.mask(docs)):
            assert out.columns == docs.columns
            out.count()
        assert mixing.mixed(docs, docs.columns).count() == len(rows)
