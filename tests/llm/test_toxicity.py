import random
import zlib

from tessera.llm import toxicity

from .data import SCHEMA, documents, frame, sentence


def corpus(n=260):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, 30).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Grublin", "zorks" + rng.choice(["a", "en", "um"])]))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.trained(docs, marks), ["doc_id"]).collect()}
    apart = [(got[i].score >= toxicity.THRESHOLD) == bool(t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(apart) > 50 and sum(apart) >= 0.97 * len(apart)
    text = rows[0][1]
    assert {text[s.start : s.end].lower()[:4] for s in got[0].toxic_spans} <= {"grub", "zork"} and got[0].toxic_spans


def test_scores_depend_on_the_text_alone(spark):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.trained(docs, marks)
    other = spark.createDataFrame([(r[0] + 9999, r[1], "xx", "t", 0) for r in rows], SCHEMA)
    a, b = ([r.score for r in toxicity.scored(d, model, ["doc_id"]).orderBy("doc_id").collect()] for d in (docs, other))
    assert a == b


def test_hard_texts_and_missing_labels(spark):
    docs = frame(spark, clash=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, toxicity.trained(docs, none), ["doc_id", "score"]).collect()
    assert len(got) == len(documents()) and all(r.score == 0 and r.toxic_spans == [] for r in got)
    one = spark.createDataFrame([(0, 1, 1), (2, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.scored(docs, toxicity.trained(docs, one), ["doc_id"]).collect()} <= {0.0, 1.0}
    assert toxicity.scored(frame(spark, []), toxicity.Model(), ["doc_id"]).count() == 0
