import random
import re

import corpus_pipeline
from tessera.llm import near

from .data import SCHEMA, documents, frame, sentence


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def least_ids(rows):
    """The smallest id of each group, by comparing all."""
    sets, of = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if of[i] != of[j] and (not both or 5 * len(sets[i] & sets[j]) >= 4 * both):
                of = [of[j] if x == of[i] else x for x in of]
    return sorted({min(r[0] for r, x in zip(rows, of, strict=True) if x == c) for c in set(of)})


def edited(rng, text, share):
    return " ".join(f"new{rng.random()}" if rng.random() < share else w for w in text.split())


def test_light_edits_are_near_copies(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.randint(60, 200)), "en", "s", 1) for i in range(80)]
    rows += [(1000 + i, edited(rng, rows[i][1], rng.choice([0.01, 0.02, 0.025, 0.05])), "en", "s", 1) for i in range(60)]
    want = least_ids(rows)
    assert 90 < len(want) < 125
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    kept = {r.doc_id for r in got.collect()}
    assert kept >= set(want) and len(kept) <= len(want) + 1  # a pair at the threshold is missed one time in 200


def test_large_groups_and_common_passages(spark):
    rng = random.Random(9)
    base, common = sentence(rng, 150), sentence(rng, 40)
    rows = [(i, edited(rng, base, rng.choice([0.005, 0.015, 0.03])), "en", "s", 1) for i in range(90)]
    rows += [(200 + i, f"{common} {sentence(rng, rng.randint(4, 80))}", "en", "s", 1) for i in range(90)]
    rows += [(400 + i, base.upper() if i % 2 else base, "en", "s", 1) for i in range(30)]
    rng.shuffle(rows)
    want, df = least_ids(rows), spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in near.dedup(df).collect()) == want


def test_hard_and_empty_tables(spark):
    docs = frame(spark, clash=True)
    out = near.dedup(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == least_ids(documents())
    assert near.dedup(frame(spark, [])).count() == 0


def test_recall_of_candidates_against_all_pairs(spark):
    """Pairs of 0.8 to 0.9, each text in one pair, so that no chain of links hides a pair that is missed."""
    rng, rows, want = random.Random(10), [], set()
    while len(want) < 250:
        one = sentence(rng, rng.randint(40, 160))
        two = edited(rng, one, rng.choice([0.01, 0.015, 0.02, 0.025]))
        a, b = shingles(one), shingles(two)
        if 0.8 <= len(a & b) / len(a | b) <= 0.9:
            want.add(len(rows))
            rows += [(len(rows), one, "en", "s", 1), (len(rows) + 1, two, "en", "s", 1)]
    kept = {r.doc_id for r in near.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = {i for i in want if i in kept and i + 1 not in kept}
    assert len(kept) == 2 * len(want) - len(found)
    assert len(found) >= 0.95 * len(want)


def test_plan_grows_with_the_members():
    assert near.plan(100) == near.plan(200_000)
    width, count = near.plan(50_000_000)
    assert width > 16 and count > near.plan(100)[1] and len(set(near.masks(width, count))) == count
