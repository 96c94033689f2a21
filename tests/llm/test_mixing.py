import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

from .data import documents, frame


def goals(sizes):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = sum(weight[s] for s in free)
        out = {s: 2 * sizes[s] if s in full else rest * weight[s] / share for s in names}
        above = {s for s in free if out[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return out
        full |= above


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_taken_words(spark):
    rows = documents(4, 150)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + count(r[1])
    want = goals(sizes)
    got = mixing.mixed(frame(spark, rows, clash=True), ["doc_id", "source"], block=16).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.size) for r in got) == sorted((r[0], count(r[1])) for r in rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, x in taken.items():
        assert abs(x - want[s]) <= 16 + 0.005 * want[s]


def test_result_is_the_same_for_any_layout(spark):
    rows, shown = documents(4, 150), []
    for files, order in ((1, "doc_id"), (3, "text"), (7, "n_chars")):
        docs = frame(spark, rows).repartition(files).sortWithinPartitions(order)
        spark.conf.set("spark.sql.shuffle.partitions", str(files + 1))
        shown.append(sorted((tuple(r) for r in mixing.mixed(docs, block=16).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert shown[0] == shown[1] == shown[2]


def test_draws_are_multinomial_and_decide_the_slots(spark):
    goal = spark.createDataFrame([("a", 1, 160_000, 200_000.0), ("b", 2, 100_000, 60_000.0), ("c", 3, 90, 130.0)], "source string, rank int, source_size long, target double")
    slots = mixing.drawn(goal, 16, 1 << 14).toPandas()
    wanted = {1: 12_500, 2: 3_750, 3: 6 * 130 / 90}
    counts = slots.groupby(["shard", "rank"]).size().unstack(fill_value=0)
    assert len(counts) == 16 and counts[1].nunique() > 8  # every shard has drawn its own
    n, p = 16_259 / 16, 12_500 / 16_259
    assert 0.3 < counts[1].var() / (n * p * (1 - p)) < 3
    for rank, own in slots.groupby("rank"):
        assert abs(own.part.sum() - wanted[rank]) <= 0.0051 * wanted[rank]
        assert sorted(own.slot) == list(range(len(own)))  # each slot once
        blocks = {1: 10_000, 2: 6_250, 3: 6}[rank]
        for _, one in own.groupby(own.slot // blocks):
            assert one.block.is_unique and one.block.between(0, blocks - 1).all()
    # a shard's slots of a source are one range, after those of the shards before, as the counts say
    one = slots[(slots["rank"] == 1)].sort_values("slot")
    assert (one.shard.diff().fillna(0) >= 0).sum() >= len(one) * 0.99
    assert abs(slots[slots["rank"] == 1].part.sum() - 12_500) > 0  # the draws, not the target, set the number


def test_permutation_of_any_size(spark):
    for n in (1, 2, 3, 64, 97, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p"))
        assert sorted(r.p for r in got.collect()) == list(range(n))


def test_blocks_hold_the_words_that_are_counted(spark):
    rows = [r for r in documents()[:-1] if r[0] is not None]
    docs = frame(spark, rows)
    taken = mixing.mixed(docs, block=8).agg(F.sum("taken")).first()[0]
    blocks = mixing.blocks(docs, block=8)
    assert blocks.agg(F.sum(F.size("words"))).first()[0] == taken
    assert blocks.agg(F.max(F.size("words"))).first()[0] <= 8


def test_empty_and_wordless_tables(spark):
    assert mixing.mixed(frame(spark, [])).count() == 0
    got = mixing.mixed(frame(spark, [(1, None, "en", None, None), (2, " ", "en", "a", 1)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
