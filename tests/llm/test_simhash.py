import random
import re

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.components import Classes, components, spanned

from .data import SCHEMA, documents, frame


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def grouped(pairs):
    """Smallest id reachable, from (id, fingerprint) pairs, by comparing all."""
    ids = [i for i, _ in pairs]
    fps = np.array([f for _, f in pairs], np.uint64)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4):
            parent[find(i)] = find(int(j))
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(ids))]


def test_components_match_brute_force(spark):
    rows = documents()
    want = grouped([(r[0], fingerprint(r[1])) for r in rows])
    got = sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(frame(spark, clash=True)).collect())
    assert got == sorted((r[0], fingerprint(r[1]), c) for r, c in zip(rows, want, strict=True))


def clustered():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (700, 3)).astype(np.uint64), axis=1) for _ in base]
    return np.unique(np.concatenate([b ^ f for b, f in zip(base, flips, strict=True)] + [rng.integers(0, 1 << 63, 900, dtype=np.uint64)]))


def test_hierarchy_loses_no_link_among_clusters_and_noise(monkeypatch):
    fps = clustered()
    brute, pairs = Classes(len(fps)), set()
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4)
        brute.join(np.full(len(j), i), j)
        pairs |= {(i, int(k)) for k in j if k > i}
    every, compared = np.arange(len(fps)), []
    plain = simhash.GrayIndex._expanded

    def counting(self, level, a, *more):
        compared.append((level, len(a)))
        plain(self, level, a, *more)

    monkeypatch.setattr(simhash.GrayIndex, "_expanded", counting)
    # all under one top node: the lower nodes alone must prune
    index = simhash.GrayIndex(np.zeros(len(fps), np.int64), fps[:, None])
    assert len(index.levels) > 4 and [len(r) for r in index.roots[:-1]] == [0] * (len(index.levels) - 1)
    found = Classes(len(fps))
    a, b = index.pairs(4, found, every)
    assert (found.of == brute.of).all() and len(a) < 3 * len(fps)
    assert {level for level, _ in compared} == set(range(1, len(index.levels)))
    assert sum(n for level, n in compared if level == 1) * simhash.FAN**2 < len(fps) ** 2 / 4
    # all pairs, exactly
    x, y = simhash.GrayIndex(np.zeros(len(fps), np.int64), fps[:, None]).pairs(4, Classes(len(fps)), every, whole=True)
    assert {(min(p), max(p)) for p in zip(x.tolist(), y.tolist(), strict=True)} == pairs


def test_hierarchy_of_many_small_nodes_and_two_words():
    rng = np.random.default_rng(6)
    node = rng.integers(0, 150, 900)
    fps = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)[rng.integers(0, 40, 900)]
    fps = fps ^ (np.uint64(1) << rng.integers(0, 64, (900, 2)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (900, 2)).astype(np.uint64))
    x, y = simhash.GrayIndex(node, fps).pairs(6, Classes(900), np.arange(900), whole=True, most=64)
    near = lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= 6
    want = {(i, j) for i in range(900) for j in range(i + 1, 900) if node[i] == node[j] and near(i, j)}
    assert {(min(p), max(p)) for p in zip(x.tolist(), y.tolist(), strict=True)} == want and len(x) == len(want)


def test_majority_of_very_many_hashes():
    rng = np.random.default_rng(7)
    h, of = rng.integers(0, 1 << 63, 3000, dtype=np.uint64), np.repeat([0, 2, 3], [1, 2500, 499])
    got = simhash.majority(h, of, 5)
    for t in range(5):
        own = h[of == t]
        assert int(got[t]) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in own) > len(own))


def test_nodes_are_read_in_bounded_runs():
    import pyarrow as pa

    node = np.repeat(np.arange(50), 7)
    batches = [pa.RecordBatch.from_arrays([pa.array(node[i : i + 10]), pa.array(np.arange(350)[i : i + 10])], ["node", "x"]) for i in range(0, 350, 10)]
    runs = list(simhash.by_node(iter(batches), 30))
    assert [x for r in runs for x in r[1]] == list(range(350)) and len(runs) > 5
    assert not any(set(a[0]) & set(b[0]) for i, a in enumerate(runs) for b in runs[i + 1 :])


def test_masks_leave_no_close_pair_apart():
    rng, masks = random.Random(2), simhash.masks(4)
    assert len(masks) == 15
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(500, 501), (7, 7)]
    for held in (0, 20, 1000):
        roots = {}
        for r in components(spark.createDataFrame(links, "a long, b long"), held=held).collect():
            roots.setdefault(r.root, set()).add(r.node)
        assert sorted(map(len, roots.values())) == [2, 40, 61]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spanning_links_join_the_same_nodes_and_are_few(spark):
    rng = random.Random(4)
    dense = [(rng.randrange(a, a + 40), rng.randrange(a, a + 40)) for a in (0, 100, 200) for _ in range(600)] + [(300 + i, 301 + i) for i in range(30)]
    given = {frozenset(x) for x in dense}

    def groups(rows):
        out = {}
        for r in rows:
            out.setdefault(r.root, set()).add(r.node)
        return {frozenset(x) for x in out.values()}

    links = spark.createDataFrame(dense, "a long, b long")
    for held in (0, 50, 10000):
        roots, tree = spanned(links, held=held)
        taken = [(r.a, r.b) for r in tree.collect()]
        assert {frozenset(x) for x in taken} <= given
        assert groups(roots.collect()) == groups(components(links).collect()) == groups(components(tree).collect())
        assert len(taken) <= 2 * 151
    roots, tree = spanned(spark.createDataFrame([], "a long, b long"))
    assert roots.count() == tree.count() == 0


def test_dedup_keeps_one_row_of_each_group(spark):
    docs = frame(spark, clash=True)
    out = simhash.dedup(docs)
    assert out.columns == docs.columns
    rows = documents()
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(grouped([(r[0], fingerprint(r[1])) for r in rows])))
    assert simhash.dedup(frame(spark, [])).count() == 0


def test_null_ids_name_a_group_and_stay_last(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text, "en", "s", 1), (5, text, "en", "s", 2), (3, text, "en", "s", 3), (3, text, "de", "s", 3), (None, "other", "en", "s", 1)], SCHEMA)
    assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str) == [(3, 3), (3, 3), (5, 3), (None, 3), (None, None)]
    for _ in range(2):
        assert sorted((str(r.doc_id), r.n_chars) for r in simhash.dedup(docs.repartition(4)).collect()) == [("3", 3), ("None", 1)]
