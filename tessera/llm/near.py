"""Near copies of the pipeline (operator 3 with its exact check): SimHash candidates from the Gray-order index, confirmed by sets.

Texts are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or more.  A fingerprint has two words of 64
bits, each bit the majority of the set's hashes.  At a similarity of 0.8 a bit differs with a probability of about 0.15, so
20 of 128 do (deviation 4): candidates are pairs that differ in at most DISTANCE.  Top nodes of the index are masked patterns of
`width` bits drawn over both words: `width` grows with the logarithm of the number of sets, so that chance meetings under a
node stay few, and the number of masks with it, so that a pair at the threshold misses all of them with a probability of MISS
at most (`plan`).  So the search is by chance in this alone; recall against comparing all pairs is measured in the tests.

Equal sets are one member, named by a hash of the set.  Each task sends a spanning set of its candidate links; of all of these
as many as the members need to hang together (`spanned`) are confirmed on the whole sets, however many tasks have seen a group.  If all are, the confirmed classes are those of all candidates.  Else, among members that a failed link
touches through candidates, the index is asked again across the confirmed classes: for other spanning links, and at last for
all pairs, so that no candidate that could join two classes is left out.  In these searches members also carry the parities
of their shingles by hash in PARITY bits.  As many bits as differ, so many shingles at least are in one set only, and more are likely by
a known law; so nearly all pairs of a group of near copies that are not similar enough are ruled out within the task.

Defined results: words as in simhash.py; a text of fewer words than a shingle is one shingle; null and empty texts are
equal; very long texts are read whole; which row stays of a group is as in simhash.py; an empty table gives an empty result;
other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD_BYTE, chunks, mix, owner, per_text, prefix_hash, row_mark, runs, span_hash, written
from .components import Classes, components, spanned
from .simhash import GrayIndex, by_node, majority, one_of_each

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of 128 in which candidates may differ: three deviations above the mean at the threshold.
DISTANCE = 32
#: Share of pairs at the threshold that no top node may bring together.
MISS = 0.005
#: Residues by which sets that are no candidate's are left out.
ASKED = 1 << 24
#: Searches for spanning links before all pairs across classes are checked.
SEARCHES = 3
#: Bits of a set's parities, and how far (four deviations at most) more of them may differ than is likely at the threshold.
PARITY, SLACK = 1024, 64


def plan(members: int) -> tuple[int, int]:
    """Bits of a mask and number of masks for so many sets."""
    width = max(16, math.ceil(math.log2(max(members, 2))) - 2)
    agree = 1 - math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    return width, math.ceil(math.log(MISS) / math.log(1 - agree**width))


def masks(width: int, count: int) -> list[tuple[int, int]]:
    """Masks of `width` of the 128 bits as two words each."""
    rng = np.random.default_rng(20240607)
    chosen = [sum(1 << int(b) for b in rng.choice(128, width, replace=False)) for _ in range(count)]
    return [(x & (1 << 64) - 1, x >> 64) for x in chosen]


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text of a chunk as 64-bit hashes, and the text of each; by text, then by hash."""
    n = len(offsets) - 1
    buf = LOWER[buf]
    starts, ends = runs(WORD_BYTE[buf], offsets)
    doc, words = owner(offsets, starts), span_hash(prefix_hash(buf), starts, ends)
    count = per_text(n, doc)
    each = np.where(count == 0, 0, np.maximum(count - SHINGLE + 1, 1))
    of = np.repeat(np.arange(n), each)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    at, left = nth + (np.cumsum(count) - count)[of], count[of] - nth
    key = np.zeros(len(of), np.uint64)
    for k in range(SHINGLE):
        some = np.flatnonzero(left > k)
        key[some] = mix(key[some] * np.uint64(5) + words[at[some] + k])
    by = np.lexsort((key, of))
    key, of = key[by], of[by]
    new = np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])] if len(key) else np.zeros(0, bool)
    return key[new], of[new]


def described(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """shingles() with the hash and the size of each text's set."""
    key, of = shingles(buf, offsets)
    size = per_text(len(offsets) - 1, of)
    sums = np.r_[np.uint64(0), np.cumsum(mix(key), dtype=np.uint64)]
    end = np.cumsum(size)
    return key, of, mix(sums[end] - sums[end - size] + size.astype(np.uint64)), size


def parities(key: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """(n, PARITY / 64): a bit for each residue of the hashes, set if an odd number of a text's shingles has it."""
    cell, times = np.unique(of * PARITY + (key >> np.uint64(40)).astype(np.int64) % PARITY, return_counts=True)
    flat = np.zeros(n * PARITY, np.uint8)
    flat[cell[times % 2 == 1]] = 1
    return np.packbits(flat.reshape(n, PARITY), axis=1, bitorder="little").view("<u8")


def similar(size: np.ndarray, bits: np.ndarray):
    """Which pairs of members sizes and parities allow to be similar enough."""

    def allowed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, m = size[x], size[y]
        ok = near(np.minimum(n, m), n, m)
        at = np.flatnonzero(ok)
        apart = np.zeros(len(at), np.int64)
        for k in range(PARITY // 64):
            apart += np.bitwise_count(bits[x[at], k] ^ bits[y[at], k])
        most = (n[at] + m[at]) / 9  # shingles of one set only
        ok[at] = apart <= np.minimum(most, PARITY / 2 * (1 - np.exp(-2 * most / PARITY)) + SLACK)
        return ok

    return allowed


def long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark) with the set's hash, its size, the fingerprint's two words and the set's parities."""
    for batch in batches:
        for i, j, buf, offsets in chunks(batch.column(0)):
            key, of, sig, size = described(buf, offsets)
            low, high = majority(key, of, j - i), majority(mix(key + np.uint64(1)), of, j - i)
            yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), long(sig), long(size), long(low), long(high), pa.array([b.tobytes() for b in parities(key, of, j - i)], pa.binary())], [*batch.schema.names[1:], "sig", "size", "f0", "f1", "bits"])


def near(shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m with so many shared have a similarity of 0.8 or more."""
    return 9 * shared >= 4 * (n + m)


def _under(top: list[tuple[int, int]]):
    """Members once for each top node they stand under, named by a hash of the mask's number and the pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f0, f1 = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.uint64) for c in ("f0", "f1"))
            for i, (x, y) in enumerate(top):
                node = mix((f0 & np.uint64(x)) + mix((f1 & np.uint64(y)) + np.uint64(i)))
                yield pa.RecordBatch.from_arrays([long(node), *batch.columns], ["node", *batch.schema.names])

    return run


def _candidates(whole: bool):
    """Candidate links (a, b) among members of different classes under the same top nodes: a spanning set, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, sig, f0, f1, *rest in by_node(batches):
            member, row, which = np.unique(sig, return_index=True, return_inverse=True)
            classes, allowed = Classes(len(member)), None
            if rest:  # (size, bits, root): some are one class already
                size, bits, root = (x[row] for x in rest)
                allowed = similar(size, np.frombuffer(b"".join(bits), "<u8").reshape(-1, PARITY // 64))
                _, least, of = np.unique(root, return_index=True, return_inverse=True)
                classes.join(np.arange(len(member)), least[of])
            x, y = GrayIndex(node, np.stack([f0, f1], axis=1).astype(np.uint64)).pairs(DISTANCE, classes, which, whole, allowed)
            yield pa.RecordBatch.from_arrays([long(member[x]), long(member[y])], ["a", "b"])

    return run


def candidates(members: DataFrame, top: list[tuple[int, int]], whole: bool) -> DataFrame:
    """Candidate pairs (a, b) of members (sig, f0, f1, and size, bits and root where some are one class), written: those that span them, or all."""
    under = members.mapInArrow(_under(top), "node long, " + ", ".join(f"{c} {kind}" for c, kind in members.dtypes))
    found = under.repartition("node").sortWithinPartitions("node").mapInArrow(_candidates(whole), "a long, b long")
    if not whole:
        return spanned(found)[1]
    return written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def _sets(asked):
    """(sig, keys): the whole set of each text whose hash is among the asked residues."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in chunks(batch.column(0)):
                key, _, sig, size = described(buf, offsets)
                end = np.cumsum(size)
                once = np.unique(sig, return_index=True)[1]
                once = once[asked.value[(sig[once] % np.uint64(ASKED)).astype(np.int64)]]
                yield pa.RecordBatch.from_arrays([long(sig[once]), pa.array([key[end[t] - size[t] : end[t]].tobytes() for t in once], pa.binary())], ["sig", "keys"])

    return run


def sets(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(sig, keys) of the members of pairs, and of few others; texts are not dealt out, only their sets."""
    own = pairs.select(F.col("a").alias("sig")).union(pairs.select("b"))
    found = own.select(F.expr(f"cast(pmod(sig, {ASKED}L) as int)").alias("x")).distinct().toArrow()["x"].to_numpy()
    asked = np.zeros(ASKED, bool)
    asked[found] = True
    held = docs.sparkSession.sparkContext.broadcast(asked)
    return written(docs.select("text").mapInArrow(_sets(held), "sig long, keys binary").dropDuplicates(["sig"]), "sets")


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            ok.append(bool(near(np.intersect1d(x, y, assume_unique=True).size, len(x), len(y))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with ok, whether the whole sets confirm them; written."""
    x, y = (sets.select(F.col("sig").alias(c), F.col("keys").alias(f"keys_{c}")) for c in "ab")
    met = pairs.join(x, "a").join(y, "b").select("a", "b", "keys_a", "keys_b")
    return written(met.mapInArrow(_confirmed, "a long, b long, ok boolean"), "confirmed")


def classes(signed_docs: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of the members that are linked with others."""
    members = written(signed_docs.where("size > 0").dropDuplicates(["sig"]).select("sig", "f0", "f1", "size", "bits"), "members")
    top = masks(*plan(members.count()))
    live, links, whole_sets = members.select("sig", "f0", "f1"), None, None
    for search in range(SEARCHES + 1):
        whole = search == SEARCHES
        pairs = candidates(live, top, whole)
        if whole_sets is None:  # later searches are among the same members
            whole_sets = sets(pairs, docs)
        judged = confirmed(pairs, whole_sets)
        links = judged if links is None else links.unionByName(judged)
        roots = components(links.where("ok").select("a", "b"))
        if whole or judged.where("not ok").isEmpty():
            return roots
        # what hangs together with a failed link by candidates of any outcome
        met = components(links.select("a", "b"))
        failed = judged.where("not ok").select(F.col("a").alias("node")).join(met, "node").select("root").distinct()
        dirty = met.join(failed, "root", "left_semi").select(F.col("node").alias("sig"))
        known = dirty.join(roots.withColumnRenamed("node", "sig"), "sig", "left")
        live = written(members.join(known, "sig").select(*members.columns, F.coalesce("root", "sig").alias("root")), "live")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies."""
    rows = docs.select("text", "doc_id", row_mark(docs).alias("mark"))
    found = written(rows.mapInArrow(_signed, f"doc_id {dict(docs.dtypes)['doc_id']}, mark long, sig long, size long, f0 long, f1 long, bits binary"), "signed")
    roots = classes(found, rows)
    named = found.select("doc_id", "mark", "sig").join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    return one_of_each(docs, named.select("doc_id", "mark", F.coalesce("root", "sig").alias("root")), "root")
