"""SimHash near-duplicates (operator 3) on a Gray-order hierarchical index.

A fingerprint has, for each of its bits, the majority of the hashes of the text's word shingles.  Two uses share the index:

* `near_duplicates`: 64 bits of XXH64; distinct fingerprints are linked when at most `bits` bits differ.
* near.py (the pipeline's stage): 128 bits; pairs within a distance are candidates that the sets of shingles confirm.

The index is one hierarchy of masked patterns.  Its top are patterns of a few bits that many members share and that Spark deals
out: for `near_duplicates` the 64 bits are cut into `bits + 2` blocks, and two fingerprints within `bits` agree on two of
them at least, so each stands under one node for each pair of blocks (15 for 4 bits).  Under a top node members are sorted by
Gray rank, so that neighbours share long patterns; every FAN neighbours are factored into a node with the mask of bits on
which all of them agree and the pattern there, FAN of those into the next, up to the top node.  `GrayIndex.pairs` goes down from
all top nodes of a task at once.  Two nodes are compared on the bits that both fix and their parents did not; differences
accumulate on the way, and beyond the limit the whole pair of groups is pruned.  Groups that are known to be one class already are passed
over, a group whose members cannot differ by more than the limit is linked as a star, and only a spanning set of links leaves a
task: a node with many near copies neither compares nor emits all of its pairs.

Tasks read nodes in order and hold a bounded run of them.  Components are joined in Spark (components.py); copies share a
fingerprint and are never expanded.

Defined results: null and empty texts have fingerprint zero and are linked like others; a text with fewer words than a
shingle is one shingle; very long texts are hashed whole; repeated rows and ids are grouped like others; the smallest doc_id
names a component, null only if there is no other; an empty table gives an empty result.  `dedup` keeps of each group the row
of the smallest doc_id (null last), of the smallest hash of all columns among those; of rows equal in all columns one.
Other columns are ignored, and pass through `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORD_BYTE, Kept, chunks, fresh, owner, per_text, row_mark, runs, table, written
from .components import Classes, components

SHINGLE, BITS, SEED = 4, 4, 42
#: Children of a node of the hierarchy.
FAN = 4
#: Members of the top nodes that a task holds at a time (a node is never split).
HELD = 1 << 20
#: Each byte with its bits spread over eight bytes.
LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).copy().view("<u8").reshape(-1)


def majority(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Of each of n texts, the bits that are set in over half of its hashes h (of: their texts, in order)."""
    count = per_text(n, of)
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    # sums by byte lanes over runs of at most 255 hashes of a text, then over the runs
    place = np.arange(len(h)) - (np.cumsum(count) - count)[of]
    head = np.flatnonzero(place % 255 == 0)
    own = of[head]
    text = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.zeros((len(text), 64), np.uint8)
    for k in range(8):
        lanes = np.add.reduceat(LANES[raw[:, k]], head).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes, text, axis=0, dtype=np.int64)
        bits[:, 8 * k : 8 * k + 8] = 2 * ones > count[own[text]][:, None]
    out[own[text]] = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text of a chunk."""
    n = len(offsets) - 1
    buf = LOWER[buf]
    mask = WORD_BYTE[buf]
    starts, ends = runs(mask, offsets)
    doc, size = owner(offsets, starts), ends - starts
    words = len(starts)
    # the words with one space after each
    flat = np.full(int(size.sum()) + words, 32, np.uint8)
    flat[np.arange(int(size.sum())) + np.repeat(np.arange(words), size)] = buf[mask]
    end = np.cumsum(size + 1) - 1
    start = end - size
    raw = flat.tobytes()
    count = per_text(n, doc)
    first = np.cumsum(count) - count
    shingles = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
    of = np.repeat(np.arange(n), shingles)
    at = np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[of]
    last = np.minimum(at + shingle, first[of] + count[of]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(start[at].tolist(), end[last].tolist(), strict=True)), np.uint64, len(at))
    return majority(h, of, n)


def _fingerprinted(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints(buf, offsets, shingle) for _, _, buf, offsets in chunks(batch.column(0))]
            found = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.astype(np.int64))], [*batch.schema.names[1:], "fp"])

    return run


def fingerprinted(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """docs' columns `keep` with the fingerprint fp as a signed long."""
    kept = Kept(docs, keep, ("fp", "component_id"))
    return docs.select("text", *kept.columns).mapInArrow(_fingerprinted(shingle), f"{kept.kinds}fp long").select(*kept.back, "fp")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray code."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def gray_ranks(fps: np.ndarray) -> list[np.ndarray]:
    """The rank of codes of several words (the last column highest) as words, lowest first."""
    out, odd = [], np.zeros(len(fps), np.uint64)
    for k in range(fps.shape[1] - 1, -1, -1):
        rank = gray_rank(fps[:, k]) ^ (np.uint64(0) - odd)
        odd = rank & np.uint64(1)
        out.append(rank)
    return out[::-1]


def bits_of(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


class GrayIndex:
    """The hierarchy under top nodes: levels of (mask, pattern, first leaf, end of leaves, first child, children), the leaves first.

    fps has a row of 64-bit words for each member; a member may stand under several nodes.
    """

    def __init__(self, node: np.ndarray, fps: np.ndarray):
        self.order = np.lexsort((*gray_ranks(fps), node))
        node, pattern = node[self.order], fps[self.order]
        self.width = 64 * fps.shape[1]
        mask, first = np.full(pattern.shape, ~np.uint64(0)), np.arange(len(node))
        end, child, children = first + 1, first, np.zeros(len(node), np.int64)
        self.levels, self.roots = [], []
        while True:
            self.levels.append((mask, pattern, first, end, child, children))
            new = np.r_[True, node[1:] != node[:-1]] if len(node) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            size = np.diff(np.r_[head, len(node)])
            each = np.repeat(size, size)
            self.roots.append(np.flatnonzero(each == 1))
            up = np.flatnonzero(each > 1)
            if not len(up):
                return
            place = (np.arange(len(node)) - np.repeat(head, size))[up]
            head = np.flatnonzero(place % FAN == 0)
            both, either = (f.reduceat(pattern[up], head, axis=0) for f in (np.bitwise_and, np.bitwise_or))
            mask = np.bitwise_and.reduceat(mask[up], head, axis=0) & ~(both ^ either)
            pattern, children = both & mask, np.diff(np.r_[head, len(up)])
            child, first, end, node = up[head], first[up][head], end[up][head + children - 1], node[up][head]

    def pairs(self, bits: int, classes: Classes, member: np.ndarray, whole: bool = False, allowed=None, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """Members of different classes within `bits` of each other: a spanning set of links, which joins the classes, or all (whole).

        allowed(x, y) may rule out some of the pairs of members.
        """
        own = member[self.order]
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def found(x: np.ndarray, y: np.ndarray) -> None:
            x, y = own[x], own[y]
            if whole or allowed is not None:
                at = np.flatnonzero(classes.of[x] != classes.of[y])
                x, y = x[at], y[at]
            if allowed is not None and len(x):
                at = np.flatnonzero(allowed(x, y))
                x, y = x[at], y[at]
            if not whole:
                at = classes.span(x, y)
                x, y = x[at], y[at]
            out.append((x, y))

        stack = [(level, r, r, np.zeros(len(r), np.int64)) for level, r in enumerate(self.roots) if level and len(r)]
        while stack:
            level, a, b, apart = stack.pop()
            mask, _, first, end, child, children = self.levels[level]
            if not whole and allowed is None:
                tight = a[(a == b) & (self.width - bits_of(mask[a]) <= bits)]
                size = end[tight] - first[tight]
                if len(tight):
                    center = np.repeat(first[tight], size - 1)
                    found(center, center + 1 + np.arange(len(center)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1))
            entry = np.unique(np.r_[a, b])
            of = np.r_[classes.of[own], 0]
            ends = np.stack([first[entry], end[entry]], axis=1).reshape(-1)
            low, high = (f.reduceat(of, ends)[::2] for f in (np.minimum, np.maximum))
            x, y = np.searchsorted(entry, a), np.searchsorted(entry, b)
            open_ = (low[x] != high[x]) | (low[y] != high[y]) | (low[x] != low[y])
            a, b, apart = a[open_], b[open_], apart[open_]
            size = children[a] * children[b]
            cuts = np.searchsorted(np.cumsum(size), np.arange(most, size.sum() + most, most)) + 1 if len(a) else []
            start = 0
            for stop in cuts:
                stop = min(int(stop), len(a))
                if stop > start:
                    self._expanded(level, a[start:stop], b[start:stop], apart[start:stop], bits, stack, found)
                start = stop
        x, y = (np.concatenate([p[i] for p in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
        return x, y

    def _expanded(self, level, a, b, apart, bits, stack, found) -> None:
        """Compare the children of pairs of nodes; those that stay near are found, or wait on the stack."""
        mask, _, _, _, child, children = self.levels[level]
        wide = children[b]
        size = children[a] * wide
        up = np.repeat(np.arange(len(a)), size)
        k = np.arange(len(up)) - np.repeat(np.cumsum(size) - size, size)
        x, y = child[a][up] + k // wide[up], child[b][up] + k % wide[up]
        ok = (a[up] != b[up]) | ((x <= y) if level > 1 else (x < y))
        x, y, up = x[ok], y[ok], up[ok]
        below, pattern = self.levels[level - 1][:2]
        # accumulate: only bits that the parents had left open
        fresh_bits = below[x] & below[y] & ~(mask[a] & mask[b])[up]
        apart = apart[up] + bits_of((pattern[x] ^ pattern[y]) & fresh_bits)
        near = apart <= bits
        if level == 1:
            found(x[near], y[near])
        elif near.any():
            stack.append((level - 1, x[near], y[near], apart[near]))


def masks(bits: int = BITS) -> list[int]:
    """The masks of the top nodes: each pair of bits + 2 blocks of the 64 bits."""
    cuts = [round(64 * i / (bits + 2)) for i in range(bits + 3)]
    block = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [x | y for x, y in combinations(block, 2)]


def signed(x: int):
    """A literal of 64 bits."""
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def by_node(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[list[np.ndarray]]:
    """The columns of runs of whole nodes (column 0, in order), about `held` rows at a time."""
    kept: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        if rows >= held:
            cut = int(np.argmax(cols[0] != kept[-1][0][-1])) if cols[0][-1] != kept[-1][0][-1] else -1
            if cut >= 0:
                kept.append([c[:cut] for c in cols])
                yield [np.concatenate(x) for x in zip(*kept, strict=True)]
                cols, kept, rows = [c[cut:] for c in cols], [], 0
        kept.append(cols)
        rows += len(cols[0])
    if kept:
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]


def linked(node: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links among fingerprints under the same top node."""
    distinct, member = np.unique(fps, return_inverse=True)
    a, b = GrayIndex(node, fps[:, None]).pairs(bits, Classes(len(distinct)), member)
    return distinct[a], distinct[b]


def _linked(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, fps in by_node(batches):
            a, b = linked(node, fps.astype(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])

    return run


def classes_of(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of prints (doc_id, fp)."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    nodes = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(signed(m)).alias("pattern")) for i, m in enumerate(masks(bits))))
    under = distinct.select("fp", F.explode(nodes).alias("x")).select(F.xxhash64("x.i", "x.pattern").alias("node"), "fp")
    links = under.repartition("node").sortWithinPartitions("node").mapInArrow(_linked(bits), "a long, b long")
    found = components(links)
    joined = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """docs' columns `keep` with fp and component_id, the smallest doc_id that can be reached by links."""
    prints = written(fingerprinted(docs, keep or ["doc_id"], shingle), "prints")
    return prints.join(classes_of(prints, bits), "fp")


def one_of_each(docs: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """docs with one row of each group; groups has doc_id, mark (row_mark) and the group `by` of each row of docs."""
    best = groups.groupBy(by).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("best"))
    a, b = fresh(docs, "__id"), fresh(docs, "__mark")
    stay = best.select(F.col("best.doc_id").alias(a), F.col("best.mark").alias(b))
    out = docs.join(stay, F.col("doc_id").eqNullSafe(F.col(a)) & (row_mark(docs) == F.col(b)), "left_semi")
    if groups.groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        return out
    return out.dropDuplicates(["doc_id", "text"])  # rows equal in all columns


def dedup(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of each component."""
    rows = docs.select("doc_id", "text", row_mark(docs).alias("mark"))
    return one_of_each(docs, written(near_duplicates(rows, ["doc_id", "mark"], shingle, bits), "near"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
