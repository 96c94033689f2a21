"""Benchmark decontamination (operator 10) by training suffix arrays.

Each shard (a chunk of whole training texts) gets a suffix array over its words: the start of every word, sorted by all the
words that follow (by prefix doubling, until no two suffixes are alike or as far as the longest item reaches).  Every
suffix of every test item is binary-searched in every shard, one word after another as far as it matches; on the way its range at the
window's length gives the locations of its windows.  At each location the match is followed to its end, so every document
gets its longest verbatim match with any one item.  Benchmarks are sent in blocks of bounded size; a larger one is searched
block by block, so neither side is ever shuffled or held whole.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased, compared by 64-bit hashes.  An item's windows are
its runs of 10 words, or the whole item if it has fewer (none if it has no word).

Defined results: null and empty texts have no words, so no hits; repeated items and rows each count; an item id that
repeats counts once; a match shorter than a window (or than the whole item, if that has fewer words) is none; very long texts
are a shard of their own; an empty benchmark leaves every document clean; other columns are ignored, and pass through `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_BYTE, LOWER, Kept, chunks, column, owner, per_text, prefix_hash, runs, span_hash, strings, table

WINDOW = 10
#: Bytes of benchmark text in a broadcast block.
BLOCK_BYTES = 16 << 20
FOUND = ("found_words", "found_mask", "found_items", "found_longest")


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word."""
    buf = LOWER[buf]
    starts, ends = runs(ALNUM_BYTE[buf], offsets)
    return span_hash(prefix_hash(buf), starts, ends), owner(offsets, starts)


class SuffixArray:
    """The word suffixes of a chunk of texts in order, none beyond its text; words beyond `depth` don't count."""

    def __init__(self, hashes: np.ndarray, texts: np.ndarray, depth: int):
        self.known, ids = np.unique(hashes, return_inverse=True)
        n = len(ids)
        # the words with a 0 after each text, and 0s to read beyond the end
        self.place = np.arange(n) + texts
        self.words = np.zeros((self.place[-1] if n else 0) + 2 * depth + 2, np.int64)
        self.words[self.place] = ids + 1
        rank, width = self.words[: len(self.words) - depth].copy(), 1
        live = np.flatnonzero(rank)  # suffixes that are not alone with their first words yet
        while width < depth and len(live):
            after = np.zeros(len(live), np.int64)
            inside = live + width < len(rank)
            after[inside] = rank[live[inside] + width]
            by = np.lexsort((after, rank[live]))
            first, second = rank[live][by], after[by]
            new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
            head = np.r_[True, first[1:] != first[:-1]]
            # a rank is the number of smaller suffixes and so leaves room for those that part later
            start = first[head][np.cumsum(head) - 1] if width > 1 else None
            if start is None:
                place = np.arange(1, len(live) + 1)
            else:
                place = start + np.arange(len(live)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            fresh = place[np.flatnonzero(new)[np.cumsum(new) - 1]]
            rank[live[by]] = fresh
            alone = new & np.r_[new[1:], True]
            live = live[by][~alone]
            width *= 2
        self.order = np.argsort(rank, kind="stable")
        self.order = self.order[self.words[self.order] > 0]

    def search(self, suffixes: Suffixes, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct suffix: how many of its words match in a row at most, and the range of suffixes that match its first
        `window` words (empty if none)."""
        n = len(suffixes.start)
        low, high, longest = np.zeros(n, np.int64), np.full(n, len(self.order)), np.zeros(n, np.int64)
        at_window = np.zeros((2, n), np.int64)
        live, k = np.arange(n), 0
        while True:
            live = live[suffixes.size[live] > k]
            if not len(live) or not len(self.known):
                return longest, *at_window
            h = suffixes.hashes[suffixes.start[live] + k]
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            there = self.known[at] == h
            live, word = live[there], at[there] + 1
            ends = []
            for right in (False, True):
                a, b = low[live].copy(), high[live].copy()
                while (open_ := a < b).any():
                    m = (a + b) >> 1
                    w = self.words[self.order[np.minimum(m, len(self.order) - 1)] + k]
                    up = open_ & ((w <= word) if right else (w < word))
                    a, b = np.where(up, m + 1, a), np.where(open_ & ~up, m, b)
                ends.append(a)
            found = ends[0] < ends[1]
            live, k = live[found], k + 1
            low[live], high[live], longest[live] = ends[0][found], ends[1][found], k
            full = live[window[live] == k]
            at_window[0, full], at_window[1, full] = low[full], high[full]

    def extended(self, at: np.ndarray, suffixes: Suffixes, which: np.ndarray, known: np.ndarray) -> np.ndarray:
        """How many words from `at` on are those of the suffixes `which`; the first `known` are."""
        size, live = known.copy(), np.arange(len(at))
        while True:
            live = live[size[live] < suffixes.size[which[live]]]
            if not len(live):
                return size
            word, h = self.words[at[live] + size[live]], suffixes.hashes[suffixes.start[which[live]] + size[live]]
            live = live[(word > 0) & (self.known[np.maximum(word, 1) - 1] == h)]
            size[live] += 1


class Suffixes:
    """Every suffix of every item: where it starts in the hashes of all words, its words, and its item."""

    def __init__(self, items: list[tuple[str, str | None]]):
        hashes, self.item = words(*strings(pa.array([x for _, x in items], pa.large_string())))
        self.hashes = hashes
        n = len(hashes)
        count = per_text(len(items), self.item)
        self.start = np.arange(n)
        self.size = np.cumsum(count)[self.item] - self.start if n else np.zeros(0, np.int64)
        self.words = count[self.item] if n else np.zeros(0, np.int64)


def _searched(items: list[tuple[str, str | None]], window: int):
    """A pass over texts and what earlier blocks found: adds the words hit, the items found and the longest match."""
    suffixes = Suffixes(items)
    need = np.minimum(suffixes.words, window)
    deepest = int(suffixes.size.max()) if len(suffixes.size) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in chunks(batch.column(0)):
                hashes, text = words(buf, offsets)
                index = SuffixArray(hashes, text, deepest)
                _, low, high = index.search(suffixes, need)
                full = np.flatnonzero(low < high)
                n = high[full] - low[full]
                which = np.repeat(full, n)
                at = index.order[np.repeat(low[full] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(full) else np.zeros(0, int)
                marks = np.zeros(len(index.words) + 1, np.int64)
                np.add.at(marks, at, 1)
                np.add.at(marks, at + need[which], -1)
                hit = np.cumsum(marks)[index.place] > 0 if len(text) else np.zeros(0, bool)
                own = text[np.searchsorted(index.place, at)] if len(at) else at
                found: dict[int, set[str]] = {}
                for t, x in np.unique(np.c_[own, suffixes.item[which]], axis=0).tolist() if len(at) else ():
                    found.setdefault(t, set()).add(items[x][0])
                best = np.zeros(j - i, np.int64)
                np.maximum.at(best, own, index.extended(at, suffixes, which, need[which]))
                n_words = per_text(j - i, text)
                where = np.r_[0, np.cumsum(n_words)]
                masks, names, most = ([x.as_py() for x in batch.column(c).slice(i, j - i)] for c in (2, 3, 4))
                for t, ids in found.items():
                    mask = np.packbits(hit[where[t] : where[t + 1]])
                    masks[t] = (mask | np.frombuffer(masks[t], np.uint8) if masks[t] else mask).tobytes()
                    names[t] = sorted(ids | set(names[t]))
                    most[t] = max(most[t], int(best[t]))
                new = [pa.array(n_words), pa.array(masks, pa.binary()), pa.array(names, pa.list_(pa.string())), pa.array(most, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *new, *(batch.column(c).slice(i, j - i) for c in range(5, batch.num_columns))], batch.schema.names)

    return run


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The items, in blocks of at most `most` bytes (an item is never split)."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if held and size + len(row[1] or "") > most:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += 4 * len(row[1] or "")
    yield held


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with found_words, found_mask (a bit for each word, 1: hit; empty: none), found_items and found_longest (words of the
    longest verbatim match with one item; 0 if it holds no window).

    Each block of the benchmark is one more pass over the texts within the same stage.
    """
    kept = Kept(docs, docs.columns, ("text", *FOUND))
    nothing = [F.lit(0).cast("long").alias("found_words"), F.lit(b"").alias("found_mask"), F.array().cast("array<string>").alias("found_items"), F.lit(0).cast("long").alias("found_longest")]
    out = docs.select("text", *nothing, *kept.columns)
    for items in blocks(benchmark, block_bytes):
        out = out.mapInArrow(_searched(items, window), out.schema)
    return out.select("text", *FOUND, *kept.back)


def clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs without those that hold a window of an item."""
    kept = Kept(docs, docs.columns, ("text",))
    found = matches(docs.select("text", *kept.columns), benchmark, **parameters).where(F.length("found_mask") == 0)
    return found.select("text", *kept.back).select(*map(column, docs.columns))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = F.aggregate(F.sequence(F.lit(1), F.length("found_mask")), F.lit(0), lambda n, i: n + F.bit_count(F.conv(F.hex(F.substring("found_mask", i, F.lit(1))), 16, 10).cast("int")))
    return found.select(
        "doc_id",
        F.col("found_words").alias("n_words"),
        F.when(F.length("found_mask") > 0, hits).otherwise(0).cast("long").alias("n_hit"),
        F.size("found_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found_items", ","), 256).alias("items_sha256"),
        (F.length("found_mask") > 0).alias("contaminated"),
        F.col("found_longest").alias("longest_match"),
    )


QUERIES = {"op10_decontaminate": op10_decontaminate}
