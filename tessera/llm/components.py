"""Connected components of a graph of links, by repeated contraction in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Links that one task may hold; as long as more are left, Spark contracts them.
HELD = 100_000


def _solved(witnessed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if held:
            a, b, *pair = (np.concatenate(x) for x in zip(*held, strict=True))
            node, at = np.unique(np.r_[a, b], return_inverse=True)
            classes = Classes(len(node))
            taken = classes.span(at[: len(a)], at[len(a) :])
            found = [pa.array(node), pa.array(node[classes.of])]
            if witnessed:  # the classes first, then the links taken
                none = pa.nulls(len(node), pa.int64()), pa.nulls(len(taken), pa.int64())
                yield pa.RecordBatch.from_arrays([*found, none[0], none[0]], ["node", "up", "p", "q"])
                found = [none[1], none[1], *(pa.array(x[taken]) for x in pair)]
            yield pa.RecordBatch.from_arrays(found, ["node", "up", "p", "q"][: len(found)])

    return run


def components(links: DataFrame, jumps: int = 3, held: int = HELD) -> DataFrame:
    """(node, root) of the nodes of links (a, b): nodes have the same root exactly if a chain of links joins them.

    Each round every node hooks onto its least neighbour, chains of hooks are shortened by jumps, and the links are
    renamed by them; links within a class vanish; what at most `held` links are left of is solved in one task.  Any such renaming keeps what is connected connected, so the loop
    ends with one root for each component, after a logarithmic number of rounds.  Each round's tables are written, so
    that a lost executor costs no earlier round.
    """
    return _contracted(links, jumps, held, False)[0]


def spanned(links: DataFrame, jumps: int = 3, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """components() of links of longs, and links (a, b) among them that join the same nodes.

    A link is taken where a node hooks onto another by it, so of a node at most one a round: however many links join a class,
    those taken are in proportion to its nodes.
    """
    return _contracted(links, jumps, held, True)


def _contracted(links: DataFrame, jumps: int, held: int, witnessed: bool) -> tuple[DataFrame, DataFrame | None]:
    """The roots, and the links taken if witnessed; a renamed link then carries one that it comes from as (p, q)."""
    pair = ["p", "q"] if witnessed else []
    live = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    live = written(live.select("a", "b", *(F.col(x).alias(y) for x, y in zip("ab", pair, strict=False))), "links")
    parents = tree = None
    while left := live.count():
        if left <= held:
            schema = "node long, up long, p long, q long" if witnessed else "node long, up long"
            hook = written(live.coalesce(1).mapInArrow(_solved(witnessed), schema), "hooks")
            new, hook = hook.where("p is not null") if witnessed else None, hook.where("node is not null").select("node", "up")
        else:
            both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), *pair))
            hook = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("b", *pair)).alias("low"))
            hook = written(hook.select("node", F.least("node", "low.b").alias("up"), *(f"low.{x}" for x in pair)), "hooks")
            new, hook = hook.where("up < node"), hook.select("node", "up")
            for _ in range(jumps):
                over = hook.select(F.col("node").alias("up"), F.col("up").alias("further"))
                hook = hook.join(over, "up").select("node", F.col("further").alias("up"))
            hook = written(hook, "hooks")
        if witnessed:
            new = new.select(F.col("p").alias("a"), F.col("q").alias("b"))
            tree = new if tree is None else tree.unionByName(new)
        if parents is None:
            parents = hook.select("node", F.col("up").alias("root"))
        else:
            step = hook.select(F.col("node").alias("root"), "up")
            parents = written(parents.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "parents")
        if left <= held:
            break
        a, b = hook.select(F.col("node").alias("a"), F.col("up").alias("x")), hook.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved = live.join(a, "a").join(b, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), *pair)
        if witnessed:
            moved = moved.groupBy("a", "b").agg(F.min(F.struct("p", "q")).alias("first")).select("a", "b", "first.p", "first.q")
        live = written(moved if witnessed else moved.distinct(), "links")
    if parents is None:
        parents = live.select(F.col("a").alias("node"), F.col("b").alias("root"))
        tree = live.select("a", "b")
    return parents, written(tree.distinct(), "tree") if witnessed else None


class Classes:
    """Classes of the numbers below n, joined by arrays of links."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while (self.of[self.of] != self.of).any():
                self.of = self.of[self.of]

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Join a with b; the places of links that suffice for it, at most one for each class and round."""
        at, chosen = np.arange(len(a)), []
        while True:
            x, y = self.of[a[at]], self.of[b[at]]
            apart = x != y
            at, x, y = at[apart], x[apart], y[apart]
            if not len(at):
                return np.concatenate(chosen) if chosen else at
            take = at[np.unique(np.unique(np.r_[x, y], return_index=True)[1] % len(at))]
            chosen.append(take)
            self.join(a[take], b[take])
