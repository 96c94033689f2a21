"""Graph algorithms as iterated joins and aggregations.

Edges come as (src, dst, w); each gives a DataFrame (id, value) with a row for each vertex.  A round's table is checkpointed to the shared
folder, so plans stay short and a lost executor costs no earlier round; one number a round comes back to the driver.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, at, buckets, dropped, looked_up, met, parted, settled, united


#: Edges that a partition holds at least, if there are more partitions than cores.
PART_EDGES = 300_000


def dealt(f):
    """Runs an algorithm with as many shuffle partitions as its edges fill, at most those that are set."""

    @wraps(f)
    def run(g: Graph, *args, **which) -> DataFrame:
        spark, key = g.spark, "spark.sql.shuffle.partitions"
        before = spark.conf.get(key)
        fill = max(spark.sparkContext.defaultParallelism, -(-g.e().count() // PART_EDGES))
        spark.conf.set(key, str(min(int(before), fill)))
        try:
            return f(g, *args, **which)
        finally:
            spark.conf.set(key, before)

    return run


def edges(g: Graph, direction: str = "outE", labels: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(src, dst, w) in the direction of travel; a missing weight is 0."""
    e = g.e(set(labels) if labels else None)
    w = F.coalesce(F.col(f"`{at(weight)}`").cast("double"), F.lit(0.0)) if weight and at(weight) in e.columns else F.lit(1.0)
    out = e.select("src", "dst", w.alias("w"))
    turned = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return {"outE": out, "inE": turned, "bothE": out.unionAll(turned)}[direction]


def summed(g: Graph, **which) -> DataFrame:
    """Edges, of parallel ones the sum, kept by their source."""
    e = edges(g, **which)
    return parted(e.repartition(buckets(g.spark), "src").groupBy("src", "dst").agg(F.sum("w").alias("w")), "src")


def ids(g: Graph) -> DataFrame:
    return g.v().select("id")


def name(g: Graph) -> DataFrame:
    """(id, name): the external id of each vertex as a string."""
    v = g.v()
    return v.select("id", (F.coalesce(F.col("uid"), F.col("id").cast("string")) if "uid" in v.columns else F.col("id").cast("string")).alias("name"))


@dealt
def page_rank(g: Graph, alpha: float = 0.85, rounds: int = 20, epsilon: float = 1e-5, **which) -> DataFrame:
    """Ranks that sum to 1; a vertex without edges out hands its rank to all."""
    e = summed(g, **which)
    v = ids(g)
    n = v.count()
    # what a vertex sends in all; nothing if that is not positive
    out = e.groupBy("src").agg(F.sum("w").alias("out")).where("out > 0")
    rank = parted(met(v, out, F.col("id") == F.col("src"), "left").select("id", "out", F.lit(1.0 / max(n, 1)).alias("r")), "id")
    for _ in range(rounds):
        lost = rank.agg(F.sum((1 - alpha) * F.col("r")).alias("t"), F.sum(F.when(F.col("out").isNull(), alpha * F.col("r"))).alias("s")).first()
        base = ((lost["t"] or 0.0) + (lost["s"] or 0.0)) / max(n, 1)
        got = looked_up(e, rank.where("out is not null"), F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(alpha * F.col("r") * (F.col("w") / F.col("out"))).alias("m"))
        new = parted(met(rank, got, F.col("id") == F.col("dst"), "left").select("id", "out", (F.lit(base) + F.coalesce("m", F.lit(0.0))).alias("r")), "id")
        moved = 0.0 if epsilon <= 0 else met(new, rank.select("id", F.col("r").alias("old")), "id").agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] or 0.0
        dropped(rank)
        rank = new
        if moved < epsilon:
            break
    return rank.select("id", F.col("r").alias("value"))


@dealt
def article_rank(g: Graph, alpha: float = 0.85, rounds: int = 20, tolerance: float = 1e-7, **which) -> DataFrame:
    """Each vertex passes on what it gained, by its degree and the mean degree together."""
    e = summed(g, **which)
    v = ids(g)
    n = max(v.count(), 1)
    mean = (e.agg(F.sum("w")).first()[0] or 0.0) / n
    out = e.groupBy("src").agg(F.sum("w").alias("out"))
    state = parted(met(v, out, F.col("id") == F.col("src"), "left").select("id", "out", F.lit(1 - alpha).alias("score"), F.lit(1 - alpha).alias("delta")), "id")
    for _ in range(rounds):
        sends = state.where(F.col("delta") > tolerance).where("out is not null").select("id", "out", "delta")
        got = looked_up(e, sends, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(alpha * F.col("delta") * (F.col("w") / (F.col("out") + mean))).alias("m"))
        gain = F.coalesce("m", F.lit(0.0))
        new = parted(met(state, got, F.col("id") == F.col("dst"), "left").select("id", "out", (F.col("score") + gain).alias("score"), gain.alias("delta")), "id")
        dropped(state)
        state = new
        if state.where(F.col("delta") > tolerance).isEmpty():
            break
    return state.select("id", F.col("score").alias("value"))


@dealt
def components(g: Graph, threshold: float | None = None, direction: str = "bothE", **which) -> DataFrame:
    """The smallest external id, as a string, of each weakly connected component: contraction, a logarithmic number of rounds.

    Roots stay dealt out by vertex, so that a component of most vertices is never one task's.
    """
    e = edges(g, "outE", **which)
    e = e if threshold is None else e.where(F.col("w") > threshold)
    n = buckets(g.spark)
    links = parted(e.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).repartition(n, "a").distinct(), "a")
    root = ids(g).select("id", F.col("id").alias("root"))
    while not links.isEmpty():
        both = links.unionAll(links.select("b", "a"))
        up = parted(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("up")), "a")
        for _ in range(3):
            further = parted(met(up, up.select(F.col("a").alias("up"), F.col("up").alias("further")), "up").select("a", F.col("further").alias("up")), "a")
            dropped(up)
            up = further
        new = parted(met(root, up, F.col("root") == F.col("a"), "left").select("id", F.coalesce("up", "root").alias("root")), "id")
        x, y = up.select("a", F.col("up").alias("x")), up.select(F.col("a").alias("b"), F.col("up").alias("y"))
        left = parted(met(met(links, x, "a"), y, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).repartition(n, "a").distinct(), "a")
        dropped(links, up, *([root] if hasattr(root, "_kept_at") else []))
        root, links = new, left
    named = met(name(g), root, "id")
    return met(named, named.groupBy("root").agg(F.min("name").alias("value")), "root").select("id", "value")


def strong_components(g: Graph, **which) -> DataFrame:
    """The smallest external id of each strongly connected component: least vertices spread forward as colours, and back from each colour's own vertex."""
    left = settled(ids(g))
    e = settled(edges(g, **which).where("src <> dst").select("src", "dst").distinct())
    done: list[DataFrame] = []
    while not left.isEmpty():
        while True:  # what nothing enters, or nothing leaves, is alone
            both = e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))
            alone = settled(met(left, both, "id", "left_anti"))
            if alone.isEmpty():
                break
            done.append(alone.withColumn("c", F.col("id")))
            left = settled(met(left, both, "id", "left_semi"))
            e = settled(met(met(e, left.withColumnRenamed("id", "src"), "src", "left_semi"), left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
        if left.isEmpty():
            break
        colour = settled(left.select("id", F.col("id").alias("c"), F.lit(True).alias("new")))
        while True:
            got = met(e, colour.where("new"), F.col("src") == F.col("id")).groupBy("dst").agg(F.min("c").alias("m"))
            less = F.coalesce(F.col("m") < F.col("c"), F.lit(False))  # only these pass it on
            colour = settled(met(colour, got, F.col("id") == F.col("dst"), "left").select("id", F.when(less, F.col("m")).otherwise(F.col("c")).alias("c"), less.alias("new")))
            if colour.where("new").isEmpty():
                break
        colour = colour.drop("new")
        inner = settled(met(met(e, colour.withColumnRenamed("id", "src"), "src"), colour.select(F.col("id").alias("dst"), F.col("c").alias("c2")), "dst").where("c = c2").select("src", "dst", "c"))
        found = settled(colour.where("id = c"))
        front = found
        while not front.isEmpty():
            back = met(inner, front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "c").distinct()
            front = settled(met(back, found, "id", "left_anti"))
            found = settled(found.unionByName(front))
        done.append(found)
        left = settled(met(left, found, "id", "left_anti"))
        e = settled(met(met(e, left.withColumnRenamed("id", "src"), "src", "left_semi"), left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    if not done:
        return ids(g).withColumn("value", F.lit(""))
    named = met(united(done), name(g), "id")
    return met(named, named.groupBy("c").agg(F.min("name").alias("value")), "c").select("id", "value")


@dealt
def peer_pressure(g: Graph, rounds: int = 30, **which) -> DataFrame:
    """The cluster that most of a vertex and its neighbours in vote for; ties go to the smallest.

    Votes are dealt out once, by the vertex that counts them.  Where names are only ids, clusters travel as ids and are compared as text.
    """
    e = summed(g, **which)
    n = buckets(g.spark)
    text = "uid" in g.v().columns
    state = parted(name(g).withColumnRenamed("name", "c") if text else ids(g).select("id", F.col("id").alias("c")), "id")
    for _ in range(rounds):
        votes = looked_up(e, state, F.col("id") == F.col("src")).select(F.col("dst").alias("to"), "c", "w")
        counted = votes.repartition(n, "to").unionAll(state.select(F.col("id").alias("to"), "c", F.lit(1.0).alias("w")).repartition(n, "to")).groupBy("to", "c").agg(F.sum("w").alias("n"))
        best = counted.groupBy("to").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("c").cast("string").alias("t"), "c"))["c"].alias("best"))
        new = parted(best.select(F.col("to").alias("id"), F.col("best").alias("c")), "id")
        same = met(new, state.select("id", F.col("c").alias("old")), "id").where("c <> old").isEmpty()
        dropped(state)
        state = new
        if same:
            break
    return state.select("id", F.col("c").cast("string").alias("value"))


def distances(g: Graph, sources: DataFrame | None = None, limit: float | None = None, **which) -> DataFrame:
    """(s, id, d): shortest distances from each source to each vertex that it reaches, itself included."""
    e = settled(edges(g, **which).groupBy("src", "dst").agg(F.min("w").alias("w")))
    found = settled((ids(g) if sources is None else sources).select(F.col("id").alias("s"), "id", F.lit(0.0).alias("d")))
    front = found
    while not front.isEmpty():
        step = front.join(e, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        step = step if limit is None else step.where(F.col("d") <= limit)
        better = step.join(found.withColumnRenamed("d", "old"), ["s", "id"], "left").where("old is null or d < old")
        front = settled(better.select("s", "id", "d"))
        found = settled(found.join(front.select("s", "id", F.col("d").alias("new")), ["s", "id"], "full_outer").select("s", "id", F.coalesce("new", "d").alias("d")))
    return found


def shortest_paths(g: Graph, sources: DataFrame | None = None, targets: DataFrame | None = None, limit: float | None = None, **which) -> DataFrame:
    """(s, id, distance, path): all shortest paths as arrays of vertex ids, from sources to targets."""
    d = settled(distances(g, sources, limit, **which))
    e = edges(g, **which).groupBy("src", "dst").agg(F.min("w").alias("w"))
    # edges that lie on shortest paths of a source
    on = settled(d.join(e, F.col("id") == F.col("src")).select("s", "src", "dst", (F.col("d") + F.col("w")).alias("via"), "w").join(d.select("s", F.col("id").alias("dst"), F.col("d").alias("dd")), ["s", "dst"]).where("abs(via - dd) < 1e-9 and src <> dst and w > 0"))
    paths = settled(d.where("s = id").select("s", "id", F.array("id").alias("path")))
    done = [paths]
    while not paths.isEmpty():
        nxt = paths.withColumnRenamed("s", "s0").join(on.select("s", "src", "dst"), (F.col("s0") == F.col("s")) & (F.col("id") == F.col("src")))
        paths = settled(nxt.select("s", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")))
        done.append(paths)
    every = united(done).join(d.withColumnRenamed("d", "distance"), ["s", "id"])
    return every if targets is None else every.join(targets.select("id"), "id", "left_semi")


def betweenness(g: Graph, **which) -> DataFrame:
    """Brandes: numbers of shortest paths forward level by level, dependencies backward."""
    e = settled(edges(g, **which).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")))
    v = ids(g)
    front = settled(v.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma")))
    seen, levels = front.select("s", "id"), [front]
    while True:
        step = front.join(e, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id")).agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"))
        front = settled(step.join(seen, ["s", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen = settled(seen.unionByName(front.select("s", "id")))
        levels.append(front)
    total = [v.select("id", F.lit(0.0).alias("x"))]
    delta = levels[-1].select("s", "id", "sigma", F.lit(0.0).alias("delta"))
    for upper in reversed(levels[:-1]):
        low = delta.select("s", F.col("id").alias("dst"), F.col("sigma").alias("sd"), F.col("delta").alias("dd"))
        got = upper.join(e, F.col("id") == F.col("src")).join(low, ["s", "dst"]).groupBy("s", "id").agg(F.sum(F.col("sigma") * F.col("m") / F.col("sd") * (1 + F.col("dd"))).alias("delta"))
        delta = settled(upper.join(got, ["s", "id"], "left").select("s", "id", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        total.append(delta.where("s <> id").select("id", F.col("delta").alias("x")))
    return united(total).groupBy("id").agg(F.sum("x").alias("value"))


def closeness(g: Graph, **which) -> DataFrame:
    """Of the vertices that reach a vertex: their number by the sum of their distances, 0 if none."""
    d = distances(g, **which).where("s <> id").groupBy("id").agg((F.count(F.lit(1)) / F.sum("d")).alias("value"))
    return ids(g).join(d, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def harmonic(g: Graph, **which) -> DataFrame:
    v = ids(g)
    n = v.count()
    d = distances(g, **which).where("s <> id and d > 0").groupBy("id").agg((F.sum(1 / F.col("d")) / max(n - 1, 1)).alias("value"))
    return v.join(d, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def degree(g: Graph, direction: str = "IN", labels: list[str] | None = None, weight: str | None = None) -> DataFrame:
    e = edges(g, {"IN": "outE", "OUT": "inE", "BOTH": "bothE"}[direction], labels, weight)
    c = (F.sum("w") if weight else F.count(F.lit(1)).cast("bigint")).alias("value")
    got = e.groupBy(F.col("dst").alias("id")).agg(c)
    zero = F.lit(0.0) if weight else F.lit(0).cast("bigint")
    return ids(g).join(got, "id", "left").select("id", F.coalesce("value", zero).alias("value"))


@dealt
def hits(g: Graph, rounds: int = 20, **which) -> DataFrame:
    """(id, hub, authority), each of length 1."""
    e = summed(g, **which)
    turned = parted(e, "dst")
    hub = authority = parted(ids(g).select("id", F.lit(1.0).alias("x")), "id")
    h = a = 1.0  # what the kept scores are to be divided by

    def passed(e: DataFrame, start: str, end: str, kept: DataFrame, size: float, old: DataFrame) -> tuple[DataFrame, float]:
        got = looked_up(e, kept.where("x <> 0"), F.col("id") == F.col(start)).groupBy(end).agg(F.sum(F.col("x") / size * F.col("w")).alias("m"))
        new = parted(met(kept.select("id"), got, F.col("id") == F.col(end), "left").select("id", F.coalesce("m", F.lit(0.0)).alias("x")), "id")
        if old is not kept:
            dropped(old)
        return new, (new.agg(F.sqrt(F.sum(F.col("x") ** 2))).first()[0] or 0.0) or 1.0

    for _ in range(rounds):
        authority, a = passed(e, "src", "dst", hub, h, authority)
        hub, h = passed(turned, "dst", "src", authority, a, hub)
    return met(hub.select("id", (F.col("x") / h).alias("hub")), authority.select("id", (F.col("x") / a).alias("authority")), "id")


def simple(g: Graph, labels: list[str] | None = None) -> DataFrame:
    """(a, b), a < b: the undirected simple graph."""
    e = edges(g, "outE", labels)
    return e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _closed(g: Graph, labels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Triangles (id, n) and degrees (x, d), of vertices that have some.

    Edges run from the vertex of fewer to that of more neighbours, so no hub makes all pairs of its own.  A vertex sends what follows
    a neighbour in its list, as an array, to that neighbour if it has a list too, and the two lists are intersected there.
    """
    n = buckets(g.spark)
    pairs = edges(g, "outE", labels).where("src <> dst")
    e = parted(pairs.select(F.explode(F.array(F.struct(F.col("src").alias("x"), F.col("dst").alias("y")), F.struct(F.col("dst").alias("x"), F.col("src").alias("y")))).alias("p")).select("p.x", "p.y").repartition(n, "x").distinct(), "x")
    degree = parted(e.groupBy("x").agg(F.count(F.lit(1)).cast("int").alias("d")), "x")
    told = looked_up(e, degree, "x").select(F.col("y").alias("v"), F.struct("d", F.col("x").alias("u")).alias("z"))
    later = met(told, degree, F.col("v") == F.col("x")).where(F.struct("d", "x") < F.col("z"))
    lists = parted(later.groupBy("v").agg(F.transform(F.sort_array(F.collect_list("z")), lambda z: z["u"]).alias("l")), "v")
    dropped(e)
    heads = lists.select(F.col("v").alias("y"))
    asks = lists.where("size(l) > 1").select(F.col("v").alias("x"), F.posexplode("l").alias("k", "y"))
    asked = met(asks, heads, "y", "left_semi").select(F.col("x").alias("v"), "y", "k")
    sent = met(lists, asked, "v").where("k + 1 < size(l)").select("y", F.col("v").alias("x"), F.slice("l", F.col("k") + 2, F.size("l")).alias("rest"))
    common = met(sent, lists.select(F.col("v").alias("y"), "l"), "y").select("x", "y", F.array_intersect("rest", "l").alias("z")).where("size(z) > 0")
    one = F.lit(1).cast("bigint").alias("n")
    every = F.concat(F.array(*(F.struct(F.col(c).alias("id"), F.size("z").cast("bigint").alias("n")) for c in ("x", "y"))), F.transform("z", lambda z: F.struct(z.alias("id"), one)))
    return common.select(F.explode(every).alias("t")).groupBy("t.id").agg(F.sum("t.n").alias("n")), degree


@dealt
def triangles(g: Graph, labels: list[str] | None = None) -> DataFrame:
    """Triangles of each vertex."""
    got = _closed(g, labels)[0].withColumnRenamed("id", "x")
    return met(ids(g), got, F.col("id") == F.col("x"), "left").select("id", F.coalesce("n", F.lit(0).cast("bigint")).alias("value"))


@dealt
def clustering(g: Graph, labels: list[str] | None = None) -> DataFrame:
    got, degree = _closed(g, labels)
    n, d = F.coalesce("n", F.lit(0)), F.coalesce("d", F.lit(0)).cast("bigint")
    known = met(met(ids(g), degree, F.col("id") == F.col("x"), "left").drop("x"), got.withColumnRenamed("id", "x"), F.col("id") == F.col("x"), "left")
    return known.select("id", F.when(d < 2, 0.0).otherwise(2 * n / (d * (d - 1))).alias("value"))


@dealt
def k_core(g: Graph, labels: list[str] | None = None) -> DataFrame:
    """Core numbers as the fix-point of the H-index of the neighbours' values, from the degrees on.

    Only a vertex that a neighbour no longer holds up is looked at again: its value was at most the neighbour's, and is above it now.
    A vertex that falls tells those neighbours whose degree is above what it falls to, as no other can be above it.
    """
    n = buckets(g.spark)
    pairs = edges(g, "outE", labels).where("src <> dst").select("src", "dst")
    both = pairs.unionAll(pairs.select("dst", "src")).toDF("x", "y")
    e = parted(both.repartition(n, "x").distinct(), "x")
    degree = e.groupBy("x").agg(F.count(F.lit(1)).cast("int").alias("d"))
    known = parted(met(ids(g), degree, F.col("id") == F.col("x"), "left").select("id", F.coalesce("d", F.lit(0)).alias("c")), "id")
    # every edge has its opposite, so that each vertex can tell its degree to its neighbours
    told = parted(looked_up(e, known, F.col("x") == F.col("id")).select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("c").alias("d")), "x")
    dropped(e)
    state, seen = known, told.select(F.col("x").alias("to"), F.col("d").alias("c"))
    while True:
        # values are counted where they are told: a hub has few distinct ones, not a row for each neighbour, in its window
        near = seen.groupBy("to", "c").agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(Window.partitionBy("to").orderBy(F.col("c").desc()))
        h = near.withColumn("above", above).groupBy("to").agg(F.max(F.least("c", F.col("above").cast("int"))).alias("h"))
        new = parted(met(state, h, F.col("id") == F.col("to"), "left").select("id", F.least("c", F.coalesce("h", "c")).alias("c"), F.col("c").alias("old")), "id")
        fell = looked_up(told, new.where("c < old"), F.col("x") == F.col("id")).where("d > c").groupBy(F.col("y").alias("to")).agg(F.min("c").alias("low"), F.max("old").alias("high"))
        look = parted(met(new.select("id", "c"), fell, F.col("id") == F.col("to")).where("low < c and c <= high").select("id"), "id")
        dropped(state)
        state = new
        if look.isEmpty():
            return state.select("id", F.col("c").cast("bigint").alias("value"))
        asked = looked_up(told, look, F.col("x") == F.col("id"), "left_semi").select(F.col("x").alias("to"), "y").repartition(n, "y")
        seen = looked_up(asked, state.select("id", "c"), F.col("y") == F.col("id")).select("to", "c").repartition(n, "to")


#: Pairs that one task counts.
TASK_PAIRS = 8_000_000


def node_similarity(g: Graph, labels: list[str] | None = None) -> DataFrame:
    """(node1, node2, similarity): Jaccard of the sets of neighbours out, of pairs that share some.

    A neighbour sends the rest of its list of sources to each of them, as one array of 32-bit codes, and the pairs are counted where it arrives.  So
    a pair met through a neighbour is four bytes of an array that is shuffled once, and a task counts the pairs of few sources.  Of a
    pair, the source with fewer neighbours counts it.
    """
    e = parted(edges(g, "outE", labels).select("src", "dst").distinct(), "src")
    n = buckets(e.sparkSession)
    part = F.pmod(F.xxhash64("src"), F.lit(n)).cast("int")
    count = e.groupBy("src").agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("part", part)
    nodes = parted(count.select("src", "n", ((F.row_number().over(Window.partitionBy("part").orderBy("src")) - 1) * n + F.col("part")).alias("code")), "code")
    met_by = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    pairs = met_by.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    lists = met(e, nodes, "src").groupBy("dst").agg(F.sort_array(F.collect_list(F.struct("n", "code")))["code"].alias("l"))
    sent = lists.select("l", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("k")).where("k < size(l)").select(F.col("l")[F.col("k") - 1].alias("a"), F.slice("l", F.col("k") + 1, F.size("l")).alias("l"))
    both = sent.repartition(max(n, int(pairs // TASK_PAIRS)), "a").select("a", F.explode("l").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    known = nodes.select(F.col("code").alias("a"), F.col("src").alias("node1"), F.col("n").alias("n1")), nodes.select(F.col("code").alias("b"), F.col("src").alias("node2"), F.col("n").alias("n2"))
    found = both.join(known[0], "a").join(known[1], "b").select("node1", "node2", (F.col("c") / (F.col("n1") + F.col("n2") - F.col("c"))).alias("similarity"))
    ends = F.array(F.struct("node1", "node2"), F.struct(F.col("node2").alias("node1"), F.col("node1").alias("node2")))
    return found.select(F.explode(ends).alias("p"), "similarity").select("p.node1", "p.node2", "similarity")


def search(g: Graph, term: str, kind: str = "vertex") -> DataFrame:
    """(owner, key, v): properties whose text holds the term, in any case."""
    low: Column = F.lit(term.lower())
    parts = []
    for df in (g._v if kind == "vertex" else g._e).values():
        for c, t in df.dtypes:
            if c.startswith("@") and not t.startswith("array"):
                text = F.col(f"`{c}`").cast("string")
                parts.append(df.where(F.lower(text).contains(low)).select(F.col("id").alias("owner"), F.lit(c[1:]).alias("key"), text.alias("v")))
    return united(parts) if parts else g.nothing("owner long, key string, v string")


def schema(g: Graph) -> DataFrame:
    """(kind, label, key, type, count) of the labels and properties in use."""
    rows = []
    for kind, frames in (("vertex", g.vertices), ("edge", g.edges)):
        for label, df in frames.items():
            rows.append(df.select(F.lit(f"{kind}Label").alias("kind"), F.lit(label).alias("label"), F.lit("").alias("key"), F.lit("").alias("type")))
            for c, t in df.dtypes:
                if c.startswith("@"):
                    there = F.size(f"`{c}`") > 0 if t.startswith("array") else F.col(f"`{c}`").isNotNull()
                    rows.append(df.where(there).select(F.lit("property" if kind == "vertex" else "edgeProperty").alias("kind"), F.lit(label).alias("label"), F.lit(c[1:]).alias("key"), F.lit(t).alias("type")))
    return united(rows).groupBy("kind", "label", "key", "type").agg(F.count(F.lit(1)).alias("count"))
