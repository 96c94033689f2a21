"""Mixing sources to target weights (operator 2), in DataFrame functions only.

Targets: the sources, in the order of their code points with null last, weigh 5, 2, 1 and so on again; they share 150 % of all
words.  A target stops at twice its source's words, and the excess goes to the others by weight until none is above
(a water level, found by one pass over the sources by the ratio of limit and weight).

Blocks: the documents of a source, in the order of a hash of the whole row, are one run of words that is cut into blocks of BLOCK
words; so the order depends on the rows alone, not on files or partitions.  The offsets are prefix sums in two levels, over chunks
of each source and over the chunks' sums, so that a source with a third of all rows is summed by many tasks.

Draws: the mix has as many slots as the targets need, dealt evenly to output shards.  Each slot draws its source by the
targets' shares from a hash of its own, so the counts of the sources in a shard are multinomial; rerun after rerun they are the
same.  The counts say which slots of a source a shard takes: the next ones after those of the shards before.  A source
ends within TOLERANCE of its target: slots drawn beyond that are left out, and ones that lack are dealt to shards by a hash; its last slot
takes part of its block, so that the words meet.  A slot's number modulo the blocks of its source, permuted by a swap-or-not
shuffle keyed by source and pass, is its block: in one pass over a source no block comes twice, and there are two passes at
most.  Slots and documents meet by (source, block).

Defined results: a null or empty text has size 0 and is taken 0 times; sources without words have target 0; a null source is one
of its own; repeated rows are documents like others (which of rows equal in all columns is taken how often, is open); very long
texts span as many blocks as they need; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Kept, row_mark, table, written

WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2
BLOCK = 256
#: Words of an output shard, about.
SHARD_WORDS = 1 << 20
#: Pieces in which the words of a source are summed.
CHUNKS = 1024
ROUNDS = 12
#: How far, as a share of its target, the draws may carry a source from it.
TOLERANCE = 0.005
#: Cells of the unit interval by which draws and sources meet.
CELLS = 4096
#: Slots that a task makes.
TASK_SLOTS = 1 << 22


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, rank, source_size, target) of each source of sizes (source, size)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    x = ordered.withColumn("weight", weight).withColumn("most", (limit * F.col("source_size")).cast("double"))
    whole = Window.partitionBy()
    first = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"all": F.sum("source_size").over(whole) * share, "every": F.sum("weight").over(whole)})
    x = x.withColumns({"full": F.coalesce(F.sum("most").over(first), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(first), F.lit(0.0))})
    # the level if those before have their limits; it holds from the first source on that it does not fill
    level, ratio = (F.col("all") - F.col("full")) / (F.col("every") - F.col("gone")), F.col("most") / F.col("weight")
    x = x.withColumn("level", F.min(F.when(level <= ratio, F.struct(ratio, "rank", level.alias("level")))).over(whole)["level"])
    return x.select("source", "rank", "source_size", F.coalesce(F.least(F.col("most"), F.col("level") * F.col("weight")), F.col("most")).alias("target"))


def permuted(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 for each key: swap or not, round by round."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r, F.lit("k")), n) - x, n)
        swap = F.xxhash64(key, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, step)


def placed(docs: DataFrame, keep: list, chunks: int = CHUNKS, **shares) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): docs' columns `keep` with row, size, source's rank, source_size and target, and the offset of their
    first word in their source; the sources with their targets."""
    mark = row_mark(docs)
    sized = docs.select(*keep, F.col("source").alias("__source"), size_of(F.col("text")).alias("size"), mark.alias("place"), F.xxhash64(mark, "doc_id", F.col("text")).alias("place2"), F.monotonically_increasing_id().alias("row"))
    light = written(sized.withColumn("chunk", F.pmod("place", F.lit(chunks))), "sizes")
    goal = written(targets(light.select(F.col("__source").alias("source"), "size"), **shares), "targets")
    known = light.join(goal.withColumnRenamed("source", "__of"), F.col("__source").eqNullSafe(F.col("__of"))).drop("__source", "__of")
    sums = known.groupBy("rank", "chunk").agg(F.sum("size").alias("sum"))
    before = sums.select("rank", "chunk", (F.sum("sum").over(Window.partitionBy("rank").orderBy("chunk")) - F.col("sum")).alias("before"))
    inner = F.sum("size").over(Window.partitionBy("rank", "chunk").orderBy("place", "place2", "row")) - F.col("size")
    return known.withColumn("inner", inner).join(before, ["rank", "chunk"]).withColumn("offset", F.col("before") + F.col("inner")).drop("inner", "before", "chunk", "place", "place2"), goal


def drawn(goal: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, limit: int = LIMIT, tolerance: float = TOLERANCE) -> DataFrame:
    """(shard, rank, slot, block, part): the slots of each source, the block that each takes, and how much of it."""
    spark = goal.sparkSession
    x = goal.where("target > 0").withColumn("n", F.ceil(F.col("source_size") / block)).withColumn("wanted", F.round(F.col("target") * F.col("n") / F.col("source_size"), 9))
    words, slots = x.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.ceil(F.sum("wanted")), F.lit(0))).first()
    shards = max(1, -(-int(words) // shard_words))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slots // TASK_SLOTS))
    # the unit interval, parted by the sources' shares, in cells
    by = Window.orderBy("rank")
    high = F.when(F.lead("rank").over(by).isNull(), 1.0).otherwise(F.sum("wanted").over(by) / F.sum("wanted").over(Window.partitionBy()))
    parted = x.withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(by), F.lit(0.0)))
    last = F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))
    cells = parted.select("rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), last)).alias("cell"))
    each = spark.range(0, slots, 1, tasks).select(F.floor(F.col("id") / -(-max(slots, 1) // shards)).alias("shard"), (F.shiftrightunsigned(F.xxhash64("id", F.lit("draw")), 11) * 2.0**-53).alias("u"))
    met = each.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell").where("u >= low and u < high")
    counts = written(met.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("count")), "draws")
    # what the draws make of the targets
    got = counts.groupBy("rank").agg(F.sum("count").alias("drawn"))
    bound = F.greatest((1 - tolerance) * F.col("wanted"), F.least((1 + tolerance) * F.col("wanted"), F.col("drawn"), (limit * F.col("n"))))
    settled = written(x.join(got, "rank", "left").fillna(0, ["drawn"]).select("rank", "n", "drawn", F.least(bound, limit * F.col("n")).alias("wanted")), "settled")
    start = F.sum("count").over(Window.partitionBy("rank").orderBy("shard")) - F.col("count")
    ranges = counts.select("shard", "rank", start.alias("from"), "count")
    taken = ranges.repartition(tasks, "shard", "rank").select("shard", "rank", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("count") - 1)).alias("slot"))
    # those that lack, numbered in two steps: no task makes all of a source
    lacking = settled.where("ceil(wanted) > drawn").select("rank", F.col("drawn").alias("from"), F.ceil("wanted").alias("to"))
    lacking = lacking.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("to") - F.col("from") - 1) / 4096)))).repartition(tasks, "rank", "piece")
    first = F.col("from") + F.col("piece") * 4096
    lacking = lacking.select("rank", F.explode(F.sequence(first, F.least(first + 4095, F.col("to") - 1))).alias("slot"))
    lacking = lacking.select(F.pmod(F.xxhash64("rank", "slot", F.lit("shard")), F.lit(shards)).cast("long").alias("shard"), "rank", "slot")
    out = taken.unionByName(lacking).join(settled, "rank").where("slot < wanted")
    pass_ = F.xxhash64("rank", F.floor(F.col("slot") / F.col("n")))
    return out.select("shard", "rank", "slot", permuted(F.pmod("slot", "n"), F.col("n"), pass_).alias("block"), F.least(F.lit(1.0), F.col("wanted") - F.col("slot")).alias("part"))


def pieces(documents: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """(shard, rank, slot, block, row, from_word, n_words): the words of each document that each slot takes."""
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)
    spans = documents.where("size > 0").withColumn("block", F.explode(F.sequence(first, last))).select("rank", "block", "row", "offset", "size", "source_size")
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    start = F.greatest(F.col("offset"), F.col("block") * block)
    end = F.least(F.col("offset") + F.col("size"), F.col("block") * block + F.round(F.col("part") * length).cast("long"))
    # slots come out of a few rows, so their size is not known to the optimizer: never broadcast them
    met = spans.join(slots.hint("merge"), ["rank", "block"]).withColumns({"start": start, "end": end}).where("`end` > `start`")
    return met.select("shard", "rank", "slot", "block", "row", (F.col("start") - F.col("offset")).alias("from_word"), (F.col("end") - F.col("start")).alias("n_words"))


def mixed(docs: DataFrame, keep: list[str] | None = None, block: int = BLOCK, **shares) -> DataFrame:
    """docs' columns `keep` with size, source_size, target, taken, the words that the mix takes of each document, and the first and
    last output shard that they go to (null if none)."""
    kept = Kept(docs, keep, ("size", "source_size", "target", "taken", "first_shard", "last_shard"))
    documents, goal = placed(docs, kept.columns, **shares)
    documents = written(documents, "placed")
    taken = pieces(documents, drawn(goal, block), block).groupBy("row").agg(F.sum("n_words").alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    return documents.join(taken, "row", "left").select(*kept.back, "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_shard", "last_shard")


def blocks(docs: DataFrame, block: int = BLOCK, **shares) -> DataFrame:
    """(shard, slot, source_rank, words): the blocks of the mix themselves.  doc_id must be a key of docs here."""
    documents, goal = placed(docs, [F.col("doc_id")], **shares)
    documents = written(documents, "placed")
    took = pieces(documents, drawn(goal, block), block).join(documents.select("row", "doc_id", "offset"), "row")
    texts = docs.select(F.col("doc_id").alias("__id"), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("all"))
    cut = took.join(texts, F.col("doc_id") == F.col("__id")).select("shard", "slot", "rank", "offset", "row", F.slice("all", (F.col("from_word") + 1).cast("int"), F.col("n_words").cast("int")).alias("words"))
    rows = cut.groupBy("shard", "rank", "slot").agg(F.sort_array(F.collect_list(F.struct("offset", "row", "words"))).alias("x"))
    return rows.select("shard", "slot", F.col("rank").alias("source_rank"), F.flatten(F.col("x.words")).alias("words"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


QUERIES = {"op2_mix_sources": op2_mix_sources}
