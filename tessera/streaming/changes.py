"""A change feed into a graph: Structured Streaming appends changes to a log, and a snapshot is the last change of each element.

A change is a JSON line: seq, op (`put` or `drop`), kind (`vertex` or `edge`), label, id, src, dst, props (a map of texts).
The log is Parquet, parted by kind and label.  A dropped vertex takes its edges along.  Changes of an equal seq are ordered by their op,
`put` first, so that replaying a feed, or a batch twice, gives the same graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import Graph, at

SCHEMA = "seq long, op string, kind string, label string, id long, src long, dst long, props map<string, string>"


def follow(spark: SparkSession, feed: str, log: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append new files of the feed to the log; once: what is there now, in batches, then stop."""
    changes = spark.readStream.schema(SCHEMA).json(feed).where("id is not null and kind in ('vertex', 'edge')")
    writer = changes.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).partitionBy("kind", "label")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def latest(changes: DataFrame, upto: int | None = None) -> DataFrame:
    """The last change of each element, up to a seq."""
    changes = changes if upto is None else changes.where(F.col("seq") <= upto)
    last = F.max_by(F.struct("op", "label", "src", "dst", "props"), F.struct("seq", F.col("op") == "drop"))
    return changes.groupBy("kind", "id").agg(last.alias("x")).where("x.op = 'put'").select("kind", "id", "x.*")


def snapshot(spark: SparkSession, log: str, upto: int | None = None, types: dict[str, str] | None = None) -> Graph:
    """The graph of a log; types: the Spark types of properties that aren't text."""
    now = latest(spark.read.parquet(log), upto)
    keys = now.select("kind", "label", F.explode_outer(F.map_keys("props")).alias("key")).distinct().collect()  # a row for each label and key
    vertices = now.where("kind = 'vertex'")

    def frame(kind: str, label: str) -> DataFrame:
        own = sorted({r.key for r in keys if (r.kind, r.label) == (kind, label) and r.key})
        cols = ["id"] if kind == "vertex" else ["id", "src", "dst"]
        rows = now.where((F.col("kind") == kind) & (F.col("label") == label))
        if kind == "edge":  # an edge needs both ends
            ids = vertices.select("id")
            rows = rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return rows.select(*cols, *(F.try_element_at("props", F.lit(k)).cast((types or {}).get(k, "string")).alias(at(k)) for k in own))

    found = sorted({(r.kind, r.label) for r in keys if r.label is not None})
    return Graph(spark, {b: frame(a, b) for a, b in found if a == "vertex"}, {b: frame(a, b) for a, b in found if a == "edge"})


def windowed(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) counted by type in windows of time; on a stream, rows later than `late` don't count."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
