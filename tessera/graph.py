"""A property graph as two families of DataFrames, vertices and edges by label."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def at(key: str) -> str:
    """The column that holds a property."""
    return f"@{key}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or a local one where it is unset and there is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "/tmp/checkpoints/tessera"
        spark.sparkContext.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder as compressed columns: for wide rows and long texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/filed_{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parted(df: DataFrame, by: str) -> DataFrame:
    """df computed once and kept in the shared folder as a table dealt out by a column: joins and aggregations by that column shuffle it no more.

    Plain columns take far fewer bytes than a checkpoint's rows.  The catalog holds the table's name only while it is made.
    """
    spark, name = df.sparkSession, f"parted_{uuid.uuid4().hex}"
    n, path = buckets(spark), f"{shared_dir(spark).rstrip('/')}/tables/{name}"
    df.repartition(n, by).write.bucketBy(n, by).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
    out._kept_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of parted() tables that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A merge join: nothing is broadcast, so nothing passes through the driver, however often a loop joins."""
    return left.join(right.hint("merge"), on, how)


def looked_up(edges: DataFrame, vertices: DataFrame, on, how: str = "inner") -> DataFrame:
    """Edges with what is kept of their vertices, both dealt out alike: each task holds its share of the vertices, and the edges need no sort."""
    return edges.join(vertices.hint("shuffle_hash"), on, how)


def united(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@dataclass
class Graph:
    """vertices: label -> (id, uid?, @property ...); edges: label -> (id, src, dst, @property ...).

    A label of `vertices` may name several labels joined by `::`.  ends: the labels of an edge's source and target, where they
    are known; they decide which tables a movement reads.  multi: keys whose columns are arrays of structs (value, meta).
    """

    spark: SparkSession
    vertices: dict[str, DataFrame]
    edges: dict[str, DataFrame]
    ends: dict[str, tuple[set[str], set[str]]] = field(default_factory=dict)
    multi: set[str] = field(default_factory=set)
    name: str = "graph"

    def _typed(self, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Properties of several types become strings, if not all are numbers (then doubles)."""
        kinds: dict[str, set[str]] = {}
        for df in frames.values():
            for c, t in df.dtypes:
                kinds.setdefault(c, set()).add(t)
        numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
        odd = {c: ("double" if t & {"float", "double"} else "bigint") if t <= numbers else "string" for c, t in kinds.items() if len(t) > 1}
        return {k: df.withColumns({c: F.col(f"`{c}`").cast(odd[c]) for c in df.columns if c in odd}) if set(df.columns) & set(odd) else df for k, df in frames.items()}

    @cached_property
    def _v(self) -> dict[str, DataFrame]:
        return {k: df.withColumns({"label": F.lit(k.split("::")[0]), "labels": F.array(*map(F.lit, k.split("::")))}) for k, df in self._typed(self.vertices).items()}

    @cached_property
    def _e(self) -> dict[str, DataFrame]:
        return {k: df.withColumn("label", F.lit(k)) for k, df in self._typed(self.edges).items()}

    def v(self, labels: set[str] | None = None) -> DataFrame:
        """Vertices that may have one of the labels (table keys), all columns; unread ones are pruned by the optimizer."""
        own = [df for k, df in self._v.items() if labels is None or k in labels]
        return united(own) if own else self.nothing("id long, label string, labels array<string>")

    def e(self, labels: set[str] | None = None) -> DataFrame:
        own = [df for k, df in self._e.items() if labels is None or k in labels]
        return united(own) if own else self.nothing("id long, src long, dst long, label string")

    def nothing(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def tables(self, label: str) -> set[str]:
        """The vertex tables of a label."""
        return {k for k in self.vertices if label in k.split("::")}

    def keys(self, element: str) -> list[str]:
        frames = (self._v if element == "vertex" else self._e).values()
        return sorted({c[1:] for df in frames for c in df.columns if c.startswith("@")})

    def from_labels(self, edge: str, direction: str) -> set[str] | None:
        """Vertex tables that an edge label leads to, going out or in."""
        if edge not in self.ends:
            return None
        return self.ends[edge][1 if direction == "out" else 0]

    def replaced(self, vertices: dict[str, DataFrame] | None = None, edges: dict[str, DataFrame] | None = None, **more: Any) -> Graph:
        return Graph(self.spark, self.vertices if vertices is None else vertices, self.edges if edges is None else edges, more.get("ends", self.ends), more.get("multi", self.multi), self.name)

    def traverse(self, text: str, **params: Any):
        """The result of a Gremlin text, as a Result."""
        from .operators.run import run

        return run(self, text, params)
