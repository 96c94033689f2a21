"""A query from text or steps to a result."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.parser import parse
from ..plans.passes import Source, WRITES, normalised, source, verified
from ..plans.steps import P, Step, Traversal, UnsupportedTraversal
from .lowering import Lowering
from .stream import Stream

#: Terminal steps, and those that mean nothing for a DataFrame.
TERMINAL = {"toList", "iterate"}
REFUSED = {"next", "hasNext", "toSet", "tryNext", "explain", "toString", "profile", "timeLimit"}


@dataclass
class Result:
    """kind and rows of a traversal; graph is the one after its writes."""

    stream: Stream
    graph: Graph

    @property
    def kind(self) -> str:
        return self.stream.kind

    @property
    def df(self) -> DataFrame:
        """Vertices as id, label; edges as id, label, src, dst; values and lists as value; groups as key, value; records by their fields."""
        s = self.stream.single()
        terms = [F.col(f"`{c}`").asc_nulls_first() if up else F.col(f"`{c}`").desc_nulls_last() for c, up in s.order]
        df = s.df.orderBy(*terms) if terms else s.df
        if s.kind == "vertex":
            if "label" not in df.columns:
                v = self.graph.v(s.tables).select(F.col("id").alias("_i"), "label")
                df = s.df.join(v, F.col("id") == F.col("_i")).drop("_i")
                df = df.orderBy(*terms) if terms else df
            return df.select("id", "label")
        if s.kind == "edge":
            return df.select("id", "label", "src", "dst")
        if s.kind == "record":
            return df.select(*(F.col(f"`f${n}`").alias(n) for n in s.names))
        if s.kind in ("groups", "entry"):
            return df.select(F.col("k").alias("key"), F.col("v").alias("value"))
        if s.kind == "property":
            return df.select("owner", "key", F.col("v").alias("value"))
        return df.select(F.col("v").alias("value"))

    def rows(self) -> list[Any]:
        """All rows on the driver: single values by themselves.  For small results."""
        got = self.df.collect()
        return [r[0] for r in got] if self.kind in ("value", "list") else [r.asDict(recursive=True) for r in got]

    def json(self) -> DataFrame:
        return self.df.select(F.to_json(F.struct("*")).alias("value"))


def run(graph: Graph, text: str | Traversal, params: dict[str, Any] | None = None, graphs: dict[str, Graph] | None = None, **options: Any) -> Result:
    t = text if isinstance(text, Traversal) else parse(text, params)
    src, steps = source(t)
    if steps and steps[-1].name in TERMINAL:
        steps = steps[:-1]
    for s in steps:
        if s.name in REFUSED:
            raise UnsupportedTraversal(f"{s.name}() has no meaning for a table of results")
    if not steps:
        raise UnsupportedTraversal("an empty traversal")
    steps = normalised(steps)
    verified(steps, src)
    graph = restricted(graph, src)
    if steps[0].name == "match" and isinstance(steps[0].args[0], str):
        from ..plans.gql import translated

        steps = [*normalised(translated(steps[0].args[0])), *steps[1:]]
    if any(s.name in WRITES for s in steps) or steps[0].name == "io":
        from .writes import written

        return written(graph, steps, src, graphs)
    lowering = Lowering(graph, Traversal(steps), graphs, **options)
    prepare(lowering, src)
    stream = lowering.chain(steps, None)
    return Result(stream, lowering.g)


def prepare(lowering: Lowering, src: Source) -> None:
    lowering.sack = src.sack
    for name, value in src.effects.items():
        values = value if isinstance(value, (list, set, tuple)) else [value]
        lowering.side[name] = lowering._injected(list(values)) if values else Stream(lowering.g.nothing("v string"), "value")


def restricted(graph: Graph, src: Source) -> Graph:
    """SubgraphStrategy and PartitionStrategy: the base tables are filtered once, instead of every step."""
    for st in src.strategies:
        if st.name == "SubgraphStrategy":
            graph = subgraph(graph, st.extra.get("vertices"), st.extra.get("edges"), st.extra.get("vertexProperties"))
        elif st.name == "PartitionStrategy":
            key, read = st.extra.get("partitionKey", "_partition"), list(st.extra.get("readPartitions") or [])
            keep = Traversal([Step("has", [key, P("within", tuple(read))])])
            graph = subgraph(graph, keep, keep)
    return graph


def subgraph(graph: Graph, vertices: Traversal | None, edges: Traversal | None, properties: Traversal | None = None) -> Graph:
    """The vertices and edges that pass; an edge needs both of its ends."""
    if properties is not None:
        raise UnsupportedTraversal("SubgraphStrategy on vertex properties")
    own_v, own_e = graph.vertices, graph.edges

    def passed(kind: str, t: Traversal, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        t = Traversal(normalised(t.steps))
        out = {}
        for label, df in tables.items():
            lowering = Lowering(graph, t)
            whole = graph._v[label] if kind == "vertex" else graph._e[label]
            s = lowering.semi(Stream(whole, kind, attached=True, tables={label}), t)
            out[label] = s.df.select(*df.columns)
        return out

    if vertices is not None:
        own_v = passed("vertex", vertices, own_v)
    if edges is not None:
        own_e = passed("edge", edges, own_e)
    if vertices is not None:
        out = graph.replaced(own_v, own_e)
        ids = out.v().select("id")
        own_e = {k: e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi") for k, e in own_e.items()}
    return graph.replaced(own_v, own_e)
