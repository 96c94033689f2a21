"""call(): services by name, and the steps that stand for some.  A score becomes a property of the vertices of the rest of the traversal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, at
from ..plans.steps import Step, Token, Traversal, UnsupportedTraversal
from . import algorithms as A
from .stream import Stream

if TYPE_CHECKING:
    from .lowering import Lowering

#: name -> (function to (id, value), the property's name)
SCORES: dict[str, tuple[Callable[..., DataFrame], str]] = {
    "pageRank": (A.page_rank, "gremlin.pageRankVertexProgram.pageRank"),
    "articleRank": (A.article_rank, "articleRank"),
    "connectedComponent": (A.components, "gremlin.connectedComponentVertexProgram.component"),
    "wcc": (A.components, "gremlin.connectedComponentVertexProgram.component"),
    "scc": (A.strong_components, "componentId"),
    "peerPressure": (A.peer_pressure, "gremlin.peerPressureVertexProgram.cluster"),
    "betweenness": (A.betweenness, "betweenness"),
    "closeness": (A.closeness, "closeness"),
    "harmonic": (A.harmonic, "harmonic"),
    "tinker.degree.centrality": (A.degree, "degree"),
    "triangleCount": (A.triangles, "triangleCount"),
    "localClusteringCoefficient": (A.clustering, "localClusteringCoefficient"),
    "kcore": (A.k_core, "coreValue"),
}
OTHERS = ("hits", "nodeSimilarity", "shortestPath", "tinker.search", "schema", "federate", "--list")
CUSTOM: dict[str, Callable[[Graph, DataFrame | None, dict], DataFrame]] = {}
#: Option names and the parameters they set.
OPTIONS = {"alpha": "alpha", "times": "rounds", "maxIterations": "rounds", "epsilon": "epsilon", "weight": "weight", "weightProperty": "weight", "threshold": "threshold", "direction": "direction", "tolerance": "tolerance", "edgeLabels": "labels"}


def service(name: str):
    """Register a function (graph, payload or None, params) -> DataFrame as a service; its columns are a record."""

    def keep(f):
        CUSTOM[name] = f
        return f

    return keep


def decorated(g: Graph, scores: DataFrame, key: str) -> Graph:
    """The graph with a score as a property of its vertices."""
    one = scores.select("id", F.col("value").alias(at(key)))
    return g.replaced({k: df.drop(at(key)).join(one, "id", "left") for k, df in g.vertices.items()})


def _scoped(params: dict[str, Any]) -> dict[str, Any]:
    """Parameters of a function from the options of a step; an `edges` traversal gives direction and labels."""
    out = {OPTIONS[k]: v for k, v in params.items() if k in OPTIONS}
    e = params.get("edges")
    if isinstance(e, Traversal):
        first = e.steps[0]
        out |= {"direction": first.name, "labels": list(first.args) or None}
    if isinstance(out.get("direction"), Token):
        out["direction"] = out["direction"].name
    if isinstance(out.get("labels"), str):
        out["labels"] = [out["labels"]]
    return out


def scored(low: Lowering, s: Stream | None, name: str, params: dict[str, Any]) -> Stream:
    f, key = SCORES[name]
    key = params.get("propertyName") or params.get("property") or key
    low.g = decorated(low.g, A.settled(f(low.g, **_scoped(params))), key)
    if s is None:
        return low.step_V(None, Step("V"))
    return replace(s, df=s.df.select(*s.channels(), "id"), attached=False)


def desugared(low: Lowering, s: Stream, step: Step) -> Stream:
    params = {str(k).rsplit(".", 1)[-1].lstrip("~"): v for k, v in step.extra.get("with", {}).items()}
    if step.name == "shortestPath":
        return paths(low, s, params)
    if step.name == "pageRank" and step.args:
        params["alpha"] = step.args[0]
    return scored(low, s, step.name, params)


def paths(low: Lowering, s: Stream | None, params: dict[str, Any]) -> Stream:
    if "includeEdges" in params:
        raise UnsupportedTraversal("shortestPath() with includeEdges")
    sources = None if s is None else s.df.select("id").distinct()
    target, targets = params.get("target"), None
    if isinstance(target, Traversal):
        everywhere = low.step_V(None, Step("V"))
        targets = low.semi(everywhere, target).df.select("id")
    more = _scoped(params)
    if "distance" in params:
        more["weight"] = params["distance"]
    more.setdefault("direction", "bothE")
    found = A.shortest_paths(low.g, sources, targets, params.get("maxDistance"), **more)
    return Stream(found.select(F.col("path").alias("v")), "list")


def call(low: Lowering, s: Stream | None, step: Step) -> Stream:
    if not step.args:
        step = Step("call", ["--list"], extra=step.extra)
    name = step.args[0]
    params: dict[str, Any] = {}
    for a in step.args[1:]:
        if isinstance(a, dict):
            params |= {getattr(k, "name", k): v for k, v in a.items()}
    params |= step.extra.get("with", {})
    if name in SCORES:
        return scored(low, s, name, params)
    if name == "hits":
        found = A.settled(A.hits(low.g, **_scoped(params)))
        low.g = decorated(decorated(low.g, found.select("id", F.col("hub").alias("value")), "hub"), found.select("id", F.col("authority").alias("value")), "authority")
        return low.step_V(None, Step("V")) if s is None else replace(s, df=s.df.select(*s.channels(), "id"), attached=False)
    if name == "--list":
        names = sorted([*SCORES, *OTHERS, *CUSTOM])
        return Stream(low.g.spark.createDataFrame([(n,) for n in names], "v string"), "value")
    if name == "shortestPath":
        return paths(low, s, params)
    if name == "tinker.search":
        kind = str(params.get("type", "vertex")).lower()
        return Stream(A.search(low.g, params.get("search") or params.get("term") or "", kind).withColumn("pid", F.lit("")), "property", of=kind)
    found = {"nodeSimilarity": lambda: A.node_similarity(low.g, _scoped(params).get("labels")), "schema": lambda: A.schema(low.g)}.get(name)
    if name == "federate":
        return federated(low, params)
    if found is None and name in CUSTOM:
        found = lambda: CUSTOM[name](low.g, s.df if s is not None else None, params)
    if found is None:
        raise UnsupportedTraversal(f"no service {name!r}")
    df = found()
    return Stream(df.select(*(F.col(c).alias(f"f${c}") for c in df.columns)), "record", names=tuple(df.columns))


def federated(low: Lowering, params: dict[str, Any]) -> Stream:
    """A traversal on another graph; its rows go on as values here."""
    from .run import run

    other = low.graphs.get(params.get("graph", ""))
    if other is None:
        raise UnsupportedTraversal(f"no graph {params.get('graph')!r}")
    asked = params.get("traversal") or params.get("query")
    if isinstance(asked, Traversal):
        asked = Traversal(asked.steps, anonymous=False)
    return run(other, asked, graphs={k: g for k, g in low.graphs.items() if g is not other}).stream
