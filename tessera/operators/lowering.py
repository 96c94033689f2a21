"""Steps to DataFrames.

Every step maps a Stream to a Stream.  A nested traversal is never run row by row: it is lowered once over the distinct
payloads (and those channels that it reads) of the stream that hosts it, each keyed as a scope, and its results
are joined back by the contract of the host: existence, none, all, first, or one value.  Steps that see a whole stream (count, order,
limit, dedup, group ...) work within scopes, which makes them right inside nested traversals.

Multiplicities: where no channel tells equal traversers apart, a movement that others follow adds them up (`_n`), so a walk of many hops has a
row for each vertex rather than for each path.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import math, scalars
from ..functions.predicates import comparable, literal, no, test
from ..graph import Graph, at, buckets, settled, united
from ..plans.steps import P, Step, Token, Traversal, UnsupportedTraversal
from .stream import Stream, merged, scalar

MOVES = set("out in both outE inE bothE outV inV bothV otherV to toE toV".split())
#: Steps that see the whole stream: a nested traversal with one of them can't be written in place.
BARRIERS = set("count sum min max mean fold group groupCount order limit range skip tail sample dedup aggregate store cap tree none discard barrier".split())
#: Steps after which equal traversers can't be told apart, so that their multiplicities can be kept as numbers.
PLAIN = MOVES | set("V E has hasLabel hasId hasNot hasKey hasValue where filter not and or is dedup count groupCount values id label identity repeat barrier sum mean min max by times emit until".split())
REDUCERS = set("count sum min max mean fold group groupCount".split())
MAX_LOOPS = 100


def is_local(step: Step) -> bool:
    return any(isinstance(a, Token) and a.name == "local" for a in step.args)


def plain_args(step: Step) -> list[Any]:
    return [a for a in step.args if not (isinstance(a, Token) and a.name in ("local", "global"))]


class Lowering:
    def __init__(self, graph: Graph, whole: Traversal, graphs: dict[str, Graph] | None = None, collapse: bool = True, max_loops: int = MAX_LOOPS):
        self.g, self.graphs, self.max_loops = graph, graphs or {}, max_loops
        names = [s.name for s in whole.walk()]
        self.collapse = collapse and set(names) <= PLAIN
        self.paths = bool({"path", "simplePath", "cyclicPath", "tree"} & set(names))
        self.entered = "otherV" in names
        self.ring = next((s.bys for s in whole.walk() if s.name in ("path", "tree")), [])
        self.side: dict[str, Stream] = {}
        self.depth = 0
        self.rest: list[Step] = []
        self.rebound: set[str] = set()
        self.sack: Any = None
        self.seeds: dict[str, Any] = {}

    # -- chains ---------------------------------------------------------------------------------------------------------

    def chain(self, steps: list[Step], s: Stream | None) -> Stream:
        if s is None and (counted := self._counted_pairs(steps)) is not None:
            return counted
        for i, step in enumerate(steps):
            f: Callable | None = getattr(self, f"step_{step.name}", None)
            if f is None:
                raise UnsupportedTraversal(f"step {step.name}()")
            self.rest = steps[i + 1 :]
            if s is None and step.name not in ("V", "E", "inject", "union", "call", "match", "addV", "mergeV", "addE", "mergeE", "io"):
                raise UnsupportedTraversal(f"{step.name}() can't start a traversal")
            s = f(s, step)
        return s

    def tracked(self, s: Stream) -> Stream:
        """The stream with its payload added to the path."""
        if not self.paths or s.kind not in ("vertex", "edge", "value"):
            return s
        by = self.ring
        if s.kind == "value":
            shown = F.col("v").cast("string")
        elif not by or not any(by):
            shown = F.col("id").cast("string")
        else:
            s = self.attach(s)
            n = F.size("_path") if "_path" in s.df.columns else F.lit(0)
            parts = [self._shown(s, b) for b in by]
            shown = parts[0] if len(parts) == 1 else F.element_at(F.array(*parts), (F.pmod(n, F.lit(len(parts))) + 1).cast("int"))
        key = F.concat(F.lit(s.kind[0]), (F.col("id") if s.kind != "value" else F.col("v")).cast("string"))
        one = F.array(F.struct(key.alias("key"), shown.alias("shown"), F.array().cast("array<string>").alias("labels")))
        return s.to(s.df.withColumn("_path", F.concat("_path", one) if "_path" in s.df.columns else one))

    def _shown(self, s: Stream, by: list[Any]) -> Column:
        if not by:
            return F.col("id").cast("string")
        if isinstance(by[0], Traversal):
            c = self.expression(s, by[0])
            if c is None:
                raise UnsupportedTraversal("path().by() of a movement")
            return c.cast("string")
        return self.key(s, by[0]).cast("string")

    # -- elements ---------------------------------------------------------------------------------------------------------

    def attach(self, s: Stream) -> Stream:
        """Vertices with their label and properties."""
        if s.kind != "vertex" or s.attached:
            return s
        found = self.g.v(s.tables)
        return s.to(s.df.join(found, "id"), attached=True)

    def key(self, s: Stream, name: Any) -> Column:
        """A property, field or token of an attached stream; null where there is none."""
        types = dict(s.df.dtypes)
        if isinstance(name, Token):
            if name.name in ("keys", "key") and s.kind in ("groups", "entry"):
                return F.col("k")
            if name.name in ("values", "value") and s.kind in ("groups", "entry"):
                return F.col("v")
            if name.name == "id":
                return F.coalesce(F.col("uid"), F.col("id").cast("string")) if "uid" in types else F.col("id")
            return F.col({"label": "label", "key": "key", "value": "v"}[name.name])
        if s.kind in ("vertex", "edge"):
            if at(name) not in types:
                return F.lit(None)
            c = F.col(f"`{at(name)}`")
            return F.try_element_at(c, F.lit(1))["value"] if name in self.g.multi and s.kind == "vertex" else c
        if s.kind == "record":
            return F.col(f"`f${name}`") if name in s.names else F.lit(None)
        if s.kind == "property" and name in ("key", "value"):
            return F.col("key" if name == "key" else "v")
        if s.kind == "value" and s.vtype.startswith("struct"):
            return F.col("v")[name]
        if s.kind == "value" and s.vtype.startswith("map"):
            return F.try_element_at("v", F.lit(name))
        raise UnsupportedTraversal(f"by({name!r}) on {s.kind}")

    def values_of(self, s: Stream, name: str) -> tuple[Column, bool]:
        """A property's column, and whether it is an array of structs."""
        return (F.col(f"`{at(name)}`"), True) if name in self.g.multi and s.kind == "vertex" and at(name) in s.df.columns else (self.key(s, name), False)

    # -- nested traversals --------------------------------------------------------------------------------------------------

    def expression(self, s: Stream, t: Traversal) -> Column | None:
        """A nested traversal of one value that needs no join, as a column over the attached stream; None if it isn't one."""
        c: Column | None = None
        for i, step in enumerate(t.steps):
            n, a = step.name, plain_args(step)
            if step.bys and n != "math" or any(isinstance(x, Traversal) for x in a):
                return None
            if i == 0:
                if n == "values" and len(a) == 1 and s.kind in ("vertex", "edge") and not (a[0] in self.g.multi and s.kind == "vertex"):
                    c = self.key(s, a[0])
                elif n in ("id", "label") and s.kind in ("vertex", "edge"):
                    c = self.key(s, Token(n))
                elif n == "constant":
                    c = literal(a[0])
                elif n == "identity" and s.kind == "value":
                    c = F.col("v")
                elif n == "loops" and "_loops" in s.df.columns:
                    c = F.col("_loops")
                elif n == "sack" and "_sack" in s.df.columns:
                    c = F.col("_sack")
                elif n == "select" and len(a) == 1 and a[0] in s.aliases and s.aliases[a[0]][0] == "value":
                    c = F.col(f"`a${a[0]}`")
                elif n == "select" and len(a) == 1 and isinstance(a[0], Token) and s.kind in ("groups", "entry"):
                    c = self.key(s, a[0])
                elif s.kind == "value" and n in scalars.VALUE and not is_local(step):
                    c = scalars.VALUE[n](F.col("v"), s.vtype, *a)
                elif n == "math" and s.kind == "value" and not step.bys:
                    c = math.compiled(a[0], lambda name: F.col("v") if name == "_" else F.col(f"`a${name}`"))
                else:
                    return None
            elif n in scalars.VALUE and not is_local(step) and n not in ("asNumber", "asBool", "asDate", "reverse"):
                c = scalars.VALUE[n](c, "string", *a)
            elif n == "math" and set(math.names(a[0])) <= {"_"}:
                c = math.compiled(a[0], lambda name, c=c: c)
            else:
                return None
        return c

    def condition(self, s: Stream, t: Traversal) -> Column | None:
        """A nested filter that needs no join, as a column over the attached stream; None if it isn't one."""
        out, c, kind = F.lit(True), None, ""
        for step in t.steps:
            n, a = step.name, step.args
            if n in ("has", "hasLabel", "hasId", "hasNot") and c is None and s.kind in ("vertex", "edge") and not any(isinstance(x, Traversal) for x in a):
                out = out & self.has_column(s, step)
            elif n in ("and", "or") and c is None and a and all(isinstance(x, Traversal) for x in a):
                parts = [self.condition(s, x) for x in a]
                if any(p is None for p in parts):
                    return None
                out = out & reduce(lambda p, q: p & q if n == "and" else p | q, parts)  # noqa: B023
            elif n in ("not", "where", "filter") and c is None and len(a) == 1 and isinstance(a[0], Traversal):
                p = self.condition(s, a[0])
                if p is None:
                    return None
                out = out & (no(p) if n == "not" else p)
            elif n == "is" and len(a) == 1 and not self._reads(a[0]):
                if c is None and s.kind != "value":
                    return None
                out = out & test(F.col("v") if c is None else c, a[0], s.vtype if c is None else kind)
            elif n == "identity":
                continue
            elif c is None and out is not None:
                c = self.expression(s, Traversal([step]))
                if c is None:
                    return None
                kind = s.df.select(c.alias("c")).dtypes[0][1]
                out = out & (c.isNotNull() if n not in ("constant",) else F.lit(True))
            else:
                return None
        return out

    @staticmethod
    def _reads(p: Any) -> bool:
        return isinstance(p, Traversal) or isinstance(p, P) and any(isinstance(x, Traversal) or Lowering._reads(x) for x in p.args)

    def child(self, s: Stream, t: Traversal) -> tuple[Stream, list[tuple[str, str]]]:
        """The results of t for each distinct payload of s (with the channels that t reads), and the pairs of columns to join back on."""
        self.depth += 1
        names = {x.name for x in t.walk()}
        wanted = t.strings()
        whole = bool(names & {"valueMap", "elementMap", "properties", "values", "propertyMap"})
        keys = [c for c in s.keys() if not c.startswith("@") or whole or c[1:] in wanted]
        keys += [f"a${a}" for a in s.aliases if a in wanted or names & {"match", "where", "select", "math", "dedup"} and any(a in w for w in wanted)]
        keys += [c for c, n in (("_path", {"path", "simplePath", "cyclicPath", "tree"}), ("_sack", {"sack"}), ("_loops", {"loops"}), ("_from", {"otherV"})) if c in s.df.columns and names & n]
        keys = list(dict.fromkeys(keys))
        pairs = [(c, f"k${self.depth}_{i}") for i, c in enumerate(keys)]
        domain = s.df.select(*(F.col(f"`{c}`") for c in keys)).distinct()
        domain = domain.select(*(F.col(f"`{c}`") for c in keys), *(F.col(f"`{c}`").alias(k) for c, k in pairs))
        scope = tuple(k for _, k in pairs)
        inner = replace(s, df=domain, scope=scope, domain=domain.select(*scope), attached=False if s.kind == "vertex" else s.attached, order=(), aliases={a: x for a, x in s.aliases.items() if f"a${a}" in keys})
        rest = self.rest
        out = self.chain(t.steps, inner).single()
        self.rest = rest
        return out, pairs

    @staticmethod
    def on(pairs: list[tuple[str, str]]) -> Column:
        return reduce(lambda a, b: a & b, (F.col(f"`{c}`") == F.col(k) if c in ("id", "src", "dst") else F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in pairs))

    def semi(self, s: Stream, t: Traversal, keep: bool = True) -> Stream:
        """Traversers for which t has a result, or has none."""
        attached = self.attach(s) if s.kind == "vertex" and not self._moves(t) else s
        c = self.condition(attached, t)
        if c is not None:
            return attached.where(c if keep else no(c))
        out, pairs = self.child(s, t)
        found = out.df.select(*(k for _, k in pairs)).distinct()
        return s.to(s.df.join(found, self.on(pairs), "left_semi" if keep else "left_anti"))

    @staticmethod
    def _moves(t: Traversal) -> bool:
        return any(x.name in MOVES for x in t.walk())

    def rejoined(self, s: Stream, out: Stream, pairs: list[tuple[str, str]]) -> Stream:
        """Each traverser of s with all results of its scope."""
        own = set(out.channels())
        left = s.df.select(*s.channels(), *(F.col(f"`{c}`").alias(f"j${c}") for c, _ in pairs if c not in s.channels()))
        # what the nested traversal has set or moved on replaces what was there
        left = left.select(*(c for c in left.columns if c not in own or any(c == p for p, _ in pairs)))
        cond = reduce(lambda a, b: a & b, (F.col(f"`{c if c in s.channels() else 'j$' + c}`").eqNullSafe(F.col(f"`{k}`")) for c, k in pairs))
        right = out.df
        twice = [c for c in left.columns if c in right.columns]
        left = left.withColumnsRenamed({c: f"l${c}" for c in twice})
        cond = reduce(lambda a, b: a & b, (F.col(f"`{('l$' + c if c in twice else c) if c in s.channels() else 'j$' + c}`").eqNullSafe(F.col(f"`{k}`")) for c, k in pairs)) if twice else cond
        df = left.join(right, cond).drop(*(f"j${c}" for c, _ in pairs), *(f"l${c}" for c in twice), *(k for _, k in pairs))
        return out.to(df, scope=s.scope, domain=s.domain, order=(), aliases={**s.aliases, **out.aliases})

    def first(self, out: Stream, pairs: list[tuple[str, str]]) -> Stream:
        """The first result of each scope, in order of emission or else of the payload."""
        terms = self.terms(out) or [F.col(f"`{c}`") for c in out.keys() if not dict(out.df.dtypes)[c].startswith("map")]
        w = Window.partitionBy(*(k for _, k in pairs)).orderBy(*terms)
        return out.to(out.df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r"))

    def by(self, s: Stream, by: list[Any], name: str) -> Stream:
        """s with the by()'s value as a column; null where it has none."""
        args = [a for a in by if not (isinstance(a, Token) and a.name in ("asc", "desc", "incr", "decr", "shuffle"))]
        if not args:
            return s.to(s.df.withColumn(name, self.identity(s)))
        x = args[0]
        if not isinstance(x, Traversal):
            s = self.attach(s)
            return s.to(s.df.withColumn(name, self.key(s, x)))
        if not x.steps:
            return s.to(s.df.withColumn(name, self.identity(s)))
        attached = self.attach(s) if s.kind == "vertex" and not self._moves(x) else s
        c = self.expression(attached, x)
        if c is not None:
            return attached.to(attached.df.withColumn(name, c))
        out, pairs = self.child(s, x)
        if x.steps[-1].name not in REDUCERS or out.kind == "groups":
            out = self.first(out, pairs)
        one = scalar(out).df.select(*(k for _, k in pairs), F.col("v").alias(name))
        if out.kind == "groups":
            one = out.df.groupBy(*(k for _, k in pairs)).agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias(name))
        joined = s.df.join(one, self.on(pairs), "left").drop(*(k for _, k in pairs))
        return s.to(joined)

    def identity(self, s: Stream) -> Column:
        return {"vertex": lambda: F.col("id"), "edge": lambda: F.col("id"), "property": lambda: F.col("v")}.get(s.kind, lambda: F.col("v") if "v" in s.df.columns and s.kind in ("value", "list") else F.struct(*s.payload()))()

    # -- sources ------------------------------------------------------------------------------------------------------------

    def step_V(self, s: Stream | None, step: Step) -> Stream:
        return self._source(s, step, "vertex", self.g.v())

    def step_E(self, s: Stream | None, step: Step) -> Stream:
        return self._source(s, step, "edge", self.g.e())

    def _source(self, s: Stream | None, step: Step, kind: str, df: DataFrame) -> Stream:
        ids = [x for a in step.args for x in (a if isinstance(a, (list, set)) else [a])]
        fresh = Stream(df, kind, attached=True)
        if step.args:
            fresh = fresh.where(self.has_id(fresh, ids))
        if s is None:
            if self.sack is not None:
                fresh = fresh.to(fresh.df.withColumn("_sack", literal(self.sack)))
            return self.tracked(fresh)
        # every traverser meets every element: a product by definition, of which filters on ids leave a join
        base = s.df.select(*s.channels())
        return self.tracked(s.to(base.crossJoin(fresh.df), kind, attached=True))

    def step_inject(self, s: Stream | None, step: Step) -> Stream:
        if s is not None:
            fresh = self._injected(step.args)
            missing = s.channels()
            if s.scope or missing:
                raise UnsupportedTraversal("inject() into a nested traversal")
            return merged([scalar(s.single()), fresh])
        return self.tracked(self._injected(step.args))

    def _injected(self, args: list[Any]) -> Stream:
        kinds = {type(a) for a in args if a is not None}
        if kinds and kinds <= {list, set, tuple}:
            df = united([self.g.spark.range(1).select(literal(list(a)).alias("v")) for a in args])
            return Stream(df, "list")
        if kinds == {dict}:
            return Stream(united([self.g.spark.range(1).select(literal(a).alias("v")) for a in args]), "value")
        if len(kinds) > 1:
            args = [float(a) for a in args] if kinds <= {int, float} else [None if a is None else str(a) for a in args]
        one = next((a for a in args if a is not None), None)
        kind = "boolean" if isinstance(one, bool) else "long" if isinstance(one, int) else "double" if isinstance(one, float) else "timestamp" if hasattr(one, "year") else "string"
        return Stream(self.g.spark.createDataFrame([(a,) for a in args], f"v {kind}"), "value")

    # -- movement -------------------------------------------------------------------------------------------------------------

    def edges_for(self, s: Stream, labels: list[str], direction: str) -> tuple[list[str] | None, set[str] | None]:
        """The edge labels to read, and the vertex tables they lead to."""
        use = [k for k in self.g.edges if not labels or k in labels]
        if s.tables is not None:
            near = 0 if direction == "out" else 1
            use = [k for k in use if k not in self.g.ends or self.g.ends[k][near] & s.tables]
        if any(k not in self.g.ends for k in use):
            return use, None
        return use, set().union(*(self.g.ends[k][1 if direction == "out" else 0] for k in use)) if use else set()

    def _adjacent(self, s: Stream, labels: list[str], direction: str) -> tuple[DataFrame, set[str] | None]:
        """(from, to) of the edges."""
        use, tables = self.edges_for(s, labels, direction)
        e = self.g.e(set(use))
        a, b = ("src", "dst") if direction == "out" else ("dst", "src")
        return e.select(F.col(a).alias("_a"), F.col(b).alias("_b")), tables

    def _hop(self, s: Stream, labels: list[str], directions: list[str]) -> Stream:
        if s.kind != "vertex":
            raise UnsupportedTraversal(f"movement from {s.kind}")
        if any(not isinstance(x, str) for x in labels):
            raise UnsupportedTraversal("edge labels are strings")
        found = [self._adjacent(s, labels, d) for d in directions]
        adjacent = found[0][0] if len(found) == 1 else found[0][0].unionAll(found[1][0])
        tables = None if any(t is None for _, t in found) else set().union(*(t for _, t in found))
        df = s.df.select(*s.channels(), "id").join(adjacent, F.col("id") == F.col("_a")).drop("id", "_a").withColumnRenamed("_b", "id")
        out = s.to(df, "vertex", tables=tables)
        if self.collapse and not s.order and any(x.name in MOVES or x.name in ("count", "groupCount", "repeat") for x in self.rest):
            n = F.sum(F.col("_n") if s.bulky else F.lit(1)).alias("_n")
            keep = [c for c in out.channels() if c != "_n"]
            out = out.to(df.groupBy(*keep, "id").agg(n))
        return self.tracked(out)

    def step_out(self, s: Stream, step: Step) -> Stream:
        return self._hop(s, step.args, ["out"])

    def step_in(self, s: Stream, step: Step) -> Stream:
        return self._hop(s, step.args, ["in"])

    def step_both(self, s: Stream, step: Step) -> Stream:
        return self._hop(s, step.args, ["out", "in"])

    def _incident(self, s: Stream, labels: list[str], directions: list[str]) -> Stream:
        parts, used = [], set()
        for d in directions:
            use, _ = self.edges_for(s, labels, d)
            used |= set(use)
            e = self.g.e(set(use)).withColumn("_a", F.col("src" if d == "out" else "dst"))
            base = s.df.select(*(c for c in s.channels() if c != "_from"), F.col("id").alias("_v"))
            parts.append(base.join(e, F.col("_v") == F.col("_a")).drop("_a").withColumnRenamed("_v", "_from"))
        df = united(parts)
        return self.tracked(s.to(df if self.entered else df.drop("_from"), "edge", tables=used, attached=True))

    def step_outE(self, s: Stream, step: Step) -> Stream:
        return self._incident(s, step.args, ["out"])

    def step_inE(self, s: Stream, step: Step) -> Stream:
        return self._incident(s, step.args, ["in"])

    def step_bothE(self, s: Stream, step: Step) -> Stream:
        return self._incident(s, step.args, ["out", "in"])

    def _endpoint(self, s: Stream, column: Column, near: list[int]) -> Stream:
        if s.kind != "edge":
            raise UnsupportedTraversal(f"an endpoint of {s.kind}")
        tables = None
        if s.tables is not None and all(k in self.g.ends for k in s.tables):
            tables = set().union(*(self.g.ends[k][i] for k in s.tables for i in near)) if s.tables else set()
        return self.tracked(s.to(s.df.select(*(c for c in s.channels() if c != "_from"), column.alias("id")), "vertex", tables=tables))

    def step_outV(self, s: Stream, step: Step) -> Stream:
        return self._endpoint(s, F.col("src"), [0])

    def step_inV(self, s: Stream, step: Step) -> Stream:
        return self._endpoint(s, F.col("dst"), [1])

    def step_bothV(self, s: Stream, step: Step) -> Stream:
        return self._endpoint(s, F.explode(F.array("src", "dst")), [0, 1])

    def step_otherV(self, s: Stream, step: Step) -> Stream:
        return self._endpoint(s, F.when(F.col("_from") == F.col("src"), F.col("dst")).otherwise(F.col("src")), [0, 1])

    def _directed(self, step: Step) -> tuple[str, list[Any]]:
        d = step.args[0]
        return {"OUT": "out", "IN": "in", "BOTH": "both"}[d.name], step.args[1:]

    def step_to(self, s: Stream, step: Step) -> Stream:
        d, labels = self._directed(step)
        return self._hop(s, labels, {"out": ["out"], "in": ["in"], "both": ["out", "in"]}[d])

    def step_toE(self, s: Stream, step: Step) -> Stream:
        d, labels = self._directed(step)
        return self._incident(s, labels, {"out": ["out"], "in": ["in"], "both": ["out", "in"]}[d])

    def step_toV(self, s: Stream, step: Step) -> Stream:
        d, _ = self._directed(step)
        return getattr(self, f"step_{d}V")(s, step)

    # -- filters ---------------------------------------------------------------------------------------------------------------

    def has_id(self, s: Stream, ids: list[Any]) -> Column:
        if len(ids) == 1 and isinstance(ids[0], P):
            return test(F.col("id"), ids[0], "bigint")
        ids = [F.col("id") if isinstance(x, Traversal) else x for x in ids]
        numbers = [x for x in ids if isinstance(x, int) and not isinstance(x, bool)]
        texts = [x for x in ids if isinstance(x, str)]
        out = F.col("id").isin(numbers) if numbers else F.lit(False)
        if texts and "uid" in s.df.columns:
            out = out | F.coalesce(F.col("uid").isin(texts), F.lit(False))
        return out

    def has_column(self, s: Stream, step: Step) -> Column:
        a = step.args
        if step.name == "hasLabel":
            if len(a) == 1 and isinstance(a[0], P):
                return F.exists("labels", lambda x: test(x, a[0], "string")) if s.kind == "vertex" else test(F.col("label"), a[0], "string")
            names = [x for x in a if isinstance(x, str)]
            if s.kind != "vertex":
                return F.col("label").isin(names)
            return F.arrays_overlap("labels", F.array(*map(F.lit, names))) if any("::" in k for k in self.g.vertices) else F.col("label").isin(names)
        if step.name == "hasId":
            return self.has_id(s, [x for y in a for x in (y if isinstance(y, (list, set)) else [y])])
        if step.name == "hasNot":
            c, many = self.values_of(s, a[0])
            return F.size(c) == 0 if many else c.isNull()
        label = F.lit(True)
        if len(a) == 3:
            label, a = F.col("label") == a[0], a[1:]
        if isinstance(a[0], Token):
            if a[0].name == "id":
                return label & self.has_id(s, [a[1]])
            return label & test(self.key(s, a[0]), a[1], "string")
        c, many = self.values_of(s, a[0])
        if len(a) == 1:
            return label & (F.size(c) > 0 if many else c.isNotNull())
        kind = dict(s.df.dtypes).get(at(a[0]), "void")
        if many:
            inner = s.df.select(F.element_at(c, 1)["value"].alias("c")).dtypes[0][1]
            return label & F.exists(c, lambda x: test(x["value"], a[1], inner))
        if a[1] is None:
            return F.lit(False)
        return label & c.isNotNull() & test(c, a[1], kind)

    def step_has(self, s: Stream, step: Step) -> Stream:
        if s.kind == "property":
            return s.where(test(F.col("key"), step.args[0], "string"))
        if len(step.args) == 2 and isinstance(step.args[1], Traversal):
            first = [Step("values", [step.args[0]])] if isinstance(step.args[0], str) else [Step(step.args[0].name)]
            return self.semi(s, Traversal([*first, *step.args[1].steps]))
        s = self.attach(s)
        return s.where(self.has_column(s, step))

    def step_hasLabel(self, s: Stream, step: Step) -> Stream:
        names = [x for x in step.args if isinstance(x, str)]
        if s.kind == "vertex" and len(names) == len(step.args) and not s.attached:
            tables = set().union(*(self.g.tables(x) for x in names))
            tables = tables if s.tables is None else tables & s.tables
            if s.tables is not None and tables == s.tables:
                return s  # the movement leads nowhere else
            s = s.to(s.df, tables=tables)
        s = self.attach(s)
        out = s.where(self.has_column(s, step))
        if len(names) == len(step.args):
            tables = set().union(*(self.g.tables(x) for x in names)) if s.kind == "vertex" else set(names)
            out = out.to(out.df, tables=tables if s.tables is None else tables & s.tables)
        return out

    def step_hasId(self, s: Stream, step: Step) -> Stream:
        s = self.attach(s) if any(isinstance(x, str) for x in step.args) else s
        return s.where(self.has_column(s, step))

    def step_hasNot(self, s: Stream, step: Step) -> Stream:
        s = self.attach(s)
        return s.where(self.has_column(s, step))

    def step_hasKey(self, s: Stream, step: Step) -> Stream:
        if s.kind != "property":
            raise UnsupportedTraversal(f"hasKey() on {s.kind}")
        p = step.args[0] if isinstance(step.args[0], P) else P("within", tuple(step.args))
        return s.where(test(F.col("key"), p, "string"))

    def step_hasValue(self, s: Stream, step: Step) -> Stream:
        if s.kind != "property":
            raise UnsupportedTraversal(f"hasValue() on {s.kind}")
        p = step.args[0] if isinstance(step.args[0], P) else P("within", tuple(step.args))
        return s.where(test(F.col("v"), p, s.vtype))

    def step_is(self, s: Stream, step: Step) -> Stream:
        p = step.args[0]
        if self._side(p):
            return self._within(s, "v", p)
        return s.where(test(F.col("v"), p, s.vtype))

    def _side(self, p: Any) -> bool:
        return isinstance(p, P) and p.op in ("within", "without") and len(p.args) == 1 and isinstance(p.args[0], str) and p.args[0] in self.side

    def _within(self, s: Stream, column: str, p: P) -> Stream:
        """Membership in a collection gathered so far."""
        held = self.side[p.args[0]].df.select(F.col("v").alias("_m")).distinct()
        return s.to(s.df.join(held, F.col(f"`{column}`") == F.col("_m"), "left_semi" if p.op == "within" else "left_anti"))

    def step_where(self, s: Stream, step: Step) -> Stream:
        a = step.args
        if len(a) == 1 and isinstance(a[0], Traversal):
            return self._where_traversal(s, a[0])
        left, p = (a[0], a[1]) if len(a) == 2 else (None, a[0])
        if self._side(p) and left is None:
            s2 = self.by(s, step.bys[0] if step.bys else [], "_l")
            return s2.to(self._within(s2, "_l", p).df.drop("_l"))
        bys = step.bys or [[]]
        out = self._side_value(s, left, bys[0], "_l")
        names: list[str] = []

        def bound(p: P) -> P:
            if p.op in ("and", "or", "not"):
                return P(p.op, tuple(bound(x) for x in p.args))
            args = []
            for x in p.args:
                if not isinstance(x, str) or x not in s.aliases:
                    raise UnsupportedTraversal(f"where(): {x!r} names nothing")
                names.append(x)
                args.append(F.col(f"_r{len(names) - 1}"))
            if p.op in ("within", "without"):
                same = [P("eq", (x,)) for x in args]
                any_ = reduce(lambda x, y: P("or", (x, y)), same)
                return any_ if p.op == "within" else P("not", (any_,))
            return P(p.op, tuple(args))

        p = bound(p)
        for i, n in enumerate(names):
            out = self._side_value(out, n, bys[(i + 1) % len(bys)], f"_r{i}")
        kind = dict(out.df.dtypes)["_l"]
        out = out.where(F.col("_l").isNotNull() & test(F.col("_l"), p, kind)) if any(bys) else out.where(test(F.col("_l"), p, kind))
        return out.to(out.df.drop("_l", *(f"_r{i}" for i in range(len(names)))))

    def _side_value(self, s: Stream, name: str | None, by: list[Any], to: str) -> Stream:
        """What a label, or else the payload, has under by()."""
        if name is None:
            return self.by(s, by, to)
        kind, tables = s.aliases[name]
        if not by or kind == "value":
            c = F.col(f"`a${name}`")
            return s.to(s.df.withColumn(to, c["id"] if kind == "edge" else c))
        v = self.g.v(tables) if kind == "vertex" else self.g.e(tables)
        one = Stream(v, kind, attached=True, tables=tables)
        one = self.by(one, by, to).df.select(F.col("id").alias("_i"), to)
        c = F.col(f"`a${name}`") if kind == "vertex" else F.col(f"`a${name}`.id")
        return s.to(s.df.join(one, c == F.col("_i"), "left").drop("_i"))

    def _counted_pairs(self, steps: list[Step]) -> Stream | None:
        """... as(a) ... as(b).where(a, gt(b)).by(x).by(y).count(), without the pairs: walks to the vertex before the last movement, and from it on, meet
        there, and their values are counted against each other in order.  None where the traversal isn't of that form."""
        if len(steps) < 6 or self.paths or self.entered or self.sack is not None:
            return None
        *walk, b, where, count = steps
        if (b.name, where.name, count.name) != ("as", "where", "count") or count.args or len(where.args) != 2 or len(b.args) != 1:
            return None
        name, p = where.args
        if not isinstance(p, P) or p.op not in ("lt", "lte", "gt", "gte") or p.args != (b.args[0],) or len(where.bys) != 2 or any(len(x) != 1 or not isinstance(x[0], str) for x in where.bys):
            return None
        named = [i for i, x in enumerate(walk) if x.name == "as"]
        if not named or walk[named[-1]].args != [name] or name == b.args[0]:
            return None
        between, simple = walk[named[-1] + 1 :], {"out", "in", "both", "has", "hasLabel", "hasId", "hasNot"}
        moves = [i for i, x in enumerate(between) if x.name in ("out", "in", "both")]
        if not moves or any(x.name not in simple or any(True for _ in x.traversals()) for x in between):
            return None
        cut = named[-1] + 1 + moves[-1]
        left = self.chain_of(walk[:cut])
        if left.kind != "vertex" or left.scope or left.order:
            return None
        met = left.df.select("id").distinct().withColumn("k$met", F.col("id"))
        right = self.chain_of([*walk[cut:], b], Stream(met, "vertex", tables=left.tables))
        x = self._side_value(left, name, where.bys[0], "_v").df.select(F.col("id").alias("_k"), "_v", left.size().alias("_x"), F.lit(0).cast("bigint").alias("_y"))
        y = self._side_value(right, b.args[0], where.bys[1], "_v").df.select(F.col("k$met").alias("_k"), "_v", F.lit(0).cast("bigint").alias("_x"), F.lit(1).alias("_y"))
        kinds = {dict(df.dtypes)["_v"] for df in (x, y)}
        if not (kinds <= {"tinyint", "smallint", "int", "bigint"} or kinds <= {"tinyint", "smallint", "int", "float", "double"} or len(kinds) == 1 and kinds <= {"string", "timestamp", "timestamp_ntz", "date"}):
            return None
        # the numbers of both sides by value, dealt out in order: a vertex where many walks meet takes many tasks
        rows = x.unionAll(y).where("_v is not null").groupBy("_k", "_v").agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y"))
        rows = settled(rows.repartitionByRange(buckets(self.g.spark), "_k", "_v").withColumn("_p", F.spark_partition_id()))
        low, high = ("_y", "_x") if p.op in ("gt", "gte") else ("_x", "_y")
        earlier = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        before = rows.groupBy("_k", "_p").agg(F.sum(low).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")
        within = Window.partitionBy("_k", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0 if p.op in ("gte", "lte") else -1)
        own = rows.withColumn("_own", F.coalesce(F.sum(low).over(within), F.lit(0))).where(f"{high} > 0")
        n = own.join(before, ["_k", "_p"]).agg(F.coalesce(F.sum(F.col(high) * (F.col("_own") + F.col("_before"))), F.lit(0)).cast("bigint").alias("v"))
        return Stream(n, "value")

    def chain_of(self, steps: list[Step], s: Stream | None = None) -> Stream:
        """A part of a chain by itself."""
        rest, out = self.rest, self.chain(steps, s)
        self.rest = rest
        return out

    def _where_traversal(self, s: Stream, t: Traversal) -> Stream:
        """where(as('a') ... as('b')): from one bound label, to another if it ends so."""
        steps = t.steps
        if steps and steps[0].name == "as" and steps[0].args[0] in s.aliases:
            body = [Step("select", [steps[0].args[0]]), *steps[1:]]
            if body[-1].name == "as" and body[-1].args[0] in s.aliases:
                body = [*body[:-1], Step("where", [P("eq", (body[-1].args[0],))])]
            return self.semi(s, Traversal(body))
        if steps and steps[-1].name == "as" and steps[-1].args[0] in s.aliases:
            return self.semi(s, Traversal([*steps[:-1], Step("where", [P("eq", (steps[-1].args[0],))])]))
        return self.semi(s, t)

    def step_filter(self, s: Stream, step: Step) -> Stream:
        return self.step_where(s, step)

    def step_not(self, s: Stream, step: Step) -> Stream:
        return self.semi(s, step.args[0], keep=False)

    def step_and(self, s: Stream, step: Step) -> Stream:
        for t in step.args:
            s = self._where_traversal(s, t)
        return s

    def step_or(self, s: Stream, step: Step) -> Stream:
        whole = Traversal([Step("or", step.args)])
        attached = self.attach(s) if s.kind == "vertex" and not any(self._moves(t) for t in step.args) else s
        c = self.condition(attached, whole)
        if c is not None:
            return attached.where(c)
        found = [self.child(s, t) for t in step.args]
        # each arm has keys of its own names: bring them to those of the first, if they read the same columns
        if len({tuple(c for c, _ in p) for _, p in found}) > 1:
            union = Traversal([Step("union", step.args)])
            return self.semi(s, union)
        pairs = found[0][1]
        keys = united([o.df.select(*(F.col(k).alias(m) for (_, k), (_, m) in zip(p, pairs, strict=True))) for o, p in found]).distinct()
        return s.to(s.df.join(keys, self.on(pairs), "left_semi"))

    def step_identity(self, s: Stream, step: Step) -> Stream:
        return s

    step_barrier = step_identity

    def step_discard(self, s: Stream, step: Step) -> Stream:
        return s.where(F.lit(False))

    def step_none(self, s: Stream, step: Step) -> Stream:
        return self._quantified(s, step) if step.args else self.step_discard(s, step)

    def step_all(self, s: Stream, step: Step) -> Stream:
        return self._quantified(s, step)

    def step_any(self, s: Stream, step: Step) -> Stream:
        return self._quantified(s, step)

    def _quantified(self, s: Stream, step: Step) -> Stream:
        return s.where(scalars.quantified(step.name, F.col("v"), step.args[0], self._element(s)))

    @staticmethod
    def _element(s: Stream) -> str:
        t = s.vtype
        return t[6:-1] if t.startswith("array<") else "string"

    def step_coin(self, s: Stream, step: Step) -> Stream:
        return s.single().where(F.rand(42) < float(step.args[0]))

    def step_dedup(self, s: Stream, step: Step) -> Stream:
        if is_local(step):
            return s.value(F.array_distinct("v"), s.kind)
        names = [a for a in plain_args(step) if isinstance(a, str)]
        if s.bulky:
            s = s.to(s.df.drop("_n"))
        if names:
            cols = [f"a${n}" for n in names]
            missing = [n for n in names if n not in s.aliases]
            if missing:
                return s.where(F.lit(False))
            if step.bys:
                for i, n in enumerate(names):
                    kind, tables = s.aliases[n]
                    one = self.by(Stream(self.g.v(tables), kind, attached=True, tables=tables), step.bys[i % len(step.bys)], f"_d{i}").df.select(F.col("id").alias("_i"), f"_d{i}")
                    s = s.to(s.df.join(one, F.col(f"`a${n}`") == F.col("_i")).drop("_i"))
                cols = [f"_d{i}" for i in range(len(names))]
        elif step.bys:
            s = self.by(s, step.bys[0], "_d0")
            s = s.where(F.col("_d0").isNotNull())
            cols = ["_d0"]
        else:
            cols = s.keys()
            if not s.order and not [c for c in s.channels() if not c.startswith("k$")]:
                return s.to(s.df.dropDuplicates([*s.scope, *cols]))
        w = Window.partitionBy(*(F.col(f"`{c}`") for c in [*s.scope, *cols])).orderBy(*(self.terms(s) or [F.col(f"`{c}`") for c in s.keys()]))
        df = s.df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", *(c for c in s.df.columns if c.startswith("_d") and c[2:].isdigit()))
        return s.to(df)

    def _section(self, step: Step) -> Column:
        """The path from the last place with the label of from() to that of to(); from its start and to its end without them."""
        path = F.col("_path")
        at_label = lambda name: F.array_max(F.transform(path, lambda e, i: F.when(F.array_contains(e["labels"], name), i + 1)))
        sides = {side: step.extra[side] for side in ("from", "to") if side in step.extra}
        if not sides:
            return path
        if any(not isinstance(x, str) for x in sides.values()) or len(step.bys) > 1:
            raise UnsupportedTraversal(f"{step.name}() with from() or to() that are no labels, or with several by()")
        start = F.coalesce(at_label(sides["from"]), F.lit(1)) if "from" in sides else F.lit(1)
        end = F.coalesce(at_label(sides["to"]), F.size(path)) if "to" in sides else F.size(path)
        return F.slice(path, start, F.greatest(end - start + 1, F.lit(0)))

    def step_simplePath(self, s: Stream, step: Step) -> Stream:
        keys = self._section(step).getField("key")
        return s.where(F.size(F.array_distinct(keys)) == F.size(keys))

    def step_cyclicPath(self, s: Stream, step: Step) -> Stream:
        keys = self._section(step).getField("key")
        return s.where(F.size(F.array_distinct(keys)) < F.size(keys))

    # -- reads --------------------------------------------------------------------------------------------------------------------

    def step_values(self, s: Stream, step: Step) -> Stream:
        if s.kind == "record":
            return self.step_select(s, Step("select", step.args))
        s = self.attach(s)
        names = step.args or self.g.keys(s.kind)
        parts = []
        for n in names:
            c, many = self.values_of(s, n)
            if at(n) not in s.df.columns:
                continue
            parts.append(s.value(F.explode(F.transform(c, lambda x: x["value"])) if many else c).where("v is not null") if many else s.where(c.isNotNull()).value(c))
        return self.tracked(merged(parts) if parts else s.value(F.lit(None).cast("string")).where(F.lit(False)))

    def step_id(self, s: Stream, step: Step) -> Stream:
        if s.kind == "property":
            return s.value(F.col("pid"))
        s = self.attach(s) if s.kind == "vertex" and any("uid" in df.columns for df in self.g.vertices.values()) else s
        return self.tracked(s.value(self.key(s, Token("id"))))

    def step_label(self, s: Stream, step: Step) -> Stream:
        s = self.attach(s)
        return self.tracked(s.value(F.col("key" if s.kind == "property" else "label")))

    def step_labels(self, s: Stream, step: Step) -> Stream:
        s = self.attach(s)
        return s.value(F.explode("labels") if s.kind == "vertex" else F.col("label"))

    def _properties(self, s: Stream, step: Step) -> list[str]:
        return [a for a in step.args if isinstance(a, str)] or [k for k in self.g.keys(s.kind) if at(k) in s.df.columns]

    def step_valueMap(self, s: Stream, step: Step) -> Stream:
        s = self.attach(s).single()
        tokens = any(a is True for a in step.args) or bool(step.extra.get("with"))
        cols = []
        for n in self._properties(s, step):
            c, many = self.values_of(s, n)
            one = F.when(F.size(c) > 0, F.transform(c, lambda x: x["value"])) if many else F.when(c.isNotNull(), F.array(c)) if s.kind == "vertex" else c
            cols.append(one.alias(f"f${n}"))
        names = self._properties(s, step)
        if tokens:
            cols, names = [F.col("id").alias("f$id"), F.col("label").alias("f$label"), *cols], ["id", "label", *names]
        return s.to(s.df.select(*s.channels(), *cols), "record", names=tuple(names))

    def step_elementMap(self, s: Stream, step: Step) -> Stream:
        s = self.attach(s).single()
        cols, names = [F.col("id").alias("f$id"), F.col("label").alias("f$label")], ["id", "label"]
        if s.kind == "edge":
            cols += [F.col("src").alias("f$OUT"), F.col("dst").alias("f$IN")]
            names += ["OUT", "IN"]
        for n in self._properties(s, step):
            cols.append(self.key(s, n).alias(f"f${n}"))
            names.append(n)
        return s.to(s.df.select(*s.channels(), *cols), "record", names=tuple(names))

    def step_properties(self, s: Stream, step: Step) -> Stream:
        if s.kind not in ("vertex", "edge"):
            raise UnsupportedTraversal(f"properties() of {s.kind}")
        s = self.attach(s).single()
        parts = []
        # values keep their type if all have the same; numbers of several become doubles, others text
        names = [n for n in self._properties(s, step) if at(n) in s.df.columns]
        kinds = {n: (lambda c, many: F.transform(c, lambda x: x["value"]) if many else F.array(c))(*self.values_of(s, n)) for n in names}
        types = {dict(s.df.select(c.alias("c")).dtypes)["c"][6:-1] for c in kinds.values()}
        numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
        to = types.pop() if len(types) == 1 else "double" if types and types <= numbers else "string"
        for n in names:
            c, many = self.values_of(s, n)
            cells = F.transform(c, lambda x: F.struct(x["value"].cast(to).alias("v"))) if many else F.when(c.isNotNull(), F.array(F.struct(c.cast(to).alias("v"))))
            one = s.df.select(*s.channels(), F.col("id").alias("owner"), F.lit(n).alias("key"), F.posexplode(cells).alias("_p", "_x"))
            parts.append(one.select(*s.channels(), "owner", F.concat_ws("/", "owner", "key", "_p").alias("pid"), "key", F.col("_x.v").alias("v")))
        if not parts:
            parts = [s.df.where(F.lit(False)).select(*s.channels(), F.col("id").alias("owner"), F.lit("").alias("pid"), F.lit("").alias("key"), F.lit("").alias("v"))]
        return s.to(united(parts), "property", of=s.kind, tables=s.tables)

    def step_propertyMap(self, s: Stream, step: Step) -> Stream:
        """For each key the list of its properties, as (key, value)."""
        s = self.attach(s).single()
        cols, names = [], [n for n in self._properties(s, step) if at(n) in s.df.columns]
        for n in names:
            c, many = self.values_of(s, n)
            cell = lambda v, n=n: F.struct(F.lit(n).alias("key"), v.alias("value"))
            one = F.when(F.size(c) > 0, F.transform(c, lambda x: cell(x["value"]))) if many else F.when(c.isNotNull(), F.array(cell(c)))  # noqa: B023
            cols.append(one.alias(f"f${n}"))
        return s.to(s.df.select(*s.channels(), *cols), "record", names=tuple(names))

    def step_key(self, s: Stream, step: Step) -> Stream:
        return s.value(F.col("key" if s.kind == "property" else "k"))

    def step_value(self, s: Stream, step: Step) -> Stream:
        return s.value(F.col("v"))

    def step_element(self, s: Stream, step: Step) -> Stream:
        return s.to(s.df.select(*s.channels(), F.col("owner").alias("id")), s.of, tables=s.tables)

    def step_constant(self, s: Stream, step: Step) -> Stream:
        return s.value(literal(step.args[0]))

    def step_index(self, s: Stream, step: Step) -> Stream:
        return s.value(F.transform("v", lambda x, i: F.struct(x.alias("value"), i.alias("index"))), "list")

    def step_project(self, s: Stream, step: Step) -> Stream:
        s = s.single()
        bys = step.bys or [[]]
        for i, n in enumerate(step.args):
            s = self.by(s, bys[i % len(bys)], f"f${n}")
        return s.to(s.df.select(*s.channels(), *(F.col(f"`f${n}`") for n in step.args)), "record", names=tuple(step.args), order=s.order)

    # -- labels ---------------------------------------------------------------------------------------------------------------------

    def step_as(self, s: Stream, step: Step) -> Stream:
        if "_path" in s.df.columns:
            last = F.element_at("_path", -1)
            named = F.struct(last["key"].alias("key"), last["shown"].alias("shown"), F.concat(last["labels"], F.array(*(F.lit(n) for n in step.args))).alias("labels"))
            s = s.to(s.df.withColumn("_path", F.concat(F.slice("_path", F.lit(1), F.size("_path") - 1), F.array(named))))
        for name in step.args:
            if name in s.aliases:
                self.rebound.add(name)
            if s.kind == "edge":
                c, kind = F.struct("id", "src", "dst", "label"), "edge"
            elif s.kind == "vertex":
                c, kind = F.col("id"), "vertex"
            elif s.kind in ("value", "list"):
                c, kind = F.col("v"), s.kind
            else:
                c, kind = F.struct(*s.payload()), "value"
            s = s.to(s.df.withColumn(f"a${name}", c), aliases={**s.aliases, name: (kind, s.tables)})
        return s

    def _recalled(self, s: Stream, name: str) -> Stream:
        """The stream of what was bound to a label."""
        kind, tables = s.aliases[name]
        c = F.col(f"`a${name}`")
        if kind == "vertex":
            return s.to(s.df.select(*s.channels(), c.alias("id")), "vertex", tables=tables, order=s.order)
        if kind == "edge":
            e = self.g.e(tables)
            return s.to(s.df.select(*s.channels(), c.alias("_e")).join(e, (F.col("_e.id") == F.col("id")) & (F.col("_e.label") == F.col("label")) & (F.col("_e.src") == F.col("src")) & (F.col("_e.dst") == F.col("dst"))).drop("_e"), "edge", tables=tables, attached=True, order=s.order)
        return s.value(c, kind)

    def step_select(self, s: Stream, step: Step) -> Stream:
        args = [a for a in step.args if not (isinstance(a, Token) and a.name in ("first", "last", "all", "mixed"))]
        pop = next((a.name for a in step.args if isinstance(a, Token) and a.name in ("first", "last", "all", "mixed")), "last")
        if len(args) == 1 and isinstance(args[0], Token):
            if s.kind in ("groups", "entry"):
                return s.value(F.col("k" if args[0].name == "keys" else "v"))
            if s.kind == "record":
                return s.value(F.array(*(F.lit(n) for n in s.names)) if args[0].name == "keys" else F.array(*(F.col(f"`f${n}`").cast("string") for n in s.names)), "list")
            if s.vtype.startswith("map"):
                return s.value(F.map_keys("v") if args[0].name == "keys" else F.map_values("v"), "list")
            raise UnsupportedTraversal(f"select({args[0]}) on {s.kind}")
        if len(args) == 1 and isinstance(args[0], Traversal):
            raise UnsupportedTraversal("select(traversal)")
        if pop != "last" and self.rebound.intersection(a for a in args if isinstance(a, str)):
            raise UnsupportedTraversal(f"select(Pop.{pop}) of a label that is bound more than once")
        if len(args) == 1:
            n = args[0]
            if s.kind == "record" and n in s.names and not (s.of == "bound" and n in s.aliases):
                return s.where(F.col(f"`f${n}`").isNotNull()).value(F.col(f"`f${n}`"))
            if n not in s.aliases:
                if n in self.side:
                    return self.step_cap(s, Step("cap", [n]))
                if s.kind in ("groups", "entry"):
                    return s.where(F.col("k") == literal(n)).value(F.col("v"))
                if s.kind == "value" and s.vtype.startswith(("map", "struct")):
                    return s.value(self.key(s, n)).where("v is not null")
                return s.value(F.lit(None).cast("string")).where(F.lit(False))
            out = self._recalled(s, n)
            if step.bys and step.bys[0]:
                out = self.by(out, step.bys[0], "_s")
                return out.where(F.col("_s").isNotNull()).value(F.col("_s"))
            return out.value(F.array(F.col("v" if out.kind in ("value", "list") else "id")), "list") if pop == "all" else out
        if s.kind == "record" and all(n in s.names for n in args) and not (step.bys and all(n in s.aliases for n in args)):
            return s.to(s.df.select(*s.channels(), *(F.col(f"`f${n}`") for n in args)), names=tuple(args))
        bys = step.bys or [[]]
        out = s.single()
        out = out.to(out.df.drop(*(f"f${n}" for n in out.names)))
        for i, n in enumerate(args):
            if n not in s.aliases:
                return s.to(s.df.where(F.lit(False)).select(*s.channels(), *(F.lit(None).cast("string").alias(f"f${m}") for m in args)), "record", names=tuple(args))
            by, (kind, tables) = bys[i % len(bys)], s.aliases[n]
            c = F.col(f"`a${n}`")
            if not by:
                out = out.to(out.df.withColumn(f"f${n}", c["id"] if kind == "edge" else c))
                continue
            if kind in ("value", "list"):
                one = self.by(Stream(out.df.select(c.alias("v")).distinct(), kind), by, "_b").df.select(F.col("v").alias("_i"), F.col("_b").alias(f"f${n}"))
                out = out.to(out.df.join(one, c.eqNullSafe(F.col("_i")), "left").drop("_i"))
            else:
                base = self.g.v(tables) if kind == "vertex" else self.g.e(tables)
                own = [] if kind == "vertex" else ["src", "dst"]
                one = self.by(Stream(base, kind, attached=True, tables=tables), by, "_b").df.select(F.col("id").alias("_i"), *(F.col(x).alias(f"_{x}") for x in own), F.col("_b").alias(f"f${n}"))
                match = c == F.col("_i") if kind == "vertex" else (c["id"] == F.col("_i")) & (c["src"] == F.col("_src")) & (c["dst"] == F.col("_dst"))
                out = out.to(out.df.join(one, match, "left").drop("_i", "_src", "_dst"))
            out = out.where(F.col(f"`f${n}`").isNotNull())
        # without by(), the fields are what the labels are bound to
        return out.to(out.df.select(*s.channels(), *(F.col(f"`f${n}`") for n in args)), "record", names=tuple(args), order=s.order, of="" if any(bys) else "bound")

    # -- reduction ---------------------------------------------------------------------------------------------------------------------

    def reduced(self, s: Stream, agg: Column, empty: Column | None, kind: str = "value", of: DataFrame | None = None) -> Stream:
        """One row for each scope; scopes without traversers get `empty`, or vanish."""
        df = s.df if of is None else of
        if not s.scope:
            out = df.agg(agg.alias("v"))
            out = out.select(F.coalesce("v", empty).alias("v")) if empty is not None else out.where("v is not null")
        else:
            out = df.groupBy(*s.scope).agg(agg.alias("v"))
            if empty is not None and s.domain is not None:
                out = self._filled(s, out).withColumn("v", F.coalesce("v", empty))
            else:
                out = out.where("v is not null")
        return replace(s, df=out, kind=kind, tables=None, attached=False, names=(), order=(), aliases={})

    @staticmethod
    def _filled(s: Stream, out: DataFrame) -> DataFrame:
        """A row for each scope of the domain."""
        other = out.select(*(F.col(c).alias(f"r{c}") for c in s.scope), "v")
        cond = reduce(lambda a, b: a & b, (F.col(f"`{c}`").eqNullSafe(F.col(f"`r{c}`")) for c in s.scope))
        return s.domain.join(other, cond, "left").select(*s.scope, "v")

    def step_count(self, s: Stream, step: Step) -> Stream:
        if is_local(step):
            if s.kind == "groups":
                return self.reduced(s, F.count(F.lit(1)), F.lit(0).cast("bigint"))
            return s.value(F.lit(len(s.names)).cast("bigint") if s.kind == "record" else F.size("v").cast("bigint"))
        agg = F.sum("_n") if s.bulky else F.count(F.lit(1))
        return self.reduced(s, agg, F.lit(0).cast("bigint"))

    def _number(self, s: Stream, step: Step, f: Callable[[Column], Column]) -> Stream:
        if is_local(step):
            return s.value(scalars.LOCAL[step.name](F.col("v"), self._element(s))).where("v is not null")
        if s.kind in ("vertex", "edge"):
            raise UnsupportedTraversal(f"{step.name}() of {s.kind}")
        return self.reduced(s, f(F.col("v")), None)

    def step_sum(self, s: Stream, step: Step) -> Stream:
        return self._number(s, step, lambda v: F.sum(v * s.size()) if s.bulky else F.sum(v))

    def step_mean(self, s: Stream, step: Step) -> Stream:
        return self._number(s, step, lambda v: F.sum(v * s.size()) / F.sum(F.when(v.isNotNull(), s.size())) if s.bulky else F.avg(v))

    def step_min(self, s: Stream, step: Step) -> Stream:
        return self._number(s, step, F.min)

    def step_max(self, s: Stream, step: Step) -> Stream:
        return self._number(s, step, F.max)

    def step_fold(self, s: Stream, step: Step) -> Stream:
        s = s.single()
        if len(step.args) == 2:
            seed, op = step.args
            if op.name in ("sum", "sumLong"):
                return self.reduced(s, F.sum("v") + F.lit(seed), F.lit(seed))
            if op.name in ("min", "max"):
                f, g = (F.min, F.least) if op.name == "min" else (F.max, F.greatest)
                return self.reduced(s, g(f("v"), F.lit(seed)), F.lit(seed))
            if op.name == "mult":
                return self.reduced(s, F.aggregate(F.collect_list("v"), F.lit(float(seed)), lambda a, x: a * x.cast("double")), F.lit(float(seed)))
            raise UnsupportedTraversal(f"fold({op})")
        one = scalar(s)
        keys = [c for c, _ in s.order]
        item = F.struct(*(self._directed_key(one.df, c, up) for c, up in s.order), F.col("v").alias("v")) if keys else F.col("v")
        listed = F.sort_array(F.collect_list(item)) if not one.vtype.startswith("map") else F.collect_list(item)
        agg = F.transform(listed, lambda x: x["v"]) if keys else listed
        kind = dict(one.df.dtypes)["v"]
        return self.reduced(one, agg, F.array().cast(f"array<{kind}>"), "list")

    @staticmethod
    def _directed_key(df: DataFrame, c: str, up: bool) -> Column:
        """A column whose ascending order is the wanted one."""
        if up:
            return F.col(f"`{c}`")
        kind = dict(df.dtypes)[c]
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            return (-F.col(f"`{c}`")).alias(c)
        if kind.startswith("timestamp") or kind == "date":
            return (-F.unix_micros(F.col(f"`{c}`").cast("timestamp"))).alias(c)
        # descending text: the complement of each code point, a larger one ending it
        return F.concat(F.transform(F.split(F.col(f"`{c}`"), ""), lambda x: -F.ascii(x)), F.array(F.lit(1))).alias(c)

    def step_unfold(self, s: Stream, step: Step) -> Stream:
        if s.kind == "groups":
            return s.to(s.df, "entry")
        if s.kind == "list" or s.vtype.startswith("array"):
            return s.to(s.df.select(*s.channels(), F.explode("v").alias("v")), "value", order=())
        if s.kind == "record":
            pairs = F.array(*(F.struct(F.lit(n).alias("k"), F.col(f"`f${n}`").cast("string").alias("v")) for n in s.names))
            df = s.df.select(*s.channels(), F.explode(pairs).alias("_x")).where("_x.v is not null")
            return s.to(df.select(*s.channels(), F.col("_x.k").alias("k"), F.col("_x.v").alias("v")), "entry")
        if s.vtype.startswith("map"):
            return s.to(s.df.select(*s.channels(), F.explode("v").alias("k", "v")), "entry")
        return s

    def step_groupCount(self, s: Stream, step: Step) -> Stream:
        names = [a for a in step.args if isinstance(a, str)]
        keyed = self.by(s, step.bys[0] if step.bys else [], "_g").where(F.col("_g").isNotNull())
        df = keyed.df.groupBy(*s.scope, F.col("_g").alias("k")).agg(F.sum(keyed.size()).cast("bigint").alias("v"))
        out = replace(s, df=df, kind="groups", tables=None, attached=False, order=(), aliases={})
        if names:
            self.side[names[0]] = out
            return s
        return out

    def step_group(self, s: Stream, step: Step) -> Stream:
        names = [a for a in step.args if isinstance(a, str)]
        s = s.single()
        keyed = self.by(s, step.bys[0] if step.bys else [], "_g").where(F.col("_g").isNotNull())
        self.depth += 1
        key = f"k$g{self.depth}"
        keyed = keyed.to(keyed.df.withColumnRenamed("_g", key))
        scope = (*s.scope, key)
        inner = replace(keyed, scope=scope, domain=keyed.df.select(*scope).distinct())
        by = step.bys[1] if len(step.bys) > 1 else []
        if by and isinstance(by[0], Traversal) and by[0].steps:
            out = self.chain(by[0].steps, inner)
            if out.kind == "groups":
                out = out.to(out.df.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("v")), "list")
            elif by[0].steps[-1].name not in REDUCERS:
                out = self.chain([Step("fold")], out)
        else:
            valued = self.by(inner, by, "_m").where(F.col("_m").isNotNull())
            out = self.chain([Step("fold")], valued.value(F.col("_m")))
        out = scalar(out)
        df = out.df.select(*s.scope, F.col(key).alias("k"), F.col("v"))
        done = replace(s, df=df, kind="groups", tables=None, attached=False, order=(), aliases={})
        if names:
            self.side[names[0]] = done
            return s
        return done

    # -- order and slices ----------------------------------------------------------------------------------------------------------------

    def terms(self, s: Stream) -> list[Column]:
        return [F.col(f"`{c}`").asc_nulls_first() if up else F.col(f"`{c}`").desc_nulls_last() for c, up in s.order]

    def step_order(self, s: Stream, step: Step) -> Stream:
        s = s.single()
        local = is_local(step)
        if local and s.kind == "list":
            by = step.bys[0] if step.bys else []
            down = any(isinstance(a, Token) and a.name in ("desc", "decr") for a in by)
            return s.value(F.sort_array("v", not down), "list")
        df, order = s.df.drop(*(c for c, _ in s.order)), []
        s = s.to(df, order=())
        for i, by in enumerate(step.bys or [[]]):
            how = next((a.name for a in by if isinstance(a, Token) and a.name in ("asc", "desc", "incr", "decr", "shuffle")), "asc")
            name = f"o${i}"
            if how == "shuffle":
                s = s.to(s.df.withColumn(name, F.rand(7)))
            else:
                s = self.by(s, by, name)
                if any(not (isinstance(a, Token) and a.name in ("asc", "desc", "incr", "decr")) for a in by):
                    s = s.where(F.col(f"`{name}`").isNotNull())
            order.append((name, how not in ("desc", "decr")))
        # ties in the order of the payload, so that results can be repeated
        if s.kind in ("vertex", "edge"):
            s = s.to(s.df.withColumn("o$id", F.col("id")))
            order.append(("o$id", True))
        elif s.kind in ("groups", "entry") and not dict(s.df.dtypes)["k"].startswith("map"):
            s = s.to(s.df.withColumn("o$id", F.col("k")))
            order.append(("o$id", True))
        return s.to(s.df, order=tuple(order))

    def _sliced(self, s: Stream, low: int, high: int) -> Stream:
        if high >= 0 and low > high:
            raise UnsupportedTraversal(f"Not a legal range: [{low}, {high}]")
        s = s.single()
        terms = self.terms(s)
        if s.scope:
            w = Window.partitionBy(*s.scope).orderBy(*(terms or [F.col(f"`{c}`") for c in s.keys()]))
            r = F.col("_r")
            cond = (r > low) if high < 0 else (r > low) & (r <= high)
            return s.to(s.df.withColumn("_r", F.row_number().over(w)).where(cond).drop("_r"))
        df = s.df.orderBy(*terms) if terms else s.df
        if high >= 0:
            df = df.limit(high)
        return s.to(df.offset(low) if low else df)

    def step_limit(self, s: Stream, step: Step) -> Stream:
        a = plain_args(step)
        return self._local_slice(s, step, a) if is_local(step) else self._sliced(s, 0, a[0])

    def step_skip(self, s: Stream, step: Step) -> Stream:
        a = plain_args(step)
        return self._local_slice(s, step, a) if is_local(step) else self._sliced(s, a[0], -1)

    def step_range(self, s: Stream, step: Step) -> Stream:
        a = plain_args(step)
        return self._local_slice(s, step, a) if is_local(step) else self._sliced(s, a[0], a[1])

    def step_tail(self, s: Stream, step: Step) -> Stream:
        a = plain_args(step) or [1]
        if is_local(step):
            return self._local_slice(s, step, a)
        if not s.order:
            s = self.step_order(s, Step("order"))
        turned = s.to(s.df, order=tuple((c, not up) for c, up in s.order))
        return replace(self._sliced(turned, 0, a[0]), order=s.order)

    def _local_slice(self, s: Stream, step: Step, a: list[Any]) -> Stream:
        if s.kind == "groups":
            return self.chain([Step(step.name, a)], s if s.order else self.step_order(s, Step("order", bys=[[Token("keys")]])))
        return s.value(scalars.LOCAL[step.name](F.col("v"), self._element(s), *a), "list")

    def step_sample(self, s: Stream, step: Step) -> Stream:
        s = s.single()
        draw = F.rand(11)
        if step.bys:
            s = self.by(s, step.bys[0], "_w")
            draw = -F.log(F.rand(11)) / F.col("_w")
        s = s.to(s.df.withColumn("o$s", draw).drop("_w"), order=(("o$s", True),))
        out = self._sliced(s, 0, plain_args(step)[0])
        return out.to(out.df.drop("o$s"), order=())

    # -- values ------------------------------------------------------------------------------------------------------------------------------

    def _scalar_step(self, s: Stream, step: Step) -> Stream:
        a = plain_args(step)
        f = scalars.VALUE[step.name]
        if step.name == "dateDiff" and a and isinstance(a[0], Traversal):
            s = self.by(s, a, "_o")
            return s.value(F.unix_millis("v") - F.unix_millis("_o"))
        if is_local(step) and s.kind == "list":
            kind = self._element(s)
            return s.value(F.transform("v", lambda x: f(x, kind, *a)), "list")
        if s.kind in ("vertex", "edge", "record", "groups", "entry", "property"):
            s = scalar(s)
        kind = "list" if step.name == "split" or step.name == "reverse" and s.kind == "list" else "value"
        return self.tracked(s.value(f(F.col("v"), s.vtype, *a), kind))

    step_length = step_toUpper = step_toLower = step_trim = step_lTrim = step_rTrim = step_replace = step_substring = step_split = _scalar_step
    step_asString = step_asNumber = step_asBool = step_asDate = step_dateAdd = step_dateDiff = step_reverse = _scalar_step

    def step_concat(self, s: Stream, step: Step) -> Stream:
        parts = []
        for i, a in enumerate(step.args):
            if isinstance(a, Traversal):
                s = self.by(s, [a], f"_c{i}")
                parts.append(F.col(f"_c{i}"))
            else:
                parts.append(F.lit(a).cast("string"))
        return s.value(scalars.concat(self.identity(s), parts))

    def step_conjoin(self, s: Stream, step: Step) -> Stream:
        return s.value(scalars.conjoin(F.col("v"), step.args[0]))

    def _list_step(self, s: Stream, step: Step) -> Stream:
        a = step.args[0]
        if isinstance(a, Traversal):
            s = self.by(s, [a], "_b")
            other = F.col("_b")
        else:
            other = literal(a)
        if isinstance(a, dict) or s.vtype.startswith("map"):
            kept = F.map_filter("v", lambda k, x: ~F.map_contains_key(other, k))
            return s.value(F.map_concat(kept, other))
        kind = s.vtype
        if isinstance(a, (list, set, tuple)):
            other = other.cast(kind)
        return s.value(scalars.LISTS[step.name](F.col("v"), other), "list")

    step_combine = step_intersect = step_difference = step_disjunct = step_merge = step_product = _list_step

    def step_math(self, s: Stream, step: Step) -> Stream:
        names = math.names(step.args[0])
        bys = step.bys or [[]]
        s, cols = s.single(), {}
        for i, n in enumerate(names):
            by = bys[i % len(bys)]
            if n == "_":
                s = self.by(s, by, f"_m{i}")
            elif s.kind == "record" and n in s.names:
                s = s.to(s.df.withColumn(f"_m{i}", F.col(f"`f${n}`")))
            elif n in s.aliases:
                kind, tables = s.aliases[n]
                if by and kind != "value":
                    one = self.by(Stream(self.g.v(tables), "vertex", attached=True, tables=tables), by, f"_m{i}").df.select(F.col("id").alias("_i"), f"_m{i}")
                    s = s.to(s.df.join(one, F.col(f"`a${n}`") == F.col("_i"), "left").drop("_i"))
                else:
                    s = s.to(s.df.withColumn(f"_m{i}", F.col(f"`a${n}`")))
            else:
                raise UnsupportedTraversal(f"math(): {n!r} names nothing")
            cols[n] = f"_m{i}"
        out = s.value(math.compiled(step.args[0], lambda n: F.col(cols[n])))
        return out.where("v is not null")

    def step_format(self, s: Stream, step: Step) -> Stream:
        import re

        text, parts, bys, used = step.args[0], [], step.bys, 0
        s = self.attach(s).single()
        for i, piece in enumerate(re.split(r"(%\{[^}]*\})", text)):
            m = re.fullmatch(r"%\{([^}]*)\}", piece)
            if not m:
                parts.append(F.lit(piece))
            elif m[1] == "_":
                s = self.by(s, bys[used % len(bys)] if bys else [], f"_t{i}")
                used += 1
                parts.append(F.col(f"_t{i}").cast("string"))
            elif m[1] in s.aliases and s.aliases[m[1]][0] == "value":
                parts.append(F.col(f"`a${m[1]}`").cast("string"))
            else:
                parts.append(self.key(s, m[1]).cast("string"))
        return s.value(F.concat(*parts)).where("v is not null")

    # -- branches --------------------------------------------------------------------------------------------------------------------------------

    def step_union(self, s: Stream | None, step: Step) -> Stream:
        rest = self.rest
        out = []
        for t in step.args:
            out.append(self.chain(t.steps, s))
            self.rest = rest
        return merged(out)

    def _inline(self, t: Traversal) -> bool:
        return not any(x.name in BARRIERS for x in t.steps)

    def step_local(self, s: Stream, step: Step) -> Stream:
        t = step.args[0]
        if self._inline(t):
            return self.chain(t.steps, s)
        s = s.single()
        out, pairs = self.child(s, t)
        return self.rejoined(s, out, pairs)

    step_flatMap = step_local

    def step_map(self, s: Stream, step: Step) -> Stream:
        s, t = s.single(), step.args[0]
        attached = self.attach(s) if s.kind == "vertex" and not self._moves(t) else s
        c = self.expression(attached, t)
        if c is not None:
            return self.tracked(attached.value(c).where("v is not null"))
        out, pairs = self.child(s, t)
        return self.rejoined(s, out if t.steps[-1].name in REDUCERS else self.first(out, pairs), pairs)

    def step_coalesce(self, s: Stream, step: Step) -> Stream:
        s, out = s.single(), []
        for t in step.args:
            if not t.steps or all(x.name == "identity" for x in t.steps):
                out.append(s)
                break
            got, pairs = self.child(s, t)
            out.append(self.rejoined(s, got, pairs))
            s = s.to(s.df.join(got.df.select(*(k for _, k in pairs)).distinct(), self.on(pairs), "left_anti"))
        return merged(out)

    def step_optional(self, s: Stream, step: Step) -> Stream:
        return self.step_coalesce(s, Step("coalesce", [step.args[0], Traversal([])]))

    def step_choose(self, s: Stream, step: Step) -> Stream:
        s, rest = s.single(), self.rest
        if step.options:
            return self._routed(s, step, every=False)
        test_, then, other = step.args[0], step.args[1], step.args[2] if len(step.args) > 2 else Traversal([])
        if isinstance(test_, P):
            test_ = Traversal([Step("is", [test_])])
        a = self.chain(then.steps, self.semi(s, test_))
        self.rest = rest
        b = self.chain(other.steps, self.semi(s, test_, keep=False))
        self.rest = rest
        return merged([a, b])

    def step_branch(self, s: Stream, step: Step) -> Stream:
        return self._routed(s.single(), step, every=True)

    def _routed(self, s: Stream, step: Step, every: bool) -> Stream:
        """option() arms: the first that matches, or every one (branch); Pick.none takes what matched none."""
        rest = self.rest
        s = self.by(s, [step.args[0]], "_k")
        kind = dict(s.df.dtypes)["_k"]
        out, left, none = [], s.where(F.col("_k").isNotNull()), None
        unproductive = s.where(F.col("_k").isNull())
        missed = left
        for value, t in step.options:
            if isinstance(value, Token) and value.name in ("none", "unproductive", "any"):
                if value.name == "none":
                    none = t
                elif value.name == "any":
                    out.append(self.chain(t.steps, s.to(s.df.drop("_k"))))
                else:
                    out.append(self.chain(t.steps, unproductive.to(unproductive.df.drop("_k"))))
                    unproductive = None
                continue
            p = test(F.col("_k"), value, kind)
            hit = (left if every else missed).where(p)
            missed = missed.where(no(p))
            out.append(self.chain(t.steps, hit.to(hit.df.drop("_k"))))
        self.rest = rest
        plain = missed.to(missed.df.drop("_k"))
        if none is not None:
            out.append(self.chain(none.steps, plain))
        elif not every:
            out.append(plain)
        if unproductive is not None and not every:
            u = unproductive.to(unproductive.df.drop("_k"))
            out.append(self.chain(none.steps, u) if none is not None else u)
        self.rest = rest
        return merged(out)

    def step_sideEffect(self, s: Stream, step: Step) -> Stream:
        rest = self.rest
        self.chain(step.args[0].steps, s)
        self.rest = rest
        return s

    def step_repeat(self, s: Stream, step: Step) -> Stream:
        x = step.extra
        body = next(a for a in step.args if isinstance(a, Traversal))
        times, until, emit = x.get("times"), x.get("until"), x.get("emit")
        rest, out = self.rest, []
        counted = "loops" in {y.name for y in [*body.walk(), *(until.walk() if until else ()), *(emit.walk() if isinstance(emit, Traversal) else ())]}

        def numbered(s: Stream, i: int) -> Stream:
            return s.to(s.df.withColumn("_loops", F.lit(i))) if counted else s

        def emitted(s: Stream) -> Stream:
            return s if not isinstance(emit, Traversal) else self.semi(s, emit)

        s = numbered(s, 0)
        if times == 0 and not x.get("times_first"):
            times = 1
        if x.get("emit_first") and emit is not None:
            out.append(emitted(s))
        if x.get("until_first") and until is not None:
            out.append(self.semi(s, until))
            s = self.semi(s, until, keep=False)
        if until is None and times is None and emit is None:
            raise UnsupportedTraversal("repeat() without times(), until() or emit()")
        # a dedup() that ends the body remembers what earlier loops have seen
        last = body.steps[-1] if body.steps else None
        seen: DataFrame | None = None
        remember = last is not None and last.name == "dedup" and not last.args and not last.bys
        i = 0
        while times is None or i < times:
            i += 1
            # what follows inside the loop: more hops, unless this is the last
            self.rest = [*rest, *(body.steps if times is None or i < times else [])]
            after = self.rest
            steps = body.steps
            for j, one in enumerate(steps):
                self.rest = [*steps[j + 1 :], *after]
                s = getattr(self, f"step_{one.name}")(s, one)
            if remember:
                keys = [*s.scope, *s.keys()]
                if seen is not None:
                    s = s.to(s.df.join(seen, keys, "left_anti"))
                s = s.to(settled(s.df))
                seen = s.df.select(*keys) if seen is None else seen.unionByName(s.df.select(*keys))
            s = numbered(s, i)
            if times is None:
                s = s.to(settled(s.df))
                if s.df.isEmpty():
                    break
                if i >= self.max_loops:
                    raise UnsupportedTraversal(f"repeat() went on for {i} loops")
            elif i % 8 == 0 and i < times:
                s = s.to(settled(s.df))  # else the plan of a long loop is never done
            if until is not None:
                done = self.semi(s, until)
                out.append(done)
                s = self.semi(s, until, keep=False)
            if emit is not None and (times is None or i < times or x.get("emit_first") is not True):
                out.append(emitted(s))
        self.rest = rest
        if times is not None and (emit is None or x.get("emit_first") is True):
            if until is None:
                out.append(s)
        result = merged(out) if out else s
        return result.to(result.df.drop("_loops")) if counted and "loops" not in {y.name for y in rest} else result

    def step_loops(self, s: Stream, step: Step) -> Stream:
        return s.value(F.col("_loops"))

    # -- paths, side effects, sack -----------------------------------------------------------------------------------------------------------------

    def step_path(self, s: Stream, step: Step) -> Stream:
        return s.value(self._section(step).getField("shown"), "list")

    def step_tree(self, s: Stream, step: Step) -> Stream:
        """The tree as its edges: each parent path and child, once."""
        steps = F.explode(F.transform(F.sequence(F.lit(1), F.size("_path")), lambda i: F.slice(F.col("_path.shown"), 1, i)))
        return s.to(s.df.select(*s.scope, steps.alias("v")).distinct(), "list")

    def step_aggregate(self, s: Stream, step: Step) -> Stream:
        name = next(a for a in step.args if isinstance(a, str))
        held = self.by(s.single(), step.bys[0] if step.bys else [], "_v")
        new = Stream(held.df.where(F.col("_v").isNotNull()).select(F.col("_v").alias("v")), "value", tables=s.tables, of=s.kind)
        if name in self.side:
            new = merged([self.side[name], new])
        self.side[name] = new
        return s

    step_store = step_aggregate

    def step_cap(self, s: Stream, step: Step) -> Stream:
        if len(step.args) > 1:
            raise UnsupportedTraversal("cap() of several")
        held = self.side.get(step.args[0])
        if held is None:
            raise UnsupportedTraversal(f"cap(): {step.args[0]!r} names nothing")
        if held.kind == "groups":
            return held
        return self.chain([Step("fold")], replace(held, scope=(), domain=None, of=""))

    def step_sack(self, s: Stream, step: Step) -> Stream:
        if not step.args:
            return s.value(F.col("_sack"))
        op = step.args[0].name
        s = self.by(s.single(), step.bys[0] if step.bys else [], "_v").where(F.col("_v").isNotNull())
        a, b = F.col("_sack"), F.col("_v")
        zero = F.raise_error(F.lit("Division by zero!")).cast("double")
        made = {"sum": a + b, "sumLong": a + b, "minus": a - b, "mult": a * b, "div": F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0))), "min": F.least(a, b), "max": F.greatest(a, b), "assign": b, "and": None, "or": None}
        if made.get(op) is None:
            raise UnsupportedTraversal(f"sack({op})")
        return s.to(s.df.withColumn("_sack", made[op]).drop("_v"))

    def step_match(self, s: Stream | None, step: Step) -> Stream:
        """Patterns in turn, each from a label that is bound; an end label that is bound already is compared."""
        if s is None:
            s = self.step_V(None, Step("V"))
        todo = list(step.args)
        s = s.single()
        first = todo[0].steps[0]
        if first.name != "as":
            raise UnsupportedTraversal("match() patterns start at a label")
        s = self.step_as(s, first)
        while todo:
            ready = next((t for t in todo if t.steps[0].name != "as" or t.steps[0].args[0] in s.aliases), None)
            if ready is None:
                raise UnsupportedTraversal("match(): no pattern starts at a bound label")
            todo.remove(ready)
            if ready.steps[0].name in ("where", "not", "and", "or"):
                s = self.chain(ready.steps, s)
                continue
            body, end = ready.steps[1:], None
            if body and body[-1].name == "as":
                body, end = body[:-1], body[-1].args[0]
            here = self._recalled(s, ready.steps[0].args[0])
            if end is None:
                s = self.semi(here, Traversal(body))
            else:
                moved = self.step_local(here, Step("local", [Traversal(body)])) if body else here
                if end in s.aliases:
                    moved = self.step_where(moved, Step("where", [P("eq", (end,))]))
                    s = moved
                else:
                    s = self.step_as(moved, Step("as", [end]))
        return self.step_select(s, Step("select", list(s.aliases)))

    def step_call(self, s: Stream | None, step: Step) -> Stream:
        from .services import call

        return call(self, s, step)

    def step_pageRank(self, s: Stream, step: Step) -> Stream:
        from .services import desugared

        return desugared(self, s, step)

    step_connectedComponent = step_peerPressure = step_shortestPath = step_pageRank

    def step_fail(self, s: Stream, step: Step) -> Stream:
        message = step.args[0] if step.args else "fail() Step Triggered"
        return s.where(F.raise_error(F.lit(message)).cast("boolean"))


__all__ = ["Lowering", "comparable"]
