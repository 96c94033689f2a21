"""Writing steps.  Tables are immutable: each write gives a new Graph, and a step sees its input as it was before the step.

A property of one value per vertex is a column; property(list, ...) or property(set, ...) makes it, or keeps it, an array of
values with meta-properties.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import literal
from ..graph import Graph, at, settled
from ..plans.passes import Source
from ..plans.steps import P, Step, Token, Traversal, UnsupportedTraversal
from .lowering import Lowering
from .stream import Stream


class WriteError(Exception):
    """A write that would break the graph: an id in use, an edge without an end."""


class Writer(Lowering):
    def chain(self, steps: list[Step], s: Stream | None) -> Stream:
        self.collapse = False
        return super().chain(steps, s)

    # -- vertices -----------------------------------------------------------------------------------------------------------

    def _next_id(self, df: DataFrame) -> int:
        return (df.agg(F.max("id")).first()[0] or 0) + 1

    def _numbered(self, df: DataFrame, first: int, wanted: Column | None = None) -> DataFrame:
        """A settled table with new ids; the numbers of one write run on from the largest in use."""
        if wanted is not None:
            return settled(df.withColumn("_new", wanted.cast("long")))
        df = settled(df.withColumn("_m", F.monotonically_increasing_id()))
        parts = df.groupBy((F.shiftright("_m", 33)).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
        starts = parts.withColumn("_s", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c"))
        return settled(df.withColumn("_p", F.shiftright("_m", 33)).join(starts, "_p").withColumn("_new", F.lit(first) + F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_s", "_c"))

    def step_addV(self, s: Stream | None, step: Step) -> Stream:
        label = next((a for a in step.args if isinstance(a, str)), "vertex")
        if s is None:
            s = Stream(self.g.spark.range(1).select(F.lit(0).alias("v")), "value")
        new = self._numbered(s.df.select(*s.channels()), self._next_id(self.g.v()))
        rows = new.select(F.col("_new").alias("id"))
        self._append_vertices(label, rows)
        return s.to(new.select(*s.channels(), F.col("_new").alias("id")), "vertex", tables={label})

    def _append_vertices(self, label: str, rows: DataFrame) -> None:
        tables = dict(self.g.vertices)
        tables[label] = settled(tables[label].unionByName(rows, allowMissingColumns=True) if label in tables else rows)
        self.g = self.g.replaced(tables)

    def step_property(self, s: Stream, step: Step) -> Stream:
        a = list(step.args)
        how = a.pop(0).name if isinstance(a[0], Token) and a[0].name in ("single", "list", "set") else None
        if isinstance(a[0], dict):
            for k, v in a[0].items():
                s = self.step_property(s, Step("property", [*([Token(how)] if how else []), k, v]))
            return s
        key, value, meta = a[0], a[1], a[2:]
        if isinstance(value, Step):
            how, value = value.name, value.args[0]
        if isinstance(key, Token):
            if key.name != "id" or s.kind != "vertex":
                raise UnsupportedTraversal(f"property({key})")
            return self._renumbered(s, value)
        s = replace(s, df=settled(s.df))
        rows = self.by(s, [value], "_v") if isinstance(value, Traversal) else s.to(s.df.withColumn("_v", literal(value) if value is not None else F.lit(None).cast("string")))
        updates = settled(rows.df.select("id", *(["src", "dst"] if s.kind == "edge" else []), "_v").dropDuplicates(["id"]) if how != "list" else rows.df.select("id", "_v"))
        frames = dict(self.g.vertices if s.kind == "vertex" else self.g.edges)
        multi = set(self.g.multi)
        many = s.kind == "vertex" and (how in ("list", "set") or key in multi and how != "single")
        if many:
            pairs = F.create_map(*(literal(x) for x in meta)).cast("map<string,string>") if meta else F.lit(None).cast("map<string,string>")
            updates = updates.groupBy("id").agg(F.collect_list(F.struct(F.col("_v").alias("value"), pairs.alias("meta"))).alias("_v"))
            multi.add(key)
        for label, df in frames.items():
            if s.tables is not None and label not in s.tables and not (many and at(key) in df.columns):
                continue
            c, kinds = at(key), dict(df.dtypes)
            joined = df.join(updates.select("id", F.col("_v").alias("_u"), F.lit(True).alias("_hit")), "id", "left")
            if many:
                empty = F.array().cast(updates.schema["_v"].dataType)
                old = empty if c not in kinds else F.col(f"`{c}`") if kinds[c].startswith("array") else F.when(F.col(f"`{c}`").isNull(), empty).otherwise(F.array(F.struct(F.col(f"`{c}`").alias("value"), F.lit(None).cast("map<string,string>").alias("meta"))))
                old = F.transform(F.coalesce(old, empty), lambda x: F.struct(x["value"].alias("value"), x["meta"].cast("map<string,string>").alias("meta")))
                both = F.concat(old, F.coalesce("_u", empty))
                if how == "set":
                    both = F.aggregate(both, F.array().cast(updates.schema["_v"].dataType), lambda acc, x: F.when(F.exists(acc, lambda y: y["value"].eqNullSafe(x["value"])), acc).otherwise(F.concat(acc, F.array(x))))
                new = both
            else:
                kind = kinds.get(c)
                u = F.col("_u") if kind is None else F.col("_u").cast(kind)
                new = F.when(F.col("_hit"), u).otherwise(F.col(f"`{c}`") if kind else F.lit(None))
            frames[label] = settled(joined.withColumn(c, new).drop("_u", "_hit"))
        if not many and key in multi and how == "single":
            multi.discard(key)
        self.g = self.g.replaced(frames, None, multi=multi) if s.kind == "vertex" else self.g.replaced(None, frames)
        return s.to(s.df.select(*s.channels(), "id"), attached=False) if s.kind == "vertex" else self._reread(s)

    def _reread(self, s: Stream) -> Stream:
        e = self.g.e(s.tables)
        return s.to(s.df.select(*s.channels(), "id").join(e, "id"))

    def _renumbered(self, s: Stream, value: Any) -> Stream:
        """property(T.id, x) right after addV()."""
        ids = settled(s.df.select("id"))
        if isinstance(value, int) and not self.g.v().where(F.col("id") == value).isEmpty():
            raise WriteError(f"Vertex with id already exists: {value}")
        tables = {}
        for label, df in self.g.vertices.items():
            hit = df.join(ids, "id", "left_semi") if s.tables is None or label in s.tables else None
            if hit is None:
                tables[label] = df
            elif isinstance(value, int):
                tables[label] = settled(df.join(ids, "id", "left_anti").unionByName(hit.withColumn("id", F.lit(value).cast("long"))))
            else:
                tables[label] = settled(df.join(ids, "id", "left_anti").unionByName(hit.withColumn("uid", F.lit(str(value))), allowMissingColumns=True))
        self.g = self.g.replaced(tables)
        return s.to(s.df.withColumn("id", F.lit(value).cast("long"))) if isinstance(value, int) else s

    def _moved(self, s: Stream, change) -> Stream:
        """Vertices to the tables of their new sets of labels."""
        s = replace(s, df=settled(s.df))
        ids, tables, reached = s.df.select("id").distinct(), dict(self.g.vertices), set()
        for label in list(tables):
            new = "::".join(sorted(change(set(label.split("::")))) or ["vertex"])
            reached.add(new)
            if new == label:
                continue
            hit = tables[label].join(ids, "id", "left_semi")
            tables[label] = settled(tables[label].join(ids, "id", "left_anti"))
            tables[new] = settled(tables[new].unionByName(hit, allowMissingColumns=True) if new in tables else hit)
        self.g = self.g.replaced(tables, None, ends={})
        return s.to(s.df.select(*s.channels(), "id"), attached=False, tables=reached)

    def step_addLabel(self, s: Stream, step: Step) -> Stream:
        return self._moved(s, lambda own: own | set(step.args))

    def step_dropLabel(self, s: Stream, step: Step) -> Stream:
        return self._moved(s, lambda own: own - set(step.args))

    def step_dropLabels(self, s: Stream, step: Step) -> Stream:
        return self._moved(s, lambda own: set())

    # -- edges -----------------------------------------------------------------------------------------------------------------

    def _end(self, s: Stream, x: Any, name: str) -> Stream:
        if x is None:
            return s.to(s.df.withColumn(name, F.col("id")))
        if isinstance(x, str):
            return s.to(s.df.withColumn(name, F.col(f"`a${x}`")))
        if isinstance(x, int):
            return s.to(s.df.withColumn(name, F.lit(x).cast("long")))
        if x.steps and x.steps[0].name == "select" and len(x.steps) == 1:
            return s.to(s.df.withColumn(name, F.col(f"`a${x.steps[0].args[0]}`")))
        if x.steps and x.steps[0].name == "V":
            one = Lowering(self.g, x).chain(x.steps, None)
            found = one.df.select(F.col("id").alias(name)).limit(1)
            return s.to(s.df.crossJoin(F.broadcast(found)))  # a single row
        return self.by(s, [x], name)

    def step_addE(self, s: Stream | None, step: Step) -> Stream:
        label = step.args[0]
        if s is None:
            s = Stream(self.g.spark.range(1).select(F.lit(0).alias("v")), "value")
        s = self._end(s, step.extra.get("from"), "_src")
        s = self._end(s, step.extra.get("to"), "_dst")
        if not s.df.where("_src is null or _dst is null").isEmpty():
            raise WriteError("addE() could not find a vertex for one of its ends")
        new = self._numbered(s.df, self._next_id(self.g.e()) if self.g.edges else 1)
        rows = new.select(F.col("_new").alias("id"), F.col("_src").cast("long").alias("src"), F.col("_dst").cast("long").alias("dst"))
        tables = dict(self.g.edges)
        tables[label] = settled(tables[label].unionByName(rows, allowMissingColumns=True) if label in tables else rows)
        ends = {k: v for k, v in self.g.ends.items() if k != label}  # what the label joins isn't known any more
        self.g = self.g.replaced(None, tables, ends=ends)
        out = new.select(*s.channels(), F.col("_new").alias("id"), F.col("_src").cast("long").alias("src"), F.col("_dst").cast("long").alias("dst"), F.lit(label).alias("label"))
        return s.to(out, "edge", tables={label}, attached=True)

    # -- merges ------------------------------------------------------------------------------------------------------------------

    def _merge_args(self, step: Step) -> tuple[dict, dict, dict]:
        def plain(m: Any) -> dict:
            if not isinstance(m, dict):
                raise UnsupportedTraversal(f"{step.name}() of a traversal")
            return {getattr(k, "name", k): v for k, v in m.items()}

        options = {k.name: plain(v) for k, v in step.options if isinstance(v, dict)}
        return plain(step.args[0] if step.args else {}), options.get("onCreate", {}), options.get("onMatch", {})

    def step_mergeV(self, s: Stream | None, step: Step) -> Stream:
        search, create, match = self._merge_args(step)
        tests = [Step("hasLabel", [search["label"]])] if "label" in search else []
        tests += [Step("hasId", [search["id"]])] if "id" in search else []
        tests += [Step("has", [k, v]) for k, v in search.items() if k not in ("label", "id")]
        found = Lowering(self.g, Traversal(tests)).chain([Step("V"), *tests], None)
        found = replace(found, df=settled(found.df.select("id")), attached=False)
        if not found.df.isEmpty():
            for k, v in match.items():
                found = self.step_property(found, Step("property", [Token("single"), k, v]))
            return found
        whole = {**search, **create}
        out = self.step_addV(None, Step("addV", [whole.get("label", "vertex")]))
        if "id" in whole:
            out = self.step_property(out, Step("property", [Token("id"), whole["id"]]))
        for k, v in whole.items():
            if k not in ("label", "id"):
                out = self.step_property(out, Step("property", [Token("single"), k, v]))
        return out

    def step_mergeE(self, s: Stream | None, step: Step) -> Stream:
        search, create, match = self._merge_args(step)
        ends = {k: search.get(k, search.get(v)) for k, v in (("OUT", "from"), ("IN", "to"))}
        tests = [Step("hasLabel", [search["label"]])] if "label" in search else []
        tests += [Step("has", [k, v]) for k, v in search.items() if k not in ("label", "id", "OUT", "IN", "from", "to")]
        found = Lowering(self.g, Traversal(tests)).chain([Step("E"), *tests], None)
        for c, k in (("src", "OUT"), ("dst", "IN")):
            if ends[k] is not None:
                found = found.where(F.col(c) == F.lit(ends[k]))
        found = replace(found, df=settled(found.df))
        if not found.df.isEmpty():
            for k, v in match.items():
                found = self.step_property(found, Step("property", [k, v]))
            return found
        if ends["OUT"] is None or ends["IN"] is None:
            raise WriteError("mergeE() needs both ends to create an edge")
        out = self.step_addE(None, Step("addE", [{**search, **create}.get("label", "edge")], extra={"from": ends["OUT"], "to": ends["IN"]}))
        for k, v in {**search, **create}.items():
            if k not in ("label", "id", "OUT", "IN", "from", "to"):
                out = self.step_property(out, Step("property", [k, v]))
        return out

    # -- drops -----------------------------------------------------------------------------------------------------------------------

    def step_drop(self, s: Stream, step: Step) -> Stream:
        s = replace(s, df=settled(s.df))
        if s.kind == "vertex":
            ids = s.df.select("id").distinct()
            vertices = {k: settled(df.join(ids, "id", "left_anti")) for k, df in self.g.vertices.items()}
            a, b = ids.withColumnRenamed("id", "src"), ids.withColumnRenamed("id", "dst")
            edges = {k: settled(df.join(a, "src", "left_anti").join(b, "dst", "left_anti").select(*df.columns)) for k, df in self.g.edges.items()}
            self.g = self.g.replaced(vertices, edges)
        elif s.kind == "edge":
            ids = s.df.select("id", "src", "dst", F.col("label").alias("_l")).distinct()
            self.g = self.g.replaced(None, {k: settled(df.join(ids.where(F.col("_l") == k), ["id", "src", "dst"], "left_anti").select(*df.columns)) for k, df in self.g.edges.items()})
        elif s.kind == "property":
            frames = dict(self.g.vertices if s.of == "vertex" else self.g.edges)
            for label, df in frames.items():
                for c in [c for c in df.columns if c.startswith("@")]:
                    ids = s.df.where(F.col("key") == c[1:]).select(F.col("owner").alias("id"), F.lit(True).alias("_hit")).distinct()
                    df = df.join(ids, "id", "left").withColumn(c, F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(f"`{c}`"))).drop("_hit")
                frames[label] = settled(df)
            self.g = self.g.replaced(frames) if s.of == "vertex" else self.g.replaced(None, frames)
        else:
            raise UnsupportedTraversal(f"drop() of {s.kind}")
        return s.where(F.lit(False))


def written(graph: Graph, steps: list[Step], src: Source, graphs: dict[str, Graph] | None):
    from .run import Result, prepare

    for st in src.strategies:
        key, part = st.extra.get("partitionKey"), st.extra.get("writePartition")
        if st.name == "PartitionStrategy" and part is not None:
            steps = [y for x in steps for y in ([x, Step("property", [key, part])] if x.name in ("addV", "addE") else [x])]
    if steps[0].name == "io":
        return _io(graph, steps)
    writer = Writer(graph, Traversal(steps), graphs)
    prepare(writer, src)
    out = writer.chain(steps, None)
    return Result(out, writer.g)


def _io(graph: Graph, steps: list[Step]):
    """io(path).read() and .write(): GraphSON for .json, pairs of CSV files otherwise."""
    from ..sources import csv, graphson
    from .run import Result

    path, how = steps[0].args[0], steps[1].name if len(steps) > 1 else "read"
    done = Stream(graph.spark.createDataFrame([], "v string"), "value")
    if path.endswith((".xml", ".graphml", ".kryo")):
        raise UnsupportedTraversal("io() of GraphML or Gryo")
    form = csv if path.endswith(".csv") else graphson
    if how == "write":
        form.write(graph, path)
        return Result(done, graph)
    return Result(done, form.read(graph.spark, path))


__all__ = ["P", "WriteError", "Writer", "written"]
