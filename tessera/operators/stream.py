"""A stream of traversers: a DataFrame of payload columns and channels, and what is known about it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import united

#: Columns that travel along: scope keys, aliases, order keys, path, sack, loops, entered vertex, bulk.
CHANNELS = ("k$", "a$", "o$", "_path", "_sack", "_loops", "_from", "_n")


@dataclass
class Stream:
    """kind: vertex (id), edge (id, src, dst, label), value (v), list (v), record (f$name ...), groups and entry (k, v),
    property (owner, pid, key, v).

    tables: the vertex tables or edge labels that the elements can be of, None if any.  attached: a vertex's other
    columns are there too.  scope: the columns that part the stream for steps that see all of it; domain has a row for each.
    """

    df: DataFrame
    kind: str
    tables: set[str] | None = None
    attached: bool = False
    scope: tuple[str, ...] = ()
    domain: DataFrame | None = None
    names: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    aliases: dict[str, tuple[str, Any]] = field(default_factory=dict)
    of: str = ""

    def channels(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(CHANNELS)]

    def payload(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(CHANNELS)]

    def to(self, df: DataFrame, kind: str | None = None, **more: Any) -> Stream:
        base = {"tables": None, "attached": False, "names": (), "of": ""} if kind else {}
        return replace(self, df=df, kind=kind or self.kind, **(base | more))

    def where(self, condition) -> Stream:
        return replace(self, df=self.df.where(condition))

    def value(self, column, kind: str = "value", **more: Any) -> Stream:
        """A stream of values instead of the payload."""
        return self.to(self.df.select(*self.channels(), column.alias("v")), kind, **more)

    @property
    def vtype(self) -> str:
        return dict(self.df.dtypes).get("v", "")

    @property
    def bulky(self) -> bool:
        return "_n" in self.df.columns

    def single(self) -> Stream:
        """One row for each traverser."""
        if not self.bulky:
            return self
        return replace(self, df=self.df.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n"))

    def size(self):
        """The number of traversers of a row."""
        return F.col("_n") if self.bulky else F.lit(1)

    def keys(self) -> list[str]:
        """The columns that tell the payload."""
        if self.kind == "vertex":
            return ["id"]
        return self.payload()


def merged(streams: list[Stream]) -> Stream:
    """One stream of several: of their kind if they agree, of values as strings otherwise."""
    streams = [s for s in streams if s is not None]
    if len(streams) == 1:
        return streams[0]
    streams = [s.single() for s in streams] if len({s.bulky for s in streams}) > 1 else streams
    kinds = {s.kind for s in streams}
    first = streams[0]
    tables = None if any(s.tables is None for s in streams) else set().union(*(s.tables for s in streams))
    if kinds == {"vertex"}:
        parts = [s.df.select(*s.channels(), "id") for s in streams]
        return first.to(united(parts), "vertex", tables=tables)
    if len(kinds) == 1 and (kinds & {"edge", "property", "groups", "entry", "record"}):
        names = tuple(dict.fromkeys(n for s in streams for n in s.names))
        return first.to(united([s.df for s in streams]), first.kind, tables=tables, names=names)
    parts = [scalar(s) for s in streams]
    types = {s.vtype for s in parts}
    if len(types) > 1:
        numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
        to = ("double" if types & {"float", "double"} else "bigint") if types <= numbers else "string"
        parts = [s.to(s.df.withColumn("v", F.col("v").cast(to))) for s in parts]
    kind = "list" if all(s.kind == "list" for s in parts) else "value"
    return first.to(united([s.df for s in parts]), kind)


def scalar(s: Stream) -> Stream:
    """The payload as one column v: elements by id, records and entries as structs."""
    if s.kind in ("value", "list"):
        return s
    if s.kind in ("vertex", "edge"):
        return s.value(F.col("id"))
    if s.kind == "property":
        return s.value(F.col("v"))
    if s.kind == "record":
        return s.value(F.struct(*(F.col(f"f${n}").alias(n) for n in s.names)))
    return s.value(F.struct("k", "v"))
