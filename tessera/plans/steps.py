"""The step language: a traversal is a list of steps with literal, predicate, token or nested arguments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any


class UnsupportedTraversal(Exception):
    """The traversal has no meaning here; decided from its text alone, before any job."""


class VerificationError(Exception):
    """A traversal that its strategies forbid."""


@dataclass(frozen=True)
class Token:
    """An enumeration value such as T.id, Order.desc, Scope.local, Pop.last, Pick.none, Column.keys, DT.day."""

    name: str

    def __repr__(self) -> str:
        return self.name


@dataclass(frozen=True)
class P:
    """A predicate: an operator and its operands."""

    op: str
    args: tuple = ()

    def negate(self) -> P:
        return P("not", (self,))


@dataclass
class Step:
    name: str
    args: list[Any] = field(default_factory=list)
    bys: list[list[Any]] = field(default_factory=list)
    options: list[tuple[Any, Any]] = field(default_factory=list)
    extra: dict[str, Any] = field(default_factory=dict)

    def traversals(self) -> Iterator[Traversal]:
        for x in [*self.args, *(a for b in self.bys for a in b), *(a for o in self.options for a in o), *self.extra.values()]:
            if isinstance(x, Traversal):
                yield x
            elif isinstance(x, P):
                yield from (a for a in x.args if isinstance(a, Traversal))


@dataclass
class Traversal:
    steps: list[Step] = field(default_factory=list)
    anonymous: bool = True

    def walk(self) -> Iterator[Step]:
        """All steps, those of nested traversals included."""
        for s in self.steps:
            yield s
            for t in s.traversals():
                yield from t.walk()

    def strings(self) -> set[str]:
        """All string arguments: a superset of the property keys and labels that the traversal can read."""
        found: set[str] = set()
        for s in self.walk():
            for x in [*s.args, *(a for b in s.bys for a in b)]:
                if isinstance(x, str):
                    found.add(x)
        return found


#: The names of tokens, by enumeration.
TOKENS = {
    "T": "id label key value",
    "Order": "asc desc shuffle incr decr",
    "Scope": "local global",
    "Pop": "first last all mixed",
    "Pick": "any none unproductive",
    "Column": "keys values",
    "Direction": "OUT IN BOTH from to",
    "Cardinality": "single list set",
    "Merge": "onCreate onMatch outV inV",
    "DT": "second minute hour day",
    "Operator": "sum minus mult div min max and or addAll assign sumLong",
    "GType": "STRING BOOLEAN BYTE SHORT INT INTEGER LONG FLOAT DOUBLE BIGINT BIGINTEGER BIGDECIMAL DATETIME DURATION BINARY UUID CHAR LIST SET MAP VERTEX EDGE PROPERTY VPROPERTY PATH TREE GRAPH NUMBER NULL",
    "Barrier": "normSack",
}
TOKEN_NAMES = {n for names in TOKENS.values() for n in names.split()}
#: The names of predicates.
PREDICATES = set("eq neq lt lte gt gte inside outside between within without not startingWith notStartingWith endingWith notEndingWith containing notContaining regex notRegex typeOf".split())
