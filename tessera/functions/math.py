"""Formulas of math(): a precedence climber over columns.  All results are doubles; a division by zero raises."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.steps import UnsupportedTraversal

LEX = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|([-+*/%^(),]))")


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(f(x))


#: The functions of formulas.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": F.round, "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "signum": F.signum,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "log": _log(F.log), "log10": _log(F.log10), "log2": _log(F.log2), "log1p": F.log1p, "expm1": F.expm1,
}
CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045}
LEVELS = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2, "^": 4}


def names(formula: str) -> list[str]:
    """The variables of a formula, in order of first use."""
    out = [m[2] for m in LEX.finditer(formula) if m[2] and m[2] not in FUNCTIONS and m[2] not in CONSTANTS]
    return list(dict.fromkeys(out))


def compiled(formula: str, variable: Callable[[str], Column]) -> Column:
    tokens, at = [], 0
    while at < len(formula.rstrip()):
        m = LEX.match(formula, at)
        if not m:
            raise UnsupportedTraversal(f"math: cannot read {formula[at:]!r}")
        tokens.append(m[1] or m[2] or m[3])
        at = m.end()
    place = 0

    def peek() -> str:
        return tokens[place] if place < len(tokens) else ""

    def take() -> str:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def unary() -> Column:
        if peek() in ("-", "+"):
            return -climb(3) if take() == "-" else climb(3)
        t = take() if peek() else ""
        if t == "(":
            x = climb(0)
            if not peek() or take() != ")":
                raise UnsupportedTraversal("math: missing )")
            return x
        if t in FUNCTIONS:
            return FUNCTIONS[t](unary().cast("double")).cast("double")
        if t in CONSTANTS:
            return F.lit(CONSTANTS[t])
        if re.match(r"[\d.]", t):
            return F.lit(float(t))
        if re.match(r"[A-Za-z_]", t):
            return variable(t).cast("double")
        raise UnsupportedTraversal(f"math: unexpected {t!r}")

    def climb(level: int) -> Column:
        x = unary()
        while peek() in LEVELS and LEVELS[peek()] >= max(level, 1):
            op = take()
            y = climb(LEVELS[op] + (op != "^"))
            if op in "/%":
                zero = F.raise_error(F.lit("Division by zero!")).cast("double")
                x = F.when(y == 0, zero).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y) if op == "/" else F.pmod(F.abs(x), F.abs(y)) * F.signum(x))
            else:
                x = x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else F.pow(x, y)
        return x

    out = climb(0)
    if place < len(tokens):
        raise UnsupportedTraversal(f"math: unexpected {peek()!r}")
    return out.cast("double")
