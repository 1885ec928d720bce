"""Constraint expressions compiled to Columns, through a whitelist of syntax."""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = frozenset({"abs", "min", "max", "round"})
COMPARE = {ast.Lt: "lt", ast.LtE: "le", ast.Gt: "gt", ast.GtE: "ge", ast.Eq: "eq", ast.NotEq: "ne"}
ARITHMETIC = (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow)
ALLOWED = (ast.Expression, ast.Compare, ast.BoolOp, ast.UnaryOp, ast.BinOp, ast.Name, ast.Constant, ast.Load, ast.And, ast.Or, ast.Not, ast.USub, ast.UAdd, ast.Call, *COMPARE, *ARITHMETIC)


class ConstraintError(ValueError):
    """An expression outside the whitelist."""


def parse(expression: str) -> ast.expr:
    try:
        tree = ast.parse(expression, mode="eval")
    except SyntaxError as e:
        raise ConstraintError(f"cannot parse {expression!r}: {e}") from e
    for node in ast.walk(tree):
        if not isinstance(node, ALLOWED):
            raise ConstraintError(f"{expression!r}: {type(node).__name__} is not allowed")
        if isinstance(node, ast.Call) and not (isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords):
            raise ConstraintError(f"{expression!r}: only {sorted(FUNCTIONS)} may be called")
        if isinstance(node, ast.Constant) and not isinstance(node.value, int | float):
            raise ConstraintError(f"{expression!r}: only numbers may be written")
    return tree.body


def references(expression: str) -> set[str]:
    """Attributes that an expression reads."""
    return {n.id for n in ast.walk(parse(expression)) if isinstance(n, ast.Name) and n.id not in FUNCTIONS}


def compile_constraint(expression: str, value: Callable[[str], Column]) -> tuple[Column, Column]:
    """(holds, broken): NULL holds means that an input is missing; broken that a division by zero was met.

    ``and`` and ``or`` need all their inputs, so a missing one skips the whole constraint; a chained comparison
    stops at its first false link, whatever is missing after it.
    """
    zero: list[Column] = []

    def either(xs: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, xs)

    def guarded(xs: list[Column], out: Column) -> Column:
        return F.when(~either([x.isNull() for x in xs]), out)

    def boolean(node: ast.expr) -> Column:
        x = walk(node)
        return x if isinstance(node, ast.Compare | ast.BoolOp) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not) else x != 0

    def walk(node: ast.expr) -> Column:
        match node:
            case ast.Constant():
                return F.lit(float(node.value))
            case ast.Name():
                return value(node.id)
            case ast.UnaryOp(op=ast.Not()):
                return ~boolean(node.operand)
            case ast.UnaryOp():
                return -walk(node.operand) if isinstance(node.op, ast.USub) else walk(node.operand)
            case ast.BinOp():
                a, b = walk(node.left), walk(node.right)
                match node.op:
                    case ast.Add():
                        return a + b
                    case ast.Sub():
                        return a - b
                    case ast.Mult():
                        return a * b
                    case ast.Div():
                        zero.append(F.coalesce(b == 0, F.lit(False)))
                        return F.try_divide(a, b)
                    case _:
                        return F.pow(a, b)
            case ast.BoolOp():
                parts = [boolean(v) for v in node.values]
                return guarded(parts, reduce(lambda a, b: a & b, parts) if isinstance(node.op, ast.And) else either(parts))
            case ast.Compare():
                sides = [walk(x) for x in (node.left, *node.comparators)]
                out = None
                for a, b, op in reversed(list(zip(sides, sides[1:], node.ops, strict=False))):
                    link = {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b, "eq": a == b, "ne": a != b}[COMPARE[type(op)]]
                    out = link if out is None else F.when(link, out).when(~link, F.lit(False))
                return out
            case ast.Call():
                xs = [walk(a) for a in node.args]
                match node.func.id:
                    case "abs":
                        return F.abs(xs[0])
                    case "round":
                        return F.bround(xs[0], int(node.args[1].value) if len(xs) > 1 else 0)
                    case name:
                        return guarded(xs, (F.least if name == "min" else F.greatest)(*xs)) if len(xs) > 1 else xs[0]
        raise ConstraintError(type(node).__name__)

    holds = boolean(parse(expression))
    return holds, either(zero) if zero else F.lit(False)
