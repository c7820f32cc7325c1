"""Expression text to columns, with aggregates over neighbours.

``sum(x[neighbors(node)]) / degree + 0.5`` names variables, calls functions, and asks for an aggregate of
a variable over each node's neighbours.  Compiling gives the column and the neighbour aggregates that must
be joined to the nodes first.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.scalar import safe_div

_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: safe_div, ast.Mod: lambda a, b: F.when(b != 0, F.pmod(a, b)), ast.Pow: F.pow}
_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_ONE = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "floor": F.floor, "ceil": F.ceil, "round": F.round}
_OVER = ("sum", "mean", "min", "max", "mode", "count")


@dataclass
class Compiled:
    column: Column
    neighbor: list[tuple[str, str, str]] = field(default_factory=list)  # (variable, aggregate, column)


def compile_expression(text: str) -> Compiled:
    wanted: list[tuple[str, str, str]] = []

    def neighbor_variable(node: ast.AST) -> str | None:
        """The variable of ``x[neighbors(node)]`` or ``neighbor_values(x)``."""
        if isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Call) and getattr(node.slice.func, "id", "") == "neighbors":
            return node.value.id
        if isinstance(node, ast.Call) and getattr(node.func, "id", "") == "neighbor_values":
            return node.args[0].id
        return None

    def over(var: str, how: str) -> Column:
        name = f"__nb_{how}_{var}"
        if (var, how, name) not in wanted:
            wanted.append((var, how, name))
        return F.col(name)

    def walk(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            return F.col(node.id)
        if isinstance(node, ast.BinOp):
            return _BINARY[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp):
            x = walk(node.operand)
            return -x if isinstance(node.op, ast.USub) else ~x if isinstance(node.op, ast.Not) else x
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            return _COMPARE[type(node.ops[0])](walk(node.left), walk(node.comparators[0]))
        if isinstance(node, ast.BoolOp):
            out = walk(node.values[0])
            for v in node.values[1:]:
                out = out & walk(v) if isinstance(node.op, ast.And) else out | walk(v)
            return out
        if isinstance(node, ast.IfExp):
            return F.when(walk(node.test), walk(node.body)).otherwise(walk(node.orelse))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            name, args = node.func.id, node.args
            if name == "neighbor_count":
                return over("node_id", "count")
            if name in _OVER and len(args) == 1 and (var := neighbor_variable(args[0])):
                return over(var, name)
            if name in ("min", "max"):
                return (F.least if name == "min" else F.greatest)(*map(walk, args))
            if name == "pow":
                return F.pow(*map(walk, args))
            if name in _ONE:
                return _ONE[name](walk(args[0]))
        raise ValueError(f"can't compile {ast.unparse(node)!r}")

    return Compiled(walk(ast.parse(text, mode="eval").body), wanted)
