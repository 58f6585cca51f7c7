"""Complexity of functions, from syntax trees.

A function is a stream of events (cyclomatic, cognitive, depth reached) that its
statements and expressions give off at a nesting depth; its metrics are two sums
and a maximum. Definitions inside it are measured by themselves.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass

Event = tuple[int, int, int]
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
LOOPS = (ast.For, ast.AsyncFor, ast.While)
#: Expressions whose parts are looked at, by field, at the same depth.
_PLAIN: dict[type, tuple[str, ...]] = {
    ast.Compare: ("left", "comparators"), ast.BinOp: ("left", "right"), ast.UnaryOp: ("operand",), ast.Attribute: ("value",), ast.Subscript: ("value", "slice"),
    ast.Tuple: ("elts",), ast.List: ("elts",), ast.Set: ("elts",), ast.Dict: ("keys", "values"), ast.Await: ("value",), ast.NamedExpr: ("value",),
    ast.Expr: ("value",), ast.Return: ("value",), ast.Assign: ("value",), ast.AugAssign: ("value",), ast.AnnAssign: ("value",), ast.Raise: ("exc",),
}


@dataclass
class FunctionMetrics:
    name: str
    owner: str | None
    line: int
    column: int
    lines: int
    parameters: int
    cyclomatic: int
    cognitive: int
    max_nesting: int

    @property
    def qualified(self) -> str:
        return f"{self.owner}.{self.name}" if self.owner else self.name


class _Stream:
    def __init__(self, name: str, lines: list[bytes]):
        self.name, self.lines = name, lines

    def every(self, nodes, depth: int) -> Iterator[Event]:
        for n in nodes if isinstance(nodes, list) else [nodes]:
            if n is not None:
                yield from self.of(n, depth)

    def starts_with(self, node: ast.AST, word: bytes) -> bool:
        return self.lines[node.lineno - 1][node.col_offset :].startswith(word)

    def branch(self, node: ast.If, depth: int) -> Iterator[Event]:
        """What follows the first test: bodies, and one step for each further clause."""
        yield from self.every(node.test, depth)
        yield from self.every(node.body, depth + 1)
        rest = node.orelse
        if len(rest) == 1 and isinstance(rest[0], ast.If) and self.starts_with(rest[0], b"elif"):
            yield 1, 1, 0
            yield from self.branch(rest[0], depth)
        elif rest:
            yield 0, 1, 0
            yield from self.every(rest, depth + 1)

    def of(self, node: ast.AST, depth: int) -> Iterator[Event]:
        deeper = (1, 1 + depth, depth + 1)
        match node:
            case ast.If():
                yield deeper
                yield from self.branch(node, depth)
            case ast.For() | ast.AsyncFor() | ast.While():
                yield deeper
                yield from self.every(node.test if isinstance(node, ast.While) else node.iter, depth)
                yield from self.every(node.body, depth + 1)
                if node.orelse:
                    yield 0, 1, 0
                    yield from self.every(node.orelse, depth + 1)
            case ast.Try() | ast.TryStar():
                yield from self.every(node.body, depth)
                for h in node.handlers:
                    yield deeper
                    yield from self.every(h.body, depth + 1)
                yield from self.every(node.orelse + node.finalbody, depth)
            case ast.With() | ast.AsyncWith():
                yield 1, 0, 0
                yield from self.every([i.context_expr for i in node.items], depth)
                yield from self.every(node.body, depth)
            case ast.Match():
                yield from self.every(node.subject, depth)
                yield 0, 1 + depth, depth + 1
                for c in node.cases:
                    yield 1, 0, 0
                    yield from self.every([c.guard, *c.body], depth + 1)
            case ast.Assert():
                yield 1, 0, 0
                yield from self.every(node.test, depth)
            case ast.BoolOp():
                yield len(node.values) - 1, 1, 0
                yield from self.every(node.values, depth)
            case ast.IfExp():
                yield deeper
                yield from self.every(node.test, depth)
                yield from self.every([node.body, node.orelse], depth + 1)
            case ast.Lambda():
                yield from self.every(node.body, depth + 1)
            case ast.ListComp() | ast.SetComp() | ast.GeneratorExp() | ast.DictComp():
                for g in node.generators:
                    yield 1 + len(g.ifs), 0, 0
                    yield from self.every(g.iter, depth)
                    yield from self.every(g.ifs, depth + 1)
                yield from self.every([node.key, node.value] if isinstance(node, ast.DictComp) else node.elt, depth + 1)
            case ast.Call():
                if isinstance(node.func, ast.Name) and node.func.id == self.name:
                    yield 0, 1, 0
                yield from self.every([node.func, *node.args, *(k.value for k in node.keywords)], depth)
            case _:
                for field in _PLAIN.get(type(node), ()):
                    yield from self.every(getattr(node, field), depth)


def _functions(body: list[ast.stmt], owner: str | None) -> Iterator[tuple[ast.AST, str | None]]:
    """Functions in source order with the class around them; those inside a function have none."""
    for s in body:
        if isinstance(s, FUNCTIONS):
            yield s, owner
            yield from _functions(s.body, None)
        elif isinstance(s, ast.ClassDef):
            yield from _functions(s.body, s.name)
        elif isinstance(s, (ast.If, *LOOPS)):
            yield from _functions(s.body + s.orelse, owner)
        elif isinstance(s, ast.Try | ast.TryStar):
            yield from _functions(s.body + [x for h in s.handlers for x in h.body] + s.orelse + s.finalbody, owner)
        elif isinstance(s, ast.With | ast.AsyncWith):
            yield from _functions(s.body, owner)


def name_place(node: ast.AST, lines: list[bytes]) -> tuple[int, int]:
    """(line, byte column from 0) of the name of a definition."""
    line = lines[node.lineno - 1]
    word = b"class" if isinstance(node, ast.ClassDef) else b"def"
    at = line.index(word, node.col_offset) + len(word)
    row = node.lineno
    while True:
        rest = line[at:]
        gap = len(rest) - len(rest.lstrip(b" \t\f"))
        if rest.strip() in (b"", b"\\"):
            row, at, line = row + 1, 0, lines[row]
            continue
        return row, at + gap


def measure(tree: ast.Module, source: str) -> list[FunctionMetrics]:
    lines = source.encode().splitlines()
    out = []
    for node, owner in _functions(tree.body, None):
        line, col = name_place(node, lines)
        a = node.args
        events = list(_Stream(node.name, lines).every(node.body, 0))
        column = len(lines[line - 1][:col].decode(errors="replace")) + 1
        parameters = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
        out.append(FunctionMetrics(node.name, owner, line, column, node.end_lineno - line + 1, parameters, 1 + sum(e[0] for e in events), sum(e[1] for e in events), max((e[2] for e in events), default=0)))
    return out
