"""Tokens for clone detection, deletable definitions and suppression comments."""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize

_OPEN, _CLOSE = "([{", ")]}"
_STRINGS = {tokenize.STRING, tokenize.FSTRING_START, tokenize.FSTRING_MIDDLE, tokenize.FSTRING_END} if hasattr(tokenize, "FSTRING_START") else {tokenize.STRING}


def boilerplate(tree: ast.Module) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Ranges (line, byte column) of docstrings and of imports reached through definitions, branches and handlers."""
    out = []
    todo: list[tuple[list[ast.stmt], bool]] = [(tree.body, True)]
    while todo:
        body, documented = todo.pop()
        for k, s in enumerate(body):
            doc = documented and k == 0 and isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)
            if doc or isinstance(s, ast.Import | ast.ImportFrom):
                out.append(((s.lineno, s.col_offset), (s.end_lineno, s.end_col_offset)))
            elif isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                todo.append((s.body, True))
            elif isinstance(s, ast.If):
                todo += [(s.body, False), (s.orelse, False)]
            elif isinstance(s, ast.Try | ast.TryStar):
                todo += [(s.body, False), *((h.body, False) for h in s.handlers)]
    return sorted(out)


def clone_tokens(source: str, tree: ast.Module) -> list[tuple[str, str, int, str]]:
    """(kind, text, line, nesting) of tokens that matter. Kinds: newline, indent, dedent, name, literal, other; brackets and what they enclose are ``expression``."""
    lines = source.splitlines(True)
    skip, at, level = boilerplate(tree), 0, 0
    out: list[tuple[str, str, int, str]] = []
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        if t.type in (tokenize.COMMENT, tokenize.NL, tokenize.ENDMARKER):
            continue
        line, col = t.start
        column = len(lines[line - 1][:col].encode()) if line <= len(lines) else 0
        while at < len(skip) and skip[at][1] <= (line, column):
            at += 1
        if at < len(skip) and skip[at][0] <= (line, column) < skip[at][1] and t.type not in (tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT):
            continue
        inside = level > 0
        if t.type == tokenize.OP and t.string in _OPEN:
            level, inside = level + 1, True
        elif t.type == tokenize.OP and t.string in _CLOSE:
            level, inside = max(level - 1, 0), True
        if t.type == tokenize.NEWLINE:
            kind = "newline"
        elif t.type == tokenize.INDENT:
            kind = "indent"
        elif t.type == tokenize.DEDENT:
            kind = "dedent"
        elif t.type == tokenize.NAME and not keyword.iskeyword(t.string):
            kind = "name"
        elif t.type == tokenize.NUMBER or t.type in _STRINGS:
            kind = "literal"
        else:
            kind = "other"
        out.append((kind, t.string, line, "expression" if inside else "statement"))
    return out


def deletables(tree: ast.Module, source: str) -> list[tuple[str, int, int, int, int, bool]]:
    """(name, line, column, start, end, would_be_empty) of definitions at module or class level; bytes of whole lines from the first decorator on."""
    from .metrics import name_place

    raw = source.encode()
    lines = raw.splitlines(True)
    begin = [0]
    for x in lines:
        begin.append(begin[-1] + len(x))
    out: list[tuple[str, int, int, int, int, bool]] = []

    def add(name: str, line: int, col: int, node: ast.stmt, first: int, empty: bool) -> None:
        out.append((name, line, len(lines[line - 1][:col].decode(errors="replace")) + 1, begin[first - 1], begin[node.end_lineno], empty))

    def collect(body: list[ast.stmt], in_class: bool) -> None:
        empty = in_class and len(body) <= 1
        for s in body:
            if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                if isinstance(s, ast.ClassDef):
                    collect(s.body, True)
                first = min([s.lineno, *(d.lineno for d in s.decorator_list)])
                add(s.name, *name_place(s, lines), s, first, empty)
            elif isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) or isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
                target = s.targets[0] if isinstance(s, ast.Assign) else s.target
                add(target.id, target.lineno, target.col_offset, s, s.lineno, empty)

    collect(tree.body, False)
    return out


def suppressions(source: str, rules: tuple[str, ...], marker: str = "lodestone") -> list[tuple[int, str, list[str]]]:
    """(line, scope, rules) of comments ``# marker: ignore``, ``ignore[a, b]`` and ``ignore-file``. Unknown rules are dropped; a list of only unknown ones is no suppression."""
    form = re.compile(rf"^{re.escape(marker)}:\s*(ignore-file|ignore)\s*(?:\[([^\]]*)\])?\s*$")
    out = []
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        if t.type != tokenize.COMMENT or not (m := form.match(t.string.lstrip("#").strip())):
            continue
        if m[1] == "ignore-file":
            if m[2] is None:
                out.append((t.start[0], "file", []))
        elif m[2] is None:
            out.append((t.start[0], "all", []))
        elif known := [r for r in (x.strip() for x in m[2].split(",")) if r in rules]:
            out.append((t.start[0], "rules", known))
    return out
