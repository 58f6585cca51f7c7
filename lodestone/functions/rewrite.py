"""Text rewriting: take definitions out of a source and imports that nothing uses any more."""

from __future__ import annotations

import ast
from collections.abc import Iterable
from itertools import takewhile


def _lines(text: str) -> list[str]:
    """Lines with their line feeds; no last line that is empty."""
    parts = text.split("\n")
    return [*(p + "\n" for p in parts[:-1]), *([parts[-1]] if parts[-1] else [])]


def _blank(lines: Iterable[str]) -> int:
    """How many lines without anything visible come first."""
    return sum(1 for _ in takewhile(lambda line: not line.strip(), lines))


def remove_block(text: str, start: int, end: int) -> str:
    """``text`` without the bytes [start, end), whole lines. Of the blank lines before and after only the longer gap stays; a last block takes the gap before it along."""
    raw = text.encode()
    if not 0 <= start <= end <= len(raw):
        return text
    above, below = _lines(raw[:start].decode()), _lines(raw[end:].decode())
    gap, after = _blank(reversed(above)), _blank(below)
    return "".join(above[: len(above) - gap]) if after == len(below) else "".join([*above, *below[min(gap, after) :]])


def names_in(text: str) -> set[str]:
    """Names that code uses: loads, heads of attributes, and identifiers inside strings that parse."""
    try:
        tree = ast.parse(_dedented(text))
    except (SyntaxError, ValueError):
        return set()
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}


def _dedented(text: str) -> str:
    import textwrap

    parts = []
    for block in text.split("\n\n"):
        parts.append(textwrap.dedent(block))
    whole = textwrap.dedent(text)
    try:
        ast.parse(whole)
        return whole
    except SyntaxError:
        return "\n".join(parts)


def _removed_names(removed: str) -> set[str]:
    """Names in removed blocks, each parsed by itself as far as it parses."""
    import io
    import tokenize

    found = names_in(removed)
    if found:
        return found
    try:
        return {t.string for t in tokenize.generate_tokens(io.StringIO(removed).readline) if t.type == tokenize.NAME}
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return found


def prune_imports(text: str, removed: str) -> str:
    """``text`` without module-level import bindings that only ``removed`` used.

    A statement that loses some of its names is written anew on one line; one
    that loses all goes with its lines. Wildcards, names in ``__all__`` and
    sources that do not parse are left alone.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return text
    gone = _removed_names(removed)
    live = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}
    live |= {n.value for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str)}
    lines = text.splitlines(True)
    edits = []
    for node in tree.body:
        if not isinstance(node, ast.Import | ast.ImportFrom):
            continue
        bound = [(a, a.asname or (a.name.split(".")[0] if isinstance(node, ast.Import) else a.name)) for a in node.names]
        drop = [a for a, name in bound if name != "*" and name in gone and name not in live]
        if not drop or isinstance(node, ast.ImportFrom) and node.module == "__future__":
            continue
        keep = [a for a in node.names if a not in drop]
        new = ""
        if keep:
            shown = ", ".join(f"{a.name} as {a.asname}" if a.asname else a.name for a in keep)
            new = f"import {shown}\n" if isinstance(node, ast.Import) else f"from {'.' * node.level}{node.module or ''} import {shown}\n"
        edits.append((node.lineno - 1, node.end_lineno, new))
    for a, b, new in reversed(edits):
        rest = lines[b - 1].encode()
        last = next(n for n in tree.body if n.lineno - 1 == a and n.end_lineno == b)
        if rest[last.end_col_offset :].strip() and not rest[last.end_col_offset :].strip().startswith(b"#"):
            continue  # another statement shares the line
        lines[a:b] = [new] if new else []
    out = "".join(lines)
    return out.lstrip("\n") if edits and not text.startswith("\n") else out
