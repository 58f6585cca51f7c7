"""One pass over a source file: definitions, imports, uses and strings, as plain rows."""

from __future__ import annotations

import ast
import re
import sys
from typing import Any

from .metrics import FUNCTIONS, measure, name_place
from .tokens import clone_tokens, deletables, suppressions

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
DOTTED = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+\Z")
ENTRY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*:[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*\Z")
LONGEST_STRING = 200
STDLIB = sys.stdlib_module_names


def module_of(rel_path: str, roots: tuple[str, ...] = ("src/", "")) -> str | None:
    """The dotted module of a file, or None where a part is no identifier."""
    for root in roots:
        if rel_path.startswith(root):
            rel_path = rel_path[len(root) :]
            break
    parts = rel_path.rsplit(".", 1)[0].split("/")
    if parts[-1] == "__init__":
        parts.pop()
    return ".".join(parts) if parts and all(IDENTIFIER.match(p) for p in parts) else None


def dotted(node: ast.AST) -> str | None:
    """a.b.c of names and attributes, else None."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([node.id, *reversed(parts)])


def _targets(node: ast.AST) -> list[ast.Name]:
    if isinstance(node, ast.Name):
        return [node]
    if isinstance(node, ast.Tuple | ast.List):
        return [n for e in node.elts for n in _targets(e)]
    return _targets(node.value) if isinstance(node, ast.Starred) else []


def _own_nodes(body: list[ast.stmt]):
    """Nodes of a scope, without those of scopes inside it."""
    todo: list[ast.AST] = list(reversed(body))
    while todo:
        n = todo.pop()
        yield n
        if not isinstance(n, (*FUNCTIONS, ast.ClassDef, ast.Lambda)):
            todo += reversed(list(ast.iter_child_nodes(n)))


class Scan:
    """Facts of one file. Offsets are bytes; ``facts`` holds lists of dictionaries by table."""

    def __init__(self, source: str, module: str | None, is_package: bool, rules: tuple[str, ...] = (), marker: str = "lodestone"):
        self.source, self.module, self.is_package = source, module, is_package
        self.tree = ast.parse(source)
        raw = source.encode()
        self.lines = raw.splitlines(True) or [b""]
        self.begin = [0]
        for x in self.lines:
            self.begin.append(self.begin[-1] + len(x))
        self.facts: dict[str, Any] = {k: [] for k in ("symbols", "imports", "aliases", "uses", "strings", "words", "params", "attr_names", "attr_prefixes", "param_names", "path_literals", "package_wide")}
        self.exports: list[str] = []
        self.main_guard = self.reads_globals = False
        self.guards: set[str] = set()
        self.makers: dict[str, str] = {}
        self.said: set[str] = set()
        self.seq = 0
        self._module_level()
        self._define(self.tree.body, None, None)
        self._visit_scope(self.tree, [])
        self.metrics = measure(self.tree, source)
        self.tokens = clone_tokens(source, self.tree)
        self.deletables = deletables(self.tree, source)
        self.suppressions = suppressions(source, rules, marker)
        self.facts["makers"] = [{"name": k, "callee": v} for k, v in sorted(self.makers.items())]
        names = self.facts
        for k in ("attr_names", "attr_prefixes", "param_names", "path_literals", "package_wide"):
            names[k] = sorted(set(names[k]))

    def offset(self, line: int, col: int) -> int:
        return self.begin[line - 1] + col

    def column(self, line: int, col: int) -> int:
        return len(self.lines[line - 1][:col].decode(errors="replace")) + 1

    # Definitions

    def _module_level(self) -> None:
        for s in self.tree.body:
            targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AugAssign | ast.AnnAssign) else []
            value = getattr(s, "value", None)
            if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets):
                self._export(value)
            if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and dotted(s.value.func) == "__all__.extend" and s.value.args:
                self._export(s.value.args[0])
            if isinstance(s, ast.If) and isinstance(s.test, ast.Compare) and isinstance(s.test.left, ast.Name) and s.test.left.id == "__name__":
                self.main_guard |= any(isinstance(c, ast.Constant) and c.value == "__main__" for c in s.test.comparators)
            if isinstance(s, ast.Assign) and self._version_test(value):
                self.guards |= {t.id for t in targets if isinstance(t, ast.Name)}
            if isinstance(s, ast.Assign) and isinstance(value, ast.Call) and (callee := dotted(value.func)):
                self.makers |= {t.id: callee for t in targets if isinstance(t, ast.Name)}

    def _export(self, value: ast.AST | None) -> None:
        if isinstance(value, ast.List | ast.Tuple):
            self.exports += [e.value for e in value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]

    def _version_test(self, node: ast.AST | None) -> bool:
        return node is not None and any(isinstance(n, ast.Attribute) and dotted(n) == "sys.version_info" or isinstance(n, ast.Name) and n.id in self.guards for n in ast.walk(node))

    def _symbol(self, name: str, kind: str, parent: int | None, line: int, col: int, node: ast.AST, **more) -> int:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        start = self.offset(first, min((d.col_offset for d in getattr(node, "decorator_list", []) if d.lineno == first), default=node.col_offset))
        if getattr(node, "decorator_list", []) and first < node.lineno:
            start -= 1  # the at-sign
        at = self.offset(line, col)
        ordinal = len(self.facts["symbols"])
        row = {"ordinal": ordinal, "name": name, "kind": kind, "parent_ordinal": parent, "decorators": [], "bases": [], "class_keywords": [], "name_start": at, "name_end": at + len(name.encode()), "full_start": start, "full_end": self.offset(node.end_lineno, node.end_col_offset), "line": line, "column": self.column(line, col), "full_line": first}
        self.facts["symbols"].append(row | more)
        return ordinal

    def _decorators(self, node: ast.AST) -> list[dict]:
        out = []
        for d in node.decorator_list:
            call = isinstance(d, ast.Call)
            if name := dotted(d.func if call else d):
                out.append({"name": name, "keywords": [k.arg for k in d.keywords if k.arg] if call else [], "call": "called" if call else "bare", "maker": self.makers.get(name.split(".")[0])})
        return out

    def _define(self, body: list[ast.stmt], parent: int | None, owner: ast.ClassDef | None) -> None:
        seen: set[str] = set()
        for s in self._statements(body):
            if isinstance(s, FUNCTIONS):
                line, col = name_place(s, self.lines)
                decorators = self._decorators(s)
                last = {d["name"].rsplit(".", 1)[-1] for d in decorators}
                kind = "function" if owner is None else "property" if last & {"property", "cached_property", "setter", "getter", "deleter"} else "method"
                k = self._symbol(s.name, kind, parent, line, col, s, decorators=decorators)
                self._define(s.body, k, None) if any(isinstance(x, (*FUNCTIONS, ast.ClassDef)) for x in self._statements(s.body)) else None
            elif isinstance(s, ast.ClassDef):
                line, col = name_place(s, self.lines)
                bases = [b for b in (dotted(x.value if isinstance(x, ast.Subscript) else x) for x in s.bases) if b]
                k = self._symbol(s.name, "class", parent, line, col, s, decorators=self._decorators(s), bases=bases, class_keywords=[w.arg for w in s.keywords if w.arg], open_base=len(bases) < len(s.bases))
                self._define(s.body, k, s)
                self._instance_attributes(s, k)
            elif isinstance(s, ast.Assign | ast.AnnAssign) and getattr(s, "value", None) is not None and (parent is None or owner is not None):
                for t in [n for x in (s.targets if isinstance(s, ast.Assign) else [s.target]) for n in _targets(x)]:
                    if t.id in seen:
                        continue
                    seen.add(t.id)
                    upper = t.id.isupper()
                    kind = ("constant" if upper else "variable") if owner is None else ("constant" if upper else "field")
                    self._symbol(t.id, kind, parent, t.lineno, t.col_offset, s)

    def _statements(self, body: list[ast.stmt]):
        """Statements of a scope, through branches, loops and handlers."""
        for s in body:
            yield s
            for field in ("body", "orelse", "finalbody"):
                if not isinstance(s, (*FUNCTIONS, ast.ClassDef)) and isinstance(getattr(s, field, None), list):
                    yield from self._statements(getattr(s, field))
            for h in getattr(s, "handlers", []):
                yield from self._statements(h.body)

    def _instance_attributes(self, cls: ast.ClassDef, parent: int) -> None:
        declared = {r["name"] for r in self.facts["symbols"] if r["parent_ordinal"] == parent}
        for method in cls.body:
            args = method.args.posonlyargs + method.args.args if isinstance(method, FUNCTIONS) else []
            if not args or any(isinstance(d, ast.Name) and d.id in ("staticmethod", "classmethod") for d in method.decorator_list):
                continue
            me = args[0].arg
            for n in ast.walk(method):
                targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) and n.value is not None else []
                for t in targets:
                    for a in t.elts if isinstance(t, ast.Tuple | ast.List) else [t]:
                        if isinstance(a, ast.Attribute) and isinstance(a.value, ast.Name) and a.value.id == me and a.attr not in declared:
                            declared.add(a.attr)
                            col = a.end_col_offset - len(a.attr.encode())
                            self._symbol(a.attr, "constant" if a.attr.isupper() else "field", parent, a.end_lineno, col, n)

    # Uses

    def _visit_scope(self, scope: ast.AST, above: list[set[str]]) -> None:
        """Uses in a function, class or module; ``above``: local names of the functions around it."""
        local: set[str] = set()
        mine = above
        if isinstance(scope, (*FUNCTIONS, ast.Lambda)):
            a = scope.args
            params = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if x]
            self.facts["param_names"] += params
            if isinstance(scope, FUNCTIONS) and (scope.name.startswith("test") or any((dotted(d.func if isinstance(d, ast.Call) else d) or "").rsplit(".", 1)[-1] == "fixture" for d in scope.decorator_list)):
                self.facts["params"] += [{"name": x.arg, "start": self.offset(x.lineno, x.col_offset), "end": self.offset(x.lineno, x.col_offset) + len(x.arg.encode())} for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)]
            local |= set(params)
            body = scope.body if isinstance(scope.body, list) else [ast.Expr(scope.body)]
            shared: set[str] = set()
            for n in _own_nodes(body):
                if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store | ast.Del):
                    local.add(n.id)
                elif isinstance(n, (*FUNCTIONS, ast.ClassDef)):
                    local.add(n.name)
                elif isinstance(n, ast.ExceptHandler) and n.name:
                    local.add(n.name)
                elif isinstance(n, ast.Global | ast.Nonlocal):
                    shared |= set(n.names)
            local -= shared
            mine = [*above, local]
        self._walk(scope, mine, guarded=False, typed=False, depth=len(mine) if isinstance(scope, FUNCTIONS) else len(above))

    def _walk(self, scope: ast.AST, local: list[set[str]], guarded: bool, typed: bool, depth: int) -> None:
        parts: list[tuple[ast.AST, bool, bool]] = []
        if isinstance(scope, FUNCTIONS):
            outer = [*scope.decorator_list, *scope.args.defaults, *(d for d in scope.args.kw_defaults if d), scope.returns, *(x.annotation for x in (*scope.args.posonlyargs, *scope.args.args, *scope.args.kwonlyargs, scope.args.vararg, scope.args.kwarg) if x)]
            for n in outer:
                if n is not None:
                    self._nodes(n, local[:-1], guarded, typed, depth - 1)
            parts = [(n, guarded, typed) for n in scope.body]
        elif isinstance(scope, ast.ClassDef):
            parts = [(n, guarded, typed) for n in (*scope.decorator_list, *scope.bases, *(k.value for k in scope.keywords), *scope.body)]
        elif isinstance(scope, ast.Lambda):
            parts = [(scope.body, guarded, typed)]
        else:
            parts = [(n, guarded, typed) for n in scope.body]
        for n, g, t in parts:
            self._nodes(n, local, g, t, depth)

    def _nodes(self, node: ast.AST, local: list[set[str]], guarded: bool, typed: bool, depth: int) -> None:
        if isinstance(node, (*FUNCTIONS, ast.ClassDef, ast.Lambda)):
            self._visit_scope(node, local)
            return
        if isinstance(node, ast.If):
            test = dotted(node.test)
            typed = typed or bool(test) and test.rsplit(".", 1)[-1] == "TYPE_CHECKING"
            guarded = guarded or self._version_test(node.test)
        elif isinstance(node, ast.Import | ast.ImportFrom):
            self._import(node, "type-only" if typed else "deferred" if depth else "runtime", guarded, local)
            return
        elif isinstance(node, ast.Attribute):
            if isinstance(node.ctx, ast.Load):
                self.facts["attr_names"].append(node.attr)
            if (name := dotted(node)) is not None:
                self._use(name, node, local)
                inner = node.value
                while isinstance(inner, ast.Attribute):
                    self.facts["attr_names"].append(inner.attr)
                    inner = inner.value
                return
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            self._use(node.id, node, local)
            return
        elif isinstance(node, ast.Call):
            self._call(node)
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            self._string(node.value, node)
        elif isinstance(node, ast.JoinedStr):
            head = node.values[0].value if node.values and isinstance(node.values[0], ast.Constant) else ""
            self._head(head)
        elif isinstance(node, ast.BinOp) and isinstance(node.left, ast.Constant) and isinstance(node.left.value, str):
            self._head(node.left.value.split("%")[0])
        for child in ast.iter_child_nodes(node):
            self._nodes(child, local, guarded, typed, depth)

    def _use(self, name: str, node: ast.AST, local: list[set[str]]) -> None:
        head = name.split(".")[0]
        if any(head in names for names in local):
            return
        first = node
        while isinstance(first, ast.Attribute):
            first = first.value
        start = self.offset(first.lineno, first.col_offset)
        self.facts["uses"].append({"name": name, "start": start, "end": self.offset(node.end_lineno, node.end_col_offset)})

    def _call(self, node: ast.Call) -> None:
        callee = node.func.id if isinstance(node.func, ast.Name) else None
        if callee in ("globals", "vars") and not node.args and not node.keywords:
            self.reads_globals = True
        # Calls that take an attribute by its name (fixed values).
        if callee in ("getattr", "hasattr", "setattr", "delattr") and len(node.args) > 1 and isinstance(node.args[1], ast.Constant) and isinstance(node.args[1].value, str):
            self.facts["attr_names"].append(node.args[1].value)

    def _head(self, text: str) -> None:
        """The literal beginning of a computed string: a beginning of attribute names, or a package whose modules are loaded by name."""
        tail = re.split(r"[^A-Za-z0-9_.]", text)[-1] if text else ""
        if len(tail) >= 3 and tail.endswith("_") and IDENTIFIER.match(tail):
            self.facts["attr_prefixes"].append(tail)
        if tail.endswith(".") and len(tail) > 1 and (DOTTED.match(tail[:-1]) or IDENTIFIER.match(tail[:-1])) and len(text) <= LONGEST_STRING:
            self.facts["package_wide"].append(tail[:-1])

    def _string(self, text: str, node: ast.AST) -> None:
        if len(text) > LONGEST_STRING:
            return
        if IDENTIFIER.match(text):
            self.facts["attr_names"].append(text)
            if len(text) >= 3 and text not in self.said:
                self.said.add(text)
                self.facts["words"].append({"name": text, "line": node.lineno, "column": self.column(node.lineno, node.col_offset)})
        for mark in "%{":
            if mark in text:
                self._head(text.split(mark)[0])
        if text and not any(c.isspace() for c in text):
            if text.endswith(".py"):
                self.facts["path_literals"].append(text.replace("\\", "/"))
            elif DOTTED.match(text) or ENTRY.match(text):
                self.facts["strings"].append({"name": text.replace(":", "."), "start": self.offset(node.lineno, node.col_offset), "end": self.offset(node.end_lineno, node.end_col_offset), "line": node.lineno, "column": self.column(node.lineno, node.col_offset)})

    def _import(self, node: ast.AST, kind: str, guarded: bool, local: list[set[str]]) -> None:
        where = {"line": node.lineno, "column": self.column(node.lineno, node.col_offset), "start": self.offset(node.lineno, node.col_offset), "end": self.offset(node.end_lineno, node.end_col_offset), "kind": kind, "condition": "version" if guarded else "always"}
        top = not local
        base = ""
        if isinstance(node, ast.ImportFrom):
            base = node.module or ""
            if node.level:
                parts = (self.module or "").split(".") if self.module else []
                up = node.level - (1 if self.is_package else 0)
                base = ".".join([*(parts[: len(parts) - up] if up else parts), *([node.module] if node.module else [])])
        for a in node.names:
            self.seq += 1
            level = getattr(node, "level", 0)
            if isinstance(node, ast.Import):
                self.facts["imports"].append({"seq": self.seq, "module": a.name, "attr": None, "level": 0, **where})
                self.facts["aliases"].append({"name": a.asname or a.name.split(".")[0], "module": a.name if a.asname else a.name.split(".")[0], "attr": None, "top": top})
            else:
                self.facts["imports"].append({"seq": self.seq, "module": base, "attr": a.name, "level": level, **where})
                self.facts["aliases"].append({"name": a.asname or a.name, "module": base, "attr": None if a.name == "*" else a.name, "top": top})


_NAMES = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*")
_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+(\.*)([A-Za-z0-9_.]*)[ \t]+import[ \t]+\(?([^#\n)]+)|import[ \t]+([^#\n;]+))", re.M)


def names_only(source: str, module: str | None, is_package: bool) -> dict[str, Any]:
    """What the text of a file names, without its structure: dotted names as uses and attributes, and imports that stand on one line."""
    uses, attrs, imports, aliases = [], set(), [], []
    at = start = 0
    for m in _NAMES.finditer(source):
        start += len(source[at : m.start()].encode())
        at = m.start()
        uses.append({"name": m[0], "start": start, "end": start + len(m[0])})
        attrs.update(m[0].split("."))
    for m in _IMPORT.finditer(source):
        line = source.count("\n", 0, m.start()) + 1
        place = {"line": line, "column": 1, "start": m.start(), "end": m.end(), "kind": "runtime", "condition": "always"}
        base = m[2] or ""
        if m[1]:
            parts = module.split(".") if module else []
            up = len(m[1]) - (1 if is_package else 0)
            base = ".".join([*(parts[: len(parts) - up] if up else parts), *([m[2]] if m[2] else [])])
        for item in (m[3] or m[4]).split(","):
            name, _, bound = (x.strip() for x in item.partition(" as "))
            if not (name == "*" or _NAMES.fullmatch(name)):
                continue
            if m[4]:
                imports.append({"seq": len(imports), "module": name, "attr": None, "level": 0, **place})
                aliases.append({"name": bound or name.split(".")[0], "module": name if bound else name.split(".")[0], "attr": None, "top": True})
            else:
                imports.append({"seq": len(imports), "module": base, "attr": name, "level": len(m[1]), **place})
                aliases.append({"name": bound or name, "module": base, "attr": None if name == "*" else name, "top": True})
    return {"uses": uses, "attr_names": sorted(attrs), "imports": imports, "aliases": aliases}
