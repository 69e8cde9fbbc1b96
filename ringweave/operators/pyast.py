"""Facts about Python sources, by the standard library's parser, and dependency graphs of modules."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package


def module_of(path: str, root: str | None = "") -> str:
    """Dotted module of a file below the import root; a package for its ``__init__``."""
    path, root = path.replace("\\", "/").strip("/"), (root or "").strip("/")
    if root and path.startswith(root + "/"):
        path = path[len(root) + 1 :]
    parts = re.sub(r"\.py$", "", path).split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def resolve(module: str, is_package: bool, level: int, target: str | None, compat: bool = False) -> str | None:
    """The module that ``from <dots><target> import`` means. ``compat``: absolute ones as relative to the module."""
    parts = module.split(".") if module else []
    if level == 0:
        base = parts if compat else []
    else:
        drop = level if compat or not is_package else level - 1
        if drop > len(parts):
            return None
        base = parts[: len(parts) - drop]
    return ".".join([*base, *([target] if target else [])]) or None


def _mentions_type_checking(node: ast.AST) -> bool:
    return any((isinstance(n, ast.Name) and n.id == "TYPE_CHECKING") or (isinstance(n, ast.Attribute) and n.attr == "TYPE_CHECKING") for n in ast.walk(node))


def runtime_imports(text: str, module: str, is_package: bool = False, compat: bool = False) -> list[str]:
    """Modules imported outside any ``if`` that mentions TYPE_CHECKING, with all below it left out; [] if unparsable."""
    try:
        todo = [ast.parse(text)]
    except (SyntaxError, ValueError):
        return []
    out = set()
    while todo:
        node = todo.pop()
        if isinstance(node, ast.If) and _mentions_type_checking(node.test):
            continue
        if isinstance(node, ast.Import):
            out.update(a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            base = resolve(module, is_package, node.level or 0, node.module, compat)
            if base:
                out.add(base)
        todo += ast.iter_child_nodes(node)
    return sorted(out)


def import_table(files: DataFrame, compat: bool = False) -> DataFrame:
    """graph_id, path, module, imported of Python files (graph_id, path, text, import_root)."""
    ship_package(files.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = []
            for gid, path, text, root in zip(pdf["graph_id"], pdf["path"], pdf["text"], pdf["import_root"]):
                module = module_of(path, root)
                rows += [(gid, path, module, i) for i in runtime_imports(text or "", module, path.endswith("__init__.py"), compat)]
            yield pd.DataFrame(rows, columns=["graph_id", "path", "module", "imported"])

    return files.select("graph_id", "path", "text", "import_root").mapInPandas(run, "graph_id string, path string, module string, imported string")


def module_graph(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges (graph_id, src, dst) between files of a module listing (graph_id, module, path, imports), as far as
    the files' own imports (graph_id, path, imported) bear them out.

    An edge stays if an import of its source is its target module, or a prefix or extension of it by whole names;
    all edges of a source without any import found stay.
    """
    own = modules.where(F.col("path").isNotNull() & ~F.col("path").rlike("(?i)(^|/)vendors?(/|$)"))
    at = own.select("graph_id", F.col("module").alias("dst_module"), F.col("path").alias("dst"))
    edges = own.select("graph_id", F.col("path").alias("src"), F.explode("imports").alias("dst_module")).join(at, ["graph_id", "dst_module"])
    seen = imports.select("graph_id", F.col("path").alias("src"), "imported")
    near = (F.col("imported") == F.col("dst_module")) | F.startswith("imported", F.concat("dst_module", F.lit("."))) | F.startswith("dst_module", F.concat("imported", F.lit(".")))
    e, s = edges.alias("e"), seen.alias("s")
    backed = e.join(s, (F.col("e.graph_id") == F.col("s.graph_id")) & (F.col("e.src") == F.col("s.src")) & near, "left_semi")
    unknown = edges.join(seen, ["graph_id", "src"], "left_anti")
    return backed.unionByName(unknown).select("graph_id", "src", "dst").distinct()


_DEF = re.compile(r"^(?:async\s+def|def|class)\s+([A-Za-z_]\w*)\s*[(:]")


def top_level_symbols(lines: list[str]) -> list[str]:
    """Functions and classes that unindented lines define, each once."""
    return list(dict.fromkeys(m[1] for m in map(_DEF.match, lines) if m))


def import_names(lines: list[str]) -> list[tuple[str, str]]:
    """(module, bound name) of the imports in unindented lines; none if they don't parse together."""
    text = "\n".join(x for x in lines if re.match(r"(?:import|from)\s|[\w, ]*\)|\s+[\w, ]+,?\s*$", x) and not x.startswith((" ", "\t")))
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in tree.body:
        if isinstance(node, ast.Import):
            out += [(a.name, a.asname or a.name.split(".")[0]) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [("." * node.level + (node.module or ""), a.asname or a.name) for a in node.names if a.name != "*"]
    return list(dict.fromkeys(out))


def exported_names(text: str) -> list[str]:
    """Names that a module's top level binds."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append(node.name)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            out += [a.asname or (a.name.split(".")[0] if isinstance(node, ast.Import) else a.name) for a in node.names if a.name != "*"]
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            out += [n for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) for n in assigned_names(t)]
    return list(dict.fromkeys(out))


def export_table(files: DataFrame, key: str, text: str) -> DataFrame:
    """key and name of what each source's top level binds; a source that can't be parsed binds nothing."""
    ship_package(files.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = [(k, n) for k, t in zip(pdf[key], pdf[text]) for n in exported_names(t or "")]
            yield pd.DataFrame(rows, columns=[key, "name"])

    own = files.select(key, text)
    return own.mapInPandas(run, own.select(key, F.lit("").alias("name")).schema)


def assigned_names(target: ast.AST | None) -> list[str]:
    """Names that an assignment's target binds: a name, or those in tuples and lists."""
    if isinstance(target, ast.Name):
        return [target.id]
    return [n for x in target.elts for n in assigned_names(x)] if isinstance(target, (ast.Tuple, ast.List)) else []


@dataclass
class Facts:
    imports: list[tuple[str | None, int, str, int]] = field(default_factory=list)  # module as written, level, name, line
    loads: list[tuple[str, int]] = field(default_factory=list)  # name, line
    bound: set[str] = field(default_factory=set)


class _Loads(ast.NodeVisitor):
    """Names loaded at run time: annotations and import statements are left out."""

    def __init__(self, out: list[tuple[str, int]]):
        self.out = out

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Load):
            self.out.append((node.id, node.lineno))

    def visit_arg(self, node):
        pass

    def visit_AnnAssign(self, node):
        if node.value:
            self.visit(node.value)

    def _each(self, *nodes):
        for x in nodes:
            if x is not None:
                self.visit(x)

    def visit_FunctionDef(self, node):
        self._each(*node.decorator_list, *node.args.defaults, *node.args.kw_defaults, *node.body)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node):
        self._each(*node.args.defaults, *node.args.kw_defaults, node.body)

    def visit_ClassDef(self, node):
        self._each(*node.decorator_list, *node.bases, *node.keywords, *node.body)


#: Nodes that bind the names of their targets.
_TARGETS = {
    ast.Assign: lambda n: n.targets, ast.AnnAssign: lambda n: [n.target], ast.AugAssign: lambda n: [n.target], ast.For: lambda n: [n.target], ast.AsyncFor: lambda n: [n.target],
    ast.With: lambda n: [i.optional_vars for i in n.items], ast.AsyncWith: lambda n: [i.optional_vars for i in n.items],
}


def analyse(text: str | None, loads: bool = True) -> Facts | None:
    """The facts of a source, without loads and bound names if they aren't asked for; None if it can't be parsed.

    Bound are the names of functions, classes, parameters (lambdas' and starred ones too), imports, exceptions, and the
    targets of assignments, loops and ``with``. Those of comprehensions are bound only inside them and don't count.
    """
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return None
    facts = Facts()
    for node in ast.walk(tree):
        kind = type(node)
        if kind is ast.ImportFrom:
            facts.imports += [(node.module, node.level or 0, a.name, node.lineno) for a in node.names]
            facts.bound.update(a.asname or a.name for a in node.names if a.name != "*")
        elif not loads:
            continue
        elif kind in (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef):
            facts.bound.add(node.name)
        elif kind is ast.arg:
            facts.bound.add(node.arg)
        elif kind is ast.Import:
            facts.bound.update(a.asname or a.name.split(".")[0] for a in node.names)
        elif kind is ast.ExceptHandler and node.name:
            facts.bound.add(node.name)
        elif kind in _TARGETS:
            facts.bound.update(n for t in _TARGETS[kind](node) for n in assigned_names(t))
    if loads:
        _Loads(facts.loads).visit(tree)
    return facts


def removed_imports(lines: list[str]) -> list[tuple[str, str | None]]:
    """(bound name, module as written without dots) of the lines that begin an import; none if they don't parse together."""
    try:
        tree = ast.parse("\n".join(x for x in lines if x.startswith(("import ", "from "))))
    except (SyntaxError, ValueError):
        return []
    out: list[tuple[str, str | None]] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(a.asname or a.name.split(".")[0], a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(a.asname or a.name, node.module) for a in node.names if a.name != "*"]
    return list(dict.fromkeys(out))
