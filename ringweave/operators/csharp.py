"""Type references between C# files, read from their source.

A file's declarations and mentions of types are found by a scan of its tokens; what a mention means follows from the
namespaces that are visible where it stands, by equi joins. This is what a compiler knows less inference: a type that
is never named in a file (``var``), and one that only a library declares, give no edge.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..session import ship_package

#: Comments, texts, preprocessor lines, then names (dotted ones whole) and single marks.
_TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*.*?\*/|\$*"{3,}.*?"{3,}|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+'|^[ \t]*\#[^\n]*)"""
    r"""|(?P<name>@?[^\W\d]\w*(?:\s*(?:\.|::)\s*@?[^\W\d]\w*)*)|(?P<mark>[^\s\w])""",
    re.S | re.M,
)
_DECLARES = {"class", "struct", "interface", "enum", "record"}
_WORDS = set(
    "abstract as async await base bool break byte case catch char checked const continue decimal default delegate do double dynamic else event explicit extern false finally fixed float for foreach get goto if "
    "implicit in init int internal is let lock long nameof new null object operator out override params partial private protected public readonly ref required return sbyte sealed set short sizeof stackalloc static "
    "string switch this throw true try typeof uint ulong unchecked unsafe ushort value var virtual void volatile when where while with yield class struct interface enum record namespace using".split()
)


def scan(text: str) -> tuple[set[tuple[str, str]], set[tuple[str, str]]]:
    """(declared, mentioned): types as (namespace, name) that a file declares, and those that it may mean."""
    tokens = [(m.lastgroup, re.sub(r"[\s@]|global::", "", m[0]) if m.lastgroup == "name" else m[0]) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]
    declared, names, aliases = set(), [], {}
    scopes: list[str] = []  # what each open brace belongs to; "" for blocks that are no namespace
    spaces, visible = [""], {""}
    waiting, i = "", 0

    def inside() -> str:
        return ".".join(s for s in [spaces[0], *scopes] if s)

    while i < len(tokens):
        kind, word = tokens[i]
        after = tokens[i + 1][1] if i + 1 < len(tokens) else ""
        if kind == "mark":
            if word == "{":
                scopes.append(waiting)
                waiting = ""
            elif word == "}" and scopes:
                scopes.pop()
        elif word == "namespace":
            end = tokens[i + 2][1] if i + 2 < len(tokens) else ""
            if end == ";":
                spaces[0] = after
            else:
                waiting = after
            full = ".".join(s for s in (inside(), after if end != ";" else "") if s)
            parts = full.split(".")
            visible.update(".".join(parts[:k]) for k in range(1, len(parts) + 1))
            i += 1
        elif word == "using" and not any(scopes) and after not in ("(", "var"):
            j = i + 1 + (after == "static")
            target = tokens[j][1] if j < len(tokens) else ""
            if j + 2 < len(tokens) and tokens[j + 1][1] == "=":
                aliases[target] = tokens[j + 2][1]
                j += 2
            else:
                visible.add(target)
            i = j
        elif word in _DECLARES and i + 1 < len(tokens) and tokens[i + 1][0] == "name":
            j = i + 1 + (after in ("class", "struct"))  # record class, record struct
            if j < len(tokens) and tokens[j][1] not in _WORDS:
                declared.add((inside(), tokens[j][1]))
                i = j
        elif word == "delegate":
            j = i + 1  # the name is the last one before the parameters, which may come after type arguments
            while j + 1 < len(tokens) and tokens[j + 1][1] not in ("(", ";"):
                j += 1
            k = j
            while k > i and tokens[k][0] != "name":
                k -= 1
            if k > i + 1:
                declared.add((inside(), tokens[k][1]))
        elif i == 0 or tokens[i - 1][1] != ".":
            names.append(word)
        i += 1
    mentioned = set()
    for word in names:
        parts = word.split(".")
        if parts[0] in _WORDS:
            continue
        if parts[0] in aliases:
            parts = aliases[parts[0]].split(".") + parts[1:]
        for k in range(len(parts)):
            scope = ".".join(parts[:k])
            mentioned.update((".".join(s for s in (v, scope) if s), parts[k]) for v in visible)
    return declared, mentioned


def type_table(files: DataFrame) -> DataFrame:
    """graph_id, path, declares (boolean), namespace, name of C# files (graph_id, path, text) that are sources.

    A null text has no types. Built and generated files are left out.
    """
    ship_package(files.sparkSession)

    names = ["graph_id", "path", "declares", "namespace", "name"]
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for gid, path, text in zip(*(column.to_pylist() for column in batch.columns)):
                declared, mentioned = scan(text or "")
                rows += [(gid, path, True, *d) for d in sorted(declared)] + [(gid, path, False, *m) for m in sorted(mentioned)]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    own = files.where(E.is_csharp_source("path")).select("graph_id", E.norm_path("path").alias("path"), "text")
    return own.mapInArrow(run, "graph_id string, path string, declares boolean, namespace string, name string")


def type_graph(files: DataFrame) -> DataFrame:
    """Edges (graph_id, src, dst) from each C# file to those that declare a type it mentions; a type that several files
    declare in parts leads to all of them. No file has an edge to itself."""
    types = type_table(files)
    there = types.where("declares").select("graph_id", "namespace", "name", F.col("path").alias("dst"))
    used = types.where("not declares").select("graph_id", "namespace", "name", F.col("path").alias("src"))
    return used.join(there, ["graph_id", "namespace", "name"]).where("src <> dst").select("graph_id", "src", "dst").distinct()
