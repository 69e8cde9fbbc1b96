"""References that a run's patch has left behind, found on a base with an overlay for each run.

What a repository's files import is found once, whatever the number of runs. A run adds only the files that its patch
touches: the base's rows of those paths are taken away by an anti-join and the rows of their new texts stand in. Each
distinct text, before or after, is parsed once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..session import ship_package, stored
from . import diff, pyast

#: Folders that hold none of a project's own sources. Fixed names.
SKIP = (".git", ".hg", ".svn", ".tox", ".venv", "venv", "__pycache__", "build", "dist", ".mypy_cache", ".pytest_cache")
KINDS = ("stale_old_import", "stale_local_reference", "removed_import_used")
_SECTION = "file_ord int, old string, new string, post string, removed array<string>, added array<string>, dropped array<struct<name:string,module:string>>"
_FACT = "hash binary, what string, symbol string, module string, level int, line int"


def _clean(token: Column) -> Column:
    """A path of a patch without its prefix; null for /dev/null."""
    bare = F.regexp_replace(F.trim(token), "^[ab]/", "")
    return F.when((F.trim(token) != "/dev/null") & (bare != ""), bare)


def patch_sections(runs: DataFrame) -> DataFrame:
    """run_id, repo, file_ord, old, new, section: the files of each patch (run_id, repo, patch), paths without prefixes."""
    parts = F.split("patch", r"(?m)^(?=diff --git )", -1)
    rows = runs.where("patch is not null").select("run_id", "repo", F.posexplode(parts).alias("file_ord", "section")).where(F.startswith("section", F.lit("diff --git ")))
    head = F.split("section", r"(?m)^@@ ", 2)[0]
    words = F.split(F.trim(F.split("section", r"\R", 2)[0]), r"\s+")

    def path(place: int, mark: str) -> Column:
        named = F.regexp_extract(head, rf"(?m)^{mark} (.*)$", 1)
        return F.when(head.rlike(rf"(?m)^{mark} "), _clean(named)).otherwise(F.when(F.size(words) >= 4, _clean(F.get(words, F.lit(place)))))

    return rows.select("run_id", "repo", "file_ord", path(2, "---").alias("old"), path(3, r"\+\+\+").alias("new"), "section")


def changed_files(runs: DataFrame, files: DataFrame) -> DataFrame:
    """The Python files of each patch: run_id, file_ord, old, new, post (the text after; null where it is gone or can't be
    told), removed and added (names of functions and classes), dropped (imports: name, module). Stored.

    Only a patch and the texts that it names go to Python, once each.
    """
    ship_package(runs.sparkSession)
    own = patch_sections(runs).where("old like '%.py' or new like '%.py'")
    before = files.select("repo", F.col("path").alias("old"), F.col("text").alias("before"), F.lit(True).alias("there"))

    def run(batches):
        for pdf in batches:
            rows = []
            for name, k, old, new, section, before, there in zip(*(pdf[c] for c in ("run_id", "file_ord", "old", "new", "section", "before", "there"))):
                parsed = (diff.parse_patch(section) or [diff.FilePatch()])[0]
                parsed.old, parsed.new = old, new
                post = None
                if new is not None and new.endswith(".py") and (old is None or there is True and old.endswith(".py")):
                    post = diff.apply_patch("" if old is None else before or "", parsed)
                gone, come = parsed.side("-"), parsed.side("+")
                rows.append((name, k, old, new, post, pyast.top_level_symbols(gone), pyast.top_level_symbols(come), [{"name": a, "module": b} for a, b in pyast.removed_imports(gone)]))
            yield pd.DataFrame(rows, columns=["run_id", "file_ord", "old", "new", "post", "removed", "added", "dropped"])

    met = own.join(before, ["repo", "old"], "left").select("run_id", "file_ord", "old", "new", "section", "before", "there")
    return stored(met.mapInPandas(run, f"run_id {met.schema['run_id'].dataType.simpleString()}, {_SECTION}"), "changed-files")


def _hash(text: str) -> Column:
    return F.unhex(F.sha2(text, 256)).alias("hash")


def distinct_texts(texts: DataFrame) -> DataFrame:
    """hash, text, full of each distinct text that isn't empty; full if it is so anywhere."""
    once = texts.where("text <> ''").select(_hash("text"), "text", "full")
    return once.groupBy("hash").agg(F.any_value("text").alias("text"), F.bool_or("full").alias("full"))


def text_facts(texts: DataFrame) -> DataFrame:
    """Facts of distinct texts (text, full): hash, what, symbol, module, level, line. Stored.

    ``from``: a name imported from a module as written. For ``full`` texts also ``load``, ``bound`` and ``export``.
    A text that can't be parsed has none.
    """
    ship_package(texts.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = []
            for key, text, full in zip(pdf["hash"], pdf["text"], pdf["full"]):
                facts = pyast.analyse(text, loads=full)
                if facts is None:
                    continue
                rows += [(key, "from", name, module, level, line) for module, level, name, line in facts.imports]
                if full:
                    rows += [(key, "load", name, None, 0, line) for name, line in sorted(set(facts.loads))]
                    rows += [(key, "bound", name, None, 0, 0) for name in sorted(facts.bound)]
                    rows += [(key, "export", name, None, 0, 0) for name in pyast.exported_names(text)]
            yield pd.DataFrame(rows, columns=["hash", "what", "symbol", "module", "level", "line"])

    return stored(distinct_texts(texts).mapInPandas(run, _FACT), "text-facts")


def _module(path: str, root: str) -> Column:
    """Dotted module of a Python file below the import root; null elsewhere, and for the root's own package file."""
    p, r = E.norm_path(path), F.trim(E.norm_path(root), F.lit("/"))
    below = F.when(r == "", p).when(F.startswith(p, F.concat(r, F.lit("/"))), F.substr(p, F.length(r) + 2))
    name = E.module_name(below)
    return F.when(F.endswith(p, F.lit(".py")) & (name != ""), name)


def _imports(rows: DataFrame, path: str) -> DataFrame:
    """``from`` facts (import_root, path, module, level) with the module they mean; those that mean none are left out."""
    own = rows.withColumn("_own", _module(path, "import_root"))
    package = F.endswith(F.col(path), F.lit("__init__.py"))
    means = E.resolve_import("_own", "level", "module", package)
    return own.withColumn("module", F.when(F.col("_own").isNotNull(), means)).drop("_own").where("module is not null")


def import_roots(runs: DataFrame, files: DataFrame) -> DataFrame:
    """Runs (repo, entry) with source_root, their entry, and import_root: the folder above it if it is a package, else itself."""
    package = files.where(F.endswith("path", F.lit("/__init__.py"))).select("repo", F.expr("left(path, length(path) - 12)").alias("entry"), F.lit(True).alias("_package"))
    entry = F.trim(E.norm_path("entry"), F.lit("/"))
    parent = F.regexp_replace("entry", "/?[^/]*$", "")
    joined = runs.withColumn("entry", entry).join(package.distinct(), ["repo", "entry"], "left")
    return joined.withColumns({"source_root": F.col("entry"), "import_root": F.when(F.col("_package"), parent).otherwise(F.col("entry"))}).drop("_package")


def stale_references(runs: DataFrame, files: DataFrame) -> DataFrame:
    """run_id, kind, path, line, symbol, removal, old_module, new_module, old_file, new_file of each finding.

    runs: run_id, repo, patch, import_root and, if it isn't the whole repository, source_root (see ``import_roots``).
    files: repo, path, text of Python files before. Kinds:

    * ``stale_old_import``: a file still imports a symbol from the module that it was moved or deleted from;
    * ``stale_local_reference``: a file still loads a symbol that was moved out of it, and doesn't bind it;
    * ``removed_import_used``: a file still loads a name whose import the patch removed, and doesn't bind it.

    removal: moved, deleted or import_removed. A symbol that was moved to several places gives a finding for each. A file
    after a patch that doesn't fit it is unknown and isn't looked at. Runs without a patch, texts that can't be parsed
    and files outside the source root (but for those that a patch touches) give none.
    """
    if "source_root" not in runs.columns:
        runs = runs.withColumn("source_root", F.lit(""))
    plan = stored(runs.select("run_id", "repo", "import_root", "source_root"), "runs")
    sections = changed_files(runs.select("run_id", "repo", "patch"), files).join(plan, "run_id")
    last = F.max_by(F.struct("import_root", _hash("post")), "file_ord").alias("s")
    post = stored(sections.where("post is not null").groupBy("run_id", F.col("new").alias("path")).agg(last).select("run_id", "path", "s.*"), "files-after")
    told = text_facts(files.select("text", F.lit(False).alias("full")).unionByName(sections.where("post is not null").select(F.col("post").alias("text"), F.lit(True).alias("full"))))
    of = lambda what: told.where(F.col("what") == what)

    # the overlay: what files after a run's patch export, import, bind and load
    def after(what: str) -> DataFrame:
        return post.join(of(what).drop("what"), "hash").drop("hash")

    exports = after("export").select("run_id", "path", "symbol")
    removed = sections.select("run_id", "repo", "import_root", F.col("old").alias("old_file"), F.explode("removed").alias("symbol"), _module("old", "import_root").alias("old_module")).where("old_module is not null").distinct()
    gone = removed.join(exports.withColumnRenamed("path", "old_file"), ["run_id", "old_file", "symbol"], "left_anti")
    added = sections.select("run_id", F.col("new").alias("new_file"), F.explode("added").alias("symbol"), _module("new", "import_root").alias("new_module")).where("new_module is not null").distinct()
    there = added.join(exports.withColumnRenamed("path", "new_file"), ["run_id", "new_file", "symbol"], "left_semi")
    moved = gone.join(there, ["run_id", "symbol"]).where("new_module <> old_module")
    lost = gone.join(moved.select("run_id", "old_file", "symbol"), ["run_id", "old_file", "symbol"], "left_anti").withColumns({"new_file": F.lit(None).cast("string"), "new_module": F.lit(None).cast("string")})
    gone = stored(moved.withColumn("removal", F.lit("moved")).unionByName(lost.withColumn("removal", F.lit("deleted"))), "gone-symbols")

    def finding(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select("run_id", F.lit(kind).alias("kind"), "path", "line", "symbol", "removal", "old_module", "new_module", "old_file", "new_file")

    # the base: imports of all files, once for each root they are read with
    roots = plan.select("repo", "import_root", "source_root").distinct()
    own = F.trim(E.norm_path("source_root"), F.lit("/"))
    inside = ((own == "") | F.startswith("path", F.concat(own, F.lit("/")))) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIP)))
    base = files.select("repo", "path", _hash("text")).join(of("from").drop("what"), "hash").join(roots, "repo").where(inside)
    wanted = gone.select("repo", "import_root", F.col("old_module").alias("module"), "symbol").distinct()
    base = _imports(base, "path").join(wanted, ["repo", "import_root", "module", "symbol"], "left_semi").select("repo", "import_root", "source_root", "path", "module", "symbol", "line")
    touched = sections.select("run_id", F.explode(F.array("old", "new")).alias("path")).where("path is not null").distinct()
    lost_from = gone.withColumn("module", F.col("old_module")).join(plan.select("run_id", "source_root"), "run_id")
    kept = lost_from.join(base, ["repo", "import_root", "source_root", "module", "symbol"]).join(touched, ["run_id", "path"], "left_anti")
    imports = _imports(after("from"), "path").select("run_id", "path", "module", "symbol", "line")
    again = gone.withColumn("module", F.col("old_module")).join(imports, ["run_id", "module", "symbol"])

    bound = after("bound").select("run_id", "path", "symbol")
    loads = after("load").select("run_id", "path", "symbol", "line")
    used = loads.join(bound, ["run_id", "path", "symbol"], "left_anti")
    # a symbol that comes back under another name isn't stale
    back = imports.select("run_id", F.col("path").alias("old_file"), F.col("module").alias("new_module"), "symbol")
    left = gone.where("removal = 'moved'").join(back, ["run_id", "old_file", "new_module", "symbol"], "left_anti")
    local = left.withColumn("path", F.col("old_file")).join(used, ["run_id", "path", "symbol"])
    dropped = sections.select("run_id", F.col("old").alias("path"), F.explode("dropped").alias("d")).where("path like '%.py'").select("run_id", "path", F.col("d.name").alias("symbol"), F.col("d.module").alias("old_module")).distinct()
    none = F.lit(None).cast("string")
    orphaned = dropped.join(used, ["run_id", "path", "symbol"]).withColumns({"removal": F.lit("import_removed"), "new_module": none, "old_file": F.col("path"), "new_file": none})
    return finding(kept, KINDS[0]).unionByName(finding(again, KINDS[0])).unionByName(finding(local, KINDS[1])).unionByName(finding(orphaned, KINDS[2])).distinct()
