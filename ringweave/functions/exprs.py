"""Column expressions: percentages, bins, paths, cycles, budgets, texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def pct(part: Column | str, whole: Column | str, digits: int = 1) -> Column:
    """Percentage rounded half to even; null where the whole is zero or null."""
    part, whole = col(part), col(whole)
    return F.when(whole != 0, F.bround(F.lit(100.0) * part / whole, digits))


def count_if(flag: Column) -> Column:
    """How many rows have the flag; a null counts as no."""
    return F.coalesce(F.count_if(flag), F.lit(0)).cast("long")


def to_int(value: Column | str) -> Column:
    """A whole number, or null where there is none."""
    return F.expr(f"try_cast({value} AS BIGINT)") if isinstance(value, str) else value.try_cast("bigint")


# bins ---------------------------------------------------------------------------------------------------------


def _upto(value: Column, *steps: tuple[float, str], above: str) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for most, label in steps:
        out = out.when(value <= most, label)
    return out.otherwise(above)


#: Bins of cycle sizes. Fixed values.
SIZE_BINS = [(2, 3, "2--3"), (4, 6, "4--6"), (7, 8, "7--8")]


def size_bin(size: Column | str, bins: list[tuple[int, int, str]] = SIZE_BINS) -> Column:
    """Label of the first bin that holds the size; null outside all."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(bins):
        out = F.when(col(size).between(lo, hi), label).otherwise(out)
    return out


def parse_bins(spec: str) -> list[tuple[int, int, str]]:
    """Bins of a text like ``2-3,4-6,7``; the ends of a bin may be swapped."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        a, _, b = part.partition("-")
        lo, hi = sorted((int(a), int(b or a)))
        out.append((lo, hi, f"{lo}-{hi}" if lo != hi else str(lo)))
    if not out:
        raise ValueError("no bins")
    return out


def bin_priority(bins: list[tuple[int, int, str]]) -> list[str]:
    """Labels of the bins, larger cycles first."""
    return [label for _, _, label in sorted(bins, key=lambda b: (b[1], b[0]), reverse=True)]


def centrality_bin(x: Column | str) -> Column:
    return _upto(col(x), (1.0, "<=1x average"), (2.0, "1--2x average"), above=">2x average")


def external_bin(n: Column | str) -> Column:
    return _upto(col(n), (50, "<=50"), (100, "51--100"), above=">100")


def repo_bin(n: Column | str) -> Column:
    return _upto(col(n), (100, "<=100"), (300, "101--300"), above=">300")


def scc_bin(n: Column | str) -> Column:
    return _upto(col(n), (10, "1--10"), (50, "11--50"), above=">50")


#: Labels of the three bins of each of four factors. Fixed values.
BIN_ORDER = ["<=1x average", "1--2x average", ">2x average", "<=50", "51--100", ">100", "<=100", "101--300", ">300", "1--10", "11--50", ">50"]


def bin_rank(label: Column | str) -> Column:
    """Place of a bin among the three of its factor; unknown labels come last."""
    pairs = [x for i, name in enumerate(BIN_ORDER) for x in (F.lit(name), F.lit(i % 3))]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(label)), F.lit(999))


#: Bins of pooled success. Fixed values.
DIFFICULTY_BINS = ["0%", ">0--10%", ">10--25%", ">25--50%", ">50--75%", ">75--<100%", "100%"]


def difficulty_bin(pct_value: Column | str) -> Column:
    p = col(pct_value)
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(p == 0, DIFFICULTY_BINS[0])
        .when(p <= 10, DIFFICULTY_BINS[1])
        .when(p <= 25, DIFFICULTY_BINS[2])
        .when(p <= 50, DIFFICULTY_BINS[3])
        .when(p <= 75, DIFFICULTY_BINS[4])
        .when(p < 100, DIFFICULTY_BINS[5])
        .when(p == 100, DIFFICULTY_BINS[6])
    )


# names and paths ----------------------------------------------------------------------------------------------


def branch_name(text: Column | str) -> Column:
    """A text as a git branch name: odd characters become single dashes, none at the ends."""
    t = F.replace(F.trim(col(text)), F.lit(" "), F.lit("-"))
    t = F.regexp_replace(t, "[^A-Za-z0-9._/-]+", "-")
    t = F.regexp_replace(t, "-{2,}", "-")
    return F.regexp_replace(F.regexp_replace(t, "^-+|-+$", ""), "/+$", "")


def refactor_branch(experiment: Column | str, mode: Column | str, cycle: Column | str) -> Column:
    """``atd-<experiment>-<mode>-<cycle>`` as a branch name."""
    return branch_name(F.concat_ws("-", F.lit("atd"), col(experiment), col(mode), col(cycle)))


ARTIFACTS = {
    "metrics_path": "code_quality_checks/metrics.json",
    "graph_path": "ATD_identification/dependency_graph.json",
    "scc_report_path": "ATD_identification/scc_report.json",
    "cycle_catalog_path": "ATD_identification/cycle_catalog.json",
    "openhands_status_path": "openhands/status.json",
    "explain_prompt_path": "explain/prompt.txt",
    "diff_patch_path": "openhands/git_diff.patch",
}


def artifact_path(root: Column | str, repo: Column | str, branch: Column | str, kind: str) -> Column:
    """``<root>/<repo>/branches/<branch>/...`` for a kind of artifact, or the folder itself for ``dir``."""
    parts = [col(root), col(repo), F.lit("branches"), col(branch)]
    return F.concat_ws("/", *parts, *([] if kind == "dir" else [F.lit(ARTIFACTS[kind])]))


def norm_path(p: Column | str) -> Column:
    return F.trim(F.replace(col(p), F.lit("\\"), F.lit("/")))


def path_depth(p: Column | str) -> Column:
    return F.size(F.split(col(p), "/")) - 1


def short_label(p: Column | str) -> Column:
    """File name without its last suffix."""
    name = F.element_at(F.split(col(p), "/"), -1)
    return F.when(name == "__init__.py", "__init__").otherwise(F.regexp_replace(name, "(?<=.)\\.[^.]*$", ""))


def folder_bucket(p: Column | str, root: Column | str, depth: int) -> Column:
    """The first ``depth`` folders of a path below ``root``; empty for files directly in it."""
    path, root = F.trim(norm_path(p), F.lit("/")), F.trim(norm_path(root), F.lit("/"))
    below = F.when((root != "") & F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)
    parts = F.filter(F.split(below, "/"), lambda x: x != "")
    return F.when(F.size(parts) <= 1, "").otherwise(
        F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.greatest(F.size(parts) - 1, F.lit(1)))), "/")
    )


def bucket_label(bucket: Column | str, root: Column | str) -> Column:
    bucket, root = col(bucket), F.trim(norm_path(root), F.lit("/"))
    return (
        F.when(bucket == "", F.when(root != "", root).otherwise("(root)")).when(root == "", bucket).otherwise(F.concat_ws("/", root, bucket))
    )


def module_name(path: Column | str) -> Column:
    """Dotted module of a Python file; a package for its ``__init__``."""
    t = F.regexp_replace(F.regexp_replace(norm_path(path), "\\.py$", ""), "(^|/)__init__$", "")
    return F.replace(t, F.lit("/"), F.lit("."))


def github_repo(url: Column | str) -> Column:
    """``owner/repo`` of a GitHub remote, by https or ssh; null for others."""
    got = F.regexp_extract(F.trim(col(url)), "github\\.com[:/]([^/\\s]+/[^/\\s]+?)(?:\\.git)?/?$", 1)
    return F.when(got != "", got)


def in_vendor_dir(p: Column | str) -> Column:
    return col(p).rlike("(?i)(^|/)vendors?(/|$)")


def is_csharp_source(p: Column | str) -> Column:
    """A ``.cs`` file that is neither built nor generated."""
    p = norm_path(p)
    return p.rlike("(?i)\\.cs$") & ~p.rlike("(?i)(^|/)(bin|obj)/") & ~p.rlike("(?i)\\.(g|g\\.i|designer|generated)\\.cs$")


def resolve_import(module: Column | str, level: Column | str, target: Column | str, is_package: Column | str, compat: bool = False) -> Column:
    """Module that ``from <level dots><target> import ...`` in ``module`` means; null beyond the top.

    ``compat`` gives absolute imports (level 0) as relative to the module, and counts levels from the module
    itself, packages included.
    """
    parts, level, target = F.split(col(module), "\\."), col(level), col(target)
    drop = level if compat else level - F.when(col(is_package), 1).otherwise(0)
    base = F.when(level == 0, parts if compat else F.array().cast("array<string>")).otherwise(
        F.slice(parts, 1, F.greatest(F.size(parts) - drop, F.lit(0)))
    )
    joined = F.array_join(F.filter(F.concat(base, F.array(target)), lambda x: x.isNotNull() & (x != "")), ".")
    return F.when((drop > F.size(parts)) | (joined == ""), F.lit(None).cast("string")).otherwise(joined)


# cycles -------------------------------------------------------------------------------------------------------


def canonical_cycle(nodes: Column | str) -> Column:
    """The cycle from its least node on, direction kept."""
    a = col(nodes)
    i = F.array_position(a, F.array_min(a)).cast("int")
    return F.when(F.size(a) == 0, a).otherwise(F.concat(F.slice(a, i, F.size(a)), F.slice(a, F.lit(1), i - 1)))


def cycle_edges(nodes: Column | str) -> Column:
    """Edges (source, target) of a cycle, the closing one last."""
    a = col(nodes)
    return F.zip_with(a, F.concat(F.slice(a, F.lit(2), F.size(a)), F.slice(a, 1, 1)), lambda x, y: F.struct(x.alias("source"), y.alias("target")))


def cycle_chain(nodes: Column | str) -> Column:
    a = F.filter(F.transform(col(nodes), norm_path), lambda x: x != "")
    return F.when(F.size(a) == 0, "N/A").otherwise(F.array_join(F.concat(a, F.slice(a, 1, 1)), " -> "))


def scc_of_cycle(cycle_id: Column | str) -> Column:
    """``scc_<i>`` of ``scc_<i>_cycle_<j>``; null for other ids."""
    got = F.regexp_extract(col(cycle_id), "^(scc_\\d+)_cycle_\\d+$", 1)
    return F.when(got != "", got)


def cycle_scc_lenient(cycle_id: Column | str) -> Column:
    """What stands before ``_cycle_``, whatever it is."""
    return F.element_at(F.split(col(cycle_id), "_cycle_"), 1)


# texts and budgets --------------------------------------------------------------------------------------------

CHARS_PER_TOKEN = 3


def tokens_of_chars(n: Column | str) -> Column:
    return F.when(col(n) <= 0, F.lit(0).cast("long")).otherwise(F.ceil(col(n) / CHARS_PER_TOKEN))


def chars_of_tokens(n: Column | str) -> Column:
    return F.greatest(col(n), F.lit(0)).cast("long") * CHARS_PER_TOKEN


def block_budget(text: Column | str, wrapper_chars: Column | str, total_tokens: Column | str) -> Column:
    """Characters a wrapped block may have: what it needs, within the tokens there are, and 1 at least."""
    need = tokens_of_chars(F.length(F.coalesce(col(text), F.lit("")))) + tokens_of_chars(F.greatest(col(wrapper_chars), F.lit(0)))
    return F.greatest(F.lit(1), chars_of_tokens(F.least(need, F.greatest(col(total_tokens), F.lit(0)))))


def two_way_budget(need_a: Column | str, need_b: Column | str, total: Column | str) -> Column:
    """Tokens (a, b) for two needs: half each, what one leaves to the other, the larger rest first."""
    zero = F.lit(0).cast("long")
    a, b, t = (F.greatest(col(c).cast("long"), zero) for c in (need_a, need_b, total))
    first_a = F.least(F.floor(t / 2), a)
    first_b = F.least(t - first_a, b)
    left = t - first_a - first_b
    rest_a, rest_b = a - first_a, b - first_b
    more_a = F.when(rest_a >= rest_b, F.least(left, rest_a)).otherwise(F.least(left - F.least(left, rest_b), rest_a))
    more_b = F.when(rest_a >= rest_b, F.least(left - F.least(left, rest_a), rest_b)).otherwise(F.least(left, rest_b))
    return F.struct((first_a + more_a).cast("long").alias("a"), (first_b + more_b).cast("long").alias("b"))


#: The mark of a text that is cut. Fixed value.
TRUNCATED = "\n[Truncated]\n"


def format_block(path: Column | str, text: Column | str, max_chars: Column | str) -> Column:
    """A text between BEGIN and END lines within ``max_chars``; cut at the end with a mark, or empty if they don't fit."""
    path, body, most = col(path), F.coalesce(col(text), F.lit("")), col(max_chars)
    head, foot = F.concat(F.lit("--- BEGIN "), path, F.lit(" ---\n")), F.concat(F.lit("\n--- END "), path, F.lit(" ---\n"))
    room = most - F.length(head) - F.length(foot)
    cut = F.left(body, F.greatest(room - len(TRUNCATED), F.lit(0)))
    return (
        F.when((most <= 0) | (room < 0), "")
        .when(F.length(body) <= room, F.concat(head, body, foot))
        .otherwise(F.left(F.concat(head, cut, F.lit(TRUNCATED), foot), most))
    )


#: What stands for the middle of a text. Fixed value.
SNIP = "\n... [snip for console] ...\n"


def clip_middle(text: Column | str, max_chars: int, mark: str = SNIP) -> Column:
    t, half = F.coalesce(col(text), F.lit("")), max_chars // 2
    if max_chars <= 0:
        return F.lit("")
    tail = F.right(t, F.lit(half)) if half else t
    return F.when(F.length(t) <= max_chars, t).otherwise(F.concat(F.left(t, F.lit(half)), F.lit(mark), tail))


#: The line of the base prompt that explanations follow. Fixed value.
EXPLANATION_ANCHOR = "- It is not enough to remove some imports/references: for the chosen broken edge, all relevant references must be removed."


def explanation_length(prompt: Column | str, anchor: str = EXPLANATION_ANCHOR) -> Column:
    """Characters after the last anchor, white space before them not counted; null without an anchor or a prompt."""
    parts = F.split(col(prompt), "\\Q" + anchor + "\\E")
    return F.when(F.size(parts) > 1, F.length(F.regexp_replace(F.element_at(parts, -1), "^\\s+", "")))


def lines_of(text: Column | str) -> Column:
    """Lines without their ends; a line end at the end of the text begins no further line."""
    t = col(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, "(\\r\\n|\\n|\\r)\\z", ""), "\\r\\n|\\n|\\r"))


def nonblank_lines(text: Column | str) -> Column:
    return F.size(F.filter(lines_of(text), lambda x: F.trim(F.regexp_replace(x, "\\s+", " ")) != ""))


def parse_pct(value: Column | str) -> Column:
    return F.trim(F.replace(col(value), F.lit("%"), F.lit(""))).try_cast("double")


def json_value(doc: Column | str, dotted: str) -> Column:
    """The value at a dotted path of a JSON text, as text."""
    return F.get_json_object(col(doc), "$." + dotted)


def json_assert(doc: Column | str, dotted: str, rule: str, wanted=None) -> Column:
    """Whether a JSON text meets a rule: exists, equals, in, contains."""
    got = json_value(doc, dotted)
    tests: dict[str, Callable[[], Column]] = {
        "exists": lambda: got.isNotNull() == F.lit(bool(wanted)),
        "equals": lambda: F.coalesce(got == str(wanted), F.lit(False)),
        "in": lambda: F.coalesce(got.isin(*map(str, wanted)), F.lit(False)),
        "contains": lambda: F.coalesce(got.contains(str(wanted)), F.lit(False)),
    }
    if rule not in tests:
        raise ValueError(f"no such rule: {rule}")
    return tests[rule]()


#: What stands for a secret in a logged header. Fixed value.
REDACTED = "Bearer ***REDACTED***"


def redacted_headers(headers: Column | str) -> Column:
    """A map of headers, whose authorization is not told, however its name is written."""
    return F.transform_values(col(headers), lambda k, v: F.when(F.lower(k) == "authorization", REDACTED).otherwise(v))


def served_model(model: Column | str) -> Column:
    """A model's own name, without the prefix that says how it is reached."""
    return F.regexp_replace(col(model), "^openai/", "")


#: How far the markers of 2, 3 and 4 equal values stand from the middle of their row. Fixed values.
SPREADS = {2: (-0.12, 0.12), 3: (-0.16, 0.0, 0.16), 4: (-0.21, -0.07, 0.07, 0.21)}


def marker_offsets(values: Column | str, tolerance: float = 0.05) -> Column:
    """Offsets for an array of values in the order in which they are drawn; null for a null.

    Each value joins the first one before it that began a group and differs by ``tolerance`` at most, or begins one;
    the members of a group of two to four are spread, others stay in the middle.
    """
    own = col(values)
    start = F.struct(F.array().cast("array<double>").alias("first"), F.array().cast("array<int>").alias("of"))

    def place(a, x):
        near = F.array_position(F.transform(a["first"], lambda f: F.abs(f - x) <= tolerance), True).cast("int")
        joins = F.struct(a["first"].alias("first"), F.concat(a["of"], F.array(near)).alias("of"))
        begins = F.struct(F.concat(a["first"], F.array(x.cast("double"))).alias("first"), F.concat(a["of"], F.array(F.size(a["first"]) + 1)).alias("of"))
        none = F.struct(a["first"].alias("first"), F.concat(a["of"], F.array(F.lit(None).cast("int"))).alias("of"))
        return F.when(x.isNull(), none).when(near > 0, joins).otherwise(begins)

    spreads = F.create_map(*[x for many, spread in SPREADS.items() for x in (F.lit(many), F.array(*map(F.lit, spread)))])

    def spread_out(of):
        def offset(g, i):
            n, nth = F.size(F.filter(of, lambda h: h == g)), F.size(F.filter(F.slice(of, F.lit(1), i + 1), lambda h: h == g))
            return F.when(g.isNotNull(), F.coalesce(F.get(F.try_element_at(spreads, n), nth - 1), F.lit(0.0)))

        return F.transform(of, offset)

    # the groups are given to a lambda, so that they are found once and not for each value
    return F.aggregate(own, start, place, lambda a: spread_out(a["of"]))


def safe_filename(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "[^A-Za-z0-9._-]+", "_")


def display_language(language: Column | str) -> Column:
    low = F.lower(F.trim(col(language)))
    return F.when(low == "python", "Python").when(low.isin("csharp", "c#"), "C#").otherwise(F.trim(col(language)))


def fallback_label(mode_id: Column | str) -> Column:
    """A readable name for a mode without a label."""
    t = F.regexp_replace(F.regexp_replace(col(mode_id), "_noaux$", ""), "^explain_", "")
    return F.when(col(mode_id) == "no_explain", "No explanation").otherwise(F.replace(t, F.lit("_"), F.lit(" ")))


def display_configuration(mode_id: Column | str, label: Column | str, modes: list[str], baseline: str = "no_explain") -> Column:
    """``baseline`` and ``selected`` where exactly one mode stands against the baseline, else the mode's label."""
    if baseline in modes and len(set(modes)) == 2:
        return F.when(col(mode_id) == baseline, "baseline").otherwise("selected")
    return F.coalesce(col(label), fallback_label(mode_id))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """A text with ``{name}`` replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def utc_text(ts: Column | str) -> Column:
    """A time as ``2024-01-31T12:00:00Z``."""
    return F.date_format(F.to_utc_timestamp(col(ts), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def execution_id(ts: Column | str) -> Column:
    """A name for an execution: its time and a random part."""
    return F.concat(F.date_format(col(ts), "yyyyMMdd'T'HHmmss"), F.lit("-"), F.left(F.uuid(), F.lit(8)))


def log_positive(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that log axes can show: all the columns there and above zero."""
    out = df.dropna(subset=list(columns))
    for c in columns:
        out = out.where(F.col(c) > 0)
    return out
