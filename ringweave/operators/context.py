"""Summaries of a cycle's surroundings and prompts within token budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


def round_robin(rows: DataFrame, keys: list[str], group: str, item: list[str], k: int) -> DataFrame:
    """Of each key k rows, dealt in rounds over its groups (larger first, then by name); ``item`` orders a group.

    Returns the rows with group_rank, depth (from 0) and omitted (rows of the key left out); in the order of
    (group_rank, depth) a group's rows lie together.
    """
    size = rows.groupBy(*keys, group).agg(F.count("*").alias("_size"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_size"), group))
    ranked = size.withColumn("group_rank", rank)
    depth = F.row_number().over(Window.partitionBy(*keys, group).orderBy(*item)) - 1
    dealt = rows.withColumn("depth", depth).join(ranked, [*keys, group])
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("depth", "group_rank"))
    total = F.count("*").over(Window.partitionBy(*keys))
    return dealt.withColumns({"_turn": turn, "_total": total}).where(F.col("_turn") <= k).withColumn("omitted", F.greatest(F.col("_total") - k, F.lit(0))).drop("_turn", "_total", "_size")


def folder_counts(paths: DataFrame, keys: list[str], path: str, root: str, depth: int, most: int) -> DataFrame:
    """Paths of each key by folder, the ``most`` largest: keys, folder, n, place, omitted_folders."""
    own = paths.select(*keys, path, root).distinct().withColumn("folder", E.bucket_label(E.folder_bucket(path, root, depth), root))
    n = own.groupBy(*keys, "folder").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    return n.withColumns(
        {"place": F.row_number().over(w.orderBy(F.desc("n"), "folder")), "omitted_folders": F.greatest(F.count("*").over(w) - most, F.lit(0))}
    ).where(F.col("place") <= most)


def counter_top(edges: DataFrame, keys: list[str], item: str, order: list[str], k: int) -> DataFrame:
    """The k most frequent items of each key; ties by first appearance in ``order``."""
    w = Window.partitionBy(*keys)
    placed = edges.withColumn("_pos", F.row_number().over(w.orderBy(*order)))
    n = placed.groupBy(*keys, item).agg(F.count("*").alias("n"), F.min("_pos").alias("_pos"))
    return n.withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "_pos"))).where(F.col("place") <= k).drop("_pos")


def _joined(rows: DataFrame, keys: list[str], order: list[str], line: Column, name: str, more: str | None = None) -> DataFrame:
    """Lines of each key in order, with a last line for what is left out."""
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_l")))).alias("_a"), *([F.max(more).alias("_m")] if more else []))
    text = F.array_join(F.transform("_a", lambda x: x["_l"]), "\n")
    if more:
        text = F.when(F.col("_m") > 0, F.concat(text, F.lit("\n- ... +"), F.col("_m").cast("string"), F.lit(" more"))).otherwise(text)
    return got.select(*keys, text.alias(name))


def scc_summary(cycles: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """A text about each cycle (graph_id, cycle_id, nodes) in the edges of its component (graph_id, cycle_id, src, dst)."""
    from . import graph as G

    key = ["graph_id", "cycle_id"]
    member = cycles.select(*key, F.explode("nodes").alias("node"))
    own = edges.select(*key, "src", "dst").distinct()
    a = member.select(*key, F.col("node").alias("src"), F.lit(True).alias("_s"))
    b = member.select(*key, F.col("node").alias("dst"), F.lit(True).alias("_d"))
    marked = own.join(a, [*key, "src"], "left").join(b, [*key, "dst"], "left")
    inside, out, inn = marked.where("_s and _d"), marked.where("_s and _d is null"), marked.where("_s is null and _d")
    ring = cycles.select(*key, F.explode(E.cycle_edges("nodes")).alias("e")).select(*key, F.col("e.source").alias("src"), F.col("e.target").alias("dst"))
    w = Window.partitionBy(*key)
    extra = inside.select(*key, "src", "dst").join(ring, [*key, "src", "dst"], "left_anti")
    extra = extra.withColumns({"p": F.row_number().over(w.orderBy("src", "dst")), "m": F.count("*").over(w) - k}).where(F.col("p") <= k)
    arrow = F.concat(F.lit("- "), F.col("src"), F.lit(" -> "), F.col("dst"))
    deg = G.degrees(own.select(F.struct(*key).alias("graph_id"), "src", "dst")).select("graph_id.graph_id", "graph_id.cycle_id", "node", "indeg", "outdeg", "total")
    hub = deg.withColumn("p", F.row_number().over(w.orderBy(F.desc("total"), "node"))).where(F.col("p") <= k)
    hub_line = F.format_string("- %s (in=%d, out=%d, total=%d)", "node", "indeg", "outdeg", "total")
    count_line = lambda c: F.format_string("- %s (%d)", c, "n")
    parts = [
        own.groupBy(*key).agg(F.format_string("SCC summary: %d nodes, %d edges", F.size(F.array_distinct(F.concat(F.collect_set("src"), F.collect_set("dst")))), F.count("*")).alias("t_scc")),
        cycles.select(*key, F.format_string("Cycle summary: %d nodes, %d edges (as given)", F.size(F.array_distinct("nodes")), F.size(F.array_distinct(E.cycle_edges("nodes")))).alias("t_cycle")),
        _joined(extra, key, ["p"], arrow, "t_chords", "m"),
        _joined(hub, key, ["p"], hub_line, "t_hubs"),
        _joined(counter_top(out, key, "dst", ["src", "dst"], k), key, ["place"], count_line("dst"), "t_out"),
        _joined(round_robin(out.select(*key, "src", "dst"), key, "dst", ["src", "dst"], k), key, ["group_rank", "depth"], arrow, "t_outs", "omitted"),
        _joined(counter_top(inn, key, "src", ["src", "dst"], k), key, ["place"], count_line("src"), "t_in"),
        _joined(round_robin(inn.select(*key, "src", "dst"), key, "src", ["src", "dst"], k), key, ["group_rank", "depth"], arrow, "t_ins", "omitted"),
    ]
    got = cycles.select(*key)
    for p in parts:
        got = got.join(p, key, "left")
    titles = [
        ("Extra edges among cycle nodes (chords / alternate routes):", "t_chords", "- (none visible)"),
        ("Hub candidates (by in+out degree within SCC):", "t_hubs", "- N/A"),
        ("Cycle -> non-cycle connections (top targets):", "t_out", "- (none)"),
        ("Cycle -> non-cycle edge samples:", "t_outs", "- (none)"),
        ("Non-cycle -> cycle connections (top sources):", "t_in", "- (none)"),
        ("Non-cycle -> cycle edge samples:", "t_ins", "- (none)"),
    ]
    head = F.concat_ws("\n", F.coalesce("t_scc", F.lit("SCC summary: 0 nodes, 0 edges")), "t_cycle")
    body = [F.concat_ws("\n", F.lit(title), F.coalesce(c, F.lit(none))) for title, c, none in titles]
    return got.select(*key, F.concat_ws("\n\n", head, *body).alias("summary"))


def external_connections(cycles: DataFrame, edges: DataFrame, depth: int, most_folders: int, samples: int) -> DataFrame:
    """For each node of a cycle (graph_id, cycle_id, nodes, src_root) and direction: outside neighbours, their folders
    and samples spread over folders."""
    key = ["graph_id", "cycle_id", "node", "direction"]
    member = cycles.select("graph_id", "cycle_id", "src_root", F.explode("nodes").alias("node"))
    e = edges.select("graph_id", "src", "dst").distinct()
    out = e.join(member.withColumnRenamed("node", "src"), ["graph_id", "src"]).select("graph_id", "cycle_id", "src_root", F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("path"))
    inn = e.join(member.withColumnRenamed("node", "dst"), ["graph_id", "dst"]).select("graph_id", "cycle_id", "src_root", F.col("dst").alias("node"), F.lit("in").alias("direction"), F.col("src").alias("path"))
    outside = out.unionByName(inn).join(member.select("graph_id", "cycle_id", F.col("node").alias("path")), ["graph_id", "cycle_id", "path"], "left_anti").distinct()
    labelled = outside.withColumn("folder", E.bucket_label(E.folder_bucket("path", "src_root", depth), "src_root"))
    total = labelled.groupBy(*key).agg(F.count("*").alias("total"))
    folders = folder_counts(outside, key, "path", "src_root", depth, most_folders).groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.format_string("%s (%d)", "folder", "n").alias("t")))), lambda x: x["t"]), ", ").alias("folders"),
        F.max("omitted_folders").alias("omitted_folders"),
    )
    some = round_robin(labelled, key, "folder", ["path"], samples).groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("group_rank", "depth", "path"))), lambda x: x["path"]).alias("samples"), F.max("omitted").alias("omitted")
    )
    return total.join(folders, key, "left").join(some, key, "left")


def water_fill(needs: list[int], total: int) -> list[int]:
    """Tokens for each of several needs: equal shares, what is left spread over those that want more, in order."""
    if not needs or total <= 0:
        return [0] * len(needs)
    want = [max(0, int(n)) for n in needs]
    given = [min(total // len(want), w) for w in want]
    left = total - sum(given)
    while left > 0 and (open_ := [i for i, w in enumerate(want) if given[i] < w]):
        share = max(1, left // len(open_))
        for i in open_:
            more = min(want[i] - given[i], share, left)
            given[i] += more
            left -= more
            if left <= 0:
                break
    return given


def token_budgets(df: DataFrame, needs: str, total: str, out: str = "allocated") -> DataFrame:
    """``df`` with the shares of ``water_fill`` for a column of needs (array) and one of totals."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<long>")
    def fill(n: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([water_fill([] if x is None else list(x), 0 if pd.isna(k) else int(k)) for x, k in zip(n, t)])

    return df.withColumn(out, fill(F.col(needs), F.col(total)))


def edge_prompt(df: DataFrame, system: Column, budget: str) -> DataFrame:
    """Prompts of edges (src, dst, src_text, dst_text): both files within the token budget, unused shares passed on."""
    wrap = lambda p: F.length(p) * 2 + len("--- BEGIN  ---\n") + len("\n--- END  ---\n")
    need = lambda t, p: E.tokens_of_chars(F.length(F.coalesce(t, F.lit("")))) + E.tokens_of_chars(wrap(p))
    share = df.withColumn("_b", E.two_way_budget(need("src_text", "src"), need("dst_text", "dst"), budget))
    block = lambda p, t, s: E.format_block(p, t, E.chars_of_tokens(F.col("_b")[s]))
    text = F.concat_ws("\n\n", system, F.concat(F.lit("Edge: "), F.col("src"), F.lit(" -> "), F.col("dst")), block("src", "src_text", "a"), block("dst", "dst_text", "b"))
    return share.withColumn("prompt", text).drop("_b")


def _blocks(df: DataFrame, keys: list[str], order: str, title: str, text: str, budget: str) -> DataFrame:
    """Wrapped texts of each key, in order, that share a token budget: keys and ``blocks``."""
    own = F.array_sort(F.collect_list(F.struct(order, F.col(title).alias("t"), F.coalesce(text, F.lit("")).alias("x"))))
    got = df.groupBy(*keys).agg(own.alias("_a"), F.max(budget).alias("_b"))
    wrap = lambda t: F.length(t) * 2 + len("--- BEGIN  ---\n") + len("\n--- END  ---\n")
    need = F.transform("_a", lambda a: E.tokens_of_chars(F.length(a["x"])) + E.tokens_of_chars(wrap(a["t"])))
    shared = token_budgets(got.withColumn("_n", need), "_n", "_b", "_s")
    block = F.zip_with("_a", "_s", lambda a, n: E.format_block(a["t"], a["x"], E.chars_of_tokens(n)))
    return shared.select(*keys, F.array_join(F.filter(block, lambda b: b != ""), "\n").alias("blocks"))


def synthesizer_prompt(reports: DataFrame, keys: list[str], system: Column, extra: Column, budget: str) -> DataFrame:
    """Prompts that put together the reports (ord, edge, report) on a cycle's edges, with further context."""
    return _blocks(reports, keys, "ord", "edge", "report", budget).withColumn("prompt", F.concat_ws("\n\n", system, extra, F.col("blocks"))).drop("blocks")


def project_prompt(readmes: DataFrame, keys: list[str], system: Column, budget: str) -> DataFrame:
    """Prompts from a project's README files (place, path, text), nearest first."""
    return _blocks(readmes, keys, "place", "path", "text", budget).withColumn("prompt", F.concat_ws("\n\n", system, F.col("blocks"))).drop("blocks")


def minimal_prompt(nodes: Column | str, language: Column | str) -> Column:
    """The base refactoring prompt of a cycle, up to and with the anchor that explanations follow."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Break this dependency cycle in the "), E.display_language(language), F.lit(" code:")),
        E.cycle_chain(nodes),
        F.lit("- Remove one dependency of the cycle and keep the behavior."),
        F.lit(E.EXPLANATION_ANCHOR),
    )


#: Prompt variants of the edge (E) and synthesizer (S) agents. Fixed ids.
VARIANTS = [(f"{a}{i}", kind, style) for a, kind in (("E", "edge"), ("S", "synthesizer")) for i, style in enumerate(("descriptive", "advisory", "directive"))]


def require_variants(units: DataFrame, columns: list[str]) -> DataFrame:
    """variant, agent and style of the prompt variants that each unit names in ``columns``; an unknown one is an error."""
    known = F.create_map(*[F.lit(x) for v, agent, style in VARIANTS for x in (v, f"{agent} {style}")])
    named = units.select("*", F.explode(F.array(*columns)).alias("variant")).where("variant is not null")
    found = F.try_element_at(known, F.col("variant"))
    checked = F.when(found.isNull(), F.raise_error(F.concat(F.lit("no such prompt variant: "), "variant"))).otherwise(F.split(found, " "))
    return named.withColumn("_v", checked).withColumns({"agent": F.col("_v")[0], "style": F.col("_v")[1]}).drop("_v", *columns)
