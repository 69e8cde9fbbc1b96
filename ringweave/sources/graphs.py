"""Graph documents: dependency graphs, component reports, cycle catalogs, module listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = "struct<source:string,target:string,relation:string>"
GRAPH = f"struct<schema_version:int,language:string,repo_root:string,entry:string,nodes:array<struct<id:string,kind:string,abs_path:string>>,edges:array<{EDGE}>>"
SCC_REPORT = (
    "struct<schema_version:int,generated_at_utc:string,graph:struct<node_count:bigint,edge_count:bigint>,"
    "node_features:map<string,struct<pagerank:double>>,sccs:array<struct<id:string,size:bigint,edge_count:bigint,density_directed:double,"
    f"edge_surplus_lb:bigint,total_loc:bigint,avg_loc_per_node:double,nodes:array<struct<id:string,kind:string>>,edges:array<{EDGE}>>>>"
)
CATALOG = (
    "struct<schema_version:int,sccs:array<struct<id:string,node_count:bigint,edge_count:bigint,cycles:array<struct<id:string,length:int,"
    f"nodes:array<string>,edges:array<{EDGE}>,metrics:struct<pagerank_avg:double,pagerank_min:double,pagerank_max:double>>>>>>"
)
PYDEPS = "map<string,struct<path:string,imports:array<string>>>"


def edges_of(docs: DataFrame, key: str = "graph_id", doc: str = "doc") -> DataFrame:
    """Distinct edges of graph documents, self-loops kept; members without both ends are dropped."""
    e = docs.select(F.col(key).alias("graph_id"), F.explode(f"{doc}.edges").alias("e"))
    return e.where("e.source is not null and e.target is not null").select("graph_id", F.col("e.source").alias("src"), F.col("e.target").alias("dst")).distinct()


def nodes_of(docs: DataFrame, key: str = "graph_id", doc: str = "doc") -> DataFrame:
    """Declared nodes and ends of edges."""
    declared = docs.select(F.col(key).alias("graph_id"), F.explode(f"{doc}.nodes.id").alias("node"))
    ends = edges_of(docs, key, doc).select("graph_id", F.explode(F.array("src", "dst")).alias("node"))
    return declared.union(ends).where("node is not null").distinct()


def tolerant_nodes(raw: DataFrame, key: str = "graph_id", text: str = "text") -> DataFrame:
    """Declared nodes of a graph text whose nodes are objects with an id or plain strings."""
    items = raw.select(F.col(key).alias("graph_id"), F.explode(F.from_json(F.get_json_object(text, "$.nodes"), "array<string>")).alias("x"))
    return items.select("graph_id", F.coalesce(F.get_json_object("x", "$.id"), F.when(~F.col("x").startswith("{"), F.col("x"))).alias("node")).where("node is not null").distinct()


def tolerant_cycle(record: str = "record") -> tuple:
    """Nodes and edges of a cycle record with other names: edges or cycle_edges; nodes, cycle_nodes, path or files."""
    pick = lambda *names: F.coalesce(*[F.get_json_object(record, f"$.{n}") for n in names])
    return F.from_json(pick("nodes", "cycle_nodes", "path", "files"), "array<string>"), F.from_json(pick("edges", "cycle_edges"), f"array<{EDGE}>")


def sccs_of(docs: DataFrame, key: str = "graph_id", doc: str = "doc") -> DataFrame:
    """graph_id, scc_id, size, edge_count, self_loop, nodes of component reports."""
    s = docs.select(F.col(key).alias("graph_id"), F.explode(f"{doc}.sccs").alias("s"))
    nodes = F.filter("s.nodes.id", lambda x: x.isNotNull())
    loop = F.exists(F.coalesce("s.edges", F.array().cast(f"array<{EDGE}>")), lambda e: e["source"] == e["target"])
    return s.select("graph_id", F.col("s.id").alias("scc_id"), F.coalesce("s.size", F.size("s.nodes").cast("bigint")).alias("size"), F.coalesce("s.edge_count", F.size("s.edges").cast("bigint")).alias("edge_count"), loop.alias("self_loop"), nodes.alias("nodes"))


def ranks_of(docs: DataFrame, key: str = "graph_id", doc: str = "doc") -> DataFrame:
    f = docs.select(F.col(key).alias("graph_id"), F.explode(f"{doc}.node_features").alias("node", "f"))
    return f.select("graph_id", "node", F.col("f.pagerank").alias("rank"))


def cycles_of(docs: DataFrame, key: str = "graph_id", doc: str = "doc") -> DataFrame:
    """graph_id, scc_id, cycle_id, length, nodes, edges, pagerank_avg of cycle catalogs."""
    s = docs.select(F.col(key).alias("graph_id"), F.explode(f"{doc}.sccs").alias("s")).select("graph_id", F.col("s.id").alias("scc_id"), F.explode("s.cycles").alias("c"))
    return s.select("graph_id", "scc_id", F.col("c.id").alias("cycle_id"), F.col("c.length").alias("length"), F.col("c.nodes").alias("nodes"), F.col("c.edges").alias("edges"), F.col("c.metrics.pagerank_avg").alias("pagerank_avg"))


def modules_of(raw: DataFrame, key: str = "graph_id", text: str = "text") -> DataFrame:
    """graph_id, module, path, imports of module listings; a listing with one top-level ``imports`` is an error."""
    odd = F.get_json_object(text, "$.imports").isNotNull()
    own = raw.select(F.col(key).alias("graph_id"), F.when(odd, F.raise_error(F.lit("a module listing has modules at its top"))).otherwise(F.from_json(text, PYDEPS)).alias("m"))
    return own.select("graph_id", F.explode("m").alias("module", "v")).select("graph_id", "module", F.col("v.path").alias("path"), F.coalesce("v.imports", F.array().cast("array<string>")).alias("imports"))
