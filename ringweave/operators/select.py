"""Greedy, fair selection of cycles: soft targets for size bins, caps for repositories and nodes.

Candidates stay in Spark; the driver holds a frontier of best ones and what has been chosen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..session import stored

#: How often a node may be in selected cycles of its repository.
NODE_USES = 2


def candidates(catalog: DataFrame, repos: DataFrame, bins: list[tuple[int, int, str]]) -> DataFrame:
    """Cycles (repo, cycle_id, nodes, pagerank_avg) in a bin, with their repository's language."""
    own = catalog.select("repo", "cycle_id", F.size("nodes").alias("size"), "nodes", "pagerank_avg").withColumn("bin", E.size_bin("size", bins))
    return own.where("bin is not null").join(repos.select("repo", "language"), "repo")


def bin_targets(available: dict[str, int], priority: list[str], total: int) -> dict[str, int]:
    """Equal shares of ``total`` for the bins that have candidates; what is left goes to the first ones."""
    own = [b for b in priority if available.get(b, 0) > 0]
    if not own:
        raise ValueError("no candidate is in a bin")
    return {b: total // len(own) + (i < total % len(own)) for i, b in enumerate(own)}


def select_cycles(available: dict[str, int], best: Callable[[str, list[dict]], dict | None], bins: list[tuple[int, int, str]], total: int) -> list[dict]:
    """At most ``total`` cycles in the order of choice (pick_no from 0). Bins are filled to their targets, larger cycles
    first, and then beyond them; ``best(bin, chosen)`` gives the next one of a bin."""
    targets = bin_targets(available, E.bin_priority(bins), total)
    chosen: list[dict] = []
    for upto in (targets, dict.fromkeys(targets, total)):
        for b in targets:
            while len(chosen) < total and sum(c["bin"] == b for c in chosen) < upto[b] and (c := best(b, chosen)):
                chosen.append({**c, "pick_no": len(chosen)})
    return chosen


class _Frontier:
    """The best candidate of each repository and bin, scored anew only when it may win.

    A repository that nothing was chosen of has its best cycle by size and name, so of these the first ``total`` of a
    bin are enough. One that was chosen from is scored against what it holds now; until then its score is bounded from
    below by its number of chosen cycles, and it waits while another's score lies below that. So all repositories of a wave
    (as many chosen of each) are scored together, and the jobs don't depend on the number of picks.
    """

    def __init__(self, pool: DataFrame, total: int, max_per_repo: int, node_uses: int):
        self.pool, self.most, self.uses = pool, max_per_repo, node_uses
        self.chosen: dict[str, list[dict]] = {}
        self.stale: set[str] = set()
        self.jobs = 1
        first = F.struct((-F.col("size")).alias("s"), F.col("cycle_id").alias("c"))
        tops = pool.groupBy("repo", "bin").agg(F.min_by(F.struct(*pool.columns), first).alias("row"), F.min(first).alias("at"))
        place = F.row_number().over(Window.partitionBy("bin").orderBy("at.s", "repo"))
        self.best: dict[tuple[str, str], tuple[tuple, dict]] = {}
        for r in tops.withColumn("place", place).where(F.col("place") <= total).select("row").toLocalIterator():
            row = r["row"].asDict(recursive=True)
            self.best[row["bin"], row["repo"]] = (0, 0, -row["size"], row["repo"], row["cycle_id"]), row

    def take(self, row: dict) -> None:
        self.chosen.setdefault(row["repo"], []).append(row)
        self.stale.add(row["repo"])

    def _score(self) -> None:
        """Scores of all repositories that have changed, in one job."""
        self.jobs += 1
        state = []
        for repo in sorted(self.stale):
            own = self.chosen[repo]
            uses = Counter(n for c in own for n in c["nodes"])
            state.append((repo, len(own), [c["cycle_id"] for c in own], sorted(uses), sorted(n for n, k in uses.items() if k >= self.uses)))
        now = self.pool.sparkSession.createDataFrame(state, "repo string, _chosen int, _taken array<string>, _used array<string>, _full array<string>")
        own = self.pool.join(F.broadcast(now), "repo")  # of repositories chosen from: ``total`` rows at most
        own = own.where((F.col("_chosen") < self.most) & ~F.array_contains("_taken", F.col("cycle_id")) & ~F.arrays_overlap("nodes", "_full"))
        again = F.size(F.filter("nodes", lambda n: F.array_contains("_used", n)))
        cost = F.struct(F.col("_chosen").alias("a"), again.alias("b"), (-F.col("size")).alias("c"), "repo", "cycle_id")
        got = own.groupBy("repo", "bin").agg(F.min_by(F.struct(*self.pool.columns), cost).alias("row"), F.min(cost).alias("cost")).collect()
        self.best = {k: v for k, v in self.best.items() if k[1] not in self.stale}
        for r in got:
            self.best[r["bin"], r["repo"]] = tuple(r["cost"]), r["row"].asDict(recursive=True)
        self.stale = set()

    def next(self, b: str) -> dict | None:
        while True:
            fresh = [v for (of, repo), v in self.best.items() if of == b and repo not in self.stale]
            best = min(fresh, key=lambda v: v[0], default=None)
            waiting = [len(self.chosen[r]) for r in self.stale if len(self.chosen[r]) < self.most]
            if not waiting or best and best[0][:2] < (min(waiting), 0):
                return best and best[1]
            self._score()


def greedy_selection(cands: DataFrame, bins: list[tuple[int, int, str]], total: int, max_per_repo: int, node_uses: int = NODE_USES) -> DataFrame:
    """The candidates (repo, cycle_id, size, nodes, bin, ...) that are selected, with pick_no.

    Each time the cycle is taken that has the fewest chosen of its repository, then the fewest nodes chosen before,
    then the most nodes, then the first repository and cycle_id; not one of a repository with ``max_per_repo``
    chosen, nor one with a node that is in ``node_uses`` chosen ones. The driver holds what has been chosen and a best
    candidate for ``total`` repositories of each bin and those chosen from.
    """
    import pyspark.sql.types as T

    spark = cands.sparkSession
    pool = stored(cands, "candidates")
    available = {r["bin"]: r["n"] for r in pool.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # a row for each bin
    frontier = _Frontier(pool, total, max_per_repo, node_uses)

    def best(b: str, chosen: list[dict]) -> dict | None:
        row = frontier.next(b)
        if row:
            frontier.take(row)
        return row

    chosen = select_cycles(available, best, bins, total)
    schema = T.StructType([*cands.schema.fields, T.StructField("pick_no", T.IntegerType())])
    out = spark.createDataFrame([tuple(c[f.name] for f in schema) for c in chosen], schema)
    out._jobs = frontier.jobs
    return out


def counters(cands: DataFrame) -> DataFrame:
    """Candidates by bin, language, repository, (repository, bin) and (repository, size) in one pass."""
    b, lang, repo, size = (F.col(c) for c in ("bin", "language", "repo", "size"))
    sets = [[b], [lang], [repo], [repo, b], [repo, size]]
    return cands.groupingSets(sets, b, lang, repo, size).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))


def overlap_summary(selection: DataFrame) -> DataFrame:
    """For each repository: most uses of a node, nodes used twice or more, distinct nodes."""
    uses = selection.select("repo", F.explode("nodes").alias("node")).groupBy("repo", "node").agg(F.count("*").alias("n"))
    return uses.groupBy("repo").agg(F.max("n").alias("max_use"), E.count_if(F.col("n") >= 2).alias("reused"), F.count("*").alias("distinct_nodes"))
