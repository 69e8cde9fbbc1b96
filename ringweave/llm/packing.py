"""Packing documents into token sequences: Martello-Toth dominance reduction, then best fit decreasing.

Sizes are whole numbers up to the capacity, so an instance is the histogram of its sizes: at most
``capacity`` counts, whatever the number of documents. The plan is made on that histogram, in runs of
equally filled sequences, and each piece then finds its place from its rank among the pieces of its size.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package, stored
from .tokens import bounded, default_path, encoder

#: A plan of more rows is joined by size instead of being broadcast (six longs a row).
PLAN_ROWS = 300_000
#: Pieces of one size are ranked in buckets of about so many, whatever they hold: no size, text or doc_id is one task's.
BUCKET_ROWS = 512


@dataclass
class Plan:
    """Rows (size, first, n, bin0, per_bin, offset): pieces ``first`` to ``first + n - 1`` of a size go to
    sequences bin0, bin0 + 1, ..., ``per_bin`` to each, one after another from ``offset``."""

    capacity: int
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    bins: int = 0
    fixed_bins: int = 0
    used: dict[int, int] = field(default_factory=dict)

    def put(self, size: int, n: int, bin0: int, per_bin: int, offset: int) -> None:
        first = self.used.get(size, 0)
        self.rows.append((size, first, n, bin0, per_bin, offset))
        self.used[size] = first + n

    def fix(self, sizes: tuple[int, ...], times: int) -> None:
        """``times`` sequences that hold exactly these sizes."""
        at, k = 0, 0
        while k < len(sizes):
            same = sizes.count(sizes[k])
            self.put(sizes[k], times * same, self.bins, same, at)
            at += same * sizes[k]
            k += same
        self.bins += times
        self.fixed_bins += times


def _dominant(left: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with the item ``j`` that dominates every other feasible set with it; None if none is proven.

    A set dominates another if the other's items can be parted so that each part fits the place of one item
    of the set. Sets of at most three items are looked at, as Martello and Toth (1990, section 8.5) do.
    """
    room = capacity - j
    left[j] -= 1
    try:
        fits = np.flatnonzero(left[: room + 1])
        if not len(fits):
            return (j,)
        k = int(fits[-1])
        if k == room:
            return (j, k)
        small: list[int] = []
        for s in fits[:3]:
            small += [int(s)] * min(3, int(left[s]))
        if len(small) < 2 or small[0] + small[1] > room:
            return (j, k)  # one more item fits at most, so the largest stands for any
        if len(small) >= 3 and sum(small[:3]) <= room:
            return None
        best = 0  # the largest sum of two
        for a in fits.tolist():
            others = fits[(fits <= room - a) & ((fits != a) | (left[fits] > 1))]
            if len(others):
                best = max(best, a + int(others[-1]))
        if k >= best:
            return (j, k)
        with_k = fits[(fits <= room - k) & ((fits != k) | (left[fits] > 1))]
        m = int(with_k[-1]) if len(with_k) else 0
        above: list[int] = []  # two items both above m would be a pair that {k, m} doesn't dominate
        for s in fits[fits > m][:2]:
            above += [int(s)] * min(2, int(left[s]))
        if m and (len(above) < 2 or above[0] + above[1] > room):
            return (j, k, m)
        return None
    finally:
        left[j] += 1


def reduce(left: np.ndarray, plan: Plan) -> None:
    """Fix dominating sets for as long as there are any, taking what they use out of ``left``.

    Taking items away takes feasible sets away, so a set that dominates stays so for as long as its items
    last, and is fixed as many times at once.
    """
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(left)[::-1].tolist():
            while left[j]:
                own = _dominant(left, j, plan.capacity)
                if own is None:
                    break
                times = min(int(left[s]) // own.count(s) for s in set(own))
                plan.fix(tuple(sorted(own, reverse=True)), times)
                for s in own:
                    left[s] -= times
                changed = True


def best_fit(left: np.ndarray, plan: Plan) -> None:
    """Best fit decreasing, for runs of equal sequences at a time."""
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    rooms = 0  # bit r: there are sequences with room r

    def push(room: int, bin0: int, n: int) -> None:
        nonlocal rooms
        if n and room:
            runs.setdefault(room, []).append((bin0, n))
            rooms |= 1 << room

    for size in np.flatnonzero(left)[::-1].tolist():
        n = int(left[size])
        while n:
            above = rooms >> size
            if above:
                room = size + (above & -above).bit_length() - 1
                bin0, many = runs[room].pop()
                if not runs[room]:
                    rooms &= ~(1 << room)
            else:
                room, bin0 = plan.capacity, plan.bins
                many = -(-n // (room // size))
                plan.bins += many
            each = room // size  # the fullest that takes it stays the fullest, so it takes on until full
            full = min(many, n // each)
            if full:
                plan.put(size, full * each, bin0, each, plan.capacity - room)
                push(room - each * size, bin0, full)
                n -= full * each
            else:
                full = 1
                plan.put(size, n, bin0, n, plan.capacity - room)
                push(room - n * size, bin0, 1)
                n = 0
            push(room, bin0 + full, many - full)
        left[size] = 0


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Places for so many pieces of each size."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] = n
    plan = Plan(capacity)
    reduce(left, plan)
    best_fit(left, plan)
    return plan


def token_pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Whole texts as ids in pieces of at most ``capacity``: doc_id, piece, start, length, ids (binary, u32), row.

    Only longer documents are cut; their first piece is the shorter one. A null text counts as empty and so
    gives one piece, the end id alone. ``row`` is another number for each piece.
    """
    ship_package(docs.sparkSession)
    tokenizer = path or default_path()

    def encode(batches):
        from pyspark import TaskContext

        enc, row = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for some in bounded(texts):
                out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": [], "row": []}
                for key, got in zip(keys[some], enc.encode(texts[some])):
                    ids = np.append(np.frombuffer(got, dtype=enc.dtype), end_id).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for c, v in zip(out, (key, k, a, b - a, ids[a:b].tobytes(), row)):
                            out[c].append(v)
                        row += 1
                yield pa.RecordBatch.from_pydict(out, schema=_PIECES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids binary, row long")


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("row", pa.int64())])


def _longs(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """Rows of longs as a table. Arrow goes to the JVM as it is; of rows in a list Python workers make tuples first, which
    then stay beside those that hold the encoders."""
    columns = np.array(rows, dtype=np.int64).reshape(-1, len(names)).T
    return spark.createDataFrame(pa.table([pa.array(np.ascontiguousarray(c)) for c in columns], names=names))


def pack_documents(
    docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 0, carry: dict[str, Column] | None = None
) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, the columns of ``carry``, sequence_id, offset.

    ``carry`` names what goes along with each piece, as expressions over the columns of ``token_pieces``;
    without it the ids do. A sequence's pieces lie gapless from offset 0 and have at most ``capacity`` ids
    together. A document with a null text is the end id alone. Null doc_ids and repeated rows are pieces of
    their own; which of several equal pieces lies where is open. An empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, capacity, path, end_id), "pieces")
    # at most a row for each size
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(counts, capacity)
    places = _longs(spark, plan.rows, ["length", "first", "n", "bin0", "per_bin", "at"])
    sizes = _longs(spark, [(k, -(-n // BUCKET_ROWS)) for k, n in counts.items()], ["length", "_buckets"])
    carry = {"ids": F.col("ids")} if carry is None else carry
    own = pieces.select(
        "doc_id", "piece", "start", "length", *[c.alias(name) for name, c in carry.items()], F.col("row").alias("_tie")
    )
    own = own.join(F.broadcast(sizes), "length").withColumn("_bucket", F.pmod(F.xxhash64("_tie"), F.col("_buckets")))
    # a size that many pieces share is ranked in buckets: rank there, after those of the buckets before
    held = own.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_bucket").orderBy("_tie")
    ranked = (
        own.withColumn("_row", F.row_number().over(inside).cast("long") - 1)
        .join(base, ["length", "_bucket"])
        .withColumn("_rank", F.col("_row") + F.col("_base"))
    )
    if len(plan.rows) <= PLAN_ROWS:
        places = F.broadcast(places)
    k = F.col("_rank") - F.col("first")
    return ranked.join(
        places, (ranked["length"] == places["length"]) & (k >= 0) & (F.col("_rank") < F.col("first") + F.col("n"))
    ).select(
        "doc_id",
        "piece",
        "start",
        ranked["length"],
        *carry,
        (F.col("bin0") + F.floor(k / F.col("per_bin"))).alias("sequence_id"),
        (F.col("at") + k % F.col("per_bin") * ranked["length"]).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, doc_ids, ids. A group has ``capacity`` ids at most."""
    own = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(own.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"),
        F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"),
        F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    return pack_documents(docs, 2048, carry={"ids_crc32": F.crc32("ids")})
