"""Exact top-k by inner product on a bit-sliced index.

Vectors are quantised to whole numbers and dealt into blocks of some ``BLOCK_ROWS`` rows. In a block each component is
an attribute whose bits lie in slices: bitmaps with one bit for each row. A query's scores are a weighted sum of
attributes, and are added for all rows of a block at once by bitmap arithmetic: each non-zero signed digit of a weight
puts an attribute's slices into columns of equal weight, and full adders (five bitmap operations) reduce the columns
until one slice of the score is left in each. The k highest are then read off from the most significant slice of the
score downward; rows that tie at the boundary are resolved exactly, by smaller id.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package, stored

SCALE = 256
#: Rows of a block: a bitmap has 8 kB, a block of 64 components of nine bits some 5 MB.
BLOCK_ROWS = 65_536
#: Queries that travel together.
CHUNK = 256
#: Components beyond this magnitude are refused: their products might pass a long.
LARGEST = 1 << 24


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """uid, vec_id, values (whole numbers): floor(scale * x), x as double. Stored, so that a row keeps its uid.

    Vectors that are null, or hold null or non-finite components, take no part. A component whose quantised value is
    2^24 or more in magnitude raises an error.
    """
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    small = ~F.exists("values", lambda v: F.abs(v) >= LARGEST)
    rows = vectors.select("vec_id", "embedding").where(sound).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), x.alias("values"))
    values = F.when(small, F.col("values").cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large for an exact score")).cast("array<int>"))
    return stored(rows.select("uid", "vec_id", values.alias("values")), "quantised-vectors")


# A block in bytes: vec_ids, whether they are null, uids in order of vec_id; for each component its least value and slices.


def _words(bits: np.ndarray) -> np.ndarray:
    """Booleans as a bitmap of 64-bit words, the first row in the lowest bit."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    short = -packed.shape[-1] % 8
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, short)]).view("<u8")


def slice_block(table: pa.Table) -> dict:
    """Index of one block's (uid, vec_id, values). Vectors that are shorter than the longest count as zero in what they lack."""
    ids, values = table.column("vec_id").combine_chunks(), table.column("values").combine_chunks()
    unnamed, uids = ids.is_null().to_numpy(zero_copy_only=False), table.column("uid").to_numpy()
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((uids, ids, unnamed))
    lengths = pc.list_value_length(values).to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    x = np.zeros((len(ids), width), np.int64)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    x[np.repeat(np.arange(len(ids)), lengths), np.arange(len(starts)) - starts] = values.flatten().to_numpy(zero_copy_only=False)
    x = x[order]
    least = x.min(0)
    above = x - least
    n_slices = [int(m).bit_length() for m in above.max(0)]
    slices = [_words((above[:, d] >> b & 1).astype(bool)) for d in range(width) for b in range(n_slices[d])]
    return {
        "n": len(order),
        "ids": ids[order].astype("<i8").tobytes(),
        "unnamed": unnamed[order].astype("u1").tobytes(),
        "uids": uids[order].astype("<i8").tobytes(),
        "least": least.astype("<i8").tobytes(),
        "n_slices": np.array(n_slices, "u1").tobytes(),
        "slices": np.concatenate(slices).tobytes() if slices else b"",
    }


_BLOCK = pa.schema([("block", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("ids", "unnamed", "uids", "least", "n_slices", "slices"))])


def sliced_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index of all rows of ``quantised``: one row for each block, stored. Blocks are numbered from 0.

    Rows are dealt by a hash of their uid, so blocks are even whatever the ids and vectors, and hold ``block_rows`` rows
    give or take a few in a hundred.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    n_blocks = max(1, math.ceil(vectors.count() / block_rows))

    def build(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([{"block": table.column("block")[0].as_py(), **slice_block(table)}], _BLOCK)

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n_blocks)))
    kinds = "block long, n long, " + ", ".join(f"{c} binary" for c in _BLOCK.names[2:])
    return stored(dealt.groupBy("block").applyInArrow(build, kinds), "sliced-index")


class Block:
    """A block's bitmaps, as views of its bytes."""

    def __init__(self, n: int, ids: bytes, unnamed: bytes, uids: bytes, least: bytes, n_slices: bytes, slices: bytes):
        self.n = n
        self.ids, self.unnamed, self.uids = np.frombuffer(ids, "<i8"), np.frombuffer(unnamed, "u1"), np.frombuffer(uids, "<i8")
        self.least = np.frombuffer(least, "<i8").tolist()
        self.rows = _words(np.ones(n, bool))
        flat, at = np.frombuffer(slices, "<u8").reshape(-1, len(self.rows)), 0
        self.slices: list[list[np.ndarray]] = []
        for count in np.frombuffer(n_slices, "u1").tolist():
            self.slices.append([flat[k] for k in range(at, at + count)])
            at += count
        #: A negative digit adds the complement: (2^s - 1 - u) for an attribute u of s slices.
        self.flipped = [[~s for s in attribute] for attribute in self.slices]
        self.at = {int(u): k for k, u in enumerate(self.uids)} if n else {}


def signed_digits(x: int) -> list[tuple[int, int]]:
    """``x`` as the sum of digit * 2^place with digits 1 and -1, as few as can be."""
    out, place = [], 0
    while x:
        if x & 1:
            digit = 2 - (x & 3)
            out.append((digit, place))
            x -= digit
        x >>= 1
        place += 1
    return out


def add_slices(block: Block, weights: list[int]) -> tuple[list[np.ndarray | None], int]:
    """Slices of the weighted sum of a block's attributes, least significant first, and what to add to it.

    None is a slice without bits.
    """
    columns: list[list[np.ndarray]] = []
    base = 0
    for weight, least, plain, flipped in zip(weights, block.least, block.slices, block.flipped):
        base += weight * least
        for digit, place in signed_digits(weight):
            if digit < 0:
                base -= ((1 << len(plain)) - 1) << place
            while len(columns) < place + len(plain):
                columns.append([])
            for b, bitmap in enumerate(plain if digit > 0 else flipped):
                columns[place + b].append(bitmap)
    out: list[np.ndarray | None] = []
    k = 0
    while k < len(columns):
        column = columns[k]
        if len(column) > 1 and k + 1 == len(columns):
            columns.append([])
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            half = a ^ b
            carry = half & c
            half ^= c
            a = a & b
            carry |= a
            column.insert(0, half)
            columns[k + 1].append(carry)
        if len(column) == 2:
            a, b = column
            columns[k + 1].append(a & b)
            column[:] = [a ^ b]
        out.append(column[0] if column else None)
        k += 1
    return out, base


def top_rows(block: Block, score: list[np.ndarray | None], k: int, without: int | None) -> list[int]:
    """Rows with the k highest scores, those of smaller id first among ties; ``without``: a row that doesn't count."""
    tied = block.rows.copy()
    if without is not None:
        tied[without >> 6] &= ~np.uint64(1 << (without & 63))
    sure = np.zeros_like(tied)
    for s in reversed(score):
        if s is None:
            continue
        upper = tied & s
        n = int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(upper).sum())
        if n > k:
            tied = upper
        else:
            sure |= upper
            if n == k:
                tied = np.zeros_like(tied)
                break
            tied &= ~s
    rows = _set_rows(sure)
    # what still ties at the boundary has one score: rows lie in order of id
    return rows + _set_rows(tied, k - len(rows))


def _set_rows(bitmap: np.ndarray, most: int | None = None) -> list[int]:
    out: list[int] = []
    for w in np.flatnonzero(bitmap).tolist():
        if most is not None and len(out) >= most:
            break
        word = int(bitmap[w])
        while word:
            low = word & -word
            out.append(w * 64 + low.bit_length() - 1)
            word ^= low
    return out if most is None else out[: max(0, most)]


def _score(score: list[np.ndarray | None], base: int, row: int) -> int:
    return base + sum(1 << k for k, s in enumerate(score) if s is not None and int(s[row >> 6]) >> (row & 63) & 1)


_FOUND = pa.schema([("query_uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("uid", pa.int64()), ("score", pa.int64())])


def top_k(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of ``vectors`` with the highest inner product, for each query.

    Both are (uid, vec_id, values) as of ``quantised``, ``queries`` being rows of ``vectors``; a query's own row (that
    with its uid) doesn't count, other rows with its id do. Ties go to the smaller vec_id (then uid), and rows without a
    vec_id come last among them. Fewer than k other rows: all of them. Components that one of two vectors lacks
    count as zero. An empty table gives no row.

    Queries travel in chunks to the blocks, each block with all chunks in turn; a block's rows stay in its bitmaps, and
    only its k best go on for a query. A task holds one block and one chunk at a time.
    """
    spark = vectors.sparkSession
    index = sliced_index(vectors, block_rows)
    n_blocks, n_queries = (index.agg(F.max("block")).first()[0] or 0) + 1, queries.count()
    n_chunks = max(1, math.ceil(n_queries / CHUNK))
    # with fewer blocks than tasks could run, a block is held by several, each for its share of the chunks
    lanes = min(n_chunks, math.ceil(2 * spark.sparkContext.defaultParallelism / n_blocks))
    dealt = queries.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(n_chunks)))
    chunks = dealt.groupBy("chunk").agg(F.collect_list(F.struct("uid", "vec_id", "values")).alias("asked")).withColumn("lane", F.pmod("chunk", F.lit(lanes)))
    sent = chunks.select("lane", "asked", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")).alias("block"))
    held = index.select(*_BLOCK.names, F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)).cast("array<long>")).alias("lane"))

    def search(batches):
        now, block = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(j)[row] for j, c in enumerate(batch.schema.names)}
                if cell["block"].as_py() != now:
                    now = cell["block"].as_py()
                    block = Block(cell["n"].as_py(), *(cell[c].as_py() for c in _BLOCK.names[2:]))
                found = []
                for q in cell["asked"].as_py():
                    own = block.at.get(q["uid"])
                    score, base = add_slices(block, q["values"])
                    for r in top_rows(block, score, k, own):
                        found.append((q["uid"], q["vec_id"], None if block.unnamed[r] else int(block.ids[r]), int(block.uids[r]), _score(score, base, r)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), _FOUND)] if found else [pa.array([], t.type) for t in _FOUND], schema=_FOUND)

    met = sent.join(held, ["block", "lane"]).select(*_BLOCK.names, "asked")
    best = met.mapInArrow(search, "query_uid long, query_id long, vec_id long, uid long, score long")
    place = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    ranked = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest scores of every vector whose id is divisible by 50, among all other vectors."""
    vectors = quantised(spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")))
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


OP11_SQL = """
WITH given AS (
  SELECT row_number() OVER () AS uid, vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), rows AS (
  SELECT uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM given
), scored AS (
  SELECT q.uid AS query_uid, q.vec_id AS query_id, c.uid, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score
  FROM rows q JOIN rows c ON q.uid <> c.uid WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_uid ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
