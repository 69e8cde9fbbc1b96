"""Histogram sort into shards of equal bytes.

Documents are ordered by a hash of their text, and by doc_id where that is equal, so equal texts lie together.
Splitters are found by counting: each round counts the bytes in 256 cells between candidate boundaries and
goes on inside those cells that hold a target, until the boundary is exact enough. Rounds read a table of keys
and sizes only and return a bounded number of sums. Then the documents are exchanged once.

Only built-in functions are used.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

KEY_BITS, STEP_BITS = 60, 8
#: A text hash goes whole to one side of a splitter if that shifts the splitter by at most a shard's bytes / 200.
WHOLE_GROUP = 200
#: Shards are exchanged in ranges of about so many bytes. Splitters are sought for so many ranges at most, which bounds
#: what the driver adds up; each of those is then cut into even parts of its span of hashes.
RANGE_BYTES, RANGES = 32 << 20, 8192
_LEAST = -(1 << 63)


def text_key(text: Column) -> Column:
    """60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long")


def text_bytes(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


@dataclass
class _Target:
    """A wanted number of bytes, and what is known of the boundary nearest to it."""

    number: int  # of the range that begins there
    want: int
    loose: int  # how far off it may lie
    exact: bool  # between shards
    key: int = 0
    low: int = _LEAST
    high: int = 0
    below: int = 0  # bytes below the cell that holds it
    rows: int = 0
    found: tuple[int, int, int, int] | None = None  # key, doc_id, bytes below, rows below

    def off(self, below: int) -> tuple[int, int]:
        return abs(below - self.want), below


def find_splitters(keys: DataFrame, shards: int, parts: int, total: int, rows: int) -> list[tuple[int, int, int, int]]:
    """(key, doc_id, bytes below, rows below) of the boundaries between ``shards * parts`` ranges.

    The boundary between two shards is that between keys (k, d) nearest to its target; a boundary between
    hashes k is taken instead where it is near enough, so that equal texts stay together. Boundaries inside a
    shard only share out work and may lie off by a quarter of a range.
    """
    n = shards * parts
    scale = n  # bytes are compared times n, so that targets are whole numbers
    targets = [
        _Target(i, i * total, total // 4 if i % parts else total * parts // WHOLE_GROUP, not i % parts) for i in range(1, n)
    ]
    todo, shift, last = targets, KEY_BITS, 0
    hot: list[_Target] = []
    while todo and shift > 0:
        shift, last = max(0, shift - STEP_BITS), shift
        cell = F.shiftright("k", shift)
        own = keys
        if last < KEY_BITS:
            own = keys.where(F.shiftright("k", last).isin(sorted({t.key for t in todo})))
        sums: dict[int, list] = {}
        for r in own.groupBy(cell.alias("c")).agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("k").alias("k0"), F.max("k").alias("k1")).collect():
            sums.setdefault(r["c"] >> (last - shift), []).append((r["c"], r["b"], r["n"], r["k0"], r["k1"]))
        for s in sums.values():
            s.sort()
        again = []
        for t in todo:
            below, count = t.below, t.rows
            for c, b, m, k0, k1 in sums.get(t.key if last < KEY_BITS else 0, []):
                if (below + b) * scale >= t.want:
                    break
                below, count = below + b, count + m
            t.below, t.rows, t.key = below, count, c
            start, end = (k0, _LEAST, below, count), (k1 + 1, _LEAST, below + b, count + m)
            near = min(start, end, key=lambda x: t.off(x[2] * scale))
            if k0 == k1:  # one hash: take it whole, or look into it
                if t.off(near[2] * scale)[0] <= t.loose or m == 1:
                    t.found = near
                else:
                    t.key = k0
                    hot.append(t)
            elif not t.exact and b * scale <= t.loose:
                t.found = near
            else:
                again.append(t)
        todo = again
    _split_hashes(keys, hot, scale)
    return [t.found for t in targets]


def _split_hashes(keys: DataFrame, todo: list[_Target], scale: int) -> None:
    """Find boundaries between the doc_ids of one hash, where its rows are too many for one side."""
    if not todo:
        return
    wide = "decimal(20,0)"
    own = keys.where(F.col("k").isin(sorted({t.key for t in todo})))
    ends = {r["k"]: (r["d0"], r["d1"]) for r in own.groupBy("k").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).collect()}
    for t in todo:
        t.low, t.high = ends[t.key]
    while todo:
        spans = sorted({(t.key, t.low, t.high) for t in todo})  # a row for each target at most
        width = {s: max(1, -(-(s[2] - s[1] + 1) // (1 << STEP_BITS))) for s in spans}
        near = keys.sparkSession.createDataFrame(
            [(*s, str(width[s])) for s in spans], "k long, low long, high long, width string"
        ).withColumn("width", F.col("width").cast(wide))
        met = keys.join(F.broadcast(near), "k").where("d between low and high")
        cell = F.floor((F.col("d").cast(wide) - F.col("low").cast(wide)) / F.col("width")).cast("long")
        sums: dict[tuple, list] = {}
        for r in met.groupBy("k", "low", "high", cell.alias("c")).agg(
            F.sum("size").alias("b"), F.count("*").alias("n"), F.min("d").alias("d0"), F.max("d").alias("d1")
        ).collect():
            sums.setdefault((r["k"], r["low"], r["high"]), []).append((r["c"], r["b"], r["n"], r["d0"], r["d1"]))
        again = []
        for t in todo:
            below, count = t.below, t.rows
            for _, b, m, d0, d1 in sorted(sums[(t.key, t.low, t.high)]):
                if (below + b) * scale >= t.want:
                    break
                below, count = below + b, count + m
            t.below, t.rows, t.low, t.high = below, count, d0, d1
            if d0 == d1 or (not t.exact and b * scale <= t.loose):
                t.found = min((t.key, d0, below, count), (t.key, d1 + 1, below + b, count + m), key=lambda x: t.off(x[2] * scale))
            else:
                again.append(t)
        todo = again


def _range_of(k: Column, d: Column, splitters: list[tuple[int, int, int, int]]) -> Column:
    """How many splitters are at or below (k, d), by binary search in a constant array."""
    if not splitters:
        return F.lit(0)
    keys = F.array(*[F.struct(F.lit(s[0]).cast("long").alias("k"), F.lit(s[1]).cast("long").alias("d")) for s in splitters])
    steps = [1 << i for i in range(len(splitters).bit_length())][::-1]
    own = F.struct(k.alias("k"), d.alias("d"))
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(keys, at + s - 1) <= own, at + s).otherwise(at)
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """All columns of ``docs`` in ``doc``, with size, law, shard and slot, in ``shards`` shards of equal bytes.

    A row's size is its text's UTF-8 bytes plus 1. The law is ``bytes``: the boundary between two shards is the
    nearest to its share of all bytes. Slots count from 0 in each shard, in the order of text hash and doc_id.
    Equal texts lie together; a group is cut only where a splitter would else be off by over 1 / 200 of a shard.

    A null text has no bytes and counts as empty. Null doc_ids come first in a group. Rows that are equal in text
    and doc_id go to one shard. An empty table gives no rows. Columns of ``docs`` stay apart in the struct
    ``doc``, so no name clashes.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    k, d = text_key(F.col("doc.text")), F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(_LEAST))
    keys = stored(rows.select(k.alias("k"), d.alias("d"), text_bytes(F.col("doc.text")).alias("size")), "shard-keys")
    whole = keys.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    total, count = whole["b"] or 0, whole["n"]
    parts = max(1, min(-(-total // (shards * RANGE_BYTES)), RANGES // shards))
    parts = max(parts, 8)
    cuts = max(1, -(-total // (shards * parts * RANGE_BYTES)))
    splitters = find_splitters(keys, shards, parts, total, count) if count else []
    starts = [0, *[s[3] for s in splitters]]
    base = F.get(F.array(*[F.lit(n - starts[i - i % parts]).cast("long") for i, n in enumerate(starts)]), F.col("range"))
    placed = rows.select("doc", k.alias("k"), d.alias("d")).withColumn("range", _range_of(F.col("k"), F.col("d"), splitters))
    deal = ["range"]
    if cuts > 1:
        deal = ["range", "cut"]
        cut = _cut_of([s[0] for s in splitters], cuts)
        held = keys.select("k", _range_of(F.col("k"), F.col("d"), splitters).alias("range")).groupBy("range", cut.alias("cut")).agg(F.count("*").alias("n"))
        before = Window.partitionBy("range").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
        held = held.select("range", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("more"))
        placed = placed.withColumn("cut", cut).join(held, deal)
        base = base + F.col("more")
    inside = Window.partitionBy(*deal).orderBy("k", "d")
    return placed.select(
        "doc",
        text_bytes(F.col("doc.text")).alias("size"),
        F.lit("bytes").alias("law"),
        F.floor(F.col("range") / F.lit(parts)).cast("int").alias("shard"),
        (F.row_number().over(inside) - 1 + base).cast("long").alias("slot"),
    )


def _cut_of(splitters: list[int], cuts: int) -> Column:
    """Which of ``cuts`` even parts of its range's span of hashes a row lies in. The hashes are spread evenly, so the
    parts are about even too; rows of one hash stay in one part."""
    ends = [0, *splitters, 1 << KEY_BITS]
    width = [max(1, -(-(b - a + 1) // cuts)) for a, b in zip(ends, ends[1:])]
    of = lambda x: F.get(F.array(*[F.lit(v).cast("long") for v in x]), F.col("range"))
    return F.call_function("div", F.col("k") - of(ends[:-1]), of(width)).cast("int")


def op5_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7."""
    sharded = shard_documents(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), 8)
    return sharded.select(
        "doc.doc_id",
        "size",
        F.crc32(F.encode(F.coalesce("doc.text", F.lit("")), "UTF-8")).alias("text_crc32"),
        "law",
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP5_SQL = f"""
WITH docs AS (
  SELECT doc_id, t, strlen(t) + 1 AS size, ('0x' || substr(md5(t), 1, 15))::BIGINT AS k, coalesce(doc_id, {_LEAST + 1} - 1) AS d
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), total AS (SELECT sum(size)::BIGINT AS total FROM docs
), keys AS (
  SELECT k, d, (sum(b) OVER (ORDER BY k, d) - b)::BIGINT AS below FROM (SELECT k, d, sum(size) AS b FROM docs GROUP BY k, d)
), hashes AS (SELECT min(below) AS below FROM keys GROUP BY k UNION ALL SELECT total FROM total
), bounds AS (SELECT below FROM keys UNION ALL SELECT total FROM total
), targets AS (SELECT i, total FROM total, range(1, 8) AS r(i)
), near AS (
  SELECT i, total,
    (SELECT below FROM hashes ORDER BY abs(8 * below - i * total), below LIMIT 1) AS whole,
    (SELECT below FROM bounds ORDER BY abs(8 * below - i * total), below LIMIT 1) AS part
  FROM targets
), splitters AS (
  SELECT CASE WHEN abs(8 * whole - i * total) * {WHOLE_GROUP} <= total THEN whole ELSE part END AS cut FROM near
), crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, x: xor(c >> 1, (c & 1) * 3988292384))) AS tbl
), placed AS (
  SELECT docs.*, (SELECT count(*) FROM splitters WHERE cut <= keys.below)::INTEGER AS shard FROM docs JOIN keys USING (k, d)
), texts AS (
  SELECT DISTINCT t, list_transform(regexp_extract_all(hex(t), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM docs
), sums AS (
  SELECT t, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM texts, crc
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY k, d) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed JOIN sums USING (t)
"""
