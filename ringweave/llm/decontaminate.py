"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item of n distinct shingles lies in a document if it holds at least t * n of them. Items are partitioned by size,
a partition for each power of two. An item's sketch is its k smallest shingle hashes (bottom-k MinHash), with one k
for the whole partition, from the largest size u in it: k = 2 * (u - ceil(t u)) + 1. The share of a sketch that a
document holds estimates the containment; a document that holds t n of the n shingles misses n - ceil(t n) at most,
so it holds k - (n - ceil(t n)) of the sketch at least, and pairs with fewer are dropped without loss. What is left
is verified on the shingles themselves. A symmetric sketch of both sides can't do that: an item of 30 shingles in a
document of 20 000 has a Jaccard similarity near 0.001.

Documents are only scanned: their shingle hashes (8 bytes a word, while a document is looked at) are probed against
the sketches, and nothing is shuffled.
"""

from __future__ import annotations

import functools
import itertools
import math
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_stored, ship_package, stored

WORDS, THRESHOLD = 5, 0.8
#: Benchmark items are searched for in blocks of about so many bytes of text; the driver and each task hold one block at
#: a time (an index of some two and a half times its text), and the documents are scanned once for each.
BLOCK_BYTES = 64 << 20
#: Bytes of items that are hashed at once while an index is made, and shingle sets of items that a task keeps.
PART_BYTES, KEPT_SHINGLES = 4 << 20, 1 << 19
#: Bytes of text that are hashed at once.
RUN = 1 << 20
#: Words are runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased.
_TABLE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_B = 0x9E3779B97F4A7C15
_C = np.array([pow(0xD6E8FEB86659FD93, j, 1 << 64) for j in range(64)], dtype=np.uint64)


def plain(text: str | None) -> bytes:
    """The text's words, parted by spaces."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def upto(b):
        out = np.full(n, b, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return upto(_B), upto(pow(_B, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``run`` begins, and its hash, which its bytes alone decide."""
    b = np.frombuffer(run, dtype=np.uint8)
    inside = np.concatenate([[False], b != 32, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _powers(max(RUN, 1 << (len(b)).bit_length()))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b.astype(np.uint64) * up[: len(b)])])
    return starts, _mix((upto[ends] - upto[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _runs(text: bytes):
    """A long text in runs that end between words."""
    at = 0
    while len(text) - at > RUN:
        to = text.rfind(b" ", at + 1, at + RUN)
        to = to if to > 0 else text.find(b" ", at + RUN)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle of each text, repeats included. Fewer words are one shingle."""
    which, hashes = [], []
    held, size, names = [], 0, []

    def flush():
        nonlocal held, size, names
        if held:
            at = np.cumsum([0, *[len(x) + 1 for x in held]])
            starts, h = word_hashes(b" ".join(held))
            which.append(np.array(names)[np.searchsorted(at, starts, side="right") - 1])
            hashes.append(h)
        held, size, names = [], 0, []

    for i, text in enumerate(texts):
        for run in _runs(text):
            if size + len(run) > RUN:
                flush()
            held.append(run)
            names.append(i)
            size += len(run) + 1
    flush()
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    which, h = np.concatenate(which), np.concatenate(hashes)
    n = len(h) - words + 1
    whole = which[: max(n, 0)] == which[words - 1 :] if n > 0 else np.zeros(0, bool)
    got = np.zeros(max(n, 0), np.uint64)
    for j in range(words if n > 0 else 0):
        got += h[j : n + j] * _C[j]
    own, out = [which[: max(n, 0)][whole]], [_mix(got[whole])]
    count = np.bincount(which, minlength=len(texts)) if len(which) else np.zeros(len(texts), np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    for i in np.flatnonzero((count > 0) & (count < words)).tolist():
        part = h[first[i] : first[i + 1]]
        own.append(np.array([i]))
        out.append(_mix(np.array([np.sum(part * _C[: len(part)]) + np.uint64(len(part))], dtype=np.uint64)))
    return np.concatenate(own), np.concatenate(out)


def each_shingle(text: bytes, words: int = WORDS):
    """The shingles themselves, in order, one by one."""
    w = text.split()
    if 0 < len(w) < words:
        yield b" ".join(w)
    for i in range(len(w) - words + 1):
        yield b" ".join(w[i : i + words])


def shingles(text: bytes, words: int = WORDS) -> list[bytes]:
    """All shingles, in order."""
    return list(each_shingle(text, words))


@dataclass
class Sizes:
    """The sketches of the items of one size partition."""

    hashes: np.ndarray  # of all its sketches, ascending
    items: np.ndarray  # whose


class Index:
    """A block of items: their words, sizes and sketches. ``need``: how many of an item's shingles a document must hold;
    ``hits``: of its sketch. An item's shingles are cut from its words when a document is a candidate for it."""

    def __init__(self, ids: list, texts: list, words: int, threshold: float):
        self.ids, self.words = np.array([i is not None for i in ids], bool), words
        self._ids = np.array([i or 0 for i in ids], np.int64)
        own = [plain(t) for t in texts]
        self.at = np.cumsum([0, *map(len, own)])
        self.text = b"".join(own)
        least = lambda k: math.ceil(round(threshold * k, 9))
        items, sizes, sketches = [np.zeros(0, np.int64)], [], [np.zeros(0, np.uint64)]
        for first, end in _some(own, PART_BYTES):
            which, h = shingle_hashes(own[first:end], words)
            order = np.lexsort((h, which))
            which, h = which[order], h[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (which[1:] != which[:-1]) | (h[1:] != h[:-1])
            which, h = which[fresh], h[fresh]
            n = np.bincount(which, minlength=end - first)
            # never more than the partition's k, which is that of its largest size
            most = np.array([2 * (u - least(u)) + 1 for u in ((1 << int(k).bit_length()) - 1 for k in n)], dtype=np.int64)
            kept = np.arange(len(h)) - np.searchsorted(which, which) < most[which]
            sizes.append(n)
            items.append(which[kept] + first)
            sketches.append(h[kept])
        n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        items, h = np.concatenate(items), np.concatenate(sketches)
        self.n, self.need = n, np.array([least(k) for k in n.tolist()], dtype=np.int64)
        place = np.arange(len(h)) - np.searchsorted(items, items)
        part = np.array([k.bit_length() for k in n.tolist()], dtype=np.int64)
        k = np.zeros(len(n), np.int64)
        self.parts: list[Sizes] = []
        bits = min(30, max(16, (64 * max(1, len(h))).bit_length()))
        self.shift, self.seen = 64 - bits, np.zeros(1 << bits - 3, np.uint8)  # a bit for each beginning of a hash
        for size in np.unique(part[n > 0]).tolist():
            inside = part == size
            u = int(n[inside].max())
            k[inside] = np.minimum(n[inside], 2 * (u - least(u)) + 1)
            rows = inside[items] & (place < k[items])
            x, y = h[rows], items[rows]
            order = np.argsort(x, kind="stable")
            self.parts.append(Sizes(x[order], y[order].astype(np.int32)))
            top = np.unique((x >> np.uint64(self.shift)).astype(np.int64))
            np.bitwise_or.at(self.seen, top >> 3, (1 << (top & 7)).astype(np.uint8))
        self.hits = k - (n - self.need)
        self._held: dict[int, frozenset] = {}
        self._room = KEPT_SHINGLES

    def name(self, item: int) -> int | None:
        return int(self._ids[item]) if self.ids[item] else None

    def shingle_set(self, item: int) -> frozenset:
        """An item's shingles, kept for the next documents while there is room."""
        got = self._held.get(item)
        if got is None:
            got = frozenset(each_shingle(self.text[self.at[item] : self.at[item + 1]], self.words))
            if self._room < len(got):
                self._held, self._room = {}, KEPT_SHINGLES
            self._held[item] = got
            self._room -= len(got)
        return got

    def nbytes(self) -> int:
        """Bytes of its arrays and texts."""
        arrays = (self.ids, self._ids, self.at, self.n, self.need, self.hits, self.seen, *(x for p in self.parts for x in (p.hashes, p.items)))
        return len(self.text) + sum(x.nbytes for x in arrays)

    def candidates(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(text, item) pairs in which the text is large enough and holds enough of the sketch."""
        which, h = shingle_hashes(texts, self.words)
        size = np.bincount(which, minlength=len(texts))
        top = (h >> np.uint64(self.shift)).astype(np.int64)
        hit = np.flatnonzero(self.seen[top >> 3] >> (top & 7).astype(np.uint8) & np.uint8(1))
        which, h = which[hit], h[hit]
        out: set[tuple[int, int]] = set()
        for part in self.parts:
            a, b = np.searchsorted(part.hashes, h), np.searchsorted(part.hashes, h, side="right")
            times = b - a
            text = np.repeat(which, times)
            at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(a, times)
            once = np.unique(text * len(part.hashes) + at)  # a shingle that a text repeats counts once
            text, item = once // len(part.hashes), part.items[once % len(part.hashes)].astype(np.int64)
            pair, held = np.unique(text * len(self.n) + item, return_counts=True)
            text, item = pair // len(self.n), pair % len(self.n)
            enough = (held >= self.hits[item]) & (size[text] >= self.need[item])
            out.update(zip(text[enough].tolist(), item[enough].tolist()))
        return sorted(out)

    def matches(self, texts: list[bytes]):
        """(text, item, shared, first word, end) of each item that a text contains."""
        for text, pairs in itertools.groupby(self.candidates(texts), lambda x: x[0]):
            sets = {item: self.shingle_set(item) for _, item in pairs}
            wanted = frozenset().union(*sets.values())
            own: dict[bytes, list[int]] = {}
            for i, s in enumerate(each_shingle(texts[text], self.words)):
                if s in wanted:
                    own.setdefault(s, []).append(i)
            for item, whole in sets.items():
                shared = [s for s in whole if s in own]
                if len(shared) >= self.need[item]:
                    words = min(self.words, len(shared[0].split()))
                    yield text, item, len(shared), min(own[s][0] for s in shared), max(own[s][-1] for s in shared) + words


def _blocks(benchmark: DataFrame, words: int, threshold: float):
    """Broadcast indexes of the benchmark, blocks of about ``BLOCK_BYTES`` of text one after another."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    n = -(-total // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    if n > 1:  # so that a block is read without the others
        items = stored(items.withColumn("block", block).repartitionByRange("block").sortWithinPartitions("block"), "benchmark")
        block = F.col("block")
    for k in range(n):
        rows = items.where(block == k).select("item_id", "text").collect()
        if rows:
            held = spark.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], words, threshold))
            del rows
            yield held


def _some(texts: list, size: int = 1 << 20):
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n > size:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


_MATCH = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("n_shingles", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())]
)


def find_contamination(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains.

    doc_id, item_id, shared (distinct shingles of the item in the whole document), n_shingles (of the item),
    first_word and end_word (the words of the document from the first shared shingle to after the last),
    containment. An item is contained if shared / n_shingles is at least ``threshold``. Texts with fewer words
    than a shingle are one shingle, the whole of them, so a shorter item is found where a document is just it.

    Null and empty texts, and texts without words, contain nothing and are contained nowhere. Null ids and
    repeated rows of either table are kept, each row by itself. Empty tables give no rows. Other columns are
    ignored, whatever their names.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for held in _blocks(benchmark, words, threshold):

        def run(batches, held=held):
            index = held.value
            for batch in batches:
                for a, b in _some(texts := batch.column(1).to_pylist()):
                    keys = batch.column(0).slice(a, b - a).to_pylist()
                    found = [
                        (keys[t], index.name(i), n, int(index.n[i]), first, end)
                        for t, i, n, first, end in index.matches([plain(t) for t in texts[a:b]])
                    ]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), _MATCH)], schema=_MATCH)

        got = rows.mapInArrow(run, "doc_id long, item_id long, shared long, n_shingles long, first_word long, end_word long")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "doc_id long, item_id long, shared long, n_shingles long, first_word long, end_word long")
    return out.withColumn("containment", F.col("shared") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item of the benchmark (see ``find_contamination``).

    What a block leaves is stored before the next block's turn, so that a task holds one block at a time.
    """
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")
    before = None
    for k, held in enumerate(_blocks(benchmark, words, threshold)):
        if k:
            docs, gone = stored(docs, "decontaminated"), before
            before = docs
            if gone is not None:
                drop_stored(gone)

        def run(batches, held=held):
            index = held.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, b in _some(texts := batch.column(at).to_pylist()):
                    for t, *_ in index.matches([plain(t) for t in texts[a:b]]):
                        keep[a + t] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    return find_contamination(
        spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    )


def _sql_shingles(table: str, key: str) -> str:
    return f"""
  SELECT rid, {key}, w, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END AS s
  FROM (SELECT row_number() OVER () AS rid, {key}, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+') AS w FROM {table})"""


OP1_SQL = f"""
WITH docs AS ({_sql_shingles("documents", "doc_id")}
), items AS ({_sql_shingles("benchmark", "item_id")}
), held AS (SELECT rid, doc_id, unnest(s) AS g, unnest(range(0, len(s))) AS i, len(w) AS n FROM docs
), wanted AS (SELECT DISTINCT rid, item_id, unnest(s) AS g, len(list_distinct(s)) AS n FROM items
), met AS (
  SELECT held.rid, doc_id, wanted.rid AS iid, item_id, wanted.n AS n, count(DISTINCT g) AS shared, min(i) AS a, max(i) AS b, min(held.n) AS words
  FROM held JOIN wanted USING (g) GROUP BY ALL
)
SELECT doc_id, item_id, shared::BIGINT AS shared, n::BIGINT AS n_shingles, a::BIGINT AS first_word,
  (b + least({WORDS}, words))::BIGINT AS end_word, shared / n AS containment
FROM met WHERE shared >= ceil(round({THRESHOLD}::DOUBLE * n, 9))
"""
