"""SimHash near-duplicates: a segment-popcount embedding, a grid range-join under Manhattan distance, and
an exact check of the Hamming distance.

A 64-bit fingerprint is embedded as the bit counts of 32 segments of two bits. Each differing bit changes one
count by one at most, so the Manhattan distance of two embeddings is at most the Hamming distance of the
fingerprints: near fingerprints are near in the grid. If that distance is 3 or less, one half of the
embedding (16 counts) is within distance 1. So each fingerprint stands in the grid cell of each of its halves
and is asked for in the cells one step up; pairs that are one step apart meet in the upper one's cell, and no
near pair is missed. Whoever meets in a cell is compared exactly.

Copies collapse into one fingerprint before the join, and a cell returns links that span its near groups, a
forest, not all pairs, so a large group of near copies gives no more links than it has fingerprints. Such a forest
is as good as all pairs wherever a link in it is final (``near_duplicates``). Where links are candidates only
(``similar_documents``) the forest says which texts may belong together, and all texts of such a candidate group
are then held against each other exactly.
"""

from __future__ import annotations

import hashlib
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_stored, ship_package, stored
from .decontaminate import _mix, _runs, plain, shingle_hashes, word_hashes

#: Differing bits up to which fingerprints link; the grid is made for this number.
MAX_BITS = 3
#: Fingerprints with more than one row in so many are joined by broadcast; there are fewer than that.
HOT_SHARE = 1000
_PAIRS = np.uint64(0x5555555555555555)


def fingerprints(texts: list[str | None], words: int = 3) -> np.ndarray:
    """64-bit SimHash of each whole text, as unsigned integers.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are ``words`` words,
    repeats included, joined by a space; fewer words are one shingle. A shingle's hash is XXH64 of its UTF-8
    with seed 42; a bit is 1 if it is set in over half of the hashes. No words, or null: zero.
    """
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        w = (text or "").encode().lower().split()
        if not w:
            continue
        n, counts = 0, np.zeros((8, 256), dtype=np.int64)
        for at in range(0, max(1, len(w) - words + 1), 1 << 18):  # a long text's hashes are not held at once
            part = w[at : at + (1 << 18) + words - 1]
            grams = map(b" ".join, zip(*[part[k:] for k in range(words)])) if len(w) >= words else [b" ".join(w)]
            h = np.fromiter((xxh64_intdigest(g, 42) for g in grams), dtype="<u8").view(np.uint8).reshape(-1, 8)
            n += len(h)
            for k in range(8):
                counts[k] += np.bincount(h[:, k], minlength=256)
        ones = counts @ _BITS  # (byte, bit)
        set_bits = (2 * ones > n).astype(np.uint8).reshape(-1)
        out[i] = np.packbits(set_bits, bitorder="little").view("<u8")[0]
    return out


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def embed(f: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each in the two bits of its segment."""
    return f - ((f >> np.uint64(1)) & _PAIRS)


def cells(f: np.ndarray, bits: int = 64, tag: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, asks): each fingerprint's own cell for each half, and those one step up, which it asks.

    ``bits`` is a fingerprint's width, a multiple of 4; ``tag`` tells the cells of several fingerprints apart.
    """
    e = embed(f)
    rows, own, asks = [], [], []
    at, wide = np.arange(len(f)), bits // 2
    for half in (0, 1):
        c = (e >> np.uint64(wide * half)) & np.uint64((1 << wide) - 1)
        name = np.uint64((2 * tag + half) << 32)
        rows.append(at)
        own.append(c | name)
        asks.append(np.zeros(len(f), dtype=bool))
        for lane in range(wide // 2):
            up = np.flatnonzero(((c >> np.uint64(2 * lane)) & np.uint64(3)) < 2)
            rows.append(up)
            own.append((c[up] + np.uint64(1 << 2 * lane)) | name)
            asks.append(np.ones(len(up), dtype=bool))
    return np.concatenate(rows), np.concatenate(own).astype(np.int64), np.concatenate(asks)


class _Sets:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _bits_apart(differences: list[np.ndarray]) -> np.ndarray:
    """Set bits over all words of each pair."""
    far = np.bitwise_count(differences[0])
    for more in differences[1:]:
        far = far + np.bitwise_count(more)  # 8 bits hold the counts of three words
    return far


def cell_links(f: np.ndarray, asks: np.ndarray, max_bits: int = MAX_BITS, done: bool = False) -> list[tuple[int, int]]:
    """Links that span the near groups among those who meet in a cell: (place, place), a forest. ``f``: values of one
    64-bit word, or of several, a row each.

    Compared are residents with each other (unless that is ``done``) and with those who ask; two who only ask meet
    elsewhere if they are near. Comparisons go block by block, so memory stays bounded.
    """
    home, out = np.flatnonzero(~asks), []
    sets, parts = _Sets(len(f)), f.reshape(len(f), -1).T
    for at in range(0, len(home), 256):
        mine = home[at : at + 256]
        for to in range(0, len(f), 1 << 13):
            far = _bits_apart([w[mine][:, None] ^ w[None, to : to + (1 << 13)] for w in parts])
            a, b = np.nonzero(far <= max_bits)
            a, b = mine[a], b + to
            keep = (a != b) & (asks[b] | ((a < b) & (not done)))
            for x, y in zip(a[keep].tolist(), b[keep].tolist()):
                if sets.join(x, y):
                    out.append((x, y))
    return out


def _stars(cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the links (a, b) in each cell those of each group's least name with its others: cells in which much the same
    ones meet give the same links."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    least: list[int] = []
    other: list[int] = []
    now, up = None, {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    def done() -> None:
        for x in up:
            if (r := root(x)) != x:
                least.append(r)
                other.append(x)

    for c, x, y in sorted(zip(cell.tolist(), low.tolist(), high.tolist())):
        if c != now:
            done()
            now, up = c, {}
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    done()
    return np.array(least, np.int64), np.array(other, np.int64)


_KEYED = pa.schema([("doc_id", pa.int64()), ("f", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint_documents(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and f, the fingerprint as a signed long, for each row."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for at in range(0, batch.num_rows, 256):
                got = fingerprints(batch.column(1).slice(at, 256).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([keys.slice(at, 256), pa.array(got.view(np.int64))], schema=_KEYED)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, f long")


#: Residents of a cell that one task looks at, and rows of a cell that a worker holds before those who only ask are
#: compared and let go. A cell with more residents is dealt to several tasks.
HELD = 1 << 16
#: Cells that are dealt out are named to all tasks up to so many; more are joined by key.
SENT_CELLS = 100_000


def near_links(reps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between the ``rep`` of rows that meet in a cell of the grid, spanning the near groups there.

    ``reps`` has f, a fingerprint, which gives the cells, and rep. Near are those whose values (the words v0, v1, ...)
    differ in ``max_bits`` bits or less; without such columns ``f`` itself is compared. With a column ``tag`` the
    fingerprints of each tag have a grid of their own.
    """
    words = [c for c in reps.columns if c[:1] == "v" and c[1:].isdigit()]
    kinds = ", ".join(["cell long", *(f"v{k} long" for k in range(max(1, len(words)))), "rep long"])
    cell_rows = pa.schema([(c.split()[0], pa.int64()) for c in kinds.split(", ")])

    def to_cells(batches):
        for batch in batches:
            f, tags, rep, *v = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns))
            order = np.argsort(tags, kind="stable")
            f, rep, tags, v = f[order], rep[order], tags[order], [w[order] for w in v]
            ends = [0, *(np.flatnonzero(tags[1:] != tags[:-1]) + 1).tolist(), len(tags)]
            for a, b in ((k, min(k + 4096, to)) for at, to in zip(ends, ends[1:]) for k in range(at, to, 4096)):
                row, cell, asks = cells(f[a:b].view(np.uint64), 64, int(tags[a]))
                yield pa.RecordBatch.from_arrays([pa.array(2 * cell + asks), *(pa.array(w[a:b][row]) for w in v), pa.array(rep[a:b][row])], schema=cell_rows)

    def met(batches):
        # rows come by cell, its residents before those who ask
        held: list[np.ndarray] = []  # the last cell's rows, which may go on in the next batch
        done = False  # whether the residents among them are compared with each other
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            if not len(cols[0]):
                continue
            if held:
                if done and cols[0][0] >> 1 == held[0][0] >> 1:
                    here = int(np.searchsorted(cols[0] >> 1, cols[0][0] >> 1, side="right"))
                    yield from links([np.concatenate([h, c[:here]]) for h, c in zip(held, cols)], True)
                    if here == len(cols[0]):
                        continue
                    cols = [c[here:] for c in cols]
                elif not done:
                    cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            last = int(np.searchsorted(cols[0] >> 1, cols[0][-1] >> 1))
            yield from links([c[:last] for c in cols])
            held, done = [c[last:] for c in cols], False
            if len(held[0]) > HELD and held[0][-1] & 1:  # all residents are here: the others need not stay
                yield from links(held)
                home = (held[0] & 1) == 0
                held, done = [c[home] for c in held], True
                if not len(held[0]):
                    held, done = [], False
        if held and not done:
            yield from links(held)

    def links(cols, done=False):
        cell, *v, rep = cols
        if len(cell) < 2:
            return
        asks, u = (cell & 1).astype(bool), [w.view(np.uint64) for w in v]
        own = cell >> 1
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ends = np.append(starts[1:], len(own))
        residents = np.add.reduceat((~asks).astype(np.int64), starts)
        a, b = [], []
        # cells of a few are compared all at once, by shifts; larger ones one by one, to the same groups
        size = ends - starts
        few = (size > 1) & (size <= 32) & (residents > 0) & (not done)
        end_of, in_few = np.repeat(ends, size), np.repeat(few, size)
        met_i, met_j = [], []
        for shift in range(1, 32):
            i = np.flatnonzero(in_few & (np.arange(len(own)) + shift < end_of))
            if not len(i):
                break
            j = i + shift
            near = (_bits_apart([w[i] ^ w[j] for w in u]) <= max_bits) & ~(asks[i] & asks[j])
            met_i.append(i[near])
            met_j.append(j[near])
        if met_i:
            i, j = np.concatenate(met_i), np.concatenate(met_j)
            at = np.repeat(np.arange(len(size)), size)[i]
            rich = np.bincount(at, minlength=len(size)) >= size  # more links than a forest has
            thin = ~rich[at]
            a.append(rep[i[thin]])
            b.append(rep[j[thin]])
            got = _stars(at[~thin], rep[i[~thin]], rep[j[~thin]])
            a.append(got[0])
            b.append(got[1])
        more = (size > 1) & ~few & (residents > 0)
        for s, e in zip(starts[more].tolist(), ends[more].tolist()):
            order = s + np.argsort(rep[s:e], kind="stable")
            got = np.array(cell_links(np.stack([w[order] for w in u], axis=1), asks[order], max_bits, done), dtype=np.int64).reshape(-1, 2)
            got = _stars(np.zeros(len(got), np.int64), rep[order][got[:, 0]], rep[order][got[:, 1]])
            a.append(got[0])
            b.append(got[1])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if len(a):
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], schema=_LINKS)

    tag = F.col("tag") if "tag" in reps.columns else F.lit(0).cast("long").alias("tag")
    given = reps.select("f", tag, "rep", *(words or [F.col("f").alias("v0")]))
    rows = _dealt(given.mapInArrow(to_cells, kinds), _crowded(given))
    met_rows = rows.repartition(F.shiftright("cell", 1)).sortWithinPartitions("cell")
    return met_rows.mapInArrow(met, "a long, b long").where("a <> b").distinct()


def _crowded(given: DataFrame) -> DataFrame:
    """(at, parts) of each cell with more than ``HELD`` residents, counted by built-in functions."""
    mask, half = F.lit(0x5555555555555555), F.lit(0xFFFFFFFF)
    low, high = F.col("f").bitwiseAND(mask), F.shiftrightunsigned("f", 1).bitwiseAND(mask)
    e = F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))  # as ``embed``
    name = lambda h: F.shiftleft(F.col("tag") * 2 + h, 32)
    at = F.explode(F.array(e.bitwiseAND(half).bitwiseOR(name(0)), F.shiftrightunsigned(e, 32).bitwiseOR(name(1))))
    n = given.select(at.alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    return stored(n.where(F.col("n") > HELD).select("at", F.ceil(F.col("n") / HELD).cast("long").alias("parts")), "crowded-cells")


def _dealt(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """The rows of crowded cells dealt to parts of them: a row lives in one part and asks in the others, so all who
    meet in the cell still do."""
    n = crowded.count()
    if not n:
        return rows
    if n <= SENT_CELLS:
        crowded = F.broadcast(crowded)
    met = rows.join(crowded, F.shiftright(rows["cell"], 1) == crowded["at"], "left")
    asks, home = F.col("cell").bitwiseAND(F.lit(1)), F.pmod(F.xxhash64("rep"), F.col("parts"))
    own = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        # a cell has 35 bits, its part stands above them, and the lowest bit says who asks
        lambda k: F.shiftleft(k, 40).bitwiseOR(F.col("cell")).bitwiseOR(F.when((asks == 1) | (k != home), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))),
    )
    every = F.when(F.col("parts").isNull(), F.array("cell")).otherwise(own)
    return met.select(F.explode(every).alias("cell"), *rows.columns[1:])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the links but the smallest of each component, which it names.

    Alternates large-star and small-star (Kiveris et al. 2014); each round is aggregations with partial sums
    and one join, written to the shared folder. It ends when a round changes no link.
    """
    now = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # each larger neighbour goes to the least of the neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before, now = now, stored(small.where("u <> v").distinct(), "links")
        was, mark = mark, _mark(now)
        drop_stored(before)
        if was == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(links: DataFrame) -> tuple:
    r = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("s")).first()
    return r["n"], r["s"]


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of ``docs``.

    Fingerprints link at ``MAX_BITS`` or fewer differing bits; component_id is the smallest doc_id reachable by
    links, its own included. Texts that are null or have no word share fingerprint zero and are linked like any
    other. Rows with a null doc_id are kept; they lend no name, and a component of such rows alone has a null
    component_id. Given doc_ids lie below 2**62. Repeated rows are kept. An empty table gives no rows. Other columns are ignored, whatever
    their names.
    """
    keyed = stored(fingerprint_documents(docs, words), "fingerprints")
    count = keyed.groupBy("f").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    reps = stored(count, "fingerprint-reps")
    rows = reps.agg(F.sum("n").alias("n")).first()["n"] or 0
    # a fingerprint that only rows without a doc_id have still links others: it stands below as a node of its own
    named = reps.select("f", "n", "rep", F.coalesce("rep", F.lit(1 << 62) + F.pmod("f", F.lit(1 << 61))).alias("node"))
    found = components(near_links(named.select("f", F.col("node").alias("rep"))))
    labelled = named.join(found, "node", "left").select(
        "f", "n", F.coalesce("component", "node").alias("c")
    ).select("f", "n", F.when(F.col("c") < (1 << 62), F.col("c")).alias("component_id"))
    # fingerprints with over a thousandth of the rows each are a thousand at most, and go to all; others meet by key
    hot = F.col("n") * HOT_SHARE > rows
    labelled = stored(labelled, "components")
    many = F.broadcast(labelled.where(hot).select("f", "component_id", F.lit(True).alias("hot")))
    marked = keyed.join(many, "f", "left")
    cold = marked.where("hot is null").select("f", "doc_id").join(labelled.where(~hot).select("f", "component_id"), "f")
    both = marked.where("hot").select("f", "doc_id", "component_id").unionByName(cold)
    return both.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


#: SimHashes of a text's distinct words, 64 bits each.
SIGNATURES = 4
#: A large candidate group is looked into in chunks of about so many texts and shingles (or as many times ``WEIGHED``
#: bytes, where that is more), and what a chunk leaves open goes against the whole group in blocks of so many.
CHUNK_TEXTS, CHUNK_SHINGLES, BLOCK_SHINGLES = 4096, 1 << 22, 1 << 21


def signatures(texts: list[str | None]) -> np.ndarray:
    """``SIGNATURES`` SimHashes of the distinct words of each whole text (words as in ``decontaminate.plain``). No
    words: zeros."""
    runs = [(i, r) for i, t in enumerate(texts) for r in _runs(plain(t))]
    which, hashes = [], []
    for i, run in runs:
        h = np.unique(word_hashes(run)[1])
        which.append(np.full(len(h), i))
        hashes.append(h)
    n = len(texts)
    out = np.zeros((n, SIGNATURES), np.uint64)
    if not hashes:
        return out
    which, h = _distinct(np.concatenate(which), np.concatenate(hashes))
    count = np.bincount(which, minlength=n)
    for k in range(SIGNATURES):
        each = _mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            held = np.bincount(which * 256 + each[:, j], minlength=n * 256).reshape(n, 256) @ _BITS
            byte = np.packbits((2 * held > count[:, None]).astype(np.uint8), axis=1, bitorder="little")[:, 0]
            out[:, k] |= byte.astype(np.uint64) << np.uint64(8 * j)
    return out


def _distinct(which: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) in order, each once."""
    order = np.lexsort((h, which))
    which, h = which[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (which[1:] != which[:-1]) | (h[1:] != h[:-1])
    return which[fresh], h[fresh]


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """The distinct 64-bit shingle hashes of each whole text, ascending."""
    which, h = _distinct(*shingle_hashes([plain(t) for t in texts], words))
    at = np.searchsorted(which, np.arange(len(texts) + 1))
    return [h[a:b] for a, b in zip(at, at[1:])]


#: 64-bit words of a sketch.
SKETCH_WORDS = 2
_PLACES = np.arange(64 * SKETCH_WORDS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def sketch(own: np.ndarray) -> np.ndarray:
    """``SKETCH_WORDS`` words of bits, one of the least hash in each equal part of the range (of the next such part that
    has any): two sketches differ in about (1 - similarity) / 2 of them. No shingles: zeros.

    A bit mixes in its place, so the bits of texts of few shingles are no copies of one another, and sketches of texts
    that share no shingle are independent.
    """
    if not len(own):
        return np.zeros(SKETCH_WORDS, np.uint64)
    n = 64 * SKETCH_WORDS
    parts = (own >> np.uint64(64 - (n - 1).bit_length())).astype(np.int64)
    least = own[np.searchsorted(parts, np.arange(n)) % len(own)]
    return np.packbits((_mix(least ^ _PLACES) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")


def sketch_bits(threshold: float) -> int:
    """Bits in which the sketches of similar texts may differ: four standard deviations beyond those expected, which
    one pair in 20 000 at the threshold exceeds. At 0.8 that is 27 of 128. Two sketches of texts without a common shingle
    have no more with a probability of 1e-11, so chance doesn't join texts into groups at any size of a corpus."""
    n, p = 64 * SKETCH_WORDS, (1 - threshold) / 2
    return int(np.ceil(round(n * p + 4 * (n * p * (1 - p)) ** 0.5, 9)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; texts without words are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


class Shingles:
    """An index of shingle sets, which tells all that are similar to a given one."""

    def __init__(self, sets: list[np.ndarray], threshold: float):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.threshold = threshold
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.texts = flat[order], np.repeat(np.arange(len(sets)), self.size)[order]

    def similar(self, own: np.ndarray) -> np.ndarray:
        """Places of all sets whose similarity to ``own`` is the threshold or more."""
        if not len(own):
            return np.flatnonzero(self.size == 0)
        a, b = np.searchsorted(self.hashes, own), np.searchsorted(self.hashes, own, side="right")
        n = b - a
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        both = np.bincount(self.texts[at], minlength=len(self.size))
        return np.flatnonzero((both >= self.threshold * (self.size + len(own) - both) - 1e-9) & (both > 0))


def group_links(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that give the exact components of some texts at ``threshold``.

    Who is similar to the first one is in one component with it, and links among those change nothing. Each of the
    rest is held against all, so no link that matters is missing.
    """
    index, out = Shingles(sets, threshold), []
    label = np.arange(len(sets))

    def expand(i: int) -> None:
        near = index.similar(sets[i])
        others, first = np.unique(label[near], return_index=True)
        for name, j in zip(others.tolist(), near[first].tolist()):
            if name != label[i]:
                out.append((i, j))
        label[np.isin(label, others)] = label[i]

    expand(0)
    for i in np.flatnonzero(label != label[0]).tolist():
        expand(i)
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("m", pa.string()), ("s", pa.list_(pa.int64())), ("v", pa.list_(pa.int64())), ("size", pa.int64())])
#: Bytes of text that weigh as much as one shingle: a long text that repeats itself has few shingles.
WEIGHED = 16


def _within_groups(texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """Verified links (a, b) inside the chunks of candidate groups; the first of a group is in each of its chunks."""

    def run(batches):
        held, key = [], None

        def done():
            got = group_links([x for _, x in held], threshold) if len(held) > 1 else []
            if got:
                a, b = np.array([n for n, _ in held], dtype=np.int64)[np.array(got).T]
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], schema=_LINKS)

        for batch in batches:
            own = (batch.column(k).to_pylist() for k in range(3))
            for group, chunk, node, x in zip(*own, shingle_sets(batch.column(3).to_pylist(), words)):
                if key != (group, chunk):
                    yield from done()
                    held, key = [], (group, chunk)
                held.append((node, x))  # a text's shingles, not the text
        yield from done()

    every = F.explode(F.when(F.col("leads"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("chunks")))))
    dealt = texts.select("group", every.alias("chunk"), "node", "text", "leads")
    ordered = dealt.repartition("group", "chunk").sortWithinPartitions("group", "chunk", F.desc("leads"), "node")
    return ordered.select("group", "chunk", "node", "text").mapInArrow(run, "a long, b long")


def _across_chunks(texts: DataFrame, links: DataFrame, threshold: float, words: int) -> DataFrame:
    """``links``, and those between different chunks of large candidate groups.

    Texts that are in one component with their group's first are settled. Each of the rest is held against all texts
    of its group: blocks of them, bounded in shingles, are indexed and the groups' texts are scanned against each
    block. A task returns one link at most for a text of the block and a component.
    """
    spark = texts.sparkSession
    large = texts.where("chunks > 1")
    if large.isEmpty():
        return links
    found = components(links)
    named = large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.where("leads").select("group", F.col("component").alias("settled"))
    named = stored(named.join(first, "group").withColumn("open", F.col("component") != F.col("settled")), "similar-large")
    total = named.where("open").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return links
    blocks = max(1, -(-total["n"] // BLOCK_SHINGLES), -(-total["rows"] // (4 * CHUNK_TEXTS)))
    for k in range(blocks):
        rows = named.where(F.col("open") & (F.pmod(F.xxhash64("node"), F.lit(blocks)) == k)).select("group", "node", "text").collect()
        if not rows:
            continue
        own: dict[int, list] = {}
        for r, s in zip(rows, shingle_sets([r["text"] for r in rows], words)):
            own.setdefault(r["group"], []).append((r["node"], s))
        block = {g: (np.array([n for n, _ in x], dtype=np.int64), Shingles([s for _, s in x], threshold)) for g, x in own.items()}
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            told = set()
            for batch in batches:
                group, node, component, text = (batch.column(k).to_pylist() for k in range(4))
                at = [i for i, g in enumerate(group) if g in held.value]
                out = []
                for i, s in zip(at, shingle_sets([text[i] for i in at], words)):
                    nodes, index = held.value[group[i]]
                    for x in nodes[index.similar(s)].tolist():
                        if x != node[i] and (x, component[i]) not in told:
                            told.add((x, component[i]))
                            out.append((x, node[i]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=_LINKS)

        more = named.select("group", "node", "component", "text").mapInArrow(run, "a long, b long")
        links = links.unionByName(stored(more, "similar-across"))
    return links


def similar_documents(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """doc_id and component_id for each row: texts link at a Jaccard similarity of ``threshold`` of their shingles.

    Candidates are texts of which a half of one of ``SIGNATURES`` SimHashes of the distinct words has bit counts at
    a Manhattan distance of 1 or less, found in the same grid, and whose sketches of shingles are near. They give
    candidate groups, of texts that are similar to about 0.6 or more one after another, as sketches of 128 bits leave no
    room for chance. In each, components are then found exactly, on the shingles (64-bit hashes) of whole texts, however
    large a group is. So what can be missed is a text that no candidate leads to; no link inside a
    candidate group is. Equal texts collapse first.

    component_id is the smallest doc_id reachable. Null doc_ids, empty texts, repeated rows, empty tables and other
    columns are as in ``near_duplicates``; rows with a null doc_id alone in a component have a null component_id.
    """
    ship_package(docs.sparkSession)

    def sign(batches):
        for batch in batches:
            keys = batch.column(0)
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                m = [hashlib.md5((t or "").encode("utf-8", "replace")).hexdigest() for t in texts]
                s = signatures(texts).view(np.int64).tolist()
                sets = shingle_sets(texts, words)
                v = [sketch(x).view(np.int64).tolist() for x in sets]
                size = [max(len(x), len(t or "") // WEIGHED) for x, t in zip(sets, texts)]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([keys.slice(at, 256), pa.array(m), pa.array(s, longs), pa.array(v, longs), pa.array(size, pa.int64())], schema=_SIGNED)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = stored(rows.mapInArrow(sign, "doc_id long, m string, s array<long>, v array<long>, size long"), "signatures")
    count = keyed.groupBy("m").agg(F.min("doc_id").alias("rep"), F.first("s").alias("s"), F.first("v").alias("v"), F.first("size").alias("size"), F.count("*").alias("n"))
    reps = stored(count.withColumn("node", F.monotonically_increasing_id()), "signature-reps")
    total = reps.agg(F.sum("n").alias("n")).first()["n"] or 0
    values = [F.get("v", F.lit(k)).alias(f"v{k}") for k in range(SKETCH_WORDS)]
    signed = reps.select(F.posexplode("s").alias("tag", "f"), *values, F.col("node").alias("rep")).withColumn("tag", F.col("tag").cast("long"))
    maybe = stored(near_links(signed, sketch_bits(threshold)), "similar-candidates")
    # candidate groups; the text with most candidates, as the original of many copies has, leads its group
    groups = components(maybe)
    ends = maybe.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    members = reps.select("node", "m", "size", F.col("rep").alias("doc_id")).join(ends, "node").join(groups, "node", "left")
    members = stored(members.withColumn("component", F.coalesce("component", "node")), "similar-members")
    whole = members.groupBy("component").agg(F.max(F.struct("links", "node")).alias("lead"), F.sum("size").alias("shingles"), F.count("*").alias("texts"))
    chunks = F.greatest(F.ceil(F.col("shingles") / CHUNK_SHINGLES), F.ceil(F.col("texts") / CHUNK_TEXTS))
    whole = whole.select("component", F.col("lead.node").alias("leader"), chunks.cast("long").alias("chunks"))
    wanted = members.join(whole, "component").select(
        F.col("component").alias("group"), "chunks", (F.col("node") == F.col("leader")).alias("leads"), "node", "size", "m", "doc_id"
    )
    # one text of each member; members are as many as the documents at worst, so no side is broadcast whatever its size
    own = rows.select(F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("m"), "text")
    found = own.join(wanted.hint("merge"), (own["m"] == wanted["m"]) & own["doc_id"].eqNullSafe(wanted["doc_id"]))
    texts = stored(found.select("group", "chunks", "leads", "node", "size", "text").dropDuplicates(["node"]), "similar-texts")
    links = stored(_within_groups(texts, threshold, words), "similar-links")
    parts = components(_across_chunks(texts, links, threshold, words))
    named = reps.join(parts, "node", "left")
    named = named.select("m", "n", "rep", F.coalesce("component", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    labelled = stored(named.join(least, "c").select("m", "n", "component_id"), "similar-components")
    hot = F.col("n") * HOT_SHARE > total
    many = F.broadcast(labelled.where(hot).select("m", "component_id", F.lit(True).alias("hot")))
    marked = keyed.select("doc_id", "m").join(many, "m", "left")
    cold = marked.where("hot is null").select("m", "doc_id").join(labelled.where(~hot).select("m", "component_id"), "m")
    return marked.where("hot").select("doc_id", "component_id").unionByName(cold.select("doc_id", "component_id"))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))
