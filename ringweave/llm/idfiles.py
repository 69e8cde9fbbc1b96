"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A file holds the documents of a run of ascending doc_ids:

    b"RWIDS001" | lengths of the parts (4 x u64) | n_docs, n_ids, n_null, base (u64, u64, u64, i64) | id width (u8)
    | Elias-Fano of the n_docs + 1 boundaries | Elias-Fano of doc_id - base of rows with a doc_id
    | ids, little-endian | crc32 of all before it (u32)

Files are written and read through ``pyarrow.fs`` in the shared folder, so any store that it knows does.
Each task writes a file under a name of its own and then renames it to one that only the partition and
the place in it decide; a task that runs again writes the same bytes under the same name.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path, ship_package, stored
from .eliasfano import EliasFano
from .tokens import bounded, default_path, encoder

MAGIC = b"RWIDS001"
_LENGTHS, _COUNTS = struct.Struct("<QQQQ"), struct.Struct("<QQQqB")
#: A file is closed at so many ids or documents; one longer document has a file of its own.
IDS_IN_FILE, DOCS_IN_FILE = 1 << 22, 1 << 16


def filesystem(uri: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def pack_file(doc_ids: list, ids: list[bytes], width: int) -> bytes:
    """The bytes of one file. Rows without a doc_id come first."""
    n_null = sum(x is None for x in doc_ids)
    named = np.array([x for x in doc_ids if x is not None], dtype=np.int64)
    base = int(named[0]) if len(named) else 0
    ends = np.concatenate([[0], np.cumsum([len(x) // width for x in ids])])
    bounds, names = EliasFano.of(ends).to_bytes(), EliasFano.of((named - base).astype(np.uint64)).to_bytes()
    counts = _COUNTS.pack(len(doc_ids), int(ends[-1]), n_null, base, width)
    body = b"".join(ids)
    head = MAGIC + _LENGTHS.pack(len(counts), len(bounds), len(names), len(body))
    out = b"".join((head, counts, bounds, names, body))
    return out + struct.pack("<I", zlib.crc32(out))


class IdFile:
    """Random access to one file: the head is read at once, ids only where asked for."""

    def __init__(self, source):
        self.source = source
        head = source.read_at(len(MAGIC) + _LENGTHS.size, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not an id file")
        a, b, c, self.ids_len = _LENGTHS.unpack_from(head, len(MAGIC))
        at = len(head)
        rest = source.read_at(a + b + c, at)
        self.n_docs, self.n_ids, self.n_null, self.base, self.width = _COUNTS.unpack_from(rest)
        self.bounds = EliasFano.from_bytes(rest[a : a + b])
        self.names = EliasFano.from_bytes(rest[a + b :])
        self.body = at + a + b + c

    def check(self) -> None:
        """Raise unless the bytes are those written."""
        got, at, end = 0, 0, self.body + self.ids_len
        while at < end:
            got = zlib.crc32(self.source.read_at(min(1 << 20, end - at), at), got)
            at += 1 << 20
        if struct.unpack("<I", self.source.read_at(4, end))[0] != got:
            raise ValueError("an id file is damaged")

    def doc_ids(self, at: int, to: int) -> list:
        named = self.names.get(np.arange(max(at, self.n_null), to) - self.n_null) + self.base
        return [None] * max(0, min(to, self.n_null) - at) + named.tolist()

    def offsets(self, i: np.ndarray) -> np.ndarray:
        """First id of the i-th documents; n_docs gives the end."""
        return self.bounds.get(i)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        return self.run(*self.offsets(np.array([i, i + 1])).tolist())

    def run(self, a: int, b: int) -> np.ndarray:
        """The ids from place a up to b."""
        return np.frombuffer(self.source.read_at((b - a) * self.width, self.body + a * self.width), f"<u{self.width}")


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = 0) -> tuple[DataFrame, str]:
    """Encode the whole texts of ``docs`` (doc_id, text) and write them in ascending doc_id order.

    Returns the list of files as a DataFrame (part, seq, file, n_docs, n_ids) and the folder. A null text
    counts as empty; each document ends with ``end_id``. Rows with a null doc_id come first; rows of one
    doc_id lie together, ordered by their texts' hashes, and each is a document of its own. An empty table
    gives no file. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    tokenizer = path or default_path()
    folder = fresh_path(spark, "ids")

    def write(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        names, ids, n, seq = [], [], 0, 0

        def flush():
            name = f"part-{part:06d}-{seq:06d}.rwids"
            own = f"{top}/_{name}.{attempt}"
            with fs.open_output_stream(own) as f:
                f.write(pack_file(names, ids, enc.dtype.itemsize))
            try:
                fs.move(own, f"{top}/{name}")
            except OSError:  # some stores do not rename onto a file; an earlier attempt wrote the same bytes
                fs.delete_file(f"{top}/{name}")
                fs.move(own, f"{top}/{name}")
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "file": [name], "n_docs": [len(names)], "n_ids": [n]},
                schema=_MANIFEST,
            )

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for some in bounded(texts):
                for key, got in zip(keys[some], enc.encode(texts[some])):
                    names.append(key)
                    ids.append(got + end)
                    n += len(got) // enc.dtype.itemsize + 1
                    if n >= IDS_IN_FILE or len(names) >= DOCS_IN_FILE:
                        yield flush()
                        names, ids, n, seq = [], [], 0, seq + 1
        if names:
            yield flush()

    # the last key lets rows of one doc_id and text be dealt to several tasks
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    made = ordered.mapInArrow(write, "part long, seq long, file string, n_docs long, n_ids long")
    return stored(made, "id-list"), folder


_MANIFEST = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """Read files of ``write_ids`` back: doc_id, start, n_tokens, ids_crc32, file.

    ``start`` counts the ids of all documents before, over all files. A file's ids are read in runs of
    documents, between offsets that the select structures give.
    """
    whole = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = whole.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.join(parts, "part").select(
        "part", "seq", "file", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start")
    )

    def read(batches):
        fs, top = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(f"{top}/{name}") as source:
                    f = IdFile(source)
                    f.check()
                    for at in range(0, f.n_docs, 512):
                        to = min(at + 512, f.n_docs)
                        offsets = f.offsets(np.arange(at, to + 1))
                        ids = f.run(*offsets[[0, -1]].tolist()).astype("<u4")
                        cuts = (offsets - offsets[0]).tolist()
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": f.doc_ids(at, to),
                                "start": offsets[:-1] + start,
                                "n_tokens": np.diff(offsets),
                                "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])],
                                "file": [name] * (to - at),
                            },
                            schema=_ROWS,
                        )

    n = max(1, files.sparkSession.sparkContext.defaultParallelism * 4)
    return placed.repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string())])


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as id files, read back."""
    files, folder = write_ids(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))
    return read_ids(files, folder)
