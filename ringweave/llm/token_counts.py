"""Tokens of the sections of a document, by the character offsets of one encoding of the whole text."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .tokens import TextEncoder, bounded, cut, default_path, encoder

RULES = ("first", "last", "most")


def _spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines as sections: each with its line feed, gapless; an empty text has one empty section."""
    ends = [i + 1 for i in _feeds(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    ends = np.array(ends, dtype=np.int64)
    return np.concatenate([[0], ends[:-1]]), ends


def _feeds(text: str):
    at = text.find("\n")
    while at >= 0:
        yield at
        at = text.find("\n", at + 1)


def _owner(starts, ends, a, b, rule):
    """Section of tokens [a, b): that of the first or last character, or of most of them (a tie: the first)."""
    first = np.searchsorted(starts, a, side="right") - 1
    last = np.searchsorted(starts, np.maximum(b - 1, a), side="right") - 1
    if rule == "first":
        own = first
    elif rule == "last":
        own = last
    else:
        own = first.copy()
        for k in np.flatnonzero(first != last):
            held = [min(ends[s], b[k]) - max(starts[s], a[k]) for s in range(first[k], last[k] + 1)]
            own[k] = first[k] + int(np.argmax(held))
    return own, first != last


def token_spans(enc: TextEncoder, run: str, ids: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token of a text, and the one after its last.

    Where tokens are runs of bytes (``ids`` given), their spans are the running sums of their bytes, counted in
    characters; a token that holds part of a character covers the whole of it. Else the library's offsets.
    """
    if ids is None:
        at = np.array(enc.whole(run).offsets, dtype=np.int64).reshape(-1, 2)
        return at[:, 0], at[:, 1]
    to = np.cumsum(enc.bytes_of[ids])
    a, b = to - enc.bytes_of[ids], to
    if not run.isascii():
        raw = np.frombuffer(run.encode("utf-8"), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        a, b = char[a], char[b - 1] + 1
    return a, b


class _Counter:
    """Counts of tokens and of boundary-crossing tokens for each section of a text."""

    def __init__(self, path: str, rule: str):
        self.enc, self.rule = encoder(path), rule

    def count(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(starts, ends, tokens, crossing) of the sections of each text, each of them encoded once, as a whole."""
        if not self.enc.by_piece:
            return [self._join(t, [(t, None)]) for t in texts]
        if len(texts) == 1:  # a long one: its ids are held run by run
            runs = ((r, np.frombuffer(self.enc.encode([r])[0], self.enc.dtype)) for r in cut(texts[0]))
            return [self._join(texts[0], runs)]
        return [self._join(t, [(t, np.frombuffer(i, self.enc.dtype))]) for t, i in zip(texts, self.enc.encode(texts))]

    def _join(self, text: str, runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The interval join of a text's token spans with its sections."""
        starts, ends = _spans(text)
        tokens, crossing, base = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), 0
        for run, ids in runs:
            a, b = token_spans(self.enc, run, ids)
            own, over = _owner(starts, ends, a + base, b + base, self.rule)
            tokens += np.bincount(own, minlength=len(starts))
            crossing += np.bincount(own[over], minlength=len(starts))
            base += len(run)
        return starts, ends, tokens, crossing


_OUT = pa.schema([(c, pa.int64()) for c in ("doc_id", "section", "start", "length", "n_tokens", "n_crossing")])


def count_tokens(docs: DataFrame, path: str | None = None, rule: str = "first") -> DataFrame:
    """Tokens of each line of each document: doc_id, section, start, length, n_tokens, n_crossing.

    A whole text is encoded once; its tokens' character spans are joined with those of its sections
    (lines, each with its line feed). A token that crosses a boundary counts in one section, so the sums
    over the sections are the document's tokens: by ``rule`` in the section of its ``first`` or ``last``
    character, or of ``most`` of its characters (a tie: the earlier). ``n_crossing`` says how many of a
    section's tokens do. Tokens that share a character (parts of one) each cover the whole of it.

    A null or empty text has one empty section without tokens. Null doc_ids and repeated rows are kept,
    each row by itself. Other columns are ignored, whatever their names.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    ship_package(docs.sparkSession)
    tokenizer = path or default_path()

    def count(batches):
        counter = _Counter(tokenizer, rule)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for some in bounded(texts):
                own = texts[some]
                got = counter.count(own)
                n = [len(g[0]) for g in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, m in zip(keys[some], n) for _ in range(m)], pa.int64()),
                        pa.array(np.concatenate([np.arange(m) for m in n])),
                        pa.array(np.concatenate([g[0] for g in got])),
                        pa.array(np.concatenate([g[1] - g[0] for g in got])),
                        pa.array(np.concatenate([g[2] for g in got])),
                        pa.array(np.concatenate([g[3] for g in got])),
                    ],
                    schema=_OUT,
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, section long, start long, length long, n_tokens long, n_crossing long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return count_tokens(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))
