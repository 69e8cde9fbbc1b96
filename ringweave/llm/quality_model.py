"""Quality classifier: supervised subword embeddings (Joulin et al. 2016), trained by stochastic gradient descent.

A document is the mean of learned vectors of its words, of the character n-grams in them and of its word pairs,
hashed into buckets; a softmax on that mean gives the classes. A pair is written by its second word relative to
the first, the same or another, which is what pairs tell about quality whatever the language. The softmax is linear, so for scoring each bucket's vector is replaced
by its share of the logit, and a text's score is the mean of one number for each of its features.
"""

from __future__ import annotations

import functools
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .sample import held_out, training_rows

BITS, DIM, GRAMS = 18, 16, (3, 4, 5)
#: At most so many labelled documents of each class are learned from.
PER_CLASS = 2000
EPOCHS, RATE, SEED = 5, 0.25, 7
KEEP_AT = 0.3
#: Features of training texts in one array (of 36 MB, which an allocator gives back).
CHUNK = 9_000_000
#: Code points whose features are held at once.
RUN = 1 << 18
_B = 0x9E3779B97F4A7C15
_M1, _PAIR = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SCALE = np.array([pow(0xD6E8FEB86659FD93, j, 1 << 64) for j in range(max(GRAMS))], dtype=np.uint64)
_SPACES = dict.fromkeys([*range(9, 14), 0x85, 0xA0], " ")


@functools.lru_cache(maxsize=1)
def _powers(n: int):
    up = np.full(n, _B, dtype=np.uint64)
    down = np.full(n, pow(_B, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def features(run: str, before: np.uint64 | None = None, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.uint64 | None]:
    """(place, bucket) of each feature of a run of whole words: its words, word pairs, and the n-grams of `` word ``.

    The third value is the last word's hash; given as ``before`` to the next run of the same text, the pair across
    the cut is there too. ``first`` has the places where texts begin, if the run holds several: no pair crosses them.
    """
    c = np.frombuffer(f" {run} ".translate(_SPACES).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    space = c == 32
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = turns[::2], turns[1::2]
    up, down = _powers(max(2 * RUN, 1 << len(c).bit_length()))
    code = (c + np.uint64(1)) * _M1
    code ^= code >> np.uint64(29)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * up[: len(c)])])
    words = (upto[ends] - upto[starts]) * down[starts] + (ends - starts).astype(np.uint64) if len(starts) else np.zeros(0, np.uint64)
    second = starts[1:]
    pairs = words[1:] == words[:-1]  # as written; a capital makes another word
    if first is not None and len(second):
        own = np.searchsorted(first, starts, side="right")
        second, pairs = second[own[1:] == own[:-1]], pairs[own[1:] == own[:-1]]
    if before is not None and len(starts):
        second, pairs = np.concatenate([starts[:1], second]), np.concatenate([words[:1] == before, pairs])
    places, hashes = [starts, second], [words, (pairs.astype(np.uint64) + np.uint64(1)) * _PAIR]
    last = words[-1] if len(words) else before
    grown = code.copy()
    spaces = np.concatenate([[0], np.cumsum(space)])
    for n in range(2, max(GRAMS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        grown = grown[:m] + code[n - 1 :] * _SCALE[n - 1]
        if n in GRAMS:
            # a word's end may be the first or last character, none may lie between
            at = np.flatnonzero(spaces[n - 1 : n - 1 + m] == spaces[1 : m + 1])
            places.append(at)
            hashes.append(grown[at] + np.uint64(n))
    h = np.concatenate(hashes)
    h ^= h >> np.uint64(32)
    h *= _M1
    return np.concatenate(places), (h >> np.uint64(64 - BITS)).astype(np.int64), last


def _buckets(text: str):
    """The buckets of a whole text's features, run by run."""
    last = None
    for run in _runs(text):
        _, bucket, last = features(run, last)
        yield bucket


def _runs(text: str):
    """A long text in runs of whole words."""
    at = 0
    while len(text) - at > RUN:
        to = text.rfind(" ", at + 1, at + RUN)
        if to < 0:
            to = text.find(" ", at + RUN)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


class Model:
    """``weight[bucket]``: a feature's logit of class 1 over class 0; a document has the mean, plus ``bias``."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    @classmethod
    def train(cls, rows: list[tuple[str, int]], prior: float) -> Model:
        """Learn from (text, 0 or 1). ``prior``: the log odds of class 1, which replace those of the sample."""
        n = [sum(y == k for _, y in rows) for k in (0, 1)]
        if not all(n):  # one class or none: there is nothing to tell apart
            return cls(np.zeros(1 << BITS, np.float32), float(prior))
        # features lie in a few large arrays: small ones' memory would stay with the driver after training
        bags, at = [], CHUNK
        for text, y in rows:
            b, count = np.unique(np.concatenate(list(_buckets(text))), return_counts=True)
            if not len(b):
                continue
            if at + len(b) > CHUNK:
                size = max(CHUNK, len(b))
                buckets, shares, at = np.empty(size, np.int32), np.empty(size, np.float32), 0
            own = slice(at, at + len(b))
            buckets[own], shares[own] = b, count / count.sum()
            bags.append((buckets[own], shares[own], y))
            at += len(b)
        rng = np.random.default_rng(SEED)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
        out = np.zeros((DIM, 2), np.float32)
        steps, at = EPOCHS * len(bags), 0
        for _ in range(EPOCHS):
            for k in rng.permutation(len(bags)):
                b, share, y = bags[k]
                rate = np.float32(RATE * (1 - at / steps))
                at += 1
                own = vectors[b]
                mean = share @ own
                z = mean @ out
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                back = out @ p
                out -= rate * np.outer(mean, p)
                # a feature takes the gradient by its share times the number of features (at most 4), so that
                # steps don't shrink with a document's length
                vectors[b] = own - rate * np.minimum(share * len(b), 4)[:, None] * back
        odds = prior - math.log(n[1] / n[0])
        return cls((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), odds)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of class 1 of each whole text; a text without words has the bias alone.

        A text's score is the same to the last bit whatever stands beside it: no feature crosses texts, and a text
        of up to ``RUN`` code points is summed in one go, a longer one run by run.
        """
        total, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        held, names, size = [], [], 0

        def flush():
            nonlocal held, names, size
            if held:
                first = np.cumsum([0, *[len(x) + 1 for x in held]])[:-1]
                # the run has a space before it, so a text begins at first + 1; the space itself begins n-grams of its word
                place, bucket, _ = features(" ".join(held), first=first)
                own = np.searchsorted(first, place, side="right") - 1
                total[names] = np.bincount(own, weights=self.weight[bucket], minlength=len(held))
                count[names] = np.bincount(own, minlength=len(held))
            held, names, size = [], [], 0

        for i, text in enumerate(texts):
            text = text or ""
            if len(text) > RUN:
                for bucket in _buckets(text):
                    total[i] += self.weight[bucket].sum(dtype=np.float64)
                    count[i] += len(bucket)
                continue
            if size + len(text) > RUN:
                flush()
            held.append(text)
            names.append(i)
            size += len(text) + 1
        flush()
        z = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from the labelled documents outside the held-out fold: ``labels`` has doc_id and quality."""
    marked = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("string").alias("label"))
    rows, counts = training_rows(docs, marked, per_class)
    prior = math.log((counts.get("1", 0) + 1) / (counts.get("0", 0) + 1))
    return Model.train([(t, int(y)) for t, y in rows], prior)


def score_documents(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """The columns of ``docs`` in ``doc``, with score (probability of quality 1) and predicted (score >= keep_at).

    Only the text is looked at, the whole of it. A null or empty text has the score of the model's bias alone, as
    has any text where nothing could be learned (no labelled row of one of the classes). Null doc_ids and repeated
    rows are scored each by itself; an empty table gives no rows. Columns of ``docs`` stay apart in ``doc``, so no
    name clashes.
    """
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a megabyte, whatever the corpus
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held.value.scores(batch.column(1).to_pylist()))], names=["doc", "score"]
            )

    schema = rows.select("doc", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= keep_at).cast("int"))


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    model = learn(docs, spark.read.parquet(os.path.join(sf_dir, "labels.parquet")))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", "predicted")
