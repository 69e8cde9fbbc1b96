"""Language identification by a byte convolutional network, trained here in numpy.

Each byte has a learned vector; filters of several widths slide over a window of fixed length, each filter's
largest response is kept (max pooling), and a softmax over these gives the language. For prediction the byte
vectors and filters are multiplied out into a table of 256 rows for each place in a filter, so a response is a
sum of looked-up rows. A text is cut into windows from end to end and its languages' probabilities are the means
over its windows, weighted by their bytes.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .sample import held_out, training_rows

WIDTHS, FILTERS, DIM, WINDOW = (2, 3, 4, 5), 12, 8, 128
#: At most so many documents of each language are learned from, and so many windows of each document.
PER_CLASS, WINDOWS_EACH = 400, 8
EPOCHS, BATCH, RATE, SEED = 4, 32, 0.01, 11
#: Windows that are predicted at once.
AT_ONCE = 256


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased UTF-8 bytes of a whole text in rows of ``WINDOW``, the last filled with zeros, and their lengths."""
    b = text.lower().encode("utf-8", "replace")
    n = max(1, -(-len(b) // WINDOW))
    rows = np.frombuffer(b.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)
    length = np.full(n, WINDOW, dtype=np.int64)
    length[-1] = len(b) - (n - 1) * WINDOW
    return rows, length


@dataclass
class ByteCNN:
    langs: list[str]
    tables: list[list[np.ndarray]]  # for each width, a table (256, filters) for each place
    offsets: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def train(cls, rows: list[tuple[str, str]]) -> ByteCNN:
        """Learn from (text, language): Adam on the cross entropy of single windows."""
        langs = sorted({y for _, y in rows})
        rng = np.random.default_rng(SEED)
        x, y = [], []
        for text, lang in rows:
            own, length = windows(text)
            own = own[length >= min(16, int(length.max()))]
            take = rng.permutation(len(own))[:WINDOWS_EACH]
            x.append(own[take])
            y += [langs.index(lang)] * len(take)
        p = {"e": rng.normal(0, 0.5, (256, DIM)).astype(np.float32)}
        for w in WIDTHS:
            p[f"w{w}"] = rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)).astype(np.float32)
            p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        p["o"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        p["c"] = np.zeros(len(langs), np.float32)
        x, y = np.concatenate(x) if x else np.zeros((0, WINDOW), np.uint8), np.array(y, dtype=np.int64)
        m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        for _ in range(EPOCHS if len(langs) > 1 else 0):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                k = order[at : at + BATCH]
                t += 1
                for name, g in cls._gradients(p, x[k], y[k]).items():
                    m1[name] = 0.9 * m1[name] + 0.1 * g
                    m2[name] = 0.999 * m2[name] + 0.001 * g * g
                    p[name] -= RATE * (m1[name] / (1 - 0.9**t)) / (np.sqrt(m2[name] / (1 - 0.999**t)) + 1e-8)
        tables = [[p["e"] @ p[f"w{w}"][j * DIM : (j + 1) * DIM] for j in range(w)] for w in WIDTHS]
        return cls(langs, tables, [p[f"b{w}"] for w in WIDTHS], p["o"], p["c"])

    @staticmethod
    def _gradients(p: dict, x: np.ndarray, y: np.ndarray) -> dict:
        n = len(x)
        e = p["e"][x]
        pooled, where, patches = [], [], []
        for w in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2)
            flat = view.reshape(n, WINDOW - w + 1, w * DIM)
            z = flat @ p[f"w{w}"] + p[f"b{w}"]
            at = z.argmax(axis=1)
            where.append(at)
            patches.append(flat)
            pooled.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0])
        h = np.maximum(np.concatenate(pooled, axis=1), 0)
        z = h @ p["o"] + p["c"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"o": h.T @ q, "c": q.sum(axis=0), "e": np.zeros_like(p["e"])}
        back = (q @ p["o"].T) * (h > 0)
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            d = back[:, i * FILTERS : (i + 1) * FILTERS]  # (n, filters): only the largest response has a gradient
            hit = patches[i][rows, where[i]]  # (n, filters, w * DIM)
            g[f"w{w}"] = np.einsum("nfk,nf->kf", hit, d)
            g[f"b{w}"] = d.sum(axis=0)
            to = d[:, :, None] * p[f"w{w}"].T[None]  # (n, filters, w * DIM)
            for j in range(w):
                np.add.at(g["e"], x[rows, where[i] + j], to[:, :, j * DIM : (j + 1) * DIM])
        return g

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window."""
        out = np.empty((len(x), len(self.langs)))
        for at in range(0, len(x), AT_ONCE):
            own = x[at : at + AT_ONCE]
            pooled = []
            for tables, offset in zip(self.tables, self.offsets):
                n = WINDOW - len(tables) + 1
                z = tables[0].take(own[:, :n], axis=0)
                for j in range(1, len(tables)):
                    z += tables[j].take(own[:, j : j + n], axis=0)
                pooled.append(z.max(axis=1) + offset)
            z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.bias
            q = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + AT_ONCE] = q / q.sum(axis=1, keepdims=True)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its probability of each whole text; ``und`` and 0 for a null text or one without letters."""
        import regex

        letter = regex.compile(r"\p{L}")
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and self.langs and letter.search(t)]
        held, names, size = [], [], 0

        def flush():
            nonlocal held, names, size
            if held:
                x = np.concatenate([a for a, _ in held])
                length = np.concatenate([b for _, b in held]).astype(float)
                first = np.cumsum([0, *[len(a) for a, _ in held]])[:-1]
                q = np.add.reduceat(self.probabilities(x) * length[:, None], first, axis=0) / np.add.reduceat(length, first)[:, None]
                for i, row in zip(names, q):
                    out[i] = (self.langs[int(row.argmax())], float(min(1.0, row.max())))
            held, names, size = [], [], 0

        for i in todo:
            held.append(windows(texts[i]))
            names.append(i)
            size += len(held[-1][0])
            if size >= AT_ONCE * 8:
                flush()
        flush()
        return out


def learn(docs: DataFrame, per_class: int = PER_CLASS) -> ByteCNN:
    """A network from the text and lang of documents outside the held-out fold."""
    labels = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label"))
    return ByteCNN.train(training_rows(docs, labels, per_class)[0])


def identify_languages(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """The columns of ``docs`` in ``doc``, with lang_pred and score, its probability.

    The whole text is looked at, and nothing else. A null text and one without a letter is ``und`` with score 0,
    as is every text if no language could be learned. Null doc_ids and repeated rows are predicted each by itself;
    an empty table gives no rows. Columns of ``docs`` stay apart in ``doc``, so no name clashes.
    """
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # some hundred kilobytes, whatever the corpus
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].alias("text"))

    def run(batches):
        for batch in batches:
            got = held.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc", "lang_pred", "score"],
            )

    schema = rows.select("doc", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    found = identify_languages(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score")
