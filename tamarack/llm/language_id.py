"""Language identification: averaged hashed subword embeddings with a linear softmax.

Features of a text are its character 1- to 4-grams, over the lower-cased text in which every run of characters that
are not letters is one space. They are hashed into BUCKETS rows of an embedding table; a text is the average
of its features' rows, and a linear layer with softmax gives the languages. Table and layer are trained together by
mini-batch stochastic gradient descent in numpy on the driver, with executors computing the features of the training
rows. A third of those is held back to calibrate: a temperature makes scores probabilities, and the score under which
REJECT_SHARE of right answers fall becomes the threshold of rejection.

Training takes about `train_rows` labelled rows, an equal share of each language, those of the smallest hash of the id, and never more
than twice as many, which bounds memory on the driver; whole texts are used. More than MOST_LANGUAGES languages are an error. Prediction folds embedding and layer into one table of BUCKETS x languages.

Defined results: a text that is null or has no letter is `und` with score 0. Without labelled rows all texts are `und`.
Ties between languages go to the first in alphabetical order. Only the text decides: id, source and language of a row
are no inputs of its prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require

BUCKETS, DIM, ORDERS = 1 << 15, 16, (1, 2, 3, 4)
TRAIN_ROWS, EPOCHS, BATCH, RATE = 3000, 12, 32, 20.0
REJECT_SHARE = 0.005
#: More languages are an error, as the model has a column for each.
MOST_LANGUAGES = 3000
_STEPS = 1 << 30
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_CHUNK = 1 << 19


def features(text: str) -> np.ndarray:
    """Buckets of the features of a text, in order, repeats included."""
    code = codes(text)
    return grams(code, 0, len(code))


def codes(text: str) -> np.ndarray:
    """Code points of the text as features see it."""
    plain = f" {_OTHER.sub(' ', text.lower()).strip()} "
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(code: np.ndarray, a: int, b: int) -> np.ndarray:
    """Buckets of the n-grams that begin at a or later and before b."""
    out, h = [], np.zeros(max(0, min(b, len(code)) - a), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        count = min(b, len(code) - n + 1) - a
        if count <= 0:
            break
        h = (h[:count] * np.uint32(0x01000193)) ^ (code[a + n - 1 : a + n - 1 + count] * np.uint32(0x9E3779B1))
        if n in ORDERS:
            x = h ^ (h >> np.uint32(15))
            x = x * np.uint32(0x85EBCA6B)
            out.append((x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: str) -> np.ndarray:
        """Of the whole text; n-grams are summed in parts by where they begin, so that long texts take little memory."""
        total, n, code = np.zeros(len(self.languages)), 0, codes(text)
        for at in range(0, len(code), _CHUNK):
            f = grams(code, at, at + _CHUNK)
            total += np.bincount(f, minlength=BUCKETS) @ self.table if len(f) > BUCKETS else self.table[f].sum(axis=0, dtype=np.float64)
            n += len(f)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[list[int], list[int]]], labels: list[str], seed: int = 0) -> Model:
    """rows: distinct buckets and their counts."""
    languages = sorted(set(labels))
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    held = np.zeros(len(rows), bool) if len(rows) < 9 else np.arange(len(rows)) % 3 == 2
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    sparse = [(np.array(b, np.int64), (np.array(c) / max(sum(c), 1)).astype(np.float32)) for b, c in rows]
    train = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            x = np.stack([sparse[i][1] @ embedding[sparse[i][0]] for i in batch])
            g = _softmax(x @ layer + bias)
            g[np.arange(len(batch)), y[batch]] -= 1
            g /= len(batch)
            back = g @ layer.T
            layer -= rate * x.T @ g
            bias -= 0.1 * g.sum(axis=0)
            for i, b in zip(batch, back, strict=True):
                embedding[sparse[i][0]] -= rate * np.outer(sparse[i][1], b)
    table = embedding @ layer
    check = np.flatnonzero(held) if held.any() else train
    z = np.stack([sparse[i][1] @ table[sparse[i][0]] for i in check]) + bias
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    return Model(languages, table, bias, temperature, float(np.quantile(right, REJECT_SHARE)) if len(right) else 0.0)


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """labelled: doc_id, text, lang. Of each language an equal share of train_rows is taken by hash of the id, give or take chance, and never more than twice train_rows in all."""
    require(labelled, "doc_id", "text", "lang")
    own = labelled.select("text", F.col("lang").cast("string").alias("lang"), F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(_STEPS)).alias("h")).filter("lang is not null and text is not null")
    counts = own.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    if not counts:
        return fit([], [])
    share = max(1, train_rows // len(counts))
    # Of each language the rows whose hash is under its share, in one pass.
    limits = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], -(-share * _STEPS // r["count"]))))
    parts = own.filter(F.col("h") < F.coalesce(F.try_element_at(limits, F.col("lang")), F.lit(0))).select("lang", "text", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(features(t), return_counts=True) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([b.tolist() for b, _ in found], pa.list_(pa.int32())), pa.array([c.tolist() for _, c in found], pa.list_(pa.int32()))], ["lang", "h", "buckets", "counts"])

    sampled = parts.mapInArrow(run, "lang string, h long, buckets array<int>, counts array<int>").orderBy("h", "lang", "buckets").limit(2 * train_rows)
    rows = sorted(sampled.collect(), key=lambda r: (r["buckets"], r["lang"]))
    order = np.random.default_rng(1).permutation(len(rows))
    return fit([(rows[i]["buckets"], rows[i]["counts"]) for i in order], [rows[i]["lang"] for i in order])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected (the score is under the calibrated threshold, or the text has no letter)."""
    require(docs, "doc_id", "text")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([x == "und" or s < own.threshold for x, s in found])], ["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    """Rows of which nothing is learned: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
