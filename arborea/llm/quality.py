"""Quality by compression: a text that a dictionary of good texts compresses better than one of bad texts is good.

Learning uses a bounded sample of labelled rows (``SAMPLE`` of each label, those with the smallest hash of doc_id, of at
most ``MOST_CHARS`` characters each) and never a row that is held out: crc32 of doc_id as text, modulo 3, is 1. Half of
it builds the two zstandard dictionaries, the other half calibrates: a logistic curve over the normalised
difference of the compressed sizes alone, weighted so that the labels have the shares of all labelled rows. Labels,
language, source and doc_id are no inputs of a score.

Scoring compresses each whole text with either dictionary, where the text lies: no shuffle. A text is compressed in
pieces of ``PIECE`` bytes, each on its own, so that the dictionary and not the text before is what a piece is compared with,
however long the text is; the difference of the sums is divided by the length of the text.

Defined cases: a null text counts as empty; an empty text has the difference 0 and is scored like any other; very long texts
are scored whole, piece by piece; texts with equal differences have equal scores; without labels of both kinds in either half
every score is the share of label 1 (one half without labels); repeated rows each get a row, and of repeated labelled rows the
smallest text teaches; a null doc_id isn't held out; other columns, whatever their names, are not looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches

#: Labelled rows of each label, their longest text, bytes of a piece and of a dictionary, zstandard's level.
SAMPLE, MOST_CHARS, PIECE, DICTIONARY, LEVEL = 2000, 20_000, 512, 112_640, 3


@dataclass(frozen=True)
class Model:
    """Dictionaries of good and bad text, and the curve from the difference to a score: offset and slope, or a constant."""

    good: bytes
    bad: bytes
    share: float
    curve: tuple[float, float] | None = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.share)
        z = self.curve[0] + self.curve[1] * differences(texts, self.good, self.bad)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes):
    out = []
    for raw in (good, bad):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL))
    return out


def pieces(text: bytes) -> list[bytes]:
    return [text[a : a + PIECE] for a in range(0, len(text), PIECE)]


def differences(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Of each text: how many bytes less the dictionary of good text makes of it than that of bad text, by its length."""
    g, b = _compressors(good, bad)
    return np.array([sum(len(b.compress(x)) - len(g.compress(x)) for x in pieces(t)) / max(1, len(t)) for t in texts], float)


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary of the texts' pieces, or the texts themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, [x for t in texts for x in pieces(t) if len(x) > 8]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY:] or b"-" * 8


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Offset and slope of a logistic curve with a small ridge, by Newton's method; weight: of each row, their mean is 1."""
    scale = float(x.std()) or 1.0
    x, w, ridge = np.c_[np.ones(len(x)), x / scale], np.zeros(2), np.array([1e-6, 1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1] / scale)


def fit(labelled: list[tuple[int, int, str | None]], share: float | None = None) -> Model:
    """labelled: a number that halves the rows, the label, the text; share: of label 1 among all labelled rows."""
    rows = [(n % 2, y, (t or "").encode("utf-8", "surrogatepass")) for n, y, t in labelled]
    share = float(np.mean([y for _, y, _ in rows])) if share is None and rows else 0.5 if share is None else share
    if not all(any(r[:2] == (h, y) for r in rows) for h in (0, 1) for y in (0, 1)):
        return Model(b"", b"", share)
    good, bad = (dictionary([t for h, y, t in rows if h == 0 and y == label]) for label in (1, 0))
    other = [(y, t) for h, y, t in rows if h == 1]
    y = np.array([y for y, _ in other], float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(good, bad, share, _logistic(differences([t for _, t in other], good, bad), y, weight))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits the model to a sample of the labelled rows of ``docs`` that aren't held out."""
    bounded_batches(docs)
    key = F.col("doc_id")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(key.isNotNull() & F.col("quality").isin(0, 1) & ~held_out(key))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = known.agg(F.avg("quality")).first()[0]
    some = [known.filter(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    chosen = some[0].unionByName(some[1])
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.coalesce(F.length("text"), F.lit(0)) <= MOST_CHARS)
    # one row a chosen doc_id, so at most 2 * SAMPLE
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows = sorted((r.doc_id, r.quality, r.text) for r in rows)
    return fit([(i, y, t) for i, (_, y, t) in enumerate(rows)], share)


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    bounded_batches(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            found = []
            for a in range(0, batch.num_rows, 256):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").slice(a, 256).to_pylist()]
                found.append(model.scores(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found) if found else [], pa.float64())], schema=schema)

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = src.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_column(model: Model):
    """The score as a column function of the text, for filters."""

    def run(texts):
        import pandas as pd

        # one text at a time: memory for one
        return pd.Series([model.scores([(t or "").encode("utf-8", "surrogatepass")])[0] for t in texts], dtype="float64")

    return F.pandas_udf(run, "double")
