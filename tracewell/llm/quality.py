"""Quality of texts by compression: how much better a dictionary of good text serves than one of bad text.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A whole text is compressed
in pieces, each with either dictionary; the difference of the two sizes and the size under the good one, both
by byte of text, are turned into a probability by a logistic fit on other labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.storage import materialize

#: Characters of a piece, bytes of a dictionary, and the compression level.
PIECE, DICTIONARY, LEVEL = 1024, 112 << 10, 3


@dataclass
class Model:
    """Two dictionaries and a logistic function; of bounded size, whatever the corpus."""

    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the constant first


def pieces(text: str) -> list[bytes]:
    return [text[i:i + PIECE].encode() for i in range(0, len(text), PIECE)]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.compress = [self.compressor(d) for d in (model.good, model.bad)]

    @staticmethod
    def compressor(dictionary: bytes):
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False).compress

    def features(self, text: str | None) -> tuple[float, float]:
        """Bytes saved by the good dictionary against the bad one, and bytes left by the good one, per byte."""
        good = bad = size = 0
        for piece in pieces(text or ""):
            good += len(self.compress[0](piece))
            bad += len(self.compress[1](piece))
            size += len(piece)
        return (bad - good) / max(size, 1), good / max(size, 1)

    def scores(self, texts) -> np.ndarray:
        found = np.array([self.features(t) for t in texts]).reshape(-1, 2)
        x = np.c_[np.ones(len(found)), (found - self.model.mean) / self.model.scale] @ self.model.weights
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of very few samples, which the trainer refuses, their text itself; of none, none."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of ``x``, and the weights of a slightly damped logistic regression by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.c_[np.ones(len(x)), (x - mean) / scale]
    found, damp = np.zeros(design.shape[1]), 1e-4 * weight.sum() * np.eye(design.shape[1])
    damp[0, 0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ found, -30, 30)))
        curve = design.T @ (design * (weight * (p * (1 - p) + 1e-6))[:, None]) + damp
        found = found + np.linalg.solve(curve, design.T @ (weight * (y - p)) - damp @ found)
    return mean, scale, found


def held_out(doc: str = "doc_id"):
    """Whether a row is kept from learning: a third of all, by the CRC of the id."""
    return F.coalesce(F.crc32(F.col(f"`{doc}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality",
        max_docs: int = 4000, max_pieces: int = 4000) -> Model | None:
    """Learns from at most ``max_docs`` labelled documents of either class that are not held out.

    Half of them, by a hash of the id, give at most ``max_pieces`` pieces a class to the dictionaries, the
    others the logistic fit, in which classes weigh as among all labels. The choice depends on hashes alone.
    Labels other than 0 and 1 and rows without an id are left out; of several labels of an id the lowest counts.
    None if a class has no labelled document.
    """
    known = labels.where(~held_out(doc)).where(F.col(label).isin(0, 1) & F.col(doc).isNotNull()).groupBy(
        F.col(doc).alias("_doc")).agg(F.min(label).cast("int").alias("_label"))
    totals = dict(known.groupBy("_label").count().collect())
    chosen = known.where("_label = 1").orderBy(F.xxhash64("_doc"), "_doc").limit(max_docs).unionByName(
        known.where("_label = 0").orderBy(F.xxhash64("_doc"), "_doc").limit(max_docs))
    # At most 2 * max_docs ids, so the broadcast is bounded.
    sample = materialize(docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).dropna().join(
        F.broadcast(chosen), "_doc").withColumn("_half", F.pmod(F.xxhash64("_doc", F.lit(7)), F.lit(2))), "sample")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, t, y in zip(batch["_doc"], batch["_text"], batch["_label"], strict=True):
                own = pieces(t)
                yield pd.DataFrame({"doc": d, "at": range(len(own)), "piece": own, "label": y})

    cuts = sample.where("_half = 0").select("_doc", "_text", "_label").mapInPandas(
        cut, "doc long, at int, piece binary, label int")
    samples = [[bytes(r[0]) for r in cuts.where(f"label = {y}").orderBy(
        F.xxhash64("doc", "at"), "doc", "at").limit(max_pieces).select("piece").collect()] for y in (1, 0)]
    model = Model(*map(dictionary, samples), np.zeros(2), np.ones(2), np.zeros(3))
    rest = featured(sample.where("_half = 1"), model, "_text").select("_label", "f.saved", "f.left").collect()
    y = np.array([r[0] for r in rest], float)
    if not all(samples) or len(set(y)) < 2:
        return None
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (len(y) - y.sum()))
    model.mean, model.scale, model.weights = logistic(
        np.array([r[1:] for r in rest]), y, weight * len(y) / weight.sum())
    return model


def featured(df: DataFrame, model: Model, text: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("saved double, left double")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame([scorer.features(t) for t in texts], columns=["saved", "left"], dtype=float)

    return df.withColumn("f", features(text))


def scored(df: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """Adds the probability that a text is good, from the whole text alone; it replaces a column of that name.

    Null and empty texts are scored as a text that neither dictionary changes. Without a model every score
    is 0.5. Equal texts get equal scores, an empty table gives no rows, and a very long text is compressed as a whole.
    """
    if model is None:
        return df.withColumn(score, F.lit(0.5))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer.scores(texts))

    return df.withColumn(score, scores(F.col(f"`{text}`").cast("string")))
