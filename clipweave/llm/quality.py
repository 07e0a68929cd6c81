"""Quality scores from compression with zstandard dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import replacing, slices
from .fitting import Logistic, labelled_sample

BLOCK = 1024  # a long text is compressed in blocks, or its own words would soon count more than the dictionary
DICTIONARY = 112 * 1024
EMPTY_FRAME = 12  # bytes of a frame besides what is compressed


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    logistic: Logistic | None
    share: float  # of label 1: the score where nothing could be fitted


class _Sizes:
    """Two compressors and the sizes that they give for a text."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = (zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)) for d in (good, bad))

    def features(self, text: str | None) -> list[float]:
        """The normalised difference of the compressed sizes: of the text, and the smallest and largest of its blocks; and the share of its bytes that compression leaves."""
        data = (text or "").encode()
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)] or [b""]
        good = np.array([len(self.good.compress(b)) for b in blocks], float)
        bad = np.array([len(self.bad.compress(b)) for b in blocks], float)
        each = (bad - good) / (bad + good)
        total = (bad.sum() - good.sum()) / (bad.sum() + good.sum())
        return [total, (good.sum() - EMPTY_FRAME * len(blocks)) / (len(data) + 1), each.min(), each.max()]


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; with too few samples to train on, the samples themselves."""
    blocks = [b for t in texts for data in [t.encode()] for k in range(0, len(data), BLOCK) if len(b := data[k : k + BLOCK]) > 7]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(blocks)[-DICTIONARY:]


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000, most_bytes: int = 16384) -> QualityModel:
    """Dictionaries from half of a bounded sample of the labelled rows (see labelled_sample), calibration on the other half.

    Without texts of both labels the model scores every text with the share of label 1 (0.5 without any label).
    """
    sample = labelled_sample(docs, labels, label, per_class, most_bytes)
    share = sum(y for _, y in sample) / len(sample) if sample else 0.5
    texts = {y: [t for t, z in sample if z == y] for y in (0, 1)}
    if min(map(len, texts.values())) < 2:
        return QualityModel(b"", b"", None, share)
    learn = {y: t[::2] for y, t in texts.items()}
    rest = [(t, y) for y in (0, 1) for t in texts[y][1::2]]
    good, bad = _dictionary(learn[1]), _dictionary(learn[0])
    sizes = _Sizes(good, bad)
    x = np.array([sizes.features(t) for t, _ in rest])
    return QualityModel(good, bad, Logistic(x, np.array([y for _, y in rest], float)), share)


def quality_scores(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "quality_score") -> DataFrame:
    """docs with a score from 0 to 1 in column ``out``: how likely a text is of the good kind.

    Each whole text is compressed block by block with either dictionary. Null and empty texts get the score of an empty text; repeated
    rows, null ids and all columns stay (one that is named as ``out`` is replaced), and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = replacing(docs, [out])
    names = docs.columns
    at = names.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        sizes = _Sizes(fitted.good, fitted.bad) if fitted.logistic else None
        for batch in slices(batches, at):
            found = fitted.logistic.scores(np.array([sizes.features(t) for t in batch.column(at).to_pylist()])) if sizes else np.full(batch.num_rows, fitted.share)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*names, out])

    return docs.mapInArrow(score, docs.select("*", F.lit(0.0).alias(out)).schema)
