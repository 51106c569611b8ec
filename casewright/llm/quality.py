"""Quality by compression with two zstandard dictionaries.

One dictionary is built from good labelled texts, one from bad ones. A text is compressed in blocks with either;
the difference of the compressed sizes over their sum tells which kind it is like. A logistic
curve fitted on labelled rows outside the dictionaries turns it into a score; the curve also sees the
compressed share of the text, as text that repeats itself is small with either dictionary. Blocks keep the
dictionaries' pull on a long text as strong as on a short one.

Nulls: a null text scores as an empty one, by the curve at difference 0 and the labelled texts' mean share. Rows without a label teach nothing; with
labels of one kind only, that kind's share is everybody's score. Texts of any length are compressed whole, block by block. Repeated
rows each give a row. Columns of docs are handed on, but for one named like the score, which is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from casewright.llm.language import bounded_sample, fitted_in_a_task

CUT = 0.3
LEVEL = 3
BLOCK_BYTES = 2048
DICTIONARY_BYTES = 96 * 1024
#: At most this many labelled rows of each kind, and about this many bytes of their texts, are learned from, drawn by a hash of id and text.
TRAIN_ROWS = 6000
TRAIN_BYTES = 16_000_000
#: Of the sample, the part kept from the dictionaries for the curve.
CALIBRATION_SHARE = 0.4


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    curve: np.ndarray  # weights of (1, difference, share, share squared), each measured from mean in units of spread
    mean: np.ndarray
    spread: np.ndarray
    _tools: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None}

    def measures(self, text: str | None) -> tuple[float, float]:
        """(size with the bad dictionary - size with the good one) / their sum, and their mean over the text's size."""
        if not self.good or not self.bad or not text:
            return 0.0, np.nan
        if self._tools is None:
            options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
            self._tools = tuple(zstandard.ZstdCompressor(dict_data=_loaded(d), **options) for d in (self.good, self.bad))
        data = text.encode("utf-8", "surrogatepass")
        a, b = (sum(len(tool.compress(data[i : i + BLOCK_BYTES])) for i in range(0, len(data), BLOCK_BYTES)) for tool in self._tools)
        return (b - a) / (b + a), (a + b) / (2 * len(data))

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = (expanded(np.array([self.measures(t) for t in texts]).reshape(-1, 2)) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + np.nan_to_num(x) @ self.curve[1:], -40, 40)))


def expanded(measures: np.ndarray) -> np.ndarray:
    share = np.minimum(measures[:, 1], 1.0)
    return np.column_stack([measures[:, 0], share, share * share])


def _loaded(data: bytes) -> zstandard.ZstdCompressionDict:
    made = zstandard.ZstdCompressionDict(data)
    made.precompute_compress(level=LEVEL)
    return made


def dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; the texts themselves where there are too few to train on."""
    samples = [s for t in texts for data in [t.encode("utf-8", "surrogatepass")] for s in (data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES))]
    joined = b"".join(samples)
    if len(samples) >= 50 and len(joined) >= 4 * size:
        return zstandard.train_dictionary(size, samples).as_bytes()
    return joined[-size:]


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Weights of the logistic curve, the constant first, by Newton steps with a slight pull to 0."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pull = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.05
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ w)
        w -= np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-10:
            break
    return w


def fit(texts: list[str], labels: np.ndarray) -> QualityModel:
    y = np.asarray(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(b"", b"", np.array([np.log(share / (1 - share)), 0, 0, 0]), np.zeros(3), np.ones(3))
    for_curve = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) / 2**32 < CALIBRATION_SHARE for t in texts])
    if not len(set(y[for_curve])) == len(set(y[~for_curve])) == 2:
        for_curve = np.arange(len(y)) % 2 == 0
    if not len(set(y[~for_curve])) == 2:
        for_curve[:] = False
    model = QualityModel(*(dictionary([t for t, k, c in zip(texts, y, for_curve) if k == kind and not c]) for kind in (1, 0)), np.zeros(4), np.zeros(3), np.ones(3))
    judge = np.flatnonzero(for_curve) if len(set(y[for_curve])) == 2 else np.arange(len(y))
    x = expanded(np.array([model.measures(texts[i]) for i in judge]))
    told = ~np.isnan(x).any(axis=1)
    if told.any():
        model.mean, model.spread = x[told].mean(axis=0), np.maximum(x[told].std(axis=0), 1e-9)
        model.curve = fit_curve((x[told] - model.mean) / model.spread, y[judge][told])
    return model


def fit_quality_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, seed: int = 5) -> QualityModel:
    """A model from a bounded sample, of each kind, of rows with a text and a 0/1 label.

    The curve is fitted on the rows as they were drawn: kinds drawn at different rates are set right
    by the logarithm of the rates."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y")).where("text is not null and y in (0, 1)")
    kinds, sizes = [], []
    for kind in (0, 1):
        own = rows.where(F.col("y") == kind)
        kinds.append(bounded_sample(own, [F.col("id"), F.col("text")], train_rows, seed, F.octet_length("text"), train_bytes).select("text", "y"))
        sizes.append(own.count())

    def learn(drawn: pd.DataFrame) -> QualityModel:
        drawn = drawn.sort_values(["text", "y"])
        model = fit(drawn["text"].tolist(), drawn["y"].to_numpy())
        rates = [(drawn["y"] == kind).sum() / n if n else 1.0 for kind, n in enumerate(sizes)]
        model.curve[0] += float(np.log(rates[0] / rates[1]))
        return model

    return fitted_in_a_task(kinds[0].unionAll(kinds[1]), learn)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score, in place of a column of that name; below CUT a text counts as bad."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries, about 200 kB

    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()), dtype="float64")

    return docs.withColumn(out, pandas_udf(apply, DoubleType())(F.col(text_col)))
