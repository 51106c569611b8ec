"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of `WINDOW` bytes (the last one padded); every window of the
whole text goes through filters of several widths, max pooling and softmax, and the text's
probabilities are the windows' means, weighted by their bytes. The network is trained in numpy on a
bounded sample of labelled rows and sent to the tasks as a few hundred kB of weights.

Nulls: a null text, or one without a letter, is `und` with score 0. Rows with a null language or null text
teach nothing; if no row teaches, every text is `und`. Ties go to the language first in order of code point. Repeated rows each
give a row. Columns of docs are handed on, but for those named like the results, which are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from casewright.llm.convnet import ConvNet, softmax, train
from casewright.llm.tables import whole_rows

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 12
#: At most this many labelled rows, and about this many bytes of text, are learned from, drawn by a hash of id and text. Every
#: window of a row that is drawn teaches, whatever its length.
TRAIN_ROWS = 6000
TRAIN_BYTES = 4_000_000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_PAD = 256
_STRETCH = 1 << 17


def bounded_sample(rows: DataFrame, key: list[Column], most: int, seed: int, size: Column | None = None, most_bytes: float = math.inf) -> DataFrame:
    """At most `most` of rows, and about most_bytes of size (all, if fewer), drawn by a hash of key; the same rows every time.

    All rows are alike in being drawn, so where they are large fewer are drawn. Rows alike in key are told apart by nothing, and may all be
    drawn up to the bound."""
    n, total = rows.agg(F.count("*"), F.sum(F.lit(0) if size is None else size)).first()
    rate = min(1.0, most / max(n, 1), most_bytes / max(total or 0, 1))
    if rate == 1.0:
        return rows
    due = math.ceil(rate * n)
    # a little more than is due passes the first cut, so that little has to be ordered
    margin = min(1.0, (due + 6 * due**0.5 + 20) / n)
    drawn = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40))
    return rows.withColumn("_drawn", drawn).where(F.col("_drawn") <= int(margin * (1 << 40))).orderBy("_drawn").limit(due).drop("_drawn")


def fitted_in_a_task(sample: DataFrame, fit: Callable[[pd.DataFrame], Any]) -> Any:
    """What fit makes of a bounded sample, worked out in one task: the driver gets the result alone, and neither rows nor what
    learning needs."""
    names = sample.columns

    def apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(parts)
        yield pd.DataFrame({"made": [pickle.dumps(fit(pd.concat(rows) if rows else pd.DataFrame(columns=names)))]})

    made = sample.coalesce(1).mapInPandas(apply, "made binary").first()
    return fit(pd.DataFrame(columns=names)) if made is None else pickle.loads(made[0])  # no partition, no task


@dataclass
class LanguageModel:
    languages: list[str]
    first: np.ndarray  # what each pair of bytes adds as first and second of a width
    later: np.ndarray  # ... as third and fourth
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities of (windows, WINDOW) byte codes."""
        n, size = codes.shape
        wide = np.full((n, size + 3), _PAD, np.int32)
        wide[:, :size] = codes
        pairs = wide[:, :-1] * 257 + wide[:, 1:]
        conv = self.first[pairs[:, :size]]
        conv += self.later[pairs[:, 2:]]
        conv[codes == _PAD] = -np.inf  # no filter begins after the text's end
        features = np.maximum(conv.max(axis=1) + self.bias, 0)
        p = softmax(features @ self.weights + self.offset)
        return np.log(np.maximum(p, 1e-9))

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        total = np.zeros((len(texts), len(self.languages)))
        size = np.zeros(len(texts))
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        waiting = 0

        def flush() -> None:
            nonlocal waiting
            if held:
                codes, of = np.concatenate(held), np.concatenate(owner)
                n = (codes != _PAD).sum(axis=1)
                p = np.exp(self.windows(codes)) * n[:, None]
                np.add.at(total, of, p)
                np.add.at(size, of, n)
                held.clear()
                owner.clear()
                waiting = 0

        step = _STRETCH // WINDOW * WINDOW
        for i, text in enumerate(texts):
            if text is None or not _LETTER.search(text):
                continue
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            for a in range(0, len(data), step):
                codes = byte_windows(data[a : a + step])
                held.append(codes)
                owner.append(np.full(len(codes), i))
                waiting += codes.size
                if waiting >= _STRETCH:
                    flush()
        flush()
        for i in np.flatnonzero(size):
            p = total[i] / size[i]
            best = int(p.argmax())
            names[i], scores[i] = self.languages[best], float(min(1.0, p[best]))
        return names, scores


def byte_windows(data: np.ndarray) -> np.ndarray:
    n = -(-len(data) // WINDOW)
    codes = np.full(n * WINDOW, _PAD, np.int32)
    codes[: len(data)] = data
    return codes.reshape(n, WINDOW)


def folded(net: ConvNet, languages: list[str]) -> LanguageModel:
    """Tables over byte pairs: one look-up stands for two places of every width."""
    parts = net.tables()
    blank = np.zeros_like(parts[0][0])
    place = lambda j: [t[j] if j < len(t) else blank for t in parts]
    both = lambda a, b: np.concatenate([(x[:, None, :] + y[None, :, :]).reshape(-1, x.shape[1]) for x, y in zip(place(a), place(b))], axis=1)
    (weights, offset), *_ = net.heads
    return LanguageModel(languages, both(0, 1).astype(np.float32), both(2, 3).astype(np.float32), net.bias, weights, offset)


def fit_windows(texts: list[str], labels: list[str], seed: int = 7, epochs: int = 4) -> tuple[ConvNet | None, list[str]]:
    languages = sorted(set(labels))
    codes, target = [], []
    for text, label in zip(texts, labels):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(data):
            for row in byte_windows(data):
                codes.append(row[row != _PAD][:, None])
                target.append(languages.index(label))
    if not codes:
        return None, []
    net = ConvNet.fresh(257, DIM, WIDTHS, FILTERS, [len(languages)], _PAD, seed)
    y = np.array(target)
    share = np.bincount(y, minlength=len(languages))
    balance = (len(y) / (len(languages) * np.maximum(share, 1)))[y].astype(np.float32)
    train(net, codes, [y], [np.sqrt(balance)], epochs=epochs, batch=32, rate=0.004, seed=seed)
    return net, languages


def fit_language_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, seed: int = 7) -> LanguageModel:
    """A model from a bounded sample of rows with a text and a language."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sample = bounded_sample(rows, [F.col("id"), F.col("text")], train_rows, seed, F.octet_length("text"), train_bytes).toPandas().sort_values(["lang", "text"])
    sample = sample[np.array([bool(_LETTER.search(t)) for t in sample["text"]], dtype=bool)]
    net, languages = fit_windows(sample["text"].tolist(), sample["lang"].tolist(), seed)
    if net is None:
        return LanguageModel([], *[np.zeros((0, 0), np.float32)] * 5)
    return folded(net, languages)


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 25 MB of tables at most, whatever the input

    def apply(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.classify(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    found = whole_rows(docs.drop("lang_pred", "score"), pandas_udf(apply, kind)(F.col(text_col)).alias("found"))
    return found.select("row.*", "found.*")


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(F.col(id_col).cast("string")) % modulus
