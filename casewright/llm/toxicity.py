"""Toxicity by a convolutional text classifier over hashed words.

Each word has hashed embeddings of its own and of its stems (its first letters, runs of several
lengths), so unseen forms share what is known of their stems. One dimension of the embeddings starts
from how surely counting finds a bucket in toxic texts. Filters over one, two and three words are
max-pooled over the whole text, a first softmax gives the probability of toxicity and a second, on the
same features, tells the language. Thresholds are calibrated for each language that is told from the
text: the probability is bent, in two straight pieces, so that the language's own threshold lands on `CUT`.

Nulls: a null or wordless text scores as the empty text, 0. Rows without a label teach nothing; with
no label at all every score is 0. Texts of any length are scored whole, in stretches of words. Repeated rows each give a row.
Columns of docs are handed on, but for one named like the score, which is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from casewright.llm.convnet import ConvNet, pool_segments, softmax, train
from casewright.llm.language import bounded_sample, fitted_in_a_task

#: Buckets that words and stems share; with the pad they fit 16 bits.
BUCKETS = (1 << 16) - 1
#: Letters of a word's stems. A word that ends sooner is told from one that goes on.
STEMS = (4, 6, 8)
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
CUT = 0.7
#: At most this many labelled rows, and about this many bytes of their texts, are learned from, drawn by a hash of id and text.
TRAIN_ROWS = 10_000
TRAIN_BYTES = 24_000_000
#: Of the sample, the part kept from the gradient steps for the thresholds.
CALIBRATION_SHARE = 0.25
#: A language's own threshold needs this many toxic rows; others use the common one.
LEAST_TOXIC = 12
#: Rows are visited about this often in all while learning, within these limits on rounds.
TRAIN_VISITS = 40_000
EPOCHS = (3, 60)
#: Of a bucket's evidence, what its embedding starts from.
HEAD_START = 0.3
#: No threshold lies outside.
THRESHOLDS = (0.25, 0.98)
CACHE_WORDS = 100_000
_WORD = re.compile(r"\w+")
_PAD = BUCKETS
_STRETCH = 1 << 16


def word_ids(words: list[str], seen: dict[str, bytes]) -> np.ndarray:
    """(words, 1 + stems): the buckets of each word and of its stems, remembered in seen."""
    out = []
    for w in words:
        x = seen.get(w)
        if x is None:
            parts = [w, *(f"{n}^{w}" if len(w) <= n else f"{n}^{w[:n]}-" for n in STEMS)]
            x = b"".join((zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS).to_bytes(2, "little") for p in parts)
            if len(seen) >= CACHE_WORDS:
                seen.clear()
            seen[w] = x
        out.append(x)
    return np.frombuffer(b"".join(out), dtype="<u2").reshape(-1, 1 + len(STEMS))


@dataclass
class ToxicityModel:
    net: ConvNet | None  # None: nothing was learned
    thresholds: np.ndarray  # for each language
    _tables: np.ndarray | None = field(default=None, repr=False)
    _seen: dict[str, bytes] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None, "_seen": {}}  # a sixth is sent, and folded where it is used

    @property
    def empty(self) -> bool:
        return self.net is None

    @property
    def tables(self) -> np.ndarray:
        if self._tables is None:
            self._tables = np.concatenate([t for parts in self.net.tables() for t in parts], axis=1)
        return self._tables

    def chances(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, the chance of being toxic and the place of the language that each text seems to be in."""
        features = self.features(texts)
        (w, b), (language_w, language_b) = self.net.heads
        return features, softmax((features @ w + b).astype(np.float64))[:, 1], (features @ language_w + language_b).argmax(axis=1)

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.net.bias)), np.float32)
        held, starts, owner, size = [], [], [], 0
        gap = np.full((max(WIDTHS) - 1, 1 + len(STEMS)), _PAD, np.uint16)

        def flush() -> None:
            nonlocal size
            if held:
                ids = np.concatenate(held)
                pooled = pool_segments(self.tables, list(WIDTHS), FILTERS, list(ids.T), np.array(starts), _PAD)
                out[owner] = np.maximum(pooled + self.net.bias, 0)
                held.clear()
                starts.clear()
                owner.clear()
                size = 0

        for i, text in enumerate(texts):
            words = _WORD.findall((text or "").lower())
            if words:
                starts.append(size)
                owner.append(i)
                held += [word_ids(words, self._seen), gap]
                size += len(words) + len(gap)
                if size >= _STRETCH:
                    flush()
        flush()
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.empty:
            return np.zeros(len(texts))
        features, p, seems = self.chances(texts)
        at = self.thresholds[seems]
        bent = np.where(p >= at, CUT + (1 - CUT) * (p - at) / (1 - at), CUT * p / at)
        bent = np.where(p < at, np.minimum(bent, np.nextafter(CUT, 0)), np.maximum(bent, CUT))
        bent[~features.any(axis=1)] = 0.0
        return np.clip(bent, 0, 1)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap at which F1 is greatest; ties to the higher."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    i = int(f1.argmax())
    below = p[i + 1] if i + 1 < len(p) else 0.0
    return float(np.clip((p[i] + below) / 2, *THRESHOLDS))


def evidence(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """For each bucket, how surely it is found in toxic texts rather than others: the log-odds of the two shares of texts
    that hold it, less twice its standard error, 0 at least."""
    hits = [np.full(BUCKETS + 1, 0.5) for _ in range(2)]
    for ids, kind in zip(rows, y):
        hits[kind][np.unique(ids)] += 1
    clean, toxic = hits
    odds = np.log(toxic / (y == 1).sum()) - np.log(clean / (y == 0).sum())
    return np.maximum(odds - 2 * np.sqrt(1 / toxic + 1 / clean), 0).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, languages: list[str | None], seed: int = 11, head_start: float = HEAD_START) -> ToxicityModel:
    """A model from labelled texts. Their languages teach the second head and the thresholds only."""
    names = sorted({x for x in languages if x is not None}) or [""]
    seen: dict[str, bytes] = {}
    rows = [word_ids(_WORD.findall(t.lower()), seen) if _WORD.search(t) else np.empty((0, 1 + len(STEMS)), np.uint16) for t in texts]
    y = np.asarray(labels, dtype=np.int64)
    told = np.array([names.index(x) if x is not None else 0 for x in languages])
    known = np.array([x is not None for x in languages], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(None, np.zeros(0))
    held_back = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) / 2**32 < CALIBRATION_SHARE for t in texts])
    if y[~held_back].min() == y[~held_back].max() or not held_back.any():
        held_back[:] = False
    learn = np.flatnonzero(~held_back)
    net = ConvNet.fresh(BUCKETS + 1, DIM, WIDTHS, FILTERS, [2, len(names)], _PAD, seed, spread=0.02)
    # max pooling teaches few places at a time: one dimension starts from what counting tells
    net.embedding[:_PAD, 0] += head_start * evidence([rows[i] for i in learn], y[learn])[:_PAD]
    weight = np.where(y == 1, 0.5 / max(y[learn].mean(), 1e-6), 0.5 / max(1 - y[learn].mean(), 1e-6)).astype(np.float32)
    epochs = int(np.clip(TRAIN_VISITS / len(learn), *EPOCHS))
    train(net, [rows[i] for i in learn], [y[learn], told[learn]], [np.sqrt(weight[learn]), 0.3 * known[learn]], epochs=epochs, batch=16, rate=0.004, seed=seed)
    model = ToxicityModel(net, np.full(len(names), 0.5))
    judge = np.flatnonzero(held_back) if held_back.any() and y[held_back].any() else learn
    _, p, seems = model.chances([texts[i] for i in judge])
    model.thresholds[:] = best_threshold(p, y[judge])
    for k in range(len(names)):
        own = seems == k
        if y[judge][own].sum() >= LEAST_TOXIC:
            model.thresholds[k] = best_threshold(p[own], y[judge][own])
    return model


def fit_toxicity_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, seed: int = 11) -> ToxicityModel:
    """A model from a bounded sample of rows with a text and a 0/1 label."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("y"), F.col(lang_col).alias("lang")).where("text is not null and y in (0, 1)")
    sample = bounded_sample(rows, [F.col("id"), F.col("text")], train_rows, seed, F.octet_length("text"), train_bytes).select("text", "y", "lang")

    def learn(drawn: pd.DataFrame) -> ToxicityModel:
        drawn = drawn.sort_values(["text", "y", "lang"])
        languages = [None if pd.isna(x) else x for x in drawn["lang"]]
        return fit(drawn["text"].tolist(), drawn["y"].to_numpy(), languages, seed)

    return fitted_in_a_task(sample, learn)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score, in place of a column of that name; at CUT and above a text counts as toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 3 MB, whatever the input; each worker folds its own tables of 19 MB

    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()), dtype="float64")

    return docs.withColumn(out, pandas_udf(apply, DoubleType())(F.col(text_col)))
