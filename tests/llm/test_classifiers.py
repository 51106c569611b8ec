from __future__ import annotations

import pickle
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import convnet, language, quality, queries, toxicity
from tests.llm.edge import edge, nothing


def test_training_lowers_the_loss_that_applying_sees():
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, 9, (n, 2)) for n in (4, 7, 1)]
    y, w = np.array([0, 1, 1]), np.ones(3, np.float32)

    def fresh():
        net = convnet.ConvNet.fresh(10, 3, (1, 2), 2, [2], 9, 1)
        for i, p in enumerate(net.parameters()):
            p[...] = np.random.default_rng(i).normal(0, 0.5, p.shape)
        net.embedding[9] = 0
        return net

    def loss(net):
        tables = np.concatenate([t for parts in net.tables() for t in parts], axis=1)
        flat = np.concatenate([np.concatenate([s, [[9, 9]]]) for s in seqs])
        starts = np.cumsum([0, *[len(s) + 1 for s in seqs[:-1]]])
        f = np.maximum(convnet.pool_segments(tables, net.widths, 2, [flat[:, 0], flat[:, 1]], starts, 9, most=4) + net.bias, 0)
        p = convnet.softmax(f @ net.heads[0][0] + net.heads[0][1])
        return -np.log(p[np.arange(3), y]).mean()

    before, net = loss(fresh()), fresh()
    convnet.train(net, seqs, [y], [w], epochs=60, batch=3, rate=0.02, seed=0)
    assert loss(net) < 0.5 * before  # the pooled path and the training path are the same function


def test_gradients_are_those_of_finite_differences():
    """Both heads, weights, an empty sequence, items of two ids; in double, at points where no maximum ties."""
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 11, (n, 2)) for n in (4, 7, 1, 0, 12)]
    targets = [np.array([0, 1, 1, 0, 1]), np.array([2, 0, 1, 1, 2])]
    weights = [rng.random(5), rng.random(5)]
    net = convnet.ConvNet.fresh(12, 4, (1, 2, 3), 3, [2, 3], 11, 1)
    net.embedding, net.filters, net.bias = rng.normal(0, 0.7, (12, 4)), [rng.normal(0, 0.7, k.shape) for k in net.filters], rng.normal(0, 0.3, len(net.bias))
    net.heads = [(rng.normal(0, 0.7, w.shape), rng.normal(0, 0.3, b.shape)) for w, b in net.heads]
    net.embedding[11] = 0

    def loss() -> float:
        tables = np.concatenate([t for parts in net.tables() for t in parts], axis=1)
        flat = np.concatenate([np.concatenate([s if len(s) else np.full((1, 2), 11), np.full((2, 2), 11)]) for s in seqs])
        starts = np.cumsum([0, *[max(1, len(s)) + 2 for s in seqs[:-1]]])
        pooled = []
        for i, s in enumerate(seqs):  # a place that is all pad still counts where a text has nothing else
            rows = tables[flat[starts[i] : starts[i] + max(1, len(s)) + 2]].sum(axis=1)
            at, own = 0, []
            for k, kernel in enumerate(net.filters):
                places = [sum(rows[p + j, at + 3 * j : at + 3 * j + 3] for j in range(len(kernel))) for p in range(max(1, len(s)))]
                own.append(np.max(places, axis=0))
                at += 3 * len(kernel)
            pooled.append(np.concatenate(own))
        f = np.maximum(np.array(pooled) + net.bias, 0)
        out = 0.0
        for (w, b), y, v in zip(net.heads, targets, weights):
            out += (-np.log(convnet.softmax(f @ w + b)[np.arange(5), y]) * v).mean()
        return out

    grads, ids = convnet.gradients(net, seqs, targets, weights)
    full = np.zeros_like(net.embedding)
    full[ids] = grads[0]
    for value, grad in zip(net.parameters(), [full, *grads[1:]]):
        for at in np.ndindex(*value.shape):
            if value is net.embedding and at[0] == 11:
                continue
            kept, step = value[at], 1e-6
            value[at] = kept + step
            up = loss()
            value[at] = kept - step
            down = loss()
            value[at] = kept
            assert grad[at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_language_held_out(spark, sf_dir):
    rows = queries.op4_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    model = language.fit_language_model(edge(spark))
    rows = language.predict_language(edge(spark), model).collect()
    assert len(rows) == 11
    und = {r.doc_id: r.lang_pred for r in rows}
    assert [und[i] for i in (2, 3, 5, 8)] == ["und"] * 4 and und[1] in ("en", "de", "fr")
    empty = language.fit_language_model(nothing(spark))
    assert {r.lang_pred for r in language.predict_language(edge(spark), empty).collect()} == {"und"}
    assert language.predict_language(nothing(spark), model).count() == 0


def test_language_of_a_long_text_is_that_of_its_windows():
    texts = ["the house and the river " * 30, "der fluss und das haus " * 30]
    net, names = language.fit_windows(texts * 8, ["en", "de"] * 8, epochs=30)
    model = language.folded(net, names)
    assert model.classify([texts[0] * 300, texts[1] * 300, texts[1] * 600 + texts[0] * 100])[0] == ["en", "de", "de"]


def labelled(n=240):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        bad = i % 4 == 0
        text = " ".join(rng.choice(words, 40))
        if bad:
            text = " ".join(f"{w}$$%" for w in text.split()) + " idiotic"
        out.append((i, text, "en", int(not bad), int(bad)))
    return out


def test_quality_tells_kinds_apart(spark):
    df = spark.createDataFrame(labelled(), "doc_id long, text string, lang string, quality int, toxic int")
    model = quality.fit_quality_model(df.where("doc_id % 5 <> 0"))
    rows = quality.score_quality(df, model).where("doc_id % 5 = 0").collect()
    assert np.mean([(r.score >= quality.CUT) == r.quality for r in rows]) > 0.95


def test_quality_edges(spark):
    df = edge(spark).withColumn("quality", F.lit(1))
    one = quality.fit_quality_model(df)  # one kind of label only
    scores = [r.score for r in quality.score_quality(edge(spark), one).collect()]
    assert len(scores) == 11 and len(set(scores)) == 1 and 0 < scores[0] < 1
    none = quality.fit_quality_model(df.withColumn("quality", F.lit(None).cast("int")))
    assert all(0 <= r.score <= 1 for r in quality.score_quality(edge(spark), none).collect())
    two = quality.fit_quality_model(edge(spark).withColumn("quality", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")))
    rows = {r.doc_id: r.score for r in quality.score_quality(edge(spark), two).collect()}
    assert all(0 <= s <= 1 for s in rows.values()) and rows[2] == rows[3]
    assert quality.score_quality(nothing(spark), two).count() == 0


def test_toxicity_tells_words(spark):
    df = spark.createDataFrame(labelled(), "doc_id long, text string, lang string, quality int, toxic int")
    model = toxicity.fit_toxicity_model(df.where("doc_id % 3 <> 1"))
    rows = toxicity.score_toxicity(df, model).where("doc_id % 3 = 1").collect()
    assert np.mean([(r.score >= toxicity.CUT) == r.toxic for r in rows]) > 0.9
    again = toxicity.score_toxicity(df.repartition(7), model).where("doc_id % 3 = 1").collect()
    assert {r.doc_id: round(r.score, 4) for r in rows} == {r.doc_id: round(r.score, 4) for r in again}


def test_toxicity_edges(spark):
    labels = edge(spark).withColumn("toxic", F.when(F.col("doc_id") == 1, 1).otherwise(0))
    model = toxicity.fit_toxicity_model(labels)
    rows = {r.doc_id: r.score for r in toxicity.score_toxicity(edge(spark), model).collect()}
    assert all(0 <= s <= 1 for s in rows.values()) and rows[2] == rows[3] == 0
    empty = toxicity.fit_toxicity_model(nothing(spark).withColumn("toxic", F.lit(1)))
    assert {r.score for r in toxicity.score_toxicity(edge(spark), empty).collect()} == {0.0}
    assert toxicity.score_toxicity(nothing(spark), model).count() == 0


def test_models_are_fitted_away_from_the_driver(spark, monkeypatch):
    """No rows come to the driver, only counts and the model, which is the one that its rows give; also of a drawn sample."""
    data = labelled()
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, quality int, toxic int").repartition(5)
    texts = [t for _, t, *_ in sorted(data, key=lambda r: r[1])]
    told = {t: (q, x) for _, t, _, q, x in data}
    toxic = toxicity.fit(texts, np.array([told[t][1] for t in texts]), ["en"] * len(texts))
    good = quality.fit(texts, np.array([told[t][0] for t in texts]))
    came, frame = [], type(df)

    def collect(self, real=frame.collect):
        came.append(real(self))
        return came[-1]

    def whole(self):
        raise AssertionError("rows came to the driver")

    monkeypatch.setattr(frame, "collect", collect)
    monkeypatch.setattr(frame, "toPandas", whole)
    assert np.allclose(toxicity.fit_toxicity_model(df).score(texts), toxic.score(texts), atol=1e-4)
    assert np.allclose(quality.fit_quality_model(df).score(texts), good.score(texts), atol=1e-9)
    assert not toxicity.fit_toxicity_model(df, train_rows=100).empty and quality.fit_quality_model(df, train_rows=30).good
    assert max(len(rows) for rows in came) == 1
    sent = pickle.dumps(toxic)
    assert len(sent) < 4_000_000 and np.array_equal(pickle.loads(sent).score(texts), toxic.score(texts))


def test_threshold_lies_in_the_gap():
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.3, 0.2]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)
