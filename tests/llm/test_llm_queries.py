"""Every registered query at the smallest size, and the models against plain loops."""

from __future__ import annotations

import hashlib
import io
import math
import re
import wave
import zlib

import numpy as np
import pytest
import zstandard

from casewright.llm import convnet, language, quality, queries, toxicity
from tests.llm.test_mixing_media import share_targets


def rows(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_mix(spark, sf_dir):
    docs = {r.doc_id: r for r in rows(spark, sf_dir, "documents")}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    names = sorted({d.source for d in docs.values() if d.source is not None}) + [None] * any(d.source is None for d in docs.values())
    words = [sum(size[i] for i, d in docs.items() if d.source == n) for n in names]
    due = dict(zip(names, share_targets(words, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(words), 2)))
    found = queries.op1_entropy_mix(spark, sf_dir).collect()
    assert len(found) == len(docs)
    taken = dict.fromkeys(names, 0)
    for r in found:
        n = docs[r.doc_id].source
        assert r["size"] == size[r.doc_id] and r.taken <= 2 * r["size"] and r.target == pytest.approx(due[n]) and r.source_size == words[names.index(n)]
        taken[n] += r.taken
    for n in names:
        longest = max(size[i] for i, d in docs.items() if d.source == n)
        assert abs(taken[n] - due[n]) <= max(longest, 0.01 * due[n])


def test_media(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in rows(spark, sf_dir, "documents")}
    for r in queries.op2_media_columns(spark, sf_dir).collect():
        data = texts[r.doc_id]
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        held = io.BytesIO()
        with wave.open(held, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(payload)
        media = held.getvalue()
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        assert r.feature


def test_token_counts_and_packing(spark, sf_dir):
    counts = {r.doc_id: r.n_tokens for r in queries.op3_separator_scan(spark, sf_dir).collect()}
    pieces = {}
    for r in queries.op5_vector_packing(spark, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(counts) == set(pieces) == {r.doc_id for r in rows(spark, sf_dir, "documents")}
    for i, own in pieces.items():
        assert sum(n for _, n, _ in own) == counts[i] + 1 == own[0][2]


def test_fingerprints(spark, sf_dir):
    found = queries.op6_simhash_components(spark, sf_dir).collect()
    least = {}
    for r in found:
        assert re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id
        least.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(s) == 1 for s in least.values())


@pytest.mark.parametrize(("query", "modulus", "held", "cut"), [(queries.op8_quality, 5, 0, quality.CUT), (queries.op10_toxicity, 3, 1, toxicity.CUT)])
def test_scores(spark, sf_dir, query, modulus, held, cut):
    found = query(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in rows(spark, sf_dir, "documents"))
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= cut) and r.held_out == (crc(r.doc_id) % modulus == held)


def slow_softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def slow_features(net, items):
    """Pooled features of one sequence of id tuples; no filter begins after its end."""
    vectors = [sum(net.embedding[i].astype(float) for i in ids) for ids in items]
    out = []
    for kernel in net.filters:
        places = [sum(vectors[at + j] @ kernel[j].astype(float) for j in range(len(kernel)) if at + j < len(vectors)) for at in range(len(vectors))]
        out += np.max(places, axis=0).tolist()
    return np.maximum(np.array(out) + net.bias, 0)


def test_language_equals_a_plain_loop():
    texts = ["the house and the river " * 20, "der fluß und das haus " * 20, "le fleuve et la maison été " * 20]
    net, names = language.fit_windows(texts * 4, ["en", "de", "fr"] * 4, epochs=2)
    model = language.folded(net, names)
    for text in (texts[0] + texts[1], "a", "été " * 90, texts[2] * 40):
        data, total = text.encode(), np.zeros(3)
        for at in range(0, len(data), language.WINDOW):
            part = data[at : at + language.WINDOW]
            f = slow_features(net, [(b,) for b in part])
            total += len(part) * np.array(slow_softmax((f @ net.heads[0][0] + net.heads[0][1]).tolist()))
        (name,), (score,) = model.classify([text])
        assert name == names[int(total.argmax())] and score == pytest.approx(total.max() / len(data), rel=1e-3)


def test_pooled_tables_equal_a_plain_loop():
    rng = np.random.default_rng(4)
    net = convnet.ConvNet.fresh(50, 4, (1, 2, 3), 3, [2], 49, 5)
    seqs = [rng.integers(0, 49, (n, 2)) for n in (1, 2, 9, 40)]
    gap = np.full((2, 2), 49)
    flat, starts = np.concatenate([x for s in seqs for x in (s, gap)]), np.cumsum([0, *[len(s) + 2 for s in seqs[:-1]]])
    tables = np.concatenate([t for parts in net.tables() for t in parts], axis=1)
    for most in (1 << 16, 5):
        pooled = convnet.pool_segments(tables, net.widths, 3, [flat[:, 0], flat[:, 1]], starts, 49, most=most)
        for got, seq in zip(np.maximum(pooled + net.bias, 0), seqs):
            assert got == pytest.approx(slow_features(net, [tuple(x) for x in seq]), rel=1e-3, abs=1e-5)


def test_toxicity_scores_equal_a_plain_loop():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words, 30)) + (" vile wretch" if i % 3 == 0 else "") for i in range(90)]
    model = toxicity.fit(texts, np.array([i % 3 == 0 for i in range(90)]), ["en", "de", None] * 30)
    for text in (texts[0], texts[1], "vile", "w1 " * 70_000 + "vile wretch"):
        ids = toxicity.word_ids(re.findall(r"\w+", text.lower()), {})
        rows_ = model.tables[ids].sum(axis=1)
        features, at = [], 0
        for w in toxicity.WIDTHS:
            conv = np.zeros((len(rows_), toxicity.FILTERS))
            for j in range(w):
                own = rows_[j:, at + j * toxicity.FILTERS : at + (j + 1) * toxicity.FILTERS]
                conv[: len(own)] += own
            at += w * toxicity.FILTERS
            features += conv.max(axis=0).tolist()
        f = np.maximum(np.array(features) + model.bias, 0)
        p = slow_softmax((f @ model.head[0] + model.head[1]).tolist())[1]
        t = model.thresholds[int((f @ model.language_head[0] + model.language_head[1]).argmax())]
        want = toxicity.CUT + (1 - toxicity.CUT) * (p - t) / (1 - t) if p >= t else toxicity.CUT * p / t
        assert model.score([text])[0] == pytest.approx(want, abs=1e-3)


def test_quality_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 60)) for _ in range(80)]
    bad = [" ".join(rng.choice(["$$$", "buy!!", "###", "now%%"], 60)) for _ in range(80)]
    model = quality.fit(good + bad, np.array([1] * 80 + [0] * 80))
    for text in (good[0], bad[0], good[1] + bad[1], good[2] * 40, ""):
        data, sizes = text.encode(), []
        for d in (model.good, model.bad):
            tool = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(tool.compress(data[i : i + 2048])) for i in range(0, len(data), 2048)))
        a, b = sizes
        share = min((a + b) / (2 * len(data)), 1) if data else None
        x = [(v - m) / s for v, m, s in zip(((b - a) / (a + b), share, share * share) if data else (0, 0, 0), model.mean, model.spread)]
        if not data:
            x = [(0 - model.mean[0]) / model.spread[0], 0, 0]
        z = model.curve[0] + sum(w * v for w, v in zip(model.curve[1:], x))
        assert model.score([text])[0] == pytest.approx(1 / (1 + math.exp(-z)), abs=0.02)


def test_quality_scores_are_calibrated():
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for i in range(1200):
        share = rng.random()
        w = [rng.choice(["alpha", "beta", "gamma"]) if rng.random() < share else rng.choice(["$$", "!!", "%%"]) for _ in range(60)]
        texts.append(" ".join(w))
        labels.append(int(rng.random() < share))
    model = quality.fit(texts[:900], np.array(labels[:900]))
    s, y = model.score(texts[900:]), np.array(labels[900:])
    for low, high in ((0, 0.4), (0.4, 0.6), (0.6, 1.01)):
        own = (s >= low) & (s < high)
        assert own.sum() > 20 and abs(s[own].mean() - y[own].mean()) < 0.15


def test_a_bounded_draw_is_ordered_and_whole(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("t"))
    key = [F.col("k"), F.col("t")]
    drawn = language.bounded_sample(df, key, 100, 1)
    assert drawn.count() == 100 and sorted(map(str, drawn.collect())) == sorted(map(str, language.bounded_sample(df.repartition(7), key, 100, 1).collect()))
    few = language.bounded_sample(df, key, 10**6, 1, F.octet_length("t"), 5000).collect()
    assert 100 < len(few) < 320 and max(len(r.t) for r in few) > 40
    assert language.bounded_sample(df, key, 10**6, 1).count() == 3000 and language.bounded_sample(df.limit(0), key, 5, 1).count() == 0
