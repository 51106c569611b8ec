from __future__ import annotations

import hashlib
import math
import wave
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import media as M
from casewright.llm import mixing as X
from tests.llm.edge import edge, nothing


def share_targets(sizes, weights, budget, cap):
    """The plain rule: shared by weight, none above cap times its size, what is over reshared."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), budget
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > cap * sizes[i]}
        for i in over or open_:
            targets[i] = float(cap * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left -= sum(targets[i] for i in over)
        open_ -= over
    return targets


def test_targets_fill_up_to_the_cap(spark):
    rng = np.random.default_rng(8)
    for words in ([100, 100, 100], [10, 10, 0], [], [0, 0], [7], rng.integers(0, 10**6, 700).tolist()):
        names = [f"s{i:04}" for i in range(len(words) - 1)] + [None] * bool(words)
        sources = spark.createDataFrame([(n, X_key(n), int(w), 1, 1) for n, w in zip(names, words)], "source string, key string, words long, rows long, filled long")
        found = {r.source: r for r in X.with_targets(X.weighted_sources(sources.repartition(3))).collect()}
        weights = [(5, 2, 1)[i % 3] for i in range(len(words))]
        assert [found[n].weight for n in names] == weights
        due = share_targets(words, weights, 1.5 * sum(words), 2)
        assert [found[n].target for n in names] == pytest.approx(due)


def X_key(name):
    return "" if name is None else "=" + name


def slow_tilt(sizes, due, cap=2.0):
    """The same dual by bisection."""
    c = np.array(sizes) / np.mean([s for s in sizes if s])
    low, high = -200.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.array(sizes) * np.minimum(cap, np.exp(np.minimum(mid * c, 50)))).sum() < due else (low, mid)
    return mid


def test_newton_meets_bisection(spark):
    rng = np.random.default_rng(1)
    sizes = [rng.integers(1, 900, 60).tolist(), rng.integers(1, 90, 200).tolist(), [7] * 30, [0, 1, 5000]]
    rows = [(str(s), int(v), 1) for s, vs in enumerate(sizes) for v in vs if v]
    due = {0: sum(sizes[0]) * 0.2, 1: sum(sizes[1]) * 1.9, 2: sum(sizes[2]) * 2.0, 3: sum(sizes[3]) * 0.7}
    sources = spark.createDataFrame([(str(s), sum(v), sum(x > 0 for x in v), float(due[s])) for s, v in enumerate(sizes)], "key string, words long, filled long, target double")
    found = {int(r.key): r for r in X.tilts(spark.createDataFrame(rows, "key string, size long, n long"), sources).collect()}
    assert found[2].tilt is None
    for s in (0, 1, 3):
        rates = np.minimum(2, np.exp(found[s].tilt * np.array(sizes[s]) / found[s].mean))
        assert (rates * sizes[s]).sum() == pytest.approx(due[s], rel=1e-7)
        assert found[s].tilt == pytest.approx(slow_tilt(sizes[s], due[s]), rel=1e-5)


def slow_copies(units):
    """Error feedback over (size, n, rate) units row by row: a unit's rows go one after another, then those with a copy more are counted."""
    due, out = 0.0, []
    for size, n, rate in units:
        whole, more = math.floor(rate), 0
        due += (rate - whole) * size * n
        while rate > whole and size and more < n and due >= size / 2:
            due -= size
            more += 1
        out.append((whole, more))
    return out


def test_rounding_equals_a_plain_loop():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    sizes = sorted(rng.integers(0, 90, 200).tolist(), reverse=True)
    times = rng.choice([1, 1, 2, 9, 300], 200).tolist()
    rates = rng.random(200).round(3) * 2
    n = len(sizes)
    batch = pa.RecordBatch.from_pydict({c: [0] * n for c in X.UNIT} | {"key": ["a"] * n, "part": [0] * n, "size": sizes, "n": times, "rate": rates})
    found = [(w, m) for b in X.round_copies(iter([batch.slice(0, 70), batch.slice(70)])) for w, m in zip(b.column("whole").to_pylist(), b.column("more").to_pylist())]
    assert found == slow_copies(zip(sizes, times, rates))


ALIKE = {
    "null ids": [(None, 10, s) for s, n in (("a", 600), ("b", 200), ("c", 200)) for _ in range(n)],
    "one id repeated": [(1, 10, "a")] * 300 + [(i, 10 + i % 7, "a") for i in range(2, 100)] + [(i, 20, "b") for i in range(500)],
    "one-id sources": [(1, 7, "a")] * 50 + [(2, 9, "b")] * 40 + [(3, 11, None)] * 30,
    "mixed": [(None, 3 + i % 5, "a") for i in range(400)] + [(i % 9, 10 * (i % 3), "b") for i in range(300)] + [(i, 1, None) for i in range(50)],
}


@pytest.mark.parametrize(("name", "large_units"), [("null ids", 1000), ("one id repeated", 2), ("one-id sources", 1000), ("mixed", 2)])
def test_targets_are_met_where_rows_are_alike(spark, monkeypatch, name, large_units):
    monkeypatch.setattr(X, "LARGE_UNITS", large_units)
    rows = [(i, "w " * n, s, k % 4 if name == "mixed" else 0) for k, (i, n, s) in enumerate(ALIKE[name])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tag long").repartition(4)
    found = X.mix_report(docs).collect()
    assert len(found) == len(rows) and all(r.taken <= 2 * r["size"] for r in found)
    taken, target = {}, {}
    for r in found:
        taken[r.source_size, r.target] = taken.get((r.source_size, r.target), 0) + r.taken
    longest = max(n for _, n, _ in ALIKE[name])
    assert all(abs(t - due) <= longest for (_, due), t in taken.items())
    mixed = X.mix_documents(docs)
    assert mixed.columns == docs.columns
    count = lambda x: sorted(map(tuple, x.groupBy(*docs.columns).count().collect()), key=str)
    first = count(mixed)
    if name == "mixed":
        assert first == count(X.mix_documents(docs.repartition(7)))
    assert sum(len(r[1].split()) * r[4] for r in first) == sum(r.taken for r in found)
    have = {}
    for r in rows:
        have[r] = have.get(r, 0) + 1
    assert all(r[4] <= 2 * have[r[:4]] for r in first)


def test_ids_stay_exact_beside_nulls(spark):
    big = 2**53
    docs = spark.createDataFrame([(big + 1, "a b c", "s"), (None, "d e", "s"), (big + 3, "f g h i", "t"), (None, "d e", "s")], "doc_id long, text string, source string").coalesce(1)
    rows = X.mix_report(docs).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in rows) == [(0, 2), (0, 2), (big + 1, 3), (big + 3, 4)]
    copies = {}
    for r in rows:
        copies[r.doc_id, r["size"]] = copies.get((r.doc_id, r["size"]), 0) + r.copies
    kept = X.mix_documents(docs).groupBy("doc_id", "text").count().collect()
    assert {(r.doc_id, len(r.text.split())): r["count"] for r in kept} == {k: n for k, n in copies.items() if n}


def test_rows_alike_are_written_in_batches(spark, monkeypatch):
    monkeypatch.setattr(X, "REPEAT_ROWS", 7)
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", 7), ("d", 8), ("e", 50)], "x string, n long")
    assert {r.x: r["count"] for r in X.repeated(rows, F.col("n")).groupBy("x").count().collect()} == {"b": 1, "c": 7, "d": 8, "e": 50}


def test_mix_meets_targets(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"),
    )
    rows = X.mix_report(docs).collect()
    assert len(rows) == 3000
    assert sorted(rows) == sorted(X.mix_report(docs.repartition(5)).collect())
    by_target = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        by_target.setdefault((r.target, r.source_size), []).append(r.taken)
    for (target, _), taken in by_target.items():
        assert sum(taken) == pytest.approx(target, rel=0.002)
    kept = X.mix_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in kept} == {r.doc_id: r.copies for r in rows if r.copies}


def test_mix_edges(spark):
    rows = X.mix_report(edge(spark)).collect()
    assert len(rows) == 11 and sum(r["size"] for r in rows if r.doc_id == 4) == 48000
    assert all(r.taken <= 2 * r["size"] for r in rows)
    mixed = X.mix_documents(edge(spark))
    assert mixed.columns == edge(spark).columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert X.mix_report(nothing(spark)).count() == 0 and X.mix_documents(nothing(spark)).count() == 0


def test_few_long_documents_are_rounded_together(spark, monkeypatch):
    monkeypatch.setattr(X, "PART_ROWS", 100)
    i = F.col("id")
    crowd = spark.range(4000).select(i.alias("doc_id"), F.when(i % 2 == 0, "a").otherwise("b").alias("source"), F.lit(5).cast("long").alias("size"))
    books = spark.range(4000, 4060).select(i.alias("doc_id"), F.lit("c").alias("source"), F.lit(1000).cast("long").alias("size"))
    blank = spark.range(5000, 6000).select(i.alias("doc_id"), F.lit("c").alias("source"), F.lit(0).cast("long").alias("size"))
    # a large source whose few long documents lie in a crowd of short ones, at rates below 1
    mixed = spark.range(6000, 6030).select(i.alias("doc_id"), F.lit("d").alias("source"), F.lit(5000).cast("long").alias("size"))
    short = spark.range(7000, 9000).select(i.alias("doc_id"), F.lit("d").alias("source"), F.lit(1).cast("long").alias("size"))
    rows = crowd.unionAll(books).unionAll(blank).unionAll(mixed).unionAll(short)
    plan = X.plan_mix(rows, budget=0.6).collect()
    assert len(plan) == 7090
    for source, longest in (("a", 5), ("b", 5), ("c", 1000), ("d", 5000)):
        own = [r for r in plan if r.source == source]
        # the long ones end within half a document of their words due, so does each part of the short ones
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) <= longest / 2 + 25 * 5 / 2
    assert sorted(map(tuple, plan), key=str) == sorted(map(tuple, X.plan_mix(rows.repartition(7), budget=0.6).collect()), key=str)


def test_wav_holds_the_payload(spark):
    text = F.col("text")
    rows = edge(spark).select("text", M.text_to_wav(text).alias("m"), M.wav_features(M.text_to_wav(text)).alias("f"), M.pair_digest(M.wav_features(M.text_to_wav(text))).alias("d")).collect()
    seen = {}
    for r in rows:
        data = (r.text or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        with wave.open(io.BytesIO(bytes(r.m))) as w:
            assert w.readframes(w.getnframes()) == payload and w.getsampwidth() == 1
        assert r.f.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.f.media_bytes == len(r.m)
        assert seen.setdefault(payload, r.d) == r.d
        times = [p >> 32 for p in r.f.pairs]
        assert times == sorted(times)


def test_peaks_find_a_tone():
    t = np.arange(8000)
    samples = (128 + 100 * np.sin(2 * np.pi * 50 / M.FRAME * t)).astype(np.uint8).tobytes()
    n, peaks = M.spectral_peaks(samples)
    assert n == (8000 - M.FRAME) // M.HOP + 1
    assert {f for _, f in peaks if 41 <= f < 81} == {50}
    pairs = M.peak_pairs(peaks)
    assert len(pairs) and all((p & 0xFF) <= M.REACH for p in pairs)
    assert len(M.peak_pairs(np.empty((0, 2), np.int64))) == 0


def slow_peaks(samples):
    """Frames, spectra by the sum itself, peaks and pairs in plain loops."""
    x = [s - 128 for s in samples]
    n = (len(x) - M.FRAME) // M.HOP + 1
    turn = np.exp(-2j * np.pi * np.outer(np.arange(M.FRAME // 2 + 1), np.arange(M.FRAME)) / M.FRAME)
    power = [np.abs(turn @ (np.array(x[i * M.HOP : i * M.HOP + M.FRAME]) * np.hanning(M.FRAME))) ** 2 for i in range(n)]
    peaks = []
    for i in range(n):
        best = [max(range(lo, hi), key=lambda b: power[i][b]) for lo, hi in zip(M.BANDS, M.BANDS[1:])]
        mean = np.mean([math.log1p(power[i][b]) for b in best])
        for b in best:
            if math.log1p(power[i][b]) > mean and all(power[i][b] > power[k][b] for k in (i - 1, i + 1) if 0 <= k < n):
                peaks.append((i, b))
    pairs = []
    for i, b in peaks:
        later = [(j, c) for j, c in peaks if j > i][: M.FAN_OUT]
        pairs += [i << 32 | b << 20 | c << 8 | (j - i) for j, c in later if j - i <= M.REACH]
    return n, peaks, pairs


def test_peaks_and_pairs_equal_plain_loops(monkeypatch):
    rng = np.random.default_rng(2)
    for samples in (rng.integers(0, 256, 9000).astype(np.uint8).tobytes(), ("Running text of some length, again and again. " * 150).encode()[:6336]):
        n, peaks, pairs = slow_peaks(samples)
        for stretch in (2048, 7):
            monkeypatch.setattr(M, "STRETCH_FRAMES", stretch)
            got = M.spectral_peaks(samples)
            assert got[0] == n and [tuple(p) for p in got[1].tolist()] == peaks and M.peak_pairs(got[1]).tolist() == pairs
        assert pairs and all(p & 0xFF for p in pairs)


def test_a_shift_by_whole_frames_keeps_the_pairs():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, 40 * M.HOP).astype(np.uint8).tobytes()
    code = lambda s: {p & 0xFFFFFFFF for p in M.peak_pairs(M.spectral_peaks(s)[1]).tolist()}
    a, b = code(x), code(b"\x80" * (4 * M.HOP) + x)
    assert len(a & b) > 0.9 * len(a)
