from __future__ import annotations

import random
import re

import numpy as np
import pytest

from casewright.llm import jaccard as J
from casewright.llm import queries
from casewright.llm.simhash import joined_words
from tests.compare import spark_rows, sql_rows
from tests.llm.edge import edge, nothing


def brute(rows) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by all pairs of sets of shingles."""
    sets = []
    for _, text in rows:
        words = joined_words(text).split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def test_words_hash_as_a_pattern_cuts_them():
    """Words of all lengths, by steps of eight bytes, against words cut by the contract's pattern."""
    rng, seen = random.Random(3), {}
    for _ in range(1000):
        text = "".join(rng.choice("aAbBzZé\x0b\x0c\x1c\x85  \t\n\rx") * rng.choice([1, 1, 1, 9, 70]) for _ in range(rng.randrange(60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        hashes = J.word_hashes(text.encode()).tolist()
        assert len(words) == len(hashes)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes))
    assert len(set(seen.values())) == len(seen) and max(map(len, seen)) > J.LONG_WORD


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def varied(seed: int, n: int, families: int, passage: int = 40) -> list[tuple]:
    """Texts in families of near copies at all distances, some with one passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(passage)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 6, 12, 40, 120, 300]))] for _ in range(families)]
    rows = []
    for i in range(n):
        text = list(bases[int(families * rng.random() ** 2)])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.2:
            text = text[: rng.randrange(len(text)) + 1]
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            text[at:at] = shared
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("seed", "families"), [(1, 60), (2, 5)])
def test_components_are_those_of_all_pairs(spark, seed, families):
    rows = varied(seed, 400, families)
    assert got(J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)


def test_large_tiles_bands_and_common_shingles(spark, monkeypatch):
    rows = varied(3, 300, 12, passage=60)
    for name, value in (("SMALL_TILE", 3), ("CHUNK_ROWS", 8), ("COMMON_FROM", 10), ("COMMON_KEPT", 50), ("GATHERED", 500), ("FILTER_WORDS", 4)):
        monkeypatch.setattr(J, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(J.common_shingles(df, "text").shingles) == 50
    monkeypatch.setattr(J, "NAMED", 1)
    assert got(J.jaccard_components(df)) == brute(rows)
    # proposals find nothing, so that everything rests on the bands
    monkeypatch.setattr(J, "best_pairs", lambda pairs: pairs.select("a", "b").where("false"))
    assert got(J.jaccard_components(df)) == brute(rows)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    common = J.Common(pool[:300], rng.integers(64, 1000, 300))
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.choice(pool, n))
        b = np.unique(np.concatenate([rng.choice(a, int(len(a) * rng.uniform(0.7, 1)), replace=False), rng.choice(pool, int(rng.integers(0, 1 + n // 5)))]))
        together = len(np.intersect1d(a, b))
        if len(b) and 100 * together >= 80 * len(np.union1d(a, b)):
            assert together >= J.overlap_needed(len(a), len(b))
            (p, _), (q, _) = common.prefix(a), common.prefix(b)
            shared = [t for t in p if t in set(q.tolist())]
            assert shared
            i, j = p.tolist().index(shared[0]), q.tolist().index(shared[0])
            assert J._possible(len(a), i, len(b), j)


def test_bitmaps_bound_overlap():
    rng = np.random.default_rng(6)
    for _ in range(100):
        pool = rng.integers(0, 1 << 62, 500).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 400)))) for _ in range(2))
        wide = [J.bitmap(x, 512)[None] for x in (a, b)]
        for bits in (512, 128):
            x, y = (J.folded(m, bits) for m in wide)
            assert (x == J.bitmap(a, bits)).all()
            bound = min(len(a) - np.bitwise_count(x & ~y).sum(), len(b) - np.bitwise_count(y & ~x).sum())
            assert bound >= len(np.intersect1d(a, b))


def test_common_counts_are_sure(monkeypatch):
    monkeypatch.setattr(J, "COMMON_KEPT", 10)
    rng = np.random.default_rng(7)
    values, counts, all_ = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    for _ in range(30):
        more = rng.zipf(1.5, 200).astype(np.uint64)
        all_.append(more)
        values, counts = J._fold(values, counts, [more])
    seen, true = np.unique(np.concatenate(all_), return_counts=True)
    assert set(seen[true > sum(map(len, all_)) / 10]) <= set(values.tolist()) and len(values) <= 10


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in edge(spark).collect()]
    assert got(J.jaccard_components(edge(spark))) == brute(rows)
    assert got(J.jaccard_components(nothing(spark))) == []
    blank = spark.createDataFrame([(1, ""), (2, None), (None, " ")], "doc_id long, text string")
    assert got(J.jaccard_components(blank)) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]


def test_query_against_sql(spark, sf_dir):
    names, expected = sql_rows(queries.ORACLE["op11_jaccard_join"], sf_dir)
    df = queries.op11_jaccard_join(spark, sf_dir)
    assert sorted(df.columns) == names and spark_rows(df) == expected
    assert len({r[0] for r in expected}) < len(expected)


def test_a_task_has_one_python_step(spark, monkeypatch):
    """No table is written by a task that holds two Python workers at once: each keeps its memory while the executor lives."""
    rows = [(i, " ".join(f"w{k + i // 3}" for k in range(60 + i % 3))) for i in range(30)]
    steps = {}

    def noted(df, label, real=J.materialise):
        plan = df._jdf.queryExecution().executedPlan().toString()
        steps.setdefault(label, []).extend(len(re.findall("ArrowEvalPython|MapInArrow|MapInPandas", part)) for part in plan.split("Exchange hashpartitioning"))
        return real(df, label)

    monkeypatch.setattr(J, "materialise", noted)
    J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # of the texts, the join's other side takes the second step, in a task of its own
    assert max(steps["jaccard-sets"]) == 1 and {label for label, found in steps.items() if max(found) > 1} <= {"jaccard-texts"}
