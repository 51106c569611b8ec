from __future__ import annotations

import itertools
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewright.llm import jaccard as J
from casewright.llm import simhash as S
from tests.llm.edge import edge, nothing


def slow_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBÉ ß\t\n\x0b\x1f xyz", max_size=120))
def test_fingerprint_equals_definition(text):
    assert S.simhash(text) % (1 << 64) == slow_print(text)


def slow_components(ids, prints, radius=3):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin((prints[i] ^ prints[j]) % (1 << 64)).count("1") <= radius:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min((x for x in groups[find(k)] if x is not None), default=None) for k, i in enumerate(ids)}


def planted(rng, n, groups):
    base = [int(x) for x in rng.integers(0, 1 << 62, n)]
    for _ in range(groups):
        x = base[int(rng.integers(0, n))]
        for _ in range(6):
            for b in rng.integers(0, 62, int(rng.integers(1, 4))):
                x ^= 1 << int(b)
            base.append(x)
    return sorted(set(base))


def test_links_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(5)
    prints = planted(rng, 300, 12)
    for cell_rows in (4096, 8):  # whole cells, and cells cut into chunks
        classes = spark.createDataFrame([(p,) for p in prints], "print long")
        found = S.star_components(S.near_links(classes, cell_rows=cell_rows)).collect()
        root = {r.node: r.root for r in found}
        want = slow_components(prints, prints)
        got = {p: root.get(p, p) for p in prints}
        assert {p: min(q for q in prints if got[q] == got[p]) for p in prints} == want


def test_crowded_cells(spark):
    prints = [(1 << i) | (1 << j) for i in range(24) for j in range(i)]  # all in few cells, all linked
    classes = spark.createDataFrame([(p,) for p in prints], "print long")
    roots = {r.root for r in S.star_components(S.near_links(classes, cell_rows=50)).collect()}
    assert roots == {min(prints)}


def test_edges(spark):
    found = S.simhash_components(edge(spark)).collect()
    assert len(found) == 11
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert by_id[1] == [by_id[1][0]] * 2 and by_id[7][0] == by_id[1][0] and by_id[1][0][1] == 1
    assert by_id[2][0] == ("0" * 16, 2) == by_id[5][0] == by_id[3][0]
    assert ("0" * 16, 2) in by_id[None]
    assert S.simhash_components(nothing(spark)).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def least_of_groups(rows):
    """The least id of every group of near copies, by all pairs: five words, similarity 0.8 or more."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common >= 0.8 * (len(a) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        g = find(i)
        least[g] = min(least.get(g, doc_id), doc_id)
    return set(least.values())


def near_rows(rng, groups, size, edits):
    """Groups of texts, each text with so many words changed against the first of its group."""
    rows = []
    for g in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for _ in range(size):
            w = list(base)
            for at in rng.integers(0, 150, edits):
                w[at] = f"x{int(rng.integers(0, 10**6))}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(3)
    rows = near_rows(rng, 20, 3, 1) + [(1000 + i, t) for i, t in near_rows(rng, 20, 2, 6)] + [(2000 + i, t) for i, t in near_rows(rng, 30, 1, 0)]
    kept = S.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string"))
    want = least_of_groups(rows)
    assert {r.doc_id for r in kept.collect()} == want and 1000 < max(want) and len(want) > 80


def test_a_large_group_in_crowded_cells(spark):
    rng = np.random.default_rng(4)
    rows = near_rows(rng, 1, 300, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in S.keep_one_per_group(docs).collect()] == [0]
    sketches = docs.select(F.md5("text").alias("text_hash"), S.wide_sketch_udf("text").alias("s")).select("text_hash", "s.*")
    links = S.similar_links(sketches, docs.select(F.md5("text").alias("text_hash"), "text"), cell_rows=20)
    assert S.star_components(links).select("root").distinct().count() == 1
    assert S.similar_links(sketches.limit(0), docs.select(F.md5("text").alias("text_hash"), "text")).count() == 0


def test_tree_keeps_what_is_within_radius_together():
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 1 << 62, (60, 2)).astype(np.uint64)
    prints[20:] = prints[:1]
    prints[20:, 0] ^= rng.integers(0, 16, 40).astype(np.uint64)
    for radius in (4, 29):
        i, j = S.near_tree(prints, radius)
        assert (S._apart(prints[i], prints[j]) <= radius).all()
        joined = slow_closure(60, [(a, b) for a in range(60) for b in range(a) if S._apart(prints[a], prints[b]) <= radius])
        assert slow_closure(60, zip(i.tolist(), j.tolist())) == joined


def slow_closure(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_sketch_equals_a_plain_loop():
    text = "A b c d e f g a b c d e é"
    w = words_of(text)
    hashes = sorted({xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode(), 42) for i in range(len(w) - 4)})
    mask = (1 << 64) - 1
    bits = [0] * 256
    for h in hashes:
        for k in range(4):
            x = (h + (k + 1) * 0x9E3779B97F4A7C15) & mask
            x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
            x ^= x >> 31
            for b in range(64):
                bits[64 * k + b] += x >> b & 1
    bits = [2 * b > len(hashes) for b in bits]
    hi, lo, p0, p1, cells = S.wide_sketch(text)
    assert [p % (1 << 64) for p in (p0, p1)] == [sum(1 << b for b in range(64) if bits[64 * k + b]) for k in range(2)]
    assert cells.tolist() == [(t << 16) + sum(1 << k for k in range(16) if bits[S._SAMPLED[t, k]]) for t in range(S.TABLES)]
    assert S.wide_sketch(" a B\t c")[:2] == S.wide_sketch("A b C ")[:2] != S.wide_sketch("a b d")[:2]
    assert S.wide_sketch(None)[:2] == S.wide_sketch(" \n")[:2] and S.wide_sketch(None)[4] == []


def test_one_stays_of_every_group(spark):
    kept = S.keep_one_per_group(edge(spark))
    assert kept.columns == edge(spark).columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 4, 6, 8]
    assert kept.where(F.col("doc_id").isNull()).count() == 1  # its component has no id but null
    assert S.keep_one_per_group(nothing(spark)).count() == 0


def test_the_kept_row_is_chosen_by_class_not_by_id(spark):
    a, b, c = ("".join(f"{w}{i} " for i in range(40)) for w in "abc")
    rows = [
        (None, a, "x"), (None, b, "x"), (None, b, "x"),  # two unrelated texts without an id, one of them twice
        (1, c, "x"), (5, c, "x"), (5, "p q r s t", "x"),  # the copy with id 5 must not come back
        (7, "k l m n o", "x"), (7, "u v w y z", "x"),  # unrelated texts that share an id
        (9, "one of two sources", "x"), (9, "one of two sources", "y"),
    ]
    want = [(1, c), (5, "p q r s t"), (7, "k l m n o"), (7, "u v w y z"), (9, "one of two sources"), (None, a), (None, b)]
    runs = []
    for given in (rows, rows[::-1]):
        docs = spark.createDataFrame(given, "doc_id long, text string, source string").repartition(3)
        runs.append(sorted(map(tuple, S.keep_one_per_group(docs).collect()), key=str))
    assert sorted((r[:2] for r in runs[0]), key=str) == sorted(want, key=str)
    assert runs[0] == runs[1]


def scattered_rows(pairs, words, edits):
    """Pairs of near copies, so many words changed far apart; unlike all other texts."""
    rows = []
    for g in range(pairs):
        base = [f"g{g}w{i}" for i in range(words)]
        other = list(base)
        for e in range(edits):
            other[(e + 1) * words // (edits + 1)] = f"x{g}e{e}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    return rows


def test_no_link_is_lost_at_the_least_similarity(spark):
    """300 words, 296 shingles, six edits: 266 common of 326, 0.816. Fingerprints differ in some ten bits, so the grid alone finds hardly any."""
    rows = scattered_rows(300, 300, 6)
    want = least_of_groups(rows[:20])
    assert want == set(range(0, 20, 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in S.keep_one_per_group(docs).collect()) == list(range(0, 600, 2))


def test_the_stage_takes_the_grid_join(spark, monkeypatch):
    """Pairs within RADIUS bits are settled first, by the grid join over segment counts of the sets' fingerprints."""
    seen = []
    real = S.near_links
    monkeypatch.setattr(S, "near_links", lambda classes, **a: seen.append(real(classes, **a).collect()) or real(classes, **a))
    rows = near_rows(np.random.default_rng(9), 40, 2, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in S.keep_one_per_group(docs).collect()} == least_of_groups(rows)
    prints = [S.majority(J.shingle_set(t)) for _, t in rows]
    near = {(min(a, b), max(a, b)) for a, b in itertools.combinations(prints, 2) if ((a ^ b) % (1 << 64)).bit_count() <= S.RADIUS and a != b}
    assert len(seen) == 1 and {tuple(r) for r in seen[0]} == near and near
