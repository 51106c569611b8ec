from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from casewright.llm import queries
from casewright.llm import trie as T
from tests.compare import spark_rows, sql_rows

SCHEMA = "conv_id long, turn long, role string, text string, words int, place string, arc string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "p", "a") for r in rows], SCHEMA)


def brute(rows, rebuild: bool = True) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        base = c - int(c % 20 if c >= 0 else -(-c % 20))
        paths[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    name = {k: (min(m), len(k)) for k, m in members.items()}
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        kids = [x for x in below if len(x) == len(k) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(re.findall(T.WORD, x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(paths[c]) == len(k)))
        out.append((*name[k], name[k[:-1]][0] if k else None, len(m), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    named = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*named).collect()), key=str)


def built(seed: int, convs: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(rng.choice([0, 1, 2, 3, 4, 6])):
            rows.append((c * rng.choice([1, 1, -1]) if c else 0, turn, rng.choice(["user", "assistant", None]), rng.choice(["", "a b", "c", None, "d  e\tf"])))
    return sorted({(r[0], r[1]): r for r in rows}.values(), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_brute_force(spark, tmp_path, seed):
    rows = built(seed, 120) + [(None, 1, "user", "x"), (500, None, "user", "first"), (500, 3, "user", "x"), (520, 9, None, None)]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(queries.op12_prefix_trie(spark, str(tmp_path))) == brute(rows)


def test_small_blocks_chunks_and_posts(spark, monkeypatch):
    rows = built(3, 60) + [(900, t, "user", str(t % 3)) for t in range(50)] + [(901, t, "user", str(t % 3)) for t in range(40)]
    monkeypatch.setattr(T, "BLOCK", 4)
    monkeypatch.setattr(T, "CHUNK", 2)
    monkeypatch.setattr(T, "POST_GAP", 3)
    turns = T.conversation_turns(frame(spark, rows))
    assert got(T.prefix_trie(turns, turns.select("conv_id").distinct())) == brute(rows, rebuild=False)


def test_ranks_of_a_group_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 2 * (F.col("id") > 900).cast("long")).alias("g"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = T.ranked(df, ["g"], ["id"], "test").orderBy("g", "id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    zero, one = ([r.place for r in placed if r.g == g] for g in (0, 1))
    assert zero == list(range(1, len(zero) + 1)) and one == list(range(1, len(one) + 1)) and len(one) == 50


def test_repeats_and_empty_tables(spark):
    rows = [(1, 0, "user", "a")] * 3 + [(2, 0, "user", "a")] * 2
    turns = T.conversation_turns(frame(spark, rows))
    assert got(T.prefix_trie(turns, turns.select("conv_id").distinct())) == brute(rows, rebuild=False)
    turns = T.conversation_turns(frame(spark, []))
    assert T.prefix_trie(turns, turns.select("conv_id").distinct()).count() == 0


def test_query_against_sql(spark, sf_dir):
    names, expected = sql_rows(queries.ORACLE["op12_prefix_trie"], sf_dir)
    df = queries.op12_prefix_trie(spark, sf_dir)
    assert sorted(df.columns) == names and spark_rows(df) == expected
