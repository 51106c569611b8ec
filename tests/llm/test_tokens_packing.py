from __future__ import annotations

import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casewright.llm import packing as P
from casewright.llm import queries
from casewright.llm import tokens as T
from tests.llm.edge import edge, nothing

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PLAIN.encode_special_tokens = True


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1.'sé ß \t\n\x0b\x1f  ", max_size=40) | st.text(max_size=30))
def test_ids_equal_the_tokenizer(text):
    text = text.encode("utf-8", "ignore").decode()
    assert T.encoder().encode(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_special_strings_are_plain_text():
    assert T.END_OF_DOCUMENT not in T.encoder().encode("a <|endoftext|> b")


def test_scan_counts_every_document(spark):
    want = sorted((r.doc_id is None, r.doc_id or 0, len(PLAIN.encode(r.text or "", add_special_tokens=False).ids)) for r in edge(spark).collect())
    for block in (1 << 17, 50):
        found = T.document_token_counts(edge(spark), block_tokens=block).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in found) == want
    assert T.document_token_counts(nothing(spark)).count() == 0


def test_scan_of_a_flat_file(spark, tmp_path):
    lengths = [0, 3, 0, 0, 40, 1, 12]
    flat = [x for n in lengths for x in [5] * n + [T.END_OF_DOCUMENT]] + [9, 9]
    (tmp_path / "f.bin").write_bytes(np.array(flat, "<u2").tobytes())
    blocks = T.read_token_blocks(spark, f"file://{tmp_path}/f.bin", block_tokens=8)
    found = sorted((r.ordinal, r.n_tokens, r.closed) for r in T.separator_scan(blocks, block_tokens=8).collect())
    assert found == [*((i, n, True) for i, n in enumerate(lengths)), (len(lengths), 2, False)]


def held(rows, n_tokens, limit=1024):
    """Checks pieces and sequences; returns tokens of padding."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    assert sum(r.length for r in rows) == n_tokens
    return padding


def test_packing_holds_every_id_once(spark):
    docs = edge(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = P.pack_documents(docs).collect()
    for d in docs.collect():
        ids = np.array(PLAIN.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
        own, at = sorted((r for r in rows if r.doc_id == d.doc_id), key=lambda r: r.start), 0
        for r in own:
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.ids == ids[at : at + r.length].tolist()
            at += r.length
        assert at == len(ids)
    assert held(rows, sum(len(PLAIN.encode(d.text or "", add_special_tokens=False).ids) + 1 for d in docs.collect())) == 0


def test_packing_edges(spark):
    rows = P.pack_documents(edge(spark), with_ids=False)
    assert "ids" not in rows.columns
    total = sum(len(PLAIN.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in edge(spark).collect())
    assert held(rows.collect(), total) == 0
    assert P.pack_documents(nothing(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.integers(0, 100)), max_size=60), st.integers(1, 6), st.integers(20, 128))
def test_limits_hold(examples, segments, loss_limit):
    limits = P.Limits(tokens=128, segments=segments, loss_tokens=loss_limit)
    masks = [np.arange(n) % 100 < share for n, share in examples]
    sums = [np.concatenate(([0], np.cumsum(m))) for m in masks]
    between = lambda row, a, b: int(sums[row][b] - sums[row][a])
    full, rest = [], []
    for i, (n, _) in enumerate(examples):
        whole, tail = P.cut_full(i, n, limits, between)
        full += [[p] for p in whole]
        rest += P.fitting(tail, limits, between) if tail else []
    sequences = full + P.place(rest, limits, between)
    seen = [np.zeros(n, int) for n, _ in examples]
    for s in sequences:
        assert sum(p.length for p in s) <= 128 and len(s) <= segments and sum(p.loss for p in s) <= loss_limit
        for p in s:
            assert p.loss == between(p.row, p.start, p.start + p.length)
            seen[p.row][p.start : p.start + p.length] += 1
    assert all((x == 1).all() for x in seen)


def test_dot_product_prefers_the_fuller_piece():
    plain = lambda row, a, b: b - a
    pieces = [P.Piece(0, 0, 60, 60), P.Piece(1, 0, 30, 30), P.Piece(2, 0, 40, 40)]
    assert [[p.length for p in s] for s in P.place(pieces, P.Limits(100, 4, 100), plain, may_cut=False)] == [[60, 40], [30]]


def test_turns_bear_loss_on_answers(spark):
    data = [(1, 0, "user", "hello there"), (1, 1, "assistant", "hi, how are you"), (2, None, None, "x"), (3, 0, "assistant", None), (None, 1, "assistant", "z")]
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string")
    loss = {}
    for r in P.pack_turns(df).collect():
        loss[tuple(r.doc_id)] = loss.get(tuple(r.doc_id), 0) + r.loss_tokens
    assert loss == {(1, 0): 0, (1, 1): len(PLAIN.encode("hi, how are you").ids) + 1, (2, None): 0, (3, 0): 1, (None, 1): 2}
    assert P.pack_turns(df.limit(0)).count() == 0


def test_conversations_meet_three_limits_that_bind(spark, sf_dir):
    rows = queries.op5_instruction_packing(spark, sf_dir).collect()
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    assert sum(r.length for r in rows) == sum(len(PLAIN.encode(t.text or "", add_special_tokens=False).ids) + 1 for t in turns)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    tokens = [sum(r.length for r in s) for s in sequences.values()]
    pieces = [len(s) for s in sequences.values()]
    loss = [sum(r.loss_tokens for r in s) for s in sequences.values()]
    limits = P.TURN_LIMITS
    assert (max(tokens), max(pieces)) == (limits.tokens, limits.segments)
    assert limits.loss_tokens - 16 < max(loss) <= limits.loss_tokens  # few tokens short of the limit, as pieces come


def test_ids_stay_exact_beside_nulls(spark):
    big = 2**53
    docs = spark.createDataFrame([(big + 1, "a b"), (None, "c"), (big + 3, "d e f"), (big + 3, None)], "doc_id long, text string").coalesce(1)
    want = sorted(((r.doc_id or 0), len(PLAIN.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r.doc_id or 0, r.n_tokens) for r in T.document_token_counts(docs).collect()) == want
    packed = P.pack_documents(docs, with_ids=False).where("start = 0").collect()
    assert sorted((r.doc_id or 0, r.doc_tokens - 1) for r in packed) == want
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {r.doc_id for r in P.pack_documents(named).collect()} == {str(big + 1), str(big + 3), None}


def test_null_blocks_hold_no_tokens(spark):
    blocks = spark.createDataFrame([("f", 0, None), ("g", 0, bytearray(np.array([5, T.END_OF_DOCUMENT], "<u2").tobytes()))], "file string, block long, data binary")
    assert [(r.file, r.n_tokens) for r in T.separator_scan(blocks, block_tokens=8).collect()] == [("g", 1)]


def test_too_large_a_piece_is_an_error():
    with pytest.raises(ValueError, match="larger"):
        P.place([P.Piece(0, 0, 10, 0)], P.Limits(5, 1, 5), lambda r, a, b: 0, may_cut=False)
