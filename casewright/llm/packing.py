"""Packing examples into training sequences by vector bin packing.

An example asks for tokens, one segment and loss-bearing tokens; a sequence has a limit on each. Full
sequences are cut off long examples first. What is left is placed by the dot-product heuristic: into
the open sequence goes, of the pieces that fit, the one whose demand has the greatest dot product with what the
sequence still has to give (both in shares of the limits). When none fits whole and cutting is
allowed, a piece is cut to fill the sequence. A partition's last sequences, which nothing can fill, are cut
into powers of two, which need no padding.

Every partition packs its own rows as they come, so nothing is shuffled and a lost partition is packed
again the same way. Sequence ids are the partition number and a running number.

Nulls: a null text is an empty example (its separator alone). An id, null or repeated or not, is carried along as it is,
of whatever type; every row is packed on its own. A text of any length is cut into as many pieces as it needs. Ties go to the
shorter, then the less loss-bearing piece. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from casewright.llm.tokens import VOCABULARY, encoder

SEQUENCE_TOKENS = 1024
MAX_SEGMENTS = 64
#: Pieces that one round of packing holds; what a round leaves over goes into the next.
ROUND_PIECES = 20_000
#: Sequences handed on at once, so that what is on its way out stays small.
OUTPUT_SEQUENCES = 512
SEPARATOR = 0
PIECE_COLUMNS = ("doc_id", "start", "length", "loss_tokens", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


@dataclass(frozen=True)
class Limits:
    """What a sequence holds: tokens, pieces, and tokens that bear loss."""

    tokens: int = SEQUENCE_TOKENS
    segments: int = MAX_SEGMENTS
    loss_tokens: int = SEQUENCE_TOKENS


@dataclass
class Piece:
    """Tokens start .. start + length of the example `row`; loss: how many of them bear loss."""

    row: int
    start: int
    length: int
    loss: int


#: Given a row, a start and a stop, how many tokens between bear loss.
LossCount = Callable[[int, int, int], int]


def place(pieces: list[Piece], limits: Limits, loss_between: LossCount, may_cut: bool = True) -> list[list[Piece]]:
    """Sequences for pieces that fit a sequence each. Only the last ones may be left short when cutting is allowed.

    Pieces of equal demand are alike, so the heuristic weighs distinct demands, not pieces."""
    shelves: dict[tuple[int, int], list[Piece]] = {}
    for p in pieces:
        shelves.setdefault((p.length, p.loss), []).append(p)
    kinds = sorted(shelves)
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
    demand = np.array([(t, 1, n) for t, n in kinds], dtype=np.float64).reshape(-1, 3)
    shares = demand / np.maximum(cap, 1)
    left = np.array([len(shelves[k]) for k in kinds], dtype=np.int64)

    def put(p: Piece) -> None:
        nonlocal kinds, demand, shares, left
        key = (p.length, p.loss)
        i = index.get(key)
        if i is None:
            index[key] = i = len(kinds)
            kinds.append(key)
            row = np.array([[p.length, 1, p.loss]], dtype=np.float64)
            demand, shares, left = np.concatenate([demand, row]), np.concatenate([shares, row / np.maximum(cap, 1)]), np.append(left, 0)
            shelves[key] = []
        shelves[key].append(p)
        left[i] += 1

    index = {k: i for i, k in enumerate(kinds)}
    out: list[list[Piece]] = []
    while left.any():
        room, sequence = cap.copy(), []
        while True:
            fits = (left > 0) & (demand <= room).all(axis=1)
            if not fits.any():
                break
            i = int(np.where(fits, shares @ (room / np.maximum(cap, 1)), -1.0).argmax())
            sequence.append(shelves[kinds[i]].pop())
            left[i] -= 1
            room -= demand[i]
        if may_cut and left.any() and room[0] >= 1 and room[1] >= 1:
            i = int(np.where(left > 0, demand[:, 0], -1.0).argmax())
            p = shelves[kinds[i]][-1]
            # as many tokens as there is room for, fewer if they bear too much loss
            n = int(min(room[0], p.length - 1))
            while n > 0 and loss_between(p.row, p.start, p.start + n) > room[2]:
                n -= max(1, int(loss_between(p.row, p.start, p.start + n) - room[2]))
            if n > 0:
                shelves[kinds[i]].pop()
                left[i] -= 1
                head = loss_between(p.row, p.start, p.start + n)
                sequence.append(Piece(p.row, p.start, n, head))
                put(Piece(p.row, p.start + n, p.length - n, p.loss - head))
        if not sequence:
            raise ValueError("a piece is larger than a sequence")
        out.append(sequence)
    return out


def cut_full(row: int, length: int, limits: Limits, loss_between: LossCount) -> tuple[list[Piece], Piece | None]:
    """Pieces of a long example that fill a sequence alone, and the rest."""
    full, at = [], 0
    while length - at >= limits.tokens:
        loss = loss_between(row, at, at + limits.tokens)
        if loss > limits.loss_tokens:
            break
        full.append(Piece(row, at, limits.tokens, loss))
        at += limits.tokens
    return full, (Piece(row, at, length - at, loss_between(row, at, length)) if at < length else None)


def fitting(piece: Piece, limits: Limits, loss_between: LossCount) -> list[Piece]:
    """piece in parts that each fit a sequence."""
    out = []
    while piece.length > limits.tokens or piece.loss > limits.loss_tokens:
        low, high = 1, min(piece.length, limits.tokens)
        while low < high:  # the longest head within the limits
            mid = (low + high + 1) // 2
            low, high = (mid, high) if loss_between(piece.row, piece.start, piece.start + mid) <= limits.loss_tokens else (low, mid - 1)
        head = loss_between(piece.row, piece.start, piece.start + low)
        out.append(Piece(piece.row, piece.start, low, head))
        piece = Piece(piece.row, piece.start + low, piece.length - low, piece.loss - head)
    return [*out, piece] if piece.length else out


def in_powers_of_two(sequence: list[Piece], loss_between: LossCount) -> list[list[Piece]]:
    """The pieces of a short sequence, dealt to sequences whose lengths are powers of two."""
    total = sum(p.length for p in sequence)
    out, queue = [], list(sequence)
    for bit in reversed(range(total.bit_length())):
        room, part = total & (1 << bit), []
        while room:
            p = queue.pop(0)
            n = min(room, p.length)
            head = loss_between(p.row, p.start, p.start + n)
            part.append(Piece(p.row, p.start, n, head))
            if n < p.length:
                queue.insert(0, Piece(p.row, p.start + n, p.length - n, p.loss - head))
            room -= n
        if part:
            out.append(part)
    return out


def pack_examples(
    rows: DataFrame,
    tokenise: Callable[[list], list[tuple[np.ndarray, np.ndarray | None]]],
    id_col: str,
    input_col: Column,
    limits: Limits = Limits(),
    round_pieces: int = ROUND_PIECES,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, loss_tokens, ids_crc32, doc_tokens, sequence_id, offset and, unless
    with_ids is false, ids.

    tokenise turns a list of inputs into (ids, loss mask or None for all) pairs."""
    columns = [c for c in PIECE_COLUMNS if with_ids or c != "ids"]
    narrow = rows.select(F.col(id_col).alias("id"), input_col.alias("input"))
    kinds = {"doc_id": narrow.schema["id"].dataType.simpleString(), "ids": "array<int>"}

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"ids": pa.list_(pa.int32())}
        serial = TaskContext.get().partitionId() << 33
        names: dict[int, object] = {}
        ids: dict[int, np.ndarray] = {}
        sums: dict[int, np.ndarray | None] = {}
        waiting: list[Piece] = []
        count = 0

        def loss_between(row: int, a: int, b: int) -> int:
            s = sums[row]
            return b - a if s is None else int(s[b] - s[a])

        def rows_of(sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(sequences), OUTPUT_SEQUENCES):
                yield some_rows(sequences[at : at + OUTPUT_SEQUENCES])

        def some_rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal serial
            out = []
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    piece = ids[p.row][p.start : p.start + p.length].astype("<u4")
                    out.append((names[p.row], p.start, p.length, p.loss, zlib.crc32(piece.tobytes()), len(ids[p.row]), serial, offset, *([piece.astype(np.int32)] if with_ids else [])))
                    offset += p.length
                serial += 1
            return pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.int64())) for c, v in zip(columns, zip(*out))], names=columns)

        def settled(sequences: list[list[Piece]]) -> list[list[Piece]]:
            """Short sequences, which the limits leave, are cut so that none needs padding."""
            return [s for whole in sequences for s in ([whole] if sum(p.length for p in whole) == limits.tokens else in_powers_of_two(whole, loss_between))]

        def forget(kept: set[int]) -> None:
            for held in (names, ids, sums):
                for row in held.keys() - kept:
                    del held[row]

        for part in parts:
            full: list[list[Piece]] = []
            types["doc_id"] = part.schema.field("id").type
            for doc_id, (tokens, mask) in zip(part.column("id").to_pylist(), tokenise(part.column("input").to_pylist())):
                names[count] = doc_id
                ids[count] = tokens
                sums[count] = None if mask is None else np.concatenate(([0], np.cumsum(mask)))
                whole, rest = cut_full(count, len(tokens), limits, loss_between)
                full += [[p] for p in whole]
                if rest is not None:
                    waiting += fitting(rest, limits, loss_between)
                count += 1
            if len(waiting) >= round_pieces:
                packed = place(waiting, limits, loss_between)
                full += settled(packed[:-1])
                waiting = packed[-1]
            if full:
                yield from rows_of(full)
            forget({p.row for p in waiting})
        if waiting:
            yield from rows_of(settled(place(waiting, limits, loss_between)))

    return narrow.mapInArrow(pack, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in columns))


def tokenise_texts(texts: list[str | None], vocabulary: str = VOCABULARY) -> list[tuple[np.ndarray, None]]:
    enc, end = encoder(vocabulary), np.array([SEPARATOR], np.uint16)
    return [(np.concatenate([enc.encode(t), end]), None) for t in texts]


def pack_documents(docs: DataFrame, limits: Limits = Limits(), with_ids: bool = True) -> DataFrame:
    """Pieces of the texts of docs; each text's ids are followed by SEPARATOR, and every token bears loss."""
    return pack_examples(docs, tokenise_texts, "doc_id", F.col("text"), limits, with_ids=with_ids)


def tokenise_turns(turns: list, vocabulary: str = VOCABULARY, learned_roles: frozenset[str] = frozenset({"assistant"})) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids of turns (role, text), each ended by SEPARATOR; only turns of learned_roles bear loss."""
    enc, out, end = encoder(vocabulary), [], np.array([SEPARATOR], np.uint16)
    for turn in turns:
        ids = np.concatenate([enc.encode(turn["text"]), end])
        out.append((ids, np.full(len(ids), int(turn["role"] in learned_roles))))
    return out


#: Instruction data: seven eighths of a sequence's tokens may bear loss, and it attends to no more than 5 pieces.
TURN_LIMITS = Limits(segments=5, loss_tokens=SEQUENCE_TOKENS * 7 // 8)


def pack_turns(conversations: DataFrame, limits: Limits = TURN_LIMITS) -> DataFrame:
    """Pieces of (conv_id, turn, role, text) rows, for instruction data: every turn is an example, doc_id the struct (conv_id, turn).

    Turns are packed as they come, so a conversation of any length is no single task's work."""
    named = conversations.withColumn("doc_id", F.struct("conv_id", "turn"))
    return pack_examples(named, tokenise_turns, "doc_id", F.struct("role", "text"), limits)
