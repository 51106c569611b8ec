"""Token ids of a public byte-level vocabulary, and counts by separator scan.

A flat token file is a bare run of little-endian 16-bit ids: no index, each document ended by
the end-of-document id. It is handled as fixed-size blocks (file, block, data). Each block is
searched for the id with one vectorised comparison; documents that straddle blocks are stitched by a
prefix scan over block summaries (two levels, so a huge file is no single task's work).

Nulls: a null text is an empty document, and counts 0 tokens; a null block holds no tokens. Repeated rows and repeated
doc_ids each give a row; a doc_id, null or not, is carried along as it is, of whatever type. A text of any length is one
document, over as many blocks as it needs. Other columns of docs are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from casewright.llm.tables import materialise

#: The vocabulary of byte_bpe_50k.json as a rank file. Its ids are the same (a test holds them against each other), and a word
#: that is not remembered yet takes a third of the time.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 17
SCAN_GROUP = 1024
#: Words kept with their ids by each Python worker.
CACHE_WORDS = 300_000
#: A blank between white space: only there do ids depend on more than one blank-led word.
_RUN = re.compile(r"\s (?:\s|\Z)")


class Encoder:
    """Ids of whole texts as uint16. Texts are cut before blanks and the pieces' ids remembered; this
    vocabulary never joins across such a cut, but for runs of white space, which go uncut."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError(f"{path}: ids do not fit 16 bits")
        self._plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._seen: dict[str, bytes] = {}

    def _ids(self, piece: str) -> np.ndarray:
        return np.array(self._plain.encode_ordinary(piece), dtype="<u2")

    def _bytes(self, piece: str) -> bytes:
        return self._ids(piece).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint16)
        if _RUN.search(text):
            return self._ids(text)
        seen, out = self._seen, []
        first, *rest = text.split(" ")
        out.append(self._bytes(first))
        for word in rest:
            ids = seen.get(word)
            if ids is None:
                ids = self._bytes(" " + word)
                if len(word) < 64:
                    if len(seen) >= CACHE_WORDS:
                        seen.clear()
                    seen[word] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u2")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Flat token files as rows (file, block, data); one file for each partition of docs.

    first_doc and doc_ids list, for each block, which documents begin in it. They are the writer's
    record for naming documents later; the scan does not read them."""

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([END_OF_DOCUMENT], "<u2")
        held: list[np.ndarray] = []
        size = block = begun = 0
        ids: list = []
        id_type = None

        def row(data: np.ndarray) -> pa.RecordBatch:
            nonlocal block, begun, ids
            values = [(file, pa.int32()), (block, pa.int64()), (data.tobytes(), pa.binary()), (begun, pa.int64()), (ids, pa.list_(id_type))]
            block, begun, ids = block + 1, begun + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["file", "block", "data", "first_doc", "doc_ids"])

        for part in parts:
            id_type = part.schema.field("id").type
            for doc_id, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                ids.append(doc_id)
                held += [enc.encode(text), end]
                size += len(held[-2]) + 1
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    for at in range(0, size - block_tokens + 1, block_tokens):
                        yield row(flat[at : at + block_tokens])
                    held = [flat[size - size % block_tokens :]]
                    size %= block_tokens
        if size:
            yield row(np.concatenate(held))

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(write, f"file int, block long, data binary, first_doc long, doc_ids array<{id_kind}>")


def read_token_blocks(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, token_bytes: int = 2) -> DataFrame:
    """Blocks of existing flat token files of any size: each task reads its own ranges of bytes.

    Only names and lengths are listed; the ranges are dealt over the cluster and read through pyarrow, so the files must be in
    a store that it knows (a shared folder, HDFS, S3 and the like)."""
    size = block_tokens * token_bytes
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "length")
    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, store = None, None
        for part in parts:
            for file, block in zip(part.column("file").to_pylist(), part.column("block").to_pylist()):
                if file != opened:
                    system, name = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", file))
                    store, opened = system.open_input_file(name), file
                data = store.read_at(size, block * size)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    return ranges.repartition("file", "block").mapInArrow(read, "file string, block long, data binary")


def separator_scan(blocks: DataFrame, end_id: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, n_tokens, closed) for every document of flat token files, separators uncounted.

    closed is false for tokens after a file's last separator. Every block but a file's last holds
    block_tokens tokens."""
    file_type = blocks.schema["file"].dataType.simpleString()

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for data in part["data"]:
                tokens = np.frombuffer(data or b"", dtype)
                rows.append((len(tokens), np.flatnonzero(tokens == end_id).astype(np.int32)))
            yield pd.DataFrame({"file": part["file"], "block": part["block"], "tokens": [n for n, _ in rows], "ends": [e for _, e in rows]})

    found = blocks.select("file", "block", "data").mapInPandas(search, f"file {file_type}, block long, tokens long, ends array<int>")
    found = materialise(found, "separator-ends")
    start = F.col("block") * block_tokens
    n = F.size("ends")
    # the absolute place of a block's last separator; null without one
    summary = found.select("file", "block", F.floor(F.col("block") / SCAN_GROUP).alias("part"), n.alias("n"), F.when(n > 0, start + F.element_at("ends", -1)).alias("last"), (start + F.col("tokens")).alias("stop"))
    groups = summary.groupBy("file", "part").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    above = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("file", "part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.coalesce(F.max("last").over(above), F.lit(-1)).alias("last0"))
    inside = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.join(groups, ["file", "part"]).select(
        "file",
        "block",
        (F.col("n0") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("ordinal0"),
        F.greatest("last0", F.coalesce(F.max("last").over(inside), F.lit(-1))).alias("last0"),
    )
    closed = (
        found.where(n > 0)
        .join(carry, ["file", "block"])
        .select("file", "ordinal0", "last0", start.alias("start"), "ends", F.posexplode("ends").alias("i", "end"))
        .select(
            "file",
            (F.col("ordinal0") + F.col("i")).alias("ordinal"),
            (F.col("start") + F.col("end") - F.when(F.col("i") == 0, F.col("last0")).otherwise(F.col("start") + F.get("ends", F.col("i") - 1)) - 1).alias("n_tokens"),
            F.lit(True).alias("closed"),
        )
    )
    open_end = (
        summary.groupBy("file")
        .agg(F.sum("n").alias("ordinal"), (F.max("stop") - F.coalesce(F.max("last"), F.lit(-1)) - 1).alias("n_tokens"))
        .where("n_tokens > 0")
        .select("file", "ordinal", "n_tokens", F.lit(False).alias("closed"))
    )
    return closed.unionByName(open_end)


def document_token_counts(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, file and ordinal of every document, counted in the token files written from docs."""
    blocks = materialise(write_token_blocks(docs, block_tokens=block_tokens), "token-blocks")
    counts = separator_scan(blocks.select("file", "block", "data"), block_tokens=block_tokens)
    names = blocks.select("file", "first_doc", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("first_doc") + F.col("i")).alias("ordinal"), "doc_id")
    return names.join(counts, ["file", "ordinal"]).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "file", "ordinal")
