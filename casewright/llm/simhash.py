"""SimHash near-duplicate classes by segment popcounts.

A 64-bit fingerprint is mapped to 32 counts, the set bits of each two-bit segment. The
Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints, so a pair within `RADIUS` bits is within `RADIUS` in the grid of counts. The 32
axes are cut into six runs; a pair at Manhattan distance 3 or less agrees wholly on at least
three of them, so the range join is one of equality on three runs. Each fingerprint therefore enters one grid cell
for each three runs (20 cells), and only fingerprints that share a cell are compared: first by Manhattan distance, then
exactly. Cells are dealt over the cluster; a crowded cell is cut into chunks that meet pairwise.
A cell hands on a spanning forest of its links, so copies never expand into all pairs, and the
classes are found by alternating star contractions on tables.

keep_one_per_group works by the general rule for near copies: word sets of five, similarity 0.8 or more. The same fingerprints, taken of
these sets, the same popcounts and the same grid join propose the nearest pairs, and each is settled on the whole sets. Pairs at that similarity
may differ in more bits than any grid of counts selects (some ten): those between the groups so found are left to jaccard.py's
tiles, which miss none.

similar_links is another way, with a probability, by wider fingerprints (`WIDE_BITS`) whose cells are samples of single bits. Nothing here takes it.

Nulls: a null or blank text has fingerprint 0, which links like any other. A null doc_id takes
part in linking; component_id is the smallest non-null doc_id (null if a class has none).
Ties: of equal distances any may be handed on, which changes no class. Texts of any length are read whole.
Repeated rows each give a row. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from casewright.llm.tables import materialise, whole_rows

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
RUNS = 6
#: Fingerprints of one cell that meet in one task; larger cells are cut into chunks of about this size.
CELL_ROWS = 4096
#: Up to this many members a cell is compared by offsets over the whole batch.
SMALL_CELL = 12
#: similar_links: words of a shingle, and the share of common shingles from which two texts are near copies.
NEAR_WORDS = 5
NEAR_SIMILARITY = 0.8
#: Its fingerprints, the bits that make a cell, and the cells of each text. Two texts at the similarity share a given cell
#: in 7 of 100 cases. Far beyond 10^8 texts more bits keep cells small, and more cells make up for them.
WIDE_BITS = 256
CELL_BITS = 16
TABLES = 48
#: Texts of one cell are worth verifying when this many of the first 128 bits differ at most: 2.3 deviations beyond what
#: is expected at NEAR_SIMILARITY.
NEAR_RADIUS = 29
#: Shingles counted at once, so that a very long text needs no more memory.
STRETCH = 1 << 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LOW_BITS = 0x5555555555555555


def joined_words(text: str | None) -> bytes:
    """The words of a text in lower case (A-Z), one blank between."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())


def shingle_hashes(joined: bytes, shingle_words: int) -> np.ndarray:
    """XXH64 of every run of shingle_words words, repeats included; of the whole, if there are fewer."""
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(joined)]))
    k = min(shingle_words, len(starts))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype="<u8")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of (n, words) 64-bit hashes have each bit set."""
    width = 64 * hashes.shape[1]
    counts = np.zeros(width, np.int64)
    for at in range(0, len(hashes), STRETCH):
        part = np.ascontiguousarray(hashes[at : at + STRETCH], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        # eight byte-wide counters to a word: no counter overflows within 255 rows
        packed = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(bits), 255), axis=0)
        counts += packed.view(np.uint8).reshape(-1, width).sum(axis=0, dtype=np.int64)
    return counts


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of 64-bit hashes: the bits set in over half of them."""
    return int(np.packbits(2 * bit_counts(hashes[:, None]) > len(hashes), bitorder="little").view("<i8")[0])


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash over word shingles; 0 without words."""
    joined = joined_words(text)
    if not joined:
        return 0
    return majority(shingle_hashes(joined, shingle_words))


@pandas_udf(LongType())
def simhash_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), simhash_udf(F.col(text_col)).alias("print"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def run_masks(runs: int = RUNS, radius: int = RADIUS) -> list[int]:
    """For each choice of runs - radius runs, the mask of their two-bit count fields."""
    cuts = [round(32 * i / runs) for i in range(runs + 1)]
    fields = [sum(3 << (2 * s) for s in range(a, b)) for a, b in itertools.pairwise(cuts)]
    return [_signed(sum(c)) for c in itertools.combinations(fields, runs - radius)]


def segment_counts(print_col):
    """The 32 popcounts of two-bit segments, packed in two-bit fields."""
    low, next_bit = F.lit(_LOW_BITS), F.shiftrightunsigned(print_col, 1)
    one = print_col.bitwiseXOR(next_bit).bitwiseAND(low)
    two = F.shiftleft(print_col.bitwiseAND(next_bit).bitwiseAND(low), 1)
    return one.bitwiseOR(two)


def _counts(prints: np.ndarray) -> np.ndarray:
    low = np.uint64(_LOW_BITS)
    return (prints & low) + ((prints >> np.uint64(1)) & low)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, x = np.uint64(_LOW_BITS), a ^ b
    odd, high = x & low, (x >> np.uint64(1)) & low
    return np.bitwise_count(odd) + 2 * np.bitwise_count(high & ~odd)


def _linked(counts_a, a, counts_b, b, radius: int) -> np.ndarray:
    near = _manhattan(counts_a, counts_b) <= radius
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= radius
    return near


def _forest(prints: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints, breadth first."""
    out, left, queue = [], prints, []
    counts = _counts(prints)
    while queue or len(left):
        if queue:
            at = queue.pop()
        else:
            at, left, counts = left[0], left[1:], counts[1:]
        one = np.full(len(left), at, np.uint64)
        near = _linked(_counts(one), one, counts, left, radius)
        if near.any():
            found = left[near]
            out.append((one[: len(found)], found))
            queue.extend(found)
            left, counts = left[~near], counts[~near]
    return out


def whole_cells(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows sorted by keys, regrouped so that no cell is torn: rows, and where cells start and how long they are.

    A cell may go on over batches; its rows wait for the next batch."""

    def spans(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        same = np.ones(len(rows), bool)
        for k in keys:
            same[1:] &= rows[k].to_numpy()[1:] == rows[k].to_numpy()[:-1]
        same[0] = False
        starts = np.flatnonzero(~same)
        return rows, starts, np.diff(np.append(starts, len(rows)))

    held: list[pd.DataFrame] = []
    for rows in parts:
        if not len(rows):
            continue
        last = np.ones(len(rows), bool)
        for k in keys:
            last &= rows[k].to_numpy() == rows[k].iloc[-1]
        if last.all() and held and (held[-1][keys].iloc[-1] == rows[keys].iloc[0]).all():
            held.append(rows)  # one cell fills the whole batch
            continue
        if not last.all():
            yield spans(pd.concat([*held, rows[~last]]))
            held = [rows[last]]
        else:
            if held:
                yield spans(pd.concat(held))
            held = [rows]
    if held:
        yield spans(pd.concat(held))


def small_cell_pairs(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs within cells of up to SMALL_CELL rows, by the offset between them."""
    total = int(lengths.sum())
    at, of = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= SMALL_CELL), lengths)), np.repeat(np.arange(len(starts)), lengths)
    for step in range(1, SMALL_CELL):
        at = at[at + step < total]
        at = at[of[at] == of[at + step]]
        if not len(at):
            return
        yield at, at + step


def cell_links(parts: Iterator[pd.DataFrame], radius: int = RADIUS) -> Iterator[pd.DataFrame]:
    """Rows (combo, cell, u, v, print), sorted by cell, to links (a, b), a < b."""
    for rows, starts, lengths in whole_cells(parts, ["combo", "cell", "u", "v"]):
        prints = rows["print"].to_numpy().view(np.uint64)
        counts, found = _counts(prints), []
        for i, j in small_cell_pairs(starts, lengths):
            hit = _linked(counts[i], prints[i], counts[j], prints[j], radius)
            found.append((prints[i[hit]], prints[j[hit]]))
        for i in np.flatnonzero(lengths > SMALL_CELL):
            found += _forest(prints[starts[i] : starts[i] + lengths[i]], radius)
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def meeting_chunks(cells: DataFrame, keys: list[str], member: list[str], cell_rows: int) -> DataFrame:
    """cells with (u, v): rows of a cell meet where all three agree. A cell of more than cell_rows rows is cut into chunks by
    a hash of member, and any two of its chunks meet once."""
    crowded = materialise(
        cells.groupBy(*keys).count().where(F.col("count") > cell_rows).withColumn("chunks", F.ceil(F.col("count") / cell_rows).cast("int")).drop("count"),
        "simhash-crowded",
    )
    one = F.lit(0).cast("int")
    own = F.pmod(F.xxhash64(*member), F.col("chunks")).cast("int")
    meets = F.transform(
        F.sequence(one, F.col("chunks") - 1),
        lambda j: F.struct(F.least(own, j).alias("u"), F.greatest(own, j).alias("v")),
    )
    alone = F.array(F.struct(one.alias("u"), one.alias("v")))
    joined = cells.join(crowded, keys, "left")
    return joined.select(*cells.columns, F.inline(F.when(F.col("chunks").isNull(), alone).otherwise(meets)))


def near_links(classes: DataFrame, runs: int = RUNS, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) whose closure equals that of all pairs of distinct fingerprints within radius."""
    counts = segment_counts(F.col("print"))
    cells = classes.select(
        "print",
        F.inline(F.array(*[F.struct(F.lit(i).alias("combo"), counts.bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(run_masks(runs, radius))])),
    )
    cells = meeting_chunks(cells, ["combo", "cell"], ["print"], cell_rows)
    keys = ["combo", "cell", "u", "v"]
    return (
        cells.repartition(*keys)
        .sortWithinPartitions(*keys, "print")
        .mapInPandas(lambda parts: cell_links(parts, radius), "a long, b long")
        .distinct()
    )


def star_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), of any type with an order; root is the smallest node of its component.

    Alternating large-star and small-star contractions: every pass is a group-by and a join,
    the links stay in tables, and the number of passes grows with the logarithm of the size."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star-links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star-low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "star-large")
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "star-low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = materialise(small.where("a <> b").distinct(), "star-links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs."""
    prints = materialise(fingerprints(docs, id_col, text_col), "simhash-prints")
    classes = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-classes")
    nodes = materialise(star_components(near_links(classes)).join(classes.withColumnRenamed("print", "node"), "node"), "simhash-nodes")
    roots = materialise(nodes.groupBy("root").agg(F.min("first").alias("least")), "simhash-roots")
    linked = nodes.join(roots, "root").select(F.col("node").alias("print"), "least")
    labels = materialise(
        classes.join(linked, "print", "left").select("print", F.coalesce("least", "first").alias("component_id")),
        "simhash-labels",
    )
    return prints.join(labels, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


SKETCH = StructType([*[StructField(n, LongType()) for n in ("hi", "lo", "p0", "p1")], StructField("cells", ArrayType(IntegerType()))])
_SAMPLED = np.random.default_rng(SEED).permuted(np.tile(np.arange(WIDE_BITS), (TABLES, 1)), axis=1)[:, :CELL_BITS]


def wide_hashes(hashes: np.ndarray) -> np.ndarray:
    """(n, words) hashes of 64 bits each, mixed from one."""
    x = hashes[:, None] + np.arange(1, WIDE_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_sketch(text: str | None) -> tuple:
    """Two words that name the text's word sequence, the first 128 bits of its wide fingerprint, and its cells."""
    joined = joined_words(text)
    name = np.frombuffer(hashlib.md5(joined).digest(), "<i8").tolist()
    if not joined:
        return (*name, 0, 0, [])
    hashes = np.unique(shingle_hashes(joined, NEAR_WORDS))
    bits = 2 * bit_counts(wide_hashes(hashes)) > len(hashes)
    cells = bits[_SAMPLED] @ (1 << np.arange(CELL_BITS)) + (np.arange(TABLES) << CELL_BITS)
    return (*name, *np.packbits(bits, bitorder="little").view("<i8")[:2].tolist(), cells.astype(np.int32))


@pandas_udf(SKETCH)
def wide_sketch_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([wide_sketch(t) for t in texts], columns=["hi", "lo", "p0", "p1", "cells"])


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.bitwise_count(p ^ q).sum(axis=-1, dtype=np.int16)


def near_tree(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of links within radius: all of them if they are few, else a forest of the shortest."""
    n = len(prints)
    found, many = [], 0
    step = max(1, (1 << 19) // n)
    for a in range(0, n, step):
        i, j = np.nonzero(_apart(prints[a : a + step, None], prints[None]) <= radius)
        found.append(np.stack([i + a, j])[:, i + a < j])
        many += found[-1].shape[1]
        if many > 2 * n:
            break
    else:
        return tuple(np.concatenate(found, axis=1))
    out, at = [], 0
    best, parent, left = np.full(n, radius + 1, np.int16), np.full(n, -1), np.ones(n, bool)
    for _ in range(n):
        left[at] = False
        away = _apart(prints[at], prints)
        nearer = left & (away < best)
        best[nearer], parent[nearer] = away[nearer], at
        at = int(np.where(left, best, np.int16(9999)).argmin())
        if left[at] and parent[at] >= 0:
            out.append((parent[at], at))
    return tuple(np.array(out, dtype=np.int64).reshape(-1, 2).T)


def cell_candidates(parts: Iterator[pd.DataFrame], radius: int = NEAR_RADIUS) -> Iterator[pd.DataFrame]:
    """Rows (cell, u, v, hi, lo, p0, p1), sorted by cell, to pairs of names worth verifying."""
    names = ["hi", "lo"]
    for rows, starts, lengths in whole_cells(parts, ["cell", "u", "v"]):
        prints, ids = rows[["p0", "p1"]].to_numpy().view(np.uint64), rows[names].to_numpy()
        found = []
        for i, j in small_cell_pairs(starts, lengths):
            near = _apart(prints[i], prints[j]) <= radius
            found.append((i[near], j[near]))
        for at, n in zip(starts[lengths > SMALL_CELL], lengths[lengths > SMALL_CELL]):
            i, j = near_tree(prints[at : at + n], radius)
            found.append((i + at, j + at))
        if found:
            i, j = (np.concatenate(x) for x in zip(*found))
            yield pd.DataFrame(np.concatenate([ids[i], ids[j]], axis=1), columns=["ahi", "alo", "bhi", "blo"])


@pandas_udf(BooleanType())
def near_copies(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether the sets of NEAR_WORDS-word shingles of two texts are similar (common to all) from NEAR_SIMILARITY up."""
    out, seen, known = [], None, None
    for a, b in zip(left, right):
        if a != seen:
            seen, known = a, np.unique(shingle_hashes(joined_words(a), NEAR_WORDS))
        other = np.unique(shingle_hashes(joined_words(b), NEAR_WORDS))
        common = len(np.intersect1d(known, other, assume_unique=True))
        out.append(common >= NEAR_SIMILARITY * (len(known) + len(other) - common) - 1e-9)
    return pd.Series(out, dtype=bool)


def similar_links(sketches: DataFrame, texts: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Verified links (a, b) of near copies, named by structs (hi, lo).

    sketches: one row for each name (hi, lo, p0, p1, cells, text_hash of one of its texts); texts: (text_hash, text) of all rows.
    Each cell hands on the shortest links that keep its texts together, and only texts that have one are gathered."""
    cells = sketches.select("hi", "lo", "p0", "p1", F.explode("cells").alias("cell"))
    keys = ["cell", "u", "v"]
    met = meeting_chunks(cells, ["cell"], ["hi", "lo"], cell_rows).repartition(*keys).sortWithinPartitions(*keys)
    found = met.mapInPandas(cell_candidates, "ahi long, alo long, bhi long, blo long")
    a, b = F.struct(F.col("ahi").alias("hi"), F.col("alo").alias("lo")), F.struct(F.col("bhi").alias("hi"), F.col("blo").alias("lo"))
    pairs = materialise(found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "near-pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    shown = sketches.select(F.struct("hi", "lo").alias("name"), "text_hash").join(named, "name")
    wanted = materialise(texts.join(shown, "text_hash").groupBy("name").agg(F.min("text").alias("text")), "near-texts")
    both = pairs.join(wanted.select(F.col("name").alias("a"), F.col("text").alias("left")), "a")
    both = both.join(wanted.select(F.col("name").alias("b"), F.col("text").alias("right")), "b")
    return both.where(near_copies("left", "right")).select("a", "b")


def class_links(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of uid from classes (uid, print): those that the grid join links by their prints, and of one print each with the first."""
    firsts = materialise(classes.groupBy("print").agg(F.min("uid").alias("first")), "near-firsts")
    alike = classes.join(firsts, "print").where("uid > first").select(F.col("first").alias("a"), F.col("uid").alias("b"))
    links = near_links(firsts.select("print"))
    for side in "ab":
        links = links.join(firsts.select(F.col("print").alias(side), F.col("first").alias(f"first_{side}")), side)
    return alike.unionAll(links.select(F.least("first_a", "first_b"), F.greatest("first_a", "first_b")))


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """One document of every group of near copies, all its columns: the one with the smallest doc_id.

    Texts are linked if 0.8 or more of their sets of five words (in lower case) are common; a group is what links join, and no
    link is lost. Texts without words are one group. The choice is made by group, never by
    doc_id alone: nulls come last, rows that share the smallest id are ordered by a hash of the text, then of the row. Of rows
    alike in all columns, one stays. An empty table stays empty."""
    from casewright.llm.jaccard import jaccard_components  # which takes this module's tables of links

    # maps and variants have no hash; rows that differ in them only count as alike
    hashed = [F.col("row")[f.name] for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    order = [F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), F.xxhash64("_text").alias("text_hash"), F.xxhash64(*hashed).alias("row_hash")]
    rows = whole_rows(docs, F.col("text").alias("_text"))
    rows = rows.select("row", "_text", F.struct(*order).alias("key"))
    groups = jaccard_components(rows, "key", "_text", class_links)
    first = groups.where((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").count()
    wordless = groups.where("n_shingles = 0").groupBy("doc_id").count().orderBy("doc_id").limit(1)
    names = [f"keep_{c}" for c in ("doc_id", "text_hash", "row_hash")]
    keep = first.unionAll(wordless).select(*[F.col(f"doc_id.{c[5:]}").alias(c) for c in names], "count")
    keep = materialise(keep, "near-keep")
    # a merge join at every size: the list of rows kept grows with docs
    keyed = rows.select("row", *[F.col(f"key.{c[5:]}").alias(c[5:]) for c in names])
    same = F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("text_hash") == F.col("keep_text_hash")) & (F.col("row_hash") == F.col("keep_row_hash"))
    kept = keyed.join(keep.select(*names).hint("merge"), same, "left_semi")
    if not keep.where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text_hash", "row_hash"])
    return kept.select("row.*")
