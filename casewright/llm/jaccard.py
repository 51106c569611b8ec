"""Exact Jaccard join of word-shingle sets by size-banded tiles and hashed bitmaps.

A document's set is the hashes of its distinct shingles; documents with one set are one class, and only a class's first row
goes on. Two sets can be similar only if they share one of the first few shingles of both, in any order that is the same for all: so
each set enters one tile for each shingle of its prefix. In the order used, shingles that very many documents
share come last; Misra-Gries counts over all texts find them, and sets are then seldom in a tile for a common passage.

In a tile of a few sets all pairs that sizes and places allow are candidates. Larger tiles first propose a few pairs for each set; what is
similar joins classes into groups. Only tiles where several groups are left are looked at further: cut into bands of
size, so that a set meets its own band and the next, and into chunks where a band is crowded. There a set is a bitmap of hashed shingles, some four bits each;
a bit that only one of two sets has stands for a shingle that the other lacks, so counts of bits bound the overlap from above. Sets name the
sets of other groups that the bound leaves possible; where they are many, each names the most alike first, in rounds, and all when that
joins no more groups. Pairs inside a group need no look. Candidates are settled by intersecting the sorted
arrays. So copies never expand into all pairs, and the groups are those of all pairs.

Nulls: a null or wordless text has an empty set, and its component is its own id. A null doc_id takes part; component_id is
the smallest non-null doc_id (null if there is none). Fewer words than a shingle has make one shingle. Texts of any length are read whole. Repeated
rows each give a row. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from casewright.llm.simhash import majority, meeting_chunks, star_components, whole_cells
from casewright.llm.tables import materialise

SHINGLE_WORDS = 5
#: Sets are similar when OF * common >= LEAST * (size of the union).
LEAST, OF = 80, 100
#: Shingles that each count keeps, and the list of common ones at most: those in more than one of so many shingles are surely known.
COMMON_KEPT = 1 << 14
#: Documents from which a shingle is worth listing as common.
COMMON_FROM = 64
#: Parts that the tile of a common shingle is written in.
COMMON_PARTS = 64
#: Up to this many sets a tile proposes all its pairs.
SMALL_TILE = 12
#: Sets of one band that meet in one task; more are cut into chunks of about this size.
CHUNK_ROWS = 4096
#: Ratio of a band's ends, above OF / LEAST: similar sets are in one band or in neighbours.
BAND_RATIO = 1.26
BITS = (256, 1 << 16)
#: Sets of other groups that a set names at first, and the rounds in which it names the most alike only.
NAMED, ROUNDS = 4, 2
#: Words of 64 bits of the table that tells unwanted texts.
FILTER_WORDS = 1 << 17
#: Bytes from which a word is hashed on its own.
LONG_WORD = 64
#: Shingles gathered before they are counted.
GATHERED = 1 << 20


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Masks that keep the first 0 to 8 bytes of eight.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of a text's words, A-Z as a-z: all words at once, eight bytes further at each step; long words on their own."""
    padded = b" " + text.translate(_LOWER) + b" " * 8
    gap = _IS_SPACE[np.frombuffer(padded, np.uint8)]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(padded) - 7, "<u8", padded, 0, 1)
    out = mixed(lengths.astype(np.uint64) * _SPREAD + (eights[starts] & _FIRST_BYTES[np.minimum(lengths, 8)]))
    at = np.flatnonzero(lengths > 8)
    for step in range(8, LONG_WORD, 8):
        at = at[lengths[at] > step]
        if not len(at):
            break
        out[at] = mixed(out[at] * _SPREAD + (eights[starts[at] + step] & _FIRST_BYTES[np.minimum(lengths[at] - step, 8)]))
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(padded[starts[i] : starts[i] + lengths[i]], SHINGLE_WORDS)
    return out


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text: its words in lower case (A-Z), hashed, then mixed in order."""
    hashes = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(hashes):
        return hashes
    k = min(SHINGLE_WORDS, len(hashes))
    out = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _SPREAD + hashes[i : len(hashes) - k + 1 + i]
    out = np.sort(mixed(out))
    return out[np.append(True, out[1:] != out[:-1])]


def overlap_needed(a, b):
    """Common shingles from which sets of a and b are similar."""
    return -(-LEAST * (a + b) // (LEAST + OF))


def prefix_length(n: int) -> int:
    return n + (-LEAST * n) // OF + 1


def _fold(values: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries step: counts of at most COMMON_KEPT values, each too low by what was taken off all."""
    new = np.sort(np.concatenate([values[:0], *more]))
    if not len(new):
        return values, counts
    first = np.flatnonzero(np.append(True, new[1:] != new[:-1]))
    seen, total = new[first], np.diff(np.append(first, len(new)))
    at = np.minimum(np.searchsorted(seen, values), len(seen) - 1)
    known = seen[at] == values
    total[at[known]] += counts[known]
    seen, total = np.concatenate([seen, values[~known]]), np.concatenate([total, counts[~known]])
    if len(seen) > COMMON_KEPT:
        total -= np.partition(total, -COMMON_KEPT - 1)[-COMMON_KEPT - 1]
    kept = np.flatnonzero(total > 0)
    kept = kept[np.argsort(seen[kept])]
    return seen[kept], total[kept]


def count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    values, counts, waiting, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    for batch in batches:
        for text in batch.column(0):
            waiting.append(shingle_set(text.as_py()))
            n += len(waiting[-1])
            if n >= GATHERED:
                values, counts = _fold(values, counts, waiting)
                waiting, n = [], 0
    values, counts = _fold(values, counts, waiting)
    kept = counts > 1
    yield pa.RecordBatch.from_arrays([pa.array(values[kept].view(np.int64)), pa.array(counts[kept])], names=["shingle", "n"])


class Common:
    """The order of shingles: rare ones by hash, then the common ones, the most common last."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray) -> None:
        order = np.lexsort((shingles, counts))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_hash = np.argsort(shingles)
        self.shingles, self.rank = shingles[by_hash], rank[by_hash]

    def prefix(self, of: np.ndarray) -> tuple[np.ndarray, int]:
        """The first shingles of a set, and how many of them are rare."""
        p = prefix_length(len(of))
        if not len(self.shingles) or not len(of):
            return of[:p], min(p, len(of))
        at = np.minimum(np.searchsorted(self.shingles, of), len(self.shingles) - 1)
        common = self.shingles[at] == of
        rare = of[~common][:p]
        if len(rare) == p:
            return rare, p
        last = of[common][np.argsort(self.rank[at[common]])]
        return np.concatenate([rare, last[: p - len(rare)]]), len(rare)


def common_shingles(docs: DataFrame, text_col: str) -> Common:
    """At most COMMON_KEPT shingles, counted over all texts."""
    counts = docs.select(text_col).mapInArrow(count_shingles, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "shingle").limit(COMMON_KEPT).collect()
    return Common(np.array([r.shingle for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64))


MARKS = "text_hash long, n long, hi long, lo long, prefix array<long>, rare int, bits binary"


def mark_sets(common: Common, prints: bool = False) -> Callable:
    """Rows (doc_id, text, ..) to (doc_id, .., n, hi, lo, prefix, rare, bits): the set's name, its first shingles and its bitmap, one
    for the band above its own; with prints also the set's SimHash (print; 0 if it is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, prefixes, rare, maps, marked = [], [], [], [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py())
                first, n_rare = common.prefix(found) if len(found) else (found, 0)
                sizes.append(len(found))
                names.append(np.frombuffer(hashlib.md5(found.tobytes()).digest(), "<i8"))
                prefixes.append(first.view(np.int64))
                rare.append(n_rare)
                maps.append(bitmap(found, band_bits(band_of(len(found)) + 1)).tobytes())
                if prints:
                    marked.append(majority(found) if len(found) else 0)
            hi, lo = (np.array([x[i] for x in names], np.int64) for i in (0, 1))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            more = [pa.array(marked, pa.int64())] if prints else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(hi), pa.array(lo), lists, pa.array(rare, pa.int32()), pa.array(maps, pa.binary()), *more],
                names=["doc_id", "text_hash", "n", "hi", "lo", "prefix", "rare", "bits", "print"][: 8 + len(more)],
            )

    return run


def _possible(n_a, at_a, n_b, at_b):
    """Pairs whose first common shingle may be this one: what follows it suffices for the overlap."""
    return np.minimum(n_a - at_a, n_b - at_b) >= overlap_needed(n_a, n_b)


def tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, n, uid, at) sorted by token, at odd for common shingles and twice the place: the pairs (uid, other) of small tiles,
    and the rows of large tiles.

    Sets alone in a tile are left out. No more than SMALL_TILE rows of a tile are held back."""
    names = ["token", "uid", "n", "at", "other"]
    held, large_token = None, None

    def split(cols: list[np.ndarray], ended: bool):
        nonlocal held, large_token
        token = cols[0]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        lengths = np.diff(np.append(starts, len(token)))
        large = (lengths > SMALL_TILE) | cols[4][starts] | (token[starts] == large_token if large_token is not None else False)
        if not ended:
            a = starts[-1]
            held = None if large[-1] else [c[a:] for c in cols]
            large_token = token[a] if large[-1] else None
            if not large[-1]:
                lengths[-1] = 0  # not yet complete
        of, keep = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(token)))), np.repeat(large, np.diff(np.append(starts, len(token))))
        if keep.any():
            rows = [c[keep] for c in cols[:4]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.nulls(len(rows[0]), pa.int64())], names=names)
        at = np.flatnonzero(np.repeat(~large & (lengths > 1), np.diff(np.append(starts, len(token)))))
        _, uid, n, place, _ = cols
        for step in range(1, SMALL_TILE):
            at = at[at + step < len(token)]
            at = at[of[at] == of[at + step]]
            if not len(at):
                return
            i, j = at, at + step
            hit = _possible(n[i], place[i], n[j], place[j])
            a, b = uid[i[hit]], uid[j[hit]]
            if len(a):
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(np.minimum(a, b)), none, none, pa.array(np.maximum(a, b))], names=names)

    for batch in batches:
        if batch.num_rows:
            token, n, uid, at = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            cols = [token, uid, n, at >> 1, at & 1 == 1]
            yield from split(cols if held is None else [np.concatenate(p) for p in zip(held, cols)], False)
    if held is not None:
        yield from split(held, True)


def band_of(n: int) -> int:
    return int(np.floor(np.log(max(1, n)) / np.log(BAND_RATIO)))


def band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(BAND_RATIO)))).cast("int")


def band_bits(band: int) -> int:
    """Bits of the bitmaps of a band: two to four for each shingle of its largest sets."""
    wide = 2 << int(np.ceil((band + 1) * np.log2(BAND_RATIO)))
    return min(max(wide, BITS[0]), BITS[1])


def bitmap(found: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(found & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(maps: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (rows of words) brought to bits, which divides their width."""
    while maps.shape[1] * 64 > bits:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def sorted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (uid, text) to (uid, members), the sorted hashes."""
    for batch in batches:
        sets = [shingle_set(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["uid", "members"])


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The hashes in each value of a binary column, where they lie."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = column.buffers()[2]
    return [np.frombuffer(data, np.uint64, (b - a) // 8, a) if b > a else np.zeros(0, np.uint64) for a, b in zip(offsets, offsets[1:])]


def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, left, right) to those (a, b) whose sorted arrays have the overlap needed."""
    for batch in batches:
        both = zip(_arrays(batch.column(2)), _arrays(batch.column(3)))
        hit = [len(np.intersect1d(x, y, assume_unique=True)) >= overlap_needed(len(x), len(y)) for x, y in both]
        yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))


@pandas_udf(BooleanType())
def may_be_similar(n_a: pd.Series, left: pd.Series, n_b: pd.Series, right: pd.Series) -> pd.Series:
    """Whether bit counts leave room for the overlap needed."""
    out = []
    for a, x, b, y in zip(n_a, left, n_b, right):
        x, y = (np.frombuffer(v, np.uint64)[None] for v in (x, y))
        bits = 64 * min(x.shape[1], y.shape[1])
        x, y = folded(x, bits), folded(y, bits)
        lacks, lacked = (int(np.bitwise_count(v).sum()) for v in (x & ~y, y & ~x))
        out.append(min(a - lacks, b - lacked) >= overlap_needed(a, b))
    return pd.Series(out, dtype=bool)


class Sets:
    """Sorted sets of classes, read from their first rows' texts when they are first needed.

    light: uid, n, bits of all classes; places: uid, doc_id, text_hash of all rows; texts: doc_id, text."""

    def __init__(self, light: DataFrame, places: DataFrame, texts: DataFrame) -> None:
        self.light, self.places, self.texts = light, places, texts
        self.repeated = not places.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
        self.known: DataFrame | None = None

    def of(self, pairs: DataFrame) -> DataFrame:
        """Sets of all that stand in pairs, which should be stored, and of more."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
        if self.known is not None:
            wanted = wanted.join(self.known.select("uid"), "uid", "left_anti")
        wanted = materialise(self.places.join(wanted, "uid").select("uid", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "jaccard-wanted")
        if self.known is None or not wanted.isEmpty():
            found = materialise(self._read(wanted), "jaccard-sets")
            self.known = found if self.known is None else self.known.unionByName(found)
        return self.known

    def _read(self, wanted: DataFrame) -> DataFrame:
        """A table of bits, of fixed size, tells most texts that nobody wants before any is moved; the join decides.

        What is read is stored before it is hashed: a task with one step in Python has one worker, and workers keep their memory."""
        word, bit = F.pmod(F.shiftright("_hash", 6), F.lit(FILTER_WORDS)), F.pmod(F.col("_hash"), F.lit(64))
        words = np.zeros(FILTER_WORDS, np.uint64)
        for w, b in wanted.groupBy(word.cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("b")).collect():
            words[w] = np.int64(b).view(np.uint64)

        @pandas_udf(BooleanType())
        def asked(hashes: pd.Series) -> pd.Series:
            h = hashes.to_numpy()
            return pd.Series((words[(h >> 6) % FILTER_WORDS] >> (h % 64).astype(np.uint64)) & np.uint64(1) == 1)

        source = self.texts.where(F.col("text").isNotNull()).withColumn("text_hash", F.xxhash64("text")).where(asked("text_hash"))
        read = source.join(wanted, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("uid", "text")
        if self.repeated:
            read = read.dropDuplicates(["uid"])  # rows alike in id and text
        return materialise(read, "jaccard-texts").mapInArrow(sorted_sets, "uid long, members binary")


def similar_pairs(pairs: DataFrame, sets: Sets) -> DataFrame:
    """Those of pairs (a, b) that are similar: by bit counts, then exactly."""
    left, right = (sets.light.select(*[F.col(c).alias(f"{c}_{side}") for c in ("uid", "n", "bits")]) for side in "ab")
    near = pairs.join(left, F.col("a") == F.col("uid_a")).join(right, F.col("b") == F.col("uid_b"))
    near = materialise(near.where(may_be_similar("n_a", "bits_a", "n_b", "bits_b")).select("a", "b"), "jaccard-near")
    members = sets.of(near)
    both = near.join(members.select(F.col("uid").alias("a"), F.col("members").alias("left")), "a")
    both = both.join(members.select(F.col("uid").alias("b"), F.col("members").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(similar, "a long, b long")


def best_pairs(pairs: DataFrame) -> DataFrame:
    """For each set the pair it is most often proposed in; pairs: (a, b, met)."""
    each = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.struct("met", "a", "b").alias("pair"))
    return each.groupBy("node").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b").distinct()


def proposals(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (token, chunk, turn, uid, n, comp), sorted: pairs of each set with its tile's first, and with the one before, if of other groups."""
    for rows, starts, lengths in whole_cells(parts, ["token", "chunk"]):
        uid, n, comp = (rows[c].to_numpy() for c in ("uid", "n", "comp"))
        at, first = np.arange(len(rows)), np.repeat(starts, lengths)
        other = np.flatnonzero(comp != comp[first])
        # the first set of another group speaks for the group of the tile's first
        cells, place = np.unique(first[other], return_index=True)
        speaker = first.copy()
        found = np.searchsorted(cells, first)
        has = (found < len(cells)) & (cells[np.minimum(found, len(cells) - 1)] == first) if len(cells) else np.zeros(len(rows), bool)
        speaker[has] = other[place[found[has]]]
        j = np.concatenate([np.where(comp != comp[first], first, speaker), np.maximum(at - 1, first)])
        i = np.concatenate([at, at])
        hit = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) >= overlap_needed(n[i], n[j]))
        a, b = uid[i[hit]], uid[j[hit]]
        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def banded_pairs(every: bool) -> Callable:
    """Rows (token, band, u, v, guest, uid, n, at, comp, bits), sorted by tile: pairs (a, b, met, by) of different groups that bit counts
    leave possible, or of these the NAMED best for each set, with the set that named them as by where it has others; met is the share in
    common, at best, in parts of a million.

    A guest is of the band below; guests do not meet each other here."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, lengths in whole_cells(parts, ["token", "band", "u", "v"]):
            for s, k in zip(starts.tolist(), lengths.tolist()):
                cell = rows.iloc[s : s + k]
                guest, uid, n, at, comp = (cell[c].to_numpy() for c in ("guest", "uid", "n", "at", "comp"))
                if k < 2 or guest.all() or (comp == comp[0]).all():
                    continue
                bits = band_bits(int(cell["band"].iloc[0]))
                maps = np.stack([folded(np.frombuffer(b, np.uint64)[None], bits)[0] for b in cell["bits"]])
                pop = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
                own = np.flatnonzero(~guest)
                step = max(1, (1 << 20) // (k * maps.shape[1]))
                for x in range(0, len(own), step):
                    i = own[x : x + step]
                    common = np.bitwise_count(maps[i, None] & maps[None]).sum(axis=2, dtype=np.int64)
                    most = np.minimum((n - pop)[i, None], (n - pop)[None]) + common
                    need = overlap_needed(n[i, None], n[None])
                    hit = (most >= need) & (comp[i, None] != comp[None]) & _possible(n[i, None], at[i, None], n[None], at[None])
                    share = 1_000_000 * most // np.maximum(1, n[i, None] + n[None] - most)
                    more = np.zeros(len(i), bool)
                    if every:
                        hit &= guest[None] | (uid[None] > uid[i, None])
                    else:
                        more = hit.sum(axis=1) > NAMED
                        for r in np.flatnonzero(more):
                            named = np.flatnonzero(hit[r])
                            hit[r, np.delete(named, np.argpartition(-share[r, named], NAMED)[:NAMED])] = False
                    p, q = np.nonzero(hit)
                    if len(p):
                        a, b = uid[i[p]], uid[q]
                        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "met": share[p, q], "by": pd.Series(a, dtype="Int64").where(more[p])})

    return run


class Groups:
    """Links known to hold, and the groups they make."""

    def __init__(self, nodes: DataFrame) -> None:
        self.links: DataFrame | None = None
        self.roots = nodes.sparkSession.createDataFrame([], "node long, root long")

    def add(self, links: DataFrame) -> bool:
        """Whether there were any."""
        links = materialise(links, "jaccard-links")
        if links.isEmpty():
            return False
        self.links = links if self.links is None else self.links.unionByName(links)
        self.roots = materialise(star_components(self.links), "jaccard-roots")
        return True

    def of(self, rows: DataFrame, node: str, name: str) -> DataFrame:
        """rows with the group of a column of sets."""
        named = self.roots.select(F.col("node").alias(node), F.col("root").alias(name))
        return rows.join(named, node, "left").withColumn(name, F.coalesce(name, node))

    def apart(self, pairs: DataFrame) -> DataFrame:
        return self.of(self.of(pairs, "a", "_a"), "b", "_b").where("_a <> _b").drop("_a", "_b")


def _proposed(tiles: DataFrame) -> DataFrame:
    """(a, b, met) that large tiles propose; tiles: token, uid, n, comp."""
    crowded = materialise(tiles.groupBy("token").count().where(F.col("count") > CHUNK_ROWS), "jaccard-crowded")
    cut = tiles.join(crowded, "token", "left")
    order = F.xxhash64("uid")
    cut = cut.select("token", F.pmod(order, F.coalesce(F.ceil(F.col("count") / CHUNK_ROWS), F.lit(1))).cast("int").alias("chunk"), order.alias("turn"), "uid", "n", "comp")
    keys = ["token", "chunk"]
    found = cut.repartition(*keys).sortWithinPartitions(*keys, "turn").mapInPandas(proposals, "a long, b long")
    return found.groupBy("a", "b").agg(F.count("*").alias("met"))


def _several(tiles: DataFrame) -> DataFrame:
    """Rows of tiles that hold more than one group."""
    mixed = tiles.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("token")
    return tiles.join(mixed, "token")


def _banded(tiles: DataFrame, light: DataFrame, every: bool, open_: DataFrame | None) -> DataFrame:
    """(a, b, met, first, last, whole): pairs of mixed tiles, the sets that named them and have others, and whether one named them that has not.

    open_: the sets (uid) that have pairs not yet named; only they, and the band below where they are, meet again."""
    own = band(F.col("n"))
    if open_ is None:
        hosts, guests = tiles.withColumn("band", own), tiles.withColumn("band", own + 1)
    else:
        hosts = tiles.join(open_, "uid", "left_semi").withColumn("band", own)
        guests = tiles.withColumn("band", own + 1).join(hosts.select("token", "band").distinct(), ["token", "band"], "left_semi")
    named = ["token", "uid", "n", "at", "comp", "band"]
    rows = hosts.select(*named, F.lit(False).alias("guest")).unionAll(guests.select(*named, F.lit(True).alias("guest")))
    rows = rows.join(light.select("uid", "bits"), "uid")
    keys = ["token", "band", "u", "v"]
    met = meeting_chunks(rows, ["token", "band"], ["uid"], CHUNK_ROWS)
    found = met.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(banded_pairs(every), "a long, b long, met long, by long")
    return found.groupBy("a", "b").agg(F.max("met").alias("met"), F.min("by").alias("first"), F.max("by").alias("last"), F.max(F.col("by").isNull()).alias("whole"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nearest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    nearest takes the classes (uid, print: the set's SimHash) to pairs (a, b) that are settled before all others; it changes no result."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    common = common_shingles(texts, "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    marks = texts.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(mark_sets(common, nearest is not None), f"doc_id {kind}, {MARKS}" + ", print long" * (nearest is not None))
    marks = materialise(marks.withColumn("uid", F.monotonically_increasing_id()), "jaccard-marks")
    full = marks.where("n > 0")
    prints = [F.any_value("print").alias("print")] if nearest else []
    classes = materialise(full.groupBy("hi", "lo").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("first"), *prints), "jaccard-classes")
    rows = full.join(classes.select("uid"), "uid").select("uid", "n", "rare", F.posexplode("prefix").alias("at", "token"))
    rows = rows.select("token", F.col("n").cast("int").alias("n"), "uid", (2 * F.col("at") + (F.col("at") >= F.col("rare")).cast("int")).alias("at"))
    part = F.when(F.col("at") % 2 == 1, F.pmod(F.xxhash64("uid"), F.lit(COMMON_PARTS))).otherwise(F.lit(0))
    sorted_rows = rows.repartition(F.col("token"), part).sortWithinPartitions("token", "n", "uid")
    found = materialise(sorted_rows.mapInArrow(tile_rows, "token long, uid long, n long, at long, other long"), "jaccard-tiles")
    pairs = found.where("other IS NOT NULL").groupBy(F.col("uid").alias("a"), F.col("other").alias("b")).agg(F.count("*").alias("met"))
    pairs = materialise(pairs, "jaccard-pairs")
    tiles = found.where("other IS NULL").drop("other")
    sets = Sets(full.select("uid", "n", "bits"), full.select("uid", "doc_id", "text_hash"), texts)
    groups = Groups(marks)
    if nearest:
        groups.add(similar_pairs(materialise(nearest(classes.select("uid", "print")), "jaccard-nearest"), sets))
        pairs = materialise(groups.apart(pairs), "jaccard-pairs")
    proposed = _proposed(groups.of(tiles, "uid", "comp") if nearest else tiles.withColumn("comp", F.col("uid")))
    groups.add(similar_pairs(best_pairs(pairs.unionByName(proposed)), sets))
    rest = materialise(groups.apart(pairs.select("a", "b")), "jaccard-rest")
    open_ = None
    for turn in range(ROUNDS + 1):
        mixed = materialise(_several(groups.of(tiles, "uid", "comp")), "jaccard-mixed")
        named = materialise(_banded(mixed, sets.light, turn == ROUNDS, open_), "jaccard-named")
        left = materialise(named.select(F.explode(F.array_compact(F.array("first", "last"))).alias("uid")).distinct(), "jaccard-open")
        ended = left.isEmpty()  # then these are all pairs
        chosen = named.select("a", "b") if ended else best_pairs(named)
        if not turn or ended:  # with what small tiles and earlier rounds have left
            chosen = chosen.unionByName(groups.apart(rest)).distinct()
        joined = groups.add(similar_pairs(chosen, sets))
        if ended:
            break
        kept = named.where("whole").select("a", "b")
        rest = materialise(groups.apart(kept if not turn else rest.unionByName(kept)), "jaccard-rest")
        open_ = left
        if not joined:
            others = _banded(mixed, sets.light, True, open_).select("a", "b")
            groups.add(similar_pairs(others.unionByName(rest).distinct(), sets))
            break
    rooted = groups.of(classes, "uid", "root")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = materialise(rooted.join(least, "root").select("hi", "lo", "component_id"), "jaccard-labels")
    named = full.join(labels, ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return named.unionByName(marks.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))

