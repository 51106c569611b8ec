"""A trie of conversation prefixes, its subtree sums read off an Euler tour.

Every distinct sequence of first turns is a node, named by its smallest conversation and its depth. Sequences are told apart by
two 64-bit hashes of place and content, joined by exclusive or along the conversation, so no text is shuffled. The tour enters a node,
walks through its children by conversation, and leaves it: an enter and an exit arc for each node, each with its successor, found by
joins on unique keys. The list of arcs is ranked by pointer jumping: every 64th arc (by hash) is a post; all arcs jump to
the next post, then posts jump among themselves, so all but the first few rounds run over a small share of the arcs. Leaves and saved
words lie on enter arcs; a subtree's sum is the difference of the prefix sums at its two arcs.

Nothing depends on the size of one key: ranks in a conversation and among siblings are counted in range partitions that may
cut a key anywhere, prefix sums run in blocks, and the conversations that end at one node are hashed from chunks written beforehand.

Rows with a null conv_id take no part. A null role or text is empty. Turns go by turn (null first), at a tie by a hash of role and
text; repeated rows are turns of their own. Texts of any length are read whole. Other columns, whatever their names, are not read. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.tables import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Places that are summed up in one window.
BLOCK = 1 << 16
#: One arc of so many is a post of the list ranking.
POST_GAP = 64
#: Conversations whose ids make one chunk of text.
CHUNK = 1 << 14
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _new_groups(keys: np.ndarray, last: np.ndarray | None) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    new[0] = last is None or bool((keys[0] != last).any())
    return new


def _keys(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(g).to_numpy() for g in names], axis=1)


def local_ranks(group: list[str]) -> Callable:
    """Sorted rows with their place, from 1, among the rows of their group in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, at = _keys(batch, group), np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(_new_groups(keys, last), at, -1))
            rank = np.where(start < 0, count + at + 1, at - start + 1)
            last, count = keys[-1], int(rank[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, pa.int64())], names=[*batch.schema.names, "place"])

    return run


def ranked(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """rows, stored, with their place (from 1) in their group by order; group columns are whole numbers and never null.

    Range partitions cut groups anywhere. What each partition's first group had before is known from one row a partition."""
    keys = [*group, *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(local_ranks(group), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", place long")
    placed = materialise(placed.withColumn("part", F.spark_partition_id()), label)
    parts = placed.groupBy("part").agg(F.min(F.struct(*group)).alias("first"), F.max(F.struct(*group, "place")).alias("last")).collect()
    offsets, before, known = [], None, 0
    for part, first, last in sorted(parts):
        # the range of a partition never falls before that of an earlier one
        known = known if before == tuple(first) else 0
        if known:
            offsets.append((part, *first, known))
        alone = tuple(first) == tuple(last)[:-1]
        before, known = tuple(last)[:-1], last["place"] + (known if alone else 0)
    if not offsets:
        return placed.drop("part")
    table = rows.sparkSession.createDataFrame(offsets, "part int, " + ", ".join(f"{g} long" for g in group) + ", earlier long")
    joined = placed.join(F.broadcast(table), ["part", *group], "left")  # at most one row a partition
    return joined.select(*rows.columns, (F.col("place") + F.coalesce("earlier", F.lit(0))).alias("place"))


def running(rows: DataFrame, group: list[str], place: str, values: list[str], combine: Callable[[str], Column], label: str) -> DataFrame:
    """rows, which should be stored, with run_<value> for each value: combined along place (dense, from 1) up to the row itself.

    Blocks of places are combined first, then what blocks come to, in the same way."""
    longest = rows.agg(F.max(place)).first()[0] or 0
    blocked = rows.withColumn("block", F.floor((F.col(place) - 1) / BLOCK).cast("long"))
    along = Window.partitionBy(*group, "block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    inside = blocked.select("*", *[combine(v).over(along).alias(f"run_{v}") for v in values])
    if longest <= BLOCK:
        return inside.drop("block")
    totals = blocked.groupBy(*group, "block").agg(*[combine(v).alias(v) for v in values])
    totals = materialise(totals.withColumn("following", F.col("block") + 1), label)
    before = running(totals, group, "following", values, combine, label)
    before = before.select(*group, F.col("following").alias("block"), *[F.col(f"run_{v}").alias(f"before_{v}") for v in values])
    joined = inside.join(before, [*group, "block"], "left")
    pair = {v: F.array(f"run_{v}", F.coalesce(f"before_{v}", F.lit(0))) for v in values}
    both = [(F.col(f"run_{v}").bitwiseXOR(pair[v][1]) if combine is F.bit_xor else pair[v][0] + pair[v][1]).alias(f"run_{v}") for v in values]
    return joined.select(*rows.columns, *both)


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), m1 and m2 (hashes of role and text) and words of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    half = [F.conv(F.substring(digest, a, 15), 16, 10).cast("long") for a in (1, 17)]
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        half[0].alias("m1"),
        half[1].alias("m2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return ranked(turns, ["conv_id"], ["turn", "m1", "m2"], "trie-turns").drop("turn")


def with_shared_openings(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations, and all conversations: c starts with the first h turns of c - c % every, then goes on with its
    own turns after its first h; h is the crc32 of c modulo most + 1."""
    opening = F.sort_array(F.collect_list(F.struct("place", "m1", "m2", "words")))
    firsts = turns.where(F.col("place") <= most).groupBy("conv_id").agg(opening.alias("opening"))  # no more than `most` turns each
    c = F.col("conv_id")
    cut = F.pmod(F.crc32(c.cast("string")), F.lit(most + 1)).cast("int")
    heads = turns.select("conv_id").distinct().select("conv_id", (c - c % every).alias("base"), cut.alias("h"))
    heads = heads.join(firsts.withColumnRenamed("conv_id", "base"), "base", "left")
    shared = F.when(F.col("opening").isNull(), F.array().cast(firsts.schema["opening"].dataType)).otherwise(F.slice("opening", F.lit(1), F.col("h")))
    heads = materialise(heads.select("conv_id", "h", shared.alias("opening")), "trie-heads")
    taken = heads.select("conv_id", F.posexplode("opening")).select("conv_id", (F.col("pos") + 1).cast("long").alias("place"), "col.m1", "col.m2", "col.words")
    sizes = heads.select("conv_id", "h", F.size("opening").alias("n"))
    own = turns.join(sizes, "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("n")).cast("long").alias("place"), "m1", "m2", "words")
    return taken.unionByName(own), heads.select("conv_id")


def trie_nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, words), and (conv_id, depth, member) of all conversations at the node they end at.

    turns: conv_id, place, m1, m2, words; convs: every conv_id, those without turns too."""
    term = [F.xxhash64(F.lit(seed), "place", "m1", "m2").alias(f"t{seed}") for seed in (1, 2)]
    steps = materialise(turns.select("conv_id", "place", "words", *term), "trie-steps")
    steps = running(steps, ["conv_id"], "place", ["t1", "t2"], F.bit_xor, "trie-runs")
    zero = F.lit(0).cast("long")
    paths = steps.select("conv_id", F.col("place").alias("depth"), F.col("run_t1").alias("k1"), F.col("run_t2").alias("k2"), "t1", "t2", "words")
    paths = materialise(paths.unionByName(convs.select("conv_id", *[zero.alias(x) for x in ("depth", "k1", "k2", "t1", "t2", "words")])), "trie-paths")
    key = ["depth", "k1", "k2"]
    found = paths.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        *[F.min(x).alias(x) for x in ("t1", "t2", "words")],
    )
    up = [F.col(k).bitwiseXOR(F.col(t)).alias(f"p_{k}") for k, t in (("k1", "t1"), ("k2", "t2"))]
    found = materialise(found.select(*key, "conv_id", "n_convs", "words", (F.col("depth") - 1).alias("p_depth"), *up), "trie-found")
    parents = found.select(*[F.col(k).alias(f"p_{k}") for k in key], F.col("conv_id").alias("parent_conv_id"))
    nodes = found.join(parents, [f"p_{k}" for k in key], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "words")
    last = paths.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("e")).select(F.col("conv_id").alias("member"), "e.*")
    ends = last.join(found.select(*key, "conv_id"), key).select("conv_id", "depth", "member")
    return materialise(nodes, "trie-nodes"), materialise(ends, "trie-ends")


def _post(arc: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), arc), F.lit(POST_GAP)) == 0


def _jump(open_: DataFrame, targets: DataFrame) -> DataFrame:
    """open_ (arc, next, hops) with next moved to where the arc called next points to; each target is one arc's next at most."""
    there = targets.select(F.col("arc").alias("next"), F.col("next").alias("beyond"), F.col("hops").alias("more"))
    return open_.join(there, "next").select("arc", F.col("beyond").alias("next"), (F.col("hops") + F.col("more")).alias("hops"))


def list_distances(arcs: DataFrame) -> DataFrame:
    """(arc, left) for lists given by (arc, next): how many arcs come after each; next is null at an end."""
    ended = F.col("next").isNull()
    todo = materialise(arcs.select("arc", "next", F.when(ended, 0).otherwise(1).cast("long").alias("hops")), "tour-arcs")
    stop = ended | _post("next")
    done, open_ = [todo.where(stop)], todo.where(~stop)
    while not open_.isEmpty():
        targets = open_
        for table in done:
            targets = targets.unionByName(table)
        moved = materialise(_jump(open_, targets.where(~_post("arc"))), "tour-jumps")
        done, open_ = [*done, moved.where(stop)], moved.where(~stop)
    near = done[0]
    for table in done[1:]:
        near = near.unionByName(table)
    posts = materialise(near.where(_post("arc")), "tour-posts")
    done, open_ = [posts.where(ended)], posts.where(~ended)
    while not open_.isEmpty():
        targets = open_
        for table in done:
            targets = targets.unionByName(table)
        moved = materialise(_jump(open_, targets), "tour-posts")
        done, open_ = [*done, moved.where(ended)], moved.where(~ended)
    far = done[0]
    for table in done[1:]:
        far = far.unionByName(table)
    far = far.select(F.col("arc").alias("next"), F.col("hops").alias("more"))
    return near.join(far, "next", "left").select("arc", (F.col("hops") + F.coalesce("more", F.lit(0))).alias("left"))


def _arc(conv_id: str | Column, depth: str | Column, leaves: bool) -> Column:
    return F.struct(F.col(conv_id).alias("c") if isinstance(conv_id, str) else conv_id.alias("c"), F.col(depth).alias("d") if isinstance(depth, str) else depth.alias("d"), F.lit(leaves).alias("x"))


def euler_tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arc, next) of all arcs, and the number of children of every node that has some: (conv_id, depth, n_children)."""
    children = nodes.where("depth > 0").select("parent_conv_id", "depth", "conv_id")
    children = ranked(children, ["parent_conv_id", "depth"], ["conv_id"], "tour-children")
    firsts = children.where("place = 1").select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.col("conv_id").alias("child"))
    enters = nodes.join(firsts, ["conv_id", "depth"], "left").select(
        _arc("conv_id", "depth", False).alias("arc"),
        F.when(F.col("child").isNull(), _arc("conv_id", "depth", True)).otherwise(_arc("child", F.col("depth") + 1, False)).alias("next"),
    )
    following = children.select("parent_conv_id", "depth", (F.col("place") - 1).alias("place"), F.col("conv_id").alias("sibling"))
    exits = children.join(following, ["parent_conv_id", "depth", "place"], "left").select(
        _arc("conv_id", "depth", True).alias("arc"),
        F.when(F.col("sibling").isNull(), _arc("parent_conv_id", F.col("depth") - 1, True)).otherwise(_arc("sibling", "depth", False)).alias("next"),
    )
    root = nodes.where("depth = 0").select(_arc("conv_id", "depth", True).alias("arc"))
    root = root.select("arc", F.lit(None).cast(root.schema["arc"].dataType).alias("next"))
    counts = children.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    return enters.unionByName(exits).unionByName(root), counts


def id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, depth, member) sorted, to (conv_id, depth, first member, joined members)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, members = _keys(batch, ["conv_id", "depth"]), batch.column(2).to_numpy()
        starts = np.flatnonzero(_new_groups(keys, None))
        ends = np.append(starts[1:], len(keys))
        cuts = [(a, min(a + CHUNK, b)) for s, b in zip(starts.tolist(), ends.tolist()) for a in range(s, b, CHUNK)]
        at = np.array([a for a, _ in cuts])
        texts = [",".join(map(str, members[a:b].tolist())) for a, b in cuts]
        yield pa.RecordBatch.from_arrays([pa.array(keys[at, 0]), pa.array(keys[at, 1]), pa.array(members[at]), pa.array(texts, pa.string())], names=["conv_id", "depth", "first", "ids"])


def chunk_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by node and first member, to (conv_id, depth, digest of all chunks, comma-joined)."""
    last, state, out = None, None, []
    for batch in batches:
        for c, d, ids in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "depth", "ids"))):
            if (c, d) == last:
                state.update(b"," + ids.encode())
                continue
            if last:
                out.append((*last, state.hexdigest()))
            last, state = (c, d), hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["conv_id", "depth", "ends_sha256"])
            out = []
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, state.hexdigest())], names=["conv_id", "depth", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node. Ids are joined where they lie; one task only hashes a node's chunks."""
    node = ["conv_id", "depth"]
    chunks = ends.repartitionByRange(*node, "member").sortWithinPartitions(*node, "member").mapInArrow(id_chunks, "conv_id long, depth long, first long, ids string")
    return chunks.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(chunk_digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes, ends = trie_nodes(turns, convs)
    arcs, counts = euler_tour(nodes)
    node = ["conv_id", "depth"]
    nodes = materialise(nodes.join(counts, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "trie-counted")
    distances = materialise(list_distances(arcs), "tour-distances")
    total = distances.count()
    spots = distances.select("arc.*", (F.lit(total) - F.col("left")).alias("spot"))
    gain = [(F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")]
    valued = spots.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), "x", "spot").join(nodes.select(*node, *gain), node)
    names = ["leaf", "saved"]
    on_enter = [F.when(F.col("x"), 0).otherwise(F.col(v)).cast("long").alias(v) for v in names]
    toured = running(materialise(valued.select(*node, "x", "spot", *on_enter), "tour-values"), [], "spot", names, F.sum, "tour-runs")
    # between enter and exit arc lies the subtree; the enter arc's own value is part of it
    inside = [F.sum(F.when(F.col("x"), F.col(f"run_{v}")).otherwise(F.col(v) - F.col(f"run_{v}"))).alias(v) for v in names]
    sums = toured.groupBy(*node).agg(*inside)
    joined = nodes.join(sums, node).join(end_digests(ends), node, "left")
    return joined.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaf").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
