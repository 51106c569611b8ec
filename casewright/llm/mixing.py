"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Document rates that stay closest to 1 in relative entropy,
meet every source's target and do not exceed CAP are exponentially tilted: rate = min(CAP, exp(lambda * size /
mean size)), one lambda for each source. Newton steps on the convex dual find the lambdas; a step is one
aggregation over the histogram of sizes. Rates are then rounded into copies with error feedback: within
each part of a source, from large to small documents, a copy more or less is chosen so that the words taken stay
close to the words due.

All that is known of a source (words, target, lambda) stays in a table with one row a source; only sums over that
table reach the driver, so any number of sources can be mixed. A source is one part unless it holds several times
PART_ROWS documents with words itself; then its longest PART_ROWS documents stay one part and the others are dealt by
document. So the rounding of a source depends on its own rows only, few long documents are always rounded together, and
a source that holds a third of all rows is spread.

Nulls: a null text has size 0 and takes nothing; null is a source of its own, the last; a null doc_id is an id like any
other. Rows alike in doc_id, source and size are one unit: as many of them get one copy more as the words due ask for, so targets are
met where ids are null or repeat; mix_documents gives it to the rows with the least hashes (rows that differ only in map or variant columns
count as alike there). Ids are handed on as they are, of whatever type. Texts of any length only count their words. Ties in size go by a hash of the id, then by the id.
Other columns, whatever their names, are carried along by mix_documents. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm.tables import materialise, whole_rows
from casewright.operators.ranks import edge_rows

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2.0
TOLERANCE = 1e-9
MAX_STEPS = 60
#: Documents, more or less, that one part of a large source rounds.
PART_ROWS = 200_000
#: Rows alike that are written out at once.
REPEAT_ROWS = 10_000
#: A unit with more than one of so many of all rows is joined by broadcast: there are no more such units than this.
LARGE_UNITS = 1000
#: Columns that rounding hands on.
UNIT = ("doc_id", "source", "size", "n", "source_size", "target")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A name for each source that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def weighted_sources(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """totals with the weight of each source: the weights repeat in order of code point, null last.

    Sources are numbered in two levels: by slice of the sorted table, and inside the slice."""
    order = [F.col("source").isNull(), F.col("source")]
    sliced = materialise(totals.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy("slice").count().select("slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    place = F.col("first") + F.row_number().over(Window.partitionBy("slice").orderBy(*order)) - 1
    numbered = sliced.join(offsets, "slice").withColumn("place", place)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int"))
    return numbered.withColumn("weight", weight.cast("long")).drop("slice", "first", "place")


def with_targets(sources: DataFrame, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """sources (words, weight, ..) with target: budget times all words, shared by weight, none above cap times its words.

    What is over is reshared until none is above: each round sums up the sources above their share, and no more than a
    few rounds are needed, whatever the number of sources. Sums are of whole numbers, so their order does not show."""
    (total,) = sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()
    unit, last = 0.0, None
    while True:
        over = F.lit(unit) * F.col("weight") > F.lit(cap) * F.col("words") if last is not None else F.lit(False)
        capped, weight = sources.agg(F.coalesce(F.sum(F.when(over, F.col("words"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if (capped, weight) == last:
            break
        last = capped, weight
        if not weight:  # all are at the cap
            unit = math.inf
            break
        unit = max(0.0, budget * total - cap * capped) / weight
    most = F.lit(float(cap)) * F.col("words")
    return sources.withColumn("target", most if math.isinf(unit) else F.least(most, F.lit(float(unit)) * F.col("weight")))


def tilts(histogram: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """sources (key, words, filled, target, ..) with mean and tilt, the lambda of each; null where the target is the cap itself.

    histogram: (key, size, n) of all sizes above 0. Newton steps on the dual, kept within a bracket; every step is one pass
    over the histogram and writes the sources' state anew."""
    log_cap = math.log(cap)
    none = F.lit(None).cast("double")
    words, due = F.col("words").cast("double"), F.col("target")
    at_cap = due >= F.lit(cap) * words * (1 - 1e-12)
    state = sources.withColumn("mean", words / F.greatest(F.col("filled"), F.lit(1))).select(
        "*",
        F.when(~at_cap & (words > 0), F.ln(due / words)).when(~at_cap, F.lit(0.0)).alias("tilt"),
        none.alias("low"),
        none.alias("high"),
        (F.col("words") > 0) & ~at_cap & (F.abs(due - words) > TOLERANCE * due),
    )
    state = materialise(state.toDF(*state.columns[:-1], "open"), "mix-state")
    kept = [c for c in state.columns if c not in ("tilt", "low", "high", "open")]
    for _ in range(MAX_STEPS):
        if not state.where("open").limit(1).count():
            break
        at, low, high = F.col("tilt"), F.col("low"), F.col("high")
        part = F.col("size") / F.col("mean")
        power = at * part
        taken = F.col("n") * F.col("size") * F.exp(F.least(power, F.lit(log_cap)))
        now = state.where("open").select("key", "mean", "tilt")
        sums = histogram.join(now, "key").groupBy("key").agg(F.sum(taken).alias("g"), F.sum(F.when(power < log_cap, taken * part).otherwise(0.0)).alias("h"))
        joined = state.join(sums, "key", "left")
        met = F.abs(F.col("g") - due) <= TOLERANCE * due
        low, high = F.when(F.col("g") < due, at).otherwise(low), F.when(F.col("g") < due, high).otherwise(at)
        joined = joined.select(*kept, "tilt", "open", "g", "h", met.alias("met"), low.alias("low"), high.alias("high"))
        low, high = F.col("low"), F.col("high")
        # Newton on the logarithm, which a sum of exponentials makes nearly straight
        newton = F.when((F.col("h") > 0) & (F.col("g") > 0), at - F.col("g") * F.ln(F.col("g") / due) / F.col("h"))
        inside = (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        halved = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).when(high.isNull(), at * 2 + 1).otherwise(at * 2 - 1)
        stuck = F.coalesce(high - low <= 1e-15 * F.greatest(F.lit(1.0), F.abs(at)), F.lit(False))
        moves = F.col("open") & ~F.col("met") & ~stuck
        step = F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(halved)
        state = materialise(joined.select(*kept, F.when(moves, step).otherwise(at).alias("tilt"), "low", "high", moves.alias("open")), "mix-state")
    # the order of summation must not show
    return state.select(*kept, F.format_string("%.9e", F.col("tilt")).try_cast("double").alias("tilt"))


def round_copies(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """whole and more of units (.., key, part, size, n, rate), sorted by key, part and falling size, with error feedback.

    Every row of a unit is taken whole times, and more of its rows once more."""
    at, due = None, 0.0
    for part in parts:
        wholes, mores = [], []
        for key, of, size, n, rate in zip(*(part.column(c).to_pylist() for c in ("key", "part", "size", "n", "rate"))):
            if (key, of) != at:
                at, due = (key, of), 0.0
            whole = math.floor(rate)
            due += (rate - whole) * size * n
            more = min(n, max(0, math.floor(due / size + 0.5))) if rate > whole and size else 0
            due -= more * size
            wholes.append(whole)
            mores.append(more)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in UNIT), pa.array(wholes, pa.int32()), pa.array(mores, pa.int64())], names=[*UNIT, "whole", "more"])


def dealt_sources(histogram: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source of many documents: key, dealt, and longest.

    dealt is the number of parts of its shorter documents; longest the least size such that at most PART_ROWS of its documents are
    as large or larger, null if more are of its largest size. One window row for each distinct size."""
    large = sources.where(F.col("filled") >= 2 * PART_ROWS).select("key", F.floor(F.col("filled") / PART_ROWS).alias("dealt"))
    so_far = F.sum("n").over(Window.partitionBy("key").orderBy(F.desc("size")))
    sizes = histogram.join(large, "key").withColumn("so_far", so_far)
    return sizes.groupBy("key", "dealt").agg(F.min(F.when(F.col("so_far") <= PART_ROWS, F.col("size"))).alias("longest"))


def plan_mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, n (rows alike), whole, more, source_size, target for (doc_id, source, size) rows: each of the n rows is
    taken whole times, and `more` of them once more."""
    sizes = sizes.withColumn("key", source_key(F.col("source")))
    totals = sizes.groupBy("source", "key").agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.count_if(F.col("size") > 0).alias("filled"))
    sources = materialise(with_targets(materialise(weighted_sources(totals, weights), "mix-weights"), budget, cap), "mix-targets")
    histogram = materialise(sizes.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")), "mix-histogram")
    state = tilts(histogram, sources, cap).select("key", F.col("words").alias("source_size"), "target", (F.col("tilt") / F.col("mean")).alias("tilt"))
    facts = materialise(state.join(dealt_sources(histogram, sources), "key", "left"), "mix-facts")
    rows, blank = sources.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum(F.col("rows") - F.col("filled")), F.lit(0))).first()
    # size 0 takes nothing whatever its part: a source may hold any number of such rows
    spread = F.col("dealt").isNotNull() & ~F.coalesce(F.col("size") >= F.col("longest"), F.lit(False))
    part = (
        F.when(F.col("size") == 0, F.pmod(F.xxhash64("doc_id"), F.lit(max(1, blank // PART_ROWS))))
        .when(spread, 1 + F.pmod(F.xxhash64("doc_id", "size"), "dealt"))
        .otherwise(0)
    )
    # summed up where they lie: rows alike may be any share of all
    alike = sizes.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("n"))
    units = alike.join(facts, "key").select(*UNIT, "key", "tilt", part.cast("long").alias("part"))
    rate = F.when(F.col("tilt").isNull(), F.lit(float(cap))).otherwise(F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(math.log(cap)))))
    rated = units.select(*UNIT, "key", "part", F.least(rate, F.lit(float(cap))).alias("rate")).repartition(max(1, rows // PART_ROWS), "key", "part")
    sorted_ = rated.sortWithinPartitions("key", "part", F.desc("size"), F.xxhash64("doc_id"), "doc_id")
    id_type = sizes.schema["doc_id"].dataType.simpleString()
    return sorted_.mapInArrow(round_copies, f"doc_id {id_type}, source string, size long, n long, source_size long, target double, whole int, more long")


def document_sizes(docs: DataFrame) -> DataFrame:
    return materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")


def repeated(rows: DataFrame, n: Column) -> DataFrame:
    """Every row of rows n times. What is to be written very often is first cut into batches, which are spread."""
    counted = rows.withColumn("_n", n.cast("long"))
    batches = F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / REPEAT_ROWS))
    many = counted.where(F.col("_n") > REPEAT_ROWS).withColumn("_batch", F.explode(batches))
    size = F.least(F.col("_n") - F.col("_batch") * REPEAT_ROWS, F.lit(REPEAT_ROWS))
    many = many.repartition("_batch").withColumn("_n", size).drop("_batch")
    few = counted.where(F.col("_n").between(1, REPEAT_ROWS))
    both = few.unionAll(many)
    return both.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")


def mix_report(docs: DataFrame) -> DataFrame:
    """For every document: its words, its source's words and target, copies, and words taken."""
    plan = materialise(plan_mix(document_sizes(docs)), "mix-plan")
    once, again = F.struct((F.col("n") - F.col("more")).alias("times"), F.col("whole").alias("copies")), F.struct(F.col("more").alias("times"), (F.col("whole") + 1).alias("copies"))
    each = plan.select("doc_id", "size", "source_size", "target", F.inline(F.array(once, again)))
    each = repeated(each, F.col("times"))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (row, source, size, ..) of units that are taken, with n, whole and more.

    Units that hold a large share of all rows are few, so they go to the rows; the others meet them by a merge join, at every
    size, as the plan grows with the rows."""
    (total,) = plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()
    named = plan.select(F.col("doc_id").alias("plan_id"), F.col("source").alias("plan_source"), F.col("size").alias("plan_size"), "n", "whole", "more")
    large = F.col("n") * LARGE_UNITS > total
    same = F.col("row.doc_id").eqNullSafe(F.col("plan_id")) & F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("size") == F.col("plan_size"))
    large &= F.col("n") > 1
    few = named.where(large)
    if few.isEmpty():
        return rows.join(named.hint("merge"), same).where((F.col("whole") > 0) | (F.col("more") > 0))
    marked = rows.join(F.broadcast(few), same, "left")
    found = marked.where(F.col("n").isNotNull())
    rest = marked.where(F.col("n").isNull()).select(*rows.columns).join(named.where(~large).hint("merge"), same)
    return found.unionByName(rest).where((F.col("whole") > 0) | (F.col("more") > 0))


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; rows it does not take are gone."""
    hashed = [F.col("row")[f.name] for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    rows = whole_rows(docs, F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    joined = with_plan(rows, materialise(plan_mix(document_sizes(docs)), "mix-plan"))
    mixed = F.col("more").between(1, F.col("n") - 1)
    even = joined.where(~mixed).withColumn("copies", F.col("whole") + (F.col("more") > 0).cast("int"))
    # a document is taken CAP times at most
    even = even.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    # units of which some rows are taken once more than others: rows wholly alike first become one
    unit = ["plan_id", "plan_source", "plan_size"]
    alike = joined.where(mixed).withColumn("_hash", F.xxhash64(*hashed)).groupBy(*unit, "more", "_hash").agg(F.any_value("row").alias("row"), F.count("*").alias("n"), F.max("whole").alias("whole"))
    alike = materialise(alike, "mix-alike")
    edge = edge_rows(repeated(alike.select(*unit, "more", "_hash", "n"), F.col("n")), unit, "more", [F.col("_hash")], {})
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"e.{c}")) for c in unit]
    placed = alike.alias("a").join(edge.alias("e"), same, "left").select("a.row", "a.n", "a.whole", F.when(F.col("a._hash") < F.col("e._edge.o0"), F.col("a.n")).when(F.col("a._hash") == F.col("e._edge.o0"), F.col("e._left")).otherwise(0).alias("extra"))
    uneven = repeated(placed.select("row", (F.col("n") * F.col("whole") + F.col("extra")).alias("_times")), F.col("_times")).select("row")
    return even.select("row").unionByName(uneven).select("row.*")
