"""Mixing sources to target weights by a low-discrepancy schedule of blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.operators.ordering import RangeOrdered, global_row_number
from sievegrid.session import durable

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
CELLS, CHUNK, ROWS_PER_BUCKET = 4096, 1024, 512


@dataclass
class Mix:
    """sources: (source, source_size, target, blocks); schedule: (slot, source, pass, block, words);
    documents: one row per input row with its place in its source's line and ``taken``."""

    sources: DataFrame
    schedule: DataFrame
    documents: DataFrame
    block: int


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, limit: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size, rank, target) of (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the sum of all sizes. A target stops at ``limit`` times its source's size;
    the excess goes to the others by weight until none is above. The state of
    that loop is one number, the share of a unit of weight.
    """
    ranked = global_row_number(
        sizes.withColumn("_null", F.col("source").isNull().cast("int")), ["_null", "source"], "rank"
    ).drop("_null")
    turn = ((F.col("rank") - 1) % len(weights) + 1).cast("int")
    ranked = durable(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)))
    top = limit * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, stopped = 0.0, None
    while total:
        above = F.col("weight") * share > top
        free, full, n = ranked.agg(
            F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, top)), F.count(F.when(above, 1))
        ).first()
        if n == stopped or not free:
            break
        share, stopped = (total - (full or 0.0)) / free, n
    return ranked.withColumn("target", F.least(F.col("weight") * share, top).cast("double"))


def lines(sized: DataFrame) -> DataFrame:
    """``sized`` with ``start``: the words before each row in its source's shuffled line.

    Rows are dealt by hash into buckets of about ``ROWS_PER_BUCKET``; sums of
    whole buckets come first, added up in ranges, then the rows of one bucket, so
    no task sees a whole source, nor all its buckets.
    """
    buckets = max(1, -(-sized.count() // ROWS_PER_BUCKET))
    dealt = sized.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    sums = RangeOrdered(sums, ["s"], ["bucket"]).running_sum("n", "upto").withColumn("before", F.col("upto") - F.col("n"))
    inside = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "size")
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(before(inside)), F.lit(0)))
    joined = placed.join(sums.drop("n", "upto"), ["s", "bucket"])
    return joined.withColumn("start", F.col("before") + F.col("inside")).drop("bucket", "before", "inside")


def schedule(sources: DataFrame, total: int, block: int, passes: int) -> DataFrame:
    """(slot, s, pass, block, words): which block of which source every slot takes, and its first words.

    Slot k looks at the golden-ratio point (k + 1/2) / phi mod 1 on the line of
    cumulative targets. The r-th slot of a source takes its block r mod n in
    pass r div n. Points meet sources in ``CELLS`` cells of the line, and slots
    are counted by chunks of ``CHUNK`` before they are numbered, so that no
    source is numbered in one task.

    Points know nothing of part-filled blocks, nor of sources smaller than a
    block, so every source is settled: slots past its target go, the one that
    reaches it takes a part of its block, and blocks still missing (a few for
    any source) follow in slots after the last one.
    """
    spark = sources.sparkSession
    share = RangeOrdered(sources, [], ["rank"]).running_sum("target", "high")
    share = share.select("s", "blocks", "rank", (F.col("high") - F.col("target")).alias("low"), "high").filter("high > low")
    cell = lambda x: F.least(F.floor(x / F.lit(float(total)) * CELLS), F.lit(CELLS - 1)).cast("int")
    wide = share.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    last = F.col("high") >= total * (1 - 1e-12)
    slots = spark.range(-(-total // block)).select(F.col("id").alias("slot"), (F.col("id") + 0.5).alias("p"))
    point = (F.col("p") * GOLDEN) % 1.0 * F.lit(float(total))
    slots = slots.select("slot", point.alias("x")).withColumn("cell", cell(F.col("x")))
    met = slots.join(wide, "cell").filter((F.col("x") >= F.col("low")) & ((F.col("x") < F.col("high")) | last))
    met = met.select("slot", "s", "blocks", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = met.groupBy("s", "chunk").agg(F.count("slot").alias("n"))
    counts = counts.select("s", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    ranked = met.withColumn("inside", inside).join(counts, ["s", "chunk"]).withColumn("r", F.col("inside") + F.col("before"))
    own = sources.filter("source_size > 0").withColumn(
        "due", F.least(F.round("target").cast("long"), passes * F.col("source_size"))
    )
    whole, rest = F.floor(F.col("due") / F.col("source_size")), F.col("due") % F.col("source_size")
    own = own.select("s", "source_size", "blocks", "due", (whole * F.col("blocks") + F.ceil(rest / block)).alias("needed"))
    got = ranked.groupBy("s").agg(F.count("slot").alias("got"))
    short = own.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < needed")
    short = durable(short.select("s", F.explode(F.sequence("got", F.col("needed") - 1)).alias("r")))
    late = global_row_number(short, ["s", "r"], "late").select((F.col("late") - 1 - (total // -block)).alias("slot"), "s", "r")
    settled = ranked.select("slot", "s", "r").unionByName(late).join(own, "s").filter("r < needed")
    settled = settled.withColumn("pass", F.floor(F.col("r") / F.col("blocks"))).withColumn("block", F.col("r") % F.col("blocks"))
    left = F.col("due") - F.col("pass") * F.col("source_size") - F.col("block") * block
    return settled.select("slot", "s", "pass", "block", F.least(left, filled(block)).alias("words"))


def filled(block: int) -> Column:
    """The words of a block: the last one of a source may be part-filled."""
    return F.least(F.lit(block), F.col("source_size") - F.col("block") * block)


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    passes: int = 3,
    slots: int = 1 << 18,
    seed: int = 17,
) -> Mix:
    """How many words of every document a mix of as many words as ``docs`` has takes.

    A source's shuffled line of words is cut into equal blocks, about ``slots``
    of them over all sources at any size of the input. Its last slot takes what
    its target still lacks, so every source, however small, gets its target to
    the word. Blocks cut documents where they fall.
    Null texts have no words and null is a source of its own. Repeated rows are
    documents of their own; columns other than the three are ignored.
    """
    s = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-")).alias("s")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), s, words(F.col(text)).alias("size"))
    sized = durable(rows.withColumn("h", F.xxhash64("doc_id", "s", F.lit(seed))))
    sizes = sized.groupBy("s", "source").agg(F.sum("size").alias("source_size"))
    found = durable(targets(sizes, passes, weights))
    total = found.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, -(-total // slots))
    found = found.withColumn("blocks", F.ceil(F.col("source_size") / block))
    plan = durable(schedule(found, total, block, passes))
    full = F.col("words") == filled(block)
    uses = plan.join(found.select("s", "source_size"), "s").groupBy("s", "block")
    uses = uses.agg(F.count(F.when(full, 1)).alias("uses"), F.coalesce(F.max(F.when(~full, F.col("words"))), F.lit(0)).alias("part"))
    line = durable(lines(sized))
    end = F.col("start") + F.col("size")
    numbers = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    pieces = line.filter("size > 0").select("s", "start", "size", F.explode(numbers).alias("block"))
    first = F.col("block") * block
    overlap = lambda length: F.greatest(F.least(end, first + length) - F.greatest("start", first), F.lit(0))
    taken = (
        pieces.join(uses, ["s", "block"])
        .groupBy("s", "start", "size")
        .agg(F.sum(overlap(F.lit(block)) * F.col("uses") + overlap(F.col("part"))).alias("taken"))
    )
    with_taken = line.join(taken, ["s", "start", "size"], "left")
    out = with_taken.join(found.select("s", "source_size", "target"), "s")
    out = out.select("doc_id", "source", "size", "source_size", "target", "start", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return Mix(found, plan, out, block)
