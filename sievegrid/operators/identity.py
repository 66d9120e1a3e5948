"""Near-identity inside a batch: an edit-bounded self join that keeps classes instead of pairs.

Two sequences are near-identical when their edit distance is at most
d = (1 - t) times the longer length, rounded down. The shorter is cut into windows of a fixed
length; d edits can touch d of them, so of any d + 1 windows one stands unchanged
in the longer sequence, shifted by d letters at most. Windows are chosen from rare to
frequent, so a frame that all sequences share is looked up only by sequences that have
nothing else. Candidates are tested by a banded edit distance in the JVM.

A window that many sequences still share would make all pairs of its group. There every
sequence is first compared with one of them, and two that are near-identical to it are
in one class already and don't meet any more.

The windows looked up are many times larger than the letters. They are made for some sequences at a
time, for all in the end, and leave the disk with their part.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.operators.components import connected_components
from sievegrid.session import durable, rebalance, release, unnest

HEAVY = 1 << 14  # at most so many windows count as frequent
PART, PARTS = 1 << 17, 8  # sequences whose windows are looked up at a time, and parts at most
WAITING = 1 << 20  # pairs, or an eighth of the sequences, that are compared at a time (about)
EPS = 1e-9


def edits(n, t: float):
    """Edits that near-identity allows to a longer length ``n`` (a column or a number)."""
    if isinstance(n, Column):
        return F.floor(n * (1 - t) + EPS).cast("int")
    return math.floor(n * (1 - t) + EPS)


def most_edits(n, t: float):
    """Edits allowed between a sequence of length ``n`` and any that is at least as long."""
    longest = F.floor(n / t + EPS) if isinstance(n, Column) else math.floor(n / t + EPS)
    return edits(longest, t)


def window_length(t: float) -> int:
    """A length of which every sequence that can have a partner holds one window more than edits."""
    shortest = next(n for n in range(1, 1 << 20) if most_edits(n, t) > 0)
    return min(n // (most_edits(n, t) + 1) for n in range(shortest, 40 * shortest))


def _index(nodes: DataFrame, t: float, w: int) -> DataFrame:
    """(key, id, n, at): the rarest windows of each sequence, one more than edits."""
    starts = F.sequence(F.lit(0), F.floor(F.col("n") / w).cast("int") - 1)
    windows = F.transform(starts, lambda j: F.struct(F.xxhash64(F.substring("seq", j * w + 1, F.lit(w))).alias("key"), (j * w).alias("at")))
    rows = unnest(nodes.filter(F.col("n") >= w), windows, "_w", "id", "n").select("id", "n", "_w.key", "_w.at")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    total = counts.agg(F.sum("f")).first()[0] or 0
    heavy = counts.filter(F.col("f") > max(32, total // HEAVY))
    seen = rows.join(F.broadcast(heavy), "key", "left")
    order = F.struct(F.coalesce("f", F.lit(0)).alias("f"), "at", "key")
    per = seen.groupBy("id", "n").agg(F.array_sort(F.collect_list(order)).alias("_ws"))
    return unnest(per, F.slice("_ws", F.lit(1), most_edits(F.col("n"), t) + 1), "_w", "id", "n").select("_w.key", "id", "n", "_w.at")


def _probes(nodes: DataFrame, t: float, w: int) -> DataFrame:
    """(key, id, n, at): the windows of each sequence that stand near a cut of a shorter one."""
    timely = nodes.withColumn("d", edits(F.col("n"), t)).filter("d > 0")
    every = unnest(timely, F.sequence(F.lit(0), F.col("n") - w), "at", "id", "n", "d", "seq")
    placed = every.filter((F.col("at") % w <= F.col("d")) | (F.col("at") % w >= w - F.col("d")))
    return placed.select(F.xxhash64(F.substring("seq", F.col("at") + 1, F.lit(w))).alias("key"), "id", "n", "at")


def _near(pairs: DataFrame, texts: DataFrame, t: float) -> DataFrame:
    """The pairs (a, b) whose edit distance is small enough."""
    a = texts.select(F.col("id").alias("a"), F.col("seq").alias("a_seq"))
    b = texts.select(F.col("id").alias("b"), F.col("seq").alias("b_seq"))
    full = rebalance(pairs.join(a, "a").join(b, "b"))
    longer = F.greatest(F.length("a_seq"), F.length("b_seq"))
    full = full.withColumn("_d", edits(longer, t))
    return full.filter(F.expr("levenshtein(a_seq, b_seq, _d)") >= 0).select("a", "b")


def _met(left: DataFrame, right: DataFrame, t: float, *by: str) -> DataFrame:
    """(a, b): entries of the index that probes meet under the same key and near enough; a star is met by no other way."""
    starred = "star" in left.columns
    right = right.select("key", *by, *[F.col(c).alias(f"b_{c}") for c in right.columns if c not in ("key", *by)])
    d = edits(F.col("b_n"), t)
    fits = (F.col("b_n") - F.col("n")).between(0, d) & (F.abs(F.col("at") - F.col("b_at")) <= d)
    once = (F.col("n") < F.col("b_n")) | (F.col("id") < F.col("b_id"))
    met = left.join(right, ["key", *by]).filter(fits & once & (F.col("id") != F.col("b_id")))
    if starred:
        met = met.filter(F.col("star").isNull() | F.col("b_star").isNull() | (F.col("star") != F.col("b_star")))
    return met.select(F.col("id").alias("a"), F.col("b_id").alias("b"))


def near_links(nodes: DataFrame, t: float, crowd: int = 64) -> DataFrame:
    """(a, b): links that join all near-identical sequences of ``nodes`` (id, seq), each seq once, to classes.

    Every linked pair is near-identical; pairs that are linked through a third sequence may be left out.
    ``nodes`` is read many times.
    """
    w = window_length(t)
    if w < 1:
        raise ValueError(f"identity of {t} leaves no windows")
    spark, total = nodes.sparkSession, nodes.count()
    nodes = nodes.select("id", "seq", F.length("seq").alias("n"))
    parts = min(PARTS, max(1, -(-total // PART)))
    probes = [_probes(nodes.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part), t, w) for part in range(parts)]
    index = durable(_index(nodes, t, w))
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("star"))
    crowded = durable(sizes.filter(F.col("size") > crowd))
    release(spark)
    crowds = crowded.count()
    few = F.broadcast(crowded) if crowds <= HEAVY else crowded

    def compared(groups: Iterable[DataFrame]) -> DataFrame:
        """The near pairs of many groups, as many groups at a time as hold few pairs."""
        found, waiting, n = None, None, 0
        for i, pairs in enumerate(groups, 1):
            pairs = durable(pairs.distinct())
            n += pairs.count()
            waiting = pairs if waiting is None else waiting.unionByName(pairs)
            del pairs
            release(spark)
            if i == parts or n > max(WAITING, total // 8):
                near = durable(_near(waiting, nodes, t))
                found, waiting, n = near if found is None else found.unionByName(near), None, 0
                del near
                release(spark)
        return found

    if not crowds:
        return compared(_met(index, some, t) for some in probes)

    def rays_of(part: int) -> DataFrame:
        members = probes[part].select("key", "id")
        members = members.unionByName(index.select("key", "id")) if part == 0 else members
        return members.join(few, "key").select(F.col("id").alias("a"), F.col("star").alias("b")).filter("a <> b")

    rays = durable(compared(rays_of(part) for part in range(parts)).distinct())
    # in a crowded group: the sequence next to its star (the star itself included), else null
    near_star = rays.select(F.col("a").alias("id"), F.col("b").alias("star"), F.lit(True).alias("ray"))

    def starred(rows: DataFrame) -> DataFrame:
        marked = rows.join(few, "key").join(near_star, ["id", "star"], "left")
        return marked.withColumn("star", F.when(F.col("ray") | (F.col("id") == F.col("star")), F.col("star"))).drop("ray")

    def pairs_of(some: DataFrame) -> DataFrame:
        plain = _met(index.join(few, "key", "left_anti"), some.join(few, "key", "left_anti"), t)
        salts = F.ceil(F.col("size") / 1024).cast("int")
        left = starred(index).withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).drop("size")
        right = starred(some).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("size")
        return plain.unionByName(_met(left, right, t, "salt"))

    return rays.unionByName(compared(pairs_of(some) for some in probes))


def near_identical(rows: DataFrame, key: str, seq: str, min_identity: float = 0.98) -> DataFrame:
    """``rows`` with ``cluster``, the smallest key of all rows that near-identity joins to it, and ``kept``,
    whether the row is that one.

    Equal sequences are one class; a missing or empty sequence is near to nothing. Rows without key are
    joined by their sequence, too, and aren't kept unless no row of their class has a key.
    """
    text = F.col(seq).cast("string")
    known = F.coalesce(F.length(text), F.lit(0)) > 0
    nodes = rows.filter(known).groupBy(text.alias("seq")).agg(F.min(key).alias("_least"))
    nodes = durable(nodes.withColumn("id", F.monotonically_increasing_id()))
    release(rows.sparkSession)
    links = durable(near_links(nodes.select("id", "seq"), min_identity))
    release(rows.sparkSession)
    # most sequences are near to none and a class of their own
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    parts = durable(connected_components(ends, links))
    least = parts.join(nodes.select("id", "_least"), "id").groupBy("component").agg(F.min("_least").alias("cluster"))
    linked = durable(parts.join(least, "component").select("id", "cluster"))
    release(rows.sparkSession)
    hashed = lambda c: F.unhex(F.md5(c)).alias("_seq")
    classes = nodes.select("id", hashed("seq"), "_least").join(linked, "id", "left").select("_seq", F.coalesce("cluster", "_least").alias("cluster"))
    found = rows.withColumn("_seq", F.when(known, hashed(text))).join(classes, "_seq", "left")
    found = found.withColumn("cluster", F.when(F.col("_seq").isNotNull(), F.col("cluster")).otherwise(F.col(key))).drop("_seq")
    return found.withColumn("kept", F.col(key).eqNullSafe(F.col("cluster")))
