"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.common import row_key, text_of
from sievegrid.operators.components import connected_components
from sievegrid.session import durable

# An odd number and its inverse modulo 2^64, for hashes of byte ranges by prefix sums.
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
PIECE = 1 << 22


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word (run of non-blank bytes) of a text in UTF-8."""
    blank = SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):  # long texts go in pieces of whole words
        first = starts[done]
        last = max(done + 1, int(np.searchsorted(stops, first + PIECE, "right")))
        part = data[first : stops[last - 1]].astype(np.uint64) + np.uint64(1)
        up = np.cumprod(np.full(len(part), BASE, np.uint64))
        down = np.cumprod(np.full(len(part), UNBASE, np.uint64))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(part * up)))
        a, b = starts[done:last] - first, stops[done:last] - first
        out[done:last] = _mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        done = last
    return out


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; a shorter text has one, of all its words."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = _mix(out * BASE + words[i : len(words) - width + 1 + i])
    return out


def label_occurrences(hashes: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, how many equal ones came before), so that repeats differ."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
    at = np.arange(len(ranked))
    count = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty_like(hashes)
    out[order] = np.where(count > 0, _mix(ranked + count.astype(np.uint64) * BASE), ranked)
    return out


def order_min_hash(labelled: np.ndarray, seeds: np.ndarray, take: int) -> np.ndarray:
    """One key per seed: the ``take`` labelled shingles of least hash, in text order."""
    take = min(take, len(labelled))
    least = np.empty((take, len(seeds)), np.int64)
    step = max(1, (1 << 21) // max(len(labelled), 1))
    for at in range(0, len(seeds), step):
        hashed = _mix(labelled[:, None] ^ seeds[None, at : at + step])
        least[:, at : at + step] = np.argpartition(hashed, take - 1, axis=0)[:take] if take < len(labelled) else np.arange(take)[:, None]
    least.sort(axis=0)
    key = seeds.copy()
    for row in least:
        key = _mix(key * BASE + labelled[row])
    return key


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Aligned shingles over all, |M| / (|a| + |b| - |M|), or 0 where that is below ``least``.

    M is the longest common subsequence of the labelled shingles. At ``least``
    or above, no match lies further off the diagonal than the shingles that may
    stay unmatched: only matches in that band are aligned. Each label occurs
    once in a text, so the alignment is a longest increasing run of places.
    """
    n = len(a) + len(b)
    if not n:
        return 1.0
    needed = int(np.ceil(least * n / (1 + least) - 1e-9))
    if min(len(a), len(b)) < needed:
        return 0.0
    _, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(at - bt) <= n - 2 * needed
    at, bt = at[near], bt[near]
    if len(at) < needed:
        return 0.0
    places = bt[np.argsort(at)]
    if (np.diff(places) > 0).all():
        matched = len(places)
    else:
        ends: list[int] = []
        for p in places.tolist():
            i = bisect_left(ends, p)
            if i == len(ends):
                ends.append(p)
            else:
                ends[i] = p
        matched = len(ends)
    return matched / (n - matched) if matched >= needed else 0.0


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column.cast(pa.large_binary()):
        buffer = value.as_buffer() if value.is_valid else None
        yield np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)


def _node(words: np.ndarray) -> bytes:
    return blake2b(words.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, width: int, sketches: int, take: int, seed: int) -> DataFrame:
    """(id, row, node, keys): ``node`` is a 128-bit hash of the text's words in order."""
    seeds = _mix(np.arange(1, sketches + 1, dtype=np.uint64) * BASE + np.uint64(seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [], []
            for data in _texts(batch.column("text")):
                words = word_hashes(data)
                nodes.append(_node(words))
                labelled = label_occurrences(shingles(words, width))
                keys.append(order_min_hash(labelled, seeds, take).view(np.int64) if len(labelled) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "row", "node", "keys"],
            )

    return docs.mapInArrow(run, "id long, row binary, node binary, keys array<long>")


def _words_of(docs: DataFrame) -> DataFrame:
    """(node, words): the word hashes of every text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_hashes(data) for data in _texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(w) for w in found], pa.binary()), pa.array([w.astype("<u8").tobytes() for w in found], pa.binary())],
                names=["node", "words"],
            )

    return docs.select("text").mapInArrow(run, "node binary, words binary")


def verify(pairs: DataFrame, words: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose aligned similarity is ``least`` or more."""
    full = pairs.join(words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    full = full.join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for name, wa, wb in zip(*(batch.column(c).to_pylist() for c in ("a", "wa", "wb"))):
                if name != last:
                    last, held = name, label_occurrences(shingles(np.frombuffer(wa, "<u8"), width))
                other = label_occurrences(shingles(np.frombuffer(wb, "<u8"), width))
                keep.append(aligned(held, other, least) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.mapInArrow(run, "a binary, b binary")


def _link_across(group: pa.Table, width: int, least: float) -> pa.Table:
    """Links of the outliers of one block with the members of one block, across classes.

    The shared labelled shingles of a member with all outliers are one sum of
    columns of a table (outliers x their shingles); only pairs whose plain
    similarity is enough are aligned, and none whose ends are tied already.
    """
    rows = group.to_pylist()
    sets = [label_occurrences(shingles(np.frombuffer(r["words"], "<u8"), width)) for r in rows]
    outliers = [k for k, r in enumerate(rows) if r["outlier"]]
    others = [k for k, r in enumerate(rows) if not r["outlier"]]
    tied: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while x in tied:
            x = tied[x]
        return x

    out: list[tuple[bytes, bytes]] = []
    for at in range(0, len(outliers), 64):
        part = outliers[at : at + 64]
        known = np.unique(np.concatenate([sets[k] for k in part])) if part else np.zeros(0, np.uint64)
        has = np.zeros((len(known), len(part)), np.uint8)
        for j, k in enumerate(part):
            has[np.searchsorted(known, sets[k]), j] = 1
        sizes = np.array([len(sets[k]) for k in part])
        for k in others:
            place = np.searchsorted(known, sets[k])
            place[place == len(known)] = 0
            place = place[known[place] == sets[k]] if len(known) else place[:0]
            shared = has[place].sum(0, dtype=np.int64)
            for j in np.flatnonzero(shared >= least * (sizes + len(sets[k]) - shared) - 1e-9):
                o = part[j]
                x, y = top(rows[o]["comp"]), top(rows[k]["comp"])
                if x != y and aligned(sets[o], sets[k], least) >= least:
                    tied[max(x, y)] = min(x, y)
                    out.append((rows[o]["node"], rows[k]["node"]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})


def _rest(met: DataFrame, component: DataFrame, words: DataFrame, width: int, least: float, block: int) -> DataFrame:
    """Links (a, b) between nodes that met under one leader and are still in different classes.

    ``met`` has (lead, node). The largest class under a leader is left aside:
    pairs inside it are settled. Every other node there, an outlier, is compared
    with all nodes of other classes, in blocks of about ``block`` outliers by
    ``block`` nodes, each block a group of bounded size.
    """
    named = durable(met.join(component, "node"))
    sizes = named.groupBy("lead", "comp").agg(F.count("node").alias("n"))
    mixed = (
        sizes.groupBy("lead")
        .agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.count("comp").alias("classes"))
        .filter("classes > 1")
        .select(
            "lead",
            F.col("top.comp").alias("top"),
            F.ceil(F.col("all") / block).cast("int").alias("blocks"),
            F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("turns"),
        )
    )
    rows = named.join(mixed, "lead").join(words, "node")
    pick = lambda c, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    base = ["lead", "node", "comp", "words"]
    members = rows.select(*base, pick("blocks", 1).alias("block"), each("turns").alias("turn"), F.lit(False).alias("outlier"))
    outliers = rows.filter("comp <> top").select(*base, each("blocks").alias("block"), pick("turns", 2).alias("turn"), F.lit(True).alias("outlier"))
    return (
        members.unionByName(outliers)
        .groupBy("lead", "block", "turn")
        .applyInArrow(lambda group: _link_across(group, width, least), "a binary, b binary")
    )


def row_of(key: str, text: str) -> Column:
    """What tells a row from others: its id, null too, and its text."""
    return row_key(F.col(key).cast("long"), text_of(text))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(doc_id, class_id, kept) for every row of ``docs``; settings and rules as in ``classes``.

    The row with the smallest doc_id of a class is kept (one row of it, if it is
    repeated; null ids come last).
    """
    kept = F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    return classes(docs, key, text, **settings).select(F.col("id").alias("doc_id"), "class_id", kept)


def keepers(docs: DataFrame, **settings) -> DataFrame:
    """(row): the ``row_of`` of exactly one row of every class, that of the smallest doc_id.

    Among rows of that id, and where all ids are null, the smallest ``row_of`` decides.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))
    return classes(docs, **settings).groupBy("comp").agg(first.alias("first")).select("first.row")


def classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    sketches: int = 16,
    take: int = 3,
    block: int = 512,
    seed: int = 7,
) -> DataFrame:
    """(id, row, comp, class_id) for every row of ``docs``; ``row`` is its ``row_of``.

    Texts are words between blanks; two are linked if the alignment of their
    labelled ``width``-word shingles gives ``similarity`` or more; classes are
    what links reach, named by their smallest doc_id. Copies with equal
    words are one node, so they cost no comparison; texts without words are
    copies of each other. Texts shorter than ``width`` words are one shingle.

    Nodes that share a key (``take`` least labelled shingles in text order,
    under one of ``sketches`` hashes) are candidates. In every key the member
    with the fullest keys leads, and the others are compared with it alone.
    Nodes that met under a leader and are still in different classes are then
    compared in bounded blocks, all but those inside its largest class, so this
    misses none. A pair of similarity s shares no key with probability
    (1 - s^take)^sketches: 1e-5 at 0.8.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), row_of(key, text).alias("row"), text_of(text).alias("text"))
    drawn = durable(sketch(rows, width, sketches, take, seed))
    nodes = drawn.groupBy("node").agg(F.min("id").alias("id"), F.min("row").alias("row"), F.first("keys").alias("keys"))
    each = nodes.filter("keys IS NOT NULL").select("node", "row", F.explode("keys").alias("key"))
    sizes = each.groupBy("key").agg(F.count("node").alias("size")).filter("size > 1")
    live = durable(each.join(sizes, "key"))
    fullness = live.groupBy("node").agg(F.sum("size").alias("full"))
    members = durable(live.join(fullness, "node").select("key", F.struct("full", "node").alias("m")))
    wanted = live.select("row").distinct()
    words = durable(_words_of(rows.join(wanted, "row", "left_semi")).join(fullness.select("node"), "node", "left_semi").dropDuplicates(["node"]))

    leads = members.groupBy("key").agg(F.max("m").alias("lead"))
    pairs = durable(
        members.join(leads, "key")
        .select(F.col("lead.node").alias("a"), F.col("m.node").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    links = durable(verify(pairs, words, width, similarity))
    everyone = fullness.select(F.col("node").alias("id"))
    named_so = lambda df: df.select(F.col("id").alias("node"), F.col("component").alias("comp"))
    component = durable(named_so(connected_components(everyone, links)))
    met = pairs.select(F.col("a").alias("lead"), F.col("b").alias("node"))
    met = met.unionByName(pairs.select(F.col("a").alias("lead"), F.col("a").alias("node")).distinct())
    more = durable(_rest(met, component, words, width, similarity, block))
    if not more.isEmpty():
        component = durable(named_so(connected_components(everyone, links.unionByName(more))))
    comp = component.select("node", "comp")
    classed = nodes.select("node", "id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = classed.groupBy("comp").agg(F.min("id").alias("class_id"))
    named = classed.join(least, "comp").select("node", "comp", "class_id")
    return drawn.select("id", "row", "node").join(named, "node").select("id", "row", "comp", "class_id")
