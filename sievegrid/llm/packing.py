"""Packing documents into windows of tokens, with the sources in fixed proportions."""

from __future__ import annotations

import heapq
import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.session import durable, scratch_path

PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
)
LEFT = PIECE + ", share double, group int, ids binary, taken long, filled long"
BROADCAST, HOT = 1 << 24, 1000
GOLDEN = 0.6180339887498949
# How a byte-level BPE splits text, and the bytes that stand for themselves in its file.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


def bpe_encoding(path: str):
    """The encoding of a byte-level BPE file without a normalizer, merges in order of ids.

    The file's tokens, ids and special tokens are used as they are; only the
    merging runs in the faster of the two installed libraries. A file of
    another kind is refused.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    split = stored["pre_tokenizer"]
    if split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or stored.get("normalizer"):
        raise ValueError(f"not a plain byte-level BPE: {path}")
    others = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    byte_of = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    ranks = {
        bytes(byte_of[c] for c in token): i
        for token, i in stored["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


class Packer:
    """Deficit round robin over queues of token arrays.

    A queue's deficit is its share of all tokens filled so far, less what it gave.
    Queues come up in turn as their deficits reach a mark, and are served as much as
    the deficit (``least`` at least), the queue and the window allow; what room is
    left goes to those that come up next. Marks are spread over 0 to ``least``, so
    that queues of like shares don't all come up in one window. Only queues that hold tokens wait in the heap of turns, so a
    window costs as many steps as it serves queues, however many there are.
    Deficits stay from window to window and may be handed in and out, so that they
    carry on in the next lane or partition.
    """

    def __init__(self, share=(), window: int = 2048, least: int = 64, deficits=None, filled: int = 0):
        self.window, self.least, self.filled = window, least, filled
        self.share: list[float] = []
        self.taken: list[float] = []
        self.queues: list[deque] = []
        self.held: list[int] = []
        self.turns: list[tuple[float, int]] = []
        for i, x in enumerate(share):
            self.open(float(x), x * filled - (deficits[i] if deficits is not None else 0.0))

    def open(self, share: float, taken: float = 0) -> int:
        """A new queue, by its number."""
        self.share.append(share)
        self.taken.append(taken)
        self.queues.append(deque())
        self.held.append(0)
        return len(self.share) - 1

    @property
    def deficits(self) -> np.ndarray:
        return np.array(self.share) * self.filled - np.array(self.taken)

    def _wait(self, queue: int) -> None:
        share = self.share[queue]
        mark = queue * GOLDEN % 1.0 * self.least
        due = (self.taken[queue] + mark) / share if share > 0 else np.inf
        heapq.heappush(self.turns, (due, queue))

    def add(self, queue: int, doc: tuple, ids: np.ndarray, start: int = 0) -> None:
        if len(ids):
            self.queues[queue].append([doc, ids, start])
            self.held[queue] += len(ids)
            if self.held[queue] == len(ids):
                self._wait(queue)

    def _serve(self, queue: int, room: int) -> Iterator[tuple[tuple, int, np.ndarray, int]]:
        while room:
            head = self.queues[queue][0]
            doc, ids, start = head
            n = min(room, len(ids))
            yield doc, start, ids[:n], queue
            room -= n
            if n == len(ids):
                self.queues[queue].popleft()
            else:
                head[1], head[2] = ids[n:], start + n

    def fill(self, size: int) -> list[tuple[tuple, int, np.ndarray, int]]:
        """The pieces of one window of exactly ``size`` tokens (as many must be held)."""
        self.filled += size
        room, pieces = size, []
        while room:
            _, queue = heapq.heappop(self.turns)
            deficit = int(self.share[queue] * self.filled - self.taken[queue])
            n = min(max(self.least, deficit), self.held[queue], room)
            pieces += self._serve(queue, n)
            self.taken[queue] += n
            self.held[queue] -= n
            room -= n
            if self.held[queue]:
                self._wait(queue)
        return pieces

    def rest(self) -> list[tuple[tuple, int, np.ndarray, int]]:
        """Everything still held, queue by queue."""
        return [(doc, start, ids, q) for q, line in enumerate(self.queues) for doc, ids, start in line]


def _rows(pieces, sequence: int) -> list[tuple]:
    at, rows = 0, []
    for (doc_id, tokens, source), start, ids, _ in pieces:
        crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
        rows.append((doc_id, start, len(ids), crc, tokens, sequence, at, source))
        at += len(ids)
    return rows


def _batch(rows: list[tuple], left: list[tuple] = ()) -> pa.RecordBatch:
    full = [(*r, None, None, None, None, None) for r in rows] + list(left)
    types = [pa.int64()] * 7 + [pa.string(), pa.float64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in LEFT.split(", ")]
    columns = list(zip(*full)) if full else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _with_share(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """``rows`` with the ``share`` of their source, 0 for sources without one.

    Shares are broadcast where their names fit in ``BROADCAST`` bytes; else only those
    of sources above one of ``HOT`` of the whole are, and the others are joined by name.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    named = durable(shares.select(name("source").alias("_key"), "share"))
    size = named.agg(F.sum(F.length("_key") * 4 + 64)).first()[0] or 0
    keyed = rows.withColumn("_key", name("source"))
    if size <= BROADCAST:
        return keyed.join(F.broadcast(named), "_key", "left").drop("_key").fillna(0.0, ["share"])
    is_hot = F.col("share") > 1 / HOT
    hot = named.filter(is_hot).withColumnRenamed("share", "_hot")
    salt = F.concat(F.lit("#"), F.xxhash64("doc_id", "text").cast("string"))
    spread = keyed.join(F.broadcast(hot), "_key", "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col("_key")).otherwise(salt))
    found = spread.join(named.filter(~is_hot), "_key", "left")
    return found.withColumn("share", F.coalesce("_hot", "share", F.lit(0.0))).drop("_key", "_hot")


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    window: int = 2048,
    end_id: int = 1,
    least: int = 64,
    lane_tokens: int = 1 << 20,
    lanes_per_group: int = 256,
    proportions: dict[str | None, float] | None = None,
) -> DataFrame:
    """All documents as pieces of sequences of ``window`` tokens.

    A document is its ids and ``end_id``; null counts as empty and gives one
    piece of one token. Every source, by its name, is a queue (null one more), and
    each window takes its tokens by deficit round robin in the proportions asked
    for (by default those of the sources' code points over the whole table; sources
    not named get nothing until the others are empty), as far as the queues last.

    Rows are dealt by hash to partitions, each of which fills windows of lanes
    of about ``lane_tokens`` tokens, handing its deficits from lane to lane.
    What is left of a partition, less than a window, goes to one of the groups
    of ``lanes_per_group`` partitions, with what each source gave and how many tokens
    were filled; these are added up by group and source, so the group is packed
    from the sum of all deficits. The last tokens of a group go to sequences
    whose lengths are powers of two, so nothing is padded.

    Repeated rows are packed each; other columns are ignored; an empty table
    gives no rows. Partitions are written once to the shared folder, so a lost
    executor can't make the two steps see different pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    if proportions is None:
        sizes = rows.groupBy("source").agg(F.sum(F.length("text") + 1).alias("n"))
    else:
        sizes = spark.createDataFrame([(k, float(v)) for k, v in proportions.items()], "source string, n double")
    sizes = durable(sizes)
    total = float(sizes.agg(F.sum("n")).first()[0] or 1)
    rows = _with_share(rows, sizes.select("source", (F.col("n") / F.lit(total)).alias("share")))
    groups = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // lanes_per_group))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        encoding = bpe_encoding(tokenizer)
        special = set(encoding.special_tokens_set)
        packer, place = Packer((), window, least), {}
        sequence, held, out = partition << 32, 0, []

        def drain(until: int):
            nonlocal sequence, held, out
            while held >= max(until, window):
                out += _rows(packer.fill(window), sequence)
                held -= window
                sequence += 1
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []

        for batch in batches:
            for doc, name, share, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "share", "text"))):
                ids = np.append(encoding.encode_to_numpy(body, allowed_special=special), np.uint32(end_id))
                if name not in place:
                    place[name] = packer.open(share)
                packer.add(place[name], (doc, len(ids), name), ids)
                held += len(ids)
                if held > 2 * lane_tokens:
                    yield from drain(lane_tokens)
        yield from drain(window)
        group = partition % groups
        left = [
            (doc, start, len(ids), 0, tokens, None, None, name, packer.share[q], group, ids.astype("<u4").tobytes(), None, None)
            for (doc, tokens, name), start, ids, q in packer.rest()
        ]
        given = [(*[None] * 7, name, None, group, None, int(packer.taken[q]), None) for name, q in place.items()]
        yield _batch(out, [*left, *given, (*[None] * 9, group, None, None, packer.filled)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups_here: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                groups_here.setdefault(r["group"], []).append(r)
        for group, lines in sorted(groups_here.items()):
            lines.sort(key=lambda r: (r["source"] is not None, r["source"] or "", str(r["doc_id"]), r["start"]))
            packer, place = Packer((), window, least, filled=lines[0]["filled"]), {}
            for r in lines:
                name = r["source"]
                if name not in place:
                    place[name] = packer.open(r["share"], r["taken"])
                packer.add(place[name], (r["doc_id"], r["doc_tokens"], name), np.frombuffer(r["ids"], "<u4"), r["start"])
            held, sequence, out = sum(packer.held), (1 << 62) + (group << 32), []
            while held:
                size = window if held >= window else 1 << (held.bit_length() - 1)
                out += _rows(packer.fill(size), sequence)
                held -= size
                sequence += 1
            whole = _batch(out)
            yield whole.select([x.split()[0] for x in PIECE.split(", ")])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.repartition(parts, F.xxhash64("doc_id", "source")).sortWithinPartitions(F.xxhash64("doc_id"), "source")
    path = scratch_path(spark, "pack")
    dealt.select("doc_id", "source", "share", "text").mapInArrow(fill, LEFT).write.parquet(path)
    stored = spark.read.schema(LEFT).parquet(path)
    full = stored.filter("sequence_id IS NOT NULL").select(*[x.split()[0] for x in PIECE.split(", ")])
    left = stored.filter("ids IS NOT NULL").drop("taken", "filled")
    gave = stored.filter("taken IS NOT NULL").groupBy("group", "source").agg(F.sum("taken").alias("taken"))
    done = stored.filter("filled IS NOT NULL").groupBy("group").agg(F.sum("filled").alias("filled"))
    gave = gave.select(F.col("group").alias("_group"), F.col("source").alias("_source"), "taken")
    both = (F.col("group") == F.col("_group")) & F.col("source").eqNullSafe(F.col("_source"))
    known = left.join(gave, both).drop("_group", "_source").join(done, "group")
    rest = known.repartition(groups, "group").mapInArrow(finish, PIECE)
    return full.unionByName(rest)
