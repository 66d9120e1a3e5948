"""A trie of conversations that share their first turns, from adaptive radix trees over sorted ranges of keys.

A turn's id is 16 bytes, the hash of role and text, so a conversation is a key of
16 bytes a turn, and equal conversations are one key with a weight. The keys are
sorted into ranges, and every block of a range grows its own radix tree: nodes
hold 4, 16, 48 or 256 children and are laid out anew when they are full, and
bytes without a branch lie in one node. Only byte depths that end a turn
are nodes of the trie.

A trie node whose members lie in several blocks comes out of each of them. How
many turns the last key of a block shares with the next key tells which nodes
these are, and every figure of a node is a sum or a minimum over blocks once what
two blocks share is charged to the first of them; so parts are merged by one
grouping, however many members a node has.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.llm.common import row_key, text_of
from sievegrid.session import durable

WIDTH = 16
NODE = (
    "node binary, parent_node binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, border boolean, ends boolean"
)
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Node:
    """A node of the radix tree: the bytes of its unbranched path, an entry if a key ends here, its children.

    Up to 4 children stand unsorted, up to 16 sorted by their byte, up to 48 behind a table of 256
    places, more directly in a table of 256 children.
    """

    __slots__ = ("path", "entry", "room", "bytes", "children", "count")

    def __init__(self, path: bytes, entry=None):
        self.path, self.entry, self.room, self.count = path, entry, 4, 0
        self.bytes, self.children = bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            at = self.bytes.find(byte)
            return self.children[at] if at >= 0 else None
        if self.room == 48:
            at = self.bytes[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, node: Node) -> None:
        """Set the child of a byte, in a larger layout if need be."""
        if self.child(byte) is None:
            if self.count == self.room:
                self._grow()
            self.count += 1
            if self.room == 4:
                self.bytes.append(byte)
                self.children.append(node)
            elif self.room == 16:
                at = bisect_left(self.bytes, byte)
                self.bytes.insert(at, byte)
                self.children.insert(at, node)
            elif self.room == 48:
                self.children.append(node)
                self.bytes[byte] = len(self.children)
            else:
                self.children[byte] = node
        elif self.room <= 16:
            self.children[self.bytes.find(byte)] = node
        else:
            self.children[self.bytes[byte] - 1 if self.room == 48 else byte] = node

    def _grow(self) -> None:
        pairs = self.items()
        if self.room == 4:
            self.room, self.bytes, self.children = 16, bytearray(b for b, _ in pairs), [c for _, c in pairs]
        elif self.room == 16:
            self.room, self.bytes, self.children = 48, bytearray(256), [c for _, c in pairs]
            for i, (b, _) in enumerate(pairs):
                self.bytes[b] = i + 1
        else:
            self.room, self.bytes, self.children = 256, bytearray(), [None] * 256
            for b, c in pairs:
                self.children[b] = c

    def items(self) -> list[tuple[int, Node]]:
        """Bytes and children in the order of the bytes."""
        if self.room <= 16:
            return sorted(zip(self.bytes, self.children), key=lambda p: p[0])
        if self.room == 48:
            return [(b, self.children[at - 1]) for b, at in enumerate(self.bytes) if at]
        return [(b, c) for b, c in enumerate(self.children) if c is not None]


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """How many bytes of ``a`` stand in ``b`` from ``at`` on."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at : at + n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        half = (low + high) // 2
        if a[:half] == b[at : at + half]:
            low = half
        else:
            high = half
    return low


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, entry) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.child(key[at])
            if child is None:
                node.put(key[at], Node(key[at + 1 :], entry))
                return
            same = common(child.path, key, at + 1)
            if same < len(child.path):  # the unbranched path splits
                upper = Node(child.path[:same])
                upper.put(child.path[same], child)
                child.path = child.path[same + 1 :]
                node.put(key[at], upper)
                child = upper
            node, at = child, at + 1 + same
        node.entry = entry

    def nodes(self) -> Iterator[tuple[Node, int, int]]:
        """Every node after its children, with the byte depth of its parent and its own."""
        stack = [(self.root, 0, 0, False)]
        while stack:
            node, above, depth, done = stack.pop()
            if done:
                yield node, above, depth
                continue
            stack.append((node, above, depth, True))
            for _, child in reversed(node.items()):
                stack.append((child, depth, depth + 1 + len(child.path), False))


def hashes(key: bytes, turns: int) -> list[bytes]:
    """The node ids of the first ``turns`` beginnings of a key, the empty one included."""
    run, out = hashlib.md5(), []
    for t in range(turns + 1):
        out.append(run.copy().digest())
        run.update(key[WIDTH * t : WIDTH * (t + 1)])
    return out


def block_nodes(keys: list[tuple[bytes, int, int, list[int]]], before: int, after: int) -> list[list]:
    """The trie nodes of sorted distinct keys (key, members, smallest member, words of each turn).

    ``before`` and ``after`` say how many turns the first key shares with the key before it, and the last with
    the key after it, -1 if there is none. Rows as in ``NODE``; a node that other blocks have too is ``border``.
    """
    tree = RadixTree()
    for place, entry in enumerate(keys):
        tree.insert(entry[0], (place, *entry))
    first_path, last_path = hashes(keys[0][0], max(before, 0)), hashes(keys[-1][0], max(after, 0))
    out: list[list] = []
    done: list[tuple] = []  # finished subtrees whose parents aren't
    for node, above, depth in tree.nodes():
        below = done[len(done) - node.count :] if node.count else []
        del done[len(done) - node.count :]
        n, leaves, saved, counted = (sum(part[i] for part in below) for i in range(4))
        tops = [top for part in below for top in part[4]]
        low = min((part[5] for part in below), default=None)
        first, last, sample = (below[0][6], below[-1][7], below[0][8]) if below else (None, None, None)
        if node.entry is not None:
            place, key, members, least, own = node.entry
            n, low = n + members, least if low is None else min(low, least)
            first, last, sample = place, last if below else place, sample if below else own
        for turn in range(depth // WIDTH, -1 if node is tree.root else above // WIDTH, -1):
            ends = node.entry is not None and turn * WIDTH == depth
            in_before, in_after = first == 0 and turn <= before, last == len(keys) - 1 and turn <= after
            if ends and not below and not in_after:
                leaves += 1
            spoken = sample[turn - 1] if turn else 0
            saved += spoken * (n if in_before else n - 1)
            identity = first_path[turn] if in_before else last_path[turn] if in_after else None
            if ends and identity is None:
                identity = hashlib.md5(key).digest()
            border = in_before or in_after
            row = [identity, None, turn, low, None, n, counted, leaves, saved, border, ends]
            for top in tops:
                top[1 if border else 4] = identity if border else low
            out.append(row)
            tops, counted = [row], 0 if in_before else 1
        done.append((n, leaves, saved, counted, tops, low, first, last, sample))
    return out


def _trees(borders: dict[int, tuple[int, int]], most_keys: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, before, here, previous = [], 0, -1, None, None

        def finish(after: int) -> pa.RecordBatch:
            rows = block_nodes(block, before, after)
            types = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
            fields = [f.split() for f in NODE.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[f for f, _ in fields]
            )

        for batch in batches:
            for r in batch.to_pylist():
                key = r["key"]
                if r["range"] != here:
                    if block:
                        yield finish(borders[here][1])
                    here, block, size, before = r["range"], [], 0, borders[r["range"]][0]
                elif len(block) >= most_keys or size > most_bytes:
                    shared = common(previous, key) // WIDTH
                    yield finish(shared)
                    block, size, before = [], 0, shared
                block.append((key, r["n"], r["conv_id"], r["words"]))
                size += len(key)
                previous = key
        if block:
            yield finish(borders[here][1])

    return run


def _shared_turns(a, b):
    """Equal first turns of two keys, -1 if either is missing."""
    turns = F.floor(F.least(F.octet_length(a), F.octet_length(b)) / F.lit(WIDTH))
    part = lambda k, i: F.substring(k, (i - 1) * WIDTH + 1, F.lit(WIDTH))
    same = F.transform(F.sequence(F.lit(1), F.greatest(turns, F.lit(1)).cast("int")), lambda i: part(a, i) == part(b, i))
    first_other = F.nullif(F.array_position(same, False), F.lit(0))
    shared = F.when(turns < 1, 0).otherwise(F.coalesce(first_other - 1, turns))
    return F.when(a.isNull() | b.isNull(), -1).otherwise(shared).cast("int")


def end_hashes(members: DataFrame, ids_per_row: int = 4096) -> DataFrame:
    """SHA-256 of the members' ids, ascending and joined by commas, per node.

    Ids are sorted over the whole cluster and first joined to pieces of
    ``ids_per_row``; only the pieces of a node meet in one task, which reads them one after
    the other and holds a hash state, since that hash can't be taken in parts.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []

        def cut():
            out.append((node, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            for n, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node or len(ids) >= ids_per_row:
                    if ids:
                        cut()
                    node, ids = n, []
                ids.append(i)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("node", "least", "piece"), r)) for r in out])
                out = []
        if ids:
            cut()
            yield pa.RecordBatch.from_pylist([dict(zip(("node", "least", "piece"), r)) for r in out])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for n, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n == node:
                    state.update(b",")
                else:
                    if state:
                        out.append({"node": node, "ends_sha256": state.hexdigest()})
                    node, state = n, hashlib.sha256()
                state.update(piece.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out)
        if state:
            yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": state.hexdigest()}])

    ordered = members.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    joined = ordered.mapInArrow(pieces, "node binary, least long, piece string")
    return joined.repartition("node").sortWithinPartitions("node", "least").mapInArrow(digests, "node binary, ends_sha256 string")


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs (turn, id, words).

    ``turns`` has conv_id, turn, role and text. Null turns come first, equal ones in the order of their ids; null
    role or text is empty; rows without conv_id belong to no conversation and drop out.
    The text doesn't travel: a turn is 16 bytes and its number of words.
    """
    words = F.regexp_count(text_of("text"), F.lit(r"[^\x20\x09-\x0D]+"))
    short = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"), row_key(text_of("role"), text_of("text")).alias("id"), words.cast("int").alias("words")
        ).alias("said"),
    )
    return short.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))


def spliced(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin like others: the first h turns of conversation c - c % ``every``, then the own
    turns after the first h; h is the unsigned crc32 of the decimal id modulo ``most``. Missing ones lend nothing."""
    lenders = convs.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = convs.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % every, "_h": h}).join(lenders, "_base", "left")
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    own = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return rows.select("conv_id", F.concat(head, own).alias("turns"))


def prefix_tree(convs: DataFrame, most_keys: int = 20_000, most_bytes: int = 1 << 24) -> DataFrame:
    """One row per distinct beginning of the conversations (conv_id, turns as of ``sequences``).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256;
    the root has depth 0 and no parent. Conversations without turns end at the root. No conversations, no rows.
    A block grows a tree of at most ``most_keys`` distinct conversations or about ``most_bytes`` of their ids; the
    result doesn't depend on either. A conversation is one row of 20 bytes a turn (2^26 turns at most).
    """
    keyed = durable(
        convs.select(
            "conv_id",
            F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("key"),
            F.col("turns.words").alias("words"),
        )
    )
    distinct = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.any_value("words").alias("words")
    )
    ranged = distinct.repartitionByRange("key").withColumn("range", F.spark_partition_id())
    ranged = durable(ranged.sortWithinPartitions("key"))
    ends = ranged.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.partitionBy(F.lit(1)).orderBy("range")
    shared = ends.select(
        "range",
        _shared_turns(F.lag("last").over(order), F.col("first")).alias("before"),
        _shared_turns(F.col("last"), F.lead("first").over(order)).alias("after"),
    )
    borders = {r["range"]: (r["before"], r["after"]) for r in shared.collect()}  # two numbers a partition
    grown = durable(
        ranged.sortWithinPartitions("range", "key").mapInArrow(_trees(borders, most_keys, most_bytes), NODE)
    )
    merged = (
        grown.filter("border")
        .groupBy("node")
        .agg(
            F.max("parent_node").alias("parent_node"),
            F.max("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            F.min("parent_conv_id").alias("parent_conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.lit(True).alias("border"),
            F.bool_or("ends").alias("ends"),
        )
    )
    nodes = grown.filter("NOT border").unionByName(merged)
    above = merged.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("_above"))
    below = nodes.filter("parent_node IS NOT NULL").join(above, "parent_node", "left")
    below = below.withColumn("parent_conv_id", F.col("_above")).drop("_above")
    nodes = nodes.filter("parent_node IS NULL").unionByName(below.select(*nodes.columns))
    ended = end_hashes(keyed.select(F.unhex(F.md5("key")).alias("node"), "conv_id"))
    with_ends = nodes.filter("ends").join(ended, "node", "left")
    rest = nodes.filter("NOT ends").withColumn("ends_sha256", F.lit(NO_ENDS))
    return with_ends.select(*rest.columns).unionByName(rest).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
