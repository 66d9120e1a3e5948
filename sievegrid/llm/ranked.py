"""Ranked lexical search over posting lists in blocks of similar documents.

Documents stay where they are: every task turns its own, a few thousand at a time,
into an index of the terms that the queries use. A term's posting list is cut
into blocks of documents that are alike (each goes to the most similar of evenly
spaced documents of the list, seen through a fixed random projection), and every block stores
the largest impact of each term among its documents. That summary bounds the score
of any document in the block exactly, so a block is skipped only if its bound is below the
score that the query's last place holds by then. What the tasks found is merged
per query. Numbers of documents, lengths and document frequencies come from
a pass over all documents before.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.session import scratch_path

# Bytes of terms (digits, letters, all beyond ASCII); capital ASCII letters count as small.
_TERM = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _TERM else 0x20 for b in range(256))
FORWARD = "doc_id long, n long, terms binary, tfs binary"
FOUND = "slot int, item_id long, doc_id long, score long"


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


class Query:
    """A query's term numbers, their count, and which of a term's summary columns are its own."""

    def __init__(self, slot: int, item_id, counts: dict[int, int]):
        self.slot, self.item_id = slot, item_id
        self.terms = np.array(sorted(counts), np.int64)
        self.counts = np.array([counts[t] for t in sorted(counts)], np.int64)


class Columns:
    """For every term, the terms it shares a query with: the coordinates its summaries need."""

    def __init__(self, queries: list[Query], terms: int):
        self.of: list[np.ndarray] = [np.empty(0, np.int64)] * terms
        beside: dict[int, set[int]] = {}
        for q in queries:
            for t in q.terms.tolist():
                beside.setdefault(t, set()).update(q.terms.tolist())
        for t, others in beside.items():
            self.of[t] = np.array(sorted(others), np.int64)

    def places(self, query: Query, term: int) -> np.ndarray:
        return np.searchsorted(self.of[term], query.terms)


class BlockedIndex:
    """Posting lists of some documents, cut into blocks with coordinatewise-maximum summaries.

    ``impacts`` has a row per document and a column per term, 0 where the term is missing.
    Lists of up to ``block`` documents are one block, opened without a look at a summary.
    """

    def __init__(self, impacts: np.ndarray, weights: np.ndarray, columns: Columns, block: int = 64, sketch: int = 24):
        self.impacts = impacts
        signs = np.random.default_rng(7).choice(np.array([-1.0, 1.0], np.float32), (len(weights), sketch))
        seen = (impacts.astype(np.float32) * (weights / max(1, weights.max(initial=1))).astype(np.float32)) @ signs
        seen /= np.maximum(np.linalg.norm(seen, axis=1, keepdims=True), 1e-9)
        self.short: dict[int, np.ndarray] = {}
        self.members: dict[int, np.ndarray] = {}
        self.starts: dict[int, np.ndarray] = {}
        self.summaries: dict[int, np.ndarray] = {}
        held, docs = np.nonzero(impacts.T)
        cuts = np.flatnonzero(np.diff(held)) + 1
        for docs_of, term in zip(np.split(docs, cuts), held[np.concatenate([[0], cuts])] if len(held) else []):
            if len(docs_of) <= block:
                self.short[int(term)] = docs_of
                continue
            pivots = docs_of[:: block]
            nearest = np.argmax(seen[docs_of] @ seen[pivots].T, axis=1)
            order = np.argsort(nearest, kind="stable")
            members, nearest = docs_of[order], nearest[order]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(nearest)) + 1])
            of = columns.of[term]
            self.members[int(term)], self.starts[int(term)] = members, starts
            self.summaries[int(term)] = np.maximum.reduceat(impacts[np.ix_(members, of)], starts, axis=0)

    def bounds(self, query: Query, weights: np.ndarray, columns: Columns) -> list[tuple[int, np.ndarray]]:
        """For each long list of the query, the most that a document of each block can score."""
        each = query.counts * weights[query.terms]
        return [
            (t, self.summaries[t][:, columns.places(query, t)] @ each) for t in query.terms.tolist() if t in self.summaries
        ]

    def score(self, docs: np.ndarray, query: Query, weights: np.ndarray) -> np.ndarray:
        return self.impacts[np.ix_(docs, query.terms)] @ (query.counts * weights[query.terms])

    def block_docs(self, term: int, chosen: np.ndarray) -> list[np.ndarray]:
        members, starts = self.members[term], self.starts[term]
        stops = np.append(starts[1:], len(members))
        return [members[starts[b] : stops[b]] for b in chosen.tolist()]


class Best:
    """The best documents of a query so far: score descending, then id ascending, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.unknown = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """What a document must score to get a place."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            scores = np.concatenate([self.scores, scores[good]])
            ids, unknown = np.concatenate([self.ids, ids[good]]), np.concatenate([self.unknown, unknown[good]])
            order = np.lexsort((ids, unknown, -scores))[: self.k]
            self.scores, self.ids, self.unknown = scores[order], ids[order], unknown[order]


def visit(index: BlockedIndex, query: Query, weights: np.ndarray, columns: Columns, best: Best, ids: np.ndarray, unknown: np.ndarray, first: int = 4) -> int:
    """Bring the index's documents into ``best``; returns how many were scored.

    Blocks with the highest bounds are opened first, so that the rest meet a high bar.
    """
    fresh, scored = np.ones(len(ids), bool), 0

    def open_docs(lists: list[np.ndarray]) -> None:
        nonlocal scored
        if lists:
            docs = np.unique(np.concatenate(lists))
            docs = docs[fresh[docs]]
            fresh[docs] = False
            scored += len(docs)
            best.add(index.score(docs, query, weights), ids[docs], unknown[docs])

    found = index.bounds(query, weights, columns)
    open_docs([index.short[t] for t in query.terms.tolist() if t in index.short])
    if found:
        every = np.sort(np.concatenate([b for _, b in found]))[::-1]
        bar = max(best.least, int(every[min(first, len(every)) - 1]))
        open_docs([d for t, b in found for d in index.block_docs(t, np.flatnonzero(b >= bar))])
        open_docs([d for t, b in found for d in index.block_docs(t, np.flatnonzero((b < bar) & (b >= best.least)))])
    return scored


def _forward(number_of: dict[bytes, int], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": [], "n": [], "terms": [], "tfs": []}
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column(text)):
                words = terms_of(body.as_py() or "")
                if words:
                    found = [(number_of[w], c) for w, c in Counter(words).items() if w in number_of]
                    found.sort()
                    out["doc_id"].append(doc_id)
                    out["n"].append(len(words))
                    out["terms"].append(np.array([t for t, _ in found], "<i4").tobytes())
                    out["tfs"].append(np.array([c for _, c in found], "<i8").tobytes())
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return run


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's documents; their number under -1, their terms under -2."""
    total: Counter = Counter()
    for batch in batches:
        held = b"".join(batch.column("terms").to_pylist())
        numbers, counts = np.unique(np.frombuffer(held, "<i4"), return_counts=True)
        total.update(dict(zip(numbers.tolist(), counts.tolist())))
        total.update({-1: batch.num_rows, -2: sum(batch.column("n").to_pylist())})
    keys = list(total)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k] for k in keys], pa.int64())], names=["term", "held"])


def _searched(queries: list[Query], weights: np.ndarray, docs: int, length: int, k: int, block: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = Columns(queries, len(weights))
        best = [Best(k) for _ in queries]
        most = max(4 * block, min(4096, cells // max(1, len(weights))))

        def search(part: pa.RecordBatch) -> None:
            impacts = np.zeros((part.num_rows, len(weights)), np.int32)
            terms = [np.frombuffer(t, "<i4") for t in part.column("terms").to_pylist()]
            tfs = np.frombuffer(b"".join(part.column("tfs").to_pylist()), "<i8")
            rows = np.repeat(np.arange(part.num_rows), [len(t) for t in terms])
            m = np.array([75 + (25 * n * docs) // length for n in part.column("n").to_pylist()], np.int64)
            if len(rows):
                impacts[rows, np.concatenate(terms)] = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[rows])
            ids = np.array([0 if i is None else i for i in part.column("doc_id").to_pylist()], np.int64)
            unknown = np.array([i is None for i in part.column("doc_id").to_pylist()], bool)
            index = BlockedIndex(impacts, weights, columns, block)
            for query, places in zip(queries, best):
                visit(index, query, weights, columns, places, ids, unknown)

        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                if rows + piece.num_rows > most:
                    search(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, rows = [], 0
                held.append(piece)
                rows += piece.num_rows
        if rows:
            search(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        out = [
            (q.slot, q.item_id, None if u else i, s)
            for q, b in zip(queries, best)
            for s, i, u in zip(b.scores.tolist(), b.ids.tolist(), b.unknown.tolist())
        ]
        columns_out = list(zip(*out)) if out else [()] * 4
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_out, types)], names=["slot", "item_id", "doc_id", "score"])

    return run


def query_blocks(items: DataFrame, most_terms: int) -> Iterator[list[tuple]]:
    """The different items (item_id, terms with counts), in blocks of at most ``most_terms`` different terms or one item."""
    block, terms = [], set()
    rows = items.filter("text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        counts = Counter(terms_of(r["text"]))
        if block and len(terms | set(counts)) > most_terms:
            yield block
            block, terms = [], set()
        block.append((r["item_id"], counts))
        terms |= set(counts)
    if block:
        yield block


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    key: str = "doc_id",
    text: str = "text",
    block: int = 64,
    most_terms: int = 4096,
    cells: int = 1 << 23,
) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    Documents without a term (null, empty) score nothing and don't count; each row is a document of its own,
    so repeated ids may come twice; ids that are null come last among equal scores. Items are told apart
    by id and text, repeated ones count once, and items without a term or without a hit give no rows.
    Other columns are ignored. The items are a stated set of queries: they are read in blocks of at
    most ``most_terms`` different terms, with a pass over the documents each. A task holds an index of at most
    ``cells`` impacts (4096 documents at most), and gives out ``k`` rows an item.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found, slots = spark.createDataFrame([], FOUND), 0
    for part in query_blocks(wanted, most_terms):
        number_of = {t: i for i, t in enumerate(sorted(set().union(*[c for _, c in part])))}
        path = scratch_path(spark, "forward")
        texts.mapInArrow(_forward(number_of, "_text"), FORWARD).write.parquet(path)
        forward = spark.read.schema(FORWARD).parquet(path)
        counted = forward.mapInArrow(_statistics, "term int, held long").groupBy("term").agg(F.sum("held").alias("held"))
        held = {r["term"]: r["held"] for r in counted.collect()}
        total, length = held.get(-1, 0), held.get(-2, 0)
        weights = np.array([weight(total, held.get(i, 0)) for i in range(len(number_of))], np.int64)
        queries = [Query(slots + i, item, {number_of[t]: n for t, n in c.items()}) for i, (item, c) in enumerate(part)]
        slots += len(queries)
        if total and number_of:
            found = found.unionByName(forward.mapInArrow(_searched(queries, weights, total, length, k, block, cells), FOUND))
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
