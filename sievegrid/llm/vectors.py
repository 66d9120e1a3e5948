"""Near-duplicate vectors by an inverted multi-index, verified in double precision."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.operators.components import connected_components
from sievegrid.session import durable


def k_means(points: np.ndarray, k: int, seed: int, steps: int = 10) -> np.ndarray:
    """At most ``k`` centres by Lloyd's steps from a seeded draw of distinct points."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(steps):
        near = distances(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points x centres."""
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)


class Codebook:
    """Centres of one half, and how deep in its own region a point lies.

    ``depths`` gives the squared distance from a point to the plane that
    separates its nearest centre from every other: 0 for the nearest, and never
    more than the squared distance to any point of the other's region.
    """

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        self.apart = np.sqrt(np.maximum(distances(centres, centres), 0))

    def depths(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(points, self.centres)
        own = d.argmin(1)
        gap = d - d[np.arange(len(d)), own][:, None]
        depth = np.maximum(gap, 0) / np.maximum(2 * self.apart[own], 1e-12)
        depth[np.arange(len(d)), own] = 0
        return own, depth**2


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells (i, j) of the product grid by growing first[i] + second[j], up to ``limit``.

    Both halves are sorted once; a heap holds the border of the visited corner
    of the grid, so only cells that are visited, or border on one, cost time.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, out, seen = [(first[a[0]] + second[b[0]], 0, 0)], [], {(0, 0)}
    while heap:
        value, i, j = heapq.heappop(heap)
        if value > limit:
            break
        out.append((int(a[i]), int(b[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


class MultiIndex:
    """Two codebooks on the halves of unit vectors, and the limit of the traversal."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, recall: float, seed: int):
        self.half = sample.shape[1] // 2 or 1
        self.books = [Codebook(k_means(part, k, seed + i)) for i, part in enumerate(self._halves(sample))]
        self.width = len(self.books[1].centres)
        self.limit = self._calibrate(sample, cosine, recall, seed)

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        found = [book.depths(part) for book, part in zip(self.books, self._halves(x))]
        return found[0][0] * self.width + found[1][0], [f[1] for f in found]

    def _calibrate(self, sample: np.ndarray, cosine: float, recall: float, seed: int) -> float:
        """The traversal limit at which ``recall`` of the hardest links are met.

        Each sampled vector gets partners at exactly the least cosine, in random
        directions; the limit is the quantile of the depths of their cells.
        """
        rng = np.random.default_rng(seed + 2)
        needed = []
        for _ in range(max(1, 20_000 // max(len(sample), 1))):
            noise = rng.standard_normal(sample.shape)
            noise -= (noise * sample).sum(1)[:, None] * sample
            size = np.linalg.norm(noise, axis=1)[:, None]
            other = cosine * sample + np.sqrt(1 - cosine**2) * noise / np.maximum(size, 1e-12)
            cell, _ = self.cells(other)
            _, (first, second) = self.cells(sample)
            at = np.arange(len(sample))
            needed.append(first[at, cell // self.width] + second[at, cell % self.width])
        bound = 2 - 2 * cosine
        return float(min(bound, np.quantile(np.concatenate(needed), recall)))

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Own cell of every vector, and its visited cells from its own one upwards."""
        own, (first, second) = self.cells(x)
        out = []
        for k, cell in enumerate(own):
            met = multi_sequence(first[k], second[k], self.limit)
            out.append([c for c in (i * self.width + j for i, j in met) if c >= cell])
        return own, out


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors (rows x width) of a list column, padded with zeros; a row of zeros if it has no direction."""
    out = np.zeros((len(column), width))
    for k, value in enumerate(column):
        if value.is_valid and value.values is not None and not value.values.null_count:
            v = value.values.to_numpy(zero_copy_only=False).astype(float)
            top = np.abs(v).max(initial=0)
            if np.isfinite(top) and top > 0 and np.isfinite(v).all():
                v = v / top
                out[k, : len(v)] = v / np.sqrt((v * v).sum())
    return out


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    cosine: float = 0.95,
    recall: float = 0.999,
    sample: int = 16_384,
    per_cell: int = 64,
    most_centres: int = 1_024,
    block: int = 1_024,
    seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows are linked by a cosine of ``cosine`` or more. Vectors that are null,
    empty or zero or hold a null or non-finite number link with nothing; those of
    different lengths never link. Equal vectors are one node with a weight, so
    copies cost nothing. Rows that repeat a vec_id are vectors of their own.

    The codebooks (sqrt(n / ``per_cell``) centres a half, at most
    ``most_centres``) are fitted on about ``sample`` vectors drawn by hash; every
    vector is indexed. It visits the cells from its own one upwards, nearest
    first, until a limit calibrated to meet ``recall`` of the links at the least
    cosine. Cells are dealt in blocks of about ``block`` members, and the
    visitors of a block in parts of about as many, so a task compares two
    bounded sets by one matrix product. It returns a count and a label for each
    vector that has links, never the pairs.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[vector]
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    fine = F.coalesce(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    same = F.concat(F.xxhash64("v").cast("string"), F.lit("/"), F.hash("v").cast("string"), F.lit("/"), F.size("v").cast("string"))
    named = rows.withColumn("node", F.when(fine, F.md5(F.concat(same, F.lit("/"), F.to_json("v")))))
    nodes = durable(
        named.filter("node IS NOT NULL").groupBy("node").agg(F.count("v").alias("w"), F.min("vec_id").alias("low"), F.first("v").alias("v"))
    )
    shape = nodes.agg(F.count("node").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = shape["n"], shape["width"] or 0
    if n < 2:
        found = nodes.select("node", F.lit(0).cast("long").alias("n"), F.col("node").alias("label")).limit(0)
    else:
        share = int(min(1.0, sample / n) * (1 << 30))
        drawn = nodes.filter(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) <= share).select("node", "v").orderBy("node").toArrow()
        drawn = unit_rows(drawn.column("v").combine_chunks(), width)
        if len(drawn) < 2:
            drawn = unit_rows(nodes.orderBy("node").limit(64).toArrow().column("v").combine_chunks(), width)
        centres = int(min(most_centres, max(2, np.ceil(np.sqrt(n / per_cell)))))
        index = MultiIndex(drawn, centres, cosine, recall, seed)
        found = _compare(nodes, index, width, cosine, block, kind)
    found = durable(found)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.select(F.col("node").alias("a"), F.col("label").alias("b"))
    linked = counts.select(F.col("node").alias("id"))
    reached = connected_components(linked, edges) if not found.isEmpty() else linked.select("id", F.col("id").alias("component"))
    classes = nodes.select("node", "w", "low").join(reached.withColumnRenamed("id", "node"), "node", "left")
    classes = classes.withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left")
    least = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    known = classes.join(least, "component").select(
        "node", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id"
    )
    out = named.select("vec_id", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _compare(nodes: DataFrame, index: MultiIndex, width: int, cosine: float, block: int, kind: str) -> DataFrame:
    """(node, n, label): links found for a node in one block, and the least node it is tied to there."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own, visited = index.visits(unit_rows(part.column("v"), width))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(own, pa.int32()), pa.array(visited, pa.list_(pa.int32()))],
                    names=[*part.schema.names, "cell", "visits"],
                )

    placed = durable(
        nodes.select("node", "w", "v").mapInArrow(place, f"node string, w long, v {kind}, cell int, visits array<int>")
    )
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    sizes = placed.groupBy("cell").agg(F.count("node").alias("members"))
    visitors = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("cell").alias("visitors"))
    grid = sizes.join(visitors, "cell").select("cell", parts("members").alias("blocks"), parts("visitors").alias("turns"))
    grid = durable(grid)
    pick = lambda c, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(c)).cast("int")
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = placed.join(grid, "cell").select(
        "node", "w", "v", "cell", F.col("cell").alias("home"), pick("blocks", 1).alias("block"), numbers("turns").alias("turn"), F.lit(True).alias("member")
    )
    guests = placed.select("node", "w", "v", F.col("cell").alias("home"), F.explode("visits").alias("cell")).join(grid, "cell")
    guests = guests.select(
        "node", "w", "v", "cell", "home", numbers("blocks").alias("block"), pick("turns", 2).alias("turn"), F.lit(False).alias("member")
    )

    def links(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        is_member = np.asarray(group.column("member"))
        names = np.asarray(group.column("node").to_pylist(), object)
        weights = np.asarray(group.column("w"))
        lengths = np.array([len(v) for v in group.column("v").to_pylist()])
        home = np.asarray(group.column("home"))
        cell = group.column("cell")[0].as_py()
        x = unit_rows(group.column("v").chunk(0) if group.num_rows else pa.array([]), width)
        m, g = np.flatnonzero(is_member), np.flatnonzero(~is_member)
        counts, label = np.zeros(len(names), np.int64), np.arange(len(names))
        order = np.argsort(names, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        label = rank.copy()
        near = np.zeros((len(g), len(m)), bool)
        for at in range(0, len(g), 1024):
            rows = g[at : at + 1024]
            near[at : at + 1024] = (
                (x[rows] @ x[m].T >= cosine) & (lengths[rows][:, None] == lengths[m][None]) & (names[rows][:, None] != names[m][None])
            )
        counts[g] = near @ weights[m]
        away = home[g] != cell  # a guest of another cell isn't visited in turn, so the member's link counts here
        counts[m] = weights[g[away]] @ near[away] if away.any() else 0
        has_g, has_m = near.any(1), near.any(0)
        while len(g) and len(m):
            big = len(names)
            to_g = np.minimum(label[g], np.where(near, label[m][None], big).min(1))
            to_m = np.minimum(label[m], np.where(near, to_g[:, None], big).min(0))
            if (to_g == label[g]).all() and (to_m == label[m]).all():
                break
            label[g], label[m] = to_g, to_m
        keep = np.concatenate([g[has_g], m[has_m]])
        return pa.table(
            {"node": pa.array(names[keep], pa.string()), "n": pa.array(counts[keep]), "label": pa.array(names[order][label[keep]], pa.string())}
        )

    return members.unionByName(guests).groupBy("cell", "block", "turn").applyInArrow(links, "node string, n long, label string")


def measured_recall(vectors: DataFrame, links: DataFrame, cosine: float = 0.95, every: int = 50, block: int = 4_096) -> float:
    """Links found over links there are, for the query set of ids divisible by ``every``.

    The queries meet all rows in blocks: each task multiplies its rows with one
    block of queries at a time and adds up counts.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    asked = rows.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(64))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(63))))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (unit_rows(t.combine_chunks().column("v").chunk(0), width) if t.num_rows else np.zeros((0, width)) for t in (left, right))
        ids, others = np.asarray(left.column("vec_id")), np.asarray(right.column("vec_id"))
        near = (a @ b.T >= cosine) & (ids[:, None] != others[None])
        return pa.table({"vec_id": pa.array(ids), "n": pa.array(near.sum(1))})

    truth = asked.groupBy("q", "part").cogroup(dealt.groupBy("q", "part")).applyInArrow(count, "vec_id long, n long")
    truth = truth.groupBy("vec_id").agg(F.sum("n").alias("n"))
    both = truth.join(links, "vec_id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return 1.0 if not both[0] else both[1] / both[0]
