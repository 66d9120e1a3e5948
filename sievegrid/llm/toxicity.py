"""Toxicity from confirmed examples and unlabelled text: non-negative PU learning."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
BUCKETS = 1 << 22
CACHE = 300_000
FIRST_UNSPACED = "\u2e80"


def held_out(key: Column, folds: int = 5) -> Column:
    """True for the fold whose labels are never learned from (null keys are in none)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def word_features(word: str) -> tuple[int, ...]:
    """The hash bucket of a word; a run of letters of a script without spaces gives those of its pairs."""
    if any(c >= FIRST_UNSPACED for c in word):
        return tuple({zlib.crc32(word[i : i + 2].encode()) % BUCKETS for i in range(max(1, len(word) - 1))})
    return (zlib.crc32(word.encode()) % BUCKETS,)


class Features:
    """Distinct features of texts, those of ``chosen`` only when it is given; words are cached."""

    def __init__(self, chosen: dict[int, int] | None = None):
        self.chosen, self.known = chosen, {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = word_features(word)
        if self.chosen is not None:
            found = tuple(self.chosen[f] for f in found if f in self.chosen)
        if len(self.known) >= CACHE:
            self.known = {}
        self.known[word] = found
        return found

    def __call__(self, text: str) -> set[int]:
        known, out = self.known, set()
        for word in set(WORD.findall(text.lower())):
            found = known.get(word)
            if found is None:
                found = self._of(word)
            if found:
                out.update(found)
        return out


def train(
    rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, width: int, prior: float,
    epochs: int = 400, rate: float = 0.05, ridge: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model by the non-negative PU risk.

    ``rows`` and ``columns`` list the present features. The risk is
    prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)]); while the second
    term is negative its gradient is followed upwards, which keeps the model
    from explaining the positives away.
    """
    n, weights = len(positive), np.zeros(width + 1)
    at_p, at_u = np.flatnonzero(positive), np.flatnonzero(~positive)
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    weights[width] = np.log(prior / (1 - prior))
    for step in range(1, epochs + 1):
        z = np.bincount(rows, weights[columns], n) + weights[width]
        s = sigmoid(z)
        loss_minus = np.logaddexp(0, z)
        negative = loss_minus[at_u].mean() - prior * loss_minus[at_p].mean()
        by_row = np.zeros(n)
        if negative >= 0:
            by_row[at_p] = -prior * (1 - s[at_p]) / len(at_p) - prior * s[at_p] / len(at_p)
            by_row[at_u] = s[at_u] / len(at_u)
        else:
            by_row[at_p] = prior * s[at_p] / len(at_p)
            by_row[at_u] = -s[at_u] / len(at_u)
        slope = np.append(np.bincount(columns, by_row[rows], width), by_row.sum())
        slope[:width] += ridge * weights[:width]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:width], float(weights[width])


class Model:
    """Chosen features with their weights; ``score`` maps texts to probabilities."""

    def __init__(self, chosen: dict[int, int], weights: np.ndarray, bias: float):
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def score(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with ``score`` in [0, 1] for every whole text; null counts as empty."""
        chosen, weights, bias = self.chosen, self.weights.tolist(), self.bias
        kept = docs.drop(name)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = Features(chosen)
            for batch in batches:
                z = [
                    bias + sum(weights[f] for f in sorted(features(t.as_py() or "")))
                    for t in batch.column(text)
                ]
                scores = 1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

        return kept.mapInArrow(run, _with(kept, f"{name} double"))


def _with(df: DataFrame, extra: str):
    from pyspark.sql.types import StructType, _parse_datatype_string

    return StructType(df.schema.fields + _parse_datatype_string(extra).fields)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    folds: int = 5,
    positives: int = 4_000,
    unlabelled: int = 16_000,
    features: int = 4_096,
    least_z: float = 4.0,
    prior: float | None = None,
) -> Model:
    """A model from the confirmed rows of ``labels`` and other texts, none of them held out.

    At most about ``positives`` confirmed and ``unlabelled`` other documents,
    drawn by hash, are used to fit: that bounds what reaches the driver (the
    drawn ids, the counts of the chosen features, and which of them each drawn
    document has). The other documents count as unlabelled whatever their
    label. The features are the words, at most ``features`` of them, whose log
    odds differ by ``least_z`` standard errors. ``prior`` is the share of positives, by default that among all
    labelled rows that aren't held out. Several labels of one document count as
    the largest; null labels are none. Without a positive or an unlabelled
    document, or at a prior of 0, the model scores the prior everywhere.
    """
    spark = docs.sparkSession
    known = (
        labels.filter(~held_out(F.col(key), folds) & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("id"))
        .agg(F.max(label).alias("label"))
    )
    counts = known.agg(F.count("label"), F.sum(F.when(F.col("label") == 1, 1))).first()
    n_labelled, n_positive = counts[0], counts[1] or 0
    share = prior if prior is not None else n_positive / max(n_labelled, 1)
    if not n_positive or not 0 < share < 1:
        return Model({}, np.zeros(0), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    sure = known.filter("label = 1").select("id")
    ids = docs.select(F.col(key).alias("id")).filter(F.col("id").isNotNull() & ~held_out(F.col("id"), folds))
    n_docs = ids.count()
    drawn = lambda df, most, n, seed: df.filter(
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30))
    )
    others = drawn(ids, unlabelled, n_docs, 2).join(sure, "id", "left_anti").distinct()
    picked = drawn(sure, positives, n_positive, 1).select("id", F.lit(True).alias("sure")).unionByName(
        others.select("id", F.lit(False).alias("sure"))
    )
    sample = spark.createDataFrame(picked.toPandas(), "id long, sure boolean")
    texts = docs.join(F.broadcast(sample), docs[key] == sample["id"]).select("sure", F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = Features(), np.zeros((2, BUCKETS), np.int32)
        n = np.zeros(2, np.int64)
        for batch in batches:
            for is_sure, body in zip(batch.column("sure").to_pylist(), batch.column("text").to_pylist()):
                found = find(body or "")
                n[int(is_sure)] += 1
                seen[int(is_sure), np.fromiter(found, np.int64, len(found))] += 1
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_pydict(
            {
                "feature": np.append(at, -1),
                "p": np.append(seen[1, at], n[1]).astype(np.int64),
                "u": np.append(seen[0, at], n[0]).astype(np.int64),
            }
        )

    seen = texts.mapInArrow(count, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    from sievegrid.session import durable

    seen = durable(seen)
    totals = seen.filter("feature = -1").first()
    if totals is None or not totals["p"] or not totals["u"]:
        return Model({}, np.zeros(0), float(np.log(share / (1 - share))))
    half = lambda c: F.col(c) + 0.5
    other = lambda c: F.lit(totals[c]) - F.col(c) + 0.5
    z = (F.log(half("p") / other("p")) - F.log(half("u") / other("u"))) / F.sqrt(1 / half("p") + 1 / half("u"))
    telling = seen.filter("feature >= 0 AND p + u >= 3").filter(F.abs(z) >= least_z)
    best = telling.orderBy(F.abs(z).desc(), "feature").limit(features).select("feature").collect()
    chosen = {r["feature"]: i for i, r in enumerate(sorted(best, key=lambda r: r["feature"]))}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Features(chosen)
        for batch in batches:
            found = [sorted(find(body or "")) for body in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sure"), pa.array([np.asarray(f, "<u2").tobytes() for f in found], pa.binary())], names=["sure", "found"]
            )

    rows = texts.mapInArrow(present, "sure boolean, found binary").orderBy("sure", "found").collect()
    lists = [np.frombuffer(r["found"], "<u2") for r in rows]
    weights, bias = train(
        np.repeat(np.arange(len(rows)), [len(x) for x in lists]),
        np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64),
        np.array([r["sure"] for r in rows]),
        len(chosen),
        share,
    )
    return Model(chosen, weights, bias)
