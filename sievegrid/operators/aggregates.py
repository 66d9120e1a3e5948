"""Rollups of screening metrics. Groups are reduced by partial aggregates only."""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.draws import uniform
from sievegrid.operators.ordering import RangeOrdered
from sievegrid.session import durable, unnest

FINGERPRINT_BITS = 167  # fixed value: bits of the structural-key fingerprint


def _h(p: Column) -> Column:
    inner = (p > 0) & (p < 1)
    return F.when(inner, -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(0.0)


def bit_entropy(df: DataFrame, by: Sequence[str], bits: str, n_bits: int = FINGERPRINT_BITS) -> DataFrame:
    """Mean over all bits of the entropy of a bit being set."""
    sizes = df.filter(F.col(bits).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    counts = unnest(df, F.col(bits), "_bit", *by).groupBy(*by, "_bit").agg(F.count(F.lit(1)).alias("_c"))
    joined = counts.join(sizes, list(by))
    return joined.groupBy(*by).agg((F.sum(_h(F.col("_c") / F.col("_n"))) / n_bits).alias("entropy"))


def find_identical(df: DataFrame, uid: str, key: str, index: str) -> DataFrame:
    """Rows whose (uid, key) occurs more than once, one output row per item.

    Long form: a group is never gathered into one array, however large.
    """
    repeated = df.groupBy(uid, key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return df.join(repeated, [uid, key], "left_semi").select(uid, key, index)


def per_target_mean(df: DataFrame, target: Column, metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(target.alias("target")).agg(*[F.round(F.avg(m), 5).alias(m) for m in metrics])


def exact_median(df: DataFrame, value: str, key: str, name: str = "median") -> DataFrame:
    """Exact median of a column by position in a distributed sort."""
    present = df.filter(F.col(value).isNotNull())
    placed = RangeOrdered(present.select(value, key), [], [value, key]).row_number("_place")
    n = present.agg(F.count(F.lit(1))).scalar()
    middle = placed.filter(F.col("_place").between(F.floor((n + 1) / 2), F.floor(n / 2) + 1))
    return middle.agg(F.avg(value).alias(name))


def novelty(hits: DataFrame) -> DataFrame:
    """Best mean of the two normalised scores per query."""
    score = (F.col("qtmscore") + F.col("ttmscore")) / 2
    return hits.groupBy("query").agg(F.max(score).alias("novelty"))


def best_of_samples(
    df: DataFrame, by: Sequence[str], value: str, confidence: str, sample: str, lower_is_better: bool = False
) -> DataFrame:
    """Oracle (best), average, and value of the most confident sample."""
    best = F.min(value) if lower_is_better else F.max(value)
    rank = F.struct(F.col(confidence), -F.col(sample))
    return df.groupBy(*by).agg(
        best.alias("oracle"), F.avg(value).alias("average"), F.max_by(value, rank).alias("top1")
    )


def fraction_over(
    df: DataFrame, by: Sequence[str], values: Column, threshold: float, over: bool, unassigned: Column, default: float
) -> DataFrame:
    """Share of values beyond a threshold; nulls drop out, each unassigned entry counts as the default."""
    test = lambda v: (v > threshold) if over else (v < threshold)
    real = F.filter(values, lambda v: v.isNotNull())
    hits = F.size(F.filter(real, test))
    default_hit = int(default > threshold if over else default < threshold)
    total = F.size(real) + unassigned
    counted = df.groupBy(*by).agg(
        F.sum(hits + unassigned * default_hit).alias("_hits"), F.sum(total).alias("n_values")
    )
    return counted.select(*by, F.try_divide("_hits", "n_values").alias("fraction"), "n_values")


# Chance of at most 0, 1, 2, ... draws of a row: the Poisson(1) distribution to 15 digits.
POISSON_STEPS = [round(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)), 15) for k in range(9)]


def bootstrap_ci(
    df: DataFrame, by: Sequence[str], value: str, key: str, n_boot: int = 1000, alpha: float = 0.05, seed: int = 0
) -> DataFrame:
    """Mean and percentile interval of resampled means per group.

    In every replicate a row counts as often as a Poisson(1) number drawn by
    hash says, which is what drawing with replacement comes to in a large group;
    replicates that draw nothing are left out. A row meets its replicates inside
    its task, where the sums of (group, replicate) are taken first: what is
    shuffled is n_boot sums per group and task, never rows times replicates.
    """
    draw = uniform(seed, *[F.col(b) for b in by], F.col("_rep"), F.col(key))
    times = sum((F.when(draw >= c, 1).otherwise(0) for c in POISSON_STEPS), F.lit(0))
    replicas = df.select(*by, F.col(value).alias("_v"), key, F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("_rep"))
    sums = replicas.withColumn("_w", times).groupBy(*by, "_rep").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_n"))
    bounds = sums.filter("_n > 0").withColumn("_m", F.col("_s") / F.col("_n")).groupBy(*by).agg(
        F.percentile("_m", F.lit(alpha / 2)).alias("lower"),
        F.percentile("_m", F.lit(1 - alpha / 2)).alias("upper"),
    )
    means = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    return means.join(bounds, list(by)).select(*by, "mean", "lower", "upper")


def validity_rollup(df: DataFrame, by: Sequence[str], sample: str, valid: str) -> DataFrame:
    """Validity of the first sample, and whether any sample is valid."""
    return df.groupBy(*by).agg(
        F.max(F.when(F.col(sample) == 0, F.col(valid).cast("int"))).alias("top1"),
        F.max(F.col(valid).cast("int")).alias("oracle"),
    )


def class_metrics(df: DataFrame, by: Sequence[str], pred: str, true: str, classes: Mapping[int, str]) -> DataFrame:
    """Precision, recall and accuracy per class over the conditioned positions (true != 0).

    NaN where a denominator is empty.
    """
    p, t = F.col(pred), F.col(true)
    nan = F.lit(float("nan"))
    out, total = [], F.lit(0)
    for i, name in classes.items():
        tp = F.count_if((p == i) & (t == i))
        fp = F.count_if((p == i) & (t != i) & (t != 0))
        fn = F.count_if((p != i) & (t == i))
        out.append(F.coalesce(F.try_divide(tp, tp + fp), nan).alias(f"precision_{name}"))
        out.append(F.coalesce(F.try_divide(tp, tp + fn), nan).alias(f"recall_{name}"))
        out.append(F.coalesce(F.try_divide(tp, tp + fp + fn), nan).alias(f"accuracy_{name}"))
        total = total + tp
    conditioned = F.count_if(t != 0)
    out.append(F.coalesce(F.try_divide(total, conditioned), nan).alias("accuracy_overall"))
    return df.groupBy(*by).agg(*out)


def position_counts(rows: DataFrame, by: Sequence[str], seq: str, letters: str) -> DataFrame:
    """Letter counts per alignment column; letters outside the alphabet are ignored."""
    placed = rows.select(*by, F.posexplode(F.split(F.upper(seq), "")).alias("position", "letter"))
    placed = placed.filter(F.col("letter") != "")
    return placed.groupBy(*by, "position").agg(
        *[F.count_if(F.col("letter") == a).alias(a) for a in letters]
    )


def logo_information(counts: DataFrame, keys: Sequence[str], letters: str) -> DataFrame:
    """Information log2(20) - H per column of a count matrix, and letter heights p * info."""
    total = F.aggregate(F.array(*letters), F.lit(0).cast("bigint"), lambda acc, c: acc + c)
    shares = counts.withColumn("_n", total).select(
        *keys,
        *[F.coalesce(F.try_divide(F.col(a), F.col("_n")), F.lit(0.0)).alias(a) for a in letters],
    )
    entropy = F.aggregate(
        F.array(*letters),
        F.lit(0.0),
        lambda acc, p: acc + F.when(p > 0, -p * F.log2(p)).otherwise(0.0),
    )
    informed = shares.withColumn("information", F.lit(float(np.log2(20))) - entropy)
    heights = [(F.col(a) * F.col("information")).alias(f"height_{a}") for a in letters]
    return informed.select(*keys, "information", *heights)


def histogram(df: DataFrame, by: Sequence[str], value: str, bins: int) -> DataFrame:
    """Equal-width bin counts between minimum and maximum, and the mean; NaN and null drop out."""
    v = F.col(value)
    present = df.filter(v.isNotNull() & ~F.isnan(v)).select(*by, value)
    span = present.groupBy(*by).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean")
    )
    if by:
        joined = present.join(span, list(by))
    else:
        whole = span.select(F.struct("low", "high", "mean")).scalar()
        joined = present.withColumn("_s", whole).select("*", "_s.*")
    place = F.least(F.floor((v - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    bin_no = F.when(F.col("high") == F.col("low"), 0).otherwise(place).cast("int")
    return joined.groupBy(*by, bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.any_value("low").alias("low"),
        F.any_value("high").alias("high"),
        F.any_value("mean").alias("mean"),
    )


def cluster_sizes(chains: DataFrame) -> DataFrame:
    return chains.filter("valid").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def interface_cluster_sizes(interfaces: DataFrame) -> DataFrame:
    """Valid interfaces per sorted pair of chain clusters (text order)."""
    a, b = F.col("cluster_1").cast("string"), F.col("cluster_2").cast("string")
    return (
        interfaces.filter("valid")
        .groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
        .agg(F.count(F.lit(1)).alias("size"))
    )


def physical_validity(df: DataFrame, clashes: Sequence[str], violations: Sequence[str]) -> DataFrame:
    add = lambda cs: sum((F.col(c) for c in cs), F.lit(0))
    return df.withColumns(
        {
            "num_clashes": add(clashes),
            "num_violations": add(violations),
            "valid": (add(clashes) == 0) & (add(violations) == 0),
        }
    )


def vendi(df: DataFrame, group: str, vector: str, dim: int, mask: Column | None = None) -> DataFrame:
    """Vendi score per group for cosine similarity: exp of the entropy of the eigenvalues of K/n.

    K = X X^T has the non-zero eigenvalues of the dim x dim matrix X^T X, so
    only partial Gram matrices leave the tasks, never the n x n similarities.
    A group without rows under the mask scores 0.
    """
    keep = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    rows = df.select(F.col(group).alias("g"), F.col(vector).alias("v"), keep.alias("keep"))

    def partial(batches):
        for pdf in batches:
            out = []
            for g, part in pdf.groupby("g"):
                used = part[part["keep"]]
                x = np.array(used["v"].tolist(), dtype=float).reshape(len(used), dim)
                if len(x):
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                gram = x.T @ x
                out.append(pd.DataFrame({"g": g, "i": np.arange(dim), "row": list(gram), "n": len(x)}))
            if out:
                yield pd.concat(out)

    kind = rows.schema["g"].dataType.simpleString()
    parts = rows.mapInPandas(partial, f"g {kind}, i int, row array<double>, n long")
    sums = [F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(dim)]
    gram = parts.groupBy("g", "i").agg(F.sum("n").alias("n"), *sums)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        value = 0.0
        if n:
            matrix = pdf.sort_values("i")[[f"c{j}" for j in range(dim)]].to_numpy() / n
            eigen = np.clip(np.linalg.eigvalsh(matrix), 0.0, None)
            eigen = eigen[eigen > 0]
            value = float(np.exp(-(eigen * np.log(eigen)).sum()))
        return pd.DataFrame({group: [pdf["g"].iloc[0]], "vendi": [value]})

    # dim rows per group, whatever the group held
    return gram.groupBy("g").applyInPandas(score, f"{group} {kind}, vendi double")


def group_states(
    df: DataFrame,
    by: Sequence[str],
    state: str,
    fold: Callable[[pd.DataFrame], dict],
    merge: Callable[[dict, dict], dict],
    finish: Callable[[dict], dict],
    result: str,
    most_keys: int = 10_000,
) -> DataFrame:
    """A function of groups that returns several values, from states that merge.

    ``fold`` makes a state of some rows of a group, ``merge`` one of two, ``finish`` the result. Every task folds its
    Arrow batches to a state per group (at most ``most_keys`` are held at once), and a group is then merged from the states
    of the tasks, a few values each, so no task ever holds its rows. ``state`` and ``result`` are schemas.
    """
    keys = df.select(*by).schema
    of_keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.fields)
    names = list(by)
    integral = [f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") for f in keys.fields]

    def rows_of(held: dict) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip(names, k)), **s} for k, s in held.items()])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, dict] = {}
        for pdf in batches:
            for key, rows in pdf.groupby(names, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else int(k) if whole_number else k for k, whole_number in zip(key, integral))
                folded = fold(rows)
                held[key] = merge(held[key], folded) if key in held else folded
            if len(held) > most_keys:
                yield rows_of(held)
                held = {}
        if held:
            yield rows_of(held)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        states = pdf.drop(columns=names).to_dict("records")
        return pdf[names].head(1).assign(**finish(functools.reduce(merge, states)))

    states = df.mapInPandas(partial, f"{of_keys}, {state}")
    return states.groupBy(*names).applyInPandas(whole, f"{of_keys}, {result}")


def group_median(df: DataFrame, by: str, value: str, ranges: int = 256, few: int = 1024) -> DataFrame:
    """(by, median): the middle value of each group, or the mean of the two middle ones.

    Every round counts the values of a group in ``ranges`` equal ranges and goes on in the one that holds
    the middle, until it holds ``few`` values or one; only counts are shuffled before. Null and NaN values don't
    count, infinite ones do; groups without values don't appear.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        F.col(by).alias("k"), F.col(value).cast("double").alias("v")
    )
    rows = durable(rows)
    ends = rows.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    # the ranks of the one or two middles, counted from the smallest value of [lo, hi]
    middles = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))
    targets = durable(ends.withColumn("rank", F.explode(middles)).withColumn("target", F.col("rank")))
    done = targets.limit(0)
    of_group = F.col("k").eqNullSafe(F.col("g")) & F.col("v").between(F.col("lo"), F.col("hi"))
    least, most = -sys.float_info.max, sys.float_info.max
    half = lambda c: F.greatest(F.least(F.col(c), F.lit(most)), F.lit(least)) / 2
    while True:
        wide = (F.col("n") > few) & (F.col("lo") < F.col("hi"))
        done = done.unionByName(targets.filter(~wide))
        left = targets.filter(wide).withColumnRenamed("k", "g")
        if left.isEmpty():
            break
        share = F.coalesce(F.try_divide(half("v") - half("lo"), half("hi") - half("lo")), F.lit(0.0))
        inner = F.least(F.floor(share * ranges), F.lit(ranges - 1))
        # the ends of a range never share a place, so every round parts them
        place = F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), ranges).otherwise(inner)
        counts = rows.join(left, of_group).groupBy("k", "target", "rank", place.alias("place")).agg(
            F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        up_to = Window.partitionBy("k", "target").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        placed = counts.withColumn("upto", F.sum("c").over(up_to))
        placed = placed.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        rank = (F.col("rank") - F.col("upto") + F.col("c")).alias("rank")
        targets = durable(placed.select("k", "lo", "hi", F.col("c").alias("n"), rank, "target"))
    single = done.filter("lo >= hi").select("k", F.col("lo").alias("v"))
    some = rows.join(done.filter("lo < hi").withColumnRenamed("k", "g"), of_group)
    order = Window.partitionBy("k", "target").orderBy("v")
    picked = some.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") == F.col("rank")).select("k", "v")
    return single.unionByName(picked).groupBy(F.col("k").alias(by)).agg(F.avg("v").alias("median"))
