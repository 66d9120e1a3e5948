"""Rank aggregation: dense, average and min ranks over whole frames, tie-breaks, selection.

All metrics are ranked in one pass over a long (row, metric, value) frame, so
the number of shuffles does not grow with the number of metrics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.scoring import INF, sentinel
from sievegrid.operators.ordering import RangeOrdered, global_row_number, keep_one, sort_columns
from sievegrid.session import durable

# Metric directions by category, and weights of the min-max rank.
METRIC_CATEGORIES = {
    "confidence": {
        "design_iiptm": "max",
        "design_ptm": "max",
        "design_to_target_iptm": "max",
        "min_design_to_target_pae": "min",
        "interaction_pae": "min",
    },
    "physical_interaction": {
        "plip_hbonds_refolded": "max",
        "plip_saltbridge_refolded": "max",
        "delta_sasa_refolded": "max",
    },
    "developability": {"liability_score": "min", "liability_num_violations": "min"},
}
BINDER_WEIGHTS = {
    "design_iiptm": 1.0,
    "design_ptm": 2.0,
    "min_design_to_target_pae": 1.0,
    "plip_hbonds_refolded": 2.0,
    "plip_saltbridge_refolded": 2.0,
    "delta_sasa_refolded": 2.0,
}
# Weights of the absolute score; negative where lower is better.
SCORE_WEIGHTS = {
    "affinity_probability_binary1": 1.5,
    "design_iiptm": 1.0,
    "design_ptm": 0.5,
    "min_design_to_target_pae": -1.0,
    "design_hydrophobicity": -0.125,
    "design_largest_hydrophobic_patch_refolded": -0.15,
    "delta_sasa_refolded": 0.25,
    "plip_saltbridge_refolded": 0.25,
    "plip_hbonds_refolded": 0.25,
}
CONFIDENCE_METRICS = ("design_iiptm", "design_ptm", "min_design_to_target_pae")


FEW = 1 << 17  # distinct values, of all metrics together, whose ranks fit every task


def long_ranks(
    df: DataFrame,
    ids: Sequence[str],
    modes: Mapping[str, str],
    method: str,
    by: Sequence[str] = (),
    lead: Sequence[str] = (),
) -> DataFrame:
    """(ids..., lead..., metric, rank): every metric ranked over the whole frame.

    ``by`` ranks within groups instead; ``lead`` are sort keys before the metric
    itself (``"-x"`` descending). A missing value has no rank. ``df`` is read
    several times: give a durable one.

    Metrics of few distinct values are ranked by their values and counts, and each row
    looks its rank up; the others are ranked row by row. The ranks are the same.
    """
    lead_names = [c.lstrip("-") for c in lead]
    keep = list(dict.fromkeys([*ids, *by, *lead_names]))
    within = list(dict.fromkeys([*by, *lead_names]))
    signed = [
        (-F.col(m) if mode == "max" else F.col(m)).cast("double").alias(m)
        for m, mode in modes.items()
    ]
    wide = df.select(*keep, *signed)
    kinds = [F.approx_count_distinct(F.struct(*within, m)).alias(f"_k{i}") for i, m in enumerate(modes)]
    rows, *kinds = wide.agg(F.count(F.lit(1)), *kinds).first()
    few, left = [], FEW
    for n, m in sorted(zip(kinds, modes)):
        left -= n
        few += [m] if left >= 0 else []
    many = [m for m in modes if m not in few]
    cut = lambda ms: wide.select(*keep, *ms).unpivot(keep, ms, "metric", "value")
    # Missing values form their own group, so that one pass serves both.
    missing = F.coalesce(F.isnan("value"), F.lit(True)) | F.col("value").isNull()
    parts = []
    if many or not few:
        ranked = RangeOrdered(
            cut(many).withColumn("_missing", missing), [*by, "metric", "_missing"], [*lead, "value"], list(ids), rows * len(many)
        ).rank(method, "rank")
        rank = F.when(~F.col("_missing"), F.col("rank"))
        parts.append(ranked.withColumn("rank", rank).drop("value", "_missing"))
    if few:
        counted = cut(few).filter(~missing).groupBy(*within, "metric", "value").agg(F.count(F.lit(1)).alias("_n"))
        order = Window.partitionBy(*by, "metric").orderBy(*sort_columns([*lead, "value"]))  # ``FEW`` rows, about
        end = F.sum("_n").over(order)
        start = end - F.col("_n") + 1
        place = {"min": start, "dense": F.row_number().over(order).cast("bigint"), "average": (start + end) / F.lit(2.0)}
        ranks = counted.select(*[F.col(c).alias(f"_r_{c}") for c in [*within, "metric", "value"]], place[method].alias("rank"))
        same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in within]
        same += [F.col(c) == F.col(f"_r_{c}") for c in ("metric", "value")]
        found = cut(few).join(F.broadcast(ranks), reduce(and_, same), "left")
        parts.append(found.select(*keep, "metric", F.when(~missing, F.col("rank")).alias("rank")))
    return reduce(DataFrame.unionByName, parts)


def rank_sum(
    df: DataFrame,
    ids: Sequence[str],
    modes: Mapping[str, str],
    by: Sequence[str] = (),
    categories: Mapping[str, Sequence[str]] | None = None,
    nulls_last: bool = False,
) -> DataFrame:
    """Dense rank per metric, then rank_sum and worst_rank, and both per category.

    A missing metric adds nothing to the sum unless ``nulls_last`` ranks it
    behind all others.
    """
    if nulls_last:
        df = df.withColumns(
            {m: F.coalesce(F.col(m), F.lit(sentinel(mode))) for m, mode in modes.items()}
        )
    df = durable(df.select(*dict.fromkeys([*ids, *by, *modes])))
    ranks = long_ranks(df, ids, modes, "dense", by)
    in_metric = lambda ms: F.col("metric").isin(list(ms))
    keys = list(dict.fromkeys([*by, *ids]))
    aggregates = [
        F.coalesce(F.sum("rank"), F.lit(0)).alias("rank_sum"),
        F.max("rank").alias("worst_rank"),
        *[F.max(F.when(F.col("metric") == m, F.col("rank"))).alias(f"{m}_rank") for m in modes],
    ]
    for category, members in (categories or {}).items():
        part = F.when(in_metric(members), F.col("rank"))
        aggregates.append(F.coalesce(F.sum(part), F.lit(0)).alias(f"{category}_rank_sum"))
        aggregates.append(F.max(part).alias(f"{category}_worst_rank"))
    return ranks.groupBy(*keys).agg(*aggregates)


def minmax_weighted_rank(
    df: DataFrame,
    key: str,
    modes: Mapping[str, str],
    weights: Mapping[str, float] | None = None,
    k: int = 50,
    max_violations: float | None = None,
    max_score: float | None = None,
) -> DataFrame:
    """Top k by the worst of average rank / weight, with the metric that is the bottleneck."""
    weights = dict(weights or BINDER_WEIGHTS)
    absent = [m for m in weights if m not in df.columns]
    if absent:
        raise ValueError(f"no columns for the weights of {absent}")
    if max_violations is not None and "liability_num_violations" in df.columns:
        df = df.filter(F.col("liability_num_violations") <= max_violations)
    if max_score is not None and "liability_score" in df.columns:
        df = df.filter(F.col("liability_score") <= max_score)
    df = durable(df.select(*dict.fromkeys([key, *weights])))
    ranks = long_ranks(df, [key], {m: modes[m] for m in weights}, "average")
    order = {m: i for i, m in enumerate(weights)}
    weight_of = F.create_map(*[F.lit(x) for m, w in weights.items() for x in (m, float(w))])
    place_of = F.create_map(*[F.lit(x) for m, i in order.items() for x in (m, i)])
    weighted = F.col("rank") / weight_of[F.col("metric")]
    scored = ranks.groupBy(key).agg(
        F.max(weighted).alias("algo2_score"),
        F.max_by("metric", F.struct(weighted.alias("w"), (-place_of[F.col("metric")]).alias("p"))).alias(
            "bottleneck_metric"
        ),
        *[F.max(F.when(F.col("metric") == m, weighted)).alias(f"wrank_{m}") for m in weights],
    )
    top = scored.orderBy("algo2_score", key).limit(k)
    position = F.row_number().over(Window.orderBy("algo2_score", key))  # at most k rows
    return top.withColumn("selection_rank", position)


def quality_rank(
    df: DataFrame,
    key: str,
    inverse_importance: Mapping[str, float | None],
    tie_metric: str,
    passed: str = "num_filters_passed",
) -> DataFrame:
    """Final rank and quality of designs.

    Per metric a descending min rank on (filters passed, metric) over its
    inverse importance; the worst of them orders the designs, ``tie_metric``
    breaks ties.
    """
    used = {m: w for m, w in inverse_importance.items() if w is not None}
    df = durable(df.select(*dict.fromkeys([key, passed, tie_metric, *used])))
    ranks = long_ranks(df, [key], dict.fromkeys(used, "max"), "min", lead=[f"-{passed}"])
    weight_of = F.create_map(*[F.lit(x) for m, w in used.items() for x in (m, float(w))])
    worst = ranks.groupBy(key).agg(F.max(F.col("rank") / weight_of[F.col("metric")]).alias("max_rank"))
    worst = durable(worst.join(df.select(key, F.col(tie_metric).alias("_tie")), key))
    final = RangeOrdered(worst, [], ["max_rank"], ["-_tie", key], worst.count()).rank("dense", "secondary_rank", "final_rank")
    n = final.agg(F.count(F.lit(1))).scalar()
    quality = F.when(n == 1, 1.0).otherwise(1 - (F.col("final_rank") - 1) / (n - 1))
    return final.drop("_tie").withColumn("quality_score", quality)


def absolute_score(
    df: DataFrame,
    stats: Mapping[str, tuple[float, float]],
    filter_columns: Sequence[str] = (),
    weights: Mapping[str, float] = SCORE_WEIGHTS,
) -> DataFrame:
    """Weighted z-scores over all importances, a confidence part, and a tenth per failed filter."""
    z = lambda m: (F.col(m) - stats[m][0]) / stats[m][1]
    total = F.lit(0.0)
    for m, w in weights.items():
        if m in df.columns:
            total = total + w * z(m)
    total = total / sum(abs(w) for w in weights.values())
    part = [m for m in CONFIDENCE_METRICS if m in weights and m in df.columns]
    confidence = F.lit(0.0)
    for m in part:
        confidence = confidence + weights[m] * z(m)
    if part:
        confidence = confidence / sum(abs(weights[m]) for m in part)
    for flag in filter_columns:
        failed = ~F.col(flag)
        if "fraction" in flag:
            failed = failed & (F.col("num_design") > 8)
        total = total * F.when(failed, 0.1).otherwise(1.0)
    return df.withColumns({"absolute_score": total, "structure_confidence": confidence})


def rank_uids(
    df: DataFrame,
    score: str,
    mode: str,
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    block: str = "block",
    push_time: str = "push_time",
    uid: str = "uid",
) -> DataFrame:
    """Rank 1..n among uids with a finite score; ties by categories, block, push time, uid."""
    value = F.col(score).cast("double")
    fine = value.isNotNull() & ~F.isnan(value) & ~F.abs(value).eqNullSafe(F.lit(INF))
    keyed = df.filter(fine).withColumns(
        {
            # equal scores must tie whatever the order of summation
            "_score": F.round(-value if mode == "max" else value, 9),
            **{f"_tie{i}": F.coalesce(F.col(t).cast("double"), F.lit(INF)) for i, t in enumerate(ties)},
            "_block": F.coalesce(F.col(block).cast("double"), F.lit(INF)),
        }
    )
    order = ["_score", *[f"_tie{i}" for i in range(len(ties))], "_block", push_time, uid]
    ranked = RangeOrdered(keyed, by, order).row_number("rank")
    return ranked.select(*df.columns, "rank")


def final_score(
    df: DataFrame,
    group: Sequence[str],
    item: str,
    score: str,
    mode: str,
    items: int | None = None,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Sum over items of the mean over targets; an item with an infinite or missing score,
    and an absent item, counts as the sentinel.

    ``totals`` maps columns to names of sums over all rows, taken in the same pass.
    """
    totals = dict(totals or {})
    bad = F.lit(sentinel(mode))
    value = F.when(F.coalesce(F.col(score), F.lit(0.0)) == 0, bad).otherwise(F.col(score))
    per_item = df.groupBy(*group, item).agg(
        F.when(F.max(F.abs(value)) == INF, bad).otherwise(F.avg(value)).alias("_mean"),
        *[F.sum(c).alias(name) for c, name in totals.items()],
    )
    total = F.sum("_mean")
    if items is not None:
        total = F.when(F.count(F.lit(1)) < items, bad).otherwise(total)
    return per_item.groupBy(*group).agg(
        total.alias("final_score"), *[F.sum(n).cast("double").alias(n) for n in totals.values()]
    )


def category_rank_total(df: DataFrame, group: Sequence[str], column: str, name: str) -> DataFrame:
    return df.groupBy(*group).agg(F.coalesce(F.sum(column), F.lit(INF)).alias(name))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """k best rows per group: each task keeps k rows per group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= k)


def limit_targets(df: DataFrame, target: str, order: Sequence[Column], n: int, k: int) -> DataFrame:
    """At most n targets (the first by name) and k rows of each."""
    first = df.select(target).distinct().orderBy(target).limit(n)  # n rows: safe to broadcast
    return top_per_group(df.join(F.broadcast(first), target), [target], order, k)


def distinct_with_index(df: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """First row per key, and every row with the position of its key among the firsts."""
    first = keep_one(df, [key], [F.col(order)])
    numbered = global_row_number(first, [order], "index").withColumn("index", F.col("index") - 1)
    return numbered, df.join(numbered.select(key, "index"), key)


def truncate_list(items: Column, n: int) -> Column:
    """The first n items, null when there are fewer."""
    return F.when(F.size(items) >= n, F.slice(items, 1, n))


def priority_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def summary_table(df: DataFrame, metrics: Sequence[str], top: int, diverse: Column) -> DataFrame:
    """Mean of each metric over all, the top and the diverse designs, in one pass."""
    in_top = F.col("final_rank") <= top
    sets = {"all": F.lit(True), "top": in_top, "diverse": diverse}
    means = [
        F.avg(F.when(chosen, F.col(m))).alias(f"{s}_{m}") for s, chosen in sets.items() for m in metrics
    ]
    counts = [F.count(F.lit(1)).alias("n_designs"), F.count_if("pass_filters").alias("n_passing")]
    return df.agg(*counts, *means)


def winning_group(df: DataFrame, score: str, by: Sequence[str], length: int = 361) -> DataFrame:
    """All rows whose score, rounded to 4 places, equals the best of the group."""
    rounded = df.withColumn("_score", F.round(score, 4))
    best = rounded.groupBy(*by).agg(F.max("_score").alias("_score"))
    out = rounded.join(best, [*by, "_score"], "left_semi")
    return out.withColumn("blocks_into_epoch", F.col("block") % length).drop("_score")


def allocate(winners: DataFrame, weight: float, override: int | None = None) -> DataFrame:
    """Shares per slot: winners hold (epoch, molecule, nanobody), null for no winner.

    Without a winner the share goes to slot 0; an override slot takes everything.
    """
    shares = F.explode(
        F.array(
            F.struct(F.lit("molecule").alias("kind"), F.col("molecule").alias("w"), F.lit(1 - weight).alias("s")),
            F.struct(F.lit("nanobody").alias("kind"), F.col("nanobody").alias("w"), F.lit(weight).alias("s")),
        )
    )
    flat = winners.select("epoch", shares.alias("x")).select("epoch", "x.*")
    slot = F.coalesce("w", F.lit(0)) if override is None else F.lit(override)
    return flat.groupBy("epoch", slot.cast("bigint").alias("slot")).agg(
        F.round(F.sum("s"), 8).alias("share")
    )


def payouts(winners: DataFrame, weight: float) -> DataFrame:
    """(epoch, kind, winner, share rounded to 8) of the winners that exist."""
    both = F.array(
        F.struct(F.lit("molecule").alias("kind"), F.col("molecule").alias("winner"), F.round(F.lit(1 - weight), 8).alias("share")),
        F.struct(F.lit("nanobody").alias("kind"), F.col("nanobody").alias("winner"), F.round(F.lit(weight), 8).alias("share")),
    )
    return winners.select("epoch", F.explode(both).alias("x")).select("epoch", "x.*").filter("winner IS NOT NULL")


def best_sample(df: DataFrame, design: str, iptm: str = "iptm", ptm: str = "ptm") -> DataFrame:
    """The sample with the highest 0.8 ipTM + 0.2 pTM of each design."""
    merit = 0.8 * F.col(iptm) + 0.2 * F.col(ptm)
    row = F.struct(*[c for c in df.columns if c != design])
    return df.groupBy(design).agg(F.max_by(row, F.struct(merit, -F.col("sample"))).alias("_r")).select(design, "_r.*")
