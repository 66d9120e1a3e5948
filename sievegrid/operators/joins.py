"""Joins of the screening flow. Spark picks broadcast or shuffle from sizes it knows;
AQE splits skewed keys. Nothing here broadcasts a side that grows with the data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.operators.ordering import keep_one


def assemble_submissions(commits: DataFrame, payloads: DataFrame, parsed: DataFrame) -> DataFrame:
    """Commit, parsed submission (inner) and push time (left, empty when unknown)."""
    times = payloads.select("path", "push_time")
    joined = commits.join(parsed, "path").join(times, "path", "left")
    return joined.withColumn("push_time", F.coalesce("push_time", F.lit("")))


def unique_vs_archive(items: DataFrame, archive: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Items that the archive does not hold; a missing archive means all are unique."""
    if archive is None:
        return items
    return items.join(archive.select(*keys).distinct(), list(keys), "left_anti")


def reject_known(items: DataFrame, archive: DataFrame, keys: Sequence[str], uid: str) -> DataFrame:
    """Drop every submission with at least one archived item."""
    known = items.join(archive.select(*keys).distinct(), list(keys), "left_semi").select(uid).distinct()
    return items.join(known, uid, "left_anti")


def distribute_unique(
    items: DataFrame, key: str, score: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Score every distinct item once and fan the result out to all that hold it."""
    scored = score(items.select(key).distinct())
    return items.join(scored, key)


def apply_consensus(
    local: DataFrame, averages: DataFrame, keys: Sequence[str], metrics: Sequence[str], entity: str
) -> DataFrame:
    """Overwrite local metrics by the averages where those are known.

    All or nothing per entity type: when any id of the type has no average,
    none of its metrics change.
    """
    side = averages.select(
        *keys, *[F.col(m).alias(f"_avg_{m}") for m in metrics], F.lit(True).alias("_hit")
    )
    joined = local.join(side, list(keys), "left")
    # rows without an entity type are one type of their own
    complete = joined.groupBy(F.col(entity).alias("_type")).agg(F.bool_and(F.coalesce("_hit", F.lit(False))).alias("_all"))
    out = joined.join(complete, F.col(entity).eqNullSafe(F.col("_type")))
    use = lambda m: F.when(F.col("_all"), F.coalesce(f"_avg_{m}", m)).otherwise(F.col(m))
    return out.select(*[use(c).alias(c) if c in metrics else F.col(c) for c in local.columns])


def merge_scores(
    matrix: DataFrame, scores: DataFrame, keys: Sequence[str], missing: float
) -> DataFrame:
    joined = matrix.join(scores, list(keys), "left")
    return joined.withColumn("score", F.coalesce("score", F.lit(missing)))


def reindex(queries: DataFrame, results: DataFrame, key: str, value: str, fill: float = 0.0) -> DataFrame:
    """One row per query; a query without a result gets the fill value."""
    joined = queries.join(results, key, "left")
    return joined.withColumn(value, F.coalesce(value, F.lit(fill)))


def skip_existing(
    inputs: DataFrame, outputs: DataFrame, key: str, kinds: Sequence[str] | None = None, override: bool = False
) -> DataFrame:
    """Inputs not processed yet; with ``kinds`` only an input with all outputs counts as done."""
    if override:
        return inputs
    done = outputs
    if kinds is not None:
        wanted = outputs.filter(F.col("kind").isin(list(kinds)))
        done = wanted.groupBy(key).agg(F.count_distinct("kind").alias("_n")).filter(F.col("_n") == len(set(kinds)))
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def id_list_filter(df: DataFrame, ids: DataFrame, key: str, reverse: bool = False) -> DataFrame:
    """Case-insensitive include (or exclude) list."""
    listed = ids.select(F.lower(key).alias("_id")).distinct()
    how = "left_anti" if reverse else "left_semi"
    return df.join(listed, F.lower(df[key]) == F.col("_id"), how)


def train_val_split(
    records: DataFrame, split: DataFrame, key: str, rules: Sequence[Column]
) -> tuple[DataFrame, DataFrame]:
    """Listed ids validate; the others train, filtered by all rules."""
    from sievegrid.operators.gates import all_of

    train = id_list_filter(records, split, key, reverse=True).filter(all_of(list(rules)))
    return train, id_list_filter(records, split, key)


def cluster_lookup(chains: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster of ``<record>_<entity>`` in lower case, -1 when unknown."""
    keyed = chains.withColumn("_k", F.lower(F.concat_ws("_", "record", F.col("entity").cast("string"))))
    table = clusters.select(F.col("chain_key").alias("_k"), "cluster_id")
    return (
        keyed.join(table, "_k", "left")
        .withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
        .drop("_k")
    )


def common_targets(
    results: DataFrame, tools: Sequence[str], excluded: DataFrame | None = None
) -> DataFrame:
    """(target, metric) that every tool has, with equally many values."""
    used = results.filter(F.col("tool").isin(list(tools)))
    if excluded is not None:
        used = used.join(excluded, "target", "left_anti")
    sizes = used.groupBy("target", "metric", "tool").agg(F.count(F.lit(1)).alias("_n"))
    fine = (F.col("_tools") == len(set(tools))) & (F.col("_low") == F.col("_high"))
    return (
        sizes.groupBy("target", "metric")
        .agg(
            F.count(F.lit(1)).alias("_tools"), F.min("_n").alias("_low"), F.max("_n").alias("_high")
        )
        .filter(fine)
        .select("target", "metric", F.col("_low").alias("n_values"))
    )


def append_dedup(archive: DataFrame | None, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Archive and new rows together, the last one per key (by ``order``)."""
    both = new if archive is None else archive.unionByName(new)
    return keep_one(both, key, [F.col(order)], last=True)


def consensus_average(
    rows: DataFrame, keys: Sequence[str], validator: str, order: str, metrics: Sequence[str]
) -> DataFrame:
    """Mean of each metric over validators, the first row of a validator counting."""
    first = keep_one(rows, [*keys, validator], [F.col(order)])
    return first.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])
