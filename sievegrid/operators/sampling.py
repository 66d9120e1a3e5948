"""Weights and seeded draws. All draws hash the row keys, so they are the same on any cluster."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegrid.functions.draws import geometric, pick, uniform
from sievegrid.functions.sequences import AMINO_ACIDS
from sievegrid.operators.ordering import RangeOrdered, global_row_number
from sievegrid.session import durable

# Molecule kinds of chains.
PROTEIN, DNA, RNA, LIGAND = 0, 1, 2, 3


def _kind_count(kinds: Sequence[Column], wanted: Sequence[int]) -> Column:
    return sum((k.isin(list(wanted)).cast("int") for k in kinds), F.lit(0))


def cluster_weights(
    chains: DataFrame,
    interfaces: DataFrame,
    beta_chain: float = 0.5,
    beta_interface: float = 1.0,
    alphas: tuple[float, float, float] = (3.0, 3.0, 1.0),
) -> DataFrame:
    """(record, kind, item, weight): beta / cluster size times the mix of molecule kinds,
    normalised over chains and interfaces together."""
    prot, nucl, lig = alphas
    mix = lambda ks: (
        prot * _kind_count(ks, [PROTEIN]) + nucl * _kind_count(ks, [DNA, RNA]) + lig * _kind_count(ks, [LIGAND])
    )
    live = chains.filter("valid")
    sizes = live.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_size"))
    one = live.join(sizes, "cluster_id").select(
        "record",
        F.lit(0).alias("kind"),
        F.col("chain_id").cast("bigint").alias("item"),
        (F.lit(beta_chain) / F.col("_size") * mix([F.col("mol_type")])).alias("_w"),
    )
    a, b = F.col("cluster_1").cast("string"), F.col("cluster_2").cast("string")
    paired = interfaces.filter("valid").withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)})
    pair_sizes = paired.groupBy("_lo", "_hi").agg(F.count(F.lit(1)).alias("_size"))
    two = paired.join(pair_sizes, ["_lo", "_hi"]).select(
        "record",
        F.lit(1).alias("kind"),
        F.col("interface_id").cast("bigint").alias("item"),
        (
            F.lit(beta_interface) / F.col("_size") * mix([F.col("mol_type_1"), F.col("mol_type_2")])
        ).alias("_w"),
    )
    both = one.unionByName(two)
    total = both.agg(F.sum("_w")).scalar()
    return both.select("record", "kind", "item", (F.col("_w") / total).alias("weight"))


def weighted_draw(df: DataFrame, keys: Sequence[str], weight: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement, proportional to weight.

    Rows get their half-open slice of the cumulative weight; a draw and the
    slice that holds it meet by an as-of step in one distributed order, so
    there is no range join over all rows.
    """
    spark = df.sparkSession
    positive = df.filter(F.col(weight) > 0).select(*keys, F.col(weight).cast("double").alias("_w"))
    ends = durable(RangeOrdered(positive, [], list(keys)).running_sum("_w", "_end"))
    total = ends.agg(F.max("_end")).scalar()
    rows = ends.select((F.col("_end") - F.col("_w")).alias("_at"), F.lit(0).alias("_draw"), F.struct(*keys).alias("_row"))
    draws = spark.range(1, n + 1).select(F.col("id").alias("_draw"))
    points = draws.select(
        (uniform(seed, F.col("_draw")) * total).alias("_at"),
        "_draw",
        F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"),
    )
    return _carry_forward(rows.unionByName(points)).filter("_draw > 0").select(
        F.col("_draw").alias("draw"), "_row.*"
    )


def _carry_forward(df: DataFrame) -> DataFrame:
    """Fill ``_row`` from the last row at or before, in the order of (_at, _draw)."""
    numbered = durable(global_row_number(df, ["_at", "_draw"], "_n"))
    block = F.floor(F.col("_n") / 4096).cast("bigint")
    from pyspark.sql import Window

    inside = Window.partitionBy("_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    local = numbered.withColumn("_block", block).withColumn(
        "_filled", F.last("_row", ignorenulls=True).over(inside)
    )
    tails = local.groupBy("_block").agg(
        F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("_n"))).alias("_tail")
    )
    # one row per 4096: ordered by the same range method, so it stays distributed
    tails = RangeOrdered(tails.withColumn("_seen", F.col("_tail").isNotNull()), [], ["_block"])
    carried = _last_seen(tails)
    return (
        local.join(carried, "_block", "left")
        .withColumn("_row", F.coalesce("_filled", "_carried"))
        .select("_at", "_draw", "_row")
    )


def _last_seen(ordered: RangeOrdered) -> DataFrame:
    """Per block the last non-null tail of the blocks before it."""
    runs = ordered.running_sums({"_k": F.col("_seen").cast("int")})
    holders = runs.filter("_seen").select(F.col("_k").alias("_j"), F.col("_tail").alias("_carried"))
    before = F.col("_k") - F.col("_seen").cast("int")
    return runs.select("_block", before.alias("_j")).join(holders, "_j", "left").drop("_j")


def drop_invalid(records: DataFrame) -> DataFrame:
    """Records without their invalid chains and interfaces."""
    return records.withColumns(
        {
            "chains": F.filter("chains", lambda c: c["valid"]),
            "interfaces": F.filter("interfaces", lambda i: i["valid"]),
        }
    )


def numbered_draw(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """n uniform draws with replacement: a hashed position joined to row numbers."""
    spark = df.sparkSession
    numbered = durable(global_row_number(df, [key], "_place"))
    size = numbered.agg(F.count(F.lit(1))).scalar()
    draws = spark.range(1, n + 1).withColumnRenamed("id", "draw")
    placed = draws.select("draw", (1 + pick(seed, size, F.col("draw"))).alias("_place"))
    return placed.join(numbered, "_place").drop("_place")


def two_stratum_draw(
    df: DataFrame, key: str, size: Column, n: int, seed: int, limit: int = 200, p: float = 0.01
) -> DataFrame:
    """Each draw takes the small stratum with probability p, else the large one."""
    spark = df.sparkSession
    strata = df.withColumn("_small", size <= limit)
    numbered = durable(RangeOrdered(strata, ["_small"], [key]).row_number("_place"))
    sizes = numbered.groupBy("_small").agg(F.count(F.lit(1)).alias("_n"))  # two rows
    draws = spark.range(1, n + 1).select(
        F.col("id").alias("draw"), (uniform(f"{seed}s", F.col("id")) < p).alias("_small")
    )
    placed = draws.join(F.broadcast(sizes), "_small").select(
        "draw", "_small", (1 + pick(seed, F.col("_n"), F.col("draw"))).alias("_place")
    )
    return placed.join(numbered, ["_small", "_place"]).drop("_small", "_place")


def dataset_of_draw(draws: DataFrame, probabilities: Sequence[float], seed: int) -> DataFrame:
    """Dataset index of each draw by the mixture probabilities."""
    u, edge, out = uniform(f"{seed}d", F.col("draw")), 0.0, None
    total = sum(probabilities)
    for i, p in enumerate(probabilities[:-1]):
        edge += p / total
        out = F.when(u < edge, i) if out is None else out.when(u < edge, i)
    last = F.lit(len(probabilities) - 1)
    return draws.withColumn("dataset", last if out is None else out.otherwise(last))


def subset(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows without replacement: the n smallest hashes, a bounded top-k."""
    u = uniform(seed, *[F.col(k) for k in key])
    return df.withColumn("_u", u).orderBy("_u", *key).limit(n).drop("_u")


def mutate(df: DataFrame, key: str, seq: str, n: int, seed: int) -> Column:
    """n distinct positions, each replaced by a different residue; works inside one row.

    A position's draw is ``draws.uniform`` of the key and the position, the smallest ones are taken; the hashes
    come in Python batches, where one costs a third of its columns.
    """

    @F.pandas_udf(T.StringType())
    def change(keys: pd.Series, seqs: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else mutated(k, s, n, seed) for k, s in zip(keys, seqs)], dtype=object)

    return change(F.col(key).cast("string"), F.col(seq))


def mutated(key: str | None, seq: str, n: int, seed: int) -> str:
    """``mutate`` of one sequence: equal hashes are taken by position."""
    letters = list(seq) or [""]

    def draws(label: str):
        """Function of a position: its uniform number in steps of 2^-52."""
        head = hashlib.md5("|".join([label] if key is None else [label, key]).encode() + b"|")

        def number(i: int) -> int:
            h = head.copy()
            h.update(b"%d" % i)
            return int.from_bytes(h.digest()[:8], "big") >> 12

        return number

    place, other = draws(str(seed)), draws(f"{seed}r")
    for _, i in heapq.nsmallest(n, zip(map(place, range(len(letters))), range(len(letters)))):
        others = AMINO_ACIDS.replace(letters[i], "") if letters[i] else AMINO_ACIDS
        letters[i] = others[math.floor(other(i) / 2**52 * len(others))]
    return "".join(letters)


def geometric_subset(df: DataFrame, by: Sequence[str], key: str, p: float, seed: int) -> DataFrame:
    """k = geometric(p) + 1 random rows per group."""
    group = [F.col(b) for b in by]
    shuffled = df.withColumn("_u", uniform(seed, *group, F.col(key)))
    placed = RangeOrdered(shuffled, by, ["_u", key]).row_number("_place")
    k = geometric(p, uniform(f"{seed}k", *group)) + 1
    return placed.filter(F.col("_place") <= k).drop("_u", "_place")
