"""Unions of runs, alignments and clusters."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.sequences import sequence_hash

# Most alignment rows, and most paired rows among them.
MAX_MSA_SEQS = 16384
MAX_PAIRED_SEQS = 8192


def merge_runs(runs: Mapping[str, DataFrame], key: str = "id") -> DataFrame:
    """All runs under each other, ids prefixed by the run tag; absent columns are null."""
    if not runs:
        raise ValueError("no runs to merge")
    tagged = [
        df.withColumn(key, F.concat_ws("_", F.lit(tag), F.col(key))).withColumn("run_tag", F.lit(tag))
        for tag, df in runs.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def cluster_union(proteins: DataFrame, singletons: DataFrame, ligands: DataFrame) -> DataFrame:
    """Protein clusters, short and nucleotide sequences by their own hash, ligands by their code."""
    own = sequence_hash(F.col("seq"))
    alone = singletons.select(own.alias("member"), own.alias("cluster"))
    codes = ligands.select(F.col("code").alias("member"), F.col("code").alias("cluster"))
    return proteins.select("member", "cluster").unionByName(alone).unionByName(codes)


def combine_msas(
    paired: DataFrame, unpaired: DataFrame, max_seqs: int = MAX_MSA_SEQS, max_paired: int = MAX_PAIRED_SEQS
) -> DataFrame:
    """(msa_id, idx, key, sequence) from rows (msa_id, idx, sequence).

    Paired rows keep their index as key and lose all-gap rows; unpaired rows
    fill up to the cap with key -1, their query row left out when there is a
    paired one. Row indexes start at 0 per alignment.
    """
    head = paired.filter(F.col("idx") < max_paired)
    kept = head.filter(F.translate("sequence", "-", "") != "")
    used = kept.groupBy("msa_id").agg(F.count(F.lit(1)).alias("_used"))
    rest = unpaired.join(used, "msa_id", "left").withColumn("_used", F.coalesce("_used", F.lit(0)))
    rest = rest.filter((F.col("idx") < max_seqs - F.col("_used")) & ((F.col("_used") == 0) | (F.col("idx") > 0)))
    top = kept.select("msa_id", "idx", F.col("idx").cast("bigint").alias("key"), "sequence")
    low = rest.select(
        "msa_id", (F.col("idx") + F.col("_used")).alias("idx"), F.lit(-1).cast("bigint").alias("key"), "sequence"
    )
    return top.unionByName(low)
