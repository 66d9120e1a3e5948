"""One epoch from commitments to ranks: intake, gates, archive, metric ranks, tie-breaks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.functions import scoring as C
from sievegrid.operators import gates as G
from sievegrid.operators import ranking as R
from sievegrid.operators.ordering import keep_one
from sievegrid.session import unnest


def in_window(commits: DataFrame, length: int = C.EPOCH_BLOCKS, cutoff: int = C.CUTOFF_BLOCKS) -> DataFrame:
    """Commits with their epoch, strictly after its first block and before the cut-off."""
    epoch = F.floor(F.col("block") / length).cast("bigint")
    start = epoch * length
    fine = (F.col("block") > start) & (F.col("block") < start + length - cutoff)
    return commits.withColumn("epoch", epoch).filter(fine)


def latest_commits(commits: DataFrame) -> DataFrame:
    """The last commit of each uid in each epoch; a partial aggregate."""
    return keep_one(commits, ["epoch", "uid"], [F.col("block"), F.col("commit_id")], last=True)


def rank_epochs(
    commits: DataFrame,
    submissions: DataFrame,
    archive: DataFrame | None,
    metrics: DataFrame,
    modes: Mapping[str, str],
    categories: Mapping[str, Sequence[str]],
    count: int,
    **limits,
) -> DataFrame:
    """(epoch, uid, block, final_score, rank).

    ``submissions``: (uid, items); ``archive``: (seq); ``metrics``: (uid, item, target, metrics...).
    """
    # 1. gate every submission once, whatever the number of epochs that use it
    flagged = G.nanobody_gate(submissions, count, **limits)
    # a plain filter would move the gate below the shuffle that spreads the texts over the cores
    passing = F.when(F.col("first_failed_rule").isNull(), F.array("items"))
    gated = unnest(flagged, passing, "items", "uid")
    if archive is not None:
        flat = gated.select("uid", F.explode("items").alias("seq"))
        known = flat.join(archive.select("seq").distinct(), "seq", "left_semi").select("uid").distinct()
        gated = gated.join(known, "uid", "left_anti")
    latest = latest_commits(in_window(commits)).select("epoch", "uid", "block")
    entries = latest.join(gated.select("uid"), "uid", "left_semi")
    # 2. rank metrics over the (item x target) frame of each epoch
    frame = entries.join(metrics.filter(F.col("item") < count), "uid")
    ids = ["uid", "block", "item", "target"]
    ranked = R.rank_sum(frame, ids, modes, by=["epoch"], categories=categories)
    # 3. item means over targets, sum over items, category totals for ties
    scored = R.final_score(
        ranked.withColumn("_s", F.col("rank_sum").cast("double")),
        ["epoch", "uid", "block"],
        "item",
        "_s",
        "min",
        count,
        {f"{c}_rank_sum": f"{c}_total" for c in categories},
    )
    scored = scored.withColumn("push_time", F.lit(None).cast("timestamp"))
    ranks = R.rank_uids(
        scored, "final_score", "min", ["epoch"], [f"{c}_total" for c in categories]
    )
    return ranks.select("epoch", "uid", "block", "final_score", "rank")


