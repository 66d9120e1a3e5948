"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.session import durable, release


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id reachable.

    ``nodes`` has ``id``, ``edges`` has ``a`` and ``b``. Every round takes the
    smallest label among the neighbours (a partial aggregate, so a hub costs
    one row per task) and then the label of the label, which halves long
    chains. Labels are checkpointed; an edge is dropped once both its ends carry
    the same label and can no longer change anything by itself.
    """
    a, b = F.col("a"), F.col("b")
    ways = F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))
    links = durable(edges.filter("a <> b").select(F.explode(ways).alias("e")).select("e.*").distinct())
    labels = durable(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = links.join(labels.select(F.col("id").alias("b"), "component"), "b")
        best = near.groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_near"))
        # hooking the old label as well lets whole trees move at once
        hooks = (
            best.join(labels, "id")
            .groupBy(F.col("component").alias("id"))
            .agg(F.min("_near").alias("_hook"))
        )
        moved = labels.join(best, "id", "left").join(hooks, "id", "left")
        moved = moved.select(
            "id",
            F.col("component").alias("_old"),
            F.least("component", F.coalesce("_near", "component"), F.coalesce("_hook", "component")).alias("_new"),
        )
        moved = durable(moved)
        jump = moved.select(F.col("id").alias("_new"), F.col("_new").alias("_jump"))
        stepped = moved.join(jump, "_new", "left").select(
            "id", "_old", F.least("_new", F.coalesce("_jump", "_new")).alias("component")
        )
        stepped = durable(stepped)
        if stepped.filter("component <> _old").isEmpty():
            return stepped.select("id", "component")
        labels = stepped.select("id", "component")


def greedy_cover(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, representative): the clusters of a greedy run over the nodes by priority, in parallel rounds.

    ``nodes`` has ``id`` and ``priority`` (any orderable value; ties go to the larger id), ``edges`` has ``a``
    and ``b``. One after the other, the first node left becomes a representative and takes its neighbours out.
    A node that beats all its neighbours left is next to none that comes before it, so every round takes
    all of these at once; a node belongs to the first of its neighbours that are representatives. The
    result is that of the run one by one.

    An edge is kept once, from the end that comes first to the other. So a node has won when no edge left leads to it,
    and nodes without edges take no part in the rounds.
    """
    spark = nodes.sparkSession
    ranked = durable(nodes.select("id", "priority"))
    p = F.struct("priority", "id")
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    pairs = edges.filter("a <> b").select(a, b).distinct()
    pairs = pairs.join(ranked.select(F.col("id").alias("a"), p.alias("a_p")), "a").join(ranked.select(F.col("id").alias("b"), p.alias("b_p")), "b")
    ahead = F.col("a_p") > F.col("b_p")
    links = durable(pairs.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("then")))
    live, gone = links, ranked.select("id").limit(0)
    while not live.isEmpty():
        beaten = live.select(F.col("then").alias("first")).distinct()
        taken = durable(live.join(beaten, "first", "left_anti").select(F.col("then").alias("id")).distinct())
        gone = gone.unionByName(taken)
        live = live.join(taken.select(F.col("id").alias("then")), "then", "left_anti")
        live = durable(live.join(taken.select(F.col("id").alias("first")), "first", "left_anti").select("first", "then"))
        release(spark)
    near = links.join(gone.select(F.col("id").alias("first")), "first", "left_anti")
    near = near.join(ranked.select(F.col("id").alias("first"), p.alias("p")), "first")
    near = near.groupBy(F.col("then").alias("id")).agg(F.max_by("first", "p").alias("representative"))
    own = ranked.join(gone, "id", "left_anti").select("id", F.col("id").alias("representative"))
    return own.unionByName(near)
