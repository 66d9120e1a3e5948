"""Diverse selection and token crops."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegrid.functions.alignment import identity_with
from sievegrid.functions.draws import uniform
from sievegrid.operators.geometry import XYZ, near, square_distance
from sievegrid.operators.ordering import RangeOrdered
from sievegrid.session import durable, rebalance


def diverse_select(
    df: DataFrame,
    key: str,
    seq: str,
    quality: str,
    k: int,
    alpha: float,
    buckets: Sequence[tuple[int, int, int]] = (),
    similarity_to: Callable[[str], Callable[[str], float]] = identity_with,
    pool: int = 512,
) -> DataFrame:
    """Greedy selection of k rows by (1 - alpha) * quality + alpha * (1 - similarity to the selected).

    A gain can only fall as more rows are selected, so a gain against some of them, at first against
    none, is an upper bound. The ``pool`` rows with the best bounds come to the driver, which compares
    the best of them with the selected one by one: a row that stays the best is picked, while it beats
    the bound of every row left outside. Otherwise the rows with a bound near the best gain, and only
    these, are compared in the cluster, and a new pool is taken. Nothing is dropped: the pool size
    changes the speed, not the result. ``buckets``: (min, max, count) of sequence lengths, max exclusive.
    ``similarity_to(reference)`` gives the similarity of a sequence to it, at least -1.
    """
    spark = df.sparkSession
    rows = durable(rebalance(df.select(key, seq, quality)))
    if rows.limit(k + 1).count() <= k:
        return rows.select(key, F.lit(None).cast("int").alias("pick_order"))
    least = 0.0 if similarity_to is identity_with else -1.0
    first = rows.orderBy(F.desc(quality), key).first()
    chosen, taken, filled = [first], {first[key]}, [0] * len(buckets)
    similar = [similarity_to(first[seq])]
    bound = (1 - alpha) * F.col(quality) + alpha * (1 - F.col("_sim"))
    # as read: compared with none; those with a first bound from ``low`` on are in ``near``, compared
    rows = rows.withColumns({"_sim": F.lit(least), "_seen": F.lit(0)})
    near, low = None, None

    def bucket_of(text: str) -> int | None:
        found = [i for i, (low, high, _) in enumerate(buckets) if low <= len(text) < high]
        return found[-1] if found else None

    def still_open(frame: DataFrame) -> DataFrame:
        kept = frame.filter(~F.col(key).isin([r[key] for r in chosen]))
        full = [i for i, (b, n) in enumerate(zip(buckets, filled)) if n >= b[2]]
        if full:
            place = F.lit(None).cast("int")
            for i, (low, high, _) in enumerate(buckets):  # a row counts in the last bucket that holds it
                place = F.when(F.length(seq).between(low, high - 1), i).otherwise(place)
            kept = kept.filter(~F.coalesce(place.isin(full), F.lit(False)))
        return kept

    def latest(down_to: float | None = None) -> DataFrame:
        """Rows with their last bounds; of those compared with none, only from ``down_to`` on."""
        rest = rows if near is None else rows.filter(~F.coalesce(bound >= low, F.lit(False)))
        if down_to is not None:
            rest = rest.filter(bound >= down_to)
        return still_open(rest if near is None else near.unionByName(rest))

    def compared(down_to: float) -> DataFrame:
        texts = [r[seq] for r in chosen]

        @F.pandas_udf(T.DoubleType())
        def closest(s: pd.Series, seen: pd.Series) -> pd.Series:
            known = int(seen.min())
            to = [similarity_to(t) for t in texts[known:]]
            return pd.Series([max((f(x) for f in to[i - known :]), default=-1.0) for x, i in zip(s, seen)], dtype="float64")

        spread = rebalance(latest(down_to).withColumn("_due", bound >= down_to))
        due = spread.filter("_due").withColumns({"_sim": F.greatest("_sim", closest(seq, "_seen")), "_seen": F.lit(len(texts))})
        return durable(due.unionByName(spread.filter("NOT coalesce(_due, false)")).drop("_due"))

    reach = alpha / 64
    while len(chosen) < k:
        head = latest().withColumn("_gain", bound).orderBy(F.desc("_gain"), key).limit(pool + 1).collect()
        if not head:
            break
        outside = (-head[pool]["_gain"], head[pool][key]) if len(head) > pool else None
        live = [(-r["_gain"], r[key], i, r["_sim"], r["_seen"]) for i, r in enumerate(head[:pool])]
        heapq.heapify(live)
        while live and len(chosen) < k:
            gain, name, i, sim, seen = live[0]
            row = head[i]
            if outside is not None and (gain, name) > outside:
                break  # a row outside may be better now
            place = bucket_of(row[seq])
            if name in taken or (place is not None and filled[place] >= buckets[place][2]):
                heapq.heappop(live)
            elif seen < len(chosen):
                sim = max(sim, similar[seen](row[seq]))
                heapq.heapreplace(live, (-((1 - alpha) * row[quality] + alpha * (1 - sim)), name, i, sim, seen + 1))
            else:
                heapq.heappop(live)
                if place is not None:
                    filled[place] += 1
                chosen.append(row)
                taken.add(name)
                similar.append(similarity_to(row[seq]))
        if live and len(chosen) < k:
            down_to = -live[0][0] - reach
            near, low = compared(down_to), down_to if low is None else min(low, down_to)
            reach *= 2
    names = [(r[key], i) for i, r in enumerate(chosen)]  # k rows
    kind = df.schema[key].dataType.simpleString()
    return spark.createDataFrame(names, f"{key} {kind}, pick_order int")


def pick_token(tokens: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """One token per structure: of the wanted chain, of any chain when that has none.

    ``wanted``: structure_id, chain_id. The smallest hash wins, a partial aggregate.
    """
    u = uniform(seed, F.col("structure_id"), F.col("token_idx"))
    joined = tokens.join(wanted.withColumnRenamed("chain_id", "_want"), "structure_id")
    outside = F.when(F.col("chain_id") == F.col("_want"), 0).otherwise(1)
    return joined.groupBy("structure_id").agg(
        F.min_by("token_idx", F.struct(outside, u, F.col("token_idx"))).alias("token_idx")
    )


def pick_interface_token(tokens: DataFrame, interface: DataFrame, seed: int, cutoff: float = 15.0, widen: float = 5.0) -> DataFrame:
    """One token per structure out of the two chains of an interface.

    Tokens closer than the cutoff to the other chain are preferred, then those
    within the wider cutoff, then the tokens of either chain, then any.
    """
    u = uniform(seed, F.col("structure_id"), F.col("token_idx"))
    both = tokens.join(interface, "structure_id")
    slim = both.select("structure_id", "token_idx", "chain_id", "chain_1", "chain_2", *XYZ)
    of_pair = slim.filter(F.col("chain_id").isin(F.col("chain_1"), F.col("chain_2")))
    pairs = near(
        of_pair, of_pair.select("structure_id", "chain_id", *XYZ), cutoff + widen,
        condition=F.col("chain_id") != F.col("b_chain_id"), inclusive=False,
    )
    closest = pairs.groupBy("structure_id", "token_idx").agg(F.min(square_distance()).alias("_d2"))
    ranked = slim.join(closest, ["structure_id", "token_idx"], "left")
    tier = (
        F.when(F.col("_d2") < cutoff**2, 0)
        .when(F.col("_d2").isNotNull(), 1)
        .when(F.col("chain_id").isin(F.col("chain_1"), F.col("chain_2")), 2)
        .otherwise(3)
    )
    return ranked.groupBy("structure_id").agg(
        F.min_by("token_idx", F.struct(tier, u, F.col("token_idx"))).alias("token_idx")
    )


def _neighbourhoods(tokens: DataFrame, size: int) -> DataFrame:
    """(structure_id, token_idx, member): the whole chain when it is short, else the
    narrowest span of residues around the token that holds ``size`` tokens.

    Members lie at most ``size`` residues away, so they meet in bins of that width.
    """
    keys = ["structure_id", "chain_id"]
    counts = tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sized = tokens.select(*keys, "token_idx", "res_idx").join(counts, keys)
    short = sized.filter(F.col("_n") <= size)
    whole = short.select(*keys, "token_idx").join(
        short.select(*keys, F.col("token_idx").alias("member")), keys
    )
    width = max(size, 1)
    long = sized.filter(F.col("_n") > size).withColumn("_bin", F.floor(F.col("res_idx") / width))
    spread = long.select(
        *keys, F.col("token_idx").alias("member"), F.col("res_idx").alias("_r"),
        F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)).alias("_bin"),
    )
    away = F.abs(F.col("res_idx") - F.col("_r"))
    close = long.join(spread, [*keys, "_bin"]).withColumn("_away", away).filter(F.col("_away") <= size)
    # a token has a few dozen close ones: gathered per token, not per chain
    gathered = close.groupBy(*keys, "token_idx").agg(
        F.array_sort(F.collect_list(F.struct("_away", "member"))).alias("_near")
    )
    last = F.get("_near", F.least(F.lit(max(size, 1)), F.size("_near")) - 1)["_away"]
    kept = gathered.withColumn("_w", last).withColumn("_m", F.explode("_near")).filter(F.col("_m._away") <= F.col("_w"))
    return whole.select("structure_id", "token_idx", "member").unionByName(
        kept.select("structure_id", "token_idx", F.col("_m.member").alias("member"))
    )


def crop(
    tokens: DataFrame,
    distance: str,
    neighborhood: int,
    max_tokens: int,
    max_atoms: int | None = None,
    max_protein: int | None = None,
) -> DataFrame:
    """Tokens kept by distance, each with its neighbourhood, up to the first overflow.

    ``tokens``: structure_id, token_idx, chain_id, res_idx, atom_num, resolved,
    is_ligand and the distance column. A token enters at the smallest rank of
    those whose neighbourhood holds it; running totals over ranks give the
    first rank that would break a limit, and all that entered before it stay.
    """
    live = tokens.filter("resolved")
    ranked = RangeOrdered(live.select("structure_id", "token_idx", distance), ["structure_id"], [distance, "token_idx"]).row_number("_rank")
    around = _neighbourhoods(tokens, neighborhood)
    entered = (
        around.join(ranked.select("structure_id", "token_idx", "_rank"), ["structure_id", "token_idx"])
        .groupBy("structure_id", F.col("member").alias("token_idx"))
        .agg(F.min("_rank").alias("_rank"))
    )
    facts = entered.join(tokens.select("structure_id", "token_idx", "atom_num", "is_ligand"), ["structure_id", "token_idx"])
    per_rank = facts.groupBy("structure_id", "_rank").agg(
        F.count(F.lit(1)).alias("_t"), F.sum("atom_num").alias("_a"), F.count_if(~F.col("is_ligand")).alias("_p")
    )
    totals = RangeOrdered(per_rank, ["structure_id"], ["_rank"]).running_sums(
        {"_tokens": F.col("_t"), "_atoms": F.col("_a"), "_proteins": F.col("_p")}
    )
    over: Column = F.col("_tokens") > max_tokens
    if max_atoms is not None:
        over = over | (F.col("_atoms") > max_atoms)
    if max_protein is not None:
        over = over | (F.col("_proteins") > max_protein)
    stop = totals.filter(over).groupBy("structure_id").agg(F.min("_rank").alias("_stop"))
    kept = entered.join(stop, "structure_id", "left").filter(F.col("_stop").isNull() | (F.col("_rank") < F.col("_stop")))
    return tokens.join(kept.select("structure_id", "token_idx"), ["structure_id", "token_idx"], "left_semi")


def distance_to_token(tokens: DataFrame, query: DataFrame) -> DataFrame:
    """Tokens with the distance to the query token of their structure."""
    place = tokens.select("structure_id", "token_idx", *[F.col(c).alias(f"b_{c}") for c in XYZ])
    centre = query.join(place, ["structure_id", "token_idx"]).drop("token_idx")
    return tokens.join(centre, "structure_id").withColumn("distance", F.sqrt(square_distance())).drop(*[f"b_{c}" for c in XYZ])


def distance_to_ligand(tokens: DataFrame) -> DataFrame:
    """Tokens with the distance to the nearest ligand token of their structure."""
    from sievegrid.operators.geometry import nearest_distance

    placed = tokens.withColumn("atom_idx", F.col("token_idx"))
    nearest = nearest_distance(placed, placed.filter("is_ligand"))
    return tokens.join(nearest.withColumnRenamed("atom_idx", "token_idx"), ["structure_id", "token_idx"])


def keep_bonds(bonds: DataFrame, tokens: DataFrame) -> DataFrame:
    """Token bonds with both ends among the tokens."""
    ends = tokens.select("structure_id", "token_idx")
    for end in ("token_1", "token_2"):
        bonds = bonds.join(ends.withColumnRenamed("token_idx", end), ["structure_id", end], "left_semi")
    return bonds
