"""Reactant library: role matching, name resolution, ordering, random products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.draws import pick
from sievegrid.operators.ordering import RangeOrdered
from sievegrid.session import durable, unnest


def fits(mask: Column, role: Column) -> Column:
    """All bits of the role are set in the mask."""
    return mask.bitwiseAND(role) == role


def reaction_roles(reactions: DataFrame) -> DataFrame:
    """(rxn_id, slot, role) with the third slot only where it is used."""
    slots = F.array(
        *[
            F.struct(F.lit(s).alias("slot"), F.col(c).cast("int").alias("role"))
            for s, c in (("A", "roleA"), ("B", "roleB"), ("C", "roleC"))
        ]
    )
    long = reactions.select("rxn_id", F.explode(slots).alias("x")).select("rxn_id", "x.*")
    return long.filter("role IS NOT NULL AND (slot <> 'C' OR role <> 0)")


def molecules_by_role(molecules: DataFrame, reactions: DataFrame) -> DataFrame:
    """(role, mol_id): molecules that can fill a role, as an equi-joinable table.

    The distinct roles are bit masks of a fixed width; they form one array
    and every molecule expands to the roles it fits, so there is no theta join.
    """
    roles = reaction_roles(reactions).agg(F.collect_set("role")).scalar()
    with_roles = molecules.select("mol_id", "role_mask", roles.alias("roles"))
    fitting = F.filter("roles", lambda r: fits(F.col("role_mask"), r))
    return unnest(with_roles, fitting, "role", "mol_id")


def resolve_products(products: DataFrame, reactions: DataFrame, molecules: DataFrame) -> DataFrame:
    """Join a parsed name (rxn, m1, m2, m3) to its reaction and reactants; all must exist."""
    side = lambda i: molecules.select(
        F.col("mol_id").alias(f"m{i}"), F.col("smiles").alias(f"smiles{i}"), F.col("role_mask").alias(f"mask{i}")
    )
    rx = reactions.select(F.col("rxn_id").alias("rxn"), "roleA", "roleB", "roleC")
    joined = products.join(rx, "rxn").join(side(1), "m1").join(side(2), "m2").join(side(3), "m3", "left")
    return joined.filter(F.col("m3").isNull() | F.col("mask3").isNotNull())


def order_reactants(df: DataFrame) -> DataFrame:
    """r1, r2, r3 in reaction order; null when the reactants do not fit.

    The given order is preferred. With three reactants the order is decided by
    any shared bit, although fitting asks for all bits.
    """
    a, b, c = F.col("roleA"), F.col("roleB"), F.col("roleC")
    m1, m2, m3 = F.col("mask1"), F.col("mask2"), F.col("mask3")
    straight = fits(m1, a) & fits(m2, b)
    swapped = fits(m1, b) & fits(m2, a)
    touches = (m1.bitwiseAND(a) != 0) & (m2.bitwiseAND(b) != 0)
    three = F.col("m3").isNotNull()
    fine = (straight | swapped) & (~three | fits(m3, F.coalesce(c, F.lit(0))))
    keep = F.when(three, touches).otherwise(straight)
    return df.withColumns(
        {
            "r1": F.when(fine, F.when(keep, F.col("smiles1")).otherwise(F.col("smiles2"))),
            "r2": F.when(fine, F.when(keep, F.col("smiles2")).otherwise(F.col("smiles1"))),
            "r3": F.when(fine, F.col("smiles3")),
        }
    )


def library_size(molecules: DataFrame, reactions: DataFrame) -> DataFrame:
    """Number of products of every reaction: counts per role multiplied, nothing enumerated."""
    counts = molecules_by_role(molecules, reactions).groupBy("role").agg(F.count(F.lit(1)).alias("_n"))
    per_slot = reaction_roles(reactions).join(counts, "role", "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    slot = lambda s: F.max(F.when(F.col("slot") == s, n))
    return per_slot.groupBy("rxn_id").agg(
        (slot("A") * slot("B") * F.coalesce(slot("C"), F.lit(1))).cast("bigint").alias("n_products")
    )


def random_products(molecules: DataFrame, reactions: DataFrame, n: int, seed: int) -> DataFrame:
    """n random product names: a random reaction, then a random fitting molecule per role.

    Molecules are numbered per role, so that a hashed position finds its
    molecule by an equi-join. A draw whose role nobody fills yields nothing.
    """
    spark = molecules.sparkSession
    placed = durable(
        RangeOrdered(molecules_by_role(molecules, reactions), ["role"], ["mol_id"]).row_number("_place")
    )
    sizes = placed.groupBy("role").agg(F.count(F.lit(1)).alias("_n"))
    numbered = RangeOrdered(reactions.select("rxn_id"), [], ["rxn_id"]).row_number("_r")
    total = reactions.agg(F.count(F.lit(1))).scalar()
    draws = spark.range(1, n + 1).withColumnRenamed("id", "draw")
    chosen = draws.select("draw", (1 + pick(f"{seed}x", total, F.col("draw"))).alias("_r")).join(numbered, "_r")
    slots = chosen.join(reaction_roles(reactions), "rxn_id").join(sizes, "role", "left")
    wanted = slots.withColumn("_place", 1 + pick(seed, F.col("_n"), F.col("draw"), F.col("slot")))
    filled = wanted.join(placed, ["role", "_place"], "left")
    slot = lambda s: F.max(F.when(F.col("slot") == s, F.col("mol_id")))
    named = filled.groupBy("draw", "rxn_id").agg(
        slot("A").alias("a"), slot("B").alias("b"), slot("C").alias("c"),
        F.count_if(F.col("mol_id").isNull()).alias("_missing"),
    )
    name = F.concat_ws(":", F.lit("rxn"), *[F.col(c).cast("string") for c in ("rxn_id", "a", "b", "c")])
    return named.filter("_missing = 0").select("draw", name.alias("name"))
