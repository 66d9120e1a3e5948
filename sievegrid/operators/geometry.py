"""Geometry over atom tables (structure_id, atom_idx, chain_id, x, y, z, ...).

Neighbours meet in grid cells as wide as the cutoff: one side is spread over
the 27 cells around it and joined on (structure, cell), with the distance test
inside the join. Nothing compares all atoms of a structure with each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.operators.components import connected_components
from sievegrid.operators.ordering import RangeOrdered
from sievegrid.session import durable

XYZ = ("x", "y", "z")
# Cutoffs in Angstrom.
INTERFACE_CUTOFF = 5.0
POCKET_TOKEN_CUTOFF = 15.0
CONTACT_CUTOFF = 8.0


def square_distance(a: str = "", b: str = "b_") -> Column:
    d = lambda c: F.col(f"{a}{c}") - F.col(f"{b}{c}")
    return d("x") * d("x") + d("y") * d("y") + d("z") * d("z")


def near(
    a: DataFrame,
    b: DataFrame,
    cutoff: float,
    by: Sequence[str] = ("structure_id",),
    condition: Column | None = None,
    how: str = "inner",
    inclusive: bool = True,
) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` within the cutoff, columns of ``b`` prefixed ``b_``.

    ``how`` may also be ``left_semi`` or ``left_anti``: then no pair leaves the join.
    """
    width = F.lit(float(cutoff))
    cell = lambda p, c: F.floor(F.col(f"{p}{c}") / width)
    around = lambda c: F.array(*[cell("b_", c) + i for i in (-1, 0, 1)])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    for c in XYZ:
        right = right.withColumn(f"_b{c}", F.explode(around(c)))
    left = a.withColumns({f"_a{c}": cell("", c) for c in XYZ})
    limit = float(cutoff) ** 2
    test = square_distance() <= limit if inclusive else square_distance() < limit
    for k in by:
        test = test & (F.col(k) == F.col(f"b_{k}"))
    for c in XYZ:
        test = test & (F.col(f"_a{c}") == F.col(f"_b{c}"))
    if condition is not None:
        test = test & condition
    joined = left.join(right, test, how)
    return joined.drop(*[f"_{s}{c}" for s in "ab" for c in XYZ])


def interfaces(atoms: DataFrame, cutoff: float = INTERFACE_CUTOFF) -> DataFrame:
    """Unordered chain pairs with any two present atoms within the cutoff."""
    other = F.col("chain_id") < F.col("b_chain_id")
    slim = atoms.select("structure_id", "chain_id", *XYZ)
    pairs = near(slim, slim, cutoff, condition=other)
    return pairs.select("structure_id", F.col("chain_id").alias("chain_1"), F.col("b_chain_id").alias("chain_2")).distinct()


def salt_bridges(atoms: DataFrame, low: float = 0.5, high: float = 5.5) -> DataFrame:
    """Pairs of opposite charges strictly between the limits, one side designed and the other
    outside the design chains; both directions summed."""
    slim = atoms.select("structure_id", "charge", "is_design", "is_chain_design", *XYZ)
    positive, negative = slim.filter("charge > 0"), slim.filter("charge < 0")
    pairs = near(positive, negative, high, inclusive=False).filter(square_distance() > low * low)
    forward = F.col("is_design") & ~F.col("b_is_chain_design")
    backward = ~F.col("is_chain_design") & F.col("b_is_design")
    counted = pairs.groupBy("structure_id").agg(
        (F.count_if(forward) + F.count_if(backward)).alias("salt_bridges")
    )
    every = atoms.select("structure_id").distinct()
    return every.join(counted, "structure_id", "left").withColumn(
        "salt_bridges", F.coalesce("salt_bridges", F.lit(0))
    )


def clash_fractions(atoms: DataFrame, dist: float = 1.7) -> DataFrame:
    """(structure, chain, other, num_atoms, num_clashes): atoms of a chain near another chain."""
    slim = atoms.select("structure_id", "chain_id", "atom_idx", *XYZ)
    sizes = slim.groupBy("structure_id", "chain_id").agg(F.count(F.lit(1)).alias("num_atoms"))
    other = F.col("chain_id") != F.col("b_chain_id")
    hits = near(slim, slim.drop("atom_idx"), dist, condition=other)
    touching = hits.select("structure_id", "chain_id", F.col("b_chain_id").alias("other"), "atom_idx").distinct()
    counted = touching.groupBy("structure_id", "chain_id", "other").agg(F.count(F.lit(1)).alias("num_clashes"))
    return counted.join(sizes, ["structure_id", "chain_id"])


def clashing_chains(atoms: DataFrame, dist: float = 1.7, freq: float = 0.3) -> DataFrame:
    """Chains to remove. Clashes are resolved one after another in pair order: of two chains
    that clash with each other the one with the larger share goes, then the one with fewer
    atoms, then the one with the larger id; a pair with a removed chain is skipped.

    Only clashing chain pairs reach the per-structure step, never atoms.
    """
    clashes = clash_fractions(atoms, dist).filter(F.col("num_clashes") / F.col("num_atoms") > freq)
    clashes = clashes.withColumns(
        {"lo": F.least("chain_id", "other"), "hi": F.greatest("chain_id", "other")}
    )

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["lo", "hi", "chain_id"])
        facts = {
            (r.chain_id, r.other): (r.num_clashes / r.num_atoms, -r.num_atoms, r.chain_id)
            for r in ordered.itertuples()
        }
        gone: set = set()
        for pair, mine in facts.items():
            if gone.isdisjoint(pair):
                theirs = facts.get(pair[::-1])
                gone.add(pair[0] if theirs is None else max(mine, theirs)[2])
        return pd.DataFrame({"structure_id": pdf["structure_id"].iloc[0], "chain_id": sorted(gone)})

    return clashes.groupBy("structure_id").applyInPandas(resolve, "structure_id long, chain_id long")


def met_by_radius(atoms: DataFrame, share: float) -> DataFrame:
    """Pairs of atoms of different chains that may be closer than ``share`` times the sum of their radii, each once.

    Radii are classed by powers of two. A grid per class is as wide as its atoms reach; the atoms of the
    class look around in it and meet those of their own and of smaller classes. So a large
    atom costs what lies around it, and leaves the cells of the others as they are. Atoms without a radius
    or with a radius of 0 or less meet nobody as the larger ones.
    """
    classed = atoms.withColumn("_class", F.when(F.col("radius") > 0, F.ceil(F.log2("radius"))))
    classes = classed.filter("_class IS NOT NULL").select("structure_id", F.col("_class").alias("_grid")).distinct()
    width = F.pow(F.lit(2.0), F.col("_grid")) * (2 * share)
    cell = lambda c: F.floor(F.col(c) / width)
    placed = classed.join(classes, "structure_id").filter("_class IS NULL OR _class <= _grid")
    placed = placed.withColumns({f"_cell_{c}": cell(c) for c in XYZ})
    right = placed.select(*[F.col(c).alias(f"b_{c}") for c in placed.columns])
    left = classed.filter("_class IS NOT NULL").withColumn("_grid", F.col("_class"))
    for c in XYZ:
        left = left.withColumn(f"_cell_{c}", F.explode(F.array(*[cell(c) + i for i in (-1, 0, 1)])))
    same = F.col("chain_id") != F.col("b_chain_id")
    for c in ("structure_id", "_grid", *[f"_cell_{c}" for c in XYZ]):
        same = same & (F.col(c) == F.col(f"b_{c}"))
    once = F.col("b__class").isNull() | (F.col("b__class") < F.col("_class")) | (F.col("chain_id") < F.col("b_chain_id"))
    met = left.join(right, same & once)
    return met.select(*atoms.columns, *[f"b_{c}" for c in atoms.columns])


def steric_clashes(atoms: DataFrame, bonded: DataFrame, buffer: float = 0.25) -> DataFrame:
    """Clashing chain pairs per bucket: any two atoms closer than (r1 + r2) * (1 - buffer).

    Single-atom chains and covalently linked pairs are left out. Chains of the
    same entity and size are symmetric; other pairs are keyed by their types in
    chain order. ``atoms``: + entity_id, type, radius; ``bonded``: structure, chain_1, chain_2.
    """
    chains = atoms.groupBy("structure_id", "chain_id").agg(
        F.count(F.lit(1)).alias("n"), F.first("entity_id").alias("entity_id"), F.first("type").alias("type")
    ).filter("n > 1")
    live = atoms.join(chains.select("structure_id", "chain_id", "n"), ["structure_id", "chain_id"])
    slim = live.select("structure_id", "chain_id", "entity_id", "type", "n", "radius", *XYZ)
    reach = (F.col("radius") + F.col("b_radius")) * (1.0 - buffer)
    hits = met_by_radius(slim, 1.0 - buffer).filter(square_distance() < reach * reach)
    first = F.col("chain_id") < F.col("b_chain_id")
    in_order = lambda c: (F.when(first, F.col(c)).otherwise(F.col(f"b_{c}")), F.when(first, F.col(f"b_{c}")).otherwise(F.col(c)))
    (chain_1, chain_2), (type_1, type_2) = in_order("chain_id"), in_order("type")
    pairs = hits.select(
        "structure_id",
        chain_1.alias("chain_1"),
        chain_2.alias("chain_2"),
        ((F.col("entity_id") == F.col("b_entity_id")) & (F.col("n") == F.col("b_n"))).alias("sym"),
        type_1.alias("type_1"),
        type_2.alias("type_2"),
    ).distinct()
    pairs = pairs.join(bonded.select("structure_id", "chain_1", "chain_2"), ["structure_id", "chain_1", "chain_2"], "left_anti")
    bucket = F.when(F.col("sym"), F.concat(F.lit("sym_"), "type_1")).otherwise(
        F.concat_ws("_", F.lit("asym"), "type_1", "type_2")
    )
    return pairs.groupBy("structure_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("num_clashes"))


def chain_pair_counts(chains: DataFrame, bonded: DataFrame) -> DataFrame:
    """Chain pairs per bucket of :func:`steric_clashes`, counted without listing them.

    ``chains``: structure_id, chain_id, entity_id, type, n (atoms). Running
    counts of the earlier chains per type give the ordered pairs, once over the
    structure and once over chains of the same entity and size.
    """
    live = chains.filter("n > 1")

    def earlier(by):
        kinds = live.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("type").alias("t1")).distinct()
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        grid = live.join(kinds, same).drop(*[f"_{c}" for c in by])  # a row per chain and kind of its group
        own = (F.col("type") == F.col("t1")).cast("int")
        counted = RangeOrdered(grid, [*by, "t1"], ["chain_id"]).running_sums({"_k": own})
        long = counted.select("structure_id", "t1", F.col("type").alias("t2"), (F.col("_k") - own).alias("k"))
        return long.groupBy("structure_id", "t1", "t2").agg(F.sum("k").alias("n"))

    asym = F.concat_ws("_", F.lit("asym"), "t1", "t2")
    everything = earlier(["structure_id"]).select("structure_id", asym.alias("bucket"), "n")
    same = earlier(["structure_id", "entity_id", "n"])
    symmetric = same.select("structure_id", F.concat(F.lit("sym_"), "t1").alias("bucket"), "n")
    off = same.select("structure_id", asym.alias("bucket"), (-F.col("n")).alias("n"))
    side = lambda i: live.select(
        "structure_id", F.col("chain_id").alias(f"chain_{i}"), F.col("type").alias(f"type_{i}"),
        F.col("entity_id").alias(f"e{i}"), F.col("n").alias(f"n{i}"),
    )
    linked = bonded.select("structure_id", "chain_1", "chain_2").distinct()
    linked = linked.join(side(1), ["structure_id", "chain_1"]).join(side(2), ["structure_id", "chain_2"])
    sym = (F.col("e1") == F.col("e2")) & (F.col("n1") == F.col("n2"))
    name = F.when(sym, F.concat(F.lit("sym_"), "type_1")).otherwise(F.concat_ws("_", F.lit("asym"), "type_1", "type_2"))
    less = linked.select("structure_id", name.alias("bucket"), F.lit(-1).cast("bigint").alias("n"))
    total = everything.unionByName(symmetric).unionByName(off).unionByName(less)
    return total.groupBy("structure_id", "bucket").agg(F.sum("n").alias("num_pairs")).filter("num_pairs > 0")


def consecutive_distance(residues: DataFrame, limit: float = 10.0) -> DataFrame:
    """(structure_id, chain_id, valid): no two neighbouring present residues further apart.

    ``residues``: structure_id, chain_id, res_idx, is_present, x, y, z. The next
    residue has the next index, so the step is an equi-join.
    """
    live = residues.filter("is_present").select("structure_id", "chain_id", "res_idx", *XYZ)
    following = live.select(
        "structure_id", "chain_id", (F.col("res_idx") - 1).alias("res_idx"), *[F.col(c).alias(f"b_{c}") for c in XYZ]
    )
    steps = live.join(following, ["structure_id", "chain_id", "res_idx"])
    broken = steps.filter(square_distance() > limit * limit).select("structure_id", "chain_id").distinct()
    chains = residues.select("structure_id", "chain_id").distinct()
    return chains.join(broken.withColumn("_b", F.lit(True)), ["structure_id", "chain_id"], "left").select(
        "structure_id", "chain_id", F.col("_b").isNull().alias("valid")
    )


def free_cysteines(sulfurs: DataFrame, limit: float = 4.0) -> DataFrame:
    """Sulfur atoms without another one within the limit, counted per structure."""
    slim = sulfurs.select("structure_id", "atom_idx", *XYZ)
    alone = near(slim, slim, limit, condition=F.col("atom_idx") != F.col("b_atom_idx"), how="left_anti")
    return alone.groupBy("structure_id").agg(F.count(F.lit(1)).alias("free_cysteines"))


def aligned_rmsd(pairs: DataFrame, by: str, weight: Column) -> DataFrame:
    """RMSD after the best rigid superposition of (x, y, z) on (px, py, pz).

    Weighted sums give centroids and the 3 x 3 covariance in one aggregate; the
    singular values of that matrix give the RMSD directly. NaN without weight.
    """
    w = weight.cast("double")
    sums = {"w": F.sum(w)}
    for c in XYZ:
        sums[f"s{c}"] = F.sum(w * F.col(c))
        sums[f"p{c}"] = F.sum(w * F.col(f"p{c}"))
        for d in XYZ:
            sums[f"{c}{d}"] = F.sum(w * F.col(c) * F.col(f"p{d}"))
    sums["ss"] = F.sum(w * sum((F.col(c) * F.col(c) for c in XYZ), F.lit(0.0)))
    sums["pp"] = F.sum(w * sum((F.col(f"p{c}") * F.col(f"p{c}") for c in XYZ), F.lit(0.0)))
    reduced = pairs.groupBy(by).agg(*[e.alias(n) for n, e in sums.items()])

    @F.pandas_udf("double")
    def rmsd(s: pd.DataFrame) -> pd.Series:
        total = s["w"].to_numpy()
        safe = np.where(total > 0, total, 1.0)
        a = s[[f"s{c}" for c in XYZ]].to_numpy() / safe[:, None]
        b = s[[f"p{c}" for c in XYZ]].to_numpy() / safe[:, None]
        cov = s[[f"{c}{d}" for c in XYZ for d in XYZ]].to_numpy().reshape(-1, 3, 3) / safe[:, None, None]
        cov = cov - a[:, :, None] * b[:, None, :]
        spread = (s["ss"] + s["pp"]).to_numpy() / safe - (a * a).sum(1) - (b * b).sum(1)
        u, sing, v = np.linalg.svd(np.nan_to_num(cov))
        sing[:, 2] *= np.sign(np.linalg.det(u) * np.linalg.det(v))
        value = np.sqrt(np.clip(spread - 2 * sing.sum(1), 0, None))
        return pd.Series(np.where(total > 0, value, np.nan))

    value = F.coalesce(rmsd(F.struct(*list(sums))), F.lit(float("nan")))
    return reduced.select(by, value.alias("rmsd"))


def lddt(atoms: DataFrame, cutoff: float = 15.0) -> DataFrame:
    """Per structure: mean share of true distances below the cutoff kept within .5, 1, 2 and 4."""
    slim = atoms.select("structure_id", "atom_idx", *XYZ, *[f"p{c}" for c in XYZ])
    pairs = near(slim, slim, cutoff, condition=F.col("atom_idx") != F.col("b_atom_idx"), inclusive=False)
    true = F.sqrt(square_distance())
    d = lambda c: F.col(f"p{c}") - F.col(f"b_p{c}")
    predicted = F.sqrt(d("x") * d("x") + d("y") * d("y") + d("z") * d("z"))
    off = F.abs(true - predicted)
    hits = sum(((off < t).cast("double") for t in (0.5, 1.0, 2.0, 4.0)), F.lit(0.0)) / 4
    return pairs.groupBy("structure_id").agg(F.avg(hits).alias("lddt"), F.count(F.lit(1)).alias("pairs"))


def site_adherence(site: DataFrame, design: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Share of site tokens whose nearest design token is closer than each threshold."""
    slim = site.select("structure_id", "atom_idx", *XYZ)
    pairs = near(slim, design.select("structure_id", *XYZ), max(thresholds), inclusive=False)
    closest = pairs.groupBy("structure_id", "atom_idx").agg(F.min(square_distance()).alias("_d2"))
    all_site = slim.select("structure_id", "atom_idx").join(closest, ["structure_id", "atom_idx"], "left")
    share = lambda t: F.avg(F.coalesce((F.col("_d2") < t * t).cast("double"), F.lit(0.0)))
    return all_site.groupBy("structure_id").agg(*[share(t).alias(f"under_{t}".replace(".", "_")) for t in thresholds])


def largest_patch(atoms: DataFrame, cutoff: float = 6.0) -> DataFrame:
    """Largest summed area of atoms connected by steps within the cutoff."""
    key = F.struct("structure_id", "atom_idx")
    slim = atoms.select("structure_id", "atom_idx", *XYZ)
    pairs = near(slim, slim, cutoff, condition=F.col("atom_idx") < F.col("b_atom_idx"))
    edges = pairs.select(key.alias("a"), F.struct(F.col("b_structure_id").alias("structure_id"), F.col("b_atom_idx").alias("atom_idx")).alias("b"))
    parts = connected_components(slim.select(key.alias("id")), edges)
    tagged = parts.select("id.structure_id", "id.atom_idx", "component")
    areas = atoms.select("structure_id", "atom_idx", "area").join(tagged, ["structure_id", "atom_idx"])
    summed = areas.groupBy("structure_id", "component").agg(F.sum("area").alias("_area"))
    return summed.groupBy("structure_id").agg(F.max("_area").alias("largest_patch"))


def at(atoms: DataFrame, constraints: DataFrame, index: str, prefix: str, coords: Sequence[str] = XYZ) -> DataFrame:
    """Attach the coordinates of the atom that a constraint column names."""
    side = atoms.select(
        "structure_id", F.col("atom_idx").alias(index), *[F.col(c).alias(f"{prefix}{d}") for c, d in zip(coords, XYZ)]
    )
    return constraints.join(side, ["structure_id", index])


def disulfide_quality(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Longest and shortest covalent sulfur-sulfur bond per structure."""
    placed = at(atoms, at(atoms, bonds, "atom_1", ""), "atom_2", "b_")
    d = F.sqrt(square_distance())
    return placed.groupBy("structure_id").agg(F.max(d).alias("max_length"), F.min(d).alias("min_length"))


def distance_geometry(
    atoms: DataFrame, bounds: DataFrame, bond_buffer: float = 0.25, angle_buffer: float = 0.25, clash_buffer: float = 0.2
) -> DataFrame:
    """Violated bond, angle and clash bounds, and totals, per structure.

    ``bounds``: structure_id, atom_1, atom_2, is_bond, is_angle, lower, upper.
    """
    d = F.sqrt(square_distance())
    placed = at(atoms, at(atoms, bounds, "atom_1", ""), "atom_2", "b_").withColumn("_d", d)
    outside = lambda buf: (F.col("_d") <= F.col("lower") * (1 - buf)) | (F.col("_d") >= F.col("upper") * (1 + buf))
    bond, angle = F.col("is_bond"), F.col("is_angle")
    apart = ~bond & ~angle
    return placed.groupBy("structure_id").agg(
        F.count_if(bond & outside(bond_buffer)).alias("num_bond_length_violations"),
        F.count_if(bond).alias("num_bonds"),
        F.count_if(angle & outside(angle_buffer)).alias("num_bond_angle_violations"),
        F.count_if(angle).alias("num_angles"),
        F.count_if(apart & (F.col("_d") <= F.col("lower") * (1 - clash_buffer))).alias("num_internal_clash_violations"),
        F.count_if(apart).alias("num_non_neighbors"),
    )


def _vector(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in XYZ]


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def with_torsion(atoms: DataFrame, quads: DataFrame, name: str = "torsion") -> DataFrame:
    """Torsion angle of atoms (atom_1..atom_4) in radians.

    The angle between the two plane normals, signed by the middle bond.
    """
    placed = quads
    for i in range(1, 5):
        placed = at(atoms, placed, f"atom_{i}", f"q{i}_")
    back, middle, ahead = _vector("q1_", "q2_"), _vector("q3_", "q2_"), _vector("q3_", "q4_")
    before, after = _cross(back, middle), _cross(middle, ahead)
    sign = F.signum(_dot(middle, _cross(before, after)))
    cosine = _dot(before, after) / F.sqrt(_dot(before, before) * _dot(after, after))
    clipped = F.least(F.greatest(cosine, F.lit(-1 + 1e-8)), F.lit(1 - 1e-8))
    keep = [c for c in placed.columns if not c.startswith("q")]
    return placed.select(*keep, (sign * F.acos(clipped)).alias(name))


def stereo_violations(atoms: DataFrame, chirals: DataFrame, bonds: DataFrame) -> DataFrame:
    """Chiral centres with the wrong sign of torsion, double bonds on the wrong side.

    ``chirals``/``bonds``: structure_id, atom_1..atom_4, is_reference, expected.
    """
    c = with_torsion(atoms, chirals.filter("is_reference")).withColumn("got", F.col("torsion") > 0)
    b = with_torsion(atoms, bonds.filter("is_reference")).withColumn("got", F.abs("torsion") > np.pi / 2)
    both = c.withColumn("kind", F.lit("chiral_atom")).unionByName(b.withColumn("kind", F.lit("stereo_bond")))
    wrong = F.col("got") != F.col("expected")
    per = lambda k, e: F.count_if((F.col("kind") == k) & e)
    return both.groupBy("structure_id").agg(
        per("chiral_atom", wrong).alias("num_chiral_atom_violations"),
        per("chiral_atom", F.lit(True)).alias("num_chiral_atoms"),
        per("stereo_bond", wrong).alias("num_stereo_bond_violations"),
        per("stereo_bond", F.lit(True)).alias("num_stereo_bonds"),
    )


def planarity(atoms: DataFrame, groups: DataFrame, buffer: float = 0.25) -> DataFrame:
    """Violations of flat groups per kind. ``groups``: structure_id, group_id, kind, atoms ARRAY.

    ``ring_5`` counts rings all of whose atoms are WITHIN the buffer, as the
    screening rules do; ``ring_6`` and ``double_bond`` count groups with an atom
    beyond it. A group has at most a handful of atoms.
    """
    flat = groups.select("structure_id", "group_id", "kind", F.explode("atoms").alias("atom_idx"))
    placed = flat.join(atoms.select("structure_id", "atom_idx", *XYZ), ["structure_id", "atom_idx"])
    gathered = placed.groupBy("structure_id", "kind", "group_id").agg(
        F.flatten(F.collect_list(F.array(*XYZ))).alias("xyz")
    )

    @F.pandas_udf("double")
    def worst(xyz: pd.Series) -> pd.Series:
        out = []
        for values in xyz:
            points = np.asarray(values).reshape(-1, 3)
            points = points - points.mean(axis=0)
            normal = np.linalg.svd(points)[2][-1]
            out.append(float(np.abs(points @ normal).max()))
        return pd.Series(out)

    measured = gathered.withColumn("_far", worst("xyz"))
    bad = F.when(F.col("kind") == "ring_5", F.col("_far") <= buffer).otherwise(F.col("_far") >= buffer)
    return measured.groupBy("structure_id", "kind").agg(
        F.count_if(bad).alias("num_violations"), F.count(F.lit(1)).alias("num_groups")
    )


def delta_area(atoms: DataFrame) -> DataFrame:
    """Unbound minus bound area of the target atoms, from per-atom areas."""
    target = F.col("is_target")
    unbound = F.sum(F.when(target, F.col("area_unbound")).otherwise(0.0))
    bound = F.sum(F.when(target, F.col("area_bound")).otherwise(0.0))
    return atoms.groupBy("structure_id").agg(
        (unbound - bound).alias("delta"), unbound.alias("unbound"), bound.alias("bound")
    )


class CellTree:
    """Points (structure_id, x, y, z) in cells of cells, 4 to an axis, with the boxes around their points.

    ``leaf`` points at most lie in a cell of the last level, unless ``deepest`` levels don't part them.
    A level holds occupied cells only.
    """

    def __init__(self, points: DataFrame, leaf: int = 64, deepest: int = 12):
        box = points.groupBy("structure_id").agg(
            *[F.min(c).alias(f"_lo_{c}") for c in XYZ], *[F.max(c).alias(f"_hi_{c}") for c in XYZ]
        )
        split = float(4**deepest)
        share = lambda c: F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
        place = lambda c: F.least(F.floor(F.coalesce(F.nanvl(share(c), F.lit(0.0)), F.lit(0.0)) * split), F.lit(4**deepest - 1))
        placed = points.join(box, "structure_id").select("structure_id", *XYZ, *[place(c).cast("long").alias(f"_{c}") for c in XYZ])
        self.points, self.deepest = durable(placed), deepest
        self.levels = 0
        while self.levels < deepest:
            crowd = self.points.groupBy("structure_id", *self.cell(self.levels)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
            if (crowd or 0) <= leaf:
                break
            self.levels += 1

    def cell(self, level: int) -> list[Column]:
        return [F.shiftright(F.col(f"_{c}"), 2 * (self.deepest - level)).alias(f"_c{c}") for c in XYZ]

    def boxes(self, level: int) -> DataFrame:
        """(structure_id, parent cell, cell, box) of the occupied cells of a level."""
        cells = self.points.groupBy("structure_id", *self.cell(level)).agg(
            *[F.min(c).alias(f"_lo_{c}") for c in XYZ], *[F.max(c).alias(f"_hi_{c}") for c in XYZ]
        )
        return cells.withColumns({f"_p{c}": F.shiftright(f"_c{c}", 2) for c in XYZ})


def nearest_distance(
    a: DataFrame, b: DataFrame, leaf: int = 64, noise: Column | None = None
) -> DataFrame:
    """(structure_id, atom_idx, distance) of the nearest row of ``b``; infinite without one.

    Rows go down a tree of cells from the whole structure: a cell is left out once another holds a
    point that is nearer than its box, and only the last cells give out their points. So what
    is compared is bounded by the cells near the answer, near or far. A row of ``a`` with a null or
    non-finite coordinate counts as unresolved, its distance is infinite; such rows of ``b`` count as missing.
    """
    finite = lambda df: df.filter(" AND ".join(f"{c} IS NOT NULL AND abs({c}) < double('Infinity')" for c in XYZ))
    slim = a.select("structure_id", "atom_idx", *[F.col(c).cast("double").alias(c) for c in XYZ])
    tree = CellTree(finite(b.select("structure_id", *[F.col(c).cast("double").alias(c) for c in XYZ])).distinct(), leaf)
    left = finite(slim).distinct().withColumns({**{f"_c{c}": F.lit(0).cast("long") for c in XYZ}, "_best": F.lit(float("inf"))})
    row = ["structure_id", "atom_idx", *XYZ]
    for level in range(1, tree.levels + 1):
        above = left.select(*row, "_best", *[F.col(f"_c{c}").alias(f"_p{c}") for c in XYZ])
        met = above.join(tree.boxes(level), ["structure_id", *[f"_p{c}" for c in XYZ]])
        least = lambda c: F.greatest(F.col(f"_lo_{c}") - F.col(c), F.col(c) - F.col(f"_hi_{c}"), F.lit(0.0))
        most = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"_lo_{c}")), F.abs(F.col(c) - F.col(f"_hi_{c}")))
        total = lambda f: f("x") * f("x") + f("y") * f("y") + f("z") * f("z")
        bounded = met.withColumns({"_least": total(least), "_most": total(most)})
        reach = F.least(F.col("_best"), F.min("_most").over(Window.partitionBy(*row)))
        left = bounded.withColumn("_best", reach).filter("_least <= _best").select(*row, "_best", *[f"_c{c}" for c in XYZ])
        if level % 3 == 0:
            left = durable(left)
    points = tree.points.select("structure_id", *[F.col(c).alias(f"b_{c}") for c in XYZ], *tree.cell(tree.levels))
    met = left.join(points, ["structure_id", *[f"_c{c}" for c in XYZ]])
    found = met.groupBy(*row).agg(F.sqrt(F.min(square_distance())).alias("distance"))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in row], "distance")
    same = F.lit(True)
    for c in row:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = slim.join(found, same, "left").select(
        "structure_id", "atom_idx", F.coalesce("distance", F.lit(float("inf"))).alias("distance")
    )
    if noise is not None:
        out = out.withColumn("distance", F.col("distance") + noise)
    return out


def pocket_tokens(tokens: DataFrame, atoms: DataFrame, binder: Column, cutoff: float) -> DataFrame:
    """Polymer, resolved tokens of other chains with an atom strictly within the cutoff of the binder.

    ``atoms``: structure_id, token_idx, chain_id, x, y, z (present atoms only).
    """
    live = tokens.filter("is_polymer AND resolved").select("structure_id", "token_idx")
    mine = atoms.filter(~binder).join(live, ["structure_id", "token_idx"], "left_semi")
    theirs = atoms.filter(binder).select("structure_id", *XYZ)
    hits = near(mine.select("structure_id", "token_idx", *XYZ), theirs, cutoff, how="left_semi", inclusive=False)
    return hits.select("structure_id", "token_idx").distinct()


def contact_pairs(constraints: DataFrame, tokens: DataFrame) -> DataFrame:
    """Atom pairs of contact constraints with their threshold and group.

    ``constraints``: structure_id, group_id, token_1, token_2, threshold;
    ``tokens``: structure_id, token_idx, atom_idx, atom_num. A token has few
    atoms, so the pairs of a constraint are few.
    """
    side = lambda i: tokens.select(
        "structure_id",
        F.col("token_idx").alias(f"token_{i}"),
        F.sequence(F.col("atom_idx"), F.col("atom_idx") + F.col("atom_num") - 1).alias(f"_a{i}"),
    )
    joined = constraints.join(side(1), ["structure_id", "token_1"]).join(side(2), ["structure_id", "token_2"])
    first = joined.withColumn("atom_1", F.explode("_a1"))
    return first.withColumn("atom_2", F.explode("_a2")).select(
        "structure_id", "group_id", "atom_1", "atom_2", "threshold"
    )


# confidence rollups -------------------------------------------------------------------


def pae_rollup(pairs: DataFrame) -> DataFrame:
    """Means and minima of predicted errors over token pairs with roles attached.

    ``pairs``: structure_id, pae, pde, p_contact, chain_1/2, design_1/2, chain_design_1/2.
    """
    d1, d2, c1, c2 = (F.col(c) for c in ("design_1", "design_2", "chain_design_1", "chain_design_2"))
    chain_pair = (c1 & ~c2) | (~c1 & c2)
    design_pair = (d1 & ~c2) | (~c1 & d2)
    inter = F.col("chain_1") != F.col("chain_2")
    mean = lambda m: F.sum(F.when(m, F.col("pae")).otherwise(0.0)) / (F.count_if(m) + 1e-5)
    weight = F.col("p_contact")
    weighted = F.sum(F.when(inter, F.col("pde") * weight).otherwise(0.0)) / (F.sum(F.when(inter, weight).otherwise(0.0)) + 1e-5)
    return pairs.groupBy("structure_id").agg(
        mean(chain_pair).alias("chain_interaction_pae"),
        F.min(F.when(chain_pair, F.col("pae"))).alias("min_interaction_pae"),
        mean(design_pair).alias("interaction_pae"),
        F.min(F.when(design_pair, F.col("pae"))).alias("min_design_to_target_pae"),
        (F.sum(F.col("pde") * weight) / F.sum(weight)).alias("complex_pde"),
        weighted.alias("complex_ipde"),
    )


def plddt_rollup(tokens: DataFrame, weights: tuple[float, float, float] = (20.0, 10.0, 1.0)) -> DataFrame:
    """Plain and interface-weighted mean confidence.

    Weights: ligand, polymer within 8 A of another chain, other.
    """
    slim = tokens.select("structure_id", "atom_idx", "chain_id", "is_ligand", "plddt", *XYZ)
    other = slim.select("structure_id", "chain_id", *XYZ)
    touching = near(
        slim.filter(~F.col("is_ligand")), other, CONTACT_CUTOFF,
        condition=F.col("chain_id") != F.col("b_chain_id"), how="left_semi", inclusive=False,
    ).select("structure_id", "atom_idx", F.lit(True).alias("_touch"))
    joined = slim.join(touching, ["structure_id", "atom_idx"], "left")
    w = F.when(F.col("is_ligand"), weights[0]).when(F.col("_touch"), weights[1]).otherwise(weights[2])
    return joined.groupBy("structure_id").agg(
        F.avg("plddt").alias("complex_plddt"), (F.sum(F.col("plddt") * w) / F.sum(w)).alias("complex_iplddt")
    )


def ptm_rollup(pairs: DataFrame, masks: Mapping[str, Column], value: str = "tm") -> DataFrame:
    """Per mask: the best row mean of the expected TM value over the row's masked pairs."""
    cell = F.col(value)
    rows = pairs.groupBy("structure_id", "i").agg(
        *[(F.sum(F.when(m, cell).otherwise(0.0)) / (F.count_if(m) + 1e-5)).alias(n) for n, m in masks.items()]
    )
    return rows.groupBy("structure_id").agg(*[F.max(n).alias(n) for n in masks])


def chain_pair_ptm(pairs: DataFrame, value: str = "tm") -> DataFrame:
    """Best row mean for each ordered pair of chains."""
    rows = pairs.groupBy("structure_id", "chain_1", "chain_2", "i").agg(
        (F.sum(value) / (F.count(F.lit(1)) + 1e-5)).alias("_m")
    )
    return rows.groupBy("structure_id", "chain_1", "chain_2").agg(F.max("_m").alias("ptm"))


def tm_weight(error: Column, residues: Column) -> Column:
    d0 = 1.24 * F.pow(F.greatest(residues, F.lit(19)) - 15, F.lit(1.0 / 3)) - 1.8
    return 1 / (1 + (error / d0) * (error / d0))
