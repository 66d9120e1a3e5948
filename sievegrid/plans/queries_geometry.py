"""Queries over atom tables: neighbours, clashes, quality and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegrid.operators import gates as P
from sievegrid.operators import geometry as G
from sievegrid.plans import fixtures as X
from sievegrid.plans.registry import query

ATOMS = X.with_sql(X.SQL_ATOMS)
_D2 = "((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"
_PAIR = "FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id"


@query(
    "j18_interfaces",
    ATOMS
    + f"SELECT DISTINCT a.structure_id, a.chain_id AS chain_1, b.chain_id AS chain_2 {_PAIR} AND a.chain_id < b.chain_id AND {_D2} <= 25.0",
)
def j18(spark, sf):
    return G.interfaces(X.atoms(spark, sf))


@query(
    "j19_salt_bridges",
    ATOMS
    + f""", p AS (SELECT a.structure_id, count(*) FILTER (a.flag AND a.chain_id < 2 AND b.chain_id >= 2)
        + count(*) FILTER (a.chain_id >= 2 AND b.flag AND b.chain_id < 2) AS n {_PAIR}
        AND a.charge > 0 AND b.charge < 0 AND {_D2} < 30.25 AND {_D2} > 0.25 GROUP BY a.structure_id)
    SELECT structure_id, coalesce(n, 0) AS salt_bridges FROM (SELECT DISTINCT structure_id FROM atoms) LEFT JOIN p USING (structure_id)""",
)
def j19(spark, sf):
    chain_design = F.col("chain_id") < 2
    roles = {"is_design": F.col("flag") & chain_design, "is_chain_design": chain_design}
    return G.salt_bridges(X.atoms(spark, sf).withColumns(roles))


_CLASH_SQL = (
    ATOMS
    + f""", t AS (SELECT DISTINCT a.structure_id, a.chain_id, b.chain_id AS other, a.atom_idx {_PAIR}
      AND a.chain_id <> b.chain_id AND {_D2} <= 2.0 * 2.0),
    n AS (SELECT structure_id, chain_id, count(*) AS num_atoms FROM atoms GROUP BY ALL),
    c AS (SELECT structure_id, chain_id, other, count(*) AS num_clashes FROM t GROUP BY ALL)
    """
)


@query(
    "j20_clash_fractions",
    _CLASH_SQL + "SELECT structure_id, chain_id, other, num_clashes, num_atoms FROM c JOIN n USING (structure_id, chain_id)",
)
def j20(spark, sf):
    out = G.clash_fractions(X.atoms(spark, sf), 2.0)
    return out.select("structure_id", "chain_id", "other", "num_clashes", "num_atoms")


@query("j20_clashing_chains")
def j20_removed(spark, sf):
    return G.clashing_chains(X.atoms(spark, sf), 2.0, 0.05)


_STERIC_SQL = """t AS (SELECT *, chain_id % 2 AS entity_id, CASE WHEN chain_id < 3 THEN 'protein' ELSE 'ligand' END AS type,
      CASE element WHEN 'C' THEN 1.7 ELSE 1.55 END AS radius FROM atoms),
    ch AS (SELECT structure_id, chain_id, any_value(entity_id) AS e, any_value(type) AS type, count(*) AS n FROM t GROUP BY ALL)"""


def typed_atoms(spark, sf):
    chain = F.col("chain_id")
    return X.atoms(spark, sf).withColumns(
        {
            "entity_id": chain % 2,
            "type": F.when(chain < 3, "protein").otherwise("ligand"),
            "radius": F.when(F.col("element") == "C", 1.7).otherwise(1.55),
        }
    )


def bonded_chains(spark, sf):
    first = X.atoms(spark, sf).filter("structure_id % 3 = 0").select("structure_id").distinct()
    return first.select("structure_id", F.lit(0).cast("bigint").alias("chain_1"), F.lit(1).cast("bigint").alias("chain_2"))


@query(
    "j21_steric_clashes",
    X.with_sql(X.SQL_ATOMS, _STERIC_SQL)
    + f""", p AS (SELECT DISTINCT a.structure_id, a.chain_id AS c1, b.chain_id AS c2 FROM t a JOIN t b
      ON a.structure_id = b.structure_id AND a.chain_id < b.chain_id
      AND {_D2} < ((a.radius + b.radius) * 0.75) * ((a.radius + b.radius) * 0.75)
      WHERE NOT (a.structure_id % 3 = 0 AND a.chain_id = 0 AND b.chain_id = 1))
    SELECT p.structure_id, CASE WHEN a.e = b.e AND a.n = b.n THEN 'sym_' || a.type ELSE concat_ws('_', 'asym', a.type, b.type) END AS bucket,
      count(*) AS num_clashes FROM p JOIN ch a ON p.structure_id = a.structure_id AND c1 = a.chain_id
      JOIN ch b ON p.structure_id = b.structure_id AND c2 = b.chain_id WHERE a.n > 1 AND b.n > 1 GROUP BY ALL""",
)
def j21(spark, sf):
    return G.steric_clashes(typed_atoms(spark, sf), bonded_chains(spark, sf))


@query(
    "j21_chain_pair_counts",
    X.with_sql(X.SQL_ATOMS, _STERIC_SQL)
    + """SELECT a.structure_id, CASE WHEN a.e = b.e AND a.n = b.n THEN 'sym_' || a.type ELSE concat_ws('_', 'asym', a.type, b.type) END AS bucket,
      count(*) AS num_pairs FROM ch a JOIN ch b ON a.structure_id = b.structure_id AND a.chain_id < b.chain_id
      WHERE a.n > 1 AND b.n > 1 AND NOT (a.structure_id % 3 = 0 AND a.chain_id = 0 AND b.chain_id = 1) GROUP BY ALL""",
)
def j21_pairs(spark, sf):
    chains = (
        typed_atoms(spark, sf)
        .groupBy("structure_id", "chain_id")
        .agg(F.first("entity_id").alias("entity_id"), F.first("type").alias("type"), F.count(F.lit(1)).alias("n"))
    )
    return G.chain_pair_counts(chains, bonded_chains(spark, sf))


@query(
    "j22_contact_pairs",
    ATOMS
    + """, tok AS (SELECT structure_id, res_idx AS token_idx, min(atom_idx) AS a, count(*) AS n FROM atoms GROUP BY ALL),
    c AS (SELECT structure_id, token_idx AS t1, token_idx + 2 AS t2 FROM tok WHERE token_idx % 4 = 0)
    SELECT c.structure_id, t1 AS group_id, x.atom_idx AS atom_1, y.atom_idx AS atom_2, 6.0::DOUBLE AS threshold FROM c
      JOIN atoms x ON c.structure_id = x.structure_id AND x.res_idx = t1
      JOIN atoms y ON c.structure_id = y.structure_id AND y.res_idx = t2""",
)
def j22(spark, sf):
    tokens = (
        X.atoms(spark, sf)
        .groupBy("structure_id", F.col("res_idx").alias("token_idx"))
        .agg(F.min("atom_idx").alias("atom_idx"), F.count(F.lit(1)).alias("atom_num"))
    )
    token = F.col("token_idx")
    constraints = tokens.filter(token % 4 == 0).select(
        "structure_id",
        token.alias("group_id"),
        token.alias("token_1"),
        (token + 2).alias("token_2"),
        F.lit(6.0).alias("threshold"),
    )
    return G.contact_pairs(constraints, tokens)


@query(
    "w7_consecutive_distance",
    ATOMS
    + """, r AS (SELECT * FROM atoms WHERE atom_idx % 3 = 0),
    s AS (SELECT a.structure_id, a.chain_id, bool_or("""
    + _D2
    + """ > 100.0) AS broken FROM r a JOIN r b ON a.structure_id = b.structure_id AND a.chain_id = b.chain_id
      AND b.res_idx = a.res_idx + 1 WHERE a.element = 'C' AND b.element = 'C' GROUP BY ALL)
    SELECT structure_id, chain_id, NOT coalesce(broken, false) AS valid FROM (SELECT DISTINCT structure_id, chain_id FROM r)
      LEFT JOIN s USING (structure_id, chain_id)""",
)
def w7(spark, sf):
    residues = X.atoms(spark, sf).filter("atom_idx % 3 = 0").withColumn("is_present", F.col("element") == "C")
    return G.consecutive_distance(residues)


@query(
    "w10_free_cysteines",
    ATOMS
    + f""", s AS (SELECT * FROM atoms WHERE element = 'N'),
    p AS (SELECT DISTINCT a.structure_id, a.atom_idx FROM s a JOIN s b ON a.structure_id = b.structure_id
      AND a.atom_idx <> b.atom_idx AND {_D2} <= 16.0)
    SELECT structure_id, count(*) AS free_cysteines FROM s WHERE (structure_id, atom_idx) NOT IN (SELECT (structure_id, atom_idx) FROM p)
    GROUP BY structure_id""",
)
def w10(spark, sf):
    return G.free_cysteines(X.atoms(spark, sf).filter("element = 'N'"))


@query("g1_aligned_rmsd")
def g1(spark, sf):
    return G.aligned_rmsd(X.atoms(spark, sf), "structure_id", F.lit(1.0)).withColumn("rmsd", F.round("rmsd", 6))


@query(
    "g2_lddt",
    ATOMS
    + f""", p AS (SELECT a.structure_id, abs(sqrt({_D2}) - sqrt((a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py)
        + (a.pz-b.pz)*(a.pz-b.pz))) AS d {_PAIR} AND a.atom_idx <> b.atom_idx AND {_D2} < 225.0)
    SELECT structure_id, round(avg((CAST(d < 0.5 AS INT) + CAST(d < 1.0 AS INT) + CAST(d < 2.0 AS INT) + CAST(d < 4.0 AS INT)) / 4.0), 8) AS lddt,
      count(*) AS pairs FROM p GROUP BY structure_id""",
)
def g2(spark, sf):
    return G.lddt(X.atoms(spark, sf)).withColumn("lddt", F.round("lddt", 8))


_SITE = [3, 4, 5, 6, 7, 8, 9]


@query(
    "g3_binding_site_adherence",
    ATOMS
    + f""", m AS (SELECT a.structure_id, a.atom_idx, min(CASE WHEN b.chain_id = 0 THEN {_D2} END) AS d2 FROM atoms a
      LEFT JOIN atoms b ON a.structure_id = b.structure_id AND b.chain_id = 0 WHERE a.chain_id > 0 GROUP BY ALL)
    SELECT structure_id, """
    + ", ".join(f"round(avg(CASE WHEN d2 < {t * t} THEN 1.0 ELSE 0.0 END), 8) AS under_{t}" for t in _SITE)
    + " FROM m GROUP BY structure_id",
)
def g3(spark, sf):
    atoms = X.atoms(spark, sf)
    out = G.site_adherence(atoms.filter("chain_id > 0"), atoms.filter("chain_id = 0"), _SITE)
    return out.select("structure_id", *[F.round(f"under_{t}", 8).alias(f"under_{t}") for t in _SITE])


@query(
    "g4_largest_patch",
    X.with_sql(X.SQL_ATOMS).replace("WITH", "WITH RECURSIVE", 1)
    + f""", e AS (SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j {_PAIR} AND {_D2} <= 4.0),
    r AS (SELECT structure_id, atom_idx AS i, atom_idx AS root FROM atoms UNION
      SELECT e.structure_id, e.j, r.root FROM r JOIN e ON r.structure_id = e.structure_id AND r.i = e.i),
    c AS (SELECT structure_id, i AS atom_idx, min(root) AS comp FROM r GROUP BY ALL),
    s AS (SELECT structure_id, comp, sum(area) AS a FROM c JOIN atoms USING (structure_id, atom_idx) GROUP BY ALL)
    SELECT structure_id, round(max(a), 6) AS largest_patch FROM s GROUP BY structure_id""",
)
def g4(spark, sf):
    return G.largest_patch(X.atoms(spark, sf), 2.0).withColumn("largest_patch", F.round("largest_patch", 6))


def bonds(spark, sf):
    a = X.atoms(spark, sf).filter("atom_idx % 5 < 3 AND atom_idx < 45")
    return a.select("structure_id", F.col("atom_idx").alias("atom_1"), (F.col("atom_idx") + 2).alias("atom_2"), "element", "flag")


_BOND_SQL = f"""bo AS (SELECT a.structure_id, a.element, a.flag, sqrt({_D2}) AS d {_PAIR}
      AND b.atom_idx = a.atom_idx + 2 WHERE a.atom_idx % 5 < 3 AND a.atom_idx < 45)"""


@query(
    "g5_disulfide_quality",
    X.with_sql(X.SQL_ATOMS, _BOND_SQL)
    + "SELECT structure_id, round(max(d), 7) AS max_length, round(min(d), 7) AS min_length FROM bo GROUP BY structure_id",
)
def g5(spark, sf):
    out = G.disulfide_quality(X.atoms(spark, sf), bonds(spark, sf))
    return out.select("structure_id", *[F.round(c, 7).alias(c) for c in ("max_length", "min_length")])


@query(
    "g6_distance_geometry",
    X.with_sql(X.SQL_ATOMS, _BOND_SQL)
    + """SELECT structure_id, count(*) FILTER (flag AND (d <= 3.0 OR d >= 12.5)) AS num_bond_length_violations,
      count(*) FILTER (flag) AS num_bonds, count(*) FILTER (NOT flag AND element = 'C' AND (d <= 3.0 OR d >= 12.5)) AS num_bond_angle_violations,
      count(*) FILTER (NOT flag AND element = 'C') AS num_angles,
      count(*) FILTER (NOT flag AND element <> 'C' AND d <= 4.0 * 0.8) AS num_internal_clash_violations,
      count(*) FILTER (NOT flag AND element <> 'C') AS num_non_neighbors FROM bo GROUP BY structure_id""",
)
def g6(spark, sf):
    bounds = bonds(spark, sf).select(
        "structure_id",
        "atom_1",
        "atom_2",
        F.col("flag").alias("is_bond"),
        (~F.col("flag") & (F.col("element") == "C")).alias("is_angle"),
        F.lit(4.0).alias("lower"),
        F.lit(10.0).alias("upper"),
    )
    return G.distance_geometry(X.atoms(spark, sf), bounds)


def _sql_torsion() -> str:
    v = lambda a, b: [f"({a}.{c} - {b}.{c})" for c in "xyz"]
    cross = lambda p, q: [
        f"({p[1]} * {q[2]} - {p[2]} * {q[1]})",
        f"({p[2]} * {q[0]} - {p[0]} * {q[2]})",
        f"({p[0]} * {q[1]} - {p[1]} * {q[0]})",
    ]
    dot = lambda p, q: " + ".join(f"{i} * {j}" for i, j in zip(p, q))
    back, mid, ahead = v("q1", "q2"), v("q3", "q2"), v("q3", "q4")
    n1, n2 = cross(back, mid), cross(mid, ahead)
    return (
        f"sign({dot(mid, cross(n1, n2))}) * acos(least(greatest(({dot(n1, n2)}) / "
        f"sqrt(({dot(n1, n1)}) * ({dot(n2, n2)})), -1 + 1e-8), 1 - 1e-8))"
    )


_QUAD_SQL = f"""quads AS (SELECT q1.structure_id, q1.element, q1.flag, {_sql_torsion()} AS torsion FROM atoms q1
      JOIN atoms q2 ON q1.structure_id = q2.structure_id AND q2.atom_idx = q1.atom_idx + 1
      JOIN atoms q3 ON q1.structure_id = q3.structure_id AND q3.atom_idx = q1.atom_idx + 2
      JOIN atoms q4 ON q1.structure_id = q4.structure_id AND q4.atom_idx = q1.atom_idx + 3)"""


@query(
    "g7_stereo_violations",
    X.with_sql(X.SQL_ATOMS, _QUAD_SQL)
    + """SELECT structure_id, count(*) FILTER (element = 'C' AND (torsion > 0) <> flag) AS num_chiral_atom_violations,
      count(*) FILTER (element = 'C') AS num_chiral_atoms,
      count(*) FILTER (element = 'N' AND (abs(torsion) > pi() / 2) <> flag) AS num_stereo_bond_violations,
      count(*) FILTER (element = 'N') AS num_stereo_bonds FROM quads GROUP BY structure_id""",
)
def g7(spark, sf):
    i = F.col("atom_idx")
    quads = X.atoms(spark, sf).filter("atom_idx < 47").select(
        "structure_id",
        *[(i + k - 1).alias(f"atom_{k}") for k in range(1, 5)],
        "element",
        F.lit(True).alias("is_reference"),
        F.col("flag").alias("expected"),
    )
    split = lambda e: quads.filter(F.col("element") == e).drop("element")
    return G.stereo_violations(X.atoms(spark, sf), split("C"), split("N"))


@query("g8_planarity")
def g8(spark, sf):
    groups = (
        X.atoms(spark, sf)
        .groupBy("structure_id", F.floor(F.col("atom_idx") / 5).alias("group_id"))
        .agg(F.collect_list("atom_idx").alias("atoms"))
        .withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in ("ring_5", "ring_6", "double_bond")]), (F.col("group_id") % 3 + 1).cast("int")))
    )
    return G.planarity(X.atoms(spark, sf), groups, 1.5)


@query(
    "g9_delta_area",
    ATOMS
    + """SELECT structure_id, round(sum(area * 1.5) FILTER (chain_id > 1) - sum(area) FILTER (chain_id > 1), 6) AS delta,
      round(sum(area * 1.5) FILTER (chain_id > 1), 6) AS unbound, round(sum(area) FILTER (chain_id > 1), 6) AS bound FROM atoms GROUP BY structure_id""",
)
def g9(spark, sf):
    atoms = X.atoms(spark, sf).select(
        "structure_id",
        (F.col("chain_id") > 1).alias("is_target"),
        (F.col("area") * 1.5).alias("area_unbound"),
        F.col("area").alias("area_bound"),
    )
    return G.delta_area(atoms).select("structure_id", *[F.round(c, 6).alias(c) for c in ("delta", "unbound", "bound")])


@query(
    "g10_min_token_distance",
    ATOMS
    + f"""SELECT a.structure_id, a.atom_idx, round(sqrt(min({_D2})), 8) AS distance {_PAIR} AND b.chain_id = 0 AND a.chain_id > 0
    GROUP BY ALL""",
)
def g10(spark, sf):
    atoms = X.atoms(spark, sf)
    out = G.nearest_distance(atoms.filter("chain_id > 0"), atoms.filter("chain_id = 0"))
    return out.withColumn("distance", F.round("distance", 8))


@query(
    "g14_pocket_tokens",
    ATOMS
    + f"""SELECT DISTINCT a.structure_id, a.res_idx AS token_idx {_PAIR} AND b.chain_id = 0 AND a.chain_id > 0 AND {_D2} < 36.0
      WHERE a.res_idx % 5 <> 0""",
)
def g14(spark, sf):
    atoms = X.atoms(spark, sf).withColumnRenamed("res_idx", "token_idx")
    tokens = atoms.select(
        "structure_id", "token_idx", F.lit(True).alias("is_polymer"), (F.col("token_idx") % 5 != 0).alias("resolved")
    ).distinct()
    return G.pocket_tokens(tokens, atoms, F.col("chain_id") == 0, 6.0)


# token pairs with roles: the parts are tokens, the line items pairs of them
_PAIRS_SQL = """tok AS (SELECT p_partkey AS t, p_size % 4 AS chain, p_size % 4 = 0 AS cd, p_size % 8 = 0 AS d, p_size % 3 = 0 AS lig FROM part),
    pr AS (SELECT l_suppkey AS structure_id, l_partkey AS i, l_orderkey % 2000 AS j, l_quantity AS pae, l_tax AS pde,
      l_discount + 0.01 AS p_contact, 1 / (1 + pow(l_quantity / (1.24 * pow(100.0 - 15, 1.0 / 3) - 1.8), 2)) AS tm FROM lineitem),
    pairs AS (SELECT pr.*, a.chain AS c1, b.chain AS c2, a.cd AS cd1, b.cd AS cd2, a.d AS d1, b.d AS d2, a.lig AS l1, b.lig AS l2
      FROM pr JOIN tok a ON i = a.t JOIN tok b ON j = b.t)"""


def token_pairs(spark, sf):
    size = F.col("p_size")
    part = X.table(spark, sf, "part")
    side = lambda k, key: part.select(
        F.col("p_partkey").alias(key),
        (size % 4).alias(f"chain_{k}"),
        (size % 4 == 0).alias(f"chain_design_{k}"),
        (size % 8 == 0).alias(f"design_{k}"),
        (size % 3 == 0).alias(f"ligand_{k}"),
    )
    pairs = X.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("structure_id"),
        F.col("l_partkey").alias("i"),
        (F.col("l_orderkey") % 2000).alias("j"),
        F.col("l_quantity").alias("pae"),
        F.col("l_tax").alias("pde"),
        (F.col("l_discount") + 0.01).alias("p_contact"),
        G.tm_weight(F.col("l_quantity"), F.lit(100)).alias("tm"),
    )
    return pairs.join(side(1, "i"), "i").join(side(2, "j"), "j")


@query(
    "a28_pae_rollup",
    "WITH "
    + _PAIRS_SQL
    + """SELECT structure_id, round(sum(CASE WHEN cd1 <> cd2 THEN pae ELSE 0 END) / (count(*) FILTER (cd1 <> cd2) + 1e-5), 7) AS chain_interaction_pae,
      min(pae) FILTER (cd1 <> cd2) AS min_interaction_pae,
      round(sum(CASE WHEN (d1 AND NOT cd2) OR (NOT cd1 AND d2) THEN pae ELSE 0 END) /
        (count(*) FILTER ((d1 AND NOT cd2) OR (NOT cd1 AND d2)) + 1e-5), 7) AS interaction_pae,
      min(pae) FILTER ((d1 AND NOT cd2) OR (NOT cd1 AND d2)) AS min_design_to_target_pae,
      round(sum(pde * p_contact) / sum(p_contact), 7) AS complex_pde,
      round(sum(CASE WHEN c1 <> c2 THEN pde * p_contact ELSE 0 END) / (sum(CASE WHEN c1 <> c2 THEN p_contact ELSE 0 END) + 1e-5), 7) AS complex_ipde
    FROM pairs GROUP BY structure_id""",
)
def a28(spark, sf):
    out = G.pae_rollup(token_pairs(spark, sf))
    rounded = ("chain_interaction_pae", "interaction_pae", "complex_pde", "complex_ipde")
    return out.withColumns({c: F.round(c, 7) for c in rounded})


@query(
    "a29_plddt_rollup",
    ATOMS
    + f""", c AS (SELECT DISTINCT a.structure_id, a.atom_idx {_PAIR} AND a.chain_id <> b.chain_id AND {_D2} < 64.0 WHERE a.chain_id <> 3),
    w AS (SELECT t.structure_id, t.area AS v, CASE WHEN t.chain_id = 3 THEN 20.0::DOUBLE WHEN c.atom_idx IS NOT NULL THEN 10.0 ELSE 1.0 END AS w
      FROM atoms t LEFT JOIN c ON t.structure_id = c.structure_id AND t.atom_idx = c.atom_idx)
    SELECT structure_id, round(avg(v), 7) AS complex_plddt, round(sum(v * w) / sum(w), 7) AS complex_iplddt FROM w GROUP BY structure_id""",
)
def a29(spark, sf):
    tokens = X.atoms(spark, sf).withColumns({"is_ligand": F.col("chain_id") == 3, "plddt": F.col("area")})
    out = G.plddt_rollup(tokens)
    return out.withColumns({c: F.round(c, 7) for c in ("complex_plddt", "complex_iplddt")})


_MASKS = {
    "ptm": "true",
    "iptm": "c1 <> c2",
    "ligand_iptm": "c1 <> c2 AND l1 <> l2",
    "protein_iptm": "c1 <> c2 AND NOT l1 AND NOT l2",
    "design_iptm": "cd1 <> cd2",
    "design_to_target_iptm": "(d1 AND NOT cd2) OR (NOT cd1 AND d2)",
    "design_ptm": "cd1 AND cd2",
    "target_ptm": "NOT cd1 AND NOT cd2",
}


@query(
    "a30_ptm_rollup",
    "WITH "
    + _PAIRS_SQL
    + ", r AS (SELECT structure_id, i, "
    + ", ".join(
        f"sum(CASE WHEN {m} THEN tm ELSE 0 END) / (count(*) FILTER ({m}) + 1e-5) AS {n}" for n, m in _MASKS.items()
    )
    + " FROM pairs GROUP BY ALL) SELECT structure_id, "
    + ", ".join(f"round(max({n}), 8) AS {n}" for n in _MASKS)
    + " FROM r GROUP BY structure_id",
)
def a30(spark, sf):
    names = {"c1": "chain_1", "c2": "chain_2", "cd1": "chain_design_1", "cd2": "chain_design_2"}
    names |= {"d1": "design_1", "d2": "design_2", "l1": "ligand_1", "l2": "ligand_2"}
    pairs = token_pairs(spark, sf).withColumnsRenamed({v: k for k, v in names.items()})
    out = G.ptm_rollup(pairs, {n: F.expr(m) for n, m in _MASKS.items()})
    return out.withColumns({n: F.round(n, 8) for n in _MASKS})


@query(
    "a30_chain_pair_ptm",
    "WITH "
    + _PAIRS_SQL
    + """, r AS (SELECT structure_id, c1, c2, i, sum(tm) / (count(*) + 1e-5) AS m FROM pairs GROUP BY ALL)
    SELECT structure_id, c1 AS chain_1, c2 AS chain_2, round(max(m), 8) AS ptm FROM r GROUP BY ALL""",
)
def a30_chains(spark, sf):
    return G.chain_pair_ptm(token_pairs(spark, sf)).withColumn("ptm", F.round("ptm", 8))


@query(
    "p19_chain_filters",
    ATOMS
    + """, m AS (SELECT structure_id, chain_id, count(*) FILTER (element = 'C') BETWEEN 4 AND 5000
        AND NOT bool_and(charge = 0) AND count(*) FILTER (flag) < 9 AS valid FROM atoms GROUP BY ALL),
    i AS (SELECT DISTINCT structure_id, c AS chain_1, c + 1 AS chain_2 FROM (SELECT structure_id, chain_id AS c FROM atoms WHERE chain_id < 4))
    SELECT i.structure_id, chain_1, chain_2, coalesce(a.valid AND b.valid, false) AS valid FROM i
      LEFT JOIN m a ON i.structure_id = a.structure_id AND chain_1 = a.chain_id
      LEFT JOIN m b ON i.structure_id = b.structure_id AND chain_2 = b.chain_id""",
)
def p19(spark, sf):
    atoms = X.atoms(spark, sf)
    residues = atoms.select(
        "structure_id",
        "chain_id",
        (F.col("element") == "C").alias("is_present"),
        F.when(F.col("charge") == 0, "UNK").otherwise("ALA").alias("name"),
    )
    chains = atoms.select("structure_id", "chain_id").distinct()
    excluded = atoms.groupBy("structure_id", "chain_id").agg((F.count_if("flag") < 9).alias("valid"))
    pairs = chains.filter("chain_id < 4").select(
        "structure_id", F.col("chain_id").alias("chain_1"), (F.col("chain_id") + 1).alias("chain_2")
    )
    _, flagged = P.propagate_validity(chains, [P.polymer_filter(residues), excluded], pairs)
    return flagged.select("structure_id", "chain_1", "chain_2", "valid")
