"""Queries over the reactant library, weights and seeded draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegrid.functions import intake as I
from sievegrid.functions.draws import uniform
from sievegrid.operators import reactants as M
from sievegrid.operators import sampling as Q
from sievegrid.plans import fixtures as X
from sievegrid.plans.queries_intake import NAMES, product_names
from sievegrid.plans.registry import query


def sql_u(seed: str, *keys: str) -> str:
    text = ", ".join([f"'{seed}'", *keys])
    return f"(('0x' || substr(md5(concat_ws('|', {text})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def sql_pick(seed: str, n: str, *keys: str) -> str:
    return f"CAST(floor({sql_u(seed, *keys)} * {n}) AS BIGINT)"


_LIBRARY_SQL = """molecules AS (SELECT p_partkey AS mol_id, p_name AS smiles, p_size AS role_mask FROM part),
    reactions AS (SELECT n_nationkey AS rxn_id, 1 << (n_nationkey % 5) AS roleA, 1 << ((n_nationkey + 1) % 5) AS roleB,
      CASE WHEN n_nationkey % 2 = 0 THEN 1 << ((n_nationkey + 2) % 5) END AS roleC FROM nation),
    roles AS (SELECT rxn_id, 'A' AS slot, roleA AS role FROM reactions UNION ALL
      SELECT rxn_id, 'B', roleB FROM reactions UNION ALL SELECT rxn_id, 'C', roleC FROM reactions WHERE roleC <> 0)"""


def library(spark, sf):
    molecules = X.table(spark, sf, "part").select(
        F.col("p_partkey").alias("mol_id"), F.col("p_name").alias("smiles"), F.col("p_size").alias("role_mask")
    )
    key = F.col("n_nationkey")
    bit = lambda i: F.expr(f"shiftleft(1, (n_nationkey + {i}) % 5)")
    reactions = X.table(spark, sf, "nation").select(
        key.alias("rxn_id"),
        bit(0).alias("roleA"),
        bit(1).alias("roleB"),
        F.when(key % 2 == 0, bit(2)).alias("roleC"),
    )
    return molecules, reactions


@query(
    "j3_j5_resolve_and_order",
    NAMES
    + ", "
    + _LIBRARY_SQL
    + """, p AS (SELECT uid, pos, name, CAST(l_suppkey % 6 AS INT) AS rxn, l_partkey AS m1, uid % 50 AS m2,
      CASE WHEN pos % 2 = 0 THEN l_suppkey END AS m3 FROM names WHERE pos <> 7),
    j AS (SELECT p.*, a.smiles AS s1, a.role_mask AS k1, b.smiles AS s2, b.role_mask AS k2, c.smiles AS s3, c.role_mask AS k3,
      roleA, roleB, coalesce(roleC, 0) AS roleC FROM p JOIN reactions ON rxn = rxn_id JOIN molecules a ON m1 = a.mol_id
      JOIN molecules b ON m2 = b.mol_id LEFT JOIN molecules c ON m3 = c.mol_id WHERE m3 IS NULL OR c.mol_id IS NOT NULL),
    f AS (SELECT *, (k1 & roleA) = roleA AND (k2 & roleB) = roleB AS straight,
      (k1 & roleB) = roleB AND (k2 & roleA) = roleA AS swapped FROM j),
    o AS (SELECT *, (straight OR swapped) AND (m3 IS NULL OR (k3 & roleC) = roleC) AS fine,
      CASE WHEN m3 IS NULL THEN straight ELSE (k1 & roleA) <> 0 AND (k2 & roleB) <> 0 END AS keep FROM f)
    SELECT uid, pos, name, CASE WHEN fine THEN CASE WHEN keep THEN s1 ELSE s2 END END AS r1,
      CASE WHEN fine THEN CASE WHEN keep THEN s2 ELSE s1 END END AS r2, CASE WHEN fine THEN s3 END AS r3 FROM o""",
)
def j3_j5(spark, sf):
    molecules, reactions = library(spark, sf)
    parsed = product_names(spark, sf).select("uid", "pos", "name", I.parse_product(F.col("name")).alias("p"))
    parsed = parsed.filter("p IS NOT NULL").select("uid", "pos", "name", "p.*")
    ordered = M.order_reactants(M.resolve_products(parsed, reactions, molecules))
    return ordered.select("uid", "pos", "name", "r1", "r2", "r3")


@query(
    "j4_role_join",
    "WITH "
    + _LIBRARY_SQL
    + """SELECT DISTINCT role, mol_id FROM molecules JOIN (SELECT DISTINCT role FROM roles) ON (role_mask & role) = role""",
)
def j4(spark, sf):
    molecules, reactions = library(spark, sf)
    return M.molecules_by_role(molecules, reactions)


@query(
    "j6_library_size",
    "WITH "
    + _LIBRARY_SQL
    + """, n AS (SELECT rxn_id, slot, count(mol_id) AS n FROM roles LEFT JOIN molecules ON (role_mask & role) = role GROUP BY ALL)
    SELECT rxn_id, CAST(product(n) AS BIGINT) AS n_products FROM n GROUP BY rxn_id""",
)
def j6(spark, sf):
    return M.library_size(*library(spark, sf))


@query(
    "q7_random_products",
    "WITH "
    + _LIBRARY_SQL
    + f""", by_role AS (SELECT role, mol_id, row_number() OVER (PARTITION BY role ORDER BY mol_id) AS place,
        count(*) OVER (PARTITION BY role) AS n FROM molecules JOIN (SELECT DISTINCT role FROM roles) ON (role_mask & role) = role),
    sizes AS (SELECT DISTINCT role, n FROM by_role),
    draws AS (SELECT range AS draw FROM range(1, 2001)),
    chosen AS (SELECT draw, {sql_pick('7x', '(SELECT count(*) FROM reactions)', 'draw')} AS rxn_id FROM draws),
    slots AS (SELECT draw, rxn_id, slot, role, 1 + {sql_pick('7', 'n', 'draw', 'slot')} AS place
      FROM chosen JOIN roles USING (rxn_id) JOIN sizes USING (role))
    SELECT draw, concat_ws(':', 'rxn', rxn_id, max(mol_id) FILTER (slot = 'A'), max(mol_id) FILTER (slot = 'B'),
      max(mol_id) FILTER (slot = 'C')) AS name FROM slots JOIN by_role USING (role, place) GROUP BY draw, rxn_id""",
)
def q7(spark, sf):
    return M.random_products(*library(spark, sf), n=2000, seed=7)


_CHAIN_SQL = """ch AS (SELECT l_orderkey AS record, l_linenumber AS chain_id, l_partkey % 500 AS cluster_id,
      l_suppkey % 4 AS mol_type, l_returnflag <> 'N' AS valid FROM lineitem),
    itf AS (SELECT o_orderkey AS record, o_custkey AS interface_id, o_custkey % 300 AS cluster_1,
      o_orderkey % 300 AS cluster_2, o_custkey % 4 AS mol_type_1, o_orderkey % 4 AS mol_type_2,
      o_orderstatus <> 'F' AS valid FROM orders)"""


def chains_and_interfaces(spark, sf):
    chains = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("record"),
        F.col("l_linenumber").alias("chain_id"),
        (F.col("l_partkey") % 500).alias("cluster_id"),
        (F.col("l_suppkey") % 4).alias("mol_type"),
        (F.col("l_returnflag") != "N").alias("valid"),
    )
    interfaces = X.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("record"),
        F.col("o_custkey").alias("interface_id"),
        (F.col("o_custkey") % 300).alias("cluster_1"),
        (F.col("o_orderkey") % 300).alias("cluster_2"),
        (F.col("o_custkey") % 4).alias("mol_type_1"),
        (F.col("o_orderkey") % 4).alias("mol_type_2"),
        (F.col("o_orderstatus") != "F").alias("valid"),
    )
    return chains, interfaces


@query(
    "a20_cluster_sizes",
    "WITH " + _CHAIN_SQL + "SELECT cluster_id, count(*) AS size FROM ch WHERE valid GROUP BY cluster_id",
)
def a20(spark, sf):
    from sievegrid.operators.aggregates import cluster_sizes

    return cluster_sizes(chains_and_interfaces(spark, sf)[0])


@query(
    "a20_interface_cluster_sizes",
    "WITH "
    + _CHAIN_SQL
    + """SELECT least(cluster_1::VARCHAR, cluster_2::VARCHAR) AS low, greatest(cluster_1::VARCHAR, cluster_2::VARCHAR) AS high,
      count(*) AS size FROM itf WHERE valid GROUP BY ALL""",
)
def a20_interfaces(spark, sf):
    from sievegrid.operators.aggregates import interface_cluster_sizes

    return interface_cluster_sizes(chains_and_interfaces(spark, sf)[1])


@query(
    "q1_cluster_weights",
    "WITH "
    + _CHAIN_SQL
    + """, a AS (SELECT record, 0 AS kind, chain_id AS item, 0.5 / count(*) OVER (PARTITION BY cluster_id) *
        CASE WHEN mol_type IN (0, 1, 2) THEN 3.0 ELSE 1.0 END AS w FROM ch WHERE valid),
    b AS (SELECT record, 1 AS kind, interface_id AS item, 1.0 / count(*) OVER (PARTITION BY
        least(cluster_1::VARCHAR, cluster_2::VARCHAR), greatest(cluster_1::VARCHAR, cluster_2::VARCHAR)) *
        (CASE WHEN mol_type_1 < 3 THEN 3.0 ELSE 1.0 END + CASE WHEN mol_type_2 < 3 THEN 3.0 ELSE 1.0 END) AS w
        FROM itf WHERE valid),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
    SELECT record, kind, item, round(1e6 * CAST(w AS DOUBLE) / sum(CAST(w AS DOUBLE)) OVER (), 6) AS weight FROM u""",
)
def q1(spark, sf):
    weights = Q.cluster_weights(*chains_and_interfaces(spark, sf))
    return weights.withColumn("weight", F.round(F.col("weight") * 1e6, 6))


@query(
    "q2_weighted_draw",
    f"""WITH w AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, CAST(sum(p_size) OVER (ORDER BY p_partkey) AS DOUBLE) AS hi FROM part),
    d AS (SELECT range AS draw, {sql_u('5', 'range')} * (SELECT max(hi) FROM w) AS x FROM range(1, 3001))
    SELECT draw, p_partkey FROM d JOIN w ON x >= hi - w AND x < hi""",
)
def q2(spark, sf):
    return Q.weighted_draw(X.table(spark, sf, "part"), ["p_partkey"], "p_size", 3000, 5)


@query(
    "q3_random_record_draw",
    f"""WITH r AS (SELECT l_orderkey AS record, count(*) FILTER (l_returnflag <> 'N') AS n_chains FROM lineitem GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (ORDER BY record) AS place FROM r),
    d AS (SELECT range AS draw, 1 + {sql_pick('3', '(SELECT count(*) FROM r)', 'range')} AS place FROM range(1, 1001))
    SELECT draw, record, n_chains FROM d JOIN n USING (place)""",
)
def q3(spark, sf):
    """Records as nested rows; a record holds at most the lines of one order."""
    lines = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("record"), F.struct((F.col("l_returnflag") != "N").alias("valid")).alias("c")
    )
    records = lines.groupBy("record").agg(F.collect_list("c").alias("chains"))
    records = records.withColumn("interfaces", F.col("chains"))
    drawn = Q.numbered_draw(Q.drop_invalid(records), "record", 1000, 3)
    return drawn.select("draw", "record", F.size("chains").cast("bigint").alias("n_chains"))


@query(
    "q4_two_stratum_draw",
    f"""WITH n AS (SELECT p_partkey, p_size <= 10 AS small, row_number() OVER (PARTITION BY p_size <= 10 ORDER BY p_partkey) AS place,
      count(*) OVER (PARTITION BY p_size <= 10) AS n FROM part),
    s AS (SELECT DISTINCT small, n FROM n),
    d AS (SELECT range AS draw, {sql_u('4s', 'range')} < 0.25 AS small FROM range(1, 1001))
    SELECT draw, p_partkey FROM d JOIN s USING (small) JOIN n USING (small) WHERE place = 1 + {sql_pick('4', 's.n', 'draw')}""",
)
def q4(spark, sf):
    part = X.table(spark, sf, "part").select("p_partkey", "p_size")
    drawn = Q.two_stratum_draw(part, "p_partkey", F.col("p_size"), 1000, 4, limit=10, p=0.25)
    return drawn.select("draw", "p_partkey")


@query(
    "q5_dataset_mixture",
    f"""SELECT o_orderkey AS draw, CASE WHEN {sql_u('6d', 'o_orderkey')} < 0.5 THEN 0
      WHEN {sql_u('6d', 'o_orderkey')} < 0.8 THEN 1 ELSE 2 END AS dataset FROM orders""",
)
def q5(spark, sf):
    draws = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("draw"))
    return Q.dataset_of_draw(draws, [0.5, 0.3, 0.2], 6)


@query(
    "q6_subset",
    f"SELECT o_orderkey FROM orders ORDER BY {sql_u('9', 'o_orderkey')}, o_orderkey LIMIT 100",
)
def q6(spark, sf):
    return Q.subset(X.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 100, 9)


@query(
    "q8_mutate_sequence",
    X.with_sql(X.SQL_CHAINS)
    + f""", l AS (SELECT doc_id, unnest(range(length(seq))) AS i, unnest(string_split(seq, '')) AS c FROM chains WHERE seq <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {sql_u('8', 'doc_id', 'i')}, i) AS k FROM l)
    SELECT doc_id, string_agg(CASE WHEN k <= 5 THEN replace('ACDEFGHIKLMNPQRSTVWY', c, '')[1 + {sql_pick('8r', '19', 'doc_id', 'i')}]
      ELSE c END, '' ORDER BY i) AS mutated FROM r GROUP BY doc_id""",
)
def q8(spark, sf):
    chains = X.chains(spark, sf).filter("seq <> ''")
    return chains.select("doc_id", Q.mutate(chains, "doc_id", "seq", 5, 8).alias("mutated"))


@query(
    "q9_geometric_subset",
    f"""WITH m AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS pos FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {sql_u('2', 'l_suppkey', 'pos')}, pos) AS k FROM m)
    SELECT l_suppkey, pos FROM r WHERE k <= 1 + greatest(ceil(ln(1 - {sql_u('2k', 'l_suppkey')}) / ln(1 - 0.2::DOUBLE)), 1)""",
)
def q9(spark, sf):
    lines = X.table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    mask = lines.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")).distinct()
    return Q.geometric_subset(mask, ["l_suppkey"], "pos", 0.2, 2)
