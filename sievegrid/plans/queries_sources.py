"""Round trips through the file formats, and structure tables.

Files are written below the shared folder from the given tables, then read
back, so that every reader and writer works on data that grows with them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegrid.operators import structures as U
from sievegrid.plans import fixtures as X
from sievegrid.plans.queries_evaluation import _MSA_SQL, msa
from sievegrid.plans.registry import query
from sievegrid.session import scratch_path
from sievegrid.sources import readers as R
from sievegrid.sources import writers as W


@query(
    "s1_local_submissions",
    X.with_sql(X.SQL_SUBMISSIONS)
    + """SELECT uid, ['rxn:1:' || uid || ':2'] AS molecules, items AS sequences FROM submissions WHERE len(items) > 0""",
)
def s1(spark, sf):
    path = scratch_path(spark, "s1")
    uid = F.col("uid").cast("string")
    line = F.concat(uid, F.lit("|rxn:1:"), uid, F.lit(":2|"), F.array_join("items", ","))
    X.submissions(spark, sf).filter(F.size("items") > 0).select(line.alias("value")).write.text(path)
    return R.read_local_submissions(spark, path, 1000000).filter("error IS NULL").select("uid", "molecules", "sequences")


@query(
    "s2_k2_fasta_round_trip",
    X.with_sql(X.SQL_CHAINS) + "SELECT 'doc' || doc_id AS name, seq FROM chains WHERE seq <> ''",
)
def s2(spark, sf):
    path = scratch_path(spark, "s2")
    named = X.chains(spark, sf).filter("seq <> ''").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "seq")
    W.write_fasta(named, path)
    return R.read_fasta(spark, path)


@query(
    "s3_typed_fasta",
    X.with_sql(X.SQL_CHAINS)
    + """SELECT doc_id::VARCHAR AS chain_id, CASE doc_id % 3 WHEN 0 THEN 'PROTEIN' WHEN 1 THEN 'DNA' ELSE 'PEPTIDE' END AS entity_type,
      CASE doc_id % 3 WHEN 2 THEN 'unknown entity type' WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'alignment given for a non-protein' END END AS error,
      length(seq) AS n FROM chains WHERE seq <> ''""",
)
def s3(spark, sf):
    path = scratch_path(spark, "s3")
    d = F.col("doc_id")
    kind = F.when(d % 3 == 0, "protein").when(d % 3 == 1, "dna").otherwise("peptide")
    msa = F.when(d % 2 == 0, "|m.a3m").otherwise("")
    name = F.concat(d.cast("string"), F.lit("|"), kind, msa)
    W.write_fasta(X.chains(spark, sf).filter("seq <> ''").select(name.alias("name"), "seq"), path)
    rows = R.read_typed_fasta(spark, path, strict=False)
    return rows.select("chain_id", "entity_type", "error", F.length("seq").alias("n"))


def _alignment_lines(spark, sf):
    """Rows of one alignment per label, with insertions and copies."""
    cut = (F.col("seq_idx") % 5).cast("int")
    copies = F.when(F.col("seq_idx") % 7 == 0, F.lit("A" * 64)).otherwise(F.col("row"))
    line = F.concat(F.lower(F.replace(F.substring(copies, F.lit(1), cut), F.lit("-"), F.lit("g"))), F.substring(copies, cut + 1, F.lit(64)))
    return msa(spark, sf).select("msa_id", "seq_idx", line.alias("line"))


_ALIGN_SQL = """, li AS (SELECT msa_id, seq_idx, lower(replace(substr(c, 1, seq_idx % 5), '-', 'g')) || substr(c, seq_idx % 5 + 1) AS line
      FROM (SELECT *, CASE WHEN seq_idx % 7 = 0 THEN repeat('A', 64) ELSE row END AS c FROM msa)),
    fi AS (SELECT msa_id, upper(replace(line, '-', '')) AS u, min(seq_idx) AS seq_idx, min_by(line, seq_idx) AS line FROM li GROUP BY ALL)
    """


@query(
    "s4_a3m",
    "WITH "
    + _MSA_SQL
    + _ALIGN_SQL
    + """SELECT msa_id::VARCHAR AS msa, CASE WHEN seq_idx % 4 = 0 THEN seq_idx % 10 ELSE -1 END AS taxonomy,
      regexp_replace(line, '[a-z]', '', 'g') AS residues, length(line) - length(regexp_replace(line, '[a-z]', '', 'g')) AS inserted FROM fi""",
)
def s4(spark, sf):
    """One file per alignment; the file order decides which copy stays."""
    path = scratch_path(spark, "s4")
    head = F.when(F.col("seq_idx") % 4 == 0, F.concat(F.lit(">UniRef100_T"), (F.col("seq_idx") % 10).cast("string"), F.lit(" x"))).otherwise(
        F.concat(F.lit(">other_"), F.col("seq_idx").cast("string"))
    )
    lines = _alignment_lines(spark, sf).select("msa_id", "seq_idx", F.concat(head, F.lit("\n"), F.col("line"), F.lit("\n")).alias("value"))
    ordered = lines.repartition("msa_id").sortWithinPartitions("msa_id", "seq_idx")
    ordered.select("msa_id", "value").write.partitionBy("msa_id").text(path)
    taxonomy = spark.range(10).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("uniref_id"), F.col("id").alias("taxonomy_id"))
    rows = R.read_a3m(spark, path, taxonomy)
    return rows.select(
        F.regexp_extract("msa_id", r"msa_id=(\d+)", 1).alias("msa"),
        "taxonomy",
        "residues",
        F.aggregate("deletions", F.lit(0), lambda acc, d: acc + d["deletion"]).alias("inserted"),
    )


@query(
    "s5_k7_msa_csv",
    "WITH "
    + _MSA_SQL
    + _ALIGN_SQL
    + """SELECT msa_id::VARCHAR AS msa, seq_idx % 3 - 1 AS taxonomy, regexp_replace(line, '[a-z]', '', 'g') AS residues FROM fi""",
)
def s5(spark, sf):
    path = scratch_path(spark, "s5")
    rows = _alignment_lines(spark, sf).select(
        "msa_id", F.col("seq_idx").alias("idx"), (F.col("seq_idx") % 3 - 1).alias("key"), F.col("line").alias("sequence")
    )
    W.write_msa_csv(rows, path)
    back = R.read_msa_csv(spark, f"{path}/*/*.csv")
    return back.select(F.regexp_extract("msa_id", r"msa_id=(\d+)", 1).alias("msa"), "taxonomy", "residues")


@query(
    "s6_archive_round_trip",
    """SELECT sha256(text) AS key, max(doc_id) AS seq_no FROM documents WHERE lang = 'en' GROUP BY ALL""",
)
def s6(spark, sf):
    """Two batches appended per language; one language read back, the last row per key winning."""
    root = scratch_path(spark, "s6")
    docs = X.table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("key"), F.col("doc_id").alias("seq_no"), F.col("lang").alias("target")
    )
    middle = docs.agg(F.avg("seq_no")).first()[0]
    W.append_archive(docs.filter(F.col("seq_no") <= middle), root, "nanobody", 0)
    W.append_archive(docs.filter(F.col("seq_no") > middle), root, "nanobody", 1)
    assert R.read_archive(spark, root, "no such target", "nanobody", "key") is None
    return R.read_archive(spark, root, "en", "nanobody", "key").select("key", "seq_no")


@query(
    "s7_prediction_json",
    """SELECT concat('r', o_orderstatus, o_orderpriority[1:1]) AS record, 'm' || o_custkey % 7 AS metric,
      max_by(o_totalprice, o_orderkey) AS value FROM orders GROUP BY ALL""",
)
def s7(spark, sf):
    """One folder of prediction files per order class; a later file wins for a metric."""
    root = scratch_path(spark, "s7")
    orders = X.table(spark, sf, "orders").select(
        F.concat(F.lit("r"), "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("record"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 7).cast("string")).alias("k"),
        "o_orderkey",
        "o_totalprice",
    )
    best = orders.groupBy("record", "k").agg(F.max_by("o_totalprice", "o_orderkey").alias("v"))
    # seven metric names per record
    maps = best.groupBy("record").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value"))
    maps.repartition("record").write.partitionBy("record").text(root)
    back = R.read_prediction_json(spark, root, file_glob="part-*")
    flat = back.select("record", F.explode("metrics").alias("metric", "value"))
    return flat.withColumn("record", F.regexp_extract("record", r"record=(\w+)", 1))


@query(
    "s8_k5_metrics_csv",
    """SELECT l_orderkey::VARCHAR AS item, l_linenumber::VARCHAR AS target, round(max(l_tax / 3), 5) AS m1 FROM lineitem GROUP BY ALL""",
)
def s8(spark, sf):
    path = scratch_path(spark, "s8")
    rows = X.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_tax") / 3).alias("m1"))
    name = F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.lit("x"))
    W.write_metrics_csv(rows.select(name.alias("id"), "m1"), path)
    return R.read_metrics_csv(spark, path, ["m1"])


@query("s9_reaction_count", "SELECT CAST(count(*) AS INT) AS n FROM nation")
def s9(spark, sf):
    return R.reaction_count(X.table(spark, sf, "nation"))


@query(
    "s10_k6_manifest",
    """SELECT o_orderkey AS id, o_orderstatus AS method, count(*) FILTER (l_returnflag <> 'N') AS valid_chains FROM orders
      JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
)
def s10(spark, sf):
    """Records with their chains, at most the lines of one order, written and read as JSON."""
    path = scratch_path(spark, "s10")
    lines = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber").alias("chain_id"), (F.col("l_returnflag") != "N").alias("valid")).alias("c")
    )
    orders = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("method")).alias("structure"))
    records = orders.join(lines.groupBy("id").agg(F.collect_list("c").alias("chains")), "id")
    W.write_manifest(records, path)
    back, _ = R.read_manifest(spark, path, "id bigint, structure struct<method:string>, chains array<struct<chain_id:int,valid:boolean>>")
    good = F.size(F.filter("chains", lambda c: c["valid"])).cast("bigint")
    return back.select("id", F.col("structure.method").alias("method"), good.alias("valid_chains"))


@query("s11_list_inputs", "SELECT DISTINCT lang || '-' || source AS folder, true AS fits FROM documents")
def s11(spark, sf):
    """Documents written by language and source, found again by listing the files alone."""
    path = scratch_path(spark, "s11")
    folder = F.concat_ws("-", "lang", "source").alias("folder")
    X.table(spark, sf, "documents").select(folder, "doc_id").repartition(folder).write.partitionBy("folder").json(path)
    files = R.list_inputs(spark, path, "*.json", 10**9)
    return files.select(F.regexp_extract("path", "folder=([^/]*)/", 1).alias("folder"), "fits").distinct()


@query("s12_cluster_tsv", "SELECT lang || source AS rep, doc_id::VARCHAR AS member FROM documents")
def s12(spark, sf):
    path = scratch_path(spark, "s12")
    rows = X.table(spark, sf, "documents").select(F.concat("lang", "source").alias("rep"), F.col("doc_id").cast("string").alias("member"))
    rows.write.option("sep", "\t").csv(path)
    return R.read_cluster_tsv(spark, path)


@query(
    "s13_protein_lookup",
    X.with_sql(X.SQL_CHAINS)
    + """SELECT p_partkey AS code, substr(coalesce(a.seq, b.seq), 31, 182) AS seq FROM part LEFT JOIN (SELECT * FROM chains WHERE doc_id % 2 = 0) a
      ON p_partkey = a.doc_id LEFT JOIN (SELECT doc_id, reverse(seq) AS seq FROM chains) b ON p_partkey = b.doc_id""",
)
def s13(spark, sf):
    codes = X.table(spark, sf, "part").select(F.col("p_partkey").alias("code"))
    chains = X.chains(spark, sf).withColumnRenamed("doc_id", "code")
    fallback = chains.select("code", F.reverse("seq").alias("seq"))
    return R.protein_lookup(codes, chains.filter("code % 2 = 0"), fallback, 30, 212)


@query(
    "k3_epoch_report",
    """WITH m AS (SELECT o_custkey AS uid, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
    a AS (SELECT o_custkey AS uid, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
    SELECT c_custkey AS uid, c_custkey - 100 AS blocks_elapsed, coalesce(m.n, 0) AS molecules, coalesce(a.n, 0) AS nanobodies, CASE WHEN c_acctbal < 0
      THEN -999.99 ELSE c_acctbal END AS molecule_final_score FROM customer LEFT JOIN m ON c_custkey = m.uid LEFT JOIN a ON c_custkey = a.uid
      WHERE m.n IS NOT NULL OR a.n IS NOT NULL""",
)
def k3(spark, sf):
    """Reports as nested documents; a customer's orders are the items of a submission."""
    key = F.col("c_custkey")
    submissions = X.table(spark, sf, "customer").select(
        key.alias("uid"),
        F.col("c_name").alias("hotkey"),
        key.alias("block_submitted"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("molecule_final_score"),
        F.lit(0.0).alias("nanobody_final_score"),
    )
    orders = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("item"), "o_totalprice", "o_orderstatus")
    items = lambda s: orders.filter(F.col("o_orderstatus") == s).drop("o_orderstatus")
    report = W.epoch_report(submissions, items("F"), items("O"), 100, {"num_molecules": "1", "num_sequences": "1"})
    text = W.json_safe(F.col("document"))
    back = F.from_json(text, report.schema["document"].dataType.json())
    n = lambda c: F.coalesce(F.size(F.col(f"d.{c}")), F.lit(0)).cast("bigint").alias(c)
    none = lambda c: F.when(F.col(f"d.{c}").isNull(), F.lit(0).cast("bigint")).otherwise(n(c)).alias(c)
    parsed = report.select("uid", back.alias("d"))
    return parsed.select("uid", "d.blocks_elapsed", none("molecules"), none("nanobodies"), "d.molecule_final_score")


@query(
    "k4_json_safe",
    """SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)
def k4(spark, sf):
    """Nested columns to JSON text and back."""
    events = X.table(spark, sf, "events")
    nested = F.struct("event_type", F.from_json("props", "k bigint").alias("props"))
    text = events.select("event_id", W.json_safe(nested).alias("j"))
    back = F.from_json("j", "event_type string, props struct<k:bigint>")
    return text.select("event_id", back.alias("b")).select("event_id", "b.event_type", "b.props.k")


# structure tables --------------------------------------------------------------------

_STRUCT_SQL = """ch AS (SELECT structure_id, chain_id, chain_id % 2 AS entity_id, NOT ((structure_id + chain_id) % 4 = 0) AS valid FROM atoms GROUP BY ALL),
    nc AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY chain_id) - 1 AS nc,
      row_number() OVER (PARTITION BY structure_id, entity_id ORDER BY chain_id) - 1 AS sym FROM ch WHERE valid),
    na AS (SELECT a.*, nc, row_number() OVER (PARTITION BY a.structure_id ORDER BY nc, atom_idx) - 1 AS nat,
      dense_rank() OVER (PARTITION BY a.structure_id ORDER BY nc, res_idx) - 1 AS nres FROM atoms a JOIN nc USING (structure_id, chain_id))"""


def structure(spark, sf):
    """Chains start at whole residues here: 12 atoms, 4 residues each."""
    atoms = X.atoms(spark, sf).select("structure_id", "atom_idx", "chain_id", "res_idx", "x", "y", "z", "element")
    chain = F.col("chain_id")
    chains = atoms.select("structure_id", "chain_id").distinct().select(
        "structure_id", "chain_id", (chain % 2).alias("entity_id"), ((F.col("structure_id") + chain) % 4 != 0).alias("valid")
    )
    residues = atoms.select("structure_id", "chain_id", "res_idx").distinct()
    i = F.col("atom_idx")
    bonds = atoms.filter("atom_idx < 40").select("structure_id", i.alias("atom_1"), (i + 10).alias("atom_2"))
    return {"atoms": atoms, "chains": chains, "residues": residues, "bonds": bonds}


@query(
    "g11_drop_invalid_chains",
    X.with_sql(X.SQL_ATOMS, _STRUCT_SQL)
    + """SELECT 'atom' AS kind, structure_id, nat AS a, nc AS b, nres AS c FROM na UNION ALL
    SELECT 'chain', structure_id, nc, sym, entity_id FROM nc UNION ALL
    SELECT 'bond', x.structure_id, x.nat, y.nat, 0 FROM na x JOIN na y ON x.structure_id = y.structure_id AND y.atom_idx = x.atom_idx + 10
      WHERE x.atom_idx < 40""",
)
def g11(spark, sf):
    out = U.drop_invalid_chains(structure(spark, sf))
    zero = F.lit(0).cast("bigint")
    row = lambda df, kind, a, b, c: df.select(
        F.lit(kind).alias("kind"), "structure_id", F.col(a).alias("a"), F.col(b).alias("b"), c.alias("c")
    )
    return (
        row(out["atoms"], "atom", "atom_idx", "chain_id", F.col("res_idx"))
        .unionByName(row(out["chains"], "chain", "chain_id", "sym_id", F.col("entity_id")))
        .unionByName(row(out["bonds"], "bond", "atom_1", "atom_2", zero))
    )


@query(
    "g12_extract_and_concatenate",
    X.with_sql(X.SQL_ATOMS)
    + """, k AS (SELECT structure_id, atom_idx, chain_id, res_idx, row_number() OVER (PARTITION BY structure_id ORDER BY atom_idx) - 1 AS n FROM atoms WHERE element = 'C'),
    s AS (SELECT structure_id, count(*) AS n, max(chain_id) + 1 AS c FROM k GROUP BY ALL),
    b AS (SELECT x.structure_id, x.n AS a1, y.n AS a2 FROM k x JOIN k y ON x.structure_id = y.structure_id AND y.atom_idx = x.atom_idx + 10 WHERE x.atom_idx < 40)
    SELECT 'atom' AS kind, structure_id, n AS a, chain_id AS b FROM k UNION ALL
    SELECT 'atom', structure_id, k.n + s.n, chain_id + c FROM k JOIN s USING (structure_id) UNION ALL
    SELECT 'bond', structure_id, a1, a2 FROM b UNION ALL SELECT 'bond', structure_id, a1 + n, a2 + n FROM b JOIN s USING (structure_id)""",
)
def g12(spark, sf):
    """Carbon atoms extracted, then the result appended to itself."""
    tables = structure(spark, sf)
    part = U.extract_atoms(tables, tables["atoms"].filter("element = 'C'"))
    both = U.concatenate(part, part)
    atoms = both["atoms"].select(F.lit("atom").alias("kind"), "structure_id", F.col("atom_idx").alias("a"), F.col("chain_id").alias("b"))
    bonds = both["bonds"].select(F.lit("bond").alias("kind"), "structure_id", F.col("atom_1").alias("a"), F.col("atom_2").alias("b"))
    return atoms.unionByName(bonds)


@query(
    "g13_token_table",
    X.with_sql(X.SQL_ATOMS)
    + """, r AS (SELECT structure_id, chain_id, res_idx, min(atom_idx) AS a, count(*) AS n, res_idx % 3 <> 0 AS std FROM atoms
        WHERE (structure_id + chain_id) % 4 <> 0 GROUP BY ALL),
    t AS (SELECT structure_id, chain_id, res_idx, a AS atom_idx, n AS atom_num, a AS center FROM r WHERE std UNION ALL
      SELECT r.structure_id, r.chain_id, r.res_idx, x.atom_idx, 1, x.atom_idx FROM r JOIN atoms x ON r.structure_id = x.structure_id AND r.res_idx = x.res_idx
      WHERE NOT std)
    SELECT t.structure_id, row_number() OVER (PARTITION BY t.structure_id ORDER BY t.chain_id, t.atom_idx) - 1 AS token_idx, t.atom_idx, atom_num,
      x.element = 'C' AS resolved FROM t JOIN atoms x ON t.structure_id = x.structure_id AND t.center = x.atom_idx""",
)
def g13(spark, sf):
    tables = structure(spark, sf)
    atoms = tables["atoms"].withColumn("is_present", F.col("element") == "C")
    residues = atoms.groupBy("structure_id", "chain_id", "res_idx").agg(F.min("atom_idx").alias("center_idx"))
    residues = residues.withColumns({"is_standard": F.col("res_idx") % 3 != 0, "is_present": F.lit(True)})
    tokens = U.token_table(residues, atoms, tables["chains"])
    return tokens.select("structure_id", "token_idx", "atom_idx", "atom_num", "resolved")


@query(
    "g13_token_bonds",
    X.with_sql(X.SQL_ATOMS)
    + """SELECT structure_id, a.res_idx AS token_1, b.res_idx AS token_2 FROM atoms a JOIN atoms b USING (structure_id)
      WHERE b.atom_idx = a.atom_idx + 10 AND a.atom_idx < 40""",
)
def g13_bonds(spark, sf):
    tables = structure(spark, sf)
    tokens = tables["atoms"].groupBy("structure_id", F.col("res_idx").alias("token_idx")).agg(
        F.min("atom_idx").alias("atom_idx"), F.count(F.lit(1)).alias("atom_num")
    )
    return U.token_bonds(tokens, [tables["bonds"]])


@query(
    "f28_region_alignment",
    """WITH r AS (SELECT DISTINCT o_custkey AS chain, o_orderkey % 13 + 105 AS n, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'A' END AS i FROM orders),
    u AS (SELECT DISTINCT n, i FROM r), c AS (SELECT DISTINCT chain FROM r)
    SELECT chain, string_agg(CASE WHEN r.n IS NULL THEN '-' ELSE substr('ACDEFGHIKLMNP', r.n - 104, 1) END, '' ORDER BY u.n, u.i) AS row
    FROM c CROSS JOIN u LEFT JOIN r USING (chain, n, i) GROUP BY chain""",
)
def f28(spark, sf):
    n = F.col("o_orderkey") % 13 + 105
    pos = F.concat(F.lit("H"), n.cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("A"))
    aa = F.substring(F.lit("ACDEFGHIKLMNP"), (n - 104).cast("int"), F.lit(1))
    regions = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("chain"), pos.alias("pos"), aa.alias("aa")).distinct()
    return U.region_alignment(regions)


@query(
    "x7_map_with_errors",
    """SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN length(text) END AS n, CASE WHEN doc_id % 50 = 0 THEN 'ValueError: bad' END AS error FROM documents
""",
)
def x7(spark, sf):
    def work(pdf):
        if (pdf["doc_id"] % 50 == 0).any():
            raise ValueError("bad")
        return pdf.assign(n=pdf["text"].str.len())[["doc_id", "n"]]

    return U.map_with_errors(X.documents(spark, sf), work, "doc_id long, n long", ["doc_id"])
