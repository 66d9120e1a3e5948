"""Queries over evaluation rollups, records, splits and alignment statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegrid.functions import sequences as S
from sievegrid.operators import aggregates as A
from sievegrid.operators import gates as G
from sievegrid.operators import joins as J
from sievegrid.plans import fixtures as X
from sievegrid.plans.queries_sampling import sql_u
from sievegrid.plans.registry import query
from sievegrid.session import unnest


@query(
    "a6_per_target_mean",
    """SELECT event_type AS target, round(avg(value), 5) AS value, round(avg(user_id), 5) AS user_id FROM events GROUP BY ALL""",
)
def a6(spark, sf):
    from sievegrid.functions.scoring import target_of_design

    name = F.concat(F.lit("rank1_"), F.col("event_type"), F.lit("_"), F.col("event_id").cast("string"))
    events = X.table(spark, sf, "events")
    return A.per_target_mean(events, target_of_design(name), ["value", "user_id"])


_HITS_SQL = """hits AS (SELECT l_partkey AS query, l_suppkey AS target, l_discount AS qtmscore, l_tax AS ttmscore FROM lineitem)"""


def hits(spark, sf):
    return X.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("query"),
        F.col("l_suppkey").alias("target"),
        F.col("l_discount").alias("qtmscore"),
        F.col("l_tax").alias("ttmscore"),
    )


@query(
    "c3_novelty",
    f"""WITH {_HITS_SQL}, b AS (SELECT query, max((qtmscore + ttmscore) / 2) AS n FROM hits WHERE qtmscore >= 0.1 GROUP BY query)
    SELECT p_partkey AS query, round(coalesce(n, 0.0), 9) AS novelty FROM part LEFT JOIN b ON p_partkey = query""",
)
def c3(spark, sf):
    best = A.novelty(hits(spark, sf).filter("qtmscore >= 0.1"))
    queries = X.table(spark, sf, "part").select(F.col("p_partkey").alias("query"))
    out = J.reindex(queries, best, "query", "novelty")
    return out.withColumn("novelty", F.round("novelty", 9))


@query(
    "a7_per_target_novelty",
    f"""WITH {_HITS_SQL}, b AS (SELECT query, max((qtmscore + ttmscore) / 2) AS n FROM hits GROUP BY query),
    t AS (SELECT p_brand AS target, avg(n) AS n FROM b JOIN part ON query = p_partkey GROUP BY p_brand)
    SELECT round(avg(n), 9) AS mean_novelty, round(median(n), 9) AS median_novelty FROM t""",
)
def a7(spark, sf):
    best = A.novelty(hits(spark, sf))
    part = X.table(spark, sf, "part").select(F.col("p_partkey").alias("query"), F.col("p_brand").alias("target"))
    per_target = best.join(part, "query").groupBy("target").agg(F.avg("novelty").alias("n"))
    median = A.exact_median(per_target, "n", "target").scalar()
    mean = per_target.agg(F.round(F.avg("n"), 9).alias("mean_novelty"))
    return mean.withColumn("median_novelty", F.round(median, 9))


@query(
    "a8_best_of_samples",
    """SELECT l_returnflag AS tool, l_partkey AS target, max(l_discount) AS oracle, round(avg(l_discount), 9) AS average,
      max_by(l_discount, (l_quantity, -l_orderkey)) AS top1 FROM lineitem GROUP BY ALL""",
)
def a8(spark, sf):
    rows = X.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("tool"), F.col("l_partkey").alias("target"), "l_discount", "l_quantity", "l_orderkey"
    )
    out = A.best_of_samples(rows, ["tool", "target"], "l_discount", "l_quantity", "l_orderkey")
    return out.withColumn("average", F.round("average", 9))


@query(
    "a9_fraction_over",
    """SELECT label, round(sum(len(list_filter(embedding, lambda x: x > 0.1::FLOAT))) / sum(64 + 2), 9) AS fraction,
      CAST(sum(66) AS BIGINT) AS n_values FROM embeddings GROUP BY label""",
)
def a9(spark, sf):
    e = X.table(spark, sf, "embeddings")
    threshold = F.lit(0.1).cast("float")
    out = A.fraction_over(e, ["label"], F.col("embedding"), 0.1, True, F.lit(2), 0.0)
    del threshold
    return out.withColumn("fraction", F.round("fraction", 9))


_EVAL_SQL = """ev AS (SELECT l_returnflag AS tool, l_suppkey AS target, round(avg(l_discount), 9) AS value FROM lineitem GROUP BY ALL)"""


@query(
    "a10_bootstrap_ci",
    f"""WITH {_EVAL_SQL}, d AS (SELECT tool, rep, value, {sql_u('0', 'tool', 'rep', 'target')} AS u FROM ev, (SELECT range AS rep FROM range(1000))),
    w AS (SELECT tool, rep, value, {' + '.join(f'CAST(u >= {c!r} AS INT)' for c in A.POISSON_STEPS)} AS w FROM d),
    m AS (SELECT tool, rep, sum(w * value) / sum(w) AS m FROM w GROUP BY ALL HAVING sum(w) > 0),
    g AS (SELECT tool, avg(value) AS mean FROM ev GROUP BY tool)
    SELECT tool, round(any_value(mean), 8) AS mean, round(quantile_cont(m, 0.025), 8) AS lower,
      round(quantile_cont(m, 0.975), 8) AS upper FROM m JOIN g USING (tool) GROUP BY tool""",
)
def a10(spark, sf):
    values = (
        X.table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("tool"), F.col("l_suppkey").alias("target"))
        .agg(F.round(F.avg("l_discount"), 9).alias("value"))
    )
    out = A.bootstrap_ci(values, ["tool"], "value", "target")
    return out.select("tool", *[F.round(c, 8).alias(c) for c in ("mean", "lower", "upper")])


@query(
    "a11_validity_rollup",
    """SELECT l_returnflag AS tool, l_partkey AS target, max(CASE WHEN l_linenumber = 1 THEN CAST(l_tax > 0.04 AS INT) END) AS top1,
      max(CAST(l_tax > 0.04 AS INT)) AS oracle FROM lineitem GROUP BY ALL""",
)
def a11(spark, sf):
    rows = X.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("tool"),
        F.col("l_partkey").alias("target"),
        (F.col("l_linenumber") - 1).alias("sample"),
        (F.col("l_tax") > 0.04).alias("valid"),
    )
    return A.validity_rollup(rows, ["tool", "target"], "sample", "valid")


@query(
    "a12_class_metrics",
    """WITH c AS (SELECT source, quality + 2 * toxic AS pred, CASE WHEN labels.doc_id % 4 = 0 THEN 0 ELSE quality + 1 END AS truth
      FROM labels JOIN documents USING (doc_id)),
    n AS (SELECT source, """
    + ", ".join(
        f"count(*) FILTER (pred = {i} AND truth = {i}) AS tp{i}, count(*) FILTER (pred = {i} AND truth NOT IN (0, {i})) AS fp{i}, "
        f"count(*) FILTER (pred <> {i} AND truth = {i}) AS fn{i}"
        for i in (1, 2)
    )
    + """, count(*) FILTER (truth <> 0) AS c FROM c GROUP BY source)
    SELECT source, """
    + ", ".join(
        f"round(tp{i} / nullif(tp{i} + fp{i}, 0), 9) AS precision_{n}, round(tp{i} / nullif(tp{i} + fn{i}, 0), 9) AS recall_{n}, "
        f"round(tp{i} / nullif(tp{i} + fp{i} + fn{i}, 0), 9) AS accuracy_{n}"
        for i, n in ((1, "loop"), (2, "helix"))
    )
    + ", round((tp1 + tp2) / nullif(c, 0), 9) AS accuracy_overall FROM n",
)
def a12(spark, sf):
    from sievegrid.functions.scoring import nan_to_null

    docs = X.table(spark, sf, "documents").select("doc_id", "source")
    rows = X.table(spark, sf, "labels").join(docs, "doc_id").select(
        "source",
        (F.col("quality") + 2 * F.col("toxic")).alias("pred"),
        F.when(F.col("doc_id") % 4 == 0, 0).otherwise(F.col("quality") + 1).alias("truth"),
    )
    out = A.class_metrics(rows, ["source"], "pred", "truth", {1: "loop", 2: "helix"})
    return out.select("source", *[F.round(nan_to_null(F.col(c)), 9).alias(c) for c in out.columns[1:]])


# alignment rows: one letter per embedding dimension, gaps included
_MSA_LETTERS = "ACDEFGHIKLMNPQRSTVWY-"
_MSA_SQL = f"""msa AS (SELECT label AS msa_id, vec_id AS seq_idx, array_to_string(list_transform(embedding,
      lambda x: substr('{_MSA_LETTERS}', 1 + CAST(floor(abs(x::DOUBLE) * 100) AS INT) % 21, 1)), '') AS row FROM embeddings)"""


def msa(spark, sf):
    e = X.table(spark, sf, "embeddings")
    letter = lambda x: F.substring(
        F.lit(_MSA_LETTERS), (1 + F.floor(F.abs(x.cast("double")) * 100) % 21).cast("int"), F.lit(1)
    )
    row = F.array_join(F.transform("embedding", letter), "")
    return e.select(F.col("label").alias("msa_id"), F.col("vec_id").alias("seq_idx"), row.alias("row"))


_COUNTS_SQL = (
    f"""WITH {_MSA_SQL}, l AS (SELECT msa_id, unnest(range(64)) AS position, unnest(string_split(row, '')) AS c FROM msa),
    n AS (SELECT msa_id, position, """
    + ", ".join(f'count(*) FILTER (c = \'{a}\') AS "{a}"' for a in S.AMINO_ACIDS)
    + " FROM l GROUP BY ALL)\n"
)


@query("a15_position_counts", _COUNTS_SQL + "SELECT * FROM n")
def a15(spark, sf):
    return A.position_counts(msa(spark, sf), ["msa_id"], "row", S.AMINO_ACIDS)


_TOTAL_SQL = " + ".join(f'"{a}"' for a in S.AMINO_ACIDS)
_H_SQL = " + ".join(
    f'CASE WHEN "{a}" > 0 THEN -("{a}" / total) * log2("{a}" / total) ELSE 0 END' for a in S.AMINO_ACIDS
)


@query(
    "a16_logo_information",
    _COUNTS_SQL
    + f""", t AS (SELECT *, {_TOTAL_SQL} AS total FROM n), h AS (SELECT *, log2(20) - ({_H_SQL}) AS info FROM t)
    SELECT msa_id, position, round(info, 8) AS information, """
    + ", ".join(f'round("{a}" / total * info, 8) AS "height_{a}"' for a in S.AMINO_ACIDS)
    + " FROM h",
)
def a16(spark, sf):
    counts = A.position_counts(msa(spark, sf), ["msa_id"], "row", S.AMINO_ACIDS)
    out = A.logo_information(counts, ["msa_id", "position"], S.AMINO_ACIDS)
    return out.select("msa_id", "position", *[F.round(c, 8).alias(c) for c in out.columns[2:]])


@query(
    "a18_histogram",
    """WITH s AS (SELECT l_returnflag AS target, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
      round(avg(l_extendedprice), 5) AS mean FROM lineitem GROUP BY ALL)
    SELECT target, least(CAST(floor((l_extendedprice - low) / (high - low) * 50) AS INT), 49) AS bin, count(*) AS n, low, high, mean
    FROM lineitem JOIN s ON l_returnflag = target GROUP BY ALL""",
)
def a18(spark, sf):
    lines = X.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "target")
    out = A.histogram(lines, ["target"], "l_extendedprice", 50)
    return out.withColumn("mean", F.round("mean", 5))


@query(
    "a18_histogram_global",
    """WITH s AS (SELECT min(value) AS low, max(value) AS high, round(avg(value), 5) AS mean FROM events)
    SELECT least(CAST(floor((value - low) / (high - low) * 30) AS INT), 29) AS bin, count(*) AS n, low, high, mean
    FROM events, s GROUP BY ALL""",
)
def a18_global(spark, sf):
    out = A.histogram(X.table(spark, sf, "events"), [], "value", 30)
    return out.withColumn("mean", F.round("mean", 5))


@query(
    "a21_distinct_clusters",
    "SELECT count(DISTINCT lang || source) AS n_clusters, count(*) AS n_members FROM documents",
)
def a21(spark, sf):
    docs = X.table(spark, sf, "documents")
    return docs.agg(
        F.count_distinct(F.concat("lang", "source")).alias("n_clusters"),
        F.count(F.lit(1)).alias("n_members"),
    )


@query("a23_vendi")
def a23(spark, sf):
    e = X.table(spark, sf, "embeddings")
    return A.vendi(e, "label", "embedding", 64).withColumn("vendi", F.round("vendi", 6))


@query(
    "a24_physical_validity",
    """SELECT l_orderkey, l_linenumber, CAST(l_discount > 0.08 AS INT) + CAST(l_tax > 0.07 AS INT) AS num_clashes,
      CAST(l_quantity > 45 AS INT) AS num_violations, l_discount <= 0.08 AND l_tax <= 0.07 AND l_quantity <= 45 AS valid FROM lineitem""",
)
def a24(spark, sf):
    lines = X.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_discount") > 0.08).cast("int").alias("c1"),
        (F.col("l_tax") > 0.07).cast("int").alias("c2"),
        (F.col("l_quantity") > 45).cast("int").alias("v1"),
    )
    return A.physical_validity(lines, ["c1", "c2"], ["v1"]).drop("c1", "c2", "v1")


# records, splits, common targets ----------------------------------------------------


@query(
    "p17_record_filters",
    """WITH c AS (SELECT l_orderkey AS record, count(*) AS n, count(*) FILTER (l_returnflag <> 'N') AS ok,
      sum(l_quantity) AS residues, max(l_tax) AS resolution FROM lineitem GROUP BY ALL)
    SELECT o_orderkey AS record FROM orders JOIN c ON o_orderkey = record
    WHERE CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END <= DATE '2001-06-01'
      AND n <= 6 AND ok >= 1 AND residues BETWEEN 20 AND 200 AND resolution <= 0.07""",
)
def p17(spark, sf):
    lines = X.table(spark, sf, "lineitem")
    chains = lines.groupBy(F.col("l_orderkey").alias("record")).agg(
        F.count(F.lit(1)).alias("num_chains"),
        F.count_if(F.col("l_returnflag") != "N").alias("valid_chains"),
        F.sum("l_quantity").alias("residues"),
        F.max("l_tax").alias("resolution"),
    )
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = X.table(spark, sf, "orders").select(
        key.alias("record"),
        F.when(key % 3 == 0, "").otherwise(day).alias("released"),
        F.when(key % 5 == 0, "").otherwise(day).alias("deposited"),
    )
    date = G.record_date(F.lit(""), F.col("released"), F.col("deposited"), "revised")
    rules = [
        date <= F.lit("2001-06-01").cast("date"),
        F.col("num_chains") <= 6,
        F.col("valid_chains") >= 1,
        F.col("residues").between(20, 200),
        F.col("resolution") <= 0.07,
    ]
    return orders.join(chains, "record").filter(G.all_of(rules)).select("record")


@query(
    "j17_train_val_split",
    """SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'val' ELSE 'train' END AS part
    FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR o_totalprice > 50000""",
)
def j17(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    records = orders.withColumn("id", F.concat(F.lit("REC"), F.col("o_custkey").cast("string")))
    listed = X.table(spark, sf, "customer").filter("c_acctbal < 0")
    split = listed.select(F.concat(F.lit("rec"), F.col("c_custkey").cast("string")).alias("id"))
    train, val = J.train_val_split(records, split, "id", [F.col("o_totalprice") > 50000])
    tagged = train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))
    return tagged.select("o_orderkey", "part")


@query(
    "j24_cluster_lookup",
    """SELECT l_orderkey, l_linenumber, coalesce(p_size, -1) AS cluster_id FROM lineitem
      LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey""",
)
def j24(spark, sf):
    chains = X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit("PDB").alias("record"), F.col("l_partkey").alias("entity")
    )
    clusters = X.table(spark, sf, "part").filter("p_size > 5").select(
        F.concat(F.lit("pdb_"), F.col("p_partkey").cast("string")).alias("chain_key"),
        F.col("p_size").alias("cluster_id"),
    )
    return J.cluster_lookup(chains, clusters).select("l_orderkey", "l_linenumber", "cluster_id")


@query(
    "j25_common_targets",
    """WITH s AS (SELECT l_partkey AS target, l_linestatus AS metric, l_returnflag AS tool, count(*) AS n FROM lineitem
      WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 5) AND l_returnflag IN ('A', 'R') GROUP BY ALL)
    SELECT target, metric, min(n) AS n_values FROM s GROUP BY ALL HAVING count(*) = 2 AND min(n) = max(n)""",
)
def j25(spark, sf):
    rows = X.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("target"), F.col("l_linestatus").alias("metric"), F.col("l_returnflag").alias("tool")
    )
    excluded = X.table(spark, sf, "part").filter("p_size < 5").select(F.col("p_partkey").alias("target"))
    return J.common_targets(rows, ["A", "R"], excluded)


@query(
    "u3_target_intersection",
    "SELECT l_partkey AS target FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'",
)
def u3(spark, sf):
    lines = X.table(spark, sf, "lineitem")
    of = lambda f: lines.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("target"))
    return of("A").intersect(of("R"))


@query(
    "u4_target_difference",
    "SELECT p_partkey AS target FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax = 0)",
)
def u4(spark, sf):
    part = X.table(spark, sf, "part").select(F.col("p_partkey").alias("target"))
    out = X.table(spark, sf, "lineitem").filter("l_tax = 0").select(F.col("l_partkey").alias("target"))
    return part.join(out.distinct(), "target", "left_anti")


@query(
    "u1_merge_runs",
    """SELECT 'run1_' || l_orderkey AS id, sum(l_tax) > 0.1 AS flag, NULL::DOUBLE AS extra FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey
    UNION ALL SELECT 'run2_' || l_orderkey, NULL, max(l_discount) FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey""",
)
def u1(spark, sf):
    from sievegrid.operators.setops import merge_runs

    lines = X.table(spark, sf, "lineitem")
    text = F.col("l_orderkey").cast("string").alias("id")
    one = lines.filter("l_returnflag = 'A'").groupBy(text).agg((F.sum("l_tax") > 0.1).alias("flag"))
    two = lines.filter("l_returnflag = 'R'").groupBy(text).agg(F.max("l_discount").alias("extra"))
    return merge_runs({"run1": one, "run2": two}).drop("run_tag")


@query(
    "k1_append_dedup",
    """WITH d AS (SELECT doc_id, sha256(text) AS k, source FROM documents)
    SELECT k AS sequence_hash, max(doc_id) AS doc_id, max_by(source, doc_id) AS source FROM d GROUP BY k""",
)
def k1(spark, sf):
    docs = X.table(spark, sf, "documents").select(F.sha2("text", 256).alias("sequence_hash"), "doc_id", "source")
    return J.append_dedup(docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0"), ["sequence_hash"], "doc_id")


@query(
    "u7_cluster_union",
    X.with_sql(X.SQL_SEQUENCES)
    + """, k AS (SELECT DISTINCT seq, CASE WHEN regexp_full_match(seq, '[ACGTUN]*') THEN 'nucleotide' WHEN length(seq) < 10 THEN 'short'
      ELSE 'protein' END AS kind FROM sequences),
    p AS (SELECT sha256(seq) AS h, sha256(length(seq)::VARCHAR) AS c FROM k WHERE kind = 'protein')
    SELECT h AS member, c AS cluster FROM p UNION ALL SELECT sha256(seq), sha256(seq) FROM k WHERE kind <> 'protein'
    UNION ALL SELECT DISTINCT p_brand, p_brand FROM part""",
)
def u7(spark, sf):
    from sievegrid.operators.setops import cluster_union

    distinct = X.sequences(spark, sf).select("seq").distinct()
    kinds = distinct.withColumn("kind", S.sequence_kind(F.col("seq")))
    proteins = kinds.filter("kind = 'protein'").select(
        S.sequence_hash(F.col("seq")).alias("member"),
        S.sequence_hash(F.length("seq").cast("string")).alias("cluster"),
    )
    ligands = X.table(spark, sf, "part").select(F.col("p_brand").alias("code")).distinct()
    return cluster_union(proteins, kinds.filter("kind <> 'protein'").select("seq"), ligands)


@query(
    "a27_liability_details",
    X.with_sql(X.SQL_SEQUENCES)
    + r""", v AS (SELECT doc_id, pos, 'TrpOx' AS motif, 10 AS sev, unnest(list_filter(range(1, length(seq) + 1),
        lambda i: substr(seq, i, 1) = 'W')) AS p FROM sequences UNION ALL
      SELECT doc_id, pos, 'MetOx', 5, unnest(list_filter(range(1, length(seq) + 1), lambda i: substr(seq, i, 1) = 'M')) FROM sequences),
    g AS (SELECT doc_id, pos, motif, count(*) AS n, min(p) AS a, max(p) AS b, any_value(sev) AS s FROM v GROUP BY ALL)
    SELECT doc_id, pos, motif, n, CASE WHEN n = 1 THEN concat(motif, '(pos', a, ',sev', s, ')')
      ELSE concat(motif, 'x', n, '(pos', a, '-', b, ',sev', s, ')') END AS summary FROM g""",
)
def a27(spark, sf):
    from sievegrid.functions import liabilities as L

    found = L.liability_violations(F.col("seq"))
    wanted = F.filter(found, lambda v: v["motif"].isin("TrpOx", "MetOx"))
    flat = unnest(X.sequences(spark, sf), wanted, "v", "doc_id", "pos")
    flat = flat.select("doc_id", F.col("pos").alias("piece"), "v.*")
    out = L.liability_summary(flat, ["doc_id", "piece"])
    return out.select("doc_id", F.col("piece").alias("pos"), "motif", "n", "summary")


@query(
    "p27_atom_name_width",
    """SELECT l_orderkey AS mol_id, max(length(upper(p_brand[1:1]) || CAST(l_linenumber + l_partkey AS VARCHAR))) <= 4 AS ok
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
)
def p27(spark, sf):
    from sievegrid.operators.structures import atom_name_width_ok

    part = X.table(spark, sf, "part").select("p_partkey", F.substring("p_brand", 1, 1).alias("symbol"))
    lines = X.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    ranked = lines.select(
        F.col("l_orderkey").alias("mol_id"), "symbol", (F.col("l_linenumber") + F.col("l_partkey") - 1).alias("rank")
    )
    return atom_name_width_ok(ranked, "mol_id")
