"""Queries over rank aggregation, final ranks and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegrid.operators import ranking as R
from sievegrid.operators.ordering import RangeOrdered
from sievegrid.plans import fixtures as X
from sievegrid.plans.registry import query

METRICS = X.with_sql(X.SQL_METRICS)
MODES = {"m1": "max", "m2": "min", "m3": "max", "m4": "min"}
CATEGORIES = {"confidence": ["m1", "m2"], "physical": ["m3"], "developability": ["m4"]}


def _sql_dense(partition: str = "") -> str:
    parts = [
        f"dense_rank() OVER ({partition} ORDER BY {m} {'DESC' if d == 'max' else 'ASC'}) AS {m}_rank"
        for m, d in MODES.items()
    ]
    return ", ".join(parts)


_SQL_RANKED = METRICS + f", r AS (SELECT *, {_sql_dense()} FROM metrics)\n"


@query(
    "w1_rank_sum",
    _SQL_RANKED
    + """SELECT item, target, m1_rank + m2_rank + m3_rank + m4_rank AS rank_sum,
      greatest(m1_rank, m2_rank, m3_rank, m4_rank) AS worst_rank, m1_rank, m2_rank, m3_rank, m4_rank FROM r""",
)
def w1(spark, sf):
    return R.rank_sum(X.metrics(spark, sf), ["item", "target"], MODES)


@query(
    "w1_rank_sum_per_target",
    METRICS
    + f""", r AS (SELECT *, {_sql_dense('PARTITION BY target')} FROM metrics)
    SELECT item, target, m1_rank + m2_rank + m3_rank + m4_rank AS rank_sum FROM r""",
)
def w1_per_target(spark, sf):
    ranked = R.rank_sum(X.metrics(spark, sf), ["item"], MODES, by=["target"])
    return ranked.select("item", "target", "rank_sum")


@query(
    "w1_rank_sum_missing_metric",
    METRICS
    + """, holes AS (SELECT item, target, nullif(m3, 0.05) AS m3, m1 FROM metrics),
    r AS (SELECT *, CASE WHEN m3 IS NOT NULL THEN dense_rank() OVER (PARTITION BY m3 IS NULL ORDER BY m3 DESC) END AS a,
      dense_rank() OVER (ORDER BY m1 DESC) AS b FROM holes)
    SELECT item, target, coalesce(a, 0) + b AS rank_sum, greatest(coalesce(a, 0), b) AS worst_rank FROM r""",
)
def w1_missing(spark, sf):
    holes = X.metrics(spark, sf).withColumn("m3", F.nullif("m3", F.lit(0.05)))
    ranked = R.rank_sum(holes, ["item", "target"], {"m3": "max", "m1": "max"})
    return ranked.select("item", "target", "rank_sum", "worst_rank")


@query(
    "w2_category_rank_sum",
    _SQL_RANKED
    + """SELECT item, target, m1_rank + m2_rank AS confidence_rank_sum,
      greatest(m1_rank, m2_rank) AS confidence_worst_rank, m3_rank AS physical_rank_sum,
      m3_rank AS physical_worst_rank, m4_rank AS developability_rank_sum,
      m4_rank AS developability_worst_rank FROM r""",
)
def w2(spark, sf):
    ranked = R.rank_sum(X.metrics(spark, sf), ["item", "target"], MODES, categories=CATEGORIES)
    return ranked.select(
        "item", "target", *[f"{c}_{s}" for c in CATEGORIES for s in ("rank_sum", "worst_rank")]
    )


_DESIGNS_SQL = """designs AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, min(l_quantity) AS design_iiptm,
    min(l_extendedprice) AS design_ptm, min(l_discount) AS min_design_to_target_pae,
    min(l_tax) AS plip_hbonds_refolded, CAST(min(l_quantity * l_discount * 100) AS INT) AS liability_num_violations,
    min(l_shipdate) AS d
  FROM lineitem GROUP BY ALL)"""


def designs(spark, sf):
    lines = X.table(spark, sf, "lineitem")
    return lines.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(
        F.min("l_quantity").alias("design_iiptm"),
        F.min("l_extendedprice").alias("design_ptm"),
        F.min("l_discount").alias("min_design_to_target_pae"),
        F.min("l_tax").alias("plip_hbonds_refolded"),
        F.round(F.min(F.col("l_quantity") * F.col("l_discount") * 100))
        .cast("int")
        .alias("liability_num_violations"),
    )


_W3_WEIGHTS = {"design_iiptm": 1.0, "design_ptm": 2.0, "min_design_to_target_pae": 1.0}


@query(
    "w3_minmax_weighted_rank",
    X.with_sql(_DESIGNS_SQL)
    + """, kept AS (SELECT * FROM designs WHERE liability_num_violations <= 150),
    r AS (SELECT id,
      rank() OVER (ORDER BY design_iiptm DESC) + (count(*) OVER (PARTITION BY design_iiptm) - 1) / 2.0 AS a,
      (rank() OVER (ORDER BY design_ptm DESC) + (count(*) OVER (PARTITION BY design_ptm) - 1) / 2.0) / 2.0 AS b,
      rank() OVER (ORDER BY min_design_to_target_pae) +
        (count(*) OVER (PARTITION BY min_design_to_target_pae) - 1) / 2.0 AS c FROM kept)
    SELECT id, greatest(a, b, c) AS algo2_score, CASE greatest(a, b, c) WHEN a THEN 'design_iiptm'
      WHEN b THEN 'design_ptm' ELSE 'min_design_to_target_pae' END AS bottleneck_metric,
      a AS wrank_design_iiptm, b AS wrank_design_ptm, c AS wrank_min_design_to_target_pae,
      row_number() OVER (ORDER BY greatest(a, b, c), id) AS selection_rank
    FROM r ORDER BY algo2_score, id LIMIT 50""",
)
def w3(spark, sf):
    modes = {"design_iiptm": "max", "design_ptm": "max", "min_design_to_target_pae": "min"}
    return R.minmax_weighted_rank(designs(spark, sf), "id", modes, _W3_WEIGHTS, 50, 150)


_W4_SQL = (
    X.with_sql(_DESIGNS_SQL)
    + """, p AS (SELECT *, CASE WHEN design_iiptm < 10 THEN 0 WHEN min_design_to_target_pae > 0.06 THEN 1
      WHEN plip_hbonds_refolded < 0.02 THEN 2 ELSE 3 END AS num_filters_passed FROM designs),
    r AS (SELECT id, num_filters_passed, design_iiptm AS iptm, greatest(
      rank() OVER (ORDER BY num_filters_passed DESC, design_iiptm DESC) / 1.0,
      rank() OVER (ORDER BY num_filters_passed DESC, design_ptm DESC) / 2.0,
      rank() OVER (ORDER BY num_filters_passed DESC, plip_hbonds_refolded DESC) / 2.0) AS max_rank FROM p),
    s AS (SELECT *, dense_rank() OVER (ORDER BY max_rank) AS secondary_rank FROM r),
    f AS (SELECT *, row_number() OVER (ORDER BY secondary_rank, iptm DESC, id) AS final_rank,
      count(*) OVER () AS n FROM s)
    """
)
_W4_RULES = [
    ("design_iiptm", False, 10.0),
    ("min_design_to_target_pae", True, 0.06),
    ("plip_hbonds_refolded", False, 0.02),
]


def ranked_designs(spark, sf):
    from sievegrid.operators.gates import metric_threshold_filters

    flagged = metric_threshold_filters(designs(spark, sf), _W4_RULES)
    importance = {"design_iiptm": 1, "design_ptm": 2, "plip_hbonds_refolded": 2, "delta": None}
    return flagged, R.quality_rank(flagged, "id", importance, "design_iiptm")


@query(
    "w4_quality_rank",
    _W4_SQL
    + """SELECT id, max_rank, secondary_rank, final_rank,
      round(1 - (final_rank - 1) / (n - 1), 8) AS quality_score FROM f""",
)
def w4(spark, sf):
    _, ranked = ranked_designs(spark, sf)
    return ranked.withColumn("quality_score", F.round("quality_score", 8))


@query(
    "t4_top_budget",
    _W4_SQL + "SELECT id, final_rank FROM f WHERE final_rank <= 100",
)
def t4(spark, sf):
    _, ranked = ranked_designs(spark, sf)
    return ranked.filter("final_rank <= 100").select("id", "final_rank")


@query(
    "a19_summary_table",
    _W4_SQL
    + """SELECT count(*) AS n_designs, count(*) FILTER (num_filters_passed = 3) AS n_passing,
      round(avg(iptm), 6) AS all_design_iiptm, round(avg(iptm) FILTER (final_rank <= 100), 6) AS top_design_iiptm,
      round(avg(iptm) FILTER (final_rank <= 10), 6) AS diverse_design_iiptm FROM f""",
)
def a19(spark, sf):
    flagged, ranked = ranked_designs(spark, sf)
    joined = flagged.join(ranked.select("id", "final_rank"), "id")
    out = R.summary_table(joined, ["design_iiptm"], 100, F.col("final_rank") <= 10)
    return out.withColumns(
        {c: F.round(c, 6) for c in out.columns if c not in ("n_designs", "n_passing")}
    )


_SCORES_SQL = """scores AS (
  SELECT year(o_orderdate) AS epoch, o_custkey AS uid, sum(l_quantity) AS score,
    min(o_orderkey) % 50 AS block, count(*) AS ties, min(o_orderdate) AS push_time
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


def scores(spark, sf):
    orders, lines = X.table(spark, sf, "orders"), X.table(spark, sf, "lineitem")
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
    return joined.groupBy(F.year("o_orderdate").alias("epoch"), F.col("o_custkey").alias("uid")).agg(
        F.sum("l_quantity").alias("score"),
        (F.min("o_orderkey") % 50).alias("block"),
        F.count(F.lit(1)).alias("ties"),
        F.min("o_orderdate").alias("push_time"),
    )


@query(
    "w5_rank_uids",
    X.with_sql(_SCORES_SQL)
    + """SELECT epoch, uid, score, row_number() OVER (PARTITION BY epoch
      ORDER BY score DESC, ties, block, push_time, uid) AS rank FROM scores""",
)
def w5(spark, sf):
    ranked = R.rank_uids(scores(spark, sf), "score", "max", ["epoch"], ["ties"])
    return ranked.select("epoch", "uid", "score", "rank")


@query(
    "e6_epoch_winner",
    X.with_sql(_SCORES_SQL)
    + """SELECT epoch, uid, score FROM (SELECT *, row_number() OVER (PARTITION BY epoch
      ORDER BY score, block, push_time, uid) AS rank FROM scores) WHERE rank = 1""",
)
def e6(spark, sf):
    """Only the winner is asked for: one partial aggregate instead of a full ranking."""
    from sievegrid.operators.ordering import keep_one

    order = [F.col(c) for c in ("score", "block", "push_time", "uid")]
    return keep_one(scores(spark, sf), ["epoch"], order).select("epoch", "uid", "score")


@query(
    "w8_model_rank",
    "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice "
    "DESC, l_linenumber, l_partkey, l_suppkey) - 1 AS model_rank, l_extendedprice FROM lineitem",
)
def w8(spark, sf):
    lines = X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"
    )
    order = ["-l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey"]
    ranked = RangeOrdered(lines, ["l_orderkey"], order).row_number("model_rank")
    return ranked.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("model_rank") - 1).alias("model_rank"),
        "l_extendedprice",
    )


@query(
    "w9_dedup_keep_first",
    """WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents),
    firsts AS (SELECT h, min(doc_id) AS first_id FROM d GROUP BY h),
    n AS (SELECT h, first_id, row_number() OVER (ORDER BY first_id) - 1 AS idx FROM firsts)
    SELECT doc_id, first_id, idx AS index FROM d JOIN n USING (h)""",
)
def w9(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first, mapped = R.distinct_with_index(docs, "h", "doc_id")
    return mapped.join(first.select("index", F.col("doc_id").alias("first_id")), "index").select(
        "doc_id", "first_id", "index"
    )


_STATS = {"design_iiptm": (25.0, 14.0), "design_ptm": (38000.0, 23000.0), "min_design_to_target_pae": (0.05, 0.03)}


@query(
    "w11_absolute_score",
    X.with_sql(_DESIGNS_SQL)
    + """, z AS (SELECT id, (design_iiptm - 25) / 14 AS a, (design_ptm - 38000) / 23000 AS b,
      (min_design_to_target_pae - 0.05) / 0.03 AS c, design_iiptm >= 10 AS ok FROM designs)
    SELECT id, round(CAST((a * 1.0 + b * 0.5 - c) / 2.5 * CASE WHEN ok THEN 1 ELSE 0.1 END AS DOUBLE), 7) AS absolute_score,
      round(CAST((a * 1.0 + b * 0.5 - c) / 2.5 AS DOUBLE), 7) AS structure_confidence FROM z""",
)
def w11(spark, sf):
    flagged = designs(spark, sf).withColumn("pass_design_iiptm_filter", F.col("design_iiptm") >= 10)
    weights = {m: R.SCORE_WEIGHTS[m] for m in _STATS}
    scored = R.absolute_score(flagged, _STATS, ["pass_design_iiptm_filter"], weights)
    return scored.select(
        "id",
        F.round("absolute_score", 7).alias("absolute_score"),
        F.round("structure_confidence", 7).alias("structure_confidence"),
    )


@query("t1_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def t1(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.top_k(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 50)


@query(
    "t2_top_reference_per_target",
    METRICS
    + """SELECT target, item, m1, place FROM (SELECT *, row_number() OVER (PARTITION BY target
      ORDER BY m1 DESC, m2, item) AS place FROM metrics) WHERE place <= 50""",
)
def t2(spark, sf):
    top = R.top_per_group(
        X.metrics(spark, sf), ["target"], [F.desc("m1"), F.asc("m2"), F.asc("item")], 50
    )
    return top.select("target", "item", "m1", "place")


@query(
    "t3_truncate_list",
    X.with_sql(X.SQL_SUBMISSIONS) + "SELECT uid, items[1:5] AS kept FROM submissions WHERE len(items) >= 5",
)
def t3(spark, sf):
    cut = X.submissions(spark, sf).select("uid", R.truncate_list(F.col("items"), 5).alias("kept"))
    return cut.filter("kept IS NOT NULL")


@query(
    "t9_priority_columns",
    "SELECT o_totalprice, o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders",
)
def t9(spark, sf):
    return R.priority_columns(X.table(spark, sf, "orders"), ["o_totalprice", "absent"])


@query(
    "t10_limit_targets",
    METRICS
    + """SELECT target, item, place FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY item) AS place,
      dense_rank() OVER (ORDER BY target) AS t FROM metrics) WHERE t <= 7 AND place <= 20""",
)
def t10(spark, sf):
    out = R.limit_targets(X.metrics(spark, sf), "target", [F.asc("item")], 7, 20)
    return out.select("target", "item", "place")


@query(
    "a1_final_score",
    """WITH s AS (SELECT l_orderkey AS uid, l_linenumber AS item, l_suppkey AS target,
      CASE WHEN l_tax = 0 THEN -CAST('inf' AS DOUBLE) ELSE l_tax END AS v FROM lineitem),
    i AS (SELECT uid, item, CASE WHEN max(abs(v)) = CAST('inf' AS DOUBLE) THEN -CAST('inf' AS DOUBLE)
      ELSE avg(v) END AS m FROM s GROUP BY ALL)
    SELECT uid, CASE WHEN min(m) = -CAST('inf' AS DOUBLE) THEN -999.99 ELSE round(sum(m), 8) END AS final_score
    FROM i GROUP BY uid""",
)
def a1(spark, sf):
    from sievegrid.functions.scoring import safe_num

    lines = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("item"), "l_tax"
    )
    scored = R.final_score(lines, ["uid"], "item", "l_tax", "max")
    return scored.select("uid", safe_num(F.round("final_score", 8)).alias("final_score"))


@query(
    "a5_category_rank_total",
    _SQL_RANKED
    + "SELECT item AS uid, CAST(sum(m1_rank + m2_rank) AS DOUBLE) AS confidence_total FROM r GROUP BY item",
)
def a5(spark, sf):
    ranked = R.rank_sum(X.metrics(spark, sf), ["item", "target"], MODES, categories=CATEGORIES)
    total = R.category_rank_total(ranked, ["item"], "confidence_rank_sum", "confidence_total")
    return total.withColumnRenamed("item", "uid")


@query(
    "a22_winning_group",
    X.with_sql(_SCORES_SQL)
    + """SELECT epoch, uid, score, block, block % 361 AS blocks_into_epoch FROM scores
    WHERE round(score, 4) = (SELECT max(round(score, 4)) FROM scores s WHERE s.epoch = scores.epoch)""",
)
def a22(spark, sf):
    out = R.winning_group(scores(spark, sf), "score", ["epoch"])
    return out.select("epoch", "uid", "score", "block", "blocks_into_epoch")


_WINNERS_SQL = (
    X.with_sql(_SCORES_SQL)
    + """, winners AS (SELECT epoch,
      max_by(CASE WHEN score > 200 THEN uid END, (score, -uid)) AS molecule,
      min_by(uid, (score, uid)) AS nanobody FROM scores GROUP BY epoch)
    """
)


def winners(spark, sf):
    best = F.max_by(F.when(F.col("score") > 200, F.col("uid")), F.struct("score", -F.col("uid")))
    return scores(spark, sf).groupBy("epoch").agg(
        best.alias("molecule"), F.min_by("uid", F.struct("score", "uid")).alias("nanobody")
    )


@query(
    "a25_allocate",
    _WINNERS_SQL
    + """SELECT epoch, slot, round(sum(share), 8) AS share FROM (
      SELECT epoch, coalesce(molecule, 0) AS slot, 0.4::DOUBLE AS share FROM winners UNION ALL
      SELECT epoch, coalesce(nanobody, 0), 0.6::DOUBLE FROM winners) GROUP BY ALL""",
)
def a25(spark, sf):
    return R.allocate(winners(spark, sf), 0.6)


@query(
    "a25_payouts",
    _WINNERS_SQL
    + """SELECT epoch, 'molecule' AS kind, molecule AS winner, 0.4::DOUBLE AS share FROM winners
      WHERE molecule IS NOT NULL UNION ALL
      SELECT epoch, 'nanobody', nanobody, 0.6::DOUBLE FROM winners WHERE nanobody IS NOT NULL""",
)
def a25_payouts(spark, sf):
    return R.payouts(winners(spark, sf), 0.6)


@query(
    "a26_best_sample",
    """SELECT l_partkey AS design, max_by(l_orderkey, (0.8 * l_discount + 0.2 * l_tax, -l_orderkey)) AS sample
    FROM lineitem GROUP BY ALL""",
)
def a26(spark, sf):
    samples = X.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("design"),
        F.col("l_orderkey").alias("sample"),
        F.col("l_discount").alias("iptm"),
        F.col("l_tax").alias("ptm"),
    )
    return R.best_sample(samples, "design").select("design", "sample")
