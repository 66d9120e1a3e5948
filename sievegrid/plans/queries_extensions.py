"""Extension points in use: predicates, masks, samplers, group functions, expansion, parameter text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sievegrid.functions.draws import uniform
from sievegrid.operators import aggregates as A
from sievegrid.operators import gates as G
from sievegrid.plans import fixtures as X
from sievegrid.plans.queries_sampling import sql_u
from sievegrid.plans.registry import query
from sievegrid.session import unnest


@query(
    "x1_record_predicates",
    """SELECT doc_id FROM documents WHERE length(text) > 200 AND lang IN ('en', 'de') AND text NOT LIKE '%http%'""",
)
def x1(spark, sf):
    """Any list of conditions filters records; a user adds one to the list."""
    predicates = [F.length("text") > 200, F.col("lang").isin("en", "de"), ~F.col("text").contains("http")]
    return X.table(spark, sf, "documents").filter(G.all_of(predicates)).select("doc_id")


@query(
    "x2_chain_masks",
    """WITH c AS (SELECT l_orderkey AS s, l_linenumber AS c, max(l_quantity) > 5 AND min(l_tax) < 0.07 AS valid FROM lineitem GROUP BY ALL)
    SELECT a.s AS structure_id, a.c AS chain_1, b.c AS chain_2, a.valid AND b.valid AS valid FROM c a JOIN c b ON a.s = b.s AND b.c = a.c + 1""",
)
def x2(spark, sf):
    """Two masks over chains, and the interfaces that stay valid under both."""
    lines = X.table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("structure_id"), F.col("l_linenumber").alias("chain_id")
    ).agg(F.max("l_quantity").alias("q"), F.min("l_tax").alias("t"))
    keys = ["structure_id", "chain_id"]
    masks = [lines.select(*keys, (F.col("q") > 5).alias("valid")), lines.select(*keys, (F.col("t") < 0.07).alias("valid"))]
    chains = lines.select(*keys)
    following = chains.select("structure_id", (F.col("chain_id") - 1).alias("chain_1"), F.col("chain_id").alias("chain_2"))
    pairs = chains.withColumnRenamed("chain_id", "chain_1").join(following, ["structure_id", "chain_1"])
    return G.propagate_validity(chains, masks, pairs)[1]


@query(
    "x3_sampler_and_crop",
    f"""SELECT doc_id, substr(text, 1 + CAST(floor({sql_u("crop", "doc_id")} * greatest(length(text) - 40, 1)) AS INT), 40) AS piece
    FROM documents WHERE {sql_u("draw", "doc_id")} < 0.3""",
)
def x3(spark, sf):
    """A sampler and a cropper are functions of a DataFrame, put together by transform."""

    def sampler(df):
        return df.filter(uniform("draw", F.col("doc_id")) < 0.3)

    def cropper(df):
        room = F.greatest(F.length("text") - 40, F.lit(1))
        start = 1 + F.floor(uniform("crop", F.col("doc_id")) * room).cast("int")
        return df.select("doc_id", F.substr("text", start, F.lit(40)).alias("piece"))

    return X.table(spark, sf, "documents").transform(sampler).transform(cropper)


@query(
    "x5_group_function",
    """SELECT c_nationkey, count(*) AS n, round(median(c_acctbal), 6) AS middle, round(max(c_acctbal) - min(c_acctbal), 6) AS spread
    FROM customer GROUP BY c_nationkey""",
)
def x5(spark, sf):
    """Several values of a group from states that merge; no task holds a whole nation."""
    rows = X.table(spark, sf, "customer").select("c_nationkey", "c_acctbal")

    def fold(pdf: pd.DataFrame) -> dict:
        v = pdf["c_acctbal"]
        return {"n": len(pdf), "low": v.min(), "high": v.max()}

    def merge(a: dict, b: dict) -> dict:
        return {"n": a["n"] + b["n"], "low": min(a["low"], b["low"]), "high": max(a["high"], b["high"])}

    ends = A.group_states(
        rows, ["c_nationkey"], "n long, low double, high double", fold, merge,
        lambda s: {"n": s["n"], "spread": round(s["high"] - s["low"], 6)}, "n long, spread double",
    )
    middle = A.group_median(rows, "c_nationkey", "c_acctbal")
    return ends.join(middle, "c_nationkey").select("c_nationkey", "n", F.round("median", 6).alias("middle"), "spread")


@query(
    "x6_row_expansion",
    """SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY ALL""",
)
def x6(spark, sf):
    """One row per word of a text, counted."""
    docs = X.table(spark, sf, "documents").select("lang", "text")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return unnest(docs, words, "word", "lang").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p15_parameter_text",
    """SELECT num_filters_passed, count(*) AS n, round(sum(2.0 * l_quantity - 0.5 * l_tax), 4) AS weighted FROM (SELECT *,
      CASE WHEN l_quantity < 10 THEN 0 WHEN l_discount > 0.06 THEN 1 WHEN l_tax > 0.05 THEN 2 ELSE 3 END AS num_filters_passed FROM lineitem)
    WHERE l_linenumber >= 2 AND l_linenumber < 6 GROUP BY ALL""",
)
def p15(spark, sf):
    """Filters, weights and a size bucket, all written as text."""
    rules = [G.parse_filter_rule(t) for t in ("l_quantity > 10", "l_discount<0.06", "l_tax<0.05")]
    weights = dict(G.parse_metric_weight(t) for t in ("l_quantity=2", "l_tax=-0.5", "l_discount=none"))
    low, high, _ = G.parse_size_bucket("2-6:100")
    lines = X.table(spark, sf, "lineitem").filter((F.col("l_linenumber") >= low) & (F.col("l_linenumber") < high))
    total = sum((F.lit(w) * F.col(m) for m, w in weights.items() if w is not None), F.lit(0.0))
    passed = G.metric_threshold_filters(lines, rules).groupBy("num_filters_passed")
    return passed.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 4).alias("weighted"))
