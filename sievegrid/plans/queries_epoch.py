"""The flagship query: who wins each epoch."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegrid.plans import fixtures as X
from sievegrid.plans.epoch import in_window, latest_commits, rank_epochs
from sievegrid.plans.queries_intake import _ARCHIVE_SQL, archive
from sievegrid.plans.registry import query

MODES = {"m1": "max", "m2": "min", "m3": "max", "m4": "min"}
CATEGORIES = {"confidence": ["m1", "m2"], "physical": ["m3"], "developability": ["m4"]}

_WINDOW_SQL = """windowed AS (SELECT *, block // 361 AS epoch FROM commits
      WHERE block % 361 > 0 AND block % 361 < 351),
    latest AS (SELECT epoch, uid, max_by(block, (block, commit_id)) AS block,
      max(block * 1000000000 + commit_id) % 1000000000 AS commit_id FROM windowed GROUP BY ALL)"""


@query(
    "e3_latest_commit",
    X.with_sql(X.SQL_COMMITS, _WINDOW_SQL) + "SELECT epoch, uid, block, commit_id FROM latest",
)
def e3(spark, sf):
    return latest_commits(in_window(X.commits(spark, sf))).select("epoch", "uid", "block", "commit_id")


def item_metrics(spark, sf):
    """(uid, item, target, m1..m4) from the line items of the part with the uid's number."""
    lines = X.table(spark, sf, "lineitem")
    means = {"m1": "l_quantity", "m2": "l_extendedprice", "m3": "l_discount", "m4": "l_tax"}
    return lines.groupBy(
        F.col("l_partkey").alias("uid"),
        (F.col("l_linenumber") - 1).alias("item"),
        F.col("l_returnflag").alias("target"),
    ).agg(*[F.round(F.avg(c), 6).alias(m) for m, c in means.items()])


_EPOCH_SQL = (
    _ARCHIVE_SQL
    + ", "
    + ",\n".join([X.SQL_SUBMISSIONS, X.SQL_COMMITS, _WINDOW_SQL])
    + """, cut AS (SELECT uid, items[1:2] AS items FROM submissions),
    gated AS (SELECT uid FROM cut WHERE len(items) = 2 AND items[1] <> items[2]
      AND len(list_filter(items, lambda x: length(x) NOT BETWEEN 5 AND 600)) = 0
      AND len(list_filter(items, lambda x: """
    + " OR ".join(f"contains(x, '{a * 7}')" for a in "ACDEFGHIKLMNPQRSTVWY")
    + """)) = 0
      AND len(list_filter(items, lambda x: contains(array_to_string(list_transform(range(1, length(x) - 1), lambda i:
        CASE WHEN x[i] = x[i + 2] AND x[i] <> x[i + 1] THEN '1' ELSE '0' END), ''), '11111111'))) = 0
      AND len(list_filter(items, lambda x: len(list_filter(range(1, 20), lambda i: i + 11 <= least(length(x), 30) AND
        length(regexp_replace(substr(x, i, 12), '[^AILMFWV]', '', 'g')) >= 10)) > 0)) = 0
      AND uid NOT IN (SELECT uid FROM (SELECT uid, unnest(items) AS s FROM cut) WHERE s IN (SELECT seq FROM archive))),
    im AS (SELECT l_partkey AS uid, l_linenumber - 1 AS item, l_returnflag AS target, round(avg(l_quantity), 6) AS m1,
      round(avg(l_extendedprice), 6) AS m2, round(avg(l_discount), 6) AS m3, round(avg(l_tax), 6) AS m4
      FROM lineitem GROUP BY ALL),
    frame AS (SELECT epoch, uid, block, item, target, m1, m2, m3, m4 FROM latest JOIN gated USING (uid)
      JOIN im USING (uid) WHERE item < 2),
    ranked AS (SELECT *, dense_rank() OVER (PARTITION BY epoch ORDER BY m1 DESC) AS a,
      dense_rank() OVER (PARTITION BY epoch ORDER BY m2) AS b,
      dense_rank() OVER (PARTITION BY epoch ORDER BY m3 DESC) AS c,
      dense_rank() OVER (PARTITION BY epoch ORDER BY m4) AS d FROM frame),
    items AS (SELECT epoch, uid, block, item, avg(a + b + c + d) AS mean, sum(a + b) AS t1, sum(c) AS t2, sum(d) AS t3
      FROM ranked GROUP BY ALL),
    final AS (SELECT epoch, uid, block, sum(mean) AS final_score, sum(t1) AS t1, sum(t2) AS t2, sum(t3) AS t3
      FROM items GROUP BY ALL HAVING count(*) = 2)
    SELECT epoch, uid, block, round(final_score, 6) AS final_score, row_number() OVER (PARTITION BY epoch
      ORDER BY round(final_score, 9), t1, t2, t3, block, uid) AS rank FROM final"""
)


@query("epoch_rank", _EPOCH_SQL)
def epoch_rank(spark, sf):
    ranked = rank_epochs(
        X.commits(spark, sf),
        X.submissions(spark, sf),
        archive(spark, sf),
        item_metrics(spark, sf),
        MODES,
        CATEGORIES,
        2,
        length=(5, 600),
        min_cys=0,
        signal=(12, 10, 30),
    )
    return ranked.withColumn("final_score", F.round("final_score", 6))
