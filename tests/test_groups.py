"""Group functions from merging states, and the exact median, against whole groups."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sievegrid.operators import aggregates as A


def rows(seed, n):
    r = random.Random(seed)
    out = [(r.choice([1, 1, 1, 2, 3, None]), round(r.gauss(0, 50), 2)) for _ in range(n)]
    return out + [(4, None), (4, math.nan), (5, 7.0), (6, 2.0), (6, 3.0)] + [(7, 1.5)] * 3000 + [(8, -math.inf), (8, math.inf), (8, 0.0)]


@pytest.mark.parametrize("ranges,few", [(256, 1024), (4, 1), (2, 3)])
def test_median_equals_whole_groups(spark, ranges, few):
    data = rows(1, 4000)
    df = spark.createDataFrame(data, "g long, v double")
    got = {x.g: x["median"] for x in A.group_median(df, "g", "v", ranges, few).collect()}
    groups = {}
    for g, v in data:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    assert got == {g: pytest.approx(statistics.median(v)) for g, v in groups.items()}


def test_median_of_far_and_infinite_values(spark):
    data = [(1, v) for v in [-math.inf] * 5 + [math.inf] * 4 + [1e308, -1e308, 1e-300, 0.0, 5e-324]]
    got = A.group_median(spark.createDataFrame(data, "g long, v double"), "g", "v", 4, 1).first()["median"]
    assert got == statistics.median([v for _, v in data])
    assert A.group_median(spark.createDataFrame([], "g long, v double"), "g", "v").count() == 0


def test_states_equal_whole_groups(spark):
    data = rows(2, 5000)
    df = spark.createDataFrame(data, "g long, v double").repartition(6)
    fold = lambda p: {"n": len(p), "total": float(p["v"].sum())}
    merge = lambda a, b: {"n": a["n"] + b["n"], "total": a["total"] + b["total"]}
    done = lambda s: {"mean": s["total"] / s["n"], "n": s["n"]}
    for most_keys in (10_000, 1):
        out = A.group_states(df.filter("g < 8 OR g IS NULL"), ["g"], "n long, total double", fold, merge, done, "mean double, n long", most_keys)
        got = {x.g: (x.n, x.mean) for x in out.collect()}
        want = {}
        for g, v in data:
            if g != 8:
                n, total = want.get(g, (0, 0.0))
                want[g] = (n + 1, total + (0.0 if v is None or math.isnan(v) else v))
        assert got == {g: (n, pytest.approx(t / n)) for g, (n, t) in want.items()}


def test_one_group_with_all_rows_reaches_no_task_whole(spark):
    """What is merged for a group is a state a task, however many rows it has."""
    df = spark.range(300_000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v")).repartition(5)
    seen = spark.sparkContext.accumulator(0)

    def fold(pdf):
        assert len(pdf) <= 20_000
        return {"n": len(pdf)}

    def merge(a, b):
        seen.add(1)
        return {"n": a["n"] + b["n"]}

    out = A.group_states(df, ["g"], "n long", fold, merge, lambda s: s, "n long").collect()
    assert [x.n for x in out] == [300_000]
    assert A.group_median(df, "g", "v").first()["median"] == 149_999.5


def test_reports_hold_the_first_items_only(spark):
    from sievegrid.sources.writers import epoch_report

    kind = "uid long, hotkey string, block_submitted long, molecule_final_score double, nanobody_final_score double"
    people = spark.createDataFrame([(1, "a", 10, 1.0, 2.0), (2, "b", 11, None, None), (3, "c", 12, 0.0, 0.0)], kind)
    items = spark.createDataFrame([(1, i, i * 0.5) for i in range(50)] + [(2, 7, None)], "uid long, item long, score double")
    for most, n in ((None, 50), (3, 3)):
        got = {x.uid: x.document for x in epoch_report(people, items, items.filter("uid = 2"), 5, {"k": "v"}, most).collect()}
        assert set(got) == {1, 2}
        assert [m.item for m in got[1].molecules] == list(range(n)) and got[1].nanobodies is None
        assert [m.item for m in got[2].molecules] == [7] and got[2].blocks_elapsed == 6


def test_consensus_keeps_rows_without_an_entity(spark):
    from sievegrid.operators.joins import apply_consensus

    local = spark.createDataFrame([(1, "m", 1.0), (2, "m", 2.0), (3, None, 3.0), (4, "n", 4.0)], "id long, entity string, score double")
    averages = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "id long, score double")
    got = {x.id: x.score for x in apply_consensus(local, averages, ["id"], ["score"], "entity").collect()}
    assert got == {1: 10.0, 2: 20.0, 3: 30.0, 4: 4.0}


def test_the_report_query_keeps_every_item(spark, tmp_path):
    from sievegrid.plans.queries_sources import k3

    people = [(1, "a", 5.0), (2, "b", -1.0), (3, "c", 0.0)]
    spark.createDataFrame(people, "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(1, i, i * 1.5, "F") for i in range(12)] + [(1, 50 + i, 2.0, "O") for i in range(7)] + [(2, 99, 1.0, "O"), (3, 98, 1.0, "P")]
    kind = "o_custkey long, o_orderkey long, o_totalprice double, o_orderstatus string"
    spark.createDataFrame(orders, kind).write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(x) for x in k3(spark, str(tmp_path)).collect()}
    assert got == {(1, -99, 12, 7, 5.0), (2, -98, 0, 1, -999.99)}
