"""Work that must stay small however many rows there are."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sievegrid.operators import msa as M
from sievegrid.operators import ranking as R
from sievegrid.operators import selection as T


@pytest.mark.parametrize("pool", [2, 512])
def test_rows_that_cannot_be_picked_are_not_compared(spark, pool):
    """400 rows lie far below the bounds of the 20 best."""
    r = random.Random(8)
    rows = [(i, "".join(r.choices("ACDE", k=60)), 5 + r.random() / 9) for i in range(20)]
    rows += [(100 + i, "".join(r.choices("ACDE", k=9)), r.random()) for i in range(400)]

    def to(reference):
        def share(seq):
            if len(seq) < 60:
                raise ValueError("compared")
            return sum(x == y for x, y in zip(reference, seq)) / 60

        return share

    left, texts, want = {x[0]: x for x in rows[:20]}, [], []
    while len(want) < 6:
        worth = lambda x: 0.6 * x[2] + 0.4 * (1 - max((to(t)(x[1]) for t in texts), default=-1.0))
        best = min(left.values(), key=lambda x: (-worth(x), x[0]) if texts else (-x[2], x[0]))
        want.append(best[0])
        texts.append(left.pop(best[0])[1])
    df = spark.createDataFrame(rows, "id long, seq string, quality double").repartition(3)
    got = T.diverse_select(df, "id", "seq", "quality", 6, 0.4, similarity_to=to, pool=pool).orderBy("pick_order").collect()
    assert [x.id for x in got] == want


LINES = ["", "A", "a", "aA", "Aa", "abCDe-Fgh", "ab-", "a\nB", "ACDacdACD", "x𝒳y𝒳z", "ABC\naD\n", None]


def test_insertions_are_sought_up_to_the_last_only(spark):
    """the same runs, without a step for every column behind them."""
    rows = spark.createDataFrame(list(enumerate(LINES)), "i int, line string")
    cut = M.insertions(F.col("line"))
    got = {r.i: r.d and [tuple(x) for x in r.d] for r in rows.select("i", cut.alias("d")).collect()}
    for i, line in enumerate(LINES):
        runs = None if line is None else [(j, len(r)) for j, r in enumerate(re.findall("([a-z]*)[^a-z]", line)) if r]
        assert got[i] == runs


@pytest.mark.parametrize("block,at_once", [(1024, 1 << 22), (2, 3)])
def test_profiles_count_columns_in_tasks(spark, monkeypatch, block, at_once):
    """letters become no rows; null alignments and columns beyond the residues are left out as before."""
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "LETTERS", at_once)
    kind = "msa_id long, seq_idx long, residues string, deletions array<struct<res_idx:int,deletion:int>>"
    rows = [
        (1, 0, "AC-L", [(0, 2), (3, 1)]), (1, 1, "A", []), (1, 2, "𝒳LA", [(0, 4)]), (1, 3, "", [(9, 9)]),
        (2, 0, "", []), (3, 0, None, None), (3, 1, "L", None), (None, 0, "AL", [(0, 1)]),
    ]
    df = spark.createDataFrame(rows, kind).repartition(3)
    profile = M.msa_profile(df, "AL")
    assert "split(residues" not in profile._jdf.queryExecution().analyzed().toString()
    got = {(r.msa_id, r.res_idx): tuple(r)[2:] for r in profile.collect()}
    import math

    gap = lambda *n: sum(math.pi / 2 * math.atan(x / 3) for x in n)
    want = {
        (1, 0): (2 / 4, 0.0, 2 / 4, gap(2, 4) / 4), (1, 1): (0.0, 1 / 4, 0.0, 0.0), (1, 2): (1 / 4, 0.0, 0.0, 0.0),
        (1, 3): (0.0, 1 / 4, 1 / 4, gap(1) / 4), (3, 0): (0.0, 1 / 2, 0.0, 0.0),
    }
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


@pytest.mark.parametrize("method", ["min", "dense", "average"])
@pytest.mark.parametrize("by,lead", [((), ()), (("g",), ()), ((), ("-p",)), (("g",), ("p",))])
def test_ranks_by_value_are_those_of_rows(spark, monkeypatch, method, by, lead):
    """null, NaN and minus zero included, and null groups."""
    r = random.Random(2)
    some = [None, float("nan"), -0.0, 0.0, 1.5, 2.0, float("inf")]
    rows = [(i // 2, r.choice([None, 1, 2]), r.choice([None, 0, 1]), r.choice(some), r.choice(some)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g int, p int, a double, b double").repartition(3)
    found = []
    for few in (R.FEW, 0):
        monkeypatch.setattr(R, "FEW", few)
        ranks = R.long_ranks(df, ["id"], {"a": "max", "b": "min"}, method, by, lead)
        found.append((dict(ranks.dtypes)["rank"], sorted(map(repr, ranks.select("id", *by, "metric", "rank").collect()))))
    assert found[0] == found[1]


def test_only_metrics_of_many_values_are_ranked_row_by_row(spark, monkeypatch):
    """and the rows are made once."""
    made, laid, plain = spark.sparkContext.accumulator(0), [], R.RangeOrdered
    monkeypatch.setattr(R, "FEW", 50)
    monkeypatch.setattr(R, "RangeOrdered", lambda df, *rest: laid.append(rest[-1]) or plain(df, *rest))

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    rows = [(i, float(i % 5), i * 7 % 400 / 8) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("a", counted("a"))
    got = {x.id: (x.rank_sum, x.a_rank, x.b_rank) for x in R.rank_sum(df, ["id"], {"a": "max", "b": "min"}).collect()}
    a, b = {v: i + 1 for i, v in enumerate([4.0, 3.0, 2.0, 1.0, 0.0])}, {v: i + 1 for i, v in enumerate(sorted({x[2] for x in rows}))}
    assert got == {i: (a[x] + b[y], a[x], b[y]) for i, x, y in rows}
    assert laid == [400] and made.value == 400
