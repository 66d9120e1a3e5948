"""Nearest points and clashes of mixed radii against all pairs, and how many pairs they compare."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievegrid.operators import geometry as G

POINT = "structure_id long, atom_idx long, x double, y double, z double"


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_nearest_equals_all_pairs(spark, leaf):
    r = random.Random(leaf)
    a, b = [], []
    for s in range(4):
        spread = 10.0 ** s
        b += [(s, i, *(r.gauss(0, spread) for _ in range(3))) for i in range(120)]
        a += [(s, i, *(r.gauss(0, 2 * spread) for _ in range(3))) for i in range(60)]
        a += [(s, 900, 1e7, -1e7, 3.0)]
    b += [(0, 500, 5e6, 5e6, 0.0), (1, 501, *b[121][2:]), (5, 1, 2.0, 2.0, 2.0), (5, 2, 2.0, 2.0, 2.0)]
    a += [(5, 1, 2.0, 2.0, 5.0), (6, 1, 0.0, 0.0, 0.0), (0, 901, 5e6, 5e6, 4.0), a[0]]
    got = sorted(map(tuple, G.nearest_distance(spark.createDataFrame(a, POINT), spark.createDataFrame(b, POINT), leaf).collect()))
    want = sorted((s, i, min((math.dist(p, q[2:]) for q in b if q[0] == s), default=math.inf)) for s, i, *p in a)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(x[2] == pytest.approx(y[2], rel=1e-12) for x, y in zip(got, want))


def test_coordinates_that_are_none_or_not_finite(spark):
    nan, inf = math.nan, math.inf
    a = [(1, 1, nan, 0.0, 0.0), (1, 2, inf, 0.0, 0.0), (1, 3, None, 0.0, 0.0), (1, 4, 0.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0)]
    b = [(1, 1, nan, nan, nan), (1, 2, 3.0, 4.0, 0.0), (1, 3, -inf, 0.0, 0.0), (1, 4, None, 0.0, 0.0), (2, 1, inf, 0.0, 0.0)]
    got = {(r.structure_id, r.atom_idx): r.distance for r in G.nearest_distance(spark.createDataFrame(a, POINT), spark.createDataFrame(b, POINT)).collect()}
    assert got == {(1, 1): inf, (1, 2): inf, (1, 3): inf, (1, 4): 5.0, (2, 1): inf}


def test_far_points_dont_meet_all(spark):
    """Two clouds far apart: a point meets the cells that face it, not the whole cloud."""
    r = random.Random(5)
    b = spark.createDataFrame([(1, i, r.random() * 100, r.random() * 100, r.random() * 100) for i in range(20_000)], POINT)
    a = spark.createDataFrame([(1, i, 5000 + r.random(), r.random() * 100, r.random() * 100) for i in range(20)], POINT)
    tree = G.CellTree(b.select("structure_id", *G.XYZ), 64)
    assert 2 <= tree.levels <= 6
    out = G.nearest_distance(a, b)
    plain = a.crossJoin(b.select(*[F.col(c).alias(f"b_{c}") for c in G.XYZ])).groupBy("atom_idx").agg(F.sqrt(F.min(G.square_distance())).alias("d"))
    want = {x.atom_idx: x.d for x in plain.collect()}
    assert {x.atom_idx: x.distance for x in out.collect()} == want


ATOM = "structure_id long, chain_id long, entity_id long, type string, radius double, x double, y double, z double"


def atoms(r, n, radius):
    return [(s, i % 7, i % 7 % 3, "ab"[i % 7 % 2], radius(r), *(r.uniform(0, 40) for _ in range(3))) for s in range(2) for i in range(n)]


def test_clashes_of_mixed_radii_equal_all_pairs(spark):
    r = random.Random(9)
    rows = atoms(r, 90, lambda r: r.choice([0.0, 0.3, 1.0, 1.7, 2.0, 4.5, None])) + [(0, 8, 0, "a", 30.0, 5.0, 5.0, 5.0), (0, 8, 0, "a", 0.1, 0.0, 0.0, 0.0)]
    rows.append((1, 9, 1, "b", 50.0, 1.0, 1.0, 1.0))  # one atom alone is no chain to clash
    bonded = [(0, 1, 2)]
    got = G.steric_clashes(spark.createDataFrame(rows, ATOM), spark.createDataFrame(bonded, "structure_id long, chain_1 long, chain_2 long"))
    size = {}
    for s, c, e, t, *_ in rows:
        size[s, c] = size.get((s, c), 0) + 1
    want = {}
    pairs = set()
    for p in rows:
        for q in rows:
            if p[0] == q[0] and p[1] < q[1] and p[4] is not None and q[4] is not None and math.dist(p[5:], q[5:]) < (p[4] + q[4]) * 0.75:
                if min(size[p[0], p[1]], size[q[0], q[1]]) > 1 and (p[0], p[1], q[1]) not in bonded:
                    pairs.add((p[0], p[1], q[1]))
    assert got.agg(F.sum("num_clashes")).first()[0] == len(pairs)


def test_one_giant_atom_leaves_the_others_cells(spark):
    r = random.Random(11)
    rows = [(1, i % 7, 0, "a", 1.5, *(r.uniform(0, 120) for _ in range(3))) for i in range(3000)]
    plain = G.met_by_radius(spark.createDataFrame(rows, ATOM), 0.75).count()
    giant = G.met_by_radius(spark.createDataFrame(rows + [(1, 8, 0, "a", 100.0, 60.0, 60.0, 60.0)], ATOM), 0.75).count()
    assert plain < 60_000 and giant - plain <= 3000
