"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from sievegrid.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n_links long, kept string"


def brute_force(rows, cosine=0.95):
    ids = [r[0] for r in rows]
    near = np.zeros((len(rows), len(rows)), bool)
    unit = []
    for r in rows:
        v = r[1]
        fine = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        a = np.array(v, np.float32).astype(float) if fine else None
        unit.append(a / np.linalg.norm(a) if fine else None)
    for i, a in enumerate(unit):
        for j, b in enumerate(unit):
            near[i, j] = i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= cosine
    label = np.arange(len(rows))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    least = {k: min(ids[i] for i in range(len(rows)) if label[i] == k) for k in set(label)}
    return sorted((ids[i], int(near[i].sum()), least[label[i]]) for i in range(len(rows)))


@pytest.fixture
def rows():
    rng = np.random.default_rng(1)
    out = []
    for i in range(400):
        out.append(rng.standard_normal(16))
    for i in range(150):
        out.append(out[i % 7] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.25]))
    out += [out[3] * 5] * 60 + [out[4]] * 30
    full = [(i, [float(x) for x in v], i % 3, "x", 7, "x") for i, v in enumerate(out)]
    n = len(full)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [1.0] * 8]
    return full + [(n + i, v, None, None, None, None) for i, v in enumerate(odd)]


@pytest.mark.parametrize("block", [16, 1024])
def test_links_and_components(spark, rows, block):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = V.near_vectors(df, block=block, per_cell=8)
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect())
    want = brute_force(rows)
    links, met = sum(w[1] for w in want), sum(f[1] for f in found)
    assert all(f[1] <= w[1] for f, w in zip(found, want))
    assert met >= 0.99 * links
    assert sum(f != w for f, w in zip(found, want)) <= 0.02 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_recall_is_measured_against_all_rows(spark, rows):
    df = spark.createDataFrame(rows[:-8], SCHEMA)
    found = V.near_vectors(df)
    assert V.measured_recall(df, found, every=5) >= 0.9
    assert V.measured_recall(df, found.withColumn("n_links", found.n_links * 0), every=5) == 0


def test_traversal_visits_cells_by_distance():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(7)
    got = V.multi_sequence(a, b, 1.0)
    values = [a[i] + b[j] for i, j in got]
    assert values == sorted(values)
    assert set(got) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 1.0}


def test_few_rows(spark):
    assert V.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    one = V.near_vectors(spark.createDataFrame([(5, [1.0, 0.0], 1, "", 1, "")], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(5, 0, 5, True)]
    two = V.near_vectors(spark.createDataFrame([(5, [1.0, 0.0], 1, "", 1, ""), (3, [2.0, 0.1], 1, "", 1, "")], SCHEMA)).collect()
    assert sorted(tuple(r) for r in two) == [(3, 1, 3, True), (5, 1, 3, False)]
