"""The similarity join against all pairs: exact, with few candidates and with a hot token."""

import random

import pytest
from pyspark.sql import functions as F

from sievegrid.operators import similarity as Y


def sets_of(n, seed, hot):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if i % 10 == 0 and out:
            new = set(r.choice(out))
            for _ in range(r.randint(0, 14)):
                new.discard(r.choice(sorted(new)))
                new.add(r.randrange(2048))
        else:
            new = set(r.sample(range(2048), r.randint(40, 60)))
        if hot and i % 3:
            new.add(7)
        out.append(new)
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_exact_and_selective_on_sparse_sets(spark, hot):
    sets = sets_of(400, 1, hot)
    known, new = sets[:200], sets[200:]
    near = lambda a, b: len(a & b) >= 0.6 * len(a | b) - 1e-9
    want = {i for i, a in enumerate(new) if any(near(a, b) for b in known)}
    kind = "key long, tokens array<int>"
    left = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(new)], kind)
    right = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(known)], kind)
    got = {r.key for r in Y.near_archive(left, right, "tokens", 0.6).collect()}
    assert got == want and want
    ids = lambda df: df.select(F.col("key").alias("id"), F.array_sort("tokens").alias("tokens"))
    assert Y.candidate_pairs(ids(left), ids(right), 0.6).count() < 0.1 * len(new) * len(known)
