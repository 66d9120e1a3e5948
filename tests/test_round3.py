"""Faster forms of functions against the plain ones, and work that must not be done twice."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.functions import alignment as N
from sievegrid.functions import liabilities as L
from sievegrid.functions import sequences as S
from sievegrid.operators import ordering
from sievegrid.operators import sampling as Q
from sievegrid.operators import similarity as Y

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def test_whole_scores_equal_the_plain_ones_and_long_rows_hold_up_nobody(monkeypatch):
    """the shorter sequence takes the steps, and what has ended drops out."""
    rng = random.Random(3)
    pair = {(x, y): float(rng.randint(-4, 6)) for x in LETTERS for y in LETTERS}
    table = N.Substitutions(pair)
    text = lambda n: "".join(rng.choices(LETTERS + "X", k=n))
    a = [text(rng.randint(0, 30)) for _ in range(40)] + [text(700), None, ""]
    b = [text(rng.randint(0, 60)) for _ in range(40)] + ["ACD", "A", ""]
    steps = []
    plain = N._whole_block
    monkeypatch.setattr(N, "_whole_block", lambda a, *rest: steps.append(max(map(len, a))) or plain(a, *rest))
    for gaps in ((-11.0, -1.0), (-1.0, -5.0)):
        got = N.affine_scores(a, b, table, *gaps)
        want = [np.nan if x is None else N._affine_block([x], [y], table, *gaps)[0] for x, y in zip(a, b)]
        np.testing.assert_array_equal(got, want)
        if gaps[0] == -11.0:
            assert max(steps) <= 60
    halves = N.Substitutions({(x, x): 0.5 for x in LETTERS})
    steps.clear()
    N.affine_scores(a, b, halves)
    assert not steps


def test_kmers_beyond_ascii(spark):
    texts = ["ACDACDA", "AßC𝒳DE", "A\nB\nC", "ab", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.k for r in rows.select("i", S.kmers(F.col("t"), 3).alias("k")).collect()}
    for i, t in enumerate(texts[:-1]):
        assert got[i] == list(dict.fromkeys(t[j : j + 3] for j in range(len(t) - 2)))


@pytest.mark.parametrize("modality,kind", [("antibody", "linear"), ("peptide", "linear"), ("peptide", "cyclic")])
def test_widths_are_those_of_the_motifs(spark, modality, kind):
    """lengths that are given equal lengths that are searched."""
    import re

    rng = random.Random(5)
    texts = ["".join(rng.choices(LETTERS, k=200)) for _ in range(20)] + ["A"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", F.explode(L.liability_violations(F.col("t"), modality, kind)).alias("v")).select("i", "v.*").collect()
    for motif, pattern in L.motif_set(modality, kind).items():
        got = sorted((r.i, r.pos, r.len) for r in found if r.motif == motif)
        assert got == [(i, m.start() + 1, len(m[0])) for i, t in enumerate(texts) for m in re.finditer(pattern, t)], motif
    assert rows.select(L.liability_violations(F.lit(None).cast("string")).alias("v")).first().v is None


def test_mutations_by_hash(spark):
    """positions and residues are those of the md5 numbers."""
    seq = "ACDEFGHIKLMNPQRSTVWY" * 3
    u = lambda s, i: int(hashlib.md5(f"{s}|7|{i}".encode()).hexdigest()[:13], 16) / 2**52
    want = list(seq)
    for i in sorted(range(len(seq)), key=lambda i: (u("8", i), i))[:5]:
        want[i] = LETTERS.replace(seq[i], "")[int(u("8r", i) * 19)]
    rows = spark.createDataFrame([(7, seq), (7, None), (None, "AC")], "k long, s string")
    got = [r[0] for r in rows.select(Q.mutate(rows, "k", "s", 5, 8)).collect()]
    assert got[:2] == ["".join(want), None] and len(got[2]) == 2 and got[2][0] != "A" and got[2][1] != "C"


def test_near_archive_of_texts_that_meet_many(spark, monkeypatch):
    """Sets are made from texts, and most candidates look no further than a few archived ones."""
    rng = random.Random(9)
    texts = ["".join(rng.choices("ACD", k=rng.randint(3, 40))) for _ in range(400)]
    new, old = texts[:200] + ["", None, "ACDACDACD"], texts[200:] + ["", None]
    words = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    near = lambda a, b: len(words(a) & words(b)) * 1.8 >= 0.8 * (len(words(a)) + len(words(b))) - 1e-9
    want = sorted(i for i, t in enumerate(new) if t and any(near(t, o) for o in old if o))
    left = spark.createDataFrame([(i, t) for i, t in enumerate(new)], "i int, t string")
    right = spark.createDataFrame([(t,) for t in old], "t string")
    late = []
    pairs = Y.candidate_pairs
    monkeypatch.setattr(Y, "candidate_pairs", lambda a, *rest: late.append(a.count()) or pairs(a, *rest))
    for few in (2, 1 << 20):
        monkeypatch.setattr(Y, "FEW", few)
        got = Y.near_archive(left, right, "t", 0.8, of=lambda c: S.kmers(c, 2))
        assert sorted(r.i for r in got.collect()) == want
    assert late[0] < late[1]


def test_ranges_by_rows(spark, monkeypatch):
    """a range holds so many rows, however well they compress."""
    monkeypatch.setattr(ordering, "ROWS", 100)
    rows = spark.range(5000).selectExpr("id", "id % 3 AS v")
    ordered = ordering.RangeOrdered(rows, [], ["v"], ["id"], 5000)
    assert ordered._ranged.rdd.getNumPartitions() == 50
    ranks = {r.v: r.rank for r in ordered.rank("dense").select("v", "rank").distinct().collect()}
    assert ranks == {0: 1, 1: 2, 2: 3}
