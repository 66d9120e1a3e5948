"""Near-identity classes against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sievegrid.operators import identity as I


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def classes(rows, t):
    """Smallest key reachable, over all pairs."""
    label = {k: k for k, _ in rows}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, (k, a) in enumerate(rows):
        for m, b in rows[:i]:
            n = max(len(a or ""), len(b or ""))
            if a and b and abs(len(a) - len(b)) <= I.edits(n, t) and (a == b or distance(a, b) <= I.edits(n, t)):
                x, y = sorted((top(k), top(m)))
                label[y] = x
    return {k: top(k) for k, _ in rows}


def edited(r, seq, n):
    letters = list(seq)
    for _ in range(n):
        at = r.randrange(len(letters))
        how = r.random()
        if how < 0.4:
            letters[at] = r.choice("ACDEFGHIKLMNPQRSTVWY")
        elif how < 0.7:
            letters.insert(at, r.choice("ACDEFGHIKLMNPQRSTVWY"))
        else:
            del letters[at]
    return "".join(letters)


@pytest.mark.parametrize("t", [0.98, 0.9])
def test_classes_equal_all_pairs(spark, t):
    r = random.Random(int(t * 100))
    make = lambda n: "".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=n))
    seqs = []
    for n in (8, 20, 48, 49, 50, 51, 99, 100, 101, 150, 230):
        base = make(n)
        seqs += [base] + [edited(r, base, e) for e in range(1, 6) for _ in range(3)]
    frame = make(110)
    seqs += [frame[:60] + make(3) + frame[60:] for _ in range(40)]  # one common frame
    seqs += [seqs[0], seqs[5], "", "", None]
    rows = list(enumerate(seqs))
    r.shuffle(rows)
    df = spark.createDataFrame([(k, s, "x") for k, s in rows], "key long, s string, cluster string").drop("cluster")
    for crowd in (64, 3):
        nodes = df.filter("s <> ''").select("s").distinct().select(F.unhex(F.md5("s")).alias("id"), F.col("s").alias("seq"))
        links = I.near_links(nodes, t, crowd).join(nodes.select(F.col("id").alias("a"), F.col("seq").alias("x")), "a")
        links = links.join(nodes.select(F.col("id").alias("b"), F.col("seq").alias("y")), "b")
        assert all(distance(q.x, q.y) <= I.edits(max(len(q.x), len(q.y)), t) for q in links.collect())
    got = {q.key: (q.cluster, q.kept) for q in I.near_identical(df, "key", "s", t).collect()}
    want = classes(rows, t)
    assert {k: c for k, (c, _) in got.items()} == want
    assert {k for k, (_, kept) in got.items() if kept} == set(want.values())


def test_a_crowd_costs_one_comparison_each(spark):
    """A thousand variants of one sequence: their links are a star, not all pairs."""
    r = random.Random(1)
    base = "".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=150))
    variants = {base} | {base[:i] + c + base[i + 1 :] for i in range(60, 84) for c in "ACDEFGHIKLMNPQRSTVWY"}
    df = spark.createDataFrame([(s,) for s in sorted(variants)], "seq string")
    nodes = df.select(F.unhex(F.md5("seq")).alias("id"), "seq")
    assert I.near_links(nodes, 0.98).count() < 8 * len(variants)
    out = I.near_identical(df.select(F.monotonically_increasing_id().alias("k"), "seq"), "k", "seq")
    assert out.select("cluster").distinct().count() == 1 and out.filter("kept").count() == 1


def test_empty_table(spark):
    assert I.near_identical(spark.createDataFrame([], "k long, seq string"), "k", "seq").count() == 0


@pytest.mark.parametrize("heavy", [1 << 14, 1])
def test_parts_give_the_classes_of_all_pairs(spark, monkeypatch, heavy):
    """Windows are looked up for some sequences at a time and released; crowded keys may be too many to send around."""
    r = random.Random(5)
    make = lambda n: "".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=n))
    seqs = []
    for n in (50, 75, 120):
        base = make(n)
        seqs += [base, *(edited(r, base, e) for e in (1, 1, 2, 3) for _ in range(3))]
    frame = make(100)
    seqs += [frame[:50] + make(3) + frame[50:] for _ in range(30)]
    rows = list(enumerate(dict.fromkeys(seqs)))
    nodes = spark.createDataFrame([(k, s) for k, s in rows], "id long, seq string")
    monkeypatch.setattr(I, "PART", 16)
    monkeypatch.setattr(I, "WAITING", 1)
    monkeypatch.setattr(I, "HEAVY", heavy)
    used = []
    monkeypatch.setattr(I, "release", lambda s, plain=I.release: (used.append(1), plain(s)))
    links = I.near_links(nodes, 0.98, 3).collect()
    assert len(used) > 8 and all(distance(rows[x.a][1], rows[x.b][1]) <= I.edits(max(len(rows[x.a][1]), len(rows[x.b][1])), 0.98) for x in links)
    label = {k: k for k, _ in rows}
    for _ in rows:
        for x in links:
            label[x.a] = label[x.b] = min(label[x.a], label[x.b])
    assert label == classes(rows, 0.98)
