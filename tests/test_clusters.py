"""Greedy clusters by representative against a run one by one."""

import hashlib
import random

from pyspark.sql import functions as F

from sievegrid.functions.alignment import identity_with
from sievegrid.operators import similarity as Y
from sievegrid.operators.components import greedy_cover


def one_by_one(nodes, edges):
    near = {i: set() for i, _ in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    head = {}
    for i, _ in sorted(nodes, key=lambda n: (n[1], n[0]), reverse=True):
        if i not in head:
            head[i] = i
            for j in near[i]:
                head.setdefault(j, i)
    return head


def test_cover_equals_the_run_one_by_one(spark):
    for seed, n, m in ((1, 60, 150), (2, 80, 60), (3, 40, 400), (4, 1, 0)):
        r = random.Random(seed)
        nodes = [(i, r.randrange(8)) for i in range(n)]
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(0, i) for i in range(0, n, 3)]
        got = greedy_cover(spark.createDataFrame(nodes, "id long, priority long"), spark.createDataFrame(edges, "a long, b long"))
        assert {x.id: x.representative for x in got.collect()} == one_by_one(nodes, edges)


def test_cover_of_a_chain_of_falling_priorities(spark):
    nodes, edges = [(i, 20 - i) for i in range(20)], [(i, i + 1) for i in range(19)]
    got = greedy_cover(spark.createDataFrame(nodes, "id long, priority long"), spark.createDataFrame(edges, "a long, b long"))
    assert {x.id: x.representative for x in got.collect()} == one_by_one(nodes, edges)


def test_every_member_is_near_its_representative(spark):
    r = random.Random(7)
    make = lambda n: "".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=n))
    seqs = []
    for _ in range(12):  # chains of drift: single linkage would join their far ends
        seq = make(60)
        for _ in range(8):
            seqs.append(seq)
            at = r.randrange(0, 40)
            seq = seq[:at] + make(20) + seq[at + 20 :]
    df = spark.createDataFrame([(s,) for s in seqs] + [(seqs[0],), ("",), (None,)], "seq string")
    got = {x.seq: x.cluster for x in Y.sequence_clusters(df, min_identity=0.6).collect()}
    assert set(got) == set(seqs) | {""}
    named = {x.id: x.seq for x in df.select(F.sha2("seq", 256).alias("id"), "seq").distinct().collect()}
    for seq, cluster in got.items():
        head = named[cluster]
        assert got[head] == cluster
        assert seq == head or identity_with(seq)(head) >= 0.6
    nodes = df.filter("seq IS NOT NULL").distinct().withColumn("id", F.sha2("seq", 256))
    links = [(x.a, x.b) for x in Y.cluster_links(nodes, 5, 10, 0.6).collect()]
    degree = {i: sum(i in e for e in links) for i in named}
    want = one_by_one([(i, (degree[i], len(s))) for i, s in named.items() if s is not None], links)
    assert {named[i]: h for i, h in want.items()} == got


def test_pairs_of_too_different_lengths_are_not_aligned(spark, monkeypatch):
    """A long centre shares its k-mers with many short pieces; none of these pairs can reach the identity."""
    long = "ACDEFGHIKLMNPQRSTVWY" * 20
    near = long[:200] + "A" * 10 + long[200:]
    nodes = [(i, s) for i, s in enumerate([long, near, long[:40], long[5:60], long[:300]])]
    df = spark.createDataFrame(nodes, "id long, seq string")
    seen = []
    plain = Y.identity
    monkeypatch.setattr(Y, "rebalance", lambda d, *k: seen.append(d.select("a", "b").collect()) or d)
    got = {(r.a, r.b) for r in Y.cluster_links(df, 5, 400, 0.6).collect()}
    assert Y.identity is plain and got == {(0, 1), (1, 4)}
    assert {(r.a, r.b) for r in seen[0]} == {(0, 1), (1, 4)}


def test_parts_give_the_links_of_all_at_once(spark, monkeypatch):
    """Sequences meet the centres in parts, whose shuffles leave the disk; numbers in the order of the hashes break ties."""
    r = random.Random(11)
    make = lambda n: "".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=n))
    bases = [make(50) for _ in range(15)]
    seqs = bases + [b[:i] + make(8) + b[i + 8 :] for b in bases for i in range(0, 40, 8)]
    df = spark.createDataFrame([(s,) for s in [*seqs, "", "AC", None, seqs[0]]], "seq string")
    numbered = sorted((x.id, x.seq) for x in Y._numbered(df).collect())
    assert [s for _, s in numbered] == sorted({*seqs, "", "AC"}, key=lambda s: hashlib.sha256(s.encode()).hexdigest())
    nodes = spark.createDataFrame(numbered, "id long, seq string")
    got, used = [], []
    monkeypatch.setattr(Y, "release", lambda s, plain=Y.release: (used.append(1), plain(s)))
    for part in (1 << 17, 10):
        monkeypatch.setattr(Y, "PART", part)
        got.append(sorted((x.a, x.b) for x in Y.cluster_links(nodes, 5, 10, 0.4).collect()))
    assert got[0] == got[1] and len(got[0]) == len(set(got[0])) > 60
    assert len(used) == (1 + 1) + (1 + 10)
