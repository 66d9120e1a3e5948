"""Operators without SQL against brute force, skewed inputs, and streams against batches."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievegrid.functions.alignment import identity_with
from sievegrid.operators import aggregates as A
from sievegrid.operators import geometry as G
from sievegrid.operators import msa as M
from sievegrid.operators import selection as T
from sievegrid.operators import similarity as Y
from sievegrid.operators.components import connected_components
from sievegrid.operators.sampling import weighted_draw
from sievegrid.session import scratch_path
from sievegrid.sources import readers as R
from sievegrid.streaming import epochs as E


def test_components(spark):
    rng = random.Random(2)
    # a chain, a star with many leaves, and random links
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)]
    edges += [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)]
    nodes = range(0, 620)
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = connected_components(
        spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long")
    ).collect()
    assert {r["id"]: r["component"] for r in got} == {n: root(n) for n in nodes}


def test_near_archive_with_hot_copies(spark):
    rng = random.Random(4)
    sets = [tuple(sorted(rng.sample(range(40), rng.randrange(1, 14)))) for _ in range(120)]
    hot = tuple(range(0, 12))
    candidates = [(i, list(hot if i % 3 == 0 else rng.choice(sets))) for i in range(300)]
    archive = [(i, list(hot if i % 3 == 0 else rng.choice(sets))) for i in range(1000, 1150)]
    kind = "id long, tokens array<int>"
    got = Y.near_archive(spark.createDataFrame(candidates, kind), spark.createDataFrame(archive, kind), "tokens", 0.6)
    known = [set(t) for _, t in archive]
    want = {i for i, t in candidates if any(len(set(t) & k) / len(set(t) | k) >= 0.6 - 1e-12 for k in known)}
    assert {r["id"] for r in got.collect()} == want


def test_clusters_join_what_a_center_accepts(spark):
    base = ["ACDEFGHIKLMNPQRSTVWY" * 3, "WYTSRQPNMLKIHGFEDCAV" * 3]
    seqs = [b[:k] + "A" + b[k + 1 :] for b in base for k in (5, 23, 47)] + base
    got = Y.sequence_clusters(spark.createDataFrame([(s,) for s in seqs], ["seq"]), min_identity=0.9).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["cluster"], set()).add(r["seq"])
    assert sorted(map(len, groups.values())) == [4, 4]


def greedy(items, k, alpha, buckets):
    left = dict((i, (s, q)) for i, s, q in items)
    first = min(left, key=lambda i: (-left[i][1], i))
    chosen, filled = [first], [0] * len(buckets)
    texts = [left.pop(first)[0]]
    while len(chosen) < k and left:
        def gain(i):
            s, q = left[i]
            return (1 - alpha) * q + alpha * (1 - max(identity_with(t)(s) for t in texts))

        best = min(left, key=lambda i: (-gain(i), i))
        s, _ = left.pop(best)
        spot = [n for n, (lo, hi, _) in enumerate(buckets) if lo <= len(s) < hi]
        if spot and filled[spot[-1]] >= buckets[spot[-1]][2]:
            continue
        if spot:
            filled[spot[-1]] += 1
        chosen.append(best)
        texts.append(s)
    return chosen


@pytest.mark.parametrize("pool", [3, 500])
@pytest.mark.parametrize("buckets", [(), ((0, 15, 2), (15, 25, 3))])
def test_diverse_selection(spark, pool, buckets):
    rng = random.Random(9)
    items = [(i, "".join(rng.choice("ACDE") for _ in range(rng.randrange(8, 30))), rng.random()) for i in range(60)]
    df = spark.createDataFrame(items, "id long, seq string, quality double")
    got = T.diverse_select(df, "id", "seq", "quality", 8, 0.4, buckets, pool=pool).orderBy("pick_order").collect()
    assert [r["id"] for r in got] == greedy(items, 8, 0.4, buckets)


def test_vendi_against_full_matrix(spark):
    rng = np.random.default_rng(3)
    rows = [(g, rng.normal(size=5).tolist(), bool(rng.random() < 0.8)) for g in (1, 2) for _ in range(12)]
    df = spark.createDataFrame(rows, "g long, v array<double>, keep boolean").repartition(4)
    got = {r["g"]: r["vendi"] for r in A.vendi(df, "g", "v", 5, F.col("keep")).collect()}
    for g in (1, 2):
        x = np.array([v for h, v, k in rows if h == g and k])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        eigen = np.clip(np.linalg.eigvalsh(x @ x.T / len(x)), 1e-15, None)
        assert got[g] == pytest.approx(np.exp(-(eigen * np.log(eigen)).sum()), rel=1e-6)
    empty = A.vendi(df, "g", "v", 5, F.lit(False)).collect()
    assert {r["vendi"] for r in empty} == {0.0}


def test_aligned_rmsd(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(20, 3)) * 5
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn[:, 0] *= np.sign(np.linalg.det(turn))
    moved = a @ turn + 3.0
    mirrored = a * np.array([-1, 1, 1])
    rows = [(1, *p, *q) for p, q in zip(a.tolist(), moved.tolist())]
    rows += [(2, *p, *q) for p, q in zip(a.tolist(), mirrored.tolist())]
    df = spark.createDataFrame(rows, "structure_id long, x double, y double, z double, px double, py double, pz double")
    got = {r["structure_id"]: r["rmsd"] for r in G.aligned_rmsd(df, "structure_id", F.lit(1.0)).collect()}
    assert got[1] == pytest.approx(0.0, abs=1e-5)
    centre = a - a.mean(0)
    u, s, v = np.linalg.svd(centre.T @ (mirrored - mirrored.mean(0)))
    s[2] *= np.sign(np.linalg.det(u) * np.linalg.det(v))
    best = np.sqrt(max(2 * (centre**2).sum() - 2 * s.sum(), 0) / len(a))
    assert got[2] == pytest.approx(best, rel=1e-6)
    none = G.aligned_rmsd(df, "structure_id", F.lit(0.0)).collect()
    assert all(np.isnan(r["rmsd"]) for r in none)


def test_planarity_keeps_the_ring_five_quirk(spark):
    flat = [(1, i, float(i % 3), float(i // 3), 0.0) for i in range(6)]
    bent = [(1, 10 + i, float(i % 3), float(i // 3), 2.0 * (i % 2)) for i in range(6)]
    atoms = spark.createDataFrame(flat + bent, "structure_id long, atom_idx long, x double, y double, z double")
    groups = spark.createDataFrame(
        [(1, 0, "ring_5", list(range(5))), (1, 1, "ring_6", list(range(6))), (1, 2, "ring_6", list(range(10, 16)))],
        "structure_id long, group_id long, kind string, atoms array<long>",
    )
    got = {r["kind"]: (r["num_violations"], r["num_groups"]) for r in G.planarity(atoms, groups).collect()}
    assert got == {"ring_5": (1, 1), "ring_6": (1, 2)}


def test_clashing_chains_rules(spark):
    def chain(structure, c, n, shift):
        return [(structure, 100 * c + i, c, 5.0 * i + shift, 0.0, 0.0) for i in range(n)]

    rows = chain(1, 0, 4, 0.0) + chain(1, 1, 8, 0.5)  # 4/4 against 4/8: the larger share goes
    rows += chain(2, 0, 4, 0.0) + chain(2, 1, 4, 0.5)  # same share and size: the larger id goes
    rows += chain(3, 0, 4, 0.0) + chain(3, 1, 4, 2.4)  # no clash
    df = spark.createDataFrame(rows, "structure_id long, atom_idx long, chain_id long, x double, y double, z double")
    got = {(r["structure_id"], r["chain_id"]) for r in G.clashing_chains(df).collect()}
    assert got == {(1, 0), (2, 1)}


def test_weighted_draw_follows_the_weights(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(40)], "k long, w double")
    got = weighted_draw(df, ["k"], "w", 4000, 11).groupBy((F.col("k") % 4).alias("m")).count().collect()
    share = {r["m"]: r["count"] / 4000 for r in got}
    assert 0 not in share and sum(share.values()) == 1
    assert share[3] == pytest.approx(0.5, abs=0.04) and share[1] == pytest.approx(1 / 6, abs=0.03)


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([(i % 2, float(i), i) for i in range(80)], "g long, v double, id long")
    for r in A.bootstrap_ci(df, ["g"], "v", "id", 300).collect():
        assert r["lower"] < r["mean"] < r["upper"]


def test_a3m_rules(spark, tmp_path):
    (tmp_path / "one.a3m").write_text("#comment\n>UniRef100_X1 a\nACD-E\n>q\nACaaD-Ek\n\n>UniRef100_X2\nacde\n>r\nA-CDE\n")
    taxonomy = spark.createDataFrame([("X1", 9)], "uniref_id string, taxonomy_id long")
    rows = R.read_a3m(spark, str(tmp_path), taxonomy).orderBy("seq_idx").collect()
    # the last two rows repeat the letters of the first
    assert [(r["seq_idx"], r["taxonomy"], r["residues"]) for r in rows] == [(0, 9, "ACD-E"), (1, -1, "ACD-E")]
    assert [tuple(d) for d in rows[1]["deletions"]] == [(2, 2)]
    assert R.read_a3m(spark, str(tmp_path), max_seqs=1).count() == 1


def test_typed_fasta_is_strict(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">A|protein|m\nAC\nDE\n>B|dna|m\nAC\n")
    rows = {r["chain_id"]: r for r in R.read_typed_fasta(spark, str(tmp_path), strict=False).collect()}
    assert rows["A"]["seq"] == "ACDE" and rows["A"]["error"] is None
    assert rows["B"]["error"] == "alignment given for a non-protein"
    with pytest.raises(Exception, match="non-protein"):
        R.read_typed_fasta(spark, str(tmp_path)).collect()


def test_pairing_small(spark):
    rows = [("c", 0, 0, -1), ("c", 0, 1, 5), ("c", 0, 2, 5), ("c", 1, 0, -1), ("c", 1, 1, 5), ("c", 1, 2, 8)]
    df = spark.createDataFrame(rows, "complex_id string, chain_id long, seq_idx long, taxonomy long")
    got = {(r["row"], r["chain_id"]): (r["seq_idx"], r["is_paired"]) for r in M.msa_pairing(df).collect()}
    assert got == {
        (0, 0): (0, 1), (0, 1): (0, 1), (1, 0): (1, 1), (1, 1): (1, 1), (2, 0): (2, 1), (2, 1): (1, 1),
        (3, 0): (1, 0), (3, 1): (1, 0), (4, 0): (2, 0), (4, 1): (2, 0),
    }


def test_stream_in_slices_equals_batch(spark):
    base = scratch_path(spark, "slices")
    rng = random.Random(8)
    commits = [(i, rng.randrange(6), 361 * 10 + i * 7) for i in range(400)]
    for n, part in enumerate(itertools.batched(commits, 80)):
        spark.createDataFrame(list(part), "commit_id long, uid long, block long").coalesce(1).write.parquet(f"{base}/in/slice={n}")
    stream = (
        spark.readStream.schema("commit_id long, uid long, block long")
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{base}/in/*")
    )
    got = {(r["epoch"], r["uid"]): r["block"] for r in E.run_and_read(E.latest_per_epoch(stream), "t").collect()}
    pdf = pd.DataFrame(commits, columns=["id", "uid", "block"])
    place = pdf["block"] % 361
    inside = pdf[(place > 0) & (place < 351)]
    closed = (inside["block"] // 361 + 1) * 361 <= inside["block"].max() - 10
    want = inside[closed].groupby([inside["block"] // 361, "uid"])["block"].max()
    assert got == {k: v for k, v in want.items()}


def test_archive_batch_can_be_retried(spark):
    base = scratch_path(spark, "retry")
    work = E.archive_new(base, "T", "molecule", "key")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "key string, seq_no long")
    second = spark.createDataFrame([("b", 3), ("c", 4), ("c", 5)], "key string, seq_no long")
    work(first, 0)
    for _ in range(2):
        work(second, 1)
    rows = R.read_archive(spark, base, "T", "molecule", "key").collect()
    assert {(r["key"], r["seq_no"]) for r in rows} == {("a", 1), ("b", 3), ("c", 5)}
    assert R.read_archive(spark, base, "U", "molecule", "key") is None
