"""Golden values worked out by hand, and brute force where SQL cannot say it."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.functions import alignment as N
from sievegrid.functions import intake as I
from sievegrid.functions import liabilities as L
from sievegrid.functions import scoring as C
from sievegrid.functions import sequences as S
from sievegrid.operators import gates as G


def one(spark, expr, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "seq,runs,pairs",
    [("", 0, 0), ("A", 1, 0), ("AAA", 3, 0), ("AAAA", 4, 0), ("AACA", 2, 0), ("ACDE", 1, 1), ("GSGSGS", 1, 3),
     ("ABABCBCBC", 1, 3), ("XAXA", 1, 2), ("AAAB", 3, 0)],
)
def test_runs_and_pair_repeats(spark, seq, runs, pairs):
    assert one(spark, S.max_run_length(F.col("s")), s=seq) == runs
    assert one(spark, S.max_pair_repeats(F.col("s")), s=seq) == pairs


def test_pair_repeats_of_a_long_repeat(spark):
    assert one(spark, S.max_pair_repeats(F.col("s")), s="GS" * 40000) == 40000


def test_cys_pair_and_signal_peptide(spark):
    assert one(spark, S.has_cys_pair(F.col("s"), 3, 4), s="CAAC") is True
    assert one(spark, S.has_cys_pair(F.col("s"), 3, 4), s="CAC") is False
    assert one(spark, S.signal_peptide_like(F.col("s")), s="GGGG" + "L" * 8 + "GGGG") is True
    assert one(spark, S.signal_peptide_like(F.col("s")), s="LLLLLLLL") is False
    assert one(spark, S.signal_peptide_like(F.col("s")), s="G" * 30 + "L" * 12) is False


def test_entropy_and_charge(spark):
    assert one(spark, S.residue_entropy(F.col("s")), s="ACDE") == pytest.approx(2.0)
    assert one(spark, S.residue_entropy(F.col("s")), s="") == 0.0
    assert one(spark, L.net_charge(F.col("s")), s="KKRDE") == 1


def brute_liabilities(seq):
    found = []
    for name, pattern in L.ANTIBODY_MOTIFS.items():
        found += [(name, m.start() + 1, len(m.group())) for m in re.finditer(pattern, seq)]
    places = [i + 1 for i, c in enumerate(seq) if c == "C"]
    paired = {p for a, b in zip(places, places[1:]) if b - a in (1, 2) for p in (a, b)}
    found += [("UnpairedCys", p, 1) for p in places if p not in paired]
    if sum(seq.count(c) for c in "KR") - sum(seq.count(c) for c in "DE") > 1:
        found.append(("HighNetCharge", None, 0))
    return sorted(found, key=str)


def test_liabilities_against_python(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randrange(1, 90))) for _ in range(150)]
    rows = spark.createDataFrame([(s,) for s in seqs], ["s"])
    got = rows.select("s", L.liability_violations(F.col("s")).alias("v")).collect()
    for r in got:
        assert sorted([(v["motif"], v["pos"], v["len"]) for v in r["v"]], key=str) == brute_liabilities(r["s"])


def test_liability_summary_text(spark):
    v = L.liability_violations(F.col("s"), "peptide", "cyclic")
    text = one(spark, L.violations_summary(v, "peptide", "cyclic"), s="WWWWWA")
    assert "TrpOxx5(pos1-5,sev10)" in text and "LowHydrophilic(0.0% hydrophilic,sev7)" in text
    assert "ConsecIdentical(5 consecutive identical,sev7)" in text


def test_hydrophobicity_edges(spark):
    h = lambda s: one(spark, S.hydrophobicity(F.col("s")), s=s)
    assert math.isnan(h("")) and math.isnan(h("AXA"))
    assert h("W") == round(11.1 * (1 - 0.055 * 7), 4)
    assert h("WW") == round((11.1 + 11.8) * (1 - 0.055 * 6), 4)


def test_seed_and_hash_modulo(spark):
    text = "some record"
    digest = hashlib.sha256(text.encode()).digest()
    want = (int.from_bytes(digest[:8], "little") ^ 68) % (2**31 - 1)
    assert one(spark, C.record_seed(F.col("s")), s=text) == want
    hexed = "0x" + hashlib.sha256(text.encode()).hexdigest()
    assert one(spark, C.hash_mod(F.col("s"), 7), s=hexed) == int(hexed, 16) % 7
    assert one(spark, C.hash_mod(F.col("s"), 7), s=hexed[2:]) is None


@pytest.mark.parametrize(
    "text,molecules,sequences",
    [
        ("rxn:1:2:3,,|AA", ["rxn:1:2:3"], ["AA"]),
        ("  ~|AA,BB \n", [], ["AA", "BB"]),
        ("a b|c", None, None),
        ("a|b|c", None, None),
        ("|c", None, None),
        ("é|c", None, None),
    ],
)
def test_parse_submission(spark, text, molecules, sequences):
    got = one(spark, I.parse_submission(F.col("s")), s=text)
    assert (got is None) if molecules is None else (got["molecules"], got["sequences"]) == (molecules, sequences)


def test_payload_literal(spark):
    lit = lambda s: one(spark, I.payload_literal(F.col("s")), s=s)
    assert lit(r"(12, b'\x01\'q')") == 12
    assert lit("(12, 'text')") is None
    assert lit("(1.5, b'x')") is None
    assert lit("(7, b'" + "\\x00" * 5000 + "')") == 7
    assert lit("(7, b'" + "a" * 21000 + "')") is None


def test_product_names_and_reactions(spark):
    p = one(spark, I.parse_product(F.col("s")), s="'rxn:4:10:20:30'")
    assert (p["rxn"], p["m1"], p["m2"], p["m3"]) == (4, 10, 20, 30)
    assert one(spark, I.parse_product(F.col("s")), s="rxn:4:10") is None
    assert one(spark, I.reaction_allowed(F.col("s"), "rxn:4"), s="rxn:04:1:2") is True
    assert one(spark, I.reaction_allowed(F.col("s"), "rxn:4"), s="rxn:x:1:2") is False
    assert one(spark, I.reaction_allowed(F.col("s"), None), s="") is True
    assert one(spark, I.heavy_atoms(F.col("s")), s="CC(=O)[NH3+]Cl[H]") == 5
    assert one(spark, I.contains_element(F.col("s"), ["Se"]), s="C[Se]C") is True


def plain_lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return int(table[-1, -1])


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a = "".join(rng.choice("ACG") for _ in range(rng.randrange(0, 30)))
        b = "".join(rng.choice("ACG") for _ in range(rng.randrange(0, 30)))
        assert N.common_subsequence(N.letter_masks(a), len(a), b) == plain_lcs(a, b)


def plain_affine(a, b, score, open_gap, extend):
    inf = -1e18
    m = np.full((3, len(a) + 1, len(b) + 1), inf)
    m[0, 0, 0] = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                m[0, i, j] = m[:, i - 1, j - 1].max() + score(a[i - 1], b[j - 1])
            if i:
                m[1, i, j] = max(m[0, i - 1, j] + open_gap, m[2, i - 1, j] + open_gap, m[1, i - 1, j] + extend)
            if j:
                m[2, i, j] = max(m[0, i, j - 1] + open_gap, m[1, i, j - 1] + open_gap, m[2, i, j - 1] + extend)
    return m[:, -1, -1].max()


def test_affine_score():
    rng = random.Random(6)
    score = lambda x, y: 4.0 if x == y else -2.0
    for _ in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 15)))
        b = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 15)))
        profile = {x: np.array([score(x, y) for y in a]) for x in "ACGT"}
        assert N.affine_score(a, profile, b, -5, -1) == pytest.approx(plain_affine(a, b, score, -5, -1))


def test_duplicate_tiers_and_rules(spark):
    null = F.lit(None).cast("double")
    tier = lambda i, c1, c2, c3, has: one(
        spark, G.duplicate_tier(F.lit(i), F.lit(c1), F.lit(c2), F.lit(c3), F.lit(has)), z=1
    )
    assert tier(0.96, 0.0, 0.0, 0.0, True)["reason"] == "near-identical sequence"
    assert tier(0.5, 0.0, 0.0, 0.86, True)["reason"] == "CDR3 identity 86% (same clonotype)"
    assert tier(0.5, 0.9, 0.9, 0.8, True)["reason"] == "CDR3=80% with conserved CDR1/CDR2"
    assert tier(0.91, 0.0, 0.0, 0.0, True)["dup"] is False
    assert one(spark, G.duplicate_tier(F.lit(0.91), null, null, null, F.lit(False)), z=1)["dup"] is True
    assert G.parse_filter_rule("rmsd<2.5") == ("rmsd", True, 2.5)
    assert G.parse_metric_weight("iptm=none") == ("iptm", None)
    assert G.parse_size_bucket("10-20:5") == (10, 20, 5)
