"""k-mer search and its match details against a plain search."""

import random

import pytest

from sievegrid.functions.alignment import identity_with
from sievegrid.operators import similarity as Y

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def words(seq, k):
    return {seq[i : i + k] for i in range(len(seq) - k + 1)}


def data(seed):
    r = random.Random(seed)
    make = lambda n: "".join(r.choices(LETTERS, k=n))
    frame = make(30)  # k-mers that all hold
    refs = [("t", i, frame + make(20)) for i in range(12)] + [("u", i, make(40)) for i in range(5)] + [("u", 9, "ACD")]
    queries = [(i, frame[: r.randint(0, 30)] + r.choice(refs)[2][25 : r.randint(26, 50)] + make(r.randint(0, 8))) for i in range(80)]
    return refs, queries + [(90, ""), (91, queries[0][1])]


@pytest.mark.parametrize("least,share", [(1, 0.0), (5, 0.0), (5, 0.2), (1, 0.5)])
def test_search_equals_the_plain_one(spark, least, share):
    refs, queries = data(least)
    got = Y.kmer_search(
        spark.createDataFrame(queries, "query long, seq string"), spark.createDataFrame(refs, "target string, ref long, ref_seq string"), 5, least, share
    )
    want = {}
    for q, seq in queries:
        for t, ref, text in refs:
            both = len(words(seq, 5) & words(text, 5))
            union = len(words(seq, 5) | words(text, 5))
            if both >= max(least, 1) and both / union >= share:
                want[q, t, ref] = (both, both / union, identity_with(seq)(text))
    assert {(x.query, x.target, x.ref): (x.shared, x.jaccard, x.identity) for x in got.collect()} == want and want


def test_match_details(spark):
    kind = "key long, target string, ref long, identity double"
    matches = spark.createDataFrame([(1, "t", 1, 0.5), (2, "t", 1, 0.5), (3, "t", 1, 0.92), (4, "t", 1, 0.92), (5, "t", 1, 0.96), (6, "t", 2, 0.1)], kind)
    region = "cdr1 string, cdr2 string, cdr3 string"
    queries = spark.createDataFrame(
        [(1, "AAAA", "CCCC", "DDDDDDDDDD"), (2, "AAAA", "CCCC", "DDDDDDDDWW"), (3, None, None, None), (4, "WWWW", "WWWW", "WWWW"), (5, "W", "W", "W")],
        f"key long, {region}",
    )
    refs = spark.createDataFrame([("t", 1, "AAAA", "CCCC", "DDDDDDDDDD"), ("t", 2, None, None, None)], f"target string, ref long, {region}")
    got = {x.key: x for x in Y.match_details(matches, queries, refs, "key").collect()}
    assert {i: x.dup for i, x in got.items()} == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False}
    assert got[1].reason.startswith("CDR3 identity 100%") and got[2].reason == "CDR3=80% with conserved CDR1/CDR2"
    assert got[2].cdr_similarity == pytest.approx(0.25 + 0.25 + 0.4) and got[3].cdr_similarity is None


def test_pairs_that_share_too_little_are_never_shuffled(spark, monkeypatch):
    """The function over an index block gives out the matches only, with several blocks and a repeated reference."""
    monkeypatch.setattr(Y, "REFERENCES", 4)
    frame = "ACDEFGHIKL"
    refs = [("t", i, frame + c * 10) for i, c in enumerate("MNPQRSTVWY")] + [("t", 3, frame + "Q" * 10)]
    queries = [(i, frame + c * 10) for i, c in enumerate("MNPQRSTVWY") if i != 3] + [(50, frame), (51, None)]
    got = Y.kmer_search(spark.createDataFrame(queries, "query long, seq string"), spark.createDataFrame(refs, "target string, ref long, ref_seq string"), 5, 8, 0.4)
    assert sorted((x.query, x.ref, x.shared) for x in got.collect() if x.ref != 3) == [(i, i, 11) for i in range(10) if i != 3]
    # a reference that comes twice counts twice, and each of its rows gives one
    assert sorted((x.query, x.shared) for x in got.collect() if x.ref == 3) == sorted([(i, 12) for i in range(10) if i != 3] * 2 + [(50, 12)] * 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_the_coarse_count_gives_only_what_may_pass():
    import pyarrow as pa

    left = pa.table({"_id": [b"1", b"2"], "seq": ["ACDEFGHIKL", "ACDEFYYYYY"]})
    right = pa.table({"target": ["t", "t"], "ref": [1, 2], "ref_seq": ["ACDEFGHIKLMN", "YYYYYACDEF"]})
    got = Y._counted(5, 3, 0.5)(left, right)
    assert got.select(["_id", "ref", "shared"]).to_pylist() == [{"_id": b"1", "ref": 1, "shared": 6}]
    assert Y._counted(5, 3, 0.5)(left.slice(0, 0), right).num_rows == Y._counted(5, 3, 0.5)(left, right.slice(0, 0)).num_rows == 0
