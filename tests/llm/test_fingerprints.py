"""Fingerprints against a plain Merkle tree, edits by brute force."""

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from sievegrid.llm import fingerprints as P


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root(text):
    lines = (text or "").split("\n")
    sections = []
    for i, line in enumerate(lines):
        if i == 0 or zlib.crc32(line.encode()) % P.SECTION_ODDS == 0 or (lines[i - 1] == "" and line != ""):
            sections.append([])
        sections[-1].append(sha(line))
    return sha("".join(sha("".join(s)) for s in sections))


def test_roots_equal_a_plain_tree(spark):
    r = random.Random(2)
    texts = ["".join(r.choices(["a", "b", "\n", "\n\n", ". ", "é", "\U0001f600"], k=r.randint(0, 40))) for _ in range(300)] + ["", None, "\n", "\n\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x for x in df.select("i", P.tree(F.col("t")).alias("t")).select("i", "t.root", P.spelled(F.col("t")).alias("s")).collect()}
    assert all(got[i].root == root(t) for i, t in enumerate(texts))
    plain = [t or "" for t in texts]
    assert len({x.s for x in got.values()}) == len(set(plain))


def test_differing_lines(spark):
    old = "\n".join(f"line {i} of it." for i in range(50))
    new = old.replace("line 7 ", "LINE 7 ").replace("line 33 ", "")
    df = spark.createDataFrame([(old, new)], "a string, b string").select(P.tree(F.col("a")).alias("a"), P.tree(F.col("b")).alias("b"))
    got = df.select(P.differing_lines(F.col("a"), F.col("b")).alias("d"), P.differing_lines(F.col("a"), F.col("a")).alias("e")).first()
    assert (got.d, got.e) == ([7, 33], [])


def branches(text):
    """[(node, weight, {leaf: (weight, phrases)})] of every section, by plain Python."""
    lines, sections = (text or "").split("\n"), []
    for i, line in enumerate(lines):
        if i == 0 or zlib.crc32(line.encode()) % P.SECTION_ODDS == 0 or (lines[i - 1] == "" and line != ""):
            sections.append([])
        sections[-1].append(line)
    return {tuple(s): 1 + sum(len(x) + 1 for x in s) for s in sections}


def alike(a, b):
    """Likeness by plain sets: whole sections, then lines of the others, then phrases of the lines left."""
    if (a or "") == (b or ""):
        return 1.0
    x, y = branches(a), branches(b)
    shared = sum(w for s, w in x.items() if s in y)
    left, right = [s for s in x if s not in y], [s for s in y if s not in x]
    total = 2 * shared + 2 + len(left) + len(right)
    one, two = {p for s in left for p in s}, {p for s in right for p in s}
    shared_lines = sum(len(p) + 1 for p in one & two)
    phrases = lambda lines: {q for p in lines for q in re.findall(P.PHRASE, p)}
    u, v = phrases(one - two), phrases(two - one)
    total += 2 * shared_lines + len(one - two) + len(two - one) + sum(map(len, u)) + sum(map(len, v))
    return 2 * (shared + shared_lines + sum(map(len, u & v))) / total


def test_likeness_equals_plain_sets_and_is_one_for_equal_texts_only(spark):
    r = random.Random(9)
    word = lambda: r.choice(["a b", "one two", "x", "Zeile", "é\U0001f600", "", "three four five six seven eight nine ten"])
    make = lambda: "".join(word() + r.choice([". ", "\n", "\n\n", ", ", "!!! "]) for _ in range(r.randint(0, 25)))
    pairs = [("alpha beta. gamma delta! one two, three.", "three.one two, gamma delta! alpha beta. "), ("", None), ("", "\n"), ("a\nb", "b\na")]
    for _ in range(300):
        a = make()
        pairs.append((a, make() if r.random() < 0.3 else a[: len(a) // 2] + word() + a[len(a) // 2 :]))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    df = df.select("i", P.tree(F.col("a")).alias("a"), P.tree(F.col("b")).alias("b"))
    got = df.select(
        "i", P.likeness(F.col("a"), F.col("b")).alias("n"), P.likeness(F.col("b"), F.col("a")).alias("m"),
        P.differing_lines(F.col("a"), F.col("b")).alias("gone"), (F.col("a.root") == F.col("b.root")).alias("same"),
    ).collect()
    for g in got:
        a, b = pairs[g.i]
        assert g.n == pytest.approx(alike(a, b), abs=1e-12) and g.m == pytest.approx(g.n, abs=1e-12)
        assert (g.n == 1.0) == g.same == ((a or "") == (b or ""))
        x, y = branches(a), branches(b)
        kept = {p for s in y if s not in x for p in s}
        lines, want, at = (a or "").split("\n"), [], 0
        for i, line in enumerate(lines):
            if i == 0 or zlib.crc32(line.encode()) % P.SECTION_ODDS == 0 or (lines[i - 1] == "" and line != ""):
                at = i
            stop = next((j for j in range(at + 1, len(lines)) if zlib.crc32(lines[j].encode()) % P.SECTION_ODDS == 0 or (lines[j - 1] == "" and lines[j] != "")), len(lines))
            if tuple(lines[at:stop]) not in y and line not in kept:
                want.append(i)
        assert g.gone == want


def test_many_lines_cost_no_square(make_docs, prose):
    def seconds(n):
        lines = "\n".join(f"{i} {prose(6, i)}" for i in range(n))
        start = time.time()
        got = P.fingerprint_edits(make_docs([(1, lines, "en", "a"), (2, "other " + lines[::-1], "en", "a")])).collect()
        assert {r.doc_id: 0.6 < r.near_edited < 0.9 for r in got} == {1: True, 2: True}
        return time.time() - start

    seconds(100)
    small = seconds(2000)
    assert seconds(8000) < 6 * small + 4


@pytest.mark.parametrize("partitions", [1, 7])
def test_edits(make_docs, awkward, prose, partitions):
    rows = awkward + [(10 * i + 50, prose(30 + i, i).replace(". ", ".\n"), "en", "s") for i in range(200)]
    got = P.fingerprint_edits(make_docs(rows).repartition(partitions)).collect()
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t, _, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = []
    for k, (i, t) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + other[:q]
        want.append((i, len(t), sha(edited), root(t), root(edited)))
    key = lambda x: tuple(map(str, x))
    found = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint.split("|")[0], r.edited_fingerprint.split("|")[0]) for r in got]
    assert sorted(found, key=key) == sorted(want, key=key)
    texts = {(i, sha(t[: len(t) - len(t) // 4] + order[(k + 1) % len(order)][1][: len(t) // 4])): (t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)}
    by_text = {}
    for r in got:
        if r.doc_id and r.doc_id >= 50:
            t, other = texts[r.doc_id, r.edited_sha256]
            assert r.near_next == pytest.approx(alike(t, other), abs=1e-12)
            assert r.near_edited == pytest.approx(alike(t, t[: len(t) - len(t) // 4] + other[: len(t) // 4]), abs=1e-12)
            assert (r.lines_gone + r.lines_new == "") == (r.near_edited == 1.0)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(r.fingerprint.split("|")[0], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    real = [r for r in got if r.doc_id and r.doc_id >= 50]
    assert sum(r.near_edited for r in real) / len(real) > 0.6
    assert sum(r.near_next for r in real) / len(real) < 0.1


def test_one_row_and_none(make_docs):
    got = P.fingerprint_edits(make_docs([(5, "abcd efgh", "en", "a")])).first()
    assert got.edited_sha256 == sha("abcd efab") and got.near_next == 1.0
    assert P.fingerprint_edits(make_docs([])).count() == 0
