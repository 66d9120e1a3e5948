"""Near-duplicates against all pairs, and the alignment against dynamic programming."""

import random

import numpy as np

from sievegrid.llm import neardup as N


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def labelled(text, width=5):
    return N.label_occurrences(N.shingles(N.word_hashes(np.frombuffer(text.encode(), np.uint8)), width))


def edited(text, rate, seed):
    r = random.Random(seed)
    return " ".join(w if r.random() >= rate else r.choice(["", "new", "other", w + "x"]) for w in text.split()).strip()


def test_words_hash_alike_wherever_they_stand():
    a = N.word_hashes(np.frombuffer(b"one two  three\n", np.uint8))
    b = N.word_hashes(np.frombuffer(b"\ttwo one\nthree two", np.uint8))
    assert len(a) == 3 and len(b) == 4
    assert a[0] == b[1] and a[1] == b[0] == b[3] and a[2] == b[2]
    assert len(set(a.tolist())) == 3


def test_alignment_equals_dynamic_programming(prose):
    for seed in range(60):
        a = prose(60, seed) + " again and again and again and again and again and again"
        b = edited(a, random.Random(seed).choice([0.0, 0.01, 0.03, 0.1, 0.5]), seed)
        x, y = labelled(a), labelled(b)
        m = longest_common(x.tolist(), y.tolist())
        want = m / (len(x) + len(y) - m)
        assert N.aligned(x, y, 0.8) == (want if want >= 0.8 else 0.0)


def test_order_matters(prose):
    a, b = prose(100, 1), prose(100, 2)
    assert N.aligned(labelled(a + " " + b), labelled(b + " " + a), 0.8) == 0.0


def brute_force(rows):
    """Class of every row: links between all texts, followed to the end."""
    texts = sorted({(t or "") for _, t, _, _ in rows})
    found = [labelled(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = texts[i].split() == texts[j].split()
            if same or N.aligned(found[i], found[j], 0.8) >= 0.8 and len(found[i]) and len(found[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    place = {t: label[i] for i, t in enumerate(texts)}
    least = {}
    for i, t, _, _ in rows:
        k = place[t or ""]
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return {(i, t): least.get(place[t or ""]) for i, t, _, _ in rows}


def test_classes_equal_all_pairs(make_docs, prose, awkward):
    rows = list(awkward)
    n = 100
    for family in range(12):
        first = prose(random.Random(family).choice([8, 30, 200]), 50 + family)
        rows.append((n, first, "en", "a"))
        for copy in range(12 if family == 0 else 3):
            n += 1
            rows.append((n, edited(first, random.Random(n).choice([0.0, 0.01, 0.02, 0.03]), n), "en", "a"))
        n += 1
    passage = prose(60, 999)
    rows += [(n + k, prose(30, 2000 + k) + " " + passage + " " + prose(30, 3000 + k), "en", "b") for k in range(25)]
    want = brute_force(rows)
    texts = {}
    for i, t, _, _ in rows:
        texts.setdefault(i, set()).add(t)
    got = N.near_duplicates(make_docs(rows)).collect()
    assert len(got) == len(rows)
    for row in got:
        options = {want[(row.doc_id, t)] for t in texts[row.doc_id]}
        assert row.class_id in options
        assert row.kept == (row.class_id == row.doc_id)


def test_large_group_and_empty_table(make_docs, prose):
    text = prose(100, 5)
    rows = [(i, text if i % 2 else edited(text, 0.002 * (i % 5), i), "en", "a") for i in range(300)]
    want = brute_force(rows)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(make_docs(rows)).collect()}
    assert got == {i: want[(i, t)] for i, t, _, _ in rows}
    assert N.near_duplicates(make_docs([])).count() == 0


def test_links_past_the_leader(make_docs, prose):
    """Copies of one text, further apart from each other than from it, and chains away from the leader."""
    rows, n = [], 0
    for family in range(3):
        first = prose(120, family)
        for copy in range(40):
            text = edited(first, 0.012 + 0.0005 * copy, 100 * family + copy)
            rows.append((n, text, "en", "a"))
            n += 1
            if copy % 5 == 0:
                rows.append((n, edited(text, 0.01, copy), "en", "a"))
                n += 1
    want = brute_force(rows)
    assert 10 < len(set(want.values())) < n - 10
    for block in (8, 512):
        got = {r.doc_id: r.class_id for r in N.near_duplicates(make_docs(rows), block=block).collect()}
        assert got == {i: want[(i, t)] for i, t, _, _ in rows}


def test_near_copies_without_an_id_are_linked(make_docs, prose):
    """A copy without an id belongs to its class, and one may be the bridge between two others."""
    first, alone = prose(200, 1).split(), prose(150, 2)
    change = lambda words, a, b: " ".join("new" if a <= i < b and i % 5 == 0 else w for i, w in enumerate(words))
    rows = [
        (1, change(first, 0, 15), "en", "a"), (None, " ".join(first), "en", "a"), (2, change(first, 185, 200), "en", "a"),
        (None, alone, "en", "a"), (None, alone + " end", "en", "a"), (3, prose(90, 3), "en", "a"),
    ]
    x, y, z = (labelled(t) for _, t, _, _ in rows[:3])
    assert N.aligned(x, y, 0.8) and N.aligned(y, z, 0.8) and not N.aligned(x, z, 0.85)
    docs = make_docs(rows)
    want = brute_force(rows)
    got = N.near_duplicates(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.class_id) for r in got))) == sorted(map(str, ((i, want[(i, t)]) for i, t, _, _ in rows)))
    assert N.keepers(docs).count() == 3
