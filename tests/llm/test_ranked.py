"""Ranked search against a plain ranking, for any blocks; bounds that hold and blocks that are skipped."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sievegrid.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string, doc_id long, score long"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def plain(docs, items, k=20):
    found = [(i, Counter(terms(t or ""))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    total, length = len(found), sum(n for _, _, n in found)
    held = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in sorted({x for x in items if x[1] is not None}, key=str):
        asked, rows = Counter(terms(text)), []
        for i, c, n in found:
            m = 75 + (25 * n * total) // length
            score = sum(
                q * math.floor(1000 * math.log((2 * total + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, q in asked.items()
                if c[t]
            )
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if u else i, -s) for r, (s, u, i) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def run(spark, make_docs, rows, items, **more):
    docs = make_docs([(i, t, "en", "a") for i, t in rows])
    asked = spark.createDataFrame([(*x, 1, 1) for x in items], ITEM)
    return sorted(map(tuple, ranked.search(docs, asked, **more).collect()), key=str)


def corpus(prose, n=400):
    rows = [(i, prose(5 + i % 60, i % 90, "aeinrst")) for i in range(n)]  # texts come again: ties
    return rows + [(n + i, prose(30, 1000 + i // 20, "aeinrst") + f" extra{i}") for i in range(200)]


@pytest.mark.parametrize("more", [{}, {"block": 3, "cells": 1}, {"most_terms": 5}, {"k": 1, "block": 8}])
def test_equals_plain_ranking(spark, make_docs, prose, awkward, more):
    rows = corpus(prose) + [(i, t) for i, t, _, _ in awkward]
    items = [(i, prose(20, 1000 + i, "aeinrst")) for i in range(8)] + [(90, "é中 x É"), (91, ""), (92, None), (93, "nowhere!"), (None, "One two two")]
    items += [items[0], (0, "another text")]
    assert run(spark, make_docs, rows, items, **more) == plain(rows, items, more.get("k", 20))


def test_empty_tables(spark, make_docs, prose):
    assert run(spark, make_docs, [], [(1, "a")]) == []
    assert run(spark, make_docs, [(1, None), (2, "!!")], [(1, "a")]) == []
    assert run(spark, make_docs, [(1, "a")], []) == []


def test_terms_are_those_of_the_pattern():
    r = random.Random(2)
    for _ in range(500):
        text = "".join(chr(r.choice([r.randrange(0, 0x100), r.randrange(0x100, 0xD800), r.randrange(0x10000, 0x11000)])) for _ in range(20))
        assert [t.decode() for t in ranked.terms_of(text)] == terms(text)


def test_summaries_bound_and_blocks_are_skipped():
    """Documents of a few themes: blocks of other themes stay closed, and nothing is lost."""
    r = np.random.default_rng(4)
    themes, docs, vocabulary = 12, 3000, 600
    impacts = np.zeros((docs, vocabulary), np.int32)
    theme = r.integers(0, themes, docs)
    for d in range(docs):
        own = theme[d] * 50 + r.choice(50, 25, replace=False)
        impacts[d, own] = r.integers(100_000, 900_000, 25)
        impacts[d, r.choice(vocabulary, 3)] = 200_000
    impacts[:, 599] = 300_000  # a term that all have
    weights = r.integers(1, 9000, vocabulary)
    queries = [ranked.Query(i, i, {**{int(t): 1 for t in i * 50 + r.choice(50, 20, replace=False)}, 599: 2}) for i in range(themes)]
    columns = ranked.Columns(queries, vocabulary)
    index = ranked.BlockedIndex(impacts, weights, columns)
    ids, unknown, scored = np.arange(docs), np.zeros(docs, bool), 0
    for q in queries:
        whole = index.score(ids, q, weights)
        for t, bounds in index.bounds(q, weights, columns):
            for b, members in enumerate(index.block_docs(t, np.arange(len(bounds)))):
                assert whole[members].max() <= bounds[b]
        best = ranked.Best(20)
        scored += ranked.visit(index, q, weights, columns, best, ids, unknown)
        order = np.lexsort((ids, -whole))[:20]
        assert best.ids.tolist() == order.tolist() and best.scores.tolist() == whole[order].tolist()
    assert scored < 0.4 * docs * themes
