"""Mixing: targets by plain arithmetic, words near their targets, reruns that agree."""

import re
from collections import Counter, defaultdict

import pytest

from sievegrid.llm import mixing


def fair(sizes, weights=(1.0, 2.0, 3.0), limit=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * share > limit * sizes[s]}
        if not full:
            return target | {s: weight[s] * share for s in free}
        for s in full:
            target[s] = float(limit * sizes[s])
            left -= target[s]
        free -= full
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("hot", [False, True])
def test_mix(make_docs, prose, awkward, hot):
    rows = list(awkward)
    for i in range(300):
        source = "a" if hot and i % 2 else ["a", "b", "é", "Z", "\U0001f600", None][i % 6]
        rows.append((100 + i, prose(5 + i % 90, i), "en", source))
    rows.append((9000, prose(4, 1), "en", "tiny"))
    docs = make_docs(rows)
    result = mixing.mix(docs)
    got = result.documents.collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    want = fair(sizes)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, words(t)) for i, t, _, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= max(6 * result.block, 0.01 * want[s])
    again = mixing.mix(docs).documents.collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_slots_follow_the_targets_from_the_start(make_docs, prose):
    docs = make_docs([(i, prose(50, i), "en", "abc"[i % 3]) for i in range(120)])
    plan = mixing.mix(docs).schedule.orderBy("slot").collect()
    share = Counter(r.s for r in plan)
    first = Counter(r.s for r in plan[: len(plan) // 10])
    for s in share:
        assert abs(first[s] - share[s] / 10) < 8
    for s in share:
        ranks = [(r["pass"], r.block) for r in plan if r.s == s]
        assert ranks == sorted(ranks)


def test_sources_smaller_than_blocks_get_their_targets(make_docs, prose):
    """Sources of less than a block, of a block and a bit, and of several, as in a large input."""
    sizes = {"big": 6000, "s1": 2, "s2": 7, "s3": 50, "s4": 130, "s5": 420}
    rows, n = [], 0
    for source, size in sizes.items():
        for at in range(0, size, 40):
            rows.append((n, prose(min(40, size - at), n), "en", source))
            n += 1
    for slots in (60, 25):
        result = mixing.mix(make_docs(rows), slots=slots)
        taken, want = Counter(), fair(sizes)
        for r in result.documents.collect():
            assert 0 <= r.taken <= 3 * r["size"]
            taken[r.source] += r.taken
        for s in sizes:
            assert abs(taken[s] - want[s]) <= 0.5 + 1e-6, (slots, s)
        plan = result.schedule.collect()
        assert len({r.slot for r in plan}) == len(plan)
        planned = Counter()
        for r in plan:
            planned[r.s[1:]] += r.words
        assert planned == taken


def test_empty_tables(make_docs):
    assert mixing.mix(make_docs([])).documents.count() == 0
    got = mixing.mix(make_docs([(1, None, None, None), (2, "", "en", "a")])).documents.collect()
    assert [(r["size"], r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2
