"""Template matching against all matchings, batched alignment against one pair at a time."""

import itertools
import random
import time

import numpy as np
from sievegrid.functions import alignment as N
from sievegrid.operators import templates as M

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
PAIR = {(a, b): (4.0 if a == b else -1.0 - (ord(a) + ord(b)) % 3) for a in LETTERS for b in LETTERS}


def profile(reference):
    return {x: np.array([PAIR[(x, y)] for y in reference]) for x in LETTERS}


def test_batched_scores_equal_one_at_a_time():
    r = random.Random(2)
    make = lambda n: "".join(r.choices(LETTERS, k=n))
    a = [make(r.choice([0, 1, 5, 30, 80])) for _ in range(300)] + [None, "A"]
    b = [make(r.choice([0, 1, 7, 33, 90])) for _ in range(300)] + ["A", None]
    got = N.affine_scores(a, b, N.Substitutions(PAIR), cells=900)
    want = [N.affine_score(y, profile(y), x) for x, y in zip(a[:300], b[:300])]
    assert got[:300].tolist() == want and np.isnan(got[300:]).all()


def test_batched_scores_are_faster():
    r = random.Random(3)
    seqs, reference = ["".join(r.choices(LETTERS, k=r.randint(50, 90))) for _ in range(3000)], "".join(r.choices(LETTERS, k=100))
    table, p = N.Substitutions(PAIR), profile(reference)
    start = time.process_time()
    one = [N.affine_score(reference, p, s) for s in seqs[:600]]
    slow = (time.process_time() - start) * 5
    start = time.process_time()
    many = N.affine_scores(seqs, [reference] * len(seqs), table)
    assert many[:600].tolist() == one and (time.process_time() - start) * 4 < slow


def plain_total(weights):
    rows, cols = sorted({r for r, _ in weights}), sorted({c for _, c in weights})
    best = 0
    for k in range(min(len(rows), len(cols)) + 1):
        for some in itertools.combinations(rows, k):
            for to in itertools.permutations(cols, k):
                if all((r, c) in weights for r, c in zip(some, to)):
                    best = max(best, sum(weights[(r, c)] for r, c in zip(some, to)))
    return best


def test_auction_finds_the_best_total():
    r = random.Random(4)
    for _ in range(250):
        n, m = r.randint(1, 5), r.randint(1, 5)
        weights = {(i, j): r.choice([1, 5, 5, 300, r.randint(1, 900)]) for i in range(n) for j in range(m) if r.random() < 0.7}
        found = M.best_matching(weights)
        assert len(set(found.values())) == len(found)
        assert sum(weights[p] for p in found.items()) == plain_total(weights)
    seven = {(i, j): r.randint(1, 500) for i in range(7) for j in range(7)}
    best = max(sum(seven[(i, p[i])] for i in range(7)) for p in itertools.permutations(range(7)))
    assert sum(seven[p] for p in M.best_matching(seven).items()) == best
    alike = {(i, j): 2000 for i in range(60) for j in range(25)}  # more chains than places, all alike
    assert len(M.best_matching(alike)) == 25 and M.best_matching({}) == {}


def plain_spans(a, b):
    best, found = 0, set()
    for i, j in itertools.product(range(len(a)), range(len(b))):
        total = 0
        for n in range(1, min(len(a) - i, len(b) - j) + 1):
            total += PAIR[(a[i + n - 1], b[j + n - 1])]
            if total <= 0:
                break
            if total > best:
                best, found = total, set()
            if total == best:
                found.add((i, i + n, j, j + n))
    return {(s, e, t, u) for s, e, t, u in found if not any(x > s and y == e and v == u for x, y, _, v in found)}


def test_spans_equal_all_diagonals():
    r = random.Random(6)
    for _ in range(150):
        a, b = "".join(r.choices("ACD", k=r.randint(0, 9))), "".join(r.choices("ACD", k=r.randint(0, 9)))
        assert set(N.ungapped_spans(a, b, N.Substitutions(PAIR))) == plain_spans(a, b)


def test_structures_equal_all_matchings(spark):
    r = random.Random(8)
    make = lambda n: "".join(r.choices(LETTERS, k=n))
    chains, templates = [], []
    for s in range(6):
        kinds = [make(40) for _ in range(3)]
        vary = lambda x: x[: r.randint(0, 6)] + x[:20] + make(r.randint(0, 3)) + x[20:]
        chains += [(s, c, vary(r.choice(kinds))) for c in range(r.randint(1, 4))] + [(s, 90, ""), (s, 91, None)]
        templates += [(s, t, c, vary(r.choice(kinds))) for t in range(2) for c in range(r.randint(1, 4))]
    left = spark.createDataFrame(chains, "structure_id long, chain_id long, seq string")
    right = spark.createDataFrame(templates, "structure_id long, template_id long, template_chain long, seq string")
    got = M.template_match(left, right, PAIR).collect()
    seeds = {tuple(x)[:4] for x in M.seeded_pairs(left, right).collect()}
    letters = {(s, c): x for s, c, x in chains}
    for s, t in {(s, t) for s, t, _, _ in templates}:
        weights = {}
        for s2, t2, c, x in templates:
            for s3, d, y in chains:
                if (s2, t2) == (s, t) and s3 == s and (s, t, d, c) in seeds:
                    weights[(d, c)] = N.affine_score(x, profile(x), y)
        weights = {p: w for p, w in weights.items() if w > 0}
        mine = [x for x in got if (x.structure_id, x.template_id) == (s, t)]
        assert all(weights[(x.chain_id, x.template_chain)] == x.score for x in mine)
        assert len({x.chain_id for x in mine}) == len({x.template_chain for x in mine}) == len(mine)
        assert sum(x.score for x in mine) == plain_total(weights)
    of = {(s, t, c): x for s, t, c, x in templates}
    for x in got:
        a, b = letters[(x.structure_id, x.chain_id)], of[(x.structure_id, x.template_id, x.template_chain)]
        assert {tuple(q) for q in x.spans} == plain_spans(a, b)
    assert M.template_match(left.limit(0), right, PAIR).count() == 0


def plain_seeds(chains, templates, k, least):
    """Every shared k-mer of every two rows, by its first places; rows of one key add up."""
    lines = {}
    for s, c, x in chains:
        for s2, t, d, y in templates:
            if s is not None and s == s2:
                for w in {x[i : i + k] for i in range(len(x or "") - k + 1)} if x and y else ():
                    if w in y:
                        key = (s, t, c, d, x.index(w) - y.index(w))
                        lines[key] = lines.get(key, 0) + 1
    found = {}
    for (*pair, _), n in lines.items():
        if n >= least:
            found[tuple(pair)] = max(n, found.get(tuple(pair), 0))
    return found


def test_seeds_are_found_where_the_letters_meet(spark):
    """Letters travel to their structure; rows of k-mers, many times larger, aren't made at all."""
    r = random.Random(9)
    make = lambda n: "".join(r.choices("ACDE", k=n))
    chains = [(s, c, make(r.randint(0, 40))) for s in range(5) for c in range(6)]
    templates = [(s, t, c, make(r.randint(0, 40))) for s in range(1, 6) for t in range(2) for c in range(5)]
    chains += chains[3:9] + [(2, None, make(30)), (None, 1, make(30)), (3, 2, make(25)), (3, 7, None)]
    templates += templates[4:8] + [(None, 0, 1, make(30)), (2, 1, None, make(30)), (3, 1, 9, None)]
    left = spark.createDataFrame(chains, "structure_id long, chain_id long, seq string")
    right = spark.createDataFrame(templates, "structure_id long, template_id long, template_chain long, seq string")
    for k, least in ((3, 2), (5, 1)):
        found = M.seeded_pairs(left, right, k, least)
        rows = [tuple(x) for x in found.collect()]
        assert {x[:4]: x[4] for x in rows} == plain_seeds(chains, templates, k, least) and len({x[:4] for x in rows}) == len(rows)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_equal_matchings_do_not_depend_on_the_order_of_rows(spark):
    one, other = "ACDEFGHIKLMNPQRSTVWY", "YWVTSRQPNMLKIHGFEDCA"
    chains = [(0, c, one if c % 2 else other) for c in range(7)]
    templates = [(0, 1, c, one if c % 3 else other) for c in range(5)]
    got = []
    for turn in (1, -1):
        left = spark.createDataFrame(chains[::turn], "structure_id long, chain_id long, seq string")
        right = spark.createDataFrame(templates[::turn], "structure_id long, template_id long, template_chain long, seq string")
        got.append(sorted((x.chain_id, x.template_chain, x.score) for x in M.template_match(left, right, PAIR).collect()))
    assert got[0] == got[1] and len(got[0]) == 5
