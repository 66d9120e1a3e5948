"""The conversation trie against a plain version, for any blocks and ranges; the radix tree against a dict."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sievegrid.llm import prefixtree

ROWS = "conv_id long, turn long, role string, text string, node string, key string, n long, range long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 1, 1) for r in rows], ROWS)


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(said, key=lambda t: (t[0], t[1] or 0))] for c, said in own.items()}
    convs = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(c - c % 20, [])[:h] + said[h:])
    return convs, nodes_of(convs)


def nodes_of(convs):
    members = defaultdict(list)
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members[said[:d]].append(c)
    out = []
    for p, found in members.items():
        under = [x for x in members if x[: len(p)] == p]
        kids = [x for x in under if len(x) == len(p) + 1]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].split()) for x in under if x)
        ends = ",".join(str(c) for c in sorted(found) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append(
            (min(found), len(p), parent, len(found), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def made_up(seed, convs=120, kinds=3, longest=7):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(r.randint(1, longest)):
            rows.append((c, turn, r.choice(["user", "bot", None]) if r.random() < 0.1 else "user", "word " * r.randrange(kinds) or None))
    return rows


@pytest.mark.parametrize("most_keys", [1, 3, 20_000])
def test_trie_for_any_block(spark, most_keys):
    rows = made_up(most_keys) + [(900 + i, t, "user", f"hot {t}") for i in range(40) for t in range(5)]
    rows += [(700, t, "user", f"long {t}") for t in range(300)] + [(701, t, "user", f"long {t}") for t in range(250)]
    rows += [(None, 1, "user", "lost"), (40, None, None, None), (41, 3, "user", "  two\nwords\x0b")]
    convs, want = plain(rows)
    built = prefixtree.spliced(prefixtree.sequences(frame(spark, rows)))
    assert {r.conv_id: len(r.turns) for r in built.collect()} == {c: len(s) for c, s in convs.items()}
    got = prefixtree.prefix_tree(built, most_keys=most_keys).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_turnless_and_equal_turns(spark):
    # conversation 5 has fewer than its h turns and borrows none: it is rebuilt without turns
    lone = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "user", "a"), (lone + 1000, 0, None, None), (lone + 1000, 0, None, None)]
    convs, want = plain(rows)
    assert convs[lone] == ()
    got = prefixtree.prefix_tree(prefixtree.spliced(prefixtree.sequences(frame(spark, rows)))).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert prefixtree.prefix_tree(prefixtree.spliced(prefixtree.sequences(frame(spark, [])))).count() == 0


def test_equal_turn_numbers_have_one_order(spark):
    rows = [(c, 0, "user", t) for c in (21, 22) for t in ("x y", "z")]
    a = prefixtree.prefix_tree(prefixtree.sequences(frame(spark, rows))).collect()
    b = prefixtree.prefix_tree(prefixtree.sequences(frame(spark, rows[::-1]))).collect()
    assert sorted(a) == sorted(b) and {r.n_convs for r in a} == {2}


def test_radix_tree_keeps_keys_in_all_layouts():
    r = random.Random(3)
    for spread in (3, 12, 40, 256):
        tree, want = prefixtree.RadixTree(), {}
        for i in range(3000):
            key = b"".join(bytes([r.randrange(spread)]) * 16 for _ in range(r.randint(0, 3)))
            key = key[:-1] + bytes([r.randrange(spread)]) if key else key
            tree.insert(key, i)
            want[key] = i
        got, rooms = {}, set()
        stack = [(tree.root, b"")]
        while stack:
            node, above = stack.pop()
            rooms.add(node.room)
            key = above + node.path
            if node.entry is not None:
                got[key] = node.entry
            pairs = node.items()
            assert [b for b, _ in pairs] == sorted({b for b, _ in pairs}) and len(pairs) == node.count <= node.room
            stack += [(child, key + bytes([b])) for b, child in pairs]
        assert got == want and max(rooms) == next(x for x in (4, 16, 48, 256) if spread <= x)


def test_end_hashes_of_many_pieces(spark):
    rows = [(b"a", i) for i in range(5000)] + [(b"b", -3), (b"b", 12)]
    got = {bytes(r.node): r.ends_sha256 for r in prefixtree.end_hashes(spark.createDataFrame(rows, "node binary, conv_id long"), 7).collect()}
    assert got == {
        b"a": hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest(),
        b"b": hashlib.sha256(b"-3,12").hexdigest(),
    }
