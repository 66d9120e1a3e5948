"""Packing: an exact round trip, windows, proportions, and ids equal to the other library's."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievegrid.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizer_file(tokenizer):
    r = random.Random(1)
    parts = ["a", "bc", " ", "  ", "\n", "'s", "I'll", "1", "é", "²", " \n ", "\t", " ", "　", "中", "_", "<|endoftext|>", "\x1c", "\x85", "\U0001f600", "\r\n", "Ⅷ", "ß"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(3000)]
    encoding = packing.bpe_encoding(PATH)
    got = [encoding.encode_to_numpy(t, allowed_special=encoding.special_tokens_set).tolist() for t in texts]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def rebuilt(pieces, wanted):
    """Checks every piece against the documents' ids; returns the pieces by sequence."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, parts in by_doc.items():
        options = wanted[doc]
        total = sum(p.length for p in parts)
        assert total == sum(map(len, options))
        for p in parts:
            assert any(
                len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in options
            )
    assert set(by_doc) == set(wanted)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
    return by_sequence


def ids_of(tokenizer, rows):
    wanted = defaultdict(list)
    for i, t, _, _ in rows:
        wanted[i].append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    return wanted


def test_round_trip(make_docs, awkward, prose, tokenizer):
    rows = awkward + [(100 + i, prose(20 + i * 3, i), "en", "abcd"[i % 4]) for i in range(200)]
    pieces = packing.pack(make_docs(rows), PATH, lane_tokens=20_000).collect()
    rebuilt(pieces, ids_of(tokenizer, rows))


def test_windows_keep_the_proportions(make_docs, prose, tokenizer):
    rows = [(i, prose(400, i), "en", ["a", "b", "b", "c", "c", "c"][i % 6]) for i in range(600)]
    pieces = packing.pack(make_docs(rows).coalesce(1), PATH).collect()
    sequences = rebuilt(pieces, ids_of(tokenizer, rows))
    off = []
    for number, parts in sequences.items():
        if number < 1 << 61:
            share = defaultdict(int)
            for p in parts:
                share[p.source] += p.length
            off.append(max(abs(share[s] / 2048 - w / 6) for s, w in (("a", 1), ("b", 2), ("c", 3))))
    assert np.median(off) < 0.06


def test_deficits_carry_on():
    share = np.array([0.5, 0.3, 0.2])
    packer = packing.Packer(share, 100, 8, np.array([0.0, 60.0, -60.0]))
    for q in range(3):
        packer.add(q, (q, 10_000, str(q)), np.arange(10_000, dtype=np.uint32))
    taken = np.zeros(3)
    for _ in range(20):
        for _, _, ids, q in packer.fill(100):
            taken[q] += len(ids)
    assert taken.sum() == 2000
    assert np.allclose(taken + packer.deficits, share * 2000 + np.array([0, 60, -60]))
    assert np.abs(packer.deficits).max() < 40


def test_ten_thousand_sources_keep_their_proportions_in_the_steps_they_are_served():
    n, least, size = 10_000, 64, 2048
    share = np.append(np.full(n - 1, 0.5 / (n - 1)), 0.5)
    packer = packing.Packer(share, size, least)
    for q in range(n - 1):
        packer.add(q, (q, 300, str(q)), np.zeros(300, np.uint32))
    packer.add(n - 1, (n - 1, 3_000_000, "hot"), np.zeros(3_000_000, np.uint32))
    steps = 0
    for _ in range(2000):
        pieces = packer.fill(size)
        assert sum(len(ids) for _, _, ids, _ in pieces) == size
        assert abs(sum(len(ids) for _, _, ids, q in pieces if q == n - 1) / size - 0.5) < 0.1
        steps += len(pieces)
    assert steps < 2000 * 2 * size / least
    assert np.abs(packer.deficits[:-1]).max() < 3 * least and abs(packer.deficits[-1]) < 4 * size


def test_every_source_is_a_queue_of_its_own(make_docs, prose, tokenizer):
    """Sources by name, null and empty ones too; deficits go on from partitions to groups."""
    rows = [(i, prose(30 + i % 50, i), "en", None if i % 97 == 0 else "" if i % 89 == 0 else f"s{i % 60}" if i % 3 else "hot") for i in range(900)]
    pieces = packing.pack(make_docs(rows), PATH, lanes_per_group=2).collect()
    rebuilt(pieces, ids_of(tokenizer, rows))
    source = {i: s for i, _, _, s in rows}
    assert all(p.source == source[p.doc_id] for p in pieces)


def test_names_beyond_the_broadcast_bound(make_docs, prose, tokenizer, monkeypatch):
    rows = [(i, prose(20, i), "en", "hot" if i % 2 else f"s{i}") for i in range(300)] + [(1, None, None, None), (2, "", "en", None)]
    docs = make_docs(rows).selectExpr("doc_id", "source", "coalesce(text, '') AS text")
    shares = docs.groupBy("source").count().selectExpr("source", "count / 302 AS share")
    plain = packing._with_share(docs, shares).collect()
    monkeypatch.setattr(packing, "BROADCAST", 0)
    monkeypatch.setattr(packing, "HOT", 10)
    assert sorted(map(str, packing._with_share(docs, shares).select(*docs.columns, "share").collect())) == sorted(map(str, plain))
    rebuilt(packing.pack(make_docs(rows), PATH).collect(), ids_of(tokenizer, rows))


def test_empty_table(make_docs):
    assert packing.pack(make_docs([]), PATH).count() == 0


def test_wanted_proportions(make_docs, prose, tokenizer):
    rows = [(i, prose(200, i), "en", "ab"[i % 2]) for i in range(60)] + [(99, prose(9, 1), "en", None)]
    pieces = packing.pack(make_docs(rows), PATH, proportions={"a": 0.8, "b": 0.2}).collect()
    rebuilt(pieces, ids_of(tokenizer, rows))
