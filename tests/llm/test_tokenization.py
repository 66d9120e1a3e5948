"""The token automaton: plain merging on random merge lists, ids and texts equal to the other library's."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievegrid.llm import tokenization

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return tokenization.tokenizer(PATH)


def merged(word, merges):
    """Plain merging: the earliest merge anywhere, leftmost first."""
    rank = {(u, v): (k, w) for k, (u, v, w) in enumerate(merges)}
    word = list(word)
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(word, word[1:])) if p in rank]
        if not found:
            return word
        (_, w), i = min(found, key=lambda f: (f[0][0], f[1]))
        word[i : i + 2] = [w]


def test_automaton_equals_plain_merging():
    r = random.Random(5)
    for _ in range(150):
        letters = "abc"[: r.randint(1, 3)]
        labels, merges = list(letters), []
        while len(merges) < r.randint(0, 14):
            u, v = r.randrange(len(labels)), r.randrange(len(labels))
            if len(labels[u] + labels[v]) > 9 or labels[u] + labels[v] in labels:
                if len(letters) == 1 or r.random() < 0.2:
                    break
                continue
            merges.append((u, v, len(labels)))
            labels.append(labels[u] + labels[v])
        automaton = tokenization.Automaton(merges, list(enumerate(letters)))
        for _ in range(60):
            word = "".join(r.choices(letters, k=r.randint(0, 16)))
            assert automaton.read(list(word)) == merged([letters.index(c) for c in word], merges), (word, merges)


def test_improper_merges_are_refused():
    with pytest.raises(ValueError):
        tokenization.Automaton([(2, 0, 3), (0, 1, 2)], [(0, "a"), (1, "b")])


def test_ids_and_texts_equal_the_library(coder, library):
    r = random.Random(1)
    parts = ["a", "bc", "The", " ", "  ", "\n", "'s", "I'LL", "1", "é", "é", "²", "\t", " ", "　", "中", "_", "Σ", "ΑΣ", "İ",
             "<|endoftext|>", "<|startoftext|>", "<|endof", "\x1c", "\x85", "\x00", "\U0001f600", "\r\n", "Ⅷ", "ß", "!!", "aaaa", "ing", "ﬁ"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(r.choices("aeinothrsl", k=r.randint(1, 60))) for _ in range(1000)] + ["", "x" * 3000]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = coder.encode(t)
        assert ids.tolist() == e.ids, t
        assert tokenization.spell(tokenization.arc_labels(PATH), ids) == library.decode(e.ids, skip_special_tokens=False)


def test_every_code_point(coder, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}B " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    assert all(coder.encode(t).tolist() == e.ids for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)))


def test_one_long_word_costs_its_length(coder):
    coder.encode("warm up")
    times = []
    for n in (20_000, 160_000):
        word, start = "".join(random.Random(n).choices("aeinothrsl", k=n)), time.process_time()
        coder.encode(word)
        times.append(time.process_time() - start)
    assert times[1] < 30 * times[0]


def test_operator(make_docs, awkward, library):
    docs = make_docs(awkward).withColumnRenamed("base", "ids").withColumnRenamed("next", "decoded")
    coded = tokenization.decode(tokenization.encode(docs, PATH), PATH)
    assert sorted(coded.columns) == sorted(docs.columns)
    got = sorted((tuple(x) for x in tokenization.digest(coded).collect()), key=str)
    want = []
    for i, t, _, _ in awkward:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert tokenization.decode(tokenization.encode(make_docs([]), PATH), PATH).count() == 0
    nothing = coded.select("doc_id").withColumn("ids", tokenization.F.lit(None).cast("binary"))
    assert {x.decoded for x in tokenization.decode(nothing, PATH).collect()} == {""}
