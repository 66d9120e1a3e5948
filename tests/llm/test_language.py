"""Language identification: texts, declared tags, hosts, and texts that point nowhere."""

import pyarrow as pa

from sievegrid.llm import language as L

LETTERS = {"en": "etaoinshrdlu", "fr": "éèàçuqxvjpze", "de": "äöüßkwzgfbch"}


def corpus(prose):
    rows = []
    for k, (tag, letters) in enumerate(LETTERS.items()):
        for i in range(60):
            declared = tag if i % 10 else "en"
            rows.append((1000 * k + i, prose(50, 1000 * k + i, letters), declared, f"www.site{k}.example.{tag}"))
    return rows


def test_held_out_texts_and_wrong_tags(make_docs, prose):
    model = L.fit(make_docs(corpus(prose)))
    fresh = [(9000 + 10 * k + i, prose(30, 77_000 + 10 * k + i, letters), "fr-CA" if i % 2 else None, "other.org") for k, (_, letters) in enumerate(LETTERS.items()) for i in range(10)]
    got = L.identify(make_docs(fresh), model).collect()
    names = list(LETTERS)
    assert all(r.language == names[(r.doc_id - 9000) // 10] and r.kept for r in got)


def test_evidence_decides_where_the_text_does_not(make_docs, prose):
    model = L.fit(make_docs(corpus(prose)))
    rows = [(1, "zzz", None, "www.site2.example.de"), (2, "zzz", None, "sub.example.fr"), (3, "zzz", "fr", "nowhere")]
    got = {r.doc_id: r.language for r in L.identify(make_docs(rows), model).collect()}
    plain = {r.doc_id: r.posterior for r in L.identify(make_docs([(1, "zzz", None, None)]), model).collect()}
    assert got[1] == "de"
    assert {r.doc_id: r.posterior for r in L.identify(make_docs(rows[:1]), model).collect()}[1] != plain[1]


def test_host_counts_are_smoothed_towards_the_levels_above():
    import numpy as np

    model = L.Model(["a", "b"], np.zeros((2, L.BINS), np.float32))
    model.levels = [np.array([[50.0, 50.0]]), np.zeros((4, 2)), np.zeros((4, 2)), np.zeros((4, 2))]
    model.levels[1][1] = [10, 30]
    model.levels[3][2] = [5, 0]
    got = np.exp(model.prior(np.array([[0, 0, 0], [1, 0, 0], [1, 0, 2]]), 20.0))
    suffix = (10 + 20 * 0.5) / 60
    assert np.allclose(got[:, 0], [0.5, suffix, (5 + 20 * suffix) / 25])


def test_trigrams_stay_inside_their_text():
    column = pa.array(["abc", None, "", "ab", "xABcd", "1 2"])
    seen = {}
    for owner, bins in L.trigrams(column):
        for o, b in zip(owner.tolist(), bins.tolist()):
            seen.setdefault(o, []).append(b)
    assert {k: len(v) for k, v in seen.items()} == {0: 1, 4: 3}
    assert seen[4][1] == seen[0][0]
    assert L.trigrams(column.slice(4, 1)) and sum(len(b) for _, b in L.trigrams(column.slice(4, 1))) == 3


def test_awkward_rows(make_docs, awkward):
    docs = make_docs(awkward)
    got = L.identify(docs, L.fit(docs)).collect()
    assert len(got) == len(awkward)
    for row in got:
        if not (row.text or "").strip():
            assert (row.language, row.kept, row.posterior) == ("und", False, 0.0)
        else:
            assert row.kept and 0.5 <= row.posterior <= 1
    empty = make_docs([])
    assert L.identify(empty, L.fit(empty)).count() == 0
    nameless = make_docs([(1, "some words", None, None)])
    assert [r.kept for r in L.identify(nameless, L.fit(nameless)).collect()] == [False]


def test_no_host_takes_the_counts_of_another(make_docs, prose, monkeypatch):
    """Many hosts, one of them hot: the posterior is that of every host's own counts."""
    import numpy as np

    rows = [(i, prose(20, i, LETTERS["de"]), "de", "hot.example.de") for i in range(300)]
    rows += [(1000 + i, prose(20, 1000 + i, LETTERS["fr"]), "fr", f"h{i}.site{i}.fr") for i in range(200)]
    docs = make_docs(rows)
    model = L.fit(docs)
    names = {(r.level, r.name): {f.k: f.n for f in r.facts} for r in model.names.collect()}
    de, fr = model.languages.index("de"), model.languages.index("fr")
    assert names[3, "hot.example.de"] == {de: 300} and names[1, "fr"] == {fr: 200}
    assert all(names[3, f"h{i}.site{i}.fr"] == names[2, f"site{i}.fr"] == {fr: 1} for i in range(200))
    assert len(names) == 2 + 201 + 201
    whole = {r.doc_id: (r.language, r.posterior) for r in L.identify(docs, model).collect()}
    monkeypatch.setattr(L, "BROADCAST", 0)
    monkeypatch.setattr(L, "HOT", 10)
    assert {r.doc_id: (r.language, r.posterior) for r in L.identify(docs, model).collect()} == whole
    assert all(v[0] == ("de" if i < 1000 else "fr") for i, v in whole.items()) and len(whole) == len(rows)


def test_every_declared_language_is_a_class_and_the_rest_is_one(make_docs, prose):
    tags = [a + b for a in "abcdefghij" for b in "qrstuvwx"]
    rows = []
    for k, tag in enumerate(tags):
        letters = "".join(chr(0x1000 + 12 * k + j) for j in range(12))
        rows += [(10 * k + i, prose(40, 10 * k + i, letters), tag, "x.org") for i in range(3)]
    rows += [(5000 + i, "\u0b05\u0b06\u0b07 \u0b08", t, "x.org") for i, t in enumerate(["zz", "zzy", "zzx"])]
    docs = make_docs(rows)
    model = L.fit(docs)
    assert model.languages == sorted([*tags, L.REST])
    got = {r.doc_id: r.language for r in L.identify(docs, model).collect()}
    assert all(got[i] == (tag if i < 5000 else L.REST) for i, _, tag, _ in rows)
