"""Secret scans against the patterns in Python, and the added spans."""

import hashlib
import random
import re
import string
import time

from pyspark.sql import functions as F

from sievegrid.llm import secrets
from sievegrid.llm.common import match_spans, offsets, running_max

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_offsets_are_prefix_sums(spark):
    values = [random.Random(1).randint(0, 9) for _ in range(1000)]
    got = spark.range(1).select(offsets(F.array(*[F.lit(v) for v in values])).alias("o")).first().o
    assert got == [sum(values[:i]) for i in range(len(values))]
    assert spark.range(1).select(offsets(F.array().cast("array<int>")).alias("o")).first().o == []


def test_spans_count_code_points(spark):
    df = spark.createDataFrame([("\U0001f600abé ab",), ("",), ("ab",)], "t string")
    got = [[(s.start, s.stop) for s in r.s] for r in df.select(match_spans(F.col("t"), "ab").alias("s")).collect()]
    assert got == [[(1, 3), (5, 7)], [], [(0, 2)]]


def test_scan_equals_patterns_and_finds_random_tokens(make_docs, prose, awkward):
    r = random.Random(3)
    random_token = lambda n: "".join(r.choices(string.ascii_letters + string.digits + "+/", k=n))
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    rows, planted = list(awkward), {}
    for i in range(100, 160):
        text = prose(60, i)
        if i % 3 == 0:
            planted[i] = random_token(40)
            text += " key " + planted[i] + " end"
        if i % 4 == 0:
            text += f" PassWord: '{hexes(18)}' token={hexes(5)} é api_key = {random_token(12)} AKIA{'Q7' * 8} {hexes(30)}"
        if i % 5 == 0:
            text += " averyveryverylongwordofonlylettersinit some/path/to/a/file/of/mine/here 2024-01-01-2024-02-02-2024"
        rows.append((i, text, "en", "s"))
    scanned = secrets.scan(make_docs(rows)).cache()
    got = secrets.digest(scanned).collect()
    assert len(got) == len(rows)
    texts = dict((i, t or "") for i, t, _, _ in rows)
    for row in got:
        want = base(texts[row.doc_id])
        spelled = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert row.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[1] == k for s in want) for k in range(3)]
        added = [tuple(map(int, s.split(":")[1:])) for s in row.spans.split(",") if s.startswith("random")]
        assert [texts[row.doc_id][a:b] for a, b in added] == ([planted[row.doc_id]] if row.doc_id in planted else [])
    clean = {r.doc_id: r.text for r in secrets.redact(scanned).filter("doc_id >= 100").collect()}
    for i, token in planted.items():
        assert token not in clean[i] and "[SECRET]" in clean[i]
    untouched = [i for i in range(100, 160) if i not in planted and i % 4]
    assert all(clean[i] == texts[i] for i in untouched)


def test_every_encoding_is_discovered(make_docs, prose):
    """Unassigned tokens of small alphabets are found, words and numbers of those alphabets aren't."""
    r = random.Random(11)
    upper, digits = string.ascii_uppercase, string.digits
    kinds = [("0123456789ABCDEF", 40), (upper + "234567", 52), (string.ascii_lowercase + digits, 40), (upper + digits, 40), ("0123456789ABCDEF", 32)]
    ordinary = ["20240101000020240102", "INTERNATIONALIZATIONOFTHINGS2", "averylongnameofsomething2024final", "0000DEADBEEF0000DEADBEEF", "1" * 30]
    rows, planted = [], {}
    for i in range(100):
        letters, n = kinds[i % len(kinds)]
        planted[i] = "".join(r.choices(letters, k=n))
        rows.append((i, prose(20, i) + f" {planted[i]} end", "en", "s"))
        rows.append((1000 + i, prose(20, 1000 + i) + f" {ordinary[i % len(ordinary)]} end", "en", "s"))
    found = {}
    for row in secrets.scan(make_docs(rows)).collect():
        found[row.doc_id] = [row.text[x.start : x.stop] for x in row.added]
    for k in range(len(kinds)):
        hits = sum(found[i] == [planted[i]] for i in range(k, 100, len(kinds)))
        assert hits >= 16, (kinds[k], hits)
    assert not any(found[1000 + i] for i in range(100))


def test_overlapping_spans_are_one_gap(make_docs):
    text = "x token = abcdef0123456789abcdef0123456789 y"
    docs = make_docs([(1, text, "en", "a"), (2, None, "en", "a")])
    got = {r.doc_id: r.text for r in secrets.redact(secrets.scan(docs)).collect()}
    assert got == {1: "x [SECRET] y", 2: None}


def test_running_max(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        values = [random.Random(n).randint(0, 999) for _ in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>").select(running_max(F.col("v")).alias("m"))
        assert df.first().m == [max(values[:i], default=None) for i in range(n)]


def dense(n, seed):
    """A text with n hex strings and n unassigned random tokens, and some assignments that hold hex."""
    r = random.Random(seed)
    parts = []
    for i in range(n):
        parts.append("".join(r.choices("0123456789abcdef", k=40)))
        parts.append("".join(r.choices(string.ascii_letters + string.digits, k=32)))
        if i % 10 == 0:
            parts.append("token = " + "".join(r.choices("0123456789abcdef", k=30)) + "é\n")
    return " ".join(parts)


def test_many_spans_in_one_text(make_docs):
    text = dense(700, 1)
    scanned = secrets.scan(make_docs([(1, text, "en", "a")])).cache()
    row = scanned.first()
    spans = base(text)
    assert [(s.start, s.kind_order, s.kind, s.stop) for s in row.base] == spans
    assert len(row.added) >= 690 and all(not any(s[0] < a.stop and a.start < s[3] for s in spans) for a in row.added)
    gaps, clean, at = [], [], 0
    for start, stop in sorted([(s[0], s[3]) for s in spans] + [(a.start, a.stop) for a in row.added]):
        if gaps and start < gaps[-1][1]:
            gaps[-1][1] = max(gaps[-1][1], stop)
        else:
            gaps.append([start, stop])
    for start, stop in gaps:
        clean.append(text[at:start])
        at = stop
    assert secrets.redact(scanned).first().text == "[SECRET]".join([*clean, text[at:]])


def test_time_grows_with_the_spans(make_docs):
    times = []
    for n in (50, 1000, 4000):
        docs = make_docs([(1, dense(n, n), "en", "a")]).cache()
        docs.count()
        start = time.time()
        assert len(secrets.redact(secrets.scan(docs)).first().text) > n
        times.append(time.time() - start)
    assert times[2] - times[0] < 6 * max(times[1] - times[0], 1)


def test_empty_table(make_docs):
    assert secrets.digest(secrets.scan(make_docs([]))).count() == 0
