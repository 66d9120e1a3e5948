"""Archives: exact round trips, revisits, and the merge of runs."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sievegrid.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload string, run string"


def test_loser_tree_equals_sorting():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 17):
        runs = [sorted((r.randint(0, 50), r.random()) for _ in range(r.choice([0, 1, 30]))) for _ in range(k)]
        got = [key for _, key in W.LoserTree([iter(x) for x in runs])]
        assert got == sorted(sum(runs, []))


def test_base32_digest(spark):
    values = [b"", b"a", "é".encode(), bytes(range(256))]
    df = spark.createDataFrame([(bytearray(v),) for v in values], "p binary")
    got = [r.d for r in df.select(W.base32_digest(F.col("p")).alias("d")).collect()]
    assert got == [base64.b32encode(hashlib.sha1(v).digest()).decode() for v in values]


@pytest.fixture
def rows():
    nasty = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"
    out = [(i, f"https://www.h{i % 5}.example.com/p{i % 9}?q={i}", f"<p>page {i % 40}</p>" * (1 + i % 7), "x", "x") for i in range(200)]
    out += [(200, "u", nasty, "", ""), (201, "u", nasty + "é\U0001f600", "", ""), (202, None, None, "", ""), (203, "http://[bad", "", "", ""),
            (204, "line\r\nbreak", "z" * 3_000_000, "", ""), (205, "u", "\r\n\r\n", "", "")]
    return out + [(300 + i, "http://hot.org/", "<p>copy</p>", "", "") for i in range(300)]


def expected(rows, least=0):
    payload = {i: (h or "").encode() for i, _, h, _, _ in rows}
    keeper = {}
    for i, p in payload.items():
        keeper[p] = max(i, keeper.get(p, i))
    out = {}
    for i, p in payload.items():
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        own = len(p) < least or keeper[p] == i
        out[i] = (len(p), digest, "response" if own else "revisit", None if own else keeper[p])
    return out


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, rows, least, tmp_path):
    pages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = W.archive(pages, str(tmp_path / "a"), least).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected(rows, least)
    assert len(got) == len(rows)
    keys = [(r.url_key, r.captured_at, r.page_id) for r in got]
    assert keys == sorted(keys)


def test_damage_is_noticed(spark, rows, tmp_path):
    pages = spark.createDataFrame(rows[:5], SCHEMA).select("page_id", "url", "html", F.timestamp_seconds("page_id").alias("captured_at"))
    record = W.records(pages.coalesce(1))
    record.select(F.replace("value", F.lit("<p>page"), F.lit("<p>Page")).alias("value")).write.option("lineSep", W.END).option("compression", "gzip").text(str(tmp_path / "b"))
    with pytest.raises(Exception, match="doesn't match its digest"):
        W.read_archives(spark, str(tmp_path / "b")).collect()


def test_repeated_rows_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a", "", ""), (1, "u", "a", "", ""), (2, "u", "b", "", "")], SCHEMA)
    got = W.archive(pages, str(tmp_path / "c")).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (1, "response"), (2, "response")]
    assert W.archive(pages.limit(0), str(tmp_path / "d")).count() == 0


def test_nulls(spark, tmp_path):
    rows = [(None, "u", "a", "", ""), (None, None, None, None, None), (3, "u", "a", "", ""), (None, "v", "b", "", "")]
    got = W.archive(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "e")).collect()
    found = sorted((r.page_id or -1, r.url_key, r.record_type, r.refers_to or -1) for r in got)
    assert found == [(-1, ")/", "response", -1), (-1, ")u", "revisit", 3), (-1, ")v", "response", -1), (3, ")u", "response", -1)]


def test_url_keys():
    assert W.url_key("HTTPS://www.A.Example.com:80/X?y=1#z") == "com,example,a)/x?y=1"
    assert W.url_key("") == ")/"
