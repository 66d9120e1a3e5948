"""WARC archives: written and read back by Spark, and an index merged from sorted runs."""

from __future__ import annotations

import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.session import scratch_path

# The version line, the end of a record, the profile of a revisit.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"
EPOCH = 1_704_067_200  # 2024-01-01

ENTRY = (
    "url_key string, captured_at timestamp, page_id long, url string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, record_offset long, run string"
)


def base32_digest(payload: Column) -> Column:
    """SHA-1 of a binary column in bare upper-case base32.

    160 bits are 32 letters of 5 bits; the hex digits are read in groups of 5
    (20 bits, 4 letters each).
    """
    digest = F.sha1(payload)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda g: F.conv(F.substr(digest, g * 5 + 1, F.lit(5)), 16, 10).cast("long"),
    )
    spell = lambda v, shift: F.substr(
        F.lit(letters), (F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)
    )
    return F.array_join(
        F.transform(groups, lambda v: F.concat(*[spell(v, s) for s in (15, 10, 5, 0)])), ""
    )


def decide(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, keeper) of (page_id, payload).

    ``keeper`` is the largest page_id with the same payload; payloads below
    ``min_revisit_bytes`` are their own keepers. Equal payloads are those of
    equal digest and length.
    """
    known = pages.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_digest(F.col("payload").cast("binary")).alias("payload_digest"),
    )
    return known.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("keeper")
    )


def records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """One column ``value``: the record of each page without its closing blank lines.

    ``pages`` has page_id, url, html and captured_at. Null html is an empty
    payload, null url an empty target, a null time the first of 2024; a null
    page_id is an empty id, smaller than any other. Rows with equal page_id and payload are
    captures of their own with equal ids.
    """
    payload = F.coalesce("html", F.lit(""))
    digest = base32_digest(payload.cast("binary"))
    rows = pages.select(
        "page_id",
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("captured_at", F.timestamp_seconds(F.lit(EPOCH))).alias("captured_at"),
        payload.alias("payload"),
        digest.alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    keepers = decide(rows.select("page_id", "payload"), min_revisit_bytes)
    joined = rows.join(keepers, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    ident = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\n"),
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", ident(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
        line("WARC-Date", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, line("WARC-Refers-To", ident(F.col("keeper")))).otherwise(""),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return joined.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, rows_per_file: int = 20_000) -> None:
    """Archives below ``path``: gzip text files whose line separator is the end of a record.

    Spark's own writer and committer do the work, so a lost executor costs a
    task and leaves no half file. ``rows_per_file`` bounds the size of a file.
    """
    (
        records(pages, min_revisit_bytes)
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", rows_per_file)
        .text(path)
    )


def url_key(url: str) -> str:
    """The sort key of an address: host labels reversed, then path and query in lower case."""
    try:
        parts = urlsplit(url.strip().lower())
        host = parts.hostname or ""
    except ValueError:
        return url.strip().lower()
    labels = [x for x in host.split(".") if x]
    if labels[:1] == ["www"]:
        labels = labels[1:]
    return ",".join(reversed(labels)) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _inflate(chunk: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file in pieces; further members follow on."""
    unzip = zlib.decompressobj(31)
    data = memoryview(chunk)
    while len(data):
        piece = unzip.decompress(data[:size])
        data = data[size:]
        if piece:
            yield piece
        while unzip.eof and unzip.unused_data:
            rest, unzip = unzip.unused_data, zlib.decompressobj(31)
            piece = unzip.decompress(rest)
            if piece:
                yield piece


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers in lower case, block) of every record; blocks are cut by Content-Length.

    Raises on anything that isn't a record, so a damaged archive is noticed.
    """
    buffer, at, end = bytearray(), 0, False

    def fill(wanted: int) -> bool:
        nonlocal end
        while len(buffer) < wanted and not end:
            piece = next(pieces, None)
            if piece is None:
                end = True
            else:
                buffer.extend(piece)
        return len(buffer) >= wanted

    while fill(1):
        split, looked = -1, 0
        while split < 0:
            split = buffer.find(b"\r\n\r\n", max(0, looked - 3))
            looked = len(buffer)
            if split < 0 and not fill(looked + 1):
                raise ValueError(f"record at {at} has no end of header")
        first, *rest = bytes(buffer[:split]).decode("utf-8").split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"no record at {at}: {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
        length = int(headers["content-length"])
        if not fill(split + 4 + length + 4):
            raise ValueError(f"record at {at} is cut off")
        block = bytes(buffer[split + 4 : split + 4 + length])
        yield at, headers, block
        size = split + 4 + length + 4
        del buffer[:size]
        at += size


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below ``path``, checked against the payloads in them.

    Every response's payload is hashed and measured anew; a digest or length
    that differs raises. A file is read by one task in pieces.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import datetime

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for offset, head, block in parse(_inflate(content.as_buffer())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    declared = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    kind = head["warc-type"]
                    if kind == "response" and (
                        len(payload) != declared or b32encode(sha1(payload).digest()).decode() != digest
                    ):
                        raise ValueError(f"{name}: record at {offset} doesn't match its digest")
                    ident = lambda x: int(n) if (n := (x or "").strip("<>").removeprefix(RECORD_ID)) else None
                    when = datetime.datetime.strptime(head["warc-date"], "%Y-%m-%dT%H:%M:%SZ")
                    url = head.get("warc-target-uri", "")
                    rows.append(
                        (url_key(url), when.replace(tzinfo=datetime.timezone.utc), ident(head["warc-record-id"]), url,
                         kind, declared, digest, ident(head.get("warc-refers-to")), offset, name.rpartition("/")[2])
                    )
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 10, ARROW)], names=[x.name for x in ARROW_SCHEMA]
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(entries, ENTRY)


ARROW_SCHEMA = pa.schema(
    [("url_key", pa.string()), ("captured_at", pa.timestamp("us", tz="UTC")), ("page_id", pa.int64()), ("url", pa.string()),
     ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
     ("record_offset", pa.int64()), ("run", pa.string())]
)
ARROW = ARROW_SCHEMA.types


class LoserTree:
    """Merges sorted runs with one comparison per level for each row taken.

    Inner nodes hold the loser of the match below them, the root's winner is
    the run to take from. A run is an iterator of keys; an exhausted one loses
    against every other.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        n = len(runs)
        self.losers = [-1] * max(n, 1)
        winners = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            left, right = winners[2 * node], winners[2 * node + 1]
            first, second = (left, right) if self._before(left, right) else (right, left)
            winners[node], self.losers[node] = first, second
        self.winner = winners[1] if n > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None
        return (x, a) <= (y, b)

    def __iter__(self):
        n = len(self.runs)
        while n and self.heads[self.winner] is not None:
            run = self.winner
            yield run, self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            node = (run + n) // 2
            while node:
                if not self._before(run, self.losers[node]):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def merge_runs(entries: DataFrame) -> DataFrame:
    """All index entries in one order by (url_key, captured_at, page_id), with ``history``.

    ``history`` numbers the entries inside their range from 0. The ranges are
    cut by sampled keys that end in the page, so one address with a third of all
    captures spreads over many; in each, the slices of the runs lie one after
    another and a loser tree merges them. A task holds the index entries of its
    range, never a payload.
    """
    order = ["url_key", "captured_at", "page_id"]
    ranged = entries.repartitionByRange(*order).sortWithinPartitions("run", *order)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        held = held.combine_chunks()
        names = held.column("run").to_pylist()
        borders = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]
        keys = [
            (url, when, page is not None, page or 0) for url, when, page in zip(*[held.column(c).to_pylist() for c in order])
        ]  # nulls first, as Spark sorts
        runs = [((keys[i], i) for i in range(a, b)) for a, b in zip(borders, borders[1:])]
        places = [key[1] for _, key in LoserTree(runs)]
        merged = held.take(pa.array(places)).append_column("history", pa.array(range(len(places)), pa.int64()))
        yield from merged.to_batches(max_chunksize=10_000)

    return ranged.mapInArrow(merge, ENTRY + ", history long")


def archive(
    pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0, captured_at: Column | None = None
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, read them back, merge the index.

    Returns one row per page in capture order. ``captured_at`` defaults to one
    second per page_id from 2024 on.
    The runs are kept beside the archives, so that neither the sample for the
    ranges nor a lost task reads an archive again. An empty table gives an empty
    index. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    when = captured_at if captured_at is not None else F.timestamp_seconds(F.lit(EPOCH) + F.col("page_id"))
    write_archives(pages.select("page_id", "url", "html", when.alias("captured_at")), f"{path}/archive", min_revisit_bytes)
    read_archives(spark, f"{path}/archive").write.parquet(f"{path}/runs")
    return merge_runs(spark.read.schema(ENTRY).parquet(f"{path}/runs"))
