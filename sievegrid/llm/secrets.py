"""Secrets: fixed patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.sequences import bind
from sievegrid.llm.common import BLOCK, match_spans, running_max

# The three base patterns and their least lengths, in the order of the kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    ("assign", ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

# Encodings: name, pattern, letters, chance that two neighbours are of different classes
# (lower, upper, digit, other) in a random string of that encoding; the same chance and
# that of two equal characters in ordinary text of that alphabet (None: as ``scan`` is told).
# Ordinary in hex are numbers with a few letters, in base32 and base36 words with a few digits.
ENCODINGS = [
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", 16, 0.46875, 0.1, 0.1),
    ("base32", "^[A-Z2-7]+=*$", 32, 0.3046875, 0.05, 0.066),
    ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", 36, 0.4012346, 0.1, 0.066),
    ("base62", "^[A-Za-z0-9]+$", 62, 0.6222164, None, None),
    ("base64", ".", 64, 0.6445313, None, None),
]
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BINS, STRATA = 400, (4, 10)
PART = 4096


def _classes(token: Column) -> Column:
    """The token with every character replaced by its class l, u, d or o."""
    letters = F.translate(token, LOWER + UPPER + "0123456789", "l" * 26 + "u" * 26 + "d" * 10)
    return F.regexp_replace(letters, "[^lud]", "o")


def _switches(token: Column) -> Column:
    runs = _classes(token)
    for c in "ludo":
        runs = F.regexp_replace(runs, f"{c}+", c)
    return F.length(runs) - 1


def battery(token: Column, accept: float, switch_rate: float, coincidence: float) -> Column:
    """Struct (encoding, z_chi, z_runs, z_serial, p) of one token of 2+ characters.

    The three z values test whether the token is random in its inferred
    encoding: chi-squared over the alphabet (Wilson-Hilferty), the number of
    class switches, the lag-one correlation of the character codes. Where one of
    them leaves ``accept`` the token isn't random and p is 1. Otherwise p is the
    chance of as many switches and as few coincidences in ordinary text, from
    Chernoff bounds (so never too small) joined by Fisher's rule; ``switch_rate``
    and ``coincidence`` are those of ordinary text in base62 and base64, smaller
    alphabets have their own (``ENCODINGS``). Numbers and
    tokens of one class have p = 1.
    """
    n = F.length(token).cast("double")

    def kind(field: int, default: float | None = None) -> Column:
        out = None
        for row in ENCODINGS:
            hit = F.lit(default if row[field] is None else row[field])
            out = F.when(token.rlike(row[1]), hit) if out is None else out.when(token.rlike(row[1]), hit)
        return out

    def finish(s: Column) -> Column:
        chi = s["letters"] / s["n"] * s["squares"] - s["n"]
        df = s["letters"] - 1.0
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        steps = s["n"] - 1
        z_runs = (s["switches"] - steps * s["rate"]) / F.sqrt(steps * s["rate"] * (1 - s["rate"]))
        z_serial = F.when(s["var"] > 0, s["cov"] / s["var"] * F.sqrt(s["n"])).otherwise(F.lit(99.0))
        r = F.least(s["switches"] / steps, F.lit(1 - 1e-9))
        kl = r * F.log(r / s["usual"]) + (1 - r) * F.log((1 - r) / (1 - s["usual"]))
        p_runs = F.when(r > s["usual"], F.exp(-steps * kl)).otherwise(1.0)
        pairs = (s["squares"] - s["n"]) / 2
        mean = s["alike"] * s["n"] * steps / 2
        p_pairs = (
            F.when(pairs >= mean, 1.0)
            .when(pairs <= 0, F.exp(-mean))
            .otherwise(F.exp(pairs - mean - pairs * F.log(pairs / mean)))
        )
        q = F.greatest(p_runs * p_pairs, F.lit(1e-300))
        p = F.least(q * (1 - F.log(q)), F.lit(1.0))
        random = (z_chi <= accept) & (F.abs(z_runs) <= accept) & (F.abs(z_serial) <= accept)
        return F.struct(
            s["encoding"].alias("encoding"),
            z_chi.alias("z_chi"),
            z_runs.alias("z_runs"),
            z_serial.alias("z_serial"),
            F.when(random & (s["switches"] > 0), p).otherwise(1.0).alias("p"),
        )

    def moments(codes: Column) -> Column:
        total = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x)
        return bind(
            F.transform(F.array(total / F.size(codes)), lambda mean: F.transform(codes, lambda x: x - mean))[0],
            lambda d: F.struct(
                F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x).alias("var"),
                F.aggregate(
                    F.zip_with(
                        F.slice(d, F.lit(1), F.size(d) - 1),
                        F.slice(d, F.lit(2), F.size(d) - 1),
                        lambda x, y: x * y,
                    ),
                    F.lit(0.0),
                    lambda a, x: a + x,
                ).alias("cov"),
            ),
        )

    def counted(chars: Column) -> Column:
        squares = F.aggregate(
            F.array_distinct(chars),
            F.lit(0.0),
            lambda acc, c: acc + F.pow(n - F.length(F.replace(token, c, F.lit(""))), 2.0),
        )
        return bind(
            moments(F.transform(chars, lambda c: F.ascii(c).cast("double"))),
            lambda m: bind(
                F.struct(
                    n.alias("n"),
                    kind(0).alias("encoding"),
                    kind(2).cast("double").alias("letters"),
                    kind(3).alias("rate"),
                    kind(4, switch_rate).alias("usual"),
                    kind(5, coincidence).alias("alike"),
                    squares.alias("squares"),
                    _switches(token).cast("double").alias("switches"),
                    m["var"].alias("var"),
                    m["cov"].alias("cov"),
                ),
                finish,
            ),
        )

    return bind(F.split(token, ""), counted)


def _stratum(length: Column) -> Column:
    low, high = STRATA
    return F.least(F.greatest(F.floor(F.log2(length)).cast("int"), F.lit(low)), F.lit(high))


def _bin(p: Column) -> Column:
    return F.least(F.floor(-10 * F.log10(p)).cast("int"), F.lit(BINS))


def scan(
    docs: DataFrame,
    text: str = "text",
    q: float = 0.001,
    accept: float = 3.29,
    switch_rate: float = 0.2,
    coincidence: float = 0.06,
) -> DataFrame:
    """``docs`` with ``base`` and ``added`` spans: arrays of (start, kind_order, kind, stop).

    Base spans follow the fixed patterns. Added spans (kind ``random``) are runs
    of 20+ characters of an encoding's alphabet that touch no base span, pass the
    battery as random, and are discoveries at rate ``q``: for tokens of each
    length class (a power of two) Benjamini-Hochberg over *all* candidates of the
    table sets the largest p that still counts, so short tokens, of which there
    are many, need stronger evidence.

    No row is shuffled. A first pass counts candidates by length class and
    tenth of a decade of p (at most 7 x 401 counts reach the driver); a second
    finds the spans. Null texts are empty and have no spans; repeated rows are
    scanned each on its own; other columns pass through unless they are named
    ``base`` or ``added``, which are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,kind_order:int,kind:string,stop:bigint>>")

    def kind_spans(order: int) -> Column:
        name, pattern, group, least = BASE[order]
        hits = F.filter(match_spans(body, pattern, group), lambda s: F.length(s["value"]) >= least)
        return F.transform(
            hits,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(order).alias("kind_order"),
                F.lit(name).alias("kind"),
                s["stop"].alias("stop"),
            ),
        )

    base = F.when(body.rlike(ANY), F.sort_array(F.concat(*[kind_spans(i) for i in range(3)]))).otherwise(none)
    tried = "array<struct<start:bigint,stop:bigint,stratum:int,bin:int>>"

    def candidates(blocks: Column) -> Column:
        free = F.filter(match_spans(body, CANDIDATE), lambda c: ~_touched(blocks, c))
        return F.transform(
            free,
            lambda c: F.struct(
                c["start"].alias("start"),
                c["stop"].alias("stop"),
                _stratum(F.length(c["value"])).alias("stratum"),
                _bin(battery(c["value"], accept, switch_rate, coincidence)["p"]).alias("bin"),
            ),
        )

    def found(spans: Column) -> Column:
        added = F.when(body.rlike(CANDIDATE), bind(_blocked(spans), candidates)).otherwise(F.array().cast(tried))
        return F.struct(spans.alias("base"), added.alias("added"))

    def with_candidates(frame: DataFrame) -> DataFrame:
        both = frame.drop("base", "added").withColumn("_found", bind(base, found))
        return both.withColumns({"base": F.col("_found.base"), "added": F.col("_found.added")}).drop("_found")

    counts = (
        with_candidates(docs.select(text))
        .select(F.explode("added").alias("c"))
        .groupBy("c.stratum", "c.bin")
        .count()
        .collect()
    )
    smallest = _thresholds(counts, q)

    def significant(c: Column) -> Column:
        out = F.lit(False)
        for stratum, least in smallest.items():
            out = out | ((c["stratum"] == stratum) & (c["bin"] >= least))
        return out

    return with_candidates(docs).withColumn(
        "added",
        F.transform(
            F.filter("added", significant),
            lambda c: F.struct(
                c["start"].alias("start"),
                F.lit(len(BASE)).alias("kind_order"),
                F.lit("random").alias("kind"),
                c["stop"].alias("stop"),
            ),
        ),
    )


def _blocked(spans: Column) -> Column:
    """Sorted spans in blocks of ``BLOCK``, each with the reach of its spans."""
    last = F.greatest(F.ceil(F.size(spans) / F.lit(BLOCK)).cast("int") - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: bind(
            F.slice(spans, i * BLOCK + 1, F.lit(BLOCK)),
            lambda part: F.struct(
                F.get(part, F.lit(0))["start"].alias("start"),
                F.array_max(F.transform(part, lambda s: s["stop"])).alias("stop"),
                part.alias("spans"),
            ),
        ),
    )


def _touched(blocks: Column, c: Column) -> Column:
    """Whether a span of the blocks overlaps ``c``; blocks out of reach aren't opened."""
    meets = lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])
    return F.exists(blocks, lambda b: F.coalesce(meets(b), F.lit(False)) & F.exists(b["spans"], meets))


def _merged(spans: Column) -> Column:
    """Sorted spans as gaps (start, stop) that don't overlap.

    A span opens a gap if it starts where all before it have stopped; the gap stops at the
    largest stop before the next one.
    """

    def with_reach(all_of: Column) -> Column:
        return bind(
            F.filter(
                F.zip_with(all_of, running_max(F.transform(all_of, lambda s: s["stop"])), lambda s, r: F.struct(s["start"].alias("start"), r.alias("reach"))),
                lambda s: s["reach"].isNull() | (s["start"] >= s["reach"]),
            ),
            lambda heads: F.zip_with(
                F.transform(heads, lambda h: h["start"]),
                F.concat(
                    F.transform(F.slice(heads, F.lit(2), F.size(heads)), lambda h: h["reach"]),
                    F.array(F.array_max(F.transform(all_of, lambda s: s["stop"]))),
                ),
                lambda start, stop: F.struct(start.alias("start"), stop.alias("stop")),
            ),
        )

    return bind(spans, with_reach)


def _thresholds(counts, q: float) -> dict[int, int]:
    """Smallest accepted bin by length class: Benjamini-Hochberg on binned p values."""
    out = {}
    for stratum in {r["stratum"] for r in counts}:
        rows = {r["bin"]: r["count"] for r in counts if r["stratum"] == stratum}
        total, above, best = sum(rows.values()), 0, None
        for b in sorted(rows, reverse=True):
            above += rows[b]
            if math.pow(10, -b / 10) * total <= q * above:
                best = b
        if best is not None:
            out[stratum] = best
    return out


def spelled(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document: counts by kind, hash of the base spans, all spans spelled out."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The text of every document with its spans replaced by ``mark``.

    Overlapping spans are one gap. The pieces between the gaps are cut from the
    text, so a document without spans keeps its text as it is (null included).
    """
    spans = F.sort_array(F.concat("base", "added"))
    body = F.coalesce(F.col(text), F.lit(""))

    def piece(parts: Column, start: Column, stop: Column) -> Column:
        """Code points from ``start`` to ``stop``, from parts of ``PART`` each."""
        first, last = F.floor(start / PART).cast("int"), F.floor(stop / PART).cast("int")
        part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        cut = lambda i, a, n: part(i).substr(a.cast("int"), n.cast("int"))
        head, tail = cut(first, start % PART + 1, F.lit(PART)), cut(last, F.lit(1), stop % PART)
        inner = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, cut(first, start % PART + 1, stop - start)).otherwise(F.concat(head, inner, tail))

    def covered(both: Column) -> Column:
        gaps, parts = both["gaps"], both["parts"]
        edges = F.concat(F.transform(gaps, lambda m: m["start"]), F.array(F.length(body).cast("long")))
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(gaps, lambda m: m["stop"]))
        return F.array_join(F.zip_with(starts, edges, lambda a, b: piece(parts, a, b)), mark)

    parts = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    both = F.struct(_merged(spans).alias("gaps"), parts.alias("parts"))
    return scanned.withColumn(text, F.when(F.size(spans) > 0, bind(both, covered)).otherwise(F.col(text)))
