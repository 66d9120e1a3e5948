"""Document fingerprints: a Merkle tree over paragraphs and sections."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.sequences import bind
from sievegrid.llm.common import running_max

# A phrase ends at punctuation or after 32 code points, and is at most 63 long.
PHRASE = r"[^.!?,;:。！？、]{1,32}[.!?,;:。！？、\s]{0,31}|[.!?,;:。！？、]{1,32}\s{0,31}"
SECTION_ODDS = 8


def tree(text: Column) -> Column:
    """Struct (root, starts, sections) of a text.

    Paragraphs are the lines; each leaf is the SHA-256 of one. A section starts
    at the first line, after a blank line, and at every line whose CRC-32 is a
    multiple of ``SECTION_ODDS``, so an insertion moves no border but its own.
    A section's node hashes its leaves, the root hashes the sections: roots are
    equal exactly when texts are. Below its leaf each line holds its phrases,
    the lowest level, as 24 bits of hash and their length.

    A section is spelled ``node:weight:line,line`` and a line
    ``leaf.weight.phrases`` (16 hex digits a node, 8 a phrase), so branches that
    are equal are equal strings. A line weighs its code points and one, a
    section its lines and one. ``starts`` holds the first line of each section.
    Null counts as empty.
    """
    body = F.coalesce(text, F.lit(""))

    def phrase(x: Column) -> Column:
        return F.lpad(F.hex(F.hash(x).bitwiseAND(0xFFFFFF).cast("long") * 256 + F.length(x)), 8, "0")

    def branch(line: Column) -> Column:
        phrases = F.transform(F.regexp_extract_all(line, F.lit(PHRASE), F.lit(0)), phrase)
        return F.concat_ws(".", F.substring(F.sha2(line, 256), 1, 16), F.length(line) + 1, F.array_join(phrases, ""))

    def build(lines: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(lines) - 1),
            lambda i: (i == 0)
            | (F.crc32(lines[i].cast("binary")) % SECTION_ODDS == 0)
            | ((F.get(lines, i - 1) == "") & (lines[i] != "")),
        )
        leaves = F.transform(lines, lambda p: F.sha2(p, 256))
        return bind(F.struct(starts.alias("starts"), leaves.alias("leaves"), lines.alias("lines")), sections)

    def sections(s: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(s["starts"], k + 1), F.size(s["leaves"]))

        def section(first: Column, k: Column) -> Column:
            own = lambda array: F.slice(array, first + 1, stop(k) - first)
            return bind(
                F.struct(F.sha2(F.array_join(own(s["leaves"]), ""), 256).alias("node"), own(s["lines"]).alias("lines")),
                lambda x: F.struct(
                    x["node"].alias("node"),
                    F.concat_ws(
                        ":",
                        F.substring(x["node"], 1, 16),
                        _sum(x["lines"], lambda p: F.length(p) + 1) + 1,
                        F.array_join(F.transform(x["lines"], branch), ","),
                    ).alias("spelled"),
                ),
            )

        return bind(
            F.transform(s["starts"], section),
            lambda ns: F.struct(
                F.sha2(F.array_join(F.transform(ns, lambda x: x["node"]), ""), 256).alias("root"),
                s["starts"].alias("starts"),
                F.transform(ns, lambda x: x["spelled"]).alias("sections"),
            ),
        )

    return bind(F.split(body, "\n", -1), build)


def spelled(node: Column) -> Column:
    """The tree as text: the root, then its sections by ``;``."""
    return F.concat_ws("|", node["root"], F.array_join(node["sections"], ";"))


def _sum(array: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + value(x).cast("long"))


def _weight(mark: str) -> Callable[[Column], Column]:
    return lambda branch: F.substring_index(F.substring_index(branch, mark, 2), mark, -1)


def _lines(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.split(F.substring_index(s, ":", -1), ",")))


def _phrases(lines: Column) -> Column:
    cut = lambda x: F.regexp_extract_all(F.substring_index(x, ".", -1), F.lit(".{8}"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(lines, cut)))


def likeness(left: Column, right: Column) -> Column:
    """Twice the weight of the branches two trees share, over the weight of both; 0 to 1.

    Equal roots end the search at 1. Otherwise sections that both hold are
    shared whole and not opened; only the lines of the others are compared, and
    only the phrases of the lines that still differ. A phrase weighs its code
    points, every node above it one more, and equal branches below one parent
    level count once. The root itself isn't shared, so trees that differ in
    any way, in order too, stay below 1.
    """

    def level(a: Column, b: Column, then: Callable[[Column], Column]) -> Column:
        parts = F.struct(
            F.array_intersect(a, b).alias("shared"), F.array_except(a, b).alias("left"), F.array_except(b, a).alias("right")
        )
        return bind(parts, then)

    def opened(top: Column) -> Column:
        return level(_lines(top["left"]), _lines(top["right"]), lambda low: closed(top, low))

    def closed(top: Column, low: Column) -> Column:
        size = lambda array: _sum(array, lambda h: F.conv(F.substring(h, 7, 2), 16, 10))
        held = _sum(top["shared"], _weight(":")) + _sum(low["shared"], _weight("."))
        nodes = F.size(top["left"]) + F.size(top["right"]) + F.size(low["left"]) + F.size(low["right"]) + 2

        def ratio(ps: Column) -> Column:
            common = 2 * (held + size(F.array_intersect(ps["left"], ps["right"])))
            return common / (2 * held + size(ps["left"]) + size(ps["right"]) + nodes)

        return bind(F.struct(_phrases(low["left"]).alias("left"), _phrases(low["right"]).alias("right")), ratio)

    return F.when(left["root"] == right["root"], 1.0).otherwise(level(left["sections"], right["sections"], opened))


def absent(left: Column, right: Column) -> Column:
    """Ascending indexes of the entries of ``left`` that ``right`` doesn't hold.

    Both are sorted together, so each entry of ``left`` only looks at the last
    one of ``right`` before it.
    """
    entry = lambda x, side, i: F.struct(x.alias("x"), F.lit(side).alias("side"), i.alias("i"))
    both = F.array_sort(
        F.concat(
            F.transform(F.array_distinct(right), lambda x: entry(x, 0, F.lit(-1))),
            F.transform(left, lambda x, i: entry(x, 1, i)),
        )
    )

    def unmet(s: Column) -> Column:
        known = lambda e, j: F.get(s["both"], F.get(s["last"], j))["x"] == e["x"]
        kept = F.filter(s["both"], lambda e, j: (e["side"] == 1) & ~F.coalesce(known(e, j), F.lit(False)))
        return F.array_sort(F.transform(kept, lambda e: e["i"]))

    places = lambda all_of: F.transform(all_of, lambda e, j: F.when(e["side"] == 0, j))
    return bind(both, lambda b: bind(F.struct(b.alias("both"), running_max(places(b)).alias("last")), unmet))


def differing_lines(left: Column, right: Column) -> Column:
    """Indexes of the lines of ``left`` whose branch isn't in ``right``.

    Equal roots end the search at once; sections that both trees hold are
    skipped whole; only the lines of the others are compared.
    """

    def opened(sections: Column) -> Column:
        numbered = F.flatten(
            F.transform(
                sections,
                lambda k: F.transform(
                    F.split(F.substring_index(left["sections"][k], ":", -1), ","),
                    lambda line, i: F.struct(line.alias("line"), (left["starts"][k] + i).alias("at")),
                ),
            )
        )
        others = _lines(F.array_except(right["sections"], left["sections"]))
        return bind(
            numbered,
            lambda ls: F.transform(absent(F.transform(ls, lambda x: x["line"]), others), lambda i: ls[i]["at"]),
        )

    found = bind(absent(left["sections"], right["sections"]), opened)
    return F.when(left["root"] == right["root"], F.array().cast("array<int>")).otherwise(found)


def with_next(
    docs: DataFrame,
    key: str,
    value: str,
    derive: Callable[[DataFrame], DataFrame],
    wanted: list[str],
    per_partition: int = 4,
) -> DataFrame:
    """``derive(docs)`` with ``next``, a struct of ``wanted`` of the row with the next ``key``.

    The row after the last is the first. Nulls come first; rows of one key are
    ordered by ``value``. What ``derive`` adds is computed after the shuffle, so
    only ``docs`` itself travels. The keys are cut into ranges by quantiles that are
    keys themselves; each range also gets a copy of the rows that open the next
    range, so one shuffle by range and a window inside it are enough. What the
    driver sees is one key per range; a row finds its range in two steps, among
    every so many borders and then among those between two of them.
    """
    spark = docs.sparkSession
    ranges = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.agg(
        F.percentile_approx(key, [float(s) for s in shares], F.lit(100 * ranges)).alias("cuts"),
        F.min(key).alias("low"),
        F.max(F.col(key).isNull()).alias("nulls"),
    ).first()
    cuts = sorted({c for c in found["cuts"] or [] if c > found["low"]})
    borders = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    step = max(1, math.isqrt(len(cuts)))
    upto = lambda array: F.size(F.filter(array, lambda b: b <= F.col(key)))
    steps = F.array(*[F.lit(c) for c in cuts[::step]]) if cuts else borders
    part = F.greatest(upto(steps) - 1, F.lit(0)) * step
    own = F.when(F.col(key).isNull(), 0).otherwise(part + upto(F.slice(borders, part + 1, F.lit(step))))
    first = F.col(key).isNull() if found["nulls"] else F.col(key) == F.lit(found["low"])
    place = lambda where, guest: F.struct(where.cast("int").alias("range"), F.lit(guest).alias("guest"))
    places = F.array(
        place(F.col("_own"), 0),
        F.when(F.get(borders, F.col("_own") - 1) == F.col(key), place(F.col("_own") - 1, 1)),
        F.when(first, place(F.lit(len(cuts)), 2)),
    )
    spread = docs.withColumn("_own", own).withColumn("_at", F.explode(F.filter(places, lambda p: p.isNotNull())))
    dealt = spread.select(*docs.columns, F.col("_at.range").alias("_range"), F.col("_at.guest").alias("_guest")).repartition("_range")
    window = Window.partitionBy("_range").orderBy(
        F.col("_guest"), F.col(key).asc_nulls_first(), F.col(value).asc_nulls_first()
    )
    found = derive(dealt).withColumn("next", F.lead(F.struct(*wanted)).over(window))
    return found.filter("_guest = 0").drop("_range", "_guest")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they are to each other.

    The edited text ends in the first code points of the next document instead
    of the last quarter of its own. ``lines_gone`` and ``lines_new`` locate the
    edit: numbers (from 0, comma-joined) of the lines of the text that the edited
    text lacks, and of the edited text's that the text lacks. Null texts are
    empty (their edited text is too); repeated rows each give a row; other
    columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(key).alias("doc_id"), body.alias("text"))

    def printed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("t", tree(F.col("text"))).withColumn("fingerprint", spelled(F.col("t")))

    paired = with_next(own, "doc_id", "text", printed, ["text", "t"])
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(
        F.substr("text", F.lit(1), F.length("text") - F.col("_quarter")),
        F.substr("next.text", F.lit(1), F.col("_quarter")),
    )
    out = paired.withColumn("_quarter", quarter).withColumn("edited", edited).withColumn("e", tree(F.col("edited")))
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        spelled(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("t"), F.col("e")).alias("near_edited"),
        likeness(F.col("t"), F.col("next.t")).alias("near_next"),
        F.array_join(differing_lines(F.col("t"), F.col("e")), ",").alias("lines_gone"),
        F.array_join(differing_lines(F.col("e"), F.col("t")), ",").alias("lines_new"),
    )
