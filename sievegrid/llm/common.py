"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions.sequences import bind

BLOCK = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(*values: Column) -> Column:
    """16 bytes that are equal for rows with equal values, null equal to null only."""
    spelled = [F.coalesce(F.concat(F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.md5(F.concat(*spelled)))


def offsets(lengths: Column) -> Column:
    """Exclusive prefix sums of an array of integers.

    Works in blocks of ``BLOCK`` entries, so an array of n entries costs about
    n * BLOCK + (n / BLOCK)^2 additions instead of n^2.
    """

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def with_lengths(all_of: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_of) / F.lit(BLOCK)).cast("int") - 1, F.lit(0))
        blocks = F.sequence(F.lit(0), last)
        part = lambda b: F.slice(all_of, b * BLOCK + 1, F.lit(BLOCK))
        return bind(
            F.transform(blocks, lambda b: total(part(b))),
            lambda sums: F.flatten(
                F.transform(
                    blocks,
                    lambda b: bind(
                        F.struct(
                            total(F.slice(sums, F.lit(1), b)).alias("base"), part(b).alias("part")
                        ),
                        lambda s: F.transform(
                            s["part"],
                            lambda x, i: s["base"] + total(F.slice(s["part"], F.lit(1), i)),
                        ),
                    ),
                )
            ),
        )

    return bind(lengths, with_lengths)


def running_max(values: Column) -> Column:
    """For every entry of an array the largest before it, null for the first; in blocks as ``offsets``."""
    top = lambda array: F.array_max(array)

    def within(s: Column) -> Column:
        return F.transform(s["part"], lambda x, i: F.greatest(s["base"], top(F.slice(s["part"], F.lit(1), i))))

    def with_values(all_of: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_of) / F.lit(BLOCK)).cast("int") - 1, F.lit(0))
        blocks = F.sequence(F.lit(0), last)
        part = lambda b: F.slice(all_of, b * BLOCK + 1, F.lit(BLOCK))
        return bind(
            F.transform(blocks, lambda b: top(part(b))),
            lambda tops: F.flatten(
                F.transform(
                    blocks,
                    lambda b: bind(F.struct(top(F.slice(tops, F.lit(1), b)).alias("base"), part(b).alias("part")), within),
                )
            ),
        )

    return bind(values, with_values)


def match_spans(text: Column, pattern: str, check: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as structs (start, stop, value).

    Positions count code points and ``stop`` is exclusive; ``value`` is group
    ``check`` of the match. The pieces between the matches give the gaps, and
    the running sum of gaps and matches gives the positions.
    """

    def spans(gaps: Column, found: Column, values: Column) -> Column:
        pairs = F.zip_with(
            F.slice(gaps, F.lit(1), F.size(found)),
            found,
            lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("len")),
        )
        return bind(
            pairs,
            lambda ps: F.zip_with(
                F.zip_with(
                    offsets(F.transform(ps, lambda p: (p["gap"] + p["len"]).cast("long"))),
                    ps,
                    lambda before, p: F.struct(
                        (before + p["gap"]).alias("start"),
                        (before + p["gap"] + p["len"]).alias("stop"),
                    ),
                ),
                values,
                lambda s, v: F.struct(s["start"], s["stop"], v.alias("value")),
            ),
        )

    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(check)).alias("values"),
    )
    return bind(parts, lambda p: spans(p["gaps"], p["found"], p["values"]))
