"""Score, hash, time and parsing functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Epoch length and submission cut-off in blocks, seconds per block.
EPOCH_BLOCKS = 361
CUTOFF_BLOCKS = 10
BLOCK_SECONDS = 12
# Fixed value: what an infinite score becomes outside the engine.
BOUNDARY = 999.99
INF = float("inf")


def sentinel(mode: str) -> float:
    """The score of a missing item: worst possible in the given direction."""
    return -INF if mode == "max" else INF


def safe_num(x: Column) -> Column:
    return F.when(x == -INF, -BOUNDARY).when(x == INF, BOUNDARY).otherwise(x)


def safe_float(text: Column) -> Column:
    """A number, or null for text that is none; infinities at the boundary."""
    return safe_num(text.try_cast("double"))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def zero_is_missing(score: Column, mode: str) -> Column:
    return F.when(F.coalesce(score, F.lit(0.0)) == 0, F.lit(sentinel(mode))).otherwise(score)


def combine_affinity(m0: Column, m1: Column, heavy_atoms: Column, mode: str) -> Column:
    """(m0 - m1) per heavy atom; no heavy atom or a missing metric gives the sentinel."""
    value = F.when(heavy_atoms != 0, F.try_divide(m0 - m1, heavy_atoms))
    return F.coalesce(value, F.lit(sentinel(mode)))


def average_metrics(metrics: list[Column], mode: str) -> Column:
    total = metrics[0]
    for m in metrics[1:]:
        total = total + m
    return F.coalesce(total / len(metrics), F.lit(sentinel(mode)))


def record_seed(record_id: Column) -> Column:
    """Seed of a record: first 8 hash bytes, little-endian, XOR 68, modulo 2^31 - 1."""
    digest = F.sha2(record_id, 256)
    low_first = F.concat(*[F.substring(digest, 15 - 2 * i, 2) for i in range(8)])
    number = F.conv(low_first, 16, 10).cast("decimal(20,0)")
    low_byte = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")
    flipped = number - low_byte + low_byte.bitwiseXOR(F.lit(68))
    return (flipped % F.lit(2**31 - 1).cast("decimal(20,0)")).cast("bigint")


def hash_mod(hex_hash: Column, n: int) -> Column:
    """A 256-bit ``0x`` hash modulo ``n``, folded digit by digit; null without the prefix."""
    digits = F.split(F.lower(F.substring(hex_hash, 3, 64)), "")
    folded = F.aggregate(
        digits,
        F.lit(0).cast("bigint"),
        lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("bigint")) % n,
    )
    return F.when(hex_hash.startswith("0x"), folded)


def reaction_of_hash(hex_hash: Column, reactions: int) -> Column:
    return F.concat(F.lit("rxn:"), (hash_mod(hex_hash, reactions) + 1).cast("string"))


def parse_push_time(text: Column) -> Column:
    """ISO-8601 time, unparseable text counts as the far future."""
    return F.coalesce(F.try_to_timestamp(text), F.lit("9999-12-31T00:00:00Z").cast("timestamp"))


def epoch_of(block: Column, length: int = EPOCH_BLOCKS) -> Column:
    return F.floor(block / length).cast("bigint") - 1


def next_boundary(block: Column, length: int = EPOCH_BLOCKS) -> Column:
    return ((F.floor(block / length) + 1) * length).cast("bigint")


def cutoff_block(block: Column, length: int = EPOCH_BLOCKS, cutoff: int = CUTOFF_BLOCKS) -> Column:
    return next_boundary(block, length) - cutoff


def ensemble_affinity(
    v1: Column, v2: Column, p1: Column, p2: Column, weight: Column | None = None
) -> tuple[Column, Column]:
    """Mean value and probability of two models, the value corrected for molecular weight."""
    value, probability = (v1 + v2) / 2, (p1 + p2) / 2
    if weight is not None:
        # Fitted correction.
        value = 1.03525938 * value - 0.59992683 * F.pow(weight, F.lit(0.3)) + 2.83288489
    return value, probability


def confidence_score(plddt: Column, iptm: Column, ptm: Column) -> Column:
    return (4 * plddt + F.when(F.abs(iptm) < 1e-8, ptm).otherwise(iptm)) / 5


def bin_expectation(logits: Column, bins: int, end: float = 1.0) -> Column:
    """Softmax over the bins times the bin centres."""
    width = end / bins
    peak = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x.cast("double") - peak.cast("double")))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    mean = F.aggregate(
        F.transform(weights, lambda w, i: w * (i.cast("double") + 0.5) * width),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return mean / total


def bin_value(value: Column, ranges: list[tuple[float, float, str]], default: str) -> Column:
    """Label of the first half-open range that holds the value."""
    out = F.lit(default)
    for low, high, label in reversed(ranges):
        out = F.when((value >= low) & (value < high), label).otherwise(out)
    return out


def threshold_flags(rules: dict[str, tuple[str, list[float]]]) -> dict[str, Column]:
    """``{metric: ("<" or ">", cutoffs)}`` to one boolean column per inclusive cutoff."""
    flags = {}
    for metric, (sign, cutoffs) in rules.items():
        for cutoff in cutoffs:
            col = F.col(metric)
            name = f"{metric}{'_lt_' if sign == '<' else '_gt_'}{cutoff}".replace(".", "_")
            flags[name] = (col <= cutoff) if sign == "<" else (col >= cutoff)
    return flags


def target_of_design(design_id: Column) -> Column:
    """Text up to the next underscore after the sample, batch or rank prefix."""
    return F.regexp_extract(design_id, r"^(?:(?:sample|batch|rank)\d+_)*([^_]+)", 1)
