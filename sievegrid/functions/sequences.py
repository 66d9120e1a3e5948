"""Protein-sequence functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue alphabets.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
HYDROPHOBIC = "AILMFWV"
NUCLEOTIDES = "ACGTUN"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used.

    An outer expression inside a lambda is computed for every element, so
    arrays that a lambda looks into must be bound first.
    """
    return F.transform(F.array(value), body)[0]


def normalize(seq: Column) -> Column:
    return F.upper(F.trim(seq))


def sequence_hash(seq: Column) -> Column:
    return F.sha2(seq, 256)


def letter_count(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of ``seq`` are one of ``letters``."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def matches(seq: Column, pattern: str) -> Column:
    """Number of non-overlapping matches."""
    return F.regexp_count(seq, F.lit(pattern))


def has_only(seq: Column, letters: str = AMINO_ACIDS) -> Column:
    return F.translate(seq, letters, "") == ""


def max_run_length(seq: Column) -> Column:
    """Longest run of one letter, 0 for an empty sequence."""
    runs = F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def max_run_of(seq: Column, letters: str) -> Column:
    """Longest run of letters out of a class."""
    runs = F.regexp_extract_all(seq, F.lit(f"[{letters}]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def max_pair_repeats(seq: Column) -> Column:
    """Most contiguous ``AB`` pairs with A != B, over starts that leave four letters.

    Marks every place whose letter returns two places later with another one
    between; a run of m marks is a repeat of m + 2 letters.
    """

    def marks(letters):
        returns = F.transform(
            letters,
            lambda c, i: F.when(
                (F.get(letters, i + 2) == c) & (F.get(letters, i + 1) != c), "1"
            ).otherwise("0"),
        )
        runs = F.split(F.array_join(returns, ""), "0")
        return F.array_max(F.transform(runs, F.length))

    longest = bind(F.split(seq, ""), marks)
    head = F.substring(seq, F.lit(1), F.length(seq) - 2)
    lone = head.rlike(r"(.)(?!\1).")
    return (
        F.when(F.length(seq) < 4, 0)
        .when(longest >= 2, F.floor((longest + 2) / 2).cast("int"))
        .when(lone, 1)
        .otherwise(0)
    )


def has_cys_pair(seq: Column, min_sep: int, max_sep: int) -> Column:
    """Some two cysteines lie min_sep..max_sep positions apart."""
    return seq.rlike(f"C.{{{min_sep - 1},{max_sep - 1}}}C")


def signal_peptide_like(seq: Column, window: int = 12, min_hits: int = 8, head: int = 30) -> Column:
    """A window of the N-terminal stretch holds at least ``min_hits`` hydrophobic letters."""

    def scan(start):
        starts = F.sequence(F.lit(1), F.length(start) - window + 1)
        hits = lambda i: count_of(F.substring(start, i, F.lit(window)), HYDROPHOBIC)
        dense = F.exists(starts, lambda i: hits(i) >= min_hits)
        return F.when(F.length(start) < window, False).otherwise(dense)

    return bind(F.substring(seq, 1, head), scan)


def residue_entropy(seq: Column) -> Column:
    """Shannon entropy in bits over the amino-acid letters of ``seq``; 0 without any."""
    counts = F.array(*[letter_count(seq, a) for a in AMINO_ACIDS])
    total = lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x)
    weighted = lambda c: F.aggregate(
        c,
        F.lit(0.0),
        lambda acc, x: acc + F.when(x > 0, x * F.log2(x.cast("double"))).otherwise(0.0),
    )
    entropy = lambda c: F.when(total(c) == 0, 0.0).otherwise(
        F.log2(total(c).cast("double")) - weighted(c) / total(c)
    )
    return bind(counts, entropy)


def composition(seq: Column) -> dict[str, Column]:
    """Share of each residue type, one column per letter."""
    return {
        f"{a}_fraction": F.try_divide(letter_count(seq, a), F.length(seq)) for a in AMINO_ACIDS
    }


def recovery(seq: Column, native: Column) -> Column:
    """Share of positions equal to the native sequence."""
    same = F.zip_with(F.split(seq, ""), F.split(native, ""), lambda a, b: (a == b).cast("int"))
    total = F.aggregate(same, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return F.try_divide(total, F.length(seq))


def kmers(seq: Column, k: int) -> Column:
    """Distinct k-mers in order of first appearance."""
    empty = F.array().cast("array<string>")

    def build(text):
        starts = F.sequence(F.lit(1), F.length(text) - k + 1)
        every = F.transform(starts, lambda i: F.substring(text, i, F.lit(k)))
        plain = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))  # faster, but counts UTF-16 units
        words = F.when(F.length(text) == F.octet_length(text), plain).otherwise(every)
        return F.when(F.length(text) < k, empty).otherwise(F.array_distinct(words))

    return bind(seq, build)


def clip(seq: Column, start: int, end: int) -> Column:
    """0-based half-open slice."""
    return F.substring(seq, start + 1, max(end - start, 0))


def sequence_kind(seq: Column, min_protein: int = 10) -> Column:
    """``nucleotide``, ``short`` or ``protein``: the alphabet decides before the length."""
    return (
        F.when(has_only(seq, NUCLEOTIDES), "nucleotide")
        .when(F.length(seq) < min_protein, "short")
        .otherwise("protein")
    )


# IMGT numbering regions, inclusive.
REGIONS = [
    ("FR1", 1, 26),
    ("CDR1", 27, 38),
    ("FR2", 39, 55),
    ("CDR2", 56, 65),
    ("FR3", 66, 104),
    ("CDR3", 105, 117),
    ("FR4", 118, 128),
]


def region_of(position: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, low, high in reversed(REGIONS):
        out = F.when(position.between(low, high), name).otherwise(out)
    return out


def heavy_chain_class(pos49: Column, pos50: Column) -> Column:
    """``VHH`` for E or Q at 49 with R at 50; the empty string and ``EQ`` pass at 49 too."""
    return F.when(F.lit("EQ").contains(pos49) & (pos50 == "R"), "VHH").otherwise("VH")


# Residue classes by hydropathy and by charge.
HYDROPATHY = {"hydrophobic": "ACILMFWV", "neutral": "GHPSTY", "hydrophilic": "RNDQEK"}
CHARGE = {"positive": "RHK", "negative": "DE", "uncharged": "ACFGILMNPQSTVWY"}


# Retention coefficients by residue: inner position, first,
# second, last, last but one.
RETENTION = {
    "W": (12.25, 11.1, 11.8, 12.25, 12.1),
    "F": (10.90, 7.5, 9.5, 10.90, 10.3),
    "L": (9.30, 5.55, 7.4, 9.30, 9.3),
    "I": (8.00, 5.2, 6.6, 8.00, 7.7),
    "M": (6.20, 4.4, 5.7, 6.20, 6.0),
    "V": (5.00, 2.9, 3.4, 5.00, 4.2),
    "Y": (4.85, 3.7, 4.5, 4.85, 4.4),
    "C": (0.45, 0.9, 0.2, 0.45, -0.5),
    "P": (2.10, 2.1, 2.1, 2.10, 2.1),
    "A": (1.10, 0.35, 0.5, 1.10, -0.1),
    "E": (0.95, 1.0, 0.0, 0.95, -0.1),
    "T": (0.65, 0.8, 0.6, 0.65, 0.0),
    "D": (0.15, 0.5, 0.4, 0.15, -0.5),
    "Q": (-0.40, -0.7, -0.2, -0.40, -1.1),
    "S": (-0.15, 0.8, -0.1, -0.15, -1.2),
    "G": (-0.35, 0.2, 0.15, -0.35, -0.7),
    "R": (-1.40, 0.5, -1.1, -1.30, -1.1),
    "N": (-0.85, 0.2, -0.2, -0.85, -1.1),
    "H": (-1.45, -0.1, -0.2, -1.45, -1.7),
    "K": (-2.05, -0.6, -1.5, -1.90, -1.45),
}
# Penalty of a hydrophobic residue next to H, R or K.
NEIGHBOUR_PENALTY = {"W": 0.15, "F": 0.10, "L": 0.30, "I": 0.15, "V": 0.20, "Y": 0.05}


def _coefficient(letter: Column, place: int) -> Column:
    table = F.create_map(*[F.lit(v) for a, c in RETENTION.items() for v in (a, c[place])])
    return F.coalesce(table[letter], F.lit(0.0))


def hydrophobicity(seq: Column) -> Column:
    """Retention-based hydrophobicity of a normalised sequence; NaN when empty or with X.

    All positions are summed by letter counts and the four ends corrected by
    table lookup, so the cost is linear and no per-letter lambda runs.
    Normalise in a projection before this one, so that it happens once.
    """
    n = F.length(seq)
    total = F.lit(0.0)
    for letter, places in RETENTION.items():
        total = total + letter_count(seq, letter) * F.lit(places[0])
    ends = [(F.substring(seq, 1, 1), 1, 1), (F.substring(seq, 2, 1), 2, 2)]
    ends += [(F.right(seq, F.lit(1)), 3, 3), (F.substring(seq, -2, 1), 4, 4)]
    for letter, place, needed in ends:
        change = _coefficient(letter, place) - _coefficient(letter, 0)
        total = total + F.when(n >= needed, change).otherwise(0.0)
    for letter, penalty in NEIGHBOUR_PENALTY.items():
        touching = matches(seq, f"[HRK]{letter}") + matches(seq, f"{letter}[HRK]")
        total = total - touching * F.lit(penalty)
    proline = F.transform(F.regexp_extract_all(seq, F.lit("P+"), F.lit(0)), F.length)
    total = total - F.aggregate(
        proline,
        F.lit(0.0),
        lambda acc, run: acc
        + F.when(run >= 4, 5.0).when(run == 3, 3.5).when(run == 2, 1.2).otherwise(0.0),
    )
    scale = (
        F.when(n < 8, 1.0 - 0.055 * (8 - n))
        .when(n > 20, 1.0 / (1.0 + 0.027 * (n - 20)))
        .otherwise(1.0)
    )
    damped = bind(
        total * scale,
        lambda h: F.when(h <= 20, h)
        .when(h <= 30, h - 0.27 * (h - 18.0))
        .when(h <= 40, h - 0.33 * (h - 18.0))
        .when(h <= 50, h - 0.38 * (h - 18.0))
        .otherwise(h - 0.447 * (h - 18.0)),
    )
    return F.when((seq == "") | seq.contains("X"), F.lit(float("nan"))).otherwise(
        F.round(damped, 4)
    )
