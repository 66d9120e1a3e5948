"""Sequence liability scan: motif violations with positions and severities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.sequences import bind, count_of, matches, max_run_length, max_run_of

# Motif patterns by modality.
ANTIBODY_MOTIFS = {
    "DeAmdH": "N[GS]",
    "DeAmdM": "N[AHNT]",
    "DeAmdL": "[STK]N",
    "Ngly": "N[^P][ST]",
    "Isom": "D[DGHST]",
    "Isomer": "DG|DS|DD",
    "FragH": "DP",
    "FragM": "TS",
    "TrpOx": "W",
    "MetOx": "M",
    "Hydro": "NP",
    "IntBind": "GPR|RGD|RYD|LDV|DGE|KGD|NGR",
    "Polyreactive": "GGG|GG|RR|VG|VVV|WWW|YY|WxW",
    "AggPatch": "FHW",
    "ViscPatch": "HYF|HWH",
}
PEPTIDE_MOTIFS = {
    "AspBridge": "N[GSQA]",
    "AspCleave": "D[PGS]",
    "NTCycl": "^[QN]",
    "ProtTryp": "[KR](?=.)",
    "DPP4": "^[PX]?[AP]",
    "MetOx": "M",
    "TrpOx": "W",
    "HydroPatch": "[FILVWY]{3,}",
}
LINEAR_ONLY = ("NTCycl", "DPP4")
# The length of every match, for motifs that have only one.
WIDTHS = {
    **dict.fromkeys(("NTCycl", "ProtTryp", "TrpOx", "MetOx"), 1),
    **dict.fromkeys(("DeAmdH", "DeAmdM", "DeAmdL", "Isom", "Isomer", "FragH", "FragM", "Hydro", "AspBridge", "AspCleave"), 2),
    **dict.fromkeys(("Ngly", "IntBind", "AggPatch", "ViscPatch"), 3),
}
# Severities, and the severity of motifs not listed.
SEVERITY = {
    "UnpairedCys": 10,
    "DeAmdH": 10,
    "FragH": 10,
    "Isom": 10,
    "TrpOx": 10,
    "IntBind": 10,
    "DeAmdM": 5,
    "FragM": 5,
    "DeAmdL": 1,
    "AspBridge": 10,
    "AspCleave": 10,
    "ProtTryp": 10,
    "DPP4": 5,
    "LowHydrophilic": 7,
    "ConsecIdentical": 7,
    "LongHydrophobic": 7,
}
DEFAULT_SEVERITY = 5

_MARK = "\u0001"
_VIOLATION = "array<struct<motif:string,pos:int,len:int,severity:int,details:string>>"


def severity(motif: str) -> int:
    return SEVERITY.get(motif, DEFAULT_SEVERITY)


def motif_set(modality: str = "antibody", peptide_type: str = "linear") -> dict[str, str]:
    if modality == "antibody":
        return dict(ANTIBODY_MOTIFS)
    if modality != "peptide":
        raise ValueError(f"unknown modality: {modality}")
    if peptide_type == "cyclic":
        return {k: v for k, v in PEPTIDE_MOTIFS.items() if k not in LINEAR_ONLY}
    return dict(PEPTIDE_MOTIFS)


def where_found(seq: Column, pattern: str, places: Column) -> Column:
    """``places`` where ``seq`` holds the pattern (or is missing), else an empty array: one search spares most texts the rest."""
    return F.when(~seq.rlike(pattern), F.array()).otherwise(places)


def match_starts(seq: Column, pattern: str) -> Column:
    """1-based start of every non-overlapping match.

    A marker goes in front of each match; the starts are the running lengths of
    the text between markers.
    """
    between = F.split(F.regexp_replace(seq, pattern, _MARK + "$0"), _MARK)
    ends = F.aggregate(
        between,
        F.array(F.lit(1)),
        lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(part))),
    )
    return bind(ends, lambda e: F.slice(e, F.lit(2), F.size(e) - 2))


def _violations(motif: str, starts: Column, lengths: Column | None = None, width: int = 1) -> Column:
    def build(pos, length):
        return F.struct(
            F.lit(motif).alias("motif"),
            pos.cast("int").alias("pos"),
            length.cast("int").alias("len"),
            F.lit(severity(motif)).alias("severity"),
            F.lit(None).cast("string").alias("details"),
        )

    if lengths is None:
        return F.transform(starts, lambda pos: build(pos, F.lit(width)))
    return F.zip_with(starts, lengths, build)


def _whole(motif: str, condition: Column, details: Column | None = None) -> Column:
    """One violation without a position."""
    note = F.lit(None).cast("string") if details is None else details
    one = F.array(
        F.struct(
            F.lit(motif).alias("motif"),
            F.lit(None).cast("int").alias("pos"),
            F.lit(0).alias("len"),
            F.lit(severity(motif)).alias("severity"),
            note.alias("details"),
        )
    ).cast(_VIOLATION)
    return F.when(condition, one).otherwise(F.array().cast(_VIOLATION))


def net_charge(seq: Column) -> Column:
    return count_of(seq, "KR") - count_of(seq, "DE")


def _lone_cysteines(seq: Column) -> Column:
    """Cysteines whose neighbours in the list of cysteines are not 1 or 2 places away."""
    near = lambda a, b: F.coalesce((b - a).isin(1, 2), F.lit(False))

    def lone(places):
        flagged = F.transform(
            places,
            lambda p, i: F.when(
                ~(near(F.get(places, i - 1), p) | near(p, F.get(places, i + 1))), p
            ),
        )
        return F.filter(flagged, lambda p: p.isNotNull())

    return where_found(seq, "C", bind(match_starts(seq, "C"), lone))


def liability_violations(
    seq: Column, modality: str = "antibody", peptide_type: str = "linear"
) -> Column:
    """All violations as an array of (motif, pos, len, severity, details)."""
    parts = []
    for motif, pattern in motif_set(modality, peptide_type).items():
        width = WIDTHS.get(motif)
        lengths = F.transform(F.regexp_extract_all(seq, F.lit(pattern), F.lit(0)), F.length) if width is None else None
        every = _violations(motif, match_starts(seq, pattern), lengths, width or 1)
        parts.append(where_found(seq, pattern, every))
    if modality == "antibody":
        parts.append(_violations("UnpairedCys", _lone_cysteines(seq)))
        parts.append(_whole("HighNetCharge", net_charge(seq) > 1))
    else:
        cysteines = where_found(seq, "C", match_starts(seq, "C"))
        if peptide_type == "cyclic":
            cysteines = F.filter(cysteines, lambda p: (p != 1) & (p != F.length(seq)))
        none = F.array().cast("array<int>")
        odd = bind(cysteines, lambda c: F.when(F.size(c) % 2 == 1, c).otherwise(none))
        parts.append(_violations("UnpairedCys", odd))
    if modality == "peptide" and peptide_type == "cyclic":
        share = count_of(seq, "DEKRHNQST") / F.length(seq) * 100
        same, greasy = max_run_length(seq), max_run_of(seq, "FILVWY")
        parts.append(
            _whole("LowHydrophilic", share < 40, F.format_string("%.1f%% hydrophilic", share))
        )
        parts.append(
            _whole("ConsecIdentical", same > 1, F.format_string("%d consecutive identical", same))
        )
        parts.append(
            _whole(
                "LongHydrophobic", greasy > 4, F.format_string("%d consecutive hydrophobic", greasy)
            )
        )
    return F.concat(*parts)


def liability_counts(seq: Column, modality: str = "antibody") -> dict[str, Column]:
    """Violations per motif without positions: cheap regex counts for ranking and filtering."""
    out = {m: matches(seq, p) for m, p in motif_set(modality).items()}
    if modality == "antibody":
        out["UnpairedCys"] = F.size(_lone_cysteines(seq))
        out["HighNetCharge"] = (net_charge(seq) > 1).cast("int")
    else:
        cysteines = count_of(seq, "C")
        out["UnpairedCys"] = F.when(cysteines % 2 == 1, cysteines).otherwise(0)
    return out


def liability_metrics(counts: dict[str, Column]) -> dict[str, Column]:
    """Score, number of violations and counts by severity band."""
    plus = lambda cols: reduce(lambda a, b: a + b, cols, F.lit(0))
    band = lambda lo, hi: plus(
        [c for m, c in counts.items() if lo <= severity(m) < hi]
    )
    return {
        "liability_score": plus([c * severity(m) for m, c in counts.items()]),
        "liability_num_violations": plus(counts.values()),
        "liability_high_severity_violations": band(10, 1000),
        "liability_medium_severity_violations": band(5, 10),
        "liability_low_severity_violations": band(0, 5),
        **{f"liability_{m}_count": c for m, c in counts.items()},
    }


def liability_summary(violations: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, motif): count, position range and mean severity.

    ``violations`` holds one row per violation with motif, pos, len, severity.
    """
    grouped = violations.groupBy(*keys, "motif").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.count("pos").alias("num_positions"),
        F.round(F.avg("severity"), 1).alias("avg_severity"),
        F.min_by("severity", F.coalesce("pos", F.lit(0))).alias("severity"),
        F.max("details").alias("details"),
    )
    where = F.when(
        F.col("n") == 1, F.concat(F.lit("pos"), F.col("first_pos"))
    ).otherwise(F.concat(F.lit("pos"), F.col("first_pos"), F.lit("-"), F.col("last_pos")))
    times = F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("x"), F.col("n").cast("string")))
    place = F.coalesce(where, F.col("details"))
    inside = F.concat_ws(",", place, F.concat(F.lit("sev"), F.col("severity").cast("string")))
    return grouped.withColumn(
        "summary", F.concat(F.col("motif"), times, F.lit("("), inside, F.lit(")"))
    )


def violations_summary(violations: Column, modality: str, peptide_type: str = "linear") -> Column:
    """The one-line summary of all motifs of a sequence, from its violation array."""
    motifs = list(motif_set(modality, peptide_type)) + [
        "UnpairedCys",
        "HighNetCharge",
        "LowHydrophilic",
        "ConsecIdentical",
        "LongHydrophobic",
    ]

    def of_motif(motif: str) -> Column:
        return F.filter(violations, lambda v: v["motif"] == motif)

    texts = []
    for motif in motifs:
        found = of_motif(motif)
        n = F.size(found)
        places = F.filter(F.transform(found, lambda v: v["pos"]), lambda p: p.isNotNull())
        low, high = F.array_min(places), F.array_max(places)
        span = F.when(n == 1, F.concat(F.lit("pos"), low.cast("string"))).otherwise(
            F.concat(F.lit("pos"), low.cast("string"), F.lit("-"), high.cast("string"))
        )
        inside = F.concat_ws(
            ",", F.coalesce(span, F.get(found, F.lit(0))["details"]), F.lit(f"sev{severity(motif)}")
        )
        times = F.when(n == 1, "").otherwise(F.concat(F.lit("x"), n.cast("string")))
        texts.append(
            F.when(n > 0, F.concat(F.lit(motif), times, F.lit("("), inside, F.lit(")")))
        )
    return F.concat_ws("; ", *texts)
