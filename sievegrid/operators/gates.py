"""Rule gates over submissions, items, metrics and records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions import intake as I
from sievegrid.functions import sequences as S


def all_of(conditions: Sequence[Column]) -> Column:
    """Pluggable record predicates, combined with AND."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def first_failed(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that does not hold, null when all do."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(list(rules)):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


# design filters --------------------------------------------------------------


def metric_threshold_filters(
    df: DataFrame, rules: Sequence[tuple[str, bool, float]]
) -> DataFrame:
    """``pass_<f>_filter`` per (feature, lower_is_better, threshold), all inclusive.

    ``num_filters_passed`` is the length of the passing prefix of the rules;
    ``pass_filters`` says that all passed.
    """
    flags = {
        f"pass_{feature}_filter": F.coalesce(
            F.col(feature) <= threshold if lower else F.col(feature) >= threshold, F.lit(False)
        )
        for feature, lower, threshold in rules
    }
    out = df.withColumns(flags)
    prefix, passed = F.lit(True), F.lit(0)
    for flag in flags:
        prefix = prefix & F.col(flag)
        passed = passed + prefix.cast("int")
    return out.withColumns({"num_filters_passed": passed, "pass_filters": prefix})


def filter_pass_counts(df: DataFrame, rules: Sequence[tuple[str, bool, float]]) -> DataFrame:
    """Rows that pass each rule, and rows left after each rule."""
    flags = [f"pass_{feature}_filter" for feature, _, _ in rules]
    counts = []
    for i, flag in enumerate(flags):
        left = all_of([F.col(f) for f in flags[: i + 1]])
        counts += [F.count_if(F.col(flag)).alias(f"{flag}_n"), F.count_if(left).alias(f"{flag}_left")]
    return df.agg(*counts)


def derive_filter_columns(df: DataFrame, from_inverse_folded: bool) -> DataFrame:
    """Backbone or all-atom RMSD, sign-flipped copies, and whether X occurs."""
    prefix = "bb_" if from_inverse_folded else ""
    out = {"has_x": F.col("designed_sequence").contains("X")}
    for suffix in ("rmsd", "rmsd_design"):
        if f"{prefix}{suffix}" in df.columns:
            out[f"filter_{suffix}"] = F.col(f"{prefix}{suffix}")
    folding = f"designfolding-{prefix}rmsd"
    if folding in df.columns:
        out["designfolding-filter_rmsd"] = F.col(f"`{folding}`")
    for metric in (
        "min_design_to_target_pae",
        "design_hydrophobicity",
        "design_largest_hydrophobic_patch_refolded",
        "min_interaction_pae",
    ):
        if metric in df.columns:
            out[f"neg_{metric}"] = -F.col(metric)
    return df.withColumns(out)


# submission gates --------------------------------------------------------------


def has_duplicates(items: Column) -> Column:
    return F.size(items) != F.size(F.array_distinct(items))


def nanobody_rules(
    items: Column,
    count: int,
    length: tuple[int, int] = (90, 150),
    max_run: int = 6,
    max_pairs: int = 4,
    min_cys: int = 1,
    cys_sep: tuple[int, int] = (35, 80),
    signal: tuple[int, int, int] = (12, 8, 30),
) -> list[tuple[str, Column]]:
    """Rules on the first ``count`` sequences of a submission, in the order they are checked."""
    every = lambda test: F.forall(items, test)
    rules = [
        ("placeholder", ~F.exists(items, lambda s: s.contains("~"))),
        ("too_few", F.size(items) >= count),
        ("duplicate", ~has_duplicates(items)),
        ("length", every(lambda s: F.length(s).between(*length))),
        ("alphabet", every(lambda s: S.has_only(s))),
        ("homopolymer", every(lambda s: S.max_run_length(s) <= max_run)),
        ("pair_repeat", every(lambda s: S.max_pair_repeats(s) <= max_pairs)),
        ("cysteines", every(lambda s: S.letter_count(s, "C") >= min_cys)),
        ("signal_peptide", ~F.exists(items, lambda s: S.signal_peptide_like(s, *signal))),
    ]
    if min_cys > 1:
        pair = ("cys_pair", F.exists(items, lambda s: S.has_cys_pair(s, *cys_sep)))
        rules.insert(-1, pair)
    return rules


def nanobody_gate(df: DataFrame, count: int, items: str = "items", **limits) -> DataFrame:
    """All-or-nothing gate per submission: too long lists are cut, the first failed rule is named."""
    first = F.slice(items, 1, count)
    cut = F.transform(first, lambda s: S.normalize(s))
    # Bound, so that a filter on the rule does not derive the items again for each of its tests.
    failed = S.bind(cut, lambda x: first_failed(nanobody_rules(x, count, **limits)))
    return df.withColumns({items: cut, "first_failed_rule": failed})


def molecule_rules(
    name: Column,
    reactions: Sequence[str],
    smiles: Column,
    bonds: Column,
    archived: Column,
    min_heavy: int,
    banned: Sequence[str],
    min_bonds: int,
    max_bonds: int,
) -> list[tuple[str, Column]]:
    """The rules of one molecule in their order; the first that fails ends its submission.

    ``smiles`` is null or empty where the product can't be resolved; rules behind that see no molecule and
    need not say so. ``archived`` is true where an archive holds the molecule.
    """
    some = F.coalesce(smiles, F.lit(""))
    return [
        ("reaction", I.reaction_in(name, reactions)),
        ("unresolved", some != ""),
        ("heavy_atoms", I.heavy_atoms(some) >= min_heavy),
        ("banned_elements", ~I.contains_element(some, banned)),
        ("rotatable_bonds", bonds.between(min_bonds, max_bonds)),
        ("archived", ~F.coalesce(archived, F.lit(False))),
    ]


def molecule_gate(
    items: DataFrame, uid: str, pos: str, rules: Sequence[tuple[str, Column]], diverse: Column
) -> DataFrame:
    """Keep the items before the first failure of each submission; a lack of diversity
    only drops that item.

    The first failing position is a partial aggregate; it is joined back by uid.
    """
    checked = items.withColumn("failed_rule", first_failed(rules))
    stops = (
        checked.filter("failed_rule IS NOT NULL").groupBy(uid).agg(F.min(pos).alias("_stop"))
    )
    kept = checked.join(stops, uid, "left").filter(F.col("_stop").isNull() | (F.col(pos) < F.col("_stop")))
    return kept.filter(diverse).drop("_stop", "failed_rule")


def nativeness_gate(
    items: DataFrame,
    results: DataFrame,
    uid: str = "uid",
    key: str = "seq_hash",
    min_nativeness: float = 0.45,
    min_framework: float = 0.75,
    enforce_vhh: bool = True,
) -> DataFrame:
    """uids whose every item has a result that passes."""
    joined = items.join(results, key, "left")
    fine = (F.col("nativeness") >= min_nativeness) & (F.col("human_framework") >= min_framework)
    if enforce_vhh:
        fine = fine & (S.heavy_chain_class(F.col("pos49"), F.col("pos50")) == "VHH")
    passed = joined.groupBy(uid).agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("_ok"))
    return passed.filter("_ok").select(uid)


# Developability ranges, inclusive.
DEVELOPABILITY_RANGES = {
    "total_cdr_length": (20.0, 39.0),
    "cdr3_length": (5.0, 23.0),
    "compactness": (0.56, 1.61),
    "hydrophobic_patches": (73.4, 155.47),
    "positive_patches": (None, 1.18),
    "negative_patches": (None, 1.88),
}


def range_flags(ranges: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """Map of rule name to whether the column lies in its range."""
    parts = []
    for name, (low, high) in ranges.items():
        tests = []
        if low is not None:
            tests.append(F.col(name) >= low)
        if high is not None:
            tests.append(F.col(name) <= high)
        parts += [F.lit(name), F.coalesce(all_of(tests), F.lit(False))]
    return F.create_map(*parts)


def developability_gate(
    items: DataFrame, uid: str, ranges: Mapping[str, tuple[float | None, float | None]]
) -> DataFrame:
    """uids whose every item lies in all ranges."""
    ok = F.forall(F.map_values(range_flags(ranges)), lambda x: x)
    return items.groupBy(uid).agg(F.bool_and(ok).alias("_ok")).filter("_ok").select(uid)


# similarity matches --------------------------------------------------------------


def duplicate_tier(identity: Column, cdr1: Column, cdr2: Column, cdr3: Column, has_cdr: Column) -> Column:
    """(duplicate, reason) of a match by identity and CDR similarity."""
    share = lambda c: F.concat(F.format_string("%.0f", F.rint(c * 100)), F.lit("%"))
    c1, c2, c3 = (F.coalesce(c, F.lit(0.0)) for c in (cdr1, cdr2, cdr3))
    out = lambda flag, text: F.struct(F.lit(flag).alias("dup"), text.alias("reason"))
    return (
        F.when(identity >= 0.95, out(True, F.lit("near-identical sequence")))
        .when(
            has_cdr & (c3 >= 0.85),
            out(True, F.concat(F.lit("CDR3 identity "), share(c3), F.lit(" (same clonotype)"))),
        )
        .when(
            has_cdr & (c3 >= 0.80) & (c1 >= 0.90) & (c2 >= 0.90),
            out(True, F.concat(F.lit("CDR3="), share(c3), F.lit(" with conserved CDR1/CDR2"))),
        )
        .when(
            (identity >= 0.90) & ~has_cdr,
            out(True, F.concat(F.lit("whole-sequence identity "), share(identity), F.lit(" (no CDR data)"))),
        )
        .otherwise(out(False, F.lit("novel")))
    )


# records ---------------------------------------------------------------------------


def record_date(revised: Column, released: Column, deposited: Column, ref: str = "released") -> Column:
    """Date of a record: the reference date, with fallbacks for empty text."""
    filled = lambda c: F.nullif(c, F.lit(""))
    order = {
        "revised": [revised, released, deposited],
        "released": [released, deposited],
        "deposited": [deposited],
    }[ref]
    return F.coalesce(*[filled(c) for c in order]).try_cast("date")


def confidence_filter(
    struct: Column, rules: Sequence[tuple[str, str, float]], mode: str = "OR"
) -> Column:
    """Inclusive comparisons of a confidence struct; a missing struct or metric passes."""
    tests = []
    for metric, sign, threshold in rules:
        value = struct[metric]
        test = value >= threshold if sign == ">" else value <= threshold
        tests.append(F.coalesce(test, F.lit(True)))
    combined = any_of(tests) if mode == "OR" else all_of(tests)
    return struct.isNull() | combined


def polymer_filter(residues: DataFrame, low: int = 4, high: int = 5000) -> DataFrame:
    """(structure_id, chain_id, valid): resolved residues in range and not all unknown."""
    return residues.groupBy("structure_id", "chain_id").agg(
        (
            F.count_if(F.col("is_present")).between(low, high)
            & ~F.bool_and(F.col("name") == "UNK")
        ).alias("valid")
    )


def propagate_validity(
    chains: DataFrame, masks: Sequence[DataFrame], interfaces: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Chain valid = AND of all masks; interface valid = both chains valid."""
    keys = ["structure_id", "chain_id"]
    out = chains.withColumn("valid", F.lit(True)) if "valid" not in chains.columns else chains
    for mask in masks:
        other = mask.select(*keys, F.col("valid").alias("_m"))
        out = out.join(other, keys, "left").withColumn(
            "valid", F.col("valid") & F.coalesce("_m", F.lit(True))
        ).drop("_m")
    ok = out.filter("valid").select(*keys)
    first = ok.withColumnRenamed("chain_id", "chain_1").withColumn("_a", F.lit(True))
    second = ok.withColumnRenamed("chain_id", "chain_2").withColumn("_b", F.lit(True))
    flagged = (
        interfaces.join(first, ["structure_id", "chain_1"], "left")
        .join(second, ["structure_id", "chain_2"], "left")
        .withColumn("valid", F.coalesce(F.col("_a") & F.col("_b"), F.lit(False)))
        .drop("_a", "_b")
    )
    return out, flagged


# parameter text ----------------------------------------------------------------------


def parse_filter_rule(text: str) -> tuple[str, bool, float]:
    """``feature>thr`` or ``feature<thr`` to (feature, lower_is_better, threshold)."""
    for sign in "<>":
        feature, found, threshold = text.partition(sign)
        if found:
            return feature.strip(), sign == "<", float(threshold)
    raise ValueError(f"no comparison in filter rule: {text}")


def parse_metric_weight(text: str) -> tuple[str, float | None]:
    """``metric=weight``, where ``none`` switches the metric off."""
    metric, found, weight = text.partition("=")
    if not found:
        raise ValueError(f"no weight in metric rule: {text}")
    value = weight.strip()
    return metric.strip(), None if value.lower() == "none" else float(value)


def parse_size_bucket(text: str) -> tuple[int, int, int]:
    """``min-max:count`` to (min, max, count)."""
    span, _, count = text.partition(":")
    low, _, high = span.partition("-")
    return int(low), int(high), int(count)
