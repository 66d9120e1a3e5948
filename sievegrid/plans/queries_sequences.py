"""Queries over the sequence functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegrid.functions import liabilities as L
from sievegrid.functions import sequences as S
from sievegrid.plans import fixtures as X
from sievegrid.plans.registry import query
from sievegrid.session import unnest

SEQ = X.with_sql(X.SQL_SEQUENCES)
CHAIN = X.with_sql(X.SQL_CHAINS)


@query(
    "f1_normalize_and_hash",
    X.with_sql(X.SQL_PIECES)
    + r"""SELECT doc_id, pos, sha256(upper(trim(regexp_replace(piece, '[^ -~]', '', 'g')))) AS seq_hash
    FROM pieces""",
)
def f1(spark, sf):
    ascii_text = F.regexp_replace("piece", "[^ -~]", "")
    return X.pieces(spark, sf).select(
        "doc_id", "pos", S.sequence_hash(S.normalize(ascii_text)).alias("seq_hash")
    )


@query(
    "f2_max_run_length",
    CHAIN
    + """, letters AS (SELECT doc_id, unnest(string_split(seq, '')) AS c,
      unnest(range(1, length(seq) + 1)) AS i FROM chains WHERE seq <> ''),
    breaks AS (SELECT doc_id, i, CASE WHEN c = lag(c) OVER w THEN 0 ELSE 1 END AS b
      FROM letters WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    runs AS (SELECT doc_id, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM breaks),
    sizes AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL)
    SELECT doc_id, CAST(coalesce(max(n), 0) AS INT) AS max_run
    FROM chains LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
)
def f2(spark, sf):
    return X.chains(spark, sf).select("doc_id", S.max_run_length(F.col("seq")).alias("max_run"))


@query(
    "f3_max_pair_repeats",
    CHAIN
    + """, letters AS (SELECT doc_id, i, n, a, lead(a, 1, '') OVER w AS b, lead(a, 2, '') OVER w AS c
      FROM (SELECT doc_id, length(seq) AS n, unnest(string_split(seq, '')) AS a,
        unnest(range(1, length(seq) + 1)) AS i FROM chains WHERE seq <> '')
      WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    hits AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
      FROM letters WHERE a = c AND a <> b),
    islands AS (SELECT doc_id, i - k AS g, count(*) AS n FROM hits GROUP BY ALL),
    best AS (SELECT doc_id, max((n + 2) // 2) AS pairs FROM islands GROUP BY doc_id),
    lone AS (SELECT doc_id, max(CASE WHEN i <= n - 3 AND a <> b THEN 1 ELSE 0 END) AS any_pair
      FROM letters GROUP BY doc_id)
    SELECT doc_id, CAST(CASE WHEN length(seq) < 4 THEN 0 WHEN pairs >= 2 THEN pairs
      ELSE coalesce(any_pair, 0) END AS INT) AS max_pairs
    FROM chains LEFT JOIN best USING (doc_id) LEFT JOIN lone USING (doc_id)""",
)
def f3(spark, sf):
    return X.chains(spark, sf).select("doc_id", S.max_pair_repeats(F.col("seq")).alias("max_pairs"))


@query(
    "f4_has_cys_pair",
    SEQ + "SELECT doc_id, pos, regexp_matches(seq, 'C.{34,79}C') AS has_pair FROM sequences",
)
def f4(spark, sf):
    return X.sequences(spark, sf).select(
        "doc_id", "pos", S.has_cys_pair(F.col("seq"), 35, 80).alias("has_pair")
    )


@query(
    "f5_signal_peptide_like",
    SEQ
    + """SELECT doc_id, pos, length(seq) >= 12 AND len(list_filter(range(1, 20), lambda i:
        i + 11 <= least(length(seq), 30) AND
        length(regexp_replace(substr(seq, i, 12), '[^AILMFWV]', '', 'g')) >= 8)) > 0 AS flagged
    FROM sequences""",
)
def f5(spark, sf):
    return X.sequences(spark, sf).select(
        "doc_id", "pos", S.signal_peptide_like(F.col("seq")).alias("flagged")
    )


_SQL_LETTER_COUNTS = ", ".join(
    f"length(seq) - length(replace(seq, '{a}', '')) AS n_{a}" for a in S.AMINO_ACIDS
)
_SQL_ENTROPY = " + ".join(
    f"CASE WHEN n_{a} > 0 THEN n_{a} * log2(n_{a}) ELSE 0 END" for a in S.AMINO_ACIDS
)


@query(
    "f6_residue_entropy",
    CHAIN
    + f""", counts AS (SELECT doc_id, length(seq) AS n, {_SQL_LETTER_COUNTS} FROM chains)
    SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE round(log2(n) - ({_SQL_ENTROPY}) / n, 8) END AS entropy
    FROM counts""",
)
def f6(spark, sf):
    return X.chains(spark, sf).select(
        "doc_id", F.round(S.residue_entropy(F.col("seq")), 8).alias("entropy")
    )


@query(
    "f7_alphabet_and_length",
    X.with_sql(X.SQL_PIECES)
    + """SELECT doc_id, pos, regexp_full_match(piece, '[ACDEFGHIKLMNPQRSTVWY]*') AS allowed,
      CAST(length(piece) - length(replace(piece, 'C', '')) AS INT) AS cysteines,
      length(piece) BETWEEN 90 AND 150 AS in_range FROM pieces""",
)
def f7(spark, sf):
    piece = F.col("piece")
    return X.pieces(spark, sf).select(
        "doc_id",
        "pos",
        S.has_only(piece).alias("allowed"),
        S.letter_count(piece, "C").alias("cysteines"),
        F.length(piece).between(90, 150).alias("in_range"),
    )


@query(
    "f8_kmers",
    SEQ
    + """SELECT kmer, count(*) AS n FROM (
      SELECT unnest(list_distinct(list_transform(range(1, length(seq) - 3), lambda i: substr(seq, i, 5)))) AS kmer
      FROM sequences WHERE length(seq) >= 5) GROUP BY kmer""",
)
def f8(spark, sf):
    exploded = unnest(X.sequences(spark, sf), S.kmers(F.col("seq"), 5), "kmer")
    return exploded.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


_ANTIBODY = L.ANTIBODY_MOTIFS
_SQL_MOTIF_COUNTS = ", ".join(
    f"len(regexp_extract_all(seq, '{p}')) AS n_{m}" for m, p in _ANTIBODY.items()
)
_SQL_CYS = """len(list_filter(range(1, len(cys) + 1), lambda i:
  NOT coalesce((cys[i] - CASE WHEN i > 1 THEN cys[i - 1] END) IN (1, 2), false)
  AND NOT coalesce((cys[i + 1] - cys[i]) IN (1, 2), false)))"""
_SQL_CYS_LIST = "list_filter(range(1, length(seq) + 1), lambda i: substr(seq, i, 1) = 'C')"
_SQL_CHARGE = (
    "length(regexp_replace(seq, '[^KR]', '', 'g')) - length(regexp_replace(seq, '[^DE]', '', 'g'))"
)


def _sql_sum(names, weight):
    return " + ".join(f"n_{m} * {weight(m)}" for m in names)


_ALL_ANTIBODY = [*_ANTIBODY, "UnpairedCys", "HighNetCharge"]
_SQL_LIABILITY = (
    SEQ
    + f""", cys AS (SELECT *, {_SQL_CYS_LIST} AS cys FROM sequences),
    counts AS (SELECT doc_id, pos, {_SQL_MOTIF_COUNTS}, {_SQL_CYS} AS n_UnpairedCys,
      CASE WHEN {_SQL_CHARGE} > 1 THEN 1 ELSE 0 END AS n_HighNetCharge FROM cys)
    """
)


@query(
    "f17_liability_score",
    _SQL_LIABILITY
    + f"""SELECT doc_id, pos, CAST({_sql_sum(_ALL_ANTIBODY, L.severity)} AS INT) AS liability_score,
      CAST({_sql_sum(_ALL_ANTIBODY, lambda m: 1)} AS INT) AS liability_num_violations FROM counts""",
)
def f17(spark, sf):
    """Score and number of violations from the full violation list."""
    found = L.liability_violations(F.col("seq"))
    return (
        X.sequences(spark, sf)
        .select("doc_id", "pos", found.alias("v"))
        .select(
            "doc_id",
            "pos",
            F.aggregate("v", F.lit(0), lambda acc, v: acc + v["severity"]).alias("liability_score"),
            F.size("v").alias("liability_num_violations"),
        )
    )


@query(
    "f17_liability_positions",
    SEQ
    + r""", marked AS (SELECT doc_id, pos, string_split(regexp_replace(seq, '(N[GS])', chr(1) || '\1', 'g'), chr(1)) AS p
      FROM sequences),
    cut AS (SELECT doc_id, pos, p, unnest(range(1, len(p))) AS i FROM marked WHERE len(p) > 1)
    SELECT doc_id, pos, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + 1 AS INT) AS start,
      10 AS severity FROM cut""",
)
def f17_positions(spark, sf):
    """Violation positions exploded to one row each, for the deamidation motif."""
    found = L.liability_violations(F.col("seq"))
    exploded = unnest(X.sequences(spark, sf), found, "v", "doc_id", "pos")
    return exploded.filter("v.motif = 'DeAmdH'").select(
        "doc_id", "pos", F.col("v.pos").alias("start"), "v.severity"
    )


@query(
    "f18_antibody_extras",
    SEQ
    + f""", cys AS (SELECT *, {_SQL_CYS_LIST} AS cys FROM sequences)
    SELECT doc_id, pos, CAST({_SQL_CYS} AS INT) AS unpaired_cys, {_SQL_CHARGE} > 1 AS high_net_charge FROM cys""",
)
def f18(spark, sf):
    counts = L.liability_counts(F.col("seq"))
    return X.sequences(spark, sf).select(
        "doc_id",
        "pos",
        counts["UnpairedCys"].alias("unpaired_cys"),
        (counts["HighNetCharge"] == 1).alias("high_net_charge"),
    )


@query(
    "f19_peptide_extras",
    SEQ
    + """, cys AS (SELECT *, length(regexp_replace(seq, '[^C]', '', 'g')) AS n_cys,
      length(regexp_replace(seq[2:-2], '[^C]', '', 'g')) AS n_inner,
      length(regexp_replace(seq, '[^DEKRHNQST]', '', 'g')) / length(seq) * 100 AS wet,
      coalesce(list_max(list_transform(regexp_extract_all(seq, '[FILVWY]+'), lambda x: length(x))), 0) AS greasy,
      greatest(""" + ", ".join(
        f"coalesce(list_max(list_transform(regexp_extract_all(seq, '{a}+'), lambda x: length(x))), 0)"
        for a in S.AMINO_ACIDS
    ) + """) AS same FROM sequences)
    SELECT doc_id, pos, CAST(CASE WHEN n_cys % 2 = 1 THEN n_cys ELSE 0 END AS INT) AS linear_unpaired,
      CAST(CASE WHEN n_inner % 2 = 1 THEN n_inner ELSE 0 END AS INT) AS cyclic_unpaired,
      wet < 40 AS low_hydrophilic, same > 1 AS consec_identical, greasy > 4 AS long_hydrophobic FROM cys""",
)
def f19(spark, sf):
    linear = L.liability_violations(F.col("seq"), "peptide", "linear")
    cyclic = L.liability_violations(F.col("seq"), "peptide", "cyclic")
    has = lambda v, m: F.exists(v, lambda x: x["motif"] == m)
    number = lambda v, m: F.size(F.filter(v, lambda x: x["motif"] == m))
    return (
        X.sequences(spark, sf)
        .select("doc_id", "pos", linear.alias("lin"), cyclic.alias("cyc"))
        .select(
            "doc_id",
            "pos",
            number(F.col("lin"), "UnpairedCys").alias("linear_unpaired"),
            number(F.col("cyc"), "UnpairedCys").alias("cyclic_unpaired"),
            has(F.col("cyc"), "LowHydrophilic").alias("low_hydrophilic"),
            has(F.col("cyc"), "ConsecIdentical").alias("consec_identical"),
            has(F.col("cyc"), "LongHydrophobic").alias("long_hydrophobic"),
        )
    )


def _sql_band(low, high):
    names = [m for m in _ALL_ANTIBODY if low <= L.severity(m) < high]
    return f"CAST({_sql_sum(names, lambda m: 1)} AS INT)"


@query(
    "f20_liability_metrics",
    _SQL_LIABILITY
    + f"""SELECT doc_id, pos, CAST({_sql_sum(_ALL_ANTIBODY, L.severity)} AS INT) AS liability_score,
      CAST({_sql_sum(_ALL_ANTIBODY, lambda m: 1)} AS INT) AS liability_num_violations,
      {_sql_band(10, 1000)} AS liability_high_severity_violations,
      {_sql_band(5, 10)} AS liability_medium_severity_violations,
      {_sql_band(0, 5)} AS liability_low_severity_violations, """
    + ", ".join(f"CAST(n_{m} AS INT) AS liability_{m}_count" for m in _ALL_ANTIBODY)
    + " FROM counts",
)
def f20(spark, sf):
    metrics = L.liability_metrics(L.liability_counts(F.col("seq")))
    return X.sequences(spark, sf).select("doc_id", "pos", *[c.alias(n) for n, c in metrics.items()])


def _sql_case(letter: str, place: int) -> str:
    whens = " ".join(f"WHEN '{a}' THEN {c[place]}" for a, c in S.RETENTION.items())
    return f"(CASE {letter} {whens} ELSE 0 END)"


_SQL_NEIGHBOURS = " + ".join(
    f"{w} * (len(regexp_extract_all(seq, '[HRK]{a}')) + len(regexp_extract_all(seq, '{a}[HRK]')))"
    for a, w in S.NEIGHBOUR_PENALTY.items()
)


@query(
    "f21_hydrophobicity",
    CHAIN
    + f""", places AS (SELECT doc_id, length(seq) AS n, unnest(string_split(seq, '')) AS c,
        unnest(range(1, length(seq) + 1)) AS i FROM chains WHERE seq <> ''),
    base AS (SELECT doc_id, sum(CASE WHEN i = 1 THEN {_sql_case('c', 1)}
        WHEN i = 2 THEN {_sql_case('c', 2)}
        WHEN i = n THEN {_sql_case('c', 3)}
        WHEN i = n - 1 THEN {_sql_case('c', 4)}
        ELSE {_sql_case('c', 0)} END) AS h FROM places GROUP BY doc_id),
    total AS (SELECT doc_id, length(seq) AS n, h - ({_SQL_NEIGHBOURS}) - coalesce(list_sum(list_transform(
        regexp_extract_all(seq, 'P+'), lambda r: CASE WHEN length(r) >= 4 THEN 5.0 WHEN length(r) = 3
        THEN 3.5 WHEN length(r) = 2 THEN 1.2 ELSE 0.0 END)), 0) AS h FROM chains JOIN base USING (doc_id)),
    scaled AS (SELECT doc_id, CAST(h AS DOUBLE) * CASE WHEN n < 8 THEN 1 - 0.055 * (8 - n)
        WHEN n > 20 THEN 1 / (1 + 0.027 * (n - 20)) ELSE 1 END AS h FROM total)
    SELECT doc_id, round(CAST(CASE WHEN h <= 20 THEN h WHEN h <= 30 THEN h - 0.27 * (h - 18)
        WHEN h <= 40 THEN h - 0.33 * (h - 18) WHEN h <= 50 THEN h - 0.38 * (h - 18)
        ELSE h - 0.447 * (h - 18) END AS DOUBLE), 4) AS hydrophobicity FROM scaled""",
)
def f21(spark, sf):
    return (
        X.chains(spark, sf)
        .filter("seq <> ''")
        .select("doc_id", S.hydrophobicity(F.col("seq")).alias("hydrophobicity"))
    )


@query(
    "f24_clip_sequence",
    CHAIN + "SELECT doc_id, substr(seq, 31, 182) AS clipped FROM chains",
)
def f24(spark, sf):
    return X.chains(spark, sf).select("doc_id", S.clip(F.col("seq"), 30, 212).alias("clipped"))


@query(
    "f26_sequence_cluster_key",
    CHAIN + "SELECT sha256(seq) AS cluster_key, count(*) AS n FROM chains GROUP BY ALL",
)
def f26(spark, sf):
    hashed = X.chains(spark, sf).select(S.sequence_hash(F.col("seq")).alias("cluster_key"))
    return hashed.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f27_region_of_position",
    CHAIN
    + """, places AS (SELECT doc_id, unnest(range(1, length(seq) + 1)) AS i FROM chains),
    regions AS (SELECT CASE WHEN i BETWEEN 1 AND 26 THEN 'FR1' WHEN i <= 38 THEN 'CDR1'
      WHEN i <= 55 THEN 'FR2' WHEN i <= 65 THEN 'CDR2' WHEN i <= 104 THEN 'FR3'
      WHEN i <= 117 THEN 'CDR3' WHEN i <= 128 THEN 'FR4' END AS region FROM places)
    SELECT region, count(*) AS n FROM regions GROUP BY region""",
)
def f27(spark, sf):
    places = X.chains(spark, sf).select(F.posexplode(F.split("seq", "")).alias("i", "c"))
    places = places.filter("c <> ''")
    return places.groupBy(S.region_of(F.col("i") + 1).alias("region")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "p24_heavy_chain_class",
    CHAIN
    + """SELECT doc_id, CASE WHEN contains('EQ', substr(seq, 49, 1)) AND substr(seq, 50, 1) = 'R'
      THEN 'VHH' ELSE 'VH' END AS domain FROM chains""",
)
def p24(spark, sf):
    seq = F.col("seq")
    return X.chains(spark, sf).select(
        "doc_id",
        S.heavy_chain_class(F.substring(seq, 49, 1), F.substring(seq, 50, 1)).alias("domain"),
    )


@query(
    "u6_partition_sequences",
    SEQ
    + """SELECT kind, count(*) AS n FROM (SELECT DISTINCT seq, CASE
      WHEN regexp_full_match(seq, '[ACGTUN]*') THEN 'nucleotide' WHEN length(seq) < 10 THEN 'short'
      ELSE 'protein' END AS kind FROM sequences) GROUP BY kind""",
)
def u6(spark, sf):
    distinct = X.sequences(spark, sf).select("seq").distinct()
    return distinct.groupBy(S.sequence_kind(F.col("seq")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "a13_composition",
    CHAIN
    + "SELECT doc_id, "
    + ", ".join(
        f"round((length(seq) - length(replace(seq, '{a}', ''))) / nullif(length(seq), 0), 8) AS {a}_fraction"
        for a in S.AMINO_ACIDS
    )
    + " FROM chains",
)
def a13(spark, sf):
    shares = S.composition(F.col("seq"))
    return X.chains(spark, sf).select(
        "doc_id", *[F.round(c, 8).alias(n) for n, c in shares.items()]
    )


@query(
    "a14_property_counts",
    CHAIN
    + ", n AS (SELECT "
    + ", ".join(
        f"sum(length(regexp_replace(seq, '[^{letters}]', '', 'g'))) AS {name}"
        for name, letters in {**S.HYDROPATHY, **S.CHARGE}.items()
    )
    + " FROM chains) SELECT * FROM (UNPIVOT n ON COLUMNS(*) INTO NAME property VALUE residues)",
)
def a14(spark, sf):
    classes = {**S.HYDROPATHY, **S.CHARGE}
    totals = X.chains(spark, sf).agg(
        *[F.sum(S.count_of(F.col("seq"), letters)).alias(n) for n, letters in classes.items()]
    )
    return totals.unpivot([], list(classes), "property", "residues")
