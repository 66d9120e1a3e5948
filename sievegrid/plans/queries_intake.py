"""Queries over submission intake, parsing, validity gates and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegrid.functions import intake as I
from sievegrid.functions import scoring as C
from sievegrid.operators import gates as G
from sievegrid.operators import joins as J
from sievegrid.operators import similarity as Y
from sievegrid.plans import fixtures as X
from sievegrid.plans.registry import query
from sievegrid.session import unnest

COMMITS = X.with_sql(X.SQL_COMMITS)
_PATH_SQL = (
    "concat('owner', doc_id % 7, '/repo/main/', "
    "CASE WHEN doc_id % 3 = 0 THEN 'stale' ELSE substr(sha256(text), 1, 20) END, '.txt')"
)


def payloads(spark, sf):
    docs = X.documents(spark, sf)
    stem = F.when(F.col("doc_id") % 3 == 0, "stale").otherwise(F.substring(F.sha2("text", 256), 1, 20))
    owner = F.concat(F.lit("owner"), (F.col("doc_id") % 7).cast("string"))
    return docs.select(
        "doc_id",
        F.col("text").alias("content"),
        F.concat(owner, F.lit("/repo/main/"), stem, F.lit(".txt")).alias("path"),
    )


@query(
    "p1_commit_window",
    COMMITS
    + """SELECT commit_id, uid, block FROM commits
      WHERE block % 361 > 0 AND block % 361 < 351 AND block IS NOT NULL""",
)
def p1(spark, sf):
    start = (F.col("block") / 361).cast("bigint") * 361
    fine = (F.col("block") > start) & (F.col("block") < start + 361 - C.CUTOFF_BLOCKS)
    return X.commits(spark, sf).filter(fine)


@query(
    "p2_verify_payload_hash",
    f"SELECT doc_id FROM documents WHERE text <> '' AND ends_with({_PATH_SQL}, "
    "'/' || substr(sha256(text), 1, 20) || '.txt')",
)
def p2(spark, sf):
    fine = I.hash_matches_path(F.col("content"), F.col("path"))
    return payloads(spark, sf).filter(fine).select("doc_id")


_LITERAL_SQL = (
    "CASE WHEN doc_id % 4 = 0 THEN concat('(', doc_id, ', b', chr(39), regexp_replace(text, "
    "'[^a-zA-Z0-9 ]', '', 'g'), chr(39), ')') ELSE concat('(', doc_id, ', ', doc_id, ')') END"
)


@query(
    "p3_payload_literal",
    f"""WITH p AS (SELECT doc_id, {_LITERAL_SQL} AS content FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND length(content) <= 20480 THEN doc_id END AS round_number FROM p""",
)
def p3(spark, sf):
    body = F.regexp_replace("text", "[^a-zA-Z0-9 ]", "")
    number = F.col("doc_id").cast("string")
    content = F.when(
        F.col("doc_id") % 4 == 0, F.concat(F.lit("("), number, F.lit(", b'"), body, F.lit("')"))
    ).otherwise(F.concat(F.lit("("), number, F.lit(", "), number, F.lit(")")))
    docs = X.documents(spark, sf)
    return docs.select("doc_id", I.payload_literal(content).alias("round_number"))


@query(
    "p4_uid_prefix",
    "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN props END AS plain FROM events",
)
def p4(spark, sf):
    events = X.table(spark, sf, "events").select("event_id", "user_id", "props")
    owner = F.when(F.col("event_id") % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    text = F.concat(owner.cast("string"), F.lit(":"), F.col("props"))
    return events.select("event_id", I.strip_uid_prefix(text, F.col("user_id")).alias("plain"))


_SUBMISSION_SQL = """concat(CASE WHEN doc_id % 9 = 0 THEN '~' WHEN doc_id % 11 = 0 THEN '' ELSE
  concat('rxn:', doc_id % 5 + 1, ':', doc_id, ':', doc_id % 97, ',rxn:1:2:3') END, '|',
  CASE WHEN doc_id % 7 = 0 THEN '~' ELSE replace(trim(text), ' ', ',') END)"""


def submission_text(spark, sf):
    d = F.col("doc_id")
    text = lambda c: c.cast("string")
    molecules = F.concat(
        F.lit("rxn:"), text(d % 5 + 1), F.lit(":"), text(d), F.lit(":"), text(d % 97), F.lit(",rxn:1:2:3")
    )
    left = F.when(d % 9 == 0, "~").when(d % 11 == 0, "").otherwise(molecules)
    right = F.when(d % 7 == 0, "~").otherwise(F.replace(F.trim("text"), F.lit(" "), F.lit(",")))
    return X.documents(spark, sf).select("doc_id", F.concat(left, F.lit("|"), right).alias("content"))


@query(
    "p5_parse_submission",
    f"""WITH s AS (SELECT doc_id, regexp_replace({_SUBMISSION_SQL}, '^\\s+|\\s+$', '', 'g') AS c FROM documents),
    fine AS (SELECT doc_id, string_split(c, '|') AS p FROM s
      WHERE NOT regexp_matches(c, '[\\s\\x0b]') AND NOT regexp_matches(c, '[^\\x00-\\x7F]')
        AND len(string_split(c, '|')) = 2)
    SELECT doc_id, CASE WHEN p[1] = '~' THEN [] ELSE list_filter(string_split(p[1], ','), lambda x: x <> '') END AS molecules,
      CASE WHEN p[2] = '~' THEN [] ELSE list_filter(string_split(p[2], ','), lambda x: x <> '') END AS sequences
    FROM fine WHERE p[1] <> '' AND p[2] <> ''""",
)
def p5(spark, sf):
    parsed = submission_text(spark, sf).select(
        "doc_id", I.parse_submission(F.col("content")).alias("p")
    )
    return parsed.filter("p IS NOT NULL").select("doc_id", "p.molecules", "p.sequences")


@query(
    "p6_path_parts",
    """SELECT page_id, p[1] AS owner, p[2] AS repo, p[3] AS branch, array_to_string(p[4:], '/') AS file
    FROM (SELECT page_id, string_split(url, '/') AS p FROM pages) WHERE len(p) >= 4""",
)
def p6(spark, sf):
    pages = X.table(spark, sf, "pages").select("page_id", I.path_parts(F.col("url")).alias("p"))
    return pages.filter("p IS NOT NULL").select("page_id", "p.*")


_NAMES_SQL = """names AS (SELECT l_orderkey AS uid, l_linenumber AS pos, l_partkey, l_suppkey,
  concat('rxn:', l_suppkey % 6, ':', l_partkey, ':', l_orderkey % 50,
    CASE WHEN l_linenumber % 2 = 0 THEN concat(':', l_suppkey) ELSE '' END,
    CASE WHEN l_linenumber = 7 THEN ':x' ELSE '' END) AS name FROM lineitem)"""


def product_names(spark, sf):
    text = lambda c: F.col(c).cast("string")
    lines = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    third = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(":"), text("l_suppkey"))).otherwise("")
    odd = F.when(F.col("l_linenumber") == 7, ":x").otherwise("")
    name = F.concat(
        F.lit("rxn:"),
        (F.col("l_suppkey") % 6).cast("string"),
        F.lit(":"),
        text("l_partkey"),
        F.lit(":"),
        (F.col("l_orderkey") % 50).cast("string"),
        third,
        odd,
    )
    return lines.select(
        F.col("l_orderkey").alias("uid"),
        F.col("l_linenumber").alias("pos"),
        "l_partkey",
        "l_suppkey",
        name.alias("name"),
    )


NAMES = X.with_sql(_NAMES_SQL)


@query(
    "p7_reaction_allowed",
    NAMES
    + """SELECT l_suppkey % 6 = 2 AS one, l_suppkey % 6 IN (1, 2) AS any_of, count(*) AS n FROM names GROUP BY ALL""",
)
def p7(spark, sf):
    name = F.col("name")
    return (
        product_names(spark, sf)
        .groupBy(
            I.reaction_allowed(name, "rxn:2").alias("one"),
            I.reaction_in(name, ["rxn:1", "rxn:2"]).alias("any_of"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p8_strip_quotes",
    """SELECT event_id, regexp_replace(concat(chr(39), props, '"'), '[''"]', '', 'g') AS plain,
      starts_with(regexp_replace(props, '[''"]', '', 'g'), 'rxn:') AS is_product FROM events""",
)
def p8(spark, sf):
    quoted = F.concat(F.lit("'"), F.col("props"), F.lit('"'))
    return X.table(spark, sf, "events").select(
        "event_id",
        I.strip_quotes(quoted).alias("plain"),
        I.strip_quotes(F.col("props")).startswith("rxn:").alias("is_product"),
    )


@query(
    "p9_duplicate_in_submission",
    X.with_sql(X.SQL_SUBMISSIONS)
    + "SELECT uid, len(items) <> len(list_distinct(items)) AS has_duplicates FROM submissions",
)
def p9(spark, sf):
    return X.submissions(spark, sf).select(
        "uid", G.has_duplicates(F.col("items")).alias("has_duplicates")
    )


@query(
    "f9_parse_product",
    NAMES
    + """SELECT uid, pos, name, CAST(l_suppkey % 6 AS INT) AS rxn, l_partkey AS m1, uid % 50 AS m2,
      CASE WHEN pos % 2 = 0 THEN l_suppkey END AS m3 FROM names WHERE pos <> 7""",
)
def f9(spark, sf):
    # as the one item of an array, so that the test for null doesn't parse every name again
    one = F.array(I.parse_product(F.col("name")))
    parsed = unnest(X.spread(product_names(spark, sf)), one, "p", "uid", "pos", "name")
    return parsed.select("uid", "pos", "name", "p.*")


@query(
    "p10_molecule_gate",
    NAMES
    + r""", raw AS (SELECT *, regexp_extract_all(p_name, '\[[^\]]*\]|Br|Cl|[BCNOPSFI]|[bcnops]') AS t, p_name || ' ' || p_brand AS label FROM part),
    feats AS (SELECT p_partkey, label, len(t) AS heavy, len(list_filter(t, lambda x: lower(x) = 'p')) > 0 AS banned,
      length(regexp_replace(p_name, '[^aeiou]', '', 'g')) AS bonds, p_type = 'PROMO' AS old,
      list_distinct(list_transform(range(1, length(label)), lambda i: substr(label, i, 2))) AS bits FROM raw),
    known AS (SELECT DISTINCT label FROM feats WHERE old),
    sets AS (SELECT DISTINCT label, bits FROM feats), olds AS (SELECT DISTINCT label, bits FROM feats WHERE old),
    close AS (SELECT DISTINCT a.label FROM sets a JOIN olds b
      ON len(list_intersect(a.bits, b.bits)) * 1.9 >= 0.9 * (len(a.bits) + len(b.bits)) - 1e-9),
    checked AS (SELECT uid, pos, name, label, l_suppkey % 6 IN (1, 2, 3) AND regexp_matches(name, '^rxn:\d+:\d+:\d+(:\d+)?$') AND label IS NOT NULL
        AND heavy >= 2 AND NOT banned AND bonds BETWEEN 2 AND 4 AND label NOT IN (SELECT label FROM known) AS fine
      FROM names LEFT JOIN feats ON l_partkey = p_partkey),
    stops AS (SELECT uid, min(pos) AS stop FROM checked WHERE NOT coalesce(fine, false) GROUP BY uid)
    SELECT uid, pos, name FROM checked LEFT JOIN stops USING (uid)
    WHERE (stop IS NULL OR pos < stop) AND label NOT IN (SELECT label FROM close)""",
)
def p10(spark, sf):
    """All rules of a molecule: reaction, structure found, size, elements, bonds, archive; and its likeness to the archive."""
    label = F.concat("p_name", F.lit(" "), "p_brand")
    pairs = F.transform(F.sequence(F.lit(1), F.length("label") - 1), lambda i: F.substring(F.col("label"), i, F.lit(2)))
    parts = X.table(spark, sf, "part").withColumn("label", label).withColumn("bits", F.array_distinct(pairs))
    archive = parts.filter("p_type = 'PROMO'").select("label", "bits").distinct()
    close = Y.near_archive(parts.select("label", "bits").distinct(), archive, "bits", 0.9).select("label", F.lit(True).alias("close"))
    known = archive.select("label", F.lit(True).alias("known"))
    facts = parts.join(known, "label", "left").join(close, "label", "left")
    names = product_names(spark, sf).withColumn("product", I.parse_product(F.col("name")))
    items = names.join(facts, F.col("l_partkey") == F.col("p_partkey"), "left")
    rules = G.molecule_rules(
        F.col("name"),
        ["rxn:1", "rxn:2", "rxn:3"],
        smiles=F.when(F.col("product").isNotNull(), F.col("p_name")),
        bonds=F.length(F.regexp_replace("p_name", "[^aeiou]", "")),
        archived=F.col("known"),
        min_heavy=2,
        banned=["P"],
        min_bonds=2,
        max_bonds=4,
    )
    kept = G.molecule_gate(items, "uid", "pos", rules, F.col("close").isNull())
    return kept.select("uid", "pos", "name")


_GATE_SQL = (
    X.with_sql(X.SQL_SUBMISSIONS)
    + """, s AS (SELECT uid, items[1:2] AS items FROM submissions),
    c AS (SELECT uid, CASE WHEN len(items) < 2 THEN 'too_few'
      WHEN items[1] = items[2] THEN 'duplicate'
      WHEN len(list_filter(items, lambda x: length(x) NOT BETWEEN 20 AND 400)) > 0 THEN 'length'
      WHEN len(list_filter(items, lambda x: """
    + " OR ".join(f"contains(x, '{a * 4}')" for a in "ACDEFGHIKLMNPQRSTVWY")
    + """)) > 0 THEN 'homopolymer'
      WHEN len(list_filter(items, lambda x: contains(array_to_string(list_transform(range(1, length(x) - 1), lambda i:
        CASE WHEN x[i] = x[i + 2] AND x[i] <> x[i + 1] THEN '1' ELSE '0' END), ''), '11111111'))) > 0 THEN 'pair_repeat'
      WHEN len(list_filter(items, lambda x: NOT contains(x, 'C'))) > 0 THEN 'cysteines'
      WHEN len(list_filter(items, lambda x: len(list_filter(range(1, 20), lambda i: i + 11 <= least(length(x), 30) AND
        length(regexp_replace(substr(x, i, 12), '[^AILMFWV]', '', 'g')) >= 8)) > 0)) > 0 THEN 'signal_peptide'
      END AS first_failed_rule FROM s)
    """
)


@query("p11_nanobody_gate", _GATE_SQL + "SELECT uid, first_failed_rule FROM c")
def p11(spark, sf):
    gated = G.nanobody_gate(
        X.submissions(spark, sf), 2, length=(20, 400), max_run=3, max_pairs=4, min_cys=1
    )
    return gated.select("uid", "first_failed_rule")


@query(
    "p12_nativeness_gate",
    """SELECT l_orderkey AS uid FROM lineitem LEFT JOIN (SELECT p_partkey, p_size / 50.0 AS nat FROM part
      WHERE p_size > 2) ON l_partkey = p_partkey GROUP BY l_orderkey
      HAVING bool_and(coalesce(nat >= 0.45 AND l_linenumber <> 7, false))""",
)
def p12(spark, sf):
    lines = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("uid"),
        F.col("l_partkey").alias("seq_hash"),
        F.when(F.col("l_linenumber") == 7, "V").otherwise("E").alias("pos49"),
        F.lit("R").alias("pos50"),
    )
    results = (
        X.table(spark, sf, "part")
        .filter("p_size > 2")
        .select(
            F.col("p_partkey").alias("seq_hash"),
            (F.col("p_size") / 50.0).alias("nativeness"),
            F.lit(1.0).alias("human_framework"),
        )
    )
    return G.nativeness_gate(lines, results)


@query(
    "p13_developability_gate",
    """SELECT l_orderkey AS uid FROM lineitem GROUP BY l_orderkey
      HAVING bool_and(l_quantity BETWEEN 20 AND 39 AND l_discount <= 0.08)""",
)
def p13(spark, sf):
    lines = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("uid"),
        F.col("l_quantity").alias("total_cdr_length"),
        F.col("l_discount").alias("positive_patches"),
    )
    ranges = {
        "total_cdr_length": G.DEVELOPABILITY_RANGES["total_cdr_length"],
        "positive_patches": (None, 0.08),
    }
    return G.developability_gate(lines, "uid", ranges)


_RULES = [("l_quantity", False, 10.0), ("l_discount", True, 0.06), ("l_tax", True, 0.05)]


@query(
    "p14_threshold_filters",
    """WITH f AS (SELECT l_quantity >= 10 AS a, l_discount <= 0.06 AS b, l_tax <= 0.05 AS c FROM lineitem)
    SELECT a AS pass_l_quantity_filter, b AS pass_l_discount_filter, c AS pass_l_tax_filter,
      CASE WHEN NOT a THEN 0 WHEN NOT b THEN 1 WHEN NOT c THEN 2 ELSE 3 END AS num_filters_passed,
      a AND b AND c AS pass_filters, count(*) AS n FROM f GROUP BY ALL""",
)
def p14(spark, sf):
    lines = X.table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    flagged = G.metric_threshold_filters(lines, _RULES)
    return flagged.groupBy(*flagged.columns[3:]).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p14_filter_pass_counts",
    """SELECT count(*) FILTER (l_quantity >= 10) AS pass_l_quantity_filter_n,
      count(*) FILTER (l_quantity >= 10) AS pass_l_quantity_filter_left,
      count(*) FILTER (l_discount <= 0.06) AS pass_l_discount_filter_n,
      count(*) FILTER (l_quantity >= 10 AND l_discount <= 0.06) AS pass_l_discount_filter_left,
      count(*) FILTER (l_tax <= 0.05) AS pass_l_tax_filter_n,
      count(*) FILTER (l_quantity >= 10 AND l_discount <= 0.06 AND l_tax <= 0.05) AS pass_l_tax_filter_left
    FROM lineitem""",
)
def p14_counts(spark, sf):
    """Rules read from their text form."""
    rules = [G.parse_filter_rule(t) for t in ("l_quantity>10", "l_discount<0.06", "l_tax<0.05")]
    flagged = G.metric_threshold_filters(X.table(spark, sf, "lineitem"), rules)
    return G.filter_pass_counts(flagged, rules)


@query(
    "p16_derive_filter_columns",
    """SELECT l_orderkey, l_linenumber, l_quantity AS bb_rmsd, l_discount AS min_interaction_pae,
      l_quantity AS filter_rmsd, -l_discount AS neg_min_interaction_pae,
      contains(l_returnflag, 'R') AS r_flag, false AS has_x FROM lineitem""",
)
def p16(spark, sf):
    lines = X.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("bb_rmsd"),
        F.col("l_discount").alias("min_interaction_pae"),
        F.col("l_returnflag").alias("designed_sequence"),
        F.col("l_returnflag").contains("R").alias("r_flag"),
    )
    return G.derive_filter_columns(lines, from_inverse_folded=True).drop("designed_sequence")


@query(
    "p18_confidence_filter",
    """SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'O'
      OR coalesce(CASE WHEN l_linenumber <> 3 THEN l_quantity END >= 30, true) OR l_tax <= 0.02
      GROUP BY l_returnflag""",
)
def p18(spark, sf):
    lines = X.table(spark, sf, "lineitem")
    info = F.when(
        F.col("l_linestatus") != "O",
        F.struct(
            F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("iptm"),
            F.col("l_tax").alias("pae"),
        ),
    )
    kept = lines.withColumn("confidence", info).filter(
        G.confidence_filter(F.col("confidence"), [("iptm", ">", 30.0), ("pae", "<", 0.02)], "OR")
    )
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p20_safe_numbers",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 999.99 WHEN event_id % 10 = 1 THEN -999.99
      ELSE value END AS safe, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS parsed,
      NULL::DOUBLE AS unparsed FROM events""",
)
def p20(spark, sf):
    events = X.table(spark, sf, "events").select("event_id", "value", "props", "event_type")
    raw = (
        F.when(F.col("event_id") % 10 == 0, C.INF)
        .when(F.col("event_id") % 10 == 1, -C.INF)
        .otherwise(F.col("value"))
    )
    return events.select(
        "event_id",
        C.safe_num(raw).alias("safe"),
        C.safe_float(F.get_json_object("props", "$.k")).alias("parsed"),
        C.safe_float(F.col("event_type")).alias("unparsed"),
    )


@query(
    "p21_zero_is_missing",
    """SELECT CASE WHEN l_tax = 0 THEN -999.99 ELSE l_tax END AS score, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def p21(spark, sf):
    score = C.safe_num(C.zero_is_missing(F.col("l_tax"), "max")).alias("score")
    return X.table(spark, sf, "lineitem").groupBy(score).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p22_detail_rows",
    """SELECT count(*) AS n FROM lineitem WHERE coalesce(nullif(l_tax, 0), nullif(l_discount, 0)) IS NOT NULL""",
)
def p22(spark, sf):
    zero = F.lit(0.0)
    known = F.coalesce(F.nullif("l_tax", zero), F.nullif("l_discount", zero))
    return X.table(spark, sf, "lineitem").filter(known.isNotNull()).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p23_duplicate_tier",
    """WITH m AS (SELECT l_orderkey, l_linenumber, 0.8 + l_discount * 2 AS identity, 0.75 + l_tax * 2 AS cdr3,
      0.9::DOUBLE AS cdr1, 0.88 + l_discount AS cdr2, l_linenumber % 2 = 0 AS has_cdr FROM lineitem)
    SELECT l_orderkey, l_linenumber, identity >= 0.95 OR (has_cdr AND cdr3 >= 0.85) OR
      (has_cdr AND cdr3 >= 0.8 AND cdr2 >= 0.9) OR (NOT has_cdr AND identity >= 0.9) AS dup FROM m""",
)
def p23(spark, sf):
    lines = X.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        G.duplicate_tier(
            0.8 + F.col("l_discount") * 2,
            F.lit(0.9),
            0.88 + F.col("l_discount"),
            0.75 + F.col("l_tax") * 2,
            F.col("l_linenumber") % 2 == 0,
        ).alias("tier"),
    )
    return lines.select("l_orderkey", "l_linenumber", F.col("tier.dup").alias("dup"))


@query(
    "p25_threshold_flags",
    """SELECT l_discount <= 0.02 AS l_discount_lt_0_02, l_discount <= 0.05 AS l_discount_lt_0_05,
      l_quantity >= 25 AS l_quantity_gt_25_0, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def p25(spark, sf):
    flags = C.threshold_flags({"l_discount": ("<", [0.02, 0.05]), "l_quantity": (">", [25.0])})
    lines = X.table(spark, sf, "lineitem").withColumns(flags)
    return lines.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p26_bin_value",
    """SELECT CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 'low' WHEN l_quantity >= 10 AND l_quantity < 30
      THEN 'mid' ELSE 'other' END AS bin, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def p26(spark, sf):
    label = C.bin_value(F.col("l_quantity"), [(0, 10, "low"), (10, 30, "mid")], "other")
    return X.table(spark, sf, "lineitem").groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p28_drop_missing_entries",
    """SELECT l_partkey AS item, l_suppkey AS target, count(*) AS validators, count(nullif(l_tax, 0)) AS known
      FROM lineitem GROUP BY ALL""",
)
def p28(spark, sf):
    lines = X.table(spark, sf, "lineitem")
    entries = F.create_map(
        F.lit("tax"), F.nullif("l_tax", F.lit(0.0)), F.lit("qty"), F.col("l_quantity")
    )
    cleaned = F.map_filter(entries, lambda k, v: v.isNotNull())
    return (
        lines.select("l_partkey", "l_suppkey", cleaned.alias("m"))
        .groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("target"))
        .agg(
            F.count(F.lit(1)).alias("validators"),
            F.count_if(F.map_contains_key("m", "tax")).alias("known"),
        )
    )


@query(
    "f10_smiles_atoms",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\[[^\]]*\]|Br|Cl|[BCNOPSFI]|[bcnops]') AS t FROM documents),
    a AS (SELECT doc_id, list_filter(list_transform(t, lambda x: CASE WHEN starts_with(x, '[') THEN
      regexp_extract(x, '^\[\d*([A-Z][a-z]?|[a-z]{1,2})', 1) ELSE x END), lambda s: lower(s) NOT IN ('h', '')) AS a FROM t)
    SELECT doc_id, CAST(len(a) AS INT) AS heavy_atoms, len(list_filter(a, lambda s: lower(s) IN ('s', 'se'))) > 0 AS banned FROM a""",
)
def f10(spark, sf):
    text = F.col("text")
    return X.documents(spark, sf).select(
        "doc_id",
        I.heavy_atoms(text).alias("heavy_atoms"),
        I.contains_element(text, ["S", "Se"]).alias("banned"),
    )


@query(
    "f11_combine_affinity",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber = 7 THEN -999.99
      ELSE (l_discount - l_tax) / l_quantity END, 9) AS score, round((l_discount + l_tax) / 2, 9) AS mean_score FROM lineitem""",
)
def f11(spark, sf):
    heavy = F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_quantity"))
    score = C.combine_affinity(F.col("l_discount"), F.col("l_tax"), heavy, "max")
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(C.safe_num(score), 9).alias("score"),
        F.round(C.average_metrics([F.col("l_discount"), F.col("l_tax")], "max"), 9).alias("mean_score"),
    )


@query(
    "f12_record_seed",
    """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents),
    n AS (SELECT doc_id, list_sum(list_transform(range(0, 8), lambda i:
      (CASE WHEN i = 0 THEN xor(('0x' || substr(h, 1, 2))::INT, 68) ELSE ('0x' || substr(h, 2 * i + 1, 2))::INT END)::HUGEINT
      * (256::HUGEINT ** i)::HUGEINT)) AS n FROM h)
    SELECT doc_id, CAST(n % 2147483647 AS BIGINT) AS seed FROM n""",
)
def f12(spark, sf):
    return X.documents(spark, sf).select("doc_id", C.record_seed(F.col("text")).alias("seed"))


@query(
    "f13_hash_mod",
    """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents)
    SELECT doc_id, 'rxn:' || CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 65), lambda i:
      (instr('0123456789abcdef', substr(h, i, 1)) - 1)::BIGINT)), lambda a, d: (a * 16 + d) % 5) + 1 AS VARCHAR) AS reaction FROM h""",
)
def f13(spark, sf):
    hashed = F.concat(F.lit("0x"), F.sha2("text", 256))
    return X.documents(spark, sf).select("doc_id", C.reaction_of_hash(hashed, 5).alias("reaction"))


@query(
    "f14_parse_push_time",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '9999-12-31 00:00:00'
      ELSE date_trunc('second', ts) END AS pushed FROM events""",
)
def f14(spark, sf):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    text = F.when(F.col("event_id") % 4 == 0, "not a time").otherwise(iso)
    return X.table(spark, sf, "events").select("event_id", C.parse_push_time(text).alias("pushed"))


@query(
    "f22_target_id",
    """SELECT event_id, event_type AS target FROM events""",
)
def f22(spark, sf):
    name = F.concat(F.lit("batch3_sample"), F.col("event_id").cast("string"), F.lit("_"), F.col("event_type"), F.lit("_7_gen"))
    return X.table(spark, sf, "events").select("event_id", C.target_of_design(name).alias("target"))


@query(
    "f23_flatten_target_metrics",
    "SELECT l_orderkey, l_linenumber, k AS target, v AS metric FROM lineitem, "
    "LATERAL (SELECT unnest(['a', 'b']) AS k, unnest([l_tax, l_discount]) AS v)",
)
def f23(spark, sf):
    nested = F.create_map(F.lit("a"), F.col("l_tax"), F.lit("b"), F.col("l_discount"))
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.explode(nested).alias("target", "metric")
    )


@query(
    "f25_epoch_arithmetic",
    COMMITS
    + """SELECT commit_id, block // 361 - 1 AS epoch, (block // 361 + 1) * 361 AS boundary,
      (block // 361 + 1) * 361 - 10 AS cutoff FROM commits""",
)
def f25(spark, sf):
    block = F.col("block")
    return X.commits(spark, sf).select(
        "commit_id",
        C.epoch_of(block).alias("epoch"),
        C.next_boundary(block).alias("boundary"),
        C.cutoff_block(block).alias("cutoff"),
    )


@query(
    "f29_ensemble_affinity",
    """SELECT l_orderkey, l_linenumber, round(1.03525938 * (l_discount + l_tax) / 2 - 0.59992683 *
      pow(l_quantity, 0.3) + 2.83288489, 7) AS value, round((l_tax + l_discount) / 2, 7) AS probability FROM lineitem""",
)
def f29(spark, sf):
    value, probability = C.ensemble_affinity(
        F.col("l_discount"), F.col("l_tax"), F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")
    )
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(value, 7).alias("value"),
        F.round(probability, 7).alias("probability"),
    )


@query(
    "f30_confidence_score",
    """SELECT l_orderkey, l_linenumber, round((4 * l_discount + CASE WHEN abs(l_tax) < 1e-8 THEN l_quantity
      ELSE l_tax END) / 5, 8) AS confidence FROM lineitem""",
)
def f30(spark, sf):
    score = C.confidence_score(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"))
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(score, 8).alias("confidence")
    )


@query(
    "f31_bin_expectation",
    """SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: exp(embedding[i]::DOUBLE) * (i - 0.5) / 64))
      / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))), 8) AS expected FROM embeddings""",
)
def f31(spark, sf):
    return X.table(spark, sf, "embeddings").select(
        "vec_id", F.round(C.bin_expectation(F.col("embedding"), 64), 8).alias("expected")
    )


# joins and consensus ---------------------------------------------------------------


@query(
    "j1_assemble_submissions",
    f"""WITH p AS (SELECT doc_id, {_PATH_SQL} AS path, text AS content FROM documents),
    good AS (SELECT path, any_value(length(content)) AS n_chars FROM p
      WHERE ends_with(path, substr(sha256(content), 1, 20) || '.txt') GROUP BY path)
    SELECT event_id, user_id AS uid, path, n_chars,
      CASE WHEN user_id % 2 = 0 THEN '2024-01-01T00:00:00Z' ELSE '' END AS push_time
    FROM events JOIN p ON user_id = doc_id JOIN good USING (path)""",
)
def j1(spark, sf):
    paid = payloads(spark, sf)
    events = X.table(spark, sf, "events").select("event_id", F.col("user_id").alias("uid"))
    commits = events.join(paid.select(F.col("doc_id").alias("uid"), "path"), "uid")
    good = paid.filter(I.hash_matches_path(F.col("content"), F.col("path")))
    parsed = good.groupBy("path").agg(F.any_value(F.length("content")).alias("n_chars"))
    timed = paid.filter("doc_id % 2 = 0").select("doc_id", F.lit("2024-01-01T00:00:00Z").alias("push_time"))
    # push times are known per commit owner here
    times = timed.withColumnRenamed("doc_id", "uid")
    joined = commits.join(parsed, "path").join(times, "uid", "left")
    return joined.select("event_id", "uid", "path", "n_chars", F.coalesce("push_time", F.lit("")).alias("push_time"))


_ARCHIVE_SQL = (
    X.with_sql(X.SQL_SEQUENCES)
    + rf""", archive AS (SELECT DISTINCT upper(regexp_replace(p, '{X.LETTERS}', '', 'g')) AS seq
      FROM (SELECT unnest(regexp_split_to_array(text, '[.\n]')) AS p FROM benchmark))
    """
)


def archive(spark, sf):
    """Known sequences: the pieces of the benchmark passages."""
    texts = X.table(spark, sf, "benchmark").select(F.explode(F.split("text", r"[.\n]")).alias("p"))
    return texts.select(F.upper(F.regexp_replace("p", X.LETTERS, "")).alias("seq")).distinct()


@query(
    "j2_unique_vs_archive",
    _ARCHIVE_SQL + "SELECT doc_id, pos, seq FROM sequences WHERE seq NOT IN (SELECT seq FROM archive)",
)
def j2(spark, sf):
    return J.unique_vs_archive(X.sequences(spark, sf), archive(spark, sf), ["seq"])


@query(
    "j2_reject_known_submissions",
    _ARCHIVE_SQL
    + """SELECT doc_id, count(*) AS n FROM sequences WHERE doc_id NOT IN
      (SELECT doc_id FROM sequences WHERE seq IN (SELECT seq FROM archive)) GROUP BY doc_id""",
)
def j2_reject(spark, sf):
    kept = J.reject_known(X.sequences(spark, sf), archive(spark, sf), ["seq"], "doc_id")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j9_distribute_unique",
    X.with_sql(X.SQL_SEQUENCES)
    + "SELECT doc_id, pos, length(regexp_replace(seq, '[^KR]', '', 'g')) AS score FROM sequences",
)
def j9(spark, sf):
    from sievegrid.functions.sequences import count_of

    score = lambda distinct: distinct.withColumn("score", count_of(F.col("seq"), "KR"))
    return J.distribute_unique(X.sequences(spark, sf), "seq", score).select("doc_id", "pos", "score")


@query(
    "a2_consensus_average",
    """WITH first AS (SELECT l_partkey AS item, l_suppkey AS target, l_linenumber AS validator,
      min_by(l_tax, (l_orderkey, l_extendedprice)) AS tax, min_by(l_quantity, (l_orderkey, l_extendedprice)) AS qty FROM lineitem GROUP BY ALL)
    SELECT item, target, round(avg(tax), 8) AS tax, round(avg(qty), 8) AS qty FROM first GROUP BY ALL""",
)
def a2(spark, sf):
    rows = X.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("item"),
        F.col("l_suppkey").alias("target"),
        F.col("l_linenumber").alias("validator"),
        F.struct("l_orderkey", "l_extendedprice").alias("posted"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("qty"),
    )
    means = J.consensus_average(rows, ["item", "target"], "validator", "posted", ["tax", "qty"])
    return means.select(
        "item", "target", F.round("tax", 8).alias("tax"), F.round("qty", 8).alias("qty")
    )


@query(
    "j10_apply_consensus",
    """WITH avgs AS (SELECT l_partkey AS item, round(avg(l_tax), 8) AS tax FROM lineitem
        WHERE l_returnflag <> 'N' OR l_partkey % 2 = 0 GROUP BY ALL),
    loc AS (SELECT l_returnflag AS entity, l_orderkey, l_linenumber, l_partkey AS item, l_tax AS tax FROM lineitem
        WHERE l_returnflag <> 'N' OR l_partkey % 3 <> 0),
    j AS (SELECT loc.*, avgs.tax AS a, bool_and(avgs.item IS NOT NULL) OVER (PARTITION BY entity) AS ok
      FROM loc LEFT JOIN avgs USING (item))
    SELECT entity, l_orderkey, l_linenumber, item, CASE WHEN ok THEN coalesce(a, tax) ELSE tax END AS tax FROM j""",
)
def j10(spark, sf):
    lines = X.table(spark, sf, "lineitem")
    rows = lines.select(
        F.col("l_returnflag").alias("entity"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("item"),
        F.col("l_tax").alias("tax"),
    )
    averages = (
        rows.filter("entity <> 'N' OR item % 2 = 0")
        .groupBy("item")
        .agg(F.round(F.avg("tax"), 8).alias("tax"))
    )
    local = rows.filter("entity <> 'N' OR item % 3 <> 0")
    return J.apply_consensus(local, averages, ["item"], ["tax"], "entity")


@query(
    "j11_merge_scores",
    """SELECT l_orderkey, l_linenumber, coalesce(s, 999.99) AS score FROM lineitem LEFT JOIN
      (SELECT p_partkey, p_retailprice AS s FROM part WHERE p_size > 10) ON l_partkey = p_partkey""",
)
def j11(spark, sf):
    matrix = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("item"))
    scores = (
        X.table(spark, sf, "part")
        .filter("p_size > 10")
        .select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("score"))
    )
    merged = J.merge_scores(matrix, scores, ["item"], C.INF)
    return merged.select("l_orderkey", "l_linenumber", C.safe_num(F.col("score")).alias("score"))


@query(
    "j12_metrics_with_sequences",
    X.with_sql(X.SQL_CHAINS)
    + """SELECT p_partkey AS id, p_size, length(seq) AS n FROM part JOIN chains ON p_partkey = doc_id""",
)
def j12(spark, sf):
    part = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size")
    chains = X.chains(spark, sf).withColumnRenamed("doc_id", "id")
    return part.join(chains, "id").select("id", "p_size", F.length("seq").alias("n"))


@query(
    "j13_cluster_labels",
    """SELECT p_partkey AS id, p_brand, quality AS cluster_label FROM part LEFT JOIN labels ON p_partkey = doc_id""",
)
def j13(spark, sf):
    part = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    labels = X.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("cluster_label")
    )
    return part.join(labels, "id", "left")


@query(
    "j14_reindex",
    """SELECT p_partkey AS query, coalesce(b, 0.0) AS score FROM part LEFT JOIN (SELECT l_partkey, max(l_tax) AS b
      FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.07 GROUP BY ALL) ON p_partkey = l_partkey""",
)
def j14(spark, sf):
    queries = X.table(spark, sf, "part").select(F.col("p_partkey").alias("query"))
    hits = (
        X.table(spark, sf, "lineitem")
        .filter("l_returnflag = 'R' AND l_tax > 0.07")
        .groupBy(F.col("l_partkey").alias("query"))
        .agg(F.max("l_tax").alias("score"))
    )
    return J.reindex(queries, hits, "query", "score")


@query(
    "j15_skip_existing",
    """SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem
      WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 2)""",
)
def j15(spark, sf):
    inputs = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    outputs = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("kind")
    )
    return J.skip_existing(inputs, outputs, "id", ["A", "R"])


@query(
    "j16_id_list_filter",
    """SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'machinery')""",
)
def j16(spark, sf):
    customers = X.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    listed = customers.select(F.upper("c_mktsegment").alias("c_mktsegment")).filter(
        "c_mktsegment IN ('BUILDING', 'MACHINERY')"
    )
    return J.id_list_filter(customers, listed, "c_mktsegment", reverse=True).select("c_custkey", "c_name")


@query(
    "a3_bit_entropy",
    """WITH b AS (SELECT label, unnest(list_filter(range(1, 65), lambda i: embedding[i] > 0)) AS bit FROM embeddings),
    n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
    p AS (SELECT label, bit, count(*) / any_value(n) AS p FROM b JOIN n USING (label) GROUP BY ALL)
    SELECT label, round(sum(CASE WHEN p > 0 AND p < 1 THEN -p * log2(p) - (1 - p) * log2(1 - p) ELSE 0 END) / 167, 9) AS entropy
    FROM p GROUP BY label""",
)
def a3(spark, sf):
    from sievegrid.operators.aggregates import bit_entropy

    e = X.table(spark, sf, "embeddings")
    bits = F.filter(
        F.transform("embedding", lambda x, i: F.when(x > 0, i + 1)), lambda i: i.isNotNull()
    )
    out = bit_entropy(e.select("label", bits.alias("bits")), ["label"], "bits")
    return out.withColumn("entropy", F.round("entropy", 9))


@query(
    "a4_find_identical",
    """SELECT uid, inchikey, idx FROM (SELECT o_custkey AS uid, floor(o_totalprice / 10000) AS inchikey,
        o_orderkey AS idx, count(*) OVER (PARTITION BY o_custkey, floor(o_totalprice / 10000)) AS n FROM orders)
      WHERE n > 1""",
)
def a4(spark, sf):
    from sievegrid.operators.aggregates import find_identical

    orders = X.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("uid"),
        F.floor(F.col("o_totalprice") / 10000).cast("double").alias("inchikey"),
        F.col("o_orderkey").alias("idx"),
    )
    return find_identical(orders, "uid", "inchikey", "idx")
