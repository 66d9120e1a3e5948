"""Queries over similarity joins, clusters, selection, crops and alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegrid.functions import alignment as N
from sievegrid.functions import sequences as S
from sievegrid.operators import msa as M
from sievegrid.operators import selection as T
from sievegrid.operators import setops
from sievegrid.operators import similarity as Y
from sievegrid.plans import fixtures as X
from sievegrid.plans.queries_evaluation import _MSA_SQL, msa
from sievegrid.plans.queries_sampling import sql_u
from sievegrid.plans.registry import query

# fingerprints: positions of the larger embedding entries
_BITS_SQL = """fp AS (SELECT vec_id, label, list_filter(range(1, 65), lambda i: embedding[i] > 0.02::FLOAT) AS bits FROM embeddings)"""


def fingerprints(spark, sf):
    limit = F.lit(0.02).cast("float")
    bits = F.filter(
        F.transform("embedding", lambda x, i: F.when(x > limit, i + 1)), lambda i: i.isNotNull()
    )
    return X.table(spark, sf, "embeddings").select("vec_id", "label", bits.alias("bits"))


@query(
    "j7_tanimoto_join",
    f"""WITH {_BITS_SQL}, c AS (SELECT * FROM fp WHERE vec_id % 2 = 0), a AS (SELECT * FROM fp WHERE vec_id % 2 = 1),
    near AS (SELECT DISTINCT c.vec_id FROM c JOIN a ON c.label = a.label AND
      len(list_intersect(c.bits, a.bits)) * 1.4 >= 0.4 * (len(c.bits) + len(a.bits)) - 1e-9 AND len(c.bits) > 0 AND len(a.bits) > 0)
    SELECT vec_id FROM c WHERE vec_id NOT IN (SELECT vec_id FROM near)""",
)
def j7(spark, sf):
    fps = fingerprints(spark, sf)
    new, old = fps.filter("vec_id % 2 = 0"), fps.filter("vec_id % 2 = 1")
    return Y.diverse_candidates(new, old, "vec_id", "bits", 0.4, ("label",)).select("vec_id")


_KMER_SQL = """km AS (SELECT doc_id, pos, seq, list_distinct(list_transform(range(1, length(seq) - 3), lambda i: substr(seq, i, 5))) AS ks
      FROM sequences WHERE length(seq) >= 5),
    ix AS (SELECT item_id, upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) AS seq FROM benchmark),
    ik AS (SELECT item_id, list_distinct(list_transform(range(1, length(seq) - 3), lambda i: substr(seq, i, 5))) AS ks FROM ix)"""


def top_sequences(spark, sf):
    """The reference index: the passages of the benchmark, a fixed small set."""
    seq = F.upper(F.regexp_replace("text", X.LETTERS, ""))
    return X.table(spark, sf, "benchmark").select(
        F.lit("t").alias("target"), F.col("item_id").alias("ref"), seq.alias("ref_seq")
    )


@query(
    "j8_kmer_search",
    X.with_sql(X.SQL_SEQUENCES, _KMER_SQL)
    + """, q AS (SELECT doc_id, pos, ks, unnest(ks) AS k FROM km), r AS (SELECT item_id, len(ks) AS n, unnest(ks) AS k FROM ik),
    p AS (SELECT doc_id, pos, item_id AS ref, len(any_value(ks)) AS nq, any_value(r.n) AS nr, count(*) AS shared FROM q JOIN r USING (k) GROUP BY ALL)
    SELECT doc_id, pos, ref, shared, round(shared / (nq + nr - shared), 9) AS jaccard FROM p WHERE shared >= 5 AND shared / (nq + nr - shared) >= 0.05""",
)
def j8(spark, sf):
    found = Y.kmer_search(X.sequences(spark, sf), top_sequences(spark, sf), 5, 5, 0.05)
    return found.select("doc_id", "pos", "ref", "shared", F.round("jaccard", 9).alias("jaccard"))


@query("f15_search_identity")
def f15(spark, sf):
    """Alignment identity, region identities and duplicate tier of the coarse matches."""
    pieces, refs = X.sequences(spark, sf), top_sequences(spark, sf)
    found = Y.kmer_search(pieces, refs, 5, 5, 0.05)
    key = F.struct("doc_id", "pos").alias("key")
    part = lambda seq, at, n: F.when(F.length(seq) >= at + n - 1, F.substring(seq, at, n))
    regions = lambda seq: [part(seq, *w).alias(c) for c, w in (("cdr1", (5, 8)), ("cdr2", (20, 7)), ("cdr3", (40, 12)))]
    detail = Y.match_details(
        found.select(key, "target", "ref", "identity"),
        pieces.select(key, *regions("seq")),
        refs.select("target", "ref", *regions("ref_seq")),
        "key",
    )
    share = F.round("cdr_similarity", 9).alias("cdr_similarity")
    return detail.select("key.doc_id", "key.pos", "ref", F.round("identity", 9).alias("identity"), share, "dup", "reason")


@query(
    "c5_near_duplicates",
    X.with_sql(X.SQL_SEQUENCES, _KMER_SQL)
    + """, lines AS (SELECT DISTINCT upper(regexp_replace(p, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) AS seq FROM
        (SELECT unnest(regexp_split_to_array(text, '[.\\n]')) AS p FROM benchmark)),
    lk AS (SELECT list_distinct(list_transform(range(1, length(seq) - 3), lambda i: substr(seq, i, 5))) AS ks FROM lines WHERE length(seq) >= 5),
    li AS (SELECT row_number() OVER () AS rid, ks FROM lk), lx AS (SELECT rid, len(ks) AS n, unnest(ks) AS k FROM li),
    q AS (SELECT doc_id, pos, len(ks) AS n, unnest(ks) AS k FROM km),
    p AS (SELECT doc_id, pos, rid, any_value(q.n) AS a, any_value(lx.n) AS b, count(*) AS s FROM q JOIN lx USING (k) GROUP BY ALL)
    SELECT DISTINCT doc_id, pos FROM p WHERE s * 1.9 >= 0.9 * (a + b) - 1e-9""",
)
def c5(spark, sf):
    from sievegrid.plans.queries_intake import archive

    found = Y.near_archive(X.sequences(spark, sf), archive(spark, sf), "seq", 0.9, of=lambda seq: S.kmers(seq, 5))
    return found.select("doc_id", "pos")


@query(
    "c5_batch_identity",
    X.with_sql(X.SQL_SEQUENCES).replace("WITH", "WITH RECURSIVE", 1)
    + """, s AS (SELECT seq, min(doc_id * 10000000 + pos) AS id, length(seq) AS n,
        """
    + ", ".join(f"length(seq) - length(replace(seq, '{x}', '')) AS n{x}" for x in "AEINRSTDHLCM")
    + """ FROM sequences GROUP BY seq),
    longer AS (SELECT *, unnest(range(n, n + n // 49 + 1)) AS other_n FROM s),
    l AS (SELECT a.id AS a, b.id AS b FROM longer a JOIN s b ON b.n = a.other_n AND b.n >= 50 AND a.id <> b.id AND b.n - a.n <= b.n // 50
      AND """
    + " AND ".join(f"abs(a.n{x} - b.n{x}) <= b.n // 50" for x in "AEINRSTDHLCM")
    + """ WHERE levenshtein(a.seq, b.seq) <= b.n // 50),
    ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    reach AS (SELECT a, b FROM ways UNION SELECT r.a, ways.b FROM reach r JOIN ways ON ways.a = r.b),
    least AS (SELECT id, least(id, coalesce(min(b), id)) AS cluster FROM s LEFT JOIN reach ON a = id GROUP BY id)
    SELECT doc_id, pos, cluster, doc_id * 10000000 + pos = cluster AS kept FROM sequences JOIN s USING (seq) JOIN least USING (id)""",
)
def c5_batch(spark, sf):
    """Near-identical pieces of the whole batch: the class of each, and the one that stays."""
    from sievegrid.operators.identity import near_identical

    keyed = X.sequences(spark, sf).withColumn("key", F.col("doc_id") * 10000000 + F.col("pos"))
    return near_identical(keyed, "key", "seq").select("doc_id", "pos", "cluster", "kept")


@query(
    "c5_mutation_minima",
    X.with_sql(X.SQL_CHAINS)
    + """, p AS (SELECT a.doc_id, substr(a.seq, 27, 12) AS a1, substr(b.seq, 27, 12) AS b1, substr(a.seq, 56, 10) AS a2,
        substr(b.seq, 56, 10) AS b2, substr(a.seq, 105, 13) AS a3, substr(b.seq, 105, 13) AS b3
      FROM chains a JOIN chains b ON b.doc_id = a.doc_id + 1),
    n AS (SELECT doc_id, """
    + ", ".join(
        f"len(list_filter(range(1, greatest(length(a{i}), length(b{i})) + 1), lambda i: substr(a{i}, i, 1) <> substr(b{i}, i, 1))) AS m{i}"
        for i in (1, 2, 3)
    )
    + " FROM p) SELECT doc_id, m1 + m2 + m3 >= 2 AND m3 >= 1 AS distinct_enough FROM n",
)
def c5_mutations(spark, sf):
    cut = lambda p: [F.substring("seq", *w).alias(f"{p}{c}") for c, w in (("cdr1", (27, 12)), ("cdr2", (56, 10)), ("cdr3", (105, 13)))]
    chains = X.chains(spark, sf)
    a = chains.select("doc_id", *cut(""))
    b = chains.select((F.col("doc_id") - 1).alias("doc_id"), *cut("b_"))
    return Y.mutation_minima(a.join(b, "doc_id")).select("doc_id", "distinct_enough")


@query("c1_sequence_clusters")
def c1(spark, sf):
    clusters = Y.sequence_clusters(X.sequences(spark, sf))
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


@query("c6_template_match")
def c6(spark, sf):
    """The pieces of an even document are chains, those of the next one the chains of its template."""
    from sievegrid.operators.templates import template_match

    pair = {(a, b): 4.0 if a == b else -1.0 for a in S.AMINO_ACIDS for b in S.AMINO_ACIDS}
    rows = X.sequences(spark, sf).select(F.floor(F.col("doc_id") / 2).alias("structure_id"), "doc_id", "pos", "seq")
    chains = rows.filter("doc_id % 2 = 0").select("structure_id", F.col("pos").alias("chain_id"), "seq")
    templates = rows.filter("doc_id % 2 = 1").select(
        "structure_id", F.col("doc_id").alias("template_id"), F.col("pos").alias("template_chain"), "seq"
    )
    found = template_match(chains, templates, pair, k=5, min_seeds=3)
    best = found.withColumn("span", F.get("spans", F.lit(0)))
    return best.select("structure_id", "template_id", "chain_id", "template_chain", "score", "span.*", F.size("spans").alias("n_spans"))


@query("f16_score_to_reference")
def f16(spark, sf):
    """Alignment of the reference passages to the first of them under match 4, mismatch -1."""
    first = top_sequences(spark, sf).orderBy("ref").first()["ref_seq"]
    letters = S.AMINO_ACIDS
    pair = {(a, b): 4.0 if a == b else -1.0 for a in letters for b in letters}
    score = N.score_to_reference(first, pair)
    return X.sequences(spark, sf).select("doc_id", "pos", score("seq").alias("score"))


@query("t5_diverse_selection")
def t5(spark, sf):
    quality = F.round(F.length("seq") / 400 - F.pmod(F.xxhash64("seq"), F.lit(997)) / 997, 6)
    distinct = X.sequences(spark, sf).select("seq").distinct()
    designs = distinct.select(F.sha2("seq", 256).alias("id"), "seq", quality.alias("quality"))
    return T.diverse_select(designs, "id", "seq", "quality", 30, 0.5, [(0, 40, 10), (40, 80, 10)])


# token tables for crops: an atom is a token, three to a residue
_TOK_SQL = """tok AS (SELECT structure_id, atom_idx AS token_idx, chain_id, res_idx, 1 + atom_idx % 3 AS atom_num, element = 'C' AS resolved,
      chain_id = 4 AS is_ligand, x, y, z FROM atoms)"""


def tokens(spark, sf):
    idx = F.col("atom_idx")
    return X.atoms(spark, sf).select(
        "structure_id",
        idx.alias("token_idx"),
        "chain_id",
        "res_idx",
        (1 + idx % 3).alias("atom_num"),
        (F.col("element") == "C").alias("resolved"),
        (F.col("chain_id") == 4).alias("is_ligand"),
        "x",
        "y",
        "z",
    )


_NEAR_SQL = """sz AS (SELECT structure_id, chain_id, count(*) AS n FROM tok GROUP BY ALL),
    pr AS (SELECT a.structure_id, a.token_idx, b.token_idx AS member, abs(a.res_idx - b.res_idx) AS away, n FROM tok a
      JOIN tok b ON a.structure_id = b.structure_id AND a.chain_id = b.chain_id
      JOIN sz ON a.structure_id = sz.structure_id AND a.chain_id = sz.chain_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY structure_id, token_idx ORDER BY away, member) AS k FROM pr),
    wd AS (SELECT structure_id, token_idx, max(away) AS w FROM rk WHERE k <= 6 GROUP BY ALL),
    nb AS (SELECT pr.structure_id, pr.token_idx, member FROM pr JOIN wd USING (structure_id, token_idx) WHERE n <= 6 OR away <= w)"""


def _crop_sql(limit: str) -> str:
    return f"""rank AS (SELECT structure_id, token_idx, row_number() OVER (PARTITION BY structure_id ORDER BY distance, token_idx) AS r
      FROM dist WHERE resolved),
    ent AS (SELECT nb.structure_id, member AS token_idx, min(r) AS r FROM nb JOIN rank USING (structure_id, token_idx) GROUP BY ALL),
    pk AS (SELECT structure_id, r, count(*) AS t, sum(atom_num) AS a, count(*) FILTER (NOT is_ligand) AS p
      FROM ent JOIN tok USING (structure_id, token_idx) GROUP BY ALL),
    cu AS (SELECT structure_id, r, sum(t) OVER w AS t, sum(a) OVER w AS a, sum(p) OVER w AS p FROM pk
      WINDOW w AS (PARTITION BY structure_id ORDER BY r)),
    st AS (SELECT structure_id, min(r) AS s FROM cu WHERE {limit} GROUP BY ALL)
    SELECT structure_id, token_idx FROM ent LEFT JOIN st USING (structure_id) WHERE s IS NULL OR r < s"""


_PICK_SQL = f"""pk0 AS (SELECT structure_id, min_by(token_idx, (CASE WHEN chain_id = 1 THEN 0 ELSE 1 END, {sql_u('1', 'structure_id', 'token_idx')}, token_idx)) AS token_idx
      FROM tok WHERE resolved GROUP BY ALL)"""


def picked(spark, sf):
    live = tokens(spark, sf).filter("resolved")
    wanted = live.select("structure_id").distinct().select("structure_id", F.lit(1).cast("bigint").alias("chain_id"))
    return T.pick_token(live, wanted, 1)


@query("t8_pick_chain_token", X.with_sql(X.SQL_ATOMS, _TOK_SQL, _PICK_SQL) + "SELECT structure_id, token_idx FROM pk0")
def t8(spark, sf):
    return picked(spark, sf)


@query(
    "t8_pick_interface_token",
    X.with_sql(X.SQL_ATOMS, _TOK_SQL)
    + f""", m AS (SELECT a.structure_id, a.token_idx, any_value(a.chain_id) AS c, min(CASE WHEN a.chain_id IN (0, 2) AND b.chain_id IN (0, 2)
        AND a.chain_id <> b.chain_id THEN (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) END) AS d2
      FROM tok a JOIN tok b ON a.structure_id = b.structure_id WHERE a.resolved AND b.resolved GROUP BY ALL)
    SELECT structure_id, min_by(token_idx, (CASE WHEN d2 < 9 THEN 0 WHEN d2 < 64 THEN 1 WHEN c IN (0, 2) THEN 2 ELSE 3 END,
      {sql_u('2', 'structure_id', 'token_idx')}, token_idx)) AS token_idx FROM m GROUP BY structure_id""",
)
def t8_interface(spark, sf):
    live = tokens(spark, sf).filter("resolved")
    pair = live.select("structure_id").distinct().select(
        "structure_id", F.lit(0).cast("bigint").alias("chain_1"), F.lit(2).cast("bigint").alias("chain_2")
    )
    return T.pick_interface_token(live, pair, 2, 3.0, 5.0)


@query(
    "t6_spatial_crop",
    X.with_sql(X.SQL_ATOMS, _TOK_SQL, _PICK_SQL, _NEAR_SQL)
    + """, dist AS (SELECT t.structure_id, t.token_idx, t.resolved, sqrt((t.x-q.x)*(t.x-q.x) + (t.y-q.y)*(t.y-q.y) + (t.z-q.z)*(t.z-q.z)) AS distance
      FROM tok t JOIN pk0 ON t.structure_id = pk0.structure_id JOIN tok q ON q.structure_id = pk0.structure_id AND q.token_idx = pk0.token_idx), """
    + _crop_sql("t > 25 OR a > 45"),
)
def t6(spark, sf):
    every = tokens(spark, sf)
    placed = T.distance_to_token(every, picked(spark, sf))
    return T.crop(placed, "distance", 6, 25, 45).select("structure_id", "token_idx")


@query(
    "t7_ligand_crop",
    X.with_sql(X.SQL_ATOMS, _TOK_SQL, _NEAR_SQL)
    + """, dist AS (SELECT t.structure_id, t.token_idx, any_value(t.resolved) AS resolved, sqrt(min((t.x-q.x)*(t.x-q.x) + (t.y-q.y)*(t.y-q.y) + (t.z-q.z)*(t.z-q.z))) AS distance
      FROM tok t JOIN tok q ON t.structure_id = q.structure_id AND q.is_ligand GROUP BY ALL), """
    + _crop_sql("t > 30 OR p > 18"),
)
def t7(spark, sf):
    placed = T.distance_to_ligand(tokens(spark, sf))
    return T.crop(placed, "distance", 6, 30, None, 18).select("structure_id", "token_idx")


# alignments -------------------------------------------------------------------------


@query(
    "a17_msa_profile",
    X.with_sql(X.SQL_SEQUENCES)
    + """, m AS (SELECT doc_id, pos, lower(substr(seq, 1, pos % 3)) || substr(seq, pos % 3 + 1) AS line FROM sequences WHERE length(seq) > 3),
    f AS (SELECT doc_id, min(pos) AS pos, upper(line) AS u, min_by(line, pos) AS line FROM m GROUP BY doc_id, upper(line)),
    r AS (SELECT doc_id, regexp_replace(line, '[a-z]', '', 'g') AS s, length(line) - length(regexp_replace(line, '[a-z]', '', 'g')) AS d FROM f),
    n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
    l AS (SELECT doc_id, unnest(range(length(s))) AS res_idx, unnest(string_split(s, '')) AS c, d FROM r)
    SELECT doc_id AS msa_id, res_idx, round(count(*) FILTER (c = 'A') / any_value(n), 8) AS "p_A", round(count(*) FILTER (c = 'L') / any_value(n), 8) AS "p_L",
      round(count(*) FILTER (res_idx = 0 AND d > 0) / any_value(n), 8) AS has_deletion,
      round(coalesce(sum(pi() / 2 * atan(d / 3.0)) FILTER (res_idx = 0 AND d > 0), 0) / any_value(n), 8) AS deletion_mean
    FROM l JOIN n USING (doc_id) GROUP BY doc_id, res_idx""",
)
def a17(spark, sf):
    """Alignments made of the pieces of a document, their first letters as insertions."""
    start = F.col("pos") % 3
    line = F.concat(F.lower(F.substring(F.col("seq"), F.lit(1), start)), F.substring(F.col("seq"), start + 1, F.length("seq")))
    rows = X.sequences(spark, sf).filter("length(seq) > 3").select(
        F.col("doc_id").alias("msa_id"), F.col("pos").alias("order"), F.lit(None).cast("bigint").alias("taxonomy"), line.alias("line")
    )
    profile = M.msa_profile(M.build_msa(rows), "AL")
    rounded = ("p_A", "p_L", "has_deletion", "deletion_mean")
    # rounding goes by way of decimals: most shares are zero and need none
    return profile.select("msa_id", "res_idx", *[F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.round(c, 8)).alias(c) for c in rounded])


_PAIR_SQL = """ms AS (SELECT l_suppkey AS complex_id, l_linenumber % 3 AS chain_id, row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 3
      ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_partkey) - 1 AS seq_idx, CASE WHEN l_partkey % 3 = 0 THEN -1 ELSE l_partkey % 40 END AS taxonomy FROM lineitem)"""


def chain_alignments(spark, sf):
    from sievegrid.operators.ordering import RangeOrdered

    lines = X.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("complex_id"),
        (F.col("l_linenumber") % 3).alias("chain_id"),
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        "l_partkey",
    )
    order = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"]
    placed = RangeOrdered(lines, ["complex_id", "chain_id"], order).row_number("seq_idx")
    taxonomy = F.when(F.col("l_partkey") % 3 == 0, -1).otherwise(F.col("l_partkey") % 40)
    return placed.select("complex_id", "chain_id", (F.col("seq_idx") - 1).alias("seq_idx"), taxonomy.alias("taxonomy"))


@query(
    "w6_msa_pairing",
    "WITH "
    + _PAIR_SQL
    + """, pc AS (SELECT complex_id, taxonomy, chain_id, count(*) AS n, min(seq_idx) AS f FROM ms WHERE taxonomy <> -1 GROUP BY ALL),
    gr AS (SELECT complex_id, taxonomy, count(*) AS chains, max(n) AS rows_, min(chain_id) AS c0, min_by(f, chain_id) AS f0 FROM pc
      GROUP BY ALL HAVING sum(n) > 1),
    pl AS (SELECT *, CAST(sum(rows_) OVER (PARTITION BY complex_id ORDER BY chains DESC, c0, f0) AS BIGINT) - rows_ + 1 AS start FROM gr),
    rw AS (SELECT complex_id, taxonomy, i, start + i AS row FROM (SELECT *, unnest(range(rows_)) AS i FROM pl) WHERE start + i < 200),
    ch AS (SELECT complex_id, chain_id, count(*) - 1 AS spare FROM ms GROUP BY ALL),
    gd AS (SELECT rw.*, ch.chain_id, spare, n FROM rw JOIN ch USING (complex_id) LEFT JOIN pc USING (complex_id, taxonomy, chain_id)),
    ls AS (SELECT *, row_number() OVER (PARTITION BY complex_id, taxonomy, chain_id ORDER BY seq_idx) AS k FROM ms WHERE taxonomy <> -1),
    hit AS (SELECT gd.complex_id, row, gd.chain_id, seq_idx, 1 AS is_paired FROM gd JOIN ls ON gd.complex_id = ls.complex_id
      AND gd.taxonomy = ls.taxonomy AND gd.chain_id = ls.chain_id AND gd.i % gd.n + 1 = ls.k WHERE n IS NOT NULL),
    ab AS (SELECT *, row_number() OVER (PARTITION BY complex_id, chain_id ORDER BY row) AS k FROM gd WHERE n IS NULL),
    us AS (SELECT complex_id, chain_id, spare, (SELECT count(*) FROM ab WHERE ab.complex_id = ch.complex_id AND ab.chain_id = ch.chain_id) AS used FROM ch),
    tl AS (SELECT us.complex_id, chain_id, spare, used, l, unnest(range(1, CAST(least(m, 400 - l) + 1 AS BIGINT))) AS i FROM us
      JOIN (SELECT complex_id, max(greatest(spare - used, 0)) AS m FROM us GROUP BY ALL) USING (complex_id)
      JOIN (SELECT complex_id, max(row) + 1 AS l FROM rw GROUP BY ALL) USING (complex_id))
    SELECT complex_id, 0 AS row, chain_id, 0 AS seq_idx, 1 AS is_paired FROM ch UNION ALL SELECT * FROM hit UNION ALL
    SELECT complex_id, row, chain_id, CASE WHEN k <= spare THEN k ELSE -1 END, 0 FROM ab UNION ALL
    SELECT complex_id, l + i - 1, chain_id, CASE WHEN used + i <= spare THEN used + i ELSE -1 END, 0 FROM tl""",
)
def w6(spark, sf):
    return M.msa_pairing(chain_alignments(spark, sf), max_pairs=200, max_total=400)


@query(
    "j23_pairing_taxonomies",
    "WITH " + _PAIR_SQL + "SELECT complex_id, taxonomy, count(*) AS n FROM ms WHERE taxonomy <> -1 GROUP BY ALL HAVING count(*) > 1",
)
def j23(spark, sf):
    tagged = chain_alignments(spark, sf).filter("taxonomy <> -1")
    return tagged.groupBy("complex_id", "taxonomy").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(
    "u5_combine_msas",
    f"""WITH {_MSA_SQL}, p AS (SELECT msa_id, row_number() OVER (PARTITION BY msa_id ORDER BY seq_idx) - 1 AS idx,
        CASE WHEN seq_idx % 11 = 0 THEN repeat('-', 64) ELSE row END AS sequence FROM msa WHERE seq_idx % 2 = 0 AND msa_id % 3 <> 0),
    u AS (SELECT msa_id, row_number() OVER (PARTITION BY msa_id ORDER BY seq_idx) - 1 AS idx, row AS sequence FROM msa WHERE seq_idx % 2 = 1),
    k AS (SELECT * FROM p WHERE idx < 12 AND replace(sequence, '-', '') <> ''), n AS (SELECT msa_id, count(*) AS n FROM k GROUP BY msa_id)
    SELECT msa_id, idx, idx AS key, sequence FROM k UNION ALL
    SELECT msa_id, idx + coalesce(n, 0), -1, sequence FROM u LEFT JOIN n USING (msa_id)
      WHERE idx < 30 - coalesce(n, 0) AND (coalesce(n, 0) = 0 OR idx > 0)""",
)
def u5(spark, sf):
    from sievegrid.operators.structures import renumber

    rows = msa(spark, sf)
    gaps = F.when(F.col("seq_idx") % 11 == 0, F.lit("-" * 64)).otherwise(F.col("row"))
    number = lambda df: renumber(df, "msa_id", "seq_idx", "idx")
    paired = number(rows.filter("seq_idx % 2 = 0 AND msa_id % 3 <> 0").select("msa_id", "seq_idx", gaps.alias("sequence")))
    unpaired = number(rows.filter("seq_idx % 2 = 1").select("msa_id", "seq_idx", F.col("row").alias("sequence")))
    return setops.combine_msas(paired.drop("seq_idx"), unpaired.drop("seq_idx"), 30, 12)
