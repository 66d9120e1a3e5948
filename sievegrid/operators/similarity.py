"""Similarity joins over sets: fingerprints, k-mers, clusters.

Prefix filtering: two sets with Jaccard >= t must share one of their first
n - ceil(t n) + 1 tokens in any common order. Ordering tokens from rare to
frequent keeps hot tokens out of the prefixes. Token frequencies are kept per
hash bucket, a fixed number, so what is broadcast never grows with the data.
Copies are compared once: both sides are reduced to distinct sets first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.alignment import identity
from sievegrid.functions.sequences import bind, kmers
from sievegrid.operators.components import greedy_cover
from sievegrid.session import durable, rebalance, release, unnest

BUCKETS = 1024
FEW = 512  # archived sets of a group that a candidate meets first, if it would meet many
SHARED = 2  # prefix tokens that a candidate pair must share
PART, PARTS = 1 << 17, 16  # sequences that meet the centres of clusters at a time, and parts at most
REFERENCES, SEQUENCES = 512, 1 << 15  # index rows and sequences (about) that a task of the k-mer search holds


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens of two distinct-token arrays; 0 for two empty ones."""
    return bind(
        F.size(F.array_intersect(a, b)),
        lambda both: F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0)),
    )


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _frequencies(sets: DataFrame) -> Column:
    """Token counts per hash bucket as a constant array: BUCKETS numbers, whatever the input."""
    counts = unnest(sets, F.col("tokens"), "t").groupBy(_bucket(F.col("t")).alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    known = {r["b"]: r["n"] for r in counts.collect()}  # at most BUCKETS rows
    return F.lit([known.get(b, 0) for b in range(BUCKETS)])


def _prefix(n: Column, share: float) -> Column:
    return F.least(n, n - F.ceil(n * share - 1e-9) + SHARED).cast("int")


def _placed(sets: DataFrame, freq: Column, threshold: float, *keep: str) -> DataFrame:
    """(keep..., id, n, token, at, short): prefix tokens from rare to frequent.

    ``at`` is the token's place, ``n`` the size of the set. A set of similarity
    ``threshold`` to another shares ``SHARED`` tokens of its first
    n - ceil(t n) + SHARED (or all it needs, if those are fewer); if the other is
    at least as large, of its first n - ceil(2 t n / (1 + t)) + SHARED, which
    ``short`` marks.
    """
    order = F.array_sort(
        F.transform("tokens", lambda t: F.struct(F.get(freq, _bucket(t)).alias("f"), t.alias("t")))
    )
    n = F.size("tokens")
    length = lambda share: _prefix(n, share)
    head = F.transform(
        F.slice(order, F.lit(1), length(threshold)),
        lambda x, i: F.struct(x["t"].alias("token"), (i + 1).alias("at"), (i < length(2 * threshold / (1 + threshold))).alias("short")),
    )
    rows = unnest(sets, head, "_p", *keep, "id", n.alias("n"))
    return rows.select(*keep, "id", "n", "_p.token", "_p.at", "_p.short")


def candidate_pairs(
    left: DataFrame, right: DataFrame, threshold: float, by: tuple[str, ...] = (), freq: Column | None = None
) -> DataFrame:
    """(id, b_id) of sets that may be similar, from (by..., id, tokens) of distinct sets.

    The smaller set of a pair is looked up by its short prefix, the larger by
    its long one; sizes must fit, and what is left behind the shared tokens must
    be enough for the overlap that is needed (Xiao and others 2008). Tokens
    travel alone, with the 16-byte key of their set.
    """
    freq = _frequencies(right) if freq is None else freq
    a = _placed(left, freq, threshold, *by)
    b = _placed(right, freq, threshold, *by)
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    test = F.col("token") == F.col("b_token")
    for g in by:
        test = test & (F.col(g) == F.col(f"b_{g}"))
    fits = (F.col("b_n") >= F.col("n") * threshold - 1e-9) & (F.col("b_n") * threshold <= F.col("n") + 1e-9)
    needed = (F.col("n") + F.col("b_n")) * (threshold / (1 + threshold)) - 1e-9
    room = SHARED + F.least(F.col("n") - F.col("at"), F.col("b_n") - F.col("b_at")) >= needed
    sides = F.when(F.col("n") <= F.col("b_n"), F.col("short")).otherwise(F.col("b_short"))
    met = a.join(b, test & fits & room & sides).select(*by, "id", "b_id", F.least(F.ceil(needed), F.lit(SHARED)).alias("_least"))
    counted = met.groupBy(*by, "id", "b_id").agg(F.count(F.lit(1)).alias("_n"), F.first("_least").alias("_least"))
    return counted.filter("_n >= _least").drop("_n", "_least")


def near_archive(
    candidates: DataFrame,
    archive: DataFrame,
    tokens: str,
    threshold: float,
    by: tuple[str, ...] = (),
    of: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Candidates with a Jaccard (Tanimoto) similarity >= threshold to any archived set of
    the same group. Copies are one set; sets meet again only as candidate pairs.

    ``of`` makes the sets from the column ``tokens``, a text for example. Then only the texts travel, and
    the sets, many times larger, are made where they are needed.
    """
    group, keys = list(by), [*by, "id"]
    make = of or (lambda c: c)
    source = F.array_sort(tokens) if of is None else F.col(tokens)

    def distinct(df: DataFrame) -> DataFrame:
        kinds = df.select(*group, source.alias("_of")).distinct()
        kinds = kinds if of else rebalance(kinds)
        return kinds.withColumn("id", F.unhex(F.md5(F.to_json(F.struct("_of")))))

    def sets(df: DataFrame) -> DataFrame:
        return df.withColumn("tokens", make(F.col("_of"))).filter(F.size("tokens") > 0)

    def similar(a: Column, b: Column) -> Column:  # J >= t without a division
        return F.size(F.array_intersect(a, b)) * (1 + threshold) >= threshold * (F.size(a) + F.size(b)) - 1e-9

    right = distinct(archive)
    known, freq = sets(right), _frequencies(sets(right))
    first = Window.partitionBy(*(group or [F.lit(1)])).orderBy("id")
    few = known.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= FEW)
    few = few.groupBy(*group).agg(F.collect_list("tokens").alias("_few"))
    left = sets(distinct(candidates))
    left = left.join(few, group, "left") if group else left.crossJoin(few)
    met = F.sort_array(F.transform("tokens", lambda t: F.get(freq, _bucket(t))))
    met = F.slice(met, F.lit(1), _prefix(F.size("tokens"), threshold))
    many = F.aggregate(met, F.lit(0).cast("bigint"), lambda n, f: n + f) > 16 * FEW
    # of those that would meet many: most are near to one of a few already, and look no further
    soon = F.coalesce(many & F.exists("_few", lambda few_: similar(F.col("tokens"), few_)), F.lit(False))
    left = durable(left.select(*keys, "_of", soon.alias("_soon")))
    late = left.filter(~F.col("_soon"))
    pairs = candidate_pairs(sets(late).drop("_of", "_soon"), known.drop("_of"), threshold, by, freq)
    other = right.select(*group, F.col("id").alias("b_id"), F.col("_of").alias("_b_of"))
    full = pairs.join(late, keys).join(other, [*group, "b_id"])
    both = F.struct(make(F.col("_of")).alias("a"), make(F.col("_b_of")).alias("b"))
    found = full.filter(bind(both, lambda x: similar(x["a"], x["b"]))).select(*group, "_of")
    hits = found.unionByName(left.filter("_soon").select(*group, "_of")).distinct()
    return candidates.withColumn("_of", source).join(hits, [*group, "_of"], "left_semi").drop("_of")


def diverse_candidates(
    candidates: DataFrame, archive: DataFrame, key: str, tokens: str, threshold: float = 0.6, by: tuple[str, ...] = ()
) -> DataFrame:
    """Candidates without a similar archived set in any of their groups."""
    close = near_archive(candidates, archive, tokens, threshold, by).select(key).distinct()
    return candidates.join(close, key, "left_anti")


def _counted(k: int, min_shared: int, min_jaccard: float):
    """Function of sequences (_id, seq) and a block of references: the pairs that may pass, with their shared k-mers.

    Repeated rows of one (target, ref) and size add up, as they would in a join.
    """

    def words(text: str) -> set[str]:
        return {text[i : i + k] for i in range(len(text) - k + 1)}

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        places: dict[str, list[int]] = {}
        columns: dict[tuple, int] = {}
        first: list[int] = []
        for i, (target, ref, text) in enumerate(zip(*(right.column(c).to_pylist() for c in ("target", "ref", "ref_seq")))):
            held = words(text or "")
            at = columns.setdefault((target, ref, len(held)), len(first))
            if at == len(first):
                first.append(i)
            for w in held:
                places.setdefault(w, []).append(at)
        lists = {w: np.array(p, np.int64) for w, p in places.items()}
        sizes = np.array([n for _, _, n in columns], np.int64)
        rows, refs, totals, shared = [], [], [], []
        for i, text in enumerate(left.column("seq").to_pylist()):
            mine = words(text or "")
            met = [lists[w] for w in mine if w in lists]
            if not met or sum(map(len, met)) < min_shared:
                continue
            both = np.bincount(np.concatenate(met), minlength=len(first))
            union = len(mine) + sizes - both
            found = np.flatnonzero((both > 0) & (both >= min_shared) & (both >= min_jaccard * union - 1e-9))
            rows.append(np.full(len(found), i))
            refs.append(found)
            totals.append(np.full(len(found), len(mine)))
            shared.append(both[found])
        flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        columns_of = flat(refs).astype(np.int64)
        named = right.select(["target", "ref"]).take(pa.array(np.array(first, np.int64)[columns_of]))
        return pa.table(
            {
                "_id": left.column("_id").take(pa.array(flat(rows).astype(np.int64))),
                "target": named.column("target"),
                "ref": named.column("ref"),
                "_nq": pa.array(flat(totals).astype(np.int32)),
                "_nr": pa.array(sizes[columns_of].astype(np.int32)),
                "shared": pa.array(flat(shared).astype(np.int64)),
            }
        )

    return count


def kmer_search(queries: DataFrame, index: DataFrame, k: int = 5, min_shared: int = 1, min_jaccard: float = 0.0) -> DataFrame:
    """Matches of queries (query, seq) in an index (target, ref, ref_seq) of top sequences.

    Coarse: shared distinct k-mers and their Jaccard. Fine: alignment identity of
    the coarse matches only. A task counts some of the sequences against a block of the index, so the pairs
    that share too little, by far the most, are never shuffled; every sequence meets every block.
    """
    spark = queries.sparkSession
    distinct = durable(queries.select("seq").filter("seq IS NOT NULL").distinct().withColumn("_id", F.unhex(F.md5("seq"))))
    blocks = max(1, -(-index.count() // REFERENCES))
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salts = max(tasks, -(-distinct.count() // SEQUENCES))
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    hashed = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    left = distinct.select("_id", "seq", hashed(salts, "_id").alias("_salt"), spread(blocks, "_block"))
    right = index.select("target", "ref", "ref_seq", hashed(blocks, "target", "ref").alias("_block"), spread(salts, "_salt"))
    kinds = {f.name: f.dataType.simpleString() for f in index.schema}
    schema = f"_id binary, target {kinds['target']}, ref {kinds['ref']}, _nq int, _nr int, shared bigint"
    pairs = left.groupBy("_block", "_salt").cogroup(right.groupBy("_block", "_salt")).applyInArrow(_counted(k, min_shared, min_jaccard), schema)
    score = F.col("shared") / (F.col("_nq") + F.col("_nr") - F.col("shared"))
    coarse = pairs.withColumn("jaccard", score).filter((F.col("shared") >= min_shared) & (score >= min_jaccard))
    texts = coarse.join(distinct, "_id").join(index.select("target", "ref", "ref_seq"), ["target", "ref"])
    fine = rebalance(texts).withColumn("identity", identity("seq", "ref_seq"))
    found = fine.select("seq", "target", "ref", "shared", "jaccard", "identity")
    return queries.join(found, "seq").drop("seq")


REGIONS = {"cdr1": 0.25, "cdr2": 0.25, "cdr3": 0.5}


def match_details(matches: DataFrame, queries: DataFrame, refs: DataFrame, key: str, weights: dict[str, float] = REGIONS) -> DataFrame:
    """``matches`` (key, target, ref, identity, ...) with the identity of each region, their weighted mean
    ``cdr_similarity``, and the duplicate tier ``dup`` with its ``reason``.

    ``queries`` has the key and the regions, ``refs`` target, ref and the regions; a region is null where it could not be
    found. A match without any region on either side is judged by its whole identity; missing regions of others count 0.
    """
    from sievegrid.operators.gates import duplicate_tier

    names = list(weights)
    mine = queries.select(key, *names)
    theirs = refs.select("target", "ref", *[F.col(c).alias(f"_ref_{c}") for c in names])
    joined = rebalance(matches.join(mine, key, "left").join(theirs, ["target", "ref"], "left"))
    out = joined.withColumns({f"{c}_identity": identity(F.col(c), F.col(f"_ref_{c}")) for c in names})
    part = {c: F.col(f"{c}_identity") for c in names}
    has = F.coalesce(*part.values()).isNotNull()
    total = sum((F.coalesce(part[c], F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    tier = duplicate_tier(F.col("identity"), part["cdr1"], part["cdr2"], part["cdr3"], has)
    out = out.withColumns({"cdr_similarity": F.when(has, total), "_tier": tier})
    return out.withColumns({"dup": F.col("_tier.dup"), "reason": F.col("_tier.reason")}).drop(
        "_tier", *names, *[f"_ref_{c}" for c in names]
    )


def cluster_links(nodes: DataFrame, k: int = 5, picks: int = 10, min_identity: float = 0.4) -> DataFrame:
    """(a, b) of sequences (id, seq) that share a picked k-mer with a centre and reach the identity to it.

    Every sequence picks the k-mers with the smallest hashes; all that share a
    picked k-mer are compared with the longest of them only, so a k-mer held by
    a third of all sequences costs one comparison each, and none where the lengths rule the identity out.
    Keys and lengths travel, and letters come back once per different pair. (Steinegger and Soeding 2018 describe the scheme.)

    The centres are found first, over all sequences. Then the sequences meet them some at a time, all in the end: the
    k-mers and pairs of a part are many times larger than its letters and leave the disk when it is done.
    """
    spark = nodes.sparkSession
    slim = nodes.select("id", "seq")
    ranked = F.array_sort(
        F.transform(kmers(F.col("seq"), k), lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t")))
    )

    def picked(some: DataFrame) -> DataFrame:
        return unnest(some, F.slice(ranked, 1, picks), "p", "id", F.length("seq").alias("n")).select("id", "n", F.col("p.t").alias("t"))

    centers = picked(slim).groupBy("t").agg(F.max_by(F.struct("id", "n"), F.struct("n", "id")).alias("_c"))
    centers = durable(centers.select("t", F.col("_c.id").alias("c"), F.col("_c.n").alias("c_n")))
    heads = durable(slim.join(centers.select(F.col("c").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("c"), F.col("seq").alias("c_seq")))
    release(spark)
    # no more letters can agree than the shorter has, so most pairs with a long centre need no alignment
    fits = F.least("n", "c_n") / F.greatest("n", "c_n") >= min_identity
    parts = min(PARTS, max(1, -(-nodes.count() // PART)))
    found = None
    for part in range(parts):
        some = slim.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        met = picked(some).join(centers, "t").filter((F.col("id") != F.col("c")) & fits).select("id", "c").distinct()
        full = met.join(some, "id").join(heads, "c")
        pair = F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")
        compared = rebalance(full.select(*pair, "seq", "c_seq"))
        links = durable(compared.filter(identity("seq", "c_seq") >= min_identity).select("a", "b"))
        found = links if found is None else found.unionByName(links)
        del links, compared, full, met
        release(spark)
    return found.distinct()  # two centres of one another met twice


def _numbered(sequences: DataFrame) -> DataFrame:
    """(id, seq) of the distinct sequences, numbered in the order of their hashes."""
    distinct = sequences.select("seq").filter("seq IS NOT NULL").distinct()
    ranges = distinct.withColumn("_r", F.conv(F.substring(F.sha2("seq", 256), 1, 4), 16, 10).cast("bigint"))
    ranges = ranges.repartition("_r").withColumn("_h", F.unhex(F.sha2("seq", 256)))  # made behind the shuffle
    place = F.row_number().over(Window.partitionBy("_r").orderBy("_h"))
    return ranges.select((F.shiftleft("_r", 40) + place).alias("id"), "seq")


def sequence_clusters(
    sequences: DataFrame, k: int = 5, picks: int = 10, min_identity: float = 0.4
) -> DataFrame:
    """(seq, cluster): clusters of distinct sequences around representatives.

    Sequences with the most links come first, longer ones before shorter: the first one left
    becomes a representative and takes all that are linked to it. So each member reaches the
    identity to its representative, the cluster's name (a hash of its letters).
    Missing sequences drop out. Numbers in the order of the hashes travel instead of these.
    """
    nodes = durable(_numbered(sequences))
    release(nodes.sparkSession)
    links = durable(cluster_links(nodes, k, picks, min_identity))
    release(nodes.sparkSession)
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    # a length is below 2^31, so links come first and lengths next
    priority = F.shiftleft(F.coalesce("links", F.lit(0).cast("bigint")), 31) + F.col("n")
    weighed = nodes.select("id", F.length("seq").alias("n")).join(ends, "id", "left").select("id", priority.alias("priority"))
    cover = greedy_cover(weighed, links)
    names = nodes.select(F.col("id").alias("representative"), F.unhex(F.sha2("seq", 256)).alias("_name"))
    named = nodes.join(cover, "id").join(names, "representative")
    return named.select("seq", F.lower(F.hex("_name")).alias("cluster"))


def mutation_minima(pairs: DataFrame, total: int = 2, in_cdr3: int = 1) -> DataFrame:
    """Flag pairs whose regions differ by too little: cdr1/2/3 against b_cdr1/2/3."""
    from sievegrid.functions.alignment import region_mutations

    n = {c: region_mutations(F.col(c), F.col(f"b_{c}")) for c in ("cdr1", "cdr2", "cdr3")}
    out = pairs.withColumns({f"{c}_mutations": e for c, e in n.items()})
    every = sum((F.col(f"{c}_mutations") for c in n), F.lit(0))
    return out.withColumn("distinct_enough", (every >= total) & (F.col("cdr3_mutations") >= in_cdr3))
