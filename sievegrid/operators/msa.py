"""Alignments: parsed rows, profiles, pairing of chains by taxonomy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegrid.operators.ordering import RangeOrdered, keep_one
from sievegrid.operators.setops import MAX_MSA_SEQS, MAX_PAIRED_SEQS
from sievegrid.session import rebalance


def aligned_letters(line: Column) -> Column:
    """Aligned columns of an alignment row: insertions (lower case) left out."""
    return F.regexp_replace(line, "[a-z]", "")


def insertions(line: Column) -> Column:
    """(res_idx, deletion): lower-case letters before an aligned column; trailing ones are lost."""
    some = F.regexp_extract(line, "(?s)^.*[a-z][^a-z]", 0)  # up to the last insertion: columns behind it have none
    runs = F.regexp_extract_all(some, F.lit("([a-z]*)[^a-z]"), F.lit(1))
    marked = F.transform(
        runs, lambda r, i: F.struct(i.alias("res_idx"), F.length(r).alias("deletion"))
    )
    return F.filter(marked, lambda m: m["deletion"] > 0)


def build_msa(rows: DataFrame, max_seqs: int | None = None) -> DataFrame:
    """(msa_id, seq_idx, taxonomy, residues, deletions) from (msa_id, order, taxonomy, line).

    The first of all rows with the same letters stays; indexes follow the order.
    """
    text = F.upper(F.replace("line", F.lit("-"), F.lit("")))
    first = keep_one(rows.withColumn("_text", text), ["msa_id", "_text"], [F.col("order")])
    numbered = RangeOrdered(first.drop("_text"), ["msa_id"], ["order"]).row_number("seq_idx")
    if max_seqs is not None:
        numbered = numbered.filter(F.col("seq_idx") <= max_seqs)
    return numbered.select(
        "msa_id",
        (F.col("seq_idx") - 1).alias("seq_idx"),
        F.coalesce(F.col("taxonomy"), F.lit(-1)).alias("taxonomy"),
        aligned_letters(F.col("line")).alias("residues"),
        insertions(F.col("line")).alias("deletions"),
    )


BLOCK = 1024  # columns of a row of partial counts
LETTERS = 1 << 22  # letters counted at a time


def _column_counts(letters: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts per column of (msa_id, residues, deletions), summed over neighbouring rows of an alignment.

    Gives (msa_id, start, there, a count for each letter, gaps, scaled), lists over the columns from ``start`` on;
    ``there`` marks the columns that hold residues.
    """
    codes = [ord(a) if len(a) == 1 else -1 for a in letters]

    def counts(rows: pa.RecordBatch) -> pa.RecordBatch:
        names = rows.column(0).dictionary_encode()
        of = names.indices.to_numpy(zero_copy_only=False)
        texts = pc.fill_null(rows.column(1), "")
        sizes = np.asarray(pc.utf8_length(texts)).astype(np.int64)
        found = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
        gaps = rows.column(2)
        gap_of = of[np.repeat(np.arange(len(of)), np.asarray(pc.fill_null(pc.list_value_length(gaps), 0)))]
        flat = gaps.flatten()
        at, long = (np.asarray(flat.field(i)).astype(np.int64) for i in range(2))
        held, width = np.zeros((2, len(names.dictionary)), np.int64)
        np.maximum.at(held, of, sizes)
        np.maximum.at(width, gap_of, at + 1)
        width = np.maximum(width, held)
        ends = np.cumsum(width)
        base, cells = ends - width, int(ends[-1])
        # a letter's column: its place in all letters, moved by its row
        moved = np.repeat(base[of] - (np.cumsum(sizes) - sizes), sizes)
        letter_at = [np.flatnonzero(found == c) for c in codes]
        per_letter = [np.bincount(i + moved[i], minlength=cells) for i in letter_at]
        # pi/2 * atan(d / 3), the transform of a deletion count.
        scaled = np.pi / 2 * np.arctan(long / 3.0)
        gap_cells = base[gap_of] + at
        columns = np.arange(cells) - np.repeat(base, width)
        blocks = -(-width // BLOCK)
        name_of = np.repeat(np.arange(len(width)), blocks)
        start = (np.arange(len(name_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        offsets = pa.array(np.append(base[name_of] + start, cells).astype(np.int32))
        values = [columns < np.repeat(held, width), *per_letter, np.bincount(gap_cells, minlength=cells),
                  np.bincount(gap_cells, scaled, minlength=cells).astype(np.float64)]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]
        key = names.dictionary.take(pa.array(name_of))
        fields = ["msa_id", "start", "there", *[f"p{i}" for i in range(len(codes))], "gaps", "scaled"]
        return pa.RecordBatch.from_arrays([key, pa.array(start.astype(np.int32)), *lists], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            total = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(batch.column(1)), 0), np.int64))
            while done < batch.num_rows:
                before = total[done - 1] if done else 0
                upto = max(int(np.searchsorted(total, before + LETTERS, "right")), done + 1)
                yield counts(batch.slice(done, upto - done))
                done = upto

    return run


def msa_profile(msa: DataFrame, letters: str) -> DataFrame:
    """Per alignment column: share of each letter, share and mean of transformed deletions.

    Tasks count the columns of the rows they hold; only these counts, not the letters, are dealt out by alignment.
    """
    msa = msa.filter("msa_id IS NOT NULL")
    sizes = msa.groupBy("msa_id").agg(F.count(F.lit(1)).alias("_n"))
    lists = [*[f"p{i}" for i in range(len(letters))], "gaps", "scaled"]
    kind = T.StructType([msa.schema["msa_id"], T.StructField("start", T.IntegerType()), T.StructField("there", T.ArrayType(T.BooleanType()))])
    for name in lists:
        kind.add(name, T.ArrayType(T.DoubleType() if name == "scaled" else T.LongType()))
    rows = msa.select("msa_id", "residues", F.filter("deletions", lambda d: d["deletion"].isNotNull() & (d["res_idx"] >= 0)).alias("deletions"))
    # a small list becomes many columns: tasks by their number, not by the lists' bytes
    partial = rebalance(rows.mapInArrow(_column_counts(letters), kind), "msa_id").join(sizes, "msa_id")
    columns = partial.select("msa_id", "_n", "start", *lists, F.posexplode("there").alias("_at", "there")).select(
        "msa_id", "_n", (F.col("start") + F.col("_at")).alias("res_idx"), "there", *[F.get(name, F.col("_at")).alias(name) for name in lists]
    )
    counts = columns.groupBy("msa_id", "res_idx").agg(
        F.max("_n").alias("_n"), F.max("there").alias("there"), *[F.sum(name).alias(name) for name in lists]
    )
    return counts.filter("there").select(
        "msa_id",
        "res_idx",
        *[(F.col(f"p{i}") / F.col("_n")).alias(f"p_{a}") for i, a in enumerate(letters)],
        (F.col("gaps") / F.col("_n")).alias("has_deletion"),
        (F.col("scaled") / F.col("_n")).alias("deletion_mean"),
    )


def msa_pairing(
    msa: DataFrame, max_pairs: int = MAX_PAIRED_SEQS, max_total: int = MAX_MSA_SEQS, max_seqs: int | None = None
) -> DataFrame:
    """(complex_id, row, chain_id, seq_idx, is_paired) from (complex_id, chain_id, seq_idx, taxonomy).

    Row 0 pairs the queries. A taxonomy with several sequences gives as many
    rows as its most frequent chain has; the other chains roll over. Taxonomies
    on many chains come first, then by first appearance. A chain without the
    taxonomy takes its next sequence, or a gap (-1). Unpaired rows follow.
    """
    cx = ["complex_id"]
    tagged = msa.filter(F.col("taxonomy") != -1)
    per_chain = tagged.groupBy(*cx, "taxonomy", "chain_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("seq_idx").alias("_first")
    )
    groups = (
        per_chain.groupBy(*cx, "taxonomy")
        .agg(
            F.sum("_n").alias("_all"),
            F.count(F.lit(1)).alias("_chains"),
            F.max("_n").alias("_rows"),
            F.min(F.struct("chain_id", "_first")).alias("_seen"),
        )
        .filter("_all > 1")
    )
    placed = RangeOrdered(groups, cx, ["-_chains", "_seen"]).running_sums({"_end": F.col("_rows")})
    start = F.col("_end") - F.col("_rows") + 1  # row 0 holds the queries
    rows = placed.filter(start < max_pairs).select(
        *cx, "taxonomy", start.alias("_start"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("_rows"), F.lit(max_pairs) - start) - 1)).alias("_i")
    )
    rows = rows.withColumn("row", F.col("_start") + F.col("_i")).filter(F.col("row") < max_pairs)
    chains = msa.groupBy(*cx, "chain_id").agg((F.count(F.lit(1)) - 1).alias("_spare"))
    grid = rows.join(chains, cx).join(per_chain.select(*cx, "taxonomy", "chain_id", "_n"), [*cx, "taxonomy", "chain_id"], "left")
    listed = RangeOrdered(tagged, [*cx, "taxonomy", "chain_id"], ["seq_idx"]).row_number("_k")
    hit = grid.filter("_n IS NOT NULL").withColumn("_k", F.col("_i") % F.col("_n") + 1)
    hit = hit.join(listed.select(*cx, "taxonomy", "chain_id", "_k", "seq_idx"), [*cx, "taxonomy", "chain_id", "_k"])
    paired = hit.select(*cx, "row", "chain_id", "seq_idx", F.lit(1).alias("is_paired"))
    # the k-th absence of a chain takes its k-th spare sequence: sequences 1, 2, ...
    absent = RangeOrdered(grid.filter("_n IS NULL"), [*cx, "chain_id"], ["row"]).row_number("_k")
    fill = lambda k: F.when(k <= F.col("_spare"), k).otherwise(-1)
    filled = absent.select(*cx, "row", "chain_id", fill(F.col("_k")).alias("seq_idx"), F.lit(0).alias("is_paired"))
    queries = chains.select(*cx, F.lit(0).cast("bigint").alias("row"), "chain_id", F.lit(0).cast("bigint").alias("seq_idx"), F.lit(1).alias("is_paired"))
    # unpaired tail
    taken = absent.groupBy(*cx, "chain_id").agg(F.count(F.lit(1)).alias("_used"))
    left = chains.join(taken, [*cx, "chain_id"], "left").withColumn("_used", F.coalesce("_used", F.lit(0)))
    used_rows = rows.groupBy(*cx).agg((F.max("row") + 1).alias("_len"))
    most = left.groupBy(*cx).agg(F.max(F.greatest(F.col("_spare") - F.col("_used"), F.lit(0))).alias("_left"))
    tail = left.join(most, cx).join(used_rows, cx, "left").withColumn("_len", F.coalesce("_len", F.lit(1)))
    n = F.least(F.col("_left"), F.lit(max_total) - F.col("_len"))
    tail = tail.filter(n > 0).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))))
    tail = tail.select(
        *cx, (F.col("_len") + F.col("_i") - 1).alias("row"), "chain_id",
        fill(F.col("_used") + F.col("_i")).alias("seq_idx"), F.lit(0).alias("is_paired"),
    )
    out = queries.unionByName(paired).unionByName(filled).unionByName(tail)
    return out if max_seqs is None else out.filter(F.col("row") < max_seqs)


def random_rows(pairing: DataFrame, n: int, seed: int) -> DataFrame:
    """Row 0 and n - 1 random other rows of each complex, by hashed order."""
    from sievegrid.functions.draws import uniform

    others = pairing.filter("row > 0").select("complex_id", "row").distinct()
    shuffled = others.withColumn("_u", uniform(seed, F.col("complex_id"), F.col("row")))
    kept = RangeOrdered(shuffled, ["complex_id"], ["_u", "row"]).row_number("_k").filter(F.col("_k") < n)
    chosen = pairing.join(kept.select("complex_id", "row"), ["complex_id", "row"], "left_semi")
    return pairing.filter("row = 0").unionByName(chosen)
