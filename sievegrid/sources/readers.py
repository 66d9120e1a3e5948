"""Readers for the text formats of the screening flow. All of them are plain Spark scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions.draws import pick
from sievegrid.operators.msa import build_msa
from sievegrid.operators.ordering import keep_one

# Entity types of a typed FASTA header.
ENTITY_TYPES = ("protein", "dna", "rna", "ccd", "smiles")


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, place, record): text between ``>`` at line starts, splittable.

    (block, place) orders the records of a file: the byte offset of the split,
    then the position in it.
    """
    raw = spark.read.text(path, lineSep="\n>")
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.regexp_replace("value", r"\A>", "").alias("record"),
    )


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r?\n"), lambda line: F.trim(line))


def read_local_submissions(spark: SparkSession, path: str, current_block: int, seed: int = 0) -> DataFrame:
    """``uid|mol,...|seq,...`` lines; the block is a seeded 11..360 before the current one.

    The last line of a uid counts. A line of another shape comes out with its
    text in ``error`` and nulls elsewhere; blank lines are skipped.
    """
    parts = F.split(F.trim("value"), r"\|")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select("value", parts.alias("p"), F.monotonically_increasing_id().alias("_line"))
    uid = F.get("p", F.lit(0)).try_cast("bigint")
    fine = (F.size("p") == 3) & uid.isNotNull()
    read = rows.select(
        F.when(fine, uid).alias("uid"),
        F.when(fine, F.split(F.get("p", F.lit(1)), ",")).alias("molecules"),
        F.when(fine, F.split(F.get("p", F.lit(2)), ",")).alias("sequences"),
        F.when(~fine, F.concat(F.lit("malformed line: "), "value")).alias("error"),
        "_line",
    )
    good = keep_one(read.filter("error IS NULL"), ["uid"], [F.col("_line")], last=True)
    block = F.lit(current_block) - 11 - pick(seed, F.lit(350), F.col("uid"))
    return good.unionByName(read.filter("error IS NOT NULL")).select(
        "uid", "molecules", "sequences", block.alias("block_submitted"), F.lit("").alias("push_time"), "error"
    )


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, seq): first word after ``>``, lines joined, blank lines skipped."""
    lines = _lines(F.col("record"))
    rows = _records(spark, path).select(
        F.split(F.get(lines, F.lit(0)), r"\s+").alias("head"),
        F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "").alias("seq"),
    )
    return rows.select(F.get("head", F.lit(0)).alias("name"), "seq").filter("name <> ''")


def read_typed_fasta(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``CHAIN|TYPE|MSA`` records: (chain_id, entity_type, msa_id, seq, error).

    ``strict`` raises on the first malformed record; otherwise the error column
    says what is wrong, so that bad records can be set aside.
    """
    parts = F.split("name", r"\|")
    entity = F.lower(F.get(parts, F.lit(1)))
    msa_id = F.nullif(F.get(parts, F.lit(2)), F.lit(""))
    error = (
        F.when(F.size(parts) < 2, "no chain and type in header")
        .when(~entity.isin(*ENTITY_TYPES), "unknown entity type")
        .when(F.get(parts, F.lit(0)) == "", "empty chain id")
        .when(msa_id.isNotNull() & (entity != "protein"), "alignment given for a non-protein")
    )
    rows = read_fasta(spark, path).select(
        F.get(parts, F.lit(0)).alias("chain_id"),
        F.upper(entity).alias("entity_type"),
        msa_id.alias("msa_id"),
        "seq",
        error.alias("error"),
    )
    if strict:
        checked = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string"))
        rows = rows.withColumn("error", checked)
    return rows


def read_a3m(
    spark: SparkSession, path: str | list[str], taxonomy: DataFrame | None = None, max_seqs: int | None = None
) -> DataFrame:
    """Alignment rows of A3M files (plain or gzip), one alignment per file.

    ``taxonomy``: (uniref_id, taxonomy_id); only ``UniRef100_<id>`` headers are
    looked up. Blank and ``#`` lines are skipped.
    """
    lines = _lines(F.col("record"))
    rows = _records(spark, path).select(
        "file", "block", "place", F.get(lines, F.lit(0)).alias("head"),
        F.posexplode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("i", "line"),
    )
    rows = rows.filter(F.col("line").rlike("^[^#]"))
    key = F.when(F.col("head").startswith("UniRef100"), F.get(F.split(F.get(F.split("head", r"\s+"), F.lit(0)), "_"), F.lit(1)))
    keyed = rows.withColumn("uniref_id", key)
    if taxonomy is None:
        tagged = keyed.withColumn("taxonomy", F.lit(None).cast("bigint"))
    else:
        side = taxonomy.select("uniref_id", F.col("taxonomy_id").cast("bigint").alias("taxonomy"))
        tagged = keyed.join(side, "uniref_id", "left")
    placed = tagged.select(F.col("file").alias("msa_id"), F.struct("block", "place", "i").alias("order"), "taxonomy", "line")
    return build_msa(placed, max_seqs)


def read_msa_csv(spark: SparkSession, path: str | list[str], max_seqs: int | None = None) -> DataFrame:
    """Alignment rows of CSV files with exactly the columns key and sequence."""
    frame = spark.read.option("header", True).csv(path)
    if sorted(frame.columns) != ["key", "sequence"]:
        raise ValueError(f"expected columns key and sequence, found {frame.columns}")
    rows = frame.select(
        F.col("_metadata.file_path").alias("msa_id"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")
        ).alias("order"),
        F.col("key").try_cast("bigint").alias("taxonomy"),
        F.trim("sequence").alias("line"),
    )
    return build_msa(rows.filter("line <> ''"), max_seqs)


def read_archive(spark: SparkSession, root: str, target: str, entity: str, key: str) -> DataFrame | None:
    """Rows of one target's archive, the largest ``seq_no`` winning per key; None without an archive.

    The layout is ``root/entity=<e>/target=<t>/batch=<n>``: only the wanted
    target is listed, and appending never rewrites earlier batches.
    """
    try:
        rows = spark.read.option("basePath", f"{root}/entity={entity}").parquet(f"{root}/entity={entity}/target={target}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return keep_one(rows, [key], [F.col("seq_no"), F.col("batch")], last=True)


def read_prediction_json(
    spark: SparkSession,
    root: str,
    schema: str = "map<string,double>",
    file_glob: str = "{affinity,confidence}*",
) -> DataFrame:
    """(record, metrics): keys of all ``affinity*`` and ``confidence*`` files of a record folder.

    A later file overwrites an earlier one; unreadable files are skipped.
    """
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=file_glob)
    path = F.col("_metadata.file_path")
    parsed = raw.select(
        F.element_at(F.split(path, "/"), -2).alias("record"),
        path.alias("path"),
        F.from_json("value", schema).alias("m"),
    )
    entries = parsed.filter("m IS NOT NULL").select("record", "path", F.explode("m").alias("k", "v"))
    last = entries.groupBy("record", "k").agg(F.max_by("v", "path").alias("v"))
    # a record holds a fixed set of metric names
    return last.groupBy("record").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metrics"))


def read_metrics_csv(spark: SparkSession, path: str, metrics: Sequence[str]) -> DataFrame:
    """(item, target, metrics...) from metric tables with ids ``<item>_<target>...``."""
    schema = "id string, " + ", ".join(f"`{m}` double" for m in metrics)
    rows = spark.read.option("header", True).schema(schema).csv(path)
    parts = F.split("id", "_")
    return rows.select(F.get(parts, F.lit(0)).alias("item"), F.get(parts, F.lit(1)).alias("target"), *metrics)


def reaction_count(reactions: DataFrame, fallback: int = 5) -> DataFrame:
    """Number of reactions, the fallback for an empty table."""
    n = F.count(F.lit(1))
    return reactions.agg(F.when(n == 0, fallback).otherwise(n).cast("int").alias("n"))


def read_manifest(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records, and the count of files that did not parse, from one JSON document per line."""
    raw = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = raw.select("_corrupt", *raw.columns[:1]).agg(F.count("_corrupt").alias("failed"))
    return raw.filter("_corrupt IS NULL").drop("_corrupt"), bad


def list_inputs(spark: SparkSession, root: str, glob: str, max_size: int) -> DataFrame:
    """(path, length, fits): files below a folder, the content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", (F.col("length") <= max_size).alias("fits"))


def read_cluster_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rep string, member string").option("sep", "\t").csv(path)


def protein_lookup(
    codes: DataFrame, primary: DataFrame, fallback: DataFrame, start: int | None = None, end: int | None = None
) -> DataFrame:
    """Sequence of each code, from the primary table or else the fallback, optionally clipped."""
    from sievegrid.functions.sequences import clip

    joined = codes.join(primary.select("code", F.col("seq").alias("_p")), "code", "left")
    joined = joined.join(fallback.select("code", F.col("seq").alias("_f")), "code", "left")
    seq = F.coalesce("_p", "_f")
    if start is not None and end is not None:
        seq = clip(seq, start, end)
    return joined.withColumn("seq", seq).drop("_p", "_f")
