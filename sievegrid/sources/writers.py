"""Writers for the outputs of the screening flow. Nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.scoring import INF, safe_num


def fasta_record(name: Column, seq: Column, width: int = 80) -> Column:
    wrapped = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), name, F.lit("\n"), wrapped)


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(fasta_record(F.col(name).cast("string"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def write_metrics_csv(df: DataFrame, path: str, digits: int = 5) -> None:
    """CSV with all doubles rounded."""
    kinds = dict(df.dtypes)
    rounded = [
        F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns
    ]
    df.select(*rounded).write.mode("overwrite").option("header", True).csv(path)


def write_msa_csv(df: DataFrame, path: str) -> None:
    """``key,sequence`` rows, one folder per alignment, in row order within a file."""
    ordered = df.repartition("msa_id").sortWithinPartitions("msa_id", "idx")
    ordered.select("msa_id", "key", "sequence").write.mode("overwrite").partitionBy("msa_id").option("header", True).csv(path)


def write_manifest(records: DataFrame, path: str) -> None:
    """One JSON document per record and line."""
    records.write.mode("overwrite").json(path)


def json_safe(value: Column) -> Column:
    """Any nested column as JSON text, null fields kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def epoch_report(
    submissions: DataFrame,
    molecules: DataFrame,
    nanobodies: DataFrame,
    start_block: int,
    parameters: Mapping[str, str],
    most_items: int | None = None,
) -> DataFrame:
    """One nested document per submission with its epoch parameters.

    ``molecules`` and ``nanobodies`` hold one row per item (uid, ...); an item
    row without any metric is left out before. A submission holds at most ``most_items`` items
    of a kind, the first in the order of their columns; the others drop out by rank before anything is
    gathered. Submissions without items are skipped.
    """

    def nest(df: DataFrame, name: str) -> DataFrame:
        item = F.struct(*[c for c in df.columns if c != "uid"])
        if most_items is not None:
            place = F.row_number().over(Window.partitionBy("uid").orderBy(*[c for c in df.columns if c != "uid"]))
            df = df.withColumn("_place", place).filter(F.col("_place") <= most_items).drop("_place")
        return df.groupBy("uid").agg(F.array_sort(F.collect_list(item)).alias(name))

    joined = submissions.join(nest(molecules, "molecules"), "uid", "left").join(nest(nanobodies, "nanobodies"), "uid", "left")
    filled = joined.filter("molecules IS NOT NULL OR nanobodies IS NOT NULL")
    score = lambda c: safe_num(F.coalesce(F.col(c), F.lit(-INF))).alias(c)
    document = F.struct(
        F.create_map(*[F.lit(x) for kv in parameters.items() for x in kv]).alias("competition"),
        F.struct("uid", "hotkey").alias("neuron"),
        (F.col("block_submitted") - start_block).alias("blocks_elapsed"),
        score("molecule_final_score"),
        score("nanobody_final_score"),
        "molecules",
        "nanobodies",
    )
    return filled.select("uid", document.alias("document"))


def append_archive(new: DataFrame, root: str, entity: str, batch: int) -> None:
    """Add one batch of (target, seq_no, ...) rows; writing the same batch again replaces it.

    A retried micro-batch therefore leaves the archive as it was meant to be.
    """
    tagged = new.withColumn("batch", F.lit(batch))
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("target", "batch").parquet(f"{root}/entity={entity}")
