"""From raw documents to packed training windows: five stages, each a step of its own."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm import language, mixing, neardup, packing, secrets
from sievegrid.llm.common import row_key
from sievegrid.session import scratch_path, ship_package


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without letters and undecided ones go."""
    ship_package(spark)
    found = language.identify(docs, language.fit(docs))
    return found.filter("kept").select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, that with the smallest doc_id; null ids come last.

    Rows are told apart by id and text, so texts that share an id, or have none, are decided each on its own.
    """
    ship_package(spark)
    rows = docs.withColumn("_row", neardup.row_of("doc_id", "text"))
    kept = neardup.keepers(docs).select(F.col("row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    clean = secrets.redact(secrets.scan(docs))
    length = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a part of a document is its first words.

    A document that is taken q times and a rest comes q times whole and once
    with as many words as the rest; one that isn't taken goes. Rows are told apart
    by all columns; equal rows come each as often as the mix takes it.
    """
    rows = docs.withColumn("_row", row_key(*[F.col(c) for c in docs.columns]))
    taken = mixing.mix(rows, key="_row").documents.filter("taken > 0").groupBy(F.col("doc_id").alias("_row"), "taken").agg(
        F.max("size").alias("_size"), F.count("taken").alias("_rows")
    )
    spread = rows.dropDuplicates(["_row"]).join(taken, "_row").withColumnRenamed("taken", "_taken")
    spread = spread.withColumn("_rest", F.col("_taken") % F.col("_size"))
    each = F.ceil(F.col("_taken") / F.col("_size"))
    spread = spread.withColumn("_turn", F.explode(F.sequence(F.lit(0), (F.col("_rows") * each - 1).cast("int"))))
    spread = spread.withColumn("_turn", F.col("_turn") % each + 1)
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{mixing.WORD}"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("_rest").cast("int")), "")
    cut = (F.col("_turn") > F.floor(F.col("_taken") / F.col("_size"))) & (F.col("_rest") > 0)
    out = spread.withColumn("text", F.when(cut, part).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the windows."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language identification", identified),
    ("near-duplicate removal", deduplicated),
    ("secret scan", without_secrets),
    ("source mixing", mixed),
    ("packing", packed),
]

# Text models, hashing and tokens aren't SQL; each stage is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for step, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{step}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
