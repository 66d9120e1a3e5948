"""Inputs of the screening queries, derived from the given tables over all their rows.

Every derivation exists twice: as a DataFrame and as a SQL common table
expression of the same name, so that Spark and the SQL check see the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a scan yields fewer partitions than there are cores.

    Text functions are CPU-bound; one small file would keep them in one task.
    Large inputs have many splits and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line or sentence of every document: (doc_id, pos, piece)."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(F.split("text", r"[.\n]")).alias("pos", "piece"))


SQL_PIECES = r"""pieces AS (
  SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS piece
  FROM (SELECT doc_id, regexp_split_to_array(text, '[.\n]') AS p FROM documents))"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amino-acid letters of every piece: (doc_id, pos, seq)."""
    seq = F.upper(F.regexp_replace("piece", LETTERS, ""))
    some = pieces(spark, sf_dir).filter(F.col("piece").rlike(LETTERS.replace("^", "", 1)))  # a test of seq would make it twice
    return some.select("doc_id", "pos", seq.alias("seq"))


SQL_SEQUENCES = (
    SQL_PIECES
    + f""", sequences AS (
  SELECT doc_id, pos, upper(regexp_replace(piece, '{LETTERS}', '', 'g')) AS seq FROM pieces
  WHERE regexp_replace(piece, '{LETTERS}', '', 'g') <> '')"""
)


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amino-acid letters of every whole document: (doc_id, seq)."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.upper(F.regexp_replace("text", LETTERS, "")).alias("seq"))


SQL_CHAINS = f"""chains AS (
  SELECT doc_id, upper(regexp_replace(text, '{LETTERS}', '', 'g')) AS seq FROM documents)"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One submission per document, its pieces as the item list: (uid, items)."""
    docs = documents(spark, sf_dir)
    letters = F.transform(
        F.split("text", r"[.\n]"), lambda x: F.upper(F.regexp_replace(x, LETTERS, ""))
    )
    return docs.select(F.col("doc_id").alias("uid"), F.filter(letters, lambda x: x != "").alias("items"))


SQL_SUBMISSIONS = rf"""submissions AS (
  SELECT doc_id AS uid,
         list_filter(list_transform(regexp_split_to_array(text, '[.\n]'),
           lambda x: upper(regexp_replace(x, '{LETTERS}', '', 'g'))), lambda x: x <> '') AS items
  FROM documents)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics of every (item, target): quantity, price, discount, tax."""
    lines = table(spark, sf_dir, "lineitem")
    means = {"m1": "l_quantity", "m2": "l_extendedprice", "m3": "l_discount", "m4": "l_tax"}
    return lines.groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("target")).agg(
        *[F.round(F.avg(c), 6).alias(m) for m, c in means.items()]
    )


SQL_METRICS = """metrics AS (
  SELECT l_partkey AS item, l_suppkey AS target, round(avg(l_quantity), 6) AS m1,
         round(avg(l_extendedprice), 6) AS m2, round(avg(l_discount), 6) AS m3,
         round(avg(l_tax), 6) AS m4
  FROM lineitem GROUP BY ALL)"""


def epoch_seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session zone is."""
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commitments: (commit_id, uid, block), the block from the event time at 12 s each."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("commit_id"),
        F.col("user_id").alias("uid"),
        F.floor(epoch_seconds("ts") / 12).alias("block"),
    )


SQL_COMMITS = """commits AS (
  SELECT event_id AS commit_id, user_id AS uid, epoch_us(ts) // 12000000 AS block FROM events)"""


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms from the embeddings: 50 to a structure, 12 to a chain, 3 to a residue.

    (structure_id, atom_idx, chain_id, res_idx, x, y, z, px, py, pz, element, charge, area, flag);
    px, py, pz are a second model of the same atom.
    """
    e = table(spark, sf_dir, "embeddings")
    dim = lambda i: F.col("embedding")[i].cast("double")
    idx = F.col("vec_id") % 50
    return e.select(
        F.floor(F.col("vec_id") / 50).alias("structure_id"),
        idx.alias("atom_idx"),
        F.floor(idx / 12).alias("chain_id"),
        F.floor(idx / 3).alias("res_idx"),
        *[F.round(dim(i) * 60, 3).alias(c) for i, c in enumerate("xyz")],
        *[F.round(dim(i) * 60 + dim(i + 3) * 10, 3).alias(f"p{c}") for i, c in enumerate("xyz")],
        F.when(dim(3) > 0, "C").otherwise("N").alias("element"),
        F.signum(F.round(dim(4) * 8, 0)).cast("int").alias("charge"),
        F.round(F.abs(dim(5)) * 100, 3).alias("area"),
        (dim(6) > 0).alias("flag"),
    )


SQL_ATOMS = (
    """atoms AS (
  SELECT vec_id // 50 AS structure_id, vec_id % 50 AS atom_idx, vec_id % 50 // 12 AS chain_id,
         vec_id % 50 // 3 AS res_idx, """
    + ", ".join(f"round(embedding[{i + 1}]::DOUBLE * 60, 3) AS {c}" for i, c in enumerate("xyz"))
    + ", "
    + ", ".join(
        f"round(embedding[{i + 1}]::DOUBLE * 60 + embedding[{i + 4}]::DOUBLE * 10, 3) AS p{c}"
        for i, c in enumerate("xyz")
    )
    + """,
         CASE WHEN embedding[4] > 0 THEN 'C' ELSE 'N' END AS element,
         CAST(sign(round(embedding[5]::DOUBLE * 8, 0)) AS INT) AS charge,
         round(abs(embedding[6]::DOUBLE) * 100, 3) AS area, embedding[7] > 0 AS flag
  FROM embeddings)"""
)


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
