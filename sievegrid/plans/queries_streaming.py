"""Queries that run as streams over the events and must equal their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegrid.plans import fixtures as X
from sievegrid.plans.queries_epoch import _WINDOW_SQL
from sievegrid.plans.registry import query
from sievegrid.session import scratch_path
from sievegrid.sources.readers import read_archive
from sievegrid.streaming import epochs as E


SLICES, DISORDER = 6, 1700  # files, and seconds by which a row may come late (150 blocks are 1800 s)


def event_stream(spark, sf, files_per_trigger=1):
    """The events as slices out of order, one file to a micro-batch."""
    path = scratch_path(spark, "events")
    E.write_slices(X.table(spark, sf, "events"), X.epoch_seconds("ts"), SLICES, DISORDER, path)
    return E.stream_folder(spark, path, files_per_trigger)


def commit_stream(spark, sf, files_per_trigger=1):
    events = event_stream(spark, sf, files_per_trigger)
    return events.select(
        F.col("event_id").alias("commit_id"),
        F.col("user_id").alias("uid"),
        F.floor(X.epoch_seconds("ts") / 12).alias("block"),
    )


_CLOSED = "(epoch + 1) * 4332 <= (SELECT max(block) * 12 - 1800 FROM commits)"


@query(
    "e1_e2_epoch_counts",
    X.with_sql(X.SQL_COMMITS)
    + f"""SELECT epoch, commits, in_time FROM (SELECT block // 361 AS epoch, count(*) AS commits,
      count(*) FILTER (block % 361 > 0 AND block % 361 < 351) AS in_time FROM commits GROUP BY ALL) WHERE {_CLOSED}""",
)
def e1(spark, sf):
    return E.run_and_read(E.epoch_counts(commit_stream(spark, sf)), "e1")


@query(
    "e3_latest_commit_stream",
    X.with_sql(X.SQL_COMMITS, _WINDOW_SQL)
    + "SELECT epoch, uid, block, commit_id FROM latest WHERE (epoch + 1) * 4332 <= (SELECT max(block) * 12 - 1800 FROM windowed)",
)
def e3_stream(spark, sf):
    return E.run_and_read(E.latest_per_epoch(commit_stream(spark, sf, 3)), "e3")


@query(
    "e4_e5_archive_stream",
    """SELECT sha256(event_type || '-' || user_id) AS key, max(event_id) AS seq_no FROM events GROUP BY ALL""",
)
def e4(spark, sf):
    """Stream events into an archive keyed by content, then read it back."""
    events = event_stream(spark, sf)
    key = F.sha2(F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")), 256)
    rows = events.select(key.alias("key"), F.col("event_id").alias("seq_no"))
    base = scratch_path(spark, "e4")
    E.each_batch(rows, E.archive_new(f"{base}/archive", "T", "nanobody", "key"), f"{base}/checkpoint")
    return read_archive(spark, f"{base}/archive", "T", "nanobody", "key").select("key", "seq_no")


@query(
    "e6_leaderboard_stream",
    X.with_sql(X.SQL_COMMITS)
    + f""", s AS (SELECT block // 361 AS epoch, uid, count(*) AS score, min(block) AS block FROM commits GROUP BY ALL)
    SELECT epoch, uid, score, row_number() OVER (PARTITION BY epoch ORDER BY score DESC, block, uid) AS rank FROM s WHERE {_CLOSED}""",
)
def e6_stream(spark, sf):
    """Scores of closed epochs come out of the stream; every micro-batch is ranked as a batch."""
    from sievegrid.operators.ranking import rank_uids

    scores = (
        E.watermarked(commit_stream(spark, sf))
        .groupBy(F.window("at", E.EPOCH_WINDOW), "uid")
        .agg(F.count(F.lit(1)).alias("score"), F.min("block").alias("block"))
        .select(F.floor(F.unix_seconds("window.start") / 4332).alias("epoch"), "uid", "score", "block")
    )
    base = scratch_path(spark, "e6")

    def rank(batch, number):
        timed = batch.withColumn("push_time", F.lit(None).cast("timestamp"))
        ranked = rank_uids(timed, "score", "max", ["epoch"]).select("epoch", "uid", "score", "rank")
        ranked.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    E.each_batch(scores, rank, f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("epoch", "uid", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "e7_rate_gate",
    X.with_sql(X.SQL_COMMITS).replace("WITH", "WITH RECURSIVE", 1)
    + """, e AS (SELECT DISTINCT uid, block FROM commits WHERE 361 - block % 361 > 20 AND block * 12 < (SELECT max(block) * 12 - 1800 FROM commits WHERE 361 - block % 361 > 20)),
    r AS (SELECT uid, min(block) AS block FROM e GROUP BY uid UNION ALL
      SELECT r.uid, (SELECT min(e.block) FROM e WHERE e.uid = r.uid AND e.block > r.block + 50) FROM r WHERE r.block IS NOT NULL)
    SELECT uid, block FROM r WHERE block IS NOT NULL""",
)
def e7(spark, sf):
    return E.run_and_read(E.rate_gate(commit_stream(spark, sf)), "e7")


@query(
    "e4_unique_stream",
    "SELECT DISTINCT sha256(event_type || '-' || user_id) AS key, 1 AS times FROM events",
)
def e4_unique(spark, sf):
    """Keys that neither the last of the stream nor the archive holds are archived, each once."""
    events = event_stream(spark, sf, 2)
    key = F.sha2(F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")), 256)
    rows = events.select(key.alias("key"), F.col("event_id").alias("seq_no"), F.floor(X.epoch_seconds("ts") / 12).alias("block"))
    base = scratch_path(spark, "e4u")
    known = E.KnownKeys(spark, f"{base}/archive", "T", "nanobody", "key")
    E.each_batch(E.unique_new(rows, "key"), E.archive_unseen(known, f"{base}/archive", "T", "nanobody"), f"{base}/checkpoint")
    held = known.current()
    return held.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("times"))


@query(
    "e8_consensus_barrier",
    """WITH e AS (SELECT event_id, user_id AS uid, epoch_us(ts) // 12000000 AS block, event_type, value FROM events),
    p AS (SELECT *, (block // 361 + 1) * 361 - 100 AS barrier FROM e),
    a AS (SELECT uid, block // 361 AS epoch, max_by(value, (block, value)) AS average FROM p
      WHERE event_type = 'purchase' AND block <= barrier AND value IS NOT NULL GROUP BY ALL)
    SELECT event_id AS item, p.uid, block, coalesce(average, value) AS value, average IS NOT NULL AS shared
    FROM p LEFT JOIN a ON a.uid = p.uid AND a.epoch = block // 361
    WHERE event_type <> 'purchase' AND greatest(block, barrier) * 12 < (SELECT max(block) * 12 - 1800 FROM e)""",
)
def e8(spark, sf):
    """Purchases post averages of their sender and epoch; all other events wait for them at the barrier."""
    block = F.floor(X.epoch_seconds("ts") / 12).alias("block")
    events = event_stream(spark, sf, 2).select("event_id", F.col("user_id").alias("uid"), block, "event_type", "value")
    local = events.filter("event_type <> 'purchase'").select(F.col("event_id").alias("item"), "uid", "block", F.col("value").alias("local"))
    averages = events.filter("event_type = 'purchase'").select("uid", "block", F.col("value").alias("average"))
    return E.run_and_read(E.consensus_barrier(local, averages), "e8")


@query(
    "e9_reactive_resume",
    X.with_sql(X.SQL_COMMITS) + "SELECT commit_id, uid, block FROM commits",
)
def e9(spark, sf):
    """A stream that fails in the middle of its second batch, after writing it, and goes on: every row once."""
    base = scratch_path(spark, "e9")
    stream = commit_stream(spark, sf, 2)
    failed = []

    def break_once(number):
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost between writing and committing")

    E.run_resuming(stream, E.committed_sink(base, break_once), f"{base}/checkpoint")
    return E.read_committed(spark, base, stream.schema).select("commit_id", "uid", "block")
