"""Epoch processing as Structured Streaming.

Blocks map to event time at a fixed 12 s, so an epoch of 361 blocks is a
tumbling window of 4332 s and the submission cut-off a predicate inside it.

Order contract: a row may come up to ``delay_blocks`` later than a row of a
later block. Within that, results don't depend on how the input is cut into
files or micro-batches: windows close, and senders are gated, only once the
watermark has passed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievegrid.functions.scoring import BLOCK_SECONDS, CUTOFF_BLOCKS, EPOCH_BLOCKS
from sievegrid.session import scratch_path
from sievegrid.sources.readers import read_archive
from sievegrid.sources.writers import append_archive

EPOCH_WINDOW = f"{EPOCH_BLOCKS * BLOCK_SECONDS} seconds"
# Blocks that must remain and pass between two submissions; barrier of the averages.
MIN_REMAINING, MIN_SPACING = 20, 50
CONSENSUS_BARRIER = 100
DELAY_BLOCKS = 150
KEY_GROUPS = 256  # states of the functions below; a checkpoint holds for this number only


def block_time(block: Column) -> Column:
    return F.timestamp_seconds(block * BLOCK_SECONDS)


def before_cutoff(block: Column) -> Column:
    """Strictly inside the epoch and before its last blocks."""
    place = F.pmod(block, F.lit(EPOCH_BLOCKS))
    return (place > 0) & (place < EPOCH_BLOCKS - CUTOFF_BLOCKS)


def watermarked(commits: DataFrame, delay_blocks: int = DELAY_BLOCKS) -> DataFrame:
    """Commits (uid, block, ...) with event time and a watermark."""
    timed = commits.withColumn("at", block_time(F.col("block")))
    return timed.withWatermark("at", f"{delay_blocks * BLOCK_SECONDS} seconds")


def epoch_counts(commits: DataFrame) -> DataFrame:
    """Commits per closed epoch, and how many of them came in time."""
    return (
        watermarked(commits)
        .groupBy(F.window("at", EPOCH_WINDOW))
        .agg(F.count(F.lit(1)).alias("commits"), F.count_if(before_cutoff(F.col("block"))).alias("in_time"))
        .select(
            F.floor(F.unix_seconds("window.start") / (EPOCH_BLOCKS * BLOCK_SECONDS)).alias("epoch"),
            "commits",
            "in_time",
        )
    )


def latest_per_epoch(commits: DataFrame) -> DataFrame:
    """The last commit of each uid in each closed epoch; the state is one row per uid."""
    last = F.max(F.struct("block", "commit_id"))
    return (
        watermarked(commits.filter(before_cutoff(F.col("block"))))
        .groupBy(F.window("at", EPOCH_WINDOW), "uid")
        .agg(last.alias("last"))
        .select(
            F.floor(F.unix_seconds("window.start") / (EPOCH_BLOCKS * BLOCK_SECONDS)).alias("epoch"),
            "uid",
            "last.block",
            "last.commit_id",
        )
    )


def _grouped(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` dealt by key over ``KEY_GROUPS`` groups (``part``), with ``nobody`` for a missing uid, which becomes 0.

    A call of a Python state function costs far more than a row, so a state holds a group of keys.
    """
    part = F.pmod(F.xxhash64(*key), F.lit(KEY_GROUPS)).alias("part")
    mine = [F.coalesce("uid", F.lit(0)).cast("bigint").alias("uid"), F.col("uid").isNull().alias("nobody")]
    return rows.select(part, *mine, *[c for c in rows.columns if c != "uid"])


def rate_gate(commits: DataFrame) -> DataFrame:
    """Commits a sender would really send: enough blocks remain, and enough passed since
    its last one.

    The state of a sender is its last sent block and the distinct blocks that
    the watermark has not passed, at most one per block of the delay: earlier
    ones may still come, so they are gated in order when it has. A state holds the senders of one group.
    """
    timely = watermarked(commits).filter(EPOCH_BLOCKS - F.pmod(F.col("block"), F.lit(EPOCH_BLOCKS)) > MIN_REMAINING)

    def gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        senders, sent_at, waiting = state.get if state.exists else ([], [], [])
        last = dict(zip(senders, sent_at))
        pending = {u: set(w) for u, w in zip(senders, waiting) if w}
        for pdf in batches:
            for uid, nobody, block in zip(pdf["uid"].tolist(), pdf["nobody"].tolist(), pdf["block"].tolist()):
                pending.setdefault(None if nobody else uid, set()).add(int(block))
        passed, sent, held = state.getCurrentWatermarkMs(), [], {}
        for uid, blocks in pending.items():
            before = last.setdefault(uid, None)
            for block in sorted(b for b in blocks if b * BLOCK_SECONDS * 1000 < passed):
                if before is None or block - before > MIN_SPACING:
                    sent.append((uid, block))
                    before = block
            last[uid] = before
            left = sorted(b for b in blocks if b * BLOCK_SECONDS * 1000 >= passed)
            if left:
                held[uid] = left
        state.update((list(last), list(last.values()), [held.get(u, []) for u in last]))
        if held:
            state.setTimeoutTimestamp(min(w[0] for w in held.values()) * BLOCK_SECONDS * 1000)
        columns = [pd.Series([s[i] for s in sent], dtype="Int64") for i in range(2)]
        if sent:
            yield pd.DataFrame({c: pd.Series([s[i] for s in sent], dtype="Int64") for i, c in enumerate(("uid", "block"))})

    return _grouped(timely.select("uid", "block", "at"), "uid").groupBy("part").applyInPandasWithState(
        gate,
        "uid bigint, block bigint",
        "senders array<bigint>, sent array<bigint>, pending array<array<bigint>>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def barrier_block(block: Column) -> Column:
    """The block from which on the averages of a block's epoch are read."""
    return (F.floor(block / EPOCH_BLOCKS) + 1) * EPOCH_BLOCKS - CONSENSUS_BARRIER


def consensus_barrier(local: DataFrame, averages: DataFrame, delay_blocks: int = DELAY_BLOCKS) -> DataFrame:
    """(item, uid, block, value, shared): local values, replaced by averages at the barrier of their epoch.

    ``local`` is a stream (item, uid, block, local), ``averages`` one of (uid, block, average) for the epoch of their
    block. A value waits until the watermark has passed the barrier (and its own block). The average
    is the last one posted by the barrier, the largest of one block; where there is none, or only later ones, the local
    value stays. What is kept of a sender in an epoch is its waiting items and one average,
    and goes when the epoch has passed; a state holds one group of senders and epochs. Null averages count as none,
    rows without a block never come.
    """
    mine = local.filter("item IS NOT NULL AND block IS NOT NULL").select(
        "uid", "block", F.col("item").cast("bigint").alias("item"), F.col("local").cast("double").alias("value"), F.lit(False).alias("posts")
    )
    theirs = averages.filter("average IS NOT NULL AND block IS NOT NULL").select(
        "uid", "block", F.lit(0).cast("bigint").alias("item"), F.col("average").cast("double").alias("value"), F.lit(True).alias("posts")
    )
    both = watermarked(mine.unionByName(theirs), delay_blocks).withColumn("epoch", F.floor(F.col("block") / EPOCH_BLOCKS))
    ms = BLOCK_SECONDS * 1000

    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else ([],) * 8
        posted = {(u, e): (b, v) for u, e, b, v in zip(*kept[:4])}
        waiting = list(zip(*kept[4:]))  # block, item, uid, value
        for pdf in batches:
            columns = [pdf[c].tolist() for c in ("uid", "nobody", "epoch", "block", "item", "value", "posts")]
            for uid, nobody, epoch, block, item, value, posts in zip(*columns):
                uid, missing = None if nobody else uid, pd.isna(value)
                if not posts:
                    waiting.append((block, item, uid, None if missing else value))
                elif not missing and block <= (epoch + 1) * EPOCH_BLOCKS - CONSENSUS_BARRIER:
                    posted[uid, epoch] = max(posted.get((uid, epoch), (block, value)), (block, value))
        passed = state.getCurrentWatermarkMs()
        release = lambda block: max(block, (block // EPOCH_BLOCKS + 1) * EPOCH_BLOCKS - CONSENSUS_BARRIER)
        ready, held = [], []
        for w in waiting:
            (ready if release(w[0]) * ms < passed else held).append(w)
        shared = [posted.get((uid, block // EPOCH_BLOCKS)) for block, _, uid, _ in ready]
        posted = {k: v for k, v in posted.items() if (k[1] + 1) * EPOCH_BLOCKS * ms >= passed}
        if posted or held:
            names = [[k[0] for k in posted], [k[1] for k in posted], [v[0] for v in posted.values()], [v[1] for v in posted.values()]]
            state.update((*names, *[[w[i] for w in held] for i in range(4)]))
            due = [release(w[0]) for w in held] + [(k[1] + 1) * EPOCH_BLOCKS for k in posted]
            state.setTimeoutTimestamp(max(min(due) * ms, passed) + 1)
        else:
            state.remove()
        if ready:
            yield pd.DataFrame(
                {
                    "item": pd.Series([w[1] for w in ready], dtype="Int64"),
                    "uid": pd.Series([w[2] for w in ready], dtype="Int64"),
                    "block": pd.Series([w[0] for w in ready], dtype="Int64"),
                    "value": pd.Series([w[3] if a is None else a[1] for w, a in zip(ready, shared)], dtype="Float64"),
                    "shared": pd.Series([a is not None for a in shared], dtype="boolean"),
                }
            )

    return _grouped(both, "uid", "epoch").groupBy("part").applyInPandasWithState(
        hold,
        "item bigint, uid bigint, block bigint, value double, shared boolean",
        "senders array<bigint>, epochs array<bigint>, posted array<bigint>, averages array<double>, "
        "blocks array<bigint>, items array<bigint>, uids array<bigint>, locals array<double>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; running again with the same checkpoint continues."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def archive_new(root: str, target: str, entity: str, key: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch work: append what the archive does not hold in a version as new.

    The largest ``seq_no`` of a key wins, whichever batch brings it, so the
    archive reads the same for any cut of the stream. Earlier versions stay in
    their batches; nothing is rewritten.
    """
    from sievegrid.operators.ordering import keep_one

    def work(batch: DataFrame, number: int) -> None:
        fresh = keep_one(batch, [key], [F.col("seq_no")], last=True)
        known = read_archive(batch.sparkSession, root, target, entity, key)
        if known is not None:
            # rows a failed attempt of this same batch left behind are not "known"
            held = known.filter(F.col("batch") != number).select(key, F.col("seq_no").alias("_held"))
            fresh = fresh.join(held, key, "left").filter("_held IS NULL OR seq_no > _held").drop("_held")
        append_archive(fresh.withColumn("target", F.lit(target)), root, entity, number)

    return work


def _files(spark: SparkSession, path: str):
    """The file system of a path, and what lies in its folder (nothing if there is none), by name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(system.listStatus(where)) if system.exists(where) else []
    return system, sorted(found, key=lambda f: f.getPath().getName())


class KnownKeys:
    """The keys of an archive, read again only when batches were added to it."""

    def __init__(self, spark: SparkSession, root: str, target: str, entity: str, key: str):
        self.spark, self.path, self.key = spark, f"{root}/entity={entity}/target={target}", key
        self.version: tuple | None = None
        self.frame: DataFrame | None = None
        self.loads = 0

    def current(self) -> DataFrame | None:
        """(key, batch) of everything archived, None without an archive."""
        version = tuple(f.getPath().getName() for f in _files(self.spark, self.path)[1])
        if version != self.version:
            self.version, self.loads = version, self.loads + 1
            self.frame = self.spark.read.parquet(self.path).select(self.key, "batch") if version else None
        return self.frame


def unique_new(stream: DataFrame, key: str, delay_blocks: int = DELAY_BLOCKS) -> DataFrame:
    """Rows (key, block, ...) whose key didn't come within the delay before; the state is one row per key of that time."""
    return watermarked(stream, delay_blocks).dropDuplicatesWithinWatermark([key])


def archive_unseen(known: KnownKeys, root: str, target: str, entity: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch work: append the rows whose key the archive doesn't hold, each key once.

    ``known`` is read again only after an append. Rows that a failed attempt of the same batch left
    behind aren't known.
    """
    from sievegrid.operators.ordering import keep_one

    def work(batch: DataFrame, number: int) -> None:
        fresh = keep_one(batch, [known.key], [F.col("seq_no")])
        held = known.current()
        if held is not None:
            fresh = fresh.join(held.filter(F.col("batch") != number).select(known.key), known.key, "left_anti")
        if not fresh.isEmpty():
            append_archive(fresh.withColumn("target", F.lit(target)), root, entity, number)

    return work


def committed_sink(path: str, before_commit: Callable[[int], None] = lambda number: None) -> Callable[[DataFrame, int], None]:
    """Micro-batch work: write a batch, then enter it in a manifest of finished batches.

    A batch that fails in between is written again whole under its number, and until it is entered no
    reader sees it. ``before_commit`` runs in between.
    """

    def work(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        before_commit(number)
        entry = batch.sparkSession.createDataFrame([(number,)], "finished long")
        entry.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/entry={number}")

    return work


def read_committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all finished batches, each with its ``batch``."""
    empty = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("int"))
    if not _files(spark, f"{path}/manifest")[1]:
        return empty
    finished = spark.read.parquet(f"{path}/manifest").select(F.col("finished").cast("int").alias("batch"))
    data = spark.read.schema(empty.schema).option("basePath", f"{path}/data").parquet(f"{path}/data")
    return data.join(finished, "batch", "left_semi").select(*empty.columns)


def run_resuming(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, restarts: int = 3) -> int:
    """Run to the end, starting again after a failure from what isn't finished; returns the number of failures."""
    failures = 0
    while True:
        try:
            each_batch(stream, work, checkpoint)
            return failures
        except StreamingQueryException:
            failures += 1
            if failures > restarts:
                raise


def write_slices(rows: DataFrame, at: Column, slices: int, disorder: int, path: str, rows_per_slice: int = 1 << 20) -> None:
    """Files of ``rows`` in the order of ``at`` (seconds), shifted by up to ``disorder`` seconds by hash.

    One job writes a file per range of time, at least ``slices`` and about one per ``rows_per_slice`` rows, and the files'
    times are then set in their order, so a file stream sees them in it: rows of neighbouring files
    out of order, but none later than ``disorder``.
    """
    shifted = at + F.pmod(F.xxhash64(*rows.columns), F.lit(disorder))
    number = max(slices, -(-rows.count() // rows_per_slice))
    rows.repartitionByRange(number, shifted).write.parquet(path)
    system, files = _files(rows.sparkSession, path)
    parts = [f for f in files if f.getPath().getName().startswith("part-")]
    last = max((f.getModificationTime() for f in parts), default=0)
    for i, f in enumerate(parts):
        system.setTimes(f.getPath(), last - 1000 * (len(parts) - i), -1)


def stream_folder(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of parquet files as a stream with the schema of what is there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_some(stream: DataFrame, path: str, checkpoint: str, batches: int) -> int:
    """Process at least ``batches`` micro-batches or all there is, stop, and say how many were done."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime="0 seconds")
        .start()
    )
    done = lambda: (query.lastProgress or {"batchId": -1})["batchId"] + 1
    idle = lambda: query.status["message"] == "Waiting for data to arrive"
    while query.isActive and done() < batches and not idle():
        time.sleep(0.05)
    query.stop()
    return done()


def run_and_read(stream: DataFrame, name: str) -> DataFrame:
    """Run to the end into a new folder below the shared one and read the result."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    run_to_end(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
