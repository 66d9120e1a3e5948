"""Answers that must not depend on pool sizes, caps, or how a stream is cut into files."""

import pytest
from pyspark.sql import functions as F

from sievegrid.functions.alignment import identity_with
from sievegrid.operators import geometry as G
from sievegrid.operators import ranking as K
from sievegrid.operators import selection as T
from sievegrid.operators import structures as U
from sievegrid.plans import queries_streaming as S
from sievegrid.session import scratch_path
from sievegrid.sources import readers as R
from sievegrid.streaming import epochs as E


@pytest.mark.parametrize("pool", [1, 4, 512])
@pytest.mark.parametrize("buckets", [((10, 40, 2), (20, 30, 8)), ((10, 20, 3), (20, 40, 3))])
def test_selection_with_buckets(spark, pool, buckets):
    import random

    r = random.Random(4)
    rows = [(i, "".join(r.choices("ACDE", k=r.randint(8, 42))), round(r.random(), 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, seq string, quality double")
    k, alpha, filled = 14, 0.4, [0] * len(buckets)
    chosen = [min(rows, key=lambda x: (-x[2], x[0]))]
    similar = {x[0]: identity_with(chosen[0][1])(x[1]) for x in rows}
    left = [x for x in rows if x != chosen[0]]
    while len(chosen) < k and left:
        best = min(left, key=lambda x: (-((1 - alpha) * x[2] + alpha * (1 - similar[x[0]])), x[0]))
        left.remove(best)
        place = [i for i, (low, high, _) in enumerate(buckets) if low <= len(best[1]) < high]
        if place and filled[place[-1]] >= buckets[place[-1]][2]:
            continue
        if place:
            filled[place[-1]] += 1
        chosen.append(best)
        to = identity_with(best[1])
        similar = {x[0]: max(similar[x[0]], to(x[1])) for x in rows}
    got = T.diverse_select(df, "id", "seq", "quality", k, alpha, buckets, pool=pool).orderBy("pick_order").collect()
    assert [x.id for x in got] == [x[0] for x in chosen]


def test_any_number_of_chain_types(spark):
    n = 70
    chains = spark.createDataFrame([(1, i, i, f"t{i:02d}", 5) for i in range(n)], "structure_id long, chain_id long, entity_id long, type string, n long")
    bonded = spark.createDataFrame([], "structure_id long, chain_1 long, chain_2 long")
    got = G.chain_pair_counts(chains, bonded)
    assert got.agg(F.sum("num_pairs")).first()[0] == n * (n - 1) // 2


def test_nearest_atom_at_any_distance(spark):
    kind = "structure_id long, atom_idx long, x double, y double, z double"
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0)], kind)
    b = spark.createDataFrame([(1, 5, 3e5, 4e5, 0.0)], kind)
    got = {r.structure_id: r.distance for r in G.nearest_distance(a, b).collect()}
    assert got == {1: 5e5, 2: float("inf")}


def test_malformed_lines_are_reported(spark, tmp_path):
    path = tmp_path / "local"
    path.write_text("1|a,b|S\n\nnonsense\n2|c|T\n1|d|U\nx|y|z\n")
    got = R.read_local_submissions(spark, str(path), 1000).collect()
    assert {(r.uid, tuple(r.molecules), tuple(r.sequences)) for r in got if r.error is None} == {(1, ("d",), ("U",)), (2, ("c",), ("T",))}
    assert sorted(r.error for r in got if r.error) == ["malformed line: nonsense", "malformed line: x|y|z"]


def test_failing_rows_keep_their_keys(spark):
    def work(pdf):
        if (pdf["k"] == 3).any():
            raise ValueError("three")
        return pdf.assign(n=1)[["k", "n"]]

    got = U.map_with_errors(spark.range(6).toDF("k"), work, "k long, n long", ["k"]).collect()
    assert [(r.k, r.error) for r in got if r.error] == [(3, "ValueError: three")]
    assert sorted(r.k for r in got) == list(range(6))


def test_missing_weight_column_is_an_error(spark):
    df = spark.createDataFrame([("a", 1.0)], "id string, m double")
    with pytest.raises(ValueError, match="absent"):
        K.minmax_weighted_rank(df, "id", {"m": "max"}, {"absent": 1.0})


@pytest.fixture
def commits(spark):
    """Three epochs of commits of five senders, in six files out of order."""
    rows = [(i, i % 5, 1000 + (i * 37) % 1500) for i in range(400)]
    df = spark.createDataFrame(rows, "commit_id long, uid long, block long")
    path = scratch_path(spark, "commits")
    E.write_slices(df, F.col("block") * 12, 6, 1700, path)
    return path


@pytest.mark.parametrize("work", [E.epoch_counts, E.latest_per_epoch, E.rate_gate])
def test_streams_are_the_same_for_any_batches(spark, commits, work):
    one, all_at_once = (
        sorted(map(tuple, E.run_and_read(work(E.stream_folder(spark, commits, n)), "split").collect())) for n in (1, 64)
    )
    assert one == all_at_once and one


def test_archive_is_the_same_for_any_batches(spark):
    path = scratch_path(spark, "rows")
    for i in (2, 0, 3, 1):
        spark.createDataFrame([(f"k{j % 7}", 100 * i + j) for j in range(20)], "key string, seq_no long").coalesce(1).write.mode("append").parquet(path)
    got = []
    for n in (1, 64):
        base = scratch_path(spark, "archive")
        E.each_batch(E.stream_folder(spark, path, n), E.archive_new(base, "T", "molecule", "key"), f"{base}-checkpoint")
        got.append({(r["key"], r["seq_no"]) for r in R.read_archive(spark, base, "T", "molecule", "key").collect()})
    assert got[0] == got[1] == {(f"k{j}", max(300 + x for x in range(20) if x % 7 == j)) for j in range(7)}


def test_a_stopped_stream_goes_on(spark, commits):
    base = scratch_path(spark, "resume")
    stream = E.stream_folder(spark, commits, 1)
    done = E.run_some(stream, f"{base}/out", f"{base}/checkpoint", 2)
    assert done >= 2
    E.run_to_end(stream, f"{base}/out", f"{base}/checkpoint")
    assert sorted(r.commit_id for r in spark.read.parquet(f"{base}/out").collect()) == list(range(400))


def test_disorder_of_the_registered_streams_is_within_the_delay():
    assert S.DISORDER + 12 <= E.DELAY_BLOCKS * 12
    assert S.SLICES >= 5


def resumed(spark, stream, base, fails):
    """Run a stream into a committed sink that fails at the given (batch, attempt)s."""
    attempts = {}

    def break_at(number):
        attempts[number] = attempts.get(number, 0) + 1
        if (number, attempts[number]) in fails:
            raise RuntimeError("injected")

    failures = E.run_resuming(stream, E.committed_sink(base, break_at), f"{base}/checkpoint")
    return failures, E.read_committed(spark, base, stream.schema)


def test_failures_between_write_and_commit_lose_and_repeat_nothing(spark, commits):
    base = scratch_path(spark, "failing")
    stream = E.stream_folder(spark, commits, 1)
    failures, out = resumed(spark, stream, base, {(1, 1), (1, 2), (3, 1)})
    assert failures == 3
    assert sorted(r.commit_id for r in out.collect()) == list(range(400))


def test_an_unfinished_batch_is_not_read(spark, commits):
    base = scratch_path(spark, "unfinished")
    stream = E.stream_folder(spark, commits, 1)

    def always(number):
        if number == 2:
            raise RuntimeError("injected")

    with pytest.raises(E.StreamingQueryException):
        E.run_resuming(stream, E.committed_sink(base, always), f"{base}/checkpoint", restarts=1)
    assert {r.batch for r in E.read_committed(spark, base, stream.schema).select("batch").distinct().collect()} == {0, 1}


def test_streams_of_an_empty_table_end(spark):
    path, base = scratch_path(spark, "none"), scratch_path(spark, "none-out")
    E.write_slices(spark.createDataFrame([], "commit_id long, uid long, block long"), F.col("block") * 12, 6, 1700, path)
    stream = E.stream_folder(spark, path, 1)
    E.run_some(stream, f"{base}/out", f"{base}/checkpoint", 2)
    _, out = resumed(spark, stream, f"{base}/sink", set())
    assert out.count() == 0
    assert E.run_and_read(E.epoch_counts(stream), "none-counts").count() == 0


def test_barrier_holds_values_until_it_has_passed(spark, commits):
    """Averages on time replace local values, late ones and null ones don't; any cut gives the same rows."""
    got = []
    for n in (1, 64):
        rows = E.stream_folder(spark, commits, n)
        local = rows.filter("commit_id % 4 <> 0").select(F.col("commit_id").alias("item"), "uid", "block", (F.col("block") / 2).alias("local"))
        value = F.when(F.col("commit_id") % 8 == 0, F.col("commit_id") * 1.0)
        out = E.run_and_read(E.consensus_barrier(local, rows.filter("commit_id % 4 = 0").select("uid", "block", value.alias("average"))), "barrier")
        got.append(sorted(map(tuple, out.collect())))
    plain = [(i, i % 5, 1000 + (i * 37) % 1500) for i in range(400)]
    last = max(b for _, _, b in plain) * 12 - 1800
    want = []
    for i, uid, block in plain:
        barrier = (block // 361 + 1) * 361 - 100
        if i % 4 and max(block, barrier) * 12 < last:
            posted = [(b, float(j)) for j, u, b in plain if j % 8 == 0 and u == uid and b // 361 == block // 361 and b <= barrier]
            want.append((i, uid, block, max(posted)[1] if posted else block / 2, bool(posted)))
    assert got[0] == got[1] == sorted(want) and {w[4] for w in want} == {True, False}


def test_each_key_is_archived_once_for_any_batches(spark, commits):
    for n in (1, 64):
        base = scratch_path(spark, "unseen")
        rows = E.stream_folder(spark, commits, n).select(F.concat(F.lit("k"), F.col("commit_id") % 37).alias("key"), F.col("commit_id").alias("seq_no"), "block")
        known = E.KnownKeys(spark, base, "T", "molecule", "key")
        E.each_batch(E.unique_new(rows, "key"), E.archive_unseen(known, base, "T", "molecule"), f"{base}-checkpoint")
        assert sorted(r.key for r in known.current().collect()) == sorted(f"k{i}" for i in range(37))
        loads = known.loads
        known.current()
        assert known.loads == loads


def test_slices_are_in_order_within_the_disorder(spark):
    path = scratch_path(spark, "slices")
    E.write_slices(spark.range(5000).withColumnRenamed("id", "t"), F.col("t") * 10, 4, 300, path, rows_per_slice=500)
    files = [f for f in E._files(spark, path)[1] if f.getPath().getName().startswith("part-")]
    assert len(files) == 10
    files.sort(key=lambda f: f.getModificationTime())
    highest = -1
    for f in files:
        times = [r.t * 10 for r in spark.read.parquet(str(f.getPath())).collect()]
        assert min(times) >= highest - 300
        highest = max(highest, max(times))


def test_a_call_of_the_state_functions_serves_many_senders(spark, commits):
    """Calls of Python cost more than rows: there are as many as groups of keys, not as keys, in a batch."""
    rows = E.stream_folder(spark, commits, 64)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    local = rows.select(F.col("commit_id").alias("item"), "uid", "block", F.lit(1.0).alias("local"))
    posted = rows.select("uid", "block", F.lit(2.0).alias("average"))
    for work in (E.rate_gate(rows), E.consensus_barrier(local, posted)):
        state = next(line for line in plan(work).splitlines() if "FlatMapGroupsInPandasWithState" in line)
        assert "[part#" in state.replace("[[", "[")


def test_senders_without_a_name_share_one_gate(spark):
    path = scratch_path(spark, "nameless")
    rows = [(None, 1000), (0, 1001), (None, 1010), (None, 1060), (0, 1062), (5, 3000)]
    spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "commit_id long, uid long, block long").coalesce(1).write.parquet(path)
    got = E.run_and_read(E.rate_gate(E.stream_folder(spark, path, 1)), "nameless").collect()
    assert {(r.uid, r.block) for r in got} == {(None, 1000), (None, 1060), (0, 1001), (0, 1062)}
