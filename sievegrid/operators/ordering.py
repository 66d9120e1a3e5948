"""Row numbers, ranks, lags and running sums that never gather a group in one task.

A plain ``Window.partitionBy(key)`` puts all rows of a key in one task and a
window without keys puts the whole table there. Here rows are range-partitioned
on (group, order, tie-breaker) so that even a group with a third of all rows is
spread evenly. Each range is windowed on its own, and what a range needs from
the ranges before it comes from a boundary table with one row per
(range, group). Only groups that cross a range border need it: at most two per
range, so the broadcast is bounded by the number of shuffle partitions.

The ranged rows are checkpointed once: boundaries and rows then always agree,
even when an executor is lost in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.session import durable

RANGE = "_range"
ROWS = 1 << 18  # rows of a range, about, where their number is known


def _name(key: str) -> str:
    return key[1:] if key.startswith("-") else key


def sort_columns(order: Sequence[str]) -> list[Column]:
    """``"x"`` sorts ascending, ``"-x"`` descending."""
    return [F.col(_name(o)).desc() if o.startswith("-") else F.col(o).asc() for o in order]


class RangeOrdered:
    """``df`` laid out by (by..., order...) in balanced ranges.

    ``by``     group columns (may be empty: one global order)
    ``order``  sort columns, ``"-x"`` for descending
    ``tie``    columns that make the sort total, so that equal order values
               are spread over ranges; ranks ignore them
    ``rows``   how many rows there are, if known: ranges then hold ``ROWS`` of them, and a task a few
               ranges, however many rows there are; else both follow Spark's number of shuffle partitions
    """

    def __init__(
        self,
        df: DataFrame,
        by: Sequence[str],
        order: Sequence[str],
        tie: Sequence[str] = (),
        rows: int | None = None,
    ):
        self.by = list(by)
        self.order_names = list(order)
        self.order = sort_columns(order)
        self.tie = sort_columns(tie)
        self.columns = df.columns
        cores = df.sparkSession.sparkContext.defaultParallelism
        number = [] if rows is None else [max(cores, -(-rows // ROWS))]
        ranged = df.repartitionByRange(*number, *[F.col(c) for c in self.by], *self.order, *self.tie)
        self._ranged = ranged.withColumn(RANGE, F.spark_partition_id())
        if number:  # the windows deal the ranges out again: to as many tasks, or a task would hold more as the rows grow
            self._ranged = self._ranged.repartition(*number, RANGE, *self.by)

    # windows -----------------------------------------------------------
    def _local(self, total: bool = True):
        keys = self.order + (self.tie if total else [])
        return Window.partitionBy(RANGE, *self.by).orderBy(*keys)

    def _attach(self, rows: DataFrame, borders: DataFrame) -> DataFrame:
        """Left-join the (range, group) carry-over onto the rows."""
        right = borders.select(
            F.col(RANGE).alias("_b_range"),
            *[F.col(c).alias(f"_b_{c}") for c in self.by],
            *[c for c in borders.columns if c.startswith("_carry")],
        )
        condition = F.col(RANGE) == F.col("_b_range")
        for c in self.by:
            condition = condition & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        joined = rows.join(F.broadcast(right), condition, "left")
        return joined.drop("_b_range", *[f"_b_{c}" for c in self.by])

    def _crossing(self, borders: DataFrame) -> DataFrame:
        """Keep groups that lie in more than one range (at most two per range)."""
        group = Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(1))
        return borders.withColumn("_n", F.count(F.lit(1)).over(group)).filter("_n > 1").drop("_n")

    def _before(self, inclusive: bool = False):
        group = Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(1))
        return group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    def _after(self):
        group = Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(1))
        return group.orderBy(RANGE).rowsBetween(1, Window.unboundedFollowing)

    # operations ----------------------------------------------------------
    def row_number(self, name: str = "row_number") -> DataFrame:
        """1-based position in the group."""
        rows = durable(
            self._ranged.withColumn("_local", F.row_number().over(self._local()))
        )
        borders = rows.groupBy(RANGE, *self.by).agg(F.count(F.lit(1)).alias("_size"))
        borders = self._crossing(borders).withColumn(
            "_carry", F.sum("_size").over(self._before())
        )
        out = self._attach(rows, borders)
        return out.select(
            *self.columns, (F.col("_local") + F.coalesce("_carry", F.lit(0))).alias(name)
        )

    def running_sum(self, value: str, name: str = "running_sum") -> DataFrame:
        """Inclusive running sum of ``value`` in the group."""
        return self.running_sums({name: F.col(value)})

    def running_sums(self, values: dict[str, Column]) -> DataFrame:
        """Inclusive running sums of several expressions, in one pass."""
        frame = self._local().rowsBetween(Window.unboundedPreceding, 0)
        names = list(values)
        local = {f"_local{i}": F.sum(values[n]).over(frame) for i, n in enumerate(names)}
        rows = durable(self._ranged.withColumns(local))
        borders = rows.groupBy(RANGE, *self.by).agg(
            *[F.sum(values[n]).alias(f"_size{i}") for i, n in enumerate(names)]
        )
        borders = self._crossing(borders).withColumns(
            {f"_carry{i}": F.sum(f"_size{i}").over(self._before()) for i in range(len(names))}
        )
        out = self._attach(rows, borders)
        total = lambda i: F.col(f"_local{i}") + F.coalesce(f"_carry{i}", F.lit(0))
        return out.select(*self.columns, *[total(i).alias(n) for i, n in enumerate(names)])

    def lag(self, values: Sequence[str], prefix: str = "prev_") -> DataFrame:
        """Values of the row before, null for the first row of a group."""
        here = F.struct(*[F.col(v) for v in values])
        rows = durable(
            self._ranged.withColumns(
                {
                    "_prev": F.lag(here).over(self._local()),
                    "_local": F.row_number().over(self._local()),
                }
            )
        )
        borders = rows.groupBy(RANGE, *self.by).agg(
            F.max_by(here, F.col("_local")).alias("_last")
        )
        borders = self._crossing(borders).withColumn(
            "_carry", F.last("_last").over(self._before())
        )
        out = self._attach(rows, borders)
        previous = F.when(F.col("_local") == 1, F.col("_carry")).otherwise(F.col("_prev"))
        out = out.withColumn("_previous", previous)
        return out.select(
            *self.columns, *[F.col(f"_previous.{v}").alias(f"{prefix}{v}") for v in values]
        )

    def rank(self, method: str = "min", name: str = "rank", number: str | None = None) -> DataFrame:
        """``min`` (competition), ``dense`` or ``average`` rank of the order columns.

        ``number`` adds the row number in the total order under that name, from
        the same sort.
        """
        key = F.struct(*[F.col(_name(o)).alias(f"k{i}") for i, o in enumerate(self.order_names)])
        ties = self._local(total=False)
        rows = durable(
            self._ranged.withColumns(
                {
                    "_key": key,
                    "_local": F.row_number().over(ties),
                    "_first": F.rank().over(ties),
                    "_dense": F.dense_rank().over(ties),
                    "_last": F.count(F.lit(1)).over(ties),  # range frame: ties included
                    **({"_place": F.row_number().over(self._local())} if number else {}),
                }
            )
        )
        borders = rows.groupBy(RANGE, *self.by).agg(
            F.count(F.lit(1)).alias("_size"),
            F.max("_dense").alias("_kinds"),
            F.min_by("_key", "_local").alias("_head"),
            F.max_by("_key", "_local").alias("_tail"),
            F.max("_first").alias("_tail_first"),
            F.min("_last").alias("_head_size"),
        )
        crossing = self._crossing(borders)
        group = Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(1))
        step = group.orderBy(RANGE)
        crossing = crossing.withColumns(
            {
                "_offset": F.coalesce(F.sum("_size").over(self._before()), F.lit(0)),
                "_joins_prev": F.coalesce(
                    F.col("_head").eqNullSafe(F.lag("_tail").over(step))
                    & (F.lag("_size").over(step).isNotNull()),
                    F.lit(False),
                ),
                "_joins_next": F.coalesce(
                    F.col("_tail").eqNullSafe(F.lead("_head").over(step))
                    & (F.lead("_size").over(step).isNotNull()),
                    F.lit(False),
                ),
            }
        )
        through_prev = (F.col("_kinds") == 1) & F.col("_joins_prev")
        through_next = (F.col("_kinds") == 1) & F.col("_joins_next")
        crossing = crossing.withColumns(
            {
                # where the last key of this range starts, unless it started earlier
                "_tail_start": F.when(~through_prev, F.col("_offset") + F.col("_tail_first")),
                # where the first key of this range ends, unless it goes on
                "_head_end": F.when(~through_next, F.col("_offset") + F.col("_head_size")),
                "_new_kinds": F.col("_kinds") - F.col("_joins_prev").cast("int"),
            }
        )
        crossing = crossing.withColumns(
            {
                "_carry_offset": F.col("_offset"),
                "_carry_kinds": F.coalesce(F.sum("_new_kinds").over(self._before()), F.lit(0))
                - F.col("_joins_prev").cast("int"),
                "_carry_start": F.when(
                    F.col("_joins_prev"),
                    F.last("_tail_start", ignorenulls=True).over(self._before()),
                ),
                "_carry_end": F.when(
                    F.col("_joins_next"),
                    F.first("_head_end", ignorenulls=True).over(self._after()),
                ),
                "_carry_tail": F.col("_kinds"),
            }
        )
        offset = F.coalesce("_carry_offset", F.lit(0))
        start = F.when(
            (F.col("_dense") == 1) & F.col("_carry_start").isNotNull(), F.col("_carry_start")
        ).otherwise(offset + F.col("_first"))
        if method == "dense":
            value = F.col("_dense") + F.coalesce("_carry_kinds", F.lit(0))
        elif method == "min":
            value = start
        elif method == "average":
            end = F.when(
                (F.col("_dense") == F.col("_carry_tail")) & F.col("_carry_end").isNotNull(),
                F.col("_carry_end"),
            ).otherwise(offset + F.col("_last"))
            value = (start + end) / F.lit(2.0)
        else:
            raise ValueError(f"unknown rank method: {method}")
        out = self._attach(rows, crossing)
        extra = [(offset + F.col("_place")).alias(number)] if number else []
        return out.select(*self.columns, value.alias(name), *extra)


def global_row_number(
    df: DataFrame, order: Sequence[str], name: str = "row_number"
) -> DataFrame:
    """1-based position in one total order: a range sort and a per-range offset.

    ``order`` must be total (end it with a key) so that ranges stay balanced.
    """
    keys = sort_columns(order)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = durable(placed.withColumn("_place", F.monotonically_increasing_id()))
    mask = (1 << 33) - 1
    placed = placed.withColumns(
        {
            RANGE: F.shiftright("_place", 33),
            "_local": F.col("_place").bitwiseAND(F.lit(mask)),
        }
    )
    sizes = placed.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(1)).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        RANGE, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    out = placed.join(F.broadcast(offsets), RANGE)
    return out.select(*df.columns, (F.col("_local") + F.col("_offset") + 1).alias(name))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """One whole row per key, the first (or last) by ``order``: a partial aggregate, no window."""
    payload = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    pick = F.max_by(payload, rank) if last else F.min_by(payload, rank)
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        pick.alias("_row")
    ).select("_row.*")
