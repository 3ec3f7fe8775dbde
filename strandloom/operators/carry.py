"""Running totals along a coordinate without one task per group: windows inside blocks of positions, then a carry over
one summary row a block. A group (a chromosome) is spread over as many tasks as it has blocks.

Carries are merged with the rows, which are sorted by block already: many short groups have as many carries as half their rows, and by
their size on disk Spark would send them to all tasks by way of the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandloom.storage import settled

#: Positions in a block. At a row a position and chromosome-sized groups a block's rows sort in one task.
BLOCK = 5_000_000

_FOLD = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def running(df: DataFrame, by: Sequence[str], pos: str, order: Sequence[str | Column], values: dict[str, tuple[str, Column]], inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Add, for each ``name: (max|min|sum|count, column)``, the fold over all earlier rows of the group (and this one if
    ``inclusive``). ``order`` must begin with ``pos``. Rows with null group or position keys are not joined and drop out."""
    keyed = df.withColumn("_blk", F.floor(F.col(pos) / block))
    for name, (_, column) in values.items():
        keyed = keyed.withColumn(f"_v_{name}", column)
    w = Window.partitionBy(*by, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    summary = keyed.groupBy(*by, "_blk").agg(*[_FOLD[how](f"_v_{name}").alias(f"_s_{name}") for name, (how, _) in values.items()])
    carried = summary.select(*by, "_blk", *[(F.sum if how == "count" else _FOLD[how])(f"_s_{name}").over(before).alias(f"_c_{name}") for name, (how, _) in values.items()])
    out = keyed.select("*", *[_FOLD[how](f"_v_{name}").over(w).alias(f"_l_{name}") for name, (how, _) in values.items()]).join(carried.hint("merge"), [*by, "_blk"])
    for name, (how, _) in values.items():
        local, carry = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        both = {"max": F.greatest(local, carry), "min": F.least(local, carry)}.get(how, F.when(local.isNull() & carry.isNull(), None).otherwise(F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))))
        out = out.withColumn(name, both)
    return out.drop("_blk", *[f"_{p}_{name}" for name in values for p in "vslc"])


def previous(df: DataFrame, by: Sequence[str], pos: str, order: Sequence[str | Column], columns: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Add ``new: old`` columns holding the value of ``old`` in the row before (lag), across block borders."""
    keyed = df.withColumn("_blk", F.floor(F.col(pos) / block))
    w = Window.partitionBy(*by, "_blk").orderBy(*order)
    packed = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    if all(isinstance(c, str) for c in order):  # the block's last row by an aggregate: no second sort
        last = keyed.groupBy(*by, "_blk").agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    else:
        backward = Window.partitionBy(*by, "_blk").orderBy(*[c.desc() if isinstance(c, Column) else F.desc(c) for c in order])
        last = keyed.withColumn("_n", F.row_number().over(backward)).where("_n = 1").select(*by, "_blk", packed.alias("_tail"))
    tails = last.withColumn("_carry", F.lag("_tail").over(Window.partitionBy(*by).orderBy("_blk"))).drop("_tail")
    out = keyed.withColumn("_prev", F.lag(packed).over(w)).join(tails.hint("merge"), [*by, "_blk"])
    both = F.coalesce("_prev", "_carry")
    for new in columns:
        out = out.withColumn(new, both[new])
    return out.drop("_blk", "_prev", "_carry")


def numbered(df: DataFrame, order: Sequence[str], name: str = "number", label: str = "numbered") -> DataFrame:
    """Add the row's place, from 0, in the order of ``order`` over the whole table (which should tell rows apart). Rows are dealt
    by ranges, sorted and written; a row's place is that in its range and the sizes of the ranges before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = settled(ranged, label).withColumn("_range", F.shiftright("_at", 33))
    sizes = at.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row a range
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return at.join(F.broadcast(before), "_range").select(*df.columns, place.alias(name))


def work_parts(spark: SparkSession, rows: int = 0) -> int:
    """Partitions of a step whose work is large for its bytes: a few a core, and one a million rows. They are given by hand, as Spark
    would merge small ones by their bytes into a single task."""
    return max(3 * spark.sparkContext.defaultParallelism, rows >> 20)
