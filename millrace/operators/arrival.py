"""Row-count windows and runs of equal keys, over rows in arrival order.

Neither has a key to partition by. Rows are dealt by ranges of the sequence and frozen; each
range also gets the few last rows of what comes before it, so that every window and every
comparison with the row before is complete inside one range, and no task holds the table.
Callers select the columns they need first, since all columns are frozen.

Rows of equal sequence values come in the order of their other columns, so that results don't
depend on the deal; nulls come first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..sources.shared import kept

RANGE, PLACE, COPY = "_range", "_place", "_copy"
#: Rows of a block, which one task looks at.
BLOCK = 1 << 16


def dealt(df: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """df dealt by ranges of the sequence columns (RANGE), to be frozen."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *[F.col(f"`{c}`") for c in sequence]).withColumn(RANGE, F.spark_partition_id())


def order_of(df: DataFrame, sequence: Sequence[str]) -> list[Column]:
    """What df's rows are ordered by: the sequence and then the other columns."""
    return [F.col(f"`{c}`") for c in (*sequence, *(f.name for f in df.schema if f.name not in sequence and not isinstance(f.dataType, MapType)))]


def numbered(frozen: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """Frozen ranges with each row's 1-based place in the order of the sequence columns (PLACE)."""
    sizes = frozen.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_n"))
    # one row for each range
    before = sizes.select(RANGE, F.coalesce(F.sum("_n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order_of(frozen.drop(RANGE), sequence)))
    return frozen.join(F.broadcast(before), RANGE).withColumn(PLACE, inside + F.col("_before")).drop("_before")


def few(df: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """The same of so few rows that one task takes them all: nothing is dealt."""
    inside = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order_of(df, sequence)))
    return df.coalesce(1).withColumn(RANGE, F.lit(0)).withColumn(PLACE, inside.cast("long"))


def placed(df: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """df with its 1-based place in the order of the sequence columns (PLACE) and its range (RANGE)."""
    return numbered(kept(dealt(df, sequence), "ranges"), sequence)


def overlapped(rows: DataFrame, behind: int, size: int | None = None) -> DataFrame:
    """Rows in blocks (RANGE, anew) of equal size, each preceded by copies (COPY) of the `behind` rows before it."""
    size = max(behind, size or BLOCK)
    block = F.floor((F.col(PLACE) - 1) / size)
    ahead = F.floor((F.col(PLACE) - 1 + behind) / size)
    blocks = F.when(ahead > block, F.array(block, ahead)).otherwise(F.array(block))
    return rows.drop(RANGE).select("*", F.posexplode(blocks).alias("_k", RANGE)).withColumn(COPY, F.col("_k") > 0).drop("_k")


def row_windows(df: DataFrame, sequence: Sequence[str], n: int, build: Callable[[Window], Sequence[Column]], size: int | None = None) -> DataFrame:
    """A row for each full window of the last n rows; build gives the result columns over a window.

    The first n - 1 rows give none.
    """
    return windows_of(placed(df, sequence), n, build, size)


def windows_of(rows: DataFrame, n: int, build: Callable[[Window], Sequence[Column]], size: int | None = None) -> DataFrame:
    """The same of placed rows."""
    rows = overlapped(rows, n - 1, size)
    window = Window.partitionBy(RANGE).orderBy(PLACE).rowsBetween(1 - n, 0)
    columns = list(build(window))
    full = F.count(F.lit(1)).over(window) == n
    return rows.select(*columns, COPY, full.alias("_full")).where(F.col("_full") & ~F.col(COPY)).drop(COPY, "_full")


RUN = "_run"


def runs(df: DataFrame, sequence: Sequence[str], keys: Sequence[str], size: int | None = None) -> DataFrame:
    """df with the number (RUN, from 1) of each row's run of equal keys. Nulls are equal to each other."""
    return runs_of(placed(df, sequence), keys, size)


def runs_of(rows: DataFrame, keys: Sequence[str], size: int | None = None) -> DataFrame:
    """The same of placed rows."""
    rows = overlapped(rows, 1, size)
    window = Window.partitionBy(RANGE).orderBy(PLACE)
    key = F.struct(*keys)
    new = (F.col(PLACE) == 1) | ~key.eqNullSafe(F.lag(key).over(window))
    flagged = rows.withColumn("_new", new.cast("long")).where(~F.col(COPY))
    # one row for each block
    totals = flagged.groupBy(RANGE).agg(F.sum("_new").alias("_n"))
    before = totals.select(RANGE, F.coalesce(F.sum("_n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    running = F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.join(before, RANGE).withColumn(RUN, running + F.col("_before")).drop("_before", "_new", COPY, RANGE)


def closed_runs(numbered: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """One row for each run that a row of another key has ended, with RUN to order by."""
    grouped = numbered.groupBy(RUN, *keys).agg(*aggregates)
    last = numbered.agg(F.max(RUN).alias("_last"))
    return grouped.join(F.broadcast(last), F.col(RUN) < F.col("_last")).drop("_last")
