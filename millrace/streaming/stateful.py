"""Row-count windows and runs of a stream, a micro-batch at a time.

A micro-batch is dealt by ranges and frozen as a stored table is (operators.arrival), so it may be
of any size and no task holds it. What a batch leaves to the next one is small: the last n - 1 rows
before a window of n is full, or the totals of the run that is still open.

Rows of equal sequence values in a batch come in the order of their other columns, nulls first;
rows of an earlier batch come before those of a later one, whatever their sequence.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..operators import arrival
from ..operators.arrival import PLACE, RUN

#: The place of a row that an earlier batch has left, from 1; later rows have LATE.
TURN, LATE, LAST = "_turn", 1 << 62, "_last"


def _both(combine: Callable) -> Callable:
    """combine, where None counts as nothing."""
    return lambda a, b: b if a is None else a if b is None else combine(a, b)


def spans(values: list, n: int, combine: Callable) -> list:
    """combine over every n neighbours, at constant work a value.

    Values are cut into blocks of n; a span is the end of one block and the beginning of the next.
    """
    forward, backward = [], []
    for a in range(0, len(values), n):
        block = values[a : a + n]
        forward += accumulate(block, combine)
        backward += [*accumulate(reversed(block), lambda x, y: combine(y, x))][::-1]
    return [forward[i + n - 1] if i % n == 0 else combine(backward[i], forward[i + n - 1]) for i in range(len(values) - n + 1)]


def divided(total, n: int, integral: bool):
    """A mean; of integers truncated toward zero."""
    return abs(total) // n * (1 if total >= 0 else -1) if integral else total / n


def sliding(function: str | None, values: list, n: int, integral: bool) -> list:
    """What RowWindow gives for one column, in plain Python: an aggregate of every n neighbours; None is null. Without a function, the oldest value."""
    if len(values) < n:
        return []
    if function is None:
        return values[: len(values) - n + 1]
    if function == "LAST":
        return values[n - 1 :]
    if function in ("MIN", "MAX"):
        return spans(values, n, _both(min if function == "MIN" else max))
    known = spans([v is not None for v in values], n, lambda a, b: a + b)
    if function == "COUNT":
        return [int(k) for k in known]
    totals = spans(values, n, _both(lambda a, b: a + b))
    if function == "SUM":
        return totals
    return [None if not k else divided(t, k, integral) for t, k in zip(totals, known)]


class Scratch:
    """What a micro-batch has frozen so far; `spark` reads it, with its own settings instead of the stream's."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def frozen(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def placed(self, df: DataFrame, sequence: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """df frozen, and with its rows' places; by one task if it has a block's rows at most."""
        rows = self.frozen(df, "batch")
        if rows.count() <= arrival.BLOCK:
            return rows, arrival.few(rows, sequence)
        return rows, arrival.numbered(self.frozen(arrival.dealt(rows, sequence), "ranges"), sequence)


#: What the batch before has left, read with this schema in this session; None before the first batch.
Left = Callable[[object, StructType], DataFrame] | None


class RowWindow:
    """build: the result columns over a window, as for operators.arrival."""

    def __init__(self, sequence: Sequence[str], n: int, build: Callable[[Window], Sequence[Column]]):
        self.sequence, self.n, self.build = [TURN, *sequence], n, build

    def __call__(self, batch: DataFrame, left: Left, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """A row for each window that the batch completes, and the rows that the next one needs."""
        rows = batch.withColumn(TURN, F.lit(LATE))
        if left:
            rows = left(batch.sparkSession, rows.schema).unionByName(rows)
        rows, placed = scratch.placed(rows, self.sequence)
        order = arrival.order_of(rows, self.sequence)
        last = rows.orderBy(*[c.desc() for c in order]).limit(self.n - 1)
        turned = last.withColumn(TURN, F.row_number().over(Window.orderBy(*order)).cast(LongType()))  # n - 1 rows
        return arrival.windows_of(placed, self.n, self.build), turned


class Runs:
    """A row for each run of equal keys, when a row of another key has ended it; the open run is held back.

    outputs: (result name, function or None, column, integral); without a function, the column is a key.
    """

    def __init__(self, sequence: Sequence[str], keys: Sequence[str], outputs: Sequence[tuple]):
        self.sequence, self.keys, self.outputs = sequence, keys, outputs

    def totals(self) -> dict[str, tuple[Column, Callable[[Column], Column]]]:
        """What is known of a part of a run, and how that of two parts is put together."""
        out = {}
        for k, (_, f, c, _) in enumerate(self.outputs):
            column = F.lit(1) if c is None else F.col(f"`{c}`")
            if f in ("COUNT", "AVG"):
                out[f"_n{k}"] = (F.count(column), F.sum)
            if f in ("SUM", "AVG"):
                out[f"_s{k}"] = (F.sum(column), F.sum)
            if f in ("MIN", "MAX"):
                out[f"_v{k}"] = (F.min(column), F.min) if f == "MIN" else (F.max(column), F.max)
            if f == "LAST":
                out[f"_v{k}"] = (F.max_by(F.struct(column.alias("v")), F.col(PLACE))["v"], lambda v: F.max_by(F.struct(v.alias("v")), F.col("_part"))["v"])
        return out

    def results(self) -> list[Column]:
        out = []
        for k, (name, f, c, whole) in enumerate(self.outputs):
            n, total = F.col(f"_n{k}"), F.col(f"_s{k}")
            mean = F.when(n > 0, F.call_function("div", total, n) if whole else total / n)
            out.append((F.col(f"`{c}`") if f is None else n if f == "COUNT" else total if f == "SUM" else mean if f == "AVG" else F.col(f"_v{k}")).alias(name))
        return out

    def __call__(self, batch: DataFrame, left: Left, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """A row for each run that the batch ends, and the totals of the one it leaves open."""
        totals, keys = self.totals(), [F.col(f"`{k}`") for k in self.keys]
        numbered = arrival.runs_of(scratch.placed(batch, self.sequence)[1], self.keys)
        parts = scratch.frozen(numbered.groupBy(RUN, *keys).agg(*[total.alias(n) for n, (total, _) in totals.items()]), "runs")
        every = parts
        if left:
            # the run that was open goes on if the first one has its key
            first = parts.where(F.col(RUN) == 1).select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(1).cast(LongType()).alias(RUN))
            same = functools.reduce(Column.__and__, [k.eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
            held = left(parts.sparkSession, parts.drop(RUN).schema).join(F.broadcast(first), same, "left").fillna(0, [RUN]).select(*parts.columns)
            both = held.withColumn("_part", F.lit(0)).unionByName(parts.where(F.col(RUN) == 1).withColumn("_part", F.lit(1)))
            merged = both.groupBy(RUN, *keys).agg(*[add(F.col(n)).alias(n) for n, (_, add) in totals.items()])
            every = merged.unionByName(parts.where(F.col(RUN) > 1))
        last = F.broadcast(every.agg(F.max(RUN).alias(LAST)))
        return every.join(last, F.col(RUN) < F.col(LAST)).select(*self.results()), every.join(last, F.col(RUN) == F.col(LAST)).drop(RUN, LAST)
