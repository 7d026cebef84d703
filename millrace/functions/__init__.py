"""Column builders of the dialect's functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType

#: Fixed value: the date format of literals and of TO_DATE, if a session names no other.
DATE_FORMAT = "dd.MM.yyyy"


def is_integral(kind: DataType) -> bool:
    return isinstance(kind, (ByteType, ShortType, IntegerType, LongType))


def aggregate(function: str, column: Column | None, kind: DataType | None, order: Column | None = None) -> Column:
    """COUNT SUM MIN MAX AVG LAST of a column; COUNT of None counts rows.

    COUNT skips nulls. AVG of integers truncates toward zero. LAST is the value of the row that
    arrived last, by `order`; nulls count as values.
    """
    if function == "COUNT":
        return F.count(F.lit(1)) if column is None else F.count(column)
    if function == "SUM":
        return F.sum(column)
    if function == "AVG":
        return F.call_function("div", F.sum(column), F.count(column)) if is_integral(kind) else F.avg(column)
    if function in ("MIN", "MAX"):
        return (F.min if function == "MIN" else F.max)(column)
    if function == "LAST":
        return F.max_by(F.struct(column.alias("v")), order)["v"]
    raise ValueError(function)


def windowed(function: str, column: Column | None, kind: DataType | None, window) -> Column:
    """The same over a window of rows in arrival order."""
    if function == "LAST":
        return F.last(column).over(window)
    if function == "AVG" and is_integral(kind):
        return F.call_function("div", F.sum(column).over(window), F.count(column).over(window))
    return aggregate(function, column, kind).over(window)


def scalar(function: str, column: Column, date_format: str = DATE_FORMAT) -> Column:
    """TO_NUMBER TO_CHAR TO_DATE; what can't be converted is null."""
    if function == "TO_NUMBER":
        return column.try_cast("double")
    if function == "TO_CHAR":
        return column.cast("string")
    if function == "TO_DATE":
        return F.try_to_timestamp(column, F.lit(date_format)).cast("timestamp_ntz")
    raise ValueError(function)
