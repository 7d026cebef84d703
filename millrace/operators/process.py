"""PROCESS: a user's class looks at every matching row and may remove it."""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MissingWithinClause

BLOCK, BITS = "_block", "_bits"
#: Rows of a block: as many as the bits of Spark's bitmaps.
BLOCK_ROWS = 1 << 15


class EventProcessor(Protocol):
    """Made once for each partition. A row goes if process() is true and delete() is true.

    process() may be called again for a row if a task is retried, so it should be idempotent.
    A row on which it raises stays.
    """

    def process(self, row: dict) -> bool: ...

    def delete(self) -> bool: ...


def processor_class(name: str) -> type:
    module, _, cls = name.rpartition(".")
    try:
        return getattr(importlib.import_module(module), cls)
    except (ImportError, AttributeError, ValueError) as e:
        raise MissingWithinClause(f"no processor {name}") from e


def _removed(batch: pa.RecordBatch, names: list[str], one: EventProcessor) -> pa.Array:
    out = []
    for row in batch.select(names).to_pylist():
        try:
            out.append(bool(one.process(row) and one.delete()))
        except Exception:  # noqa: BLE001  the contract: a row that fails stays
            out.append(False)
    return pa.array(out, pa.bool_())


def survivors(rows: DataFrame, processor: type) -> DataFrame:
    """The rows that the processor doesn't remove, with their types as they were."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = processor()
        for b in batches:
            yield b.filter(pc.invert(_removed(b, names, one)))

    return rows.mapInArrow(run, rows.schema)


def removed(rows: DataFrame, names: list[str], places: list[str], processor: type) -> DataFrame:
    """The places of the rows that the processor removes; it sees the columns `names` only.

    places: the columns with a row's file and its number in it. The result has each file's numbers a block at a
    time (BLOCK_ROWS), as bits, so that what joins it moves no rows; blocks may come in several parts.
    """
    file, number = places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = processor()
        for b in batches:
            gone = b.filter(_removed(b, names, one)).select(places)
            found: dict[tuple[str, int], bytearray] = {}
            for f, k in zip(gone.column(0).to_pylist(), gone.column(1).to_pylist()):
                bits = found.setdefault((f, k // BLOCK_ROWS), bytearray(BLOCK_ROWS // 8))
                bits[k % BLOCK_ROWS // 8] |= 1 << k % 8
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found]), pa.array([k for _, k in found], pa.int64()), pa.array([bytes(v) for v in found.values()], pa.binary())], [file, BLOCK, BITS])

    parts = rows.select(*names, *places).mapInArrow(run, f"{file} string, {BLOCK} long, {BITS} binary")
    return parts.groupBy(file, BLOCK).agg(F.bitmap_or_agg(BITS).alias(BITS))


def is_removed(number: Column) -> Column:
    """Whether the row of this number is among the bits (BITS) of its block."""
    byte = F.substring(F.col(BITS), (number % BLOCK_ROWS / 8).cast("int") + 1, F.lit(1))
    return F.call_function("getbit", F.conv(F.hex(byte), 16, 10).cast("long"), (number % 8).cast("int")) == 1


def processed(rows: DataFrame, matching: Column | None, processor: type) -> DataFrame:
    """The table after the statement: rows that don't match, and matching ones that survive."""
    if matching is None:
        return survivors(rows, processor)
    hit = F.coalesce(matching, F.lit(False))
    return rows.where(~hit).unionByName(survivors(rows.where(hit), processor))
