"""Helpers that the operators share: inputs, intermediate tables, Arrow batches."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import removed, shared_dir

#: Bytes of text that one step of a Python operator holds at a time.
SLICE_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_WRITTEN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


@contextlib.contextmanager
def tracked(paths: list[str]) -> Iterator[None]:
    """Adds to `paths` where stored() writes meanwhile, for removed() later."""
    token = _WRITTEN.set(paths)
    try:
        yield
    finally:
        _WRITTEN.reset(token)


def stored(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Writes df into the shared folder and reads it back: cuts lineage, survives lost executors.

    It stays until the application ends, unless dropped() or removed() before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _WRITTEN.get()) is not None:
        paths.append(path)
    df.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": str(level)}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table of stored() that nothing will read again."""
    removed(df.sparkSession, df.stored_at)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator works on, so that other columns can have any name."""
    return df.select(*[df[n] for n in names])


def reducers(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of text (a longer text stands alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(_byte_lengths(b.column(b.schema.get_field_index(column))))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def _byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; a null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def bytes_of(column: pa.Array, cuts: np.ndarray | None = None) -> list[bytes]:
    """The values of an array of large strings or binaries, whole and without nulls; with cuts, joined between these."""
    if not len(column):
        return [] if cuts is None else [b""] * (len(cuts) - 1)
    _, ends, raw = column.buffers()
    ends = np.frombuffer(ends, np.int64, len(column) + 1)
    ends, raw = (ends if cuts is None else ends[cuts]).tolist(), raw.to_pybytes() if raw else b""
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


#: Parts that a hot key's rows are dealt to in salted_join().
SALTS = 16


def salted_join(many: DataFrame, few: DataFrame, on: list[str], spread: str) -> DataFrame:
    """Inner join of rows whose keys may be hot with one row for each key.

    The rows of a key go to SALTS places, by their `spread` column, and the key's one row to all
    of these. Neither side is broadcast: copies of a row compress so well that a shuffle's size
    says little about them.
    """
    many = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return many.join(few.hint("merge"), [*on, "_salt"]).drop("_salt")


_HELD: dict[str, object] = {}


def held(name: str | None = None, make: Callable[[], object] | None = None):
    """What an operator keeps in a Python worker from task to task, made if need be.

    Workers are reused by other operators; so whatever another one has kept goes first, and
    freed memory goes back to the system.
    """
    for other in [k for k in _HELD if k != name]:
        del _HELD[other]
    trim()
    if name is None:
        return None
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


def trim() -> None:
    """Gives freed memory back to the system."""
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)
