"""SELECT STREAM and PROCESS STREAM on Structured Streaming.

The Parquet files of a table outside the store are its append log: existing files are read first,
then new ones, in the order of their modification times, one a micro-batch. A stored table is
followed by its commits (sources.changes): first the rows that it holds, then each commit's new
rows; nothing else is ever seen. Progress and state are in the checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .. import errors as E
from ..catalog import Entity
from ..functions import is_integral
from ..operators.process import survivors
from ..plans import syntax as S
from ..plans.lower import MARK, Scope
from ..sources.changes import NAME as CHANGES
from ..sources.changes import Changes
from ..sources.shared import removed, shared_dir
from ..sources.store import Folder
from .stateful import RowWindow, Runs, Scratch


def source(session, entity: Entity, path: str | None = None, files_each: int = 1) -> DataFrame:
    """A table's append log: `path` or the entity's own folder, or else its commits."""
    reader = session.spark.readStream.schema(entity.schema)
    where = path or entity.path
    if not where:
        session.spark.dataSource.register(Changes)
        return reader.format(CHANGES).option("path", session.store.folder.path).option("table", entity.name).load()
    # as a pattern, the path may be a file as well as a folder
    head, _, name = where.rstrip("/").rpartition("/")
    where = where if "*" in where else f"{head}/[{name[0]}]{name[1:]}"
    return reader.option("maxFilesPerTrigger", files_each).parquet(where)


class Stream:
    """A continuous query; start it with a sink of the given kind.

    The first table is followed; others are joined to it as they are when the query starts.
    """

    def __init__(self, session, statement: S.Select):
        if statement.order or statement.limit is not None or statement.offset or statement.distinct or statement.having is not None:
            raise E.InvalidSQLStatement("a stream has no ORDER BY, LIMIT, OFFSET, DISTINCT or HAVING")
        if len(statement.tables) > 1 and (statement.group or statement.window):
            raise E.InvalidSQLStatement("a grouped stream takes one table")
        if any(t.select for t in statement.tables):
            raise E.InvalidSQLStatement("a stream has no inline views")
        self.session, self.statement = session, statement
        self.scope = Scope(session.catalog, statement.tables)
        self.query = self.output = self.schema = None
        #: what makes windows or runs of each micro-batch's rows
        self.operator: RowWindow | Runs | None = None
        self.name = f"stream_{uuid.uuid4().hex}"

    def frame(self, path: str | None = None, files_each: int = 1) -> DataFrame:
        """The streaming DataFrame of results, or of the rows that windows and runs are made of."""
        s, scope = self.statement, self.scope
        alias = s.tables[0].alias
        low = self.session.lowering()
        items = low.checked(scope, s)
        low.read = lambda entity: source(self.session, entity, path, files_each) if entity is scope.entities[alias] else self.session.table(entity)
        rows = low.joined(scope, s.where)
        if not s.window and not s.group:
            if any(low.is_call(i) for i in items):
                raise E.InvalidGroupColumnSet("an aggregate of a stream needs GROUP BY or WINDOW BY")
            out = rows.select(*[low.plain(scope, i) for i in items])
            self.schema = out.schema
            return out
        outputs, fields = [], []
        for i in items:
            e = i.expression
            call = low.is_call(i)
            if isinstance(e, S.Call) and not call:
                raise E.InvalidColumnDescription("a grouped stream has no scalar functions")
            star = call and isinstance(e.argument, S.Star)
            if call and e.function not in S.AGGREGATES:
                raise E.InvalidColumnDescription("a stream has the built-in aggregates only")
            found = None if star else scope.find(e.argument.name if call else e.name)
            outputs.append((i.name, e.function if call else None, None if star else f"{found.alias}{MARK}{found.name}", not star and is_integral(found.kind)))
            kind = LongType() if star or call and e.function == "COUNT" else found.kind
            if call and e.function in ("SUM", "AVG"):
                kind = LongType() if is_integral(found.kind) else DoubleType()
            fields.append(StructField(i.name, kind))
        sequence, self.schema = scope.sequence(alias), StructType(fields)
        keys = [f"{k.alias}{MARK}{k.name}" for k in (scope.find(c.name) for c in s.group)]
        self.operator = RowWindow(sequence, s.window[1], low.over(scope, items)) if s.window else Runs(sequence, keys, outputs)
        used = {*keys, *(o[2] for o in outputs if o[2])} - {*sequence}
        return rows.select(*[F.col(f"`{c}`") for c in (*sequence, *sorted(used))])

    def follow(self, checkpoint: str, give) -> Callable[[DataFrame, int], None]:
        """What is done with a micro-batch: its results are given and what it leaves is kept beside the checkpoint, by its number.

        A batch that is repeated after a failure finds what the one before it has left, as at first.
        """
        spark, kept = self.session.spark, Folder(self.session.spark, f"{checkpoint}/left")

        def each(df: DataFrame, number: int) -> None:
            before = sorted(n for n in map(int, kept.names()) if n < number)
            if number and not before:
                raise E.InvalidSQLStatement("the checkpoint is of another kind of query")
            left = (lambda session, schema: session.read.schema(schema).parquet(f"{kept.path}/{before[-1]}")) if before else None
            scratch = Scratch(spark, f"{shared_dir(spark)}/{self.name}/batch-{uuid.uuid4().hex}")
            results, rest = self.operator(df, left, scratch)
            rest.write.mode("overwrite").parquet(f"{kept.path}/{number}")
            give(results.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema]), number)
            removed(spark, scratch.path)
            for n in before[:-1]:
                kept.remove(str(n))

        return each

    def appender(self) -> Callable[[DataFrame, int], None]:
        """Appends a batch's results to the output as Spark's own sink of files does: each number once, and wholly or not at all."""
        spark = self.session.spark
        jvm = spark._jvm
        sink = jvm.org.apache.spark.sql.execution.streaming.sinks.FileStreamSink(spark._jsparkSession, self.output, jvm.org.apache.spark.sql.execution.datasources.parquet.ParquetFileFormat(), jvm.PythonUtils.toSeq([]), jvm.PythonUtils.toScalaMap({}))
        return lambda df, number: sink.addBatch(number, df._jdf)

    def start(self, path: str | None = None, files_each: int = 1, sink: str = "parquet", output: str | None = None, checkpoint: str | None = None, once: bool = False, each_batch=None):
        """Starts the query. sink: parquet (into `output`, or else a folder of its own), memory (in the driver; windows and runs as with parquet) or foreach (each_batch(df, number))."""
        frame, shared = self.frame(path, files_each), shared_dir(self.session.spark)
        checkpoint = checkpoint or f"{shared}/{self.name}/checkpoint"
        writer = frame.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        if once:
            writer = writer.trigger(availableNow=True)
        if sink == "foreach":
            writer = writer.foreachBatch(self.follow(checkpoint, each_batch) if self.operator else each_batch)
        elif self.operator:
            if sink not in ("parquet", "memory"):
                raise E.InvalidSQLStatement(f"windows and runs of a stream don't go to {sink}")
            self.output = output or f"{shared}/{self.name}/rows"
            writer = writer.foreachBatch(self.follow(checkpoint, self.appender()))
        elif sink == "memory":
            writer = writer.format("memory").queryName(self.name)
        else:
            self.output = output or f"{shared}/{self.name}/rows"
            writer = writer.format(sink).option("path", self.output)
        self.query = writer.start()
        if once:
            self.query.awaitTermination()
        return self

    def results(self) -> DataFrame:
        """Rows so far, of a query with a parquet or memory sink."""
        spark = self.session.spark
        if self.query.isActive:
            self.query.processAllAvailable()
        if self.output is None:
            return spark.table(self.name)
        written = Folder(spark, self.output).names("_spark_metadata")
        return spark.read.schema(self.schema).parquet(self.output) if written else spark.createDataFrame([], self.schema)

    @property
    def progress(self) -> list[dict]:
        """Rows, durations and state sizes of the latest micro-batches."""
        return [dict(p) for p in self.query.recentProgress]

    def stop(self) -> None:
        if self.query:
            self.query.stop()


def process(session, entity: Entity, condition, processor: type, path: str | None = None, output: str | None = None, checkpoint: str | None = None, files_each: int = 1, once: bool = False):
    """Runs a processor on existing rows and then on new ones; with output, survivors are appended there, by batch."""
    rows = source(session, entity, path, files_each)
    if condition is not None:
        rows = rows.where(condition)

    def each(df: DataFrame, number: int) -> None:
        left = survivors(df, processor)
        if output:
            left.write.mode("overwrite").parquet(f"{output}/batch={number}")  # a repeated batch replaces itself
        else:
            left.write.format("noop").mode("overwrite").save()

    writer = rows.writeStream.option("checkpointLocation", checkpoint or f"{shared_dir(session.spark)}/process_{uuid.uuid4().hex}").foreachBatch(each)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query
