"""A session: statements, objects and transactions over a catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import errors as E
from .catalog import Catalog, Entity
from .functions import DATE_FORMAT
from .metrics import Metrics
from .operators.process import processed, processor_class, removed
from .plans import syntax as S
from .plans.lower import Lowering, Scope
from .plans.parser import parse
from .sources.shared import kept
from .sources.store import FILE, ROW, Change, Manifest, Store, located, without_ids, without_places
from .streaming import live

MAX_NODES = 64  # fixed value: distributed ids are number * 64 + node


class Session:
    """isolation: "read committed" (each statement sees the newest commit) or "serializable" (all see the first's)."""

    def __init__(self, spark: SparkSession, catalog: Catalog, path: str | None = None, isolation: str = "read committed", node: int = 0, date_format: str = DATE_FORMAT, strict: bool = False):
        if isolation not in ("read committed", "serializable") or not 0 <= node < MAX_NODES:
            raise ValueError("no such isolation or node")
        self.spark, self.catalog, self.isolation, self.node = spark, catalog, isolation, node
        self.date_format, self.strict = date_format, strict
        self.store = Store(spark, path) if path else None
        self.processors: dict[str, type] = {}
        self.aggregates: dict[str, Callable[[Column], Column]] = {}
        #: times of what this session has done on the driver; a stream's are its progress
        self.metrics = Metrics()
        self._clear()

    def _clear(self) -> None:
        #: the manifest that the staged changes stand on, and these
        self.base: Manifest | None = None
        self.staged: dict[str, Change] = {}
        self.last_ids: dict[str, int] = {}
        self.pinned: Manifest | None = None

    # -- reading

    def _manifest(self) -> Manifest:
        if self.isolation == "serializable":
            self.pinned = self.pinned or self.store.newest()
            return self.pinned
        return self.store.newest()

    def entries(self, entity: Entity) -> list[str]:
        if entity.name in self.staged:
            return self.staged[entity.name].entries
        return self._manifest().tables.get(entity.name, [])

    def table(self, entity: Entity | str) -> DataFrame:
        """A table's rows: committed ones, and what this transaction has done."""
        entity = self.catalog[entity] if isinstance(entity, str) else entity
        if entity.path:
            return self.spark.read.schema(entity.schema).parquet(entity.path)
        if not self.store:
            raise E.InvalidTableDescription(f"{entity.name} has no path and the session no store")
        return self.store.read(self.entries(entity), entity.schema)

    def lowering(self) -> Lowering:
        return Lowering(self.catalog, self.table, self.date_format, self.strict, self.aggregates)

    def register_aggregate(self, name: str, build: Callable[[Column], Column]) -> None:
        """An aggregate of this session's batch statements: from a column to an aggregate of it."""
        if name.upper() in S.FUNCTIONS:
            raise ValueError(f"{name} is built in")
        self.aggregates[name.upper()] = build

    def execute(self, text: str):
        """SELECT gives a DataFrame, SELECT STREAM a live.Stream, PROCESS the table's rows after it; COMMIT and ROLLBACK give None."""
        with self.metrics.timed("parse"):
            statement = parse(text, self.strict, self.aggregates)
        with self.metrics.timed(type(statement).__name__.lower()):
            return self._run(statement)

    def _run(self, statement):
        if isinstance(statement, S.Commit):
            return self.commit()
        if isinstance(statement, S.Rollback):
            return self.rollback()
        if isinstance(statement, S.Process):
            return self.process_stream(statement) if statement.stream else self.process(statement)
        if isinstance(statement, S.Combined):
            return self.lowering().combined(statement)
        if statement.stream:
            return live.Stream(self, statement)
        return self.lowering().select(statement)

    def replay(self, text: str) -> DataFrame:
        """What a SELECT STREAM statement gives for the rows so far, in batch form."""
        statement = parse(text, self.strict, self.aggregates)
        if not isinstance(statement, S.Select) or not statement.stream:
            raise E.InvalidSQLStatement("SELECT STREAM was expected")
        return self.lowering().replayed(statement)

    def find(self, entity: str, key: int) -> Row | None:
        e = self.catalog[entity]
        if not e.id:
            raise E.InvalidTableDescription(f"{entity} has no id")
        return self.table(e).where(F.col(e.id) == key).first()

    def content(self, entity: str) -> Iterator[Row]:
        """A table's rows, one after another, a partition at a time."""
        return self.table(entity).toLocalIterator()

    # -- writing

    def _change(self, entity: Entity) -> Change:
        """What this transaction has made of a table so far, to change it further."""
        if entity.path:
            raise E.InvalidTableDescription(f"{entity.name} is read only")
        if self.base is None:
            self.base = self._manifest()
        if entity.name not in self.staged:
            self.staged[entity.name] = Change(tuple(self._manifest().tables.get(entity.name, ())))
        return self.staged[entity.name]

    def _without_ids(self, e: Entity, ids: DataFrame) -> Change:
        change = self._change(e)
        old, new = (without_ids(self.store, e.name, x, e.schema, e.id, ids) for x in (change.old, change.new))
        return Change(old, new)

    def next_ids(self, entity: Entity, n: int) -> list[int]:
        last = max(self.last_ids.get(entity.name, 0), self._manifest().last_ids.get(entity.name, 0))
        self.last_ids[entity.name] = last + n
        drawn = range(last + 1, last + n + 1)
        return [k * MAX_NODES + self.node for k in drawn] if entity.distributed else list(drawn)

    def new_entity(self, entity: str, **values) -> dict:
        """A row of a table, with nulls for what isn't given."""
        names = self.catalog[entity].schema.fieldNames()
        if unknown := set(values) - set(names):
            raise E.InvalidColumnDescription(f"{entity} has no {', '.join(sorted(unknown))}")
        return {n: values.get(n) for n in names}

    def persist(self, entity: str, rows: DataFrame | Iterable[dict]) -> None:
        """Inserts rows; with an id column, a row replaces the one that has its id.

        Of several given dicts with an id the last counts. A DataFrame's rows have no order: of those
        with an id the one counts whose other columns sort last.
        """
        e = self.catalog[entity]
        names = e.schema.fieldNames()
        if not isinstance(rows, DataFrame):
            rows = [dict(r) for r in rows]
            if e.generated:
                without = [r for r in rows if r.get(e.id) is None]
                for r, k in zip(without, self.next_ids(e, len(without))):
                    r[e.id] = k
            if e.id and not e.append_only:
                rows = list({r.get(e.id): r for r in rows}.values())
            rows = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], e.schema)
        elif e.generated:
            raise E.InvalidTableDescription("generated ids are for single rows; give a DataFrame its ids by with_ids()")
        elif e.id and not e.append_only:
            others = F.struct(*[n for n in names if n != e.id])
            # dealt first: a sort of each task's whole input before it would grow with the files
            rows = rows.repartition(F.col(e.id)).groupBy(e.id).agg(F.max(others).alias("_others")).select(*[F.col(e.id) if n == e.id else F.col("_others")[n].alias(n) for n in names])
        with self.metrics.timed("persist"):
            added = self.store.write(e.name, rows.select(*names))  # once: ids are looked up in what has been written
            change = self._change(e)
            if e.id and not e.append_only:
                change = self._without_ids(e, self.store.read([added], e.schema).select(e.id))
            self.staged[e.name] = Change(change.old, (*change.new, added))

    def with_ids(self, entity: str, rows: DataFrame) -> DataFrame:
        """rows with unique ids from this node's numbers, without bringing them together; not dense."""
        e = self.catalog[entity]
        last = max(self.last_ids.get(e.name, 0), self._manifest().last_ids.get(e.name, 0))
        return rows.withColumn(e.id, (F.monotonically_increasing_id() + (last + 1)) * MAX_NODES + self.node)

    def delete(self, entity: str, rows: DataFrame | Iterable[int]) -> None:
        """Removes the rows with these ids (a DataFrame with the id column, or ids)."""
        e = self.catalog[entity]
        if not e.id:
            raise E.InvalidTableDescription(f"{entity} has no id")
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([(k,) for k in rows], f"{e.id} {e.schema[e.id].dataType.simpleString()}")
        ids = rows.select(e.id)
        if e.on_delete:
            for r in self.table(e).join(ids, e.id, "left_semi").toLocalIterator():
                e.on_delete(r.asDict())
        with self.metrics.timed("delete"):
            self.staged[e.name] = self._without_ids(e, ids)

    purge = delete

    def delete_one(self, entity: str, key: int) -> None:
        if self.find(entity, key) is None:
            raise E.CannotAccessToDeletedRecord(f"{entity} has no row {key}")
        self.delete(entity, [key])

    def duplicates(self, entity: str) -> DataFrame:
        """Ids that several rows have: none, unless an append-only table broke its promise."""
        e = self.catalog[entity]
        return self.table(e).groupBy(e.id).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")

    def commit(self) -> None:
        if self.staged:
            self.store.commit(self.base, self.staged, self.last_ids)
        self._clear()

    def rollback(self) -> None:
        for name, change in self.staged.items():
            known = {"/".join(f.split("/")[:2]) for f in self.base.tables.get(name, [])}
            for folder in {"/".join(f.split("/")[:2]) for f in change.entries} - known:
                self.store.folder.remove(folder)
        self._clear()

    # -- PROCESS

    def register_processor(self, name: str, processor: type) -> None:
        self.processors[name] = processor

    def processor(self, name: str) -> type:
        return self.processors.get(name) or processor_class(name)

    @contextmanager
    def locked(self, entity: Entity):
        if self.store and not entity.path:
            if not self.store.lock(entity.name):
                raise E.UnableToLockTableForProcess(entity.name)
            try:
                yield
            finally:
                self.store.unlock(entity.name)
        else:
            yield

    def _parts(self, statement: S.Process):
        scope = Scope(self.catalog, (statement.table,))
        entity = scope.entities[statement.table.alias]
        condition = None
        if statement.where is not None:
            low = self.lowering()

            def find(e):
                column, kind = low.operand(scope, e)
                if isinstance(e, S.Column):
                    return F.col(f"`{scope.find(e.name).name}`"), kind
                return column, kind

            condition = low.condition(statement.where, find)
        return entity, condition, self.processor(statement.processor)

    def process(self, statement: S.Process) -> DataFrame:
        """Runs the processor on every matching row and stages what is left; of a read-only table, only gives it.

        Only files that hold a removed row are written anew.
        """
        entity, condition, processor = self._parts(statement)
        if entity.path:
            return processed(self.table(entity), condition, processor)
        with self.locked(entity):
            change = self._change(entity)
            if change.entries:
                rows = located(self.store, change.entries, entity.schema)
                if condition is not None:
                    rows = rows.where(condition)
                gone = kept(removed(rows, entity.schema.fieldNames(), [FILE, ROW], processor), "removed")
                old, new = (without_places(self.store, entity.name, x, entity.schema, gone) for x in (change.old, change.new))
                self.staged[entity.name] = Change(old, new)
            return self.table(entity)

    def process_stream(self, statement: S.Process, **options):
        entity, condition, processor = self._parts(statement)
        return live.process(self, entity, condition, processor, **options)


def consume(stream, callback: Callable[[dict], None]) -> None:
    """Calls back for each row of a finished or running stream's results so far."""
    for row in stream.results().toLocalIterator():
        callback(row.asDict())
