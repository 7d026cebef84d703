"""Tables that statements can name: schema, id, sequence, indexes, location."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql.types import StructType

from .errors import InvalidTableDescription


@dataclass(frozen=True)
class Index:
    """Declared order of a table's columns. Results never depend on it: Spark prunes and joins by itself."""

    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class Entity:
    """A table. id: the column that makes persist() an update; sequence: columns of arrival order."""

    name: str
    schema: StructType
    id: str | None = None
    sequence: tuple[str, ...] = ()
    indexes: tuple[Index, ...] = ()
    #: ids are drawn for rows that come without one; with `distributed`, as number * 64 + node
    generated: bool = False
    distributed: bool = False
    #: persist() never looks for rows of the same id
    append_only: bool = False
    #: a Parquet path outside the store, read only
    path: str | None = None
    on_delete: Callable[[dict], None] | None = field(default=None, compare=False)

    def __post_init__(self):
        known = set(self.schema.fieldNames())
        for c in [*([self.id] if self.id else []), *self.sequence, *(c for i in self.indexes for c in i.columns)]:
            if c not in known:
                raise InvalidTableDescription(f"{self.name} has no column {c}")

    @property
    def order(self) -> tuple[str, ...]:
        """Columns of arrival order: the sequence, else the id."""
        return self.sequence or ((self.id,) if self.id else ())


class Catalog:
    def __init__(self, entities: Sequence[Entity] = ()):
        self.entities: dict[str, Entity] = {}
        for e in entities:
            self.register(e)

    def register(self, entity: Entity) -> None:
        if entity.name in self.entities:
            raise InvalidTableDescription(f"{entity.name} is registered already")
        self.entities[entity.name] = entity

    def __getitem__(self, name: str) -> Entity:
        if name not in self.entities:
            raise InvalidTableDescription(f"no table {name}")
        return self.entities[name]

    def __contains__(self, name: str) -> bool:
        return name in self.entities
