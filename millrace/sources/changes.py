"""A streaming source of a stored table's commits.

An offset is a commit's number. A query's first batch is what the table holds at the newest
commit; each later one is the new rows of the commits since, so a row that an update has replaced
arrives anew, once, with its new values, and deletions arrive as nothing. Uncommitted, rolled back
and merely rewritten rows are in no manifest's list of new entries, so no query sees them. A batch
is the same when it is read again after a restart, since manifests don't change. Files are
the partitions; they are read as Arrow batches through pyarrow.fs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .store import MANIFESTS, manifest_name

NAME = "millrace-changes"


class DataFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Commits(DataSourceStreamReader):
    def __init__(self, root: str, table: str, schema: StructType):
        self.root, self.table, self.schema = root.rstrip("/"), table, schema
        self.last = -1

    def _open(self, *names: str):
        import pyarrow.fs

        return pyarrow.fs.FileSystem.from_uri("/".join([self.root, *names]))

    def _numbers(self) -> list[int]:
        import pyarrow.fs

        fs, path = self._open(MANIFESTS)
        found = fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
        return sorted(int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".json"))

    def _manifest(self, number: int) -> dict:
        fs, path = self._open(MANIFESTS, manifest_name(number))
        with fs.open_input_file(path) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"commit": -1}

    def latestOffset(self) -> dict:
        numbers = self._numbers()
        if self.last < 0:
            self.last = numbers[-1] if numbers else -1
        else:  # commits of other tables are no news
            self.last = next((n for n in reversed(numbers) if n > self.last and self.table in self._manifest(n)["added"]), self.last)
        return {"commit": self.last}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        import pyarrow.fs

        first, last = start["commit"], end["commit"]
        if last <= first:
            return []
        if first < 0:
            entries = self._manifest(last)["tables"].get(self.table, [])
        else:
            entries = [e for n in range(first + 1, last + 1) for e in self._manifest(n)["added"].get(self.table, [])]
        files = []
        for e in entries:
            fs, path = self._open(e)
            if fs.get_file_info(path).type == pyarrow.fs.FileType.Directory:
                files += [f"{e}/{f.base_name}" for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.base_name.startswith("part-")]
            else:
                files.append(e)
        return [DataFile(f) for f in sorted(files)]

    def read(self, partition: DataFile) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        schema = to_arrow_schema(self.schema)
        fs, path = self._open(partition.path)
        with fs.open_input_file(path) as f:
            file = pq.ParquetFile(f, coerce_int96_timestamp_unit="us")
            for b in file.iter_batches(columns=schema.names):
                table = pa.Table.from_batches([b]).select(schema.names).cast(schema)
                yield from table.to_batches()


class Changes(DataSource):
    """Options: path (the store's folder) and table; the schema is given by the reader."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Commits(self.options["path"], self.options["table"], schema)
