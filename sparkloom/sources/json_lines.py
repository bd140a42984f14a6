"""JSON lines as a data source of its own, in Python: byte splits, pushed filters, and a stream of new files.

    spark.dataSource.register(JsonLines)
    spark.read.format("json_lines").schema(schema).option("path", folder).load()
    spark.readStream.format("json_lines").schema(schema).option("path", folder).load()

Files are opened through ``pyarrow.fs``, so a folder may be in any store that it knows (``file``,
``hdfs``, ``s3``). Options: ``path``; ``splitBytes`` (default 32 MiB), the size of a partition;
``maxFilesPerTrigger`` (default: all), most new files in a batch of a stream. Spark can't ask a Python source for
its end apart from its next batch, so a stream with this limit needs a trigger that goes on (``windows.run_limited_to_files``):
``availableNow`` would end after the first batch.

A split holds the lines that begin in it, so a line that crosses a bound is read once. Filters of the
form column ``=  <  <=  >  >=  IN  IS NULL  IS NOT NULL`` value are tested before a row is made; Spark is
told so and does not test them again. A stream's offset is the (time, name) of the last file taken; files
are taken in that order and once, so a file must not change after it has appeared.

Defined cases: blank lines are no rows; a line that is no JSON object is a row of nulls; a missing
key or a value of another type is null; keys that are no columns are ignored; names that begin with
``.`` or ``_`` are no data; an empty folder has no rows. Columns may be string, boolean, tinyint, smallint, int, bigint,
float and double.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, IsNotNull, IsNull, LessThan, LessThanOrEqual

SPLIT_BYTES, BUFFER_BYTES = 32 << 20, 1 << 20
_COMPARISONS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_WHOLE = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _local(path: str) -> str:
    """``file:/x`` as Spark writes it, with the two slashes that URIs of other readers have."""
    return f"file://{path.removeprefix('file:')}" if path.startswith("file:/") and not path.startswith("file://") else path


def _files(path: str) -> list[tuple[int, str, int]]:
    """Time, name and size of each data file of a folder, or of one file."""
    from pyarrow import fs

    system, at = _opened(_local(path))
    found = system.get_file_info(at)
    infos = system.get_file_info(fs.FileSelector(at)) if found.type == fs.FileType.Directory else [found]
    files = [i for i in infos if i.type == fs.FileType.File and i.base_name[:1] not in "._"]
    return sorted((i.mtime_ns or 0, i.path, i.size) for i in files)


class Split(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def lines(source: Any, begin: int, end: int) -> Iterator[bytes]:
    """The lines of an open file that begin at ``begin`` or after, and before ``end``."""
    at = max(begin - 1, 0)
    source.seek(at)
    rest, skip = b"", begin > 0  # the line that ``begin`` is inside of is the former split's
    while at < end or skip:
        data = source.read(BUFFER_BYTES)
        if not data:
            break
        *whole, rest_after = (rest + data).split(b"\n")
        start = at - len(rest)
        for line in whole:
            if skip:
                skip = False
            elif start < end:
                yield line
            else:
                return
            start += len(line) + 1
        at, rest = at + len(data), rest_after
    while rest and not skip and at - len(rest) < end:
        data = source.read(BUFFER_BYTES)
        head, found, _ = data.partition(b"\n")
        at, rest = at + len(data), rest + head
        if found or not data:
            yield rest
            return


def _typed(value: Any, kind: T.DataType) -> Any:
    """``value`` where it is of the column's type, else None."""
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else None
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if bits := _WHOLE.get(type(kind)):
        return value if isinstance(value, int) and -(1 << (bits - 1)) <= value < 1 << (bits - 1) else None
    return float(value)


def _test(found: Filter) -> tuple[str, Any] | None:
    """Column and test of a filter that this source takes, else None."""
    if len(found.attribute) != 1:
        return None
    column = found.attribute[0]
    if isinstance(found, IsNull):
        return column, lambda v: v is None
    if isinstance(found, IsNotNull):
        return column, lambda v: v is not None
    if isinstance(found, In):
        return column, lambda v, among=frozenset(found.value): v is not None and v in among
    if type(found) in _COMPARISONS and found.value is not None:
        return column, lambda v, holds=_COMPARISONS[type(found)], bound=found.value: v is not None and holds(v, bound)
    return None


class _Parser:
    def __init__(self, schema: T.StructType):
        for field in schema:
            if not isinstance(field.dataType, (T.StringType, T.BooleanType, T.FloatType, T.DoubleType, *_WHOLE)):
                raise ValueError(f"column {field.name} has a type that JSON lines are not read as: {field.dataType.simpleString()}")
        self.fields = [(f.name, f.dataType) for f in schema]
        self.filters: list[Filter] = []

    def rows(self, split: Split) -> Iterator[tuple]:
        tests = [_test(f) for f in self.filters]
        system, _ = _opened(split.path)
        with system.open_input_file(_opened(split.path)[1]) as source:
            for line in lines(source, split.begin, split.end):
                if not line.strip():
                    continue
                try:
                    found = json.loads(line)
                except ValueError:
                    found = None
                found = found if isinstance(found, dict) else {}
                row = {name: _typed(found.get(name), kind) for name, kind in self.fields}
                if all(test(row[column]) for column, test in tests):
                    yield tuple(row.values())


def _uri(path: str, name: str) -> str:
    """The file ``name``, as the folder's store names it, with the store's scheme."""
    path = _local(path)
    scheme, found, rest = path.partition("://")
    if not found or scheme == "file":
        return f"file://{name}"
    return f"{scheme}://{rest.split('/')[0]}{name}" if name.startswith("/") else f"{scheme}://{name}"


def _splits(path: str, files: list[tuple[int, str, int]], split_bytes: int) -> list[Split]:
    return [Split(_uri(path, name), at, min(at + split_bytes, size)) for _, name, size in files for at in range(0, size, split_bytes)]


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.split_bytes, self.parser = options["path"], int(options.get("splitBytes", SPLIT_BYTES)), _Parser(schema)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for found in filters:
            if _test(found):
                self.parser.filters.append(found)
            else:
                yield found

    def partitions(self) -> list[Split]:
        return _splits(self.path, _files(self.path), self.split_bytes)

    def read(self, partition: Split) -> Iterator[tuple]:
        return self.parser.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.split_bytes, self.parser = options["path"], int(options.get("splitBytes", SPLIT_BYTES)), _Parser(schema)
        self.most = int(options["maxFilesPerTrigger"]) if "maxFilesPerTrigger" in options else None
        self.reached: tuple[int, str] | None = None

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        reached = self.reached or (-1, "")
        new = [(time, name) for time, name, _ in _files(self.path) if (time, name) > reached][: self.most]
        self.reached = new[-1] if new else reached
        return {"time": self.reached[0], "name": self.reached[1]}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        low, high = ((o["time"], o["name"]) for o in (start, end))
        self.reached = max(self.reached or high, high)  # also after a restart
        return _splits(self.path, [f for f in _files(self.path) if low < f[:2] <= high], self.split_bytes)

    def read(self, partition: Split) -> Iterator[tuple]:
        return self.parser.rows(partition)


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> str:
        raise ValueError("json_lines needs a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Batch(self.options, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(self.options, schema)


def json_lines(spark: SparkSession, path: str, schema: str, stream: bool = False, **options: str):  # noqa: ANN201
    """The rows of ``path`` by this source, with filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonLines)
    reader = spark.readStream if stream else spark.read
    return reader.format("json_lines").schema(schema).options(path=path, **options).load()
