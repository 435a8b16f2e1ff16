"""Raw column files as a Spark source: fixed-width arrays and length-prefixed strings.

A table is a directory of `{column}.bin`, all of equal row count.  Fixed-width
columns are little-endian arrays.  A string column starts with an unsigned
64-bit row count, then one (size, offset) pair of unsigned 64-bit numbers for
each row, offsets counted from the start of the file, then the bytes.  Dates
are Julian day numbers.  Each partition seeks to its own row range.  A table
written from a DataFrame is a directory of such tables, one for each million
rows or partition, listed in `_parts` once all are whole.  Paths may carry the
scheme of any file system that Arrow opens.  Columns hold no nulls.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.dates import JULIAN_DAY_OF_EPOCH

_FIXED = {T.IntegerType(): "<i4", T.LongType(): "<i8", T.DoubleType(): "<f8", T.DateType(): "<i4"}


_LIST = "_parts"
ROWS_PER_PART = 1_000_000


def _file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def write_column(path: str, values, dtype: T.DataType) -> None:
    """Writes one column file; dates are given as days since 1970-01-01."""
    fs, at = _file_system(path)
    with fs.open_output_stream(at) as f:
        if dtype == T.StringType():
            data = [v.encode() for v in values]
            sizes = np.array([len(b) for b in data], dtype="<u8")
            starts = (8 + 16 * len(data) + np.cumsum(sizes) - sizes).astype("<u8")
            f.write(np.array([len(data)], dtype="<u8").tobytes())
            f.write(np.stack([sizes, starts], axis=1).tobytes())
            f.write(b"".join(data))
            return
        arr = np.asarray(values)
        if dtype == T.DateType():
            arr = arr + JULIAN_DAY_OF_EPOCH
        f.write(arr.astype(_FIXED[dtype]).tobytes())


def write_columns(df: DataFrame, path: str) -> None:
    """Writes df as column files.  A task that fails leaves a folder that no list names."""
    schema = df.schema
    unknown = [f.name for f in schema if f.dataType != T.StringType() and f.dataType not in _FIXED]
    if unknown:
        raise ValueError(f"no column file holds the type of {unknown}")

    def write(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        folder = f"part-{uuid.uuid4().hex}"
        fs, base = _file_system(path)
        fs.create_dir(f"{base}/{folder}")
        for f in schema:
            column = table.column(f.name)
            if column.null_count:
                raise ValueError(f"column {f.name} holds nulls")
            if f.dataType == T.DateType():
                column = column.cast(pa.int32())
            write_column(f"{path}/{folder}/{f.name}.bin", column.to_pylist() if f.dataType == T.StringType() else column.to_numpy(), f.dataType)
        return pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([table.num_rows])], ["folder", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS_PER_PART:
                yield write(held)
                held, n = [], 0
        if n:
            yield write(held)

    fs, base = _file_system(path)
    fs.create_dir(base)
    # One row for each part.
    parts = df.mapInArrow(run, "folder string, n long").collect()
    with fs.open_output_stream(f"{base}/{_LIST}") as f:
        f.write("".join(f"{r.folder}\n" for r in parts).encode())


def _rows_in(path: str, dtype: T.DataType) -> int:
    fs, at = _file_system(path)
    if dtype == T.StringType():
        with fs.open_input_file(at) as f:
            return int(np.frombuffer(f.read(8), "<u8")[0])
    width = np.dtype(_FIXED[dtype]).itemsize
    size = fs.get_file_info(at).size
    if size % width:
        raise ValueError(f"{path}: {size} bytes are no multiple of {width}")
    return size // width


def _read_strings(f, start: int, stop: int) -> pa.Array:
    index = np.frombuffer(f.read_at(16 * (stop - start), 8 + 16 * start), "<u8").reshape(-1, 2).astype(np.int64)
    if not len(index):
        return pa.array([], pa.string())
    size, at = index[:, 0], index[:, 1]
    if (at[1:] == at[:-1] + size[:-1]).all():
        # Strings that lie in row order are one read.
        data = f.read_at(int(at[-1] + size[-1] - at[0]), int(at[0]))
        ends = np.append(at, at[-1] + size[-1]) - at[0]
        return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())
    return pa.array([f.read_at(n, a).decode() for n, a in index.tolist()], pa.string())


def _read_column(path: str, dtype: T.DataType, start: int, stop: int) -> pa.Array:
    fs, where = _file_system(path)
    with fs.open_input_file(where) as f:
        if dtype == T.StringType():
            return _read_strings(f, start, stop)
        kind = np.dtype(_FIXED[dtype])
        arr = np.frombuffer(f.read_at((stop - start) * kind.itemsize, start * kind.itemsize), kind)
    if dtype == T.DateType():
        return pa.array((arr - JULIAN_DAY_OF_EPOCH).astype("<i4"), pa.date32())
    return pa.array(arr)


class _Range(InputPartition):
    def __init__(self, base: str, start: int, stop: int):
        self.base, self.start, self.stop = base, start, stop


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.base = schema, options["path"]
        self.chunk = int(options.get("rowsPerPartition", 1_000_000))

    def _tables(self) -> list[str]:
        fs, at = _file_system(f"{self.base}/{_LIST}")
        if fs.get_file_info(at).type == arrow_fs.FileType.NotFound:
            return [self.base]
        with fs.open_input_file(at) as f:
            return [f"{self.base}/{name}" for name in f.read().decode().split()]

    def partitions(self) -> list[_Range]:
        out = []
        for base in self._tables():
            counts = {f.name: _rows_in(f"{base}/{f.name}.bin", f.dataType) for f in self.schema}
            if len(set(counts.values())) > 1:
                raise ValueError(f"columns differ in length: {counts}")
            n = next(iter(counts.values()))
            out += [_Range(base, s, min(n, s + self.chunk)) for s in range(0, n, self.chunk)]
        return out or [_Range(self.base, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        for s in range(part.start, part.stop, 65_536):
            e = min(part.stop, s + 65_536)
            yield pa.RecordBatch.from_arrays(
                [_read_column(f"{part.base}/{f.name}.bin", f.dataType, s, e) for f in self.schema],
                [f.name for f in self.schema],
            )


class ColumnFileSource(DataSource):
    """`spark.read.format("columnfile").schema(...).load(dir)`; the schema is required."""

    @classmethod
    def name(cls) -> str:
        return "columnfile"

    def schema(self):
        raise ValueError("columnfile needs an explicit schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def register_columnfile(spark: SparkSession) -> None:
    spark.dataSource.register(ColumnFileSource)
