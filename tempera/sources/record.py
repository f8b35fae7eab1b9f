"""Binary sample records as a Spark data source.

A record is int32 dimension, that many float64 values, int32 id, float64
weight and one flag byte, unpadded little-endian. All records of a file have
the same size, so large files are read in byte ranges by many tasks; a task learns the dimension
from the file's first record, and planning only lists names and sizes.

``read_records`` and ``write_records`` give a path the scheme that the session's default file system
stands for. The data source itself takes paths with a scheme; one without is local.

A file named ``<level>.<bin>.<dump>.<node>.record`` belongs to a level and bin: with the option ``placed`` these are
columns of its samples (-1 for other names), and samples written with such columns go to files so named.

    spark.dataSource.register(SampleRecordSource)
    spark.read.format("sample_record").load("file:///tmp/run")
    df.write.format("sample_record").mode("append").save("s3a://bucket/run")
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import IntegerType, StructField, StructType

from tempera.schema import SAMPLE

SLICE_BYTES = 64 * 1024 * 1024
BATCH_RECORDS = 10_000
SUFFIX = ".record"
# Fixed value: level, bin, dump and node of a run's record file.
RUN_FILE = re.compile(r"(\d+)\.(\d+)\.\d+\.\d+\.record$")
PLACED = StructType([*SAMPLE, StructField("level", IntegerType(), False), StructField("bin", IntegerType(), False)])


def record_type(dim: int) -> np.dtype:
    return np.dtype([("dim", "<i4"), ("data", "<f8", (dim,)), ("id", "<i4"), ("weight", "<f8"), ("calculated", "u1")])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    if "://" in path:
        return pafs.FileSystem.from_uri(quote(re.sub(r"^s3[an]:", "s3:", path), safe="/:@?&=%"))
    return pafs.LocalFileSystem(), path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Hadoop's default file system has it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(folder).toString()


def read_records(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    spark.dataSource.register(SampleRecordSource)
    return spark.read.format("sample_record").option("placed", str(placed).lower()).load(qualified(spark, path))


def write_records(samples: DataFrame, path: str, mode: str = "append") -> None:
    samples.sparkSession.dataSource.register(SampleRecordSource)
    samples.write.format("sample_record").mode(mode).save(qualified(samples.sparkSession, path))


def _list(path: str) -> list[pafs.FileInfo]:
    system, root = _open(path)
    info = system.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [info]
    found = system.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted(
        (f for f in found if f.type == pafs.FileType.File and f.path.endswith(SUFFIX) and f.size and "/_" not in f.path),
        key=lambda f: f.path,
    )


class _Slice(InputPartition):
    """Records that start in a byte range of a file."""

    def __init__(self, path: str, size: int, start: int, stop: int):
        self.path, self.size, self.start, self.stop = path, size, start, stop


def to_batch(records: np.ndarray) -> pa.RecordBatch:
    n, dim = records["data"].shape
    flat = pa.array(np.ascontiguousarray(records["data"]).ravel())
    item = pa.field("element", pa.float64(), nullable=False)
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32) if dim else np.zeros(n + 1, np.int32))
    data = pa.ListArray.from_arrays(offsets, flat, type=pa.list_(item))
    return pa.RecordBatch.from_arrays(
        [
            data,
            pa.array(np.ascontiguousarray(records["id"])),
            pa.array(np.ascontiguousarray(records["weight"])),
            pa.array(records["calculated"] != 0),
        ],
        names=["data", "id", "weight", "calculated"],
    )


def _is_placed(options: dict) -> bool:
    return str(options.get("placed", "")).lower() == "true"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.placed = options["path"], _is_placed(options)

    def partitions(self) -> list[InputPartition]:
        return [
            _Slice(info.path, info.size, start, min(start + SLICE_BYTES, info.size))
            for info in _list(self.path)
            for start in range(0, info.size, SLICE_BYTES)
        ]

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as f:
            dim = int(np.frombuffer(f.read(4), "<i4")[0])
            kind = record_type(dim)
            if partition.size % kind.itemsize:
                raise ValueError(f"{partition.path}: {partition.size} bytes are no whole number of {kind.itemsize}-byte records")
            first, last = -(-partition.start // kind.itemsize), -(-partition.stop // kind.itemsize)
            f.seek(first * kind.itemsize)
            left = last - first
            while left:
                take = min(left, BATCH_RECORDS)
                records = np.frombuffer(f.read(take * kind.itemsize), kind)
                if (records["dim"] != dim).any():
                    raise ValueError(f"{partition.path}: records of different dimension")
                batch = to_batch(records)
                if self.placed:
                    named = RUN_FILE.search(partition.path.rsplit("/", 1)[-1])
                    for i, column in enumerate(("level", "bin"), 1):
                        batch = batch.append_column(column, pa.array(np.full(take, int(named[i]) if named else -1, np.int32)))
                yield batch
                left -= take


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Writer(DataSourceArrowWriter):
    """Tasks write aside; the commit moves their files into place."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.dump = options["path"].rstrip("/"), overwrite, int(options.get("dump", 0))
        self.aside = f"{self.path}/_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, aside = _open(self.aside)
        attempt = uuid.uuid4().hex
        system.create_dir(f"{aside}/{attempt}", recursive=True)
        open_files: dict[str, tuple] = {}
        for batch in iterator:
            for name, rows in self._files(batch, attempt):
                column = {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
                if name not in open_files:
                    open_files[name] = (len(column["data"][0]), system.open_output_stream(f"{aside}/{attempt}/{name}"))
                dim, out = open_files[name]
                records = np.zeros(rows.num_rows, record_type(dim))
                records["dim"] = dim
                records["data"] = column["data"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                for field in ("id", "weight", "calculated"):
                    records[field] = column[field].to_numpy(zero_copy_only=False)
                out.write(records.tobytes())
        for _, out in open_files.values():
            out.close()
        return _Written([f"{attempt}/{name}" for name in open_files])

    def _files(self, batch: pa.RecordBatch, attempt: str) -> Iterator[tuple[str, pa.RecordBatch]]:
        """A batch by the file its rows belong to."""
        if batch.num_rows and "level" not in batch.schema.names:
            yield f"part-{attempt}{SUFFIX}", batch
        elif batch.num_rows:
            level, bin_ = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("level", "bin"))
            for place in sorted(set(zip(level.tolist(), bin_.tolist()))):
                mine = (level == place[0]) & (bin_ == place[1])
                name = f"{place[0]}.{place[1]}.{self.dump}.{TaskContext.get().partitionId()}{SUFFIX}"
                yield name, batch.filter(pa.array(mine))

    def commit(self, messages: list) -> None:
        system, root = _open(self.path)
        _, aside = _open(self.aside)
        if self.overwrite:
            for old in _list(self.path):
                system.delete_file(old.path)
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{aside}/{name}", f"{root}/{name.rsplit('/', 1)[-1]}")
        self._clean(system, aside)

    def abort(self, messages: list) -> None:
        system, aside = _open(self.aside)
        self._clean(system, aside)

    @staticmethod
    def _clean(system: pafs.FileSystem, aside: str) -> None:
        if system.get_file_info(aside).type == pafs.FileType.Directory:
            system.delete_dir(aside)


class SampleRecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sample_record"

    def schema(self):
        return PLACED if _is_placed(self.options) else SAMPLE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)
