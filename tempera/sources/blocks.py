"""Proposal blocks and block schemes: small binary files, and their table form."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def encode_blocks(blocks: list[np.ndarray]) -> bytes:
    """uint64 count, then per block uint64 rows, uint64 columns and column-major float64."""
    out = [struct.pack("<Q", len(blocks))]
    for b in blocks:
        out += [struct.pack("<QQ", *b.shape), np.asarray(b, dtype="<f8").tobytes(order="F")]
    return b"".join(out)


def decode_blocks(raw: bytes) -> list[np.ndarray]:
    (count,), at, blocks = struct.unpack_from("<Q", raw), 8, []
    for _ in range(count):
        m, n = struct.unpack_from("<QQ", raw, at)
        blocks.append(np.frombuffer(raw, "<f8", m * n, at + 16).reshape((m, n), order="F").copy())
        at += 16 + 8 * m * n
    return blocks


def encode_scheme(scheme: list[list[int]]) -> bytes:
    flat = [len(scheme)]
    for dims in scheme:
        flat += [len(dims), *dims]
    return np.asarray(flat, dtype="<i4").tobytes()


def decode_scheme(raw: bytes) -> list[list[int]]:
    numbers = np.frombuffer(raw, "<i4").tolist()
    out, at = [], 1
    for _ in range(numbers[0] if numbers else 0):
        out.append(numbers[at + 1 : at + 1 + numbers[at]])
        at += 1 + numbers[at]
    return out


def _one_file(spark: SparkSession, path: str) -> bytes | None:
    found = spark.read.format("binaryFile").load(path).select("content").take(2)
    if len(found) > 1:
        raise ValueError(f"{path} holds several files; read them with block_files")
    return bytes(found[0]["content"]) if found else None


def read_blocks(spark: SparkSession, path: str) -> list[np.ndarray]:
    """The blocks of one file."""
    raw = _one_file(spark, path)
    if raw is None:
        raise FileNotFoundError(path)
    return decode_blocks(raw)


def block_files(spark: SparkSession, path: str) -> DataFrame:
    """All block files under a path as rows (path, block, col, vec), decoded where they are read."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(name, i, c, b[:, c].tolist()) for i, b in enumerate(decode_blocks(raw.as_py())) for c in range(b.shape[1])]
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=["path", "block", "col", "vec"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "path string, block int, col int, vec array<double>")


def read_scheme(spark: SparkSession, path: str) -> list[list[int]]:
    """An absent file means one block of all dimensions, told by an empty list."""
    try:
        found = _one_file(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return decode_scheme(found) if found else []


def blocks_table(spark: SparkSession, blocks: dict[int, list[np.ndarray]]) -> DataFrame:
    rows = [
        (g, i, c, [float(v) for v in b[:, c]])
        for g, bs in blocks.items()
        for i, b in enumerate(bs)
        for c in range(b.shape[1])
    ]
    return spark.createDataFrame(rows, "grp long, block int, col int, vec array<double>")


def blocks_from_table(table: DataFrame) -> dict[int, list[np.ndarray]]:
    out: dict[int, dict[int, list]] = {}
    for r in table.orderBy("grp", "block", "col").collect():
        out.setdefault(r["grp"], {}).setdefault(r["block"], []).append(r["vec"])
    return {g: [np.array(cols).T for _, cols in sorted(bs.items())] for g, bs in out.items()}
