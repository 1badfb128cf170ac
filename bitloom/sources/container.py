"""The tensor container: a length, a JSON header and a data section; as a Spark data source, and written back.

``format("tensors")`` reads a file or a folder of them: one row a tensor, with its bytes only if they are
selected, fetched by position. A filter on the name reaches the reader.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage

from ..operators.catalog import RANKED, WIDTHS

LONGEST_HEADER = 100 << 20
SUFFIX = ".safetensors"
SCHEMA = "name string, file string, dtype string, shape array<long>, off_begin long, off_end long, data_start long, metadata map<string,string>, bytes binary"


class Malformed(ValueError):
    """A container that must not be read on."""


def parse_header(raw: bytes, data_bytes: int) -> tuple[list[dict], dict[str, str]]:
    """(tensors in the order of the header, metadata); refuses whatever the format does not allow."""
    try:
        header = json.loads(raw)
    except ValueError as e:
        raise Malformed(f"the header is no JSON: {e}") from e
    if not isinstance(header, dict):
        raise Malformed("the header is no object")
    meta = header.pop("__metadata__", {})
    meta = {k: v for k, v in meta.items() if isinstance(v, str)} if isinstance(meta, dict) else {}
    out = []
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    for name, t in header.items():
        if not isinstance(t, dict) or not isinstance(t.get("dtype"), str):
            raise Malformed(f"{name}: no dtype")
        shape, span = t.get("shape"), t.get("data_offsets")
        if not isinstance(shape, list) or not all(map(whole, shape)):
            raise Malformed(f"{name}: shape {shape}")
        if not isinstance(span, list) or len(span) != 2 or not all(map(whole, span)):
            raise Malformed(f"{name}: data_offsets {span}")
        if span[0] > span[1] or span[1] > data_bytes:
            raise Malformed(f"{name}: bytes {span} of {data_bytes}")
        width = WIDTHS.get(t["dtype"])
        if width and math.prod(shape) * width != span[1] - span[0]:
            raise Malformed(f"{name}: {shape} of {t['dtype']} in {span[1] - span[0]} bytes")
        out.append({"name": name, "dtype": t["dtype"], "shape": shape, "off_begin": span[0], "off_end": span[1]})
    return out, meta


def read_header(path: str) -> tuple[list[dict], dict[str, str], int]:
    """(tensors, metadata, where the data begins) of a file."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        first = f.read(8)
        if len(first) < 8:
            raise Malformed(f"{path}: {size} bytes")
        n = struct.unpack("<Q", first)[0]
        if n > LONGEST_HEADER or 8 + n > size:
            raise Malformed(f"{path}: a header of {n} bytes")
        tensors, meta = parse_header(f.read(n), size - 8 - n)
    return tensors, meta, 8 + n


def files_of(path: str) -> list[str]:
    if os.path.isdir(path):
        found = sorted(os.path.join(path, x) for x in os.listdir(path) if x.endswith(SUFFIX))
        if not found:
            raise Malformed(f"{path} holds no containers")
        return found
    return [path]


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_bytes = options.get("bytes", "true") == "true"
        self.name: str | None = None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",) and self.name is None:
                self.name = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in files_of(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        tensors, meta, start = read_header(partition.path)
        with open(partition.path, "rb") as f:
            for t in tensors:
                if self.name is None or t["name"] == self.name:
                    data = None
                    if self.with_bytes:
                        f.seek(start + t["off_begin"])
                        data = f.read(t["off_end"] - t["off_begin"])
                    yield t["name"], partition.path, t["dtype"], t["shape"], t["off_begin"], t["off_end"], start, meta, data


def header_bytes(tensors: list[tuple[str, str, list[int], int]], metadata: dict[str, str]) -> bytes:
    """The header of tensors (name, dtype, shape, bytes) in their order, padded with blanks to whole words."""
    out: dict = {"__metadata__": dict(sorted(metadata.items()))} if metadata else {}
    at = 0
    for name, dtype, shape, n in tensors:
        out[name] = {"dtype": dtype, "shape": list(shape), "data_offsets": [at, at + n]}
        at += n
    raw = json.dumps(out, separators=(",", ":"), ensure_ascii=False).encode()
    return struct.pack("<Q", len(raw) + -len(raw) % 8) + raw + b" " * (-len(raw) % 8)


def canonical_key(t: tuple) -> tuple[int, bytes]:
    if t[1] not in RANKED:
        raise Malformed(f"{t[0]}: no place for tensors of {t[1]}")
    return -RANKED.index(t[1]), t[0].encode()


def write_file(path: str, tensors: list[tuple[str, str, list[int], bytes]], metadata: dict[str, str]) -> None:
    """Writes beside the path, flushes, then renames; what fails leaves nothing behind."""
    tensors = sorted(tensors, key=canonical_key)
    tmp = f"{path}.tmp"
    try:
        with open(tmp, "wb") as f:
            f.write(header_bytes([(n, d, s, len(b)) for n, d, s, b in tensors], metadata))
            for t in tensors:
                f.write(t[3])
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise


class _Done(WriterCommitMessage):
    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = pairs


class _Writer(DataSourceWriter):
    """Rows (file, name, dtype, shape, bytes[, metadata]): each task writes its files under other names; committing renames them."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.metadata = json.loads(options.get("metadata", "{}"))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        by: dict[str, list] = {}
        for r in rows:
            by.setdefault(r["file"], []).append((r["name"], r["dtype"], list(r["shape"] or []), bytes(r["bytes"])))
        os.makedirs(self.folder, exist_ok=True)
        pairs, attempt = [], TaskContext.get().taskAttemptId()
        for file, tensors in by.items():
            part = os.path.join(self.folder, f".{file}.{attempt}.part")
            write_file(part, tensors, self.metadata.get(file, self.metadata.get("*", {})))
            pairs.append((part, os.path.join(self.folder, file)))
        return _Done(pairs)

    def commit(self, messages: list) -> None:
        pairs = [p for m in messages if m for p in m.pairs]
        names = [to for _, to in pairs]
        if len(set(names)) != len(names):
            self.abort(messages)
            raise Malformed("a file was written by more than one task: repartition by file")
        for part, to in pairs:
            os.replace(part, to)

    def abort(self, messages: list) -> None:
        for m in messages:
            for part, _ in m.pairs if m else ():
                if os.path.exists(part):
                    os.unlink(part)


class TensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TensorSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_tensors(spark: SparkSession, path: str, with_bytes: bool = True) -> DataFrame:
    return register(spark).read.format("tensors").option("bytes", str(with_bytes).lower()).load(path)


def duplicates(tensors: DataFrame) -> DataFrame:
    """(name, files): names that more than one file has, which is an error."""
    return tensors.groupBy("name").agg(F.count("*").alias("files")).where("files > 1")


def write_tensors(rows: DataFrame, folder: str, metadata: dict[str, dict[str, str]] | None = None) -> None:
    """Writes (file, name, dtype, shape, bytes) as containers, a file by one task."""
    register(rows.sparkSession)
    rows.select("file", "name", "dtype", "shape", "bytes").repartition("file").write.format("tensors").mode("append").option("metadata", json.dumps(metadata or {})).save(folder)


def stamped(rows: DataFrame) -> dict[str, str]:
    """Per tensor, the hash of its bytes, for a file's metadata."""
    return {f"sha256.{r.name}": r.h for r in rows.select("name", F.sha2("bytes", 256).alias("h")).collect()}


def sha256_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def as_table(tensors: list[tuple[str, str, list[int], bytes]]) -> pa.Table:
    n, d, s, b = zip(*tensors, strict=True) if tensors else ((), (), (), ())
    return pa.table({"name": pa.array(n, pa.string()), "dtype": pa.array(d, pa.string()), "shape": pa.array(s, pa.list_(pa.int64())), "bytes": pa.array(b, pa.binary())})
