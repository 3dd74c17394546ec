"""Files of framed records, each a map of named lists of whole numbers.

A record is its length (8 bytes), a checksum of the length, the body, and a checksum of
the body; the body is a protocol-buffer message ``{1: {1: {1: name, 2: {3: {1: packed
numbers}}}}}``. Written and read without any other library, a file at a time."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import ship


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    """Of the Castagnoli polynomial, bits reversed."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


def checksum(data: bytes) -> int:
    """CRC-32C, rotated by 15 bits and offset, as the frames hold it."""
    table, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = table[(c ^ b) & 0xFF] ^ c >> 8
    c ^= 0xFFFFFFFF
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1  # negative numbers take ten bytes
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, body: bytes) -> bytes:
    return bytes([number << 3 | 2]) + _varint(len(body)) + body


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    at = 0
    while at < len(data):
        key, at = _read_varint(data, at)
        if key & 7 == 2:
            n, at = _read_varint(data, at)
            yield key >> 3, 2, data[at : at + n]
            at += n
        elif key & 7 == 0:
            n, at = _read_varint(data, at)
            yield key >> 3, 0, n
        else:
            n = 8 if key & 7 == 1 else 4
            yield key >> 3, key & 7, data[at : at + n]
            at += n


def message(values: dict[str, list[int]]) -> bytes:
    """The body of one record."""
    entries = b"".join(
        _field(1, _field(1, name.encode()) + _field(2, _field(3, _field(1, b"".join(map(_varint, numbers))) if numbers else b""))) for name, numbers in values.items()
    )
    return _field(1, entries)


def numbers_of(body: bytes) -> dict[str, list[int]]:
    """The lists of whole numbers of one record; lists of other kinds are left out."""
    out: dict[str, list[int]] = {}
    for _, _, features in (f for f in _fields(body) if f[0] == 1):
        for _, _, entry in (f for f in _fields(features) if f[0] == 1):
            name, numbers, whole = "", [], False
            for number, _, value in _fields(entry):
                if number == 1:
                    name = value.decode()
                elif number == 2:
                    for kind, _, listed in _fields(value):
                        whole = kind == 3
                        for _, wire, x in _fields(listed) if whole else ():
                            at, found = 0, [x]
                            if wire == 2:
                                found = []
                                while at < len(x):
                                    n, at = _read_varint(x, at)
                                    found.append(n)
                            numbers += [n - (1 << 64) if n >> 63 else n for n in found]
            if whole:
                out[name] = numbers
    return out


def frame(body: bytes) -> bytes:
    size = struct.pack("<Q", len(body))
    return size + struct.pack("<I", checksum(size)) + body + struct.pack("<I", checksum(body))


def bodies(data: bytes, verify: bool = True) -> Iterator[bytes]:
    """The bodies of a file's records; a damaged or cut-off record is an error."""
    at = 0
    while at < len(data):
        head = data[at : at + 12]
        if len(head) < 12:
            raise ValueError("a record is cut off")
        (n,) = struct.unpack("<Q", head[:8])
        body, tail = data[at + 12 : at + 12 + n], data[at + 12 + n : at + 16 + n]
        if len(tail) < 4:
            raise ValueError("a record is cut off")
        if verify and (struct.pack("<I", checksum(head[:8])) != head[8:] or struct.pack("<I", checksum(body)) != tail):
            raise ValueError("a record is damaged")
        yield body
        at += 16 + n


def read_records(spark: SparkSession, path: str, columns: list[str], verify: bool = True) -> DataFrame:
    """One row a record with ``columns`` as arrays of whole numbers, null where a record has
    none of the name."""
    ship(spark)
    schema = ", ".join(f"`{c}` array<bigint>" for c in columns)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows = [numbers_of(b) for b in bodies(bytes(data), verify)]
                if rows:
                    yield pd.DataFrame({c: [r.get(c) for r in rows] for c in columns})

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInPandas(parse, schema)


def framed(df: DataFrame, *columns: str) -> DataFrame:
    """``(record)``: the rows as framed records of ``columns``; numbers become lists of one,
    nulls are left out."""
    ship(df.sparkSession)
    lists = [F.when(F.col(c).isNotNull(), F.col(c) if df.schema[c].dataType.simpleString().startswith("array") else F.array(c)).alias(c) for c in columns]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            yield pd.DataFrame({"record": [frame(message({c: [int(x) for x in v] for c, v in r.items() if v is not None})) for r in rows]})

    return df.select(*lists).mapInPandas(write, "record binary")


def write_records(df: DataFrame, path: str, *columns: str) -> DataFrame:
    """A folder of record files, one a partition: ``(file, records)`` of what was written.

    A task writes under a name of its own attempt and renames the file when it is whole,
    so that a lost or repeated task leaves no half file among the others."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        target, folder = fs.FileSystem.from_uri(path)
        target.create_dir(folder, recursive=True)
        name = f"part-{task.partitionId():05d}.records"
        part, n = f"{folder}/_{name}-{task.taskAttemptId()}", 0
        with target.open_output_stream(part) as out:
            for batch in batches:
                for record in batch["record"]:
                    out.write(bytes(record))
                    n += 1
        if n:
            target.move(part, f"{folder}/{name}")
            yield pd.DataFrame({"file": [name], "records": [n]})
        else:
            target.delete_file(part)

    written = framed(df, *columns).mapInPandas(write, "file string, records bigint")
    rows = written.collect()  # one row a partition
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], "file string, records bigint")
