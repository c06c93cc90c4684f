"""Map extracts in protocol-buffer format: blobs are cut out of files, dealt out and decoded.

A file is a run of blobs, each preceded by a four-byte length and a header that tells its size. One
task cuts a file (up to 2 GB, what a binary column holds) into its blobs; the blobs, which are
self-contained, are then spread over the cluster and decoded there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

NANO = 1e-9
_NODES = "id long, lat double, lon double, tags map<string,string>"
_WAYS = "id long, refs array<long>, tags map<string,string>"


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place after it) of a base-128 number."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("number cut short")
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("number too long")


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def signed64(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message; what has a length comes as bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > len(data):
                raise ValueError("field cut short")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = varint(data, at)
        out.append(n)
    return out


def running(deltas: list[int]) -> list[int]:
    total, out = 0, []
    for d in deltas:
        total += zigzag(d)
        out.append(total)
    return out


def blobs(content: bytes) -> Iterator[bytes]:
    """The data blobs of a file, unpacked; the header blob is left out."""
    at = 0
    while at + 4 <= len(content):
        (size,) = struct.unpack(">i", content[at : at + 4])
        at += 4
        head = dict(fields(content[at : at + size]))
        at += size
        body = content[at : at + head[3]]
        at += head[3]
        if head.get(1) != b"OSMData":
            continue
        parts = dict(fields(body))
        if 1 in parts:
            yield parts[1]
        elif 3 in parts:
            yield zlib.decompress(parts[3])
        else:
            raise ValueError("blob is neither plain nor zlib")


def decode(block: bytes) -> Iterator[tuple[str, int, float | None, float | None, list[int] | None, dict[str, str]]]:
    """("node" or "way", id, lat, lon, refs, tags) of a block; relations are passed over."""
    strings: list[str] = []
    groups, granularity, lat0, lon0 = [], 100, 0, 0
    for number, value in fields(block):
        if number == 1:
            strings = [v.decode("utf-8", "replace") for k, v in fields(value) if k == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            granularity = value
        elif number == 19:
            lat0 = signed64(value)
        elif number == 20:
            lon0 = signed64(value)
    lat = lambda n: NANO * (lat0 + granularity * n)
    lon = lambda n: NANO * (lon0 + granularity * n)
    for group in groups:
        for number, value in fields(group):
            if number == 1:
                own = dict(fields(value))
                tags = {strings[k]: strings[v] for k, v in zip(packed(own.get(2, b"")), packed(own.get(3, b"")))}
                yield "node", zigzag(own[1]), lat(zigzag(own[8])), lon(zigzag(own[9])), None, tags
            elif number == 2:
                own = dict(fields(value))
                marks, place = packed(own.get(10, b"")), 0
                for i, a, b in zip(running(packed(own.get(1, b""))), running(packed(own.get(8, b""))), running(packed(own.get(9, b"")))):
                    tags = {}
                    while place < len(marks) and marks[place]:
                        tags[strings[marks[place]]] = strings[marks[place + 1]]
                        place += 2
                    place += 1
                    yield "node", i, lat(a), lon(b), None, tags
            elif number == 3:
                own = dict(fields(value))
                tags = {strings[k]: strings[v] for k, v in zip(packed(own.get(2, b"")), packed(own.get(3, b"")))}
                yield "way", own[1], None, None, running(packed(own.get(8, b""))), tags


def _cut(batches):
    for batch in batches:
        for content in batch.column(0).to_pylist():
            for blob in blobs(content):
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["block"])


def _decoded(kind: str):
    def run(batches):
        tags_type = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for block in batch.column(0).to_pylist():
                rows = [r for r in decode(block) if r[0] == kind]
                ids, tags = pa.array([r[1] for r in rows], pa.int64()), pa.array([list(r[5].items()) for r in rows], tags_type)
                if kind == "node":
                    yield pa.RecordBatch.from_arrays([ids, pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64()), tags], names=["id", "lat", "lon", "tags"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array([r[4] for r in rows], pa.list_(pa.int64())), tags], names=["id", "refs", "tags"])

    return run


def read_pbf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of an extract, or of a folder of them."""
    blocks = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_cut, "block binary")
    dealt = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(_decoded("node"), _NODES), dealt.mapInArrow(_decoded("way"), _WAYS)
