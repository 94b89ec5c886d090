"""Captured realtime feeds: files of binary trip updates, decoded into the nested rows of operators.realtime."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.realtime import FEED

# Numbers of the fields that are read, by message; the rest is skipped.
_MESSAGES = {
    "feed": {1: ("header", "header"), 2: ("entity", "entity")},
    "header": {3: ("timestamp", None)},
    "entity": {1: ("id", str), 3: ("trip_update", "update")},
    "update": {1: ("trip", "trip"), 2: ("stop_time_update", "stop")},
    "trip": {1: ("trip_id", str), 3: ("start_date", str)},
    "stop": {1: ("stop_sequence", None), 4: ("stop_id", str), 2: ("arrival", "event"), 3: ("departure", "event")},
    "event": {1: ("delay", None), 2: ("time", None)},
}
_MANY = {"entity", "stop_time_update"}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a number is too long")


def decoded(data: bytes, message: str = "feed") -> dict:
    """A message as nested dicts; ValueError where the bytes are none."""
    out: dict = {name: [] for name, _ in _MESSAGES[message].values() if name in _MANY}
    at = 0
    try:
        while at < len(data):
            tag, at = _varint(data, at)
            kind = tag & 7
            if kind == 0:
                value, at = _varint(data, at)
                value -= (value >> 63) << 64
            elif kind in (1, 5):
                value, at = None, at + (8 if kind == 1 else 4)
            elif kind == 2:
                size, at = _varint(data, at)
                value, at = data[at : at + size], at + size
            else:
                raise ValueError(f"unknown wire type {kind}")
            if at > len(data):
                raise ValueError("it ends too early")
            name, inner = _MESSAGES[message].get(tag >> 3, (None, None))
            if name is None or (kind == 2) != (inner is not None):
                continue
            if inner is str:
                out[name] = value.decode()
            elif inner is None:
                out[name] = value
            elif name in _MANY:
                out[name].append(decoded(value, inner))
            else:
                out[name] = decoded(value, inner)
    except (IndexError, UnicodeDecodeError) as e:
        raise ValueError("not a feed message") from e
    return out


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """path, header, entity, reason of each file: reason is null, or why nothing could be read from it.

    Empty bodies (which Spark's reader may leave out by itself) and web pages are refused, as what a server sends
    in place of a feed. A file is one poll and fits in a task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    schema = spark.createDataFrame([], f"path string, {FEED}, reason string").schema
    arrow = pa.schema([("path", pa.string()), ("header", pa.struct([("timestamp", pa.int64())])), ("entity", _arrow_entity()), ("reason", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row, reason = {}, None
                if not data:
                    reason = "empty"
                elif data.lstrip()[:5].lower() in (b"<html", b"<!doc"):
                    reason = "a web page"
                else:
                    try:
                        row = decoded(data)
                    except ValueError as e:
                        reason = str(e)
                rows.append({"path": name, "header": row.get("header"), "entity": row.get("entity"), "reason": reason})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.mapInArrow(read, schema)


def _arrow_entity() -> pa.DataType:
    event = pa.struct([("delay", pa.int32()), ("time", pa.int64())])
    stop = pa.struct([("stop_id", pa.string()), ("stop_sequence", pa.int32()), ("arrival", event), ("departure", event)])
    update = pa.struct([("trip", pa.struct([("trip_id", pa.string()), ("start_date", pa.string())])), ("stop_time_update", pa.list_(stop))])
    return pa.list_(pa.struct([("id", pa.string()), ("trip_update", update)]))


def usable(captures: DataFrame) -> DataFrame:
    """header, entity of the files that hold a feed."""
    return captures.where(F.col("reason").isNull()).select("header", "entity")
