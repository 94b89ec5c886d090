"""What the operators share: tables, written intermediate results, stable hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(1 << 63)
_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: dict[tuple[str, str], list[str]] = {}
_OPEN: list[str] = [""]  # names of the scopes that are open, innermost last
_KEPT: dict[tuple, object] = {}  # in a worker: what its tasks of one kind share


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. In local mode a temporary one will do where that is unset; on a cluster it won't."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="transitweave-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors. See remove_written and scope."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault((df.sparkSession.sparkContext.applicationId, _OPEN[-1]), []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession, but: DataFrame | None = None, of: str = "", other_than: str | None = None) -> None:
    """Deletes what written() has left in the shared folder in this application, apart from what `but` reads; call it when its results have been used.

    With `of`, only what scopes wrote whose names begin so goes, apart from the scope `other_than`.
    """
    jvm, app = spark.sparkContext._jvm, spark.sparkContext.applicationId
    read = but.inputFiles() if but is not None else []
    for key in [k for k in _WRITTEN if k[0] == app and k[1].startswith(of) and k[1] != other_than]:
        paths = _WRITTEN.pop(key)
        used = [p for p in paths if any(f"/{p.rpartition('/')[2]}/" in f for f in read)]
        for path in set(paths) - set(used):
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        if used:
            _WRITTEN[key] = used


@contextmanager
def scope(spark: SparkSession, family: str, name: str, docs: DataFrame | None = None) -> Iterator[None]:
    """What is written in here goes when another scope of the family opens, unless its docs read it; else its results must have been used by then."""
    own = f"{family}/{name}"
    remove_written(spark, docs, f"{family}/", own)
    _OPEN.append(own)
    try:
        yield
    finally:
        _OPEN.pop()


def task_start(make=None, *key):
    """At the start of a task in a Python worker: make(*key), which its next tasks of the same kind share.

    Workers live on from stage to stage; what tasks of other kinds have left,
    and memory that the allocators hold back, is returned.
    """
    for other in [k for k in _KEPT if k != (make, *key)]:
        del _KEPT[other]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    if make and (make, *key) not in _KEPT:
        _KEPT[make, *key] = make(*key)
    return _KEPT.get((make, *key))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, which may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="transitweave-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(f"{folder}/{package.name}.zip")


def whole_ids(docs: DataFrame, column: str) -> None:
    """Raises where ids are not whole numbers: those of other types would be cut off or lost."""
    kind = docs.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{column} must hold whole numbers, not {kind}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def version_of(doc_id: Column, text: Column) -> Column:
    """With the id, what tells documents apart: 63 bits of the text's hash, and a sign that puts null ids before all others."""
    h = F.xxhash64(text.cast("binary"))
    return F.when(doc_id.isNull(), h.bitwiseOR(F.lit(NO_ID))).otherwise(h.bitwiseAND(F.lit((1 << 63) - 1)))


class Memo(dict):
    """Keeps make(key) of the keys seen last: up to twice `most` of them, none longer than `longest`."""

    def __init__(self, make, most: int = 600_000, longest: int = 48):
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Words between ASCII white space (\x20, \x09-\x0D), with A-Z lower-cased.
ASCII_WORDS = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE, _RUN = 0xA0761D6478BD642F, 1 << 18


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse; a word begins in the first half of them."""
    up, down = np.full(2 * _RUN, _BASE, np.uint64), np.full(2 * _RUN, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces of about _RUN bytes, cut at blanks. What is longer than that without a blank stays whole."""
    at = 0
    while len(data) - at > _RUN:
        cut = data.rfind(b" ", at, at + _RUN)
        if cut < 0:
            cut = data.find(b" ", at + _RUN)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut + 1
    yield data[at:]


def hashed_words(texts: Iterable[str | None], table: bytes = ASCII_WORDS) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words, in order: what `table` leaves between blanks."""
    parts: list[bytes] = []
    owners: list[int] = []
    found: list[list[np.ndarray]] = []
    filled = 0

    def flush() -> None:
        nonlocal filled
        joined = b" ".join(parts) + b" "
        text = np.frombuffer(joined, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], text == 32]).view(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        up, down = _powers()
        if len(text) > len(up):  # a word longer than all powers, alone in its run
            hashes = np.array([xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(starts, ends, strict=True)], np.uint64)
        else:
            sums = np.zeros(len(text) + 1, np.uint64)
            np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
            hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        until = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))
        for k, h in zip(owners, np.split(hashes, until[:-1]), strict=True):
            found[k].append(h)
        parts.clear(), owners.clear()
        filled = 0

    for k, value in enumerate(texts):
        found.append([])
        for piece in _pieces(value.encode().translate(table)) if value else ():
            if parts and filled + len(piece) > _RUN:
                flush()
            parts.append(piece), owners.append(k)
            filled += len(piece) + 1
    if parts:
        flush()
    none = np.zeros(0, np.uint64)
    return [h[0] if len(h) == 1 else np.concatenate([none, *h]) for h in found]


_ODD = [int(xxhash.xxh64_intdigest(f"position {i}")) | 1 for i in range(64)]


def shingle_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, in order; with fewer words, one for all of them; without words, none."""
    if not len(word_hashes):
        return word_hashes
    n = min(n, len(word_hashes))
    m = len(word_hashes) - n + 1
    total = np.full(m, n, np.uint64)
    for i in range(n):
        total += word_hashes[i : i + m] * np.uint64(_ODD[i])
    return mixed(total)
