"""Near duplicates by SimHash: fingerprints compared exactly, in tiles.

The distinct fingerprints stand in the order of their population counts: of
the whole, then of a half and two quarters. Tiles are 2,048 neighbours in that
order, blocks are 16 tiles. Two fingerprints can't differ in fewer bits than their
counts do, nor than the counts of their parts do in sum; so pairs of blocks whose
counts are further apart than the radius don't meet, and in a pair of blocks
the pairs of tiles further apart are skipped. What is left is compared whole by numpy,
exclusive-or and a count of bits. A pair of blocks hands on a spanning forest
of its links, never more rows than it has fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_WORDS, mixed, task_start, written
from .ngram_join import components
from .order import numbered

_SEED = 42
_TILE, _TILES = 2048, 16
_STRIP = 64  # rows of a tile compared at once: 1 MB of 64-bit words
_CHUNK = 1 << 16
#: The whole, its halves, its quarters: counts of each division bound the distance from below.
_DIVISIONS = [[np.uint64(((1 << w) - 1) << at) for at in range(0, 64, w)] for w in (64, 32, 16)]


def fingerprint(text: str | None, n: int = 4) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's runs of n words, repeats included; 0 without words."""
    words = text.encode().translate(ASCII_WORDS).split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), min(n, len(words))
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(blanks + 1).tolist()], [*blanks.tolist(), len(joined)]
    runs, digest = len(words) - n + 1, xxhash.xxh64_intdigest
    set_in = np.zeros(64, np.int64)
    for at in range(0, runs, _CHUNK):
        to = min(at + _CHUNK, runs)
        h = np.array([digest(joined[a:b], _SEED) for a, b in zip(starts[at:to], ends[at + n - 1 : to + n - 1], strict=True)], "<u8")
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > runs, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """doc_id and fp (64 bits as a long) of each row of docs (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        for batch in batches:
            found = np.fromiter((fingerprint(t, n) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(prints, f"doc_id {id_type}, fp long")


def _bounds(tile: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per division the least and the greatest count of each part."""
    counts = [np.stack([np.bitwise_count(tile & mask) for mask in parts]).astype(np.int64) for parts in _DIVISIONS]
    return [(c.min(axis=1), c.max(axis=1)) for c in counts]


def apart(a, b) -> int:
    """Bits by which any two fingerprints of two tiles differ at least, by their counts."""
    return max(int(np.maximum(0, np.maximum(lo - high, low - hi)).sum()) for (lo, hi), (low, high) in zip(a, b, strict=True))


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root, after the pairs (i, j) have been linked: each place has the smallest place of its component."""
    while len(i):
        a, b = root[i], root[j]
        new = a != b
        i, j, a, b = i[new], j[new], a[new], b[new]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := root[root], root):
            root = further
    return root


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs of at most `radius` differing bits connect: within `left` tiles, or between left and right ones."""
    tiles = left + (right or [])
    fps = np.concatenate(tiles)
    starts = np.cumsum([0, *map(len, tiles)])
    root, bounds = np.arange(len(fps)), [_bounds(t) for t in tiles]
    for p in range(len(left)):
        for q in range(len(left), len(tiles)) if right else range(p, len(left)):
            if apart(bounds[p], bounds[q]) > radius:
                continue
            found = [(at + i, j) for at in range(0, len(tiles[p]), _STRIP) for i, j in [np.nonzero(np.bitwise_count(tiles[p][at : at + _STRIP, None] ^ tiles[q][None, :]) <= radius)] if len(i)]
            if found:
                root = _merge(root, starts[p] + np.concatenate([i for i, _ in found]), starts[q] + np.concatenate([j for _, j in found]))
    other = np.flatnonzero(root != np.arange(len(root)))
    return fps[other], fps[root[other]]


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """a, b: links between the fingerprints fp of distinct; they connect all that differ in `radius` bits or fewer. Nodes are mixed fingerprints."""
    ones = lambda mask: F.bit_count(F.col("fp").bitwiseAND(F.lit(mask)))
    counted = distinct.select("fp", F.bit_count("fp").alias("ones"), ones(0xFFFFFFFF).alias("half"), ones(0xFFFF).alias("first"), ones(0xFFFF << 32).alias("third"))
    placed = numbered(counted, [], ["ones", "half", "first", "third", "fp"], "fingerprints")
    placed = placed.select("fp", "ones", F.expr(f"idx div {_TILE}").alias("tile"), F.expr(f"idx div {_TILE * _TILES}").alias("block"))
    tiles = written(placed.groupBy("block", "tile").agg(F.collect_list("fp").alias("fps"), F.min("ones").alias("low"), F.max("ones").alias("high")), "fingerprint-tiles")

    blocks = tiles.groupBy("block").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    near = blocks.select(F.col("block").alias("a"), F.explode(F.sequence("low", F.col("high") + radius)).alias("ones"))
    near = near.join(blocks.select(F.col("block").alias("b"), F.explode(F.sequence("low", "high")).alias("ones")), "ones").where("a <= b").select("a", "b").distinct()
    met = near.withColumn("block", F.explode(F.array_distinct(F.array("a", "b")))).join(tiles.select("block", "fps"), "block")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        task_start()
        a, b = (k.as_py() for k in key)
        sides: dict[int, list[np.ndarray]] = {a: [], b: []}
        for block, fps in zip(group.column("block").to_pylist(), (x for c in group.column("fps").chunks for x in c), strict=True):
            sides[block].append(np.asarray(fps.values).view(np.uint64))
        one, other = linked(sides[a], sides[b] if a != b else None, radius)
        return pa.table({"a": mixed(one).view(np.int64), "b": mixed(other).view(np.int64)})

    return met.groupBy("a", "b").applyInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, n: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Texts are whole; a text with fewer than n words is one run, a null or wordless one has the fingerprint
    zero and links like any other. Documents whose fingerprints differ in `radius` bits
    or fewer link; component_id is the smallest id reachable, null if all ids there are
    null. Repeated rows and equal ids are documents like any others. An empty table
    gives no rows. Other columns are not read. Comparisons grow with the square of the distinct
    fingerprints, less what population counts rule out; that is the method.
    """
    plain = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    prints = written(fingerprints(plain, n), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mixed(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], names=[*batch.schema.names, "node"])

    known = distinct.mapInArrow(nodes, f"fp long, least {distinct.schema['least'].dataType.simpleString()}, node long")
    placed = known.join(components(links(distinct, radius)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "placed-fingerprints")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = placed.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
