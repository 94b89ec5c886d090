"""Exact top-k search by distributed histogram selection.

Queries are dealt in blocks, candidates in tiles, and each block meets each tile
in one group. A round scores all of them and counts, for each query, how many
scores fall in each bin of the range that holds its k-th highest; the counts of
all tiles together tell the bin, which the next round splits, until it is one
value wide. Where more rows have that value than there is room for, rounds of the
same kind over their ids find the last one to take. A final pass keeps the rows
that the selection has named, no more than k of a query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

SCALE = 256
BINS = 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_TILE, _BLOCK = 1 << 16, 1 << 12  # candidates and queries of a group
_ROWS = 256  # candidates scored at once
_EXACT = float(1 << 53)  # whole numbers in float64 are exact up to here


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """A row for each vector, as long as the longest; shorter ones end in zeros."""
    v = vectors.combine_chunks()
    sizes = np.asarray(v.value_lengths(), np.int64)
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(v.flatten())
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as Python's integers, which don't overflow."""
    return np.array([[int(y) * SCALE if abs(y) >= _EXACT else int(np.floor(y * SCALE)) for y in row] for row in x], object).reshape(x.shape)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, a row for each query. Those that a long can't hold become its nearest end."""
    wide = min(queries.shape[1], rows.shape[1])
    queries, rows = queries[:, :wide], rows[:, :wide]
    with np.errstate(over="ignore"):
        q, r = np.floor(queries * SCALE), np.floor(rows * SCALE)
        large_q, large_r = np.abs(q).sum(1) >= 1 << 28, np.abs(r).max(1, initial=0) >= 1 << 25
    out = np.empty((len(q), len(r)), np.int64)
    out[np.ix_(~large_q, ~large_r)] = (q[~large_q] @ r[~large_r].T).astype(np.int64)  # under 2**53
    for some, others in ((large_q, np.ones(len(r), bool)), (~large_q, large_r)):
        if some.any() and others.any():
            exact = _whole(queries[some]) @ _whole(rows[others]).T
            out[np.ix_(some, others)] = np.clip(exact, LEAST, MOST).astype(np.int64)
    return out


def _scored(tile: pa.Table, block: pa.Table):
    """Runs of a tile's candidates: their ids, their scores (queries x candidates), and which of these count."""
    own, ids = np.asarray(block.column("vec_id")), np.asarray(tile.column("vec_id"))
    queries, rows = _matrix(block.column("v")), _matrix(tile.column("v"))
    for at in range(0, len(ids), _ROWS):
        part = slice(at, at + _ROWS)
        yield ids[part], _scores(queries, rows[part]), own[:, None] != ids[None, part]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest-scoring other rows, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`; candidates are all
    rows with another id. A score is an integer inner product of floor(256 x),
    exact whatever its size; one that a long can't hold counts as the nearest end
    of a long's range. Rows with a null id, and vectors that are null or hold null
    or non-finite components, take no part; vectors of unequal length score over
    their common length; a query with fewer than k candidates gets them all.
    Repeated ids are candidates of their own, and a repeated query is asked once,
    with the vector that is smallest. An empty table gives no rows; other columns
    are not read. A group holds _TILE candidates and _BLOCK queries, whatever the
    size of the table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null")
    rows = rows.where("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    total, largest = F.expr(f"aggregate(v, 0D, (a, x) -> a + abs(x) * {SCALE}D + 1)"), F.expr(f"aggregate(v, 0D, (a, x) -> greatest(a, abs(x) * {SCALE}D + 1))")
    asks = F.col("vec_id") % every == 0
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("queries"), F.max(F.when(asks, total)).alias("sum"), F.max(largest).alias("most"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last")).first()
    if not known["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tiles, blocks = max(partitions(spark), -(-known["n"] // _TILE)), -(-known["queries"] // _BLOCK)
    candidates = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(tiles)).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")

    asked = rows.where(asks).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    bound = known["sum"] * known["most"] * 1.0001 + 1
    low, high = (int(-bound), int(bound)) if bound < MOST else (LEAST, MOST)
    none = F.lit(None).cast("long")
    # of a query: the k-th score and the last id of those with it (null until known), the bin's lower end, and how many are above it
    state = written(asked.select("block", "vec_id", "v", none.alias("kth"), none.alias("last_id"), F.lit(low).cast("long").alias("lower"), F.lit(0).cast("long").alias("above"), F.lit(False).alias("split")), "topk-queries")

    state = _selected(candidates, state, tiles, k, low, high, by_score=True)
    state = state.withColumn("kth", F.col("lower")).withColumn("last_id", F.lit(known["last"])).withColumn("lower", F.lit(~known["last"]).cast("long"))
    state = written(state, "topk-queries")
    if not state.where("split").isEmpty():
        state = _selected(candidates, state, tiles, k, ~known["last"], ~known["first"], by_score=False)
        state = state.withColumn("last_id", F.bitwise_not("lower"))

    def kept(tile: pa.Table, block: pa.Table) -> pa.Table:
        own, kth, last = (np.asarray(block.column(c)) for c in ("vec_id", "kth", "last_id"))
        found = []
        for ids, s, use in _scored(tile, block):
            q, c = np.nonzero(use & ((s > kth[:, None]) | (s == kth[:, None]) & (ids[None, :] <= last[:, None])))
            found.append((own[q], ids[c], s[q, c]))
        q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((v, s, q))
        q, v, s = q[order], v[order], s[order]
        more = np.ones(len(q), bool)  # of rows that are equal in all three, k are as good as all
        more[k:] = (q[k:] != q[:-k]) | (v[k:] != v[:-k]) | (s[k:] != s[:-k])
        return pa.table([pa.array(x[more], pa.int64()) for x in (q, v, s)], names=["query_id", "vec_id", "score"])

    best = _met(candidates, state, tiles, kept, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _met(candidates: DataFrame, state: DataFrame, tiles: int, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f of each tile of candidates with each block of queries."""
    queries = state.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))

    def both(tile: pa.Table, block: pa.Table) -> pa.Table:
        return f(tile, block) if tile.num_rows and block.num_rows else empty

    empty = pa.table([pa.array([], pa.int64()) for _ in schema.split(",")], names=[c.split()[0] for c in schema.split(", ")])
    return candidates.groupBy("tile", "block").cogroup(queries.groupBy("tile", "block")).applyInArrow(both, schema)


def _selected(candidates: DataFrame, state: DataFrame, tiles: int, k: int, low: int, high: int, by_score: bool) -> DataFrame:
    """state with `lower` at the value, from low to high, that the k-th highest candidate has.

    Values are scores; or, for queries marked `split`, the ids of candidates with
    the k-th score, inverted so that smaller ones are higher. `above` counts the
    candidates over `lower`; `split` says whether more than k have its value or a
    higher one. Queries with fewer than k candidates end with the lowest value.
    """
    width = 1
    while width * BINS <= high - low:
        width *= BINS  # so that all bins of all rounds are whole
    while True:

        def counts(tile: pa.Table, block: pa.Table, width=width) -> pa.Table:
            own, kth, lower, split = (np.asarray(block.column(c)) for c in ("vec_id", "kth", "lower", "split"))
            total = np.zeros((len(own), BINS), np.int64)
            for ids, s, use in _scored(tile, block):
                value = s if by_score else np.broadcast_to(~ids, s.shape)
                if not by_score:
                    use = use & (s == kth[:, None]) & split[:, None]
                bins = value.astype(np.uint64) - lower.astype(np.uint64)[:, None]  # of 64 bits, whatever the signs
                bins //= np.uint64(width)
                use = use & (value >= lower[:, None]) & (bins < BINS)
                q = np.broadcast_to(np.arange(len(own))[:, None], bins.shape)[use]
                total += np.bincount(q * BINS + bins[use].astype(np.int64), minlength=total.size).reshape(total.shape)
            q, b = np.nonzero(total)
            return pa.table([pa.array(x, pa.int64()) for x in (own[q], b, total[q, b])], names=["query", "bin", "n"])

        histogram = _met(candidates, state, tiles, counts, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        over = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
        reached = histogram.withColumn("over", over).join(state.select(F.col("vec_id").alias("query"), "above"), "query").where(F.col("above") + F.col("over") >= k)
        found = reached.groupBy("query").agg(F.max_by(F.struct("bin", "n", (F.col("above") + F.col("over")).alias("over")), "bin").alias("x")).select(F.col("query").alias("vec_id"), F.col("x.bin").alias("bin"), F.col("x.n").alias("n"), F.col("x.over").alias("over"))
        state = state.join(found, "vec_id", "left").select(
            "block", "vec_id", "v", "kth", "last_id",
            F.coalesce((F.col("lower").cast("decimal(38,0)") + F.col("bin") * F.lit(width).cast("decimal(38,0)")).cast("long"), F.col("lower")).alias("lower"),
            F.coalesce(F.col("over") - F.col("n"), F.col("above")).alias("above"),
            F.coalesce(F.col("over") > k, F.lit(False)).alias("split"),
        )
        state = written(state, "topk-queries")
        if width == 1:
            return state
        width //= BINS
