"""Join of documents by the Jaccard similarity of their word n-grams, with signature trees.

1. Documents with equal sets become one class; all that follows is on classes.
2. Two sets similar enough share one of their first few n-grams in any fixed
   order of all n-grams. The order puts n-grams of rare words first, so few
   classes that are unlike meet. Classes that share such a key form a block. With
   one n-gram more, two sets share two: a key of very many classes gives way to
   its pairs with their other n-grams (with all: of what two sets share, other
   n-grams may come between). In what is large still, one class meets all others
   of about its size, and only classes unlike it meet the rest, in tiles.
3. A block is a signature tree: a leaf is a class with a bitmap of its n-grams, a
   node holds the bitmaps of its leaves, combined by OR, and the range of their
   sizes. Two trees are traversed together; pairs of nodes whose bitmaps and
   sizes leave no room for enough common n-grams are pruned.
4. The pairs that are left connect candidates. Inside each group of candidates
   all pairs meet again in a tree, now with their sets, and those not connected
   yet are compared exactly. Links give the components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, hashed_words, mixed, partitions, shingle_hashes, task_start, version_of, whole_ids, written

_SLOTS = 1 << 20  # counters of words: fixed, words share them by hash
_BYTES = 128  # of a bitmap at least; it has as many bits as n-grams at least
_TILE = 2048  # classes of a block or group compared at once
_LEAF, _FAN = 32, 8
_SMALL = 500_000  # rows of two longs that may be broadcast


def _word_ranks(docs: DataFrame) -> np.ndarray:
    """For each slot the binary logarithm of how often its words occur in all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        for batch in batches:
            h = np.concatenate([np.zeros(0, np.uint64), *hashed_words(batch.column(0).to_pylist())])
            some, n = np.unique((h & np.uint64(_SLOTS - 1)).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n.astype(np.int64))], names=["slot", "n"])

    counts = docs.select("text").mapInArrow(counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    table = counts.where("n >= 8").select("slot", F.floor(F.log2("n")).cast("int").alias("rank")).toArrow()  # _SLOTS rows at most
    ranks = np.zeros(_SLOTS, np.uint8)
    ranks[np.array(table.column("slot"), np.int64)] = np.array(table.column("rank"))
    return ranks


def _bitmap(grams: np.ndarray) -> bytes:
    """Bits by hash; as many as the next power of two, so that a longer bitmap folds onto a shorter one."""
    size = max(_BYTES * 8, 1 << (len(grams) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(mixed(grams) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _set_of(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of word hashes by ascending hash, and where each begins."""
    return np.unique(shingle_hashes(h, n), return_index=True)


def _class_of(grams: np.ndarray) -> bytes:
    """What a set is known by: 128 bits."""
    return hashlib.md5(grams.tobytes()).digest()


def _signatures(docs: DataFrame, n: int, num: int, den: int, ranks: np.ndarray) -> DataFrame:
    """id, version, n, node of each document, and bitmap and keys of the first of each class in a batch; without words n is 0 and node null.

    The last key is the one more that two similar sets need to share two.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        for batch in batches:
            sizes, nodes, maps, keys, seen = [], [], [], [], set()
            for h in hashed_words(batch.column(2).to_pylist()):
                grams, at = _set_of(h, n)
                size = len(grams)
                sizes.append(size)
                nodes.append(_class_of(grams) if size else None)
                if not size or nodes[-1] in seen:
                    maps.append(None), keys.append(None)
                    continue
                seen.add(nodes[-1])
                rank = shared.value[(h & np.uint64(_SLOTS - 1)).astype(np.int64)].astype(np.int64)
                width = min(n, len(h))
                common = sum(rank[i : len(rank) - width + 1 + i] for i in range(width))[at]
                first = size + (-size * num // den) + 1  # a set as similar has ceil(size * num / den) of them at least
                maps.append(_bitmap(grams))
                keys.append(grams[np.lexsort((grams, common))[: first + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(maps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "version", "n", "node", "bitmap", "keys"])

    return docs.mapInArrow(signed, "id long, version long, n long, node binary, bitmap binary, keys array<long>")


def _room(overlap, size_sum, num: int, den: int):
    """Whether sets with these sizes can be similar if no more than `overlap` is common."""
    return overlap * (den + num) >= num * size_sum


class _Tree:
    """A signature tree over rows of bitmaps, in the order that puts like ones together."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        self.order = np.lexsort((maps[:, 1], maps[:, 0], sizes))
        n, m = sizes[self.order], maps[self.order]
        self.sizes, self.maps = n, m
        self.spare = n - np.bitwise_count(m).sum(1, dtype=np.int64)  # n-grams that share a bit with another
        self.levels = []
        low, high, spare = n, n, self.spare
        width = _LEAF
        while True:
            cuts = np.arange(0, len(low), width)
            low, high, spare = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(spare, cuts)
            m = np.bitwise_or.reduceat(m, cuts, axis=0)
            self.levels.append((low, high, spare, m))
            width = _FAN
            if len(low) == 1:
                break


def _pairs(a: _Tree, b: _Tree, num: int, den: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two trees with room for enough common n-grams, by dual traversal, level by level."""
    top = max(len(a.levels), len(b.levels)) - 1
    p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for depth in range(top, -1, -1):
        la, lb = a.levels[min(depth, len(a.levels) - 1)], b.levels[min(depth, len(b.levels) - 1)]
        if depth < top:
            p, q = _children(p, len(la[0]), depth < len(a.levels) - 1, q, len(lb[0]), depth < len(b.levels) - 1)
        keep = []
        for s in range(0, len(p), 1 << 14):
            x, y = p[s : s + (1 << 14)], q[s : s + (1 << 14)]
            ok = (la[1][x] * den >= num * lb[0][y]) & (lb[1][y] * den >= num * la[0][x])
            if same:
                ok &= x <= y
            common = np.bitwise_count(la[3][x] & lb[3][y]).sum(1, dtype=np.int64)
            ok &= _room(common + np.minimum(la[2][x], lb[2][y]), la[0][x] + lb[0][y], num, den)
            keep.append(np.flatnonzero(ok) + s)
        keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        p, q = p[keep], q[keep]
    for x, y in zip(p, q, strict=True):
        i, j = slice(x * _LEAF, (x + 1) * _LEAF), slice(y * _LEAF, (y + 1) * _LEAF)
        common = np.bitwise_count(a.maps[i][:, None, :] & b.maps[j][None, :, :]).sum(2, dtype=np.int64)
        sizes = a.sizes[i][:, None] + b.sizes[j][None, :]
        ok = _room(common + np.minimum(a.spare[i][:, None], b.spare[j][None, :]), sizes, num, den)
        if same and x == y:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        r, c = np.nonzero(ok)
        if len(r):
            yield a.order[r + x * _LEAF], b.order[c + y * _LEAF]


def _children(p, na, split_a, q, nb, split_b):
    def spread(x, n, split):
        if not split:
            return x[:, None], np.ones((len(x), 1), bool)
        c = x[:, None] * _FAN + np.arange(_FAN)
        return c, c < n

    (ca, oka), (cb, okb) = spread(p, na, split_a), spread(q, nb, split_b)
    shape = (len(p), ca.shape[1], cb.shape[1])
    ok = oka[:, :, None] & okb[:, None, :]
    return np.broadcast_to(ca[:, :, None], shape)[ok], np.broadcast_to(cb[:, None, :], shape)[ok]


class _Union:
    def __init__(self, n: int):
        self.of = list(range(n))

    def find(self, x: int) -> int:
        of = self.of
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.of[max(x, y)] = min(x, y)


def _found(sizes: np.ndarray, maps: list[bytes], sides: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a block with room for enough common n-grams. A longer bitmap is folded onto a shorter one's length.

    Rows of sides 0 and 1 meet across; with a row of side -1, all meet.
    """
    lengths = np.array([len(m) for m in maps])
    both = bool(sides.min() >= 0)
    for length in np.unique(lengths):
        trees: dict[tuple[bool, int], tuple[np.ndarray, _Tree]] = {}
        most = length << math.ceil(math.log2(den / num))  # sets with longer ones are too large
        for longer, rows in ((False, lengths == length), (True, (lengths > length) & (lengths <= most))):
            for side in (0, 1) if both else (-1,):
                at = np.flatnonzero(rows & (sides == side)) if both else np.flatnonzero(rows)
                if len(at):
                    trees[longer, side] = at, _Tree(sizes[at], np.stack([_folded(maps[i], length) for i in at]))
        meets = [((False, 0), (False, 1)), ((False, 0), (True, 1)), ((False, 1), (True, 0))] if both else [((False, -1), (False, -1)), ((False, -1), (True, -1))]
        for one, two in meets:
            if one in trees and two in trees:
                (i, a), (j, b) = trees[one], trees[two]
                for x, y in _pairs(a, b, num, den, one == two):
                    yield i[x], j[y]


def _folded(bitmap: bytes, length: int) -> np.ndarray:
    """A bitmap on `length` bytes."""
    return np.bitwise_or.reduce(np.frombuffer(bitmap, np.uint64).reshape(len(bitmap) // length, -1), axis=0)


def _compared(nodes: np.ndarray, sizes: np.ndarray, maps: list[bytes], sides: np.ndarray, sets, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the rows of one block as all its pairs would; with sets, pairs are compared exactly."""
    union = _Union(len(nodes))
    if len(nodes) == 2:
        close = sets is not None or _close(sizes, maps, num, den)
        found: Iterator = iter([(np.zeros(1, np.int64), np.ones(1, np.int64))] if close else ())
    else:
        found = _found(sizes, maps, sides, num, den)
    label = np.arange(len(nodes))  # as of the last refresh: equal labels are connected for sure
    for xs, ys in found:
        apart = label[xs] != label[ys]
        joined = False
        for x, y in zip(xs[apart].tolist(), ys[apart].tolist(), strict=True):
            if union.find(x) != union.find(y) and (sets is None or _similar(sets[x], sets[y], num, den)):
                union.join(x, y)
                joined = True
        if joined:
            label = np.array([union.find(x) for x in range(len(nodes))]) if len(nodes) <= 64 else _refreshed(union)
    root = np.array([union.find(x) for x in range(len(nodes))])
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _refreshed(union: _Union) -> np.ndarray:
    label = np.array(union.of)
    while True:
        further = label[label]
        if (further == label).all():
            return label
        label = further


def _close(sizes: np.ndarray, maps: list[bytes], num: int, den: int) -> bool:
    """As the tree decides for two leaves."""
    if sizes.min() * den < num * sizes.max():
        return False
    a, b = (_folded(m, min(map(len, maps))) for m in maps)
    spare = int((sizes - np.bitwise_count(np.stack([a, b])).sum(1, dtype=np.int64)).min())
    return bool(_room(int(np.bitwise_count(a & b).sum()) + spare, int(sizes.sum()), num, den))


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common * den >= num * (len(both) - common)


def _by_block(rows: DataFrame, num: int, den: int, exact: bool) -> DataFrame:
    """a, b: for rows (block, side, node, n, bitmap[, set]) the edges of each block. A block has two tiles at most."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        held: pa.Table | None = None

        def handle(t: pa.Table) -> pa.RecordBatch:
            block, side, node, n = (np.array(t.column(k)) for k in ("block", "side", "node", "n"))
            maps = t.column("bitmap").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()] if exact else None
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            found: set[tuple[bytes, bytes]] = set()
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j - i > 1:
                    found.update(zip(*_compared(node[i:j], n[i:j], maps[i:j], side[i:j], sets and sets[i:j], num, den), strict=True))
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            block = np.array(held.column("block"))
            whole = int(np.searchsorted(block, block[-1])) if len(block) else 0
            if whole:
                yield handle(held.slice(0, whole))
                held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield handle(held)

    columns = ["block", "side", "node", "n", "bitmap"] + ["set"] * exact
    spread = rows.select(*columns).repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block")
    return spread.mapInArrow(edges, "a binary, b binary")


def _edges(rows: DataFrame, group: str, bands: bool, num: int, den: int, maps: DataFrame | None = None) -> DataFrame:
    """a, b: edges that connect the rows (group, node, n) of each group as all its pairs would.

    maps: bitmaps by node, where rows have none; rows that have sets are compared
    exactly. A group of over _TILE rows is split by size, if bands says so: sets
    whose sizes differ by more than a band can't be similar. There
    1. one row of each band meets all of its own band and the next ones;
    2. rows which that has not connected with their band's meet all others, in
       tiles. Bands meet where they aren't connected.
    So near copies, however many, meet one of them each; tiles grow with the square
    of what is unlike.
    """

    def compared(blocks: DataFrame) -> DataFrame:
        return _by_block(blocks if maps is None else blocks.join(maps, "node"), num, den, "set" in rows.columns)

    step = max(1e-6, math.log(den / num) * 1.0001)
    rows = rows.withColumn("band", F.floor(F.log("n") / step).cast("long") if bands else F.lit(0).cast("long"))
    wide = written(rows.groupBy(group).count().where(F.col("count") > _TILE).select(group), "wide-groups")
    if wide.isEmpty():
        return compared(rows.withColumn("block", F.xxhash64(group)).withColumn("side", F.lit(-1)))
    narrow = compared(rows.join(wide, group, "left_anti").withColumn("block", F.xxhash64(group)).withColumn("side", F.lit(-1)))
    rows = rows.join(wide, group)

    firsts = written(rows.groupBy(group, "band").agg(F.min("node").alias("first"), F.ceil(F.count(F.lit(1)) / _TILE).cast("long").alias("parts")), "band-firsts")
    meets = firsts.select(group, F.col("band").alias("of"), "first", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("band"))
    meets = meets.join(firsts.select(group, "band", "parts"), [group, "band"])
    around = rows.join(meets, [group, "band"]).where("node <> first").withColumn("part", F.expr("pmod(xxhash64(node), parts)")).withColumn("side", F.lit(1))
    heads = meets.select(group, "of", F.col("band").alias("beside"), "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    heads = heads.join(rows.withColumnRenamed("node", "first"), [group, "first"]).withColumn("node", F.col("first")).withColumn("band", F.col("beside")).withColumn("side", F.lit(0))
    own = [c for c in rows.columns if c not in (group, "band")]
    block = F.xxhash64(group, "of", "band", "part").alias("block")
    stars = written(compared(around.select(block, "side", *own).unionByName(heads.select(block, "side", *own))), "stars")

    joined = written(components(stars).withColumnRenamed("root", "tied"), "joined")
    roots = rows.select(group, "band", "node").join(joined, "node", "left").select(group, "band", "node", F.coalesce("tied", "node").alias("tied"))
    main = firsts.join(joined, firsts["first"] == joined["node"], "left").select(group, "band", F.coalesce("tied", "first").alias("main"))
    placed = written(roots.join(main, [group, "band"]).select(group, "node", "band", (F.col("tied") != F.col("main")).alias("apart"), "main"), "placed")
    cells = written(placed.groupBy(group, "band", "apart").agg(F.ceil(F.count(F.lit(1)) / _TILE).cast("long").alias("tiles"), F.first("main").alias("main")), "cells")
    left = cells.select(group, *(F.col(c).alias(f"{c}_l") for c in ("band", "apart", "tiles", "main")))
    right = cells.select(group, *(F.col(c).alias(f"{c}_r") for c in ("band", "apart", "tiles", "main")), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band_l"))
    known = "NOT apart_l AND NOT apart_r AND main_l = main_r"
    pairs = written(left.join(right, [group, "band_l"]).where(f"(band_l < band_r OR apart_l <= apart_r) AND NOT ({known})"), "cell-pairs")
    whole = rows.join(placed.select(group, "node", "apart"), [group, "node"])

    def side(own: str, other: str) -> DataFrame:
        at = whole.join(pairs.select("*", F.col(f"band_{own}").alias("band"), F.col(f"apart_{own}").alias("apart")), [group, "band", "apart"])
        return at.withColumn("i", F.expr(f"pmod(xxhash64(node), tiles_{own})")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"tiles_{other}") - 1)))

    same = "band_l = band_r AND apart_l = apart_r"
    one = side("l", "r").withColumn("side", F.expr(f"CASE WHEN NOT ({same}) THEN 0 WHEN i = j THEN -1 WHEN i < j THEN 0 ELSE 1 END"))
    one = one.withColumn("p", F.expr(f"IF({same}, least(i, j), i)")).withColumn("q", F.expr(f"IF({same}, greatest(i, j), j)"))
    two = side("r", "l").where(f"NOT ({same})").withColumn("side", F.lit(1)).withColumn("p", F.col("j")).withColumn("q", F.col("i"))
    block = F.xxhash64(group, "band_l", "apart_l", "band_r", "apart_r", "p", "q").alias("block")
    return narrow.unionByName(stars).unionByName(compared(one.select(block, "side", *own).unionByName(two.select(block, "side", *own))))


def components(edges: DataFrame) -> DataFrame:
    """node, root for the nodes of edges (a, b): the smallest node reachable.

    Every node goes to its smallest neighbour and edges join what they went to,
    until none is left. Nodes are hashes, so a constant share goes each round.
    """
    edges = written(edges.where("a <> b").distinct(), "edges")
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "hops")
        if found is None:
            found = hop.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            found = written(found.join(hop, found["root"] == hop["a"], "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        one, two = hop.select("a", F.col("to").alias("x")), hop.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = written(edges.join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found


def _shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows of keyed (key, node, n) whose key has several nodes, with their number as `nodes`.

    Keys with more than a fair share of all rows are spread over several tasks;
    there are few of them, as each has a 4P-th of the rows, with P partitions.
    """
    spread = partitions(keyed.sparkSession)
    counts = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1"), "key-counts")
    rows = counts.agg(F.sum("nodes")).first()[0] or 0
    common = counts.where(F.col("nodes") > max(64, rows // (4 * spread))).select("key", F.lit(spread).alias("salts"))
    keyed = keyed.join(F.broadcast(common), "key", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), "salts")).cast("int")).drop("salts")
    counts = counts.join(F.broadcast(common), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return keyed.join(counts, ["key", "salt"]).drop("salt")


def _hits(signed: DataFrame, num: int, den: int) -> DataFrame:
    """key, node, n: classes (node, n, keys) by keys that several share; a wide key by pairs with each other key of its classes.

    Similar sets share one of their keys but the last one more. Over a threshold
    of a half, sets that differ have two n-grams in common at least, and then they
    share two of all their keys.
    """
    own = F.expr(f"slice(keys, 1, cast(n - (n * {num} + {den - 1}) div {den} + 1 as int))")
    keyed = written(signed.select(F.explode(own).alias("key"), "node", "n").distinct(), "keys")
    shared = written(_shared_keys(keyed), "shared-keys")
    if 2 * num <= den:
        return shared.select("key", "node", "n")
    wide = shared.where(F.col("nodes") > _TILE)
    narrow = shared.where(F.col("nodes") <= _TILE).select("key", "node", "n")
    if wide.isEmpty():
        return narrow
    whole = signed.dropDuplicates(["node"]).select("node", "keys")
    pairs = wide.join(whole, "node").select(F.col("key").alias("one"), "node", "n", F.explode("keys").alias("other")).where("one <> other")
    pairs = pairs.select(F.xxhash64(F.least("one", "other"), F.greatest("one", "other")).alias("key"), "node", "n").distinct()
    return narrow.unionByName(_shared_keys(written(pairs, "key-pairs")).select("key", "node", "n"))


def similar_documents(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link if the Jaccard similarity of their sets of word n-grams is
    num / den or more; component_id is the smallest id reachable by links. Texts
    with fewer than n words count as one gram; null texts, and those without
    words, have none and no links, and are components of their own. Null ids come
    after all others: a component has a null id if all its ids are null. Repeated
    rows and equal ids are documents like any others. An empty table gives no
    rows; other columns are not read. Very long texts are taken whole. Ids that are
    not whole numbers, and a threshold that is not over 0 and up to 1, raise
    ValueError. Sets are compared by 64-bit hashes of their n-grams, and equal ones
    known by the 128 bits of their MD5.
    """
    return _placed(docs, n, num, den, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def _placed(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """similar_documents, with the version of each row and the root of its component (null without words)."""
    whole_ids(docs, id_col)
    if not 0 < num <= den:
        raise ValueError("the threshold must be over 0 and up to 1")
    plain = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), docs[text_col].alias("text"), version_of(docs[id_col], docs[text_col]).alias("version"))
    signatures = written(_signatures(plain.select("id", "version", "text"), n, num, den, _word_ranks(plain)), "signatures")
    some = signatures.where("node is not null")
    classes = written(some.groupBy("node").agg(F.min("id").alias("any_id"), F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("least")), "classes")
    bitmaps = some.where("bitmap is not null").select("node", "bitmap").dropDuplicates(["node"])

    hits = written(_hits(some.where("keys is not null").select("node", "n", "keys"), num, den), "hits")
    candidates = components(_edges(hits, "key", True, num, den, bitmaps))
    wanted = written(candidates.join(classes.select("node", "any_id"), "node").select(F.col("any_id").alias("id"), F.col("node").alias("wanted"), "root"), "candidates")
    if wanted.count() <= _SMALL:
        texts = plain.join(F.broadcast(wanted), "id")
    else:
        texts = plain.join(wanted, "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        for batch in batches:
            kept, sizes, maps, data = [], [], [], []
            for i, (h, node) in enumerate(zip(hashed_words(batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True)):
                grams, _ = _set_of(h, n)
                if len(grams) and _class_of(grams) == node:  # rows of one id may have different texts
                    kept.append(i)
                    sizes.append(len(grams))
                    maps.append(_bitmap(grams))
                    data.append(grams.tobytes())
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()), pa.array(data, pa.binary())], names=["node", "root", "n", "bitmap", "set"])

    full = written(texts.select("text", "wanted", "root").mapInArrow(sets, "node binary, root binary, n long, bitmap binary, set binary").dropDuplicates(["node"]), "sets")
    linked = components(_edges(full, "root", False, num, den))

    placed = classes.select("node", "least").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = placed.join(least, "root").select("node", "root", "component_id")
    own = F.when(F.col("id") != NO_ID, F.col("id"))
    out = signatures.select("id", "version", "n", "node").join(of_node, "node", "left")
    return out.select(own.alias("doc_id"), "version", "root", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), own).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component.

    First is the smallest id (null ids last), of one id the smallest version; rows
    that repeat both stay, and so do rows without words.
    """
    placed = written(_placed(docs, n, num, den).where("root is not null").select("root", F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "version").alias("key")), "near-copies")
    first = placed.groupBy("root").agg(F.min("key").alias("first"))
    dropped = written(placed.join(first, "root").where("key <> first").select(F.col("key.id").alias("id"), "key.version").distinct(), "dropped")
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"), version_of(docs["doc_id"], docs["text"]).alias("version"))
    kept = keyed.join(F.broadcast(dropped) if dropped.count() <= _SMALL else dropped, ["id", "version"], "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
