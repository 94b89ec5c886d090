"""Benchmark decontamination: rare n-grams of test items find passages, Smith-Waterman alignment scores them.

Words are runs of letters and digits, A-Z lower-cased. How rare an n-gram is
comes from the counts of its words in all documents, not from its own: a passage
that has leaked into many documents stays rare.

1. The words of the items are counted in all documents.
2. Each item gives its seeds: hashes of its rarer runs of two and of three words.
   An item of few words gives all its pairs of neighbours.
3. The n-grams of the documents that may be seeds (a bitmap of fixed size rules
   out most others) are joined with the seeds: pairs of a document and an item.
4. A document meets its items. Where enough pairs of neighbours of an item stand
   close together, the words around are aligned with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hashed_words, mixed, shingle_hashes, task_start, written

MATCH, MISMATCH, GAP = 2, -1, -1
WORD, PAIR, TRIPLE, NEAR_PAIR = 1, 2, 3, 4  # kinds of seeds; a near pair may have a word between
_SHORT, _FEW = 5, 8  # words of an item that has near pairs; that has all its pairs
_RARE = 1e-4  # chance occurrences of a run of three words in a document of mean length
_SLOTS = 1 << 26  # bits of a bitmap at most
_SMALL = 500_000  # rows of seeds that may be broadcast
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def best_alignment(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman over word hashes: the best local score, and the end of the alignment in the window."""
    n = len(window)
    slope = -GAP * np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    best, at = 0, 0
    for w in item:
        up = row + GAP
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(window == w, MATCH, MISMATCH))
        row = np.maximum(up, 0)
        row = np.maximum.accumulate(row + slope) - slope  # gaps along the window
        top = int(row.argmax())
        if row[top] > best:
            best, at = int(row[top]), top
    return best, at


def hashed(texts: list[str | None]) -> list[np.ndarray]:
    return hashed_words(texts, _WORDS)


def seed_hashes(h: np.ndarray, kind: int, of_item: bool) -> np.ndarray:
    """The seeds of a kind in a row of word hashes. In a document, near pairs may have a word between."""
    if kind == WORD:
        return mixed(h ^ np.uint64(WORD))
    if kind != NEAR_PAIR:
        return shingle_hashes(h, kind) if len(h) >= kind else h[:0]
    return np.concatenate([mixed(h[:-d] * np.uint64(3) + h[d:] + np.uint64(NEAR_PAIR)) for d in ((1,) if of_item else (1, 2)) if len(h) > d] or [h[:0]])


def least_pairs(m: int, least: float) -> int:
    """How many pairs of neighbours a passage must share with an item of m words, at least, to score `least`.

    M matches and E edits score 2M - E, stand in E + 1 runs at most, and so hold
    M - E - 1 pairs or more; with 2M - E >= 2 m least and M <= m that is (2 least - 1) m - 1.
    """
    return max(1, math.ceil((2 * least - 1) * m - 1 - 1e-9))


def _seeds_of(h: np.ndarray, share: np.ndarray, mean_words: float) -> Iterator[tuple[int, np.ndarray]]:
    """Kinds and hashes of an item's seeds. share: of each of its words among all words."""
    m = len(h)
    if m == 1:
        yield WORD, seed_hashes(h, WORD, True)
    elif m <= _SHORT:
        yield NEAR_PAIR, seed_hashes(h, NEAR_PAIR, True)
    else:
        pairs, triples = share[:-1] * share[1:] * mean_words, share[:-2] * share[1:-1] * share[2:] * mean_words
        yield PAIR, seed_hashes(h, PAIR, True)[pairs <= (np.inf if m <= _FEW else np.median(pairs))]
        yield TRIPLE, seed_hashes(h, TRIPLE, True)[triples <= max(_RARE, np.median(triples))]


def _bits(rows: DataFrame, column: str, n: int) -> tuple[np.ndarray, int]:
    """A bitmap of the low bits of a column of n hashes, and the mask of these bits. No more than _SLOTS rows come to the driver."""
    slots = min(_SLOTS, 1 << max(10, (16 * n).bit_length()))
    bits = np.zeros(slots, bool)
    bits[np.array(rows.select(F.col(column).bitwiseAND(F.lit(slots - 1)).alias("slot")).distinct().toArrow().column("slot"), np.int64)] = True
    return np.packbits(bits, bitorder="little"), slots - 1


def _in(bits: np.ndarray, mask: int, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(mask)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(docs: DataFrame, item_words: DataFrame) -> DataFrame:
    """word, n: how often the words of items, and some more, are in docs; word null for all words, and n < 0 for the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(_bits(item_words, "word", item_words.count()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        bits, mask = shared.value
        for batch in batches:
            h = np.concatenate([np.zeros(0, np.uint64), *hashed(batch.column(0).to_pylist())])
            some, n = np.unique(h[_in(bits, mask, h)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*some.view(np.int64).tolist(), None, None], pa.int64()), pa.array([*n.tolist(), len(h), -batch.num_rows], pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(counted, "word long, n long").groupBy("word", (F.col("n") < 0).alias("documents")).agg(F.sum("n").alias("n"))


def _key(rows: DataFrame) -> Column:
    """Brings a document's items to it; two documents with one key only look at each other's items too."""
    return F.xxhash64(rows["doc_id"].cast("string"), rows["text"])


def _candidates(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, items (array of item_id, text): for each document the items with a seed in it."""
    spark = docs.sparkSession
    items = written(benchmark.select("item_id", "text").where("text is not null").distinct().withColumn("item", F.xxhash64(F.col("item_id").cast("string"), "text")), "items")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        for batch in batches:
            rows = hashed(batch.column(1).to_pylist())
            n = np.array([len(h) for h in rows], np.int64)
            at = np.concatenate([np.arange(k) for k in n]) if len(n) else n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(at, pa.int64()), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64))], names=["item", "at", "word"])

    placed = written(items.select("item", "text").mapInArrow(split, "item long, at long, word long"), "item-words")
    counts = written(_counted(docs, placed.select("word").distinct()), "word-counts")
    total = {r.documents: r.n for r in counts.where("word is null").collect()}  # two rows
    all_words, mean_words = max(1, total.get(False, 0)), total.get(False, 0) / max(1, -total.get(True, 0))
    rows = placed.join(counts.where("word is not null").select("word", "n"), "word", "left").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", "word", F.coalesce("n", F.lit(1)).alias("n")))).alias("ws"))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for item, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.array([w["word"] for w in ws], np.int64).view(np.uint64)
                for kind, seeds in _seeds_of(h, np.array([w["n"] for w in ws]) / all_words, mean_words):
                    out += [(kind, s, item) for s in np.unique(seeds.view(np.int64)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["kind", "seed", "item"])

    seeds = written(rows.mapInArrow(seeded, "kind long, seed long, item long"), "seeds")
    n, kinds = seeds.count(), [r.kind for r in seeds.select("kind").distinct().collect()]
    shared = spark.sparkContext.broadcast(_bits(seeds, "seed", n))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        bits, mask = shared.value
        for batch in batches:
            found, owners = [np.zeros(0, np.uint64)], []
            for h in hashed(batch.column(1).to_pylist()):
                grams = np.concatenate([h[:0], *(seed_hashes(h, kind, False) for kind in kinds)])
                found.append(np.unique(grams[_in(bits, mask, grams)]))
                owners.append(len(found[-1]))
            keys = np.repeat(np.asarray(batch.column(0)), np.array(owners, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(found).view(np.int64))], names=["key", "seed"])

    hits = docs.select(_key(docs).alias("key"), "text").mapInArrow(met, "key long, seed long")
    known = seeds.select("seed", "item")
    pairs = hits.join(F.broadcast(known) if n <= _SMALL else known, "seed").select("key", "item").distinct()
    few = items.count() <= _SMALL // 10
    return pairs.join(F.broadcast(items) if few else items, "item").groupBy("key").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))


class _Items:
    """The items of one document, to be looked for in it."""

    def __init__(self, texts: list[str], least: float):
        self.words = hashed(texts)
        self.least, self.keys = least, {}
        for kind in (WORD, NEAR_PAIR, PAIR):
            of = [k for k, h in enumerate(self.words) if kind == (WORD if len(h) == 1 else NEAR_PAIR if len(h) <= _SHORT else PAIR)]
            if of:
                grams = [seed_hashes(self.words[k], kind, True) for k in of]
                key, owner, offset = np.concatenate(grams), np.repeat(of, [len(g) for g in grams]), np.concatenate([np.arange(len(g)) for g in grams])
                order = np.argsort(key, kind="stable")
                self.keys[kind] = key[order], owner[order], offset[order]

    def hits(self, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Of each item with any, where it would begin by each of its pairs that the document has; ascending."""
        for kind, (key, owner, offset) in self.keys.items():
            for d in (1, 2) if kind == NEAR_PAIR else (1,):
                grams = seed_hashes(doc, kind, True) if d == 1 else mixed(doc[:-2] * np.uint64(3) + doc[2:] + np.uint64(NEAR_PAIR)) if len(doc) > 2 else doc[:0]
                low, high = np.searchsorted(key, grams, "left"), np.searchsorted(key, grams, "right")
                n = high - low
                at = np.repeat(np.arange(len(grams)), n)
                row = np.repeat(low, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                yield owner[row], at - offset[row]

    def found(self, doc: np.ndarray) -> list[tuple[int, float, int, int]]:
        """item, score, first and last word: of each item the best alignment that reaches `least`."""
        hits = [*self.hits(doc)]
        if not hits:
            return []
        owner, start = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        out = []
        for k in np.unique(owner).tolist():
            low, high = np.searchsorted(owner, [k, k + 1])
            best = self.best(doc, self.words[k], start[low:high])
            if best[0] >= self.least:
                out.append((k, *best))
        return out

    def best(self, doc: np.ndarray, item: np.ndarray, starts: np.ndarray) -> tuple[float, int, int]:
        m, best = len(item), (0.0, 0, 0)
        cuts = np.flatnonzero(np.diff(starts) > m) + 1  # all pairs of one alignment begin less than m apart from the next
        for part in np.split(starts, cuts):
            if len(part) < (least_pairs(m, self.least) if m > _SHORT else 1):
                continue
            low, high = max(0, int(part[0]) - m), int(part[-1]) + 2 * m
            score, end = best_alignment(item, doc[low:high])
            if score / (MATCH * m) > best[0]:
                _, back = best_alignment(item[::-1], doc[low : low + end][::-1])
                best = score / (MATCH * m), low + end - back, low + end - 1
        return best


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: documents that hold a test item, copied or edited.

    score is the best local alignment's (2 a word, -1 a replaced, missing or
    added one) in parts of what the whole item would have; rows with `least` or more
    come back, one for each pair of a document and an item. Repeated rows of docs
    give repeated results. Null and empty texts hold nothing, and items without
    words are nowhere. Items of up to 8 words have all their pairs of neighbours
    as seeds, so no score of 0.6 is missed; longer ones the rarer half of their
    pairs and triples. Items that repeat id and text count once, others with one
    id are items of their own; null ids stay null. Of docs, doc_id and text are
    read; of benchmark, item_id and text. Very long texts are searched whole, an
    empty table on either side gives no rows.
    """
    id_type, item_type = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", item_type), *(T.StructField(c, t) for c, t in (("score", T.DoubleType()), ("first_word", T.IntegerType()), ("last_word", T.IntegerType())))])
    rows = docs.select("doc_id", "text")
    joined = rows.withColumn("key", _key(rows)).join(_candidates(rows, benchmark), "key").select("doc_id", "text", "items")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        for batch in batches:
            of, found = [], []
            items = batch.column(2)
            first = np.asarray(items.offsets)
            for i, (doc, own) in enumerate(zip(hashed(batch.column(1).to_pylist()), items.to_pylist(), strict=True)):
                for k, *x in _Items([o["text"] for o in own], least).found(doc):
                    of.append(i)
                    found.append((first[i] + k, *x))
            item, score, begin, end = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), items.values.field("item_id").take(pa.array(item, pa.int64())), pa.array(score, pa.float64()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())],
                names=schema.names,
            )

    return joined.mapInArrow(search, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.6) -> DataFrame:
    """The rows of docs, with all their columns, that hold no test item as leaks() finds them."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), _key(docs).alias("key"))
    joined = rows.join(_candidates(docs.select("doc_id", "text"), benchmark), "key", "left").select("row", F.transform("items", lambda i: i["text"]).alias("items"))
    column = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        for batch in batches:
            texts = batch.column(0).field(column).to_pylist()
            keep = [not own or not _Items(own, least).found(hashed([t])[0]) for t, own in zip(texts, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=["row"])

    kept = joined.mapInArrow(clean, T.StructType([T.StructField("row", docs.schema)]))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
