"""Removal of repeated strings with suffix arrays sorted in two stages.

A byte goes if a string of `length` bytes over it also starts earlier in the
corpus. Sorting all suffixes of a corpus is not needed for that: two equal
strings of that length choose the same anchor, the least hash of the short grams
in them, so they meet if texts are dealt by anchors.

1. Each run of starts with one anchor (a context: the bytes of all strings that
   start in it) gives a row: hash of the anchor, hashes of the context, place.
   Copies of a whole context give few rows: a task keeps only the first in some
   megabytes, and of the rest only the first of the corpus goes on.
2. Anchors that have different contexts are where repeats begin or end. Only
   their bytes are fetched; their suffixes are sorted in two stages, and equal
   neighbours by common prefix show which starts are repeats.
3. An anchor with very many contexts is made longer first, to the left for the
   strings that have enough room there and to the right for the others, so that
   its contexts are sorted in several parts. The more of a string its anchor
   takes, the fewer different contexts are left; with all of it, there is one.
4. The repeats of a document are joined to it and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, mixed, partitions, task_start, version_of, whole_ids, written

_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_CHUNK = 1 << 18  # bytes hashed at once; positions in it take 22 bits
_HELD = 1 << 18  # contexts held before they go out
_SORTED = 1 << 20  # bytes of contexts whose suffixes are sorted at once
_WIDE = 1000  # contexts of one anchor beyond which it is made longer
_HOT = 1024  # copies of a part beyond which they are dealt to _SALTS tasks
_SALTS = 16
_RUNS = "doc long, version long, start long, n long"
_ROWS = ["anchor", "context", "check", "doc", "version", "start", "n", "at"]
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))  # a number for each byte, for the second hash


def _key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    whole_ids(docs, id_col)
    return F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc"), version_of(docs[id_col], docs[text_col]).alias("version")


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class _Anchors:
    """Contexts of a run of texts."""

    def __init__(self, length: int):
        self.length, self.gram = length, max(1, length // 3)
        self.up, self.down = _powers(_CHUNK + 1, _BASE)
        self.other_up, self.other_down = _powers(_CHUNK + 1, _OTHER_BASE)

    def of(self, text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """text: bytes of several texts; left: at each byte, how many its own text has from there on.

        Returns anchor hash, context hash, 32 bits of an independent one, first
        start, number of starts, and the anchor's place after the first start of
        each context. Contexts are equal if anchors, both hashes and places are.
        """
        n, g, width = len(text), self.gram, self.length - self.gram + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        grams = mixed((sums[g:] - sums[:-g]) * self.down[: n - g + 1])
        least = (grams & ~np.uint64((1 << 22) - 1)) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: -(width - span)], least[width - span :])
        at = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
        whole = left[: len(at)] >= self.length
        change = np.ones(len(at) + 1, bool)
        change[1:-1] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1]) | (left[: len(at) - 1] < left[1 : len(at)])
        starts = np.flatnonzero(change)
        first, end = starts[:-1], starts[1:]
        first, end = first[whole[first]], end[whole[first]]
        to = end + self.length - 1
        context = mixed((sums[to] - sums[first]) * self.down[first] + (to - first).astype(np.uint64))
        sums[1:] = np.cumsum(_BYTES[text] * self.other_up[:n])
        check = mixed((sums[to] - sums[first]) * self.other_down[first]) >> np.uint64(32)
        return grams[at[first]].view(np.int64), context.view(np.int64), check.astype(np.int64), first, end - first, at[first] - first


def _contexts(docs: DataFrame, length: int) -> DataFrame:
    """_ROWS: contexts with n > 0; with n < 0, repeats that a task has found itself."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        anchors = _Anchors(length)
        for batch in batches:
            ids, versions = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            rows: list[list[np.ndarray]] = []
            texts, owners, offsets, filled = [], [], [], 0

            def flush():
                nonlocal texts, owners, offsets, filled
                if filled:
                    sizes = np.array([len(t) for t in texts])
                    text = np.frombuffer(b"".join(texts), np.uint8)
                    ends = np.cumsum(sizes)
                    left = np.repeat(ends, sizes) - np.arange(len(text))
                    anchor, context, check, first, n, at = anchors.of(text, left)
                    k = np.searchsorted(ends, first, side="right")
                    of = np.array(owners)[k]
                    rows.append([anchor, context, check, ids[of], versions[of], first - (ends - sizes)[k] + np.array(offsets)[k], n, at])
                texts, owners, offsets, filled = [], [], [], 0

            for i, value in enumerate(batch.column(2)):
                data = value.as_py()
                if data is None or len(data) < length:
                    continue
                step = _CHUNK - length  # windows of a very long text by parts
                for at in range(0, max(1, len(data) - length + 1), step):
                    part = data[at : at + step + length - 1]
                    if filled + len(part) > _CHUNK:
                        flush()
                    texts.append(part)
                    owners.append(i)
                    offsets.append(at)
                    filled += len(part)
                    if sum(len(r[0]) for r in rows) >= _HELD:
                        yield _firsts(rows)
                        rows.clear()
            flush()
            if rows:
                yield _firsts(rows)

    return docs.mapInArrow(found, ", ".join(f"{c} long" for c in _ROWS))


def _same(columns: tuple[np.ndarray, ...], i, j) -> np.ndarray:
    """Whether rows i and j are equal in all columns."""
    return np.logical_and.reduce([c[i] == c[j] for c in columns])


def _firsts(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
    """The first row of each context, and the others as repeats unless they are at its place."""
    anchor, context, check, doc, version, start, n, at = map(np.concatenate, zip(*rows, strict=True))
    order = np.lexsort((start, version, doc, context))
    again = np.zeros(len(order), bool)
    again[1:] = _same((context, anchor, check, at), order[1:], order[:-1])
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    keep, drop = order[~again], order[again & ~_same((doc, version, start), order, order[first])]
    doc2, version2, start2, n2 = _joined(doc[drop], version[drop], start[drop], n[drop])
    zero = np.zeros(len(doc2), np.int64)
    anywhere = mixed(doc2.view(np.uint64) + start2.view(np.uint64)).view(np.int64)
    return _batch(_ROWS, *(np.concatenate(x) for x in zip((c[keep] for c in (anchor, context, check, doc, version, start, n, at)), (anywhere, zero, zero, doc2, version2, start2, -n2, zero), strict=True)))


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)


def _joined(doc: np.ndarray, version: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts that meet become one."""
    order = np.lexsort((start, version, doc))
    doc, version, start, n = doc[order], version[order], start[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (start[1:] != start[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return doc[first], version[first], start[first], np.add.reduceat(n, first) if len(first) else n


def _judged(contexts: DataFrame) -> DataFrame:
    """Rows of _contexts met by anchor: repeats (n < 0), and contexts whose anchor has several different ones (n > 0).

    Rows are dealt by ranges of anchor and context, so that no anchor is too much
    for a task. An anchor at a range's end may go on in the next one, and counts as
    one with several contexts.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        # The row before: the last anchor's last new context, and whether it has gone out already.
        held, gone, begun = None, False, False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(k)) for k in range(len(_ROWS))]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            anchor, context, check, doc, version, start, n, at = cols
            marks = n < 0
            new_anchor = np.ones(len(anchor), bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new = new_anchor.copy()
            new[1:] |= ~_same((context, check, at), slice(1, None), slice(None, -1)) | marks[1:] | marks[:-1]
            first = np.flatnonzero(new & ~marks)
            group = np.cumsum(new_anchor)[first]
            several = np.bincount(group, minlength=2)[group] > 1
            if gone or not begun:
                several |= group == 1
            of = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            out = ~new & ~_same((doc, version, start), slice(None), of)  # the same place twice is no repeat
            send = first[several]
            if gone:
                send = send[send != 0]
            d, v, s, m = _joined(doc[out], version[out], start[out], n[out])
            zero = np.zeros(len(d), np.int64)
            yield _batch(_ROWS, *(np.concatenate([c[send], c[marks], x]) for c, x in zip(cols, (zero, zero, zero, d, v, s, -m, zero), strict=True)))
            begun = True
            if len(first) and anchor[first[-1]] == anchor[-1]:
                held, gone = [c[first[-1] : first[-1] + 1] for c in cols], bool(several[-1])
            else:
                held, gone = None, False
        if held is not None and not gone:
            yield _batch(_ROWS, *held)

    order = ["anchor", "context", "check", "at", "doc", "version", "start"]
    spread = contexts.repartitionByRange(partitions(contexts.sparkSession), "anchor", "context").sortWithinPartitions(*order)
    return spread.mapInArrow(judge, ", ".join(f"{c} long" for c in _ROWS))


def _directly(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Suffixes sorted by their first `length` bytes, eight at a time; only ties look further."""
    order = at[np.argsort(words[at], kind="stable")]
    tied_with_next = words[order[1:]] == words[order[:-1]]
    for depth in range(8, length + 8, 8):
        if not tied_with_next.any():
            break
        tied = np.zeros(len(order), bool)
        tied[1:] |= tied_with_next
        tied[:-1] |= tied_with_next
        where = np.flatnonzero(tied)
        group = np.cumsum(np.concatenate([[True], ~tied_with_next]))[where]
        key = words[order[where] + depth]
        inner = np.lexsort((key, group))
        order[where] = order[where][inner]
        key = key[inner]
        same = np.zeros(len(order), bool)
        same[where[1:]] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        tied_with_next = same[1:] & tied_with_next
    return order


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Suffix array of bytes in which 0 ends each string, exact for the first `length` bytes. text[-1] must be 0.

    Only suffixes smaller than their successors are sorted directly. Each other
    one starts with a byte that is not under its successor's, so a scan of the
    buckets (suffixes by first byte) in order finds every successor first and
    appends the suffix before it to its bucket.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(length + 16, np.uint8)])
    words = np.zeros(n + length + 8, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + len(words)]
    # Smaller than its successor: by the first byte that differs from its own.
    differs = np.flatnonzero(np.diff(text.astype(np.int16)))
    next_other = np.searchsorted(differs, np.arange(n))
    small = np.zeros(n, bool)
    inside = next_other < len(differs)
    at = differs[next_other[inside]]
    small[inside] = text[at] < text[at + 1]
    ends = text == 0
    direct = _directly(words, np.flatnonzero(small & ~ends), length)
    cut = np.searchsorted(text[direct], np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def scan(ready: np.ndarray, b: int) -> np.ndarray:
        """Sends the suffixes before `ready` to their buckets; returns those that belong to bucket b itself."""
        before = ready[ready > 0] - 1
        before = before[~small[before] & ~ends[before]]
        first = text[before]
        for c in np.unique(first[first > b]):
            buckets[c].append(before[first == c])
        return before[first == b]

    for b in range(256):
        if b == 0:
            ready = np.flatnonzero(ends)
            out.append(ready)
            scan(ready, b)
            continue
        run = np.concatenate(buckets[b]) if buckets[b] else np.zeros(0, np.int64)
        buckets[b] = []
        while len(run):
            out.append(run)
            run = scan(run, b)
        ready = direct[cut[b] : cut[b + 1]]
        out.append(ready)
        scan(ready, b)
    return np.concatenate(out)


def _equal_starts(contexts: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """Groups of equal strings: for each start of each context in turn, a number that equal strings of `length` bytes share."""
    sizes = np.array([len(c) + 1 for c in contexts])
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    text = raw.copy()
    ends = np.cumsum(sizes) - 1
    text[raw < 255] += 1  # a 0 in a text is no end; no UTF-8 has 255
    text[ends] = 0
    begins = ends - sizes + 1
    number = np.full(len(text), -1, np.int64)
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    number[starts] = np.arange(len(starts))
    order = suffix_order(text, length)
    order = order[number[order] >= 0]
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    a, b = order[:-1], order[1:]
    equal = np.ones(len(a), bool)  # the common prefix with the neighbour before, as far as `length`
    for i in range(length):
        if not equal.any():
            break
        w = np.flatnonzero(equal)
        equal[w] = padded[a[w] + i] == padded[b[w] + i]
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(~equal)
    out = np.empty(len(starts), np.int64)
    out[number[order]] = group
    return out


def _by_suffixes(edges: DataFrame, length: int) -> DataFrame:
    """Repeats among contexts (anchor, doc, version, start, n, bytes), whose groups by anchor fit in memory."""

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        held: list[tuple] = []
        size = 0

        def sort(rows: list[tuple]) -> pa.RecordBatch:
            _, doc, version, start, n, data = zip(*rows, strict=True)
            doc, version, start, n = (np.array(x, np.int64) for x in (doc, version, start, n))
            group = _equal_starts(list(data), n, length)
            of = np.repeat(np.arange(len(n)), n)
            at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((at, version[of], doc[of], group))
            g = group[order]
            place = doc[of][order], version[of][order], at[order]
            later = np.zeros(len(order), bool)  # the same place twice is no repeat
            later[1:] = (g[1:] == g[:-1]) & ~_same(place, slice(1, None), slice(None, -1))
            return _batch(["doc", "version", "start", "n"], *_joined(*(x[later] for x in place), np.ones(later.sum(), np.int64)))

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if size > _SORTED and row[0] != held[-1][0]:
                    yield sort(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield sort(held)

    spread = edges.repartition(partitions(edges.sparkSession), "anchor").sortWithinPartitions("anchor")
    return spread.select("anchor", "doc", "version", "start", "n", "bytes").mapInArrow(repeats, _RUNS)


def _longer(rows: DataFrame, length: int) -> DataFrame:
    """rows (anchor, doc, version, start, n, at, low, high, bytes) in two parts each, whose anchors are longer.

    The anchor of a row takes the bytes from `low` to `high`, counted from `at`.
    With d the half of what a string has besides, a string that begins d bytes
    before the anchor or more takes them in on the left; any other has enough on
    the right.
    """
    half = f"cast(ceil(({length} - (high - low)) / 2) as int)"
    rows = rows.withColumn("d", F.expr(half)).withColumn("m", F.expr("greatest(0L, least(n, at + low - d + 1))"))
    left = "anchor", "0", "substring(bytes, cast(at + low - d + 1 as int), d)"
    right = "anchor", "1", f"substring(bytes, cast(at + high + 1 as int), cast({length} + low - d + 1 - high as int))"
    parts = (
        f"named_struct('anchor', xxhash64({', '.join(left)}), 'start', start, 'n', m, 'at', at, 'low', low - d, 'high', high, 'bytes', substring(bytes, 1, cast(m + {length - 1} as int)))",
        f"named_struct('anchor', xxhash64({', '.join(right)}), 'start', start + m, 'n', n - m, 'at', at - m, 'low', low, 'high', {length} + low - d + 1, 'bytes', substring(bytes, cast(m + 1 as int), cast(n - m + {length - 1} as int)))",
    )
    return rows.select("doc", "version", F.explode(F.expr(f"filter(array({', '.join(parts)}), p -> p.n > 0)")).alias("p")).select("doc", "version", "p.*")


def _in_parts(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame | None]:
    """rows whose anchors have _WIDE contexts at most, and the repeats (doc, version, start, n) found on the way there.

    Only equal bytes are taken for repeats here: contexts that don't differ any more once they are shorter.
    """
    ready, repeats = None, None
    while True:
        wide = written(rows.groupBy("anchor").count().where(F.col("count") > _WIDE).select("anchor", F.lit(True).alias("wide")), "wide-anchors")
        if wide.isEmpty():
            return rows if ready is None else ready.unionByName(rows), repeats
        rows = written(rows.join(wide, "anchor", "left"), "repeat-edges")
        narrow = rows.where("wide is null").drop("wide")
        ready = narrow if ready is None else ready.unionByName(narrow)
        parts = written(_longer(rows.where("wide"), length), "repeat-parts")
        keys = ["anchor", "at", "low", "high", "bytes"]
        firsts = written(parts.groupBy(*keys).agg(F.min(F.struct("doc", "version", "start")).alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")), "repeat-firsts")
        # A context of very many copies is spread over several tasks. Which ones are is told by a hash of the keys alone, on both sides.
        key = F.xxhash64(*keys)
        hot = F.broadcast(firsts.where(F.col("copies") > _HOT).select(key.alias("key"), F.lit(True).alias("hot")).distinct())  # at most one in _HOT parts
        salts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
        salted = parts.withColumn("key", key).join(hot, "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "version", "start"), F.lit(_SALTS))).otherwise(F.lit(0)).cast("long")).drop("key", "hot")
        meets = firsts.drop("n", "copies").withColumn("key", key).join(hot, "key", "left").withColumn("salt", F.explode(salts)).drop("key", "hot")
        again = salted.join(meets, [*keys, "salt"]).where(F.struct("doc", "version", "start") != F.col("first")).select("doc", "version", "start", "n")
        repeats = again if repeats is None else repeats.unionByName(again)
        rows = firsts.select(*keys, "n", "first.*")


def repeated_starts(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """doc, version, start, n: runs of starts of strings that also start earlier. The rows of docs with null ids are doc -2**63."""
    texts = docs.select(*_key(docs, id_col, text_col), docs[text_col].cast("binary").alias("text"))
    judged = written(_judged(_contexts(texts, length)), "repeats")
    marks = judged.where("n < 0").select("doc", "version", "start", (-F.col("n")).alias("n"))
    edges = judged.where("n > 0").select("anchor", "doc", "version", "start", "n", "at", F.lit(0).cast("long").alias("low"), F.lit(max(1, length // 3)).cast("long").alias("high"))
    fetched = edges.join(texts, ["doc", "version"]).withColumn("bytes", F.expr(f"substring(text, cast(start + 1 as int), cast(n + {length - 1} as int))")).drop("text")
    fetched = written(fetched, "repeat-edges")
    narrow, repeats = _in_parts(fetched, length)
    found = marks.unionByName(_by_suffixes(narrow, length))
    return found if repeats is None else found.unionByName(repeats)


def _with_runs(rows: DataFrame, runs: DataFrame, length: int, size: Column, order: Column) -> DataFrame:
    """rows (doc, version, ...) with the runs of their document; of null-id rows with one text, all but the first lose it whole."""
    runs = runs.groupBy("doc", "version").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    if rows.where("version < 0").isEmpty():
        return rows.join(runs, ["doc", "version"], "left")
    copy = F.row_number().over(Window.partitionBy("doc", "version").orderBy(order)) > 1
    both = rows.where("version >= 0").withColumn("copy", F.lit(False)).unionByName(rows.where("version < 0").withColumn("copy", copy))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), (size - length + 1).cast("long").alias("n")))
    return both.join(runs, ["doc", "version"], "left").withColumn("runs", F.when(F.col("copy") & (size >= length), whole).otherwise(F.col("runs")))


def _cut(data: bytes, runs: list, length: int) -> tuple[bytes, int]:
    """What is left of a text, and how many maximal runs went."""
    spans: list[list[int]] = []
    for start, n in sorted((r["start"], r["n"]) for r in runs):
        end = min(start + n - 1 + length, len(data))
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        elif start < end:
            spans.append([start, end])
    parts, at = [], 0
    for start, end in spans:
        parts.append(data[at:start])
        at = end
    return b"".join(parts) + data[at:], len(spans)


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, kept (binary), n_bytes, n_removed, n_spans.

    A null text counts as empty. Earlier means a smaller id (null ids first), of
    one id a smaller hash of the text (see version_of), or the same document and
    an earlier start. Rows that repeat an id and its text are one document: the
    same place is no repeat of itself, and they give equal results. Rows with one
    id and different texts are different documents, and so is each row with a
    null id: of those with one text, one counts as the first. An empty table
    gives no rows; other columns are not read. Very long texts are searched by
    overlapping parts, whole. A text may lose bytes in the middle of a character:
    kept is bytes. Ids that are not whole numbers raise ValueError. Copies of a
    whole context (up to 68 starts of one anchor) are known by 96 bits of two
    hashes besides the anchor's; all else is compared byte by byte.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"), *_key(docs, id_col, text_col))
    joined = _with_runs(rows, repeated_starts(docs, length, id_col, text_col), length, F.octet_length("text"), F.col("version"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        for batch in batches:
            data = [x or b"" for x in batch.column(1).to_pylist()]
            left = [_cut(d, r, length) if r else (d, 0) for d, r in zip(data, batch.column(2).to_pylist(), strict=True)]
            sizes = np.array([len(d) for d in data], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([k for k, _ in left], pa.binary()), pa.array(sizes), pa.array(sizes - np.array([len(k) for k, _ in left], np.int64)), pa.array([s for _, s in left], pa.int64())],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return joined.select("doc_id", "text", "runs").mapInArrow(cut, f"doc_id {id_type}, kept binary, n_bytes long, n_removed long, n_spans long")


def cut_documents(docs: DataFrame, length: int = 100) -> DataFrame:
    """The rows of docs, with all their columns: text without the repeats, n_chars as long as the new text.

    A null text stays null. Characters of which only some bytes are left go, too.
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *_key(docs, "doc_id", "text"))
    joined = _with_runs(rows, repeated_starts(docs, length, "doc_id", "text"), length, F.octet_length("row.text"), F.to_json("row")).select("row", "runs")
    column = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        for batch in batches:
            row, texts = batch.column(0), batch.column(0).field(column).to_pylist()
            left = [t if t is None or not r else _cut(t.encode(), r, length)[0].decode("utf-8", "ignore") for t, r in zip(texts, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([row, pa.array(left, pa.string())], names=["row", "text"])

    out = joined.mapInArrow(cut, T.StructType([T.StructField("row", docs.schema), T.StructField("text", T.StringType())]))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def repeat_digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of without_repeats."""
    return without_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
