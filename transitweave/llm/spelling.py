"""Groups of spelling variants: words one edit apart, found with positional q-grams.

1. Words are counted over all texts.
2. One edit leaves the first half of the shorter word whole, or the rest of it. So a
   word goes to a cell for each of its halves, and two words one edit apart meet
   in a cell. A cell of very many words is dealt out as pairs of salted parts.
3. In a cell, an inverted index has a posting list for each length, position and
   2-gram of what the cell's words do not share, padded. For each word the lists
   of its grams, of lengths and positions at most one off, are merged by a heap;
   words met as often as one edit must leave grams common are verified.
4. A word's form is its commonest neighbour, if that is common enough; forms are
   followed by doubling.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, task_start, written
from .merkle import lower_ascii

#: Letters of Latin-1 and what stands between them.
_RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_Q = 2
_CELL = 4096  # words of a cell that are indexed together
_PAD = "\0"


def noisy_runs(docs: DataFrame, every: int = 199) -> DataFrame:
    """run: each maximal run of letters of each text, lower-cased; where `every` divides the CRC-32 of `id:run`, without one letter."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(_RUN), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = f"cast(h % length(run) as int)"
    return hashed.select(F.when(F.col("h") % every == 0, F.expr(f"concat(substring(run, 1, {at}), substring(run, {at} + 2))")).otherwise(F.col("run")).alias("run"))


def vocabulary(runs: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """word, n: the runs of `shortest` code points or more that occur `least` times or more."""
    return runs.where(F.length("run") >= shortest).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether b comes from a by one replaced, or one inserted, code point; len(a) <= len(b)."""
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def grams(rest: str) -> list[str]:
    padded = _PAD * (_Q - 1) + rest + _PAD * (_Q - 1)
    return [padded[i : i + _Q] for i in range(len(padded) - _Q + 1)]


def overlapping(queries: list[int], rests: list[str], allowed=lambda a, b: True) -> Iterator[tuple[int, int]]:
    """Pairs (query, other) of rests that may be one edit apart: the other as long, and later, or one longer.

    A rest of r code points has r + q - 1 padded grams; one edit breaks q of the longer one's at most.
    """
    index: dict[tuple[int, int, str], list[int]] = {}
    for k, rest in enumerate(rests):
        for at, gram in enumerate(grams(rest)):
            index.setdefault((len(rest), at, gram), []).append(k)
    for k in queries:
        own = grams(rests[k])
        for length in (len(rests[k]), len(rests[k]) + 1):
            lists = [found for at, gram in enumerate(own) for p in (at - 1, at, at + 1) if (found := index.get((length, p, gram)))]
            bound, other, seen = length - 1, -1, 0
            for m in heapq.merge(*lists):
                seen = seen + 1 if m == other else 1
                other = m
                if seen == max(bound, 1) and (length > len(rests[k]) or m > k) and allowed(k, m):
                    yield k, m


def pairs_of_cell(words: list[str], salts: list[int], shortest: int, half: str, across: bool) -> Iterator[tuple[int, int]]:
    """Pairs of places of words one edit apart, the first of `shortest` code points; those that share both halves are left to the first half's cell."""
    cut = shortest // 2
    rests = [w[cut:] if half == "first" else w[: len(w) - shortest + cut] for w in words]
    queries = [k for k, w in enumerate(words) if len(w) == shortest]
    for a, b in overlapping(queries, rests, lambda a, b: not across or salts[a] != salts[b]):
        if one_edit(words[a], words[b]) and (half == "first" or words[a][:cut] != words[b][:cut]):
            yield a, b


def near_words(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of words (word, n) that is one inserted, deleted or replaced code point apart, once."""
    length = F.length("word")
    cells = []
    for shorter in (length, length - 1):
        cut = F.floor(shorter / 2).cast("int")
        cells += [F.struct(shorter.alias("shortest"), F.lit("first").alias("half"), F.substr("word", F.lit(1), cut).alias("part")), F.struct(shorter.alias("shortest"), F.lit("rest").alias("half"), F.substr("word", length - shorter + cut + 1).alias("part"))]
    cell = ["shortest", "half", "part"]
    keyed = words.select("word", "n", F.explode(F.array(*cells)).alias("c")).select("word", "n", "c.*").where("shortest > 0")
    keyed = written(keyed, "word-cells")
    sizes = keyed.groupBy(*cell).agg(F.count(F.lit(1)).alias("size"), F.min(length).alias("least")).where("size > 1 and least = shortest")
    dealt = keyed.join(sizes.select(*cell, F.ceil(F.col("size") / _CELL).cast("long").alias("salts")), cell)
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("word"), "salts")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = dealt.select(*cell, F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "word", "n")
    unit = [*cell, "i", "j"]
    dealt = dealt.repartition(partitions(words.sparkSession), *unit).sortWithinPartitions(*unit)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from found_pairs(rows)

    return dealt.mapInArrow(near, "a string, n_a long, b string, n_b long")


def found_pairs(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Pairs of the cells whose rows (shortest, half, part, i, j, salt, word, n) follow each other."""
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], names=["a", "n_a", "b", "n_b"])

    for (shortest, half, _, i, j), group in groupby(rows, key=lambda r: r[:5]):
        members = list(group)
        words, n = [r[6] for r in members], [r[7] for r in members]
        for a, b in pairs_of_cell(words, [r[5] for r in members], shortest, half, i != j):
            out.append((words[a], n[a], words[b], n[b]))
            if len(out) >= 10_000:
                yield flushed()
    yield flushed()


def followed(forms: DataFrame) -> DataFrame:
    """word, root for forms (word, form): the last word that forms lead to. Forms grow in number each step, so there is no circle."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = written(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def spelling_forms(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n): see spelling_variants."""
    pairs = written(near_words(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    common = -F.col("best.less") >= factor * F.col("n")
    judged = written(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")), "judged-words")
    roots = followed(judged.where("form is not null").select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5, factor: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of docs: word, form, root, n, n_near, form_n.

    Words are the distinct runs (see noisy_runs) with `shortest` code points and `least` occurrences at
    least. Two are near if one inserted, deleted or replaced code point parts them. form is the near word with
    the largest n (form_n), of equal ones the first in code-point order, if that is `factor` times the word's own;
    else null. root is where forms lead, the word itself without a form. Null and empty texts
    have no words; a null id counts as an empty one; repeated rows count each. Very long texts are
    read whole. An empty table gives no rows. Other columns are not read.
    """
    plain = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return spelling_forms(written(vocabulary(noisy_runs(plain, every), shortest, least), "vocabulary"), factor)
