"""URL verdicts: rules by host and path, and a ratio of two character models for the rest.

Each model gives a character's probability after up to four characters before it,
where each longer context leans on the shorter one. One model is of accepted
URLs, one of rejected; the difference of their log-likelihoods, by character,
against a calibrated threshold judges a URL that no rule fits.

A byte with the four before it is a gram, a number of 40 bits; a model is the
exact table of the grams of its URLs, in Spark. A gram's share of the difference
is found once for all URLs, by joins with the counts of each order, and comes
back to parts of the URLs that a task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

ORDER = 4
LEAN = 4.0  # how many sightings the shorter context is worth
_BINS, _WIDEST = 4000, 8.0
_PART = 1 << 21  # bytes of URLs that a task scores at once
_UNIT = 1 << 36  # shares are added as whole numbers, so that no order of adding shows

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(url.contains("://"), F.substring_index(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "/", 1)).otherwise("")
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty without ://."""
    return F.coalesce(F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits a URL, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name, verdict = F.when(fits, domain + start).otherwise(name), F.when(fits, word).otherwise(verdict)
    return name, verdict


def _grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all URLs in a row: the URL of each byte, its gram, and how many bytes each URL has with its end."""
    data = [b"\2" * ORDER + (u or "").encode() + b"\3" for u in urls]
    sizes = np.array([len(d) for d in data], np.int64)
    text = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    of = np.repeat(np.arange(len(data)), sizes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(place >= ORDER)
    gram = np.zeros(len(at), np.int64)
    for back in range(ORDER, -1, -1):
        gram = gram << 8 | text[at - back]
    return of[at], gram, sizes - ORDER


def _known(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages that a rule fits, with c (0 accepted, 1 rejected) and held: the third with crc32(url) mod 3 = 1."""
    url = F.col("url")
    _, verdict = ruled(host_of(url), path_of(url), rules)
    return pages.withColumn("said", verdict).where("said is not null").withColumn("c", (F.col("said") == "block").cast("int")).withColumn("held", F.crc32(url.cast("binary")) % 3 == 1).drop("said")


def _counted(urls: DataFrame) -> DataFrame:
    """gram, n0, n1: how often each gram is in urls (url, c) of each class."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.array(batch.column(1).to_pylist(), np.int64)
            of, gram, _ = _grams(batch.column(0).to_pylist())
            some, at = np.unique(gram, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(np.bincount(at[kind[of] == c], minlength=len(some)).astype(np.int64)) for c in (0, 1))], names=["gram", "n0", "n1"])

    return urls.select("url", "c").mapInArrow(counted, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _shares(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, share: log P(byte | accepted) - log P(byte | rejected) of each row of grams, in units."""
    p = [F.lit(1 / 256), F.lit(1 / 256)]
    for order in range(ORDER + 1):
        low = lambda n: F.lit((1 << 8 * n) - 1)
        keys = {"full": (F.col("gram").bitwiseAND(low(order + 1)), order + 1), "seen": (F.shiftright("gram", 8).bitwiseAND(low(order)), order)}
        for name, (key, width) in keys.items():
            some = counts.groupBy(key.alias("key")).agg(F.sum("n0").alias(f"{name}0"), F.sum("n1").alias(f"{name}1"))
            # Of one or two bytes there are 65,536 at most. Longer ones have few grams each, so no key is hot.
            grams = grams.withColumn("key", key).join(F.broadcast(some) if width <= 2 else some, "key", "left").drop("key")
        for c in (0, 1):
            n, of = (F.coalesce(F.col(f"{name}{c}"), F.lit(0)) for name in keys)
            p[c] = (n + LEAN * p[c]) / (of + LEAN)
        grams = grams.select("gram", p[0].alias("p0"), p[1].alias("p1"))
        p = [F.col("p0"), F.col("p1")]
    return grams.select("gram", F.round((F.log("p0") - F.log("p1")) * _UNIT).cast("long").alias("share"))


def differences(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """page_id, url and difference, log P(url | accepted) - log P(url | rejected) by character, of each row."""
    spark = pages.sparkSession
    if not all(counts.agg(F.sum("n0"), F.sum("n1")).first()):  # nothing to compare with
        return pages.select("page_id", "url", F.lit(0.0).alias("difference"))
    size = pages.agg(F.sum(F.coalesce(F.octet_length("url"), F.lit(0)) + 1)).first()[0] or 0
    parts = max(4 * partitions(spark), -(-size // _PART))
    rows = pages.select(F.pmod(F.xxhash64("page_id", "url"), F.lit(parts)).alias("part"), "page_id", "url")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, gram, _ = _grams(batch.column(1).to_pylist())
            part = np.asarray(batch.column(0))[of]
            order = np.lexsort((gram, part))
            part, gram = part[order], gram[order]
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]) | (gram[1:] != gram[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(part[new]), pa.array(gram[new])], names=["part", "gram"])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        of, gram, sizes = _grams(left.column("url").to_pylist())
        known, share = np.asarray(right.column("gram")), np.asarray(right.column("share"))
        order = np.argsort(known)
        share = share[order][np.searchsorted(known[order], gram)]
        total = np.add.reduceat(share, np.cumsum(sizes) - sizes)
        return pa.table([left.column("page_id"), left.column("url"), pa.array(total / _UNIT / sizes)], names=["page_id", "url", "difference"])

    grams = written(rows.select("part", "url").mapInArrow(distinct, "part long, gram long").distinct(), "url-grams")
    shares = grams.join(_shares(grams.select("gram").distinct(), counts), "gram").select("part", "gram", "share")
    id_type = pages.schema["page_id"].dataType.simpleString()
    return rows.groupBy("part").cogroup(shares.groupBy("part")).applyInArrow(scored, f"page_id {id_type}, url string, difference double")


def _threshold(scored: DataFrame, rules: list[tuple[str, str, str]]) -> float:
    """The cut of the held rows of scored (url, difference) with the best mean of both shares of right verdicts; else 0, the even odds."""
    at = F.greatest(F.lit(0), F.least(F.lit(_BINS - 1), (F.col("difference") + _WIDEST) / (2 * _WIDEST) * _BINS)).cast("long")
    histogram = np.zeros((2, _BINS))
    for r in _known(scored, rules).where("held").groupBy("c", at.alias("bin")).count().collect():
        histogram[r["c"], r["bin"]] = r["count"]
    if not histogram.sum(1).all():
        return 0.0
    share = histogram / histogram.sum(1, keepdims=True)
    right = np.concatenate([[0], np.cumsum(share[1])]) + 1 - np.concatenate([[0], np.cumsum(share[0])])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(best.mean() / _BINS * 2 * _WIDEST - _WIDEST)


@dataclass
class UrlModel:
    """counts: gram, n0 (in accepted URLs), n1 (in rejected ones)."""

    counts: DataFrame
    threshold: float = 0.0


def train(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> UrlModel:
    """Learns from all URLs with a rule's verdict but the held third, which sets the threshold.

    Counts are exact and grow with the distinct grams of the URLs; they stay in Spark.
    """
    model = UrlModel(written(_counted(_known(pages.select("url"), rules).where("not held")), "url-counts"))
    held = _known(pages.select("page_id", "url"), rules).where("held").drop("c", "held")
    model.threshold = _threshold(differences(held, model.counts), rules)
    return model


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, model: UrlModel | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, difference.

    A null URL, or one without ://, has an empty host and path and fits no rule;
    it is judged by its characters all the same. Where no URL teaches one of the
    models, because rules of one verdict fit none, there is nothing to compare:
    the difference is 0 and all URLs without a rule are allowed. Repeated rows give
    repeated results, an empty table none; only page_id and url are read.
    """
    rows = pages.select("page_id", "url")
    if model:
        scored, threshold = differences(rows, model.counts), model.threshold
    else:  # as train does, but all rows are scored at once
        counts = written(_counted(_known(rows.select("url"), rules).where("not held")), "url-counts")
        scored = written(differences(rows, counts), "url-scores")
        threshold = _threshold(scored, rules)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("difference") >= threshold, "allow").otherwise("block")
    scored = scored.select("page_id", host.alias("host"), path.alias("path"), "difference")
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "difference")
