"""The newest observation of each stop visit as keyed state: nothing that is stored is read again or rewritten."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.reliability import KEYS, latest

_VALUES = ["observed_at", "scheduled_arrival", "delay_seconds"]
#: Groups of the visits of one service date.
_BUCKETS = 256
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest_visit(keep: int, kinds: dict[str, str]) -> StatefulProcessor:
    """A processor whose groups are the visits of a service date in one bucket: a map holds the newest observation of each; it goes when the watermark passes `keep` days after the date.

    A call costs far more than a row, so visits share groups; only the entries of visits that have come are read and written.
    All it needs is made in here, so that it reaches executors that don't have this package.
    """
    visit, date, values = [k for k in KEYS if k != "service_date"], "service_date", list(_VALUES)
    columns, map_key = [*KEYS, *_VALUES], ", ".join(f"{k} {kinds[k]}" for k in KEYS if k != "service_date")

    def whole(column: pd.Series) -> list:
        return [None if pd.isna(v) else int(v) for v in column]

    def order(value: tuple) -> tuple:
        """Newest first; of equal moments the later schedule, then the greater delay; what is missing comes last."""
        return tuple((v is not None, v or 0) for v in value)

    class NewestVisit(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.newest = handle.getMapState("newest", map_key, "observed bigint, scheduled bigint, delay bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            best: dict[tuple, tuple] = {}
            for frame in rows:
                moments = pd.to_datetime(frame["observed_at"])
                micros = moments.to_numpy("datetime64[us]").astype("int64").tolist()
                observed = [None if gone else m for m, gone in zip(micros, moments.isna(), strict=True)]
                texts = [[None if pd.isna(v) else v for v in frame[c].tolist()] for c in visit]
                for who, now in zip(zip(*texts, strict=True), zip(observed, *(whole(frame[c]) for c in values[1:]), strict=True), strict=True):
                    if who not in best or order(now) > order(best[who]):
                        best[who] = now
            day = key[0]
            if self.newest.exists():
                for who in list(best):
                    known = self.newest.getValue(who)
                    if known is not None and order(best[who]) <= order(tuple(known)):
                        del best[who]
            elif day is not None:
                self.handle.registerTimer(int((datetime(day.year, day.month, day.day, tzinfo=UTC) + timedelta(days=keep)).timestamp() * 1000))
            for who, now in best.items():
                self.newest.updateValue(who, now)
            if best:
                found = {c: pd.Series(v, dtype="object") for c, v in zip(visit, zip(*best, strict=True), strict=True)}
                found |= {c: pd.array(v, dtype="Int64") for c, v in zip(values, zip(*best.values(), strict=True), strict=True)}
                found[values[0]] = pd.to_datetime(pd.Series(found[values[0]]), unit="us")
                yield pd.DataFrame(found | {date: pd.Series([day] * len(best), dtype="object")})[columns]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            self.newest.clear()
            return iter(())

        def close(self) -> None:
            pass

    return NewestVisit()


def newer(stream: DataFrame, late: str = "2 days", keep: int = 30) -> DataFrame:
    """Observations that are the newest of their visit when they come: at most one a visit and batch.

    Observations later than `late` are dropped. A visit is forgotten `keep` days after its service date, by event time; that
    bounds the state by the visits of these days. The visits of a date are dealt to _BUCKETS groups.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in [*KEYS, *_VALUES]}
    inside = kinds | {"observed_at": "timestamp", "scheduled_arrival": "bigint", "delay_seconds": "bigint"}
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    watched = stream.select(*(F.col(c).cast(t).alias(c) for c, t in inside.items())).withWatermark("observed_at", late)
    dealt = watched.withColumn("bucket", F.pmod(F.xxhash64(*(k for k in KEYS if k != "service_date")), F.lit(_BUCKETS)))
    found = dealt.groupBy("service_date", "bucket").transformWithStateInPandas(newest_visit(keep, kinds), ", ".join(f"{c} {t}" for c, t in inside.items()), "Append", "EventTime")
    return found.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()))


def keep_newer(stream: DataFrame, folder: str, checkpoint: str, late: str = "2 days", keep: int = 30) -> StreamingQuery:
    """Starts a query that appends to folder what newer() finds. Files of a batch count once it has ended, so a restart repeats nothing."""
    return newer(stream, late, keep).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_visits(spark: SparkSession, folder: str) -> DataFrame:
    """The newest observation of each visit: the last that keep_newer has appended."""
    return latest(spark.read.parquet(folder))
