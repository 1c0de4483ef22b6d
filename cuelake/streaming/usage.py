"""Rate limits, job states and incremental indexes over streams; each takes a streaming or a batch DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import admission, inverted, jobs


def window_counts(calls: DataFrame, bucket: str, at: str, size: str = "1 hour", step: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(bucket, start, n): calls in sliding windows; a stream drops what is later than the watermark."""
    timed = calls.withWatermark(at, late) if calls.isStreaming else calls
    return timed.groupBy(F.col(bucket).alias("bucket"), F.window(at, size, step).alias("w")).agg(F.count("*").alias("n")).select("bucket", F.col("w.start").alias("start"), "n")


def limited(calls: DataFrame, bucket: str, at: str, limit: int) -> DataFrame:
    """Windows in which a bucket reached its limit."""
    return window_counts(calls, bucket, at).filter(F.col("n") >= limit)


class _Admission(StatefulProcessor):
    """Calls wait in order of their times until the watermark has passed them, as an earlier one may still come; then the gate lets them through."""

    def __init__(self, limit: int, window: int, slack: int):
        self.limit, self.window, self.slack = limit, window, slack

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t bigint, call bigint", "copies bigint")
        self.recent = handle.getValueState("recent", "times array<bigint>")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for t, call in zip(frame["t"].tolist(), frame["call"].tolist(), strict=True):
                copies = self.waiting.getValue((t, call))[0] if self.waiting.containsKey((t, call)) else 0
                self.waiting.updateValue((t, call), (copies + 1,))
                self.handle.registerTimer(-(-t // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted((k, self.waiting.getValue(k)[0]) for k in [tuple(k) for k in self.waiting.keys()] if k[0] <= upto)
        gate = admission.Gate(self.limit, self.window, self.slack, list(self.recent.get()[0]) if self.recent.exists() else None)
        out = []
        for (t, call), copies in due:
            out += [(key[0], call, t, at, at - t) for at in (gate.admit(t) for _ in range(copies))]
            self.waiting.removeKey((t, call))
        self.recent.update((list(gate.recent),))
        yield pd.DataFrame(out, columns=["bucket", "call", "t", "admitted", "waited"])

    def close(self) -> None:
        pass


def admissions(calls: DataFrame, bucket: str, call: str, at: str, limit: int, window: int = admission.WINDOW, slack: int = admission.SLACK, late: str = "10 minutes") -> DataFrame:
    """(bucket, call, t, admitted, waited): when each call gets through under a rolling limit, see ``operators.admission``; of a batch or, with keyed state and timers, of a stream.

    A stream gives a call's row once its watermark has passed it, the same row as the batch does; what is later than the watermark is
    dropped. Its state is the waiting calls and the last admissions; the state store must be RocksDB's.
    """
    timed = calls.withWatermark(at, late) if calls.isStreaming else calls
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = timed.select(F.col(bucket).alias("bucket"), F.col(call).cast("bigint").alias("call"), micros.alias("t"), *([F.col(at)] if calls.isStreaming else []))
    if not calls.isStreaming:
        return admission.admitted(rows, limit, window, slack)
    ddl = "bucket string, call bigint, t bigint, admitted bigint, waited bigint"
    return rows.withColumn("bucket", F.col("bucket").cast("string")).groupBy("bucket").transformWithStateInPandas(_Admission(limit, window, slack), ddl, "Append", "EventTime")


class _Lives(StatefulProcessor):
    """Snapshots wait until the watermark has passed them; timers also tell when an open job has been silent for too long."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t bigint, version bigint, status string", "copies bigint")
        self.life = handle.getValueState("life", "status string, version bigint, seen bigint")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for t, version, status in zip(frame["t"].tolist(), frame["version"].tolist(), frame["status"].tolist(), strict=True):
                self.waiting.updateValue((t, version, status), (1,))  # the same snapshot again changes nothing
                self.handle.registerTimer(-(-t // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        life = jobs.Life(self.timeout, *(self.life.get() if self.life.exists() else ()))
        out = []
        for t, version, status in sorted(k for k in [tuple(k) for k in self.waiting.keys()] if k[0] <= now):
            out += life.take(version, t, status)
            self.waiting.removeKey((t, version, status))
        out += life.expired(now)
        if life.version is not None:
            self.life.update((life.status, life.version, life.seen))
            if life.status in jobs.OPEN:
                self.handle.registerTimer((life.seen + self.timeout) // 1000 + 1)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["job", "t", "status", "version"])

    def close(self) -> None:
        pass


def job_transitions(changes: DataFrame, job: str, version: str, at: str, status: str, now: int | None = None, timeout: int = jobs.TIMEOUT, late: str = "10 minutes") -> DataFrame:
    """(job, t, status, version): each job's changes of state, see ``operators.jobs``; of a batch up to now (microseconds), or of a stream as its watermark goes on, whose state store must be RocksDB's."""
    timed = changes.withWatermark(at, late) if changes.isStreaming else changes
    rows = timed.select(F.col(job).alias("job"), F.col(version).cast("bigint").alias("version"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(status).alias("status"), *([F.col(at)] if changes.isStreaming else []))
    if not changes.isStreaming:
        return jobs.transitions(rows, now, timeout)
    known = rows.filter(F.col("version").isNotNull() & F.col("status").isin(*jobs.FOLLOWS[None])).withColumn("job", F.col("job").cast("string"))
    return known.groupBy("job").transformWithStateInPandas(_Lives(timeout), "job string, t bigint, status string, version bigint", "Append", "EventTime")


def job_states(changes: DataFrame, job: str, at: str, status: str) -> DataFrame:
    """(job, status, at): each job's state by its latest change, whatever order the changes come in."""
    latest = F.max(F.struct(F.col(at).alias("at"), F.col(status).alias("status"))).alias("s")
    return changes.groupBy(F.col(job).alias("job")).agg(latest).select("job", "s.status", "s.at")


def index_incrementally(chunks: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Appends each batch's prepared rows to the index, once for each batch number: a batch that is run again replaces its own part."""

    def add(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_postings(chunks: DataFrame, index: inverted.Index, text: str, checkpoint: str) -> StreamingQuery:
    """Each batch's chunks as a delta of the index, named by the batch's number: a batch that is run again replaces its own. A search takes the deltas "0", "1", .. that there are."""
    return chunks.writeStream.foreachBatch(lambda batch, number: index.append(str(number), batch, text)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
