"""Lives of jobs from snapshots of their states, whatever order these come in.

A job is queued, then runs, then is done or has failed, for good. A snapshot with a version that isn't newer than what is known is
stale, and one whose state can't follow is impossible: both change nothing. A job that is open and says nothing for
too long has failed then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What can follow each state; a job may be seen first in any.
FOLLOWS = {None: {"queued", "running", "done", "failed"}, "queued": {"queued", "running", "failed"}, "running": {"running", "done", "failed"}, "done": set(), "failed": set()}
OPEN = ("queued", "running")
#: Microseconds of silence after which an open job has failed.
TIMEOUT = 3_600_000_000


class Life:
    """One job's snapshots in order of version. ``seen`` is its state, version and last time."""

    def __init__(self, timeout: int = TIMEOUT, status: str | None = None, version: int | None = None, seen: int | None = None):
        self.timeout, self.status, self.version, self.seen = timeout, status, version, seen

    def expired(self, now: int) -> list[tuple]:
        """(t, status, version) of the failure, if the job has been silent for too long by now."""
        if self.status in OPEN and now - self.seen > self.timeout:
            self.status = "failed"
            return [(self.seen + self.timeout, "failed", self.version)]
        return []

    def take(self, version: int, t: int, status: str) -> list[tuple]:
        """(t, status, version) of what the snapshot changes: a failure before it, its own state."""
        out = self.expired(t)
        if (self.version is None or version > self.version) and status in FOLLOWS[self.status]:
            changed = status != self.status
            self.status, self.version, self.seen = status, version, t if self.seen is None else max(t, self.seen)
            out += [(t, status, version)] * changed
        return out


def transitions(changes: DataFrame, now: int, timeout: int = TIMEOUT) -> DataFrame:
    """(job, t, status, version): each job's changes of state up to now, from snapshots (job, version, t, status) in order of time and version.

    Snapshots without a version, time or known state are left out; a null job is a job. They stream through a task in order, which holds one job's state.
    """
    kind = dict(changes.dtypes)["job"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, life = (), Life(timeout)

        def made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(n).type if n == "job" else t) for k, (n, t) in enumerate((("job", None), ("t", pa.int64()), ("status", pa.string()), ("version", pa.int64())))], names=["job", "t", "status", "version"])

        schema = None
        for batch in batches:
            schema, out = batch.schema, []
            for job, version, t, status in zip(*(batch.column(c).to_pylist() for c in ("job", "version", "t", "status")), strict=True):
                if (job,) != current:
                    out += [(*current, *x) for x in life.expired(now)]
                    current, life = (job,), Life(timeout)
                out += [(job, *x) for x in life.take(version, t, status)]
            yield made(out, schema)
        if schema is not None:
            yield made([(*current, *x) for x in life.expired(now)], schema)

    known = changes.select("job", F.col("version").cast("bigint").alias("version"), F.col("t").cast("bigint").alias("t"), "status").filter(F.col("version").isNotNull() & (F.col("t") <= now) & F.col("status").isin(*FOLLOWS["running"], "queued"))
    return known.repartition("job").sortWithinPartitions("job", "t", "version", "status").mapInArrow(run, f"job {kind}, t bigint, status string, version bigint")
