"""Admission of calls under a rolling limit, where a call that must wait counts at the time at which it gets through.

A bucket's calls get through in order of their times. A call gets through at once if fewer than the limit did in the window
before; else it waits until the first of these has left the window, and a little longer. Times are whole microseconds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW, SLACK = 60_000_000, 50_000
#: Microseconds of calls that one task numbers: an hour's.
CELL = 3_600_000_000


class Gate:
    """One bucket's calls in order. It remembers as many admissions as the limit."""

    def __init__(self, limit: int, window: int = WINDOW, slack: int = SLACK, recent: list[int] | None = None):
        self.limit, self.window, self.slack = limit, window, slack
        self.recent = deque(recent or [], maxlen=limit)

    def admit(self, t: int) -> int:
        """When a call of that time gets through."""
        at = max(t, self.recent[-1]) if self.recent else t
        if len(self.recent) == self.limit and self.recent[0] >= at - self.window:
            at = self.recent[0] + self.window + self.slack
        self.recent.append(at)
        return at


def sessions(calls: DataFrame, limit: int, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """Calls (bucket, call, t) with the number of the call that begins their session: before it, nothing that came earlier can be in the window any more.

    Call i gets through by C * ((i - j) / limit) after call j's time at the latest, for the j that makes most of it, where C is
    the window with the slack. That bound is a running maximum, taken within an hour and over hours, so that no task holds
    a bucket; only what lies between two quiet times depends on what came before.
    """
    wait = window + slack
    each = calls.filter("t IS NOT NULL").withColumn("_cell", F.floor(F.col("t") / CELL))
    inside = W.partitionBy("bucket", "_cell").orderBy("t", "call")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    placed = each.withColumn("_k", F.row_number().over(inside).cast("bigint")).withColumn("_x", F.col("t") * limit - F.col("_k") * wait)
    cells = W.partitionBy("bucket").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("bucket", "_cell").agg(F.count("*").alias("_n"), F.max("_x").alias("_m"))
    offset = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(cells), F.lit(0)))
    carried = offset.withColumn("_most", F.max(F.col("_m") - F.col("_before") * wait).over(cells)).select(F.col("bucket").alias("_b"), F.col("_cell").alias("_c"), "_before", "_most")
    same = lambda x: F.col("bucket").eqNullSafe(F.col(x))
    known = placed.join(carried, same("_b") & (F.col("_cell") == F.col("_c"))).withColumn("_i", F.col("_before") + F.col("_k"))
    most = F.greatest(F.max("_x").over(before) - F.col("_before") * wait, F.col("_most"))  # of all calls before, whichever of both there are
    quiet = most.isNull() | ((F.col("t") - window) * limit > (F.col("_i") - 1) * wait + most)
    begun = known.withColumn("_start", F.when(quiet, F.col("_i"))).drop("_b", "_c")
    last = begun.groupBy("bucket", "_cell").agg(F.max("_start").alias("_s")).withColumn("_carried", F.max("_s").over(cells)).select(F.col("bucket").alias("_b"), F.col("_cell").alias("_c"), "_carried")
    whole = begun.join(last, same("_b") & (F.col("_cell") == F.col("_c")))
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    return whole.select("bucket", "call", "t", F.coalesce(F.max("_start").over(upto), F.col("_carried")).alias("session"))


def admitted(calls: DataFrame, limit: int, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """(bucket, call, t, admitted, waited): when each call (bucket, call, t) gets through, in microseconds; of equal times the smaller call first.

    Calls without a time are left out; those without a bucket are a bucket. Sessions are folded apart, in order, by tasks
    that remember as many admissions as the limit. A bucket that is never quiet is one session: each of its calls depends on those before.
    """
    kinds = dict(calls.dtypes)
    ddl = f"bucket {kinds['bucket']}, call {kinds['call']}, t bigint, admitted bigint, waited bigint"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gate = None, Gate(limit, window, slack)
        for batch in batches:
            out = []
            for bucket, session, t in zip(*(batch.column(c).to_pylist() for c in ("bucket", "session", "t")), strict=True):
                if (bucket, session) != key:
                    key, gate = (bucket, session), Gate(limit, window, slack)
                out.append(gate.admit(t))
            at, times = pa.array(out, pa.int64()), batch.column("t")
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("call"), times, at, pa.compute.subtract(at, times)], names=["bucket", "call", "t", "admitted", "waited"])

    dealt = sessions(calls, limit, window, slack).repartition("bucket", "session").sortWithinPartitions("bucket", "session", "t", "call")
    return dealt.mapInArrow(fold, ddl)
