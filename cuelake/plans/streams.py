"""The streaming operators over a finished log, whose batch form gives the rows of the stream's last state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.library import table
from ..streaming import usage
from .registry import query


@query("st2_window_counts", """SELECT event_type AS bucket, make_timestamp(s * 600000000) AS start, count(*) AS n FROM (SELECT event_type, unnest(range(epoch_us(ts) // 600000000 - 5, epoch_us(ts) // 600000000 + 1)) AS s FROM events) GROUP BY 1, 2""")
def counts(spark, sf_dir):
    """Calls in hours that begin each ten minutes."""
    return usage.window_counts(table(spark, sf_dir, "events"), "event_type", "ts")


@query("st3_job_states", "SELECT user_id AS job, arg_max(event_type, struct_pack(t := ts, s := event_type)) AS status, max(ts) AS at FROM events GROUP BY 1")
def states(spark, sf_dir):
    """Each job's latest state."""
    return usage.job_states(table(spark, sf_dir, "events"), "user_id", "ts", "event_type")


@query("st1_limited", "SELECT event_type AS bucket, make_timestamp(s * 600000000) AS start, count(*) AS n FROM (SELECT event_type, unnest(range(epoch_us(ts) // 600000000 - 5, epoch_us(ts) // 600000000 + 1)) AS s FROM events) GROUP BY 1, 2 HAVING count(*) >= 6")
def limits(spark, sf_dir):
    """Hours in which a bucket reached six calls."""
    return usage.limited(table(spark, sf_dir, "events"), "event_type", "ts", 6)


@query("st1_admissions", """, adm AS (SELECT bucket, call, i, t, t AS a, CAST(NULL AS BIGINT) AS p FROM calls WHERE i = 1
  UNION ALL SELECT c.bucket, c.call, c.i, c.t, CASE WHEN adm.p >= greatest(c.t, adm.a) - 180000000 THEN adm.p + 180050000 ELSE greatest(c.t, adm.a) END, adm.a FROM adm JOIN calls c ON c.bucket = adm.bucket AND c.i = adm.i + 1)
SELECT bucket, call, a - t AS waited FROM adm""", "calls AS (SELECT event_type AS bucket, event_id AS call, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)")
def admissions(spark, sf_dir):
    """How long each call waits where two may get through in three minutes."""
    return usage.admissions(table(spark, sf_dir, "events"), "event_type", "event_id", "ts", 2, 180_000_000).select("bucket", "call", "waited")


@query("st3_transitions", """, life AS (SELECT job, i, status, t AS seen, t, status AS said, version, version AS ver, false AS late FROM snap WHERE i = 1
  UNION ALL SELECT s.job, s.i, CASE WHEN l.status IN ('queued', 'running') AND s.t - l.seen > 172800000000 THEN 'failed' WHEN ok THEN s.status ELSE l.status END, CASE WHEN ok THEN greatest(s.t, l.seen) ELSE l.seen END, s.t, CASE WHEN ok AND s.status <> l.status THEN s.status END, CASE WHEN ok THEN s.version ELSE l.version END, s.version, l.status IN ('queued', 'running') AND s.t - l.seen > 172800000000
  FROM life l JOIN snap s ON s.job = l.job AND s.i = l.i + 1, LATERAL (SELECT s.version > l.version AND NOT (l.status IN ('queued', 'running') AND s.t - l.seen > 172800000000) AND (l.status = 'queued' AND s.status IN ('queued', 'running', 'failed') OR l.status = 'running' AND s.status IN ('running', 'done', 'failed')) AS ok)),
told AS (SELECT job, t, said AS status FROM life WHERE said IS NOT NULL
  UNION ALL SELECT job, lag(seen) OVER (PARTITION BY job ORDER BY i) + 172800000000, CASE WHEN late THEN 'failed' END FROM life
  UNION ALL SELECT job, seen + 172800000000, 'failed' FROM (SELECT *, max(i) OVER (PARTITION BY job) AS n FROM life) WHERE i = n AND status IN ('queued', 'running') AND 1706745600000000 - seen > 172800000000)
SELECT job, t, status FROM told WHERE status IS NOT NULL""", """snap AS (SELECT user_id AS job, event_id AS version, epoch_us(ts) AS t, CASE event_type WHEN 'click' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)""")
def transitions(spark, sf_dir):
    """Jobs' changes of state up to the end of January where events are their snapshots; two days of silence are a failure."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("running")
    return usage.job_transitions(e.withColumn("kind", kind), "user_id", "event_id", "ts", "kind", 1_706_745_600_000_000, 172_800_000_000).select("job", "t", "status")
