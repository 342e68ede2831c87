"""Registered queries: event-log analytics and event-log IO (§2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import eventlog as ev
from tessera.plans import bindings as b
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register
from tessera.session import scratch_path
from tessera.sources.eventlog import event_lines, parse_event_lines, read_event_log, write_event_log

# ------------------------------------------------------------------ SQL flavour
KEPT = """
SELECT run, job_id, sql_text, stream_id, submit_ms, finish_ms, result FROM jobs
LEFT JOIN (SELECT run, sql_text, max(finish_ms) AS fail_at FROM jobs WHERE result = 'JobFailed'
           GROUP BY run, sql_text) f USING (run, sql_text)
WHERE fail_at IS NULL OR submit_ms > fail_at"""

MERGED = """
SELECT run, sql_text,
       arg_min(finish_ms - submit_ms, submit_ms) FILTER (WHERE finish_ms IS NOT NULL) AS first_ms,
       round(avg(finish_ms - submit_ms), 6) AS avg_ms, count(*) AS n_jobs, count(finish_ms) AS n_finished
FROM kept GROUP BY run, sql_text"""

STAGE_AVG = """
SELECT run, sql_text, pos, arg_min(name, job_id) AS name,
       round(avg(complete_ms - submit_ms), 6) AS avg_ms, count(*) AS n_runs
FROM (SELECT s.*, row_number() OVER (PARTITION BY run, job_id ORDER BY stage_id) - 1 AS pos
      FROM stages s WHERE EXISTS (SELECT 1 FROM kept k WHERE k.run = s.run AND k.job_id = s.job_id)) x
GROUP BY run, sql_text, pos"""


def _kept(spark, sf):
    return ev.drop_failed_sql(b.jobs(spark, sf))


@register("drop_failed_sql", with_views(
    "SELECT run, job_id, sql_text, submit_ms, finish_ms, result FROM kept", "jobs",
    extra={"kept": KEPT}))
def q_drop_failed_sql(spark, sf):
    return _kept(spark, sf).select("run", "job_id", "sql_text", "submit_ms", "finish_ms", "result")


@register("sql_run_merge", with_views("SELECT * FROM merged", "jobs",
                                      extra={"kept": KEPT, "merged": MERGED}))
def q_sql_run_merge(spark, sf):
    return ev.sql_run_merge(_kept(spark, sf))


SQL_REGRESSION_SQL = with_views("""
SELECT coalesce(b.sql_text, r.sql_text) AS sql_text, b.first_ms AS base_ms, r.first_ms AS reg_ms,
       r.first_ms - b.first_ms AS diff_ms,
       round(CASE WHEN r.first_ms = 0 THEN NULL
                  ELSE CAST(r.first_ms - b.first_ms AS DOUBLE) / r.first_ms END, 9) AS rate,
       (r.first_ms - b.first_ms) >= 0 AS regressed, b.avg_ms AS base_avg_ms, r.avg_ms AS reg_avg_ms
FROM (SELECT * FROM merged WHERE run = 'base') b
FULL OUTER JOIN (SELECT * FROM merged WHERE run = 'reg') r ON b.sql_text = r.sql_text""",
    "jobs", extra={"kept": KEPT, "merged": MERGED})


@register("sql_regression", SQL_REGRESSION_SQL)
def q_sql_regression(spark, sf):
    return ev.sql_regression(ev.sql_run_merge(_kept(spark, sf)))


@register("stage_avg_sql", with_views("SELECT * FROM stage_avg", "stages",
                                      extra={"kept": KEPT, "stage_avg": STAGE_AVG}))
def q_stage_avg_sql(spark, sf):
    return ev.stage_avg_sql(b.stages(spark, sf, _kept(spark, sf)))


@register("stage_regression", with_views("""
SELECT coalesce(bs.sql_text, rs.sql_text) AS sql_text, coalesce(bs.pos, rs.pos) AS pos,
       coalesce(bs.name, rs.name) AS name, bs.avg_ms AS base_avg_ms, rs.avg_ms AS reg_avg_ms,
       CAST(trunc(rs.avg_ms - bs.avg_ms) AS BIGINT) AS diff_ms,
       round(CASE WHEN rs.avg_ms = 0 THEN NULL ELSE (rs.avg_ms - bs.avg_ms) / rs.avg_ms END, 9) AS rate
FROM (SELECT * FROM stage_avg WHERE run = 'base') bs
FULL OUTER JOIN (SELECT * FROM stage_avg WHERE run = 'reg') rs
  ON bs.sql_text = rs.sql_text AND bs.pos = rs.pos""", "stages",
    extra={"kept": KEPT, "stage_avg": STAGE_AVG}))
def q_stage_regression(spark, sf):
    return ev.stage_regression(ev.stage_avg_sql(b.stages(spark, sf, _kept(spark, sf))))


# ------------------------------------------------------------------ stream flavour
SKEPT = "SELECT * FROM jobs WHERE result IS NULL OR result = 'JobSucceeded'"
METRICS = """
SELECT run, stream_id, max(finish_ms) - min(submit_ms) AS span_ms, count(*) AS batches,
       CAST(sum(coalesce(finish_ms - submit_ms, 0)) // count(*) AS BIGINT) AS ms_per_batch
FROM skept GROUP BY run, stream_id"""
SSTAGE = """
SELECT run, stream_id, pos, arg_min(name, job_id) AS name,
       CAST(sum(complete_ms - submit_ms) // count(*) AS BIGINT) AS avg_ms, count(*) AS n_batches
FROM (SELECT s.*, row_number() OVER (PARTITION BY run, job_id ORDER BY stage_id) - 1 AS pos
      FROM stages s WHERE EXISTS (SELECT 1 FROM skept k WHERE k.run = s.run AND k.job_id = s.job_id)) x
GROUP BY run, stream_id, pos"""


def _skept(spark, sf):
    return ev.drop_failed_job(b.jobs(spark, sf))


@register("drop_failed_job", with_views(
    "SELECT run, stream_id, job_id, submit_ms, finish_ms, result FROM skept", "jobs",
    extra={"skept": SKEPT}))
def q_drop_failed_job(spark, sf):
    return _skept(spark, sf).select("run", "stream_id", "job_id", "submit_ms", "finish_ms", "result")


@register("stream_span", with_views("SELECT run, stream_id, span_ms FROM metrics", "jobs",
                                    extra={"skept": SKEPT, "metrics": METRICS}))
def q_stream_span(spark, sf):
    return ev.stream_span(_skept(spark, sf))


@register("stream_avg", with_views("SELECT run, stream_id, batches, ms_per_batch FROM metrics", "jobs",
                                   extra={"skept": SKEPT, "metrics": METRICS}))
def q_stream_avg(spark, sf):
    return ev.stream_avg(_skept(spark, sf))


@register("stream_stage_avg", with_views("SELECT * FROM sstage", "stages",
                                         extra={"skept": SKEPT, "sstage": SSTAGE}))
def q_stream_stage_avg(spark, sf):
    return ev.stream_stage_avg(b.stages(spark, sf, _skept(spark, sf)))


def _pct(d, base):
    return f"round(CASE WHEN {base} = 0 THEN NULL ELSE CAST({d} AS DOUBLE) * 100.0 / {base} END, 6)"


@register("stream_regression", with_views(f"""
SELECT bm.stream_id, bm.span_ms AS base_span_ms, rm.span_ms AS reg_span_ms,
       rm.span_ms - bm.span_ms AS span_diff_ms, {_pct('rm.span_ms - bm.span_ms', 'bm.span_ms')} AS span_pct,
       bm.batches AS base_batches, rm.batches AS reg_batches, rm.batches - bm.batches AS batch_diff,
       bm.ms_per_batch AS base_ms_per_batch, rm.ms_per_batch AS reg_ms_per_batch,
       rm.ms_per_batch - bm.ms_per_batch AS ms_per_batch_diff,
       {_pct('rm.ms_per_batch - bm.ms_per_batch', 'bm.ms_per_batch')} AS ms_per_batch_pct,
       (rm.span_ms - bm.span_ms) > 0 AS span_regressed,
       (rm.ms_per_batch - bm.ms_per_batch) > 0 AS ms_per_batch_regressed
FROM (SELECT * FROM metrics WHERE run = 'base') bm
LEFT JOIN (SELECT * FROM metrics WHERE run = 'reg') rm ON bm.stream_id = rm.stream_id""",
    "jobs", extra={"skept": SKEPT, "metrics": METRICS}))
def q_stream_regression(spark, sf):
    return ev.stream_regression(ev.stream_metrics(_skept(spark, sf)))


@register("stream_stage_regression", with_views("""
SELECT bs.stream_id, bs.pos, bs.name, bs.avg_ms AS base_avg_ms, rs.avg_ms AS reg_avg_ms,
       rs.avg_ms - bs.avg_ms AS diff_ms
FROM (SELECT * FROM sstage WHERE run = 'base') bs
JOIN (SELECT * FROM sstage WHERE run = 'reg') rs ON bs.stream_id = rs.stream_id AND bs.pos = rs.pos""",
    "stages", extra={"skept": SKEPT, "sstage": SSTAGE}))
def q_stream_stage_regression(spark, sf):
    return ev.stream_stage_regression(ev.stream_stage_avg(b.stages(spark, sf, _skept(spark, sf))))


# ------------------------------------------------------------------ through JSON event logs
def _lines(spark, sf):
    """The bindings as listener JSON, some lines broken."""
    j = b.jobs(spark, sf)
    return event_lines(j, b.stages(spark, sf, j))


def _log(spark, sf):
    return parse_event_lines(_lines(spark, sf))


@register("event_log_scan", with_views("""
SELECT j.run, 'SparkListenerJobStart' AS event, count(*) AS n_events, CAST(sum(job_id) AS BIGINT) AS job_ids,
       CAST(NULL AS BIGINT) AS stage_ids, CAST(any_value(s.n) AS BIGINT) AS links,
       CAST(max(length(sql_text)) AS INTEGER) AS longest_text, CAST(NULL AS VARCHAR) AS last_name
FROM jobs j LEFT JOIN (SELECT run, count(*) AS n FROM stages GROUP BY run) s ON j.run = s.run GROUP BY j.run
UNION ALL SELECT run, 'SparkListenerJobEnd', count(*), CAST(sum(job_id) AS BIGINT), NULL, NULL, NULL, NULL
FROM jobs WHERE result IS NOT NULL GROUP BY run
UNION ALL SELECT run, 'SparkListenerStageCompleted', count(*), NULL, CAST(sum(stage_id) AS BIGINT), NULL, NULL, max(name)
FROM stages GROUP BY run""", "stages"))
def q_event_log_scan(spark, sf):
    j = b.jobs(spark, sf)
    log = read_event_log(spark, write_event_log(j, b.stages(spark, sf, j), scratch_path(spark, "eventlog")))
    return (log.groupBy("run", F.col("Event").alias("event"))
            .agg(F.count(F.lit(1)).alias("n_events"), F.sum("Job ID").alias("job_ids"),
                 F.sum("Stage Info.Stage ID").alias("stage_ids"), F.sum(F.size("Stage IDs").cast("long")).alias("links"),
                 F.max(F.length(F.element_at("Properties", "spark.job.description"))).alias("longest_text"),
                 F.max("Stage Info.Stage Name").alias("last_name")))


@register("job_fact", with_views(
    "SELECT run, job_id, sql_text, stream_id, submit_ms, finish_ms, result FROM jobs", "jobs"))
def q_job_fact(spark, sf):
    return ev.job_fact(_log(spark, sf))


@register("stage_fact", with_views("SELECT * FROM stages", "stages"))
def q_stage_fact(spark, sf):
    return ev.stage_fact(_log(spark, sf))


@register("stream_job_fact", with_views(
    "SELECT run, stream_id, job_id, submit_ms, finish_ms, result FROM jobs", "jobs"))
def q_stream_job_fact(spark, sf):
    return (ev.job_fact(_log(spark, sf), owner_keys=("jobOwner",))
            .select("run", "stream_id", "job_id", "submit_ms", "finish_ms", "result"))


@register("run_summary", with_views("""
SELECT j.run, j.batch_count, (s.last_complete_ms - s.first_submit_ms) / 1000.0 AS total_sec
FROM (SELECT run, count(result) AS batch_count FROM jobs GROUP BY run) j
JOIN (SELECT run, first(submit_ms ORDER BY complete_ms, stage_id) AS first_submit_ms,
             max(complete_ms) AS last_complete_ms FROM stages GROUP BY run) s ON j.run = s.run""",
    "stages"))
def q_run_summary(spark, sf):
    return ev.run_summary_from_log(_log(spark, sf))
