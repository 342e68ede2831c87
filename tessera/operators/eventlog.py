"""Event-log analytics: per-SQL and per-stream timings, baseline vs regression.

Canonical inputs
----------------
jobs    run, job_id, sql_text, stream_id, submit_ms, finish_ms (null = unfinished), result
stages  run, job_id, sql_text, stream_id, stage_id, name, submit_ms, complete_ms

All operators are keyed aggregations (partial aggregation before the shuffle)
and equi-joins on (run, key). Per-key lookups such as "last failure of this
SQL" are aggregated first and joined back; the aggregated side has one row
per key, so AQE broadcasts it when small and splits skewed partitions when
not. Positional stage merges only number stages within a job (bounded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

JOB_START = "SparkListenerJobStart"
JOB_END = "SparkListenerJobEnd"
STAGE_DONE = "SparkListenerStageCompleted"
SUCCEEDED = "JobSucceeded"
FAILED = "JobFailed"


# ---------------------------------------------------------------- facts
def _owner(owner_keys: tuple[str, ...]):
    props = F.col("Properties")
    owner = F.coalesce(*[F.element_at(props, k) for k in owner_keys])
    return F.when(owner != "null", owner)


OWNER_KEYS = ("jobOwner", "sql.streaming.queryId")


def job_fact(events: DataFrame, owner_keys: tuple[str, ...] = OWNER_KEYS,
             exclude_streaming: bool = False) -> DataFrame:
    """Pair JobStart with JobEnd per (run, job id): one scan, one keyed aggregate.

    ``sql_text`` is property ``spark.job.description``; ``stream_id`` is the first
    present of ``owner_keys`` (the literal text "null" counts as absent).
    ``exclude_streaming`` drops jobs owned by a streaming query (stock Spark
    puts the query's own text into the description).
    """
    started, ended = F.col("Event") == JOB_START, F.col("Event") == JOB_END
    begun = lambda c: F.max(F.when(started, c))
    j = (events.where(started | ended).groupBy("run", F.col("Job ID").alias("job_id"))
         .agg(F.count_if(started).alias("__starts"),
              begun(F.element_at("Properties", "spark.job.description")).alias("sql_text"),
              begun(_owner(owner_keys)).alias("stream_id"), begun(F.col("Submission Time")).alias("submit_ms"),
              F.max(F.when(ended, F.col("Completion Time"))).alias("finish_ms"),
              F.max(F.when(ended, F.col("Job Result.Result"))).alias("result"),
              begun(F.element_at("Properties", "sql.streaming.queryId")).alias("__query_id")))
    j = j.where(F.col("__starts") > 0)
    if exclude_streaming:
        j = j.where(F.col("__query_id").isNull())
    return j.select("run", "job_id", "sql_text", "stream_id", "submit_ms", "finish_ms", "result")


def stage_fact(events: DataFrame, jobs: DataFrame | None = None,
               owner_keys: tuple[str, ...] = OWNER_KEYS) -> DataFrame:
    """Completed stages attached to their jobs through JobStart's ``Stage IDs``: one scan, one keyed aggregate.

    The latest attempt of a stage wins. A stage is listed by the few jobs that share it. ``jobs`` (run, job_id)
    keeps the stages of some jobs only.
    """
    started, done = F.col("Event") == JOB_START, F.col("Event") == STAGE_DONE
    info = F.col("Stage Info")
    job = F.struct(F.col("Job ID").alias("job_id"), F.element_at("Properties", "spark.job.description").alias("sql_text"),
                   _owner(owner_keys).alias("stream_id"))
    stage = F.struct(info["Stage Attempt ID"].alias("attempt"), info["Stage Name"].alias("name"),
                     info["Submission Time"].alias("submit_ms"), info["Completion Time"].alias("complete_ms"))
    none = lambda kind: F.lit(None).cast(kind)
    kinds = ("struct<job_id bigint, sql_text string, stream_id string>",
             "struct<attempt bigint, name string, submit_ms bigint, complete_ms bigint>")
    rows = F.when(started, F.transform("Stage IDs", lambda i: F.struct(
        i.alias("stage_id"), job.cast(kinds[0]).alias("job"), none(kinds[1]).alias("stage")))).otherwise(F.array(F.struct(
            info["Stage ID"].alias("stage_id"), none(kinds[0]).alias("job"), stage.cast(kinds[1]).alias("stage"))))
    s = (events.where(started | done).select("run", F.explode(rows).alias("r")).groupBy("run", "r.stage_id")
         .agg(F.collect_set("r.job").alias("jobs"), F.max("r.stage").alias("s")).where("s is not null")
         .select("run", "stage_id", "s", F.explode("jobs").alias("j")))
    s = s.select("run", "j.job_id", "j.sql_text", "j.stream_id", "stage_id", "s.name", "s.submit_ms", "s.complete_ms")
    return s if jobs is None else s.join(jobs.select("run", "job_id"), ["run", "job_id"], "left_semi")


# ---------------------------------------------------------------- SQL flavour
def drop_failed_sql(jobs: DataFrame) -> DataFrame:
    """A failed job removes every run of its SQL seen so far (per run folder).

    Jobs that start after the SQL's last failure begin afresh and are kept.
    Event order is (time, kind): a start at the very millisecond of a failure
    counts as earlier and is removed.
    """
    last_fail = (jobs.where(F.col("result") == FAILED)
                 .groupBy("run", "sql_text").agg(F.max("finish_ms").alias("__fail_at")))
    return (jobs.join(last_fail, ["run", "sql_text"], "left")
            .where(F.col("__fail_at").isNull() | (F.col("submit_ms") > F.col("__fail_at")))
            .drop("__fail_at"))


def drop_failed_job(jobs: DataFrame) -> DataFrame:
    """Stream flavour: only the failed job itself goes; unfinished jobs stay."""
    return jobs.where(F.col("result").isNull() | (F.col("result") == SUCCEEDED))


def sql_run_merge(jobs: DataFrame) -> DataFrame:
    """Per (run, SQL): the first finished run's elapsed time, plus mean and counts."""
    elapsed = F.col("finish_ms") - F.col("submit_ms")
    first_key = F.when(F.col("finish_ms").isNotNull(), F.struct("submit_ms", "job_id"))
    return jobs.groupBy("run", "sql_text").agg(
        F.min_by(elapsed, first_key).alias("first_ms"),
        F.round(F.avg(elapsed), 6).alias("avg_ms"),
        F.count(F.lit(1)).alias("n_jobs"),
        F.count("finish_ms").alias("n_finished"))


def _side(run_value: str, col: str):
    """The value of ``col`` on the row of one run (one row per (run, key) in the input)."""
    return F.max(F.when(F.col("run") == run_value, F.col(col)))


def _present(run_value: str):
    return F.max(F.when(F.col("run") == run_value, F.lit(1)))


def sql_regression(merged: DataFrame, base: str = "base", reg: str = "reg") -> DataFrame:
    """Union of SQL texts; diff = reg - base; rate = diff / reg; red when diff >= 0.

    ``merged`` has one row per (run, sql), so baseline and regression sides are
    conditional aggregates of one keyed aggregation (no self-join, one pass).
    """
    j = (merged.where(F.col("run").isin(base, reg)).groupBy("sql_text")
         .agg(_side(base, "first_ms").alias("base_ms"), _side(reg, "first_ms").alias("reg_ms"),
              _side(base, "avg_ms").alias("base_avg_ms"), _side(reg, "avg_ms").alias("reg_avg_ms")))
    diff = F.col("reg_ms") - F.col("base_ms")
    return (j.withColumn("diff_ms", diff)
            .withColumn("rate", F.round(F.try_divide(F.col("diff_ms").cast("double"),
                                                     F.col("reg_ms").cast("double")), 9))
            .withColumn("regressed", F.col("diff_ms") >= 0)
            .select("sql_text", "base_ms", "reg_ms", "diff_ms", "rate", "regressed",
                    "base_avg_ms", "reg_avg_ms"))


def stage_positions(stages: DataFrame, keys: tuple[str, ...] = ("run", "job_id")) -> DataFrame:
    """0-based position of each stage inside its job by stage id (jobs have few stages)."""
    w = Window.partitionBy(*keys).orderBy("stage_id")
    return stages.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


def stage_avg_sql(stages: DataFrame, kept_jobs: DataFrame | None = None) -> DataFrame:
    """Stages aligned by position across the runs of a SQL: mean duration (double).

    Every position seen in any run is kept with the number of runs having it;
    the name comes from the first run (lowest job id) at that position.
    """
    s = stages
    if kept_jobs is not None:
        s = s.join(kept_jobs.select("run", "job_id"), ["run", "job_id"], "left_semi")
    s = stage_positions(s)
    dur = F.col("complete_ms") - F.col("submit_ms")
    return s.groupBy("run", "sql_text", "pos").agg(
        F.min_by("name", "job_id").alias("name"),
        F.round(F.avg(dur), 6).alias("avg_ms"),
        F.count(F.lit(1)).alias("n_runs"))


def stage_regression(stage_avg: DataFrame, base: str = "base", reg: str = "reg") -> DataFrame:
    """Positional stage diff: truncated diff of means, rate over the regression mean."""
    j = (stage_avg.where(F.col("run").isin(base, reg)).groupBy("sql_text", "pos")
         .agg(_side(base, "name").alias("base_name"), _side(reg, "name").alias("reg_name"),
              _side(base, "avg_ms").alias("base_avg_ms"), _side(reg, "avg_ms").alias("reg_avg_ms")))
    d = F.col("reg_avg_ms") - F.col("base_avg_ms")
    return j.select("sql_text", "pos", F.coalesce("base_name", "reg_name").alias("name"),
                    "base_avg_ms", "reg_avg_ms", d.cast("long").alias("diff_ms"),
                    F.round(F.try_divide(d, F.col("reg_avg_ms")), 9).alias("rate"))


# ---------------------------------------------------------------- stream flavour
def stream_span(jobs: DataFrame) -> DataFrame:
    """Per (run, stream): latest finish - earliest submit (unfinished jobs have no finish)."""
    return jobs.where(F.col("stream_id").isNotNull()).groupBy("run", "stream_id").agg(
        (F.max("finish_ms") - F.min("submit_ms")).alias("span_ms"))


def stream_avg(jobs: DataFrame) -> DataFrame:
    """Batch count = jobs; time per batch = summed finished time div batch count."""
    el = F.coalesce(F.col("finish_ms") - F.col("submit_ms"), F.lit(0))
    return (jobs.where(F.col("stream_id").isNotNull()).groupBy("run", "stream_id")
            .agg(F.count(F.lit(1)).alias("batches"), F.sum(el).alias("__total"))
            .select("run", "stream_id", "batches",
                    F.expr("__total div batches").alias("ms_per_batch")))


def stream_stage_avg(stages: DataFrame, kept_jobs: DataFrame | None = None) -> DataFrame:
    """Positional stage means over a stream's batches (integer division)."""
    s = stages.where(F.col("stream_id").isNotNull())
    if kept_jobs is not None:
        s = s.join(kept_jobs.select("run", "job_id"), ["run", "job_id"], "left_semi")
    s = stage_positions(s)
    dur = F.col("complete_ms") - F.col("submit_ms")
    return (s.groupBy("run", "stream_id", "pos")
            .agg(F.min_by("name", "job_id").alias("name"), F.sum(dur).alias("__total"),
                 F.count(F.lit(1)).alias("n_batches"))
            .select("run", "stream_id", "pos", "name",
                    F.expr("__total div n_batches").alias("avg_ms"), "n_batches"))


def stream_metrics(jobs: DataFrame) -> DataFrame:
    """Span, batch count and time per batch in one keyed aggregation."""
    el = F.coalesce(F.col("finish_ms") - F.col("submit_ms"), F.lit(0))
    return (jobs.where(F.col("stream_id").isNotNull()).groupBy("run", "stream_id")
            .agg((F.max("finish_ms") - F.min("submit_ms")).alias("span_ms"),
                 F.count(F.lit(1)).alias("batches"), F.sum(el).alias("__total"))
            .select("run", "stream_id", "span_ms", "batches",
                    F.expr("__total div batches").alias("ms_per_batch")))


def stream_regression(metrics: DataFrame, base: str = "base", reg: str = "reg") -> DataFrame:
    """Streams of the baseline, regression values where present; % of baseline; red when > 0."""
    j = (metrics.where(F.col("run").isin(base, reg)).groupBy("stream_id")
         .agg(_present(base).alias("__b"),
              _side(base, "span_ms").alias("base_span_ms"), _side(reg, "span_ms").alias("reg_span_ms"),
              _side(base, "batches").alias("base_batches"), _side(reg, "batches").alias("reg_batches"),
              _side(base, "ms_per_batch").alias("base_ms_per_batch"),
              _side(reg, "ms_per_batch").alias("reg_ms_per_batch"))
         .where(F.col("__b").isNotNull()))
    span_d = F.col("reg_span_ms") - F.col("base_span_ms")
    batch_d = F.col("reg_batches") - F.col("base_batches")
    tpb_d = F.col("reg_ms_per_batch") - F.col("base_ms_per_batch")
    pct = lambda d, base_col: F.round(F.try_divide(d.cast("double") * 100.0, F.col(base_col).cast("double")), 6)
    return j.select(
        "stream_id", "base_span_ms", "reg_span_ms", span_d.alias("span_diff_ms"),
        pct(span_d, "base_span_ms").alias("span_pct"),
        "base_batches", "reg_batches", batch_d.alias("batch_diff"),
        "base_ms_per_batch", "reg_ms_per_batch", tpb_d.alias("ms_per_batch_diff"),
        pct(tpb_d, "base_ms_per_batch").alias("ms_per_batch_pct"),
        (span_d > 0).alias("span_regressed"), (tpb_d > 0).alias("ms_per_batch_regressed"))


def stream_stage_regression(stage_avg: DataFrame, base: str = "base", reg: str = "reg") -> DataFrame:
    """Stages zipped by position (cut to the shorter list): reg - base."""
    j = (stage_avg.where(F.col("run").isin(base, reg)).groupBy("stream_id", "pos")
         .agg(_present(base).alias("__b"), _present(reg).alias("__r"),
              _side(base, "name").alias("name"),
              _side(base, "avg_ms").alias("base_avg_ms"), _side(reg, "avg_ms").alias("reg_avg_ms"))
         .where(F.col("__b").isNotNull() & F.col("__r").isNotNull()))
    return j.select("stream_id", "pos", "name", "base_avg_ms", "reg_avg_ms",
                    (F.col("reg_avg_ms") - F.col("base_avg_ms")).alias("diff_ms"))


# ---------------------------------------------------------------- one log
def run_summary_from_log(events: DataFrame) -> DataFrame:
    """``run_summary`` in one pass over the log (conditional aggregates per run)."""
    done = F.col("Event") == STAGE_DONE
    order = F.when(done, F.struct(F.col("Stage Info.Completion Time"), F.col("Stage Info.Stage ID")))
    return (events.groupBy("run")
            .agg(F.count_if(F.col("Event") == JOB_END).alias("batch_count"),
                 F.min_by(F.col("Stage Info.Submission Time"), order).alias("__first"),
                 F.max_by(F.col("Stage Info.Completion Time"), order).alias("__last"))
            .select("run", "batch_count", ((F.col("__last") - F.col("__first")) / 1000.0).alias("total_sec")))
