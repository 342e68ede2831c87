"""Spark listener event logs as JSON lines.

``read_event_log`` scans JSON-line files with an explicit schema (no inference pass); unparsable lines become
all-null rows and are dropped, as the reference skips them. Logs may lie as they were written: ``EVENT*`` files in
a folder per run, stock single files (``app-..``, ``local-..``, ``application_..``), stock rolled logs
(``eventlog_v2_<app>/events_N_<app>``), or part files below ``run=<name>`` folders. ``write_event_log``
renders canonical jobs/stages as the three event kinds the analytics use, one folder per run, in parallel, compressed
part files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.eventlog import JOB_END, JOB_START, STAGE_DONE

EVENT_SCHEMA = (
    "Event string, `Job ID` long, `Submission Time` long, `Completion Time` long, "
    "`Stage IDs` array<long>, Properties map<string,string>, `Job Result` struct<Result:string>, "
    "`Stage Info` struct<`Stage ID`:long, `Stage Attempt ID`:long, `Stage Name`:string, "
    "`Submission Time`:long, `Completion Time`:long>"
)


LOG_FILES = "{EVENT*,events_*,app-*,local-*,application_*,part-*}"


def run_of(path):
    """The run a log file belongs to: its ``run=`` folder, else the folder of ``EVENT*`` and rolled files, else the
    file's own name (without ``.inprogress``)."""
    folder, name = F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1)
    named = F.regexp_extract(path, r"/run=([^/]+)/", 1)
    return (F.when(named != "", F.url_decode(named))
             .when(name.rlike("^(EVENT|events_|part-)"), F.regexp_replace(folder, "^eventlog_v2_", ""))
             .otherwise(F.regexp_replace(name, r"\.inprogress$", "")))


def read_event_log(spark: SparkSession, path: str, files: str = LOG_FILES) -> DataFrame:
    """Events of all log files below ``path``, with the ``run`` each belongs to."""
    raw = (spark.read.schema(EVENT_SCHEMA).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", files).json(path))
    return raw.select(run_of(F.col("_metadata.file_path")).alias("run"), "*").where(F.col("Event").isNotNull())


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """(run, value) JSON lines as events, unparsable ones dropped."""
    e = lines.select("run", F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE"}).alias("e"))
    return e.select("run", "e.*").where(F.col("Event").isNotNull())


def event_lines(jobs: DataFrame, stages: DataFrame, owner_key: str = "jobOwner") -> DataFrame:
    """(run, value) JSON lines: JobStart, JobEnd (finished jobs), StageCompleted.

    Failed jobs are followed by one unparsable line, which readers must skip.
    """
    stage_ids = stages.groupBy("run", "job_id").agg(
        F.sort_array(F.collect_list("stage_id")).alias("stage_ids"))  # a job's own stages
    j = jobs.join(stage_ids, ["run", "job_id"], "left")
    start = j.select("run", F.to_json(F.struct(
        F.lit(JOB_START).alias("Event"), F.col("job_id").alias("Job ID"),
        F.col("submit_ms").alias("Submission Time"),
        F.coalesce("stage_ids", F.array().cast("array<long>")).alias("Stage IDs"),
        F.create_map(F.lit("spark.job.description"), F.col("sql_text"),
                     F.lit(owner_key), F.coalesce(F.col("stream_id"), F.lit("null")))
        .alias("Properties"))).alias("value"))
    end = jobs.where(F.col("result").isNotNull()).select("run", F.to_json(F.struct(
        F.lit(JOB_END).alias("Event"), F.col("job_id").alias("Job ID"),
        F.col("finish_ms").alias("Completion Time"),
        F.struct(F.col("result").alias("Result")).alias("Job Result"))).alias("value"))
    junk = jobs.where(F.col("result") == "JobFailed").select(
        "run", F.concat(F.lit("{truncated event of job "), F.col("job_id").cast("string")).alias("value"))
    done = stages.select("run", F.to_json(F.struct(
        F.lit(STAGE_DONE).alias("Event"),
        F.struct(F.col("stage_id").alias("Stage ID"), F.lit(0).cast("long").alias("Stage Attempt ID"),
                 F.col("name").alias("Stage Name"), F.col("submit_ms").alias("Submission Time"),
                 F.col("complete_ms").alias("Completion Time")).alias("Stage Info"))).alias("value"))
    return start.unionByName(end).unionByName(junk).unionByName(done)


def write_event_log(jobs: DataFrame, stages: DataFrame, path: str,
                    owner_key: str = "jobOwner") -> str:
    (event_lines(jobs, stages, owner_key).write.mode("overwrite").option("compression", "lz4").partitionBy("run")
     .text(path))
    return path
