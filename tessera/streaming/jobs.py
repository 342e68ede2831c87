"""Streaming forms of the operators (bounded replays run with ``availableNow``).

``drain`` starts a query to a fresh sink folder below the shared checkpoint folder, waits for it, and returns the
sink as a batch DataFrame. Tables are streamed from where they are. Streams run in a session of their own, so
their settings touch no other query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import scratch_path, table_path


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session whose stateful streams have one state partition per core (fixed when a query first starts)."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(max(1, spark.sparkContext.defaultParallelism)))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's parquet file (or folder of files) as a stream, in a streaming session."""
    path = table_path(sf_dir, name)
    table = spark.read.parquet(path)
    reader = streaming_session(spark).readStream.schema(table.schema)
    if all(f.rstrip("/").endswith(f"/{name}.parquet") for f in table.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def drain(stream: DataFrame, name: str, spark: SparkSession | None = None, sink: str | None = None,
          ckpt: str | None = None) -> DataFrame:
    """Run ``stream`` to a parquet sink with ``availableNow`` and read the sink back (in ``spark``).

    With the ``sink`` and ``ckpt`` of an earlier run it goes on where that one has ended.
    """
    own = stream.sparkSession
    spark = spark or own
    sink, ckpt = sink or scratch_path(spark, f"{name}-sink"), ckpt or scratch_path(spark, f"{name}-ckpt")
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def job_pairs(starts: DataFrame, ends: DataFrame, bound: str = "10 minutes") -> DataFrame:
    """JobStart/JobEnd pairing per (run, job_id), with a bound on how late an end may come.

    A left outer join: a start whose end has not come within the bound goes out alone once the watermark has
    passed it. Both sides carry watermarks, so the join state is purged then.
    """
    s = starts.withWatermark("start_ts", bound).alias("s")
    e = ends.withWatermark("end_ts", bound).alias("e")
    cond = ((F.col("s.run") == F.col("e.run")) & (F.col("s.job_id") == F.col("e.job_id"))
            & (F.col("e.end_ts") >= F.col("s.start_ts"))
            & (F.col("e.end_ts") <= F.col("s.start_ts") + F.expr(f"INTERVAL {bound}")))
    return s.join(e, cond, "left_outer").select("s.run", "s.job_id", "s.start_ts", "e.end_ts")


END_OF_TIME = "9999-01-01 00:00:00"


def replay_pairs(starts: DataFrame, ends: DataFrame, bound: str = "10 minutes", spark: SparkSession | None = None,
                 name: str = "job-pairs") -> DataFrame:
    """``job_pairs`` over a bounded replay: every start comes out, those still open at its end alone.

    The streams are drained first. Then a closing row, at the end of time, comes through a control
    stream on each side; it carries the watermark past every start, and the last batch, without data, empties the join's
    state. Nothing is read twice: open starts come from that state.
    """
    own = starts.sparkSession
    spark = spark or own
    control, sink, ckpt = (scratch_path(spark, f"{name}-{x}") for x in ("control", "sink", "ckpt"))

    def write(n: int) -> None:
        (spark.range(n).select(F.lit(END_OF_TIME).cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(control))

    def with_closing(rows: DataFrame, ts: str) -> DataFrame:
        more = own.readStream.schema("ts timestamp").parquet(control)
        # not null: rows without a key are filtered before they reach the watermark
        closing = [F.lit("0").cast(f.dataType).alias(f.name) if f.name != ts else F.col("ts").alias(ts)
                   for f in rows.schema.fields]
        return rows.unionByName(more.select(*closing))

    write(0)
    pairs = job_pairs(with_closing(starts, "start_ts"), with_closing(ends, "end_ts"), bound)
    for closing in (False, True):
        if closing:
            write(1)
        drain(pairs, name, spark, sink, ckpt)
    return spark.read.schema(pairs.schema).parquet(sink).where(F.col("start_ts") < F.lit(END_OF_TIME).cast("timestamp"))


ORIGIN_MS = 946684800000  # event time of poll 0 (2000-01-01): the initial watermark is the epoch


def eventually(snapshots: DataFrame, n_targets: int, limit_ms: int, delay: str = "0 seconds",
               origin_ms: int = ORIGIN_MS) -> DataFrame:
    """Sticky polling as a stateful stream keyed by case: a row when a case is first seen and whenever it gets on.

    Polls of a trigger are taken by (poll_ms, passing_target), so one poll may pass several targets; polls past
    the limit pass nothing. Before that, polls are made distinct, dealt by all their columns: a case's task gets each
    (poll, target) once, at most one for every millisecond of the limit and target, however many events the case has,
    and polls that pass nothing once a trigger. State per case: the number of targets passed, dropped at the limit's
    event time. ``latest`` reads the outcome from the rows: no case waits for a timer to show up.
    """
    passing = F.when(F.col("poll_ms") <= limit_ms, F.col("passing_target"))
    poll = F.when(passing.isNotNull(), F.col("poll_ms")).otherwise(F.least(F.col("poll_ms"), F.lit(limit_ms)))
    snapshots = (snapshots.select("case_id", poll.alias("poll_ms"), passing.cast("int").alias("passing_target"))
                 .withColumn("ts", F.timestamp_millis(F.col("poll_ms") + F.lit(origin_ms)))
                 .withWatermark("ts", delay).dropDuplicates(["case_id", "poll_ms", "passing_target", "ts"]))
    out_schema = "case_id long, reached int, passed boolean, pass_ms long"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.exists
        start = pointer = state.get[0] if known else 0
        polls: list[tuple[int, int]] = []  # distinct, so bounded by the limit
        for b in batches:
            b = b[b["passing_target"].notna()]
            polls += zip(b["poll_ms"].tolist(), b["passing_target"].astype(int).tolist())
        at = None
        for poll, target in sorted(polls):
            if pointer < n_targets and target == pointer:
                pointer += 1
                at = poll
        state.update((pointer,))
        state.setTimeoutTimestamp(max(origin_ms + limit_ms + 1, state.getCurrentWatermarkMs() + 1))
        if not known or pointer > start:
            done = pointer == n_targets
            yield pd.DataFrame({"case_id": [int(key[0])], "reached": [pointer], "passed": [done],
                                "pass_ms": pd.array([at if done else None], dtype="Int64")})

    return (snapshots.groupBy("case_id")
            .applyInPandasWithState(step, out_schema, "pointer int", "append", GroupStateTimeout.EventTimeTimeout))


def latest(rows: DataFrame) -> DataFrame:
    """The outcome of every case from the rows of ``eventually``."""
    return rows.groupBy("case_id").agg(F.max("reached").alias("reached"), F.max("passed").alias("passed"),
                                       F.max("pass_ms").alias("pass_ms"))
