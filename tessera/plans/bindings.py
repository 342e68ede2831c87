"""Canonical operator inputs derived from the driver's tables.

Each function reads the driver's parquet tables and returns one of the
canonical inputs (``jobs``, ``stages``, ``test_events``, ``script_lines``,
``result_lines``, ``target_lines``, ``offsets``, ``snapshots`` and a few
text inputs). The same derivations exist as DuckDB SQL in
``tessera.plans.oracle_views`` for the value checks.

Row positions inside possibly huge groups (a case's result rows, a user's
polls) use the bucketed ``row_index`` rather than one window per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.scan import row_index
from tessera.session import read_table

_CUTOFF = "TIMESTAMP_NTZ '1998-04-01 00:00:00'"


def jobs(spark: SparkSession, sf: str, orders: DataFrame | None = None) -> DataFrame:
    o = orders if orders is not None else read_table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    unfinished = (k % 211) == 5
    return o.select(
        F.when(c % 40 == 0, "base").when(c % 40 == 1, "reg")
         .when(F.col("o_orderdate") < F.expr(_CUTOFF), "base").otherwise("reg").alias("run"),
        k.alias("job_id"),
        F.concat(F.lit("select * from q"), (c % 40).cast("string")).alias("sql_text"),
        (c % 25).cast("string").alias("stream_id"),
        (k * 100000).alias("submit_ms"),
        F.when(unfinished, F.lit(None).cast("long"))
         .otherwise(k * 100000 + F.floor("o_totalprice").cast("long")).alias("finish_ms"),
        F.when(unfinished, F.lit(None).cast("string"))
         .when((F.col("o_orderstatus") == "F") & (k % 97 == 0), "JobFailed")
         .otherwise("JobSucceeded").alias("result"),
    )


def _line_positions(spark: SparkSession, sf: str, base: int) -> DataFrame:
    """lineitem rows with their position inside the order (bounded: <= 7 lines)."""
    li = read_table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return li.withColumn("pos", (F.row_number().over(w) - 1 + base).cast("long"))


def stages(spark: SparkSession, sf: str, jobs_df: DataFrame | None = None) -> DataFrame:
    """Stages of ``jobs_df`` (default: all jobs); passing the kept jobs filters in the same join."""
    j = jobs_df if jobs_df is not None else jobs(spark, sf)
    s = _line_positions(spark, sf, 0).select(
        F.col("l_orderkey").alias("job_id"),
        F.concat("l_returnflag", "l_linestatus").alias("name"),
        (F.col("l_quantity") * 37).cast("long").alias("dur"),
        "pos")
    jj = j.select("job_id", "run", "sql_text", "stream_id", F.col("submit_ms").alias("job_submit"))
    return s.join(jj, "job_id").select(
        "run", "job_id", "sql_text", "stream_id",
        (F.col("job_id") * 100 + F.col("pos")).alias("stage_id"),
        "name",
        (F.col("job_submit") + F.col("pos") * 1000).alias("submit_ms"),
        (F.col("job_submit") + F.col("pos") * 1000 + F.col("dur")).alias("complete_ms"),
    )


def test_events(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    kind = (F.when(F.col("event_type") == "signup", "TestStarting")
             .when(F.col("event_type") == "purchase", "TestSucceeded")
             .when(F.col("event_type") == "error", "TestFailed")
             .when(F.col("event_type") == "click", "InfoProvided")
             .otherwise("TestIgnored"))
    body = e.select(F.col("user_id").alias("suite"), F.col("event_id").alias("ordinal"),
                    "ts", kind.alias("kind"), F.col("props").alias("message"))
    agg = e.groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"),
                                   F.max("event_id").alias("last"))
    start = agg.select(F.col("user_id").alias("suite"), F.lit(-1).cast("long").alias("ordinal"),
                       F.col("t0").alias("ts"), F.lit("SuiteStarting").alias("kind"),
                       F.lit(None).cast("string").alias("message"))
    end = agg.select(F.col("user_id").alias("suite"), (F.col("last") + 1).alias("ordinal"),
                     F.col("t1").alias("ts"),
                     F.when(F.col("user_id") % 10 == 0, "SuiteAborted")
                      .otherwise("SuiteCompleted").alias("kind"),
                     F.lit(None).cast("string").alias("message"))
    return body.unionByName(start).unionByName(end)


def script_lines(spark: SparkSession, sf: str) -> DataFrame:
    li = _line_positions(spark, sf, 1)
    ln = F.col("l_linenumber")
    line = (F.when(ln == 1, F.concat(F.lit("create table if not exists $"), F.lit("{prefix}t"),
                                      F.col("l_partkey").cast("string"), F.lit("(")))
             .when(ln == 2, "a int); -- target")
             .when(ln == 3, "begin")
             .when(ln == 4, "select 1;")
             .when(ln == 5, "end;")
             .when((ln == 6) & (F.col("l_suppkey") % 3 == 0), "use application $" + "{app}; -- time:60")
             .when(ln == 6, F.concat(F.lit("use application app"),
                                     (F.col("l_suppkey") % 3).cast("string"),
                                     F.lit("; -- time:60")))
             .otherwise(F.concat(F.lit("select count(*) from t"),
                                 F.col("l_suppkey").cast("string"), F.lit("; -- error"))))
    return li.select(F.col("l_orderkey").alias("file"), F.col("pos").alias("n"), line.alias("line"))


def stream_script_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts that create and start streams (stream ids, topics, no-reset)."""
    li = _line_positions(spark, sf, 1)
    ln = F.col("l_linenumber")
    sup = F.col("l_suppkey").cast("string")
    line = (F.when(ln == 1, F.concat(F.lit("create stream s"), sup,
                                      F.lit("(a int) tblproperties(\"topic\"=\"Topic_"),
                                      F.col("l_returnflag"), F.lit("\");")))
             .when(ln == 2, F.concat(F.lit("create stream r"), sup,
                                     F.lit("(a int) tblproperties('topic'='T"), sup,
                                     F.lit("'); -- no-reset")))
             .when(ln == 3, F.concat(F.lit("insert into t"), sup, F.lit(" select * from s"),
                                     sup, F.lit("; -- stream")))
             .when(ln == 4, F.concat(F.lit("create view v"), sup, F.lit(" as select * from t"),
                                     sup, F.lit(";")))
             .when(ln == 5, F.concat(F.lit("create external table if not exists e"), sup,
                                     F.lit("(a int);")))
             .when(ln == 6, F.concat(F.lit("insert into u select * from r"), sup,
                                     F.lit("; -- stream")))
             .otherwise(F.concat(F.lit("select count(*) from t"), sup, F.lit("; -- target"))))
    return li.select(F.col("l_orderkey").alias("file"), F.col("pos").alias("n"), line.alias("line"))


def rendered_results(orders: DataFrame) -> DataFrame:
    return orders.select(
        (F.col("o_custkey") % 200).alias("case_id"), "o_orderkey",
        F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"),
                    F.floor("o_totalprice").cast("long").cast("string")).alias("line"))


def numbered_results(rendered: DataFrame) -> DataFrame:
    return row_index(rendered, ["case_id"], "o_orderkey").select("case_id", "row_idx", "o_orderkey", "line")


def result_lines(spark: SparkSession, sf: str) -> DataFrame:
    return numbered_results(rendered_results(read_table(spark, sf, "orders")))


def target_lines(spark: SparkSession, sf: str, results: DataFrame | None = None) -> DataFrame:
    r = results if results is not None else result_lines(spark, sf)
    k = F.col("o_orderkey")
    pattern = (F.when(k % 1009 == 3, "( Z Z")
                .when(k % 501 == 0, F.concat(F.col("line"), F.lit(" extra")))
                .when(k % 7 == 0, "[0-9]+ [FOP] [0-9]+")
                .otherwise(F.col("line")))
    return (r.where(~((F.col("case_id") % 17 == 0) & (F.col("row_idx") == 0)))
             .select("case_id", "row_idx", pattern.alias("pattern")))


def offsets(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return (e.groupBy(F.col("event_type").alias("topic"), (F.col("event_id") % 4).alias("part"))
             .agg(F.min("event_id").alias("earliest"),
                  (F.max("event_id") + 1).alias("end_offset"),
                  (F.max(F.when((F.col("event_type") != "error") | (F.col("value") < 20),
                                F.col("event_id"))) + 1).alias("committed")))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    base = e.select(F.col("user_id").alias("case_id"), "event_id", "event_type")
    idx = row_index(base, ["case_id"], "event_id", name="poll_no")
    tgt = (F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "purchase", 1)
            .when(F.col("event_type") == "view", 2))
    return idx.select("case_id", (F.col("poll_no") * 2000).alias("poll_ms"),
                      tgt.alias("passing_target"))


def message_log(spark: SparkSession, sf: str) -> DataFrame:
    """Per-message stream log (topic, partition, offset) from ``events``."""
    e = read_table(spark, sf, "events")
    return e.select(F.col("event_type").alias("topic"), (F.col("event_id") % 4).alias("part"),
                    F.col("event_id").alias("offset"))
