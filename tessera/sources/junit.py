"""JUnit-style XML reports with Spark's built-in XML source.

A suite is a ``<testsuite>`` element with its attributes (errors, failures, tests, time, timestamp) and its
``<testcase>`` elements: name, time, skipped or failure (message, type, text), and the test's infos as
``<system-out>``. A suite with very many events is written as several elements of one name, each with the cases of
``CHUNK`` consecutive ordinals, the attributes on the first: no row grows with its suite, and the elements are written by
all tasks alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 10_000
FAILURE_TYPE = "TestFailed"

CASE = ("struct<_name:string, _classname:string, _time:double, skipped:struct<_message:string>, "
        "failure:struct<_message:string, _type:string, _VALUE:string>, `system-out`:string>")
SUITE_SCHEMA = ("_name string, _tests long, _failures long, _errors long, _time double, _timestamp string, "
                f"testcase array<{CASE}>")


def write_junit(suites: DataFrame, cases: DataFrame, path: str) -> str:
    """``suites``: suite, tests, failures, errors, time_ms, timestamp;
    ``cases``: suite, ordinal, name, time_ms, status, message, infos (array of text)."""
    skipped, failed = F.col("status").isin("ignored", "pending", "canceled"), F.col("status") == "failed"
    case = F.struct(
        F.col("name").alias("_name"), F.col("suite").alias("_classname"), (F.col("time_ms") / 1000.0).alias("_time"),
        F.when(skipped, F.struct(F.col("status").alias("_message"))).alias("skipped"),
        F.when(failed, F.struct(F.col("message").alias("_message"), F.lit(FAILURE_TYPE).alias("_type"),
                                F.col("message").alias("_VALUE"))).alias("failure"),
        F.when(F.size("infos") > 0, F.array_join("infos", "\n")).alias("system-out"))
    parts = (cases.select("suite", F.floor(F.col("ordinal") / CHUNK).alias("__chunk"), "ordinal", case.alias("case"))
             .groupBy("suite", "__chunk")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "case"))), lambda x: x["case"]).alias("testcase")))
    first = parts.groupBy("suite").agg(F.min("__chunk").alias("__first"))
    attributes = suites.join(first, "suite", "left").select(
        "suite", F.coalesce("__first", F.lit(0)).alias("__chunk"), F.col("tests").alias("_tests"),
        F.col("failures").alias("_failures"), F.col("errors").alias("_errors"), (F.col("time_ms") / 1000.0).alias("_time"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("_timestamp"))
    rows = attributes.join(parts, ["suite", "__chunk"], "full_outer")
    (rows.select(F.col("suite").alias("_name"), "_tests", "_failures", "_errors", "_time", "_timestamp", "testcase")
     .write.mode("overwrite").format("xml").option("rootTag", "testsuites").option("rowTag", "testsuite").save(path))
    return path


def read_junit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(suites, cases) of a report, with an explicit schema (no inference pass over the XML)."""
    rows = spark.read.format("xml").schema(SUITE_SCHEMA).option("rowTag", "testsuite").load(path)
    suites = rows.where(F.col("_tests").isNotNull()).drop("testcase")
    return suites, rows.select(F.col("_name").alias("suite"), F.explode("testcase").alias("c")).select("suite", "c.*")
