"""From annotated script files to verdicts.

A corpus is two tables of lines: scripts (file, n, line) and golden targets (file, n, line). The script operators
turn it into steps: statements with their pieces, directives, time limits and variables; the settings of a
suite come first in each of its cases, as ``with_globals`` numbers them. ``run_cases`` executes the steps, every
case in its own session, and verifies all targets in one plan.

Only the statements pass through the driver. ``stream`` directives start streams over a folder of topics, drained before
every checked step; what they have read of each topic against what it holds answers ``# data-received`` targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import substitute
from tessera.operators import scripts as sc
from tessera.operators.offsets import consumer_lag, group_key
from tessera.operators.verify import PASS, case_outcome
from tessera.plans.case_runner import TOPIC_RX, CaseSession, Step, run_cases
from tessera.sources.streams import TOPIC_SCHEMA
from tessera.sources.targets import heads_and_lines, read_targets


def script_steps(lines: DataFrame, settings: DataFrame | None = None, suite: Column | None = None,
                 default_s: int = 30) -> DataFrame:
    """(suite, file, step, piece_idx, sql, comment, is_last, limit_s): all statements' pieces in order.

    ``settings`` (suite, pos, sql) appear once a suite, with a null file and negative steps.
    """
    suite = F.lit("suite") if suite is None else suite
    st = sc.statements(lines)
    pieces = sc.split_statement(st, ["comment"]).select("file", "n", "piece_idx", F.col("piece").alias("sql"), "comment",
                                                        "is_last")
    notes = st.where(F.col("sql") == "").select("file", "n", F.lit(0).cast("long").alias("piece_idx"), "sql", "comment",
                                                F.lit(True).alias("is_last"))
    steps = pieces.unionByName(notes).join(sc.time_limit(lines, default_s), "file").withColumn("suite", suite)
    if settings is None:
        return steps.withColumnRenamed("n", "step")
    first = sc.with_globals(steps.limit(0), settings).select("suite", "file", "step", "sql")
    return steps.withColumnRenamed("n", "step").unionByName(
        first.withColumn("is_last", F.lit(True)), allowMissingColumns=True)


def _steps(table: DataFrame) -> tuple[list[Step], dict[str, str]]:
    """The steps of all cases, the settings of their suites first, and every case's suite."""
    before: dict[str, list] = {}
    steps: list[Step] = []
    suites: dict[str, str] = {}
    for r in table.orderBy(F.col("file").asc_nulls_first(), "step", "piece_idx").toLocalIterator():
        if r.file is None:
            before.setdefault(r.suite, []).append(r.sql)
            continue
        case = str(r.file)
        if case not in suites:
            suites[case] = r.suite
            steps += [Step(case, sql, limit_s=r.limit_s) for sql in before.get(r.suite, ())]
        if r.sql:
            steps.append(Step(case, r.sql, r.comment, r.limit_s, r.is_last))
    return steps, suites


def run_scripts(spark: SparkSession, lines: DataFrame, golden: DataFrame, variables: Column | None = None,
                settings: DataFrame | None = None, suite: Column | None = None, topics: str | None = None,
                groups: str | None = None, database: str = "default", default_s: int = 30, threads: int = 4,
                failed_to: str | None = None) -> DataFrame:
    """Run a corpus: (case, target_idx, verdict, message), one row per checked step; a case is a script file.

    ``variables``: a map by file for ``${name}`` in scripts and golden lines. The names ``prefix``, ``app`` and
    ``database`` have defaults; ``app`` and ``stream<k>`` change as the case runs. ``topics``: the folder that
    ``to_stream`` writes to; ``groups``: where groups keep their positions between runs. With ``failed_to``, what failed
    cases have issued is written there, one folder of statements a case.
    """
    if variables is not None:
        lines = lines.withColumn("line", substitute(F.col("line"), variables))
    table = script_steps(lines, settings, suite, default_s)
    steps, suites = _steps(table)
    sessions: dict[str, CaseSession] = {}

    def session(case: str) -> CaseSession:
        app = f"{suites[case]}_{case}"
        own = CaseSession(spark, case, {"prefix": app + "_", "app": app, "database": database}, topics, groups)
        own.spark.sql(f"use {database}")
        sessions[case] = own
        return own

    files = lines.select("file").distinct()
    heads, patterns = heads_and_lines(read_targets(golden, variables, files))
    heads, patterns = (x.withColumn("case", F.col("file").cast("string")).drop("file") for x in (heads, patterns))
    lags = topic_lags(spark, sessions, topics) if topics else None
    got = run_cases(spark, steps, patterns, heads=heads, limit_s=default_s, threads=threads, session=session,
                    lags=lags)
    if failed_to:
        write_failed(spark, got, sessions, failed_to)
    return got


def topic_lags(spark: SparkSession, sessions: dict[str, CaseSession], topics: str):
    """A function giving (topic, verdict) after the cases have run: read by every group against written.

    A stream's group is its application, database and stream view; a topic has its data received when all groups that
    read it have read all of it.
    """
    def lags() -> DataFrame:
        rows = [(own.variables["app"], own.variables["database"], view, topic, s.read)
                for own in sessions.values() for s in own.ended for view, topic in own.sources.items()
                if topic in s.topics]
        read = spark.createDataFrame(rows, "app string, db string, view string, topic string, committed long")
        read = (read.groupBy(group_key(F.col("app"), F.col("db"), F.col("view")).alias("group_id"), "topic")
                .agg(F.max("committed").alias("committed")))
        written = (spark.read.schema(TOPIC_SCHEMA).parquet(topics).groupBy("topic")
                   .agg(F.count(F.lit(1)).alias("end_offset")))
        return consumer_lag(read.join(written, "topic")).groupBy("topic").agg(F.max(
            F.when(F.col("verdict") != PASS, F.col("verdict"))).alias("late")) \
            .select("topic", F.coalesce("late", F.lit(PASS)).alias("verdict"))
    return lags


def issued_scripts(spark: SparkSession, sessions: dict[str, CaseSession], cases: Sequence[str]) -> DataFrame:
    """(file, n, sql): the statements that these cases have issued, with their variables resolved, in order."""
    rows = [(c, n, sql) for c in cases for n, sql in enumerate(sessions[c].issued)]
    return spark.createDataFrame(rows, "file string, n int, sql string")


def write_failed(spark: SparkSession, verdicts: DataFrame, sessions: dict[str, CaseSession], path: str) -> str:
    """The issued statements of every case with a target that has not passed, one folder a case."""
    failed = [r.case for r in case_outcome(verdicts, ["case"]).where(~F.col("passed")).select("case").toLocalIterator()]
    return sc.write_failed_scripts(issued_scripts(spark, sessions, failed), path)
