"""Rolling test events up to test cases and suites (JUnit-style reports).

``events``: suite, ordinal (order within the suite), ts, kind, message.
Kinds: SuiteStarting, SuiteCompleted, SuiteAborted, TestStarting,
TestSucceeded, TestFailed, TestPending, TestCanceled, TestIgnored,
InfoProvided (others are skipped).

A test is the run of events from one TestStarting to the next; its number is a
running count of starts per suite (bucketed scan: a suite with a third of all
events is still split across tasks). Everything after that is keyed
aggregation per (suite, test) with ``min_by`` picking the first terminal.
Unmatched events are counted in ``unexpected`` instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.scan import bucketed_scan, row_index

# Event kinds of the test reporter protocol.
SUITE_START = "SuiteStarting"
SUITE_ENDS = ("SuiteCompleted", "SuiteAborted")
TEST_START = "TestStarting"
TERMINALS = ("TestSucceeded", "TestFailed", "TestPending", "TestCanceled")
IGNORED = "TestIgnored"
INFO = "InfoProvided"
STATUS = {"TestSucceeded": "succeeded", "TestFailed": "failed",
          "TestPending": "pending", "TestCanceled": "canceled"}
SKIPPED = ("ignored", "pending", "canceled")


def _ms_between(start: str, end: str):
    """Whole milliseconds between two timestamps (micro difference, truncated)."""
    return F.expr(f"(unix_micros(CAST({end} AS TIMESTAMP)) - unix_micros(CAST({start} AS TIMESTAMP))) div 1000")


def suite_events(events: DataFrame) -> DataFrame:
    """Events of each suite with their 0-based position in ordinal order."""
    e = events.where(F.col("suite").isNotNull())
    return row_index(e, ["suite"], "ordinal", name="seq").select("suite", "ordinal", "kind", "seq")


def suite_bounds(events: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Each suite end event with the nearest earlier SuiteStarting.

    ``scanned``: the output of ``numbered`` (which carries the running start), to
    reuse that pass instead of scanning the events again.
    """
    s = scanned if scanned is not None else numbered(events)
    return (s.where(F.col("kind").isin(*SUITE_ENDS))
            .select("suite", F.col("__start.ordinal").alias("start_ordinal"),
                    F.col("ordinal").alias("end_ordinal"),
                    (F.col("kind") == "SuiteAborted").alias("aborted"),
                    _ms_between("__start.ts", "ts").alias("time_ms")))


def numbered(events: DataFrame) -> DataFrame:
    """events + test_no (running count of TestStarting, inclusive; 0 before the first)
    + ``__start`` (the latest SuiteStarting at or before the event), in one scan."""
    start = F.when(F.col("kind") == SUITE_START, F.struct("ordinal", "ts"))
    return bucketed_scan(events.where(F.col("suite").isNotNull()), ["suite"], "ordinal",
                         sums={"test_no": (F.col("kind") == TEST_START).cast("int")},
                         lasts={"__start": start}, inclusive=True)


def test_pairs(num: DataFrame) -> DataFrame:
    """Each TestStarting with its first following terminal event (before the next start)."""
    is_term = F.col("kind").isin(*TERMINALS)
    st = F.when(F.col("kind") == TEST_START, F.col("ordinal"))
    te = F.when(is_term, F.col("ordinal"))
    g = (num.where(F.col("test_no") > 0).groupBy("suite", "test_no")
         .agg(F.min(st).alias("start_ordinal"), F.min_by("ts", st).alias("__start_ts"),
              F.min(te).alias("end_ordinal"), F.min_by("ts", te).alias("__end_ts"),
              F.min_by("kind", te).alias("__term"), F.min_by("message", te).alias("message"),
              F.count_if(is_term).alias("__n_term")))
    status = F.lit(None).cast("string")
    for k, v in STATUS.items():
        status = F.when(F.col("__term") == k, v).otherwise(status)
    dur = _ms_between("__start_ts", "__end_ts")
    timed = F.col("__term").isin("TestSucceeded", "TestFailed")
    return g.select("suite", "test_no", "start_ordinal", "end_ordinal", status.alias("status"),
                    F.when(timed, dur).when(F.col("__term").isNotNull(), F.lit(0)).alias("duration_ms"),
                    F.col("end_ordinal").isNotNull().alias("finished"),
                    F.greatest(F.col("__n_term") - 1, F.lit(0)).alias("extra_terminals"), "message")


def _ignored(num: DataFrame, pairs: DataFrame) -> DataFrame:
    """TestIgnored events with their placement: standalone (between tests) or inside a test."""
    ig = num.where(F.col("kind") == IGNORED).select("suite", "test_no", "ordinal")
    j = ig.join(pairs.select("suite", "test_no", "end_ordinal"), ["suite", "test_no"], "left")
    standalone = (F.col("test_no") == 0) | (F.col("end_ordinal").isNotNull()
                                            & (F.col("ordinal") > F.col("end_ordinal")))
    return j.select("suite", "ordinal", standalone.alias("standalone"))


def test_status(num: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row per test case: started tests and standalone ignored tests."""
    pairs = pairs if pairs is not None else test_pairs(num)
    started = pairs.select("suite", F.col("start_ordinal").alias("ordinal"),
                           F.coalesce("status", F.lit("unfinished")).alias("status"))
    ign = (_ignored(num, pairs).where("standalone")
           .select("suite", "ordinal", F.lit("ignored").alias("status")))
    return (started.unionByName(ign)
            .withColumn("skipped", F.col("status").isin(*SKIPPED)))


def test_infos(num: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Info messages inside each test (after its start, before its terminal), as rows."""
    pairs = pairs if pairs is not None else test_pairs(num)
    info = num.where((F.col("kind") == INFO) & (F.col("test_no") > 0))
    j = info.join(pairs.select("suite", "test_no", "end_ordinal"), ["suite", "test_no"])
    return (j.where(F.col("end_ordinal").isNull() | (F.col("ordinal") < F.col("end_ordinal")))
            .select("suite", "test_no", "ordinal", "message"))


def suite_rollup(events: DataFrame, num: DataFrame | None = None) -> DataFrame:
    """Per suite: tests, failures, errors (aborted), skipped, time, unexpected events. ``num``: ``numbered(events)``."""
    num = num if num is not None else numbered(events)
    pairs = test_pairs(num)
    status = test_status(num, pairs)
    per_status = status.groupBy("suite").agg(
        F.count(F.lit(1)).alias("tests"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.count_if(F.col("skipped")).alias("skipped"))
    extra = pairs.groupBy("suite").agg(F.sum("extra_terminals").alias("__x"))
    inside = (_ignored(num, pairs).where(~F.col("standalone"))
              .groupBy("suite").agg(F.count(F.lit(1)).alias("__y")))
    bounds = suite_bounds(events, num).groupBy("suite").agg(
        F.count_if("aborted").alias("errors"), F.sum("time_ms").alias("time_ms"))
    suites = events.where(F.col("suite").isNotNull()).select("suite").distinct()
    r = (suites.join(per_status, "suite", "left").join(bounds, "suite", "left")
         .join(extra, "suite", "left").join(inside, "suite", "left"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return r.select("suite", z("tests").alias("tests"), z("failures").alias("failures"),
                    z("errors").alias("errors"), z("skipped").alias("skipped"), "time_ms",
                    (z("__x") + z("__y")).alias("unexpected"))
