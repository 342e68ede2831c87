from datetime import datetime, timedelta

from tessera.operators import testevents as te


def _events(spark, kinds):
    t0 = datetime(2020, 1, 1)
    rows = [(1, i, t0 + timedelta(seconds=i), k, f"m{i}") for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "suite long, ordinal long, ts timestamp_ntz, kind string, message string")


def test_pairs_status_infos_rollup(spark):
    ev = _events(spark, ["SuiteStarting", "TestIgnored", "TestStarting", "InfoProvided", "TestSucceeded",
                         "TestStarting", "TestFailed", "TestIgnored", "TestStarting", "InfoProvided",
                         "TestIgnored", "TestSucceeded", "TestSucceeded", "SuiteAborted"])
    num = te.numbered(ev)
    pairs = {r.test_no: (r.status, r.duration_ms, r.extra_terminals) for r in te.test_pairs(num).collect()}
    assert pairs == {1: ("succeeded", 2000, 0), 2: ("failed", 1000, 0), 3: ("succeeded", 3000, 1)}
    status = sorted((r.ordinal, r.status, r.skipped) for r in te.test_status(num).collect())
    assert status == [(1, "ignored", True), (2, "succeeded", False), (5, "failed", False),
                      (7, "ignored", True), (8, "succeeded", False)]
    assert [r.ordinal for r in te.test_infos(num).orderBy("ordinal").collect()] == [3, 9]
    roll = te.suite_rollup(ev).first()
    assert (roll.tests, roll.failures, roll.errors, roll.skipped, roll.time_ms, roll.unexpected) == \
        (5, 1, 1, 2, 13000, 2)
