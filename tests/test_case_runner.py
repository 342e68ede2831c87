"""End-to-end golden case, shaped like the reference's sample suite:
comment lines, a statement, and a one-line target."""

from tessera.operators import scripts as sc
from tessera.plans.case_runner import Step, poll_case, run_cases

EXAMPLE = [
    "-- before: create table if not exists test1(a int, b int);",
    "-- before: truncate table test1;",
    "-- after: drop table test1;",
    "select count(*) from test1;",
]


def _steps(spark, lines, case="example"):
    df = spark.createDataFrame([(1, i + 1, l) for i, l in enumerate(lines)], "file long, n long, line string")
    st = sc.statements(df).orderBy("n").collect()
    return st, [Step(case, r.sql, r.comment) for r in st if r.sql]


def test_example_script_shape(spark):
    st, steps = _steps(spark, EXAMPLE)
    # 'before:'/'after:' are plain comments (not directives): three comment steps and one statement
    assert [(r.sql, r.comment) for r in st] == [
        ("", "before: create table if not exists test1(a int, b int);"),
        ("", "before: truncate table test1;"),
        ("", "after: drop table test1;"),
        ("select count(*) from test1;", None)]
    keys = [r.key for r in sc.directives(sc.statements(
        spark.createDataFrame([(1, i + 1, l) for i, l in enumerate(EXAMPLE)], "file long, n long, line string")))
        .orderBy("n").collect()]
    assert keys == ["before", "before", "after"]


T = "case string, target_idx int, row_idx long, pattern string"


def test_run_cases_verifies_targets_and_errors(spark):
    spark.createDataFrame([], "a int, b int").createOrReplaceTempView("test1")
    _, steps = _steps(spark, ["select count(*) from test1; -- target",
                              "select count(*) + 1 from test1; -- target",
                              "select * from no_such_table_xyz; -- error"])
    targets = spark.createDataFrame([("example", 0, 0, "0"), ("example", 1, 0, "0"),
                                     ("example", 2, 0, "TABLE_OR_VIEW_NOT_FOUND")], T)
    got = sorted((r.target_idx, r.verdict) for r in run_cases(spark, steps, targets).collect())
    assert got == [(0, "Pass"), (1, "LinesNotMatch"), (2, "Pass")]
    assert spark.conf.get("spark.sql.variable.substitute") == "true"   # restored after the run


def test_modes_empty_results_and_empty_targets(spark):
    two = "select * from values (1), (2) as t(a) order by a"
    steps = [Step("c", sql, d) for sql, d in (
        ("select 1 where 1 = 0", "target"),      # nothing, though a line is expected
        ("select 1 where 1 = 0", "target"),      # nothing expected
        (two, "target"), (two, "target"), (two, "target"), (two, "target"), (two, "target"),
        ("select nope", "target"), ("select 1", "error"), ("select * from no_such_table_xyz", "error"))]
    rows = [(0, "1"), (2, "# rows 2"), (3, "# rows 3"), (4, "# include"), (4, "2"), (5, "# exclude"), (5, "2"),
            (6, "# data-received topic_a t"), (9, r".*TABLE_OR_VIEW_NOT_FOUND.*")]
    seen = {}
    data = []
    for t, p in rows:
        data.append(("c", t, seen.get(t, 0), p))
        seen[t] = seen.get(t, 0) + 1
    lags = spark.createDataFrame([("topic_a", "Pass")], "topic string, verdict string")
    got = {r.target_idx: (r.verdict, r.message) for r in
           run_cases(spark, steps, spark.createDataFrame(data, T), lags=lags).collect()}
    assert [got[i][0] for i in range(10)] == [
        "LineCountDiff", "Pass", "Pass", "LineCountDiff", "Pass", "LinesExclude", "Pass", "Error", "UnexpectedSuccess",
        "Pass"]
    assert got[0][1] == "0 lines, expected 1" and got[3][1] == "2 lines, expected 3"


def test_poll_case_keeps_passed_targets(spark):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("poll_a")
    steps = [Step("p", "select count(*) from poll_a", "target"), Step("p", "select max(a) from poll_a", "target")]
    targets = spark.createDataFrame([("p", 0, 0, "1"), ("p", 1, 0, "5")], T)
    ok, passed, message = poll_case(spark, steps, targets, limit_s=1, interval_s=0.5)
    assert (ok, passed) == (False, 1) and message.startswith("target 1: LinesNotMatch")
    spark.createDataFrame([(5,)], "a int").createOrReplaceTempView("poll_a")
    assert poll_case(spark, steps, targets, limit_s=20, interval_s=0.5) == (True, 2, None)
