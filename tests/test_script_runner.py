"""Scripts to verdicts: sessions of their own, settings, limits, variables, streams, failed scripts."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.plans.case_runner import CaseSession, Step, run_cases
from tessera.plans.script_runner import run_scripts, script_steps
from tessera.session import scratch_path
from tessera.sources.streams import to_stream

T = "case string, target_idx int, row_idx long, pattern string"
L = "file string, n long, line string"


def lines(spark, files):
    return spark.createDataFrame([(f, i, x) for f, ls in files.items() for i, x in enumerate(ls)], L)


@pytest.fixture(scope="module")
def database(spark):
    name = "tessera_script_test"
    spark.sql(f"drop database if exists {name} cascade")
    spark.sql(f"create database {name} location '{scratch_path(spark, 'db')}'")
    yield name
    spark.sql(f"drop database {name} cascade")


def test_cases_share_no_view_setting_or_database(spark):
    """Eight cases at a time that define the same view, setting and current database."""
    steps, tgt = [], []
    before = spark.catalog.currentDatabase()
    for k in range(8):
        c = f"c{k}"
        for sql, kind in ((f"create or replace temporary view same as select {k} as x", None), (f"set same.key={k}", None),
                          (f"create database if not exists db_same_{k % 2}", None), (f"use db_same_{k % 2}", None),
                          ("select count(*) from range(1000)", None), ("select x from same", "target"),
                          ("set same.key", "target"), ("select current_database()", "target")):
            steps.append(Step(c, sql, kind))
        tgt += [(c, 0, 0, str(k)), (c, 1, 0, f"same.key {k}"), (c, 2, 0, f"db_same_{k % 2}")]
    got = run_cases(spark, steps, spark.createDataFrame(tgt, T), threads=4).collect()
    assert len(got) == 24 and {r.verdict for r in got} == {"Pass"}
    assert spark.catalog.currentDatabase() == before and spark.conf.get("same.key", "none") == "none"
    assert not spark.catalog.tableExists("same")
    for k in (0, 1):
        spark.sql(f"drop database db_same_{k}")


def test_steps_of_a_script(spark):
    st = script_steps(lines(spark, {"a": ["-- time:7", "select 1; select 2; -- target", "begin", "x;", "end;", "-- note"]}),
                      settings=spark.createDataFrame([("suite", 0, "set a=1"), ("suite", 1, "set b=2")],
                                                     "suite string, pos int, sql string"))
    got = [(r.file, r.step, r.piece_idx, r.sql, r.is_last, r.limit_s)
           for r in st.orderBy(F.col("file").asc_nulls_first(), "step", "piece_idx").collect()]
    assert got == [(None, -2, None, "set a=1", True, None), (None, -1, None, "set b=2", True, None),
                   ("a", 0, 0, "", True, 7), ("a", 1, 0, "select 1", False, 7), ("a", 1, 1, " select 2", True, 7),
                   ("a", 4, 0, "begin\nx;\nend;", True, 7), ("a", 5, 0, "", True, 7)]


def test_scripts_to_verdicts(spark, database, tmp_path):
    files = {
        "one": ["-- the first", "create table ${prefix}t(a int, b string);", "insert into ${prefix}t",
                "  values (1, 'x'), (2, 'y');", "create temporary view v as select a from ${prefix}t; -- note",
                "select a", "from v order by a; -- target", "set my.key; -- target", "select * from nowhere; -- error"],
        "two": ["use application other;", "create temporary view v as select '${app}' as a;", "select a from v; -- target",
                "select 1; select 2; -- target", "select '${none}'; -- target"],
        "three": ["select 1; -- target", "select 5; -- target"],
        "slow": ["-- time:1", "select count(*) from range(1000000000000) where hash(id) % 7 = 9; -- target"],
    }
    golden = {
        "one": ["### target start", "1", "2", "### target end", "### target start", "my.key 1", "### target end",
                "### target start", "TABLE_OR_VIEW_NOT_FOUND", "### target end"],
        "two": ["### start", "other", "### end", "### start", "2", "### end", "### start", "${none}", "### end"],
        "three": ["### start", "1", "### end", "### start", "6", "### end"],
        "slow": ["0"],
    }
    settings = spark.createDataFrame([("suite", 0, "set my.key=1")], "suite string, pos int, sql string")
    path = str(tmp_path / "failed")
    got = {(r.case, r.target_idx): r.verdict for r in run_scripts(
        spark, lines(spark, files), lines(spark, golden), settings=settings, database=database, failed_to=path).collect()}
    assert got == {("one", 0): "Pass", ("one", 1): "Pass", ("one", 2): "Pass", ("two", 0): "Pass", ("two", 1): "Pass",
                   ("two", 2): "Pass", ("three", 0): "Pass", ("three", 1): "LinesNotMatch", ("slow", 0): "Error"}
    assert sorted(d for d in os.listdir(path) if d.startswith("file=")) == ["file=slow", "file=three"]
    assert [r.value for r in spark.read.text(f"{path}/file=three").collect()] == ["set my.key=1;", "select 1;", "select 5;"]


def test_variables_by_file(spark, database):
    table = F.create_map(F.lit("me"), F.upper("file"))
    got = run_scripts(spark, lines(spark, {f: ["select '${me}'; -- target"] for f in "ab"}),
                      lines(spark, {f: ["${me}"] for f in "ab"}), variables=table, database=database)
    assert {r.verdict for r in got.collect()} == {"Pass"}


def topic_folder(spark, path, n=20):
    df = spark.range(n).select("id", F.concat("id", F.lit(",v"), F.col("id") % 3, F.lit(",0.5")).alias("value"))
    return to_stream(df, "top", path)


def test_stream_directives(spark, database, tmp_path):
    topics = topic_folder(spark, str(tmp_path / "topics"))
    files = {"s": [
        "create stream s(a bigint, b string, c decimal(4,1)) row format delimited fields terminated by ','",
        "  tblproperties(\"topic\"=\"top\");",
        "create stream odd as select a, b from s where a % 2 = 1;",
        "create table ${prefix}t(a bigint, b string);", "create table ${prefix}u(n bigint, c double);",
        "insert into ${prefix}t select 100, 'batch';",
        "insert into ${prefix}t select a, b from odd; -- stream",
        "insert into ${prefix}u select a, c from s; -- stream",
        "select count(*), sum(a), count(distinct b) from ${prefix}t; -- target",
        "select '${stream1}', '${stream2}'; -- target", "select count(*), sum(c) from ${prefix}u; -- target",
        "stop streamjob ${stream1};", "select 1; -- target", "insert into ${prefix}u select x from s; -- stream"]}
    golden = {"s": ["### start", "11 200 4", "### end", "### start", "suite_s_stream1 suite_s_stream2", "### end",
                    "### start", "20 10.0", "### end", "### start", "# data-received top s", "### end"]}
    got = {r.target_idx: (r.verdict, r.message) for r in run_scripts(
        spark, lines(spark, files), lines(spark, golden), topics=topics, database=database).collect()}
    assert got == {i: ("Pass", None) for i in range(4)}


def test_streams_go_on_and_read_nothing_twice(spark, database, tmp_path):
    path = str(tmp_path / "topics")
    topics = topic_folder(spark, path, 10)
    own = CaseSession(spark, "live", {"prefix": "live_"}, topics)
    own.spark.sql(f"use {database}")
    own.issue("create table live_t(a bigint)", 30)
    own.issue('create stream s(a bigint) tblproperties("topic"="top")', 30)
    own.issue("insert into live_t select a from s", 30, starts_stream=True)
    count = lambda: own.spark.table("live_t").count()
    assert count() == 10 and own.streams["live_stream1"].read == 10
    own.drain()
    assert count() == 10
    to_stream(spark.range(5).withColumn("value", F.lit("7")), "top", path)
    to_stream(spark.range(5).withColumn("value", F.lit("8")), "other", path)
    own.drain()
    assert count() == 15 and own.streams["live_stream1"].read == 15
    own.issue("stop streamjob all;", 30)
    to_stream(spark.range(5).withColumn("value", F.lit("9")), "top", path)
    own.drain()
    assert count() == 15 and [s.stream_id for s in own.ended] == ["live_stream1"]


def test_lag_of_a_stopped_stream(spark, database, tmp_path):
    path = str(tmp_path / "topics")
    topics = topic_folder(spark, path, 10)
    to_stream(spark.range(4).withColumn("value", F.lit("7")), "unread", path)
    files = {"late": ["create stream s(a bigint) tblproperties('topic'='top');",
                      "create stream o(a bigint) tblproperties('topic'='unread');", "create table ${prefix}t(a bigint);",
                      "insert into ${prefix}t select a from s; -- stream", "select 1; -- target", "select 1; -- target"]}
    golden = {"late": ["### start", "# data-received top s", "### end", "### start", "# data-received unread o", "### end"]}
    got = run_scripts(spark, lines(spark, files), lines(spark, golden), topics=topics, database=database)
    assert {r.target_idx: r.verdict for r in got.collect()} == {0: "Pass", 1: "DataNotReceived"}


def test_wrong_streams_are_errors(spark, database, tmp_path):
    topics = topic_folder(spark, str(tmp_path / "topics"), 3)
    files = {"w": ["create stream s(a int); -- error", "create table ${prefix}t(a int);",
                   "create stream s(a int, b int) tblproperties('topic'='top');",
                   "insert into ${prefix}t select * from s; -- stream error"]}
    golden = {"w": ["### start", "stream s has no topic", "### end", "### start", ".* has 1 columns, 2 are given", "### end"]}
    got = run_scripts(spark, lines(spark, files), lines(spark, golden), topics=topics, database=database)
    assert [r.verdict for r in got.orderBy("target_idx").collect()][0] == "Pass"


def test_a_kept_group_goes_on_and_a_reset_one_starts_anew(spark, database, tmp_path):
    path, groups = str(tmp_path / "topics"), str(tmp_path / "groups")
    topics = topic_folder(spark, path, 10)

    def run(keeps, k):
        own = CaseSession(spark, "g", {"prefix": "g_", "app": "app", "database": "db"}, topics, groups)
        own.spark.sql(f"use {database}")
        own.issue("create table if not exists g_t(a bigint)", 30)
        own.issue("truncate table g_t", 30)
        own.issue('create stream s(a bigint) tblproperties("topic"="top")', 30, keeps_position=keeps)
        own.issue("insert into g_t select a from s", 30, starts_stream=True)
        return own.spark.table("g_t").count()

    assert run(True, 0) == 10
    to_stream(spark.range(5).withColumn("value", F.lit("7")), "top", path)
    assert run(True, 1) == 5 and run(True, 2) == 0  # goes on
    assert run(False, 3) == 15                      # from the smallest offset
    to_stream(spark.range(2).withColumn("value", F.lit("8")), "top", path)
    assert run(True, 4) == 2                        # a reset of another run has not moved the group
