from tessera.sources import paths as ps

FILES = ["a/sql/c1.sql", "a/result/c1.txt", "a/p.txt", "a/inner/sql/x.sql", "a/inner/result/x.txt",
         "b/sql/c2.sql", "b/deep/sql/c3.sql", "b/deep/result/c3.txt", "b/deep/sql/c4.sql",
         "c/d/sql/c5.sql", "c/d/result/c5.txt"]


def test_find_suites_stops_below_a_suite(spark):
    files = spark.createDataFrame([(f,) for f in FILES], "path string")
    got = sorted((r.suite_dir, r.suite, r.parallel, r.n_cases) for r in ps.find_suites(files).collect())
    assert got == [("a", "a", True, 1), ("b/deep", "b_deep", False, 2), ("c/d", "c_d", False, 1)]


def test_include_list_resets_and_cases(spark):
    files = spark.createDataFrame([(f,) for f in FILES], "path string")
    cases = ps.suite_cases(files, ps.find_suites(files))
    inc = spark.createDataFrame([(1, "b/deep/c3"), (2, "a"), (3, "c"), (4, "c/d/c9")], "line_no long, line string")
    got = sorted((r.suite_dir, r.case) for r in ps.filter_cases(cases, inc).collect())
    assert got == [("a", "c1"), ("b/deep", "c3")]


def test_run_stamp_and_latest(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("/x/run-a-2020/EVENT",)], "p string")
    assert df.select(ps.run_stamp(F.col("p"))).first()[0] == "2020"
    dirs = spark.createDataFrame([("/l/s1-1",), ("/l/s1-3",), ("/l/s12-0",), ("/l/s2-9",)], "path string")
    ids = spark.createDataFrame([("s1",), ("s2",)], "stream_id string")
    got = dict((r.stream_id, r.latest_path) for r in ps.latest_run(dirs, ids).collect())
    assert got == {"s1": "/l/s12-0", "s2": "/l/s2-9"}   # startswith, as the reference does
