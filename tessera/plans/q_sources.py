"""Registered queries: path, golden-file, report and stream sources/sinks.

Inputs are derived from the driver's tables: a test tree with one case per
customer (suites per nation), run folders per job, golden files per result
case, JUnit reports per test-event suite, topics from generated lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import testevents as te
from tessera.operators.generate import gen_table
from tessera.plans import bindings as b
from tessera.plans.oracle_views import with_views
from tessera.plans.q_generate import SAMPLE_SQL, SEED, csv_line, sample_test
from tessera.plans.q_testevents import CTES
from tessera.plans.registry import register
from tessera.session import read_table, scratch_path, share
from tessera.sources import paths as ps
from tessera.sources.junit import read_junit, write_junit
from tessera.sources.streams import TOPIC_SCHEMA, replay_files, stream_to_topic
from tessera.sources.targets import read_targets
from tessera.streaming.jobs import table_stream


# ------------------------------------------------------------------ test tree
def tree_files(spark, sf):
    """Relative file paths of a test tree: r<region>/n<nation>/{sql,result}/c<cust>.*

    Nations with key % 5 = 0 have no result folder (not suites) but a suite
    one level deeper; nations with key % 7 = 3 hold a nested suite (hidden
    below a suite unless their parent is not a suite); even nations carry p.txt.
    """
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    base = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"),
                    F.col("n_nationkey").cast("string"))
    k = F.col("c_custkey").cast("string")
    plain = F.col("n_nationkey") % 5 != 0
    paths = F.array(
        F.concat(base, F.when(plain, F.lit("")).otherwise(F.lit("/deep")), F.lit("/sql/c"), k, F.lit(".sql")),
        F.concat(base, F.when(plain, F.lit("")).otherwise(F.lit("/deep")), F.lit("/result/c"), k, F.lit(".txt")),
        F.when(F.col("n_nationkey") % 7 == 3, F.concat(base, F.lit("/inner/sql/c"), k, F.lit(".sql"))),
        F.when(F.col("n_nationkey") % 7 == 3, F.concat(base, F.lit("/inner/result/c"), k, F.lit(".txt"))))
    files = j.select(F.explode(F.filter(paths, lambda x: x.isNotNull())).alias("path"))
    ptxt = n.where(F.col("n_nationkey") % 2 == 0).select(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"),
                 F.col("n_nationkey").cast("string"), F.lit("/p.txt")).alias("path"))
    return files.unionByName(ptxt)


_CUST = """SELECT c_custkey, n_nationkey, n_regionkey,
       'r' || CAST(n_regionkey AS VARCHAR) || '/n' || CAST(n_nationkey AS VARCHAR) AS base
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_SUITES = """
SELECT base AS suite_dir, n_nationkey % 2 = 0 AS parallel, count(*) AS n_cases FROM cust
WHERE n_nationkey % 5 <> 0 GROUP BY base, n_nationkey
UNION ALL SELECT base || '/deep', false, count(*) FROM cust WHERE n_nationkey % 5 = 0 GROUP BY base
UNION ALL SELECT base || '/inner', false, count(*) FROM cust
WHERE n_nationkey % 5 = 0 AND n_nationkey % 7 = 3 GROUP BY base"""


@register("suite_discovery", with_views(
    "SELECT suite_dir, replace(suite_dir, '/', '_') AS suite, parallel, n_cases FROM suites",
    extra={"cust": _CUST, "suites": _SUITES}))
def q_suite_discovery(spark, sf):
    return ps.find_suites(tree_files(spark, sf))


def include_lines(spark, sf):
    """Include list: folder r1 first, then single cases, then some suites again."""
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    base = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"),
                    F.col("n_nationkey").cast("string"))
    folder = n.where(F.col("n_regionkey") == 1).select(F.lit(1).cast("long").alias("line_no"),
                                                       F.lit("r1").alias("line")).distinct()
    cases = (c.where(F.col("c_custkey") % 50 == 0).join(n, c.c_nationkey == n.n_nationkey)
             .select((F.col("c_custkey") + 1000).cast("long").alias("line_no"),
                     F.concat(base, F.lit("/c"), F.col("c_custkey").cast("string")).alias("line")))
    suites = n.where(F.col("n_nationkey") % 6 == 1).select(
        (F.col("n_nationkey") + 1000000).cast("long").alias("line_no"), base.alias("line"))
    return folder.unionByName(cases).unionByName(suites)


@register("suite_include_filter", with_views("""
SELECT s.suite_dir, 'c' || CAST(c.c_custkey AS VARCHAR) AS "case"
FROM suites s JOIN cust c
  ON s.suite_dir = c.base OR s.suite_dir = c.base || '/deep' OR s.suite_dir = c.base || '/inner'
LEFT JOIN (SELECT suite_dir, max(line_no) AS reset FROM (
             SELECT suite_dir, 1 AS line_no FROM suites WHERE starts_with(suite_dir, 'r1/')
             UNION ALL SELECT base, n_nationkey + 1000000 FROM cust
             WHERE n_nationkey % 6 = 1 AND n_nationkey % 5 <> 0) r GROUP BY suite_dir) rs
  ON s.suite_dir = rs.suite_dir
LEFT JOIN (SELECT base AS suite_dir, c_custkey + 1000 AS line_no, c_custkey FROM cust
           WHERE c_custkey % 50 = 0) cl ON cl.suite_dir = s.suite_dir
WHERE (rs.reset IS NOT NULL OR cl.suite_dir IS NOT NULL)
  AND (CASE WHEN EXISTS (SELECT 1 FROM cust c2 WHERE c2.base = s.suite_dir AND c2.c_custkey % 50 = 0
                          AND c2.c_custkey + 1000 > coalesce(rs.reset, -1))
            THEN c.c_custkey % 50 = 0 AND c.c_custkey + 1000 > coalesce(rs.reset, -1)
            ELSE rs.reset IS NOT NULL END)
GROUP BY s.suite_dir, c.c_custkey""", extra={"cust": _CUST, "suites": _SUITES}))
def q_suite_include_filter(spark, sf):
    files = tree_files(spark, sf)
    cases = ps.suite_cases(files, ps.find_suites(files))
    return ps.filter_cases(cases, include_lines(spark, sf))


# ------------------------------------------------------------------ run folders
def _run_path():
    return F.concat(F.lit("/logs/run-"), F.col("o_orderstatus"), F.lit("-"),
                    F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("/EVENT_LOG_1"))


@register("run_stamp", """
SELECT o_orderkey, '/logs/run-' || o_orderstatus || '-' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '/EVENT_LOG_1' AS path,
       strftime(o_orderdate, '%Y%m%d%H%M%S') AS stamp
FROM orders""")
def q_run_stamp(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", _run_path().alias("path"))
    return o.select("o_orderkey", "path", ps.run_stamp(F.col("path")).alias("stamp"))


@register("latest_run", with_views("""
SELECT s.stream_id, max(d.path) AS latest_path
FROM (SELECT DISTINCT stream_id FROM jobs) s
JOIN (SELECT '/logs/' || stream_id || '-' || run || '-' || lpad(CAST(job_id AS VARCHAR), 9, '0') AS path,
             stream_id || '-' || run || '-' || lpad(CAST(job_id AS VARCHAR), 9, '0') AS name FROM jobs) d
  ON starts_with(d.name, s.stream_id)
GROUP BY s.stream_id""", "jobs"))
def q_latest_run(spark, sf):
    j = b.jobs(spark, sf)
    name = F.concat("stream_id", F.lit("-"), "run", F.lit("-"), F.lpad(F.col("job_id").cast("string"), 9, "0"))
    dirs = j.select(F.concat(F.lit("/logs/"), name).alias("path"))
    return ps.latest_run(dirs, j.select("stream_id"))


# ------------------------------------------------------------------ golden files
def golden_lines(spark, sf):
    """One golden file per result case: targets of 10 lines fenced by ### lines.

    Cases with id % 13 = 0 have no fences (whole file = one target); for id % 11 = 0 the last target is left
    unclosed; for id % 7 = 2 a target without lines comes first.
    """
    r = b.result_lines(spark, sf).select("case_id", "row_idx", "line")
    t, file = F.floor(F.col("row_idx") / 10), F.col("case_id").alias("file")
    content = r.select(file, (t * 100 + 1 + F.col("row_idx") % 10).alias("n"),
                       F.concat(F.col("line"), F.lit(" ${app}")).alias("line"))
    last = r.where(F.col("case_id") % 13 != 0).groupBy("case_id").agg(F.max(t).alias("last"))
    fence = lambda k, n, word: F.struct(n.cast("long").alias("n"), F.concat(
        F.lit("### target "), k.cast("string"), F.lit(f" {word}")).alias("line"))
    closed = lambda k: ~((F.col("case_id") % 11 == 0) & (k == F.col("last")))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda k: F.array(
        fence(k, k * 100, "start"), F.when(closed(k), fence(k, k * 100 + 99, "end")))))
    empty = F.when(F.col("case_id") % 7 == 2, F.array(fence(F.lit("none"), F.lit(-2), "start"),
                                                      fence(F.lit("none"), F.lit(-1), "end"))).otherwise(F.array())
    fences = last.select(file, F.explode(F.array_compact(F.concat(pairs, empty))).alias("f")).select("file", "f.n", "f.line")
    return content.unionByName(fences)


@register("target_scan", with_views("""
SELECT case_id AS file, target_idx, row_idx, concat(line, ' app_', CAST(case_id AS VARCHAR)) AS line FROM (
  SELECT case_id, 0 AS target_idx, row_idx, line FROM result_lines WHERE case_id % 13 = 0
  UNION ALL
  SELECT r.case_id, r.row_idx // 10 + m.shift, r.row_idx % 10, r.line FROM result_lines r JOIN m ON r.case_id = m.case_id
  WHERE r.case_id % 13 <> 0 AND NOT (r.case_id % 11 = 0 AND r.row_idx // 10 = m.last)
  UNION ALL
  SELECT r.case_id, 0, r.row_idx + 1, r.line FROM result_lines r JOIN m ON r.case_id = m.case_id
  WHERE r.case_id % 13 <> 0 AND r.case_id % 11 = 0 AND m.last = 0 AND m.shift = 0) x
UNION ALL
SELECT case_id, 0, 0, '### target 0 start' FROM m WHERE case_id % 13 <> 0 AND case_id % 11 = 0 AND last = 0 AND shift = 0
UNION ALL
SELECT case_id, unnest(range(CASE WHEN case_id % 13 = 0 OR (case_id % 11 = 0 AND last = 0 AND shift = 0) THEN 1
                                  ELSE last + 1 + shift - CASE WHEN case_id % 11 = 0 THEN 1 ELSE 0 END END)), -1, NULL FROM m
UNION ALL
SELECT 1000 + n_nationkey, 0, -1, NULL FROM nation""", "result_lines",
    extra={"m": "SELECT case_id, max(row_idx // 10) AS last, CASE WHEN case_id % 7 = 2 AND case_id % 13 <> 0 THEN 1 ELSE 0 END "
                "AS shift FROM result_lines GROUP BY case_id"}))
def q_target_scan(spark, sf):
    """Targets of all golden files, variables resolved; the nations' files are there but hold no line."""
    lines = golden_lines(spark, sf)
    app = F.concat(F.lit("app_"), F.col("file").cast("string"))
    files = (read_table(spark, sf, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("file"))
             .union(lines.select("file")))
    return read_targets(lines, F.create_map(F.lit("app"), app), files)


# ------------------------------------------------------------------ JUnit reports
_JUNIT_SQL = with_views("""
SELECT s.suite, coalesce(st.tests, 0) AS tests, coalesce(st.failures, 0) AS failures,
       coalesce(bd.errors, 0) AS errors, CAST(bd.time_ms AS BIGINT) AS time_ms, st.tests AS cases, st.failures AS failed_cases,
       st.skipped AS skipped_cases, st.last_name, st.last_failure, CAST(st.ms AS BIGINT) AS case_ms,
       coalesce(i.infos, 0) AS infos
FROM (SELECT DISTINCT suite FROM test_events WHERE suite IS NOT NULL) s
LEFT JOIN (SELECT x.suite, count(*) AS tests, count(*) FILTER (WHERE x.status = 'failed') AS failures,
                  count(*) FILTER (WHERE x.status IN ('ignored', 'pending', 'canceled')) AS skipped,
                  max('test' || CAST(x.ordinal AS VARCHAR)) AS last_name,
                  max(p.message) FILTER (WHERE x.status = 'failed') AS last_failure,
                  sum(coalesce(p.duration_ms, 0)) AS ms
           FROM status x LEFT JOIN pairs p ON x.suite = p.suite AND x.ordinal = p.start_ordinal GROUP BY x.suite) st
  ON s.suite = st.suite
LEFT JOIN (SELECT suite, count(*) FILTER (WHERE aborted) AS errors, sum(time_ms) AS time_ms FROM bounds GROUP BY suite) bd
  ON s.suite = bd.suite
LEFT JOIN (SELECT n.suite, count(*) AS infos FROM num n JOIN pairs p ON n.suite = p.suite AND n.test_no = p.test_no
           WHERE n.kind = 'InfoProvided' AND n.message IS NOT NULL AND (p.end_ordinal IS NULL OR n.ordinal < p.end_ordinal)
           GROUP BY n.suite) i
  ON s.suite = i.suite""", "test_events", extra=CTES)


@register("junit_sink", _JUNIT_SQL)
def q_junit_sink(spark, sf):
    """Reports of all suites, written and read again."""
    ev = b.test_events(spark, sf)
    num = share(te.numbered(ev))  # one pass over the events feeds suites, cases and infos
    pairs = te.test_pairs(num)
    start = num.where(F.col("kind") == te.SUITE_START).select("suite", F.col("ts").alias("timestamp"))
    text = F.col("suite").cast("string").alias("suite")
    suites = te.suite_rollup(ev, num).join(start, "suite", "left").select(
        text, "tests", "failures", "errors", F.coalesce("time_ms", F.lit(0)).alias("time_ms"), "timestamp")
    infos = (te.test_infos(num, pairs).where(F.col("message").isNotNull()).groupBy("suite", "test_no")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "message"))), lambda x: x["message"]).alias("infos")))
    own = pairs.join(infos, ["suite", "test_no"], "left").select(
        "suite", F.col("start_ordinal").alias("ordinal"), "duration_ms", "message", "infos")
    cases = (te.test_status(num, pairs).join(own, ["suite", "ordinal"], "left")
             .select(text, "ordinal", F.concat(F.lit("test"), F.col("ordinal").cast("string")).alias("name"),
                     F.coalesce("duration_ms", F.lit(0)).alias("time_ms"), "status", "message", "infos"))
    s, c = read_junit(spark, write_junit(suites, cases, scratch_path(spark, "junit")))
    per_case = c.groupBy(F.col("suite").cast("long").alias("suite")).agg(
        F.count(F.lit(1)).alias("cases"), F.count("failure").alias("failed_cases"),
        F.count("skipped").alias("skipped_cases"), F.max("_name").alias("last_name"),
        F.max("failure._message").alias("last_failure"), F.sum(F.round(F.col("_time") * 1000).cast("long")).alias("case_ms"),
        F.sum(F.coalesce(F.size(F.split("system-out", "\n")), F.lit(0)).cast("long")).alias("infos"))
    return (s.select(F.col("_name").cast("long").alias("suite"), F.col("_tests").alias("tests"),
                     F.col("_failures").alias("failures"), F.col("_errors").alias("errors"),
                     F.round(F.col("_time") * 1000).cast("long").alias("time_ms"))
            .join(per_case, "suite", "left").withColumn("infos", F.coalesce("infos", F.lit(0))))


# ------------------------------------------------------------------ topics
@register("stream_sink_partitioned", """
SELECT 'test' AS topic, CAST(o_orderkey % 4 AS INTEGER) AS "partition", count(*) AS n_lines,
       min(concat_ws(',', CAST(l1 AS VARCHAR), l3, strftime(l4, '%Y-%m-%d %H:%M:%S'))) AS first_line,
       max(concat_ws(',', CAST(l1 AS VARCHAR), l3, strftime(l4, '%Y-%m-%d %H:%M:%S'))) AS last_line
FROM orders JOIN (""" + SAMPLE_SQL + """) g ON g.id = o_orderkey GROUP BY o_orderkey % 4""")
def q_stream_sink_partitioned(spark, sf):
    df = gen_table(spark, sample_test(), seed=SEED, ids=table_stream(spark, sf, "orders"), id_col="o_orderkey")
    lines = df.select("id", csv_line(df, ["l1", "l3", "l4"]).alias("value"))
    path = scratch_path(spark, "topics")
    stream_to_topic(lines, "test", path, scratch_path(spark, "topics-ckpt")).awaitTermination()
    return (spark.read.schema(TOPIC_SCHEMA).parquet(path).groupBy("topic", "partition")
            .agg(F.count(F.lit(1)).alias("n_lines"), F.min("value").alias("first_line"),
                 F.max("value").alias("last_line")))


@register("files_to_stream", """
SELECT o_orderpriority AS topic, count(*) AS n_lines, min(concat_ws(',', CAST(o_orderkey AS VARCHAR), o_orderstatus)) AS first_line,
       max(concat_ws(',', CAST(o_orderkey AS VARCHAR), o_orderstatus)) AS last_line
FROM orders GROUP BY o_orderpriority""")
def q_files_to_stream(spark, sf):
    o = read_table(spark, sf, "orders")
    folder = scratch_path(spark, "replay-src")
    (o.select(F.col("o_orderpriority").alias("topic"),
              F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("value"))
     .write.mode("overwrite").partitionBy("topic").text(folder))
    # Spark's writers name the files themselves, so here a file's folder names its topic
    topic = F.url_decode(F.regexp_replace(F.element_at(F.split(F.col("path"), "/"), -2), r"^[^=]*=", ""))
    rep = replay_files(spark, folder)
    return rep.groupBy(topic.alias("topic")).agg(F.count(F.lit(1)).alias("n_lines"), F.min("value").alias("first_line"),
                                                 F.max("value").alias("last_line"))
