"""Registered queries: streaming forms and the SQL case runner (§2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.generate import gen_table
from tessera.plans import bindings as b
from tessera.plans.case_runner import Step, run_cases
from tessera.plans.oracle_views import with_views
from tessera.plans.q_generate import _EXCEPT as EXCEPT_SQL
from tessera.plans.q_generate import SAMPLE_SQL, SEED, rules_spec, sample_test
from tessera.plans.q_verify import EXACT_SQL
from tessera.plans.registry import register
from tessera.session import read_table, scratch_path
from tessera.streaming import jobs as sj
from tessera.streaming import verify as sv


@register("stream_generate", SAMPLE_SQL)
def q_stream_generate(spark, sf):
    orders = sj.table_stream(spark, sf, "orders")
    return sj.drain(gen_table(spark, sample_test(), seed=SEED, ids=orders, id_col="o_orderkey"), "gen", spark)


@register("stream_generate_rules", EXCEPT_SQL)
def q_stream_generate_rules(spark, sf):
    """A spec with exceptions and with a ramp that include hits hold back: their count is the stream's state."""
    orders = sj.table_stream(spark, sf, "orders")
    got = sj.drain(gen_table(spark, rules_spec(), seed=SEED, ids=orders, id_col="o_orderkey"), "gen-rules", spark)
    return got.select("id", "a", "b", "c", "d", "ts")


def _runs(jobs):
    """Two runs that both count their jobs from 0, with times after the initial (epoch) watermark."""
    o = F.lit(sj.ORIGIN_MS)
    return jobs.select(F.concat(F.lit("r"), (F.col("job_id") % 2).cast("string")).alias("run"),
                       F.expr("job_id div 2").alias("job_id"),
                       F.timestamp_millis(F.col("submit_ms") + o).alias("start_ts"),
                       F.timestamp_millis(F.col("finish_ms") + o).alias("end_ts"))


@register("stream_job_pairs", with_views("""
SELECT concat('r', CAST(job_id % 2 AS VARCHAR)) AS run, job_id // 2 AS job_id, submit_ms,
       CASE WHEN finish_ms - submit_ms BETWEEN 0 AND 120000 THEN finish_ms END AS finish_ms,
       CASE WHEN finish_ms - submit_ms BETWEEN 0 AND 120000 THEN finish_ms - submit_ms END AS elapsed_ms FROM jobs""", "jobs"))
def q_stream_job_pairs(spark, sf):
    """Jobs that take longer than the bound, and unfinished ones, stay without an end."""
    orders = sj.table_stream(spark, sf, "orders")
    j = _runs(b.jobs(spark, sf, orders))
    p = sj.replay_pairs(j.drop("end_ts"), j.where(F.col("end_ts").isNotNull()).drop("start_ts"), "2 minutes", spark)
    o = F.lit(sj.ORIGIN_MS)
    return p.select("run", "job_id", (F.unix_millis("start_ts") - o).alias("submit_ms"),
                    (F.unix_millis("end_ts") - o).alias("finish_ms"),
                    (F.unix_millis("end_ts") - F.unix_millis("start_ts")).alias("elapsed_ms"))


@register("stream_eventually", """
WITH s AS (SELECT user_id AS case_id, event_id * 37 % 60000 // 500 * 500 AS poll_ms,
                  CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 END AS k FROM events),
 t0 AS (SELECT case_id, min(poll_ms) AS t FROM s WHERE k = 0 AND poll_ms <= 30000 GROUP BY case_id),
 t1 AS (SELECT s.case_id, min(poll_ms) AS t FROM s JOIN t0 ON s.case_id = t0.case_id
        WHERE k = 1 AND poll_ms >= t0.t AND poll_ms <= 30000 GROUP BY s.case_id),
 t2 AS (SELECT s.case_id, min(poll_ms) AS t FROM s JOIN t1 ON s.case_id = t1.case_id
        WHERE k = 2 AND poll_ms >= t1.t AND poll_ms <= 30000 GROUP BY s.case_id)
SELECT c.case_id, CASE WHEN t2.t IS NOT NULL THEN 3 WHEN t1.t IS NOT NULL THEN 2 WHEN t0.t IS NOT NULL THEN 1 ELSE 0 END AS reached,
       t2.t IS NOT NULL AS passed, t2.t AS pass_ms
FROM (SELECT DISTINCT case_id FROM s) c LEFT JOIN t0 ON c.case_id = t0.case_id
LEFT JOIN t1 ON c.case_id = t1.case_id LEFT JOIN t2 ON c.case_id = t2.case_id""")
def q_stream_eventually(spark, sf):
    """Polls twice a second that may pass several targets, some past the limit."""
    e = sj.table_stream(spark, sf, "events")
    target = (F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "purchase", 1)
               .when(F.col("event_type") == "view", 2))
    s = e.select(F.col("user_id").alias("case_id"), F.expr("(event_id * 37 % 60000) div 500 * 500").alias("poll_ms"),
                 target.alias("passing_target"))
    return sj.latest(sj.drain(sj.eventually(s, n_targets=3, limit_ms=30000), "eventually", spark))


@register("stream_verify", EXACT_SQL)
def q_stream_verify(spark, sf):
    """Numbered result lines arrive over several batches; verdicts come with each, the last ones are returned."""
    lines, golden = scratch_path(spark, "lines"), scratch_path(spark, "golden")
    b.result_lines(spark, sf).select("case_id", "row_idx", "line").repartition(6).write.parquet(lines)
    own = sj.streaming_session(spark)
    b.target_lines(spark, sf).write.parquet(golden)
    stream = (own.readStream.schema("case_id long, row_idx long, line string").option("maxFilesPerTrigger", 2)
              .parquet(lines))
    rows = sj.drain(sv.verdict_stream(stream, own.read.parquet(golden)), "verdicts", spark)
    return sv.last_verdicts(rows, spark.read.parquet(golden))


@register("sql_case", """
WITH n AS (SELECT n_nationkey AS k, 'n' || CAST(n_nationkey AS VARCHAR) AS "case",
                  (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal < 0) AS poor
           FROM nation n)
SELECT "case", 0 AS target_idx, CASE WHEN poor = 0 THEN 'Pass' ELSE 'LinesNotMatch' END AS verdict FROM n
UNION ALL SELECT "case", 1, CASE WHEN poor = 0 THEN 'Pass' ELSE 'LineCountDiff' END FROM n
UNION ALL SELECT "case", 2, CASE WHEN poor = 0 THEN 'Pass' ELSE 'LineCountDiff' END FROM n
UNION ALL SELECT "case", 3, CASE WHEN poor > 0 THEN 'Pass' ELSE 'LinesInclude' END FROM n
UNION ALL SELECT "case", 4, 'Pass' FROM n
UNION ALL SELECT "case", 5, 'LineCountDiff' FROM n""")
def q_sql_case(spark, sf):
    """Cases of all nations: a count, an empty target, row counts, inclusion, an expected error, a missing row."""
    read_table(spark, sf, "customer").createOrReplaceTempView("customer")
    steps, tgt = [], []
    for k in range(25):  # the statements are the program: one case a nation
        case, poor = f"n{k}", f"from customer where c_nationkey = {k} and c_acctbal < 0"
        for i, (sql, kind, lines) in enumerate([
                (f"select count(*) {poor}", "target", ["0"]), (f"select c_custkey {poor}", "target", []),
                (f"select c_custkey {poor}", "target", ["# rows 0"]),
                (f"select 'x', c_custkey {poor}", "target", ["# include", "x [0-9]++"]),
                (f"select * from missing_table_{k}", "error", ["TABLE_OR_VIEW_NOT_FOUND"]),
                ("select 1 where 1 = 0", "target", ["1"])]):
            steps.append(Step(case, sql, kind))
            tgt += [(case, i, j, x) for j, x in enumerate(lines)]
    targets = spark.createDataFrame(tgt, "case string, target_idx int, row_idx long, pattern string")
    return run_cases(spark, steps, targets).drop("message")
