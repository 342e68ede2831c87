"""Registered queries: test-event roll-up."""

from __future__ import annotations

from tessera.operators import testevents as te
from tessera.plans import bindings as b
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register
from tessera.session import share

_TERMS = "('TestSucceeded', 'TestFailed', 'TestPending', 'TestCanceled')"
NUM = """SELECT *, CAST(sum(CASE WHEN kind = 'TestStarting' THEN 1 ELSE 0 END) OVER (
           PARTITION BY suite ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS test_no
FROM test_events"""
PAIRS = f"""
SELECT suite, test_no, start_ordinal, end_ordinal,
       CASE term WHEN 'TestSucceeded' THEN 'succeeded' WHEN 'TestFailed' THEN 'failed'
                 WHEN 'TestPending' THEN 'pending' WHEN 'TestCanceled' THEN 'canceled' END AS status,
       CASE WHEN term IN ('TestSucceeded', 'TestFailed') THEN (epoch_us(end_ts) - epoch_us(start_ts)) // 1000
            WHEN term IS NOT NULL THEN 0 END AS duration_ms,
       end_ordinal IS NOT NULL AS finished, greatest(n_term - 1, 0) AS extra_terminals, message
FROM (SELECT suite, test_no,
             min(ordinal) FILTER (WHERE kind = 'TestStarting') AS start_ordinal,
             arg_min(ts, ordinal) FILTER (WHERE kind = 'TestStarting') AS start_ts,
             min(ordinal) FILTER (WHERE kind IN {_TERMS}) AS end_ordinal,
             arg_min(ts, ordinal) FILTER (WHERE kind IN {_TERMS}) AS end_ts,
             arg_min(kind, ordinal) FILTER (WHERE kind IN {_TERMS}) AS term,
             min_by(coalesce(message, ''), ordinal) FILTER (WHERE kind IN {_TERMS}) AS message,
             count(*) FILTER (WHERE kind IN {_TERMS}) AS n_term
      FROM num WHERE test_no > 0 GROUP BY suite, test_no) g"""
IGN = """
SELECT i.suite, i.ordinal, (i.test_no = 0 OR (p.end_ordinal IS NOT NULL AND i.ordinal > p.end_ordinal)) AS standalone
FROM (SELECT * FROM num WHERE kind = 'TestIgnored') i
LEFT JOIN pairs p ON i.suite = p.suite AND i.test_no = p.test_no"""
STATUS = """
SELECT suite, start_ordinal AS ordinal, coalesce(status, 'unfinished') AS status FROM pairs
UNION ALL SELECT suite, ordinal, 'ignored' FROM ign WHERE standalone"""
BOUNDS = """
SELECT suite, start_ordinal, end_ordinal, aborted, time_ms FROM (
  SELECT suite, ordinal AS end_ordinal, kind = 'SuiteAborted' AS aborted,
         s.ordinal_start AS start_ordinal, (epoch_us(ts) - epoch_us(s.ts_start)) // 1000 AS time_ms, kind
  FROM (SELECT *, last_value(CASE WHEN kind = 'SuiteStarting' THEN {'ordinal_start': ordinal, 'ts_start': ts} END
                              IGNORE NULLS) OVER (PARTITION BY suite ORDER BY ordinal
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
        FROM test_events) x
  WHERE kind IN ('SuiteCompleted', 'SuiteAborted')) y"""
CTES = {"num": NUM, "pairs": PAIRS, "ign": IGN, "status": STATUS, "bounds": BOUNDS}


@register("suite_events", with_views(
    "SELECT suite, ordinal, kind, row_number() OVER (PARTITION BY suite ORDER BY ordinal) - 1 AS seq "
    "FROM test_events WHERE suite IS NOT NULL", "test_events"))
def q_suite_events(spark, sf):
    return te.suite_events(b.test_events(spark, sf))


@register("suite_bounds", with_views("SELECT * FROM bounds", "test_events", extra=CTES))
def q_suite_bounds(spark, sf):
    return te.suite_bounds(b.test_events(spark, sf))


@register("test_pairs", with_views("SELECT * FROM pairs", "test_events", extra=CTES))
def q_test_pairs(spark, sf):
    return te.test_pairs(share(te.numbered(b.test_events(spark, sf))))


@register("test_status", with_views(
    "SELECT *, status IN ('ignored', 'pending', 'canceled') AS skipped FROM status", "test_events", extra=CTES))
def q_test_status(spark, sf):
    return te.test_status(share(te.numbered(b.test_events(spark, sf))))


@register("test_infos", with_views("""
SELECT n.suite, n.test_no, n.ordinal, n.message FROM num n JOIN pairs p ON n.suite = p.suite AND n.test_no = p.test_no
WHERE n.kind = 'InfoProvided' AND n.test_no > 0 AND (p.end_ordinal IS NULL OR n.ordinal < p.end_ordinal)""",
    "test_events", extra=CTES))
def q_test_infos(spark, sf):
    return te.test_infos(share(te.numbered(b.test_events(spark, sf))))


@register("suite_rollup", with_views("""
SELECT s.suite, coalesce(st.tests, 0) AS tests, coalesce(st.failures, 0) AS failures,
       coalesce(bd.errors, 0) AS errors, coalesce(st.skipped, 0) AS skipped, bd.time_ms,
       coalesce(x.x, 0) + coalesce(y.y, 0) AS unexpected
FROM (SELECT DISTINCT suite FROM test_events WHERE suite IS NOT NULL) s
LEFT JOIN (SELECT suite, count(*) AS tests, count(*) FILTER (WHERE status = 'failed') AS failures,
                  count(*) FILTER (WHERE status IN ('ignored', 'pending', 'canceled')) AS skipped
           FROM status GROUP BY suite) st ON s.suite = st.suite
LEFT JOIN (SELECT suite, count(*) FILTER (WHERE aborted) AS errors, CAST(sum(time_ms) AS BIGINT) AS time_ms
           FROM bounds GROUP BY suite) bd ON s.suite = bd.suite
LEFT JOIN (SELECT suite, CAST(sum(extra_terminals) AS BIGINT) AS x FROM pairs GROUP BY suite) x ON s.suite = x.suite
LEFT JOIN (SELECT suite, count(*) AS y FROM ign WHERE NOT standalone GROUP BY suite) y ON s.suite = y.suite""",
    "test_events", extra=CTES))
def q_suite_rollup(spark, sf):
    ev = b.test_events(spark, sf)
    return te.suite_rollup(ev, share(te.numbered(ev)))  # one pass, used by five aggregates
