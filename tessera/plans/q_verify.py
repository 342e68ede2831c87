"""Registered queries: result verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import match_line, render_line
from tessera.operators import verify as vf
from tessera.plans import bindings as b
from tessera.plans.oracle_views import duck_match, with_views
from tessera.plans.registry import register
from tessera.session import read_table, share

_CELL3 = ("CASE WHEN o_orderpriority LIKE '1%' THEN '' WHEN o_orderpriority LIKE '2%' THEN NULL "
          "WHEN o_orderpriority LIKE '3%' THEN '   ' ELSE o_orderpriority END")


@register("render_lines", f"""
SELECT o_orderkey, concat_ws(' ', CAST(o_orderkey AS VARCHAR),
         CASE WHEN trim(o_orderstatus) <> '' THEN o_orderstatus END,
         CASE WHEN trim(c3) <> '' THEN c3 END, CAST(o_custkey AS VARCHAR)) AS line
FROM (SELECT *, {_CELL3} AS c3 FROM orders) o""")
def q_render_lines(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey", render_line(
        ["o_orderkey", "o_orderstatus", F.expr(_CELL3), "o_custkey"]).alias("line"))


@register("row_index", with_views("SELECT case_id, row_idx, o_orderkey FROM result_lines", "result_lines"))
def q_row_index(spark, sf):
    return b.result_lines(spark, sf).select("case_id", "row_idx", "o_orderkey")


def _rt(spark, sf):
    r = b.result_lines(spark, sf)
    return r, b.target_lines(spark, sf, r)


@register("match_line", with_views(f"""
SELECT r.case_id, r.row_idx, {duck_match('r.line', 't.pattern')} AS matched
FROM result_lines r JOIN target_lines t ON r.case_id = t.case_id AND r.row_idx = t.row_idx""",
    "target_lines"))
def q_match_line(spark, sf):
    r, t = _rt(spark, sf)
    return (r.join(t, ["case_id", "row_idx"])
            .select("case_id", "row_idx", match_line(F.col("line"), F.col("pattern")).alias("matched")))


def _exact_sql(keys: str, out: str, tgt: str) -> str:
    on = " AND ".join(f"o.{k} = t.{k}" for k in keys.split(", "))
    mine = ", ".join("o." + k for k in keys.split(", "))
    return f"""
SELECT {keys}, coalesce(n_out, 0) AS n_out, coalesce(n_tgt, 0) AS n_tgt, coalesce(n_diff, 0) AS n_diff,
       first_diff_idx, diff_line, diff_pattern,
       CASE WHEN coalesce(n_out, 0) <> coalesce(n_tgt, 0) THEN 'LineCountDiff'
            WHEN coalesce(n_diff, 0) > 0 THEN 'LinesNotMatch' ELSE 'Pass' END AS verdict
FROM (SELECT {keys}, count(*) AS n_out FROM {out} GROUP BY {keys}) a
FULL OUTER JOIN (SELECT {keys}, count(*) AS n_tgt FROM {tgt} GROUP BY {keys}) c USING ({keys})
LEFT JOIN (SELECT {mine}, count(*) AS n_diff, min(o.row_idx) AS first_diff_idx,
                  arg_min(o.line, o.row_idx) AS diff_line, arg_min(t.pattern, o.row_idx) AS diff_pattern
           FROM {out} o JOIN {tgt} t ON {on} AND o.row_idx = t.row_idx
           WHERE NOT {duck_match('o.line', 't.pattern')} GROUP BY {mine}) d USING ({keys})"""


EXACT_SQL = with_views(_exact_sql("case_id", "result_lines", "target_lines"), "target_lines")


@register("verify_exact", EXACT_SQL)
def q_verify_exact(spark, sf):
    r, t = _rt(spark, sf)
    return vf.verify_exact(r, t)


@register("verify_rows", with_views("""
SELECT e.case_id, e.expected_rows, coalesce(n.n_out, 0) AS n_out,
       CASE WHEN coalesce(n.n_out, 0) = e.expected_rows THEN 'Pass' ELSE 'LineCountDiff' END AS verdict
FROM (SELECT case_id, count(*) AS expected_rows FROM target_lines GROUP BY case_id) e
LEFT JOIN (SELECT case_id, count(*) AS n_out FROM result_lines GROUP BY case_id) n ON e.case_id = n.case_id""",
    "target_lines"))
def q_verify_rows(spark, sf):
    r = share(b.result_lines(spark, sf))  # one pass for results and targets
    t = b.target_lines(spark, sf, r)
    expected = t.groupBy("case_id").agg(F.count(F.lit(1)).alias("expected_rows"))
    return vf.verify_rows(r, expected)


@register("verify_include", with_views(f"""
SELECT t.case_id, t.n_targets, coalesce(f.n_matched, 0) AS n_matched,
       CASE WHEN coalesce(f.n_matched, 0) = t.n_targets THEN 'Pass' ELSE 'LinesInclude' END AS verdict
FROM (SELECT h.case_id, count(inc.case_id) AS n_targets FROM all_cases h LEFT JOIN inc USING (case_id) GROUP BY h.case_id) t
LEFT JOIN (SELECT case_id, list_reduce(list(ks ORDER BY row_idx),
                    lambda a, v: CASE WHEN list_contains(v, a) THEN a + 1 ELSE a END, CAST(0 AS BIGINT)) AS n_matched
           FROM (SELECT r.case_id, r.row_idx, list(i.k) AS ks
                 FROM result_lines r JOIN inc i ON r.case_id = i.case_id
                 WHERE {duck_match('r.line', 'i.pattern')}
                 GROUP BY r.case_id, r.row_idx) p
           GROUP BY case_id) f ON t.case_id = f.case_id""", "target_lines",
    extra={"all_cases": "SELECT DISTINCT case_id FROM result_lines",
           "inc": "SELECT case_id, row_idx, pattern, row_number() OVER (PARTITION BY case_id ORDER BY row_idx) - 1 AS k "
                  "FROM target_lines WHERE case_id % 19 <> 5"}))
def q_verify_include(spark, sf):
    """All target lines; cases with id % 19 = 5 have an empty target."""
    r = share(b.result_lines(spark, sf))
    t = b.target_lines(spark, sf, r)
    heads = r.select("case_id").distinct()
    return vf.verify_include(r, t.where(F.col("case_id") % 19 != 5), heads=heads)


@register("verify_exclude", with_views(f"""
SELECT a.case_id, coalesce(h.n_hits, 0) AS n_hits,
       CASE WHEN coalesce(h.n_hits, 0) = 0 THEN 'Pass' ELSE 'LinesExclude' END AS verdict
FROM (SELECT DISTINCT case_id FROM result_lines) a LEFT JOIN (
  SELECT r.case_id, count(*) FILTER (WHERE {duck_match('r.line', 'f.pattern')}) AS n_hits
  FROM result_lines r JOIN firsts f ON r.case_id = f.case_id GROUP BY r.case_id) h ON a.case_id = h.case_id""",
    "target_lines",
    extra={"firsts": "SELECT (case_id + 199) % 200 AS case_id, arg_min(pattern, row_idx) AS pattern "
                     "FROM target_lines WHERE case_id % 19 <> 5 GROUP BY case_id"}))
def q_verify_exclude(spark, sf):
    """The neighbour's lines must not occur; neighbours with id % 19 = 5 have an empty target."""
    r, t = _rt(spark, sf)
    shifted = t.where(F.col("case_id") % 19 != 5).select(
        ((F.col("case_id") + 199) % 200).alias("case_id"), "row_idx", "pattern")
    return vf.verify_exclude(r, shifted, heads=r.select("case_id").distinct())


@register("verify_error", with_views(f"""
SELECT o.case_id, o.target_idx, o.error,
       CASE WHEN o.error IS NULL THEN 'UnexpectedSuccess' WHEN coalesce(t.n, 0) <> 1 THEN 'LineCountDiff'
            WHEN {duck_match('o.error', 't.pattern')} THEN 'Pass' ELSE 'LinesNotMatch' END AS verdict
FROM (SELECT case_id, row_idx AS target_idx, CASE WHEN split_part(line, ' ', 2) = 'F' THEN line END AS error
      FROM result_lines) o
LEFT JOIN (SELECT case_id, row_idx // (1 + case_id % 3) AS target_idx, count(*) AS n, arg_min(pattern, row_idx) AS pattern
           FROM target_lines GROUP BY ALL) t
  ON o.case_id = t.case_id AND o.target_idx = t.target_idx""", "target_lines"))
def q_verify_error(spark, sf):
    """Every result line is the outcome of a step; its target has one to three lines (one is right)."""
    r, t = _rt(spark, sf)
    outcome = r.select("case_id", F.col("row_idx").alias("target_idx"),
                       F.when(F.split("line", " ")[1] == "F", F.col("line")).alias("error"))
    tgt = t.withColumn("target_idx", F.floor(F.col("row_idx") / (1 + F.col("case_id") % 3)))
    return vf.verify_error(outcome, tgt, ["case_id", "target_idx"])


_HEADER = ("CASE WHEN o_orderkey % 5 = 0 THEN concat(CAST(o_orderkey AS VARCHAR), ' ', o_orderstatus) "
           "WHEN o_orderstatus = 'F' THEN concat('# include ', o_orderpriority) "
           "WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN '# include then exclude' "
           "WHEN o_orderstatus = 'O' THEN concat('# exclude then include rows ', CAST(o_custkey % 9 AS VARCHAR)) "
           "WHEN o_orderkey % 3 = 0 THEN concat('#rows', CAST(o_custkey AS VARCHAR), ' x') "
           "ELSE concat('# data-received topic_', CAST(o_custkey % 7 AS VARCHAR), ' tbl', "
           "CAST(o_orderkey % 3 AS VARCHAR), ' exclude') END")


# results of every order line by case, and a target for every order: header, then lines by its mode
_HEADS = f"""SELECT o_orderkey AS target_id, CASE WHEN o_orderkey % 23 = 1 THEN NULL ELSE {_HEADER} END AS header,
       o_orderkey % 3 AS n_out, o_orderkey, o_orderstatus FROM orders"""


@register("verify_dispatch", f"""
SELECT target_id, mode, n_out,
       CASE mode WHEN 'rows' THEN CASE WHEN n_out = n THEN 'Pass' ELSE 'LineCountDiff' END
                 WHEN 'data-received' THEN CASE WHEN topic = 'topic_3' THEN 'Pass' ELSE 'DataNotReceived' END
                 WHEN 'include' THEN CASE WHEN n_out >= 1 THEN 'Pass' ELSE 'LinesInclude' END
                 WHEN 'exclude' THEN CASE WHEN n_out = 0 THEN 'Pass' ELSE 'LinesExclude' END
                 ELSE CASE WHEN n_out <> n_tgt THEN 'LineCountDiff' WHEN n_out > 0 AND bad THEN 'LinesNotMatch'
                           ELSE 'Pass' END END AS verdict
FROM (SELECT target_id, n_out,
             CASE WHEN header IS NULL OR NOT starts_with(header, '#') THEN 'match' WHEN instr(header, 'rows') > 1 THEN 'rows'
                  WHEN instr(header, 'data-received') > 1 THEN 'data-received'
                  WHEN instr(header, 'exclude') > 1 THEN 'exclude'
                  WHEN instr(header, 'include') > 1 THEN 'include' ELSE 'match' END AS mode,
             TRY_CAST(trim(substring(header, instr(header, 'rows') + 4)) AS INTEGER) AS n,
             regexp_split_to_array(header, '\\s+')[3] AS topic,
             CASE WHEN header IS NULL THEN 0 ELSE 1 END AS n_tgt,
             header IS DISTINCT FROM concat(CAST(o_orderkey AS VARCHAR), ' ', o_orderstatus) AS bad
      FROM ({_HEADS}) h) m""")
def q_verify_dispatch(spark, sf):
    """A target for every order, verified in the mode its first line asks for; some have no line, some no result."""
    t = F.expr(_HEADER.replace("VARCHAR", "STRING"))
    o = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("target_id"), F.when(F.col("o_orderkey") % 23 != 1, t).alias("header"),
        F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("line"))
    n = F.col("target_id") % 3
    out = o.where(n > 0).select("target_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("row_idx"), "line")
    head = o.where(F.col("header").isNotNull()).select("target_id", F.lit(0).cast("long").alias("row_idx"),
                                                       F.col("header").alias("pattern"))
    modal = F.startswith("header", F.lit("#")) & (F.instr("header", "rows") < 2) & (F.instr("header", "received") < 2)
    body = o.where(modal).select("target_id", F.lit(1).cast("long").alias("row_idx"),
                                 F.regexp_replace("line", "^[0-9]+", "[0-9]++").alias("pattern"))
    lags = o.select(F.lit("topic_3").alias("topic"), F.lit("Pass").alias("verdict")).limit(1)
    return vf.verify_targets(out, o.select("target_id"), head.unionByName(body), ["target_id"], lags).drop("message")


@register("consumer_lag", with_views("""
SELECT concat('suite_case-db.', topic) AS group_id, topic, count(*) AS n_parts,
       CAST(sum(end_offset - committed) AS BIGINT) AS lag,
       CASE WHEN count(*) > 0 AND bool_and(coalesce(end_offset = committed, false)) THEN 'Pass'
            ELSE 'DataNotReceived' END AS verdict
FROM offsets GROUP BY topic""", "offsets"))
def q_consumer_lag(spark, sf):
    from tessera.operators.offsets import consumer_lag, group_key
    off = b.offsets(spark, sf).withColumn(
        "group_id", group_key(F.lit("suite_case"), F.lit("db"), F.col("topic")))
    return consumer_lag(off)


_TARGETED = {
    "rt": "SELECT case_id, row_idx // 10 AS target_idx, row_idx % 10 AS row_idx, line FROM result_lines",
    "tt": "SELECT case_id, row_idx // 10 AS target_idx, row_idx % 10 AS row_idx, pattern FROM target_lines",
}
_VERDICTS = _exact_sql("case_id, target_idx", "rt", "tt")


@register("case_outcome", with_views("""
SELECT case_id, min(target_idx) FILTER (WHERE verdict <> 'Pass') IS NULL AS passed,
       min(target_idx) FILTER (WHERE verdict <> 'Pass') AS failed_target,
       arg_min(verdict, target_idx) FILTER (WHERE verdict <> 'Pass') AS failed_verdict,
       arg_min(CASE verdict WHEN 'LineCountDiff' THEN concat(CAST(n_out AS VARCHAR), ' lines, expected ', CAST(n_tgt AS VARCHAR))
                    ELSE concat('line ', CAST(first_diff_idx AS VARCHAR), ': ', diff_line, ' | ', diff_pattern) END, target_idx)
         FILTER (WHERE verdict <> 'Pass') AS failed_message,
       coalesce(min(target_idx) FILTER (WHERE verdict <> 'Pass'), count(*)) AS targets_passed
FROM verdicts GROUP BY case_id""", "target_lines", extra={**_TARGETED, "verdicts": _VERDICTS}))
def q_case_outcome(spark, sf):
    r = share(b.result_lines(spark, sf))  # results are stored data: numbered once, verified in four modes
    t = b.target_lines(spark, sf, r)
    cut = lambda df: df.withColumns({"target_idx": F.floor(F.col("row_idx") / 10), "row_idx": F.col("row_idx") % 10})
    keys = ["case_id", "target_idx"]
    out, tgt = cut(r), cut(t)
    heads = out.select(*keys).distinct()
    return vf.case_outcome(vf.verify_targets(out, heads, tgt, keys))


@register("eventually_pass", with_views("""
SELECT c.case_id,
       CASE WHEN t2.t IS NOT NULL THEN 3 WHEN t1.t IS NOT NULL THEN 2 WHEN t0.t IS NOT NULL THEN 1 ELSE 0 END AS reached,
       t2.t IS NOT NULL AS passed, t2.t AS pass_ms
FROM (SELECT DISTINCT case_id FROM snapshots) c
LEFT JOIN t0 ON c.case_id = t0.case_id LEFT JOIN t1 ON c.case_id = t1.case_id
LEFT JOIN t2 ON c.case_id = t2.case_id""", "snapshots", extra={
    "s": "SELECT * FROM snapshots WHERE poll_ms <= 30000",
    "t0": "SELECT case_id, min(poll_ms) AS t FROM s WHERE passing_target = 0 GROUP BY case_id",
    "t1": "SELECT s.case_id, min(poll_ms) AS t FROM s JOIN t0 ON s.case_id = t0.case_id "
          "WHERE passing_target = 1 AND poll_ms >= t0.t GROUP BY s.case_id",
    "t2": "SELECT s.case_id, min(poll_ms) AS t FROM s JOIN t1 ON s.case_id = t1.case_id "
          "WHERE passing_target = 2 AND poll_ms >= t1.t GROUP BY s.case_id"}))
def q_eventually_pass(spark, sf):
    return vf.eventually_pass(share(b.snapshots(spark, sf)), n_targets=3, limit_ms=30000)
