"""The bindings of ``tessera.plans.bindings`` as DuckDB SQL (used as CTEs).

``with_views(body, *names)`` prefixes a query with the CTEs it needs, in
dependency order.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "jobs": """
SELECT CASE WHEN o_custkey % 40 = 0 THEN 'base' WHEN o_custkey % 40 = 1 THEN 'reg'
            WHEN o_orderdate < TIMESTAMP '1998-04-01 00:00:00' THEN 'base' ELSE 'reg' END AS run,
       o_orderkey AS job_id, concat('select * from q', CAST(o_custkey % 40 AS VARCHAR)) AS sql_text,
       CAST(o_custkey % 25 AS VARCHAR) AS stream_id,
       o_orderkey * 100000 AS submit_ms,
       CASE WHEN o_orderkey % 211 = 5 THEN NULL
            ELSE o_orderkey * 100000 + CAST(floor(o_totalprice) AS BIGINT) END AS finish_ms,
       CASE WHEN o_orderkey % 211 = 5 THEN NULL
            WHEN o_orderstatus = 'F' AND o_orderkey % 97 = 0 THEN 'JobFailed' ELSE 'JobSucceeded' END AS result
FROM orders""",
    "stages": """
SELECT run, job_id, sql_text, stream_id, job_id * 100 + pos AS stage_id, name,
       submit_ms + pos * 1000 AS submit_ms, submit_ms + pos * 1000 + dur AS complete_ms
FROM (SELECT l_orderkey AS job_id, concat(l_returnflag, l_linestatus) AS name,
             CAST(trunc(l_quantity * 37) AS BIGINT) AS dur,
             row_number() OVER (PARTITION BY l_orderkey
               ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pos
      FROM lineitem) s
JOIN (SELECT job_id, run, sql_text, stream_id, submit_ms FROM jobs) j USING (job_id)""",
    "test_events": """
SELECT user_id AS suite, event_id AS ordinal, ts,
       CASE event_type WHEN 'signup' THEN 'TestStarting' WHEN 'purchase' THEN 'TestSucceeded'
            WHEN 'error' THEN 'TestFailed' WHEN 'click' THEN 'InfoProvided' ELSE 'TestIgnored' END AS kind,
       props AS message FROM events
UNION ALL
SELECT user_id, CAST(-1 AS BIGINT), min(ts), 'SuiteStarting', NULL FROM events GROUP BY user_id
UNION ALL
SELECT user_id, max(event_id) + 1, max(ts),
       CASE WHEN user_id % 10 = 0 THEN 'SuiteAborted' ELSE 'SuiteCompleted' END, NULL
FROM events GROUP BY user_id""",
    "line_pos": """
SELECT *, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos
FROM lineitem""",
    "script_lines": """
SELECT l_orderkey AS file, pos AS n,
       CASE l_linenumber WHEN 1 THEN concat('create table if not exists $', '{prefix}t', CAST(l_partkey AS VARCHAR), '(')
            WHEN 2 THEN 'a int); -- target' WHEN 3 THEN 'begin' WHEN 4 THEN 'select 1;' WHEN 5 THEN 'end;'
            WHEN 6 THEN concat('use application ', CASE l_suppkey % 3 WHEN 0 THEN concat('$', '{app}')
                               ELSE concat('app', CAST(l_suppkey % 3 AS VARCHAR)) END, '; -- time:60')
            ELSE concat('select count(*) from t', CAST(l_suppkey AS VARCHAR), '; -- error') END AS line
FROM line_pos""",
    "stream_script_lines": """
SELECT l_orderkey AS file, pos AS n,
       CASE l_linenumber
            WHEN 1 THEN concat('create stream s', CAST(l_suppkey AS VARCHAR),
                               '(a int) tblproperties("topic"="Topic_', l_returnflag, '");')
            WHEN 2 THEN concat('create stream r', CAST(l_suppkey AS VARCHAR),
                               '(a int) tblproperties(''topic''=''T', CAST(l_suppkey AS VARCHAR), '''); -- no-reset')
            WHEN 3 THEN concat('insert into t', CAST(l_suppkey AS VARCHAR), ' select * from s',
                               CAST(l_suppkey AS VARCHAR), '; -- stream')
            WHEN 4 THEN concat('create view v', CAST(l_suppkey AS VARCHAR), ' as select * from t',
                               CAST(l_suppkey AS VARCHAR), ';')
            WHEN 5 THEN concat('create external table if not exists e', CAST(l_suppkey AS VARCHAR), '(a int);')
            WHEN 6 THEN concat('insert into u select * from r', CAST(l_suppkey AS VARCHAR), '; -- stream')
            ELSE concat('select count(*) from t', CAST(l_suppkey AS VARCHAR), '; -- target') END AS line
FROM line_pos""",
    "result_lines": """
SELECT o_custkey % 200 AS case_id,
       row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) - 1 AS row_idx, o_orderkey,
       concat_ws(' ', CAST(o_orderkey AS VARCHAR), o_orderstatus,
                 CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)) AS line
FROM orders""",
    "target_lines": """
SELECT case_id, row_idx,
       CASE WHEN o_orderkey % 1009 = 3 THEN '( Z Z' WHEN o_orderkey % 501 = 0 THEN concat(line, ' extra')
            WHEN o_orderkey % 7 = 0 THEN '[0-9]+ [FOP] [0-9]+' ELSE line END AS pattern
FROM result_lines WHERE NOT (case_id % 17 = 0 AND row_idx = 0)""",
    "offsets": """
SELECT event_type AS topic, event_id % 4 AS part, min(event_id) AS earliest, max(event_id) + 1 AS end_offset,
       max(CASE WHEN event_type <> 'error' OR value < 20 THEN event_id END) + 1 AS committed
FROM events GROUP BY event_type, event_id % 4""",
    "snapshots": """
SELECT user_id AS case_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 2000 AS poll_ms,
       CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 END AS passing_target
FROM events""",
    "message_log": """
SELECT event_type AS topic, event_id % 4 AS part, event_id AS "offset" FROM events""",
}

_DEPS = {
    "stages": ["jobs"],
    "script_lines": ["line_pos"],
    "stream_script_lines": ["line_pos"],
    "target_lines": ["result_lines"],
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in _DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <views> <body>``; ``extra`` CTEs (name -> SQL) come after the views."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in _order(names)]
    parts += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body


def duck_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda x: x <> '')"


def duck_match(line: str, pattern: str) -> str:
    """DuckDB form of ``match_line`` (the invalid token '(' is guarded)."""
    lt, pt = duck_tokens(line), duck_tokens(pattern)
    return (f"(CASE WHEN len({lt}) = 0 AND len({pt}) = 0 THEN true "
            f"WHEN len({lt}) <> len({pt}) THEN false "
            f"ELSE list_bool_and(list_transform(list_zip({lt}, {pt}), lambda z: "
            f"CASE WHEN z[1] = z[2] THEN true WHEN z[2] = '(' THEN false "
            f"ELSE regexp_full_match(z[1], z[2]) END)) END)")
