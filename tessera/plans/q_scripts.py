"""Registered queries: script corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import scripts as sc
from tessera.plans import bindings as b
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register

_WS = "chr(32) || chr(9) || chr(10) || chr(13)"


def stmts_sql(src: str) -> str:
    """DuckDB statement split of a line view (same rules as ``scripts.statements``)."""
    return f"""
WITH p AS (SELECT file, n, trim(toks[1], {_WS}) AS seg,
                  CASE WHEN len(list_filter(toks[2:], lambda x: length(x) > 0)) > 0
                       THEN trim(toks[2], {_WS}) END AS comment
           FROM (SELECT file, n, string_split(line, '--') AS toks FROM {src} WHERE length(line) > 0) a),
f AS (SELECT *, lower(seg) AS low,
             ((starts_with(lower(seg), 'create') OR starts_with(lower(seg), 'replace'))
               AND (contains(lower(seg), 'function') OR contains(lower(seg), 'procedure')
                    OR contains(lower(seg), 'package')))
             OR starts_with(lower(seg), 'begin') OR starts_with(lower(seg), 'declare') AS op,
             starts_with(lower(seg), 'end;') AS en
      FROM p),
i AS (SELECT *, last_value(CASE WHEN op THEN 1 WHEN en THEN 0 END IGNORE NULLS) OVER (
               PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inb
      FROM f),
c AS (SELECT *, CASE WHEN coalesce(inb, 0) = 1 THEN en ELSE (NOT op AND ends_with(low, ';')) END AS cls FROM i),
s AS (SELECT *, coalesce(sum(CAST(cls AS INTEGER)) OVER (PARTITION BY file ORDER BY n
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM c),
t AS (SELECT file, sid, string_agg(seg, chr(10) ORDER BY n) AS txt FROM s GROUP BY file, sid)
SELECT file, n, CASE WHEN cls THEN trim(txt, {_WS}) ELSE '' END AS sql, comment
FROM s JOIN t USING (file, sid)
WHERE (CASE WHEN cls THEN trim(txt, {_WS}) ELSE '' END) <> '' OR comment IS NOT NULL"""


ST = {"st": stmts_sql("script_lines")}
SST = {"sst": stmts_sql("stream_script_lines")}


def _st(spark, sf):
    return sc.statements(b.script_lines(spark, sf))


def _sst(spark, sf):
    return sc.statements(b.stream_script_lines(spark, sf))


@register("script_statements", with_views("SELECT * FROM st", "script_lines", extra=ST))
def q_script_statements(spark, sf):
    return _st(spark, sf)


_DIR = """SELECT file, n, comment, lower(trim(split_part(comment, ':', 1))) AS key,
       CASE WHEN len(string_split(comment, ':')) > 1 THEN trim(string_split(comment, ':')[2]) END AS value
FROM {src} WHERE comment IS NOT NULL"""


@register("script_directives", with_views(_DIR.format(src="st"), "script_lines", extra=ST))
def q_script_directives(spark, sf):
    return sc.directives(_st(spark, sf))


_KIND = """
SELECT file, n, kind, kind = 'create_stream' AND NOT coalesce(contains(comment, 'no-reset'), false) AS reset
FROM (SELECT file, n, comment,
             CASE WHEN len(tk) < 2 THEN 'other'
                  WHEN lower(tk[1]) = 'create' AND t2 = 'table' THEN 'create_table'
                  WHEN lower(tk[1]) = 'create' AND t2 = 'external' THEN 'create_external'
                  WHEN lower(tk[1]) = 'create' AND t2 = 'view' THEN 'create_view'
                  WHEN lower(tk[1]) = 'create' AND t2 = 'stream' THEN 'create_stream'
                  WHEN lower(tk[1]) = 'use' AND t2 = 'application' THEN 'use_application'
                  ELSE 'other' END AS kind
      FROM (SELECT *, CASE WHEN lower(tk[2]) = 'if' THEN lower(tk[5]) ELSE lower(tk[2]) END AS t2
            FROM (SELECT *, regexp_split_to_array(sql, '\\s+') AS tk FROM {src} WHERE sql <> '') a) b) c"""


@register("statement_class", with_views(
    "SELECT 'scripts' AS corpus, * FROM (" + _KIND.format(src="st") + ") x UNION ALL "
    "SELECT 'streams', * FROM (" + _KIND.format(src="sst") + ") y",
    "script_lines", "stream_script_lines", extra={**ST, **SST}))
def q_statement_class(spark, sf):
    a = sc.statement_class(_st(spark, sf)).select(F.lit("scripts").alias("corpus"), "*")
    c = sc.statement_class(_sst(spark, sf)).select(F.lit("streams").alias("corpus"), "*")
    return a.unionByName(c)


_OBJ = f"""SELECT file, n, NULLIF(regexp_extract(sql, '{sc.CREATED_OBJECT_RX}', 1), '') AS object
FROM {{src}} WHERE sql <> ''"""


@register("created_object", with_views(
    "SELECT 'scripts' AS corpus, * FROM (" + _OBJ.format(src="st") + ") x WHERE object IS NOT NULL UNION ALL "
    "SELECT 'streams', * FROM (" + _OBJ.format(src="sst") + ") y WHERE object IS NOT NULL",
    "script_lines", "stream_script_lines", extra={**ST, **SST}))
def q_created_object(spark, sf):
    def one(st, corpus):
        return (st.where(F.col("sql") != "")
                .select(F.lit(corpus).alias("corpus"), "file", "n", sc.created_object(F.col("sql")).alias("object"))
                .where(F.col("object").isNotNull()))
    return one(_st(spark, sf), "scripts").unionByName(one(_sst(spark, sf), "streams"))


@register("topic_extract", with_views(f"""
SELECT k.file, k.n, NULLIF(regexp_extract(s.sql, '{sc.CREATED_OBJECT_RX}', 1), '') AS object,
       NULLIF(regexp_extract(lower(s.sql), '{sc.TOPIC_RX.replace("'", "''")}', 1), '') AS topic, k.reset
FROM ({_KIND.format(src="sst")}) k JOIN sst s ON k.file = s.file AND k.n = s.n
WHERE k.kind = 'create_stream'""", "stream_script_lines", extra=SST))
def q_topic_extract(spark, sf):
    st = sc.statement_class(_sst(spark, sf), keep=["sql"]).where(F.col("kind") == "create_stream")
    return st.select("file", "n", sc.created_object(F.col("sql")).alias("object"),
                     sc.topic_of(F.col("sql")).alias("topic"), "reset")


def _vars():
    case = F.concat(F.lit("scripts_case"), F.col("file").cast("string"))
    return F.create_map(F.lit("prefix"), F.concat(case, F.lit("_")), F.lit("app"),
                        F.concat(case, F.lit("_${database}")), F.lit("database"), F.lit("db"))


# the app's value holds a name itself, which must stay: it is put in last
_SUBST = """replace(replace(replace(sql, '$' || '{database}', 'db'),
        '$' || '{prefix}', concat('scripts_case', CAST(file AS VARCHAR), '_')),
        '$' || '{app}', concat('scripts_case', CAST(file AS VARCHAR), '_$', '{database}'))"""


@register("app_set", with_views(f"""
SELECT DISTINCT file, app FROM (
  SELECT file, CASE WHEN starts_with(s, 'use application ') AND suffix(s, ';') THEN substr(s, 17, length(s) - 17) END AS app
  FROM (SELECT file, {_SUBST} AS s FROM st) r
  UNION ALL SELECT file, concat('scripts_case', CAST(file AS VARCHAR)) FROM st) x
WHERE app IS NOT NULL""", "script_lines", extra=ST))
def q_app_set(spark, sf):
    st = _st(spark, sf)
    return sc.app_set(st, F.concat(F.lit("scripts_case"), F.col("file").cast("string")), _vars())


@register("substitute_vars", with_views(f"SELECT file, n, {_SUBST} AS sql FROM st WHERE sql <> ''",
                                        "script_lines", extra=ST))
def q_substitute_vars(spark, sf):
    st = _st(spark, sf).where(F.col("sql") != "")
    return st.select("file", "n", sc.substitute(F.col("sql"), _vars()).alias("sql"))


@register("statement_split", with_views("""
SELECT file, n, piece_idx, piece, piece_idx = len(p) - 1 AS is_last
FROM (SELECT file, n, p, generate_subscripts(p, 1) - 1 AS piece_idx, unnest(p) AS piece
      FROM (SELECT file, n,
                   CASE WHEN ((starts_with(lower(sql), 'create') OR starts_with(lower(sql), 'replace'))
                               AND (contains(lower(sql), 'function') OR contains(lower(sql), 'procedure')
                                    OR contains(lower(sql), 'package')))
                             OR starts_with(lower(sql), 'begin') OR starts_with(lower(sql), 'declare')
                        THEN [sql] ELSE list_filter(string_split(sql, ';'), lambda x: length(x) > 0) END AS p
            FROM st WHERE sql <> '') a) b""", "script_lines", extra=ST))
def q_statement_split(spark, sf):
    return sc.split_statement(_st(spark, sf))


@register("time_limit", with_views(f"""
SELECT file, coalesce(arg_max(t, n) FILTER (WHERE t IS NOT NULL), 30) AS limit_s
FROM (SELECT file, n, CASE WHEN starts_with(lower(comment), 'time')
                           THEN TRY_CAST(trim(string_split(comment, ':')[2]) AS INTEGER) END AS t
      FROM (SELECT file, n, string_split(line, '--') AS toks,
                   CASE WHEN len(list_filter(string_split(line, '--')[2:], lambda x: length(x) > 0)) > 0
                        THEN trim(string_split(line, '--')[2], {_WS}) END AS comment
            FROM script_lines WHERE length(line) > 0) a) b
GROUP BY file""", "script_lines"))
def q_time_limit(spark, sf):
    return sc.time_limit(b.script_lines(spark, sf))


@register("stream_ids", with_views("""
SELECT file, n, concat('stream', CAST(k AS VARCHAR)) AS var,
       concat('streams_case', CAST(file AS VARCHAR), '_stream', CAST(k AS VARCHAR)) AS stream_id
FROM (SELECT file, n, row_number() OVER (PARTITION BY file ORDER BY n) AS k
      FROM sst WHERE comment IS NOT NULL AND lower(trim(split_part(comment, ':', 1))) = 'stream') a""",
    "stream_script_lines", extra=SST))
def q_stream_ids(spark, sf):
    st = _sst(spark, sf)
    return sc.stream_ids(st, F.concat(F.lit("streams_case"), F.col("file").cast("string"), F.lit("_")))


def _suite(col="file"):
    return F.concat(F.lit("s"), (F.col(col) / 1000).cast("long").cast("string"))


@register("global_settings", with_views("""
SELECT suite, file, n AS step, sql FROM (SELECT concat('s', CAST(file // 1000 AS VARCHAR)) AS suite, * FROM st) c
UNION ALL
SELECT suite, NULL, pos - k, sql FROM (
  SELECT suite, sql, row_number() OVER (PARTITION BY suite ORDER BY sql) - 1 AS pos,
         count(*) OVER (PARTITION BY suite) AS k
  FROM (SELECT DISTINCT concat('s', CAST(file // 1000 AS VARCHAR)) AS suite, sql FROM st
        WHERE sql LIKE 'use application %') d) e""", "script_lines", extra=ST))
def q_global_settings(spark, sf):
    st = _st(spark, sf).withColumn("suite", _suite())
    settings = (st.where(F.col("sql").like("use application %")).select("suite", "sql").distinct()
                .withColumn("pos", F.row_number().over(Window.partitionBy("suite").orderBy("sql")) - 1))
    return sc.with_globals(st, settings)


@register("failed_script", with_views(f"""
SELECT file, n, {_SUBST} AS sql FROM st
WHERE sql <> '' AND file IN (SELECT file FROM st WHERE comment = 'error')""", "script_lines", extra=ST))
def q_failed_script(spark, sf):
    st = _st(spark, sf)
    failed = st.where(F.col("comment") == "error").select("file").distinct()
    return sc.failed_scripts(st.where(F.col("sql") != ""), failed, _vars())
