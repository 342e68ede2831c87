"""Registered queries: generation and spec/csv sources (§2.1).

Row numbers are the keys of ``orders`` (0, 1, ..), so every generated row belongs to a row of the table and
the work grows with it. The oracles are written by hand from the definition of the recipes.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from tessera.operators.generate import ColumnSpec, Rule, TableSpec, column_stats, gen_table
from tessera.plans.registry import register
from tessera.session import read_table, scratch_path
from tessera.sources.specs import merge_rules, parse_specs

SEED = 42


def order_ids(spark, sf):
    return read_table(spark, sf, "orders").select("o_orderkey")


def generated(spark, sf, spec, columns=None):
    return gen_table(spark, spec, seed=SEED, ids=order_ids(spark, sf), id_col="o_orderkey", columns=columns)


# The reference's sample spec (tables ``test`` and ``test2``).
def sample_test() -> TableSpec:
    return TableSpec("test", 20, [
        ColumnSpec("l1", "int", [Rule("1", 0.4, "include"), Rule("2", 0.3, "include")]),
        ColumnSpec("l2", "float"), ColumnSpec("l3", "string"), ColumnSpec("l4", "timestamp")])


def sample_test2() -> TableSpec:
    return TableSpec("test2", 15, [
        ColumnSpec("l1", "string"),
        ColumnSpec("l2", "int", [Rule("1", None, "except"), Rule("2", 0.3, "include")]),
        ColumnSpec("l3", "timestamp"), ColumnSpec("l4", "float")])


def rules_spec() -> TableSpec:
    """Except on int, float and ramp columns (ends, inner values, all but one), and a ramp whose draws are
    skipped by include hits."""
    return TableSpec("gx", 0, [
        ColumnSpec("a", "int", [Rule("5", None, "except"), Rule("4", None, "except"),
                                Rule("7", 0.1, "include")]),
        ColumnSpec("b", "float", [Rule("0.0", None, "except"), Rule("10.0", None, "except"),
                                  Rule("5.0", None, "except")]),
        ColumnSpec("c", "int", [Rule(str(v), None, "except") for v in range(10)]),
        ColumnSpec("d", "float", [Rule("0.005", None, "except"), Rule("0.005001", None, "except")], range=0.01),
        ColumnSpec("ts", "timestamp", [Rule("1970-01-01 09:00:00", 0.2, "include"),
                                       Rule("1970-01-01 07:00:01", None, "except"),
                                       Rule("1970-01-01 07:00:03", None, "except")]),
        ColumnSpec("r", "timestamp", frequency=7, delta=2.5, start=3.0)])


# ------------------------------------------------------------------ oracles, by hand
def _u(table: str, col: str, use: str, id_sql: str = "id") -> str:
    return (f"(CAST(('0x' || substr(md5('42:{table}:{col}:{use}:' || CAST({id_sql} AS VARCHAR)), 1, 13)) AS BIGINT)"
            " / 4503599627370496.0)")


# 1.5 standard deviations below the mean lie a share 0.06680720126885806 of all draws
_VALUE = """
least(greatest((0.5 + ((((((-39.69683028665376 * r + 220.9460984245205) * r - 275.9285104469687) * r
  + 138.357751867269) * r - 30.66479806614716) * r + 2.506628277459239) * (p - 0.5)
  / (((((-54.47609879822406 * r + 161.5858368580409) * r - 155.6989798598866) * r + 66.80131188771972) * r
  - 13.28068155288572) * r + 1)) / 3) * {rng}, 0), {rng})"""


def _normal(u: str, rng: str, rows: str = "SELECT o_orderkey AS id FROM orders") -> str:
    """(id, x): the clipped Gaussian at probability ``u`` (an expression over id)."""
    return f"""
SELECT id, CASE WHEN p < 0.06680720126885806e0 THEN 0e0 WHEN p >= 0.9331927987311419e0 THEN {rng}
                ELSE {_VALUE.format(rng=rng)} END AS x
FROM (SELECT id, p, (p - 0.5) * (p - 0.5) AS r FROM (SELECT id, {u} AS p FROM ({rows}) i) q) n"""


def _double(sql: str) -> str:
    """Decimal literals as doubles."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"CAST('\1' AS DOUBLE)", sql)


_L1 = f"""SELECT i.id, CASE WHEN {_u('test', 'l1', 'inc', 'i.id')} < 0.3 THEN 2 WHEN {_u('test', 'l1', 'inc', 'i.id')} < 0.7
  THEN 1 ELSE CAST(floor(x) AS INTEGER) END AS l1 FROM ({_normal(_u('test', 'l1', 'n'), '10.0')}) i"""
_L2 = f"SELECT id, round(x, 6) AS l2 FROM ({_normal(_u('test', 'l2', 'n'), '10.0')}) v"
_L4 = """SELECT o_orderkey AS id, TIMESTAMP '1970-01-01 07:00:00' + to_seconds(o_orderkey // 10) AS l4 FROM orders"""
SAMPLE_SQL = _double(f"SELECT a.id, l1, l2, 'default' AS l3, l4 FROM ({_L1}) a JOIN ({_L2}) b ON a.id = b.id "
                     f"JOIN ({_L4}) c ON a.id = c.id")
# test2.l2: 1 lies at probabilities 0.11506967022170828 .. 0.18406012534675947
_T2 = _double(f"""
SELECT v.id, CASE WHEN {_u('test2', 'l2', 'inc', 'v.id')} < 0.3 THEN 2 ELSE CAST(floor(x) AS INTEGER) END AS l2
FROM ({_normal(f"CASE WHEN {_u('test2', 'l2', 'n')} * 0.9310095448749488 >= 0.11506967022170828 THEN {_u('test2', 'l2', 'n')} "
               "* 0.9310095448749488 + 0.0689904551250512 ELSE " f"{_u('test2', 'l2', 'n')} * 0.9310095448749488 END", '10.0')}) v""")
# gx.a: 4 and 5 lie at 0.3820885778110474 .. 0.6179114221889526; gx.b: the clipped ends are cut off
_A = f"""
SELECT v.id, CASE WHEN {_u('gx', 'a', 'inc', 'v.id')} < 0.1 THEN 7 ELSE CAST(floor(x) AS INTEGER) END AS a
FROM ({_normal(f"CASE WHEN {_u('gx', 'a', 'n')} * 0.7641771556220947 >= 0.3820885778110474 THEN {_u('gx', 'a', 'n')} "
               f"* 0.7641771556220947 + 0.2358228443779052 ELSE {_u('gx', 'a', 'n')} * 0.7641771556220947 END", '10.0')}) v"""
_B = f"""
SELECT id, CASE WHEN round(x, 6) = 5.0 THEN 5.000001 ELSE round(x, 6) END AS b
FROM ({_normal(f"{_u('gx', 'b', 'n')} * 0.8663855974622838 + 0.06680720126885806", '10.0')}) v"""
_D = f"""
SELECT id, CASE WHEN round(x, 6) IN (0.005, 0.005001) THEN 0.005002 ELSE round(x, 6) END AS d
FROM ({_normal(_u('gx', 'd', 'n'), '0.01')}) v"""
_TS = f"""
SELECT id, CASE WHEN hit THEN TIMESTAMP '1970-01-01 09:00:00'
                ELSE TIMESTAMP '1970-01-01 07:00:00' + to_seconds(CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN 2 ELSE k + 2 END) END AS ts
FROM (SELECT id, hit, (id - coalesce(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED
               PRECEDING AND 1 PRECEDING), 0)) // 10 AS k
      FROM (SELECT o_orderkey AS id, {_u('gx', 'ts', 'inc', 'o_orderkey')} < 0.2 AS hit FROM orders) h) t"""
_EXCEPT = _double(f"SELECT a.id, a, b, 10 AS c, d, ts FROM ({_A}) a JOIN ({_B}) b ON a.id = b.id JOIN ({_D}) d "
                  f"ON a.id = d.id JOIN ({_TS}) t ON a.id = t.id")


def _register_gen(name, spec_fn, cols, oracle):
    @register(name, oracle)
    def run(spark, sf):
        return generated(spark, sf, spec_fn(), cols).select("id", *cols)


_register_gen("gen_rows", sample_test, ["l1", "l2", "l3", "l4"], SAMPLE_SQL)
_register_gen("gen_normal_float", sample_test, ["l2"], _double(_L2))
_register_gen("gen_normal_int", sample_test2, ["l2"], _T2)
_register_gen("gen_ramp", rules_spec, ["r"], """
SELECT o_orderkey AS id,
       TIMESTAMP '1970-01-01 07:00:03' + to_seconds(CAST((o_orderkey // 7) * 5 // 2 AS BIGINT)) AS r FROM orders""")
_register_gen("gen_timestamp", sample_test, ["l4"], _L4)
_register_gen("gen_const_string", sample_test2, ["l1"], "SELECT o_orderkey AS id, 'default' AS l1 FROM orders")
_register_gen("gen_include", sample_test, ["l1"], _double(_L1))
_register_gen("gen_except", rules_spec, ["a", "b", "c", "d", "ts"], _EXCEPT)


@register("column_stats", f"""
SELECT column_name, round(sum_value, 4) AS sum_value, round(avg_value, 9) AS avg_value FROM (
  SELECT 'l1' AS column_name, sum(CAST(l1 AS DOUBLE)) AS sum_value, avg(CAST(l1 AS DOUBLE)) AS avg_value FROM g
  UNION ALL SELECT 'l2', sum(l2), avg(l2) FROM g) s""".replace("FROM g", f"FROM ({SAMPLE_SQL}) g"))
def q_column_stats(spark, sf):
    s = column_stats(generated(spark, sf, sample_test()), ["l1", "l2"])
    return s.select("column_name", F.round("sum_value", 4).alias("sum_value"),
                    F.round("avg_value", 9).alias("avg_value"))


# ------------------------------------------------------------------ csv sink
def csv_line(df, cols):
    """Comma-joined text, no quoting, no header (timestamps as yyyy-MM-dd HH:mm:ss)."""
    rendered = []
    for c in cols:
        t = dict(df.dtypes)[c]
        if t.startswith("timestamp"):
            rendered.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
        else:
            rendered.append(F.col(c).cast("string"))
    return F.concat_ws(",", *rendered)


def write_csv_lines(df, cols, path: str) -> str:
    """One folder of comma-joined text parts per table (parallel writers)."""
    df.select(csv_line(df, cols).alias("value")).write.mode("overwrite").text(path)
    return path


# below a thousandth a double's text is in scientific notation
_JAVA_L2 = """CASE WHEN l2 > 0 AND l2 < 0.001 THEN concat(substr(d, 1, 1), '.', CASE WHEN rtrim(substr(d, 2), '0') = '' THEN '0'
  ELSE rtrim(substr(d, 2), '0') END, 'E', CAST(length(d) - 7 AS VARCHAR)) ELSE CAST(l2 AS VARCHAR) END"""


@register("gen_csv_sink", f"""
SELECT concat_ws(',', CAST(l1 AS VARCHAR), {_JAVA_L2}, l3, strftime(l4, '%Y-%m-%d %H:%M:%S')) AS line
FROM (SELECT *, CAST(CAST(round(l2 * 1000000) AS BIGINT) AS VARCHAR) AS d FROM ({SAMPLE_SQL}) s) g""")
def q_gen_csv_sink(spark, sf):
    df = generated(spark, sf, sample_test())
    path = write_csv_lines(df, ["l1", "l2", "l3", "l4"], scratch_path(spark, "csv"))
    return spark.read.text(path).select(F.col("value").alias("line"))


# ------------------------------------------------------------------ spec scripts from `part`
PARTS_A_TASK = 1 << 13  # nine lines each


def part_spec_lines(spark, sf):
    """One spec table per part row; 100 tables per spec file.

    The short rows are dealt out by file before they become lines, to as many tasks as there are lines for.
    """
    p = read_table(spark, sf, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(p.count() / PARTS_A_TASK))
    p = p.select((k / 100).cast("long").alias("file"), "p_partkey", "p_size").repartition(tasks, "file")
    lines = F.array(
        F.concat(F.lit("table: p"), k.cast("string"), F.lit(" : "), s.cast("string")),
        F.lit("row:{ c1 int, C2 float,"),
        F.lit("  c3 string ,c4 timestamp}"),
        F.concat(F.lit("(c1) include ("), (s % 7).cast("string"), F.lit(" 0.4;"),
                 (s % 5).cast("string"), F.lit(" 0.3)")),
        F.concat(F.lit("(C2, c1) except (0.0, "), (s % 3).cast("string"), F.lit("; 10.0)")),
        F.lit("(c4) frequency (x 0.5)"),
        F.lit("(zz) include (9 0.2)"),
        F.lit("end;"),
        F.lit(""))
    return p.select("file", (k % 100).alias("__k"),
                    F.posexplode(lines).alias("__pos", "line")) \
            .select("file", (F.col("__k") * 10 + F.col("__pos")).alias("n"), "line")


def _parsed(spark, sf):
    return parse_specs(part_spec_lines(spark, sf))


_PART_RULES = """
SELECT 'p' || CAST(p_partkey AS VARCHAR) AS "table", 'c1' AS col, CAST(p_size % 7 AS VARCHAR) AS value,
       0.4 AS freq, 'include' AS kind, 3 AS line, 0 AS group_idx, 0 AS col_idx FROM part
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'c1', CAST(p_size % 5 AS VARCHAR), 0.3, 'include', 3, 1, 0 FROM part
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'c2', '0.0', NULL, 'except', 4, 0, 0 FROM part
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'c1', CAST(p_size % 3 AS VARCHAR), NULL, 'except', 4, 0, 1 FROM part
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'c2', '10.0', NULL, 'except', 4, 1, 0 FROM part
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'c4', 'x', 0.5, 'frequency', 5, 0, 0 FROM part"""


@register("gen_spec_scan", """
SELECT 'p' || CAST(p_partkey AS VARCHAR) AS "table", CAST(p_size AS BIGINT) AS n_rows, c.pos, c.col, c.type
FROM part, (VALUES (0, 'c1', 'int'), (1, 'c2', 'float'), (2, 'c3', 'string'), (3, 'c4', 'timestamp')) c(pos, col, type)""")
def q_gen_spec_scan(spark, sf):
    _, columns, _ = _parsed(spark, sf)
    return columns.select("table", "n_rows", "pos", "col", "type")


@register("gen_multi_col_rule", f"""
SELECT "table", col, value, CAST(freq AS DOUBLE) AS freq, kind, group_idx, col_idx FROM ({_PART_RULES}) r""")
def q_gen_multi_col_rule(spark, sf):
    _, _, rules = _parsed(spark, sf)
    return rules.select("table", "col", "value", "freq", "kind", "group_idx", "col_idx")


@register("gen_rule_merge", f"""
SELECT "table", col, value, freq, kind,
       row_number() OVER (PARTITION BY "table", col ORDER BY line, group_idx, col_idx) - 1 AS rank
FROM (SELECT "table", col, value, CAST(max(freq) AS DOUBLE) AS freq,
             arg_min(kind, line * 10000 + group_idx * 100 + col_idx) AS kind,
             min(line) AS line, arg_min(group_idx, line * 10000 + group_idx * 100 + col_idx) AS group_idx,
             arg_min(col_idx, line * 10000 + group_idx * 100 + col_idx) AS col_idx
      FROM ({_PART_RULES}) r GROUP BY "table", col, value) m""")
def q_gen_rule_merge(spark, sf):
    _, _, rules = _parsed(spark, sf)
    return merge_rules(rules).select("table", "col", "value", "freq", "kind", "rank")
