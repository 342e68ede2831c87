"""Generator spec scripts as a text job.

Grammar (per non-empty, trimmed line)::

    table: <name> : <rows>
    row:{ <col> <type>, <col> <type>, ...}        (may span lines)
    (<col>, <col>) include|except|frequency (<v> <f>, <v> <f>; <v> <f>, ...)
    end;

Each file is read whole (spec files are small), split into numbered lines,
and every line's state (current table, inside a ``row:{`` block) comes from
windows per file. Output frames: tables, columns and raw rules, each with its
table's name, so nothing is joined back and lines that lie by ``file`` already
are not moved again; ``merge_rules`` applies "same value keeps the larger
frequency and the first kind".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import jtrim
from tessera.operators.generate import KINDS, TYPES, ColumnSpec, Rule, TableSpec, gen_table


def read_spec_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) from text files under ``path`` (one whole file per row)."""
    raw = spark.read.text(path, wholetext=True)
    file_col = "file" if "file" in raw.columns else None
    f = F.col(file_col) if file_col else F.input_file_name()
    return raw.select(f.alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))


def write_spec_lines(lines: DataFrame, path: str) -> str:
    """One text file per ``file`` value, lines in ``n`` order."""
    (lines.repartition("file").sortWithinPartitions("file", "n")
     .select("file", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("file").text(path))
    return path


def _states(lines: DataFrame) -> DataFrame:
    tok = jtrim(F.col("line"))
    l = lines.where(F.length("line") > 0).withColumn("tok", tok)
    w_prev = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    w_incl = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    is_table = F.startswith("tok", F.lit("table:"))
    is_end = F.endswith("tok", F.lit("end;"))
    row_start = F.startswith("tok", F.lit("row:{"))
    row_end = F.endswith("tok", F.lit("}"))
    l = (l.withColumn("__is_table", is_table)
          .withColumn("__tev", F.when(is_end, 0).when(is_table, 1))
          .withColumn("__rev", F.when(row_end, 0).when(row_start, 1))
          .withColumn("table_no", F.sum(is_table.cast("int")).over(w_incl))
          .withColumn("__head", F.last(F.when(is_table, F.col("tok")), ignorenulls=True).over(w_incl))
          .withColumn("__t_prev", F.last("__tev", ignorenulls=True).over(w_prev))
          .withColumn("__r_prev", F.last("__rev", ignorenulls=True).over(w_prev)))
    in_table = F.col("__is_table") | (F.coalesce("__t_prev", F.lit(0)) == 1)
    in_row = in_table & (row_start | (F.coalesce("__r_prev", F.lit(0)) == 1))
    row_after = in_row & ~row_end
    return (l.withColumn("in_table", in_table).withColumn("in_row", in_row)
             .withColumn("is_rule", in_table & ~row_after & (F.instr("tok", "(") > 0)))


def parse_specs(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """-> (tables, columns, rules) from (file, n, line)."""
    s = _states(lines)
    head = F.split(F.substring("__head", 7, 1 << 30), ":")
    table = jtrim(head[0]).alias("table")
    n_rows = F.coalesce(F.expr("try_cast(trim(split(substring(__head, 7), ':')[1]) AS BIGINT)"), F.raise_error(F.concat(
        F.lit("no row count for table "), jtrim(head[0]))).cast("long")).alias("n_rows")
    tables = s.where("__is_table").select("file", "table_no", table, n_rows)

    filled = lambda c, sep: F.filter(F.split(c, sep), lambda x: F.length(x) > 0)
    body = F.when(F.startswith("tok", F.lit("row:{")), F.substring("tok", 6, 1 << 30)).otherwise(F.col("tok"))
    body = F.when(F.endswith(body, F.lit("}")), F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    decl = F.filter(F.transform(filled(body, ","), lambda d: F.transform(filled(d, " "), lambda x: F.lower(jtrim(x)))),
                    lambda w: F.size(w) == 2)
    s = s.withColumn("__decl", F.when(F.col("in_row"), decl))
    columns = (s.where("in_row")
               .select("file", "table_no", table, n_rows, "n", F.posexplode("__decl").alias("k", "__w"))
               .withColumn("pos", F.row_number().over(Window.partitionBy("file", "table_no").orderBy("n", "k")) - 1)
               .select("file", "table_no", "table", "n_rows", "pos", F.col("__w")[0].alias("col"),
                       F.when(F.col("__w")[1].isin(*TYPES), F.col("__w")[1]).otherwise(
                           F.raise_error(F.concat(F.lit("unknown column type "), F.col("__w")[1]))).alias("type")))

    # rules on undeclared columns are ignored (column names compare case-insensitively)
    names = F.flatten(F.collect_list(F.transform("__decl", lambda w: w[0])).over(Window.partitionBy("file", "table_no")))
    r = (s.where(F.col("file").isNotNull()).select("file", "table_no", table, "n", "tok", "is_rule", names.alias("__names"))
         .where("is_rule"))
    shape = r"^[^(]*\(([^)]*)\)([^(]*)\(([^)]*)\)"  # (columns) kind (values)
    words = lambda group, sep: F.transform(F.filter(F.split(F.regexp_extract("tok", shape, group), sep),
                                                    lambda x: F.length(x) > 0), jtrim)
    r = (r.where(F.col("tok").rlike(shape))
         .select("file", "table_no", "table", "__names", "n", words(1, ",").alias("__cols"),
                 F.lower(jtrim(F.regexp_extract("tok", shape, 2))).alias("kind"), words(3, ";").alias("__groups"))
         .withColumn("kind", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(
             F.raise_error(F.concat(F.lit("unknown rule kind "), F.col("kind"))))))
    g = r.select("file", "table_no", "table", "__names", "n", "kind", "__cols",
                 F.posexplode("__groups").alias("group_idx", "__g"))
    e = g.select("file", "table_no", "table", "__names", "n", "kind", "group_idx", "__cols",
                 F.posexplode(F.transform(F.filter(F.split("__g", ","), lambda x: F.length(x) > 0),
                                          lambda x: jtrim(x))).alias("col_idx", "__e"))
    e = e.where(F.col("col_idx") < F.size("__cols"))
    vf = F.split("__e", " ")
    ok = (F.size(vf) == 2) | ((F.size(vf) == 1) & (F.col("kind") == "except"))
    rules = (e.where(ok).withColumn("col", F.lower(F.element_at("__cols", F.col("col_idx") + 1)))
             .where(F.array_contains("__names", F.col("col")))
             .select("file", "table_no", "table", "n", "group_idx", "col_idx", "col", vf[0].alias("value"),
                     F.when(F.size(vf) == 2, F.expr("try_cast(split(__e, ' ')[1] AS DOUBLE)")).alias("freq"),
                     "kind"))
    return tables, columns, rules


def merge_rules(rules: DataFrame) -> DataFrame:
    """Same value in one column: larger frequency, first kind; ``rank`` = order of first appearance."""
    seq = F.struct("n", "group_idx", "col_idx")
    m = rules.groupBy("file", "table_no", "table", "col", "value").agg(
        F.max("freq").alias("freq"), F.min_by("kind", seq).alias("kind"), F.min(seq).alias("__first"))
    return m.withColumn("rank", (F.row_number().over(
        Window.partitionBy("file", "table_no", "col").orderBy("__first")) - 1).cast("long")).drop("__first")


MAX_SPEC_ROWS = 100_000


def specs_from_frames(tables: DataFrame, columns: DataFrame, merged: DataFrame) -> list[TableSpec]:
    """A hand-written script's specs as ``TableSpec`` objects (refused beyond ``MAX_SPEC_ROWS`` rows)."""
    def rows(df):
        got = df.limit(MAX_SPEC_ROWS + 1).collect()
        if len(got) > MAX_SPEC_ROWS:
            raise ValueError(f"more than {MAX_SPEC_ROWS} rows of specs: generate from the frames instead")
        return got

    cols, rules = {}, {}
    for r in rows(columns):
        cols.setdefault((r["file"], r["table_no"]), []).append(r)
    for r in rows(merged):
        rules.setdefault((r["file"], r["table_no"], r["col"]), []).append(r)
    out = []
    for t in sorted(rows(tables), key=lambda t: (t["file"], t["table_no"])):
        key = (t["file"], t["table_no"])
        spec = TableSpec(t["table"], t["n_rows"])
        for c in sorted(cols.get(key, []), key=lambda x: x["pos"]):
            own = sorted(rules.get((*key, c["col"]), []), key=lambda x: x["rank"])
            spec.columns.append(ColumnSpec(c["col"], c["type"], [Rule(x["value"], x["freq"], x["kind"]) for x in own]))
        out.append(spec)
    return out


def generate_script(spark: SparkSession, path: str, seed: int = 42) -> dict[str, DataFrame]:
    """The tables that a spec script (or a folder of them) describes, by name."""
    tables, columns, rules = parse_specs(read_spec_lines(spark, path))
    return {s.name: gen_table(spark, s, seed=seed) for s in specs_from_frames(tables, columns, merge_rules(rules))}
