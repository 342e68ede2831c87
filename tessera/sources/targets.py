"""Golden target files -> targets.

Lines between ``### ... start`` and ``### ... end`` fences form a target. A target counts when an end fence is
seen (an unclosed one is dropped); every end fence emits what was gathered since the last start, so an end
without lines before it is an empty target; a file with no end fence is one target made of all its lines, and so
is a file without lines. Golden files are written by hand: one window pass per file gives fence state, target
number and row position together, after a single exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import substitute

HEAD = -1  # row_idx of a target's header row


def read_targets(lines: DataFrame, variables: Column | None = None, files: DataFrame | None = None) -> DataFrame:
    """(file, n, line) -> (file, target_idx, row_idx, line), with one header row (``row_idx`` -1, no line) per target.

    ``variables`` (a map) is substituted in every line; ``files`` (file) names all golden files, so that
    those without lines are targets, too.
    """
    if variables is not None:
        lines = lines.withColumn("line", substitute(F.col("line"), variables))
    fence = F.startswith("line", F.lit("###"))
    start, end = fence & (F.instr("line", "start") > 1), fence & (F.instr("line", "end") > 1)
    upto = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c, w: F.sum(F.col(c).cast("long")).over(w)
    s = (lines.select("file", "n", "line", fence.alias("fence"), start.alias("start"), end.alias("end"))
         .select("*", count("start", upto).alias("no"), count("end", upto).alias("ends"),
                 F.last(F.when(F.col("end"), 0).when(F.col("start"), 1), ignorenulls=True).over(upto).alias("open"),
                 F.sum(F.lit(1).cast("long")).over(upto).alias("place"),
                 count("end", Window.partitionBy("file")).alias("file_ends")))
    own = Window.partitionBy("file", "no")
    s = (s.withColumn("inside", ~F.col("fence") & (F.coalesce("open", F.lit(0)) == 1))
         .select("*", count("inside", own.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)).alias("at"),
                 count("end", own).alias("own_ends")))
    row = lambda t, i, line: F.struct(t.cast("long").alias("target_idx"), i.cast("long").alias("row_idx"),
                                      line.alias("line"))
    head, line, none = F.lit(HEAD), F.col("line"), F.lit(None).cast("string")
    whole = F.col("file_ends") == 0
    out = (F.when(whole & (F.col("place") == 1), F.array(row(F.lit(0), head, none), row(F.lit(0), F.lit(0), line)))
            .when(whole, F.array(row(F.lit(0), F.col("place") - 1, line)))
            .when(F.col("end"), F.array(row(F.col("ends") - 1, head, none)))
            # as often as end fences follow before the next start
            .when(F.col("inside") & (F.col("own_ends") > 0), F.transform(
                F.sequence(F.lit(0), F.col("own_ends") - 1), lambda k: row(F.col("ends") + k, F.col("at") - 1, line))))
    got = s.select("file", F.explode(out).alias("t")).select("file", "t.target_idx", "t.row_idx", "t.line")
    if files is not None:
        empty = files.select("file").distinct().join(lines.select("file"), "file", "left_anti")
        got = got.unionByName(empty.select("file", F.lit(0).cast("long").alias("target_idx"),
                                           F.lit(HEAD).cast("long").alias("row_idx"), none.alias("line")))
    return got


def heads_and_lines(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, target_idx) of every target, and its lines as (file, target_idx, row_idx, pattern)."""
    lines = targets.where(F.col("row_idx") >= 0).withColumnRenamed("line", "pattern")
    return targets.where(F.col("row_idx") == HEAD).select("file", "target_idx"), lines
