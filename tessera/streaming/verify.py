"""Exact verification while the result streams in.

Result lines (keys, row_idx, line) meet their golden lines in a stream-static join and are judged in the JVM. A batch
is summed up within its tasks, so a target's state gets a few rows a batch however many lines the target has; the state
holds the counts so far and the first differing pair. A verdict row goes out whenever a batch has changed a target:
``complete`` once as many lines have come as the golden file has. ``last_verdicts`` reads the outcome.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.text import compile_pattern, match_compiled
from tessera.operators.verify import LINE_COUNT_DIFF, LINES_NOT_MATCH, PASS

PART = ("case_id long, n_out long, n_diff long, n_tgt long, first_diff_idx long, diff_line string, diff_pattern string")
STATE = "n_out long, n_diff long, first_diff_idx long, diff_line string, diff_pattern string"
OUT = PART + ", verdict string, complete boolean"


def _sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a target and batch of rows: counts, and its first differing pair."""
    for b in batches:
        g = b.groupby("case_id", sort=False)
        out = g.agg(n_out=("row_idx", "size"), n_diff=("differs", "sum"), n_tgt=("n_tgt", "first"))
        bad = b[b["differs"]]
        first = bad.loc[bad.groupby("case_id")["row_idx"].idxmin()].set_index("case_id")
        out = out.join(first[["row_idx", "line", "pattern"]])
        out = out.rename(columns={"row_idx": "first_diff_idx", "line": "diff_line", "pattern": "diff_pattern"})
        yield out.reset_index().astype({"first_diff_idx": "Int64", "n_diff": "int64"})


def verdict_stream(lines: DataFrame, golden: DataFrame) -> DataFrame:
    """Verdict rows of the targets that each batch of ``lines`` (a stream of case_id, row_idx, line) has changed.

    ``golden``: case_id, row_idx, pattern (a table, in the stream's session). Lines beyond the golden ones only count.
    """
    tgt = golden.select("case_id", "row_idx", "pattern", compile_pattern(F.col("pattern")).alias("rx"))
    n_tgt = golden.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_tgt"))
    line, pattern = F.col("line"), F.col("pattern")
    judged = (lines.join(tgt, ["case_id", "row_idx"], "left").join(n_tgt, "case_id", "left").select(
        "case_id", "row_idx", F.coalesce("n_tgt", F.lit(0)).cast("long").alias("n_tgt"), "line", "pattern",
        F.coalesce((line != pattern) & ~match_compiled(line, F.col("rx")), F.lit(False)).alias("differs")))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n_out, n_diff, *first = state.get if state.exists else (0, 0, None, None, None)
        n_tgt = 0
        for b in batches:
            n_out, n_diff, n_tgt = n_out + int(b["n_out"].sum()), n_diff + int(b["n_diff"].sum()), int(b["n_tgt"].iloc[0])
            bad = b[b["first_diff_idx"].notna()]
            if len(bad):
                r = bad.loc[bad["first_diff_idx"].idxmin()]
                if first[0] is None or r["first_diff_idx"] < first[0]:
                    first = [int(r["first_diff_idx"]), r["diff_line"], r["diff_pattern"]]
        state.update((n_out, n_diff, *first))
        verdict = LINE_COUNT_DIFF if n_out != n_tgt else LINES_NOT_MATCH if n_diff else PASS
        yield pd.DataFrame({"case_id": [int(key[0])], "n_out": [n_out], "n_diff": [n_diff], "n_tgt": [n_tgt],
                            "first_diff_idx": pd.array([first[0]], "Int64"), "diff_line": [first[1]],
                            "diff_pattern": [first[2]], "verdict": [verdict], "complete": [n_out >= n_tgt]})

    return (judged.mapInPandas(_sum_up, PART).groupBy("case_id")
            .applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout))


def last_verdicts(rows: DataFrame, golden: DataFrame) -> DataFrame:
    """The outcome of every target, as ``verify_exact`` gives it: the row with the most lines; targets without any line."""
    n = golden.groupBy("case_id").agg(F.count(F.lit(1)).alias("__n"))
    newest = Window.partitionBy("case_id").orderBy(F.col("n_out").desc())
    last = rows.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r")
    got = n.join(last, "case_id", "full_outer")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_out", "n_diff")}
    return got.select("case_id", zero["n_out"].alias("n_out"), F.coalesce("__n", F.lit(0)).alias("n_tgt"),
                      zero["n_diff"].alias("n_diff"), "first_diff_idx", "diff_line", "diff_pattern",
                      F.coalesce("verdict", F.lit(LINE_COUNT_DIFF)).alias("verdict"))
