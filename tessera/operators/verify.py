"""Verifying query results against golden targets, many cases in one plan.

Inputs
------
out     keys..., row_idx, line       rendered result rows (positional)
tgt     keys..., row_idx, pattern    golden target lines
heads   keys...                      one row per target, also of those without lines or results

``keys`` identify a target (e.g. ``case_id`` or ``suite, case, target_idx``). ``verify_targets`` is the whole
path: the first line of a target says how it is verified, all modes are one plan, and every target gives a
verdict. Exact and row-count checks are one equi-join on (keys, row_idx) and one aggregate, so a giant case
is spread over many tasks; the ordered include check stores a case's rows in blocks and follows them part by part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import _META, compile_pattern, match_compiled, match_line, tokens
from tessera.operators.scan import row_index
from tessera.session import scratch_path, share

PASS = "Pass"
LINE_COUNT_DIFF = "LineCountDiff"
LINES_NOT_MATCH = "LinesNotMatch"
LINES_INCLUDE = "LinesInclude"
LINES_EXCLUDE = "LinesExclude"
DATA_NOT_RECEIVED = "DataNotReceived"
UNEXPECTED_SUCCESS = "UnexpectedSuccess"


def _line_diffs(out: DataFrame, tgt: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_idx, line, pattern, differs) by position; one side is null beyond the shorter."""
    t = tgt.select(*keys, "row_idx", "pattern", compile_pattern(F.col("pattern")).alias("__rx"))
    both = F.col("line").isNotNull() & F.col("pattern").isNotNull()
    return (out.select(*keys, "row_idx", "line").join(t, [*keys, "row_idx"], "full_outer")
            .select(*keys, "row_idx", "line", "pattern",
                    (both & (F.col("line") != F.col("pattern"))
                     & ~match_compiled(F.col("line"), F.col("__rx"))).alias("differs")))


def verify_exact(out: DataFrame, tgt: DataFrame, keys: Sequence[str] = ("case_id",),
                 heads: DataFrame | None = None) -> DataFrame:
    """Line counts equal, else LineCountDiff; every positional pair matches, else LinesNotMatch.

    One full outer join and one aggregate. ``diff_line`` and ``diff_pattern`` are the first differing pair.
    With ``heads``, targets without any line on either side are there, too (and pass).
    """
    keys = list(keys)
    bad = F.when(F.col("differs"), F.col("row_idx"))
    res = (_line_diffs(out, tgt, keys).groupBy(*keys)
           .agg(F.count("line").alias("n_out"), F.count("pattern").alias("n_tgt"),
                F.count_if("differs").alias("n_diff"), F.min(bad).alias("first_diff_idx"),
                F.min_by(F.struct("line", "pattern"), bad).alias("__pair")))
    if heads is not None:
        res = heads.select(*keys).join(res, keys, "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n_out", "n_tgt", "n_diff")}
    verdict = (F.when(n["n_out"] != n["n_tgt"], LINE_COUNT_DIFF)
                .when(n["n_diff"] > 0, LINES_NOT_MATCH).otherwise(PASS))
    return res.select(*keys, *[x.alias(c) for c, x in n.items()], "first_diff_idx",
                      F.col("__pair.line").alias("diff_line"), F.col("__pair.pattern").alias("diff_pattern"),
                      verdict.alias("verdict"))


def exact_diffs(out: DataFrame, tgt: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """All (output, target) pairs that do not match, as rows (the failure report; never collected)."""
    keys = list(keys)
    return _line_diffs(out, tgt, keys).where("differs").drop("differs")


def verify_rows(out: DataFrame, expected: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """``# rows N``: only the count. Cases with no output rows count 0."""
    keys = list(keys)
    n_out = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_out"))
    res = expected.join(n_out, keys, "left")
    n = F.coalesce("n_out", F.lit(0))
    return res.select(*keys, "expected_rows", n.alias("n_out"),
                      F.when(n == F.col("expected_rows"), PASS).otherwise(LINE_COUNT_DIFF).alias("verdict"))


def verify_exclude(out: DataFrame, tgt: DataFrame, keys: Sequence[str] = ("case_id",),
                   heads: DataFrame | None = None) -> DataFrame:
    """Pass iff no output line matches the target's first line.

    (The reference's pointer only moves on a match, so only target line 0 is ever tested.) The
    first-line side has one row per target; its pattern is judged there. Without lines a target passes.
    """
    keys = list(keys)
    first = (tgt.groupBy(*keys).agg(F.min_by("pattern", "row_idx").alias("pattern"))
             .select(*keys, compile_pattern(F.col("pattern")).alias("__rx")))
    hits = (out.join(first, keys).where(match_compiled(F.col("line"), F.col("__rx")))
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hits")))
    res = (first if heads is None else heads).select(*keys).join(hits, keys, "left")
    n = F.coalesce("n_hits", F.lit(0))
    return res.select(*keys, n.alias("n_hits"),
                      F.when(n == 0, PASS).otherwise(LINES_EXCLUDE).alias("verdict"))


def verify_error(outcome: DataFrame, tgt: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """A step expected to fail: its message is verified like a result of one line.

    ``outcome``: keys, error (message, null when the step succeeded).
    ``tgt``: keys, row_idx, pattern (all lines of the error target).
    """
    keys = list(keys)
    t = tgt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tgt"),
                               F.min_by("pattern", "row_idx").alias("pattern"))
    j = outcome.join(t, keys, "left")
    verdict = (F.when(F.col("error").isNull(), UNEXPECTED_SUCCESS)
                .when(F.coalesce("n_tgt", F.lit(0)) != 1, LINE_COUNT_DIFF)
                .when(match_line(F.col("error"), F.col("pattern")), PASS)
                .otherwise(LINES_NOT_MATCH))
    return j.select(*keys, "error", verdict.alias("verdict"))


def target_mode(header: DataFrame, col: str = "header") -> DataFrame:
    """Mode of a target from its first line (``# ...``).

    ``rows`` wins; then the last keyword hit among include, exclude,
    data-received (checked in that order, later wins); no ``#`` -> match.
    Keyword positions must be > 0 as in ``indexOf(kw) > 0`` (instr is 1-based).
    """
    h = F.col(col)
    hit = lambda kw: F.instr(h, kw) > 1
    is_hdr = F.startswith(h, F.lit("#"))
    mode = (F.when(~is_hdr | h.isNull(), "match").when(hit("rows"), "rows")
             .when(hit("data-received"), "data-received").when(hit("exclude"), "exclude")
             .when(hit("include"), "include").otherwise("match"))
    words = F.split(h, r"\s+")
    return header.select(
        "*", mode.alias("mode"),
        F.when(mode == "rows", F.expr(f"try_cast(trim(substring({col}, instr({col}, 'rows') + 4)) AS INT)"))
         .alias("rows"),
        F.when(mode == "data-received", F.try_element_at(words, F.lit(3))).alias("topic"),
        F.when(mode == "data-received", F.try_element_at(words, F.lit(4))).alias("table"))


def verify_targets(out: DataFrame, heads: DataFrame, tgt: DataFrame, keys: Sequence[str] = ("case_id",),
                   lags: DataFrame | None = None) -> DataFrame:
    """One verdict per row of ``heads``, each target verified in the mode its first line asks for.

    ``lags`` (topic, verdict; from ``consumer_lag``) answers data-received targets; a topic that is not in it
    has not received its data. Output: keys, mode, n_out, verdict, message (null where it passes).
    """
    keys = list(keys)
    at = lambda i: F.max(F.when(F.col("row_idx") == i, F.col("pattern")))
    head = tgt.where(F.col("row_idx") <= 1).groupBy(*keys).agg(at(0).alias("header"), at(1).alias("__first"))
    modes = target_mode(heads.select(*keys).join(head, keys, "left"))
    only = lambda df, mode: df.join(modes.where(F.col("mode") == mode).select(*keys), keys, "left_semi")

    # all modes but include: a row meets its target's mode once and, in an exact target, its golden line
    unwanted = F.when(F.col("mode") == "exclude", compile_pattern(F.col("__first"))).alias("__not")
    rows = (out.select(*keys, "row_idx", "line").join(modes.select(*keys, unwanted), keys)
            .select(*keys, "row_idx", "line", match_compiled(F.col("line"), F.col("__not")).alias("__hit")))
    golden = only(tgt, "match").select(*keys, "row_idx", "pattern", compile_pattern(F.col("pattern")).alias("__rx"))
    line, pattern = F.col("line"), F.col("pattern")
    differs = (line.isNotNull() & pattern.isNotNull() & (line != pattern) & ~match_compiled(line, F.col("__rx")))
    bad = F.when(F.col("__differs"), F.col("row_idx"))
    exact = (rows.join(golden, [*keys, "row_idx"], "full_outer")
             .select(*keys, "row_idx", "line", "pattern", "__hit", differs.alias("__differs"))
             .groupBy(*keys).agg(F.count("line").alias("n_out"), F.count("pattern").alias("__n_tgt"),
                                 F.count_if("__differs").alias("__n_diff"), F.min(bad).alias("__at"),
                                 F.min_by(F.struct("line", "pattern"), bad).alias("__pair"),
                                 F.count_if("__hit").alias("__n_hits")))
    body = only(tgt, "include").where(F.col("row_idx") > 0).withColumn("row_idx", F.col("row_idx") - 1)
    inc = verify_include(only(out, "include"), body, keys, modes.where(F.col("mode") == "include"))
    got = (modes.join(exact, keys, "left")
           .join(inc.select(*keys, F.col("n_targets").alias("__want"), F.col("n_matched").alias("__found")), keys, "left"))
    text = lambda c: F.col(c).cast("string")
    n, n_tgt, n_diff, n_hits = (F.coalesce(c, F.lit(0)) for c in ("n_out", "__n_tgt", "__n_diff", "__n_hits"))
    of = {"match": (F.when(n != n_tgt, LINE_COUNT_DIFF).when(n_diff > 0, LINES_NOT_MATCH).otherwise(PASS), F.when(
              n != n_tgt, F.concat_ws("", n.cast("string"), F.lit(" lines, expected "), n_tgt.cast("string"))).when(
              n_diff > 0, F.concat_ws("", F.lit("line "), text("__at"), F.lit(": "), F.col("__pair.line"), F.lit(" | "),
                                      F.col("__pair.pattern")))),
          "include": (F.when(F.col("__want") == F.col("__found"), PASS).otherwise(LINES_INCLUDE), F.when(
              F.col("__want") != F.col("__found"),
              F.concat_ws("", text("__found"), F.lit(" of "), text("__want"), F.lit(" lines found in order")))),
          "exclude": (F.when(n_hits == 0, PASS).otherwise(LINES_EXCLUDE), F.when(
              n_hits > 0, F.concat_ws("", n_hits.cast("string"), F.lit(" excluded lines"))))}
    pick = lambda i: F.coalesce(*[F.when(F.col("mode") == m, x[i]) for m, x in of.items()])
    got = got.withColumns({"verdict": pick(0), "message": pick(1)})
    if lags is None:
        got = got.withColumn("__lag", F.lit(None).cast("string"))
    else:
        got = got.join(lags.select(F.col("topic"), F.col("verdict").alias("__lag")).distinct(), "topic", "left")
    verdict = (F.when(F.col("mode") == "rows", F.when(n == F.col("rows"), PASS).otherwise(LINE_COUNT_DIFF))
                .when(F.col("mode") == "data-received", F.coalesce("__lag", F.lit(DATA_NOT_RECEIVED)))
                .otherwise(F.col("verdict")))
    message = (F.when((F.col("mode") == "rows") & ~n.eqNullSafe(F.col("rows")),
                      F.concat_ws("", n.cast("string"), F.lit(" lines, expected "), F.col("rows").cast("string")))
                .when((F.col("mode") == "data-received") & (verdict != PASS), F.lit("data has not all received"))
                .otherwise(F.col("message")))
    return got.select(*keys, "mode", n.alias("n_out"), verdict.alias("verdict"), message.alias("message"))


def case_outcome(verdicts: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """The first target (by index) that does not pass decides the case; its message goes with it if there is one."""
    keys = list(keys)
    bad = F.when(F.col("verdict") != PASS, F.col("target_idx"))
    note = F.col("message") if "message" in verdicts.columns else F.lit(None).cast("string")
    return (verdicts.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_targets"), F.min(bad).alias("failed_target"),
                 F.min_by(F.struct(F.col("verdict"), note.alias("message")), bad).alias("__first"))
            .select(*keys, F.col("failed_target").isNull().alias("passed"), "failed_target",
                    F.col("__first.verdict").alias("failed_verdict"), F.col("__first.message").alias("failed_message"),
                    F.coalesce("failed_target", "n_targets").alias("targets_passed")))


def eventually_pass(snapshots: DataFrame, n_targets: int, limit_ms: int,
                    keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Sticky polling: target k can only pass at or after the poll where k-1 passed.

    ``snapshots``: keys, poll_ms, passing_target. Polls after ``limit_ms`` are
    ignored. One keyed ``min`` aggregation per target (targets per case are a
    handful), so no case's polls are ever gathered in one place.
    """
    keys = list(keys)
    s = snapshots.where(F.col("poll_ms") <= limit_ms)
    cases = snapshots.select(*keys).distinct()
    reached = None
    prev = None
    for k in range(n_targets):
        cand = s.where(F.col("passing_target") == k)
        if prev is not None:
            cand = cand.join(prev, keys).where(F.col("poll_ms") >= F.col("__t"))
        cur = cand.groupBy(*keys).agg(F.min("poll_ms").alias("__t"))
        tag = cur.select(*keys, F.lit(k + 1).alias(f"__r{k}"), F.col("__t").alias(f"__t{k}"))
        reached = tag if reached is None else reached.join(tag, keys, "left")
        prev = cur
    res = cases.join(reached, keys, "left")
    r = F.greatest(*[F.coalesce(f"__r{k}", F.lit(0)) for k in range(n_targets)])
    return res.select(*keys, r.alias("reached"), (r == n_targets).alias("passed"),
                      F.col(f"__t{n_targets - 1}").alias("pass_ms"))


# ------------------------------------------------------------------ include
MIN_BLOCK = 4096  # matched rows a block
BLOCKS = 256  # blocks a part: what a task holds of a target at once


def golden_lines(tgt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, __k, pattern, class): a target's lines by their place. Equal lines are one class: the place of the first."""
    at = row_index(tgt.select(*keys, "row_idx", "pattern"), keys, "row_idx", "__k", ["pattern"])
    first = at.groupBy(*keys, "pattern").agg(F.min("__k").alias("class"))
    return at.join(first, [*keys, "pattern"], "left").select(*keys, "__k", "pattern", "class")


def matched_rows(out: DataFrame, golden: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, row_idx, classes): output rows that match some target line, by the lines' class numbers.

    Lines that match as text meet by an equi-join on their tokens. A line with regular expressions meets, by an equi-join
    too, the rows that have as many tokens and its first plain token in its place (without any plain token: the rows with
    as many tokens); only those are tested.
    """
    keys = list(keys)
    key = lambda c: F.array_join(tokens(F.col(c)), " ")
    lines = golden.where(F.col("class") == F.col("__k")).select(
        *keys, "class", key("pattern").alias("__text"),
        F.col("pattern").rlike(_META).alias("__meta"), compile_pattern(F.col("pattern")).alias("__rx"))
    rows = out.select(*keys, "row_idx", "line", key("line").alias("__text"))
    plain = rows.join(lines.drop("__meta", "__rx"), [*keys, "__text"]).select(*keys, "row_idx", "class")
    fixed = F.filter(F.transform("__rx", lambda t, i: F.when(t["rx"].isNull(), F.struct(i.alias("at"), t["text"].alias("text")))),
                     lambda x: x.isNotNull())
    probe = F.coalesce(F.get(fixed, F.lit(0)), F.struct(F.lit(-1).alias("at"), F.lit("").alias("text")))
    rx = (lines.where("__meta").select(*keys, "class", "__rx", F.col("__text").alias("__own"), F.size("__rx").alias("__k"),
                                       probe.alias("__p"))
          .select("*", F.col("__p.at").alias("__at"), F.col("__p.text").alias("__token")).drop("__p"))
    places = rx.select(*keys, "__k", "__at").distinct()
    told = rows.withColumn("__tokens", tokens(F.col("line"))).withColumn("__k", F.size("__tokens"))
    told = told.join(places, [*keys, "__k"]).withColumn(
        "__token", F.when(F.col("__at") < 0, "").otherwise(F.get("__tokens", F.col("__at"))))
    other = (told.join(rx, [*keys, "__k", "__at", "__token"])
             .where((F.col("__text") != F.col("__own")) & match_compiled(F.col("line"), F.col("__rx")))
             .select(*keys, "row_idx", "class"))
    return plain.unionByName(other).groupBy(*keys, "row_idx").agg(F.collect_set("class").alias("classes"))


def _in_order(no: str, what: str):
    return F.transform(F.array_sort(F.collect_list(F.struct(no, what))), lambda x: x[what])


def verify_include(out: DataFrame, tgt: DataFrame, keys: Sequence[str] = ("case_id",),
                   heads: DataFrame | None = None) -> DataFrame:
    """Target lines must occur in the output in order (greedy subsequence).

    The matched rows of a target are stored by blocks of ``MIN_BLOCK`` class sets, and followed a part of ``BLOCKS``
    blocks after the other, all targets at once. A part meets only the lines that it can reach, from where the part
    before has ended, so a task holds a part and as many lines of a target however large it is. Output: keys,
    n_targets, n_matched, verdict; without lines a target passes.
    """
    keys, spark = list(keys), out.sparkSession
    golden = share(golden_lines(tgt, keys))
    rows = matched_rows(out, golden, keys)
    path = scratch_path(spark, "matched")
    rows.write.parquet(path)
    rows = row_index(spark.read.schema(rows.schema).parquet(path), keys, "row_idx", "__i")
    blocks = (rows.groupBy(*keys, F.floor(F.col("__i") / MIN_BLOCK).alias("__block"))
              .agg(_in_order("__i", "classes").alias("__rows"))
              .withColumn("__part", F.floor(F.col("__block") / BLOCKS)))
    path = scratch_path(spark, "blocks")
    blocks.write.partitionBy("__part").parquet(path)
    blocks = spark.read.schema(blocks.schema).parquet(path)
    parts = blocks.agg(F.max("__part")).first()[0]

    sizes = golden.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_targets"))
    ends = sizes.select(*keys, F.lit(0).cast("long").alias("__p"))
    step = lambda p, r: F.when(F.array_contains(r, F.get("__want", p)), p + 1).otherwise(p)
    for part in range(0 if parts is None else parts + 1):
        want = golden.join(ends, keys).where(F.col("__k").between(F.col("__p"), F.col("__p") + BLOCKS * MIN_BLOCK - 1))
        want = (want.groupBy(*keys, "__p", F.floor(F.col("__k") / MIN_BLOCK).alias("__b"))
                .agg(_in_order("__k", "class").alias("__lines"))
                .groupBy(*keys, "__p").agg(F.flatten(_in_order("__b", "__lines")).alias("__want")))
        here = (blocks.where(F.col("__part") == part).groupBy(*keys).agg(_in_order("__block", "__rows").alias("__blocks"))
                .join(want, keys)
                .select(*keys, (F.col("__p") + F.aggregate("__blocks", F.lit(0), lambda p, b: F.aggregate(b, p, step)))
                        .alias("__to")))
        ends = ends.join(here, keys, "left").select(*keys, F.coalesce("__to", "__p").alias("__p"))
        if part < parts:
            ends = share(ends)
    res = (sizes if heads is None else heads.select(*keys).join(sizes, keys, "left")).join(ends, keys, "left")
    n_t, n_m = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n_targets", "__p"))
    return res.select(*keys, n_t.alias("n_targets"), n_m.alias("n_matched"),
                      F.when(n_t == n_m, PASS).otherwise(LINES_INCLUDE).alias("verdict"))
