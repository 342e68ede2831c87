"""Annotated SQL scripts as tables.

``lines``: file, n (line number), line. A script is a run of statements; text
after ``--`` is a directive (``key:value``). Statement boundaries depend on a
block state carried over lines (procedures, ``begin ... end;``), which is a
last-event-wins scan: inside a block after line i iff the last block event
(open / ``end;``) at or before i was an open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import jtrim, substitute

# Keywords of the script grammar (block openers / closer).
BLOCK_CREATORS = ("create", "replace")
BLOCK_OBJECTS = ("function", "procedure", "package")
BLOCK_STARTS = ("begin", "declare")
BLOCK_END = "end;"


def is_block(seg_lower: Column) -> Column:
    """A statement that opens a block: create/replace function|procedure|package, begin, declare."""
    creator = F.lit(False)
    for k in BLOCK_CREATORS:
        creator = creator | F.startswith(seg_lower, F.lit(k))
    obj = F.lit(False)
    for k in BLOCK_OBJECTS:
        obj = obj | F.contains(seg_lower, F.lit(k))
    start = F.lit(False)
    for k in BLOCK_STARTS:
        start = start | F.startswith(seg_lower, F.lit(k))
    return (creator & obj) | start


def split_comment(lines: DataFrame) -> DataFrame:
    """Per non-empty line: ``seg`` (text before the first ``--``) and ``comment``
    (text between the first and second ``--``; absent when nothing non-empty follows,
    as ``split("--")`` drops trailing empty pieces)."""
    line = F.col("line")
    dash = F.instr(line, "--")
    rest = F.when(dash > 0, F.expr("substring(line, instr(line, '--') + 2)"))
    has_comment = (dash > 0) & ~rest.rlike("^(--)*$")
    return (lines.where(F.length("line") > 0)
            .withColumn("seg", jtrim(F.substring_index(line, "--", 1)))
            .withColumn("comment", F.when(has_comment, jtrim(F.substring_index(rest, "--", 1)))))


def statements(lines: DataFrame) -> DataFrame:
    """Lines -> steps: (file, n, sql, comment).

    ``sql`` is the statement closed on line n ('' when the line closes none);
    comment-only lines stay as steps with empty sql; lines that are neither
    are dropped. Statement text = its lines' segments joined by newlines, trimmed.

    A script is a hand-written file, so one window per file (a single hash
    exchange; both scans share its sort) carries the block state and the
    running statement number. The text is then one aggregate per statement on
    the same partitioning, with no join back.
    """
    p = split_comment(lines)
    low = F.lower(F.col("seg"))
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    p = (p.withColumn("__open", is_block(low))
          .withColumn("__end", F.startswith(low, F.lit(BLOCK_END)))
          .withColumn("__ev", F.when(F.col("__open"), F.lit(1)).when(F.col("__end"), F.lit(0)))
          .withColumn("__in", F.last("__ev", ignorenulls=True).over(before)))
    inside = F.coalesce(F.col("__in"), F.lit(0)) == 1
    close = F.when(inside, F.col("__end")).otherwise(~F.col("__open") & F.endswith(low, F.lit(";")))
    p = (p.withColumn("__close", close)
          .withColumn("__stmt", F.coalesce(F.sum(F.col("__close").cast("int")).over(before), F.lit(0))))
    # the lines of one statement number: its own lines up to the one that closes it. Notes are the other lines of
    # the group with a comment; both come from the one aggregate
    line = F.struct("n", "seg", "comment", F.col("__close").alias("close"))
    g = p.groupBy("file", "__stmt").agg(F.array_sort(F.collect_list(line)).alias("l"))
    last = F.element_at("l", -1)
    sql = jtrim(F.array_join(F.transform("l", lambda x: x["seg"]), "\n"))
    closed = F.when(last["close"], F.array(F.struct(last["n"].alias("n"), sql.alias("sql"),
                                                    last["comment"].alias("comment")))).otherwise(F.array())
    notes = F.transform(F.filter("l", lambda x: ~x["close"] & x["comment"].isNotNull()),
                        lambda x: F.struct(x["n"].alias("n"), F.lit("").alias("sql"), x["comment"].alias("comment")))
    out = g.select("file", F.explode(F.concat(closed, notes)).alias("s")).select("file", "s.n", "s.sql", "s.comment")
    return out.where((F.col("sql") != "") | F.col("comment").isNotNull())


def directives(steps: DataFrame) -> DataFrame:
    """``key:value`` of each comment (key lower-cased and trimmed)."""
    parts = F.split(F.col("comment"), ":")
    return (steps.where(F.col("comment").isNotNull())
            .select("file", "n", "comment",
                    F.lower(jtrim(parts[0])).alias("key"),
                    F.when(F.size(parts) > 1, jtrim(parts[1])).alias("value")))


def _word(tokens: Column, i: int) -> Column:
    return F.lower(F.try_element_at(tokens, F.lit(i)))


def statement_class(steps: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Kind of statement: create table / external / view / stream, use application, other (and the columns ``keep``).

    A ``create stream`` resets its topic unless the comment says ``no-reset``.
    """
    toks = F.split(F.col("sql"), r"\s+")
    w = (steps.where(F.col("sql") != "")
         .select("file", "n", "comment", *keep, F.size(toks).alias("__k"), _word(toks, 1).alias("__t1"),
                 _word(toks, 2).alias("__t2"), _word(toks, 5).alias("__t5")))
    t1 = F.col("__t1")
    t2 = F.when(F.col("__t2") == "if", F.col("__t5")).otherwise(F.col("__t2"))
    create_kind = {"table": "create_table", "external": "create_external",
                   "view": "create_view", "stream": "create_stream"}
    cond = F.when(F.col("__k") < 2, "other")
    for word, k in create_kind.items():
        cond = cond.when((t1 == "create") & (t2 == word), k)
    kind = cond.when((t1 == "use") & (t2 == "application"), "use_application").otherwise("other")
    reset = (kind == "create_stream") & ~F.coalesce(F.contains(F.col("comment"), F.lit("no-reset")),
                                                   F.lit(False))
    return w.select("file", "n", *keep, kind.alias("kind"), reset.alias("reset"))


# Patterns of the script grammar.
CREATED_OBJECT_RX = r"(?is)create\s+(?:external\s+)?\S+\s+(?:if\s+not\s+exists\s+)?([^\s(]+)"
TOPIC_RX = r"""['"]topic['"]=['"](.+?)['"]"""
USE_APP_RX = r"^use application (.+);$"


def created_object(sql: Column) -> Column:
    """Object name after ``create [external] <kind> [if not exists]``, cut at ``(``."""
    v = F.regexp_extract(sql, CREATED_OBJECT_RX, 1)
    return F.when(v != "", v)


def topic_of(sql: Column) -> Column:
    """``"topic"="x"`` table property, lower-cased."""
    v = F.regexp_extract(F.lower(sql), TOPIC_RX, 1)
    return F.when(v != "", v)


def app_of(sql: Column) -> Column:
    v = F.regexp_extract(sql, USE_APP_RX, 1)
    return F.when(v != "", v)


def app_set(steps: DataFrame, default_app: Column, variables: Column | None = None) -> DataFrame:
    """Distinct ``use application X;`` names per file (variables resolved) plus the case's default app."""
    sql = F.col("sql") if variables is None else substitute(F.col("sql"), variables)
    apps = F.array_compact(F.array(app_of(sql), default_app))
    return steps.select("file", F.explode(apps).alias("app")).distinct()


def split_statement(steps: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Non-block text split on ``;`` (empties dropped); only the last piece's result is kept (with the columns ``keep``)."""
    low = F.lower(F.col("sql"))
    pieces = F.when(is_block(low), F.array(F.col("sql"))).otherwise(
        F.filter(F.split(F.col("sql"), ";"), lambda x: F.length(x) > 0))
    s = steps.where(F.col("sql") != "").select("file", "n", *keep, pieces.alias("__p"))
    return s.select("file", "n", *keep, F.posexplode("__p").alias("piece_idx", "piece"),
                    F.size("__p").alias("__k")) \
            .select("file", "n", *keep, F.col("piece_idx").cast("long").alias("piece_idx"), "piece",
                    (F.col("piece_idx") == F.col("__k") - 1).alias("is_last"))


def time_limit(lines: DataFrame, default_s: int = 30) -> DataFrame:
    """Per file: the last ``time:n`` comment wins (read order); default 30 s."""
    p = split_comment(lines)
    c = F.col("comment")
    t = F.when(F.startswith(F.lower(c), F.lit("time")),
               F.expr("try_cast(trim(split(comment, ':')[1]) AS INT)"))
    return (p.withColumn("__t", t).groupBy("file")
            .agg(F.max_by("__t", F.when(F.col("__t").isNotNull(), F.col("n"))).alias("__last"))
            .select("file", F.coalesce("__last", F.lit(default_s)).alias("limit_s")))


def stream_ids(steps: DataFrame, prefix: Column) -> DataFrame:
    """The k-th ``stream`` directive of a case starts stream ``<prefix>stream<k>``,
    also bound to variable ``stream<k>``."""
    key = F.lower(jtrim(F.split(F.col("comment"), ":")[0]))
    d = steps.where(key == "stream").select("file", "n", prefix.alias("__prefix"))
    k = d.withColumn("__k", F.row_number().over(Window.partitionBy("file").orderBy("n")))
    var = F.concat(F.lit("stream"), F.col("__k").cast("string"))
    return k.select("file", "n", var.alias("var"), F.concat(F.col("__prefix"), var).alias("stream_id"))


def with_globals(steps: DataFrame, settings: DataFrame) -> DataFrame:
    """Settings run before every case of their suite, after the app setup.

    Linear form: the suite's settings appear once (file null, negative steps
    in their order) next to the cases' own steps; a runner executes the
    suite's rows with step < 0 before each case. No case x setting product.
    """
    n_set = settings.groupBy("suite").agg(F.count(F.lit(1)).alias("__k"))
    s = (settings.join(n_set, "suite")
         .select("suite", F.lit(None).cast(steps.schema["file"].dataType).alias("file"),
                 (F.col("pos") - F.col("__k")).alias("step"), "sql"))
    c = steps.select("suite", "file", F.col("n").alias("step"), "sql")
    return c.unionByName(s)


def failed_scripts(steps: DataFrame, failed: DataFrame, variables: Column) -> DataFrame:
    """For failed cases, the SQL issued in order with variables resolved: (file, n, sql)."""
    return (steps.join(failed, "file", "left_semi")
            .select("file", "n", substitute(F.col("sql"), variables).alias("sql")))


def write_failed_scripts(scripts: DataFrame, path: str) -> str:
    """One folder per failed case holding its statements in order (one file a case: scripts are hand-written)."""
    (scripts.repartition("file").sortWithinPartitions("file", "n")
     .select("file", F.col("sql").alias("value")).write.mode("overwrite").partitionBy("file").text(path))
    return path
