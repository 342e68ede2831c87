"""Test-tree and run-folder paths as tables.

A suite is a folder holding both ``sql`` and ``result`` folders; discovery
stops below a suite. Paths are rows (``path`` relative to a root), so the
tree walk becomes: every ancestor folder of every file (bounded by depth),
keyed aggregation per folder, and an anti-join against suite ancestors.
Prefix relations ("below this folder") are turned into equi-joins on
exploded ancestor prefixes instead of non-equi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import share


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Recursive file listing (path only; file contents are never read)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(root).select("path")


def _ancestors(rel: Column) -> Column:
    """Array of the proper ancestor folders of a relative path: a, a/b, ..."""
    segs = F.split(rel, "/")
    # sequence(1, 0) would count down: a path without a parent has no ancestors
    return F.when(F.size(segs) > 1, F.transform(F.sequence(F.lit(1), F.size(segs) - 1),
                                                lambda i: F.array_join(F.slice(segs, 1, i), "/"))
                  ).otherwise(F.array().cast("array<string>"))


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def find_suites(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Suites among relative file paths: (suite_dir, suite, parallel, n_cases).

    ``suite`` = relative folder with '/' -> '_'; ``parallel`` when ``p.txt`` is
    present; ``n_cases`` counts files in ``sql/`` whose name ends with ``sql``.
    Every file says what it tells about which folder; one keyed aggregate gathers that.
    """
    rel = F.col(path_col)
    folder, name = _parent(rel), F.element_at(F.split(rel, "/"), -1)
    tells = lambda d, sql=False, result=False, p=False, n=0: F.struct(
        d.alias("suite_dir"), F.lit(sql).alias("sql"), F.lit(result).alias("result"), F.lit(p).alias("p"), F.lit(n).alias("n"))
    marks = [F.when(F.endswith(a, F.lit(f"/{k}")), tells(_parent(a), **{k: True}))
             for k in ("sql", "result") for a in (F.col("anc"),)]
    above = files.select(rel, F.explode(_ancestors(rel)).alias("anc"))
    told = above.select(F.explode(F.array_compact(F.array(*marks))).alias("t")).unionByName(files.select(F.explode(
        F.array_compact(F.array(
            F.when(name == "p.txt", tells(folder, p=True)),
            F.when(F.endswith(folder, F.lit("/sql")) & F.endswith(name, F.lit("sql")), tells(_parent(folder), n=1))))).alias("t")))
    cand = (told.select("t.*").where("suite_dir <> ''").groupBy("suite_dir")
            .agg(F.bool_or("sql").alias("sql"), F.bool_or("result").alias("result"), F.bool_or("p").alias("parallel"),
                 F.sum("n").alias("n_cases")).where(F.col("sql") & F.col("result")))
    # discovery stops below a suite: drop candidates with a candidate ancestor
    anc = cand.select("suite_dir", F.explode(_ancestors(F.col("suite_dir"))).alias("anc"))
    nested = anc.join(cand.select(F.col("suite_dir").alias("anc")), "anc", "left_semi").select("suite_dir")
    return (cand.join(nested, "suite_dir", "left_anti")
            .select("suite_dir", F.regexp_replace("suite_dir", "/", "_").alias("suite"), "parallel", "n_cases"))


def suite_cases(files: DataFrame, suites: DataFrame, path_col: str = "path") -> DataFrame:
    """(suite_dir, case): script base names in each suite's ``sql`` folder."""
    rel = F.col(path_col)
    fdir = F.regexp_extract(rel, r"^(.*)/sql/[^/]+$", 1)
    fname = F.element_at(F.split(rel, "/"), -1)
    c = (files.where(F.endswith(fname, F.lit("sql")) & (fdir != ""))
         .select(fdir.alias("suite_dir"), F.regexp_replace(fname, r"\.[^.]*$", "").alias("case")))
    return c.join(suites.select("suite_dir"), "suite_dir", "left_semi")


def filter_cases(cases: DataFrame, include: DataFrame | None) -> DataFrame:
    """Apply an include list (line_no, line) to (suite_dir, case).

    A line naming a suite, or a folder above suites, selects all their cases
    and resets any case list gathered before it; ``suite/case`` adds one case.
    No list -> everything.
    """
    if include is None:
        return cases
    cases = share(cases)  # a table: the list is matched with it in several ways
    # suite / folder lines: equi-join on each suite's folder and its ancestors
    scopes = cases.select("suite_dir").distinct().select("suite_dir", F.explode(F.array_union(
        F.array("suite_dir"), _ancestors(F.col("suite_dir")))).alias("line"))
    resets = include.join(scopes, "line").groupBy("suite_dir").agg(F.max("line_no").alias("__reset"))
    case_lines = include.join(scopes.select("line"), "line", "left_anti").select(
        "line_no", _parent(F.col("line")).alias("suite_dir"), F.element_at(F.split("line", "/"), -1).alias("case"))
    picked = (case_lines.join(resets, "suite_dir", "left")
              .where(F.col("__reset").isNull() | (F.col("line_no") > F.col("__reset")))
              .groupBy("suite_dir", "case").agg(F.lit(True).alias("__picked")))
    some = picked.groupBy("suite_dir").agg(F.lit(True).alias("__some"))
    return (cases.join(resets, "suite_dir", "left").join(some, "suite_dir", "left")
            .join(picked, ["suite_dir", "case"], "left")
            .where(F.col("__picked") | (F.col("__reset").isNotNull() & F.col("__some").isNull()))
            .select("suite_dir", "case"))


def run_stamp(path: Column) -> Column:
    """Time token of a run folder: last '-' part of the second-to-last path segment."""
    seg = F.element_at(F.split(path, "/"), -2)
    return F.element_at(F.split(seg, "-"), -1)


def latest_run(run_dirs: DataFrame, stream_ids: DataFrame, path_col: str = "path") -> DataFrame:
    """Per stream id, the greatest run folder whose name starts with it.

    ``startswith`` becomes an equi-join on prefixes of the folder names, of only those lengths that ids have (a
    handful); the per-id ``max`` is map-side combined.
    """
    ids = stream_ids.select("stream_id").distinct()
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    lengths = ids.agg(F.collect_set(F.length("stream_id")).alias("__lengths"))  # one row
    pref = (run_dirs.select(path_col, name.alias("__name")).join(F.broadcast(lengths))
            .select(path_col, F.explode(F.transform(F.filter("__lengths", lambda n: n <= F.length("__name")),
                                                    lambda n: F.substring("__name", F.lit(1), n))).alias("stream_id")))
    return pref.join(ids, "stream_id").groupBy("stream_id").agg(F.max(path_col).alias("latest_path"))
