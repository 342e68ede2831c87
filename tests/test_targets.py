from pyspark.sql import functions as F

from tessera.sources.targets import heads_and_lines, read_targets

FILES = {
    "plain": ["1 2", "### note", "3"],
    "fenced": ["before", "### 0 start", "a", "### note", "b", "### 0 end", "between", "### 1 start", "### 1 end",
               "### 2 start", "lost", "### 3 start", "${v}", "### 3 end", "### again end", "### 4 start", "open"],
    "bare": ["x", "### end", "y"],
}
WANT = {
    ("plain", 0): ["1 2", "### note", "3"], ("fenced", 0): ["a", "b"], ("fenced", 1): [], ("fenced", 2): ["V"],
    ("fenced", 3): ["V"], ("bare", 0): [], ("none", 0): [],
}


def test_targets_of_all_shapes(spark):
    rows = [(f, 10 * i, x) for f, xs in FILES.items() for i, x in enumerate(xs)]
    lines = spark.createDataFrame(rows, "file string, n long, line string").repartition(4)
    files = spark.createDataFrame([(f,) for f in [*FILES, "none"]], "file string")
    got = read_targets(lines, F.create_map(F.lit("v"), F.lit("V")), files)
    heads, body = heads_and_lines(got)
    found = {(r.file, r.target_idx): [] for r in heads.collect()}
    assert heads.count() == len(found)
    for r in sorted(body.collect(), key=lambda r: (r.file, r.target_idx, r.row_idx)):
        assert r.row_idx == len(found[(r.file, r.target_idx)])
        found[(r.file, r.target_idx)].append(r.pattern)
    assert found == WANT
