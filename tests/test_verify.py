import pytest
from pyspark.sql import functions as F

from tessera.operators import verify as vf


def _out(spark, rows):
    return spark.createDataFrame(rows, "case_id long, row_idx long, line string")


def _tgt(spark, rows):
    return spark.createDataFrame(rows, "case_id long, row_idx long, pattern string")


def test_exact_counts_and_diffs(spark):
    out = _out(spark, [(1, 0, "a 1"), (1, 1, "b 2"), (2, 0, "x"), (3, 0, "y")])
    tgt = _tgt(spark, [(1, 0, "a [0-9]"), (1, 1, "b 3"), (2, 0, "x"), (2, 1, "z"), (3, 0, "y")])
    got = {r.case_id: (r.verdict, r.n_diff, r.first_diff_idx) for r in vf.verify_exact(out, tgt).collect()}
    assert got == {1: ("LinesNotMatch", 1, 1), 2: ("LineCountDiff", 0, None), 3: ("Pass", 0, None)}


def test_include_is_ordered_greedy(spark):
    out = _out(spark, [(1, i, s) for i, s in enumerate(["a", "c", "b", "c", "d"])]
               + [(2, i, s) for i, s in enumerate(["b", "a"])])
    tgt = _tgt(spark, [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")] + [(2, 0, "a"), (2, 1, "b")]
               + [(3, 0, "q")])
    got = {r.case_id: (r.verdict, r.n_matched) for r in vf.verify_include(out, tgt).collect()}
    assert got == {1: ("Pass", 3), 2: ("LinesInclude", 1), 3: ("LinesInclude", 0)}


def test_exclude_tests_only_first_target_line(spark):
    out = _out(spark, [(1, 0, "a"), (1, 1, "b"), (2, 0, "z")])
    tgt = _tgt(spark, [(1, 0, "q"), (1, 1, "b"), (2, 0, "z")])
    got = {r.case_id: r.verdict for r in vf.verify_exclude(out, tgt).collect()}
    assert got == {1: "Pass", 2: "LinesExclude"}


def test_target_mode(spark):
    h = spark.createDataFrame([("# include",), ("# exclude include",), ("# rows 5",), ("#rows 5",),
                               ("1 2 3",), ("# data-received topic_a t1",), ("include",)], "header string")
    got = [(r.mode, r.rows, r.topic) for r in vf.target_mode(h).collect()]
    assert got == [("include", None, None), ("exclude", None, None), ("rows", 5, None), ("rows", 5, None),
                   ("match", None, None), ("data-received", None, "topic_a"), ("match", None, None)]


def test_eventually_is_sticky_and_limited(spark):
    s = spark.createDataFrame([(1, 0, 1), (1, 2000, 0), (1, 4000, 1), (1, 6000, 2),
                               (2, 0, 0), (2, 2000, 1), (2, 40000, 2)],
                              "case_id long, poll_ms long, passing_target int")
    got = {r.case_id: (r.reached, r.passed, r.pass_ms) for r in vf.eventually_pass(s, 3, 30000).collect()}
    assert got == {1: (3, True, 6000), 2: (2, False, None)}


def test_case_outcome_first_failure_decides(spark):
    v = spark.createDataFrame([(1, 0, "Pass"), (1, 1, "LinesNotMatch"), (1, 2, "LineCountDiff"),
                               (2, 0, "Pass")], "case_id long, target_idx long, verdict string")
    got = {r.case_id: (r.passed, r.failed_target, r.failed_verdict) for r in vf.case_outcome(v).collect()}
    assert got == {1: (False, 1, "LinesNotMatch"), 2: (True, None, None)}


@pytest.mark.parametrize("blocks", [256, 3])
def test_include_in_blocks_equals_a_plain_scan(spark, monkeypatch, blocks):
    import random
    monkeypatch.setattr(vf, "MIN_BLOCK", 5)
    monkeypatch.setattr(vf, "BLOCKS", blocks)
    r = random.Random(2)
    words = ["a", "b", "c 1", "c 2", "x y"]
    out, tgt = {}, {}
    for case in range(12):
        out[case] = [r.choice(words) for _ in range(r.randint(0, 60))]
        tgt[case] = [r.choice(words + ["c [0-9]++", "[a-z&&[^b]]", "(", "q", "[xq] y", "[a-z] [0-9y]"]) for _ in range(r.randint(0, 12))]
    line = lambda w, p: {"c [0-9]++": w.startswith("c "), "[a-z&&[^b]]": w == "a",
                         "[xq] y": w == "x y", "[a-z] [0-9y]": " " in w}.get(p, w == p)
    want = {}
    for case in out:
        p = 0
        for w in out[case]:
            if p < len(tgt[case]) and line(w, tgt[case][p]):
                p += 1
        want[case] = (len(tgt[case]), p, "Pass" if p == len(tgt[case]) else "LinesInclude")
    o = _out(spark, [(c, i * 7, w) for c, ws in out.items() for i, w in enumerate(ws)])
    t = _tgt(spark, [(c, i, w) for c, ws in tgt.items() for i, w in enumerate(ws)])
    heads = spark.createDataFrame([(c,) for c in out], "case_id long")
    got = vf.verify_include(o, t, heads=heads)
    assert {r.case_id: (r.n_targets, r.n_matched, r.verdict) for r in got.collect()} == want
    assert "Python" not in got._jdf.queryExecution().toString()


def test_every_target_gets_a_verdict(spark):
    heads = spark.createDataFrame([(i,) for i in range(9)], "case_id long")
    out = _out(spark, [(0, 0, "a"), (2, 0, "a"), (2, 1, "b"), (3, 0, "x"), (4, 0, "x"), (6, 0, "1"), (8, 0, "z")])
    tgt = _tgt(spark, [(0, 0, "a"), (2, 0, "# rows 2"), (3, 0, "# include"), (3, 1, "x"), (4, 0, "# exclude"), (4, 1, "x"),
                       (5, 0, "# data-received t tab"), (6, 0, "# plain comment"), (7, 0, "# include")])
    got = {r.case_id: (r.mode, r.verdict, r.message) for r in vf.verify_targets(out, heads, tgt).collect()}
    assert got == {
        0: ("match", "Pass", None), 1: ("match", "Pass", None), 2: ("rows", "Pass", None), 3: ("include", "Pass", None),
        4: ("exclude", "LinesExclude", "1 excluded lines"),
        5: ("data-received", "DataNotReceived", "data has not all received"),
        6: ("match", "LinesNotMatch", "line 0: 1 | # plain comment"), 7: ("include", "Pass", None),
        8: ("match", "LineCountDiff", "1 lines, expected 0")}


def test_include_of_many_distinct_lines_keeps_them_apart(spark, monkeypatch):
    """No row of the plan holds a target's whole list beside each of its lines; lists longer than a part are followed whole."""
    monkeypatch.setattr(vf, "MIN_BLOCK", 16)
    monkeypatch.setattr(vf, "BLOCKS", 4)
    n = 500
    out = spark.range(n).selectExpr("1L AS case_id", "id * id AS row_idx", "concat('r ', id) AS line")
    tgt = spark.range(n).selectExpr("1L AS case_id", "id AS row_idx", "IF(id % 3 = 0, '[r] [0-9]+', concat('r ', id)) AS pattern")
    late = tgt.selectExpr("2L AS case_id", "row_idx", "IF(row_idx = 300, 'r 299', pattern) AS pattern")
    empty = spark.createDataFrame([(3, 0, None), (4, 0, "q")], "case_id long, row_idx long, pattern string")
    both = out.union(out.selectExpr("2L", "row_idx", "line")).union(out.selectExpr("3L", "row_idx", "line"))
    got = {r.case_id: (r.n_targets, r.n_matched) for r in vf.verify_include(both, tgt.union(late).union(empty)).collect()}
    assert got == {1: (n, n), 2: (n, 300), 3: (1, 0), 4: (1, 0)}
    golden = vf.golden_lines(tgt, ["case_id"])
    assert dict(golden.dtypes)["class"] == "bigint"
    assert max(len(r.classes) for r in vf.matched_rows(out, golden, ["case_id"]).collect()) == 2
