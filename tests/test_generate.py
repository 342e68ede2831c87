import math
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators.generate import ColumnSpec, Rule, TableSpec, gen_table, paced_ids
from tessera.plans.q_generate import rules_spec, sample_test
from tessera.sources.specs import generate_script, merge_rules, parse_specs
from tessera.streaming import jobs as sj

SAMPLE = """table: test : 20
row:{ l1 int, l2 float, l3 string,l4 timestamp}
(l1) include (1 0.4;2 0.3)
end;

table: test2 : 15
row:{ l1 string, l2 int,l3 timestamp,l4 float}
(l2) except (1)
(l2) include (2 0.3)
end; """


def test_sample_shape_and_ramp(spark):
    rows = gen_table(spark, sample_test(), n=20).orderBy("id").collect()
    assert all(0 <= r.l1 <= 10 and 0.0 <= r.l2 <= 10.0 and r.l3 == "default" for r in rows)
    assert [r.l4 for r in rows[:10]] == [datetime(1970, 1, 1, 7, 0, 0)] * 10   # ten a second
    assert [r.l4 for r in rows[10:]] == [datetime(1970, 1, 1, 7, 0, 1)] * 10


def test_values_do_not_depend_on_partitioning(spark):
    a = gen_table(spark, rules_spec(), n=5000).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = gen_table(spark, rules_spec(), n=5000).repartition(7).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(a) == sorted(b)


def _phi(x):
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def test_except_and_include_rules(spark):
    df = gen_table(spark, rules_spec(), n=20000)
    assert df.where("a IN (4, 5) OR b IN (0.0, 5.0, 10.0) OR c <> 10 OR d IN (0.005, 0.005001)").count() == 0
    share = df.where("a = 7").count() / 20000
    p7, p45 = _phi((8 - 5) * 0.3) - _phi((7 - 5) * 0.3), _phi((6 - 5) * 0.3) - _phi((4 - 5) * 0.3)
    assert abs(share - (0.1 + 0.9 * p7 / (1 - p45))) < 0.012   # include hit, else drawn outside {4, 5}
    excluded = [datetime(1970, 1, 1, 7, 0, 1), datetime(1970, 1, 1, 7, 0, 3)]
    assert df.where(F.col("ts").isin(excluded)).count() == 0


def test_normal_has_the_right_distribution(spark):
    df = gen_table(spark, TableSpec("t", 0, [ColumnSpec("x", "float"), ColumnSpec("k", "int")]), n=40000)
    for v in (0.0, 2.0, 5.0, 8.0):
        got = df.where(F.col("x") <= v).count() / 40000
        assert abs(got - _phi((v - 5) * 0.3)) < 0.01
    for v in range(11):
        want = _phi(-1.2) if v == 0 else _phi(-1.5) if v == 10 else _phi((v - 4) * 0.3) - _phi((v - 5) * 0.3)
        assert abs(df.where(F.col("k") == v).count() / 40000 - want) < 0.01


def test_excluding_everything_is_refused(spark):
    every = ColumnSpec("k", "int", [Rule(str(v), None, "except") for v in range(11)])
    with pytest.raises(ValueError, match="every value"):
        gen_table(spark, TableSpec("t", 5, [every]))
    one = ColumnSpec("k", "int", [Rule(str(v), None, "except") for v in range(1, 11)])
    assert gen_table(spark, TableSpec("t", 500, [one])).where("k <> 0").count() == 0
    with pytest.raises(ValueError, match="unknown rule kind"):
        ColumnSpec("k", "int", [Rule("1", None, "sometimes")])


def test_script_to_rows(spark, tmp_path):
    (tmp_path / "spec.txt").write_text(SAMPLE)
    tables = generate_script(spark, str(tmp_path))
    assert {k: (v.columns, v.count()) for k, v in tables.items()} == {
        "test": (["id", "l1", "l2", "l3", "l4"], 20), "test2": (["id", "l1", "l2", "l3", "l4"], 15)}
    assert tables["test2"].where("l2 = 1").count() == 0


@pytest.mark.parametrize("text, error", [
    ("table: t : 3\nrow:{ a blob}\nend;", "unknown column type"),
    ("table: t : 3\nrow:{ a int}\n(a) maybe (1 0.5)\nend;", "unknown rule kind"),
    ("table: t : many\nrow:{ a int}\nend;", "no row count")])
def test_broken_specs_are_refused(spark, tmp_path, text, error):
    (tmp_path / "spec.txt").write_text(text)
    with pytest.raises(Exception, match=error):
        generate_script(spark, str(tmp_path))


def test_row_counts_beyond_an_int(spark):
    lines = spark.createDataFrame([("f", 0, "table: big : 3000000000"), ("f", 1, "row:{ a int}"), ("f", 2, "end;")],
                                  "file string, n long, line string")
    assert parse_specs(lines)[0].first().n_rows == 3_000_000_000


def test_ramp_draws_skip_include_hits(spark):
    spec = TableSpec("t", 0, [ColumnSpec("ts", "timestamp",
                                         [Rule("1970-01-01 09:00:00", 0.5, "include")])])
    rows = gen_table(spark, spec, n=4000).orderBy("id").collect()
    hit = datetime(1970, 1, 1, 9, 0, 0)
    ramp = [r.ts for r in rows if r.ts != hit]
    # the non-hit rows carry the uninterrupted ramp: draw k -> second k // 10
    assert [int((t - datetime(1970, 1, 1, 7)).total_seconds()) for t in ramp] == [k // 10 for k in range(len(ramp))]


RAMP = TableSpec("held", 50, [ColumnSpec("t", "timestamp", [Rule("1970-01-01 09:00:00", 0.3, "include")],
                                         start=3, delta=2, frequency=2), ColumnSpec("k", "int")])


def test_ramp_held_back_by_include_hits_on_a_stream(spark, tmp_path):
    """The count of hits is carried over batches: the stream equals the table."""
    src = str(tmp_path / "src")
    for k in range(5):
        spark.range(k * 30, k * 30 + 30).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files come in the order of their times
    own = sj.streaming_session(spark)
    ids = own.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(src)
    got = sj.drain(gen_table(own, RAMP, seed=9, ids=ids), "held", spark)
    want = gen_table(spark, RAMP, n=150, seed=9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_paced_generation(spark, tmp_path):
    """Ten rows a second of event time; batches of a running query equal the table."""
    own = sj.streaming_session(spark)
    stream = gen_table(own, RAMP, seed=9, ids=paced_ids(own))
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "sink"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(processingTime="0 seconds").start())
    end = time.monotonic() + 120
    while len(q.recentProgress) < 3 and q.isActive and time.monotonic() < end:
        time.sleep(0.5)
    q.stop()
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "sink"))
    n = got.count()
    assert n >= 20 and n % 10 == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, gen_table(spark, RAMP, n=n, seed=9).collect()))
    ts = paced_ids(spark)
    assert ts.isStreaming and ts.columns == ["id", "ts"]


def test_ids_that_go_back_are_refused_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    own = sj.streaming_session(spark)
    for k in (3, 1):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files come in the order of their times
    ids = own.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
    with pytest.raises(Exception, match="comes after id 39"):
        sj.drain(gen_table(own, RAMP, seed=9, ids=ids), "back", spark)

def test_spec_parser_on_sample(spark):
    lines = spark.createDataFrame([("f", i, l) for i, l in enumerate(SAMPLE.split("\n"))],
                                  "file string, n long, line string")
    tables, cols, rules = parse_specs(lines)
    assert sorted((r.table, r.n_rows) for r in tables.collect()) == [("test", 20), ("test2", 15)]
    c = {(r.table_no, r.pos): (r.col, r.type) for r in cols.collect()}
    assert c[(1, 3)] == ("l4", "timestamp") and c[(2, 1)] == ("l2", "int")
    m = sorted((r.table_no, r.col, r.value, r.freq, r.kind) for r in merge_rules(rules).collect())
    assert m == [(1, "l1", "1", 0.4, "include"), (1, "l1", "2", 0.3, "include"),
                 (2, "l2", "1", None, "except"), (2, "l2", "2", 0.3, "include")]


def test_spec_lines_are_not_moved_once_they_lie_by_file(spark, tmp_path):
    """What a rule belongs to comes along with its line; the rows that lines are made of are dealt out before."""
    from tessera.plans import q_generate as q
    spark.range(950).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    for query, n in ((q.q_gen_rule_merge, None), (q.q_gen_multi_col_rule, 950 * 6), (q.q_gen_spec_scan, 950 * 4)):
        got = query(spark, str(tmp_path))
        assert n is None or got.count() == n
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    lines = spark.createDataFrame([("f", i, l) for i, l in enumerate(
        ["table: t : 3", "(A, b) include (1 0.4, 2 0.3)", "row:{ a int,", "c float}", "end;", "(a) include (9 0.1)",
         "table: u : 4", "row:{ b int}", "(a, B) except (5, 6)", "end;"])], "file string, n long, line string")
    tables, columns, rules = parse_specs(lines)
    assert sorted((r.table, r.pos, r.col) for r in columns.collect()) == [("t", 0, "a"), ("t", 1, "c"), ("u", 0, "b")]
    assert sorted((r.table, r.table_no, r.col, r.value) for r in rules.collect()) == [("t", 1, "a", "1"), ("u", 2, "b", "6")]


def test_a_stream_sends_packed_ids_through_its_state(spark, tmp_path):
    """Ids of many buckets in any order, some twice, in one batch: the task that counts gets some bits an id."""
    import numpy as np

    from tessera.operators import generate as g
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.arange(0, 65536), [70000, 70000, 131071]]) + 65536 * 5
    hits = rng.random((2, len(ids))) < 0.3
    mixed = rng.permutation(65536)
    row = g._packed(ids[:65536][mixed], hits[:, :65536][:, mixed])
    assert (row["n"], row["lo"], row["hi"]) == (65536, 65536 * 5, 65536 * 6 - 1) and len(row["blob"]) < 65536
    got = g._unpacked(type("Row", (), row | {"hits": [7, 0]}), ["x", "y"])
    assert (got["id"].to_numpy() == ids[:65536]).all()
    assert (got["x"].to_numpy() == 7 + np.cumsum(hits[0, :65536]) - hits[0, :65536]).all()
    twice = g._unpacked(type("Row", (), g._packed(ids[65536:], hits[:, 65536:])), ["x", "y"])
    assert twice["id"].tolist() == ids[65536:].tolist()

    rows = spark.range(200_000).union(spark.range(150_000, 150_100)).selectExpr("id * 3 - 90000 AS id")
    rows.orderBy(F.hash("id")).repartition(5).write.parquet(str(tmp_path / "src"))
    own = sj.streaming_session(spark)
    stream = gen_table(own, RAMP, seed=9, ids=own.readStream.schema("id long").parquet(str(tmp_path / "src")))
    got = sj.drain(stream, "packed", spark).select("id", "t", "k")
    want = gen_table(spark, RAMP, seed=9, ids=spark.read.parquet(str(tmp_path / "src")))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
