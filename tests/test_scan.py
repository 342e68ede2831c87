import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.scan import bucketed_scan, row_index


def _frame(spark, n=3000, hot=0.34, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < hot else rnd.randint(1, 20)  # one key holds a third of the rows
        v = rnd.choice([None, 1, 2, 3])
        rows.append((key, i * 3 + rnd.randint(0, 2), v))
    return spark.createDataFrame(rows, "k long, pos long, v int")


def test_row_index_matches_window_with_hot_key(spark):
    df = _frame(spark)
    got = row_index(df, ["k"], "pos", width=64).select("k", "pos", "row_idx")
    want = df.select("k", "pos", (F.row_number().over(Window.partitionBy("k").orderBy("pos")) - 1).alias("row_idx"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_scan_sum_and_last_inclusive_exclusive(spark):
    df = _frame(spark)
    for inclusive in (True, False):
        got = bucketed_scan(df, ["k"], "pos", sums={"s": F.coalesce("v", F.lit(0))},
                            lasts={"l": F.col("v")}, inclusive=inclusive, width=50)
        end = 0 if inclusive else -1
        w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, end)
        want = df.select("k", "pos", "v",
                         F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(w), F.lit(0)).alias("s"),
                         F.last("v", ignorenulls=True).over(w).alias("l"))
        assert sorted(got.select("k", "pos", "v", "s", "l").collect()) == sorted(want.collect())


def test_scan_is_repartition_invariant(spark):
    df = _frame(spark)
    a = row_index(df, ["k"], "pos", width=32).select("k", "pos", "row_idx").collect()
    b = row_index(df.repartition(13).orderBy(F.rand(3)), ["k"], "pos", width=32) \
        .select("k", "pos", "row_idx").collect()
    assert sorted(a) == sorted(b)


def test_sparse_giant_key_null_keys_and_null_order(spark):
    rows = [(0, i * 100_000, i % 3) for i in range(4000)] + [(None, i, 1) for i in range(50)] + [(1, None, 1), (1, 5, 1)]
    df = spark.createDataFrame(rows, "k long, pos long, v int")
    got = row_index(df, ["k"], "pos", width=500)
    want = df.select("*", (F.row_number().over(Window.partitionBy("k").orderBy("pos")) - 1).cast("long").alias("row_idx"))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_building_a_scan_runs_no_job(spark):
    df = _frame(spark, 50)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    row_index(row_index(df, ["k"], "pos"), ["v"], "pos", name="again")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_running_sums_without_a_key(spark):
    import random
    from pyspark.sql import functions as F

    from tessera.operators.scan import running_sums
    r = random.Random(5)
    ids = r.sample(range(-500, 5000), 700)
    df = spark.createDataFrame([(i, r.randint(0, 3)) for i in ids], "id long, v long")
    got = {x.id: (x.v, x.s, x.c) for x in running_sums(df, "id", {"s": F.col("v"), "c": F.lit(1)}, width=8).collect()}
    s = 0
    for k, x in enumerate(sorted(df.collect())):
        assert got[x.id] == (x.v, s, k)
        s += x.v
    plan = running_sums(df, "id", {"s": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
