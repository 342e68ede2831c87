from pyspark.sql import functions as F

from tessera.operators import scripts as sc

SCRIPT = [
    "create table if not exists ${prefix}t1(",
    "a int); -- target",
    "-- time:60",
    "create or replace function f(x int)",
    "returns int;",
    "begin",
    "  return x;",
    "end;",
    "select 1; select 2; -- error",
    "--",
    "create external table if not exists ext1(a int);",
    "use application app_a;",
    "select 3",
]


def _lines(spark):
    return spark.createDataFrame([(1, i + 1, l) for i, l in enumerate(SCRIPT)], "file long, n long, line string")


def test_statements_blocks_and_comments(spark):
    st = sc.statements(_lines(spark)).orderBy("n").collect()
    got = [(r.n, r.sql, r.comment) for r in st]
    assert got == [
        (2, "create table if not exists ${prefix}t1(\na int);", "target"),
        (3, "", "time:60"),
        (8, "create or replace function f(x int)\nreturns int;\nbegin\nreturn x;\nend;", None),
        (9, "select 1; select 2;", "error"),
        (11, "create external table if not exists ext1(a int);", None),
        (12, "use application app_a;", None),
    ]


def test_classes_objects_and_split(spark):
    st = sc.statements(_lines(spark))
    kinds = {r.n: r.kind for r in sc.statement_class(st).collect()}
    assert kinds[2] == "create_table" and kinds[11] == "create_external" and kinds[12] == "use_application"
    objs = {r.n: r.o for r in st.select("n", sc.created_object(F.col("sql")).alias("o")).collect()}
    assert objs[2] == "${prefix}t1" and objs[11] == "ext1"          # 'if not exists' skipped
    pieces = sc.split_statement(st).where("n = 9").orderBy("piece_idx").collect()
    assert [(p.piece.strip(), p.is_last) for p in pieces] == [("select 1", False), ("select 2", True)]


def test_substitute_keeps_unknown_and_time_limit(spark):
    st = sc.statements(_lines(spark))
    m = F.create_map(F.lit("prefix"), F.lit("s_c_"))
    got = st.where("n = 2").select(sc.substitute(F.col("sql"), m)).first()[0]
    assert got.startswith("create table if not exists s_c_t1(")
    df = spark.createDataFrame([("x ${who} ${prefix}",)], "sql string")
    assert df.select(sc.substitute(F.col("sql"), m)).first()[0] == "x ${who} s_c_"
    assert sc.time_limit(_lines(spark)).first().limit_s == 60


def test_stream_ids(spark):
    lines = spark.createDataFrame([(1, 1, "insert into a select 1; -- stream"),
                                   (1, 2, "select 1; -- target"),
                                   (1, 3, "insert into b select 1; -- stream")], "file long, n long, line string")
    st = sc.statements(lines)
    got = [(r.var, r.stream_id) for r in sc.stream_ids(st, F.lit("s_c_")).orderBy("n").collect()]
    assert got == [("stream1", "s_c_stream1"), ("stream2", "s_c_stream2")]
