from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import verify as vf
from tessera.sources.streams import TOPIC_SCHEMA, read_topic, stream_to_topic, to_stream
from tessera.streaming import jobs as sj
from tessera.streaming import verify as sv


def _stream(spark, df, path):
    df.write.parquet(path)
    return sj.streaming_session(spark).readStream.schema(df.schema).parquet(path)


def test_eventually_stream_equals_batch(spark, tmp_path):
    rows = [(1, 0, 1), (1, 0, 0), (1, 0, 2), (2, 500, 0), (3, 40000, 0), (4, 0, None), (5, 0, 0), (5, 10, 2), (5, 20, 1),
            (5, 30000, 2), (6, 30001, 0)]
    df = spark.createDataFrame(rows, "case_id long, poll_ms long, passing_target int")
    s = _stream(spark, df, str(tmp_path / "s"))
    got = sj.latest(sj.drain(sj.eventually(s, 3, 30000), "ev", spark)).collect()
    want = vf.eventually_pass(df, 3, 30000).collect()
    key = lambda rs: sorted((r.case_id, r.reached, r.passed, r.pass_ms) for r in rs)
    assert [x[:3] for x in key(got)] == [(1, 3, True), (2, 1, False), (3, 0, False), (4, 0, False), (5, 3, True), (6, 0, False)]
    assert key(got) == key(want)


def test_job_pairs_keep_runs_apart_and_lose_no_start(spark, tmp_path):
    t = lambda s: datetime(2020, 1, 1) + timedelta(seconds=s)
    starts = spark.createDataFrame([("a", 0, t(0)), ("b", 0, t(5)), ("a", 1, t(10)), ("a", 2, t(20)), ("b", 9, t(4000))],
                                   "run string, job_id long, start_ts timestamp")
    ends = spark.createDataFrame([("a", 0, t(30)), ("b", 0, t(40)), ("a", 1, t(2000))],
                                 "run string, job_id long, end_ts timestamp")
    own = sj.streaming_session(spark)
    for name, df in (("starts", starts), ("ends", ends)):
        df.write.parquet(str(tmp_path / name))
    s, e = (own.readStream.schema(df.schema).parquet(str(tmp_path / n)) for n, df in (("starts", starts), ("ends", ends)))
    got = sj.replay_pairs(s, e, "10 minutes", spark)
    assert sorted((r.run, r.job_id, r.end_ts is not None) for r in got.collect()) == [
        ("a", 0, True), ("a", 1, False), ("a", 2, False), ("b", 0, True), ("b", 9, False)]


def test_polls_of_a_case_reach_its_task_once(spark, tmp_path):
    """A case of very many events: its state gets each (poll, target) once."""
    df = spark.range(200_000).selectExpr("id % 2 as case_id", "id % 7 * 500 as poll_ms", "cast(id % 3 as int) as passing_target")
    s = _stream(spark, df, str(tmp_path / "s"))
    rows = sj.eventually(s, 3, 30000)
    q = (rows.writeStream.format("parquet").option("path", str(tmp_path / "sink"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sj.latest(spark.read.schema(rows.schema).parquet(str(tmp_path / "sink"))).collect()
    want = vf.eventually_pass(df, 3, 30000).collect()
    key = lambda rs: sorted((r.case_id, r.reached, r.passed, r.pass_ms) for r in rs)
    assert key(got) == key(want)
    kept = sum(op.numRowsUpdated for p in q.recentProgress for op in p.stateOperators if "dedupe" in op.operatorName.lower())
    assert kept == 42


def test_drain_leaves_the_session_alone(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    s = _stream(spark, spark.range(5), str(tmp_path / "r"))
    assert sj.drain(s.select(F.col("id")), "ids", spark).count() == 5
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_kafka_without_connector_is_refused(spark, tmp_path):
    with pytest.raises(RuntimeError, match="connector"):
        to_stream(spark.range(3).withColumn("value", F.lit("x")), "t", str(tmp_path / "t"), bootstrap="host:9092")


def test_topic_sink_restarted_in_mid_stream_has_every_line_once(spark, tmp_path):
    src, topics, ckpt = (str(tmp_path / n) for n in ("src", "topics", "ckpt"))
    for k in range(6):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(src)
    own = sj.streaming_session(spark)
    lines = (own.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
             .withColumn("value", F.concat(F.lit("v"), "id")))
    bad = lines.withColumn("value", F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    q = stream_to_topic(bad, "t", topics, ckpt)
    with pytest.raises(Exception, match="broken"):
        q.awaitTermination()
    got = lambda: sorted(r.value for r in spark.read.schema(TOPIC_SCHEMA).parquet(topics).collect())
    part = got()
    assert 0 < len(part) < 60 and len(part) % 10 == 0 and len(set(part)) == len(part)
    stream_to_topic(lines, "t", topics, ckpt).awaitTermination()
    assert got() == sorted(f"v{i}" for i in range(60))
    stream_to_topic(lines, "t", topics, ckpt).awaitTermination()  # nothing new
    assert len(got()) == 60
    assert {r.partition for r in spark.read.schema(TOPIC_SCHEMA).parquet(topics).where("value = 'v7'").collect()} == {3}
    again = sj.drain(read_topic(own, topics, "t"), "again", spark)
    assert sorted(r.value for r in again.collect()) == got()
    assert sj.drain(read_topic(own, topics, "u"), "none", spark).count() == 0


def test_verdicts_come_while_the_result_streams_in(spark, tmp_path):
    rows = [(c, i, f"{c} {i}") for c in range(4) for i in range(300)] + [(5, 0, "x"), (6, 0, "only here"), (7, 0, "9 9")]
    gold = [(c, i, f"{c} [0-9]+" if i % 3 else f"{c} {i}") for c in range(4) for i in range(300) if (c, i) != (2, 299)]
    gold = [(c, i, "other") if (c, i) in ((1, 250), (1, 40), (3, 7)) else (c, i, p) for c, i, p in gold]
    gold += [(5, 0, "x"), (5, 1, "y"), (7, 0, "9  9"), (8, 0, "never comes")]
    out = spark.createDataFrame(rows, "case_id long, row_idx long, line string")
    tgt = spark.createDataFrame(gold, "case_id long, row_idx long, pattern string")
    src, golden = str(tmp_path / "src"), str(tmp_path / "golden")
    out.repartition(8).write.parquet(src)
    tgt.write.parquet(golden)
    own = sj.streaming_session(spark)
    stream = own.readStream.schema(out.schema).option("maxFilesPerTrigger", 2).parquet(src)
    got = sj.drain(sv.verdict_stream(stream, own.read.parquet(golden)), "v", spark).cache()
    seen = [r.n_out for r in got.where("case_id = 0").orderBy("n_out").collect()]
    assert len(seen) == 4 and seen[-1] == 300  # a row for each batch
    assert got.where("complete and n_out < n_tgt").count() == 0 and got.where("case_id = 0 and complete").count() == 1
    cols = ["case_id", "n_out", "n_tgt", "n_diff", "first_diff_idx", "diff_line", "diff_pattern", "verdict"]
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    last = sv.last_verdicts(got, tgt)
    assert key(last) == key(vf.verify_exact(out, tgt))
    assert {r.case_id: r.verdict for r in last.collect()} == {
        0: "Pass", 1: "LinesNotMatch", 2: "LineCountDiff", 3: "LinesNotMatch", 5: "LineCountDiff", 6: "LineCountDiff",
        7: "Pass", 8: "LineCountDiff"}
