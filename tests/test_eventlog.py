from tessera.operators import eventlog as ev

JOBS = "run string, job_id long, sql_text string, stream_id string, submit_ms long, finish_ms long, result string"


def test_failed_sql_resets_earlier_runs(spark):
    jobs = spark.createDataFrame([
        ("base", 1, "q", "s", 100, 150, "JobSucceeded"),
        ("base", 2, "q", "s", 200, 260, "JobFailed"),
        ("base", 3, "q", "s", 300, 330, "JobSucceeded"),
        ("base", 4, "r", "s", 100, None, None),
    ], JOBS)
    kept = sorted(r.job_id for r in ev.drop_failed_sql(jobs).collect())
    assert kept == [3, 4]
    assert sorted(r.job_id for r in ev.drop_failed_job(jobs).collect()) == [1, 3, 4]


def test_regression_first_run_and_rate(spark):
    jobs = spark.createDataFrame([
        ("base", 1, "q", "s", 0, 100, "JobSucceeded"), ("base", 2, "q", "s", 10, 1010, "JobSucceeded"),
        ("reg", 3, "q", "s", 0, 200, "JobSucceeded"), ("reg", 4, "only_reg", "s", 0, 50, "JobSucceeded"),
    ], JOBS)
    r = {x.sql_text: x for x in ev.sql_regression(ev.sql_run_merge(jobs)).collect()}
    assert (r["q"].base_ms, r["q"].reg_ms, r["q"].diff_ms, r["q"].rate, r["q"].regressed) == (100, 200, 100, 0.5, True)
    assert r["q"].base_avg_ms == 550.0
    assert r["only_reg"].base_ms is None and r["only_reg"].diff_ms is None


def test_stream_averages_use_integer_division(spark):
    jobs = spark.createDataFrame([
        ("base", 1, "q", "s", 0, 10, "JobSucceeded"), ("base", 2, "q", "s", 5, 16, "JobSucceeded"),
        ("base", 3, "q", "s", 7, None, None),
    ], JOBS)
    m = ev.stream_metrics(jobs).first()
    assert (m.batches, m.ms_per_batch, m.span_ms) == (3, 7, 16)


def test_stock_logs_by_their_paths(spark, tmp_path):
    """Logs as Spark writes them: a single file, a rolled log, EVENT files in a folder per run."""
    from tessera.sources.eventlog import read_event_log
    lines = [
        '{"Event":"SparkListenerJobStart","Job ID":0,"Submission Time":100,"Stage IDs":[0,1],"Properties":'
        '{"spark.job.description":"select 1","sql.streaming.queryId":"null"}}',
        '{"Event":"SparkListenerStageCompleted","Stage Info":{"Stage ID":1,"Stage Attempt ID":0,"Stage Name":"old",'
        '"Submission Time":1,"Completion Time":2}}',
        '{"Event":"SparkListenerStageCompleted","Stage Info":{"Stage ID":1,"Stage Attempt ID":1,"Stage Name":"new",'
        '"Submission Time":110,"Completion Time":150}}',
        '{"Event":"SparkListenerJobEnd","Job ID":0,"Completion Time":160,"Job Result":{"Result":"JobSucceeded"}}',
        '{broken', ""]
    text = "\n".join(lines)
    for f in ("local-17", "app-2.inprogress", "eventlog_v2_app-3/events_1_app-3", "logs/run-x/EVENT_LOG_1", "run=a b/part-0"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text(text)
    (tmp_path / "eventlog_v2_app-3/appstatus_app-3").write_text("")
    log = read_event_log(spark, str(tmp_path))
    jobs = ev.job_fact(log)
    assert sorted(r.run for r in jobs.collect()) == ["a b", "app-2", "app-3", "local-17", "run-x"]
    j = jobs.where("run = 'local-17'").first()
    assert (j.sql_text, j.stream_id, j.submit_ms, j.finish_ms, j.result) == ("select 1", None, 100, 160, "JobSucceeded")
    s = ev.stage_fact(log).where("run = 'app-3'").collect()
    assert [(r.job_id, r.stage_id, r.name, r.complete_ms, r.sql_text) for r in s] == [(0, 1, "new", 150, "select 1")]


def test_a_written_log_is_compressed_and_read_whole(spark, tmp_path):
    from tessera.sources.eventlog import event_lines, read_event_log, write_event_log
    jobs = spark.range(4000).selectExpr(
        "IF(id % 3 = 0, 'base', 'reg') AS run", "id AS job_id", "concat('select ', id) AS sql_text", "'s' AS stream_id",
        "id * 10 AS submit_ms", "IF(id % 7 = 0, NULL, id * 10 + 5) AS finish_ms",
        "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 'JobFailed' ELSE 'JobSucceeded' END AS result")
    stages = spark.range(8000).selectExpr(
        "IF(id div 2 % 3 = 0, 'base', 'reg') AS run", "id div 2 AS job_id", "id AS stage_id", "concat('n', id % 4) AS name",
        "id AS submit_ms", "id + 9 AS complete_ms")
    path = write_event_log(jobs, stages, str(tmp_path / "log"))
    plain = event_lines(jobs, stages).selectExpr("sum(length(value) + 1)").first()[0]
    files = [f for f in (tmp_path / "log").rglob("part-*")]
    assert files and sum(f.stat().st_size for f in files) * 2 < plain
    log = read_event_log(spark, path)
    facts = sorted((r.run, r.job_id, r.submit_ms, r.finish_ms, r.result) for r in ev.job_fact(log).collect())
    assert facts == sorted((r.run, r.job_id, r.submit_ms, r.finish_ms, r.result) for r in jobs.collect())
    assert log.where("`Stage Info` IS NOT NULL").count() == 8000
