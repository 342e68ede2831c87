"""Run annotated SQL cases on Spark and verify their outputs.

Only the statements (the cases' program text) pass through the driver, which issues them in order with
``spark.sql``; every result stays a DataFrame: rendered to lines, positioned, and verified against the golden
targets by ``verify_targets``, in the mode each target asks for. A step's time limit cancels its jobs through a
job tag.

Every case has a session of its own (``CaseSession``). It begins as a copy of the caller's, so that the caller's
temporary views are there; views, settings, the current database and functions that a case makes stay in it, and are
seen by no other case and not by the caller. Spark's own ``${var}`` substitution is off there (cases resolve
their variables themselves). A session keeps the streams that its case has started, by stream id: they are drained
before every checked step and end with the case.

``run_cases`` issues all steps once and verifies all targets in one plan. ``poll_case`` is the way of a live case:
its steps are repeated in one session, from the first that has not passed, until all pass or the case's limit is over.
``script_runner`` runs cases from script files.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.functions.text import VARIABLE, render_line
from tessera.operators import verify as vf
from tessera.operators.scan import row_index
from tessera.operators.scripts import TOPIC_RX
from tessera.session import scratch_path
from tessera.sources.streams import TOPIC_SCHEMA, read_topic

KEYS = ["case", "target_idx"]
OUT_SCHEMA = "case string, target_idx int, row_idx long, line string"
ERROR = "Error"


@dataclass
class Step:
    case: str
    sql: str
    directive: str | None = None
    limit_s: float | None = None  # of this step; else the runner's
    last: bool = True             # of the pieces of one statement: its result is the statement's

    @property
    def checked(self) -> str | None:
        """``target`` or ``error`` where the step's outcome is verified (target first)."""
        return next((k for k in ("target", "error") if self.last and k in (self.directive or "")), None)

    @property
    def starts_stream(self) -> bool:
        return (self.directive or "").split(":")[0].strip().lower() == "stream"


def error_texts(e: Exception) -> list[str]:
    """What an expected error may be given as: the message's first line, or its error condition."""
    message = (str(e).strip().splitlines() or [""])[0].strip()
    condition = getattr(e, "getCondition", lambda: None)()
    return [message] + ([condition] if condition and condition != message else [])


@dataclass
class Stream:
    """An ``insert into <table> <select>`` that goes on: every ``advance`` brings what its topics hold by then."""
    stream_id: str
    rows: DataFrame
    table: str
    position: str                 # folder of its checkpoint and of what it has read
    folder: str                   # of the topics
    topics: tuple[str, ...] = ()  # that it reads
    read: int = 0                 # lines taken from its topics so far
    done: int = field(default_factory=time.time_ns)  # the last run whose rows are in the table
    files: int = -1               # of the topics, before that run

    def advance(self, own: SparkSession) -> None:
        """Run to the end of the topics, then insert what has come.

        The checkpoint says where the last run ended, and the sink's log which files count, so no line comes twice. A
        run's rows carry its number; those of a run that broke off are inserted with the next one's. Without new files
        in the folder of topics there is nothing to run.
        """
        files = len(own.read.schema(TOPIC_SCHEMA).parquet(self.folder).inputFiles())
        if files == self.files:
            return
        run, sink = time.time_ns(), f"{self.position}/rows"
        query = (self.rows.withColumn("__run", F.lit(run)).writeStream.queryName(f"{self.stream_id}-{run}")
                 .format("parquet").partitionBy("__run").option("path", sink)
                 .option("checkpointLocation", f"{self.position}/checkpoint").trigger(availableNow=True).start())
        try:
            query.awaitTermination()
        finally:
            if query.isActive:
                query.stop()
            new = sum(p.numInputRows for p in query.recentProgress)
            self.read += new
        if new:
            schema = StructType([*self.rows.schema.fields, StructField("__run", LongType())])
            got = own.read.schema(schema).parquet(sink)
            got.where(F.col("__run") > self.done).drop("__run").write.insertInto(self.table)
        self.done, self.files = run, files


_COLUMNS = r"\(((?:[^()]|\([^()]*\))*)\)"
CREATE_STREAM = re.compile(rf"create\s+stream\s+(?:if\s+not\s+exists\s+)?([^\s(]+)\s*{_COLUMNS}(.*)", re.I | re.S)
STREAM_AS = re.compile(r"create\s+stream\s+(?:if\s+not\s+exists\s+)?([^\s(]+)\s+as\s+(.*)", re.I | re.S)
INSERT = re.compile(r"insert\s+into\s+(?:table\s+)?(\S+)\s+(select\b.*|with\b.*)", re.I | re.S)
STOP = re.compile(r"stop\s+streamjob\s+(\S+)", re.I)
APPLICATION = re.compile(r"(create|drop|use)\s+application\s+(?:if\s+(?:not\s+)?exists\s+)?(\S+)(?:\s+cascade)?", re.I)
DELIMITER = re.compile(r"fields\s+terminated\s+by\s+'(.)'", re.I)


class CaseSession:
    """One case's session, variables and streams.

    Statements that Spark does not have: ``use application`` names the application (variable ``app``; creating and
    dropping one does nothing), ``create stream`` makes a streaming view of a topic below ``topics``, ``stop streamjob``
    ends a stream, and an insert with a ``stream`` directive starts one, whose id is bound to ``stream<k>``.

    A consumer group is an application's use of a stream view. Its stream begins at the smallest offset of its topic; only
    with a ``no-reset`` directive at ``create stream``, and a folder of ``groups``, it goes on where the group has ended.
    """

    def __init__(self, spark: SparkSession, case: str, variables: dict[str, str] | None = None, topics: str | None = None,
                 groups: str | None = None):
        self.case, self.topics, self.groups, self.variables = case, topics, groups, dict(variables or {})
        self.spark = spark.__class__(spark.sparkContext, spark._jsparkSession.cloneSession())
        self.spark.conf.set("spark.sql.variable.substitute", "false")
        self.streams: dict[str, Stream] = {}
        self.sources: dict[str, str] = {}  # topic of every stream view
        self.kept: set[str] = set()        # stream views whose group keeps its position
        self.issued: list[str] = []
        self._bound = 0
        self.ended: list[Stream] = []

    def resolve(self, text: str) -> str:
        return re.sub(VARIABLE, lambda m: self.variables.get(m[1], m[0]), text)

    def issue(self, sql: str, limit_s: float, sink: str | None = None, starts_stream: bool = False,
              keeps_position: bool = False) -> None:
        """Run a statement under its time limit; with ``sink``, write its rendered lines there in output order."""
        if starts_stream:
            self._bound += 1
            self.variables[f"stream{self._bound}"] = f"{self.variables.get('prefix', self.case + '_')}stream{self._bound}"
        sql = self.resolve(sql).strip().removesuffix(";")
        self.issued.append(sql + ";")
        tag = f"tessera-case-{uuid.uuid4().hex}"
        sc = self.spark.sparkContext
        sc.addJobTag(tag)  # the timer's thread knows no tags of this thread's session, only those of jobs
        timer = threading.Timer(limit_s, lambda: sc.cancelJobsWithTag(tag))
        timer.start()
        try:
            if sink is not None:
                self.drain()
            df = None if starts_stream and self._start(sql) or self._other(sql, keeps_position) else self.spark.sql(sql)
            if sink is not None:
                df = self.spark.createDataFrame([], "line string") if df is None else df
                # written once: line order and numbers stay fixed, and a lost executor costs nothing
                (df.select(render_line([F.col(f"`{c}`") for c in df.columns]).alias("line"))
                 .withColumn("at", F.monotonically_increasing_id()).write.parquet(sink))
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    def _other(self, sql: str, keeps_position: bool) -> bool:
        """Run a statement that is not Spark's; false where it is."""
        if m := APPLICATION.fullmatch(sql):
            if m[1].lower() == "use":
                self.variables["app"] = m[2]
        elif m := STOP.fullmatch(sql):
            for k in list(self.streams) if m[1].lower() == "all" else [m[1]]:
                if k in self.streams:
                    self.ended.append(self.streams.pop(k))
        elif m := CREATE_STREAM.fullmatch(sql):
            self._view(*m.groups(), keeps_position)
        elif m := STREAM_AS.fullmatch(sql):
            self.spark.sql(m[2]).createOrReplaceTempView(m[1])
        else:
            return False
        return True

    def _view(self, name: str, columns: str, rest: str, keeps_position: bool) -> None:
        topic = re.search(TOPIC_RX, rest, re.I)
        if not topic or not self.topics:
            raise ValueError(f"stream {name} has no topic" if not topic else "no folder of topics is given")
        sep = DELIMITER.search(rest)
        cells = F.split("value", re.escape(sep[1] if sep else ","), -1)
        schema = self.spark.createDataFrame([], columns).schema
        lines = read_topic(self.spark, self.topics, topic[1])
        lines.select(*[F.try_element_at(cells, F.lit(i + 1)).try_cast(c.dataType).alias(c.name)
                       for i, c in enumerate(schema)]).createOrReplaceTempView(name)
        self.sources[name] = topic[1]
        (self.kept.add if keeps_position else self.kept.discard)(name)

    def _start(self, sql: str) -> bool:
        """Start the stream of an insert that reads streams; false for any other statement."""
        m = INSERT.fullmatch(sql)
        rows = self.spark.sql(m[2]) if m else None
        if rows is None or not rows.isStreaming:
            return False
        key = self.variables[f"stream{self._bound}"]
        into = self.spark.table(m[1]).schema
        if len(into) != len(rows.columns):
            raise ValueError(f"{m[1]} has {len(into)} columns, {len(rows.columns)} are given")
        rows = rows.toDF(*into.names).select(*[F.col(f"`{c.name}`").cast(c.dataType) for c in into])
        named = set(re.findall(r"[\w.`$-]+", m[2].lower()))
        views = sorted(v for v in self.sources if v.lower() in named)
        position = scratch_path(self.spark, "position")
        if self.groups and views and self.kept.issuperset(views):
            names = [f"{self.variables.get('app', self.case)}-{self.variables.get('database', 'default')}.{v}" for v in views]
            position = f"{self.groups}/{'+'.join(names)}/{m[1].lower()}"
        self.streams[key] = Stream(key, rows, m[1], position, self.topics, tuple(self.sources[v] for v in views))
        self.streams[key].advance(self.spark)
        return True

    def drain(self) -> None:
        """Bring every stream of the case to the end of its topics."""
        for s in self.streams.values():
            s.advance(self.spark)

    def close(self) -> None:
        self.ended += self.streams.values()
        self.streams.clear()


def run_cases(spark: SparkSession, steps: Sequence[Step], targets: DataFrame, heads: DataFrame | None = None,
              limit_s: float = 30, lags: DataFrame | Callable[[], DataFrame] | None = None, threads: int = 4,
              session: Callable[[str], CaseSession] | None = None) -> DataFrame:
    """Execute each case's steps in order; verify ``target`` and ``error`` steps.

    ``targets``: case, target_idx, row_idx, pattern. ``heads`` (case, target_idx): all targets; without it, the steps
    that ask for one. Cases run ``threads`` at a time, each in the session that ``session`` gives for it (default: a new
    one). ``lags`` may be a function that gives them once the cases have run. A step without any golden line expects an
    empty result. Returns (case, target_idx, verdict, message), one row per checked step.
    """
    folder = scratch_path(spark, "cases")
    session = session or (lambda case: CaseSession(spark, case))
    cases: dict[str, list[tuple[int, Step]]] = {}
    for no, st in enumerate(steps):
        cases.setdefault(st.case, []).append((no, st))

    def run_one(own: list[tuple[int, Step]]) -> list[tuple]:
        out: list[tuple] = []
        at = session(own[0][1].case)
        try:
            for no, st in own:
                kind, texts = st.checked, []
                try:
                    at.issue(st.sql, st.limit_s or limit_s, f"{folder}/case={no}" if kind else None, st.starts_stream,
                             "no-reset" in (st.directive or ""))
                except Exception as e:  # noqa: BLE001 - a failing step is data here
                    texts = error_texts(e)
                if kind:
                    out.append((st.case, len(out), no, kind, texts))
        finally:
            at.close()
        return out

    with ThreadPoolExecutor(max(1, threads)) as pool:  # a case's own steps stay in order
        issued = [x for out in pool.map(run_one, cases.values()) for x in out]
    lags = lags() if callable(lags) else lags
    done = spark.createDataFrame(issued, "case string, target_idx int, no int, kind string, texts array<string>")
    if heads is not None:
        done = done.join(heads.select("case", F.col("target_idx").cast("int").alias("target_idx")).distinct(),
                         KEYS, "left_semi")
    targets = targets.withColumn("target_idx", F.col("target_idx").cast("int"))
    ran = done.where("size(texts) = 0")
    failed = done.where("size(texts) > 0")
    checks = _results(spark, folder, issued).join(ran.where("kind = 'target'").select("no", *KEYS), "no")
    out = row_index(checks.select(*KEYS, "at", "line"), KEYS, "at").drop("at")
    good = vf.verify_targets(out, ran.where("kind = 'target'").select(*KEYS), targets, KEYS, lags)
    # an expected error is verified like a result of one line, as its message or as its condition
    said = failed.where("kind = 'error'").select(*KEYS, F.posexplode("texts").alias("way", "line"))
    way = [*KEYS, "way"]
    ways = said.select(*way)
    errors = vf.verify_targets(said.withColumn("row_idx", F.lit(0).cast("long")), ways, targets.join(ways, KEYS), way, lags)
    first = F.struct(F.col("verdict") != vf.PASS, F.col("way"))
    errors = errors.groupBy(*KEYS).agg(F.min_by("verdict", first).alias("verdict"),
                                       F.min_by("message", first).alias("message"))
    other = failed.where("kind = 'target'").select(*KEYS, F.lit(ERROR).alias("verdict"), F.col("texts")[0].alias("message"))
    passed = ran.where("kind = 'error'").select(*KEYS, F.lit(vf.UNEXPECTED_SUCCESS).alias("verdict"),
                                                F.lit("the step succeeded").alias("message"))
    cols = [*KEYS, "verdict", "message"]
    return good.select(*cols).unionByName(errors.select(*cols)).unionByName(other).unionByName(passed)


def _results(spark: SparkSession, folder: str, issued: list[tuple]) -> DataFrame:
    """All results written below ``folder`` as one scan: (no, at, line)."""
    schema = "line string, at long, `case` int"
    if not any(not texts for *_, texts in issued):
        return spark.createDataFrame([], "no int, at long, line string")
    return spark.read.schema(schema).parquet(folder).select(F.col("case").alias("no"), "at", "line")


def poll_case(spark: SparkSession, steps: list[Step], targets: DataFrame, limit_s: float = 30,
              interval_s: float = 2, lags=None, step_s: float = 30) -> tuple[bool, int, str | None]:
    """Repeat one case until it passes or ``limit_s`` is over: (passed, targets passed, last message).

    No round begins after the limit; a step of one that has begun may take ``step_s``.

    Targets that have passed stay passed: a new round begins with the first step that has not.
    """
    end, at, passed = time.monotonic() + limit_s, 0, 0
    own = CaseSession(spark, steps[0].case if steps else "")
    while True:
        message = None
        for i in range(at, len(steps)):
            at = i
            if steps[i].checked is None:
                run_cases(spark, [steps[i]], targets.limit(0), limit_s=step_s, session=lambda _: own)
                continue
            want = targets.where(F.col("target_idx") == passed).withColumn("target_idx", F.lit(0))
            got = run_cases(spark, [steps[i]], want, limit_s=step_s, lags=lags, session=lambda _: own).first()
            if got["verdict"] != vf.PASS:
                message = f"target {passed}: {got['verdict']}" + (f" ({got['message']})" if got["message"] else "")
                break
            passed += 1
        else:
            return True, passed, None
        if time.monotonic() + interval_s > end:
            return False, passed, message
        time.sleep(interval_s)
