"""Synthetic tables from small column specs.

A ``TableSpec`` lists columns (int, float, string, timestamp) with value rules: ``include`` (emit the
value with a frequency, newest rule first, one uniform per row against the cumulative
frequencies), ``except`` (the value is never drawn) and ``frequency`` (parsed, unused). Values are pure
functions of (seed, table, column, row id), so a generated table is a projection over the rows of a given
table (``ids``) or over ``spark.range``, without a shuffle, except for a timestamp ramp with include rules:
an include hit skips the ramp's draw, so the draw number is ``id - (include hits before id)``, a bucketed
scan over the ids.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.functions import gen_exprs as gx
from tessera.operators.scan import running_sums

TYPES = ("int", "float", "string", "timestamp")
KINDS = ("include", "except", "frequency")
BASE_SECONDS = 7 * 3600  # ramp origin 1970-01-01 07:00:00
SPARK_TYPES = {"int": "INT", "float": "DOUBLE", "string": "STRING", "timestamp": "TIMESTAMP_NTZ"}


@dataclass
class Rule:
    value: str
    freq: float | None
    kind: str


@dataclass
class ColumnSpec:
    name: str
    type: str
    rules: list[Rule] = field(default_factory=list)
    range: float = 10.0       # normal: mean range/2, sd range/3, clipped to [0, range]
    frequency: int = 10       # ramp: draws per step
    delta: float = 1.0        # ramp: step size
    start: float = 0.0        # ramp: first value

    def __post_init__(self) -> None:
        given, self.rules = self.rules, []
        for r in given:
            self.add_rule(r.value, r.freq, r.kind)

    def add_rule(self, value: str, freq: float | None, kind: str) -> None:
        """A value counts once: with its largest frequency and the kind it came with first."""
        if kind not in KINDS:
            raise ValueError(f"unknown rule kind {kind!r}")
        known = {r.value: r for r in self.rules}
        rule = known.get(value)
        if rule is None:
            self.rules.append(Rule(value, freq, kind))
        else:
            rule.freq = max((f for f in (rule.freq, freq) if f is not None), default=None)

    @property
    def includes_newest_first(self) -> list[Rule]:
        return [r for r in reversed(self.rules) if r.kind == "include" and r.freq is not None]

    @property
    def excluded(self) -> list[str]:
        return [r.value for r in self.rules if r.kind == "except"]


@dataclass
class TableSpec:
    name: str
    n: int
    columns: list[ColumnSpec] = field(default_factory=list)

    def column(self, name: str) -> ColumnSpec | None:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        return None

    def add_rules(self, cols: list[str], groups: list[list[tuple[str, float | None]]], kind: str) -> None:
        """``(a, b) kind (v1 f1, w1 g1; v2 f2, w2 g2)``: positional per column;
        extra entries are ignored; unknown columns are skipped."""
        for group in groups:
            for col, vf in zip(cols, group):
                c = self.column(col)
                if c is not None and vf is not None:
                    c.add_rule(vf[0], vf[1], kind)


# ------------------------------------------------------------------ expressions
def _excluded_ticks(col: ColumnSpec) -> list[int]:
    ticks = set()
    for v in col.excluded:
        try:
            dt = datetime.strptime(v.strip(), "%Y-%m-%d %H:%M:%S").replace(tzinfo=timezone.utc)
        except ValueError:
            continue
        sec = int(dt.timestamp()) - BASE_SECONDS
        if col.delta == 0:
            continue
        k0 = math.floor((sec - col.start) / col.delta)
        for k in range(max(0, k0 - 1), k0 + 3):
            if math.floor(col.start + col.delta * k) == sec:
                ticks.add(k)
    return sorted(ticks)


def _excluded_ints(col: ColumnSpec) -> list[int]:
    out = set()
    for v in col.excluded:
        try:
            if str(int(v)) == v.strip():
                out.add(int(v))
        except ValueError:
            pass
    return sorted(out)


def _excluded_floats(col: ColumnSpec) -> list[int]:
    """Excluded floats in millionths, as far as a generated value can have that text."""
    out = set()
    for v in col.excluded:
        try:
            x = float(v)
        except ValueError:
            continue
        if math.isfinite(x) and abs(x * gx.SCALE - round(x * gx.SCALE)) < 1e-3:
            out.add(round(x * gx.SCALE))
    return sorted(out)


def ramp_has_include(col: ColumnSpec) -> bool:
    return col.type == "timestamp" and bool(col.includes_newest_first)


def _include_uniform(seed: int, table: str, col: ColumnSpec, id_sql: str) -> str:
    return gx.uniform([str(seed), table, col.name, "inc"], id_sql)


def include_hit(seed: int, table: str, col: ColumnSpec, id_sql: str) -> str:
    total = sum(r.freq for r in col.includes_newest_first)
    return f"({_include_uniform(seed, table, col, id_sql)} < {gx.dbl(total)})"


def draw_probability(seed: int, table: str, col: ColumnSpec, id_sql: str) -> str:
    """The uniform of an int or float column, kept off the excluded values."""
    u = gx.uniform([str(seed), table, col.name, "n"], id_sql)
    if col.type == "int":
        return gx.skip(u, gx.int_cuts(set(_excluded_ints(col)), col.range))
    ends = _excluded_floats(col)
    cuts = [(0.0, gx.LOW)] if 0 in ends else []
    if round(col.range * gx.SCALE) in ends:
        cuts.append((1 - gx.LOW, 1.0))
    return gx.skip(u, cuts)


def column_sql(seed: int, table: str, col: ColumnSpec, id_sql: str, p: str, draw_sql: str) -> str:
    """Expression of one generated column. ``p``: the column that holds ``draw_probability``;
    ``draw_sql``: the ramp's draw number."""
    if col.type == "string":
        return "'default'"
    if col.type not in SPARK_TYPES:
        raise ValueError(f"unknown column type {col.type!r}")
    typ = SPARK_TYPES[col.type]
    if col.type == "int":
        top, out = math.floor(col.range), _excluded_ints(col)
        if all(v in out for v in range(min(top, len(out)) + 1)):
            raise ValueError(f"every value of column {col.name!r} is excluded")
        val = f"CAST({gx.next_allowed(f'floor({gx.normal(p, col.range)})', out, top)} AS INT)"
    elif col.type == "float":
        out, top = _excluded_floats(col), math.floor(round(col.range * gx.SCALE, 3))
        if all(v in out for v in range(min(top, len(out)) + 1)):
            raise ValueError(f"every value of column {col.name!r} is excluded")
        val = f"round({gx.normal(p, col.range)}, 6)"
        if out:
            step = gx.next_allowed(f"round({val} * {gx.SCALE})", out, top)
            val = f"(CAST({step} AS DOUBLE) / CAST({gx.SCALE} AS DOUBLE))"
    else:
        k = gx.skip_ticks(_excluded_ticks(col), gx.idiv(draw_sql, int(col.frequency)))
        value = f"({gx.dbl(float(col.start))} + {gx.dbl(float(col.delta))} * {k})"
        val = gx.seconds_to_ts(f"({BASE_SECONDS} + CAST(floor({value}) AS BIGINT))")
    inc = col.includes_newest_first
    if inc:
        u = _include_uniform(seed, table, col, id_sql)
        acc, whens = 0.0, []
        for r in inc:
            acc += r.freq
            whens.append(f"WHEN {u} < {gx.dbl(acc)} THEN TRY_CAST({gx.quote(r.value)} AS {typ})")
        val = f"(CASE {' '.join(whens)} ELSE {val} END)"
    return val


def _ids(spark: SparkSession, n: int, rows_per_task: int = 1 << 22) -> DataFrame:
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(n / rows_per_task), 1)
    return spark.range(0, n, 1, numPartitions=min(parts, max(n, 1)))


BUCKET_BITS = 16  # a stream's ids are packed by their upper bits


def _packed(ids: np.ndarray, hits: np.ndarray) -> dict:
    """A bucket's ids, sorted, and their hits (a row for each name) as one short text."""
    order = np.argsort(ids, kind="stable")
    ids, hits = ids[order], hits[:, order].astype(np.uint8)
    blob = np.diff(ids, prepend=ids[0]).astype("<u2").tobytes() + np.packbits(hits, axis=1).tobytes()
    return {"n": len(ids), "lo": ids[0], "hi": ids[-1], "hits": [int(x.sum()) for x in hits],
            "blob": zlib.compress(blob, 1)}


def _unpacked(row, names: list[str]) -> pd.DataFrame:
    """The ids of a bucket and the hits before each, those before the bucket included."""
    blob, n = zlib.decompress(row.blob), int(row.n)
    ids = np.cumsum(np.frombuffer(blob, "<u2", n).astype(np.int64)) + row.lo
    bits = np.frombuffer(blob, np.uint8, offset=2 * n).reshape(len(names), -1)
    hits = np.unpackbits(bits, axis=1, count=n).astype(np.int64)
    return pd.DataFrame({"id": ids} | {x: np.cumsum(h) - h + before for x, h, before in zip(names, hits, row.hits)})


def _carried_sums(stream: DataFrame, hits: dict[str, Column]) -> DataFrame:
    """The exclusive running sums of a stream whose ids ascend from batch to batch.

    Rows meet by bucket of ids, and each bucket is packed where it lies (some bits a row). Only packed buckets meet in one
    task, which adds up their hits; they are dealt out again before they become rows.
    """
    names = list(hits)

    def pack(batches):
        parts: dict[int, list] = {}
        for rows in batches:
            flags = np.stack([rows[x].to_numpy(np.uint8) for x in names])
            ids = rows["id"].to_numpy(np.int64)
            at = ids >> BUCKET_BITS
            for b in np.unique(at):
                mine = at == b
                parts.setdefault(int(b), []).append(((ids[mine] - (b << BUCKET_BITS)).astype(np.uint16), flags[:, mine]))
        while parts:
            b, own = parts.popitem()
            yield pd.DataFrame([_packed(np.concatenate([x for x, _ in own]).astype(np.int64) + (b << BUCKET_BITS),
                                        np.concatenate([x for _, x in own], axis=1))])

    def step(key, batches, state):
        last, *total = state.get if state.exists else (None, *[0] * len(names))
        rows = pd.concat(list(batches)).sort_values("lo", ignore_index=True)
        if last is not None and rows["lo"].iloc[0] <= last:
            raise ValueError(f"id {rows['lo'].iloc[0]} comes after id {last}")
        before = []
        for found in rows["hits"]:
            before.append(list(total))
            total = [int(t + x) for t, x in zip(total, found)]
        rows["hits"] = before
        state.update((int(rows["hi"].iloc[-1]), *total))
        yield rows.drop(columns="all")

    def unpack(batches):
        for rows in batches:
            for row in rows.itertuples():
                yield _unpacked(row, names)

    schema = "n long, lo long, hi long, hits array<long>, blob binary"
    packed = (stream.select("id", *[x.alias(n) for n, x in hits.items()])
              .repartition(F.shiftright("id", BUCKET_BITS)).mapInPandas(pack, schema))
    summed = (packed.withColumn("all", F.lit(0)).groupBy("all")
              .applyInPandasWithState(step, schema, "last long, " + ", ".join(f"{n} long" for n in names), "append",
                                      GroupStateTimeout.NoTimeout))
    dealt = summed.withColumn("bucket", F.shiftright("lo", BUCKET_BITS)).repartition("bucket")
    return dealt.mapInPandas(unpack, "id long, " + ", ".join(f"{n} long" for n in names))


def paced_ids(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    """A stream of ``id`` (0, 1, ..) and ``ts``: a second of event time, ``rows_per_second`` rows, in every batch."""
    return (spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_second).option("numPartitions", 1)
            .option("startTimestamp", 0).option("advanceMillisPerBatch", 1000).load()
            .select(F.col("value").alias("id"), F.col("timestamp").alias("ts")))


def gen_table(spark: SparkSession, spec: TableSpec, n: int | None = None, seed: int = 42,
              ids: DataFrame | None = None, id_col: str = "id", columns: Sequence[str] | None = None) -> DataFrame:
    """``id`` and the spec's columns in order (or those of ``columns``), one row for each row of ``ids``.

    ``ids`` holds row numbers in a bigint ``id_col`` (0, 1, ..; a table's key or a stream's counter);
    without it, ``n`` rows (default ``spec.n``) are numbered. The draws of a timestamp ramp with include rules
    depend on the count of all earlier hits: a stream carries it as state, so its ids must ascend from batch to batch.
    """
    base = _ids(spark, spec.n if n is None else n) if ids is None else ids.select(F.col(id_col).cast("long").alias("id"))
    wanted = [c for c in spec.columns if columns is None or c.name in columns]  # nothing else is drawn
    hits = {f"__hb_{i}": F.expr(include_hit(seed, spec.name, c, "id")).cast("long")
            for i, c in enumerate(wanted) if ramp_has_include(c)}
    if hits:
        base = _carried_sums(base, hits) if base.isStreaming else running_sums(base, "id", hits)
    drawn = base.select("id", *hits, *[
        F.expr(draw_probability(seed, spec.name, c, "id")).alias(f"__p_{i}")
        for i, c in enumerate(wanted) if c.type in ("int", "float")])
    return drawn.select("id", *[
        F.expr(column_sql(seed, spec.name, c, "id", f"__p_{i}", f"(id - __hb_{i})" if f"__hb_{i}" in hits else "id"))
        .alias(c.name) for i, c in enumerate(wanted)])


# ------------------------------------------------------------------ stats
def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """SUM and AVERAGE of each numeric column, one row per column."""
    aggs = []
    for c in columns:
        aggs += [F.sum(F.col(c).cast("double")).alias(f"s_{c}"), F.avg(F.col(c).cast("double")).alias(f"a_{c}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `s_{c}`, `a_{c}`" for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {stack}) AS (column_name, sum_value, avg_value)")
