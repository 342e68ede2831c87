"""Skew-safe ordered scans (running sums, last-non-null, row positions).

A plain ``Window.partitionBy(key).orderBy(pos)`` sends every row of a key to one task, so one hot key (a
giant result, script or suite) becomes one straggler. The scans here cut each key into buckets that are
contiguous ranges of the order:

1. per key, its count and the span of its order values say how wide a bucket is, so that buckets hold about
   ``width`` rows however sparse the values are;
2. per (key, bucket), totals as a map-side aggregate (no rows are moved), and their exclusive prefix over the
   buckets of a key (one row per bucket);
3. one exchange of the rows on (key, bucket) with a window inside the bucket, joined with that prefix (the small
   side moves, or is broadcast by AQE).

Everything is lazy, deterministic and in built-in expressions: no sampling, no driver round trip, nothing
written. A null order value comes first; null keys are a key of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 16


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names]


def bucketed_scan(df: DataFrame, keys: Sequence[str], order: str,
                  sums: dict[str, Column] | None = None,
                  lasts: dict[str, Column] | None = None,
                  inclusive: bool = True,
                  tiebreak: Sequence[str] = (),
                  width: int = DEFAULT_WIDTH) -> DataFrame:
    """Running ``sum`` and ``last(ignorenulls)`` over ``order`` within ``keys``.

    ``order`` must be an integral column and ``keys`` not empty. ``inclusive`` chooses whether the
    current row is part of its own prefix. Output: the input columns plus one column per entry of
    ``sums`` / ``lasts``.
    """
    sums = dict(sums or {})
    lasts = dict(lasts or {})
    if not sums and not lasts:
        raise ValueError("bucketed_scan needs at least one sum or last")
    keys, b, o = list(keys), "__bs_bucket", F.col(order)
    tmp = df.select("*", *[x.cast("long").alias(f"__bs_s_{n}") for n, x in sums.items()],
                    *[x.alias(f"__bs_l_{n}") for n, x in lasts.items()])
    # 1. how wide a bucket of a key is
    span = df.groupBy(*keys).agg(F.min(o).alias("__bs_lo"), F.max(o).alias("__bs_hi"),
                                 F.ceil(F.count(F.lit(1)) / width).alias("__bs_n"))
    step = F.greatest(F.ceil((F.col("__bs_hi") - F.col("__bs_lo") + 1) / F.col("__bs_n")), F.lit(1))
    span = span.select(*keys, "__bs_lo", step.alias("__bs_step"))
    tmp = _attach(tmp, span, keys).withColumn(
        b, F.coalesce(F.floor((o - F.col("__bs_lo")) / F.col("__bs_step")).cast("long"), F.lit(-1)))
    tmp = tmp.drop("__bs_lo", "__bs_step")
    # 2. totals of the buckets before
    place = F.struct(F.coalesce(o.cast("long"), F.lit(-(1 << 63))), *tiebreak)
    total = tmp.groupBy(*keys, b).agg(
        *[F.sum(f"__bs_s_{n}").alias(f"__bs_T_{n}") for n in sums],
        *[F.max_by(f"__bs_l_{n}", F.when(F.col(f"__bs_l_{n}").isNotNull(), place)).alias(f"__bs_T_{n}")
          for n in lasts])
    wb = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(
        *keys, b,
        *[F.coalesce(F.sum(f"__bs_T_{n}").over(wb), F.lit(0)).alias(f"__bs_O_{n}") for n in sums],
        *[F.last(f"__bs_T_{n}", ignorenulls=True).over(wb).alias(f"__bs_O_{n}") for n in lasts])
    # 3. running values inside a bucket, then what came before it
    run = Window.partitionBy(*keys, b).orderBy(*_cols([order, *tiebreak])) \
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    x = tmp.select(*df.columns, b,
                   *[F.sum(f"__bs_s_{n}").over(run).alias(f"__bs_r_{n}") for n in sums],
                   *[F.last(f"__bs_l_{n}", ignorenulls=True).over(run).alias(f"__bs_r_{n}") for n in lasts])
    out = _attach(x, before, [*keys, b])
    return out.select(
        *[c for c in df.columns if c not in sums and c not in lasts],
        *[(F.col(f"__bs_O_{n}") + F.coalesce(F.col(f"__bs_r_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(F.col(f"__bs_r_{n}"), F.col(f"__bs_O_{n}")).alias(n) for n in lasts])


def _attach(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``side`` (one row per key); null keys meet null keys."""
    named = side.select(*[F.col(k).alias(f"__bs_k_{i}") for i, k in enumerate(keys)],
                        *[c for c in side.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(named[f"__bs_k_{i}"])
    return rows.join(named, same, "left").drop(*[f"__bs_k_{i}" for i in range(len(keys))])


def row_index(df: DataFrame, keys: Sequence[str], order: str, name: str = "row_idx",
              tiebreak: Sequence[str] = (), width: int = DEFAULT_WIDTH) -> DataFrame:
    """0-based position of each row within ``keys`` by (``order``, ``tiebreak``)."""
    out = bucketed_scan(df, keys, order, sums={name: F.lit(1)}, inclusive=False,
                        tiebreak=tiebreak, width=width)
    return out


def running_sums(df: DataFrame, order: str, sums: dict[str, Column], width: int = DEFAULT_WIDTH) -> DataFrame:
    """Exclusive running sums over ``order`` of the whole table: one order, without any key.

    Ids are cut into buckets of ``width`` values, and buckets into as many again. Totals of buckets are a map-side
    aggregate; their prefix runs within an upper bucket, and only the upper buckets' totals (one row for ``width`` squared
    values) meet in one task. The rows move once, by bucket, where ``order`` values should be distinct.
    """
    place = df.select("*", *[x.cast("long").alias(f"__rs_{n}") for n, x in sums.items()],
                      F.floor(F.col(order) / width).cast("long").alias("__rs_b"))
    upper = F.floor(F.col("__rs_b") / width).cast("long").alias("__rs_u")
    total = place.groupBy("__rs_b").agg(*[F.sum(f"__rs_{n}").alias(n) for n in sums]).select("*", upper)
    before = lambda w: [F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(n)
                        for n in sums]
    tops = total.groupBy("__rs_u").agg(*[F.sum(n).alias(n) for n in sums])
    tops = tops.select("__rs_u", *before(Window.orderBy("__rs_u")))
    start = (total.select("__rs_b", "__rs_u", *before(Window.partitionBy("__rs_u").orderBy("__rs_b"))).alias("l")
             .join(tops.alias("u"), "__rs_u")
             .select("__rs_b", *[(F.col(f"l.{n}") + F.col(f"u.{n}")).alias(f"__rs_o_{n}") for n in sums]))
    run = Window.partitionBy("__rs_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = place.select(*df.columns, "__rs_b", *[F.coalesce(F.sum(f"__rs_{n}").over(run), F.lit(0)).alias(f"__rs_r_{n}")
                                                 for n in sums])
    return rows.join(start, "__rs_b").select(
        *[c for c in df.columns if c not in sums], *[(F.col(f"__rs_o_{n}") + F.col(f"__rs_r_{n}")).alias(n) for n in sums])
