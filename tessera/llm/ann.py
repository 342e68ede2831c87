"""Approximate nearest neighbours by cross-polytope hashing with multiprobe.

Vectors are filed by direction, each scaled by its own norm, so no vector's length moves another one. A table
turns unit vectors by a fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) and files each under its nearest signed axis. A query probes the ``probes`` signed axes, over
all tables, where its own coordinates are largest; the vectors filed there are its candidates, and
every candidate is scored exactly, on the original vectors, in double precision and in one fixed
order of additions, so that equal vectors tie exactly.

Probing meets a vector with a probability that grows with its cosine to the query; ``reach`` is the cosine from
which it is ``sure``. Vectors also lie in ranges of norms (``RANGES`` to a doubling). By the Cauchy-Schwarz
inequality a vector of a range whose largest norm is m beats a query's k-th score s only from a cosine of
s / (|q| m) on; where that is below the reach, or the query has fewer than ``k`` candidates, the query
is held against the whole range. So short and long vectors are found as surely as equal ones.

Buckets are cut into blocks of ``block`` vectors and ``block`` queries (salted by id), so a
direction that a third of all vectors share is many blocks, all of which its queries visit: nothing is
capped. A block gives at most ``k`` rows a query.

Defined results: vectors null, zero, with null or non-finite components, with a null id or not of the
most frequent dimension take no part; rows equal in id and vector count once, and rows of one id are no
neighbours of each other; fewer other vectors than ``k`` give as many rows; no query or no vector gives no
row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import save

SEED = 20
RANGES = 4


def _signs(table: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, dim]).choice(np.array([-1.0, 1.0]), (3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised Walsh-Hadamard transform of the rows (length a power of two)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    d = x.shape[1]
    for s in _signs(table, d):
        x = hadamard(x * s) / np.sqrt(d)
    return x


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the next power of two above the dimension, and the binary logarithms of the norms."""
    n, d = v.shape
    most = np.abs(v).max(axis=1, keepdims=True)
    norm = np.sqrt(((v / most) ** 2).sum(axis=1, keepdims=True))
    out = np.zeros((n, 1 << d.bit_length()))
    out[:, :d] = v / most / norm
    return out, (np.log2(most) + np.log2(norm))[:, 0]


def axes(x: np.ndarray, tables: int) -> np.ndarray:
    """(rows, tables): the nearest signed axis; axis a is a if positive, d + a if negative."""
    out = np.empty((len(x), tables), np.int32)
    for t in range(tables):
        r = rotate(x, t)
        a = np.abs(r).argmax(axis=1)
        out[:, t] = a + x.shape[1] * (r[np.arange(len(x)), a] < 0)
    return out


def probe_axes(x: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """(rows, probes): table * 2d + signed axis, the largest signed coordinates over all tables."""
    d = x.shape[1]
    every = np.empty((len(x), tables * 2 * d), np.float32)
    for t in range(tables):
        r = rotate(x, t)
        every[:, t * 2 * d:(t * 2 + 1) * d] = r
        every[:, (t * 2 + 1) * d:(t + 1) * 2 * d] = -r
    if probes >= every.shape[1]:
        return np.broadcast_to(np.arange(every.shape[1]), every.shape)
    return np.argpartition(-every, probes, axis=1)[:, :probes]


def reach(dim: int, tables: int, probes: int, sure: float, pairs: int = 500) -> float:
    """The least cosine (in steps of 0.02) from which on probing meets a vector with probability ``sure``; inf: none.

    Measured on random pairs: the tables' rotations make every direction alike.
    """
    q, w = np.random.default_rng([SEED, dim]).normal(size=(2, pairs, dim))
    q, _ = unit(q)
    w, _ = unit(w - (w * q[:, :dim]).sum(axis=1, keepdims=True) * q[:, :dim])
    n, d = q.shape
    probed = np.zeros((n, tables * 2 * d), bool)
    np.put_along_axis(probed, probe_axes(q, tables, probes), True, axis=1)
    turned = [(rotate(q, t), rotate(w, t)) for t in range(tables)]
    least = float("inf")
    for c in np.arange(50, -1, -1) / 50:
        met = np.zeros(n, bool)
        for t, (a, b) in enumerate(turned):
            v = c * a + np.sqrt(1 - c * c) * b
            at = np.abs(v).argmax(axis=1)
            met |= probed[np.arange(n), t * 2 * d + at + d * (v[np.arange(n), at] < 0)]
        if met.mean() < sure:
            break
        least = float(c)
    return least


def exact_top(q: np.ndarray, q_id: np.ndarray, v: np.ndarray, v_id: np.ndarray, k: int):
    """(query number, vector number, score): each query's k best vectors of another id; ties to smaller ids."""
    out = []
    scale = np.sqrt((v * v).sum(axis=1)).max(initial=0.0)
    for lo in range(0, len(q), 256):
        qs = q[lo:lo + 256]
        s = qs @ v.T
        s[q_id[lo:lo + 256, None] == v_id[None, :]] = -np.inf
        if s.shape[1] > k:
            slack = 1e-9 * scale * np.sqrt((qs * qs).sum(axis=1))
            floor = -np.partition(-s, k - 1, axis=1)[:, k - 1] - slack
        else:
            floor = np.full(len(qs), -np.finfo(float).max)
        i, j = np.nonzero((s >= floor[:, None]) & np.isfinite(s))
        score = np.zeros(len(i))
        for d in range(q.shape[1]):  # one order of additions, whatever the block
            score += qs[i, d] * v[j, d]
        order = np.lexsort((v_id[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        ok = rank < k
        out.append((i[ok] + lo, j[ok], score[ok]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = col.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 16, probes: int = 160,
           block: int = 4096, small: int = 0, sure: float = 0.95, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (a condition on the id column) holds.

    ``small`` is taken for older callers and has no effect: tables of all sizes are searched alike.
    """
    v = F.col("v")
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                           F.coalesce(is_query, F.lit(False)).alias("q"))
            .where(F.col("id").isNotNull() & v.isNotNull()
                   & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                   & F.exists(v, lambda x: x != 0)))
    kinds = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")) \
        .orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not kinds:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = kinds[0][0]
    width = 2 * (1 << int(dim).bit_length())  # signed axes of a table
    # before blocks are cut: copies have one salt, and would take up the k places of their block
    rows = rows.where(F.size("v") == dim).select("id", "q", "v").dropDuplicates(["id", "v"])

    def unpacked(b):
        x = np.asarray(b.column("v").flatten()).reshape(b.num_rows, -1).astype(np.float64)
        return x, pa.array([r.tobytes() for r in x], pa.binary())

    def lists(a):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)),
                                        pa.array(a.ravel().astype(np.int32)))

    def filed(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                x, raw = unpacked(b)
                u, length = unit(x)
                a = axes(u, tables) + np.arange(tables) * width
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), raw, pa.array(length), pa.array(np.floor(length * RANGES).astype(np.int32)), lists(a)],
                    ["id", "x", "length", "range", "buckets"])

    def probing(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                x, raw = unpacked(b)
                u, length = unit(x)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), raw, pa.array(length), pa.array(marks(raw)), lists(probe_axes(u, tables, probes))],
                    ["id", "x", "length", "q", "buckets"])

    def marks(raw):
        return np.array([xxhash.xxh3_64_intdigest(x) for x in raw.to_pylist()], np.uint64).view(np.int64)

    index = save(rows.mapInArrow(filed, "id long, x binary, length double, range int, buckets array<int>"), "ann-index")
    asks = save(rows.where("q").mapInArrow(probing, "id long, x binary, length double, q long, buckets array<int>"),
                "ann-queries")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"query_id": pa.array([], pa.int64()), "q": pa.array([], pa.int64()),
                             "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_id, v_id = (t.column("id").to_numpy() for t in (a, b))
        i, j, score = exact_top(_matrix(a.column("x")), q_id, _matrix(b.column("x")), v_id, k)
        return pa.table({"query_id": pa.array(q_id[i]), "q": pa.array(marks(a.column("x"))[i]), "vec_id": pa.array(v_id[j]),
                         "score": pa.array(score)})

    def scored(asks, index):
        """The ``k`` best of every block for every query that visits it; (id, x, bucket) on both sides."""
        # a row a bucket: tables * signed axes or ranges of norms, whatever the data's size
        cuts = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
        sizes = F.broadcast(save(cuts(index, "vb").join(cuts(asks, "qb"), "bucket"), "ann-sizes"))
        side = lambda df, own, other: (
            df.join(sizes, "bucket").withColumn(own, F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("bucket", "vb", "qb", "id", "x"))
        left = side(asks, "qb", "vb").groupBy("bucket", "vb", "qb")
        right = side(index, "vb", "qb").groupBy("bucket", "vb", "qb")
        return left.cogroup(right).applyInArrow(best, "query_id long, q long, vec_id long, score double")

    # a vector may be met in several tables; a query's rows are at most k a block it visits
    place = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.distinct().withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= k)  # noqa: E731,E501
    by_bucket = lambda df: df.select("id", "x", F.explode("buckets").alias("bucket"))
    met = save(ranked(scored(by_bucket(asks), by_bucket(index))), "ann-met")

    # ranges of norms in which a vector outside the reach of a query's probes could be among its k best
    ranges = F.broadcast(index.groupBy("range").agg(F.max("length").alias("longest")))
    last = met.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "q", "score")
    least = reach(int(dim), tables, probes, sure)
    bound = F.col("length") + F.col("longest") + F.lit(float(np.log2(least)) if least else float("-inf")) + 1e-9
    short = F.col("score").isNull() | (F.col("score") <= 0) | (F.log2("score") < bound)
    open_asks = save(asks.drop("buckets").join(last, ["id", "q"], "left").join(ranges, short)
                     .select("id", "x", F.col("range").alias("bucket")), "ann-open")
    whole = scored(open_asks, index.select("id", "x", F.col("range").alias("bucket")))
    return ranked(met.drop("rank").unionByName(whole)).select("query_id", "rank", "vec_id", "score")
