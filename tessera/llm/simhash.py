"""SimHash near-duplicates by tiled exact comparison of fingerprints.

1. Fingerprints: ASCII-lower-cased words, ``shingle``-word shingles with repeats,
   XXH64 (seed 42) each; a bit is set where more than half the hashes have it.
   Bits are counted eight lanes at a time in 64-bit words, so no n x 64 table exists.
2. Distinct fingerprints are dealt into cells by the population counts of their equal
   parts (two halves; more for many millions). Parts differ by at least the difference of their counts, so two
   fingerprints within the radius lie in cells whose counts differ by at most the
   radius in total; all other tile pairs are skipped. Cells are cut into tiles of
   bounded size (salted), and tile pairs are compared whole with exclusive-or and
   bit counts. Nothing is missed: the comparison is exact.
3. Links leave a task as a spanning forest of what that task saw, never as all pairs
   of a group, and components come from large-star / small-star rounds whose
   state is a written table.

Defined results: null or empty text has no word and fingerprint zero, linked like any
other; fewer words than the shingle give one shingle of all of them; equal texts and
repeated rows share a fingerprint; a null ``doc_id`` keeps its row and counts for no
minimum (a component of null ids only has a null id); an empty table gives no row; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import flat_words, joined, ranges, save, slices

SEED = 42
TILE_ROWS = 512
LANES = np.uint64(0x0101010101010101)


def bit_counts(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per segment (starts, sizes >= 1) of ``h`` and bit 0..63: how many have it set."""
    blocks = (sizes + 254) // 255  # a byte lane holds up to 255
    first = np.cumsum(blocks) - blocks
    at = np.repeat(starts - 255 * first, blocks) + 255 * np.arange(int(blocks.sum()))
    out = np.empty((len(at), 64), np.int64)
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & LANES, at)
        out[:, j::8] = lanes.view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(out, first, axis=0)


def fingerprint_slice(text: pa.Array, shingle: int) -> np.ndarray:
    """Fingerprints (uint64) of one slice of texts."""
    words, at = flat_words(pc.ascii_lower(text))
    data, start, end = joined(words)
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    has = np.flatnonzero(n)
    if not len(has):
        return out
    count = np.maximum(n[has] - shingle + 1, 1)
    first = ranges(at[:-1][has], count)
    last = first + np.repeat(np.minimum(n[has], shingle), count) - 1
    xxh = xxhash.xxh64_intdigest
    h = np.fromiter((xxh(data[a:b], SEED) for a, b in zip(start[first].tolist(), end[last].tolist())),
                    np.uint64, len(first))
    seg = np.cumsum(count) - count
    over = bit_counts(h, seg, count) * 2 > count[:, None]
    out[has] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, key bigint, fp bigint) per row of ``docs``; ``key`` is ``text_key`` of the text."""
    def run(batches):
        for b in slices(batches, "text"):
            fp = fingerprint_slice(b.column("text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fp)],
                                             ["doc_id", "key", "fp"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def text_key(text: Column) -> Column:
    """Tells rows of one id apart (null: as its own text)."""
    return F.xxhash64(text, text.isNull())


def _forest(parent: dict, a: int, b: int) -> None:
    while (p := parent.setdefault(a, a)) != a:
        parent[a] = parent[p]
        a = p
    while (p := parent.setdefault(b, b)) != b:
        parent[b] = parent[p]
        b = p
    if a != b:
        parent[max(a, b)] = min(a, b)


def _links_of_pairs(max_bits: int):
    def run(batches):
        parent: dict[int, int] = {}
        for b in batches:
            same = b.column("same").to_pylist()
            for s, x, y in zip(same, b.column("x"), b.column("y")):
                # unsigned: numpy counts the bits of a signed number's absolute value
                p = np.frombuffer(x.as_buffer(), np.uint64)
                q = np.frombuffer(y.as_buffer(), np.uint64)
                near = np.bitwise_count(p[:, None] ^ q[None, :]) <= max_bits
                if s:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                for a, c in zip(p[i].view(np.int64).tolist(), q[j].view(np.int64).tolist()):
                    _forest(parent, a, c)
            if len(parent) > 1_000_000:  # bounded memory: what is found so far goes out
                yield _edges(parent)
                parent = {}
        yield _edges(parent)
    return run


def _edges(parent: dict[int, int]) -> pa.RecordBatch:
    kids = [k for k, v in parent.items() if k != v]
    roots = []
    for k in kids:
        while parent[k] != k:
            k = parent[k]
        roots.append(k)
    return pa.RecordBatch.from_arrays([pa.array(kids, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])


def _ball(parts: int, radius: int) -> list[tuple[int, ...]]:
    if not parts:
        return [()]
    return [(d, *rest) for d in range(-radius, radius + 1) for rest in _ball(parts - 1, radius - abs(d))]


def _offsets(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Cell offsets with L1 norm <= radius, one of each opposite pair (and zero)."""
    return [o for o in _ball(parts, radius) if o >= (0,) * parts]


def parts_for(n: int) -> int:
    """How finely population counts are taken: more cells pay off with more fingerprints.

    Only which tile pairs are skipped depends on it, never the result.
    """
    return 2 if n <= 1 << 20 else 4 if n <= 1 << 26 else 8


def links(fps: DataFrame, max_bits: int = 3, parts: int = 2, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) joining every pair of the distinct ``fp`` within ``max_bits``.

    The result spans exactly the connected groups: each task gives a forest of its pairs.
    """
    width = 64 // parts
    mask = (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit(mask))) for k in range(parts)]
    base = 100  # room for counts -radius .. 64 + radius as one number
    code = lambda cols: sum((c.cast("long") + base // 4) * base ** k for k, c in enumerate(cols))
    cells = fps.select("fp", code(counts).alias("cell"))
    # at most (64 / parts + 1) ** parts cells, whatever the data's size
    load = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).alias("cuts"))
    tiles = (cells.join(F.broadcast(load), "cell")
             .withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")))
             .groupBy("cell", "cut").agg(F.sort_array(F.collect_list("fp")).alias("fps")))
    tiles = save(tiles.mapInArrow(_pack, "cell long, cut long, fps binary"), "tiles")
    step = F.array(*[F.lit(sum(d * base ** k for k, d in enumerate(o))).cast("long")
                     for o in _offsets(parts, max_bits)])
    left = tiles.select(F.col("cell").alias("xc"), F.col("cut").alias("xt"), F.col("fps").alias("x"),
                        F.explode(step).alias("step")).withColumn("cell", F.col("xc") + F.col("step"))
    right = tiles.select("cell", F.col("cut").alias("yt"), F.col("fps").alias("y"))
    pairs = (left.join(right, "cell").where((F.col("xc") != F.col("cell")) | (F.col("xt") <= F.col("yt")))
             .withColumn("same", (F.col("xc") == F.col("cell")) & (F.col("xt") == F.col("yt"))))
    # comparing costs far more than the bytes suggest: spread tile pairs over all tasks
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(tasks, "xc", "xt", "cell", "yt").select("same", "x", "y")
    return pairs.mapInArrow(_links_of_pairs(max_bits), "a long, b long")


def _pack(batches):
    for b in batches:
        fps = [np.asarray(v.values).astype(np.int64).tobytes() for v in b.column("fps")]
        yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("cut"), pa.array(fps, pa.binary())],
                                         ["cell", "cut", "fps"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b): the smallest node of its component.

    Large-star and small-star rounds until nothing changes; each round's edges are a
    written table. A node's neighbours are aggregated to their minimum, never gathered.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        # a > b in e; large: link larger neighbours to the smallest; small: smaller ones
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v") if large else e.toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        got = both.join(low, "u")
        out = got.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else \
            got.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                got.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def mark(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    e = save(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
             .distinct(), "edges")
    seen = mark(e)
    while seen[0]:
        e = save(star(star(e, True), False), "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b"), F.col("b")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text", parts: int | None = None,
                    tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, key, fp, root, component_id) per row: ``component_id`` is the smallest id reachable by
    links of at most ``max_bits``, ``root`` the smallest fingerprint (unsigned order not implied)."""
    fp = save(fingerprints(docs, shingle, id_col, text_col), "fps")
    own = save(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    group = components(links(own.select("fp"), max_bits, parts or parts_for(own.count()), tile_rows))
    linked = own.join(group, own["fp"] == group["node"]).select("fp", "root", "least")
    low = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(low, "root").select("fp", "root", "component_id")
    # a fingerprint without links is a component of its own
    every = own.join(named, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    # as a table, so that the join of a fingerprint that many rows share can be split
    return fp.join(save(every, "components"), "fp").select("doc_id", "key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each group of ``near_duplicates`` keeps the row of its least id
    (null ids last; of equal rows one)."""
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"))
    stays = first.select(F.col("m.doc_id").alias("_keep_id"), F.col("m.key").alias("_keep_key")).distinct()
    rows = docs.withColumn("_row_key", text_key(F.col(text_col))).withColumn("_row_id", F.col(id_col).cast("long"))
    same = rows["_row_id"].eqNullSafe(stays["_keep_id"]) & (rows["_row_key"] == stays["_keep_key"])
    return (rows.join(stays, same, "left_semi").dropDuplicates(["_row_id", "_row_key"])
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
