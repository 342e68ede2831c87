"""Substring dedup: windows that occur more than once, by super-k-mer partitioning.

A window is ``k`` consecutive words. Each window's minimiser is its ``m``-word gram of
least rank (a 64-bit hash); runs of consecutive windows with one minimiser travel as one
packed string to the bucket of that minimiser, so equal windows always meet. There the
windows are sorted by a rolling hash and runs of equal hashes are compared word by word:
the count is exact.

Skew. Grams that make up a sizeable share of all grams (a heavy-hitter pass whose result is
bounded by ``HOT_SHARE``) rank last, so a window leaves a hot passage's bucket as soon as it
holds any other gram. Windows made of hot grams only are equal strings over and over: each
task sends such a string once, and answers its further copies itself, as every string that
repeats inside a slice. So a bucket gets a hot string at most once a task (or slice).

Defined results: null, empty or shorter texts have no window and keep their words; equal
rows (also with one ``doc_id``) are occurrences of each other; a null ``doc_id`` keeps its
row; a word of any length counts as one word; an empty table gives no row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_BYTES, flat_words, input_bytes, joined, ranges, save, slices

#: A gram is hot when it is at least this share of all grams; at most 2 / HOT_SHARE are kept.
HOT_SHARE = 1 / 20_000
BUCKET_BYTES = 4 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)  # odd: invertible modulo 2**64
HOT_BIT = np.uint64(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, MULT, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive entries of ``h`` (polynomial modulo 2**64)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width == 1:
        return h
    half = width // 2
    a = rolling(h, half)
    if width % 2:
        a1 = a[:n + 1] * _powers(half + 1)[half] + a[half:half + n + 1]
        return a1[:n] * MULT + h[width - 1:]
    return a[:n] * _powers(half + 1)[half] + a[half:half + n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, cur = 1, x
    while size * 2 <= width:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    if size < width:
        cur = np.minimum(cur[:len(cur) - (width - size)], cur[width - size:])
    return cur


def word_hashes(words: pa.Array) -> np.ndarray:
    d = words.dictionary_encode()
    xxh = xxhash.xxh3_64_intdigest
    h = np.fromiter((xxh(w) for w in d.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(d.dictionary))
    return h[d.indices.to_numpy()] if len(h) else np.zeros(0, np.uint64)


def _grams(text: pa.Array, m: int):
    """Words, row offsets and the hash of each m-gram that lies inside one row (others: dropped)."""
    words, at = flat_words(text)
    g = _mix(rolling(word_hashes(words), m))
    return words, at, g


def hot_grams(docs: DataFrame, m: int, share: float = HOT_SHARE) -> np.ndarray:
    """Sorted hashes of every gram with at least ``share`` of all (at most ``2 / share`` of them).

    A gram with the full share has it in some slice, too; slices report grams from half the
    share on, so sums of at least half the share are kept and none is missed.
    """
    def run(batches):
        for b in slices(batches, "text"):
            words, at, g = _grams(b.column("text"), m)
            n = np.maximum(np.diff(at) - m + 1, 0)
            g = g[ranges(at[:-1], n)]
            g.sort()
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            u, c = g[first], np.diff(np.append(first, len(g)))
            few = max(2, len(g) * share / 2)
            u, c = u[c >= few], c[c >= few]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(u.view(np.int64), 0)), pa.array(np.append(c, len(g))),
                 pa.array(np.append(np.zeros(len(u), bool), True))], ["gram", "n", "total"])

    part = save(docs.select("text").mapInArrow(run, "gram long, n long, total boolean")
                .groupBy("gram", "total").agg(F.sum("n").alias("n")), "grams")
    total = part.where("total").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = part.where(~F.col("total") & (F.col("n") >= max(64, total * share / 2))).select("gram").toPandas()
    return np.sort(hot["gram"].to_numpy(np.int64).view(np.uint64))


def super_kmers(text: pa.Array, k: int, m: int, hot: np.ndarray):
    """Runs of windows with one minimiser: joined words, and per run its row, first word in the
    row, number of windows, minimiser, and byte range."""
    words, at, g = _grams(text, m)
    n = np.diff(at)
    rows = np.flatnonzero(n >= k)
    data, start, end = joined(words)
    if not len(rows):
        z = np.zeros(0, np.int64)
        return data, z, z, z, np.zeros(0, np.uint64), z, z
    if len(hot):
        i = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
        g = np.where(hot[i] == g, g | HOT_BIT, g & ~HOT_BIT)
    else:
        g = g & ~HOT_BIT
    low = sliding_min(g, k - m + 1)
    count = n[rows] - k + 1
    first = ranges(at[:-1][rows], count)  # word index of every window
    row = np.repeat(rows, count)
    least = low[first]
    new = np.ones(len(first), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    s = np.flatnonzero(new)
    size = np.diff(np.append(s, len(first)))
    w0 = first[s]
    return data, row[s], w0 - at[:-1][row[s]], size, least[s], start[w0], end[w0 + size + k - 2]


def _pack(strings: list[bytes], doc: np.ndarray, key: np.ndarray, pos: np.ndarray, many: np.ndarray) -> bytes:
    """One compressed block: strings (no newline inside a word), then four arrays."""
    body = b"\n".join(strings)
    raw = np.array([len(strings), len(body)], np.int64).tobytes() + body + doc.tobytes() + key.tobytes() \
        + pos.astype(np.int32).tobytes() + many.astype(np.uint8).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(block: bytes):
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, size = np.frombuffer(raw, np.int64, 2).tolist()
    at = 16 + size
    doc, key = (np.frombuffer(raw, np.int64, n, at + 8 * n * i) for i in (0, 1))
    pos = np.frombuffer(raw, np.int32, n, at + 16 * n)
    many = np.frombuffer(raw, np.uint8, n, at + 20 * n)
    return raw[16:at].split(b"\n") if n else [], doc, key, pos, many


def repeated_windows(strings: list[bytes], many: np.ndarray, k: int) -> list[np.ndarray]:
    """For each string of words, which of its windows occur more than once.

    ``many[i]``: string i stands for more than one occurrence. Strings are distinct or not.
    """
    col = pa.array(strings, pa.binary()).cast(pa.string())
    words, at = flat_words(col)
    d = words.dictionary_encode()
    ids = d.indices.to_numpy().astype(np.int64)  # equal ids if and only if equal words
    h = rolling(_mix(ids.astype(np.uint64) + np.uint64(1)), k)
    count = np.diff(at) - k + 1
    first = ranges(at[:-1], count)
    hw = h[first]
    dup = np.repeat(many.astype(bool), count)
    order = np.argsort(hw, kind="stable")
    f, s = first[order], hw[order]
    d_sorted = dup[order]
    # neighbours in hash order, compared word by word
    cand = np.flatnonzero(s[1:] == s[:-1])
    same = np.zeros(max(len(s) - 1, 0), bool)
    for i in range(0, len(cand), 200_000):
        c = cand[i:i + 200_000]
        ok = np.ones(len(c), bool)
        for j in range(k):
            ok &= ids[f[c] + j] == ids[f[c + 1] + j]
        same[c] = ok
    if len(cand) and not same[cand].all():
        # two different windows share a hash: settle that run of hashes by the words themselves
        for v in np.unique(s[cand[~same[cand]]]).tolist():
            lo, hi = np.searchsorted(s, np.uint64(v)), np.searchsorted(s, np.uint64(v), side="right")
            sub = np.arange(lo, hi)
            rank = np.lexsort(np.stack([ids[f[sub] + j] for j in range(k)]))
            order[sub], f[sub], d_sorted[sub] = order[sub][rank], f[sub][rank], d_sorted[sub][rank]
            w = np.stack([ids[f[sub] + j] for j in range(k)], axis=1)
            same[lo:hi - 1] = (w[1:] == w[:-1]).all(axis=1)
    left = np.zeros(len(s), bool)
    left[1:] = same
    left[:-1] |= same
    # an occurrence that stands for many makes its equal windows repeated; equal ones already are
    out = np.zeros(len(s), bool)
    out[order] = left | d_sorted
    return np.split(out, np.cumsum(count)[:-1]) if len(count) else []


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


ANSWER = "doc_id long, key long, start int, n int"


def _deal(docs: DataFrame, k: int, m: int, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, block): super-k-mers to ask about, and answers already known (bucket by slice)."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most 2 / HOT_SHARE numbers

    def run(batches):
        sent: dict[bytes, bool] = {}  # strings of hot grams only: few, and sent once a task
        for b in slices(batches, "text", 2 * SLICE_BYTES):
            data, row, pos, size, least, lo, hi = super_kmers(b.column("text"), k, m, shared.value)
            if not len(row):
                continue
            doc = b.column("doc_id").fill_null(0).to_numpy()[row]
            key = b.column("key").to_numpy()[row]
            is_hot = (least & HOT_BIT) != 0
            to = (_mix(least) % np.uint64(buckets)).astype(np.int64)
            seen: dict[bytes, int] = {}
            many = np.zeros(len(row), np.uint8)
            known_at, ask_at, strings = [], [], []
            for i, (a, z, h) in enumerate(zip(lo.tolist(), hi.tolist(), is_hot.tolist())):
                s = data[a:z]
                if h and s in sent:
                    # a copy went out from this task before; that one asks, and now stands for two
                    if not sent[s]:
                        sent[s] = True
                        many[i] = 1
                        ask_at.append(i)
                        strings.append(s)
                    known_at.append(i)
                    continue
                j = seen.setdefault(s, i)
                if j == i:
                    ask_at.append(i)
                    strings.append(s)
                    if h and len(sent) < 100_000:
                        sent[s] = False
                else:
                    known_at += [i] if many[j] else [j, i]
                    many[j] = 1
            out_bucket, out_block = [], []
            ask_at = np.array(ask_at, np.int64)
            by = np.argsort(to[ask_at], kind="stable")
            cut = np.flatnonzero(np.diff(to[ask_at][by])) + 1
            for part in np.split(by, cut):
                i = ask_at[part]
                out_bucket.append(int(to[i[0]]))
                out_block.append(_pack([strings[j] for j in part.tolist()], doc[i], key[i], pos[i], many[i]))
            if known_at:
                i = np.array(known_at, np.int64)
                out_bucket.append(-1 - int(key[i[0]] % np.int64(buckets)))
                out_block.append(zstandard.ZstdCompressor(level=3).compress(
                    np.stack([doc[i], key[i], pos[i], size[i]]).astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int64()), pa.array(out_block, pa.binary())],
                                             ["bucket", "block"])

    return docs.mapInArrow(run, "bucket long, block binary")


def _count(k: int):
    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        out: list[np.ndarray] = []
        if len(table) and table.column("bucket")[0].as_py() < 0:
            for x in blocks:
                out.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64).reshape(4, -1))
        else:
            strings, parts = [], []
            for x in blocks:
                s, *rest = _unpack(x)
                strings += s
                parts.append(rest)
            doc, key, pos, many = (np.concatenate(v) for v in zip(*parts))
            flags = repeated_windows(strings, many > 0, k)
            for i in np.flatnonzero(many == 0).tolist():  # the others are answered by their task
                if flags[i].any():
                    s, n = _runs(flags[i])
                    out.append(np.stack([np.full(len(s), doc[i]), np.full(len(s), key[i]), pos[i] + s, n]))
        a = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
        return pa.table([pa.array(a[0]), pa.array(a[1]), pa.array(a[2].astype(np.int32)),
                         pa.array(a[3].astype(np.int32))], names=["doc_id", "key", "start", "n"])
    return run


def _cut(k: int):
    def run(batches):
        for b in slices(batches, "text"):
            text = b.column("text")
            words, at = flat_words(text)
            data, start, end = joined(words)
            found = b.column("found").to_pylist()
            n_words, n_removed, kept = [], [], []
            for r, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                n = hi - lo
                n_words.append(n)
                f = found[r]
                if not f or not n:
                    n_removed.append(0)
                    kept.append(data[start[lo]:end[hi - 1]] if n else b"")
                    continue
                v = np.frombuffer(f, np.int32).reshape(-1, 2)
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, v[:, 0], 1)
                np.add.at(cover, v[:, 0] + v[:, 1] + k - 1, -1)
                gone = np.cumsum(cover[:n]) > 0
                n_removed.append(int(gone.sum()))
                s, c = _runs(~gone)
                kept.append(b" ".join(data[start[lo + i]:end[lo + i + j - 1]]
                                      for i, j in zip(s.tolist(), c.tolist())))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])
    return run


def _gather(batches):
    for b in batches:
        found = []
        for v in b.column("runs"):
            x = np.asarray(v.values).astype(np.int64)
            found.append(np.stack([x >> 32, x & 0xFFFFFFFF], axis=1).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(found, pa.binary())],
                                         ["doc_id", "key", "found"])


def remove_repeats(docs: DataFrame, k: int = 35, m: int = 5, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row: ``kept`` is the words that no repeated window covers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a row is known by its id and its text's hash: ids may be null or repeat
    keyed = rows.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("key"),
                        "text")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                  input_bytes(rows, "text") // BUCKET_BYTES)
    dealt = _deal(keyed, k, m, hot_grams(rows, m), buckets)
    answers = dealt.groupBy("bucket").applyInArrow(_count(k), ANSWER)
    runs = (answers.groupBy("doc_id", "key")
            # a set: rows that are equal in id and text find the same runs, however many they are
            .agg(F.collect_set(F.shiftleft(F.col("start").cast("long"), 32) + F.col("n")).alias("runs"))
            .mapInArrow(_gather, "doc_id long, key long, found binary"))
    full = keyed.withColumn("id0", F.coalesce("doc_id", F.lit(0)))
    out = full.join(runs.withColumnRenamed("doc_id", "id0"), ["id0", "key"], "left")
    return out.select("doc_id", "text", "found").mapInArrow(
        _cut(k), "doc_id long, n_words long, n_removed long, kept string")
