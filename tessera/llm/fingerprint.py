"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

A text's shingles are its runs of ``shingle`` words (``[^\\x20\\x09-\\x0D]+``, unchanged; a shorter text is one
shingle). Each shingle is hashed once: the hash's top bits name one of ``bins`` bins, and a bin keeps its least hash.
An empty bin takes the value of the first filled bin in a random order of all bins that is its own (the same
for all texts), so two texts that agree in what is filled agree in what is filled up, and every bin stays an unbiased
vote. Of each value, hashed anew with its bin, ``bits`` bits are stored, packed. ``likeness`` is the share of equal values,
corrected for values that agree by chance (one in 2**bits): an estimate of the Jaccard similarity of the shingle sets.

``edits`` holds every document against an edited text, made of the document and of the one that follows it by id. The
order is found without one window over all rows: ids alone are dealt into ranges first, each range's least row is
known from that, and rows go to their range once, with a copy of every range's least row in the range before it.

Defined results: null text counts as the empty text; a text without words has the empty fingerprint (likeness 1 to
another one, 0 to any other text); equal texts have equal fingerprints; rows of one id follow each other by a hash
of their text, null ids come first, and equal rows follow each other; a lone row follows itself; an empty table
gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import flat_words, input_bytes, ranges, slices
from tessera.llm.substr import _mix, rolling, word_hashes

SHINGLE, BINS, BITS = 5, 512, 4
RANGE_BYTES = 16 << 20  # of text in a range of ids
RANGES = 4              # a task: hashed, one range a task would leave many tasks idle and some with several
PROBES = 24  # bins tried one by one; rarer cases look at all filled bins at once, with the same result


@cache
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Every bin's own random order of all bins, and each bin's place in it."""
    cell = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
    order = np.argsort(_mix(_mix((cell + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(bins)[None, :].repeat(bins, 0), axis=1)
    return order.astype(np.int32), place.astype(np.int32)


def shingle_hashes(text: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, flat, and the text of each."""
    words, at = flat_words(text)
    one, count = word_hashes(words), np.diff(at)
    out, row = [], []
    for width in range(1, shingle + 1):
        rows = np.flatnonzero(count == width if width < shingle else count >= shingle)
        if len(rows):
            n = count[rows] - width + 1
            out.append(rolling(one, width)[ranges(at[:-1][rows], n)])
            row.append(np.repeat(rows, n))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _mix(_mix(np.concatenate(out))), np.concatenate(row)


def densify(value: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """``value`` (texts x bins) with every empty bin filled; texts without any filled bin stay as they are."""
    bins = value.shape[1]
    order, place = _orders(bins)
    out = value.copy()
    row, empty = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for t in range(min(PROBES, bins)):
        if not len(row):
            return out
        probe = order[empty, t]
        hit = filled[row, probe]
        out[row[hit], empty[hit]] = value[row[hit], probe[hit]]
        row, empty = row[~hit], empty[~hit]
    cut = np.flatnonzero(np.diff(row, prepend=-1))
    for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(row)).tolist()):
        full = np.flatnonzero(filled[row[lo]])
        bin_ = empty[lo:hi]
        out[row[lo], bin_] = value[row[lo], full[place[bin_][:, full].argmin(axis=1)]]
    return out


def fingerprints(text: pa.Array, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """The packed fingerprint of every text (``bins`` a power of two, ``bits`` 1, 2, 4 or 8)."""
    h, row = shingle_hashes(text, shingle)
    least = np.full(len(text) * bins, np.uint64(0xFFFFFFFFFFFFFFFF))
    where = (h >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64) + row * bins
    np.minimum.at(least, where, h)
    filled = np.zeros(len(least), bool)
    filled[where] = True
    least, filled = least.reshape(-1, bins), filled.reshape(-1, bins)
    # a value that fills many bins must not agree by chance in all of them: each bin takes other bits of it
    own = _mix(np.arange(1, bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = (_mix(_mix(densify(least, filled) ^ own)) >> np.uint64(64 - bits)).astype(np.uint8)
    each = 8 // bits
    packed = np.zeros((len(text), bins // each), np.uint8)
    for i in range(each):
        packed |= low[:, i::each] << np.uint8(i * bits)
    any_ = filled.any(axis=1)
    return [p.tobytes() if a else b"" for p, a in zip(packed, any_.tolist())]


def likeness(a: list[bytes], b: list[bytes], bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity (0 to 1) of the texts of each pair of fingerprints."""
    out = np.array([float(not x and not y) for x, y in zip(a, b)])
    both = [i for i, (x, y) in enumerate(zip(a, b)) if x and y]
    if not both:
        return out
    x, y = (np.frombuffer(b"".join(s[i] for i in both), np.uint8).reshape(len(both), -1) for s in (a, b))
    differ, mask, each = x ^ y, np.uint8((1 << bits) - 1), 8 // bits
    equal = sum(((differ >> np.uint8(i * bits) & mask) == 0).sum(axis=1) for i in range(each))
    chance = 2.0 ** -bits
    out[both] = np.clip((equal / (x.shape[1] * each) - chance) / (1 - chance), 0, 1)
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint binary) of every row."""
    def run(batches):
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(
                fingerprints(b.column("text"), shingle, bins, bits), pa.binary())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "doc_id long, fingerprint binary")


def _key(doc: int | None, h: int) -> tuple:
    return doc is not None, doc or 0, h


def _bounds(rows: DataFrame) -> list[tuple]:
    """The least (id, hash) of each of the ranges that the rows are cut into, ascending.

    Only ids and hashes are shuffled; one entry for ``RANGE_BYTES`` of text (or ``RANGES`` a shuffle partition) reaches
    the driver.
    """
    count = max(RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                input_bytes(rows, "text") // RANGE_BYTES)
    first = (rows.select("doc_id", "h").repartitionByRange(count, "doc_id", "h")
             .groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "h")).alias("k")))
    return sorted({_key(r.k.doc_id, r.k.h) for r in first.collect()})


def _deal(rows: DataFrame, bounds: list[tuple], size: tuple) -> DataFrame:
    """Every row with its fingerprint and range; a range's least row also as the last (``guest``) of the one before."""
    shared = rows.sparkSession.sparkContext.broadcast(bounds)

    def run(batches):
        first = shared.value
        for b in slices(batches, "text"):
            keys = [_key(d, h) for d, h in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist())]
            own = [bisect_right(first, k) - 1 for k in keys]
            guest = [i for i, (k, r) in enumerate(zip(keys, own)) if first[r] == k]
            at = pa.array(list(range(len(keys))) + guest)
            prints = pa.array(fingerprints(b.column("text"), *size), pa.binary())
            to = own + [(own[i] - 1) % len(first) for i in guest]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array([False] * len(keys) + [True] * len(guest)),
                 *[c.take(at) for c in (*b.columns, prints)]],
                ["range", "guest", *b.schema.names, "print"])

    return rows.mapInArrow(run, "range int, guest boolean, doc_id long, text string, h long, print binary")


def edits(docs: DataFrame, part: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
          bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Every document beside its edited text, whose last 1/``part`` of code points is the start of the next document.

    Returns (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next): fingerprints as
    binary, ``near_edited`` and ``near_next`` the likeness to the edited text and to the next document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    size = (shingle, bins, bits)
    bounds = _bounds(rows)
    dealt = (_deal(rows, bounds, size).repartition(-(-len(bounds) // RANGES) or 1, "range")
             .sortWithinPartitions("range", "guest", "doc_id", "h", "text")
             .drop("h"))

    def run(batches):
        last = None  # (range, guest, doc_id, text, print): the row that waits for its next one
        for b in slices(batches, "text"):
            line = ([] if last is None else [last]) + list(zip(*(c.to_pylist() for c in b.columns)))
            last = line[-1]
            pairs = [(x, y) for x, y in zip(line, line[1:]) if not x[1]]
            if any(x[0] != y[0] for x, y in pairs):
                raise RuntimeError("a range ends without the least row of the next one")
            if not pairs:
                continue
            keep = [len(x[3]) - len(x[3]) // part for x, _ in pairs]
            edited = pa.array([x[3][:k] + y[3][:len(x[3]) - k] for (x, y), k in zip(pairs, keep)], pa.string())
            own, after = [x[4] for x, _ in pairs], [y[4] for _, y in pairs]
            new = fingerprints(edited, *size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                 edited, pa.array(own, pa.binary()), pa.array(new, pa.binary()),
                 pa.array(likeness(own, new, bits)), pa.array(likeness(own, after, bits))],
                ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        if last is not None and not last[1]:
            raise RuntimeError("a range ends without the least row of the next one")

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited string, fingerprint binary, "
                                 "edited_fingerprint binary, near_edited double, near_next double")
