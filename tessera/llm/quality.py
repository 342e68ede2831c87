"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text is reduced to a row of statistics (shares of character classes, word and line shape,
repetition). The table of statistics is written once; a bounded labelled sample of it fits the
trees, all of it is scored. Trees are grown level by level on histograms of quantile bins with
logistic gradients, and flattened into arrays (feature, cut, left child, value), so that scoring
walks all rows through one tree level at a time in numpy.

Fitting uses at most ``per_class`` rows a label (least hash of the id), a documented bound; the
statistics themselves always cover whole texts.

Defined results: null and empty texts have all statistics 0 and are scored as such; labels
without a document, or null, teach nothing; a label counts once for each different row of
statistics of its id; without labels of both kinds every score is the share of label 1 (0.5 without any);
rows repeat as they are; a null ``doc_id`` keeps its row and is not held out; an empty table gives
no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import flat_words, held_out, least_hashes, ranges, save, slices

STATS = ("n_chars", "n_words", "mean_word", "long_words", "short_words", "upper", "digit", "punct", "symbol",
         "space", "non_ascii", "upper_words", "mark_words", "symbol_words", "unique_words", "top_word",
         "unique_pairs", "unique_shingles", "n_lines", "mean_line", "unique_lines", "line_end", "title_words",
         "same_char", "entropy")

_CLASS = np.zeros(256, np.int64)  # of a byte: 1 lower, 2 upper, 3 digit, 4 punctuation, 5 symbol, 6 space, 7 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
for _c in b".,;:!?'\"()-":
    _CLASS[_c] = 4
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = 5
for _c in b" \t\n\x0b\x0c\r":
    _CLASS[_c] = 6
_CLASS[128:] = 7


def _share_distinct(key: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Per row: distinct keys over keys (1 where there is none)."""
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    total = np.bincount(row, minlength=n)
    return np.where(total > 0, np.bincount(r[new], minlength=n) / np.maximum(total, 1), 1.0)


def _top_share(key: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])) if len(k) else order
    size = np.diff(np.append(first, len(k)))
    out = np.zeros(n)
    np.maximum.at(out, r[first], size)
    return out / np.maximum(np.bincount(row, minlength=n), 1)


def statistics(text: pa.Array) -> np.ndarray:
    """(texts, len(STATS)) float64."""
    text = pc.fill_null(text, "")
    n = len(text)
    out = np.zeros((n, len(STATS)))
    col = {s: i for i, s in enumerate(STATS)}

    def put(name, value):
        out[:, col[name]] = value

    size = pc.binary_length(text).to_numpy().astype(np.int64)
    raw = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), text), "")[0]
                        .as_buffer(), np.uint8)
    row_c = np.repeat(np.arange(n), size)
    kinds = np.bincount(row_c * 8 + _CLASS[raw], minlength=8 * n).reshape(n, 8)
    per = np.maximum(size, 1)
    for j, name in ((2, "upper"), (3, "digit"), (4, "punct"), (5, "symbol"), (6, "space"), (7, "non_ascii")):
        put(name, kinds[:, j] / per)
    put("n_chars", np.log1p(size))
    bins = np.bincount(row_c * 256 + raw, minlength=256 * n).reshape(n, 256) / per[:, None]
    put("entropy", -(bins * np.log2(np.maximum(bins, 1e-12))).sum(axis=1))
    same = (raw[1:] == raw[:-1]) & (row_c[1:] == row_c[:-1])
    put("same_char", np.bincount(row_c[1:][same], minlength=n) / per)

    words, at = flat_words(text)
    w = np.diff(at)
    row_w = np.repeat(np.arange(n), w)
    pw = np.maximum(w, 1)
    d = words.dictionary_encode()
    ids, vocab = d.indices.to_numpy().astype(np.int64), d.dictionary
    length = pc.utf8_length(vocab).to_numpy().astype(np.float64)[ids] if len(ids) else np.zeros(0)

    def share(flags: pa.Array) -> np.ndarray:
        f = pc.cast(flags, pa.int8()).to_numpy(zero_copy_only=False).astype(np.float64)
        return np.bincount(row_w, weights=f[ids] if len(ids) else None, minlength=n) / pw

    put("n_words", np.log1p(w))
    put("mean_word", np.bincount(row_w, weights=length, minlength=n) / pw)
    put("long_words", np.bincount(row_w, weights=length > 15, minlength=n) / pw)
    put("short_words", np.bincount(row_w, weights=length <= 2, minlength=n) / pw)
    put("upper_words", share(pc.and_(pc.utf8_is_upper(vocab), pc.greater(pc.utf8_length(vocab), 1))))
    put("title_words", share(pc.utf8_is_title(vocab)))
    put("mark_words", share(pc.match_substring_regex(vocab, r"[!?.,;:]{2,}$")))
    put("symbol_words", share(pc.match_substring_regex(vocab, r"^[#$%&*+/<=>@\\^_`{|}~-]+$|[#$%&*+<=>@^~|]{2,}")))
    put("unique_words", _share_distinct(ids, row_w, n))
    put("top_word", _top_share(ids, row_w, n))
    for name, k in (("unique_pairs", 2), ("unique_shingles", 5)):
        g = np.maximum(w - k + 1, 0)
        first = ranges(at[:-1], g)
        key = np.zeros(len(first), np.uint64)
        for j in range(k):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[first + j].astype(np.uint64) + np.uint64(1)
        put(name, _share_distinct(key, np.repeat(np.arange(n), g), n))

    lists = pc.split_pattern(text, "\n")
    lines, la = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    nl = np.diff(la)
    row_l = np.repeat(np.arange(n), nl)
    ll = pc.binary_length(lines).to_numpy().astype(np.float64)
    put("n_lines", np.log1p(nl))
    put("mean_line", np.log1p(np.bincount(row_l, weights=ll, minlength=n) / np.maximum(nl, 1)))
    put("unique_lines", _share_distinct(lines.dictionary_encode().indices.to_numpy().astype(np.int64), row_l, n))
    ends = pc.match_substring_regex(lines, r"[.!?]\s*$").cast(pa.int8()).to_numpy(zero_copy_only=False)
    put("line_end", np.bincount(row_l, weights=ends, minlength=n) / np.maximum(nl, 1))
    return np.where((size > 0)[:, None], out, 0.0)


@dataclass
class Trees:
    """Complete trees of ``depth`` levels: node i has children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray      # go right where x > cut
    value: np.ndarray    # (trees, leaves)

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (len(v) - 1)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15,
              bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Histogram gradient boosting with logistic loss; classes may be weighted."""
    inner, leaves = 2 ** depth - 1, 2 ** depth
    empty = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y):
        return empty
    p = float((weight * y).sum() / weight.sum())
    if p <= 0 or p >= 1:
        empty.base = 6.0 if p >= 1 else -6.0
        return empty
    m = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    model = Trees(float(np.log(p / (1 - p))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf),
                  np.zeros((trees, leaves)))
    margin = np.full(len(y), model.base)
    offset = np.arange(m) * bins
    for t in range(trees):
        q = 0.5 * (1 + np.tanh(0.5 * margin))
        g, h = weight * (q - y), weight * q * (1 - q)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            key = ((node - first)[:, None] * m * bins + offset + binned).ravel()
            hist = [np.bincount(key, weights=np.repeat(v, m), minlength=width * m * bins).reshape(width, m, bins)
                    for v in (g, h)]
            gl, hl = (np.cumsum(v, axis=2) for v in hist)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
            gain[(hl < least / 4) | (ht - hl < least / 4)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-6 and b < len(cuts[j]):
                    model.feature[t, first + i], model.cut[t, first + i] = j, cuts[j][b]
            f, c = model.feature[t][node], model.cut[t][node]
            node = 2 * node + 1 + (x[np.arange(len(y)), f] > c)
        leaf = node - inner
        gs, hs = (np.bincount(leaf, weights=v, minlength=leaves) for v in (g, h))
        model.value[t] = -rate * gs / (hs + l2)
        margin += model.value[t][leaf]
    return model


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<double>) per row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in slices(batches, "text"):
            x = statistics(b.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)),
                                            pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), flat], ["doc_id", "stats"])

    return rows.mapInArrow(run, "doc_id long, stats array<double>")


def fit(stats: DataFrame, labels: DataFrame, label_col: str, per_class: int = 4000,
        id_col: str = "doc_id") -> Trees:
    """Trees from at most ``per_class`` rows a label outside the held-out third."""
    own = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
           .where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("y").alias("y")))
    sample = least_hashes(own, "y", "doc_id", per_class)
    # at most per_class ids a label; of rows that repeat an id, one
    got = (stats.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("stats").alias("stats"))
           .orderBy("doc_id").toPandas())
    if not len(got):
        return fit_trees(np.zeros((0, len(STATS))), np.zeros(0), np.zeros(0))
    y = got["y"].to_numpy(np.float64)
    # the sample is balanced by its bound; weights give back the share the labels have
    share = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    taken = {v: max(int((y == v).sum()), 1) for v in (0, 1)}
    weight = np.array([share[int(v)] / taken[int(v)] for v in y])
    return fit_trees(np.stack(got["stats"].to_numpy()), y, weight / weight.mean())


def predict(stats: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) per row of a statistics table."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("stats").flatten()).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.predict(x))],
                                                 ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = 4000,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row of ``docs``: how likely label 1 is."""
    stats = save(statistics_table(docs, id_col, text_col), "stats")
    return predict(stats, fit(stats, labels, label_col, per_class, id_col))
