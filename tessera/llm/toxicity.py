"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade >= k | x) = sigmoid(w . x - theta_k): one weight vector shared by all ordered thresholds,
expected severity = sum over k of P(grade >= k). Features are the distinct words of a text and
their 4- and 5-character heads, hashed; x is 0 or 1. Only features that are clearly commoner in
positive sample rows (``MIN_Z``, ``MIN_LIFT``) take part, and their weights are fitted by
proximal gradient with an L1 penalty: words that tell nothing weigh exactly nothing, however long a text is.

Fitting uses at most ``per_class`` labelled rows a class (least hash of the id), a documented
bound; scoring reads every whole text. ``labels`` may hold grades 0, 1, .. ; where they are only
0 or 1, ``grade_by_count`` grades the positive sample by thirds of the number of telling features.

Defined results: null and empty texts have no feature and score by the thresholds alone; a label
whose id is null, or without a document, teaches nothing; of rows that repeat a labelled id one
teaches; without any labelled row of both kinds every text gets severity 0; rows repeat as they
are; an empty table gives no row; other columns are kept, but for those the result is called by.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import distinct, flat_words, held_out, least_hashes, slices

BITS = 22
HEADS = (4, 5)
MIN_Z = 4.0
MIN_LIFT = 4.0
#: A text counts as toxic from this P(grade >= 1) on: below a half, as one telling word alone may weigh little.
TOXIC_P = 0.3


@dataclass
class Model:
    """weights: 2**BITS floats; thresholds: ascending, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray


def _word_features(words: list[str]) -> np.ndarray:
    """(words, 1 + heads) feature numbers."""
    mask, xxh = (1 << BITS) - 1, xxhash.xxh3_64_intdigest
    out = np.empty((len(words), 1 + len(HEADS)), np.int64)
    out[:, 0] = [xxh(w) & mask for w in words]
    for j, n in enumerate(HEADS, 1):
        out[:, j] = [xxh(w[:n], n) & mask for w in words]
    return out


def _tokens(text: pa.Array):
    """Word numbers by row offsets and the words' text, ASCII-lower-cased and trimmed of punctuation."""
    words, at = flat_words(pc.ascii_lower(text))
    d = pc.ascii_trim(words, string.punctuation).dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), at, d.dictionary.to_pylist()


def features(text: pa.Array) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text."""
    idx, at, vocab = _tokens(text)
    table = _word_features(vocab)
    return [distinct(table[distinct(idx[a:b])].ravel()) for a, b in zip(at[:-1], at[1:])]


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def grade_by_count(rows: list[np.ndarray], positive: np.ndarray, grades: int = 3) -> np.ndarray:
    """Grades 1..``grades`` for positive rows by quantiles of how many telling features they have."""
    out = positive.astype(np.int64)
    if not positive.any() or positive.all():
        return out
    marks = telling(rows, positive)
    count = np.array([marks[r].sum() if p else 0 for r, p in zip(rows, positive)])
    cuts = np.quantile(count[positive], np.arange(1, grades) / grades, method="lower")
    out[positive] = 1 + np.searchsorted(cuts, count[positive], side="left")
    return out


def telling(rows: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """Features whose share of documents is ``MIN_LIFT`` times as high among positives as among the others and
    ``MIN_Z`` standard errors above (two documents at least)."""
    n = [max(int((positive == v).sum()), 1) for v in (False, True)]
    none = [np.zeros(0, np.int64)]
    df = [np.bincount(np.concatenate([r for r, p in zip(rows, positive) if p == v] or none).astype(np.int64),
                      minlength=1 << BITS) for v in (False, True)]
    share = (df[0] + df[1] + 1) / (n[0] + n[1] + 2)
    z = (df[1] / n[1] - df[0] / n[0]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
    return (z >= MIN_Z) & (df[1] >= 2) & (df[1] / n[1] >= MIN_LIFT * df[0] / n[0])


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, steps: int = 1500, l1: float = 1e-4) -> Model:
    """Accelerated proximal gradient on the cumulative-link likelihood with an L1 penalty.

    Positive and other rows weigh the same in total. Weights are not negative: what takes part speaks for a
    higher grade or not at all.
    """
    out = np.zeros(1 << BITS)
    k = int(grades.max(initial=0))
    if not k or not (grades == 0).any():
        return Model(out, np.full(max(k, 1), 50.0))
    used = np.flatnonzero(telling(rows, grades > 0))
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    col = [place[r][place[r] >= 0] for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(c) for c in col])
    col = np.concatenate(col).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    y = np.asarray(grades)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y == 0).sum(), 1))

    def gradient(w, theta):
        s = np.bincount(row, weights=w[col], minlength=len(y)) if len(row) else np.zeros(len(y))
        p = _sigmoid(s[:, None] - theta[None, :])
        up = np.where(y > 0, p[np.arange(len(y)), np.maximum(y - 1, 0)], 1.0)   # P(grade >= y)
        over = np.where(y < k, p[np.arange(len(y)), np.minimum(y, k - 1)], 0.0)  # P(grade > y)
        q = np.maximum(up - over, 1e-9)
        gw = np.bincount(col, weights=(weight * (up + over - 1.0))[row], minlength=len(w)) if len(row) else 0 * w
        gt = np.zeros(k)
        np.add.at(gt, np.maximum(y - 1, 0), np.where(y > 0, weight * up * (1 - up) / q, 0.0))
        np.add.at(gt, np.minimum(y, k - 1), -np.where(y < k, weight * over * (1 - over) / q, 0.0))
        return gw, gt

    # the step of each weight: its share of the curvature's bound, a quarter of the rows' feature counts
    size = np.bincount(row, minlength=len(y))
    bound = np.bincount(col, weights=(weight * size)[row], minlength=len(used)) / 2 + 1e-6
    w, theta = np.zeros(len(used)), np.arange(k) * 1.0 + 1.0
    v, t = w, 1.0
    for _ in range(steps):
        gw, gt = gradient(v, theta)
        new = np.maximum(v - (gw + l1) / bound, 0.0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((v - new) * (new - w)).sum() > 0:
            t_new = 1.0  # went past: start the acceleration anew
            v = new
        else:
            v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
        theta = theta - 0.5 * np.clip(gt, -0.5, 0.5)
        theta = np.maximum.accumulate(theta - 0.1 * np.arange(k)) + 0.1 * np.arange(k)  # ordered
    out[used] = w
    return Model(out, theta)


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str,
                  text_col: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the sample: at most ``per_class`` labels a class outside the held-out third."""
    own = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
           .where("id is not null and label is not null").where(~held_out(F.col("id")))
           .groupBy("id").agg(F.max("label").alias("label")))
    sample = least_hashes(own, "label", "id", per_class)
    # at most per_class rows a label
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")) \
        .join(F.broadcast(sample), "id")

    def run(batches):
        for b in slices(batches, "text"):
            f = [r.astype(np.int32).tobytes() for r in features(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(f, pa.binary())],
                                             ["id", "label", "f"])

    got = (text.select("id", "label", "text").mapInArrow(run, "id long, label int, f binary")
           .groupBy("id", "label").agg(F.min("f").alias("f")).orderBy("id").toPandas())
    return [np.frombuffer(f, np.int32) for f in got["f"]], got["label"].to_numpy(np.int64)


def without_copies(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Row numbers with one of (mostly) each group of near copies of a label, told by four min-hashes."""
    seen, keep = set(), []
    turns = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
    for i, r in enumerate(rows):
        x = r.astype(np.uint64)
        mark = (int(y[i]), *(int(((x + np.uint64(1)) * np.uint64(t) >> np.uint64(20)).min()) if len(x) else -1
                             for t in turns))
        if mark not in seen:
            seen.add(mark)
            keep.append(i)
    return np.array(keep, np.int64)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "grade", per_class: int = 3000,
        by_count: bool = False, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows, y = labelled_rows(docs, labels, label_col, per_class, id_col, text_col)
    keep = without_copies(rows, y)
    rows, y = [rows[i] for i in keep], y[keep]
    return fit_rows(rows, grade_by_count(rows, y > 0) if by_count else y)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row with ``severity double`` (expected grade), ``grade int`` (likeliest) and
    ``toxic_p double`` (P(grade >= 1)) added."""
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds))
    rest = docs.drop("severity", "grade", "toxic_p")
    names = rest.columns

    def run(batches):
        used, weights, theta = shared.value
        w = np.zeros(1 << BITS)
        w[used] = weights
        for b in slices(batches, text_col):
            idx, at, vocab = _tokens(b.column(text_col))
            table = _word_features(vocab)
            live = w[table] != 0
            s = np.zeros(b.num_rows)
            hit = np.flatnonzero(live.any(axis=1)[idx])
            if len(hit):
                row = np.searchsorted(at, hit, side="right") - 1
                f, ok = table[idx[hit]], live[idx[hit]]
                pair = distinct((row[:, None] << BITS | f)[ok])  # a feature counts once a text
                s = np.bincount(pair >> BITS, weights=w[pair & ((1 << BITS) - 1)], minlength=b.num_rows)
            p = _sigmoid(s[:, None] - theta[None, :])
            each = np.concatenate([1 - p[:, :1], p[:, :-1] - p[:, 1:], p[:, -1:]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)),
                 pa.array(p[:, 0])], [*names, "severity", "grade", "toxic_p"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{kinds}, severity double, grade int, toxic_p double")
