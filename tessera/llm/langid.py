"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text are hashed; a text's value for a gram is its share
of the text's grams times the gram's inverse document frequency, counted over all training
documents (not a sample). Weights come from follow-the-regularised-leader with an elastic-net
penalty; a temperature, fitted on a slice of the sample that the weights have not seen, calibrates
the probabilities.

Fitting the weights uses at most ``per_class`` documents a language (least hash of id and text), a
documented bound. As values are shares, a text's score is a mean over its grams, so whole texts are
scored in one pass without sorting.

Defined results: null texts and texts without a letter get ``und`` and score 0; null languages
teach nothing; with one language every text with a letter gets it and score 1; without any, ``und``;
rows repeat as they are; a null ``doc_id`` keeps its row; an empty table gives no row; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import distinct, held_out, least_hashes, slices

BITS = 15
DIMS = 1 << BITS
UNKNOWN = "und"
SCALE = 50.0  # shares of grams are small: brings values near one, where the learner's constants fit


@dataclass
class Model:
    languages: list
    weights: np.ndarray  # (DIMS, languages), inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1-, 2- and 3-grams of every text, flat, with n+1 offsets.

    Each text is its lower-cased code points between two spaces; each position starts three grams.
    """
    padded = pc.binary_join_element_wise("", pc.fill_null(pc.utf8_lower(text), ""), "", " ")
    n = pc.utf8_length(padded).to_numpy().astype(np.int64)
    one = pa.ListArray.from_arrays(pa.array([0, len(padded)], pa.int32()), padded)
    data = pc.binary_join(one, "")[0].as_py() if len(padded) else ""
    c = np.frombuffer(data.encode("utf-32-le"), np.uint32).astype(np.uint64)
    c = np.concatenate([c, np.zeros(2, np.uint64)])  # the last text's ends, never read as its grams
    a = c * np.uint64(0x9E3779B97F4A7C15)
    b = a[:-2] * np.uint64(31) + a[1:-1]
    t = b * np.uint64(31) + a[2:]
    shift = np.uint64(64 - BITS)
    mixed = np.stack([(v ^ (v >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> shift
                      for v in (a[:-2], b + np.uint64(1), t + np.uint64(2))], axis=1)
    at = np.concatenate([[0], np.cumsum(n)])
    # a text of n padded code points has n 1-grams, n - 1 2-grams and n - 2 3-grams
    keep = np.ones(mixed.shape, bool)
    keep[at[1:] - 1, 1:] = False
    keep[at[1:] - 2, 2] = False
    flat = mixed[keep].astype(np.int32)
    return flat, np.concatenate([[0], np.cumsum(3 * n - 3)])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list, idf: np.ndarray,
             epochs: int = 4, alpha: float = 0.5, l1: float = 0.02, l2: float = 0.05, seed: int = 7) -> Model:
    """``rows``: (gram numbers, shares). One row in five calibrates the temperature only."""
    k = len(languages)
    z, n = np.zeros((DIMS + 1, k)), np.zeros((DIMS + 1, k))  # the last row is the bias
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: len(order) // 5] if len(order) >= 20 else order[:0]
    train = order[len(held):]

    def weight(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((1 + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    xs = []
    for f, share in rows:
        xs.append((np.append(f, DIMS), np.append(SCALE * share * idf[f], 1.0)))
    for _ in range(epochs):
        for j in rng.permutation(train):
            i, x = xs[j]
            w = weight(i)
            p = _softmax(x @ w)
            p[y[j]] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(DIMS + 1))
    temperature = 1.0
    if len(held):
        logits = np.stack([xs[j][1] @ w[xs[j][0]] for j in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(languages, SCALE * w[:DIMS] * idf[:, None], w[DIMS], temperature)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all texts each hashed gram occurs, and the number of texts."""
    def run(batches):
        total, seen = np.zeros(DIMS + 1, np.int64), 0
        flag = np.zeros(DIMS, np.int8)
        for b in slices(batches, "text"):
            g, at = grams(b.column("text"))
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                flag[g[lo:hi]] = 1
                total[:DIMS] += flag
                flag[g[lo:hi]] = 0
            seen += b.num_rows
        total[DIMS] = seen
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(total[i])], ["gram", "n"])

    # a task gives at most DIMS + 1 rows, the sum as many
    got = (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "gram int, n long")
           .groupBy("gram").agg(F.sum("n").alias("n")).toPandas())
    df = np.zeros(DIMS + 1, np.int64)
    df[got["gram"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return df[:DIMS], int(df[DIMS])


def fit(docs: DataFrame, label_col: str = "lang", per_class: int = 800, id_col: str = "doc_id",
        text_col: str = "text") -> Model:
    """A model from the documents of ``docs`` whose label is not null (give only those it may learn from)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                       F.col(text_col).alias("text")).where("label is not null")
    df, n = document_frequencies(rows, "text")
    idf = np.log((1 + n) / (1 + df)) + 1
    # the least hashes of each label, picked without their texts, then joined back: at most per_class a label
    keyed = rows.withColumn("h", F.xxhash64("id", "text"))
    pick = least_hashes(keyed.select("label", "h").distinct(), "label", "h", per_class)
    sample = keyed.join(F.broadcast(pick), ["label", "h"])

    def run(batches):
        for b in slices(batches, "text"):
            g, at = grams(b.column("text"))
            f, s = [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                part = np.sort(g[lo:hi])
                u = distinct(part)
                f.append(u.astype(np.int32).tobytes())
                s.append((np.diff(np.append(np.searchsorted(part, u), len(part))) / max(len(part), 1))
                         .astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("label"), pa.array(f, pa.binary()),
                                              pa.array(s, pa.binary())], ["h", "label", "f", "s"])

    got = (sample.select("h", "label", "text").mapInArrow(run, "h long, label string, f binary, s binary")
           .groupBy("h", "label").agg(F.min(F.struct("f", "s")).alias("x")).select("h", "label", "x.f", "x.s")
           .orderBy("label", "h").toPandas())
    languages = sorted(got["label"].unique().tolist())
    y = np.searchsorted(languages, got["label"].to_numpy(str)) if languages else np.zeros(0, np.int64)
    feats = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32).astype(np.float64))
             for a, b in zip(got["f"], got["s"])]
    if len(languages) < 2:
        return Model(languages, np.zeros((DIMS, len(languages))), np.zeros(len(languages)), 1.0)
    return fit_rows(feats, y, languages, idf)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        m = shared.value
        weights = m.weights.astype(np.float32)
        for b in slices(batches, "text"):
            text = b.column("text")
            letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            if not m.languages:
                letters = np.zeros(b.num_rows, bool)
                p = np.zeros((b.num_rows, 1))
            else:
                g, at = grams(text)
                total = np.stack([np.add.reduceat(np.append(weights[g, c], np.float32(0)).astype(np.float64), at[:-1])
                                  for c in range(len(m.languages))], axis=1)
                count = np.diff(at)
                total[count == 0] = 0
                p = _softmax((total / np.maximum(count, 1)[:, None] + m.bias) / m.temperature)
            best = p.argmax(axis=1)
            names = np.array([*m.languages, UNKNOWN], object)
            pred = np.where(letters, names[best], UNKNOWN)
            score = np.where(letters, p[np.arange(b.num_rows), best], 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, per_class: int = 800, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score) per row; learns from the labelled rows outside the held-out third."""
    model = fit(docs.where(~held_out(F.col(id_col))), label_col, per_class, id_col, text_col)
    return predict(docs, model, id_col, text_col)
