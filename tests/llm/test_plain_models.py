"""The learners of op3 and op9 against plain versions, formula by formula."""

import math
import random
import string

import numpy as np
import pyarrow as pa
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm import langid, toxicity  # noqa: E402
from tests.llm.fixtures import WORD, awkward_docs, frame, vocabulary  # noqa: E402

LOW = {c: c.lower() for c in string.ascii_uppercase}


def lower(t):
    return "".join(LOW.get(c, c) for c in t)


# ------------------------------------------------------------------ op3
def plain_features(text):
    out, mask = set(), (1 << toxicity.BITS) - 1
    for w in WORD.findall(lower(text or "")):
        w = w.strip(string.punctuation)
        out.add(xxhash.xxh3_64_intdigest(w) & mask)
        out |= {xxhash.xxh3_64_intdigest(w[:n], n) & mask for n in toxicity.HEADS}
    return out


def graded_texts(seed, n=240):
    r = random.Random(seed)
    clean, bad = vocabulary(200, seed), ["zz" + w for w in vocabulary(8, seed + 1)]
    texts, grades = [], []
    for i in range(n):
        g = r.choice([0, 0, 0, 1, 2, 3])
        words = [r.choice(clean) for _ in range(r.randint(8, 30))] + r.sample(bad, min(2 * g, len(bad)))
        r.shuffle(words)
        texts.append(" ".join(words))
        grades.append(g)
    return texts, np.array(grades)


def sigmoid(x):
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def loss(rows, y, weights, theta, l1):
    """The weighted negative log-likelihood of the cumulative links, and the penalty."""
    share = {True: 0.5 / (y > 0).sum(), False: 0.5 / (y == 0).sum()}
    total = l1 * sum(weights.values())
    for r, g in zip(rows, y):
        s = sum(weights.get(f, 0.0) for f in r)
        up = sigmoid(s - theta[g - 1]) if g else 1.0
        over = sigmoid(s - theta[g]) if g < len(theta) else 0.0
        total -= share[bool(g > 0)] * math.log(max(up - over, 1e-9))
    return total


def test_features_equal_plain():
    texts = [t or "" for _, t in awkward_docs()]
    got = toxicity.features(pa.array(texts))
    assert [set(g.tolist()) for g in got] == [plain_features(t) for t in texts]


def test_fit_lowers_the_plain_likelihood_with_every_part():
    texts, y = graded_texts(1)
    rows = toxicity.features(pa.array(texts))
    model = toxicity.fit_rows(rows, y)
    plain = [plain_features(t) for t in texts]
    weights = {int(i): float(model.weights[i]) for i in np.flatnonzero(model.weights)}
    theta = model.thresholds.tolist()
    assert 0 < len(weights) < 60 and theta == sorted(theta) and min(weights.values()) > 0
    best = loss(plain, y, weights, theta, 1e-4)
    share = [0.5 * (y == g).sum() / (y > 0).sum() if g else 0.5 for g in range(4)]  # weighted shares of the grades
    assert best < 0.1 * -sum(s * math.log(s) for s in share)  # of what thresholds alone can reach
    for f in weights:
        assert loss(plain, y, {k: v for k, v in weights.items() if k != f}, theta, 0.0) > loss(plain, y, weights, theta, 0.0)
    for k in range(len(theta)):  # far from its place every threshold is worse
        for step in (-3, 3):
            assert loss(plain, y, weights, sorted(theta[:k] + [theta[k] + step] + theta[k + 1:]), 1e-4) > best


def test_toxicity_scores_equal_plain(spark):
    texts, y = graded_texts(2)
    model = toxicity.fit_rows(toxicity.features(pa.array(texts)), y)
    rows = list(enumerate(texts[:60])) + awkward_docs()
    for r in toxicity.score(frame(spark, rows), model).collect():
        s = sum(model.weights[f] for f in plain_features(r.text))
        p = [sigmoid(s - t) for t in model.thresholds]
        each = [1 - p[0], *[a - b for a, b in zip(p, p[1:])], p[-1]]
        assert math.isclose(r.severity, sum(p), abs_tol=1e-9) and math.isclose(r.toxic_p, p[0], abs_tol=1e-9)
        assert math.isclose(each[r.grade], max(each), abs_tol=1e-9)


# ------------------------------------------------------------------ op9
def plain_grams(text):
    c = [ord(x) for x in " " + (text or "").lower() + " "]
    m, out = (1 << 64) - 1, []
    mixed = lambda v: ((v ^ v >> 32) * 0xD6E8FEB86659FD93 & m) >> 64 - langid.BITS
    for size, salt in ((1, 0), (2, 1), (3, 2)):
        for i in range(len(c) - size + 1):
            v = 0
            for x in c[i:i + size]:
                v = (v * 31 + x * 0x9E3779B97F4A7C15) & m
            out.append(mixed(v + salt & m))
    return sorted(out)


def test_grams_equal_plain():
    texts = ["", None, "a", "Ünï", "AbC dé\n", "𝒳y", " "] + [t for _, t in awkward_docs()[:10]]
    g, at = langid.grams(pa.array(texts))
    assert [sorted(g[a:b].tolist()) for a, b in zip(at[:-1], at[1:])] == [plain_grams(t) for t in texts]


def softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def plain_ftrl(rows, y, k, idf, epochs, alpha, l1, l2, seed):
    """Coordinate by coordinate; the order of rows is the operator's."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[:len(order) // 5] if len(order) >= 20 else order[:0]
    z, n = {}, {}

    def w(i, c):
        zi = z.get((i, c), 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((1 + math.sqrt(n.get((i, c), 0.0))) / alpha + l2)

    def logits(x):
        return [sum(v * w(i, c) for i, v in x) for c in range(k)]

    xs = [[*((int(f), langid.SCALE * s * idf[f]) for f, s in zip(*r)), (langid.DIMS, 1.0)] for r in rows]
    for _ in range(epochs):
        for j in rng.permutation(order[len(held):]):
            p = softmax(logits(xs[j]))
            steps = []
            for i, v in xs[j]:
                for c in range(k):
                    g = v * (p[c] - (c == y[j]))
                    old = n.get((i, c), 0.0)
                    steps.append((i, c, g, (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w(i, c)))
            for i, c, g, pull in steps:
                z[i, c] = z.get((i, c), 0.0) + g - pull
                n[i, c] = n.get((i, c), 0.0) + g * g
    return w, [(logits(xs[j]), y[j]) for j in held]


def small_corpus(seed, n):
    r = random.Random(seed)
    tongues = [vocabulary(12, seed + i) for i in range(3)]
    texts, y = [], []
    for i in range(n):
        c = r.randrange(3)
        texts.append(" ".join(r.choice(tongues[c]) for _ in range(r.randint(1, 5))))
        y.append(c)
    return texts, np.array(y)


def rows_of(texts):
    out = []
    for t in texts:
        g = plain_grams(t)
        f = sorted(set(g))
        out.append((np.array(f, np.int32), np.array([g.count(x) / len(g) for x in f])))
    return out


@pytest.mark.parametrize("n, epochs", [(9, 2), (30, 1)])
def test_learner_and_temperature_equal_plain(n, epochs):
    texts, y = small_corpus(n, n)
    rows = rows_of(texts)
    idf = np.ones(langid.DIMS)
    for f, _ in rows:
        idf[f] += 0.1
    got = langid.fit_rows(rows, y, ["a", "b", "c"], idf, epochs=epochs, alpha=0.5, l1=0.02, l2=0.05, seed=3)
    w, held = plain_ftrl(rows, y, 3, idf, epochs, 0.5, 0.02, 0.05, 3)
    for f in sorted({int(x) for r, _ in rows for x in r}):
        for c in range(3):
            assert math.isclose(got.weights[f, c], langid.SCALE * w(f, c) * idf[f], rel_tol=1e-9, abs_tol=1e-12)
    assert np.allclose(got.bias, [w(langid.DIMS, c) for c in range(3)])
    if held:
        grid = [math.exp(math.log(0.05) + (math.log(20) - math.log(0.05)) * i / 120) for i in range(121)]
        cost = [-sum(math.log(max(softmax([x / t for x in z])[c], 1e-12)) for z, c in held) / len(held) for t in grid]
        assert math.isclose(got.temperature, grid[cost.index(min(cost))], rel_tol=1e-6)
    else:
        assert got.temperature == 1.0


def test_predictions_equal_plain(spark):
    texts, y = small_corpus(5, 40)
    model = langid.fit_rows(rows_of(texts), y, ["a", "b", "c"], np.ones(langid.DIMS))
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, "123 !"), (103, "É"), (None, texts[0])]
    seen = 0
    for r in langid.predict(frame(spark, rows), model).collect():
        text = next(t for d, t in rows if d == r.doc_id)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == (langid.UNKNOWN, 0.0)
            continue
        g = plain_grams(text)
        z = [(sum(float(np.float32(model.weights[i, c])) for i in g) / len(g) + model.bias[c]) / model.temperature
             for c in range(3)]
        p = softmax(z)
        assert math.isclose(r.score, max(p), abs_tol=1e-5) and math.isclose(p["abc".index(r.lang_pred)], max(p), abs_tol=1e-5)
        seen += 1
    assert seen > 40
