"""Learned operators by held-out accuracy, nearest neighbours by recall, URL rules against a plain version."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ann, langid, quality, toxicity, urlfilter
from tessera.llm.common import held_out, least_hashes
from tests.llm.fixtures import awkward_docs, frame, vocabulary

F = pytest.importorskip("pyspark.sql.functions")


def _out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out(spark):
    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == _out(r.id) for r in got)
    assert spark.sql("select cast(null as long) id").select(held_out(F.col("id")).alias("h")).first().h is False


def test_least_hashes(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 50 = 0, 1, 0) y")
    got = Counter(r.y for r in least_hashes(rows, "y", "id", 300).collect())
    assert got == {0: 300, 1: 100}
    assert least_hashes(rows, "y", "id", 300).exceptAll(least_hashes(rows.repartition(7), "y", "id", 300)).count() == 0


# toxicity

def _toxic_rows(n=240, seed=3):
    r = random.Random(seed)
    clean, bad = vocabulary(200, 1), ["zz" + w for w in vocabulary(8, 2)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(clean) for _ in range(r.randint(10, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(2, 6)):
                words.insert(r.randint(0, len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out_accuracy(spark):
    rows, labels = _toxic_rows()
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", by_count=True)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    test = [(got[i], t) for i, t in labels if _out(i)]
    assert np.mean([(r.toxic_p >= toxicity.TOXIC_P) == bool(t) for r, t in test]) > 0.95
    assert all(0 <= r.severity <= len(model.thresholds) and 0 <= r.grade <= len(model.thresholds) for r, _ in test)


def test_toxicity_awkward(spark):
    rows, labels = _toxic_rows(60)
    odd = awkward_docs()
    labels += [(None, 1), (5, None), (99999, 1)]
    docs = frame(spark, rows + [(None if d is None else d + 1000, t) for d, t in odd])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", by_count=True)
    out = toxicity.score(docs, model)
    assert out.count() == len(rows) + len(odd)
    assert not out.where("severity is null or toxic_p is null").count()
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), "toxic")
    assert toxicity.score(docs, none).agg(F.max("severity")).first()[0] < 1e-6
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_grades_rank_by_telling_features():
    bad = [1000, 1001, 1002, 1003, 1004, 1005]
    rows = [np.array([i, i + 40]) for i in range(60)]
    rows += [np.sort(np.array([i, *bad[:1 + 2 * (i % 3)]])) for i in range(60)]
    g = toxicity.grade_by_count(rows, np.arange(120) >= 60)
    assert not g[:60].any()
    assert g[60:66].tolist() == [1, 2, 3, 1, 2, 3]


def test_ordinal_fit_orders_expected_severity():
    r = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(300):
        y = int(r.integers(0, 4))
        rows.append(np.unique(np.concatenate([r.integers(1000, 2000, 6), np.arange(y * 3)])))
        grades.append(y)
    m = toxicity.fit_rows(rows, np.array(grades))
    s = [toxicity._sigmoid(m.weights[np.concatenate([[1500], np.arange(3 * y)]).astype(int)].sum() - m.thresholds).sum()
         for y in range(4)]
    assert s == sorted(s) and s[0] < 0.6 and s[3] > 2.3
    assert (m.weights == 0).mean() > 0.99


# quality

def _quality_rows(n=260, seed=6):
    r = random.Random(seed)
    words = vocabulary(300, seed)
    rows, labels = [], []
    for i in range(n):
        ws = [r.choice(words) for _ in range(r.randint(20, 120))]
        good = i % 3 > 0
        if not good:
            ws = [w.upper() + "!!" for w in ws] if i % 2 else [ws[j % 4] for j in range(len(ws))]
        rows.append((i, " ".join(ws) + "."))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_held_out_accuracy(spark):
    rows, labels = _quality_rows()
    out = quality.classify(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in out.collect()}
    test = [(got[i], y) for i, y in labels if _out(i)]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in test]) > 0.95


def test_quality_awkward(spark):
    rows, labels = _quality_rows(60)
    odd = awkward_docs()
    docs = frame(spark, rows + [(None if d is None else d + 1000, t) for d, t in odd])
    bad = [(None, 1), (5, None), (6, 7), (99999, 1)]
    out = quality.classify(docs, spark.createDataFrame(labels + bad, "doc_id long, quality int"))
    assert out.count() == len(rows) + len(odd)
    assert not out.where("score is null or score < 0 or score > 1 or isnan(score)").count()
    blank = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, blank).collect()} == {0.5}
    assert quality.classify(docs.limit(0), blank).count() == 0


def test_trees_fit_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality.fit_trees(x[:1500], y[:1500], np.ones(1500))
    assert np.mean((m.predict(x[1500:]) >= 0.5) == y[1500:]) > 0.95
    # flattened arrays give what walking node by node gives
    for row in x[:20]:
        total = m.base
        for f, c, v in zip(m.feature, m.cut, m.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            total += v[node - len(f)]
        assert math.isclose(m.margin(row[None])[0], total)


# language

def _language_rows(n=240, seed=8):
    r = random.Random(seed)
    rows = []
    syll = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["schen", "ung", "keit", "ß"], "cc": ["ção", "não", "lhe", "é"]}
    for i in range(n):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join("".join(r.choice(syll[lang]) for _ in range(r.randint(1, 3)))
                                 for _ in range(r.randint(5, 40))), lang))
    return rows


def test_langid_held_out_accuracy(spark):
    rows = _language_rows()
    got = {r.doc_id: r for r in langid.identify(frame(spark, rows, "doc_id long, text string, lang string")).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if _out(i)]) > 0.97
    assert all(0 < got[i].score <= 1 for i, _, _ in rows)


def test_langid_awkward(spark):
    rows = _language_rows(60)
    odd = [(None if d is None else d + 1000, t, None) for d, t in awkward_docs()]
    odd += [(5000, "12 34 !!", "aa"), (5001, "", "bb"), (5002, None, "cc")]
    docs = frame(spark, rows + odd, "doc_id long, text string, lang string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {5000, 5001, 5002, 1400, 1401, 1402} <= und
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unknown).collect()} == {"und"}
    one = langid.identify(docs.withColumn("lang", F.lit("xx"))).where("lang_pred <> 'und'").collect()
    assert {(r.lang_pred, r.score) for r in one} == {("xx", 1.0)}
    assert langid.identify(docs.limit(0)).count() == 0


def test_grams_stay_inside_texts():
    import pyarrow as pa
    one = [langid.grams(pa.array([t], pa.string()))[0].tolist() for t in ("ab", "", None, "Éx y")]
    flat, at = langid.grams(pa.array(["ab", "", None, "Éx y"]))
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == one
    assert len(one[1]) == 3  # two spaces: two 1-grams and one 2-gram


# nearest neighbours

def _plain_nearest(rows, k, every):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == 24
          and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ok = list(dict.fromkeys((i, tuple(v)) for i, v in ok))
    out = {}
    for i, q in ok:
        if i % every == 0:
            c = sorted({(-float(np.cumsum(np.array(q) * np.array(v))[-1]), j) for j, v in ok if j != i})
            out[i] = [(j, -s) for s, j in c[:k]]
    return out


def _vectors(n, seed=0, scaled=False):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, 24))
    v = centre[r.integers(0, 6, n)] + 0.6 * r.normal(size=(n, 24))
    if not scaled:
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


def test_ann_small_tables_are_exact(spark):
    rows = _vectors(130)
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, [0.0] * 24), (302, [float("nan")] * 24), (303, [None] * 24), (304, [float("inf")] * 24),
             (305, [1.0] * 5), (None, rows[0][1]), rows[20], rows[20], (306, [])]
    df = frame(spark, rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    want = _plain_nearest(rows, 20, 20)
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [j for j, _ in x] for q, x in out.items()} == {q: [j for j, _ in x] for q, x in want.items()}
    assert all(abs(a - b) < 1e-12 for q in out for (_, a), (_, b) in zip(out[q], want[q]))
    few = ann.search(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0, k=20)
    assert few.count() == 4
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("scaled", [False, True])
def test_ann_recall(spark, scaled):
    rows = _vectors(3000, 1, scaled)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 100 == 0, k=20, small=0, block=200)
    found = Counter((r.query_id, r.vec_id) for r in got.collect())
    assert max(found.values()) == 1
    want = {(q, j) for q, x in _plain_nearest(rows, 20, 100).items() for j, _ in x}
    assert len(want & set(found)) / len(want) >= 0.9
    assert len(found) == len(want)


@pytest.mark.parametrize("norms", ["one long", "lognormal"])
def test_ann_recall_with_uneven_norms(spark, norms):
    r = np.random.default_rng(4)
    v = r.normal(size=(5000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if norms == "one long":
        v[7] *= 100
    else:
        v *= r.lognormal(0, 1, (len(v), 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 50 == 0, k=20, small=0, block=1000).collect()
    assert len(got) == 100 * 20
    score = v[::50] @ v.T
    score[np.arange(100), np.arange(0, 5000, 50)] = -np.inf
    want = {(q * 50, int(j)) for q, s in enumerate(score) for j in np.argsort(-s)[:20]}
    assert len(want & {(x.query_id, x.vec_id) for x in got}) / len(want) >= 0.95


def test_ann_repeated_rows_count_once(spark):
    rows = _vectors(400, 3)
    df = spark.createDataFrame(rows * 25, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    want = {(q, r + 1, j) for q, x in _plain_nearest(rows, 20, 20).items() for r, (j, _) in enumerate(x)}
    assert len(got) == len(want)
    assert len(want & {(x.query_id, x.rank, x.vec_id) for x in got}) / len(want) >= 0.99


def test_ann_small_tables_are_probed_alike(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(ann, "reach", lambda dim, *a, f=ann.reach: asked.append(a) or f(dim, *a))
    df = spark.createDataFrame(_vectors(60), "vec_id long, embedding array<double>")
    assert ann.search(df, F.col("vec_id") % 20 == 0, k=20).count() == 60
    assert asked == [(16, 160, 0.95)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(10, 32))
    assert np.allclose(np.linalg.norm(ann.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))


# urls

def _plain_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for h, p, v in rules:
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p or ""):
            key = (-len(h + (p or "")), h + (p or ""), v)
            best = key if best is None else min(best, key)
    return host, path, best and best[1], best[2] if best else "allow"


def test_urls_equal_plain(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "ROWS_PER_SALT", 5)
    r = random.Random(3)
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "xexample.net", "org", "w.org", "EXAMPLE.Net", "",
             "a..net", ".net", "net.", "com", "é.net"]
    paths = ["", "/", "/en/", "/en/a", "/en", "/fr/x", "/en/a/b", "//", "/É", "/EN/"]
    ends = ["", "?q=/en/", "#x", "?", "/?a://b.net/c"]
    urls = ["http://" + r.choice(hosts) + r.choice(paths) + r.choice(ends) for _ in range(400)]
    urls += [None, "", "no scheme", "://", "x://", "http://a.net://b.org/fr/", "http://net\nx/en/", "http://net/en/"] * 3
    rules = [("net", "/", "block"), ("net", "/en/", "allow"), ("net", "/en/a", "block"), ("example.net", "/en/", "allow"),
             ("a.example.net", "", "block"), ("org", "/fr/", "allow"), ("org", None, "block"), ("net", "/", "block"),
             ("net", "/", "allow"), ("", "/", "block"), (None, "/", "block"), ("com", "//", "block"), ("é.net", "/", "allow")]
    pages = frame(spark, list(enumerate(urls)) + [(None, "http://net/")], "page_id long, url string",
                  extra=("key", "salt", "stack", "best", "rule_host", "host", "path", "n"))
    got = urlfilter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert "PythonUDF" not in got._jdf.queryExecution().toString()
    out = Counter((x.page_id, x.url, x.host, x.path, x.rule, x.verdict) for x in got.collect())
    assert out == Counter((i, u, *_plain_judge(u, rules)) for i, u in [*enumerate(urls), (None, "http://net/")])


def test_urls_empty(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in urlfilter.judge(pages, rules).collect()] == [(1, "http://a.net/", "a.net", "/", None, "allow")]
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
