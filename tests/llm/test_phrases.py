"""Collocations against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm import phrases  # noqa: E402
from tests.llm.fixtures import frame, vocabulary  # noqa: E402

SCHEMA = "doc_id long, text string, lang string"


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain_counts(rows):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        for ws in pieces(text):
            n[lang] += len(ws)
            for k in range(1, 6):
                f[lang].update(" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1))
    return f, n


def plain_collocations(rows, least, top):
    f, n = plain_counts(rows)
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if a >= least and " " in p}
        best = []
        for p, a in cand.items():
            if any(f" {p} " in f" {q} " and 100 * b >= 100 * a for q, b in cand.items() if len(q.split(" ")) > len(p.split(" "))):
                continue
            ws = p.split(" ")
            cuts = []
            for k in range(1, len(ws)):
                left, right = count[" ".join(ws[:k])], count[" ".join(ws[k:])]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            best.append((-score, -a, p.encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = vocabulary(12, seed) + ["Straße", "É", "x\x1cy", "z\x85", "The", "the"]
    fixed = [" ".join(r.choice(words) for _ in range(k)) for k in (2, 3, 4, 5, 6)]
    rows = []
    for i in range(n):
        text = "".join(r.choice(words + fixed) + r.choice([" "] * 8 + [", ", ".", "\n", "\t", " ; ", "\r\n", "  "])
                       for _ in range(r.randint(0, 120)))
        rows.append((i, text, r.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(900, None, "en"), (901, "", None), (902, " .,\n", "xx"), (None, "one two " * 300, "fr"), rows[0], rows[0]]


@pytest.mark.parametrize("seed, shard_bytes, least, top", [(1, 8 << 20, 10, 2000), (2, 600, 10, 2000), (3, 2000, 5, 7)])
def test_collocations_equal_plain(spark, seed, shard_bytes, least, top):
    rows = corpus(seed)
    docs = frame(spark, rows, SCHEMA, extra=("phrase", "n", "lo", "rlo", "bucket", "shard", "a", "k", "w", "size", "total"))
    got = phrases.collocations(docs, least, top, shard_bytes=shard_bytes)
    assert [(c, t) for c, t in got.dtypes] == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *(
        (c, "bigint") for c in ("a", "l", "r", "n", "score"))]
    want = plain_collocations(rows, least, top)
    assert len(want) > 20 and max(len(w[2].split(" ")) for w in want) == 5
    assert sorted(tuple(r) for r in got.collect()) == want


def test_counts_equal_plain(spark):
    rows = corpus(7)
    got, total = phrases.count_phrases(frame(spark, rows, SCHEMA), least=4, shard_bytes=1500)
    f, n = plain_counts(rows)
    want = {(lang, p, len(p.split(" ")), a) for lang, c in f.items() for p, a in c.items() if a >= 4}
    rows_got = got.collect()
    assert len(rows_got) == len(want) and {tuple(r) for r in rows_got} == want
    assert {r.lang: r.n for r in total.collect()} == {k: v for k, v in n.items() if v}


@pytest.mark.parametrize("right_first", [True, False])
def test_intervals_are_synchronised(right_first):
    r = random.Random(4)
    text = "\n".join(" ".join(r.choice("abcde") for _ in range(r.randint(1, 40))) for _ in range(60))
    n_words, words, ids = phrases.build([text.encode()])
    own = phrases.Shard({"shard": 1, "lang": "en", "words": words, "ids": ids}, 3)
    assert n_words == sum(map(len, pieces(text)))
    ix = phrases.Index(len(own.vocabulary), own.ids)
    lo = rlo = ix.start
    n, right, want = ix.count, right_first, Counter()
    for size in range(1, 6):
        want = Counter(" ".join(ws[i:i + size]) for ws in pieces(text) for i in range(len(ws) - size + 1))
        names = zip(*(own.vocabulary.take(i).to_pylist() for i in map(phrases.pa.array, ix.symbols(lo, size))))
        assert Counter(dict(zip(map(" ".join, names), n.tolist()))) == want
        lo, rlo, n = ix.extend(lo, rlo, n, right)
        right = not right


def test_suffix_order_of_many_symbols():
    r = np.random.default_rng(2)
    for top in (3, 1 << 30):  # the second is too wide to sort with its positions
        s = r.integers(0, top, 500)
        at = phrases.suffix_order(s)
        key = [tuple(s[(i + j) % 500] for j in range(phrases.DEPTH)) for i in at.tolist()]
        assert key == sorted(key) and sorted(at.tolist()) == list(range(500))


def test_indexes_do_not_move(spark):
    path = phrases._save_by_shard(spark, phrases._shards(
        spark.createDataFrame([("a b c", "en")], "text string, lang string"), 100), 8)
    back = spark.range(5).select(F_col("id").alias("shard"))
    run = lambda a, b: a.select(["shard"])
    plan = path.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(run, "shard long")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1  # the intervals only


def F_col(name):
    from pyspark.sql import functions as F
    return F.col(name)


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    none = spark.createDataFrame([(1, None, None), (2, " . ", "en")], SCHEMA)
    assert phrases.collocations(none, least=1).collect() == []


def test_numbers_beyond_64_bits(spark):
    rows = [("aa", 2 ** 40, 2 ** 41, 2 ** 42, 2 ** 50)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "phrase string, a long, l long, r long, n long")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    got = (df.withColumn("up", exact("a") * (F.col("n") * 1000).cast("decimal(19,0)"))
           .withColumn("down", exact("l") * exact("r")).select(F.expr("up div down").alias("s"))).first().s
    assert got == 1000 * 2 ** 90 // 2 ** 83
