"""Fingerprints against plain versions and true similarities."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm import fingerprint as fp  # noqa: E402
from tessera.llm import queries  # noqa: E402
from tests.llm.fixtures import WORD, awkward_docs, frame, vocabulary  # noqa: E402


def shingles(text, k=5):
    ws = WORD.findall(text or "")
    return {tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_next(rows, spark):
    """Rows in the operator's order, each with its next row's text."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    line = [(r.doc_id, r.t) for r in df.withColumn("h", F.xxhash64("t")).orderBy("doc_id", "h", "t").collect()]
    return [(d, t, line[(i + 1) % len(line)][1]) for i, (d, t) in enumerate(line)]


def plain_edit(text, after):
    q = len(text) // 4
    return text[:len(text) - q] + after[:q]


@pytest.mark.parametrize("partitions", ["1", "5", "8"])
def test_edits_equal_plain(spark, partitions):
    rows = awkward_docs()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fp.edits(frame(spark, rows, extra=("h", "range", "guest", "print", "edited", "n_chars"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    code = lambda t: fp.fingerprints(pa.array([t]))[0]
    want = Counter()
    for d, t, after in plain_next(rows, spark):
        e = plain_edit(t, after)
        a, b, c = code(t), code(e), code(after)
        want[d, len(t), e, a, b, round(float(fp.likeness([a], [b])[0]), 9), round(float(fp.likeness([a], [c])[0]), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited, bytes(r.fingerprint), bytes(r.edited_fingerprint),
                    round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_likeness_is_close_to_the_true_similarity():
    r = random.Random(3)
    words = vocabulary(3000, 3)
    true, a, b = [], [], []
    for i in range(300):
        t = [r.choice(words) for _ in range(r.choice([1, 3, 7, 20, 100, 400, 3000]))]
        k = r.randint(0, len(t))
        u = t[:k] + [r.choice(words) for _ in range(len(t) - k)]
        a.append(" ".join(t))
        b.append(" ".join(u))
        true.append(jaccard(a[-1], b[-1]))
    got = fp.likeness(fp.fingerprints(pa.array(a)), fp.fingerprints(pa.array(b)))
    error = got - np.array(true)
    assert abs(error.mean()) < 0.01 and np.sqrt((error ** 2).mean()) < 0.03 and np.abs(error).max() < 0.15
    for bits, bins in ((1, 1024), (2, 512), (8, 256)):
        x = fp.likeness(fp.fingerprints(pa.array(a), 5, bins, bits), fp.fingerprints(pa.array(b), 5, bins, bits), bits)
        assert abs((x - true).mean()) < 0.02 and np.sqrt(((x - true) ** 2).mean()) < 0.06


def test_densification_is_the_first_filled_bin_of_each_order():
    r = np.random.default_rng(1)
    for share in (0.002, 0.01, 0.1, 0.9, 0.0):
        filled = r.random((20, 512)) < share
        value = r.integers(0, 1 << 60, (20, 512), dtype=np.uint64)
        got, (order, _) = fp.densify(value, filled), fp._orders(512)
        for d in range(20):
            for i in range(512):
                want = i if filled[d, i] or not filled[d].any() else next(b for b in order[i] if filled[d, b])
                assert got[d, i] == value[d, want]


def test_defined_likeness():
    a = fp.fingerprints(pa.array(["", None, " \t\n", "one", "one", "two words", "two  words"]))
    assert a[0] == a[1] == a[2] == b"" and a[3] == a[4] and a[5] == a[6] and len(a[3]) == 256
    assert fp.likeness([a[0], a[0], a[3], a[3]], [a[2], a[3], a[0], a[4]]).tolist() == [1, 0, 0, 1]
    assert fp.likeness([a[3]], [a[5]])[0] < 0.1


def test_empty_lone_and_query(spark, tmp_path):
    schema = "doc_id long, text string"
    assert fp.edits(spark.createDataFrame([], schema)).collect() == []
    lone = fp.edits(spark.createDataFrame([(4, "abcdefgh")], schema)).collect()
    assert [(r.doc_id, r.n_chars, r.edited, r.near_next) for r in lone] == [(4, 8, "abcdefab", 1.0)]
    rows = [r for r in awkward_docs() if r[0] is not None]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_fingerprint(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"),
                          ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"),
                          ("near_next", "double")]
    want = Counter((d, len(t), hashlib.sha256(plain_edit(t, a).encode()).hexdigest(),
                    fp.fingerprints(pa.array([t]))[0].hex()) for d, t, a in plain_next(rows, spark))
    assert Counter(tuple(r)[:4] for r in got.collect()) == want


def test_fingerprint_alone(spark):
    rows = awkward_docs()
    got = Counter((r.doc_id, bytes(r.fingerprint)) for r in fp.fingerprint(frame(spark, rows)).collect())
    assert got == Counter((d, fp.fingerprints(pa.array([t or ""]))[0]) for d, t in rows)
