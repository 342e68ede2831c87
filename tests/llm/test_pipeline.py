"""The stages one by one and together on a small corpus with planted cases."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests.llm.fixtures import vocabulary  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(1)
    words, bad = vocabulary(400, 1), ["zz" + w for w in vocabulary(6, 2)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    docs, labels = [], []
    for i in range(200):
        t = text(r.randint(30, 90))
        toxic = i % 5 == 0
        if toxic:
            t = " ".join(w + (" " + r.choice(bad) if j % 12 == 0 else "") for j, w in enumerate(t.split()))
        docs.append([i, t])
        labels.append((i, int(toxic)))
    items = [(i, text(25)) for i in range(6)]
    docs += [[300 + i, text(20) + " " + q + " " + text(20)] for i, (_, q) in enumerate(items)]
    docs += [[400 + i, docs[1][1]] for i in range(5)]
    docs += [[500, "write to someone@mail.example.com or +1 (555) 010-9999 " + text(30)], [501, None], [502, ""],
             [503, None], [None, text(40)]]
    rows = [(d, t, "en", None, None if t is None else len(t)) for d, t in docs]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r for r in docs.collect()}
    toxic = {i for i in range(200) if i % 5 == 0}
    assert len(toxic & set(seen["toxicity"])) <= 2
    assert len(set(range(200)) - toxic - set(seen["toxicity"])) <= 2
    near = seen["near_duplicates"]
    assert 1 in near and not {400, 401, 402, 403, 404} & set(near)
    assert len({501, 502, 503} & set(near)) == 1 and None in near  # no word: one group
    assert not set(range(300, 306)) & set(seen["decontamination"])
    assert set(near) - set(range(300, 306)) == set(seen["decontamination"])
    masked = seen["pii"][500]
    assert masked.text.startswith("write to <email> or <phone>") and masked.n_chars == len(masked.text)
    assert set(seen["pii"]) == set(seen["decontamination"])


def test_columns_with_names_that_stages_use_stay_as_they_are(spark, corpus):
    from pyspark.sql import functions as F
    names = ["severity", "grade", "toxic_p", "spans", "masked", "leaked", "fp", "component_id", "root", "label", "key",
             "odd `name`.x"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id is not null")
    docs = docs.select("*", *[(F.col("doc_id") * 100 + i).alias(c) for i, c in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        rows = docs.collect()
        assert len(rows) > 100 and all(tuple(r)[5:] == tuple(r[0] * 100 + i for i in range(len(names))) for r in rows)


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert out.where("size(ids) <> n_tokens").count() == 0
    assert out.count() > 140
