"""The thin ``opN_*`` queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    ann, bpe, decontam, fingerprint, langid, phrases, pii, quality, simhash, spelling, substr, toxicity, urlfilter)
from tessera.llm.common import held_out, read

RANKS = "byte_bpe_50k.tiktoken"


#: The rules that op8 judges pages by.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by boosted trees over its statistics."""
    out = quality.classify(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, one row per pair, with score and overlaps."""
    return decontam.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, likeliest grade and verdict of every document; a third of the labels is held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic", by_count=True)
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "grade", "toxic_p",
                      (F.col("toxic_p") >= toxicity.TOXIC_P).alias("toxic"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every document."""
    return digest_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"))


def digest_tokens(docs: DataFrame, *more: str) -> DataFrame:
    """Every row without its text, with (``more`` and) n_tokens and the two digests."""
    return bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN,
                             outputs=(*more, "n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and positions of personal data in every document."""
    out = pii.find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = list(pii.KINDS[:4])
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", *[count(k) for k in base],
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(base)), line), ",")
               .cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learns from the rows that are not held out."""
    out = langid.identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document because a repeated window of 35 words covers them."""
    out = substr.remove_repeats(read(spark, sf_dir, "documents"), k=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of two to five words of every language."""
    return phrases.collocations(read(spark, sf_dir, "documents"), least=100, top=2000)


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    out = fingerprint.edits(read(spark, sf_dir, "documents"))
    code = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      code("fingerprint"), code("edited_fingerprint"), "near_edited", "near_next")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of six letters or more that occurs five times or more."""
    out = spelling.spelling_variants(read(spark, sf_dir, "documents"), drop_every=199)
    return out.select("word", "form", "root", "n", "n_near", "form_n")


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
 r AS (SELECT row_number() OVER () AS rid, doc_id, ws FROM w),
 win AS (
  SELECT rid, i, array_to_string(ws[i:i + 34], ' ') AS t
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM r WHERE len(ws) >= 35)),
 dup AS (SELECT rid, i FROM win WHERE t IN (SELECT t FROM win GROUP BY t HAVING count(*) > 1)),
 gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM dup),
 word AS (SELECT rid, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM r),
 kept AS (
  SELECT word.rid, string_agg(x, ' ' ORDER BY word.p) AS s, count(*) AS n
  FROM word ANTI JOIN gone ON word.rid = gone.rid AND word.p = gone.p GROUP BY word.rid)
SELECT r.doc_id, CAST(len(r.ws) AS BIGINT) AS n_words, CAST(len(r.ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.s, '')) AS kept_sha256
FROM r LEFT JOIN kept ON r.rid = kept.rid
"""

OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    list_filter(regexp_split_to_array(unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS ws
  FROM documents),
 total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
 gram AS (
  SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM p, range(1, 6) AS s(size))),
 f AS (SELECT lang, size, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 100),
 longer AS (
  SELECT lang, unnest([array_to_string(ws[1:size - 1], ' '), array_to_string(ws[2:size], ' ')]) AS phrase, f
  FROM (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 2)),
 kept AS (
  SELECT * FROM f WHERE size > 1
   AND NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = f.lang AND x.phrase = f.phrase AND x.f >= f.f)),
 cut AS (
  SELECT lang, phrase, f AS a, k, array_to_string(ws[1:k], ' ') AS p1, array_to_string(ws[k + 1:size], ' ') AS p2
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM kept)),
 scored AS (
  SELECT cut.lang, cut.phrase, cut.a, k, x.f AS l, y.f AS r, total.n,
    (CAST(1000 AS HUGEINT) * cut.a * total.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = p1 JOIN f y ON y.lang = cut.lang AND y.phrase = p2
       JOIN total ON total.lang = cut.lang),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000
"""

OP8_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
 r(rh, rp, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                               ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  (SELECT rh || rp FROM r WHERE (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)
   ORDER BY length(rh || rp) DESC, rh || rp LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM r WHERE (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)
            ORDER BY length(rh || rp) DESC, rh || rp LIMIT 1), 'allow') AS verdict
FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality, op2_decontamination, op3_toxicity, op4_bpe, op5_pii, op6_simhash, op7_ann, op8_urls, op9_langid,
        op10_substring, op11_phrases, op12_fingerprint, op13_spelling)}

ORACLES: dict[str, str] = {"op8_urls": OP8_SQL, "op10_substring": OP10_SQL, "op11_phrases": OP11_SQL}
