"""From raw documents to token ids: five stages, each written and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the
documents that stay, with the columns of ``documents`` (the last: the tokens). Rows with
nulls, empty texts and repeated rows pass through as their operators define. Further columns of ``documents``
are carried along unchanged, whatever their names: operators do not see them by those names.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, pii, queries, simhash, toxicity
from tessera.llm.common import read, save


#: The columns that stages work on.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def keeps_columns(stage):
    """The stage, with every column beside ``OWN`` under a neutral name while it runs."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        hidden = [c if c in OWN else f"__kept_{i}" for i, c in enumerate(names)]
        return stage(spark, docs.toDF(*hidden), sf_dir).select(*hidden).toDF(*names)
    return run


@keeps_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not call toxic (it learns from these documents' labels)."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic", by_count=True)
    return toxicity.score(docs, model).where(F.col("toxic_p") < toxicity.TOXIC_P).select(*docs.columns)


@keeps_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    return simhash.keep_one(docs, simhash.near_duplicates(docs, shingle=3, max_bits=3))


@keeps_columns
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item in them."""
    marked = decontam.find_items(docs, read(spark, sf_dir, "benchmark"), keep=True)
    return marked.where(F.size("leaked") == 0).select(*docs.columns)


@keeps_columns
def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind and ``n_chars`` counted anew."""
    masked = pii.find_pii(docs)
    return masked.withColumns({
        "n_chars": F.when(F.size("spans") > 0, F.length("masked").cast("long")).otherwise(F.col("n_chars")),
        "text": F.col("masked")}).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and digests."""
    return queries.digest_tokens(docs.select("doc_id", "lang", "source", "text"), "ids")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("pii", mask_pii), ("bpe", encode)]

#: Fingerprints, learned scores and merges are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
