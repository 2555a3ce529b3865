"""A corpus pipeline in five stages, each one of the operators of silvae.llm.

quality: documents that the classifier rejects go. near_duplicates: of each group of near copies the
document of smallest id stays. decontamination: documents contaminated by a benchmark go. pii:
personal data gets surrogates. tokens: each text as ids.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of docs. Extra columns are carried along, whatever their names; the last stage
puts its results in the place of columns of their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvae.llm import bpe, mil, minhash, pii, winnow
from silvae.llm.op5_pii import KEY
from silvae.llm.op10_quality import ACCEPT
from silvae.llm.store import fresh, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is ACCEPT or more; a null or empty text is scored like any other."""
    model = mil.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return mil.score_quality(docs, model, out=score).where(F.col(score) >= ACCEPT).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component; of rows of one id, one, that of the smallest hash of its text and other columns. A row with a null id or without words stays."""
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("copies"))
    kept = materialize(kept, "kept")
    out = docs.join(kept.where("copies = 1").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    if kept.where("copies > 1").isEmpty():
        return out
    again = docs.join(kept.where("copies > 1").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = again.groupBy("doc_id").agg(F.min_by(row, F.struct(F.xxhash64("text"), F.xxhash64(F.to_json(row)))).alias("row"))
    return out.unionByName(one.select(*(F.col("row")[c].alias(c) for c in docs.columns)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the benchmark; a text without words is not."""
    hits = fresh(docs, "hits")
    found = winnow.find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=hits)
    return found.where(~winnow.contaminated(hits)).drop(hits)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities replaced in ``text``; ``n_chars`` follows the new text. A null text stays null."""
    out = pii.replace_entities(docs, KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, with the number of its tokens, their ids, and whether they decode to it. A null or empty text has no ids."""
    file = public_tokenizers.path("byte_bpe_50k.json")
    new = ("n_tokens", "ids", "round_trip", "decoded")
    keep = [c for c in docs.columns if c != "text" and c not in new]
    decoded = bpe.transcode(docs.select(*(F.col(f"`{c}`") for c in keep), "text"), file)
    return decoded.select(*(F.col(f"`{c}`") for c in keep), F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii_surrogates), ("tokens", tokens)]

#: The classifier, the regular expressions and the tokenizer have no counterpart in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
