"""op10: quality of documents."""

from pyspark.sql import functions as F

from silvae.llm import mil

#: Scores from here on are label 1.
ACCEPT = 0.3


def op10_quality_mil(spark, sf_dir):
    """A null id is not held out, nor learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = mil.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = mil.score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(mil.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
