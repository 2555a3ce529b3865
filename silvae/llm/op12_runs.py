"""op12: periodic runs of words."""

from silvae.llm.runs import run_digests


def op12_runs(spark, sf_dir):
    """Of each document its runs; see ``run_digests`` for nulls, ties and repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return run_digests(docs).drop("text")
