"""op5: surrogates for personal data."""

from pyspark.sql import functions as F

from silvae.llm.pii import replace_checked

#: The key of the queries; a real run passes its own secret.
KEY = "silvae-query-key"


def op5_pii_surrogates(spark, sf_dir):
    """Of each document the number of its entities, the text with their surrogates, and how many surrogates clash. A null text stays null and has none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_checked(docs, KEY).select("doc_id", F.size("found").cast("long").alias("n_entities"), "text", "n_clashes")
