"""op8: language of documents."""

from pyspark.sql import functions as F

from silvae.llm.langid import fit_languages, predict_language
from silvae.llm.mil import fold


def op8_language_filters(spark, sf_dir):
    """A null id is not held out, nor learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict_language(docs.select("doc_id", "text"), fit_languages(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
