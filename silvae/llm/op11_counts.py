"""op11: token counts."""

import public_tokenizers
from pyspark.sql import functions as F

from silvae.llm.counts import count_tokens

#: Documents of more tokens are over the limit.
LIMIT = 1024


def op11_token_counts(spark, sf_dir):
    """Of each document its bytes and tokens; see ``count_tokens`` for nulls and repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
