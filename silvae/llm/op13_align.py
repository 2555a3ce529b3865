"""op13: alignment of two tokenizers."""

import public_tokenizers

from silvae.llm.align import align


def op13_align(spark, sf_dir):
    """Of each document its tokens, groups and links; see ``align`` for nulls and repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
