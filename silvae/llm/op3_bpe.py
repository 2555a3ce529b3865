"""op3: BPE encoding and decoding."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import types as T

from silvae.llm import bpe


def digests(codec: bpe.Codec, batch: pa.RecordBatch) -> list[pa.Array]:
    """Of each text the number of its ids, their digest, and that of the text decoded from them."""
    ids, first = codec.encode_batch(batch.column(1))
    rows = zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
    of_ids = [hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in rows]
    of_text = [hashlib.sha256(x).hexdigest() for x in codec.decode_batch(ids, first)]
    return [pa.array(np.diff(first)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]


def op3_bpe(spark, sf_dir):
    """Of each document the digests of its ids and of the text decoded from them. A null or empty text has no ids; repeated rows get the same."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return bpe.with_codec(docs, public_tokenizers.path("byte_bpe_50k.json"), digests, fields, "text").drop("text")
