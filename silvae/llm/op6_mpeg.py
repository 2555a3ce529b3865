"""op6: media columns of MPEG audio."""

from pyspark.sql import functions as F

from silvae.llm.mpeg import analyse, store


def op6_mpeg_audio(spark, sf_dir):
    """Of each document the digests of its payload, read back from the stored stream, and of the stream. A null text is empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = store(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    read = analyse(kept)
    data = F.col("audio.payload")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length(data).cast("long").alias("payload_bytes"),
        F.sha2(data, 256).alias("payload_sha256"),
        F.crc32(F.substring(data, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("audio.feature").alias("feature"),
        F.col("audio.seconds").alias("seconds"),
        F.col("audio.crc_bad").alias("crc_bad"),
    )
