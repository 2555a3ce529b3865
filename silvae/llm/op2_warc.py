"""op2: WARC records."""

from pyspark.sql import functions as F

from silvae.llm import warc
from silvae.llm.store import materialize, new_path

#: Payloads of fewer bytes are never revisits.
LEAST = 1000
#: Tasks that the pages of one payload are dealt to.
SALTS = 8
_ID = "<urn:page:%s>"


def op2_warc(spark, sf_dir):
    """Of each page its record as the archives have it. A null html is empty, a null page_id is never a revisit; repeated rows are written each."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    narrow = pages.where(F.octet_length("html") >= LEAST).select("page_id", digest.alias("digest"))
    narrow = materialize(narrow.where("page_id is not null"), "digests")
    first = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = narrow.withColumn("salt", salt).join(salted, ["digest", "salt"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    planned = pages.where("page_id is not null").withColumn("digest", digest).join(again.hint("shuffle_hash"), ["page_id", "digest"], "left").drop("digest")
    planned = planned.unionByName(pages.where("page_id is null").withColumn("refers_to", F.lit(None).cast("long")))
    urn = lambda c: F.format_string(_ID, F.coalesce(F.col(c).cast("string"), F.lit("")))
    path = new_path(spark, "warc")
    warc.write(warc.records(planned, urn("page_id"), F.col("url"), F.col("html"), F.when(F.col("refers_to").isNotNull(), urn("refers_to"))), path)
    number = lambda c: F.regexp_extract(c, r"page:(-?\d+)", 1).try_cast("long")
    said = warc.load(spark, path, ["record_id", "record_type", "payload_digest", "refers_to", "headers"]).where("record_type = 'revisit'")
    said = said.select("record_id", F.col("headers")["x-payload-length"].cast("long").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", "refers_to")
    read = warc.load(spark, path, ["record_id", "record_type", "refers_to", "payload_bytes", "payload_sha1"]).where("record_type = 'response'")
    found = read.select("record_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to").unionByName(said)
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = f"""
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as n, sha1(coalesce(html, '')) as d from pages),
m as (select *, case when n >= {LEAST} then max(page_id) over (partition by d) else page_id end as top from p)
select page_id, n as payload_bytes, d as payload_digest, case when top = page_id then 'response' else 'revisit' end as record_type,
  case when top <> page_id then top end as refers_to from m
"""
