"""Each stage of the pipeline against a brute-force version of itself, on whole small tables."""

import re

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from silvae.llm import mil
from silvae.llm.store import materialize
from tests.helpers import SF
from tests.llm.test_minhash import brute as near
from tests.llm.test_winnow import brute as hits


@pytest.fixture(scope="module")
def stages(spark):
    """The input, and what each stage made of the one before."""
    out = [spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1)).withColumn("ids", F.lit("x"))]
    for name, f in P.STAGES:
        out.append(materialize(f(spark, out[-1], SF), name))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:-1])
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "tokens"]


def test_quality(spark, stages):
    model = mil.fit_quality(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    keep = sorted(i for i, t in pairs(stages[0]) if model.score(*mil.passages(pa.array([t])))[0] >= P.ACCEPT)
    assert sorted(i for i, _ in pairs(stages[1])) == keep and 0 < len(keep) < stages[0].count()


def test_near_duplicates(stages):
    want = sorted({c for _, c in near(pairs(stages[1])).values()})
    assert sorted(i for i, _ in pairs(stages[2])) == want


def test_decontamination(spark, stages):
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = hits(pairs(stages[2]), bench)
    assert sorted(i for i, _ in pairs(stages[3])) == sorted(i for i, x in found.items() if not x[3])


def test_pii(stages):
    kinds = [r"[\w.]+@[\w.]+\.\w+", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\b4\d{15}\b", r"\bAKIA\w{16}\b", r"(?<=password=)\w+", r'(?<=token = ")\w+']
    before, after = dict(pairs(stages[3])), dict(pairs(stages[4]))
    assert before.keys() == after.keys()
    for i, t in before.items():
        found = [m[0] for k in kinds for m in re.finditer(k, t)]
        assert all(x not in after[i] for x in found)
        assert found or after[i] == t
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_tokens(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(pairs(stages[4]))
    for r in stages[5].collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.round_trip


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars"))
    out = odd
    for name, f in P.STAGES[1:]:
        out = materialize(f(spark, out, SF), name)
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and 10**6 in ids and None in ids
    empty = docs.limit(0)
    for name, f in P.STAGES:
        empty = materialize(f(spark, empty, SF), name)
    assert empty.count() == 0
