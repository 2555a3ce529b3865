"""URL rules, sharding, language and quality: brute force, held-out accuracy and edge cases."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silvae.llm import langid, mil, op8_langid, op10_quality, sharding, urls
from silvae.llm import words as W
from tests.helpers import SF

# urls -----------------------------------------------------------------------------------------


def judge(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_rules_against_brute_force(spark):
    r = random.Random(8)
    label = lambda: r.choice(["a", "b", "www", "x-y", "com", "net", ""])
    host = lambda: ".".join(label() for _ in range(r.randint(1, 4)))
    path = lambda: "".join(r.choice(["/", "en/", "e", ""]) for _ in range(r.randint(0, 4)))
    rules = sorted({(h, p): v for h, p, v in ((host(), "/" + path(), r.choice(["allow", "block"])) for _ in range(60)) if h}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    pages = [(i, r.choice(["http://", "HTTPS://", "", "x"]) + host().upper() + r.choice(["", "/", "?q://z/", "#f"]) + path() + r.choice(["", "?a=/", "#b"])) for i in range(600)]
    pages += [(1000, None), (1001, ""), (None, "http://a.com/"), (7, pages[7][1])] + [(2000 + i, "http://hot.com/en/") for i in range(500)]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1)).repartition(6)
    got = urls.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(key, got.collect())) == sorted(map(key, [(i, *judge(u, rules)) for i, u in pages]))


def test_ties_and_empty_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    both = spark.createDataFrame([("a.com", "/", "allow"), ("a.com", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    assert urls.judge(pages, both).first().verdict == "block"
    assert urls.judge(pages, both.limit(0), default="block").first().verdict == "block"
    assert urls.judge(pages.limit(0), both).count() == 0


# shards ---------------------------------------------------------------------------------------


def test_shards_fit_and_are_few(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0, 1, 10, 5000])) for i in range(3000)] + [(None, 7), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, size long").withColumn("shard_key", F.lit(1))
    got = sharding.shard(df, "doc_id", F.col("size"), 40_000).collect()
    assert len(got) == len(rows)
    sums = {}
    for x in got:
        sums[x.shard] = sums.get(x.shard, 0) + x.bytes
    assert all(v <= 40_000 for v in sums.values()) and all(x.shard_bytes == sums[x.shard] for x in got)
    for x in sums:  # a parent would not have fitted
        assert not x or sum(v for s, v in sums.items() if s.startswith(x[:-1])) > 40_000
    assert all(not b.startswith(a) for a in sums for b in sums if a != b)


def test_one_key_too_large_and_rounds(spark):
    """Rows of one key, and those of none, are split by rows; one row that is too large stands alone."""
    df = spark.createDataFrame([(1, 50)] * 10 + [(None, 25)] * 8 + [(i, 1) for i in range(2, 50)] + [(99, 70)], "doc_id long, size long")
    got = sharding.shard(df, "doc_id", F.col("size"), 60).collect()
    assert len(got) == 67
    sums, keys = {}, {}
    for x in got:
        sums[x.shard] = sums.get(x.shard, 0) + x.bytes
        keys.setdefault(x.doc_id, set()).add(x.shard)
    assert all(v <= 60 or v == 70 for v in sums.values()) and all(x.shard_bytes == sums[x.shard] for x in got)
    assert len(keys[1]) == 10 and len(keys[None]) >= 4 and len(keys[99]) == 1 and {x.depth for x in got if x.doc_id == 99} == {120}
    assert all(len(x.shard) == x.depth for x in got) and all(not b.startswith(a) for a in sums for b in sums if a != b)
    assert sharding.shard(df.limit(0), "doc_id", F.col("size"), 60).count() == 0
    assert {x.shard for x in sharding.shard(df, "doc_id", F.col("size"), 10**6).collect()} == {""}
    with pytest.raises(ValueError, match="bytes"):
        sharding.shard(df.withColumn("bytes", F.lit(1)), "doc_id", F.col("size"), 60, ["doc_id", "bytes"])


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = F.octet_length("text")
    sharding.write_shards(docs, "doc_id", size, 100_000, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    got = sharding.shard_sizes(back, size).collect()
    assert len(got) > 3 and all(r.files == 1 and r.bytes <= 100_000 for r in got)
    assert back.drop("shard").exceptAll(docs).count() == 0 and back.count() == docs.count()


# languages --------------------------------------------------------------------------------------


def grams(text):
    t = re.sub(r" +", " ", "".join(c.lower() if c.isalpha() else " " for c in " " + (text or "") + " "))
    return [t[i : i + 4] for i in range(len(t) - 3)] if t.strip() else []


def test_grams_are_those_of_each_text():
    rows = ["The cat", "the CAT!", None, "", "123", "é", "a1b", "long text of words", "x"]
    h, of, letters = langid.grams(pa.array(rows))
    counts = [len(grams(t)) for t in rows]
    assert np.bincount(of, minlength=len(rows)).tolist() == counts
    assert h[of == 0].tolist() == h[of == 1].tolist() and letters.tolist() == [6, 6, 0, 0, 0, 1, 2, 15, 1]


def test_no_false_negatives():
    x = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    names = [f"l{i}" for i in range(70)]
    cells = langid.Filters.empty(names)
    assert langid.Filters.empty(names[:3]).dtype == np.uint8 and cells.shape == (1 << langid.CELL_BITS, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[:2000], x[1000:3000]]).view(np.int64)), pa.array(np.repeat([0, 69], 2000))], ["gram", "bit"])
    for b in langid._cells([batch]):
        for cell, word, mask in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            cells[cell, word] |= np.uint64(mask)
    f = langid.Filters(names, cells)
    assert (f.masks(x[:1000])[:, 0] & 1).all() and (f.masks(x[1000:2000]) == [1, 32]).all()
    assert (f.masks(x[3000:]) > 0).mean() < 0.01 and f.false[2] == 0 and f.false[69] > 0


def plain_grams(text, filters):
    """The n-grams of a text by plain Python, as sets of languages."""
    out = []
    for g in grams(text):
        h = 0
        for c in g:
            h = ((h << 21) & (2**64 - 1)) ^ h >> 43 ^ (0 if c == " " else ord(c))
        h = int(W.mix(np.array([h], np.uint64))[0])
        word = [[int(x) for x in filters.cells[h >> langid.CELL_BITS * p & (1 << langid.CELL_BITS) - 1]] for p in range(langid.PROBES)]
        out.append({b for b in range(len(filters.languages)) if all(w[b // 64] >> b % 64 & 1 for w in word)})
    return out


def test_language_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    f = langid.fit_languages(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = op8_langid.op8_language_filters(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        found = plain_grams(text, f)
        share = [max(0.0, (sum(b in x for x in found) / max(1, len(found)) - f.false[b]) / (1 - f.false[b])) for b in range(len(f.languages))]
        want = f.languages[share.index(max(share))] if any(c.isalpha() for c in text or "") else "und"
        assert r.lang_pred == want and abs(r.score - (max(share) / max(sum(share), 1e-12) if want != "und" else 0)) < 1e-9


def test_long_texts_by_blocks(monkeypatch):
    r = random.Random(2)
    text = "".join(r.choice(["word", " ", "é", "..", "\n", "ß", "日本"]) for _ in range(4000))
    h, _, letters = langid.grams(pa.array([text]))
    x, _ = mil.passages(pa.array([text]))
    m = mil.Model()
    want = m.score(x, np.array([0, len(x)]))[0]
    for size in (64, 1000, 5001):
        monkeypatch.setattr(langid, "LONG", size)
        monkeypatch.setattr(mil, "LONG", size)
        parts = list(langid.pieces(text.encode()))
        assert np.array_equal(np.concatenate([p for p, _ in parts]), h) and sum(n for _, n in parts) == letters[0]
        got = np.concatenate(list(mil.pieces(text.encode())))
        assert got.shape == x.shape and np.allclose(got, x) and abs(m.score_pieces(mil.pieces(text.encode())) - want) < 1e-6
    assert len(list(mil.pieces(b""))) == 1 and np.concatenate(list(mil.pieces(b" " * 9000))).shape == (1, mil.FEATURES)


def test_many_languages_and_one_id_very_often(spark):
    """More languages than bits of a word; one id so often that its rows alone would fill a sample."""
    r = random.Random(5)
    alphabets = ["".join(r.sample("abcdefghijklmnopqrstuvwxyz", 6)) for _ in range(70)]
    rows = [(100 * k + i, " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(40)), f"l{k:02d}") for k, a in enumerate(alphabets) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hot = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("zz zz").alias("text"), F.lit("l00").alias("lang"))
    f = langid.fit_languages(docs.unionByName(hot))
    assert len(f.languages) == 70 and f.cells.shape[1] == 2
    got = langid.predict_language(docs, f).where("lang = lang_pred").count()
    assert got > 0.95 * len(rows)
    assert langid.sample_texts(docs.unionByName(hot), {"l00": 20, "l01": 20}, 10).groupBy("lang").count().orderBy("lang").collect() == [("l00", 10), ("l01", 10)]
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    m = mil.fit_quality(hot.select("doc_id", "text"), labels, folds=1, held=9)
    assert 0 <= m.score(*mil.passages(pa.array(["x"])))[0] <= 1


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predict_language(docs, langid.fit_languages(docs)).where(mil.fold("doc_id", 3) == 1)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_language_edges(spark):
    train = spark.createDataFrame([(i, "the house and the tree " * 3, "en") for i in range(30)] + [(i, "der baum und das haus " * 3, "de") for i in range(30, 60)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    f = langid.fit_languages(train)
    df = spark.createDataFrame([(1, "the tree", 5), (2, "das haus", 5), (3, None, 5), (4, " 12 !", 5), (5, "", 5)], "doc_id long, text string, lang int")
    got = langid.predict_language(df, f).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "de", "und", "und", "und"] and all(0 <= r.score <= 1 for r in got) and got[2].score == 0
    assert langid.predict_language(df, langid.fit_languages(train.limit(0))).first().lang_pred == "und"
    assert langid.predict_language(df.limit(0), f).count() == 0


# quality ----------------------------------------------------------------------------------------


def test_passages():
    x, first = mil.passages(pa.array(["a b. " * 50, None, "", "ONE", "x x x"]))
    assert np.diff(first).tolist() == [3, 1, 1, 1, 1] and not x[3].any() and not x[4].any()
    assert np.allclose(x[:3, : mil._KINDS].sum(1), 1) and x[6, -3] > 0.6  # words that repeat


def plain_score(m, text):
    """A document's score by plain Python over its passages."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    raw = (text or "").encode()
    spans = [x.span() for x in re.finditer(rb"[^\x20\x09-\x0D]+", low)]
    bags = [spans[i : i + mil.PASSAGE] for i in range(0, len(spans), mil.PASSAGE)] or [[]]
    rows = []
    for k, bag in enumerate(bags):
        x = [0.0] * mil.FEATURES
        if bag:
            body = raw[bag[0][0] : bags[k + 1][0][0] if k + 1 < len(bags) else len(raw)]
            kinds, words = [int(mil._KIND[b]) for b in body], [low[a:b] for a, b in bag]
            for q in kinds:
                x[q] += 1 / len(body)
            for q, s in zip(kinds, kinds[1:], strict=False):
                x[mil._KINDS + q * mil._KINDS + s] += 1 / max(1, len(body) - 1)
            again = sum(i > 0 and words[i] == words[i - 1] for i in range(len(words)))
            x[-4:] = [len(set(words)) / len(words), again / len(words), sum(map(len, words)) / len(words) / 10, len(words) / mil.PASSAGE]
        rows.append(x)
    p = {k: v.astype(float) for k, v in m.p.items()}
    top, total, z = None, 0.0, 0.0
    weights = []
    for x in rows:
        h = np.tanh(np.clip((np.array(x) - m.mean) / m.scale, -8, 8) @ p["W"] + p["b"])
        weights.append((float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]), h))
    top = max(s for s, _ in weights)
    for s, h in weights:
        total, z = total + np.exp(s - top), z + np.exp(s - top) * h
    return 1 / (1 + np.exp(-(z / total @ p["c"] + p["d"][0])))


def test_quality_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = mil.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = op10_quality.op10_quality_mil(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_score(m, texts[r.doc_id])
        assert abs(r.score - want) < 1e-3 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.3)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "x", 1, 1)], "doc_id long, text string, score int, lang_pred int")
    for f in (lambda: mil.score_quality(df, mil.Model()), lambda: langid.predict_language(df, langid.fit_languages(df.withColumn("lang", F.lit("en"))))):
        with pytest.raises(ValueError, match="score"):
            f()


def test_gradients():
    r = np.random.default_rng(2)
    m = mil.Model()
    first = np.array([0, 3, 4, 9])
    x, y = r.standard_normal((9, mil.FEATURES)).astype(np.float32), np.array([1, 0, 1], np.float32)
    grads = m._gradients(x, first, y)

    def loss():
        z = m._forward(x, first)[-1].astype(np.float64)
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    for n, p in m.p.items():
        at = tuple(0 for _ in p.shape)
        old, e = p[at], 1e-2
        p[at] = old + e
        up = loss()
        p[at] = old - e
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * e) - grads[n][at]) < 2e-3, n


def test_held_out_quality_and_attention(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = mil.fit_quality(docs, labels)
    got = mil.score_quality(docs, m).join(labels, "doc_id").where(mil.fold("doc_id", 5) == 0)
    assert got.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("double"))).first()[0] > 0.95
    x, first = mil.passages(pa.array(["good words here, and more of them. " * 30 + "@@@ ### $$$ %%% " * 40]))
    assert abs(m.attention(x, first).sum() - 1) < 1e-5


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "x", "s"), (2, "", "s")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int")
    got = mil.score_quality(docs, mil.fit_quality(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if not r.text}) == 1
    assert mil.score_quality(docs.limit(0), mil.Model()).count() == 0


def test_no_language_is_lost_to_copies(spark):
    """Copies of one text in one language next to many texts of another."""
    german = "Der schnelle braune Fuchs springt über den faulen Hund und läuft in den Wald zurück."
    copies = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(german).alias("text"), F.lit("de").alias("lang"))
    for seed in range(3):
        other = spark.range(1337).select((F.col("id") * 3 + seed * 10_000).alias("doc_id"), F.concat(F.lit("The quick brown fox jumps over the lazy dog number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
        both = copies.withColumn("doc_id", F.lit(seed + 1).cast("long")).unionByName(other)
        got = langid.predict_language(spark.createDataFrame([(german, 1)], "text string, n int"), langid.fit_languages(both, folds=1, held=5)).first()
        assert got.lang_pred == "de"
