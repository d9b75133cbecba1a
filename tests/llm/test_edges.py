"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import random
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silicore.llm import exact_dedup, extendible, jaccard_join, lm_scoring, mixing, quality, sentencepiece_bpe, sharding, topk, url_filter, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
rnd = random.Random(7)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n))


ODD = [
    (1, words(40, 1), "en", "a", 9), (2, words(40, 1), "en", "a", 9), (2, words(40, 1), "en", "a", 9), (3, None, "en", "a", None), (4, "", "en", "a", 0), (5, "  \n\t ", None, None, 5), (None, words(40, 1), None, None, None),
    (None, None, None, None, None), (6, LONG, "de", "b", 1), (7, LONG + " z", "de", "b", 1), (8, "solo", "en", None, 4), (9, "solo", "en", "c", 4), (10, "Solo", "en", "c", 4), (11, "\U0001f600 é▁x", "fr", "c", 3), (12, words(30, 2), "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every oddity, and extra columns whose names could clash."""
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({"keep": F.lit(1), "hash": F.lit("h"), "row": F.col("doc_id"), "block": F.lit(None).cast("int"), "a.b": F.lit(2), "kind": F.lit("k")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_callers_columns_never_clash(spark):
    """Every name that an operator uses inside is carried through as an extra column."""
    import re
    from pathlib import Path

    rows = spark.createDataFrame([(1, words(40, 1), "en", "a", 1), (2, words(40, 1), "en", "a", 1), (3, words(40, 1) + " z", "en", "b", 1), (3, words(40, 9), "en", "b", 1), (4, None, None, None, None)], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0)], LABELS)
    cases = [(quality, lambda d: quality.keep_good(d, labels)), (exact_dedup, exact_dedup.drop_copies), (jaccard_join, jaccard_join.drop_near), (sharding, lambda d: sharding.place(d).drop("depth", "shard", "page", "oversize"))]
    for module, call in cases:
        source = Path(module.__file__).read_text() + Path(extendible.__file__).read_text()
        names = sorted({n for n in re.findall(r'"(__\w+)"', source)} | {"__x_s0", "__x_d0", "__x_slot0", "comp", "sid", "a", "b", "doc", "__in0", "a.b"})
        extra = rows.withColumns({n: F.lit(f"v-{n}") for n in names})
        out, plain = call(extra), call(rows)
        assert out.columns == extra.columns, module.__name__
        assert out.where(" OR ".join(f"`{n}` <> 'v-{n}' OR `{n}` IS NULL" for n in names)).isEmpty(), module.__name__
        assert as_rows(out.select(*rows.columns)) == as_rows(plain) and plain.count() > 0, module.__name__


# -- 1

LABELS = "doc_id bigint, quality int, toxic int"


def test_quality_defined_results(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 1, 0), (7, 0, 0), (7, 1, 0), (9, 0, 1), (None, 1, 0), (12, None, None)], LABELS)
    out = quality.classify(odd, labels)
    assert out.count() == len(ODD)
    assert {(r.doc_id, r.keep, r.posterior) for r in out.where("doc_id IN (3, 4, 5)").collect()} == {(3, False, 0.0), (4, False, 0.0), (5, False, 0.0)}
    few = quality.classify(odd, labels, words=False)
    assert quality.keep_good(odd, labels, words=False).count() == few.where("keep").count() and few.count() == len(ODD)
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert kept.count() == out.where("keep").count()
    assert quality.classify(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0
    no = spark.createDataFrame([], LABELS)
    assert quality.classify(odd, no).where("keep").count() == len(ODD) - 4


def test_quality_computes_the_statistics_of_a_text_once(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0)], LABELS)
    kept = quality.keep_good(odd, labels, words=False)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "op1-bins" in kept._jdf.queryExecution().executedPlan().toString()
    # what Parquet has no type for is carried through all the same
    extra = quality.keep_good(odd.withColumns({"void": F.lit(None), "interval": F.expr("make_interval(1, 2)")}), labels, words=False)
    assert extra.columns == [*odd.columns, "void", "interval"]
    assert as_rows(extra.drop("void", "interval")) == as_rows(kept) and extra.where("void IS NULL AND CAST(interval AS STRING) = CAST(make_interval(1, 2) AS STRING)").count() == kept.count() > 0


def test_the_pipeline_keeps_no_table_that_a_later_stage_does_not_read(spark, tmp_path):
    import corpus_pipeline
    from silicore.llm import common

    docs = spark.createDataFrame([(i, words(30, i), "en", "a", 1) for i in range(40)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    there = set(folder.iterdir())
    other = common.materialize(docs, "other")
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - there}
    # the tables of the last stage, its input, and the blocks that it cuts by
    assert left == {"other", "stage-4", "op2-blocks", "op2-layouts"}
    assert out.count() > 0 and other.count() == 40


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"])
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    out = quality.classify(docs, train).join(test, "doc_id").toPandas()
    assert (out.keep == (out.quality == 1)).mean() > 0.95
    assert out[out.quality == 1].keep.mean() > 0.97


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "good text here " + words(60, i), "en", "big", 1) for i in range(40)] + [(100 + i, "XX!! " * 30, "en", "bad", 1) for i in range(40)] + [(200, words(60, 999), "en", "rare", 1)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100 + i, 0, 0) for i in range(20)], LABELS)
    out = {r.source: r.site_prior for r in quality.classify(spark.createDataFrame(rows, DOCS), labels).groupBy("source").agg(F.avg("site_prior").alias("site_prior")).collect()}
    assert out["bad"] < out["rare"] < out["big"]
    assert abs(out["rare"] - 41 / 81) < 0.1


# -- 2


def test_mixing_is_lossless(spark, odd, none, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 7)
    out = mixing.mix(odd)
    assert out.count() == out.select("shard", "slot").distinct().count()
    split, _, _ = mixing._plan(odd, None, mixing.SHARD)
    blocks = mixing._blocks(odd, split).withColumn("t", F.expr("array_join(transform(__m_ps, x -> x.p), '')")).orderBy("__m_s", "__m_l", "__m_i", "__m_b").collect()
    streams = {}
    for b in blocks:
        streams.setdefault((b["__m_s"], b["__m_l"]), []).append(b["t"])
    whole = "".join("".join(v) for v in streams.values())
    want = [t + mixing.EOD for _, t, *_ in ODD if t]
    assert len(whole) == sum(map(len, want)) and all(t in whole for t in want)
    assert all(b.n_tokens == 7 for b in blocks[:-1] if streams[(b["__m_s"], b["__m_l"])][-1] != b["t"])
    assert mixing.mix(none).count() == 0
    made = mixing.mix_documents(odd)
    assert made.columns == odd.columns and made.where("keep IS NOT NULL").isEmpty()


def test_mixing_weights(spark):
    docs = spark.createDataFrame([(i, words(300, i), "en", "big" if i % 10 else "small", 1) for i in range(300)], DOCS)
    n = mixing.mix(docs).count()
    got = {r.source: r["count"] / n for r in mixing.mix(docs, {"small": 3.0, "big": 1.0, "absent": 5.0}).groupBy("source").count().collect()}
    assert abs(got["small"] - 0.75) < 0.12
    assert {r.source for r in mixing.mix(docs, {"big": 1.0}).select("source").distinct().collect()} == {"big"}
    assert mixing.mix(docs, {"absent": 1.0}).count() == 0


def test_mixing_repeats_a_small_source(spark, monkeypatch):
    """A source that is passed through many times: its draws are spread over rows, none is lost."""
    docs = spark.createDataFrame([(i, words(400, i), "en", "big", 1) for i in range(60)] + [(100, words(700, 5), "en", "tiny", 1)], DOCS)
    monkeypatch.setattr(mixing, "EPOCHS", 3)
    few = as_rows(mixing.mix(docs, {"tiny": 9.0, "big": 1.0}))
    monkeypatch.setattr(mixing, "EPOCHS", 10_000)
    assert few == as_rows(mixing.mix(docs, {"tiny": 9.0, "big": 1.0}))
    tiny = [r for r in few if r[2] == "tiny"]
    assert len({r[4] for r in tiny}) == 2 and max(r[5] for r in tiny) > 6 and len({r[:2] for r in few}) == len(few)


def test_mixing_names_every_document(spark, monkeypatch, tmp_path):
    """Every piece of a block comes out under its own document's id, also after a write."""
    import corpus_pipeline
    from collections import Counter

    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = [(i, words(3 + i % 5, i), "en", "a", 1) for i in range(60)] + [(None, "x y z", "en", "a", 1), (None, "x y z", "en", "a", 1), (70, "\u00e9\U0001f600 " + words(40, 9), None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs)
    want = Counter(i for r in mixed.collect() for i in r.doc_ids)
    mixing.mix_documents(docs).write.parquet(f"{tmp_path}/b")
    blocks = spark.read.parquet(f"{tmp_path}/b")
    cut = mixing.by_document(blocks).collect()
    assert Counter(r.doc_id for r in cut) == want
    whole = {r[0]: r[1] + mixing.EOD for r in rows}
    assert all(r.text in whole[r.doc_id] for r in cut)
    assert sum(len(r.text) for r in cut) == mixed.agg(F.sum(F.char_length("text"))).first()[0]
    out = corpus_pipeline.tokens_stage(spark, blocks, "").collect()
    assert Counter(r.doc_id for r in out) == want and all(len(r.ids) == r.n_tokens > 0 for r in out)


def test_blocks_of_one_look_keep_their_own_layouts(spark, tmp_path):
    rows = [(1, "p q", "en", "a", [(1, 1), (2, 2)])] * 2 + [(1, "p q", "en", "a", [(1, 1), (3, 2)])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, pieces array<struct<doc_id: bigint, n: int>>")
    df.withColumn("key", mixing._block_key()).write.parquet(f"{tmp_path}/t")
    blocks = df.select("doc_id", F.col("text").alias("text", metadata={mixing.BLOCKS: f"{tmp_path}/t"}), "lang", "source")
    got = as_rows(mixing.by_document(blocks).select("doc_id", "text"))
    assert got == sorted([(1, "p")] * 3 + [(2, " q")] * 2 + [(3, " q")], key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4099])
def test_permutation(n):
    x = np.arange(n, dtype=np.int64)
    for key in (0, 5, 2**28 - 1):
        p = mixing.permuted(x, np.full(n, key), np.full(n, n))
        assert sorted(p) == list(range(n))
    if n >= 1000:
        assert abs(np.corrcoef(x, p)[0, 1]) < 0.1


# -- 3

PAGES = [(1, "http://a/b", "<html>é</html>"), (2, None, "x"), (3, "http://a/\r\nX: y z", None), (None, "u", ""), (1, "http://a/b", "<html>é</html>"), (9, "big", "z" * 400_000)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES * 3, "page_id bigint, url string, html string").withColumn("data", F.lit(1))
    framed = warc.frames(pages.coalesce(2), frame_bytes=2000, bundle_bytes=500_000)
    files = {}
    for r in framed.orderBy("bundle", "frame").collect():
        assert r.frame_offset == len(files.get(r.bundle, b""))
        files[r.bundle] = files.get(r.bundle, b"") + bytes(r.data)
    seen = []
    for r in warc.locators(framed).collect():
        got = warc.read_record(files[r.bundle], r.frame, r.offset, r.length)
        assert got["WARC-Record-ID"] == r.record_id
        block = got["block"]
        seen.append((r.page_id, "WARC-Target-URI" in got, None if block is None else block.decode()))
    assert sorted(seen, key=repr) == sorted([(p, u is not None, h) for p, u, h in PAGES * 3], key=repr)
    assert warc.locators(framed).select("bundle", "record_id").distinct().count() == len(PAGES) * 3
    import io

    import zstandard

    for data in files.values():
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert plain.count(b"WARC/1.1\r\n") == plain.count(b"Content-Length")
    warc.save(framed, str(tmp_path))
    assert {p.name.split(".")[0]: p.read_bytes() for p in tmp_path.iterdir()} == files
    assert warc.frames(pages.where("false")).count() == 0


# -- 4


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 12))
    x[50] = x[51] = x[52]
    x[7] = 0
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, None, 0), (401, [], 0), (None, [1.0] * 12, 0), (402, [1.0, None], 0), (403, [float("nan")] * 12, 0), (404, [2.0, 1.0], 0), (405, [1.0, 3.0], 0), (5, x[5].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("score", F.lit(1))
    got = {}
    for q, n, s in topk.search(df, k=4, slices=3, block=64).orderBy("vec_id", "rank").select("vec_id", "neighbor_id", "score").collect():
        got.setdefault(q, []).append((n, s))
    s = np.round(x @ x.T, 9)
    for q in range(300):
        want = sorted(((-s[q, j], j) for j in range(300) if j != q))[:4]
        assert [n for n, _ in got[q]] == [j for _, j in want], q
    assert [n for n, _ in got[404]] == [405] and set(got) == {*range(300), 404, 405}
    assert topk.search(df.where("false")).count() == 0


def test_topk_asks_some_and_searches_all(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(220, 6))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    s = np.round(x @ x.T, 9)
    want = [(q, n, j) for q in range(0, 220, 50) for n, (_, j) in enumerate(sorted((-s[q, j], j) for j in range(220) if j != q)[: topk.K], 1)]
    for query in (topk.op4_topk, topk.op4_topk_blocks):
        assert sorted((r.vec_id, r.rank, r.neighbor_id) for r in query(spark, str(tmp_path)).collect()) == want


# -- 5


def test_sentencepiece_against_library(spark, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.MODEL)
    r = random.Random(3)
    bits = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "你好", "\U0001f600", "▁", "!!", "Zq", "0", "\u0000", "x" * 40]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(3000)] + [" " * k for k in range(70)] + [LONG, "", "a" * 5000]
    enc = sentencepiece_bpe.Encoder(sentencepiece_bpe.MODEL)
    ids = enc.encode(pa.array(texts))
    assert ids.to_pylist() == sp.encode(texts)
    assert enc.decode(ids).to_pylist() == [t.replace("▁", " ") for t in texts]
    assert enc.decode(pa.array([[3 + 0xFF], [1, 2], None], pa.list_(pa.int32()))).to_pylist() == ["�", "", None]
    out = {(r.doc_id, r.n_tokens, r.decoded) for r in sentencepiece_bpe.round_trip(odd).where("doc_id IN (3, 4, 8)").collect()}
    assert out == {(3, None, None), (4, 0, ""), (8, len(sp.encode("solo")), "solo")}
    assert sentencepiece_bpe.round_trip(none).count() == 0
    again = sentencepiece_bpe.decode(sentencepiece_bpe.encode(odd)).where("doc_id = 6").first()
    assert again.text == LONG


# -- 6


def test_exact_dedup(spark, odd, none):
    out = exact_dedup.find_copies(odd, capacity=200, owner_bytes=500)
    assert out.count() == len(ODD)
    assert {r.doc_id: (r.kept_doc_id, r.is_copy) for r in out.where("doc_id IN (3, 7, 8, 9, 10)").collect()} == {3: (3, False), 7: (7, False), 8: (8, False), 9: (8, True), 10: (10, False)}
    assert sorted((r.doc_id or -1, r.is_copy) for r in out.where("kept_doc_id = 1").collect()) == [(-1, True), (1, False), (2, True), (2, True)]
    kept = exact_dedup.drop_copies(odd, capacity=200, owner_bytes=500)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert len([t for t in texts if t is None]) == 2 and len(texts) == 2 + len({t for _, t, *_ in ODD if t is not None})
    assert exact_dedup.find_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_exact_dedup_of_a_text_that_outweighs_an_owner(spark):
    rows = [(i, words(40, 1), "en", "a", i) for i in range(200)] + [(None, words(40, 1), None, None, 0)] * 3 + [(1000 + i, words(20, i), "en", "b", i) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    kept = exact_dedup.drop_copies(docs, capacity=200, owner_bytes=500)
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(1000, 1020)]
    assert "__x_share" in kept._jdf.queryExecution().optimizedPlan().toString()


# -- 7

URLS = ["http://a.example.net/x", "https://b.example.net:80/fr/1?q#f", "HTTP://U@Example.NET./fr", "http://example.org/de", "http://example.org/den", "x.example.org/de/y/", "http://thther.example.org/fr/2", "http://example.com/es/1/2", "http://example.com/es/12", "//m.ththth.example.net/z", "", None, "http://", "mailto:x@y", "http://notexample.net/", "http://q.m.example.com/en//a", "http://q.m.example.com/fr", "http://any.host.xxx/a", "http://xxx", "http://m.example.com/en/" + "a/" * 50_000]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string").withColumn("action", F.lit("mine"))
    block = ["example.net", "ththre.example.com", "example.org/de", "m.example.com", "thther.example.org/fr", "example.com/es/1", "spam.example", "xxx", "example.net"]
    allow = ["example.net/fr", "m.ththth.example.net", "thther.example.org", "example.com/es", "m.example.com/en", None, "", "/only/path"]
    rules = url_filter.entries(spark, allow, block)
    trie = as_rows(url_filter.judge(pages, rules))
    assert trie == as_rows(url_filter.judge(pages, rules, trie_entries=0))
    got = [r[2] for r in sorted(trie)]
    assert got == ["block", "allow", "allow", "block", "none", "block", "block", "block", "allow", "allow", "invalid", "invalid", "invalid", "none", "none", "allow", "block", "block", "block", "allow"]
    assert all(url_filter.judge(pages.where("false"), rules, trie_entries=n).count() == 0 for n in (0, 100))
    both = url_filter.entries(spark, ["a.b"], ["a.b"])
    assert [r.action for r in url_filter.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string"), both).collect()] == ["block"]
    assert url_filter.judge(pages.where("false"), rules).count() == 0
    assert {r.action for r in url_filter.judge(pages, url_filter.entries(spark, [], [])).collect()} == {"none", "invalid"}


# -- 8


def brute(train: list[str], texts: list[str]) -> list[float]:
    import hashlib
    from collections import Counter, defaultdict

    n = lm_scoring.ORDER
    counts: list[dict] = [defaultdict(Counter) for _ in range(n)]
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % lm_scoring.VOCAB
    pad = lambda t: [-1] * (n - 1) + [bucket(w) for w in t.split()] + [-2]
    for t in train:
        s = pad(t)
        for i in range(n - 1, len(s)):
            for k in range(n):
                counts[k][tuple(s[i - k : i])][s[i]] += 1

    def p(h: tuple, w: int) -> float:
        low = p(h[1:], w) if h else 1 / lm_scoring.SYMBOLS
        c = counts[len(h)].get(h)
        return low if c is None else (c[w] + len(c) * low) / (sum(c.values()) + len(c))

    return [sum(np.log(p(tuple(s[i - n + 1 : i]), s[i])) for i in range(n - 1, len(s))) for s in map(pad, texts)]


@pytest.mark.parametrize("packed, part_bytes", [(2_000_000, 12 << 20), (50, 300)])
def test_lm_scoring(spark, odd, none, monkeypatch, packed, part_bytes):
    monkeypatch.setattr(lm_scoring, "PACKED", packed)
    monkeypatch.setattr(lm_scoring, "PART_BYTES", part_bytes)
    train = [words(50, i) for i in range(20)] + ["", "é " * 30, words(50, 3) + " end"]
    texts = [words(30, 500), "zzz QQQ é😀", "", train[3], words(400, 600), " \n\t ", words(50, 3) + " other", "é é é"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate([*train, None])], "doc_id bigint, text string")
    d = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])] + [(None, texts[0])], "doc_id bigint, text string").withColumn("s", F.lit("x"))
    want = brute(train, texts)
    out = {r.doc_id: r for r in lm_scoring.score(d, t).collect()}
    assert len(out) == len(texts) + 2 and out[None].mean_logprob == out[0].mean_logprob
    for i, x in enumerate(texts):
        n = len(x.split()) + 1
        assert out[i].n_words == n and abs(out[i].mean_logprob - want[i] / n) < 2e-6, i
    assert out[len(texts)].n_words == 0 and out[len(texts)].mean_logprob is None
    own = {r.doc_id: r.mean_logprob for r in lm_scoring.score(t, t).collect()}
    assert all(abs(own[i] - s / (len(x.split()) + 1)) < 2e-6 for i, (x, s) in enumerate(zip(train, brute(train, train))))
    assert lm_scoring.score(none, t).count() == 0
    empty = lm_scoring.score(d, none).where("doc_id = 0").first()
    assert abs(empty.mean_logprob + np.log(lm_scoring.SYMBOLS)) < 1e-6
    assert lm_scoring.score(odd, odd).count() == len(ODD)


def test_lm_scoring_reads_texts_twice(spark):
    """Once for the words and once for the transitions, whatever order the rows come in."""
    read = spark.sparkContext.accumulator(0)

    def counted(it):
        for batch in it:
            read.add(batch.num_rows)
            yield batch

    texts = [words(50, i) for i in range(20)]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").orderBy(F.rand()).mapInArrow(counted, "doc_id bigint, text string")
    out = {r.doc_id: r for r in lm_scoring.score(t, t).collect()}
    assert all(out[i].n_words == 51 and abs(out[i].mean_logprob - s / 51) < 2e-6 for i, s in enumerate(brute(texts, texts)))
    assert read.value == 2 * len(texts)


def test_lm_scoring_frequent_word(spark, monkeypatch):
    """A word of half of all positions has its states dealt out to pieces."""
    monkeypatch.setattr(lm_scoring, "PACKED", 400)
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 400)
    monkeypatch.setattr(lm_scoring, "_TAKEN", 50)
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "the", "the", *"abcdef"]) if r.random() < 0.8 else f"w{r.randrange(300)}" for _ in range(80)) for _ in range(30)]
    other = [" ".join(r.choice(["the", "b", "w7", "unseen"]) for _ in range(60)) for _ in range(5)]
    t, d = (spark.createDataFrame(list(enumerate(x)), "doc_id bigint, text string") for x in (texts, other))
    count, size = lm_scoring._counts(t)
    assert size == sum(map(len, texts)) and lm_scoring._layout(count, -(-size // 400))[1].max() > 2
    for docs, own, n in ((t, texts, 81), (d, other, 61)):
        out = {x.doc_id: x.mean_logprob for x in lm_scoring.score(docs, t).collect()}
        assert all(abs(out[i] - s / n) < 2e-6 for i, s in enumerate(brute(texts, own)))


# -- 9


def test_sharding(spark, odd, none):
    many = odd.unionByName(spark.createDataFrame([(1, words(40, 1), "en", "a", 9)] * 30, DOCS), allowMissingColumns=True)
    limit = 1500
    out = sharding.shard(many, limit)
    assert out.count() == len(ODD) + 30
    shards = out.groupBy("depth", "shard", "page").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.max("oversize").alias("o")).collect()
    assert all(s.b <= limit or (s.n == 1 and s.o) for s in shards)
    leaves = {(s.depth, s.shard) for s in shards}
    assert not any((d, p >> (e - d)) in leaves for e, p in leaves for d in range(e))
    assert sharding.shard(none).count() == 0


def test_sharding_writes_whole_shards(spark, odd, none, tmp_path):
    same = [(None, words(40, 1), "en", f"s{i}", i) for i in range(30)]
    many = odd.unionByName(spark.createDataFrame(same, DOCS), allowMissingColumns=True)
    limit = 1500
    sharding.save(many, f"{tmp_path}/out", limit)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert as_rows(back.select(*[f"`{c}`" for c in many.columns])) == as_rows(many)
    sizes = lambda df, n: sorted(tuple(r) for r in df.groupBy("depth", "shard", "page").agg(F.sum(n), F.count("*")).collect())
    assert sizes(back, F.coalesce(F.octet_length("text"), F.lit(0))) == sizes(sharding.shard(many, limit), "n_bytes")
    assert len(list((tmp_path / "out").rglob("*.parquet"))) == back.select("depth", "shard", "page").distinct().count()
    assert sharding.place(none).count() == 0
    with pytest.raises(ValueError):
        sharding.place(odd.withColumn("Shard", F.lit(1)))


def test_directory_splits_only_what_overflows(spark):
    keys = [(i << 50) + i for i in range(1024)] + [(5 << 50) + (k << 20) for k in range(300)]
    df = spark.createDataFrame([(k, 1) for k in keys], "__x_key bigint, __x_bytes bigint")
    levels = extendible.directory(df, 16)
    got = extendible.locate(df, levels).toPandas()
    sizes = got.groupby(["__x_depth", "__x_bucket"]).size()
    assert sizes.max() <= 16
    total = lambda d, p: sum(k >> (60 - d) == p for k in keys)
    assert all(d == 0 or total(d - 1, p >> 1) > 16 for d, p in sizes.index)


# -- 10


def similar_sets(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").split()
        if i is not None and w:
            n = jaccard_join.N
            sets.setdefault(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]), set()).add(i)
    return {k: sorted(v) for k, v in sets.items()}


def expected_pairs(docs):
    """Every pair of documents with its Jaccard similarity."""
    sets, out = list(similar_sets(docs).items()), {}
    for k, (a, x) in enumerate(sets):
        for b, y in sets[: k + 1]:
            o = len(a & b)
            if (jaccard_join.NUM + jaccard_join.DEN) * o >= jaccard_join.NUM * (len(a) + len(b)):
                for i in x:
                    for j in y:
                        if i != j:
                            key = min(i, j), max(i, j)
                            out[key] = max(out.get(key, 0), round(o / (len(a) + len(b) - o), 6))
    return out


def near_corpus():
    docs, r = [], random.Random(5)
    for g in range(12):
        base = words(r.randrange(3, 120), 1000 + g).split()
        for _ in range(r.randrange(1, 30)):
            w = [x if r.random() > 0.06 else words(1, r.randrange(10**6)) for x in base]
            docs.append((len(docs) * 3, " ".join(w)))
    common = words(80, 77)
    docs += [(5000 + i, common + " " + words(10 + 10 * i, i)) for i in range(12)]
    docs += [(9000 + i, words(60, 31)) for i in range(9)]
    # documents with several texts, alike and not
    docs += [(9000, words(60, 31) + " more"), (9003, words(50, 91)), (0, words(60, 31)), (0, docs[4][1]), (9100, docs[2][1]), (9100, docs[2][1] + " x")]
    return docs


@pytest.mark.parametrize("group_sets, chunk", [(20_000, 256), (3, 2)])
def test_jaccard_against_brute_force(spark, monkeypatch, group_sets, chunk):
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", group_sets)
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "INDEX_ROWS", 50 * group_sets)
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    docs = near_corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("comp", F.lit(1))
    assert as_rows(jaccard_join.join(df)) == sorted(((a, b, j) for (a, b), j in expected_pairs(docs).items()), key=repr)


def test_jaccard_defined_results(spark, odd, none):
    docs = [(i, t) for i, t, *_ in ODD]
    got = jaccard_join.join(odd).collect()
    assert {(r.doc_id_a, r.doc_id_b): r.jaccard for r in got} == expected_pairs(docs) and len(got) == len(expected_pairs(docs))
    assert {(r.doc_id_a, r.doc_id_b) for r in got} == {(1, 2), (6, 7), (8, 9)}
    kept = jaccard_join.drop_near(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 8, 10, 11, 12]
    assert kept.where("doc_id IS NULL").count() == 2
    assert jaccard_join.join(none).count() == 0 and jaccard_join.drop_near(none).count() == 0


def expected_links(docs):
    """(doc_id, class_id, links) of every document and set of its own."""
    sets = list(similar_sets(docs).items())
    near = [[k for k, (b, _) in enumerate(sets) if a is not b and (jaccard_join.NUM + jaccard_join.DEN) * len(a & b) >= jaccard_join.NUM * (len(a) + len(b))] for a, _ in sets]
    least = [min(own) for _, own in sets]
    while (new := [min([least[i], *(least[k] for k in ks)]) for i, ks in enumerate(near)]) != least:
        least = new
    rows = [(d, least[i], len(near[i])) for i, (_, own) in enumerate(sets) for d in own]
    return sorted(rows + [(i, None, 0) for i in {i for i, t in docs if i is not None and not (t or "").split()}], key=repr)


@pytest.mark.parametrize("group_sets, bundle", [(2_000, 512), (60, 20)])
def test_links_of_large_families(spark, monkeypatch, group_sets, bundle):
    """A family of near copies is not sent about as its pairs."""
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", group_sets)
    monkeypatch.setattr(jaccard_join, "BUNDLE", bundle)
    sent, write = {}, jaccard_join.materialize

    def counted(df, tag):
        out = write(df, tag)
        sent[tag] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    r = random.Random(9)
    docs = near_corpus()
    for g, n in ((1, 700), (2, 200)):
        base = words(60, 500 + g).split()
        docs += [(20_000 * g + i, " ".join(x if r.random() > 0.08 else words(1, r.randrange(10**6)) for x in base)) for i in range(n)]
    docs += [(70_000, " "), (70_001, None), (None, "a b c")]
    got = jaccard_join.links(spark.createDataFrame(docs, "doc_id bigint, text string"))
    want = expected_links(docs)
    assert as_rows(got) == want
    assert sent["op10-candidates"] < sum(n for *_, n in want) / 10


def test_links_defined_results(spark, odd, none):
    assert as_rows(jaccard_join.links(odd)) == expected_links([(i, t) for i, t, *_ in ODD])
    assert jaccard_join.links(none).count() == 0


def test_drop_near_judges_each_text_of_an_id(spark):
    near, alone = words(40, 1), words(40, 2)
    rows = [(1, near), (5, near + " z"), (5, alone), (5, None), (5, " \n"), (7, near + " y"), (7, "  ")]
    kept = jaccard_join.drop_near(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert kept.columns == ["doc_id", "text"]
    assert as_rows(kept) == sorted([(1, near), (5, alone), (5, None), (5, " \n"), (7, "  ")], key=repr)


def test_overlaps_derive_from_leaders():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 40, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(400) > 0.04], r.integers(0, 1 << 40, 20).astype(np.uint64)])) for _ in range(25)]
    sets += [np.unique(r.integers(0, 1 << 40, 300).astype(np.uint64)) for _ in range(5)]
    pairs = np.array([(i, j) for i in range(30) for j in range(i + 1, 30)])
    got = jaccard_join.overlaps(sets, pairs)
    assert list(got) == [len(np.intersect1d(sets[i], sets[j])) for i, j in pairs]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 200)]
    out = {r.node: r.comp for r in jaccard_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 300: 100}


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (7, 0, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{i}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert i == 4 or docs.columns == odd.columns, name
    assert docs.count() > 0
    assert isinstance(docs.toPandas(), pd.DataFrame)
