"""Quality classifier: hierarchical empirical Bayes.

A classifier gives every document a log likelihood ratio: naive Bayes over five binned
statistics. One is the mean weight of the document's words, hashed into ``BUCKETS``; a
bucket's weight is the log ratio of the shares of good and bad labelled documents that have
a word of it. Words are weighed by the labelled documents of even id and the bins of their
mean by those of odd id, so the bins see documents that the weights have not. The other
four are shares of symbols, capitals and repeated words, and the length. The soft verdicts are summed per path (source, lang) and
per host (source) by grouped aggregation; each level's mean is shrunk towards the
level above with a strength estimated from the spread between sites (method of
moments), so that a site with few documents falls back on its host and a sparse
host on the global mean. The posterior of a document is the path's prior, from
which the document's own verdict is taken out, times its likelihood ratio.

Defined results
  * null or blank text: posterior 0, rejected;
  * null source or lang: a site of its own (null is a key like any other);
  * null label, or a document with contradicting labels: not used in fitting;
  * repeated rows: each is scored and kept or rejected alike; repeated labels of
    one document count once; documents that share a doc_id share its label;
  * ``FIT_ROWS`` labelled documents at most, by the hash of their id, weigh words; every
    other count is over all;
  * a null doc_id has no label; no usable label of either parity: its evidence is 0;
  * no usable label: all evidence is 0, so every non-blank document is kept;
  * empty documents: an empty result;
  * extra columns of either input are ignored by ``classify`` and carried through
    unchanged by ``keep_good``, whatever their names.

``words=False`` leaves the words' statistic out: one pass without Python, for corpora in
which the other four tell as much (figures in the README).

All features but the words' are built-in expressions. The evidence table has a fixed
number of rows (the bins), so it is broadcast as one row, and the words' weights a fixed
number of places; the site table grows with the
data and is broadcast only behind a size check.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shielded, small, table
from .sentencepiece_bpe import slices
from .words import split

BINS = {"sym": 16, "up": 13, "dis": 11, "len": 17, "word": 16}
#: Hashed words are weighed by the first 16 bits of their MD5.
BUCKETS = 1 << 16
#: Labelled documents, at most, that weigh words.
FIT_ROWS = 200_000
#: Words whose bucket a worker remembers.
KNOWN = 100_000
THRESHOLD = 0.5
#: Limits of the estimated prior strengths (pseudo-documents).
STRENGTH = (1.0, 1000.0)
_NONE = "\u0001"


def _bins(text: Column) -> dict[str, Column]:
    n = F.char_length(text)
    ratio = lambda c: F.coalesce(F.try_divide(c.cast("double"), n), F.lit(0.0))
    words = F.split(text, " ", -1)
    return {
        "sym": F.least(F.lit(15), F.floor(ratio(F.regexp_count(text, F.lit(r"[^\p{L}\p{N} \t\n\r\f]"))) * 50).cast("int")),
        "up": F.least(F.lit(12), F.floor(ratio(F.regexp_count(text, F.lit(r"\p{Lu}"))) * 20).cast("int")),
        "dis": F.floor(F.size(F.array_distinct(words)).cast("double") / F.size(words) * 10).cast("int"),
        "len": F.least(F.lit(16), F.floor(F.log2(n + F.lit(1.0)) + 1e-9).cast("int")),
    }


def _words(texts: pa.Array, known: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct words of every text, by text."""
    h, s, e, bound, view = split(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(bound))
    order = np.lexsort((h, owner))
    h, owner, first = h[order], owner[order], order
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
    h, owner, first = h[new], owner[new], first[new]
    uniq, one, at = np.unique(h, return_index=True, return_inverse=True)
    raw, out = view.tobytes(), np.empty(len(uniq), np.int64)
    if len(known) > KNOWN:
        known.clear()  # a cache alone
    for i, (k, f) in enumerate(zip(uniq.tolist(), first[one].tolist())):
        got = known.get(k)
        if got is None:
            got = known[k] = int(hashlib.md5(raw[s[f] : e[f]]).hexdigest()[:4], 16)
        out[i] = got
    return owner, out[at]


def _micros(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5).astype(np.int64)


def _weights(docs: DataFrame, votes: DataFrame) -> np.ndarray:
    """Every bucket's weight in millionths, from the labelled documents of even id."""
    votes = votes.where("pmod(__l_id, 2) = 0").orderBy(F.md5(F.col("__l_id").cast("string")), "__l_id").limit(FIT_ROWS)
    known = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(votes), F.col("doc_id") == F.col("__l_id"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bucket, q, n): documents of label q that have the bucket; bucket -1: all documents with words."""
        total, seen = np.zeros((2, BUCKETS + 1), np.int64), {}
        for batch in it:
            for part in slices(batch, "text", 1 << 20):
                owner, bucket = _words(part.column("text"), seen)
                q = part.column("q").to_numpy()
                pair = np.unique(owner * BUCKETS + bucket)
                np.add.at(total, (q[pair // BUCKETS], pair % BUCKETS), 1)
                np.add.at(total, (q[np.unique(owner)], BUCKETS), 1)
        q, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(q), pa.array(total[q, b])], names=["b", "q", "n"])

    got = known.select("text", F.col("__l_q").cast("bigint").alias("q")).mapInArrow(count, "b bigint, q bigint, n bigint").groupBy("b", "q").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((2, BUCKETS + 1))
    n[got.column("q").to_numpy(), got.column("b").to_numpy()] = got.column("n").to_numpy()
    if not n[:, BUCKETS].any():
        return np.zeros(BUCKETS, np.int64)
    return _micros(np.log((n[1, :BUCKETS] + 1.0) / (n[1, BUCKETS] + 2.0)) - np.log((n[0, :BUCKETS] + 1.0) / (n[0, BUCKETS] + 2.0)))


def _word_bin(weights):
    """The bin of a text's mean weight: quarters from -2 to 2; no word: the bin of 0."""
    seen: dict[int, int] = {}

    @F.arrow_udf("int")
    def bin_of(text: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([text], names=["text"]), "text", 1 << 20):
            each = part.column(0)
            owner, bucket = _words(each, seen)
            n = np.bincount(owner, minlength=len(each))
            total = np.bincount(owner, weights.value[bucket].astype(float), len(each))  # integers below 2 ** 53: exact
            out.append(np.clip(np.floor(total / np.maximum(n, 1) / 250_000.0) + 8, 0, 15).astype(np.int32))
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int32))

    return bin_of


def _with_bins(docs: DataFrame, weights=None) -> DataFrame:
    """``docs`` with its bins; that of the words where their ``weights`` are given."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = {f"__q_{k}": c for k, c in _bins(text).items()}
    if weights is not None:
        out["__q_word"] = _word_bin(weights)(text)
    out["__q_blank"] = F.trim(F.translate(text, "\t\n\r\f", "    ")) == ""
    out["__q_host"] = F.coalesce(F.col("source"), F.lit(_NONE))
    out["__q_path"] = F.coalesce(F.col("lang"), F.lit(_NONE))
    return docs.withColumns(out)


def _votes(labels: DataFrame) -> DataFrame:
    return (
        labels.select(F.col("doc_id").alias("__l_id"), F.col("quality").cast("int").alias("__l_q"))
        .where("__l_id IS NOT NULL AND __l_q IN (0, 1)")
        .groupBy("__l_id")
        .agg(F.min("__l_q").alias("__l_q"), F.max("__l_q").alias("__l_hi"))
        .where("__l_q = __l_hi")
    )


def _evidence(light: DataFrame, votes: DataFrame) -> DataFrame:
    """One row: an array of log likelihood ratios for each feature, and the prior."""
    bins = _used(light)
    known = light.join(votes, light["doc_id"] == votes["__l_id"])
    # Words are judged by documents that did not weigh them.
    odd = F.expr("pmod(__l_id, 2) = 1")
    counts = [F.count(F.when(F.col("__l_q") == q, 1)).alias(f"n{q}") for q in (1, 0)] + [F.count(F.when((F.col("__l_q") == q) & odd, 1)).alias(f"o{q}") for q in (1, 0)]
    for f, k in bins.items():
        for b in range(k):
            for q in (1, 0):
                counts.append(F.count(F.when((F.col(f"__q_{f}") == b) & (F.col("__l_q") == q) & (odd if f == "word" else F.lit(True)), 1)).alias(f"{f}_{b}_{q}"))
    one = known.where(~F.col("__q_blank")).agg(*counts)

    def llr(f: str, b: int) -> Column:
        n = "o" if f == "word" else "n"
        ratio = F.log((F.col(f"{f}_{b}_1") + 1.0) / (F.col(f"{n}1") + float(BINS[f]))) - F.log((F.col(f"{f}_{b}_0") + 1.0) / (F.col(f"{n}0") + float(BINS[f])))
        return F.when(F.col(f"{n}1") + F.col(f"{n}0") > 0, ratio).otherwise(F.lit(0.0))

    return one.select(
        *[F.array(*[llr(f, b) for b in range(k)]).alias(f"__e_{f}") for f, k in bins.items()],
        F.log((F.col("n1") + 1.0) / (F.col("n0") + 1.0)).alias("__e_prior"),
    )


def _used(df: DataFrame) -> dict[str, int]:
    return {f: k for f, k in BINS.items() if f"__q_{f}" in df.columns}


def _micro(c: Column) -> Column:
    """Soft counts in millionths: sums are exact in any order."""
    return F.floor(c * 1e6 + 0.5).cast("bigint")


def _scored(df: DataFrame, evidence: DataFrame) -> DataFrame:
    bins = _used(df)
    llr = sum((F.element_at(F.col(f"__e_{f}"), F.col(f"__q_{f}") + 1) for f in bins), F.lit(0.0))
    out = df.crossJoin(F.broadcast(evidence)).withColumn("__q_llr", llr)
    return out.withColumn("__q_p", _micro(1.0 / (1.0 + F.exp(-(F.col("__e_prior") + F.col("__q_llr")))))).drop(*[f"__e_{f}" for f in bins], "__e_prior")


def _strength(mu: Column, spread: Column, groups: Column, n: Column) -> Column:
    noise = mu * (1.0 - mu)
    return F.least(F.lit(STRENGTH[1]), F.greatest(F.lit(STRENGTH[0]), noise / F.greatest(spread - noise * groups / n, F.lit(1e-9)) - 1.0))


def _sites(scored: DataFrame) -> DataFrame:
    """Sums per path, its host's sums, and the global mean and strengths, on every row."""
    path = scored.where(~F.col("__q_blank")).groupBy("__q_host", "__q_path").agg(F.sum("__q_p").alias("__s_p"), F.count(F.lit(1)).alias("__n_p"))
    path = materialize(path, "op1-path")
    host = path.groupBy("__q_host").agg(F.sum("__s_p").alias("__s_h"), F.sum("__n_p").alias("__n_h"))
    whole = host.agg((F.sum("__s_h") / 1e6 / F.sum("__n_h")).alias("__mu"), F.sum("__n_h").cast("double").alias("__n"), F.count(F.lit(1)).cast("double").alias("__hosts"))
    d = F.col("__s_h") / 1e6 / F.col("__n_h") - F.col("__mu")
    h = host.crossJoin(F.broadcast(whole)).agg(
        F.first("__mu").alias("__mu"), F.first("__n").alias("__n"), _strength(F.first("__mu"), F.sum(F.col("__n_h") * d * d) / F.first("__n"), F.first("__hosts"), F.first("__n")).alias("__k_h")
    )
    both = path.join(host, "__q_host").crossJoin(F.broadcast(h))
    e = F.col("__s_p") / 1e6 / F.col("__n_p") - (F.col("__s_h") / 1e6 + F.col("__k_h") * F.col("__mu")) / (F.col("__n_h") + F.col("__k_h"))
    k = both.agg(_strength(F.first("__mu"), F.sum(F.col("__n_p") * e * e) / F.first("__n"), F.count(F.lit(1)).cast("double"), F.first("__n")).alias("__k_p"))
    return both.crossJoin(F.broadcast(k))


def _posterior(scored: DataFrame, sites: DataFrame) -> DataFrame:
    own = F.col("__q_p")
    host = ((F.col("__s_h") - own) / 1e6 + F.col("__k_h") * F.col("__mu")) / (F.col("__n_h") - 1 + F.col("__k_h"))
    prior = ((F.col("__s_p") - own) / 1e6 + F.col("__k_p") * F.col("__host")) / (F.col("__n_p") - 1 + F.col("__k_p"))
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("__prior")))
    post = 1.0 / (1.0 + F.exp(-(F.log(p / (1.0 - p)) + F.col("__q_llr"))))
    out = scored.join(small(sites), ["__q_host", "__q_path"], "left").withColumn("__host", host).withColumn("__prior", prior)
    return out.withColumn("__post", F.when(F.col("__q_blank"), 0.0).otherwise(post))


def _fit(docs: DataFrame, labels: DataFrame, words: bool, text: bool = False) -> tuple:
    """``docs`` with bins, written once (the text too if it is asked for) and scored; weights, evidence, sites."""
    votes = materialize(_votes(labels), "op1-votes")
    weights = docs.sparkSession.sparkContext.broadcast(_weights(docs, votes)) if words else None
    binned = _with_bins(docs, weights)
    binned = materialize(binned if text else binned.drop("text"), "op1-bins")
    evidence = materialize(_evidence(binned, votes), "op1-evidence")
    scored = _scored(binned, evidence)
    return scored, weights, evidence, materialize(_sites(scored), "op1-sites")


def classify(docs: DataFrame, labels: DataFrame, words: bool = True) -> DataFrame:
    """(doc_id, source, lang, evidence, site_prior, posterior, keep): one row a document."""
    scored, _, _, sites = _fit(docs.select("doc_id", "text", "source", "lang"), labels, words)
    r = lambda c: F.round(F.col(c) * 1e6) / 1e6
    return _posterior(scored, sites).select("doc_id", "source", "lang", r("__q_llr").alias("evidence"), r("__prior").alias("site_prior"), r("__post").alias("posterior"), (F.col("__post") >= THRESHOLD).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, words: bool = True) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns unchanged.

    The text is never shuffled: its statistics are computed once and written beside it, and
    that table is met with the broadcast site table. Rows with columns that Parquet has no
    type for are not written; their statistics are computed again in the scan.
    """
    inner, given = shielded(docs, "doc_id", "text", "source", "lang")
    if any(re.search(r"\b(void|interval)\b", t) for _, t in inner.dtypes):
        _, weights, evidence, sites = _fit(inner.select("doc_id", "text", "source", "lang"), labels, words)
        scored = _scored(_with_bins(inner, weights), evidence)
    else:
        scored, _, _, sites = _fit(inner, labels, words, text=True)
    return given(_posterior(scored, sites).where(F.col("__post") >= THRESHOLD))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def sql(docs: str = "documents", words: bool = True) -> str:
    """CTEs ending in ``op1_out`` (every document, with keep) over ``docs``."""
    names = [f for f in BINS if words or f != "word"]
    bins = " UNION ALL ".join(f"SELECT '{f}' AS f, {k} AS k, unnest(range({k})) AS b" for f, k in BINS.items() if f in names)
    lo, hi = STRENGTH
    join = " ".join(f"JOIN op1_ev e_{f} ON e_{f}.f = '{f}' AND e_{f}.b = d.{f}" for f in names)
    return rf"""
op1_t AS (SELECT *, coalesce(text, '') AS t0, length(coalesce(text, '')) AS n0, string_split(coalesce(text, ''), ' ') AS w0,
                 coalesce(source, chr(1)) AS host0, coalesce(lang, chr(1)) AS path0 FROM {docs}),
op1_v AS (SELECT doc_id AS vid, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
op1_tr AS (SELECT row_number() OVER () AS rid, * FROM op1_t),
op1_x AS (SELECT rid, doc_id, CAST('0x' || substr(md5(w), 1, 4) AS BIGINT) AS b FROM (SELECT rid, doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(t0, '[ \t\n\r\f]+'), lambda x: x <> ''))) AS w FROM op1_tr)),
op1_xv AS (SELECT DISTINCT rid, b, q FROM op1_x JOIN op1_v ON doc_id = vid WHERE ((vid % 2) + 2) % 2 = 0),
op1_xn AS (SELECT count(DISTINCT rid) FILTER (WHERE q = 1) AS n1, count(DISTINCT rid) FILTER (WHERE q = 0) AS n0 FROM op1_xv),
op1_xw AS (SELECT u.b, CAST(floor((ln((coalesce(c1, 0) + 1.0::DOUBLE) / (n1 + 2.0::DOUBLE)) - ln((coalesce(c0, 0) + 1.0::DOUBLE) / (n0 + 2.0::DOUBLE))) * 1e6 + 0.5) AS BIGINT) * CAST(n1 + n0 > 0 AS BIGINT) AS w
  FROM (SELECT DISTINCT b FROM op1_x) u LEFT JOIN (SELECT b, count(*) FILTER (WHERE q = 1) AS c1, count(*) FILTER (WHERE q = 0) AS c0 FROM op1_xv GROUP BY b) c ON u.b = c.b CROSS JOIN op1_xn),
op1_ws AS (SELECT rid, CAST(least(15, greatest(0, floor(CAST(sum(w) AS DOUBLE) / count(*) / 250000.0::DOUBLE) + 8)) AS INT) AS word FROM op1_x JOIN op1_xw USING (b) GROUP BY rid),
op1_d AS (SELECT op1_tr.*, trim(translate(t0, chr(9) || chr(10) || chr(13) || chr(12), '    ')) = '' AS blank0,
  least(15, CAST(floor(coalesce(length(regexp_replace(t0, '[\p{{L}}\p{{N}} \t\n\r\f]', '', 'g')) / CAST(nullif(n0, 0) AS DOUBLE), 0.0) * 50) AS INT)) AS sym,
  least(12, CAST(floor(coalesce(length(regexp_replace(t0, '[^\p{{Lu}}]', '', 'g')) / CAST(nullif(n0, 0) AS DOUBLE), 0.0) * 20) AS INT)) AS up,
  CAST(floor(len(list_distinct(w0)) / CAST(len(w0) AS DOUBLE) * 10) AS INT) AS dis,
  least(16, CAST(floor(log2(n0 + 1.0::DOUBLE) + 1e-9) AS INT)) AS len , coalesce(word, 8) AS word FROM op1_tr LEFT JOIN op1_ws USING (rid)),
op1_k AS (SELECT d.*, v.q FROM op1_d d JOIN op1_v v ON d.doc_id = v.vid WHERE NOT blank0),
op1_n AS (SELECT count(*) FILTER (WHERE q = 1) AS n1, count(*) FILTER (WHERE q = 0) AS n0 FROM op1_k),
op1_nf AS (SELECT false AS odd, n1 AS m1, n0 AS m0 FROM op1_n UNION ALL SELECT true, count(*) FILTER (WHERE q = 1), count(*) FILTER (WHERE q = 0) FROM op1_k WHERE ((doc_id % 2) + 2) % 2 = 1),
op1_c AS ({" UNION ALL ".join(f"SELECT '{f}' AS f, {f} AS b, count(*) FILTER (WHERE q = 1) AS c1, count(*) FILTER (WHERE q = 0) AS c0 FROM op1_k {"WHERE ((doc_id % 2) + 2) % 2 = 1" if f == "word" else ""} GROUP BY {f}" for f in names)}),
op1_b AS ({bins}),
op1_ev AS (SELECT b.f, b.b, CASE WHEN m1 + m0 = 0 THEN 0.0::DOUBLE ELSE ln((coalesce(c1, 0) + 1.0::DOUBLE) / (m1 + k)) - ln((coalesce(c0, 0) + 1.0::DOUBLE) / (m0 + k)) END AS w
  FROM op1_b b LEFT JOIN op1_c c ON b.f = c.f AND b.b = c.b JOIN op1_nf ON odd = (b.f = 'word')),
op1_s AS (SELECT d.*, 0.0::DOUBLE + {" + ".join(f"e_{f}.w" for f in names)} AS llr FROM op1_d d {join}),
op1_p AS (SELECT *, CAST(floor(1e6 * (1.0::DOUBLE / (1.0::DOUBLE + exp(-((SELECT ln((n1 + 1.0::DOUBLE) / (n0 + 1.0::DOUBLE)) FROM op1_n) + llr)))) + 0.5) AS BIGINT) AS p FROM op1_s),
op1_path AS (SELECT host0, path0, CAST(sum(p) AS BIGINT) AS s_p, count(*) AS n_p FROM op1_p WHERE NOT blank0 GROUP BY host0, path0),
op1_host AS (SELECT host0, CAST(sum(s_p) AS BIGINT) AS s_h, CAST(sum(n_p) AS BIGINT) AS n_h FROM op1_path GROUP BY host0),
op1_w AS (SELECT CAST(sum(s_h) AS DOUBLE) / 1e6 / sum(n_h) AS mu, CAST(sum(n_h) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS hosts FROM op1_host),
op1_h AS (SELECT min(mu) AS mu, min(n) AS n, least({hi}::DOUBLE, greatest({lo}::DOUBLE, min(mu) * (1.0 - min(mu)) / greatest(sum(n_h * power(s_h / 1e6 / n_h - mu, 2)) / min(n) - min(mu) * (1.0 - min(mu)) * min(hosts) / min(n), 1e-9::DOUBLE) - 1.0)) AS k_h FROM op1_host CROSS JOIN op1_w),
op1_both AS (SELECT p.*, h.s_h, h.n_h, g.* FROM op1_path p JOIN op1_host h USING (host0) CROSS JOIN op1_h g),
op1_kp AS (SELECT least({hi}::DOUBLE, greatest({lo}::DOUBLE, min(mu) * (1.0 - min(mu)) / greatest(sum(n_p * power(s_p / 1e6 / n_p - (s_h / 1e6 + k_h * mu) / (n_h + k_h), 2)) / min(n) - min(mu) * (1.0 - min(mu)) * count(*) / min(n), 1e-9::DOUBLE) - 1.0)) AS k_p FROM op1_both),
op1_prior AS (SELECT d.*, ((s_p - p) / 1e6 + k_p * (((s_h - p) / 1e6 + k_h * mu) / (n_h - 1 + k_h))) / (n_p - 1 + k_p) AS prior
  FROM op1_p d LEFT JOIN (SELECT * FROM op1_both CROSS JOIN op1_kp) b ON d.host0 = b.host0 AND d.path0 = b.path0),
op1_clip AS (SELECT *, least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, prior)) AS pc FROM op1_prior),
op1_out AS (SELECT *, CASE WHEN blank0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-(ln(pc / (1.0 - pc)) + llr))) END AS post FROM op1_clip)"""


ORACLE = f"""WITH {sql()}
SELECT doc_id, source, lang, round(llr, 6) AS evidence, round(prior, 6) AS site_prior, round(post, 6) AS posterior, post >= {THRESHOLD} AS keep FROM op1_out"""
