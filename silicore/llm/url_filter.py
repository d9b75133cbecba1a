"""URL filter: allow and block entries in a trie over reversed host labels and path segments.

An entry is ``host[/path]``: it covers the host, its subdomains, and paths that begin
with its segments (whole segments). A URL's key is its host labels from the
top-level domain inwards, then its path segments; the entry that lies deepest on the
walk decides. A path entry covers subdomains too, so after the labels that it names any
further labels may come before its path: the walk therefore visits the path below
every label node, and depth counts labels first, then segments.

Defined results
  * a URL that no entry covers: ``none``, kept;
  * the same entry in both lists: block wins; repeated entries count once;
  * scheme, user info, port, query, fragment, a trailing dot and empty segments are
    ignored; host and scheme are compared in lower case, paths as they are;
  * null, empty or host-less URLs: action ``invalid``, not kept;
  * null entries and entries without a host are ignored;
  * repeated rows are each judged; an empty table gives an empty result; extra columns
    are ignored.

The entries are broadcast as a trie while there are at most ``TRIE_ENTRIES``. Beyond that the
trie is partitioned below its first two labels: URLs and entries go to the partition of
their first two labels, where the same walk goes over that part of the trie. Entries of one
label, of which there are no more than top-level domains, are in every part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits, table
from .url_rules import ALLOW, BLOCK

TRIE_ENTRIES = 2_000_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host labels from the top-level domain inwards, and path segments."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/]*)", 1), r"^.*@", ""), r"(:\d*)?$", ""))
    host = F.regexp_replace(host, r"\.+$", "")
    path = F.regexp_extract(rest, r"^[^/]*(.*)$", 1)
    some = lambda a: F.filter(a, lambda x: x != "")
    return F.reverse(some(F.split(host, r"\."))), some(F.split(path, "/"))


def entries(spark: SparkSession, allow: Iterable[str | None], block: Iterable[str | None]) -> DataFrame:
    """(labels, segments, action): one row a distinct entry, block before allow."""
    rows = [(e, "allow") for e in allow if e] + [(e, "block") for e in block if e]
    df = spark.createDataFrame(rows, "entry string, action string")
    labels, segments = parts(F.col("entry"))
    return df.select(labels.alias("labels"), segments.alias("segments"), "action").where("size(labels) > 0").groupBy("labels", "segments").agg(F.max("action").alias("action"))


def build_trie(rows: list) -> dict:
    """Nested dicts: label -> node; a node's "/" leads to its segment nodes, its "" holds the decision."""
    root: dict = {}
    for labels, segments, action in rows:
        add(root, labels, segments, action)
    return root


def add(root: dict, labels: list[str], segments: list[str], action: str) -> None:
    node = root
    for x in labels:
        node = node.setdefault("." + x, {})
    for x in segments:
        node = node.setdefault("/" + x, {})
    node[""] = (action, ".".join(reversed(labels)) + "".join("/" + s for s in segments))


def walk(trie: dict, labels: Iterable[str], segments: list[str]) -> tuple[str, str] | None:
    found, node = None, trie
    for x in labels:
        node = node.get("." + x)
        if node is None:
            break
        found = node.get("", found)
        below = node
        for s in segments:
            below = below.get("/" + s)
            if below is None:
                break
            found = below.get("", found)
    return found


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", trie_entries: int = TRIE_ENTRIES) -> DataFrame:
    """(key, url, action, entry, keep), one row a page."""
    labels, segments = parts(F.coalesce(F.col(url), F.lit("")))
    src = pages.select(F.col(key), F.col(url).alias("url"), labels.alias("__u_l"), segments.alias("__u_s"))
    out = (_whole if fits(rules, trie_entries) else _parted)(src, rules)
    bad = F.size("__u_l") == 0
    action = F.when(bad, "invalid").otherwise(F.coalesce(F.col("__u_hit")["action"], F.lit("none")))
    return out.select(key, "url", action.alias("action"), F.when(~bad, F.col("__u_hit")["entry"]).alias("entry"), action.isin("allow", "none").alias("keep"))


def _whole(src: DataFrame, rules: DataFrame) -> DataFrame:
    sc = src.sparkSession.sparkContext
    shared = sc.broadcast(build_trie([tuple(r) for r in rules.collect()]))

    @F.pandas_udf("struct<action string, entry string>")
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for labels, segments in batches:
            hits = [walk(trie, a, list(b)) or (None, None) for a, b in zip(labels, segments)]
            yield pd.DataFrame(hits, columns=["action", "entry"])

    return src.withColumn("__u_hit", look("__u_l", "__u_s"))


def _parted(src: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs and entries meet by their first two labels; a part's trie is built from its entries."""
    sc = src.sparkSession.sparkContext
    shared = sc.broadcast([tuple(r) for r in rules.where("size(labels) = 1").collect()])
    part = lambda c: F.concat_ws(".", F.slice(c, 1, 2))
    key, kind = src.columns[0], src.schema[0].dataType.simpleString()
    asked = src.select(part("__u_l").alias("__u_p"), F.lit(1).alias("__u_k"), F.col(key).alias("__u_id"), F.col("url").alias("__u_url"), "__u_l", "__u_s", F.lit(None).cast("string").alias("__u_a"))
    known = rules.where("size(labels) > 1").select(part("labels").alias("__u_p"), F.lit(0).alias("__u_k"), F.lit(None).cast(kind).alias("__u_id"), F.lit(None).cast("string").alias("__u_url"), F.col("labels").alias("__u_l"), F.col("segments").alias("__u_s"), F.col("action").alias("__u_a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie, found = None, {}, []
        for batch in batches:
            rows, found = [batch.column(i).to_pylist() for i in (0, 1, 4, 5, 6)], []
            for i, (p, k, labels, segments, action) in enumerate(zip(*rows)):
                if p != now:
                    now, trie = p, build_trie(shared.value)
                if k == 0:
                    add(trie, labels, segments, action)
                else:
                    found.append((i, *(walk(trie, labels, segments) or (None, None))))
            at = pa.array([x[0] for x in found], pa.int64())
            hit = pa.StructArray.from_arrays([pa.array([x[j] for x in found], pa.string()) for j in (1, 2)], ["action", "entry"])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in (2, 3, 4)), hit], names=[key, "url", "__u_l", "__u_hit"])

    rows = asked.unionByName(known).repartition("__u_p").sortWithinPartitions("__u_p", "__u_k")
    return rows.mapInArrow(run, f"`{key}` {kind}, url string, __u_l array<string>, __u_hit struct<action: string, entry: string>")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), entries(spark, ALLOW, BLOCK))


def _values() -> str:
    rows = [(e, "allow") for e in ALLOW] + [(e, "block") for e in BLOCK]
    return ", ".join(f"('{e.partition('/')[0]}', '{e.partition('/')[2]}', '{a}')" for e, a in rows)


ORACLE = rf"""
WITH r AS (SELECT host, path, max(action) AS action FROM (VALUES {_values()}) v(host, path, action) GROUP BY host, path),
u0 AS (SELECT row_number() OVER () AS rid, page_id, url, regexp_replace(regexp_replace(trim(coalesce(url, '')), '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.\-]*:)?//', '') AS rest FROM pages),
u AS (SELECT rid, page_id, url, regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(rest, '^([^/]*)', 1), '^.*@', ''), '(:\d*)?$', '')), '\.+$', '') AS host,
   list_filter(string_split(regexp_extract(rest, '^[^/]*(.*)$', 1), '/'), lambda x: x <> '') AS segs FROM u0),
m AS (SELECT rid, r.*, len(string_split(r.host, '.')) AS n, CASE WHEN r.path = '' THEN 0 ELSE len(string_split(r.path, '/')) END AS k
  FROM u JOIN r ON (u.host = r.host OR u.host LIKE '%.' || r.host) AND (r.path = '' OR list_slice(u.segs, 1, len(string_split(r.path, '/'))) = string_split(r.path, '/'))),
b AS (SELECT rid, arg_max(action, n * 1000 + k) AS action, arg_max(CASE WHEN path = '' THEN host ELSE host || '/' || path END, n * 1000 + k) AS entry FROM m GROUP BY rid)
SELECT page_id, url, CASE WHEN host = '' THEN 'invalid' ELSE coalesce(action, 'none') END AS action, entry,
  host <> '' AND coalesce(action, 'none') IN ('allow', 'none') AS keep FROM u LEFT JOIN b USING (rid)"""
