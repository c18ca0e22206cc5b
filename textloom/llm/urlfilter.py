"""URL filter: allow and block entries in one trie over reversed host labels and path segments.

An entry is host[/path]: it holds for the host, all hosts below it, and all paths below its path. The longest match
decides: more host labels first, then more path segments; of two entries for the same place block wins. An entry that is
null or blank, or has no host or an empty label, holds for nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many entries at most are broadcast as a trie (about 200 bytes each in a worker); beyond that they are joined.
TRIE_ENTRIES = 1_000_000
#: The entries of the registered query.
ENTRIES = [
    *((f"{name}.example.{top}", "block") for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")),
    ("spam-farm.example.org/about", "allow"), ("example.com/private", "block"), ("docs.example.com/private/shared", "allow"), ("example.net/es", "block"),
    ("blog.ththan.example.net/es", "allow"), ("m.ththth.example.net", "block"), ("m.ththth.example.net/en", "allow"),
]
_AUTHORITY = "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; "" if there is none."""
    authority = F.regexp_extract(url, _AUTHORITY, 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), "[.]?(?::[0-9]*)?$", ""))


def path_of(url: Column) -> Column:
    """The path as /segment/segment, empty segments left out; "" for the root."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _AUTHORITY + "([^?#]*)", 2), "/+", "/"), "/$", "")


def split_entry(entry: str | None) -> tuple[str, str] | None:
    """(host, path) of an entry, None if it holds for nothing. A scheme, user, port, query and fragment don't count."""
    authority, _, path = re.sub(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//", "", (entry or "").strip()).partition("/")
    authority = authority.split("?")[0].split("#")[0].rpartition("@")[2].partition(":")[0]
    host = authority.lower().strip(".")
    if not host or "" in host.split("."):
        return None
    return host, "".join(f"/{x}" for x in path.split("?")[0].split("#")[0].split("/") if x)


def normalised(entries: DataFrame) -> DataFrame:
    """(host, path, action) of entries (entry, action), each place once, block before allow: what both ways to match use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*place, action) for entry, action in zip(*(c.to_pylist() for c in batch.columns)) if action in ("allow", "block") and (place := split_entry(entry))]
            columns = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "path", "action"])

    text = entries.toDF("entry", "action").select(F.col("entry").cast("string"), F.col("action").cast("string"))
    return text.mapInArrow(run, "host string, path string, action string").groupBy("host", "path").agg(F.max("action").alias("action"))


def build(rules: Iterable[tuple[str, str, str]]) -> dict:
    """The trie of rules (host, path, action): a node's children by label or "/" + segment, its entry and action at ""."""
    root: dict = {}
    for host, path, action in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        for segment in path.split("/")[1:]:
            node = node.setdefault("/" + segment, {})
        node[""] = (host + path, action)
    return root


def lookup(root: dict, host: str, path: str) -> tuple[str | None, str]:
    """(entry, action) of the longest match; (None, "none") without one."""
    nodes, node = [root], root
    for label in reversed(host.split(".")) if host else ():
        node = node.get(label)
        if node is None:
            break
        nodes.append(node)
    segments = path.split("/")[1:]
    for node in reversed(nodes):
        best = node.get("")
        for segment in segments:
            node = node.get("/" + segment)
            if node is None:
                break
            best = node.get("", best)
        if best:
            return best
    return None, "none"


def _match(entries):
    trie: list[dict] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not trie:
            trie.append(build(entries.value))
        for batch in batches:
            found = [lookup(trie[0], h, p) if h else (None, "none") for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rule, action = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rule, pa.string()), pa.array(action, pa.string())], ["page_id", "host", "entry", "action"])

    return run


def by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same decisions for any number of rules (host, path, action): every host suffix and path prefix of a URL is
    looked up by a join."""
    parts = urls.withColumn("row", F.monotonically_increasing_id())
    label, segment = F.split("host", "[.]"), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(label)), lambda i: F.array_join(F.slice(label, i, F.size(label)), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segment)), lambda i: F.array_join(F.slice(segment, F.lit(1), i), "/"))
    keyed = parts.where("host <> ''").select("row", F.explode(suffixes).alias("host"), prefixes.alias("prefixes")).select("row", "host", F.explode("prefixes").alias("path"))
    rank = F.struct(F.size(F.split("host", "[.]")).alias("labels"), F.size(F.split("path", "/")).alias("segments"), F.concat("host", "path").alias("entry"), "action")
    best = keyed.join(rules, ["host", "path"]).groupBy("row").agg(F.max(rank).alias("best"))
    return parts.join(best, "row", "left").select("page_id", "host", F.col("best.entry").alias("entry"), F.coalesce("best.action", F.lit("none")).alias("action"))


def decide(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, entry, action, kept): every row's host, longest matching entry, its action and whether the row stays.

    Only a block match removes; without a match the action is "none". A null URL, or one without a host, matches nothing
    and has host "". Entries (entry, action) may be null, repeat or be none; actions other than allow and block count for
    nothing. Rows that repeat are judged alike; very long URLs and entries are matched whole. Ids keep their type. The
    table may be empty and have any further columns. Up to TRIE_ENTRIES rules are broadcast, more are joined, alike.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    slim = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    places = normalised(entries)
    rules = [tuple(r) for r in places.limit(TRIE_ENTRIES + 1).collect()]
    if len(rules) <= TRIE_ENTRIES:
        kind = dict(slim.dtypes)["page_id"]
        out = slim.mapInArrow(_match(pages.sparkSession.sparkContext.broadcast(rules)), f"page_id {kind}, host string, entry string, action string")
    else:
        out = by_join(slim, places)
    return out.withColumn("kept", F.col("action") != "block")


def default_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, "entry string, action string")


def _oracle() -> str:
    rows = ", ".join("('{}', '{}', '{}', {}, {})".format(h, p, a, len(h.split(".")), p.count("/")) for (e, a) in ENTRIES for h, p in [split_entry(e)])
    return f"""
WITH u AS (
  SELECT page_id, lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '{_AUTHORITY}', 1), '^.*@', ''), '[.]?(?::[0-9]*)?$', '')) AS host,
         regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '{_AUTHORITY}([^?#]*)', 2), '/+', '/', 'g'), '/$', '') AS path
  FROM pages
), r(rhost, rpath, action, labels, segments) AS (VALUES {rows}), m AS (
  SELECT u.page_id, u.host, u.path, max({{'labels': labels, 'segments': segments, 'entry': rhost || rpath, 'action': action}}) AS best
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND (rpath = '' OR path = rpath OR starts_with(path, rpath || '/'))
  GROUP BY ALL
)
SELECT u.page_id, u.host, m.best.entry AS entry, coalesce(m.best.action, 'none') AS action, coalesce(m.best.action, 'none') <> 'block' AS kept
FROM u JOIN m ON m.page_id = u.page_id AND m.host = u.host AND m.path = u.path
"""


ORACLE = _oracle()
