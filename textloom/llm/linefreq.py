"""Quality rule on line frequency: lines that too many documents of a host share go, depleted documents with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, if_small, written

#: So many frequent lines at most are broadcast, at eight bytes each; beyond that they are joined.
BROADCAST_LINES = 4_000_000


def normalised(line: Column) -> Column:
    """Digits become 0, runs of white space one space, ends are trimmed, case is lowered."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), "[ \\t\\r\\f]+", " "))


def _hashes(text: Column, host: Column) -> Column:
    """The hash of each line of text together with its host; lines that are empty when normalised have none."""
    return F.transform(F.split(text, "\n"), lambda x: F.nullif(F.xxhash64(host, normalised(x)), F.xxhash64(host, F.lit(""))))


def frequent_lines(docs: DataFrame, host_col: str, text_col: str, most_docs: int, share: float, share_from: int) -> DataFrame:
    """(line, n): hashes of the lines in more than most_docs documents of a host, or in more than share of them and in
    share_from at least."""
    host, text = F.coalesce(F.col(host_col).cast("string"), F.lit("")), F.col(text_col).cast("string")
    each = docs.select(host.alias("host"), F.array_distinct(_hashes(text, host)).alias("lines"))
    hosts = docs.groupBy(host.alias("host")).count().withColumnRenamed("count", "docs")
    lines = each.select("host", F.explode("lines").alias("line")).where("line is not null").groupBy("host", "line").agg(F.count("*").alias("n"))
    lines = lines.where((F.col("n") > most_docs) | (F.col("n") >= share_from))
    many = (F.col("n") > most_docs) | ((F.col("n") >= share_from) & (F.col("n") > share * F.col("docs")))
    return lines.join(F.broadcast(hosts) if hosts.limit(200_001).count() <= 200_000 else hosts, "host").where(many).select("line", "n")


def _clean(frequent, kept: list[int], text_at: int, least_words: int, least_share: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = np.frombuffer(frequent.value, np.int64)
        for batch in batches:
            texts, lists = batch.column(text_at), batch.column(batch.num_columns - 1)
            flat = lists.flatten()
            at = np.searchsorted(bad, values := flat.fill_null(0).to_numpy())
            hit = (at < len(bad)) & flat.is_valid().to_numpy(zero_copy_only=False)
            hit[hit] = bad[at[hit]] == values[hit]
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            ends = np.cumsum(sizes)
            first = np.r_[0, ends]
            total = np.r_[0, np.cumsum(hit)]
            removed = total[ends] - total[first[:-1]]
            seen = np.r_[0, np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False))]
            stay = seen[ends] > seen[first[:-1]]
            changed = np.flatnonzero(removed)
            fresh = []
            for i, text in zip(changed, texts.take(pa.array(changed)).to_pylist()):
                before = len(text.split())
                text = "\n".join(x for x, drop in zip(text.split("\n"), hit[first[i] : ends[i]]) if not drop)
                after = len(text.split())
                stay[i] = after >= least_words and after >= least_share * before
                fresh.append(text)
            if fresh:
                texts = pa.compute.replace_with_mask(texts, pa.array(removed > 0), pa.array(fresh, texts.type))
            at = pa.array(np.flatnonzero(stay))
            columns = [(texts if i == text_at else batch.column(i)).take(at) for i in kept]
            lines, gone = sizes[stay], removed[stay]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int32()), pa.array(gone, pa.int32())], names)

    return run


def remove_frequent(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep: list[str] | None = None, *, most_docs: int = 20, share: float = 0.005, share_from: int = 5, least_words: int = 5, least_share: float = 0.3) -> DataFrame:
    """docs' columns keep (all by default) with the text's frequent lines removed, then n_lines and n_removed.

    A line goes from a document if, once normalised, more than most_docs documents of the host have it, whatever the size
    of the host, or share_from and more than share of all the host's documents. A document goes if a line went and fewer
    than least_words words or less than least_share of its words are left, or if it has nothing but white space to begin
    with.
    A null text has no lines and goes; a null host is the host "". Lines that repeat within a document count once; rows
    that repeat count each, as documents. Empty lines are neither counted nor removed. Ties don't arise: a line at a
    limit stays. A very long text is taken whole. The table may be empty; where keep has n_lines or n_removed, the new
    columns take underscores before their names until they are unique.
    """
    spark = docs.sparkSession
    bounded(spark)
    keep = keep or docs.columns
    bad = written(frequent_lines(docs, host_col, text_col, most_docs, share, share_from), "lines")
    n = bad.count()
    host, text = F.coalesce(F.col(host_col).cast("string"), F.lit("")), F.col(text_col).cast("string")
    names = list(dict.fromkeys([*keep, text_col]))
    slim = docs.select(*((text if c == text_col else F.col(c)).alias(f"c{i}") for i, c in enumerate(names)), _hashes(text, host).alias("lines"))
    text_at, kept = names.index(text_col), [names.index(c) for c in keep]
    schema = T.StructType([*(T.StructField(f"k{i}", slim.schema[at].dataType) for i, at in enumerate(kept)), T.StructField("n_lines", T.IntegerType()), T.StructField("n_removed", T.IntegerType())])
    fields = [f.name for f in schema.fields]
    if n > BROADCAST_LINES:  # mark the lines by a join, then let the same code remove those marked
        numbered = slim.withColumn("row", F.monotonically_increasing_id())
        numbered = written(numbered, "numbered")
        marked = numbered.select("row", F.explode("lines").alias("line")).join(bad, "line", "left_semi").groupBy("row").agg(F.collect_set("line").alias("hits"))
        joined = numbered.join(if_small(marked, marked.count()), "row", "left")
        hit = F.coalesce("hits", F.array().cast("array<long>"))
        slim = joined.select(*(c for c in slim.columns if c != "lines"), F.transform("lines", lambda x: F.when(x.isNotNull(), F.array_contains(hit, x).cast("long"))).alias("lines"))
        values = np.ones(1, np.int64)
    else:
        values = np.sort(bad.select("line").distinct().toPandas()["line"].to_numpy(np.int64))
    frequent = spark.sparkContext.broadcast(values.tobytes())
    out = slim.mapInArrow(_clean(frequent, kept, text_at, least_words, least_share, fields), schema)
    fresh = []
    for name in ("n_lines", "n_removed"):
        while name.lower() in {c.lower() for c in keep}:
            name = f"_{name}"
        fresh.append(name)
    return out.toDF(*keep, *fresh)


ORACLE = r"""
WITH line AS (
  SELECT doc_id, host, pos, l, n_lines, trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '[ \t\r\f]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(text, chr(10))) AS l, len(string_split(text, chr(10))) AS n_lines,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents)
), frequent AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc_id) AS n FROM line WHERE norm <> '' GROUP BY host, norm) x
  JOIN (SELECT coalesce(source, '') AS host, count(*) AS docs FROM documents GROUP BY 1) h USING (host)
  WHERE n > 20 OR (n >= 5 AND n > 0.005 * docs)
), marked AS (
  SELECT line.*, f.norm IS NOT NULL AS gone FROM line LEFT JOIN frequent f ON f.host = line.host AND f.norm = line.norm
), doc AS (
  SELECT doc_id, any_value(n_lines) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
         sum(len(regexp_extract_all(l, '\S+'))) AS before, coalesce(sum(len(regexp_extract_all(l, '\S+'))) FILTER (NOT gone), 0) AS after
  FROM marked GROUP BY doc_id
)
SELECT doc_id, text, CAST(n_lines AS INT) AS n_lines, CAST(n_removed AS INT) AS n_removed FROM doc
WHERE CASE WHEN n_removed > 0 THEN after >= 5 AND after >= 0.3 * before ELSE before > 0 END
"""
