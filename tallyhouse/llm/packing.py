"""Packing documents into token-budget batches inside optimal length buckets.

Lengths are counted into one global histogram with a bin for each length.  Dynamic
programming over it chooses the ``buckets`` boundaries that minimise padding when each
document is padded to its bucket's boundary.  The optimum is exact: a length's best
earlier boundary never falls as the length grows, so each bucket takes n log n steps for
n different lengths.  The histogram is what the driver gets; n different lengths need at
least n * n / 2 tokens, so a corpus of T tokens has at most sqrt(2 T) bins.

Inside a bucket documents are dealt to shards by a hash of doc_id and length; a running
count over the small (bucket, shard) table numbers them through, so every batch
but the last of its bucket is full and no task gets a whole bucket.

Defined results: a document has one token more than words (its end); a null text
is empty; documents longer than the budget get batches of their own; repeated
rows each take a slot; a null doc_id counts as an empty one; an empty table gives no
rows; other columns pass ``pack`` unchanged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import stored, words_of

BUCKETS, BUDGET, SHARD_ROWS = 8, 16_384, 20_000


def n_tokens(text: Column) -> Column:
    return (F.size(words_of(text)) + 1).cast("long")


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, documents of each), in order."""
    found = lengths.groupBy("n_tokens").agg(F.count("*").alias("docs")).orderBy("n_tokens").toArrow()
    return found.column("n_tokens").to_numpy(), found.column("docs").to_numpy()


def _step(best: np.ndarray, length: np.ndarray, docs: np.ndarray, tokens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least padding with k + 1 buckets for lengths 0..j, and where the bucket before the last ends.

    ``docs`` and ``tokens`` are running sums.  The lowest of equally good ends is taken; as ends
    never fall from one j to the next, the middle j of a range halves the ends left to try.
    """
    n = len(length)
    now, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low, high, first, last = (np.array([x]) for x in (k, n - 1, k - 1, n - 2))
    while len(low):
        middle = (low + high) // 2
        many = np.minimum(last, middle - 1) - first + 1
        begin = np.cumsum(many) - many
        i = np.arange(many.sum()) + np.repeat(first - begin, many)
        j = np.repeat(middle, many)
        cost = best[i] + length[j] * (docs[j] - docs[i]) - (tokens[j] - tokens[i])
        least = np.minimum.reduceat(cost, begin)
        end = np.minimum.reduceat(np.where(cost == np.repeat(least, many), i, n), begin)
        now[middle], back[middle] = least, end
        low, high, first, last = np.concatenate([low, middle + 1]), np.concatenate([middle - 1, high]), np.concatenate([first, end]), np.concatenate([end, last])
        there = low <= high
        low, high, first, last = low[there], high[there], first[there], last[there]
    return now, back


def best_boundaries(lengths: np.ndarray, docs: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Boundaries of at most ``buckets`` buckets with the least padding, and that padding."""
    if not len(lengths):
        return [], 0
    length, count = np.asarray(lengths, np.int64), np.asarray(docs, np.int64)
    d, t = np.cumsum(count), np.cumsum(count * length)
    best = length * d - t  # with one bucket for lengths 0..j
    came: list[np.ndarray] = []
    for k in range(1, min(buckets, len(length))):
        best, back = _step(best, length, d, t, k)
        came.append(back)
    at = len(length) - 1
    ends = [at]
    for back in reversed(came):
        at = int(back[at])
        ends.append(at)
    return [int(length[e]) for e in reversed(ends)], int(best[-1])


def _by_bucket(values: list[int], bounds: list[int]) -> Column:
    n = F.col("n_tokens")
    out = F.lit(values[-1])
    for bound, value in reversed(list(zip(bounds[:-1], values[:-1], strict=True))):
        out = F.when(n <= bound, value).otherwise(out)
    return out


def shard_of(doc_id: Column, n: Column, shards: int) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), n.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % shards


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS, carry: bool = True) -> DataFrame:
    """``docs`` (only doc_id without ``carry``) with n_tokens, bucket, padded_tokens, batch and slot
    in place of columns of these names.

    A batch is the documents of one bucket with the same ``batch``; batch times padded length is at most the budget.
    """
    measured = docs.select(F.struct("*").alias("row"), "doc_id", n_tokens(F.col("text")).alias("n_tokens")) if carry else docs.select("doc_id", n_tokens(F.col("text")).alias("n_tokens"))
    lengths = stored(measured.select("doc_id", "n_tokens"), "packing-lengths")
    bins = histogram(lengths)
    bounds = best_boundaries(*bins, buckets)[0] or [1]
    shards = max(1, -(-int(bins[1].sum()) // shard_rows))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", _by_bucket(list(range(len(bounds))), bounds)).withColumn("shard", shard_of(F.col("doc_id"), F.col("n_tokens"), shards))

    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed(lengths).groupBy("bucket", "shard").agg(F.count("*").alias("n")).select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "shard").orderBy("n_tokens", "doc_id")
    ranked = placed(measured if carry else lengths).withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["bucket", "shard"])
    padded = _by_bucket(bounds, bounds).cast("long")
    size = _by_bucket([max(1, budget // b) for b in bounds], bounds)
    place = F.col("rank") + F.col("offset")
    made = {"n_tokens", "bucket", "padded_tokens", "batch", "slot"}
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in made] if carry else ["doc_id"]
    return ranked.select(*own, "n_tokens", F.col("bucket").cast("int").alias("bucket"), padded.alias("padded_tokens"), F.floor(place / size).alias("batch"), (place % size).cast("int").alias("slot"))


def packing_sql(buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> str:
    """The same in DuckDB SQL: one step of the dynamic programme for each bucket."""
    sql = [
        r"""
WITH lengths AS MATERIALIZED (
  SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) + 1 AS n_tokens FROM documents),
bins AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY n_tokens) AS j, n_tokens AS longest, count(*) AS docs, sum(n_tokens) AS tokens FROM lengths GROUP BY n_tokens),
sums AS MATERIALIZED (
  SELECT j, longest, CAST(sum(docs) OVER (ORDER BY j) AS BIGINT) AS d, CAST(sum(tokens) OVER (ORDER BY j) AS BIGINT) AS t FROM bins),
f1 AS MATERIALIZED (SELECT j, longest * d - t AS cost, CAST(0 AS BIGINT) AS i FROM sums)"""
    ]
    for k in range(2, buckets + 1):
        sql.append(f"""f{k} AS MATERIALIZED (
  SELECT j, best.cost AS cost, best.i AS i FROM (
    SELECT b.j, min({{'cost': f.cost + b.longest * (b.d - a.d) - (b.t - a.t), 'i': f.j}}) AS best
    FROM sums b JOIN f{k - 1} f ON f.j < b.j AND f.j >= {k - 1} JOIN sums a ON a.j = f.j GROUP BY b.j))""")
    sql.append(f"e{buckets} AS (SELECT max(j) AS j FROM sums)")
    for k in range(buckets, 1, -1):
        sql.append(f"e{k - 1} AS (SELECT f.i AS j FROM e{k} e JOIN f{k} f ON f.j = e.j)")
    ends = " UNION ALL ".join(f"SELECT {k - 1} AS bucket, j FROM e{k}" for k in range(1, buckets + 1))
    sql.append(f"""bounds AS MATERIALIZED (SELECT bucket, longest AS bound, greatest(1, {budget} // longest) AS size FROM ({ends}) e JOIN sums USING (j)),
total AS (SELECT greatest(1, CAST(ceil(count(*) / {shard_rows}) AS BIGINT)) AS shards FROM lengths),
placed AS (
  SELECT doc_id, n_tokens, (SELECT min(bucket) FROM bounds WHERE n_tokens <= bound) AS bucket,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || n_tokens), 1, 8) AS BIGINT) % shards AS shard FROM lengths, total),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY shard, n_tokens, doc_id) - 1 AS place FROM placed)
SELECT doc_id, n_tokens, CAST(bucket AS INTEGER) AS bucket, bound AS padded_tokens, CAST(place // size AS BIGINT) AS batch, CAST(place % size AS INTEGER) AS slot
FROM ranked JOIN bounds USING (bucket)""")
    return ",\n".join(sql)
