"""Packing by optimal length buckets.

Texts are cut into pieces of at most ``max_length`` tokens. Bucket boundaries are those lengths that minimise the
padding over all pieces: dynamic programming over the global histogram of piece lengths, which has at most
``max_length`` rows. A batch holds pieces of one bucket, as many as the token budget allows at the bucket's length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.functions.storage import materialize

MAX_LENGTH = 2048
BUCKETS = 8
TOKEN_BUDGET = 65_536
#: Pieces of a bucket are numbered inside ranges of this many first digits of their hash.
HASH_DIGITS = 3


def word_length(text: str = "text") -> Column:
    """Words of a text and one end token; a null text is an empty one."""
    return (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")) + 1).cast("long")


def boundaries(lengths, counts, buckets: int = BUCKETS) -> list[int]:
    """The at most ``buckets`` lengths to pad to, in order, with the least padding in total; ties take the shortest."""
    order = np.argsort(lengths)
    length = np.asarray(lengths, np.int64)[order]
    count = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64)[order])))
    total = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64)[order] * length)))
    n = len(length)
    if not n:
        return []
    # padding[i, j]: lengths i .. j-1 padded to the last of them
    padding = np.full((n + 1, n + 1), np.iinfo(np.int64).max // 4)
    for j in range(1, n + 1):
        padding[:j, j] = length[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])
    best = padding[0].copy()
    choices = []
    for _ in range(1, min(buckets, n)):
        through = best[:, None] + padding
        through[0] = np.iinfo(np.int64).max // 2
        choice = through.argmin(axis=0)
        best = np.minimum(through[choice, np.arange(n + 1)], np.iinfo(np.int64).max // 4)
        choices.append(choice)
    ends, j = [n], n
    for choice in reversed(choices):
        j = int(choice[j])
        ends.append(j)
    return [int(length[e - 1]) for e in reversed(ends)]


def pieces(docs: DataFrame, length: Column, id_col: str = "doc_id", max_length: int = MAX_LENGTH) -> DataFrame:
    """(id, piece, first_token, n_tokens): every text's runs of at most ``max_length`` tokens."""
    size = F.col("size")
    cut = docs.select(F.col(id_col).alias("id"), length.alias("size")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / max_length)))
    )
    first = F.col("piece") * max_length
    return cut.select("id", "piece", first.alias("first_token"), F.least(F.lit(max_length), size - first).alias("n_tokens"))


def pack(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", max_length: int = MAX_LENGTH,
         buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """(id, piece, first_token, n_tokens, bucket, bucket_length, batch, slot) for every piece of every row.

    ``length`` is a column of ``docs`` of at least one (default: words and one end token). The order in a bucket is
    the md5 of id and piece, so batches mix texts of all lengths and sources. Batches run from 0 without gaps in each
    bucket and only a bucket's last one is not full. Null ids are packed like others; rows that agree in id and
    length are interchangeable; an empty table gives no rows.
    """
    rows = materialize(pieces(docs, word_length() if length is None else length, id_col, max_length), "pieces")
    histogram = rows.groupBy("n_tokens").count().collect()
    ends = boundaries([r["n_tokens"] for r in histogram], [r["count"] for r in histogram], buckets)
    n, bucket, to = F.col("n_tokens"), F.lit(0), F.lit(ends[0] if ends else 1)
    for k, end in enumerate(ends[1:], 1):
        bucket, to = F.when(n > ends[k - 1], k).otherwise(bucket), F.when(n > ends[k - 1], end).otherwise(to)
    mark = F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("piece").cast("string")))
    placed = rows.select("*", bucket.alias("bucket"), to.cast("long").alias("bucket_length"), mark.alias("mark"))
    placed = placed.withColumn("range", F.substring("mark", 1, HASH_DIGITS))
    before = Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("bucket", "range").agg(F.count("*").alias("n")).select(
        "bucket", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("bucket", "range").orderBy("mark", "id", "piece", "n_tokens")
    rank = F.col("base") + F.col("rank") - 1
    capacity = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_length")))
    return (
        placed.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(ranges), ["bucket", "range"])
        .select("id", "piece", "first_token", "n_tokens", "bucket", "bucket_length",
                F.floor(rank / capacity).alias("batch"), (rank % capacity).alias("slot"))
    )


ORACLE = f"""
WITH RECURSIVE pieces AS (
  SELECT doc_id, piece, piece * {MAX_LENGTH} AS first_token, least({MAX_LENGTH}, n - piece * {MAX_LENGTH}) AS n_tokens
  FROM (SELECT doc_id, n, unnest(range(0, (n + {MAX_LENGTH - 1}) // {MAX_LENGTH})) AS piece
        FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS n FROM documents))
), histogram AS (
  SELECT row_number() OVER (ORDER BY n_tokens) AS j, n_tokens AS l, sum(count(*)) OVER (ORDER BY n_tokens) AS c,
         sum(count(*) * n_tokens) OVER (ORDER BY n_tokens) AS s
  FROM pieces GROUP BY n_tokens
), ends AS (SELECT j, l, c, s FROM histogram UNION ALL SELECT 0, 0, 0, 0),
best AS (
  SELECT 0 AS k, CAST(0 AS BIGINT) AS j, CAST(0 AS HUGEINT) AS cost, CAST([] AS BIGINT[]) AS path
  UNION ALL
  SELECT any_value(b.k) + 1, e.j, min(b.cost + e.l * (e.c - i.c) - (e.s - i.s)),
         list_append(arg_min(b.path, (b.cost + e.l * (e.c - i.c) - (e.s - i.s), b.j)), any_value(e.l))
  FROM best b JOIN ends i ON i.j = b.j JOIN ends e ON e.j > b.j
  WHERE b.k < {BUCKETS} GROUP BY e.j
), cuts AS (
  SELECT path FROM best WHERE j = (SELECT max(j) FROM ends) ORDER BY k DESC LIMIT 1
), placed AS (
  SELECT p.*, len(list_filter(path, lambda x: x < n_tokens)) AS bucket, path[len(list_filter(path, lambda x: x < n_tokens)) + 1] AS bucket_length
  FROM pieces p, cuts
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(concat(doc_id, ':', piece)), doc_id, piece) - 1 AS place,
         greatest(1, {TOKEN_BUDGET} // bucket_length) AS capacity FROM placed
)
SELECT doc_id, piece, CAST(first_token AS BIGINT) AS first_token, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(bucket AS INTEGER) AS bucket,
  CAST(bucket_length AS BIGINT) AS bucket_length, CAST(place // capacity AS BIGINT) AS batch, CAST(place % capacity AS BIGINT) AS slot
FROM ranked
"""
