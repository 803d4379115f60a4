"""Packing by optimal length buckets.

The lengths of all rows that a batch can hold make one exact histogram: a bin for each length up to the
budget, so its size is bounded by the budget, not by the input. Dynamic programming over it chooses the
bucket boundaries with the least padding, where each row is padded to the longest row of its bucket.
Inside a bucket, rows are dealt in order into batches of as many rows as the token budget holds at the
bucket's padded length. A row longer than the budget has a batch of its own in the bucket after the
others, without padding, so it has no part in the choice.

The last bucket's padding is size(j) (before(j + 1) - before(i)) for lengths i..j, whose best i rises
with j; so each step of the programme halves its range again and again, n log n in all, with whole
numbers. Rows are numbered inside a bucket in two steps (number within a shard, plus the rows of the
shards before). Shards are dealt by a number that each row gets when lengths are written, so repeated
rows and null ids spread like others; a bucket has at most ``MOST_SHARDS``.

Lengths are token counts of a tokenizer (``token_counts.lengths``), which is what the queries pack.

Defined cases: null or empty text has length 0; very long texts are counted whole; null ids are packed
like others; repeated rows each get a place; of equal choices of boundaries the one with the smaller
lengths in its last buckets is taken, and rows of one length go by shard, id and length; a row longer
than the budget has ``over_budget`` set and is never cut; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._common import materialise, text_of

SHARD_ROWS, MOST_SHARDS = 1000, 10_000


def words(text_col: str = "text") -> Column:
    """Number of words between white space. These are not tokens: a budget over this length is one of words."""
    text = F.trim(F.regexp_replace(text_of(text_col), r"[ \t\n\x0B\f\r]+", " "))
    return F.when(text == "", F.lit(0)).otherwise(F.char_length(text) - F.char_length(F.replace(text, F.lit(" "))) + 1).cast("long")


def best_starts(tail: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each j the first i <= j with the least tail[i] + size[j] (before[j + 1] - before[i]).

    The best i never falls as j rises, so the middle of a run of j bounds both of its halves; all
    runs of one depth are done together.
    """
    n = len(size)
    choice = np.zeros(n, np.int64)
    runs = np.array([[0, n - 1, 0, n - 1]])  # first and last j, least and greatest i
    while len(runs):
        low, high, least, most = runs.T
        middle = (low + high) // 2
        width = np.minimum(most, middle) - least + 1
        start = np.cumsum(width) - width
        run = np.repeat(np.arange(len(runs)), width)
        i = np.arange(width.sum()) - start[run] + least[run]
        value = tail[i] - size[middle][run] * before[i]
        smallest = np.minimum.reduceat(value, start)
        hits = np.flatnonzero(value == smallest[run])
        found = i[hits[np.unique(run[hits], return_index=True)[1]]]
        choice[middle] = found
        left = np.stack([low, middle - 1, least, found], 1)[low < middle]
        right = np.stack([middle + 1, high, found, most], 1)[middle < high]
        runs = np.concatenate([left, right])
    return choice


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds of at most ``buckets`` buckets with the least total padding; lengths ascend."""
    n = len(lengths)
    if n == 0:
        return []
    size, before = lengths.astype(np.int64), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    best = size * before[1:]  # padded size of rows 0..j in one bucket
    back = []
    for _ in range(1, min(buckets, n)):
        # rows i..j in the last bucket, those before it as well as possible
        tail = np.concatenate([[0], best[:-1]])
        choice = best_starts(tail, size, before)
        back.append(choice)
        best = tail[choice] + size * (before[1:] - before[choice])
    bounds, j = [], n - 1
    for choice in reversed(back):
        bounds.append(int(lengths[j]))
        j = int(choice[j]) - 1
        if j < 0:
            break
    if j >= 0:
        bounds.append(int(lengths[j]))
    return bounds[::-1]


def pack(rows: DataFrame, *, id_col: str = "doc_id", length_col: str = "length", buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """(id, length, bucket, padded_length, batch, slot, over_budget) for each row of ``rows``.

    ``budget`` is in the unit of ``length_col``; with ``token_counts.lengths`` both are tokens.
    """
    rows = rows.select(F.col(id_col), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("length"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "lengths")
    length, over = F.col("length"), F.col("length") > budget
    # at most budget + 2 bins
    hist = rows.groupBy(F.when(~over, length).alias("bin")).agg(F.count("*").alias("n")).collect()
    beyond = sum(r["n"] for r in hist if r["bin"] is None)
    hist = sorted((r["bin"], r["n"]) for r in hist if r["bin"] is not None)
    lengths, counts = (np.array(c, np.int64) for c in zip(*hist)) if hist else (np.empty(0, np.int64),) * 2
    bounds = bucket_bounds(lengths, counts, buckets)
    totals = [int(counts[(lengths <= hi) & (lengths > lo)].sum()) for lo, hi in zip([-1, *bounds], bounds)]

    shards = lambda total: F.lit(max(1, min(MOST_SHARDS, -(-total // SHARD_ROWS))))
    bucket, padded, capacity, parts = F.lit(len(bounds)), length, F.lit(1), shards(beyond)
    for k in range(len(bounds) - 1, -1, -1):
        fits = length <= bounds[k]
        pick = lambda value, rest, fits=fits: F.when(fits, F.lit(value)).otherwise(rest)
        bucket, padded, parts = pick(k, bucket), pick(bounds[k], padded), F.when(fits, shards(totals[k])).otherwise(parts)
        capacity = pick(max(1, budget // max(1, bounds[k])), capacity)
    placed = rows.select(
        id_col, "length", "row", bucket.cast("int").alias("bucket"), padded.cast("long").alias("padded_length"),
        capacity.cast("long").alias("capacity"), F.pmod(F.xxhash64(id_col, "length", "row"), parts).alias("shard"), over.alias("over_budget"),
    )
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    offset = sizes.select("bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("offset"))
    number = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(F.col(id_col).asc_nulls_first(), "length", "row"))
    at = F.col("offset") + F.col("number") - 1
    return (
        placed.withColumn("number", number)
        .join(offset, ["bucket", "shard"])
        .select(
            id_col, "length", "bucket", "padded_length", F.floor(at / F.col("capacity")).cast("long").alias("batch"),
            (at % F.col("capacity")).cast("int").alias("slot"), "over_budget",
        )
    )
