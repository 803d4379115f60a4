"""Exact top-k by inner product over a pivot-distance index.

Vectors become integers, floor(scale * x). With M the largest squared length, x' = (x, sqrt(M - x.x))
all have the same length, so for q' = (q, 0) the order by inner product is the order by distance:
|q' - x'|^2 = q.q + M - 2 q.x. The index keys each vector by its nearest pivot and its distance from
it, and cuts every pivot's vectors, sorted by distance, into groups of annuli. For a query at distance d
from the pivot, no vector at distances [lo, hi] is nearer than max(d - hi, lo - d), which bounds its
score from above.

A first pass searches the group nearest to each query and so finds a score that its k best reach. The
second one gives each query the other groups whose bound isn't below that score. Queries go in blocks of those
with neighbouring first groups, and a block and a group that any of its queries needs are one unit of
work, brought together by one join for all blocks. In a unit each query takes annuli outward from its
own distance, nearest first, and stops at the first whose bound is below its k-th score so far; the
bounds only fall outward. Groups of very many equal distances are split at random, so copies of one
vector spread.

The work saved depends on the data: where distances from pivots tell vectors apart (few dimensions,
clusters) most annuli stay unread; where they don't (64 independent dimensions) the search is a product
of all queries and rows in blocks, with an index beside it. ``search_counted`` gives the number of scored
pairs.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows
with a null id; shorter vectors are filled with zeros; a query never meets rows of its own id; rows
with one id and different vectors take part separately, repeated rows too; ties go to the smaller
id; fewer than k candidates give them all; an empty table gives an empty result; extra columns are
ignored. Components are held within +-2^31 after scaling, and scores within 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._common import bounded_batches, hash_sample, materialise, remove


@dataclass(frozen=True)
class TopKSpec:
    k: int = 20
    scale: int = 64
    every: int = 20
    pivots: int = 32
    #: Rows that the pivots are taken from, rows of an annulus, rows of a group, and queries of a block.
    sample_rows: int = 4096
    annulus_rows: int = 512
    group_rows: int = 1 << 15
    block_queries: int = 1 << 15
    #: Steps of the histogram of distances from which the groups are cut.
    steps: int = 1024


def scaled(vector: str, scale: int) -> Column:
    """The integer vector, or null where it takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    most = float((1 << 31) - 1)
    ints = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(int(most))), F.lit(-int(most))).cast("int"))
    return F.when(F.col(vector).isNotNull() & fine, ints)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as floats, short ones filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = flat
    return out


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """x' for rows of x."""
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]], 1)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of the sample: spread by furthest-first choice, then moved to the means of what is nearest."""
    if len(sample) == 0:
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centre = sample[chosen]
    for _ in range(5):
        near = distances(sample, centre).argmin(1)
        for k in range(len(centre)):
            if (near == k).any():
                centre[k] = sample[near == k].mean(0)
    return centre


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (centre * centre).sum(1) - 2 * (x @ centre.T)
    return np.sqrt(np.maximum(square, 0))


def products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as 64-bit integers; floats hold them as long as lengths stay below 2^52."""
    if exact:
        return (q @ x.T).astype(np.int64)
    big = q.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


LOWEST = -(1 << 63)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best rows."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    start = np.concatenate([[True], q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return order[rank < k]


@dataclass
class Groups:
    """The index's groups: pivot, least and greatest distance, rows. Of groups with equal pivot and distances each row is in one."""

    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def gaps(self, away: np.ndarray) -> np.ndarray:
        """(queries, groups): how much nearer than any vector of a group a query can be to it, from its distances to the pivots."""
        own = away[:, self.pivot]
        return np.maximum(np.maximum(own - self.high, self.low - own), 0)


def cut_groups(hist: list[tuple[int, int, int]], step: float, most_rows: int) -> tuple[Groups, list[tuple[int, int, int, int, int]]]:
    """Groups of neighbouring steps, and (pivot, first step, last step, first group, parts) of each run of steps; a larger step is split in parts."""
    runs: list[list[int]] = []
    for pivot, s, n in hist:
        if runs and runs[-1][0] == pivot and runs[-1][3] + n <= most_rows:
            runs[-1][2:] = [s, runs[-1][3] + n]
        else:
            runs.append([pivot, s, s, n])
    parts = [-(-n // most_rows) for *_, n in runs]
    first = (np.cumsum(parts) - parts).tolist()
    every = [(p, a * step, (b + 1) * step, n / c) for (p, a, b, n), c in zip(runs, parts) for _ in range(c)]
    pivot, low, high, rows = (np.array(x) for x in zip(*every))
    return Groups(pivot, low, high, rows), [(p, a, b, g, c) for (p, a, b, _), g, c in zip(runs, first, parts)]


def upper_bound(length: np.ndarray, gap: np.ndarray, most: float) -> np.ndarray:
    """What no score of a vector behind the gap exceeds, with room for rounding; ``length`` is the query's squared length."""
    return (length + most - gap * gap) / 2 + 1e-6 * (length + most + 1)


@dataclass
class Unit:
    """A block's queries (ids, keys of rows, vectors, distances from the group's pivot, scores that their k best reach) and a group's rows, by distance."""

    query: np.ndarray
    key: np.ndarray
    x: np.ndarray
    d: np.ndarray
    reach: np.ndarray
    vec: np.ndarray
    y: np.ndarray
    away: np.ndarray

    def search(self, k: int, annulus: int, most: float, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Places of queries and of their k best rows with the scores, and the number of scored pairs; each query takes annuli outward."""
        starts = np.arange(0, len(self.vec), annulus)
        low, high = self.away[starts], self.away[np.minimum(starts + annulus, len(self.vec)) - 1]
        gap = np.maximum(np.maximum(self.d[:, None] - high, low - self.d[:, None]), 0)
        outward = np.argsort(gap, 1, kind="stable")
        length = (self.x * self.x).sum(1)
        # scores that aren't reached yet are the lowest
        top = np.full((len(self.query), k), LOWEST, np.int64)
        reach = self.reach.copy()
        found, scored, alive = [], 0, np.arange(len(self.query))
        for turn in range(len(starts)):
            at = outward[alive, turn]
            on = upper_bound(length[alive], gap[alive, at], most) >= reach[alive]
            alive, at = alive[on], at[on]
            if not len(alive):
                break
            order = np.argsort(at, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                for s in range(0, len(part), 1024):
                    some, a = alive[part[s : s + 1024]], starts[at[part[s]]]
                    ids = self.vec[a : a + annulus]
                    score = products(self.x[some], self.y[a : a + annulus], exact)
                    own = self.query[some][:, None] == ids
                    score[own] = LOWEST
                    scored += score.size
                    both = np.concatenate([top[some], score], 1)
                    top[some] = np.partition(both, both.shape[1] - k, 1)[:, -k:]
                    reach[some] = np.maximum(reach[some], top[some].min(1))
                    i, j = np.nonzero((score >= reach[some][:, None]) & ~own)
                    found.append((some[i], a + j, score[i, j]))
        if not found:
            return *[np.empty(0, np.int64)] * 3, scored
        query, row, score = (np.concatenate(c) for c in zip(*found))
        kept = score >= reach[query]
        query, row, score = query[kept], row[kept], score[kept]
        keep = best(query, self.vec[row], score, k)
        return query[keep], row[keep], score[keep], scored


def units_of(batches, width: int):
    """Units from rows sorted by (block, g, kind, d), where kind 0 are queries."""
    key, held = None, []

    def unit():
        rows = pa.Table.from_batches(held).combine_chunks()
        n = int((rows.column("kind").to_numpy() == 0).sum())
        x = matrix(rows.column("x").combine_chunks() if isinstance(rows.column("x"), pa.ChunkedArray) else rows.column("x"), width)
        ids, row, d, reach = (rows.column(c).to_numpy() for c in ("id", "row", "d", "reach"))
        return Unit(ids[:n], row[:n], x[:n], d[:n], reach[:n], ids[n:], x[n:], d[n:])

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("block", "g")], 1)
        edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(edge, edge[1:]):
            if a == b:
                continue
            if held and tuple(keys[a]) != key:
                yield unit()
                held = []
            key = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield unit()


def together(queries: DataFrame, indexed: DataFrame) -> DataFrame:
    """(block, g, id, row, x, d, reach) queries and the rows of their groups, unit by unit."""
    units = queries.select("block", "g").distinct()
    rows = indexed.join(units, "g").select("block", "g", F.lit(1).alias("kind"), F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("row"), "x", F.col("away").alias("d"), F.lit(LOWEST).alias("reach"))
    asked = queries.select("block", "g", F.lit(0).alias("kind"), "id", "row", "x", "d", "reach")
    return asked.unionByName(rows).repartition("block", "g").sortWithinPartitions("block", "g", "kind", "d")


RESULT = "query_id long, rank int, vec_id long, score long"


def top_k(vectors: DataFrame, spec: TopKSpec = TopKSpec(), *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its k best other rows."""
    return search_counted(vectors, spec, id_col=id_col, vector_col=vector_col)[0]


def search_counted(vectors: DataFrame, spec: TopKSpec = TopKSpec(), *, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, object]:
    """``top_k`` with an accumulator that holds the number of scored pairs once the result has been computed (retried tasks count again)."""
    spark, k = vectors.sparkSession, spec.k
    bounded_batches(spark)
    scored = spark.sparkContext.accumulator(0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(vector_col, spec.scale).alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    facts = rows.agg(F.count("*"), F.max(F.size("x")), F.max(square), F.count_if(F.col("vec_id") % spec.every == 0)).first()
    total, width, most, asked = facts[0], facts[1] or 0, facts[2] or 0.0, facts[3]
    if not total or not asked:
        return spark.createDataFrame([], RESULT), scored
    exact = most < (1 << 52)

    sample = hash_sample(rows, spec.sample_rows, "vec_id").select("x").toArrow().column("x").combine_chunks()
    centre = choose_pivots(lifted(matrix(sample, width), most), spec.pivots)

    @F.arrow_udf("struct<pivot: int, away: double>")
    def nearest(x: pa.Array) -> pa.Array:
        d = distances(lifted(matrix(x, width), most), centre)
        at = d.argmin(1)
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], ["pivot", "away"])

    keyed = rows.withColumn("at", nearest("x")).select("vec_id", "x", "at.*", F.monotonically_increasing_id().alias("row"))
    keyed = materialise(keyed, "keyed")
    step = 2 * np.sqrt(most) / spec.steps or 1.0
    stepped = keyed.withColumn("step", F.floor(F.col("away") / step).cast("int"))
    hist = sorted(tuple(r) for r in stepped.groupBy("pivot", "step").agg(F.count("*")).collect())  # at most pivots x steps
    groups, runs = cut_groups(hist, step, spec.group_rows)
    bounds = spark.createDataFrame(runs, "p int, a int, b int, first int, parts int")  # no more rows than the histogram
    indexed = stepped.join(F.broadcast(bounds), (F.col("pivot") == F.col("p")) & F.col("step").between(F.col("a"), F.col("b"))).select(
        (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int").alias("g"), "vec_id", "away", "x"
    )

    sent = spark.sparkContext.broadcast((groups, centre))

    def of_queries(x: pa.Array, chosen):
        """A list of (group, distance) for each query, from its vector, its gaps to all groups and its place."""
        groups, centre = sent.value
        q = matrix(x, width)
        away, length, out = distances(np.concatenate([q, np.zeros((len(q), 1))], 1), centre), (q * q).sum(1), []
        for s in range(0, len(q), 64):
            gap = groups.gaps(away[s : s + 64])
            for i in range(len(gap)):
                g = chosen(groups, s + i, gap[i], length[s + i])
                out.append((g, away[s + i, groups.pivot[g]]))
        sizes = [len(g) for g, _ in out]
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([c[i] for c in out]) if out else np.empty(0), t) for i, t in enumerate((pa.int32(), pa.float64()))], ["g", "d"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pairs)

    @F.arrow_udf("array<struct<g: int, d: double>>")
    def first_group(x: pa.Array) -> pa.Array:
        """The nearest group, of equals that with most rows; with rows enough where there is one."""
        return of_queries(x, lambda groups, i, gap, length: np.array([np.lexsort((-groups.rows, gap, groups.rows <= min(k, groups.rows.max() - 1)))[0]]))

    @F.arrow_udf("array<struct<g: int, d: double>>")
    def open_groups(x: pa.Array, reach: pa.Array) -> pa.Array:
        least = reach.to_numpy()
        return of_queries(x, lambda groups, i, gap, length: np.flatnonzero(upper_bound(length, gap, most) >= least[i]))

    queries = keyed.where(F.col("vec_id") % spec.every == 0).select(F.col("vec_id").alias("id"), "x", "row", F.inline(first_group("x")))
    queries = materialise(queries, "queries")
    homes = sorted(tuple(r) for r in queries.groupBy("g").agg(F.count("*")).collect())  # no more than groups
    before = np.cumsum([0, *[n for _, n in homes]]).tolist()
    places = spark.createDataFrame([(g, n, b) for (g, n), b in zip(homes, before)], "g int, n long, before long")
    block = F.floor((F.col("before") + F.pmod(F.xxhash64("row"), F.col("n"))) / spec.block_queries).cast("int").alias("block")
    blocked = queries.join(F.broadcast(places), "g").select("id", "x", "row", block, "g", "d", F.lit(LOWEST).alias("reach"))

    def search(batches):
        for unit in units_of(batches, width):
            query, row, score, pairs = unit.search(k, spec.annulus_rows, most, exact)
            scored.add(pairs)
            columns = unit.key[query], unit.query[query], unit.vec[row], score
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "query_id", "vec_id", "score"])

    found = "row long, query_id long, vec_id long, score long"
    first = materialise(together(blocked, indexed).mapInArrow(search, found), "first")
    reached = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(LOWEST).alias("reach"))
    following = blocked.select("id", "x", "row", "block", F.col("g").alias("home")).join(reached, "row", "left").withColumn("reach", F.coalesce("reach", F.lit(LOWEST)))
    following = following.withColumn("open", open_groups("x", "reach")).select("id", "x", "row", "block", "reach", "home", F.inline("open")).where("g <> home").drop("home")
    following = materialise(following, "asked")
    others = materialise(together(following, indexed).mapInArrow(search, found), "others")
    for made in (keyed, queries, following):
        remove(made, spark)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(others).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), scored
