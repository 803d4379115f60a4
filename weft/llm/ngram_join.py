"""Similarity join of texts on word n-grams, with adaptive multi-match prefixes.

A text's set holds its distinct shingles of ``width`` words (A-Z lower-cased); with fewer words the
whole sequence is one. Two texts link when their sets' Jaccard similarity is at least ``num/den``.

1. A count sketch of fixed size over all shingles of all texts estimates how common each one is.
   It orders the shingles of every set alike, rare ones first. The order decides the speed only.
2. Equal sets form one class. If two sets of sizes n, m have the overlap a that the threshold needs,
   the first n - a + L of one and m - a + L of the other share L shingles. A class keeps its first
   n - ceil(t n) + L shingles, where L from 1 up is chosen by the estimated cost of its candidates: a
   longer prefix costs more to read, but a pair must then share L of them. Pairs meet in the shingles
   of the shortest prefixes; before they are compared, they must share as many as the smaller L in
   the prefixes lengthened for it.
3. In each shingle's list the class whose prefix is most common is the hub; all others are compared
   with it. These links are true ones and join most of a group of near copies in linear work.
4. Then pairs in a list that aren't in one component yet are met. Lists of at most ``small_list``
   classes give them as rows, under the positions that their sizes allow; those that share enough are
   compared. Longer lists are compared inside tasks, in blocks, by prefixes that grow with the number
   of partners (``hot_lists``), and give links only. So no link between components is lost, pairs
   within a component aren't listed, and rows don't grow with the square of a group.
5. Pairs are compared by their whole sets, which are read again from the texts of the classes in
   question only. Components of the links give the result.

Shingles and classes are 64-bit hashes. Defined cases: null or blank text has an empty set and is
linked with nothing; rows with a null id have a null component and take no part; rows with one id
and different texts take part separately; repeated rows fall into one class; an empty table gives an
empty result; extra columns are ignored; texts are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._common import bounded_batches, kept_by_worker, materialise, remove, text_of
from weft.llm.components import connected_components
from weft.llm.hot_lists import group_key, hot_pairs

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class JoinSpec:
    width: int = 3
    num: int = 90
    den: int = 100
    #: Most shingles that a pair can be asked to share, and the cost of a comparison in listed entries.
    most_matches: int = 8
    comparison_cost: float = 6.0
    #: Classes of a list whose pairs become rows; in longer ones, partners for which one more shared shingle is asked, and the size of a block.
    small_list: int = 32
    partners_per_match: int = 1
    block_rows: int = 512
    block_tokens: int = 1 << 19
    #: Cells of the sketch (4 bytes each), and bits of the set of wanted ids.
    sketch_cells: int = 1 << 20
    id_bits: int = 1 << 23

    def least_size(self, n):
        """ceil(t n)"""
        return -(-self.num * n // self.den)


class Shingler:
    """Sets of shingles of a text."""

    def __init__(self, width: int):
        self.width = width

    def all(self, text: bytes) -> np.ndarray:
        """Hashes of the shingles in order, with repetitions."""
        words = text.lower().split()
        w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        if len(w) == 0:
            return w
        n = min(self.width, len(w))
        h = w[: len(w) - n + 1] + np.uint64(n)
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * _P + w[k : len(w) - n + 1 + k]
        h = (h ^ (h >> np.uint64(32))) * _Q
        return h ^ (h >> np.uint64(31))

    def set(self, text: bytes) -> np.ndarray:
        return np.unique(self.all(text))


def shingler(width: int) -> Shingler:
    return kept_by_worker(f"shingles of {width}", lambda: Shingler(width))


def class_of(found: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    return int(np.array(xxhash.xxh3_64_intdigest(found.tobytes()), np.uint64).view(np.int64))


def text_class(text: Column, spec: JoinSpec) -> Column:
    """The class of each text, null without words."""
    width = spec.width

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        of = shingler(width)
        return pa.array([class_of(s) if len(s) else None for s in map(of.set, texts.cast(pa.binary()).to_pylist())], pa.int64())

    return run(text)


# -- how common shingles are ---------------------------------------------------------------------

BLOCK = 1 << 14


def sketch(texts: DataFrame, spec: JoinSpec) -> np.ndarray:
    """Counts of all shingles by cell; a task sends its cells in blocks, which are summed by block."""
    width, cells = spec.width, spec.sketch_cells

    def count(batches):
        total, of, buffer, size = np.zeros(cells, np.int64), shingler(width), [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                buffer.append((of.all(text) & np.uint64(cells - 1)).astype(np.int32))
                size += len(buffer[-1])
                if size > 4 * cells:
                    total += np.bincount(np.concatenate(buffer), minlength=cells)
                    buffer, size = [], 0
        if size:
            total += np.bincount(np.concatenate(buffer), minlength=cells)
        total = np.minimum(total, (1 << 31) - 1).astype(np.int32)
        for k in range(0, cells, BLOCK):
            if (part := total[k : k + BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "counts"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[block] = total.get(block, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        for block, counts in total.items():
            data = np.minimum(counts, (1 << 31) - 1).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["block", "counts"])

    schema, blocks = "block int, counts binary", -(-cells // BLOCK)
    parts = texts.mapInArrow(count, schema).repartition(blocks, "block").mapInArrow(merge, schema)
    out = np.zeros(blocks * BLOCK, np.int32)
    for block, counts in parts.collect():
        part = np.frombuffer(counts, np.int32)
        out[block * BLOCK : block * BLOCK + len(part)] = part
    return out


# -- prefixes ------------------------------------------------------------------------------------


def prefix(found: np.ndarray, counts: np.ndarray, spec: JoinSpec) -> tuple[np.ndarray, int, int]:
    """The listed shingles of a set in order, the number of them a pair must share, and how common they are (on a log scale)."""
    n = len(found)
    need = spec.least_size(n)
    short, most = n - need + 1, min(spec.most_matches, need)
    common = counts[(found & np.uint64(len(counts) - 1)).astype(np.int64)]
    longest = short + most - 1
    if longest < n:
        at = np.argpartition(common, longest - 1)[:longest]
        edge = common[at].max()  # ties at the edge are broken by the hash, as everywhere
        at = np.flatnonzero(common <= edge)
    else:
        at = np.arange(n)
    at = at[np.lexsort((found[at], common[at]))][:longest]
    seen = common[at].astype(np.float64)
    total = np.cumsum(seen)[short - 1 :]
    matches = np.arange(1, most + 1)
    chosen = int(np.argmin(total * (1 + spec.comparison_cost / matches))) + 1
    return found[at[: short + chosen - 1]], chosen, int(16 * np.log2(1 + seen[:short].mean()))


SETS = "doc_id long, n long, class long, matches int, common int, listed array<long>"


def set_rows(docs: DataFrame, counts, spec: JoinSpec) -> DataFrame:
    """One row for each text: its set's size, class and listed shingles."""

    def run(batches):
        of = shingler(spec.width)
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = of.set(text)
                if len(found):
                    listed, matches, common = prefix(found, counts.value, spec)
                    rows.append((len(found), class_of(found), matches, common, listed.view(np.int64)))
                else:
                    rows.append((0, 0, 0, 0, np.empty(0, np.int64)))
            n, cls, matches, common, listed = zip(*rows) if rows else ((),) * 5
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in listed])]).astype(np.int32)
            flat = np.concatenate(listed) if listed else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(matches, pa.int32()),
                    pa.array(common, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                ["doc_id", "n", "class", "matches", "common", "listed"],
            )

    return docs.mapInArrow(run, SETS)


# -- comparing -----------------------------------------------------------------------------------


def id_filter(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit set of fixed size over hashes of ids: what it lacks isn't wanted; made by a bounded aggregation."""
    at = F.pmod(F.col(column), F.lit(bits))
    words = ids.groupBy(F.floor(at / 62).cast("int").alias("w")).agg(F.bit_or(F.pow(F.lit(2.0), at % 62).cast("long")).alias("b"))
    got = words.toArrow()  # at most bits / 62 rows
    out = np.zeros((-(-bits // 62), 62), np.bool_)
    if len(got):
        out[got.column("w").to_numpy()] = (got.column("b").to_numpy()[:, None] >> np.arange(62)) & 1
    return out.ravel()[:bits]


def possibly_in(ids: DataFrame, id_col: str, spec: JoinSpec):
    """A test of id columns: false where an id is surely none of the ids. It moves no rows; a join settles the rest."""
    sent = ids.sparkSession.sparkContext.broadcast(np.packbits(id_filter(ids, id_col, spec.id_bits)))
    bits = spec.id_bits

    def test(column: pa.Array) -> pa.Array:
        at = np.mod(column.fill_null(0).to_numpy(zero_copy_only=False), bits)
        there = (sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return pa.array(there & column.is_valid().to_numpy(zero_copy_only=False))

    return test


def whole_sets(docs: DataFrame, classes: DataFrame, spec: JoinSpec, counts=None) -> DataFrame:
    """(class, data): the sorted set of each of the classes, from the text of its first document; with ``counts`` in the order of prefixes."""
    wanted = possibly_in(classes, "first_id", spec)
    arranged = lambda f: f if counts is None else f[np.lexsort((f, counts.value[(f & np.uint64(len(counts.value) - 1)).astype(np.int64)]))]

    def run(batches):
        of = shingler(spec.width)
        for batch in batches:
            texts = batch.column("text").filter(wanted(batch.column("doc_id"))).cast(pa.binary()).to_pylist()
            rows = [(class_of(f), arranged(f).tobytes()) for f in map(of.set, texts) if len(f)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["class", "data"])

    found = docs.mapInArrow(run, "class long, data binary")
    return found.join(classes.select("class"), "class", "left_semi").groupBy("class").agg(F.first("data").alias("data"))


def linked(pairs: DataFrame, sets: DataFrame, spec: JoinSpec) -> DataFrame:
    """The pairs (x, y) of classes whose whole sets reach the threshold."""
    num, den = spec.num, spec.den

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(a, b):
            x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(den * both >= num * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    first = pairs.join(sets.select(F.col("class").alias("x"), F.col("data").alias("a")), "x")
    second = first.join(sets.select(F.col("class").alias("y"), F.col("data").alias("b")), "y")
    return second.where(alike("a", "b")).select("x", "y")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("class")).distinct()


def compared(docs: DataFrame, pairs: DataFrame, classes: DataFrame, spec: JoinSpec) -> DataFrame:
    """Those of the pairs that link; only the sets of their classes are made again from the texts."""
    wanted = materialise(ends_of(pairs).join(classes.select("class", "first_id"), "class"), "wanted")
    sets = materialise(whole_sets(docs, wanted, spec), "whole-sets")
    links = materialise(linked(pairs, sets, spec), "links")
    for step in (wanted, sets):
        remove(step, docs.sparkSession)
    return links


def overlap(spec: JoinSpec, n: Column, m: Column) -> Column:
    """The least number of shingles that sets of these sizes share if they link."""
    return F.ceil((spec.num * (n + m)).cast("long") / F.lit(spec.num + spec.den)).cast("long")


def may_link(spec: JoinSpec, x: str, y: str) -> Column:
    """Whether a shingle that two classes share lies inside the shortest prefixes that their sizes allow."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    least = overlap(spec, n, m)
    return (F.col(f"{x}.pos") <= n - least) & (F.col(f"{y}.pos") <= m - least) & (F.least(n, m) >= least)


def sharing_enough(pairs: DataFrame, classes: DataFrame, spec: JoinSpec) -> DataFrame:
    """Those of the materialised pairs (x, y) of classes that share as many shingles of their lengthened prefixes as both ask for."""
    wanted = possibly_in(ends_of(pairs), "class", spec)
    prefixes = classes.select("class", "n", "matches", "listed")
    prefixes = materialise(prefixes.mapInArrow(lambda batches: (b.filter(wanted(b.column("class"))) for b in batches), prefixes.schema), "prefixes")
    side = lambda c: prefixes.select(F.col("class").alias(c), F.struct("n", "matches", "listed").alias(f"_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    n, m = F.col("_x.n"), F.col("_y.n")
    asked, least = F.least("_x.matches", "_y.matches"), overlap(spec, n, m)
    head = lambda c, size: F.slice(F.col(f"{c}.listed"), F.lit(1), (size - least + asked).cast("int"))
    out = materialise(both.where(F.size(F.array_intersect(head("_x", n), head("_y", m))) >= asked).select("x", "y"), "sharing")
    remove(prefixes, classes.sparkSession)
    return out


def between_components(docs: DataFrame, shared: DataFrame, hubs: DataFrame, label: DataFrame, stars: DataFrame, classes: DataFrame, counts, spec: JoinSpec, every: bool = False) -> DataFrame:
    """Links (x, y) between classes that meet in a list and that the stars have left in different components.

    Of lists longer than ``small_list`` as many links come as join what can be joined, unless ``every`` one is asked for.
    """
    spark = docs.sparkSession
    labelled = shared.drop("common").join(label.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    labelled = materialise(labelled, "labelled")
    lists = labelled.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"), group_key())
    mixed = materialise(lists.where("low <> high").select("shingle", "m", "g"), "mixed")
    few, hot = mixed.where(F.col("m") <= spec.small_list), mixed.where(F.col("m") > spec.small_list)

    hot_entries = labelled.join(hot, "shingle").select("g", "m", "class", "n", "component")
    sets = lambda wanted: whole_sets(docs, materialise(wanted.join(classes.select("class", "first_id"), "class"), "wanted"), spec, counts)
    found = hot_pairs(hot_entries, sets, spec, every) if not hot.isEmpty() else None

    few_entries = materialise(labelled.join(few, "shingle").select("shingle", "class", "n", "pos", "component"), "few")
    remove(labelled, spark)
    centre = hubs.select("shingle", F.col("hub.class").alias("node")).join(few.select("shingle"), "shingle", "left_semi").join(label, "node", "left")
    centre = materialise(centre.select("shingle", F.coalesce("component", "node").alias("centre")), "centre")
    # every such pair has a side outside the hub's component; if both are, each pair is taken once
    side = lambda c: F.struct("class", "n", "pos", "component").alias(c)
    outside = few_entries.join(centre, "shingle").where(F.col("component") != F.col("centre")).select("shingle", "centre", side("x"))
    met = outside.join(few_entries.select("shingle", side("y")), "shingle").where(
        (F.col("x.component") != F.col("y.component"))
        & ((F.col("y.component") == F.col("centre")) | (F.col("x.class") < F.col("y.class")))
        & may_link(spec, "x", "y")
    )
    pairs = materialise(met.select(F.least("x.class", "y.class").alias("x"), F.greatest("x.class", "y.class").alias("y")).distinct(), "met")
    for step in (few_entries, centre, mixed):
        remove(step, spark)
    known = stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    enough = sharing_enough(pairs, classes, spec)
    if found is not None:
        enough = enough.unionByName(found.where("NOT link").select("x", "y")).distinct()
    wanted = materialise(enough.join(known, ["x", "y"], "left_anti"), "pairs")
    out = compared(docs, wanted, classes, spec) if not wanted.isEmpty() else wanted
    remove(pairs, spark)
    return out if found is None else out.unionByName(found.where("link").select("x", "y"))


def listed_classes(docs: DataFrame, spec: JoinSpec, id_col: str, text_col: str) -> tuple:
    """The texts, the sketch, members (doc_id, n, class), classes, entries of shingles that several classes list, and the lists' hubs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    counts = spark.sparkContext.broadcast(sketch(docs.select("text"), spec))
    rows = materialise(set_rows(docs, counts, spec), "sets")

    taking_part = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = taking_part.groupBy("class").agg(
        F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("matches").alias("matches"), F.first("common").alias("common"), F.first("listed").alias("listed")
    )
    classes = materialise(classes, "classes")
    members = materialise(rows.select("doc_id", "n", "class"), "members")
    remove(rows, spark)
    shortest = (F.col("n") - F.ceil((spec.num * F.col("n")) / F.lit(spec.den)) + 1).cast("int")
    entries = classes.select("class", "n", "common", F.posexplode(F.slice("listed", F.lit(1), shortest)).alias("pos", "shingle"))
    # most shingles occur once; only their hashes travel to find that out. Aggregates are materialised
    # before they are joined, so that Spark can split the list of a shingle that very many classes share
    repeated = materialise(entries.groupBy("shingle").agg(F.count("*").alias("many")).where("many > 1").select("shingle"), "repeated")
    shared = materialise(entries.join(repeated, "shingle", "left_semi"), "entries")
    remove(repeated, spark)
    hubs = materialise(shared.groupBy("shingle").agg(F.max(F.struct("common", "class", "n", "pos")).alias("hub")), "hubs")
    return docs, counts, members, classes, shared, hubs


def ngram_links(docs: DataFrame, spec: JoinSpec = JoinSpec(), *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members (id, n_shingles, class, n_links), and all pairs (x, y) of linked classes, x < y.

    ``n_links`` counts the other rows that a row links with, copies too; it is null where the row takes
    no part. Copies aren't expanded into pairs, but groups of near copies have as many pairs as they
    have links; where components are enough, ``ngram_components`` gives them without.
    """
    docs, counts, members, classes, shared, hubs = listed_classes(docs, spec, id_col, text_col)
    spark = docs.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)
    pairs = between_components(docs, shared, hubs, none("node long, component long"), none("x long, y long"), classes, counts, spec, every=True)
    pairs = materialise(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "all-links")
    rows = materialise(members.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("class").agg(F.count("*").alias("rows")), "class-rows")
    both = pairs.select(F.col("x").alias("class"), F.col("y").alias("other")).unionByName(pairs.select(F.col("y").alias("class"), F.col("x").alias("other")))
    others = both.join(rows.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.sum("rows").alias("linked"))
    total = materialise(rows.join(others, "class", "left").select("class", (F.col("rows") - 1 + F.coalesce("linked", F.lit(0))).alias("links")), "link-counts")
    for step in (shared, hubs, classes, rows):
        remove(step, spark)
    takes_part = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return members.join(total, "class", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).alias("class"), F.when(takes_part, F.col("links")).alias("n_links")
    ), pairs


def ngram_components(docs: DataFrame, spec: JoinSpec = JoinSpec(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row; the component's id is its smallest."""
    found = row_components(docs, spec, id_col=id_col, text_col=text_col)
    return found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def row_components(docs: DataFrame, spec: JoinSpec = JoinSpec(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, class, component, component_id) for each row.

    Where ids repeat, components can share their smallest id; ``component`` tells them apart. It and
    ``class`` are null for rows without words.
    """
    docs, counts, members, classes, shared, hubs = listed_classes(docs, spec, id_col, text_col)
    spark = docs.sparkSession
    x = F.struct("class", "n", "pos").alias("x")
    stars = shared.join(hubs, "shingle").select(x, F.col("hub").alias("y")).where((F.col("x.class") != F.col("y.class")) & may_link(spec, "x", "y"))
    stars = materialise(stars.select(F.col("x.class").alias("x"), F.col("y.class").alias("y")).distinct(), "met")
    near = sharing_enough(stars, classes, spec)
    remove(stars, spark)
    links = compared(docs, near, classes, spec)

    label = connected_components(links, "x", "y")
    more = between_components(docs, shared, hubs, label, near, classes, counts, spec)
    for step in (shared, hubs, near):
        remove(step, spark)
    final = label if more.isEmpty() else connected_components(label.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(more), "x", "y")
    final = final.withColumnRenamed("node", "class")

    # components are named by classes so far; name them by the smallest id
    named = materialise(classes.select("class", "first_id").join(final, "class", "left").withColumn("component", F.coalesce("component", "class")), "named")
    remove(classes, spark)
    least = materialise(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    named = named.join(least, "component").select("class", "component", "component_id")
    has_words = F.col("n") > 0
    return members.join(named, "class", "left").select(
        "doc_id",
        "n",
        F.when(has_words, F.col("class")).alias("class"),
        F.when(has_words, F.col("component")).alias("component"),
        F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
