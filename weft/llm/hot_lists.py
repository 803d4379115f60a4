"""Classes that meet in hot shingle lists, compared inside tasks in blocks; only links leave a task.

A list of more than ``small_list`` classes would give a pair for each two of them. Such lists are
put together by a two-value MinHash of their classes, so that the lists of one group of near copies,
which have nearly the same classes, become one group, in which each pair is met once. The more
partners a class has in its group, the longer its prefix becomes, up to its whole set, and the more
tokens of it a pair must share:

    If the prefixes hold all but r and s tokens of two sets, and the threshold needs an overlap of o,
    the prefixes share at least o - max(r, s) tokens, as all prefixes follow one order.

A group's classes are dealt in blocks of bounded size, and each pair of blocks is one unit of work:
the shared tokens of all its pairs are one matrix product. Classes of the group's largest component
meet the others only. Where both prefixes are whole sets, the product decides the link itself, and
only links that join components not joined before leave the task, fewer than its rows. Other pairs
have few partners by construction (fewer than ``partners_per_match`` times their need) and leave as
candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._common import materialise, remove

FOUND = "x long, y long, link boolean"
COLUMNS = 4096


def group_key():
    """Of the classes of a list, an aggregate that lists of nearly the same classes mostly share."""
    return F.xxhash64(F.min("class"), F.min(F.xxhash64("class"))).alias("g")


def members_of(entries: DataFrame, spec) -> DataFrame:
    """(g, class, n, component, rest, tokens) of (g, m, class, n, component) entries: the prefix that the number of partners asks for."""
    need = F.ceil((spec.num * F.col("n")) / F.lit(spec.den)).cast("long")
    matches = F.least(need, 1 + F.floor(F.col("partners") / spec.partners_per_match))
    members = entries.groupBy("g", "class").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.sum(F.col("m") - 1).alias("partners"))
    return members.withColumn("rest", (need - matches).cast("long")).select("g", "class", "n", "component", "rest", (F.col("n") - F.col("rest")).alias("tokens"))


def dealt(members: DataFrame, spec) -> DataFrame:
    """The members with their block, once for each pair of blocks (first <= second) that they are part of."""
    parts = members.groupBy("g", "component").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"))
    groups = parts.groupBy("g").agg(
        F.max(F.struct("rows", "component", "tokens")).alias("c"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens")
    )
    blocks = lambda rows, tokens: F.ceil(F.greatest(rows / spec.block_rows, tokens / spec.block_tokens)).cast("int")
    groups = groups.select(
        "g", F.col("c.component").alias("centre"),
        blocks(F.col("rows") - F.col("c.rows"), F.col("tokens") - F.col("c.tokens")).alias("outer"), blocks(F.col("c.rows"), F.col("c.tokens")).alias("inner"),
    )
    joined = members.join(materialise(groups, "groups"), "g")
    inside, at = F.col("component") == F.col("centre"), F.xxhash64("class", "g")
    joined = joined.withColumn("block", F.when(inside, F.col("outer") + F.pmod(at, F.col("inner"))).otherwise(F.pmod(at, F.col("outer"))).cast("int"))
    last = F.when(inside, F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1)
    pairs = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.least(k, "block").alias("first"), F.greatest(k, "block").alias("second")))
    return joined.select("g", "class", "n", "component", "rest", "tokens", "block", F.explode(pairs).alias("unit")).select("*", "unit.*").drop("unit")


def shared_tokens(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of tokens that each left and each right prefix share; a prefix holds a token once."""
    flat = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(t) for t in (*left, *right)])
    token = np.unique(flat, return_inverse=True)[1]
    size = int(token.max()) + 1 if len(token) else 0
    on_left = row < len(left)
    both = np.zeros((2, size), bool)
    both[0, token[on_left]] = both[1, token[~on_left]] = True
    both = both.all(0)
    kept = both[token]
    column, row = (np.cumsum(both) - 1)[token[kept]], row[kept]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(both.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        there = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        there[row[a:b], column[a:b] - low] = 1
        out += there[: len(left)] @ there[len(left) :].T
    return out


def spanning(a: np.ndarray, b: np.ndarray, nodes: int) -> tuple[np.ndarray, list[int]]:
    """Of edges between nodes, each node's component and the places of edges of a spanning forest."""
    label, chosen = np.arange(nodes), []
    near = np.full((nodes, nodes), -1, np.int32)
    near[a, b] = near[b, a] = np.arange(len(a), dtype=np.int32)
    seen = np.zeros(nodes, bool)
    for start in range(nodes):
        if seen[start]:
            continue
        seen[start], queue = True, [start]
        while queue:
            u = queue.pop()
            label[u] = start
            for v in np.flatnonzero((near[u] >= 0) & ~seen).tolist():
                seen[v] = True
                chosen.append(int(near[u, v]))
                queue.append(v)
    return label, chosen


def linked_in(rows: dict[str, np.ndarray], prefixes: list[np.ndarray], first: int, second: int, spec, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, link) of one pair of blocks: links that join components (or ``every`` link), and pairs that need a look at whole sets."""
    left, right = np.flatnonzero(rows["block"] == first), np.flatnonzero(rows["block"] == second)
    if not len(left) or not len(right):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    n, rest, component = rows["n"], rows["rest"], np.unique(rows["component"], return_inverse=True)[1]
    share = shared_tokens([prefixes[i] for i in left], [prefixes[i] for i in right])
    least = -(-spec.num * (n[left][:, None] + n[right]) // (spec.num + spec.den))
    open_ = np.maximum(rest[left][:, None], rest[right])
    fits = (share >= least - open_) & (np.minimum(n[left][:, None], n[right]) >= least) & (component[left][:, None] != component[right])
    if first == second:
        fits = np.triu(fits, 1)
    a, b = np.nonzero(fits)
    whole = open_[a, b] == 0
    a, b = left[a], right[b]
    if every:
        return rows["class"][a], rows["class"][b], whole
    label, chosen = spanning(component[a[whole]], component[b[whole]], int(component.max()) + 1)
    x, y = rows["class"][a], rows["class"][b]
    unsure = ~whole & (label[component[a]] != label[component[b]])
    take = np.concatenate([np.flatnonzero(whole)[chosen], np.flatnonzero(unsure)]).astype(np.int64)
    return x[take], y[take], whole[take]


def compare(units: DataFrame, spec, every: bool) -> DataFrame:
    """(x, y, link) of dealt members with their prefixes (``data``), unit by unit."""

    def run(batches):
        key, held = None, []

        def found():
            table = pa.Table.from_batches(held).combine_chunks()
            rows = {c: table.column(c).to_numpy() for c in ("class", "n", "component", "rest", "block")}
            prefixes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("data")]
            x, y, link = linked_in(rows, prefixes, *key[1:], spec, every)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(link)], ["x", "y", "link"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("g", "first", "second")], 1)
            edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(edge, edge[1:]):
                if a == b:
                    continue
                if held and tuple(keys[a]) != key:
                    yield found()
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield found()

    sorted_ = units.repartition("g", "first", "second").sortWithinPartitions("g", "first", "second")
    return sorted_.mapInArrow(run, FOUND)


def hot_pairs(entries: DataFrame, sets, spec, every: bool = False) -> DataFrame:
    """(x, y, link) of (g, m, class, n, component) entries; ``sets(classes)`` gives (class, data), the set in the order of prefixes.

    Links join components, unless ``every`` link is asked for, whose number may grow with the square of a group.
    """
    spark = entries.sparkSession
    members = materialise(members_of(entries, spec), "hot-members")
    data = materialise(sets(members.select("class").distinct()), "hot-sets")
    units = dealt(members, spec).join(data, "class").withColumn("data", F.substring("data", F.lit(1), (8 * F.col("tokens")).cast("int")))
    found = materialise(compare(units, spec, every).distinct(), "hot-pairs")
    for step in (members, data):
        remove(step, spark)
    return found
