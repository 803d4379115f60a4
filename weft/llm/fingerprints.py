"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes; a chunk ends where some of its bits are zero, with more bits
before the normal size and fewer after it (normalised chunking), within a least and a largest size.
The bits depend on the last 16 bytes only, so an edit moves no chunk beyond the next boundary. The
fingerprint lists the distinct chunks as ``digest`` (eight letters of base 64 of a 48-bit hash) and
``length`` (two digits of base 36), in order of digests. Likeness of two fingerprints is containment:
the bytes of the chunks they share, over the bytes of the smaller one.

Defined cases: null text is the empty text; the fingerprint of the empty text is the empty string;
two empty fingerprints are alike by 1, an empty and another by 0. Null ids sort first; rows of one id
are ordered by the first ``HEAD`` characters of their texts, and then as they are read. Repeated rows each
get a row; an empty table gives an empty result; extra columns are ignored; very long texts are taken whole.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._common import bounded_batches, text_of

#: Sizes in bytes, and numbers of high bits that must be zero before and after the normal size.
LEAST, NORMAL, LARGEST, STRICT_BITS, LOOSE_BITS = 8, 32, 128, 6, 3
#: Bytes that the hash at a place depends on.
REACH = 16
GEAR = np.random.RandomState(20240229).randint(0, 1 << 16, 256).astype(np.uint16)
#: Characters of a text that order rows of one id, and rows for each range that the cuts are taken from.
HEAD, SAMPLE = 32, 20
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
_LENGTH = [f"{DIGITS[n // 36]}{DIGITS[n % 36]}" for n in range(LARGEST + 1)]


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the 16-bit sum of gear[b] << age over the bytes so far, by doubling windows."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        if len(h) <= step:
            break
        older = h[:-step] << np.uint16(step)
        h[step:] += older
    return h


def boundaries(data: bytes, start: int = 0) -> list[int]:
    """Ends of the chunks of ``data`` behind ``start``, itself an end or 0."""
    n = len(data)
    if n == start:
        return []
    base = max(0, start - REACH)
    h = gear_hashes(np.frombuffer(data, np.uint8, offset=base))
    loose = np.flatnonzero(h < (1 << (16 - LOOSE_BITS)))
    strict = (h[loose] < (1 << (16 - STRICT_BITS))).tolist()
    ends = []
    for at, hard in zip((loose + (base + 1)).tolist(), strict):
        while at - start > LARGEST:
            start += LARGEST
            ends.append(start)
        size = at - start
        if size >= NORMAL or hard and size >= LEAST:
            ends.append(at)
            start = at
    while n - start > LARGEST:
        start += LARGEST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks(data: bytes, ends: list[int] | None = None) -> dict[int, int]:
    """Digest -> length of the distinct chunks."""
    out, start = {}, 0
    digest = xxhash.xxh3_64_intdigest
    for end in boundaries(data) if ends is None else ends:
        out[digest(data[start:end]) >> 16] = end - start
        start = end
    return out


def show(found: dict[int, int]) -> str:
    if not found:
        return ""
    keys = sorted(found)
    coded = base64.b64encode(np.array(keys, ">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()
    return "".join([coded[8 * i : 8 * i + 8] + _LENGTH[found[k]] for i, k in enumerate(keys)])


def read(fingerprint: str) -> dict[int, int]:
    """Digest -> length, from the string."""
    rows = [fingerprint[i : i + 10] for i in range(0, len(fingerprint), 10)]
    return {int.from_bytes(base64.b64decode(r[:8]), "big"): int(r[8:], 36) for r in rows}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    return sum([a[k] for k in a.keys() & b.keys()]) / min(sum(a.values()), sum(b.values()))


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def of(text: pa.Array) -> pa.Array:
        return pa.array([show(chunks(t)) for t in text.cast(pa.binary()).to_pylist()], pa.string())

    return docs.select(F.col(id_col), of(text_of(text_col)).alias("fingerprint"))


def compare(pairs: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """Adds the likeness of two fingerprint columns; null where either is null."""

    @F.arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        rows = zip(x.to_pylist(), y.to_pylist())
        return pa.array([None if p is None or q is None else likeness(read(p), read(q)) for p, q in rows], pa.float64())

    return pairs.withColumn(name, of(F.col(a), F.col(b)))


def edited(text: str, following: str) -> tuple[str, str]:
    """The part of ``text`` that stays, and what replaces its last quarter: as much of the start of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n], following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Row:
    """A text with its chunks; they are found once, as a row of its own and as the next of another."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.data = doc_id, text, text.encode()
        self.ends = boundaries(self.data)
        self.chunks = chunks(self.data, self.ends)

    def against(self, following: _Row) -> tuple:
        head, tail = edited(self.text, following.text)
        kept = len(head.encode())
        data = self.data[:kept] + tail.encode()
        same = int(np.searchsorted(self.ends, kept, "right"))  # ends depend on what is before them only
        ends = self.ends[:same]
        ends += boundaries(data, ends[-1] if ends else 0)
        other = chunks(data, ends)
        return (
            self.doc_id, len(self.text), hashlib.sha256(data).hexdigest(), show(self.chunks), show(other),
            likeness(self.chunks, other), likeness(self.chunks, following.chunks),
        )


def _probing(batches):
    """Rows of a range in order; the row with ``closing`` is the first of the next range and gets no result."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held, out, size = None, [], 0
    for batch in batches:
        for doc_id, text, closing in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "closing"))):
            row = _Row(doc_id, text)
            if held is not None:
                out.append(held.against(row))
                size += len(held.data)
            held = None if closing else row
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out, size = [], 0
    assert held is None, "a range without its closing row"
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def edit_probe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited form, with the next text in ascending order of ids.

    Rows are cut into ranges by id, beginning of the text and number as read, at quantiles of a sample of
    at most about ``SAMPLE`` rows a range, so rows without an id, or with one id, are cut like others. A range's
    rows are brought together and sorted, so the next text is the next row and texts travel once. The
    last row of a range takes its next text from a copy of the first row of the following range (one
    row a range; behind the last range the first row of all). What the driver holds, and what is
    broadcast, has a row for each range, whose number follows that of the shuffle's partitions.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ranges = ranges or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("head", F.substring("text", 1, HEAD))
    total = docs.count()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    sample = rows.where(F.rand(7) < min(1.0, SAMPLE * ranges / total)).select("doc_id", "head", "row").toArrow()
    keys = sorted(map(_key, *(sample.column(c).to_pylist() for c in ("doc_id", "head", "row"))))
    sent = spark.sparkContext.broadcast(sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else [])

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, heads: pa.Array, numbers: pa.Array) -> pa.Array:
        cuts = sent.value
        return pa.array([bisect_right(cuts, k) for k in map(_key, ids.to_pylist(), heads.to_pylist(), numbers.to_pylist())], pa.int32())

    rows = rows.withColumn("part", range_of("doc_id", "head", "row"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "head")
    firsts = sorted(tuple(r) for r in rows.groupBy("part").agg(F.min(order).alias("at")).select("part", "at.*").collect())
    #: the first row of a range, with the range before it in a circle
    closes = [(part, known, i, head, firsts[k - 1][0]) for k, (part, known, i, head) in enumerate(firsts)]
    closes = spark.createDataFrame(closes, "part int, known boolean, id long, head string, before int").select("part", "before", F.struct("known", "id", "head").alias("at"))
    closing = (
        rows.withColumn("at", order)
        .join(F.broadcast(closes), ["part", "at"])
        .groupBy("before")
        .agg(F.min_by("text", "row").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("row"), F.lit("").alias("head"), F.col("before").alias("part"), F.lit(True).alias("closing"))
    )
    dealt = (
        rows.withColumn("closing", F.lit(False))
        .unionByName(closing)
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
        .sortWithinPartitions("part", "closing", F.col("doc_id").asc_nulls_first(), "head", "row")
    )
    return dealt.select("doc_id", "text", "closing").mapInArrow(_probing, SCHEMA)


def _key(doc_id: int | None, head: str, row: int) -> tuple:
    """The order of rows; null ids come first."""
    return doc_id is not None, doc_id or 0, head, row
