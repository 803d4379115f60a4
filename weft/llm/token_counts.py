"""Token counts through a digest cache.

A text is normalised, digested, and looked up by (content digest, tokenizer digest) among stored
counts. Only distinct contents without a stored count are encoded; their counts are appended to the
cache, and every row takes its count from there.

The normalisation never changes a count: runs of ASCII white space become one blank and end blanks
go, and A-Z are lower-cased only in pure ASCII texts without ``<|`` for a tokenizer that lower-cases
itself. Encoding works on pieces between ASCII white space, which no pre-token crosses: counts of the
first pieces are remembered in a bounded table, and those of a text that aren't in it are encoded as one.

Defined cases: null text counts as empty (0 tokens); very long texts are taken whole, and alone where
they exceed a group of texts; null ids stay null; repeated rows each get a row; a content stored twice
counts once; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm._common import bounded_batches, fresh_path, kept_by_worker, materialise, text_of

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("content_digest", T.StringType()),
        T.StructField("tokenizer_digest", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
#: Pieces that a worker remembers, bytes of the longest of them, and bytes of the texts that are counted together.
MEMO_ENTRIES, MEMO_KEY_BYTES, GROUP_BYTES = 300_000, 64, 1 << 20
#: A full memory is learnt anew if it lacks more than this share of so many words.
RELEARN_WORDS, RELEARN_SHARE = 1_000_000, 0.3


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer file and the library version that the counts hold for."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0" + tokenizers.__version__.encode()).hexdigest()


def splits_at_space(spec: dict) -> bool:
    """Whether no pre-token of this tokenizer crosses or holds ASCII white space."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    norm = json.dumps(spec.get("normalizer") or {})
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    return drops and " " not in pattern and r"[^\s" in pattern and not pattern.startswith("^") and "Prepend" not in norm


def lower_cases(spec: dict) -> bool:
    return any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))


class PieceCounter:
    """Counts tokens of texts; one for each Python worker and tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_piece, self.lower = splits_at_space(spec), lower_cases(spec)
        self.memo: dict[bytes, int] = {}
        self.seen = self.missed = 0

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[bytes]) -> list[int]:
        if not self.by_piece:
            return self.encode([t.decode() for t in texts])
        if self.lower:
            texts = [t.lower() if t.isascii() and b"<|" not in t else t for t in texts]
        totals, rest = [], []
        for t in texts:
            words = t.split()
            found = list(map(self.memo.get, words))
            unknown, at = [], -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                unknown.append(words[at])
            totals.append(sum(filter(None, found)))
            rest.append(unknown)
            self.seen += len(words)
            self.missed += len(unknown)
        if len(self.memo) < MEMO_ENTRIES:
            self.learn(rest)
            for k, words in enumerate(rest):
                totals[k] += sum(filter(None, map(self.memo.get, words)))
            rest = [[w for w in words if w not in self.memo] for words in rest]
        elif self.seen > RELEARN_WORDS:
            if self.missed > RELEARN_SHARE * self.seen:  # other texts than those that it has learnt from
                self.memo.clear()
            self.seen = self.missed = 0
        some = [k for k, words in enumerate(rest) if words]
        for k, n in zip(some, self.encode([b" ".join(rest[k]).decode() for k in some])):
            totals[k] += n
        return totals

    def learn(self, words: list[list[bytes]]) -> None:
        """Remembers the counts of pieces, as many as there is room for."""
        new = list({w for some in words for w in some if len(w) <= MEMO_KEY_BYTES})[: MEMO_ENTRIES - len(self.memo)]
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            self.memo.update(zip(some, self.encode([w.decode() for w in some])))


def grouped(texts: list[bytes], most: int = GROUP_BYTES):
    """Slices of a list with about ``most`` bytes each; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:]


def counter_of(path: str) -> PieceCounter:
    return kept_by_worker(f"tokens of {path}", lambda: PieceCounter(path))


def _counting(path: str):
    def run(batches):
        counter = counter_of(path)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            counts = list(chain.from_iterable(counter.count(g) for g in grouped(texts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("content_digest"), pa.array(counts, pa.int64())], ["content_digest", "n_tokens"]
            )

    return run


def _measuring(path: str, names: list[str]):
    def run(batches):
        counter = counter_of(path)
        for ids, texts in batches:
            counts = list(chain.from_iterable(counter.count(g) for g in grouped(texts.cast(pa.binary()).to_pylist())))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64())], names)

    return run


def lengths(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, length) for each row of ``docs``: its number of tokens, counted where the row is read; no text travels."""
    bounded_batches(docs.sparkSession)
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("length", T.LongType())])
    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(_measuring(tokenizer_path, out.names), out)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where nothing has been stored yet. Entries appended twice count once."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path).dropDuplicates(["content_digest", "tokenizer_digest"])


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    ``cache_path`` is a folder of stored counts to read and append to; without one a fresh cache is
    made in the shared folder. Texts travel once, to bring equal contents together; copies are first
    merged where they are read, so a content that fills a third of the table arrives once per task.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cache_path = cache_path or fresh_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    text = text_of(text_col)
    content = text
    if splits_at_space(spec):
        content = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
        if lower_cases(spec):
            plain = (F.octet_length(text) == F.char_length(text)) & ~F.contains(text, F.lit("<|"))
            content = F.when(plain, F.lower(content)).otherwise(content)
    keyed = docs.select(
        F.col(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("content_digest"), text.alias("text")
    )
    known = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    distinct = keyed.groupBy("content_digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known.select("content_digest"), "content_digest", "left_anti")
    counted = misses.mapInArrow(_counting(tokenizer_path), "content_digest string, n_tokens long")
    counted.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache_path)

    stored = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    # one row for each content here; materialised, so that Spark can split a content that very many rows share
    found = materialise(keyed.select("content_digest").distinct().join(stored, "content_digest"), "counts")
    return keyed.join(found, "content_digest", "left").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
