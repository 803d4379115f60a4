"""Corpus pipeline: quality, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept; the
stages but the last return the columns of ``docs``. Null texts are taken as empty, very long ones whole;
rows with a null id are judged by their texts and never dropped as copies; a quality of one half stays;
of rows alike the one with the smallest id stays, of those with equal ids the smallest text; repeated
rows are copies; an empty table passes through; extra columns stay, and columns of any name but those
read are never touched.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import ngram_join, packing, quality, token_counts, toxicity
from weft.llm._common import Scratch, materialise, remove, table, text_of

#: Near duplicates: five-word shingles and a similarity of 0.8 or more.
NEAR = ngram_join.JoinSpec(width=5, num=80)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is at least one half."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model) >= 0.5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are judged toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.severity(model)["toxic"] == 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component; documents without words or id stay.

    Rows that share an id and a component (or have no words) count as one document, and the one with
    the smallest text stays. Rows that share an id only are judged by their texts, each on its own.
    """
    found = ngram_join.row_components(docs, NEAR)
    first = F.col("doc_id") == F.col("component_id")
    kept = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("times"), F.max(first).alias("_first"))
    kept = materialise(kept.where("_first").select(F.col("doc_id").alias("_id"), "times"), "kept")
    once, more = kept.where("times = 1").select("_id"), kept.where("times > 1").select("_id")
    out = docs.join(once, docs["doc_id"] == once["_id"], "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))
    if more.isEmpty():
        return out
    repeated = docs.join(more, docs["doc_id"] == more["_id"], "left_semi")
    rows = repeated.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_at"), ngram_join.text_class(text_of("text"), NEAR).alias("_class"))
    heads = found.join(more, found["doc_id"] == more["_id"], "left_semi").where(first).select("doc_id", "class", "component").distinct()
    rows = rows.join(heads, (rows["_at"] == heads["doc_id"]) & rows["_class"].eqNullSafe(heads["class"]))
    first_of = rows.groupBy("_at", "component").agg(F.min_by("_row", text_of("_row.text")).alias("_row"))
    return out.unionByName(first_of.select("_row.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document in a bucket of token counts and a batch."""
    return packing.pack(token_counts.lengths(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]
#: The classifiers are trained here, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written besides its result, and its input, is deleted behind it."""
    docs = source = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with Scratch(spark) as steps:
            out = materialise(stage(spark, docs, sf_dir), name)
            steps.keep(out)
        if docs is not source:
            remove(docs, spark)
        docs = out
    return docs
