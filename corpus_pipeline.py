"""The corpus pipeline: stages over the documents, each written as Parquet and read again for the next.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents. Nulls, empty texts, repeated rows and extra columns are as the operators define them; rows with a null doc_id
pass the near-duplicate stage, which can't name them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, row_key, table
from quillspark.llm.decontaminate import clean_documents
from quillspark.llm.mixing import expand, mix
from quillspark.llm.ngram_join import Similarity, jaccard_components
from quillspark.llm.token_files import token_index
from quillspark.llm.toxicity import with_toxicity

#: Ids of 8 bytes that may be broadcast.
MAX_BROADCAST = 1_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    names = [f"__{n}_{len(docs.columns)}" for n in ("score", "predicted")]
    scored = with_toxicity(spark, docs, table(spark, sf_dir, "labels"), 0.3, score_column=names[0], predicted_column=names[1])
    return scored.filter(F.col(names[1]) == 0).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, that of the smallest doc_id stays; of rows that repeat a document, one. Rows of one
    doc_id with other texts are other documents."""
    scratch = Scratch(spark, "near")
    columns, key = [f"`{c}`" for c in docs.columns], f"__key_{len(docs.columns)}"
    repeated = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    unique = repeated.isEmpty()
    if unique:
        docs = docs.withColumn(key, F.col("doc_id"))
    else:
        once = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        docs = scratch.stash(docs.join(repeated, "doc_id", "left_anti").unionByName(once), "once")
        docs = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), row_key(F.col("doc_id"), F.col("text"))))
    found = jaccard_components(spark, docs.select(F.col(key).alias("doc_id"), "text"), Similarity(75, 100, words=5))
    linked = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(key), "component_id").distinct()
    if not unique:  # the smallest key isn't that of the smallest doc_id
        linked = scratch.stash(linked, "linked")
        members = linked.unionByName(linked.select(F.col("component_id").alias(key), "component_id").distinct())
        members = members.join(docs.select(key, "doc_id"), key)
        first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", key)).alias("first"))
        linked = members.join(first, "component_id").filter(F.col(key) != F.col(f"first.{key}"))
    gone = scratch.stash(linked.select(key), "gone")
    few = gone.count() <= MAX_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, key, "left_anti").select(*columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return clean_documents(spark, docs, table(spark, sf_dir, "benchmark"), window=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them; at the edge of a source's target one is cut to the word."""
    return expand(mix(spark, docs, "array(source)", (3, 1, 2), keep_columns=True))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_index(spark, docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: Kneser-Ney scoring, tokenisation and files can't be said in SQL; the tests hold the operators against brute force, and
#: the stages' decisions over a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.stash(stage(spark, docs, sf_dir), name)
        if i:  # only the last stage's table is read from here on
            scratch.drop(STAGES[i - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
