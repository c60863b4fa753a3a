"""The corpus pipeline: five stages over ``documents``, each an operator of the library.

Every stage takes what its predecessor kept, as a table. Toxicity, near-duplicates and
decontamination drop documents; suffix-array deduplication shortens texts; the last stage
encodes what is left and decodes it again.

Defined results: null and empty texts are clean, hold nothing of a benchmark, lose nothing
and have no ids; as they are copies of each other, one stays. Rows without a doc_id are
never copies nor leaks, and stay; rows of one doc_id are one document, and go or stay
together. Every text is judged whole. An empty table stays empty. Columns of any name go
along unchanged, up to the last stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity
from graphloom.llm.common import drop_ids, materialise
from graphloom.sources.tables import table

#: SQL can't express the stages; the tests hold them against brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; without labels of both kinds all stay."""
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies, the document with the smallest doc_id; a text
    of fewer than five words is a copy of those with the same words only."""
    return drop_ids(docs, materialise(simhash.near_copies(docs).where("doc_id <> component_id").select("doc_id"), "copies"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that stand earlier; a character that is cut apart goes
    as a whole. No document is dropped."""
    out = suffix_dedup.deduplicate(docs, in_text=True).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; without items all stay."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return drop_ids(docs, materialise(found.select("doc_id").distinct(), "leaks"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of each text, and of what they decode to; a row for
    each row."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(docs, path, public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("decontamination", drop_leaks),
    ("byte_level_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
