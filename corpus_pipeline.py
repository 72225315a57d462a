"""Documents to training tokens: the stages in order, each over all rows that its predecessor kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; ``run`` writes a
stage's result in the shared folder and gives it to the next, so a lost executor repeats one stage at most, and removes
what earlier stages have left there.

Edge cases: a null text counts as empty and passes all stages; a null id or source is a value like any other; rows that are
equal in id and text are one after the near-copy stage; an empty table gives an empty result of the same columns; texts are
used whole. The stages expect the columns of documents and read no others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, line_dedup, mixing, near_copies, toxicity
from tidemark.llm.common import settled, table
from tidemark.sources.shared import remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects; it learns from labels of this table's rows."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines; n_chars follows the text."""
    cleaned = line_dedup.drop_boilerplate(docs)
    return cleaned.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_copies.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether the ids decode to the text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode_and_decode(docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")), path)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: No SQL: the stages learn from labels, hash with XXH64 and encode with a vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        remove(spark, before)
        before = docs.inputFiles() and [docs.inputFiles()[0].rpartition("/")[0]]
    return STAGES[-1][1](spark, docs, sf_dir)
