"""A training corpus from raw documents: five stages, each an operator of keystrand.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents.

Edge cases, for every stage: a null text counts as empty, so the first stage rejects
it; rows that repeat an id are judged each by its own text, but are one node among near
duplicates, of which all stay or go; of a group of near duplicates the smallest id
stays; null ids are never duplicates of others; a text of any length is taken whole;
columns besides doc_id, text and n_chars, whatever their names, pass through; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.llm import _scratch, decontaminate, mixing, ngram_join, quality, queries, token_store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail them; n_chars is counted anew."""
    return quality.filter_documents(docs, clean_lines=True).withColumn("n_chars", F.length("text").cast("long"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Word shingles take five words here and link at a similarity of 0.8.
    """
    return ngram_join.deduplicate(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.remove(docs, queries.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say, clean ones once."""
    return mixing.draw(docs, queries.table(spark, sf_dir, "labels"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of what is left, as read back from its files."""
    return token_store.round_trip(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
    ("token-ID output", token_ids),
]

#: Shingle components and posteriors have no SQL form; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _scratch.write(docs, "stage")
            if before is not None:
                _scratch.drop(before)  # each stage reads its predecessor only
            before = docs
    return docs
