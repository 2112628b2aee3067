"""The training-data pipeline: language ID, line dedup, near duplicates, pseudonyms, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common
from tessera.llm.langid import language_stage
from tessera.llm.line_dedup import line_stage
from tessera.llm.ngram_join import near_duplicate_stage
from tessera.llm.packing import best_fit_packing
from tessera.llm.pii import pii_stage


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is packed: a row for each of its pieces; null and empty texts are one piece of one id, repeated rows are packed each, no rows give none."""
    return best_fit_packing(docs)


#: Each stage takes (spark, docs, sf_dir); its result is written and read again for the next one.
STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("pii_pseudonyms", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier, the tokenizer and the keyed permutations have no SQL; tests/llm/ hold the stages' operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
