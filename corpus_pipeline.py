"""A corpus made ready for training: toxic documents, texts without a language, near duplicates and benchmark passages go, and the
rest is packed into sequences. Every stage reads what the one before kept, as a written table.

Defined results of all stages: columns beside doc_id, text and lang pass through, whatever their names; rows that repeat a doc_id are judged each by
their own text; a null doc_id is kept where its text is; an empty table gives an empty one. Labels are learned from rows outside of the held-out
remainder of each operator only; a null text has no toxic term, no language, no shingle and no word, so the second stage drops it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, jaccard, language, packing, toxicity
from codeloom.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below 0.3 by a lexicon learned from the labels of docs; without labels, by the base lexicon."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; ``und`` ones (null, empty, or without a letter) go; without a known lang in docs, all do."""
    return language.known(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles; rows equal
    in id and text once, rows without an id all."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which less than a twentieth of the words lie in benchmark windows; without items, all."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; a null text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned scores and packing have no SQL form; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
