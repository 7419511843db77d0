"""The corpus pipeline: five stages from raw documents to token ids, each written before the next one reads it.

Stages take (spark, docs, sf_dir) and return a frame; all but the last return the columns of documents. Rejected
documents are gone for good. Labels come from ``labels`` in ``sf_dir``; models are trained on the stage's own input.

Defined cases, for every stage: extra columns are kept and may have any name but those beginning with ``__sw_``; an empty
table gives an empty table; whole texts count, however long. Null and empty texts go in the first stage (they have no
letter); a stage that gets them all the same scores them by the classifier's bias, holds them as equal texts of an
empty set of shingles, gives them no words in the mix, and encodes them as begin and end. Null languages, sources and
labels are not learned from; a null source is a source of its own. Null ids are documents like others and come last
where the smallest id decides. Rows that repeat id and text are judged alike, count as one in the near-dedup, and
share their copies in the mix. Ties go to the first language by name, to label 1 at a score of 0.5, and to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltwork.llm import jaccard, langid, mixing, pieces, quality
from siltwork.llm.common import saved, table
from siltwork.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language stay; texts without letters and texts that fit no language go."""
    return langid.keep_known(docs, langid.learn(docs))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good stay."""
    return quality.keep_good(docs, quality.train(quality.labelled_rows(docs, table(spark, sf_dir, "labels"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose five-word shingles link at a Jaccard similarity of 0.8 or more."""
    return jaccard.keep_first(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them; some not at all."""
    return mixing.apply_mix(docs, mixing.mix_units(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of ids and decoded text."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("quality_classifier", classify),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: Trained models, random rounding and hashes of shingles aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
