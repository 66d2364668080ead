"""The corpus pipeline: language ID, MinHash near-dedup, suffix-array dedup, PII masking, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of ``documents``. Nulls, empty tables and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparrowmill.llm import common, language, near_dup, packing, pii, suffix_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letters, or the two nearest codewords too close.

    Without any labelled row to learn from nothing can be judged, and all documents stay.
    """
    model = language.train(docs.where(~language.held_out()).select("doc_id", "text", "lang"))
    if not model["names"]:
        return docs
    names = common.fresh(docs.columns, "lang_pred", "lang_score", "lang_ambiguous")
    judged = language.predict(docs, model, tuple(names))
    return judged.where((F.col(names[0]) != "und") & ~F.col(names[2])).drop(*names)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group with five-word shingle similarity of 0.8 or more."""
    return near_dup.keep_one(docs, words=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 100 bytes or more that start earlier in the documents kept so far."""
    return suffix_dedup.remove_repeats(docs)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.mask_pii(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens."""
    return packing.best_fit_packing(docs, "word_bpe_49k.json", 0, 2048)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("PII", pii_masking),
    ("best-fit packing", best_fit_packing),
]

#: Language classifiers and near-duplicate search cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        start = common.made(spark)
        docs = common.stash(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        # what the stage wrote on its way, and its input, are of no use any more
        common.sweep(spark, start, common.made(spark) - 1)
        if before is not None:
            common.sweep(spark, before, before + 1)
        before = common.made(spark) - 1
    return STAGES[-1][1](spark, docs, sf_dir)
