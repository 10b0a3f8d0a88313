"""A corpus cleaned in stages, each of which calls one training-data operator.

Every stage works on all rows its predecessor kept.  All but the last return
the columns of ``documents``; the last returns what ``op2_bpe`` returns.

In every stage null texts count as empty, whole texts are read however long they
are, rows that repeat are treated alike, and an empty table gives an empty result.
Columns besides doc_id and text are passed on, whatever their names.  Rows with a
null id stay unless their text rejects them: exact dedup keeps one of them only
where no equal text has an id, SimHash can't name them and keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keytide.llm import bpe, common, decontaminate, exact_dedup, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, accepts;
    without labels of both kinds, all."""
    return toxicity.keep_clean(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest id; of rows
    that tie on it, one."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the least id; rows that tie on
    it all stay."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; with an empty benchmark, all."""
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, bpe.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: No SQL: a brute-force version is in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stash(docs, f"stage{k}")
    return docs
