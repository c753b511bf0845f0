"""A corpus pipeline of four training-data operators over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents: the quality classifier drops what it
rejects, exact dedup keeps the owner of each text, the n-gram Jaccard join keeps the document of least doc_id
of each component, and best-fit packing returns the pieces with their sequences.

Defined results: a null text counts as empty in every stage and stays null in the rows that are kept; empty texts
are scored like any other and are copies of one another; rows with a null doc_id are scored and packed, lose to any
other id among copies, and are never near copies; repeated rows are copies, of which exact dedup keeps one; ties go
to the smallest doc_id; texts are read whole, however long; an empty table gives no pieces; extra columns, null ones
and any names included, come through all stages but the last, which returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folio.llm import common, exact_dedup, jaccard, packing, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Scratch tables of each stage's latest call: the next stage begins when that stage's result is written.
_left: dict[int, list[str]] = {}


def _stage(k: int, work: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, _left.pop(k - 1, []))
        common.collect_garbage(spark)  # what the stages before have left in the driver
        before = set(common.made())
        out = work(spark, docs, sf_dir)
        _left[k] = [path for path in common.made() if path not in before]
        return out

    return run_stage


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), common.crc_mod("doc_id", 3) != 1)
    return quality.keep_good(docs, model)


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.near_dedup(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    (name, _stage(k, work))
    for k, (name, work) in enumerate([("quality classifier", _quality), ("exact dedup", _exact), ("n-gram Jaccard join", _near), ("best-fit packing", _pack)])
]

#: Shingles, classifier scores and token ids are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each but the last written and read again."""
    docs, written = common.table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialize(docs, "stage")
            written.append(common.made()[-1])
            common.release(spark, written[:-1])
            del written[:-1]
    return docs
