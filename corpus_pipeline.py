"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, minhash, packing, quality, toxicity
from plumbline.llm.common import Scratch, table
from plumbline.llm.queries import tokenizer

QUALITY_LEAST, TOXICITY_MOST = 0.3, 0.5


def _scored(docs: DataFrame, model, keep) -> DataFrame:
    """The rows of ``docs`` whose score ``keep`` takes, with their columns as they were."""
    column = f"_score_{uuid.uuid4().hex}"  # no input has it
    scored = quality.score(docs, model, column)
    return scored.where(keep(F.col(column))).drop(column)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is ``QUALITY_LEAST`` or more.

    A null text is scored as an empty one. Repeated rows have one score, so all stay or none. Without labels of both classes all
    stay (0.5). Ids may be null. All columns come back as they were, whatever their names; an empty table gives an empty one.
    """
    return _scored(docs, quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), lambda s: s >= QUALITY_LEAST)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is less than ``TOXICITY_MOST``.

    A null text is scored as an empty one. Repeated rows have one score. Without labels of both classes all go, as 0.5 isn't less.
    Ids may be null. All columns come back as they were; an empty table gives an empty one.
    """
    return _scored(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), lambda s: s < TOXICITY_MOST)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id.

    Documents without words, and rows without an id, stay. Rows of one id are one document: all stay or none. All columns come back
    as they were; an empty table gives an empty one.
    """
    # Most documents are kept, so the ids that go are the shorter list.
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    A null or empty text holds none. Rows without an id stay, as what is found is known by its id. If one row of an id holds an item,
    all rows of the id go. All columns come back as they were; an empty table gives an empty one.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences.

    A null or empty text is the end id alone. Each row is packed, repeated ones and those without an id too; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good),
    ("toxicity", civil),
    ("near duplicates", distinct),
    ("benchmark decontamination", uncontaminated),
    ("packing", packed),
]

#: Trained models, sampled hashes, tokenizers and greedy packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's rows are written and read again, and deleted once the next one's are written."""
    docs, scratch, last = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if last:
            scratch.drop(last)
        last = name.replace(" ", "_")
    out = STAGES[-1][1](spark, docs, sf_dir)
    scratch.drop()  # packing has written what it reads again
    return out
