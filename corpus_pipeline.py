"""The corpus pipeline: quality rules, line dedup, SimHash near-duplicates,
decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it
keeps, with the columns of ``docs``; the last returns the packed pieces.
``run`` writes every stage as Parquet under the shared checkpoint folder and
reads it back for the next.

Nulls, empty tables and repeated rows: a document with a NULL text has no words
and is rejected by the quality rules; repeated rows are copies, of which one
stays after the near-duplicate stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoofscope.llm import decontaminate, lines, packing, quality, simhash
from spoofscope.llm.common import fresh, only, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    labels = table(spark, sf_dir, "labels")
    cutoffs = staged(quality.certified(quality.counted(docs.select("doc_id", "lang", "text")).drop("text"), labels))
    judged = quality.judged(quality.counted(docs), cutoffs)
    verdict = fresh(docs.columns, "verdict")
    return (judged.select(*docs.columns, only(F.lit(True), F.col("kept")).alias(verdict))
            .filter(F.col(verdict).isNotNull()).select(*docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of repeated three-line windows."""
    cleaned = lines.without_repeated_lines(docs).select(*docs.columns)
    return _counted(cleaned)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the smallest id, and
    of several rows with that id the first by a hash of its text."""
    rid, group = (fresh(docs.columns, n) for n in ("rid", "component_id"))
    rows = staged(docs.withColumn(rid, F.monotonically_increasing_id()))
    groups = simhash.near_duplicates(rows, doc_id=rid).select(F.col("doc_id").alias(rid), F.col("component_id").alias(group))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col(rid))
    best = (rows.select(rid, order.alias("place")).join(groups, rid).groupBy(group).agg(F.min("place").alias("place"))
            .select(F.col("place")[rid].alias(rid)))
    return rows.join(best, rid, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of the benchmark."""
    cleaned = decontaminate.passages(docs, table(spark, sf_dir, "benchmark"), clean=True).select(*docs.columns)
    return _counted(cleaned)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    return packing.packed(packing.pieces(docs))


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("packing", pack)]

#: Fingerprints, the suffix search and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return staged(STAGES[-1][1](spark, docs, sf_dir))


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
