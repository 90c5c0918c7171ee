"""Preparation of a training corpus: each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontaminate, linededup, neardup, quality
from sparkloom.llm._common import remove, scratch, shared_dir, table


#: Holds, during a stage, the columns that it doesn't read: a stage that adds a column of that name doesn't touch them.
OTHERS = "columns_of_the_document"


def held(docs: DataFrame) -> DataFrame:
    """doc_id, text and lang, with all other columns in one."""
    used = [c for c in docs.columns if c in ("doc_id", "text", "lang")]
    rest = [F.col(c) for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*rest, F.lit(0).alias(OTHERS)).alias(OTHERS))


def released(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from what a stage made of held(docs)."""
    return out.select(*[F.col(c) if c in ("doc_id", "text", "lang") else F.col(OTHERS)[c].alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. References come from the documents at hand. A null text counts as empty and goes, with all under
    20 words; repeated rows are judged each; an empty table gives no rows; all columns of a document stay as they are."""
    return released(quality.judge(held(docs)).where("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a later document holds; n_chars follows the text. A null text becomes empty; rows with one id
    count as one document; an empty table gives no rows; all other columns stay as they are."""
    out = released(linededup.dedup_lines(held(docs)), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group. Documents with a null or empty text all stay; of rows repeated whole one stays; an
    empty table gives no rows; all columns stay as they are."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated. A null or empty text is clean; repeated rows are judged each; an empty table gives no rows; all
    columns stay as they are."""
    found = decontaminate.find_contamination(held(docs), table(spark, sf_dir, "benchmark"))
    return released(found.where(~F.col("contaminated")), docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document; encode() gives the ids themselves. A null text has no tokens; repeated rows are encoded each."""
    return bpe.op6(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("byte-level BPE", byte_bpe)]

#: Sampling, histograms and BPE are not expressible in SQL; tests hold each stage's operator against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. A stage's own folders are removed once its rows are written, and its rows once the next stage's are."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
