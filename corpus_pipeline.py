"""Documents to token ids: quality, boilerplate lines, near duplicates, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of documents. `run` writes each stage as Parquet into the shared folder, rereads it, and leaves the folder to be deleted
when the application ends.

In every stage a null text counts as empty, repeated rows and ids stay rows of their own unless the stage says otherwise,
any column may be null, and an empty table gives an empty one.
"""

from __future__ import annotations

from ledgerloom.llm.bpe import bpe_encode
from ledgerloom.llm.common import scratch, table
from ledgerloom.llm.line_dedup import line_dedup
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.quality import fit, score_quality
from ledgerloom.llm.simhash import drop_near_duplicates
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; the model is fitted to labels of these documents.

    Rows that repeat an id are scored each by its own text. Without labels of both classes the share of label 1 decides
    for all alike.
    """
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels"))).filter("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the boilerplate lines of its source; copies, which later stages drop, count as one page.

    A document that was boilerplate only stays as an empty text; a null source is a source.
    """
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near duplicates.

    Texts without words and documents without id stay; rows that repeat an id share its fate.
    """
    return drop_near_duplicates(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times; texts without words are in no mix."""
    return mix(docs).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    return bpe_encode(docs)


STAGES = [("quality", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixture", mixture), ("BPE", encode)]

#: SQL expresses neither the classifier nor the near duplicates; tests/llm holds the whole result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
