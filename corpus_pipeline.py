"""A training corpus from documents, stage by stage; each stage gets what the one before it kept.

A stage is called with (spark, docs, sf_dir); its result is written as Parquet and read as the next one's
docs. All but the last return the columns of documents. Rows are told apart by id and text, so null or
repeated ids neither get lost nor multiply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colometry.llm import bpe, jaccard, lines, mixing, quality
from colometry.llm.common import scratch, stash, table
from colometry.llm.queries import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or are more likely bad than good go. Null texts fail; repeated rows are judged alike.

    The rows come along with their counts, so no text is shuffled to meet its verdict, however many there are.
    """
    return quality.judge(spark, docs, row=COLUMNS).where("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are copies or near copies of an earlier one go; so do documents of which no word is left.

    Earlier is what has the smaller id (null last), then place. Of repeated rows each stays, or goes, alike.
    """
    own = docs.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "lang", "source").alias("_key"), "text")
    out = lines.dedup_lines(spark, own, key="_key", short=True).where(F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return out.select("_key.doc_id", F.col("kept").alias("text"), "_key.lang", "_key.source", F.length("kept").cast("bigint").alias("n_chars"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays (null last; of equal ids the smallest hash, of equal rows one). Those without words are linked with nothing and all stay."""
    own = _marked(docs).withColumn("_key", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))
    joined = jaccard.near_duplicates(spark, own, key="_key")
    kept = joined.where("_key = component_id").select("_key").distinct()
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return own.where(~wordless).join(kept, "_key", "left_semi").dropDuplicates(["_key"]).unionByName(own.where(wordless)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: at most twice. Repeated rows are taken together; without words, or rounded to no copy, a document goes."""
    own = docs.select(*COLUMNS, F.xxhash64("doc_id", "text", "source").alias("_row"))
    copies = mixing.mix(spark, own, key="_row").groupBy("_row").agg(F.max("copies").alias("copies")).where("copies > 0")
    both = own.join(copies, "_row")
    return both.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the hashes of ids and of what they decode to; one row for each row, a null text having no token."""
    return bpe.encode_texts(spark, docs.select("doc_id", "text"), vocabulary_path(), keep=("ids",))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("mix_sources", mix_sources), ("byte_bpe", byte_bpe)]

#: Sampling by hash, a fitted posterior and BPE aren't SQL; tests compare the stages with brute force, the posterior's verdict with the operator's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and what it had stashed on the way deleted, but for the last one's."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stash(spark, stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
