"""The corpus pipeline: language identification, line deduplication, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows to the shared folder and
reads them again for the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.langid import UNKNOWN, identify
from larkspur.llm.lines import deduplicate
from larkspur.llm.packing import pack
from larkspur.llm.shingles import similar_documents
from larkspur.sources.shared import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those whose text is null or without a letter go; ``lang`` becomes the predicted one.

    The model learns from the labelled rows outside the held-out fold. If there are none, nothing can be told and all go. Equal rows
    get the same language; texts of any length count whole; an empty table gives no rows.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(2))
    said = identify(docs.select(*COLUMNS), fold != 2).where(F.col("lang_pred") != UNKNOWN)
    return said.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat (within two edits) a line of an earlier document or place.

    ``n_chars`` follows the text; null texts stay null, texts all of whose lines go become empty. Lines of fewer than 24 characters all stay.
    Rows without a doc_id, or of one doc_id, with different texts are different documents; equal rows get the same text. An empty
    table gives no rows.
    """
    return deduplicate(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Documents link if the sets of their shingles of five words have a Jaccard similarity of 0.8 or more. SimHash fingerprints of
    those shingles give candidates; bands of minimum hashes give those that fingerprints miss; all are verified. Rows with one doc_id count as copies of each other: of its texts that no smaller doc_id is linked to the
    one with the least MD5 stays, of equal rows the one with the least lang, source and n_chars (nulls first). Rows
    without a doc_id cannot be named and all stay. An empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    digest = F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")
    found = similar_documents(docs, width=5, least=0.8, text_md5=True)
    heads = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_md5").alias("text_md5"))
    kept = docs.select("*", digest).join(heads, ["doc_id", "text_md5"]).groupBy("doc_id", "text_md5")
    first = kept.agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("row"))
    return first.select("doc_id", "row.*").select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens for every document (see ``larkspur.llm.packing``).

    Null and empty texts are one end id; rows are packed each on its own, also equal ones and those without a doc_id. An empty table gives no rows.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near", near), ("packing", packing)]

#: SQL cannot express the stages (a fitted classifier, edit distance classes, components, a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
