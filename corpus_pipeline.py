"""From raw documents to packed token windows: five stages, each one operator of flowledger.llm.

Every stage takes the documents that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowledger.llm import common, jaccard, langid, lines, packing, suffix
from flowledger.llm.queries import tokenizer


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the present text."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents take the predicted language (``und`` if there was nothing to learn from); those without a letter go."""
    found = langid.annotate(docs, langid.fit(docs))
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) | F.col("text").rlike(r"\p{L}"))
    return _documents(kept.withColumn("lang", F.col("lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a source of any size repeats on too many documents go; a document of such lines only stays as it is.

    Copies that make up a large share of a source consist of listed lines: the next stage keeps one of them.
    """
    found = lines.drop_boilerplate(docs.withColumn("whole", F.col("text")))
    nothing_left = (F.col("lines_dropped") > 0) & (F.trim(F.translate("text", "\n", " ")) == "")
    return _documents(found.withColumn("text", F.when(nothing_left, F.col("whole")).otherwise(F.col("text"))))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of smallest id (rows of one id stay or go together)."""
    gone = jaccard.jaccard_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return _documents(docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes that start earlier elsewhere go; documents stay, unless nothing is left."""
    cut = suffix.remove_repeats(docs, as_text=True)
    changed = F.size("removed_spans") > 0
    rest = cut.where(~changed | (F.trim("kept_text") != ""))
    return _documents(rest.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows; a row a piece."""
    pieces = packing.pack(docs, tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("packing", packed),
]

#: Language ID, suffix arrays and the tokenizer can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each kept is checkpointed in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.checkpoint(docs)
    return docs
