"""A training corpus in five stages: every stage reads what the one before it wrote.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillflow.llm import langid, lines, neardup, packing, secrets
from quillflow.llm.common import bounded_batches, table, written
from quillflow.llm.queries import VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.4  # of the best language, below which no language is clear


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars brought up to date."""
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a clear language go. The network learns from the stage's own input;
    a missing `lang` is filled with the prediction."""
    bounded_batches(spark)
    net = langid.fit(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    known = langid.predict(docs, net)
    if net is None:  # nothing to learn from: only texts without letters go
        return known.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    clear = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return known.where(clear).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a large share of their source's documents has are taken out, also where no other line is left;
    no document goes."""
    return _documents(lines.drop_boilerplate(docs, "source", "text", protect=False))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one stays: the one with the smallest doc_id, of several under that doc_id the
    one with the least hash, of rows repeated whole the least row. Texts without words, and rows without a doc_id,
    all stay; so does a text of its own under a doc_id that another row has, too.

    Who goes is settled on narrow rows, by doc_id and hash of the text. The documents are shuffled once, by these two.
    """
    bounded_batches(spark)
    found = written(neardup.verdicts(docs).where("doc_id is not null and set_key is not null").select(
        "doc_id", "text_key", "component", "kept"), "verdicts")
    several = found.where("kept").groupBy("component").agg(
        F.min("text_key").alias("least"), F.max("text_key").alias("most")).where("least < most")
    second = found.where("kept").join(written(several, "several"), "component").where("text_key > least")
    gone = found.where("not kept").select("doc_id", "text_key").unionByName(second.select("doc_id", "text_key"))
    gone = written(gone.distinct().withColumnRenamed("text_key", "_key"), "gone")
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.select(*COLUMNS, neardup.text_key().alias("_key"), F.monotonically_increasing_id().alias("_row"))
    keyed = keyed.withColumn("_key", F.when(alone, F.col("_row")).otherwise(F.col("_key")))
    first = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("lang", "source", "n_chars", "_row"))
    rows = keyed.withColumn("_first", first).where("_first = 1")
    return rows.join(gone, ["doc_id", "_key"], "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by its kind in brackets; no document goes."""
    bounded_batches(spark)
    return _documents(secrets.scan(docs.select(*COLUMNS), redact=True))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    bounded_batches(spark)
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

# A trained network and a tokenizer are no SQL: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, name)
    return docs
