"""The operators as queries over the given tables: each gives the digest columns that are compared.

The general operators live in the other modules; the functions here apply them to whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import DEFAULTS
from . import ans, bpe, chat, fingerprints, langid, lines, manifest, neardup, packing, secrets, spelling, topk, toxicity
from .common import bounded_batches, scratch_dir, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", DEFAULTS["spark.sql.session.timeZone"])
            bounded_batches(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query("op1_secrets")
def _secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digests(table(spark, sf, "documents"))


@query("op2_bpe")
def _bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), VOCABULARY)


@query("op3_neardup")
def _neardup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"))


@query("op4_packing")
def _packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), VOCABULARY)


@query("op5_lines", lines.ORACLE)
def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.page_lines(table(spark, sf, "pages"))


@query("op6_langid")
def _langid(spark: SparkSession, sf: str) -> DataFrame:
    return langid.digests(table(spark, sf, "documents"))


@query("op7_fingerprints")
def _fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf, "documents"), 4 * parts(spark))


@query("op8_ans")
def _ans(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_dir(spark, "token-ids")
    ans.write(table(spark, sf, "documents"), VOCABULARY, folder)
    return ans.digests(spark, folder)


@query("op9_chat")
def _chat(spark: SparkSession, sf: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))


@query("op10_topk")
def _topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.digests(table(spark, sf, "embeddings"))


@query("op11_spelling")
def _spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.digests(table(spark, sf, "documents"))


@query("op12_manifest", manifest.ORACLE)
def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.digests(table(spark, sf, "documents"))


@query("op13_toxicity")
def _toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.digests(table(spark, sf, "documents"), table(spark, sf, "labels"))
