"""One query for each operator, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .decontamination import SQL as SQL_1


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contained

    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), to, _tokenizer("word_bpe_49k.json"))
    return read_token_files(spark, to)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import cut_repeats

    out = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("cuts").cast("long").alias("n_cut"), "cuts", "text")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_classes

    return near_classes(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_token_files, op4_packing, op5_substring_dedup, op6_near_dedup, op7_quality, op8_token_counts, op9_fingerprints, op10_main_text)}

#: The others can't be said in SQL; tests hold them against a library, brute force, a round trip or held-out rows.
ORACLE_SQL = {"op1_decontamination": SQL_1}
