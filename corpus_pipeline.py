"""Training text from raw documents, in five stages.

Each stage is one operator of ``pagelake.llm`` over all that the stage before it kept; what it decides takes effect. Every
stage's rows are written as Parquet to the shared folder and read again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import release, remove, scope, stored, table
from pagelake.llm.decontamination import decontaminate
from pagelake.llm.near_dedup import deduplicate
from pagelake.llm.packing import pack
from pagelake.llm.substring_dedup import cut_repeats
from pagelake.llm.toxicity import reject


#: Tables that the operator of an earlier stage stored, and that nothing needs once that stage's result is written and read again.
_spent: list[str] = []


def stage(decide: Callable) -> Callable:
    """A stage that first removes what earlier ones stored, unless its own input still reads it."""

    @functools.wraps(decide)
    def out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = [f.removeprefix("file://") for f in docs.inputFiles()]
        done = [p for p in _spent if not any(p.removeprefix("file:").lstrip("/") in f for f in read)]
        remove(spark, done)
        _spent[:] = [p for p in _spent if p not in done]
        with scope() as paths:
            result = decide(spark, docs, sf_dir)
        _spent.extend(paths)
        return result

    return out


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null and empty texts have no evidence and stay; rows of one id are judged each; an empty table stays empty."""
    return reject(docs, table(spark, sf_dir, "labels"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the least id. Null and empty texts are one class; repeated rows are one document; rows without an id stay."""
    return deduplicate(docs)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat earlier documents' are cut from the texts; every document stays, with null and empty texts as they are."""
    out = cut_repeats(docs)
    return out.withColumn("n_chars", F.when(F.size(out.columns[-1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null, empty and short texts hold none, and rows without an id stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in training sequences; a null or empty text is a piece of one token."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: A field fitted by gradient steps, sketches and a tokenizer can't be said in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's rows go when the next one's are written; the last one's input stays for the result."""
    docs = table(spark, sf_dir, "documents")
    for name, decide in STAGES[:-1]:
        before, docs = docs, stored(decide(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(before, "_stored_at"):
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
