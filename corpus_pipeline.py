"""The corpus pipeline: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table, unused
from tessera.llm.decontam import decontaminate
from tessera.llm.mixing import mixed
from tessera.llm.similar import one_of_each
from tessera.llm.tokens import tokenize
from tessera.llm.toxicity import THRESHOLD, fit_on_tables, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    prefix = unused(docs)
    model = fit_on_tables(spark, docs.select("doc_id", "text"), sf_dir)
    return score(docs, model, prefix).where(F.col(f"{prefix}toxic_score") < THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    prefix = unused(docs)
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), prefix)
    return found.where(F.col(f"{prefix}item_id").isNull()).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file of the mix, read back."""
    return tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]
#: Fitted models, similarity search and token ids have no form in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
