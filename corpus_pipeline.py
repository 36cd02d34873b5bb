"""The corpus pipeline: what a table of documents goes through to become files of token ids.

Every stage takes (spark, documents, folder of the tables) and gives a frame that is written as Parquet and read again before the next one begins, so a lost executor costs no more than the stage it works on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import decontaminate, mixing, near_dup, quality, token_files
from panelforge.llm.common import Scratch, table

STAGES = [
    ("quality rules", quality.stage),
    ("MinHash near-dedup", near_dup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources to target weights", mixing.stage),
    ("token-ID output", token_files.stage),
]

#: Perplexity, entropy balancing and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
