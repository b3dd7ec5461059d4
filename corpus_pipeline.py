"""From raw documents to token-ID shards: five stages, each over all that the one before kept.

Defined results: null and empty texts are clean, copies of nothing, of size 0
and end as a document of the end id alone; a null source is a source; a null id
sorts first; rows that repeat an id are judged each by their own text; further
columns pass through unchanged, whatever their names, up to the last stage; an
empty table gives no rows. Each stage's table stays below the shared folder,
since the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quintet.llm import common, decontaminate, mixing, neardup, tokenids, toxicity

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity.stage),
    ("near_dedup", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("token_ids", tokenids.stage),
]

#: A trained model and BPE ids are beyond SQL; tests/llm hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet in the shared folder and reread."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = common.fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
