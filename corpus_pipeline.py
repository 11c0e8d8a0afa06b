"""From raw documents to shards for training, stage by stage.

Each stage takes (spark, docs, sf_dir), calls one operator on all rows that its
predecessor kept, and returns a DataFrame; its decisions take effect. All but
the last return the columns of documents, each row whole, and handle an empty
table. SQL can express none of the first stages, so ORACLE_SQL is None and the
tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm import decontaminate, minhash, mixing, sharding, toxicity
from prosemill.llm.common import stage, table

#: The score from which the toxicity stage rejects a document.
REJECT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score REJECT or more. Labels teach the model; a document's own label doesn't decide.

    Null and empty texts score as a text without any feature, and stay. Very
    long texts are scored whole, repeated rows go or stay together, and extra
    columns stay, whatever their names. Without labels nothing goes.
    """
    return toxicity.clean(docs, toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels"))), REJECT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id.

    Null texts all stay; of empty texts, of texts without a word and of
    repeated rows one stays. Extra columns stay, whatever their names.
    """
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of ten words of a benchmark item.

    Null and empty texts stay, very long ones are scanned whole, repeated rows
    go or stay together, and extra columns stay, whatever their names.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source. Null and empty texts have no words and get the
    whole copies of their source; repeated rows get the same copies each. Extra
    columns stay, whatever their names.
    """
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With its shard, 0 to 7; equal texts share one.

    Each null text is a group of its own. An extra column named shard stays as
    shard_before, others as they are.
    """
    return sharding.sharded(docs, 8)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
