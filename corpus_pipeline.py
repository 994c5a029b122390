"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's
rows as Parquet in the shared folder and reads them again as the next one's documents.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waywright.llm import bpe, mixing, neardup, queries, secrets, toxicity
from waywright.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model, trained on the labelled ones among them, predicts toxic go.

    Null and empty texts have no evidence and stay, unless labels say that most such documents
    are toxic; repeated rows are judged alike; rows without an id are judged, but teach
    nothing.  Columns may have any name.  An empty table stays empty.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    packed = docs.select(F.struct("*").alias("row"), "text")  # whatever the columns are named
    return toxicity.score(packed, model, keep=("row",)).filter("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id.

    Rows that repeat one another in every column count once.  Rows of one id with different
    texts are documents of their own; where they are in one group, the row with the smallest
    hash of all its columns stays.  Null and empty texts are like nothing and stay, as do rows
    without an id.  An empty table stays empty.
    """
    tag = F.xxhash64(*docs.columns)
    found = neardup.near_duplicates(docs, width=5, percent=80, tag=tag).filter("kept and doc_id is not null")
    alone = F.when(F.col("vertex").isNull(), F.col("tag"))  # empty sets have no copies but repeated rows
    kept = found.groupBy("doc_id", "vertex", alone.alias("alone")).agg(F.min("tag").alias("_tag")).select(F.col("doc_id").alias("_id"), "_tag").distinct()
    tagged = docs.filter("doc_id is not null").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), tag.alias("_tag"))
    named = tagged.join(kept, ["_id", "_tag"], "left_semi").dropDuplicates(["_id", "_tag"]).select("row.*")
    return named.unionByName(docs.filter("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and n_chars follows the text.

    Null and empty texts, other columns and repeated rows stay as they are.  An empty table stays empty.
    """
    clean = secrets.redact(docs, secrets.calibrate(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to the tree's weights: nine tenths of the tokens, no document twice.

    Null languages and sources are names of their own; null and empty texts hold no tokens and
    are taken with the prefix that passes them; rows that repeat an id and text are taken or
    left together.  Ties of the order go by id.  An empty table stays empty.
    """
    levels = queries.mixing_levels()
    leaves = mixing.plan(docs, levels, queries.mixing_weights(), share=(9, 10), max_epochs=1, seed=5)
    return mixing.apply_plan(docs, leaves, levels, seed=5).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the hashes of ids and of the text decoded from them.

    A null text is an empty one; repeated rows give repeated rows; an empty table gives no rows.
    """
    return bpe.encode_documents(docs, queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: Signatures, training and encoding are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
