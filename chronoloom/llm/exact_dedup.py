"""Exact deduplication on a 128-bit content hash, with bytes compared inside groups. [native]

Nulls: a null text counts as empty; a row with null id counts in its group but is the kept row only where
no row of the group has an id (then all such rows are kept, as nothing else would hold the text). Empty
texts form one group. Rows repeated with the same id and text are all flagged like that id. An empty table
gives an empty result. A very long text is a value like any other. Other columns of the input are not read, whatever their
names; the id and text columns are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=F.md5) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Groups are formed on (hash, bytes): the aggregation compares the text itself after the hash, so two
    texts that collide are two groups. It combines before it shuffles, so of a group of copies each task
    sends one. A group is then brought to its members by the hash and the SHA-256 that is reported anyway;
    members travel without their text. Should two different texts agree in both, the query fails loudly.
    ``content_hash`` maps a string column to a hash and is a parameter so that tests can make it collide.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    groups = (
        rows.groupBy(content_hash("_t").alias("_h"), "_t")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_h", F.sha2("_t", 256).alias("text_sha256"), "keep_id", "group_size")
        .groupBy("_h", "text_sha256")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        .withColumn("group_size", F.when(F.col("_n") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts agree in both content hashes")).cast("long")))
        .drop("_n")
    )
    members = rows.select("doc_id", content_hash("_t").alias("_h"), F.sha2("_t", 256).alias("text_sha256"))
    return members.join(groups, ["_h", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )
