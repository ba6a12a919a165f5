"""The corpus pipeline: toxicity, exact dedup, near-dedup, substring dedup, packing.

Each stage takes documents and returns documents with the same columns, whatever
they are beside doc_id, text and n_chars, but for the last, which returns packed
pieces. A stage's result is written as Parquet and read again by the next.

Defined cases: those of the stages' operators. A null text stays null unless a
stage drops its row; rows that share doc_id and text share their fate; a text of
which substring dedup leaves nothing stays as an empty one; labels are needed
only to learn from, so a document without one is scored like all others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacell.llm.common import ascii_lower, shared_dir
from stratacell.llm.exact_dedup import exact_dedup
from stratacell.llm.near_dedup import near_classes, with_node
from stratacell.llm.packing import packed
from stratacell.llm.substring_dedup import substring_dedup
from stratacell.llm.toxicity import learned, scored


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def without(docs: DataFrame, dropped: DataFrame, key: Column | str) -> DataFrame:
    """docs less the rows whose doc_id and key are in dropped (dropped_id, dropped_key)."""
    key = F.col(key) if isinstance(key, str) else key
    return docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("dropped_id")) & key.eqNullSafe(F.col("dropped_key")), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    score = fresh(docs, "score")
    net = learned(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, net, score).filter(F.col(score) < 0.5).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    dropped = exact_dedup(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("dropped_id"), F.col("text_sha256").alias("dropped_key"))
    return without(docs, dropped, F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays."""
    node = fresh(docs, "node")
    dropped = near_classes(docs).filter(~F.coalesce("kept", F.lit(True))).select(F.col("doc_id").alias("dropped_id"), F.col("node").alias("dropped_key"))
    return without(with_node(docs, node), dropped, node).drop(node)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a text that loses nothing stays as it is."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    schema = docs.select("doc_id", "text", *carry).schema

    def finish(table: pa.Table, kept: list[bytes], sizes: np.ndarray, removed: np.ndarray) -> pa.Table:
        texts = [k.decode("utf-8") if n else old for k, n, old in zip(kept, removed, table.column("text").to_pylist(), strict=True)]
        table = table.set_column(table.column_names.index("text"), "text", pa.array(texts, pa.string()))
        if "n_chars" in table.column_names and pa.types.is_integer(table.schema.field("n_chars").type):
            counts = [len(t) if n else old for t, n, old in zip(texts, removed, table.column("n_chars").to_pylist(), strict=True)]
            table = table.set_column(table.column_names.index("n_chars"), "n_chars", pa.array(counts, table.schema.field("n_chars").type))
        return table

    return substring_dedup(docs, finish, schema, carry).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("substring_dedup", substring),
    ("packing", packing),
]

#: SQL can't express the network, the sketches and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder, on whichever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of the written tables only the one that they are read from stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                removed(spark, f"{folder}/{k - 1}")
    return docs
