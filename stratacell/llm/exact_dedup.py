"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut into chunks where its own content says so (after a line break or
a sentence end beyond a least length). Chunks are deduplicated to verified
identifiers: a chunk's 64-bit hash, with a variant number for chunks that share
a hash but differ in content. A document becomes the ordered list of its
chunks' identifiers, its recipe, and equal recipes mean equal texts. Chunk text
is moved once, in pieces of bounded size, to verify the identifiers; long
documents themselves are never shuffled.

Defined cases: a null text counts as empty, and all empty texts are equal; rows
that share text and doc_id are one document and share its verdict; a null
doc_id ranks below all others; of an empty table an empty result follows; all
columns but doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacell.llm.common import ascii_lower, cut

#: Least and most code points of a chunk; it ends after the first line break or sentence end between them.
LEAST, MOST = 1024, 8192


def chunk_pattern(least: int, most: int) -> str:
    return rf"(?s).{{{least},{most}}}?(?:\n|[.!?] )|.{{1,{most + 2}}}"


def exact_dedup(docs: DataFrame, least: int = LEAST, most: int = MOST, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks of every row of docs; hashed can be a weaker hash, for tests."""
    texts = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    chunked = texts.withColumn("chunks", F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0)))
    pieces = chunked.select(F.explode("chunks").alias("chunk")).select(hashed(F.col("chunk")).alias("h"), "chunk")
    distinct = pieces.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n"))
    clashing = cut(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1").select("h"))
    recipes = chunked.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "chunks")
    if clashing.isEmpty():  # every hash stands for one chunk: it is a verified identifier
        recipe = F.transform("chunks", lambda c: F.struct(hashed(c).alias("h"), F.lit(1).alias("variant")))
        recipes = recipes.select("doc_id", "text_sha256", recipe.alias("recipe"))
    else:
        recipes = _with_variants(recipes, distinct, clashing, hashed)
    recipes = cut(recipes)
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    # Both sides are plain scans, so adaptive execution splits the partition of a group that holds many rows.
    joined = recipes.join(cut(groups).withColumnRenamed("recipe", "same"), F.col("recipe") == F.col("same"), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"),
    )


def _with_variants(recipes: DataFrame, distinct: DataFrame, clashing: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """Recipes whose clashing hashes carry the rank of the chunk among those that share the hash."""
    ranked = distinct.join(clashing, "h", "left_semi").select("h", "chunk", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).alias("variant"))
    rows = recipes.select("doc_id", "text_sha256", F.monotonically_increasing_id().alias("row"), "chunks")
    rows = cut(rows)
    each = rows.select("row", F.posexplode("chunks").alias("at", "chunk")).withColumn("h", hashed(F.col("chunk")))
    each = each.join(ranked, ["h", "chunk"], "left").select("row", F.struct("at", "h", F.coalesce("variant", F.lit(1)).alias("variant")).alias("id"))
    lists = each.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("id")), lambda x: F.struct(x["h"].alias("h"), x["variant"].alias("variant"))).alias("recipe"))
    empty = F.array().cast("array<struct<h:bigint,variant:int>>")
    return rows.join(lists, "row", "left").select("doc_id", "text_sha256", F.coalesce("recipe", empty).alias("recipe"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_chunks")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
