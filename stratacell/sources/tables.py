"""Readers and writers of tables, with declared schemas; no schema is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, MapType, StringType, StructField, StructType, ArrayType

CELL = StructType(
    [StructField("value", StringType()), StructField("not_reported", BooleanType()), StructField("unresolved", BooleanType()), StructField("evidence", StringType()), StructField("note", StringType())]
)
ENTITY = StructType(
    [
        StructField("id", StringType()), StructField("name", StringType()), StructField("papers", ArrayType(StringType())), StructField("aliases", ArrayType(StringType())),
        StructField("urls", MapType(StringType(), StringType())), StructField("coding", MapType(StringType(), CELL)),
    ]
)


def read_entities(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested records from a JSON array or from JSON lines. A cell's value may be a string, number or list; it is kept as text."""
    return spark.read.schema(ENTITY).option("multiLine", not lines).json(path)


def exploded_cells(entities: DataFrame, dimensions: DataFrame) -> DataFrame:
    """One row an entity and declared dimension (key, ord); a cell that the record lacks has nulls. The dimensions are a schema, so few."""
    return entities.select("id", "coding").crossJoin(F.broadcast(dimensions)).select("id", "key", "ord", F.try_element_at("coding", F.col("key")).alias("cell")).select("id", "key", "ord", "cell.*")


def unknown_dimensions(entities: DataFrame, dimensions: DataFrame) -> DataFrame:
    return entities.select("id", F.explode(F.map_keys("coding")).alias("key")).join(F.broadcast(dimensions.select("key")), "key", "left_anti")


def nested(cells: DataFrame) -> DataFrame:
    """Cells back to one record an entity."""
    return cells.filter("value IS NOT NULL OR not_reported OR unresolved").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("value", "not_reported", "unresolved", "evidence", "note")))).alias("coding"))


def read_csv_text(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with all columns as text; an empty field stays empty, and a byte order mark goes."""
    df = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "").option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns]).na.fill("")  # the reader has null for an empty field
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns that are missing: {missing}")
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by the suffix of its path; CSV as text."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in ("jsonl", "ndjson", "json"):
        return spark.read.option("multiLine", suffix == "json").json(path)
    if suffix in ("csv", "tsv"):
        return read_csv_text(spark, path) if suffix == "csv" else spark.read.option("header", True).option("sep", "\t").csv(path)
    raise ValueError(f"no reader for {suffix}: {path}")


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns cast where that is possible, empty and unreadable fields null."""
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")).try_cast(k) for c, k in kinds.items()})


def parsed_value(text: Column, kind: Column) -> Column:
    """A multi-valued field (JSON array or text with bars) as a list."""
    listed = F.from_json(text, "array<string>")
    return F.when(kind == "multi", F.coalesce(listed, F.filter(F.split(text, r"\|"), lambda x: x != ""))).otherwise(F.array(text))


def last_lines(log: DataFrame, key: str, offset: str, good: Column | None = None) -> DataFrame:
    """The last line of each key of an append log, or its last good one."""
    own = log if good is None else log.filter(good)
    rest = [c for c in log.columns if c != key]
    return own.groupBy(key).agg(F.max_by(F.struct(*rest), offset).alias("r")).select(key, "r.*")


def append_new(df: DataFrame, path: str, key: str, existing: DataFrame | None = None) -> None:
    """Append rows whose keys aren't there yet, one of each key."""
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in df.columns if c != key]))).filter("_r = 1").drop("_r")
    (first if existing is None else first.join(existing.select(key), key, "left_anti")).write.mode("append").json(path)


def rewrite_without(df: DataFrame, keys: DataFrame, key: str, path: str) -> DataFrame:
    """The rows of other keys, written to a new place."""
    df.join(keys.select(key), key, "left_anti").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    extra = [c for c in df.columns if c not in columns]
    if extra:
        raise ValueError(f"columns that aren't declared: {extra}")
    df.select(*columns).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def write_typed(df: DataFrame, path: str, kinds: dict[str, str]) -> None:
    typed(df, kinds).write.mode("overwrite").option("compression", "zstd").parquet(path)


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order: a sum of row hashes with their number."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}:{row['s']}"


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
