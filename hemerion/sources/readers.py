"""Readers: line files that may be torn, tables with comments, taxonomies, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One record per line; blank lines are skipped. ``seq`` keeps the order of the file."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("seq", F.monotonically_increasing_id())
    return lines.select("seq", F.from_json("value", schema).alias("r")).select("r.*", "seq")


def read_torn_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """(records, torn lines): a broken last line of a file is counted, any other raises.

    Lines are read as lines, so a large file is many tasks; ``seq`` orders the lines of a file.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("seq")).where(F.trim("value") != "")
    parsed = lines.select("file", "seq", F.from_json("value", f"{schema}, __broken string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}).alias("r"))
    broken = F.col("r.__broken").isNotNull()
    files = parsed.groupBy("file").agg(F.max("seq").alias("last"), F.min(F.when(broken, F.col("seq"))).alias("first"), F.count_if(broken).alias("n"))
    middle = files.where(F.col("first") < F.col("last")).limit(1).collect()
    if middle:
        raise ValueError(f"broken line in the middle of {middle[0].file}")
    torn = files.agg(F.sum("n")).collect()[0][0] or 0
    return parsed.where("r.__broken is null").select("r.*", "file", "seq").drop("__broken"), torn


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; without a schema all columns are strings."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_commented_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV whose comments and blank lines may stand before the header; BOM-tolerant."""
    df = spark.read.option("header", True).option("comment", "#").option("enforceSchema", False).csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return df


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(clave, nombre, definicion) of a taxonomy document."""
    return read_json_document(spark, path).select(F.explode("categorias").alias("c")).select("c.clave", "c.nombre", "c.definicion")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(asunto, canonico) of a JSON object."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return text.select(F.explode("m").alias("asunto", "canonico"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(conferencia_id, html): one row per file, bytes that are no UTF-8 replaced."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", "([^/]+)\\.[^./]+$", 1)
    return files.select(name.alias("conferencia_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
