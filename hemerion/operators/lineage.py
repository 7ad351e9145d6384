"""Ledgers, pending work, and labels that outlive a change of ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemerion.functions.text import stable_id
from hemerion.operators.aggregates import last_wins


def pending(items: DataFrame, done: DataFrame, rejected: DataFrame | None = None, key: str = "id", stable: bool = False) -> DataFrame:
    """Items neither done nor rejected, each once; ``stable`` compares ids without their thread."""
    known = done.select(key) if rejected is None else done.select(key).unionByName(rejected.select(key))
    once = items.dropDuplicates([key])
    if not stable:
        return once.join(known.distinct(), key, "left_anti")
    seen = known.select(stable_id(F.col(key)).alias("__stable")).distinct()
    return once.withColumn("__stable", stable_id(F.col(key))).join(seen, "__stable", "left_anti").drop("__stable")


def retryable(rejected: DataFrame, done: DataFrame, reason: str, key: str = "id") -> DataFrame:
    """Rejects whose reason matches and that were not done since."""
    return rejected.where(F.col("razon").rlike(reason)).join(done.select(key).distinct(), key, "left_anti")


def remap(old: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """Old ids with their current id: intacto, recuperado by stable key, or perdido (kept)."""
    now = current.select(F.col(key).alias("__now")).distinct()
    by_stable = now.groupBy(stable_id(F.col("__now")).alias("__stable")).agg(F.min("__now").alias("__found"))
    joined = old.join(now, F.col(key) == F.col("__now"), "left").withColumn("__stable", stable_id(F.col(key))).join(by_stable, "__stable", "left")
    state = F.when(F.col("__now").isNotNull(), "intacto").when(F.col("__found").isNotNull(), "recuperado").otherwise("perdido")
    return joined.withColumn("estado", state).withColumn("id_actual", F.coalesce("__now", "__found", key)).drop("__now", "__found", "__stable")


def rebuild(ledger: DataFrame, current: DataFrame, key: str = "id", order: str = "ts") -> DataFrame:
    """The labels of a ledger under current ids, the last of each, orphans left out."""
    mapped = remap(ledger, current, key).where("estado <> 'perdido'")
    renamed = mapped.drop(key, "estado").withColumnRenamed("id_actual", key)
    return last_wins(renamed, [key], [order])


def earliest(captures: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """(key, columns, time): the earliest capture of each key, ties by the columns; rows without key or time are left out."""
    rows = captures.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    first = F.min(F.struct(time, *columns)).alias("__first")
    return rows.groupBy(key).agg(first).select(key, *[F.col(f"__first.{c}").alias(c) for c in [*columns, time]])


def wanted_links(hrefs: DataFrame, href: str, day) -> tuple[DataFrame, DataFrame]:
    """(one link per date, other links each once): a link whose date can be read is wanted, of one date the first by name."""
    dated = hrefs.select(F.col(href).alias("href"), day.alias("fecha"))
    wanted = dated.where("fecha is not null").groupBy("fecha").agg(F.min("href").alias("href"))
    return wanted, dated.where("fecha is null").select("href").distinct()


def split_rejects(df: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a reason; nothing is dropped."""
    marked = df.withColumn("razon", reason)
    return marked.where("razon is null").drop("razon"), marked.where("razon is not null")


def run_batch(batch: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, key: str = "id") -> None:
    """One batch of a resumable run: pending rows are worked and appended to the ledger.

    ``work`` returns the rows with a ``razon`` that is null where all went well. Tables
    ``hechos`` and ``rechazos`` in ``folder`` are append-only; a rejected row counts as
    processed and isn't tried again by itself.
    """
    spark = batch.sparkSession
    done, rejected = (_ledger(spark, f"{folder}/{name}", key, batch) for name in ("hechos", "rechazos"))
    worked = work(pending(batch, done, rejected, key)).withColumn("ts", F.current_timestamp()).persist()
    try:
        worked.where("razon is null").drop("razon").write.mode("append").parquet(f"{folder}/hechos")
        worked.where("razon is not null").write.mode("append").parquet(f"{folder}/rechazos")
    finally:
        worked.unpersist()


def _ledger(spark, path: str, key: str, like: DataFrame) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.parquet(path).select(key)
    return spark.createDataFrame([], like.select(key).schema)
