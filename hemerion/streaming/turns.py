"""Streams: resumable batches over landed files, windows over events, threads as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hemerion.operators.lineage import run_batch


def resumable(spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], folder: str, key: str = "id",
              files: int = 100) -> StreamingQuery:
    """All landed files once, in batches; what is done or rejected stays in the ledger tables."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return (
        stream.writeStream.option("checkpointLocation", f"{folder}/avance").trigger(availableNow=True)
        .foreachBatch(lambda batch, _: run_batch(batch, work, folder, key)).start()
    )


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Count and sum by window and kind; rows later than the watermark are left out."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), kind)
        .agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("suma"))
        .select(F.col("w.start").alias("desde"), F.col("w.end").alias("hasta"), kind, "n", "suma")
    )


THREAD_OUT = "conferencia_id string, orden int, hilo int, periodista string, medio string"
THREAD_STATE = "hilo int, periodista string, medio string, orden int"


def _carry(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    thread, name, outlet, last = state.get if state.exists else (-1, None, None, -1)
    rows = pd.concat(list(frames)).sort_values("orden")
    out = []
    for r in rows.itertuples(index=False):
        if r.abre:
            thread, name, outlet = thread + 1, r.nombre, r.declarado
        last = max(last, int(r.orden))
        out.append((key[0], int(r.orden), thread, name, outlet))
    state.update((thread, name, outlet, last))
    yield pd.DataFrame(out, columns=["conferencia_id", "orden", "hilo", "periodista", "medio"])


def stream_threads(turns: DataFrame) -> DataFrame:
    """Thread and carried identity of streamed turns (conferencia_id, orden, abre, nombre, declarado).

    Turns of a conference must arrive in the order of their batches; within one they are sorted.
    """
    return turns.groupBy("conferencia_id").applyInPandasWithState(_carry, THREAD_OUT, THREAD_STATE, "append", GroupStateTimeout.NoTimeout)
