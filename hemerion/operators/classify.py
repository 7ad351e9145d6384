"""The protocol of a remote labeller, with a local classifier in its place.

Batches of bounded size, a closed list of categories, a reason for every reject, tries
with growing pauses, and passes with the order of values turned. ``ask`` gets the texts
of one batch and returns a label or null for each; it may raise.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hemerion.functions.text import excerpt


def keyword_labeller(keywords: dict[str, list[str]]) -> Callable[[list[str], int], list[str | None]]:
    """A deterministic labeller: the category with most keywords, null for none."""

    def ask(texts: list[str], turn: int) -> list[str | None]:
        names = sorted(keywords, reverse=bool(turn % 2))
        out = []
        for text in texts:
            low = text.lower()
            scores = {name: sum(low.count(w) for w in keywords[name]) for name in names}
            best = max(names, key=lambda n: scores[n]) if names else None
            out.append(best if best is not None and scores[best] else None)
        return out

    return ask


def label_texts(items: DataFrame, key: str, text: str, ask: Callable[[list[str], int], list[str | None]], categories: list[str], *,
                batch: int = 10, most: int | None = None, shortest: int = 12, passes: int = 1, tries: int = 3, pause: float = 1.0,
                method: str = "local") -> DataFrame:
    """(key, pasada, etiqueta, metodo, fragmento, razon), one row per item and pass.

    Short items are rejected with a reason; so are labels outside the list and batches
    that fail after all tries. Texts are read whole; ``most`` cuts them for a labeller
    whose prompts are limited. ``repartition`` outside decides how many batches run at once.
    """
    allowed = set(categories)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for turn in range(passes):
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch]
                    long = part[part["t"].str.len() >= shortest]
                    labels, problem = _asked(ask, [t[:most] for t in long["t"]], turn, tries, pause)
                    found = dict(zip(long["k"], labels)) if labels is not None else {}
                    for k, t in zip(part["k"], part["t"]):
                        label, reason = None, None
                        if len(t) < shortest:
                            reason = "texto demasiado corto"
                        elif problem:
                            reason = f"error: {problem}"
                        elif found.get(k) is not None and found[k] not in allowed:
                            reason = f"valor fuera de la lista: {found[k]}"
                        else:
                            label = found.get(k)
                        rows.append((k, turn, label, method, t[:160], reason))
            yield pd.DataFrame(rows, columns=["k", "pasada", "etiqueta", "metodo", "fragmento", "razon"])

    rows = items.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInPandas(run, f"k {kind}, pasada int, etiqueta string, metodo string, fragmento string, razon string")
    return out.withColumnRenamed("k", key)


def _asked(ask, texts: list[str], turn: int, tries: int, pause: float):
    problem = ""
    for attempt in range(tries):
        try:
            return (ask(texts, turn) if texts else []), ""
        except Exception as error:  # noqa: BLE001 - the reason goes into the reject
            problem = str(error)[:200]
            if attempt + 1 < tries:
                time.sleep(pause * 2**attempt)
    return None, problem or "sin respuesta"


def label_batches(items: DataFrame, key: str, text: str, ask, categories: list[str], folder: str, *, rounds: int = 4, remembered: int = 140, workers: int = 6,
                  **options) -> DataFrame:
    """Items labelled in micro-batches with a growing vocabulary; the ledger in ``folder`` is returned.

    ``ask(vocabulary)`` gives the labeller of one micro-batch, which sees a snapshot of the last
    ``remembered`` labels. Each micro-batch is a part of the keys by digest, runs on
    ``workers`` tasks and is appended to the ledger before the next one starts, so a run that
    ends early goes on with what is pending.
    """
    spark = items.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(rounds))
    for k in range(rounds):
        known = read_ledger(spark, folder)
        waiting = items.where(part == k)
        vocabulary: list[str] = []
        if known is not None:
            waiting = waiting.join(known.select(key).distinct(), key, "left_anti")
            recent = known.where("etiqueta is not null").groupBy("etiqueta").agg(F.max("ronda").alias("ronda"), F.count("*").alias("n"))
            # A bounded list goes to the labeller, whatever the ledger's size.
            vocabulary = [r.etiqueta for r in recent.orderBy(F.desc("ronda"), F.desc("n"), "etiqueta").limit(remembered).collect()]
        labelled = label_texts(waiting.repartition(workers), key, text, ask(vocabulary), categories, **options)
        labelled.withColumn("ronda", F.lit(k)).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def read_ledger(spark, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return spark.read.parquet(folder) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def require_gold(coded: DataFrame, label: str, least: int) -> None:
    """Refuses a full run until so many items have been coded by hand; stops counting there."""
    if coded.where(F.col(label).isNotNull()).limit(least).count() < least:
        raise ValueError(f"fewer than {least} items are coded")


def cost_estimate(items: DataFrame, text: str, *, batch: int = 10, overhead: int = 1000, answer: int = 60, per_letter: float = 0.25,
                  price_in: float = 0.30, price_out: float = 2.50) -> DataFrame:
    """One row: items, batches, tokens in and out and money of a run, without running it; prices are per million."""
    letters, n = F.sum(F.length(F.coalesce(text, F.lit("")))), F.count("*")
    batches = F.ceil(n / batch)
    tokens_in, tokens_out = F.ceil(F.coalesce(letters, F.lit(0)) * per_letter) + batches * overhead, n * answer
    money = F.round((tokens_in * price_in + tokens_out * price_out) / 1_000_000, 6)
    return items.agg(n.alias("n"), batches.alias("lotes"), tokens_in.alias("fichas_entrada"), tokens_out.alias("fichas_salida"), money.alias("costo"))


def metered(labelled: DataFrame, text: str = "fragmento") -> tuple[DataFrame, Observation]:
    """The rows and a meter of calls, letters and rejects that fills while they are written."""
    meter = Observation()
    counts = [F.count(F.lit(1)).alias("filas"), F.sum(F.length(text)).alias("letras"), F.count("razon").alias("rechazos")]
    return labelled.observe(meter, *counts), meter


def with_context(question, context):
    """One text from context and question; a question without context stands alone."""
    joined = F.concat(F.lit("CONTEXTO: "), context, F.lit("\nPREGUNTA: "), question)
    return F.when(F.coalesce(context, F.lit("")) != "", joined).otherwise(question)


def question_only(text):
    """Inverse of ``with_context``."""
    return F.when(text.startswith("CONTEXTO: "), F.substring_index(text, "\nPREGUNTA: ", -1)).otherwise(text)


def examples_block(sample: DataFrame, label: str, text: str, most: int = 500) -> DataFrame:
    """One row ``bloque`` with the examples of a stratified sample as text; more than ``most`` raise."""
    if sample.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} examples")
    line = F.concat(F.lit("- "), excerpt(F.col(text), 200), F.lit(" → "), F.col(label))
    return sample.select(line.alias("l")).agg(F.array_join(F.array_sort(F.collect_list("l")), "\n").alias("bloque"))
