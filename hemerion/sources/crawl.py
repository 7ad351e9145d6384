"""Crawling and downloading as a protocol: the caller brings the function that fetches.

A crawl goes through the pages of an archive in order, since what it finds decides when it
ends; a download is one pass over rows on the executors. Both keep a ledger of what is done
and what was rejected, so a run that ends early goes on where it stopped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemerion.operators.classify import read_ledger
from hemerion.operators.documents import page_problem

PAGES = "pagina int, html string, razon string"


def crawl(spark: SparkSession, fetch: Callable[[int], str], folder: str, is_empty: Callable[[str], bool], *, most: int = 200, empty_to_stop: int = 2,
          refresh: int = 0, pause: float = 1.0) -> DataFrame:
    """Pages 1, 2, ... of an archive, appended to the ledger in ``folder``; the ledger is returned.

    Pages that are done aren't fetched again, but for the first ``refresh``. A page that
    can't be fetched is a row with a reason and is tried again by the next run. It ends after
    ``empty_to_stop`` empty pages in a row or at ``most``.
    """
    ledger = read_ledger(spark, folder)
    done = set() if ledger is None else {r.pagina for r in ledger.where("razon is null").select("pagina").distinct().collect()}
    empty = 0
    for page in range(1, most + 1):
        if page in done and page > refresh:
            continue
        try:
            html, reason = fetch(page), None
        except Exception as error:  # noqa: BLE001 - the reason goes into the ledger
            html, reason = None, str(error)[:200]
        spark.createDataFrame([(page, html, reason)], PAGES).write.mode("append").parquet(folder)
        empty = empty + 1 if html is not None and is_empty(html) else 0
        if empty >= empty_to_stop:
            break
        time.sleep(pause)
    found = read_ledger(spark, folder)
    return spark.createDataFrame([], PAGES) if found is None else found


def download(urls: DataFrame, key: str, sources: list[tuple[str, str]], fetch: Callable[[str], str], *, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """(key, fuente, html, bytes, razon) for each row: the first source that gives a valid page, else why none did.

    ``sources``: (name, column with its address), in order; null addresses are passed over. A
    failed fetch is tried again after growing pauses; an invalid page isn't.
    """
    columns = [c for _, c in sources]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                for n, (name, _) in enumerate(sources):
                    address = row[n + 1]
                    if address is None:
                        continue
                    html, reason = None, ""
                    for attempt in range(tries):
                        try:
                            html = fetch(address)
                            break
                        except Exception as error:  # noqa: BLE001 - the reason goes into the row
                            reason = str(error)[:200]
                            if attempt + 1 < tries:
                                time.sleep(pause * 2**attempt)
                    rows.append((row[0], n, name, html, reason))
            yield pd.DataFrame(rows, columns=["k", "lugar", "fuente", "html", "fallo"])

    typed = urls.select(F.col(key).alias("k"), *columns)
    kind = typed.schema["k"].dataType.simpleString()
    tried = typed.mapInPandas(run, f"k {kind}, lugar int, fuente string, html string, fallo string")
    reason = F.when(F.col("html").isNull(), F.concat(F.lit("error: "), "fallo")).otherwise(page_problem(F.col("html")))
    # The first source without a reason counts; of those with one the last reason stays.
    order = F.struct(reason.isNotNull(), F.when(reason.isNull(), F.col("lugar")).otherwise(-F.col("lugar")))
    best = tried.groupBy("k").agg(F.min_by(F.struct("fuente", F.when(reason.isNull(), F.col("html")).alias("html"), reason.alias("razon")), order).alias("b"))
    joined = typed.select("k").distinct().join(best, "k", "left").select("k", "b.fuente", "b.html", "b.razon")
    return joined.select(
        F.col("k").alias(key), "fuente", "html", F.octet_length("html").alias("bytes"),
        F.when(F.col("fuente").isNull(), "sin dirección").otherwise(F.col("razon")).alias("razon"),
    )
