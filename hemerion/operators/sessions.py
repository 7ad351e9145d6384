"""Turns to threads to exchanges: gaps and islands, carried identity, contexts.

Everything is a window over one conference or one thread, which are bounded; no key
gathers more than a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemerion.functions.rules import is_noise
from hemerion.functions.text import word_count

CONF, ORDER = "conferencia_id", "orden"


def distinct_turns(turns: DataFrame) -> DataFrame:
    """Turns without re-sent rows: of equal keys the first to arrive stays."""
    w = Window.partitionBy(CONF, ORDER).orderBy("recibido_en")
    return turns.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def press_runs(turns: DataFrame, longest: int = 200) -> DataFrame:
    """Press turns with their run and whether its speakers are uncertain.

    A run ends at an official's turn; room noise neither adds nor ends. It is uncertain
    when it has two turns or more, all of at most ``longest`` characters.
    """
    so_far = Window.partitionBy(CONF).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    numbered = turns.withColumn("racha", F.count_if(F.col("tipo") == "funcionario").over(so_far)).where("tipo = 'prensa'")
    run = Window.partitionBy(CONF, "racha")
    size, top = F.count("*").over(run), F.max(F.length(F.coalesce("texto", F.lit("")))).over(run)
    return numbered.withColumn("tamano", size).withColumn("incierta", (size >= 2) & (top <= longest))


def open_threads(turns: DataFrame, opens: Column, name: Column, outlet: Column, method: Column) -> DataFrame:
    """Thread number and carried identity of each turn; turns before the first thread have -1.

    Name, outlet and method travel as one struct that only an opening row has, so an
    opening without an outlet doesn't inherit the one before.
    """
    so_far = Window.partitionBy(CONF).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(opens, F.struct(name.alias("periodista"), outlet.alias("medio"), method.alias("metodo"))), True).over(so_far)
    return (
        turns.withColumn("abre", F.coalesce(opens, F.lit(False)))
        .withColumn("hilo", (F.count_if("abre").over(so_far) - 1).cast("int")).withColumn("__id", carried)
        .select("*", "__id.periodista", "__id.medio", "__id.metodo").drop("__id")
    )


def attribute(threaded: DataFrame) -> DataFrame:
    """Role, speaker and attribution of each turn in a thread; needs ``incierta``."""
    sure = F.col("abre") | (F.col("tipo") == "funcionario")
    doubtful = F.coalesce(F.col("incierta"), F.lit(False)) | (F.col("tipo") == "anonimo")
    attribution = F.when(sure, "declarada").when(doubtful, "incierta").otherwise("propagada")
    person = F.when(F.col("tipo") == "funcionario", F.col("hablante")).when(attribution == "incierta", F.lit(None)).otherwise(F.col("periodista"))
    return (
        threaded.where("hilo >= 0").withColumn("atribucion", attribution)
        .withColumn("rol", F.when(F.col("tipo") == "funcionario", "respuesta").otherwise("pregunta"))
        .withColumn("quien", person).withColumn("ruido", is_noise(F.col("texto")))
    )


def build_threads(turns: DataFrame, introduced: DataFrame, manual: DataFrame | None = None, longest: int = 200) -> DataFrame:
    """Turns in threads, with role, speaker, attribution and noise.

    ``introduced`` and ``manual``: (conferencia_id, orden, periodista, medio). A press turn
    opens a thread where the manual table has it, even in an uncertain run, else where it
    introduces someone and its run is certain. A manual opener keeps its own outlet, null too.
    """
    keys = [CONF, ORDER]
    runs = press_runs(turns, longest).select(*keys, "incierta")
    said = introduced.where("periodista is not null").select(*keys, F.struct("periodista", "medio").alias("__said"))
    joined = turns.join(runs, keys, "left").join(said, keys, "left")
    if manual is None:
        joined = joined.withColumn("__own", F.lit(None).cast("struct<periodista:string,medio:string>"))
    else:
        own = manual.groupBy(*keys).agg(F.min(F.struct("periodista", "medio")).alias("__own"))
        joined = joined.join(own, keys, "left")
    press, by_hand = F.col("tipo") == "prensa", F.col("__own").isNotNull()
    opens = press & (by_hand | (F.col("__said").isNotNull() & ~F.coalesce("incierta", F.lit(False))))
    who = F.when(by_hand, F.col("__own")).otherwise(F.col("__said"))
    method = F.when(by_hand, "manual").otherwise("regex")
    threaded = open_threads(joined, opens, who.periodista, who.medio, method).drop("__said", "__own")
    return attribute(threaded)


def unused_manual(turns: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual rows that opened no thread: their turn is missing or no press turn."""
    return manual.join(turns.where("tipo = 'prensa'").select(CONF, ORDER), [CONF, ORDER], "left_anti")


def nested_threads(built: DataFrame) -> DataFrame:
    """One row per thread with its turns in order; a thread is a part of one document."""
    turn = F.struct("orden", "rol", "quien", "texto", "atribucion", "ruido")
    grouped = built.groupBy(CONF, "hilo").agg(
        F.min("periodista").alias("periodista"), F.min("medio").alias("medio"), F.min("metodo").alias("metodo_identificacion"),
        F.array_sort(F.collect_list(turn)).alias("turnos"),
    )
    return grouped


def thread_turns(threads: DataFrame) -> DataFrame:
    """Nested turns as rows; a re-sent thread counts once."""
    once = threads.dropDuplicates([CONF, "hilo"])
    kept = [c for c in ("periodista", "medio", "periodista_canonico") if c in threads.columns]
    return once.select(CONF, "hilo", *kept, F.explode("turnos").alias("t")).select(CONF, "hilo", *kept, "t.*")


def exchanges(rows: DataFrame) -> DataFrame:
    """A question and all answers until the next question, one row each.

    Noise is skipped, answers before the first question are dropped, and responders are
    listed once in the order they first speak.
    """
    so_far = Window.partitionBy(CONF, "hilo").orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    asks = F.col("rol") == "pregunta"
    heard = rows.where("not coalesce(ruido, false)").withColumn("intercambio", F.count_if(asks).over(so_far)).where("intercambio > 0")
    kept = [c for c in ("periodista", "medio", "periodista_canonico") if c in rows.columns]
    turn = F.struct(ORDER, F.col("quien"), F.col("texto"))
    grouped = heard.groupBy(CONF, "hilo", "intercambio").agg(
        *[F.min(c).alias(c) for c in kept], F.min(ORDER).alias(ORDER),
        F.max(F.when(asks, F.col("texto"))).alias("pregunta"),
        F.max(F.when(asks, F.col("atribucion"))).alias("atribucion"),
        F.array_sort(F.collect_list(F.when(~asks, turn))).alias("respuestas"),
    )
    doubtful = F.col("atribucion") == "incierta"
    for c in kept:
        grouped = grouped.withColumn(c, F.when(doubtful, F.lit(None)).otherwise(F.col(c)))
    speakers = F.array_distinct(F.array_compact(F.transform("respuestas", lambda r: r.quien)))
    return grouped.withColumn("quien_responde", speakers)


def exchange_words(found: DataFrame) -> DataFrame:
    """Words asked and answered in each exchange."""
    answered = F.aggregate(F.transform("respuestas", lambda r: word_count(r.texto)), F.lit(0), lambda a, b: a + b)
    return found.withColumn("wq", word_count(F.col("pregunta"))).withColumn("wa", answered)


def previous_context(rows: DataFrame, short: int = 200, most: int = 600) -> DataFrame:
    """For short questions the end of the nearest non-empty of the two turns before."""
    w = Window.partitionBy(CONF, "hilo").orderBy(ORDER)
    flat = F.nullif(F.trim(F.regexp_replace(F.coalesce("texto", F.lit("")), "\\s+", " ")), F.lit(""))
    flatted = rows.withColumn("__flat", flat)
    before = F.coalesce(F.lag("__flat", 1).over(w), F.lag("__flat", 2).over(w))
    wanted = (F.col("rol") == "pregunta") & (F.length("texto") < short)
    context = F.when(wanted, F.coalesce(F.right(before, F.lit(most)), F.lit("")))
    return flatted.withColumn("contexto", context).drop("__flat")


def context_budget(rows: DataFrame, turns: int = 4, most: int = 900) -> DataFrame:
    """How many of the turns before fit the budget of characters, nearest first, and their length."""
    w = Window.partitionBy(CONF, "hilo").orderBy(ORDER).rowsBetween(-turns, -1)
    sizes = F.reverse(F.collect_list(F.length(F.coalesce("texto", F.lit("")))).over(w))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(False).alias("full"))

    def take(state: Column, size: Column) -> Column:
        full = state.full | (state.size + size > most)
        return F.struct(
            (state.n + F.when(full, 0).otherwise(1)).alias("n"), (state.size + F.when(full, 0).otherwise(size)).alias("size"), full.alias("full")
        )

    used = F.aggregate(sizes, start, take)
    return rows.withColumn("__used", used).withColumn("previos", F.col("__used.n")).withColumn("caracteres", F.col("__used.size")).drop("__used")


def next_context(rows: DataFrame, turns: int = 4, most: int = 600) -> DataFrame:
    """(siguientes, caracteres_siguientes) after each turn: the next one, or, where the turn breaks off, what fits the budget."""
    w = Window.partitionBy(CONF, "hilo").orderBy(ORDER).rowsBetween(1, turns)
    sizes = F.collect_list(F.length(F.coalesce("texto", F.lit("")))).over(w)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(False).alias("full"))

    def take(state: Column, size: Column) -> Column:
        full = state.full | (state.size + size > most)
        return F.struct((state.n + F.when(full, 0).otherwise(1)).alias("n"), (state.size + F.when(full, 0).otherwise(size)).alias("size"), full.alias("full"))

    cut = ~F.coalesce(F.trim("texto"), F.lit("")).rlike("[.?!…]$")
    found = rows.withColumn("__sizes", sizes).withColumn("__used", F.aggregate("__sizes", start, take))
    first = F.least(F.size("__sizes"), F.lit(1))
    one = F.struct(first.alias("n"), F.coalesce(F.get(F.col("__sizes"), F.lit(0)), F.lit(0)).alias("size"))
    return (
        found.withColumn("__next", F.when(cut, F.struct("__used.n", "__used.size")).otherwise(one)).withColumn("siguientes", F.col("__next.n"))
        .withColumn("caracteres_siguientes", F.col("__next.size")).drop("__sizes", "__used", "__next")
    )


def with_attachments(found: DataFrame, *tables: tuple[DataFrame, str, list[str]]) -> DataFrame:
    """Exchanges with what is attached to them by (conferencia_id, orden), the last record of each; none is lost.

    Each table: (rows with conferencia_id and orden, the column that orders records, the columns to attach).
    """
    for rows, order, columns in tables:
        last = rows.groupBy(CONF, ORDER).agg(F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("__last"))
        found = found.join(last, [CONF, ORDER], "left").select("*", *[F.col(f"__last.{c}").alias(c) for c in columns]).drop("__last")
    return found
