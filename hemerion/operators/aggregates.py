"""Rankings, shares, concentration, cross-tabs, votes and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemerion.session import materialize


def _ordered(df: DataFrame, order: list[Column], measure: Column) -> tuple[DataFrame, DataFrame]:
    """Rows range-partitioned by the order, with ``__p``; and for each part the rows and the measure of the parts before it.

    The parts are written first, so that both readings see the same bounds. The second frame
    has one row per part, so it may be broadcast.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ordered")
    sizes = parts.groupBy("__p").agg(F.count("*").alias("n"), F.sum(measure).alias("m"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = sizes.select("__p", F.coalesce(F.sum("n").over(before), zero).alias("__n"), F.coalesce(F.sum("m").over(before), zero).alias("__m"))
    return parts, offsets


def ranking(counts: DataFrame, measure: str, *ties: str) -> DataFrame:
    """Rank by measure, then ties; sorted in range partitions, so no task holds all rows."""
    order = [F.col(measure).desc(), *[F.col(t).asc() for t in ties]]
    parts, offsets = _ordered(counts, order, F.lit(0))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return parts.join(F.broadcast(offsets), "__p").withColumn("rango", (place + F.col("__n")).cast("int")).drop("__p", "__n", "__m")


def concentration(counts: DataFrame, measure: str, *ties: str) -> DataFrame:
    """Rank, share, cumulative share and whether the rank lies within the first half."""
    order = [F.col(measure).desc(), *[F.col(t).asc() for t in ties]]
    parts, offsets = _ordered(counts, order, F.col(measure))
    w = Window.partitionBy("__p").orderBy(*order)
    # One row with the total, so it may be broadcast.
    total = F.broadcast(parts.agg(F.sum(measure).alias("__total")))
    placed = parts.join(F.broadcast(offsets), "__p").withColumn("rango", (F.row_number().over(w) + F.col("__n")).cast("int"))
    running = placed.withColumn("__so_far", F.sum(measure).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__m")).join(total)
    return (
        running.withColumn("cuota", F.round(F.col(measure) / F.col("__total"), 6))
        .withColumn("cuota_acumulada", F.round(F.col("__so_far") / F.col("__total"), 6))
        .withColumn("en_mitad", (F.col("__so_far") - F.col(measure)) * 2 < F.col("__total")).drop("__p", "__n", "__m", "__so_far", "__total")
    )


def tranches(ranked: DataFrame, measure: str, bounds: list[int]) -> DataFrame:
    """People and sum of the measure by tranche of rank."""
    label, low = None, 1
    for high in bounds:
        name = F.lit(f"{low}-{high}")
        label = F.when(F.col("rango") <= high, name) if label is None else label.when(F.col("rango") <= high, name)
        low = high + 1
    return ranked.groupBy(label.otherwise(F.lit("resto")).alias("tramo")).agg(F.count("*").alias("cuantos"), F.sum(measure).alias(measure))


def modal(df: DataFrame, key: str, value: str, count: str = "n") -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the smallest."""
    per = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias(count))
    w = Window.partitionBy(key).orderBy(F.col(count).desc(), F.col(value))
    return per.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_per_group(counts: DataFrame, group: str, value: str, measure: str, k: int) -> DataFrame:
    """The k largest values of each group with their share of the group."""
    w = Window.partitionBy(group).orderBy(F.col(measure).desc(), F.col(value))
    share = F.round(F.col(measure) / F.sum(measure).over(Window.partitionBy(group)), 6)
    return counts.withColumn("cuota", share).withColumn("puesto", F.row_number().over(w)).where(F.col("puesto") <= k)


def top_and_others(df: DataFrame, value: str, by: str, k: int, others: str = "otros") -> DataFrame:
    """Counts by value and another column, values beyond the k most frequent as one."""
    top = df.where(F.col(value).isNotNull()).groupBy(value).count().orderBy(F.col("count").desc(), value).limit(k)
    # k rows at most, so the broadcast is bounded.
    marked = df.join(F.broadcast(top.select(F.col(value).alias("__top"))), F.col(value) == F.col("__top"), "left")
    return marked.groupBy(F.coalesce("__top", F.lit(others)).alias(value), by).agg(F.count("*").alias("n"))


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; aggregated on the map side, no window."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(last).select(*keys, "__row.*")


def vote(votes: DataFrame, item: str, label: str) -> DataFrame:
    """Strict majority or null, and unanimity; ties stay undecided."""
    per = votes.where(F.col(label).isNotNull()).groupBy(item, label).agg(F.count("*").alias("n"))
    summed = per.groupBy(item).agg(
        F.sum("n").alias("votos"), F.max("n").alias("__top"), F.max_by(label, "n").alias("__label"), F.count("*").alias("__labels")
    )
    decided = F.when(F.col("__top") * 2 > F.col("votos"), F.col("__label"))
    return summed.select(item, "votos", decided.alias("consenso"), (F.col("__labels") == 1).alias("unanime"))


def hash_order(*columns: str, seed: str) -> Column:
    """Reproducible random order: a digest of the key and a seed."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(seed)))


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: str = "1") -> DataFrame:
    return df.withColumn("__h", hash_order(*keys, seed=seed)).orderBy("__h", *keys).limit(n).drop("__h")


def stratified_sample(df: DataFrame, keys: list[str], stratum: str, n: int, seed: str = "1", salts: int = 64) -> DataFrame:
    """At least two of each stratum, n over the number of strata of each.

    A stratum is first cut down within ``salts`` parts of it, so a large one isn't sorted in one task.
    """
    strata = df.select(stratum).distinct().count()
    each = max(2, n // max(1, strata))
    order = [F.col("__h"), *keys]
    salted = df.withColumn("__h", hash_order(*keys, seed=seed)).withColumn("__s", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    some = salted.withColumn("__n", F.row_number().over(Window.partitionBy(stratum, "__s").orderBy(*order))).where(F.col("__n") <= each)
    w = Window.partitionBy(stratum).orderBy(*order)
    return some.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= each).drop("__n", "__h", "__s")


def lots(sample: DataFrame, keys: list[str], count: int, seed: str) -> DataFrame:
    """A sample dealt out to ``count`` lots of equal size, in a reproducible random order."""
    ranked = ranking(sample.withColumn("__h", hash_order(*keys, seed=seed)).withColumn("__one", F.lit(1)), "__one", "__h", *keys)
    return ranked.withColumn("lote", ((F.col("rango") - 1) % count + 1).cast("int")).drop("__h", "__one", "rango")


def redrawn_sample(df: DataFrame, keys: list[str], n: int, unfit: Column, seed: str) -> DataFrame:
    """The first n rows in random order that are fit; unfit ones are drawn and passed over."""
    return hash_sample(df.where(~F.coalesce(unfit, F.lit(False))), keys, n, seed)


def dictionary(df: DataFrame, column: str, code: str) -> DataFrame:
    """(column, code): dense codes from 0 that follow the sorted values."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn("__one", F.lit(1))
    return ranking(values, "__one", column).select(column, (F.col("rango") - 1).alias(code))


def dictionary_encode(df: DataFrame, column: str, code: str) -> DataFrame:
    """``column`` beside a dense code; codes follow the sorted values."""
    return df.join(dictionary(df, column, code), column, "left")


def dictionary_export(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(rows with codes in place of the columns, dictionary of each column)."""
    coded, found = df, {}
    for column in columns:
        found[column] = dictionary(df, column, "__code")
        coded = coded.join(found[column], column, "left").drop(column).withColumnRenamed("__code", column)
    return coded, found


def edge_rates(df: DataFrame, month: str, hit: Column, first: int = 3, last: int = 4) -> DataFrame:
    """(borde, n, casos, tasa) of the first and the last months; one row per month is ranked, so the windows are small."""
    months = df.groupBy(month).agg(F.count("*").alias("n"), F.count_if(hit).alias("casos"))
    up, down = Window.orderBy(month), Window.orderBy(F.col(month).desc())
    placed = months.withColumn("__up", F.row_number().over(up)).withColumn("__down", F.row_number().over(down))
    edges = F.array_compact(F.array(F.when(F.col("__up") <= first, "primeros"), F.when(F.col("__down") <= last, "ultimos")))
    return placed.withColumn("borde", F.explode(edges)).groupBy("borde").agg(
        F.sum("n").alias("n"), F.sum("casos").alias("casos"), F.round(F.try_divide(F.sum("casos"), F.sum("n")), 6).alias("tasa")
    )


def frequency_tranches(counts: DataFrame, measure: str, bounds: list[int]) -> DataFrame:
    """How many things and how much of the measure lie from one bound to the next, bounds from high to low."""
    label, high = None, None
    for low in bounds:
        name = f">={low}" if high is None else str(low) if low == high - 1 else f"{low}-{high - 1}"
        test = F.col(measure) >= low
        label = F.when(test, name) if label is None else label.when(test, name)
        high = low
    return counts.groupBy(label.otherwise("resto").alias("tramo")).agg(F.count("*").alias("cuantos"), F.sum(measure).alias(measure))


def first_by_priority(sources: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Union of sources, one row per key by source order; rows without key all stay."""
    stacked = None
    for k, source in enumerate(sources):
        part = source.withColumn("prioridad", F.lit(k))
        stacked = part if stacked is None else stacked.unionByName(part)
    w = Window.partitionBy(key).orderBy("prioridad", *order)
    keyed = stacked.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return keyed.unionByName(stacked.where(F.col(key).isNull()))
