"""Similarity joins on word sets and clustering around representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemerion.functions.text import bag_of_words
from hemerion.operators.setpairs import KEYS, LISTED, LONG, PAIRS, first_common, least, meet
from hemerion.session import materialize

#: Words without weight in a subject.
STOP = "de la el los las en y a con por para del al su sus un una unos unas sobre que se le lo ante tras entre".split()


def subject_bag(c: Column) -> Column:
    return bag_of_words(c, STOP)


def jaccard_pairs(sets: DataFrame, key: str, words: str, threshold: float) -> DataFrame:
    """(a, b, jaccard): pairs a < b of rows whose word sets reach the threshold.

    Sets meet under keys of their rarest words and are told apart where they meet, so only pairs that
    reach the threshold leave a task (``setpairs``). Sets of more than ``LONG`` words and all that are long enough to be
    their partners are joined on the words they may share. Keys travel as numbers.
    """
    rows = sets.select(F.xxhash64(key).alias("id"), F.col(key).alias("key"), F.col(words).alias("words")).where(F.size(words) > 0)
    rows = materialize(rows, "sets")
    frequency = materialize(rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "frequency")
    rare_below = (frequency.agg(F.sum("df")).first()[0] or 0) / LISTED
    counts = {r.word: r.df for r in frequency.where(F.col("df") >= rare_below).collect()}
    short = rows.where(F.size("words") <= LONG).select("id", "words", F.lit(None).cast("int").alias("changed"))
    keyed = short.mapInPandas(first_common(threshold, lambda words, own: words, counts), KEYS)
    near = keyed.repartition("key").sortWithinPartitions("key").mapInPandas(meet(threshold), PAIRS)
    if not rows.where(F.size("words") > LONG).isEmpty():
        near = near.unionByName(_long_pairs(rows.where(F.size("words") >= least(LONG + 1, threshold)), frequency, threshold))
    near = near.distinct()
    both = near.join(rows.select(F.col("id").alias("a"), F.col("key").alias("k"), F.col("words").alias("x")), "a").join(
        rows.select(F.col("id").alias("b"), F.col("key").alias("m"), F.col("words").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    value = common / (F.size("x") + F.size("y") - common)
    found = both.withColumn("jaccard", value).where(F.col("jaccard") >= threshold - 1e-12)
    return found.select(F.least("k", "m").alias("a"), F.greatest("k", "m").alias("b"), "jaccard")


def _long_pairs(rows: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """(a, b): ids of rows that share one of their rarest words.

    Of ``n`` words it is enough to join on the first ``n - ceil(t n) + 1`` by ascending frequency.
    """
    exploded = rows.select("id", F.size("words").alias("n"), F.explode("words").alias("word"))
    w = Window.partitionBy("id").orderBy("df", "word")
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    kept = exploded.join(frequency, "word").withColumn("at", F.row_number().over(w)).where(F.col("at") <= prefix).select("id", "n", "word")
    kept = materialize(kept, "prefix")
    a = kept.select("word", F.col("id").alias("a"), F.col("n").alias("n_a"))
    b = kept.select("word", F.col("id").alias("b"), F.col("n").alias("n_b"))
    fits = (F.col("n_a") >= F.col("n_b") * threshold - 1e-9) & (F.col("n_b") >= F.col("n_a") * threshold - 1e-9)
    return a.join(b, "word").where((F.col("a") < F.col("b")) & fits).select("a", "b")


def consolidate(counts: DataFrame, subject: str, n: str, threshold: float = 0.6, rounds: int = 200) -> DataFrame:
    """(asunto, canonico): every subject with its representative, without chaining.

    Subjects go by frequency, then name; each joins the earliest representative that is
    similar enough, or becomes one. A subject is decided once all earlier neighbours are;
    the rounds decide all that can be decided at once. Without words it stands by itself.
    """
    nodes = materialize(
        counts.select(F.col(subject).alias("asunto"), F.col(n).alias("n"), subject_bag(F.col(subject)).alias("words")), "subjects"
    )
    pairs = jaccard_pairs(nodes, "asunto", "words", threshold)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size_a = nodes.select(F.col("asunto").alias("a"), F.col("n").alias("n_a"))
    size_b = nodes.select(F.col("asunto").alias("b"), F.col("n").alias("n_b"))
    before = both.join(size_a, "a").join(size_b, "b").where("n_a > n_b or (n_a = n_b and a < b)").select("a", "n_a", "b")
    before = materialize(before, "before")
    later = before.select(F.col("b").alias("asunto")).distinct()
    decided = nodes.join(later, "asunto", "left_anti").select("asunto", F.col("asunto").alias("canonico"))
    # Edges to undecided subjects, with whether the earlier one is a representative; null while that is open.
    first = before.join(later.select(F.col("asunto").alias("a"), F.lit(True).alias("__later")), "a", "left")
    edges = materialize(first.select("a", "n_a", "b", F.when(F.col("__later").isNull(), F.lit(True)).alias("rep")), "edges")
    rank = F.struct(-F.col("n_a"), F.col("a"))
    for _ in range(rounds):
        if edges.isEmpty():
            return decided
        state = edges.groupBy("b").agg(F.min(F.when(F.col("rep"), rank)).alias("best"), F.min(F.when(F.col("rep").isNull(), rank)).alias("open"))
        # Nothing that is still open comes before the earliest representative, so what is open can't change the choice.
        ready = state.where("open is null or best < open")
        fresh = materialize(ready.select(F.col("b").alias("asunto"), F.coalesce("best.a", "b").alias("canonico")), "fresh")
        decided = decided.unionByName(fresh)
        told = fresh.select(F.col("asunto").alias("a"), (F.col("asunto") == F.col("canonico")).alias("__rep"))
        left = edges.join(fresh.select(F.col("asunto").alias("b")), "b", "left_anti").join(told, "a", "left")
        edges = materialize(left.select("a", "n_a", "b", F.coalesce("rep", "__rep").alias("rep")), "edges")
    raise ValueError("subjects are chained deeper than the rounds allow")


def vocabulary_distances(words: DataFrame, owner: str, word: str) -> DataFrame:
    """(a, b, comunes, distancia): Jaccard distance of the owners' word sets."""
    distinct = words.select(F.col(owner).alias("o"), F.col(word).alias("w")).distinct()
    sizes = distinct.groupBy("o").agg(F.count("*").alias("n"))
    a, b = distinct.select(F.col("o").alias("a"), "w"), distinct.select(F.col("o").alias("b"), "w")
    common = a.join(b, "w").where("a < b").groupBy("a", "b").agg(F.count("*").alias("comunes"))
    sized = common.join(sizes.select(F.col("o").alias("a"), F.col("n").alias("n_a")), "a").join(
        sizes.select(F.col("o").alias("b"), F.col("n").alias("n_b")), "b"
    )
    distance = 1 - F.col("comunes") / (F.col("n_a") + F.col("n_b") - F.col("comunes"))
    return sized.select("a", "b", "comunes", F.round(distance, 6).alias("distancia"))


def average_linkage(names: list[str], distances: dict[tuple[str, str], float]) -> list[tuple[list[str], list[str], float]]:
    """Merges of an average-linkage clustering of a few owners, closest first.

    Takes the collected result of ``vocabulary_distances`` for at most some dozens of
    owners; missing pairs are 1 apart.
    """
    groups = [[n] for n in sorted(names)]
    merges = []

    def apart(x: list[str], y: list[str]) -> float:
        total = sum(distances.get((min(i, j), max(i, j)), 1.0) for i in x for j in y)
        return total / (len(x) * len(y))

    while len(groups) > 1:
        value, i, j = min((apart(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        merges.append((groups[i], groups[j], value))
        joined = groups[i] + groups[j]
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [joined]
    return merges
