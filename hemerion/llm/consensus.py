"""Consensus labels from several annotators by a competence-and-spamming mixture.

Each label is either truthful (with the annotator's competence) or drawn from the
annotator's own guess distribution; the item's true label has a prior. Expectation
maximisation gives the posterior of every item's label, every annotator's competence
and guesses. It runs until the largest change is under ``tolerance`` and raises if that
takes more than ``rounds`` rounds (1,000 unless given). After two steps it leaps to where
they are heading (squared extrapolation) and goes back if the next step is larger than the
one before the leap, so it ends at the same point in less than half of the rounds.

Scale: labels are made distinct per item and annotator, items with the same labels from
the same annotators are one pattern with a count, and every round sends only sums per
annotator and label to the driver (``max_annotators`` bounds them and is checked). An
item holds one label per annotator, so no group grows with the items.

Defined results: null, blank and unknown labels count as no answer; of two answers of
one annotator to one item the later one holds (the larger label in a tie); an item
without labels gets none; equally likely labels give the first in ``labels`` order; a
lone label's agreement is null; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemerion.functions.text import plain_words
from hemerion.session import materialize


@dataclass
class Mixture:
    """Parameters: competence[a], guesses[a, label], prior[label]."""

    annotators: list
    competence: np.ndarray
    guesses: np.ndarray
    prior: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.competence, self.guesses.ravel(), self.prior])


def clean_label(c: Column, labels: list[str]) -> Column:
    """The label meant, whatever its case, accents, blanks and signs; else null."""
    key = plain_words(F.regexp_replace(c, "_", " "))
    found = F.lit(None).cast("string")
    for label in labels:
        found = F.when(key == plain_words(F.lit(label)), F.lit(label)).otherwise(found)
    return found


def distinct_votes(df: DataFrame, item: str, annotator: str, label: str, arrived: str, labels: list[str]) -> DataFrame:
    """(item, annotator, label), one row per item and annotator."""
    rows = df.select(
        F.col(item).alias("item"), F.col(annotator).alias("annotator"), clean_label(F.col(label), labels).alias("label"),
        F.col(arrived).alias("arrived"),
    ).where("item is not null and annotator is not null and label is not null")
    return rows.groupBy("item", "annotator").agg(F.max(F.struct("arrived", "label")).getField("label").alias("label"))


def _patterns(votes: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(item, pattern) and (pattern, n); a pattern lists annotators and label numbers."""
    number = F.create_map(*[x for k, v in enumerate(labels) for x in (F.lit(v), F.lit(k))])[F.col("label")]
    listed = votes.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("annotator", number.alias("label")))).alias("votes"))
    items = listed.select(
        "item", F.col("votes.annotator").alias("annotators"), F.col("votes.label").alias("marks"),
    )
    items = materialize(items, "items")
    return items, materialize(items.groupBy("annotators", "marks").agg(F.count("*").alias("n")), "patterns")


def posterior(annotators, marks, model: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posterior[item, label], item of each vote, annotator, label)."""
    place = {a: k for k, a in enumerate(model.annotators)}
    sizes = np.array([len(m) for m in marks])
    item = np.repeat(np.arange(len(sizes)), sizes)
    who = np.array([place[a] for row in annotators for a in row], dtype=np.int64)
    what = np.array([m for row in marks for m in row], dtype=np.int64)
    theta, xi = model.competence[who], model.guesses[who, what]
    like = np.repeat(((1 - theta) * xi)[:, None], len(model.prior), axis=1)
    like[np.arange(len(what)), what] += theta
    scores = np.tile(np.log(model.prior), (len(sizes), 1))
    np.add.at(scores, item, np.log(np.maximum(like, 1e-300)))
    scores -= scores.max(axis=1, keepdims=True)
    post = np.exp(scores)
    return post / post.sum(axis=1, keepdims=True), item, who, what


def _expect(model: Mixture):
    """Sums of one round: annotator -1 holds the labels' expected counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = len(model.annotators)
        truth, spam = np.zeros((count, len(model.prior))), np.zeros((count, len(model.prior)))
        prior = np.zeros(len(model.prior))
        for batch in batches:
            if not len(batch):
                continue
            post, item, who, what = posterior(batch["annotators"], batch["marks"], model)
            weight = batch["n"].to_numpy()
            prior += (post * weight[:, None]).sum(axis=0)
            theta = model.competence[who]
            sure = post[item, what] * theta / np.maximum(theta + (1 - theta) * model.guesses[who, what], 1e-300)
            np.add.at(truth, (who, what), sure * weight[item])
            np.add.at(spam, (who, what), (1 - sure) * weight[item])
        k, j = np.nonzero(truth + spam)
        yield pd.DataFrame({
            "k": np.concatenate([k, np.full(len(prior), -1)]), "label": np.concatenate([j, np.arange(len(prior))]),
            "truth": np.concatenate([truth[k, j], prior]), "spam": np.concatenate([spam[k, j], np.zeros(len(prior))]),
        })

    return run


def fit(patterns: DataFrame, labels: list[str], *, rounds: int = 1000, tolerance: float = 1e-5, smooth: float = 0.1,
        max_annotators: int = 100_000) -> Mixture:
    """Expectation maximisation over the patterns; raises if ``rounds`` don't bring the largest change under ``tolerance``."""
    annotators = [
        r.a for r in patterns.select(F.explode("annotators").alias("a")).distinct().orderBy("a").limit(max_annotators + 1).collect()
    ]
    if len(annotators) > max_annotators:
        raise ValueError(f"more than {max_annotators} annotators")
    size = len(labels)
    model = Mixture(annotators, np.full(len(annotators), 0.7), np.full((len(annotators), size), 1 / size), np.full(size, 1 / size))
    if not annotators:
        return model
    before, fallback, moved = None, None, np.inf
    for _ in range(rounds):
        new = _round(patterns, model, smooth)
        moved = np.abs(new.flat() - model.flat()).max()
        if moved < tolerance:
            return new
        if fallback is not None and moved > fallback[1]:
            # The leap led away: go on from where it started.
            before, model, fallback = None, fallback[0], None
        elif before is None:
            before, model, fallback = model, new, None
        else:
            # Two steps show where the sequence is heading; leap there, unless that leads away.
            leap = _leap(before, model, new)
            before, model, fallback = None, leap, (new, moved)
    raise ValueError(f"the largest change is still {moved:.2g} after {rounds} rounds")


def _round(patterns: DataFrame, model: Mixture, smooth: float) -> Mixture:
    """One step of expectation maximisation: a job that sends only sums to the driver."""
    size = len(model.prior)
    sums = (
        patterns.mapInPandas(_expect(model), "k long, label long, truth double, spam double")
        .groupBy("k", "label").agg(F.sum("truth").alias("truth"), F.sum("spam").alias("spam")).toPandas()
        .sort_values(["k", "label"])
    )
    truth, spam = np.zeros_like(model.guesses), np.zeros_like(model.guesses)
    prior = np.zeros(size)
    for k, label, t, s in sums.itertuples(index=False):
        if k < 0:
            prior[label] = t
        else:
            truth[k, label], spam[k, label] = t, s
    competence = (truth.sum(axis=1) + smooth) / (truth.sum(axis=1) + spam.sum(axis=1) + 2 * smooth)
    guesses = (spam + smooth) / (spam.sum(axis=1, keepdims=True) + size * smooth)
    return Mixture(model.annotators, competence, guesses, (prior + smooth) / (prior.sum() + size * smooth))


def _leap(start: Mixture, first: Mixture, second: Mixture, edge: float = 1e-6) -> Mixture:
    """Squared extrapolation of three models of a sequence, kept inside the bounds of probabilities."""
    step = first.flat() - start.flat()
    turn = second.flat() - first.flat() - step
    far = max(1.0, float(np.sqrt(step @ step / max(turn @ turn, 1e-300))))
    flat = start.flat() + 2 * far * step + far * far * turn
    count, size = start.guesses.shape
    competence = np.clip(flat[:count], edge, 1 - edge)
    guesses = np.clip(flat[count : count + count * size].reshape(count, size), edge, None)
    prior = np.clip(flat[count + count * size :], edge, None)
    return Mixture(start.annotators, competence, guesses / guesses.sum(axis=1, keepdims=True), prior / prior.sum())


def _decide(model: Mixture, labels: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            post, _, _, _ = posterior(batch["annotators"], batch["marks"], model)
            best = post.argmax(axis=1)
            agree = []
            for marks in batch["marks"]:
                counts, n = np.bincount(np.asarray(marks)), len(marks)
                agree.append(float((counts * (counts - 1)).sum() / (n * (n - 1))) if n > 1 else None)
            yield pd.DataFrame({
                "item": batch["item"], "label": [labels[k] for k in best], "sure": post.max(axis=1),
                "votes": [len(m) for m in batch["marks"]], "agreement": pd.Series(agree, index=batch.index, dtype="float64"),
            })

    return run


def consensus(votes: DataFrame, labels: list[str], **options) -> tuple[DataFrame, Mixture]:
    """((item, label, sure, votes, agreement), fitted mixture) for ``distinct_votes`` rows.

    ``agreement`` is the share of an item's pairs of labels that agree.
    """
    items, patterns = _patterns(votes, labels)
    model = fit(patterns, labels, **options)
    item = items.schema["item"].dataType.simpleString()
    schema = f"item {item}, label string, sure double, votes int, agreement double"
    return items.mapInPandas(_decide(model, labels), schema), model


def agreement(votes: DataFrame) -> DataFrame:
    """(item, votes, agreement) of ``distinct_votes`` rows: the share of an item's pairs of labels that agree, null for a lone label."""
    per = votes.groupBy("item", "label").agg(F.count("*").alias("n"))
    summed = per.groupBy("item").agg(F.sum("n").alias("v"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    return summed.select("item", F.col("v").cast("int").alias("votes"), F.try_divide(F.col("same"), F.col("v") * (F.col("v") - 1)).alias("agreement"))
