"""Phrase search: a small language compiled to one Java pattern over folded text."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemerion.functions.text import plain


def _folded(phrase: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", phrase.lower()) if unicodedata.category(c) != "Mn")


def phrase_pattern(phrase: str) -> str:
    """``a|b`` means either; ``*`` at an end leaves that end open; blanks are any white space.

    An end is a word's end only where it is a letter or figure. An empty phrase raises.
    """
    parts = []
    for option in phrase.split("|"):
        text = _folded(option).strip()
        if not text:
            continue
        words = text.strip("*").split()
        if not words:
            raise ValueError(f"empty phrase: {phrase!r}")
        body = "\\s+".join(re.sub(r"([^a-z0-9])", r"\\\1", w) if w.isascii() else re.escape(w) for w in words)
        head = "" if text[0] == "*" or not words[0][0].isalnum() else "\\b"
        tail = "" if text[-1] == "*" or not words[-1][-1].isalnum() else "\\b"
        parts.append(f"(?:{head}{body}{tail})")
    if not parts:
        raise ValueError(f"empty phrase: {phrase!r}")
    return "|".join(parts)


def matches(text: Column, any_of: list[str] = (), all_of: list[str] = ()) -> Column:
    """Any of the first and all of the second; an empty list asks for nothing."""
    folded = plain(text)
    tests = [folded.rlike("|".join(phrase_pattern(p) for p in any_of))] if any_of else []
    tests += [folded.rlike(phrase_pattern(p)) for p in all_of]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def search(exchanges: DataFrame, *, any_of: list[str] = (), all_of: list[str] = (), scope: str = "ambos", first: str | None = None,
           last: str | None = None, reporter: str | None = None, outlet: str | None = None, responder: str | None = None,
           limit: int | None = None) -> DataFrame:
    """Exchanges that match, by date and reporter.

    ``scope`` is pregunta, respuesta or ambos; a question's scope takes in its subject.
    ``responder`` also narrows the searched answers to that person's. Cheap filters come
    first; dates are compared on the column, so they reach the scan.
    """
    found = exchanges
    if first:
        found = found.where(F.col("fecha") >= F.lit(first).cast("date"))
    if last:
        found = found.where(F.col("fecha") <= F.lit(last).cast("date"))
    for value, column in ((reporter, "periodista"), (outlet, "medio")):
        if value:
            found = found.where(plain(F.col(column)).contains(_folded(value)))
    answers = F.col("respuestas")
    if responder:
        answers = F.filter(answers, lambda r: plain(r.quien).contains(_folded(responder)))
        found = found.where(F.size(answers) > 0)
    answered = F.array_join(F.transform(answers, lambda r: F.coalesce(r.texto, F.lit(""))), "\n")
    asked = [F.col("pregunta")] + ([F.col("asunto")] if "asunto" in exchanges.columns else [])
    texts = {"pregunta": asked, "respuesta": [answered], "ambos": [*asked, answered]}[scope]
    found = found.where(matches(F.concat_ws("\n", *texts), any_of, all_of))
    ordered = [F.col(c).asc_nulls_last() for c in ("fecha", "periodista", "conferencia_id", "orden") if c in found.columns]
    found = found.orderBy(*ordered)
    return found.limit(limit) if limit else found


def until(df: DataFrame, day: Column, cut: str) -> DataFrame:
    """Rows up to the cut date, the day itself included; days are ISO text or dates. What is counted after it depends on the cut."""
    return df.where(day <= F.lit(cut))
