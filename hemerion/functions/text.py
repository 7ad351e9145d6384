"""Normalisation, tokens and similarity as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Lower-case letters with marks and the letter each decomposes to."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != char and char == char.lower():
            source.append(char)
            target.append(base)
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(source) + marks, "".join(target)


_ACCENTED, _PLAIN = _fold_table()

#: The blanks that count as a plain space.
EXOTIC_SPACES = "              　"


def normalize_spaces(c: Column) -> Column:
    """Exotic blanks become a plain space; the length stays."""
    return F.translate(c, EXOTIC_SPACES, " " * len(EXOTIC_SPACES))


def plain(c: Column) -> Column:
    """Lower case without accents; punctuation stays; null becomes ''."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), _ACCENTED, _PLAIN)


def plain_words(c: Column) -> Column:
    """``plain`` with everything but ``a-z0-9`` turned into single blanks."""
    return F.trim(F.regexp_replace(plain(c), "[^a-z0-9]+", " "))


def comparison_key(c: Column) -> Column:
    """Key under which spellings of one outlet name agree.

    Drops a leading article, then one support word, then an article again, and all
    blanks. Falls back to the unreduced form when nothing would be left.
    """
    words = plain_words(c)
    article = "^(?:el|la|los|las) "
    # The support words that say nothing about identity.
    support = "^(?:revista|periodico|portal|semanario|agencia|sitio) "
    reduced = F.regexp_replace(F.regexp_replace(F.regexp_replace(words, article, ""), support, ""), article, "")
    return F.regexp_replace(F.coalesce(F.nullif(reduced, F.lit("")), words), " ", "")


def bag_of_words(c: Column, stop: list[str], min_length: int = 4) -> Column:
    """Distinct accent-free tokens of ``min_length`` or more, without stop words."""
    tokens = F.regexp_extract_all(plain(c), F.lit(f"([a-z0-9]{{{min_length},}})"), F.lit(1))
    return F.array_except(F.array_distinct(tokens), F.array(*[F.lit(w) for w in stop]).cast("array<string>"))


def tokens(c: Column, stop: list[str]) -> Column:
    """Accent-free alphabetic tokens longer than two letters; repeats are kept."""
    found = F.regexp_extract_all(plain(c), F.lit("([a-z]+)"), F.lit(1))
    listed = F.array(*[F.lit(w) for w in stop]).cast("array<string>")
    return F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(listed, w))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\\s+"), lambda w: w != ""))


def excerpt(c: Column, n: int = 300) -> Column:
    """Whitespace collapsed; longer text is cut at the last blank before ``n`` and marked."""
    flat = F.trim(F.regexp_replace(c, "\\s+", " "))
    head = F.substring(flat, 1, n)
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("…")))


def capitalised_words(c: Column, function_words: list[str]) -> Column:
    """How many words start in upper case, function words aside."""
    listed = F.array(*[F.lit(w) for w in function_words]).cast("array<string>")
    words = F.split(F.trim(c), "\\s+")
    return F.size(F.filter(words, lambda w: w.rlike("^\\p{Lu}") & ~F.array_contains(listed, F.lower(w))))


def upper_first(c: Column) -> Column:
    """Only the first character is raised; the rest stays as typed."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def within_distance(a: Column, b: Column, limit: int = 2) -> Column:
    return F.levenshtein(a, b, limit).between(0, limit)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def sentences(c: Column) -> Column:
    """Pieces after ``. ? ! …`` plus blank, or between lines; blank pieces are dropped."""
    pieces = F.split(F.coalesce(c, F.lit("")), "(?<=[.?!…])\\s+|\\n+")
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")


def stable_id(c: Column) -> Column:
    """``<conf>-h<thread>-t<order>`` without the thread, which moves; other ids stay."""
    return F.regexp_replace(c, "^(.+?)-h\\d+-t(\\d+)$", "$1-t$2")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Display form of a share; a dash when the base is zero."""
    value = F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)
    return F.coalesce(F.concat(F.format_number(value, digits), F.lit(" %")), F.lit("—"))


def plural(n: Column, one: str, many: str) -> Column:
    """The number with the word that fits it."""
    return F.concat(whole_number(n), F.lit(" "), F.when(n == 1, one).otherwise(many))


def whole_number(n: Column) -> Column:
    """Thousands between commas; a dash for null."""
    return F.coalesce(F.format_number(n, 0), F.lit("—"))
