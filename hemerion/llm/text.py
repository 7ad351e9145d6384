"""Text helpers that run inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

_MARKS = re.compile("[\u0300-\u036f]+")
_MOJIBAKE = re.compile("[ÃÂâ]")
_WORD = re.compile(r"[a-z0-9]+")


def repair(text: str) -> str:
    """UTF-8 that was read as a single-byte encoding, if the whole text decodes back."""
    if _MOJIBAKE.search(text):
        for encoding in ("cp1252", "latin-1"):
            try:
                return text.encode(encoding).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return text


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    return _MARKS.sub("", unicodedata.normalize("NFD", text))


def words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def edits(a: str, b: str, limit: int) -> int:
    """Letters added, lost or changed between two words, or ``limit + 1``."""
    return distance(a, b, limit, swaps=False)


def distance(a: str, b: str, limit: int, swaps: bool = True) -> int:
    """Edits (with ``swaps`` a swap of neighbours counts one) between two words, or ``limit + 1``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new, least = [i], i
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if swaps and before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
            least = min(least, cost)
        if least > limit:
            return limit + 1
        before, row = row, new
    return row[-1] if row[-1] <= limit else limit + 1


def deletions(word: str, most: int) -> set[str]:
    """The word and all it can become by losing up to ``most`` letters."""
    found, edge = {word}, {word}
    for _ in range(most):
        edge = {w[:k] + w[k + 1 :] for w in edge for k in range(len(w)) if len(w) > 1}
        found |= edge
    return found


def slices(texts: list[str], most_chars: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts whose lengths add up to ``most_chars`` or hold a single text."""
    run: list[str] = []
    size = 0
    for text in texts:
        if run and size + len(text) > most_chars:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run
