"""Evaluation items that leak into training text.

The items are put into a BM25 inverted index with the largest impact of each block of
postings. Every passage of every document is a query; block-max WAND retrieves all items
whose score can reach their threshold, and what it retrieves is verified word by word:
the passage must hold ``run`` consecutive words of the item. An item's threshold is the
least score that any ``run`` of its words has by itself, and passages overlap by
``run - 1`` words, so nothing that the verification would accept is missed.

Scale: documents are read once and never shuffled; only hits are. The items go to the
workers in blocks of ``block`` items, one pass each, so what is shipped is bounded; a worker
process builds the index of a block once.

Defined results: null and empty texts hold nothing; items shorter than ``run`` words
can't leak; items that share their words are all reported; case, accents, punctuation,
blanks, markup and character escapes make no difference.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN, PASSAGE, BLOCK_SIZE, K1, B = 12, 24, 16, 1.2, 0.75
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_CONTROL = re.compile(r"\\[ntr](?![a-z])")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2}){2,}")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060\ufeff\u0300-\u036f]+")
_WORD = re.compile(r"[a-z0-9]+")
_NEXT = itemgetter(0)


def bare_words(text: str) -> list[str]:
    """Words without case, accents, markup and escapes."""
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), text)
        text = _CONTROL.sub(" ", text)
    if "%" in text:
        text = _PERCENT.sub(lambda m: unquote(m[0]), text)
    if "<" in text:
        text = _TAG.sub(" ", _uncommented(text))
    if any(c in text for c in "Ãâ"):
        text = _repaired(text)
    text = text.lower()
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text)


def _uncommented(text: str) -> str:
    """Markup comments taken out; an open one stays."""
    parts, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        parts.append(text[at:start])
        at = end + 3
    return " ".join([*parts, text[at:]])


def _repaired(text: str) -> str:
    """Single characters that were read as two, each by itself."""
    def back(m: re.Match) -> str:
        try:
            return m[0].encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return m[0]

    return re.sub("[ÂÃ][\u0080-¿‚-€Œ-ž]", back, text)


class ItemIndex:
    """BM25 postings of items with block maxima, and the items' words."""

    def __init__(self, ids: list, texts: list[str], run: int = RUN):
        kept = [(i, w) for i, w in ((i, bare_words(t)) for i, t in zip(ids, texts)) if len(w) >= run]
        self.run, self.ids = run, [i for i, _ in kept]
        lists = [w for _, w in kept]
        df = Counter(t for w in lists for t in set(w))
        mean = sum(map(len, lists)) / max(1, len(lists))
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.least: list[float] = []
        self.lists = lists
        for at, w in enumerate(lists):
            impact = {}
            for t, tf in Counter(w).items():
                idf = math.log(1 + (len(lists) - df[t] + 0.5) / (df[t] + 0.5))
                impact[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
                self.postings[t].append((at, impact[t]))
            spans = [w[k : k + run] for k in range(len(w) - run + 1)]
            self.least.append(min(sum(impact[t] for t in set(s)) for s in spans) - 1e-9)
        self.tops = {t: max(v for _, v in p) for t, p in self.postings.items()}
        self.blocks = {
            t: [(p[min(k + BLOCK_SIZE, len(p)) - 1][0], max(v for _, v in p[k : k + BLOCK_SIZE])) for k in range(0, len(p), BLOCK_SIZE)]
            for t, p in self.postings.items()
        }
        self.items = {t: [at for at, _ in p] for t, p in self.postings.items()}
        self.ends = {t: [end for end, _ in b] for t, b in self.blocks.items()}
        self.floor = min(self.least, default=math.inf)
        #: Least threshold among the items of each term.
        self.easiest = {t: min(self.least[at] for at, _ in p) for t, p in self.postings.items()}

    def runs(self, at: int) -> set[tuple[str, ...]]:
        """The different runs of an item; made when it is hit, since few are."""
        words = self.lists[at]
        return {tuple(words[k : k + self.run]) for k in range(len(words) - self.run + 1)}

    def retrieve(self, terms: set[str], floor: float | None = None) -> list[int]:
        """All items whose score by ``terms`` reaches their threshold, of those with a threshold of ``floor`` or more."""
        floor = self.floor if floor is None else floor
        lists = [t for t in terms if t in self.tops]
        if sum(self.tops[t] for t in lists) < floor:
            return []
        tops, postings, ends_of, blocks_of = self.tops, self.postings, self.ends, self.blocks
        cursors = [[self.items[t][0], 0, t] for t in lists]
        found = []
        while cursors:
            cursors.sort(key=_NEXT)
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += tops[t]
                if bound >= floor:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            # Block maxima at the pivot: if they can't reach the floor, skip past the nearest block end.
            ends, best = [], 0.0
            for _, _, t in cursors[: pivot + 1]:
                at = bisect_left(ends_of[t], doc)
                if at < len(ends_of[t]):
                    ends.append(ends_of[t][at])
                    best += blocks_of[t][at][1]
            if best < floor:
                after = min([e + 1 for e in ends] + [c[0] for c in cursors[pivot + 1 : pivot + 2]])
                target = max(after, doc + 1) if cursors[0][0] == doc else max(after, doc)
                self._advance(cursors, pivot, target)
            elif cursors[0][0] == doc:
                score = sum(postings[t][k][1] for d, k, t in cursors[: pivot + 1] if d == doc)
                if score >= self.least[doc]:
                    found.append(doc)
                self._advance(cursors, pivot, doc + 1)
            else:
                self._advance(cursors, pivot, doc)
            cursors = [c for c in cursors if c[0] is not None]
        return found

    def _advance(self, cursors: list[list], last: int, target: int) -> None:
        for c in cursors[: last + 1]:
            if c[0] < target:
                items = self.items[c[2]]
                c[1] = bisect_left(items, target, c[1])
                c[0] = items[c[1]] if c[1] < len(items) else None

    def leaks(self, text: str) -> dict:
        """Items in the text, each with its different runs that stand there."""
        words, found = bare_words(text), defaultdict(set)
        if len(words) < self.run:
            return found
        # An item with this run of words has all of them, so its threshold is at least each
        # word's easiest; a run is a query where the largest impacts of its words reach that.
        tops, easiest, run = self.tops, self.easiest, self.run
        streak, floors = 0, {}
        for k, w in enumerate(words):
            streak = streak + 1 if w in tops else 0
            if streak >= run:
                span = words[k - run + 1 : k + 1]
                floor = max(easiest[t] for t in span)
                if sum(tops[t] for t in set(span)) >= floor:
                    floors[k - run + 1] = floor
        upto = -1
        for start in floors:
            if start <= upto:
                continue
            upto = start
            while upto + 1 in floors and upto + 1 + run - start <= PASSAGE:
                upto += 1
            passage = words[start : upto + run]
            hits = self.retrieve(set(passage), min(floors[k] for k in range(start, upto + 1)))
            if hits:
                spans = {tuple(passage[k : k + run]) for k in range(len(passage) - run + 1)}
                for at in hits:
                    held = spans & self.runs(at)
                    if held:
                        found[at] |= held
        return {self.ids[at]: (len(held), len(held) / len(self.runs(at))) for at, held in found.items()}


def _finder(shipped, run: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A worker process keeps what was shipped to it, so it builds the index once for all its tasks.
        block = shipped.value
        if "index" not in block:
            block["index"] = ItemIndex(block["ids"], block["texts"], run)
        index = block["index"]
        for batch in batches:
            rows = [(d, i, n, share) for d, t in zip(batch["doc"], batch["text"]) for i, (n, share) in index.leaks(t).items()]
            yield pd.DataFrame(rows, columns=["doc", "item", "runs", "overlap"])

    return find


def leaked_items(docs: DataFrame, key: str, text: str, items: DataFrame, item_id: str, item_text: str, *,
                 run: int = RUN, block: int = 20_000) -> DataFrame:
    """(doc, item, runs, overlap): which items' words stand in which documents.

    ``runs`` is how many different runs of ``run`` words of the item (question, hint and
    answer alike) the document holds, ``overlap`` their share of the item's runs.
    """
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("text is not null and text <> ''")
    listed = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where(
        "id is not null and text is not null"
    ).distinct()
    blocks = max(1, -(-listed.count() // block))
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, item long, runs long, overlap double"
    parts = []
    for k in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).orderBy("id").toPandas()
        shipped = docs.sparkSession.sparkContext.broadcast({"ids": part["id"].tolist(), "texts": part["text"].tolist()})
        parts.append(rows.mapInPandas(_finder(shipped, run), schema))
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("doc", "item").agg(F.max("runs").alias("runs"), F.max("overlap").alias("overlap"))
