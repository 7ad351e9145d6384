"""Free-entered values mapped to the entries of a reference list.

Every distinct value is looked at once. A multi-pattern automaton over the canonical
names and their aliases (run together, turned round, initials, without legal form)
finds embedded mentions; the longest non-overlapping match wins. Values without a
mention go to token-set similarity, where words agree by slip or abbreviation and the
candidates come from an index of words with letters left out. A value that matches
nothing, or two entries equally well, is reported with ``UNMATCHED``.

Scale: values are made distinct before matching, so a hot value costs one look-up; the
answers return by an equi-join. The list is read in shards of ``shard`` entries, each
shipped to the workers by itself, so what is shipped is bounded whatever the list's
size. A shard gives its mentions and best similarities; they are weighed over all shards
in one grouped step, and how common a word is and whether initials are one name's is
counted over the whole list, so the answers don't depend on the shards.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemerion.llm.text import deletions, distance, fold, repair
from hemerion.session import materialize

UNMATCHED = -1
#: Words around an outlet's name that don't belong to it.
DESCRIPTORS = frozenset(
    "el la los las lo un una de del desde en para por y e a revista periodico portal semanario agencia sitio canal diario "
    "radio corresponsal reportero reportera enviado enviada prensa web pagina com mx tv online digital oficial linea noticias "
    "medio grupo red matriz sucursal antes".split()
)
#: Words without weight inside a name.
LIGHT = frozenset("el la los las de del y e".split())
#: Legal forms after folding; blanks may be missing.
LEGAL = [
    "sociedad anonima promotora de inversion de capital variable", "sociedad anonima de capital variable",
    "sociedad de responsabilidad limitada de capital variable", "sociedad civil", "asociacion civil", "s a p i de c v",
    "s de r l de c v", "s r l de c v", "s a de c v", "s a p i", "s de r l", "s r l", "s a", "s c", "a c",
]
#: Shortest run of letters that is compared as a name typed without blanks.
SHORTEST_GLUED = 8
_LEGAL = re.compile(r"(?: (?:" + "|".join(x.replace(" ", " ?") for x in sorted(LEGAL, key=len, reverse=True)) + r"))+ *$")
_CAMEL = re.compile(r"(?<=[a-záéíóúüñ])(?=[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ])")
_NOT_WORD = re.compile(r"[^a-z0-9]+")
_PLACE = re.compile(r"(?i),\s*(?:de|del|desde|en)\s.*$|\(.*?\)")
_REMARK = re.compile(r"\(.*?\)|\s/\s.*$|\*+")


def normal(value: str) -> str:
    """Folded words between single blanks, one blank at either end."""
    return " " + _NOT_WORD.sub(" ", fold(_CAMEL.sub(" ", repair(value)))).strip() + " "


def without_form(text: str) -> str:
    return _LEGAL.sub(" ", text)


def allowed(word: str) -> int:
    """Slips that a word of a name may have."""
    return 2 if len(word) > 5 else 1


@dataclass
class Evidence:
    """What one shard knows of a value: its mentions and its most similar entries."""

    mentions: list[tuple[int, int, str, int]]
    similar: list[tuple[float, int]]
    glued: list[tuple[float, int]]


class Catalogue:
    """Automaton and word index over one shard of the list.

    ``common`` holds words of more than two names and ``unique`` the initials of a single
    name, both over the whole list; without them the shard is the whole list.
    """

    def __init__(self, ids: list[int], names: list[str], legal: bool, common: set[str] | None = None, unique: set[str] | None = None):
        self.legal, self.ids = legal, ids
        self.names = [entry_words(name, legal) for name in names]
        self.heavy = [[w for w in parts if w not in LIGHT] for parts in self.names]
        if common is None:
            seen = Counter(w for heavy in self.heavy for w in set(heavy))
            common = {w for w, n in seen.items() if n > 2}
        shorts = [initials(heavy) for heavy in self.heavy]
        if unique is None:
            counted = Counter(s for s in shorts if s)
            unique = {s for s, n in counted.items() if n == 1}
        # A word of many names says what kind of name it is, not which.
        self.weights = [[len(w) * (0.35 if w in common else 1.0) for w in heavy] for heavy in self.heavy]
        self.patterns: dict[str, list[int]] = defaultdict(list)
        holders: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, (parts, heavy, short) in enumerate(zip(self.names, self.heavy, shorts)):
            forms = {" ".join(parts)}
            if len(parts) > 1:
                forms |= {"".join(parts), " ".join([parts[-1], *parts[:-1]])}
            if short in unique:
                forms |= {short, " ".join(short)}
            for form in forms - {""}:
                self.patterns[f" {form} "].append(at)
            for k, w in enumerate(heavy):
                if len(w) > 3:
                    holders[w].append((at, k))
        self.holders = [(w, found) for w, found in holders.items()]
        self.words = Deletions([w for w, _ in self.holders], [allowed(w) for w, _ in self.holders])
        self.whole = Deletions(["".join(parts) for parts in self.names], [1] * len(self.names))

    @property
    def automaton(self):
        if not hasattr(self, "_automaton"):
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for pattern, found in self.patterns.items():
                self._automaton.add_word(pattern, (pattern, found))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def mentions(self, text: str) -> list[tuple[int, int, str, int]]:
        """Every mention in the text as (start, end, pattern, entry)."""
        found = []
        if text.strip() and len(self.automaton):
            for end, (pattern, entries) in self.automaton.iter(text):
                found += [(end - len(pattern) + 1, end, pattern, self.ids[at]) for at in entries]
        return found

    def evidence(self, value: str, least: float) -> Evidence:
        """Every mention in the value and, for each kind of similarity, the two best entries that could decide it."""
        text, typed, joined, dotted = self.read(value)
        if not text.strip():
            return Evidence([], [], [])
        similar = self.similar(typed, dotted)[:2]
        # Names run together only decide where no shard has a similar one.
        return Evidence(self.mentions(text), similar, [] if similar and similar[0][0] >= least else self.glued(joined)[:2])

    def read(self, value: str) -> tuple[str, list[str], str, set[str]]:
        """(text for mentions, words for similarity, words run together, words with a dot)."""
        text = normal(_REMARK.sub(" ", value) if self.legal else value)
        if self.legal:
            text = without_form(text)
        dotted = {fold(w) for w in re.findall(r"(\w+)\.", value)}
        bare = text if self.legal else normal(_PLACE.sub(" ", value))
        return text, bare.split(), bare.replace(" ", ""), dotted

    def similar(self, parts: list[str], dotted: set[str]) -> list[tuple[float, int]]:
        """Entries by token-set similarity, best first."""
        typed = [w for w in parts if w not in LIGHT]
        near: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
        for i, w in enumerate(typed):
            if len(w) > 3:
                for known in self.words.near(w, 2):
                    word, places = self.holders[known]
                    slip = distance(w, word, allowed(word))
                    if slip <= allowed(word):
                        for at, k in places:
                            if k not in near[at] or slip < near[at][k][0]:
                                near[at][k] = (slip, i)
        scored = []
        for at, pairs in near.items():
            name, weights, used = self.heavy[at], self.weights[at], {i for _, i in pairs.values()}
            weight = sum(weights)
            total = sum(weights[k] * (1 - slip / max(4, len(name[k])) / 2) for k, (slip, _) in sorted(pairs.items()))
            for k, w in enumerate(name):
                if k in pairs:
                    continue
                for i, t in enumerate(typed):
                    if i not in used and abbreviates(t, w, t in dotted):
                        total += weights[k] * 0.9
                        used.add(i)
                        break
            extra = sum(len(t) for i, t in enumerate(typed) if i not in used and t not in DESCRIPTORS)
            scored.append((total / (weight + extra), self.ids[at]))
        return _best_first(scored)

    def glued(self, typed: str) -> list[tuple[float, int]]:
        """Names typed without blanks and with up to two slips; short words are left to exact mentions."""
        if len(typed) < SHORTEST_GLUED:
            return []
        out = []
        for at in self.whole.near(typed, 2):
            name = "".join(self.names[at])
            slip = distance(typed, name, 2)
            if slip <= 2:
                out.append((1 - slip / len(name), self.ids[at]))
        return _best_first(out)

    def look_up(self, value: str, least: float) -> list[tuple[int, float]]:
        """Entries that the value names, with scores, where this shard is the whole list; each kind of evidence only if the one before doesn't decide."""
        text, typed, joined, dotted = self.read(value)
        if not text.strip():
            return []
        certain = by_mentions(value, self.mentions(text), self.legal)
        if certain:
            return certain
        similar = self.similar(typed, dotted)[:2]
        return by_similarity(similar, [] if similar and similar[0][0] >= least else self.glued(joined)[:2], least)


def _best_first(scored: list[tuple[float, int]]) -> list[tuple[float, int]]:
    return sorted(scored, key=lambda x: (-x[0], x[1]))


class Deletions:
    """Words under the digests of all they become by losing letters, as two sorted arrays."""

    def __init__(self, words: list[str], most: list[int]):
        keys, owners = [], []
        for at, (word, n) in enumerate(zip(words, most)):
            found = deletions(word, n)
            keys += [_digest(d) for d in found]
            owners += [at] * len(found)
        keys, owners = np.array(keys, dtype=np.uint64), np.array(owners, dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]

    def near(self, word: str, most: int) -> list[int]:
        """Numbers of the words that share a form with ``word``."""
        asked = np.fromiter((_digest(d) for d in deletions(word, most)), dtype=np.uint64)
        first = np.searchsorted(self.keys, asked)
        hit = self.keys[np.minimum(first, len(self.keys) - 1)] == asked if len(self.keys) else np.zeros(0, dtype=bool)
        last = np.searchsorted(self.keys, asked[hit], "right")
        return sorted({int(at) for a, b in zip(first[: len(hit)][hit], last) for at in self.owners[a:b]})


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def entry_words(name: str, legal: bool) -> list[str]:
    text = normal(name)
    return (without_form(text) if legal else text).split()


def initials(heavy: list[str]) -> str:
    """Initials of a name of four words or more, else ''."""
    return "".join(w[0] for w in heavy) if len(heavy) >= 4 else ""


def longest_first(found: list[tuple[int, int, str, list[int]]]) -> list[tuple[int, int, str, list[int]]]:
    """The longest matches that don't overlap, in the order of the text; blanks at their ends may be shared."""
    taken: list[tuple[int, int, str, list[int]]] = []
    for m in sorted(found, key=lambda m: (m[0] - m[1], m[0])):
        if all(m[0] >= t[1] or m[1] <= t[0] for t in taken):
            taken.append(m)
    return sorted(taken)


def settle(value: str, e: Evidence, legal: bool, least: float) -> list[tuple[int, float]]:
    """Entries that the value names, by what all shards know; exact mentions score 2 and their length."""
    return by_mentions(value, e.mentions, legal) or by_similarity(e.similar, e.glued, least)


def by_mentions(value: str, mentions: list[tuple[int, int, str, int]], legal: bool) -> list[tuple[int, float]]:
    """Entries mentioned, if that is certain; a longer mention of one shard suppresses a shorter one of another."""
    at: dict[tuple[int, int, str], set[int]] = defaultdict(set)
    for start, end, pattern, entry in mentions:
        at[(start, end, pattern)].add(entry)
    found = longest_first([(*where, sorted(entries)) for where, entries in at.items()])
    if not found:
        return []
    text = normal(_REMARK.sub(" ", value) if legal else value)
    rest = without_form(text) if legal else text
    for start, end, _, _ in reversed(found):
        rest = rest[: start + 1] + rest[end:]
    whole = [w for w in rest.split() if w not in DESCRIPTORS]
    certain = [(entries[0], 2.0 + len(pattern) / 1000) for _, _, pattern, entries in found if len(entries) == 1]
    sure = not whole or all(len(m[2].split()) > 1 for m in found) or _only_place(value, rest)
    return certain if sure else []


def by_similarity(similar: list[tuple[float, int]], glued: list[tuple[float, int]], least: float) -> list[tuple[int, float]]:
    """The most similar entry; a tie, within or across shards, names none."""
    scored = _best_first(similar)
    if not scored or scored[0][0] < least:
        scored = _best_first(glued + scored)
    if scored and scored[0][0] >= least and (len(scored) == 1 or scored[0][0] - scored[1][0] > 1e-9):
        return [(scored[0][1], scored[0][0])]
    return []


def abbreviates(short: str, word: str, dotted: bool) -> bool:
    """``Rev`` for ``revista``, ``Dio.`` for ``diario``: letters of the word, in order."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return short == word
    if word.startswith(short):
        return dotted or len(short) >= 3
    letters = iter(word)
    return dotted and all(c in letters for c in short)


def _only_place(value: str, rest: str) -> bool:
    """Whether what is left over is a place or remark after the name."""
    tail = re.search(r"(?:,|\bdesde|\ben|\()\s*(.*)$", fold(value))
    left = [w for w in rest.split() if w not in DESCRIPTORS]
    return bool(tail) and set(left) <= set(_NOT_WORD.sub(" ", tail.group(1)).split())


def _catalogue(shipped) -> Catalogue:
    """A worker process keeps what was shipped to it, so it builds a shard's index once for all its tasks."""
    shard = shipped.value
    if "catalogue" not in shard:
        shard["catalogue"] = Catalogue(shard["ids"], shard["names"], shard["legal"], shard["common"], shard["unique"])
    return shard["catalogue"]


def _matcher(shipped, legal: bool, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        catalogue = _catalogue(shipped)
        for batch in batches:
            rows = [(v, ref, score) for v in batch["value"] for ref, score in catalogue.look_up(v, least) or [(UNMATCHED, 0.0)]]
            yield pd.DataFrame(rows, columns=["value", "ref_id", "score"])

    return run


def _witness(shipped, least: float):
    """Evidence of one shard as rows; a row of kind '' keeps values without any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        catalogue = _catalogue(shipped)
        for batch in batches:
            rows = []
            for v in batch["value"]:
                e = catalogue.evidence(v, least)
                rows += [(v, "m", start, end, pattern, ref, 0.0) for start, end, pattern, ref in e.mentions]
                rows += [(v, kind, 0, 0, "", ref, score) for kind, found in (("s", e.similar), ("g", e.glued)) for score, ref in found]
                rows.append((v, "", 0, 0, "", UNMATCHED, 0.0))
            yield pd.DataFrame(rows, columns=["value", "kind", "start", "end", "pattern", "ref", "score"])

    return run


def _settler(legal: bool, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v, rows in zip(batch["value"], batch["rows"]):
                e = Evidence(
                    [(r["start"], r["end"], r["pattern"], r["ref"]) for r in rows if r["kind"] == "m"],
                    [(r["score"], r["ref"]) for r in rows if r["kind"] == "s"], [(r["score"], r["ref"]) for r in rows if r["kind"] == "g"],
                )
                out += [(v, ref, score) for ref, score in settle(v, e, legal, least) or [(UNMATCHED, 0.0)]]
            yield pd.DataFrame(out, columns=["value", "ref_id", "score"])

    return run


def _worded(legal: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heavy = [[w for w in entry_words(n, legal) if w not in LIGHT] for n in batch["name"]]
            yield batch.assign(words=[sorted(set(h)) for h in heavy], initials=[initials(h) for h in heavy])

    return run


def map_to_list(values: DataFrame, entries: DataFrame, entry_id: str, entry_name: str, *, legal: bool = False,
                least: float = 0.6, shard: int = 20_000) -> DataFrame:
    """(value, ref_id, score) for the distinct non-blank ``values.value``.

    ``legal`` leaves legal forms out of the comparison. ``least`` is the similarity a value
    without exact mention must reach. Null and blank values and names are left out; of
    entries with one id the smallest name counts; an empty list leaves all unmatched.
    The answers don't depend on ``shard``.
    """
    context = values.sparkSession.sparkContext
    distinct = values.where(F.trim("value") != "").groupBy("value").agg(F.lit(1).alias("__one")).select("value")
    # Few bytes are much work here, so the rows are dealt out by number, not by size.
    distinct = distinct.repartition(context.defaultParallelism)
    named = (
        entries.select(F.col(entry_id).cast("long").alias("id"), F.col(entry_name).alias("name"))
        .where("id is not null and trim(name) <> ''").groupBy("id").agg(F.min("name").alias("name"))
    )
    shards = max(1, -(-named.count() // shard))
    if shards == 1:
        part = named.orderBy("id").toPandas()
        shipped = context.broadcast({"ids": part["id"].tolist(), "names": part["name"].tolist(), "legal": legal, "common": None, "unique": None})
        return distinct.mapInPandas(_matcher(shipped, legal, least), "value string, ref_id long, score double")
    kinds = "id long, name string, shard int, words array<string>, initials string"
    numbered = named.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    numbered = materialize(numbered.mapInPandas(_worded(legal), kinds), "entries")
    # How common a word is and whether initials are one name's is a matter of the whole list.
    common = numbered.select("id", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 2").select("word")
    unique = numbered.where("initials <> ''").groupBy("initials").agg(F.count("*").alias("n")).where("n = 1").select("initials")
    of_shard = numbered.select("shard", F.explode("words").alias("word")).distinct().join(common, "word")
    shorts = numbered.select("shard", "initials").join(unique, "initials")
    told = None
    values_once = materialize(distinct, "values")
    for k in range(shards):
        part = numbered.where(F.col("shard") == k).select("id", "name").orderBy("id").toPandas()
        shipped = context.broadcast({
            "ids": part["id"].tolist(), "names": part["name"].tolist(), "legal": legal,
            "common": {r.word for r in of_shard.where(F.col("shard") == k).collect()}, "unique": {r.initials for r in shorts.where(F.col("shard") == k).collect()},
        })
        rows = values_once.mapInPandas(_witness(shipped, least), "value string, kind string, start int, end int, pattern string, ref long, score double")
        told = rows if told is None else told.unionByName(rows)
    # A value has a few mentions and four similar entries of each shard: its group is bounded.
    grouped = told.groupBy("value").agg(F.collect_set(F.struct("kind", "start", "end", "pattern", "ref", "score")).alias("rows"))
    return grouped.mapInPandas(_settler(legal, least), "value string, ref_id long, score double")


def map_fields(rows: DataFrame, origin: Column, key: Column, value: Column, mapped: DataFrame) -> DataFrame:
    """(origen, clave, ref_id), each different entry of a field once."""
    typed = rows.select(origin.alias("origen"), key.alias("clave"), value.alias("value")).where(F.trim("value") != "")
    return typed.join(mapped.select("value", "ref_id"), "value").select("origen", "clave", "ref_id").distinct()
