"""Template residue, filler and error-page text in documents.

Every sentence is a node, and so is every confirmed notice (``notices.NOTICES``). Nodes get
a SimHash over their different runs of letters. Partitioned tables, one for each chunk of
its bits, find the nodes that agree in some chunk up to ``RADIUS`` errors; the distance and
the similarity of their letters are verified; and trusted labels are propagated through the
components of these links. Trusted are the confirmed notices, sentences with a field that
nobody filled in (known by its syntax) and a few signs of a program's own output.

Two sentences of similarity 0.8 differ in 15 of 100 bits on average, so a chunk agrees up
to two errors with chance 0.36, and one of twelve chunks does with 0.995; nearer ones are
missed less often.

A sentence may resemble a trusted one by what stands around the residue. So each label
carries its core (the words that make it residue), and reaches only nodes that hold at
least ``KEPT`` of the core's runs, over any number of links. Since nothing else can be
labelled, only such sentences get a signature: one vectorised pass over all runs of all
texts, folded letter by letter in whole batches, decides which texts are cut at all. A sentence that lacks a full stop before or after residue is also cut
where a capital follows a small letter, and its pieces are nodes of their own, if they hold a core themselves.

Scale: sentences are screened and made distinct before anything else. Labels spread as a
frontier: each round joins only the newly labelled nodes with the tables, so links inside
ordinary, often repeated turns of phrase are never built. Both sides list their chunks with
one error at most, so the lists meet for two. Tables, links and labels are DataFrames; only
whether a round added anything reaches the driver. The notices are counted (``MOST_NOTICES``).

Defined results: null, empty and blank texts hold no residue; texts are read whole; someone
talking or asking about an error or a form isn't near the notice itself; a label of an unfilled field
reaches only sentences that hold signs of a field.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemerion.llm.neardup import _chunk
from hemerion.llm.notices import MACHINE, NOTICES, PLACEHOLDERS
from hemerion.llm.text import fold, slices
from hemerion.session import materialize

_PLACEHOLDER = re.compile("|".join(PLACEHOLDERS))
_SIGN = re.compile(r"[{}\[\]]|<<|>>|<%|%\(|@@|__|#[A-ZÁÉÍÓÚÑ]|\bXX")
_SIGN_HINTS = ("{", "}", "[", "]", "<<", ">>", "<%", "%(", "@@", "__", "#", "XX")
_MACHINE = [(re.compile(pattern), core) for pattern, core in MACHINE.items()]
#: Letters of which every text that a ``MACHINE`` pattern matches holds some.
_MACHINE_HINTS = ("ipsum", "dolor sit", "asdf", "qwerty", "xxxx", "tk tk", "traceback", "uncaught", "noscript", "title>", "{", "relleno")
_BREAK = re.compile(r"(?<=[.?!…])[\s ]+|[\r\n]+")
_PIECE = re.compile(r"(?<=[a-záéíóúüñàâãçèêô0-9.,;:!?)\]])\s+(?=[A-ZÁÉÍÓÚÜÑÀÂÃÇÈÊÔ¿¡0-9])|\s*[\[\]<>|{}«»“”\"]+\s*")
_NO_WORD = re.compile(r"[\W_]+")
_FIGURES = re.compile(r"\d+")
_SIGNED = re.compile(r"[^\W_]+|[{}\[\]<>$%@#_]+")
SIMILARITY, GRAM = 0.8, 4
#: Chunks of the signature, three to a long, and the errors up to which one must agree.
CHUNKS, CHUNK_BITS, RADIUS = 12, 21, 2
LONGS = CHUNKS // (64 // CHUNK_BITS)
#: Bits of the whole signature beyond which the letters aren't compared: 39 are expected at ``SIMILARITY``, 64 are over four deviations more.
DISTANCE = 64
#: Share of the core's runs that a sentence must hold to be labelled.
KEPT = 0.5
#: Most confirmed notices that are shipped to the workers; more raise.
MOST_NOTICES = 20_000


def segments(text: str) -> list[str]:
    """Sentences and lines, without the blank ones."""
    return [s for s in (p.strip() for p in _BREAK.split(text)) if s]


def folded(segment: str) -> str:
    """Form under which equal sentences agree: folded words, figures as one sign."""
    return _joined(fold(segment))


def _joined(plain: str) -> str:
    return _FIGURES.sub("0", _bare(plain))


def _bare(plain: str) -> str:
    return _NO_WORD.sub(" ", plain).strip()


def signed(segment: str) -> str:
    """Form that keeps the signs of fields."""
    return _FIGURES.sub("0", " ".join(_SIGNED.findall(fold(segment))))


def has_placeholder(text: str) -> bool:
    return _SIGN.search(text) is not None and _PLACEHOLDER.search(text) is not None


def grams(text: str) -> set[str]:
    padded = f" {text} "
    return {padded[k : k + GRAM] for k in range(max(1, len(padded) - GRAM + 1))}


def simhashes(texts: list[str]) -> list[int]:
    """The first 64 bits of each text's signature, as signed longs."""
    return signatures(texts)[:, 0].tolist()


def signatures(texts: list[str]) -> np.ndarray:
    """SimHash of each text over its different runs of ``GRAM`` letters, a row of ``LONGS`` signed longs."""
    runs = [_signature_run(run) for run in slices(texts, 100_000)]
    return np.concatenate(runs) if runs else np.zeros((0, LONGS), dtype=np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(max(0, len(codes) - GRAM + 1), dtype=np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x100000001B3) + codes[k : len(codes) - GRAM + 1 + k]
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``GRAM`` letters of each text between blanks."""
    padded = [f" {t} ".ljust(GRAM) for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in padded])
    with np.errstate(over="ignore"):
        h = _hashes(codes)
    # Runs over the border of two texts lie at the last places of each text.
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(h)]
    inside = np.arange(len(h)) <= np.cumsum(sizes)[owner] - GRAM
    return h[inside], owner[inside]


def _distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The similarity is of sets, so a run counts once."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, dtype=bool)
    return h[new], owner[new]


def _signature_run(texts: list[str]) -> np.ndarray:
    h, owner = _distinct(*_runs(texts))
    with np.errstate(over="ignore"):
        wide = np.stack([_mixed(h + np.uint64(d) * np.uint64(0x9E3779B97F4A7C15)) for d in range(LONGS)], axis=1)
    first = np.searchsorted(owner, np.arange(len(texts)))
    total = np.diff(np.append(first, len(h)))
    kind = np.int16 if total.max() < 1 << 14 else np.int32
    counts = np.add.reduceat(np.unpackbits(wide.view(np.uint8), axis=1).astype(kind), first, axis=0)
    return np.packbits(2 * counts > total[:, None], axis=1).view("<i8")


class Letters:
    """Folds many texts at once, letter by letter, into the runs of their sentences' forms."""

    #: No letter, a letter whose folding needs its neighbours or gives several, and letters beyond the tables.
    GONE, OPEN, SIZE = 0xFFFFFFFF, 0xFFFFFFFE, 0x10000
    BLANK, FIGURE = ord(" "), ord("0")

    def __init__(self):
        self.folds = np.array([self._fold(c) for c in range(self.SIZE)], dtype=np.uint32)
        self.forms = np.array([self._form(c) for c in range(self.SIZE)], dtype=np.uint32)
        self.ends = np.isin(np.arange(self.SIZE), [ord(c) for c in ".?!…"])
        self.blanks = np.array([chr(c).isspace() for c in range(self.SIZE)])
        self.lines = np.isin(np.arange(self.SIZE), [ord("\n"), ord("\r")])

    def _fold(self, c: int) -> int:
        plain = fold(chr(c))
        return self.GONE if not plain else self.OPEN if len(plain) > 1 or c == ord("Σ") or 0xD800 <= c < 0xE000 else ord(plain)

    def _form(self, c: int) -> int:
        return self.BLANK if _NO_WORD.match(chr(c)) else self.FIGURE if _FIGURES.match(chr(c)) else c

    @staticmethod
    def _codes(texts: list[str]) -> np.ndarray:
        # Breaks stand around every text, so runs and sentences end with it.
        return np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    def runs(self, texts: list[str], hints: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, set[int]]:
        """(hash of each run, its sentence, text of each sentence, texts that hold a hint when folded); sentences are numbered through, blank ones too."""
        codes = self._codes(texts)
        sizes = np.array([len(t) + 1 for t in texts])
        plain = self.folds[np.minimum(codes, self.SIZE - 1)]
        slow = (codes >= self.SIZE) | (plain == self.OPEN)
        if slow.any():
            ends = np.cumsum(sizes)
            odd = np.unique(np.searchsorted(ends, np.flatnonzero(slow) - 1, side="right"))
            texts = list(texts)
            for k in odd:
                texts[k] = fold(texts[k])
            codes, sizes = self._codes(texts), np.array([len(t) + 1 for t in texts])
            done = np.append(False, np.repeat(np.isin(np.arange(len(texts)), odd), sizes))
            plain = np.where(done, codes, self.folds[np.minimum(codes, self.SIZE - 1)])
        text = np.append(0, np.repeat(np.arange(len(texts)), sizes))
        if (gone := plain == self.GONE).any():
            plain, text = plain[~gone], text[~gone]
        folded_text = plain.tobytes().decode("utf-32-le", "surrogatepass")
        hinted = _holding(folded_text, hints, text)
        low = np.minimum(plain, self.SIZE - 1)
        form = self.forms[low]
        if (high := plain >= self.SIZE).any():
            kinds, which = np.unique(plain[high], return_inverse=True)
            form[high] = np.array([self._form(int(c)) for c in kinds], dtype=np.uint32)[which]
        breaks = self.lines[low]
        breaks[1:] |= self.blanks[low[1:]] & self.ends[low[:-1]]
        # Of neighbouring signs and of neighbouring figures the first stays; it is a break if any of them is.
        stays = np.append(True, (form[1:] != form[:-1]) | (form[1:] != self.BLANK) & (form[1:] != self.FIGURE))
        at = np.flatnonzero(stays)
        passed = np.append(0, np.cumsum(breaks))
        broken = passed[np.append(at[1:], len(form))] > passed[at]
        with np.errstate(over="ignore"):
            h = _hashes(form[at].astype(np.uint64))
        sentence = np.cumsum(broken)
        # A run may begin and end with a break, but not go over one.
        inside = ~(broken[1 : 1 + len(h)] | broken[2 : 2 + len(h)])
        number = sentence[: len(h)]
        of = np.zeros(int(sentence[-1]) + 1, dtype=np.int64)
        # The text of a sentence is that of its last letter; the break before it may be the text's before.
        of[sentence] = text[at]
        return h[inside], number[inside], of, hinted


def _holding(joined: str, hints: tuple[str, ...], owner: np.ndarray) -> set[int]:
    """Owners of the letters at which some hint begins."""
    out: set[int] = set()
    for hint in hints:
        at = joined.find(hint)
        while at >= 0:
            out.add(int(owner[at]))
            # On to the next owner.
            at = joined.find(hint, int(np.searchsorted(owner, owner[at], side="right")))
    return out


class Screen:
    """Finds, for many forms at once, the cores of which each holds ``KEPT`` of the runs."""

    def __init__(self, cores: list[str]):
        self.cores = cores
        h, owner = _distinct(*_runs(cores))
        self.sizes = np.bincount(owner, minlength=len(cores))
        order = np.argsort(h, kind="stable")
        self.known, self.first = np.unique(h[order], return_index=True)
        self.owners = owner[order]
        self.count = np.diff(np.append(self.first, len(h)))
        self.need = np.ceil(KEPT * self.sizes - 1e-9).clip(min=1)
        self.telling: tuple | None = None
        # Most runs of a corpus are in no core: a table of bits turns them away without a search.
        places = (self.known >> np.uint64(44)).astype(np.int64)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[places] = True
        # The known run of each place; where several share one, the others are looked up by themselves.
        self.slots = np.zeros(1 << 20, dtype=np.int32)
        self.slots[places] = np.arange(len(self.known))
        self.others = np.flatnonzero(self.slots[places] != np.arange(len(self.known)))

    def held(self, forms: list[str]) -> list[tuple[int, int]]:
        """(form, core) pairs."""
        out, start = [], 0
        for run in slices(forms, 400_000):
            form, core = self._held(*_runs(run))
            out += zip((form + start).tolist(), core.tolist())
            start += len(run)
        return out

    def _held(self, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, core) pairs of runs and the forms that own them, in order of both."""
        places = (h >> np.uint64(44)).astype(np.int64)
        maybe = np.flatnonzero(self.bits[places])
        h, owner = h[maybe], owner[maybe]
        if len(self.others) > 16:
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        else:
            at = self.slots[places[maybe]].astype(np.int64)
            for k in self.others:
                at[h == self.known[k]] = k
        hit = self.known[at] == h
        owner, at = owner[hit], at[hit]
        if self.telling is None:
            self.telling = self._telling(np.bincount(at, minlength=len(self.known)))
        # A run counts once for each form.
        once = np.sort(owner * len(self.known) + at)
        once = once[np.append(True, once[1:] != once[:-1])[: len(once)]]
        owner, at = once // len(self.known), once % len(self.known)
        # Most forms hold only usual runs of the cores: the others are counted first, and all runs only where these are enough.
        maybe, _ = self._counted(owner, at, *self.telling)
        if len(maybe):
            on = np.zeros(int(owner[-1]) + 1, dtype=bool)
            on[maybe] = True
            owner, at = owner[on[owner]], at[on[owner]]
        else:
            owner, at = owner[:0], at[:0]
        return self._counted(owner, at, self.first, self.count, self.owners, self.need)

    def _counted(self, owner, at, first, count, owners, need) -> tuple[np.ndarray, np.ndarray]:
        """(owner, core) pairs with ``need`` of the runs ``at`` in the cores that ``owners`` lists for each run."""
        listed = count[at] > 0
        owner, at = owner[listed], at[listed]
        new = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
        forms, which, found = owner[new], np.cumsum(new) - 1, []
        # Each form has a bin for each core, so the forms are bounded by number.
        most = max(1, 2_000_000 // len(self.cores))
        for k in range(0, len(forms), most):
            i, j = np.searchsorted(which, [k, k + most])
            reps = count[at[i:j]]
            core = owners[np.repeat(first[at[i:j]] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())]
            bins = min(most, len(forms) - k)
            counts = np.bincount(np.repeat(which[i:j] - k, reps) * len(self.cores) + core, minlength=bins * len(self.cores)).reshape(bins, -1)
            form, core = np.nonzero(counts >= need)
            found.append((forms[k + form], core))
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none)

    def _telling(self, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The cores of each run without those of which it is among the most usual, and how many of the other runs each core needs.

        ``usual``: how often each run was seen. What holds as many runs of a core as it must, holds that many besides those left out.
        """
        run = np.repeat(np.arange(len(self.known)), self.count)
        order = np.lexsort((-usual[run], self.owners))
        core = self.owners[order]
        left_out = np.minimum(self.need * 3 // 4, self.need - 1)
        kept = np.zeros(len(order), dtype=bool)
        kept[order] = np.arange(len(core)) - np.searchsorted(core, core) >= left_out[core]
        count = np.bincount(run[kept], minlength=len(self.known))
        return np.cumsum(count) - count, count, self.owners[kept], self.need - left_out

    def texts(self, letters: Letters, texts: list[str], hints: tuple[str, ...] = ()) -> tuple[set[int], set[int]]:
        """Places of the texts of which a sentence holds ``KEPT`` of a core's runs, and of those that hold a hint when folded."""
        held, hinted, start = set(), set(), 0
        for run in slices(texts, 100_000):
            h, sentence, of, some = letters.runs(run, hints)
            held.update((of[self._held(h, sentence)[0]] + start).tolist())
            hinted.update(k + start for k in some)
            start += len(run)
        # The run of a form shorter than a run is filled up, which those of whole texts are not.
        return (held if min(map(len, self.cores)) >= GRAM - 2 else set(range(len(texts)))), hinted


def pieces(segment: str, shortest: int, longest: int) -> list[str]:
    """Forms of runs of pieces between missing full stops, brackets and quotes, from ``shortest`` to ``longest`` letters."""
    parts = [p for p in _PIECE.split(segment) if p]
    # Where someone asks, a run of pieces ends.
    parts, out = ["" if _asked(p) else folded(p) for p in parts], []
    for i in range(len(parts)):
        run = ""
        for part in parts[i:]:
            run = f"{run} {part}" if run else part
            if not part or len(run) > longest:
                break
            if len(run) >= shortest:
                out.append(run)
    return out


def _asked(segment: str) -> bool:
    return "?" in segment or "¿" in segment


def _fields(text: str) -> list[tuple[str, str | None]]:
    """(form, core) of the sentences that hold signs of fields; the core is null where the syntax is none."""
    spans, start = [], 0
    for m in _BREAK.finditer(text):
        spans.append((start, m.start()))
        start = m.end()
    spans.append((start, len(text)))
    starts, cores, out = [s for s, _ in spans], {}, []
    for m in _PLACEHOLDER.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        if m.end() <= spans[k][1]:
            cores.setdefault(k, []).append(m.group())
        else:
            out.append((signed(m.group()), signed(m.group())))
    for k, (a, b) in enumerate(spans):
        if k in cores:
            out.append((signed(text[a:b]), signed(" ".join(cores[k]))))
        elif _SIGN.search(text, a, b):
            out.append((signed(text[a:b]), None))
    return out


def _splitter(cores: list[str]):
    """(doc, form, core) of the sentences of each text that can be labelled; the core is null unless it is trusted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        screen, letters = Screen(cores), Letters()
        # A program's sign may stand in a sentence of any length; a notice is the whole of its sentence or piece.
        core_open = [c in MACHINE.values() for c in cores]
        for batch in batches:
            out: list[tuple] = []
            docs, forms = [], []
            texts = batch["text"].tolist()
            held, hinted = screen.texts(letters, texts, _MACHINE_HINTS)
            signs = _holding("\n".join(texts), _SIGN_HINTS, np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts]))
            for k, (doc, text) in enumerate(zip(batch["doc"], texts)):
                if k in signs and _SIGN.search(text):
                    out += [(doc, form, core) for form, core in _fields(text)]
                if k not in held and k not in hinted:
                    continue
                plain = fold(text)
                if k in hinted:
                    for segment in segments(plain):
                        core = next((c for p, c in _MACHINE if p.search(segment)), None)
                        if core:
                            out.append((doc, _joined(segment), core))
                if k in held:
                    parts = segments(_FIGURES.sub("0", plain))
                    docs += [(doc, text, at) for at in range(len(parts))]
                    forms += [_bare(segment) for segment in parts]
            runs, cut = [], []
            for k, c in screen.held(forms):
                doc, text, at = docs[k]
                size = len(screen.cores[c])
                # Folding keeps breaks, so sentences of the text as typed have the same places.
                typed = segments(text)[at]
                if (size <= 2 * len(forms[k]) and len(forms[k]) <= 2 * size or core_open[c]) and not _asked(typed):
                    out.append((doc, forms[k], None))
                own = pieces(typed, size // 2, 2 * size)
                runs += own
                cut += [doc] * len(own)
            # A piece that holds no core can't be labelled either.
            out += [(cut[k], runs[k], None) for k in dict.fromkeys(k for k, _ in screen.held(runs))]
            found = pd.DataFrame(out, columns=["doc", "form", "core"])
            yield found[found["form"] != ""].drop_duplicates()

    return run


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["id", "form", "notice", "core"]].assign(signature=list(signatures(batch["form"].tolist())))


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for a, b, words in zip(batch["near"], batch["form"], batch["core"]):
            x, y = grams(a), grams(b)
            held = grams(words) if words else set()
            keep.append(len(x & y) >= SIMILARITY * len(x | y) and len(held & y) >= KEPT * len(held))
        yield batch[keep][["id", "form", "signature", "core"]]


def spread(forms: DataFrame) -> DataFrame:
    """Forms linked, over any number of links, to a form with ``notice``.

    ``forms``: id, form, notice and, if it is known, core. A round adds what is near the
    forms added last; it ends when a round adds none.
    """
    given = F.coalesce("core", F.lit("")) if "core" in forms.columns else F.lit("")
    kinds = "id long, form string, notice boolean, core string, signature array<long>"
    forms = materialize(forms.select("id", "form", "notice", given.alias("core")).mapInPandas(_sign, kinds), "forms")
    chunks = F.explode(F.array(*[_chunk(F.col("signature"), k, CHUNK_BITS) + F.lit(k << CHUNK_BITS) for k in range(CHUNKS)])).alias("chunk")
    # One error on either side lets two errors meet.
    errors = F.explode(F.array(F.lit(0), *[F.lit(1 << j) for j in range(CHUNK_BITS)])).alias("error")

    def keys(rows: DataFrame) -> DataFrame:
        return rows.select("id", chunks).select("id", "chunk", errors).select("id", F.col("chunk").bitwiseXOR(F.col("error")).alias("key"))

    others = forms.where("not notice").select("id", "form", "signature")
    tables = materialize(keys(others), "tables")
    frontier = materialize(forms.where("notice").select("id", "form", "signature", "core"), "trusted")
    labelled = frontier.select("id", "core")
    apart = sum((F.bit_count(F.col("sign")[k].bitwiseXOR(F.col("signature")[k])) for k in range(LONGS)), F.lit(0))
    while not frontier.isEmpty():
        sources = keys(frontier.select("id", "signature").dropDuplicates(["id"])).withColumnRenamed("id", "known")
        # Explosion isn't in the size estimate, so the join is named: neither side is shipped whole.
        pairs = sources.hint("merge").join(tables, "key").where("known != id").select("known", "id").distinct()
        near = frontier.select(F.col("id").alias("known"), F.col("form").alias("near"), F.col("signature").alias("sign"), "core")
        fresh = (
            pairs.join(near, "known").join(labelled, ["id", "core"], "left_anti").join(others, "id").where(apart <= DISTANCE)
            .select("id", "form", "signature", "core", "near")
            .mapInPandas(_alike, "id long, form string, signature array<long>, core string").dropDuplicates(["id", "core"])
        )
        frontier = materialize(fresh, "frontier")
        labelled = labelled.unionByName(frontier.select("id", "core"))
    return labelled.select("id").distinct()


def labelled_sentences(docs: DataFrame, key: str, text: str, notices: list[str] | None = None) -> DataFrame:
    """(doc, form, trusted): the residue sentences of each document, and whether they were trusted from the start."""
    spark = docs.sparkSession
    listed = sorted({f for f in map(folded, NOTICES if notices is None else notices) if f})
    if len(listed) > MOST_NOTICES:
        raise ValueError(f"more than {MOST_NOTICES} notices")
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("text is not null")
    kind = rows.schema["doc"].dataType.simpleString()
    split = rows.mapInPandas(_splitter(sorted({*listed, *MACHINE.values()})), f"doc {kind}, form string, core string")
    sentences = materialize(split.withColumn("id", F.xxhash64("form")), "sentences")
    counted = sentences.groupBy("id").agg(F.min("form").alias("form"), F.min("core").alias("core"))
    # Notices are nodes of their own: what equals one is linked to it at distance 0.
    known = spark.createDataFrame([(f, f) for f in listed], "form string, core string").select(
        F.xxhash64(F.lit("notice"), "form").alias("id"), "form", "core"
    )
    nodes = counted.select("id", "form", "core").unionByName(known)
    labelled = spread(nodes.withColumn("notice", F.col("core").isNotNull()))
    return sentences.join(labelled, "id", "left_semi").select("doc", "form", F.col("core").isNotNull().alias("trusted"))


def residue_documents(docs: DataFrame, key: str, text: str, notices: list[str] | None = None) -> DataFrame:
    """The keys of documents that hold residue, each once."""
    return labelled_sentences(docs, key, text, notices).select("doc").distinct().withColumnRenamed("doc", key)
