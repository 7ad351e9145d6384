"""Pages and transcripts to text, header, turns and asides."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemerion.functions.rules import first_match, label_parts
from hemerion.functions.text import normalize_spaces, plain

#: Words that open and close a recording's note, and what the recording is.
OPENING_WORDS = ["inicia", "inician", "comienza", "comienzan", "empieza", "empiezan"]
CLOSING_WORDS = ["finaliza", "finalizan", "concluye", "concluyen", "termina", "terminan"]
RECORDINGS = ["video", "videos", "audio", "audios"]
#: Shortest and longest label, longest note after it, the signs it may hold beside capitals and figures.
SHORTEST_LABEL, LONGEST_LABEL, LONGEST_NOTE, LABEL_SIGNS = 3, 151, 45, " ,.()/º°'’-"
#: The dashes that set a paragraph apart.
DASHES = ["—", "–"]
#: Shortest page that is a transcript, and the class of its body.
SHORTEST_PAGE, BODY_CLASS = 20_000, "article-body"


def without_videos(text: Column) -> Column:
    """struct(texto, videos, abiertos): recordings taken out, how many, and openings left over.

    Bracketed notes are told apart by their words; a recording runs from an opening note to
    the first closing one.
    """
    pieces = F.split(text, "(?=\\()|(?<=\\))")

    def kind(piece: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(plain(piece), "[^a-z]+", " ")), " ")
        note = piece.startswith("(") & piece.endswith(")") & F.arrays_overlap(words, F.array(*[F.lit(r) for r in RECORDINGS]))
        return F.when(note & words[0].isin(OPENING_WORDS), 1).when(note & words[0].isin(CLOSING_WORDS), 2).otherwise(0)

    kinds = F.transform(pieces, kind)
    blocks = "array<struct<s:int,e:int>>"
    start = F.struct(F.array().cast(blocks).alias("b"), F.lit(-1).alias("open"), F.lit(0).alias("at"))

    def step(state: Column, k: Column) -> Column:
        closes = (k == 2) & (state.open >= 0)
        opened = F.when(closes, -1).when((k == 1) & (state.open < 0), state.at).otherwise(state.open)
        more = F.array(F.struct(state.open.alias("s"), state.at.alias("e")))
        return F.struct(F.when(closes, F.concat(state.b, more)).otherwise(state.b).alias("b"), opened.alias("open"), (state.at + 1).alias("at"))

    taken = F.aggregate(kinds, start, step).b
    # What lies in a recording goes; its place is a blank line.
    shown = F.transform(pieces, lambda p, k: F.when(F.exists(taken, lambda b: b.s == k), "\n\n").when(
        F.exists(taken, lambda b: (b.s <= k) & (k <= b.e)), "").otherwise(p))
    left = F.filter(kinds, lambda k, at: (k == 1) & ~F.exists(taken, lambda b: (b.s <= at) & (at <= b.e)))
    return F.struct(F.array_join(shown, "").alias("texto"), F.size(taken).alias("videos"), F.size(left).alias("abiertos"))


def without_end_mark(text: Column) -> Column:
    """struct(texto, marca): the closing mark of a bulletin (a last line of zeros between dashes) taken off."""
    body = F.regexp_replace(text, "\\s+$", "")
    last = F.substring_index(body, "\n", -1)
    bare = F.regexp_replace(last, "\\s+", "")
    dash = lambda c: c.isin([*DASHES, "-"])
    mark = body.contains("\n") & dash(F.left(bare, F.lit(1))) & dash(F.right(bare, F.lit(1))) & F.translate(bare, "—–-", "").rlike("^00+$")
    return F.struct(F.when(mark, F.left(body, F.length(body) - F.length(last))).otherwise(text).alias("texto"), F.coalesce(mark, F.lit(False)).alias("marca"))


def asides(text: Column) -> Column:
    """struct(texto, apartes): paragraphs wholly between dashes apart from the rest."""
    stripped = F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", ""))
    paragraphs = F.filter(stripped, lambda p: p != "")
    ended = lambda p: F.regexp_replace(p, "[.,]?\\s*$", "")
    inner = lambda p: F.regexp_replace(F.substring(ended(p), 2, 1_000_000_000), "^\\s+|\\s*[—–]$", "")
    apart = lambda p: F.left(p, F.lit(1)).isin(DASHES) & F.right(ended(p), F.lit(1)).isin(DASHES) & (F.length(ended(p)) > 2)
    inside = F.transform(F.filter(paragraphs, apart), lambda p: F.trim(inner(p)))
    return F.struct(F.array_join(F.filter(paragraphs, lambda p: ~apart(p)), "\n\n").alias("texto"), inside.alias("apartes"))


def line_label(line: Column) -> Column:
    """The speaker label that a line opens with, '' without one.

    It is what stands before the first colon (that opens no address), in capitals, figures
    and some signs; a note in brackets at its end may be in any letters.
    """
    # No label with its note is longer, so a long line isn't read to its end.
    opening = F.left(line, F.lit(LONGEST_LABEL + LONGEST_NOTE + 20))
    head = F.trim(F.regexp_extract(opening, "^((?:[^:()]++|\\([^()]*+\\))*+)(?=:(?!//))", 1))
    name = F.regexp_replace(head, f"\\s*\\([^()]{{0,{LONGEST_NOTE}}}\\)$", "")
    signs = "".join(f"\\{c}" for c in LABEL_SIGNS)
    shaped = name.rlike(f"^\\p{{Lu}}[\\p{{Lu}}0-9{signs}]*$") & F.length(name).between(SHORTEST_LABEL, LONGEST_LABEL)
    return F.when(shaped, head).otherwise(F.lit(""))


def header(text: Column) -> Column:
    """What stands before the first label; all of it without one."""
    lines = F.split(text, "\n")
    labelled = F.transform(lines, lambda line: line_label(line) != "")
    first = F.array_position(labelled, True)
    kept = F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines)
    return F.regexp_replace(F.array_join(kept, "\n"), "^\\s+|\\s+$", "")


def turns_of(docs: DataFrame, key: str, text: str, aliases: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per speaker label: key, orden from 0, etiqueta, tipo, cargo, hablante, texto, apartes."""
    rows = docs.select(F.col(key), F.split(normalize_spaces(F.col(text)), "\n").alias("__lines"))
    rows = rows.withColumn("__labels", F.transform("__lines", line_label))
    rows = rows.withColumn("__at", F.filter(F.transform("__labels", lambda t, k: F.when(t != "", k)), lambda k: k.isNotNull()))
    ends = F.transform("__at", lambda s, k: F.coalesce(F.get(F.col("__at"), k + 1), F.size("__lines")))
    rows = rows.withColumn("__ends", ends)
    said = F.transform(F.arrays_zip(F.col("__at").alias("s"), F.col("__ends").alias("e")), lambda x: F.struct(
        F.get(F.col("__labels"), x.s).alias("l"), F.array_join(F.slice(F.col("__lines"), x.s + 1, x.e - x.s), "\n").alias("t")))
    rows = rows.select(key, F.posexplode(said).alias("orden", "__turn"))
    # The text begins after the colon that ends the label, whatever blanks stand before it.
    after = F.regexp_replace(F.substr("__turn.t", F.length("__turn.l") + 1), "^\\s*:[ \\t]*", "")
    rows = rows.withColumn("etiqueta", F.col("__turn.l")).withColumn("__body", asides(after)).withColumn("__who", label_parts(F.col("etiqueta"), aliases))
    return rows.select(key, "orden", "etiqueta", "__who.tipo", "__who.cargo", "__who.hablante", "__body.texto", "__body.apartes")


def subject_of_day(turns: DataFrame, patterns: list[str], first: int = 6, most: int = 2500) -> DataFrame:
    """(conferencia_id, tema, metodo, fragmento) from what officials say in the opening turns."""
    opening = turns.where((F.col("orden") < first) & (F.col("tipo") == "funcionario"))
    said = opening.groupBy("conferencia_id").agg(
        F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("orden", "texto"))), lambda x: x.texto), "\n"), 1, most).alias("s")
    )
    flat = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    found = flat(F.regexp_replace(first_match(F.col("s"), patterns), "^[ ,;:—-]+|[ ,;:—-]+$", ""))
    found = F.nullif(found, F.lit(""))
    proof = F.substring(flat(first_match(F.col("s"), patterns, 0)), 1, 160)
    return said.select(
        "conferencia_id", found.alias("tema"), F.when(found.isNotNull(), "regex").otherwise("sin_identificar").alias("metodo"),
        F.when(found.isNotNull(), proof).alias("fragmento"),
    )


def page_problem(html: Column) -> Column:
    """Why a page is no transcript, else null."""
    return (
        F.when(F.lower(F.substring(html, 1, 5000)).rlike("just a moment|challenge-platform|checking your browser"), "pantalla de verificación")
        .when(F.length(html) < SHORTEST_PAGE, "página demasiado corta").when(~html.contains(BODY_CLASS), "sin cuerpo del artículo")
    )


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href, posicion): different links of a page in order, without their query."""
    found = F.transform(F.regexp_extract_all(html, F.lit("href=[\"']([^\"'#]+)"), F.lit(1)), lambda h: F.regexp_extract(h, "^([^?]*)", 1))
    return pages.select(key, F.posexplode(F.array_distinct(found)).alias("posicion", "href"))


class _Page(HTMLParser):
    """Heading, place-and-date line, caption and all paragraphs of the body, in that order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.heads: list[str] = []
        self.paragraphs: list[str] = []
        self.sections: list[str] = []
        self.caption: list[str] = []
        self.depth = self.body = self.image = 0
        self.taking: list[tuple[str, int, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            if tag == "br":
                self._put(" ")
            return
        self.depth += 1
        names = (dict(attrs).get("class") or "").split()
        if BODY_CLASS in names and not self.body:
            self.body = self.depth
        if tag in ("h1", "h2", "section") or (tag == "p" and self.body > 0) or "imagen-principal" in names:
            self.taking.append(("img" if "imagen-principal" in names else tag, self.depth, []))

    def handle_endtag(self, tag):
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            return
        while self.taking and self.taking[-1][1] >= self.depth:
            kind, _, parts = self.taking.pop()
            text = " ".join("".join(parts).split())
            where = {"p": self.paragraphs, "section": self.sections, "img": self.caption}.get(kind, self.heads)
            if text:
                where.append(text)
            if self.taking and kind != "p":
                self.taking[-1][2].append(text)
        if self.body == self.depth:
            self.body = -1
        self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        self._put(data)

    def _put(self, data):
        if self.taking:
            self.taking[-1][2].append(data)


def page_text(html: str, place: str = "") -> str | None:
    """Paragraphs of a page between blank lines; None when the body is missing."""
    page = _Page()
    page.feed(html)
    page.close()
    if not page.body:
        return None
    dated = [s for s in page.sections if place and s.startswith(place) and len(s) < 120][:1]
    return "\n\n".join(page.heads[:2] + dated + page.caption[:1] + page.paragraphs)


def pages_to_text(pages: DataFrame, key: str, html: str, place: str = "") -> DataFrame:
    """(key, texto); null where the page has no body."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "texto": [None if h is None else page_text(h, place) for h in batch["html"]]})

    rows = pages.select(F.col(key).alias("k"), F.col(html).alias("html"))
    return rows.mapInPandas(run, f"k {rows.schema['k'].dataType.simpleString()}, texto string").withColumnRenamed("k", key)
