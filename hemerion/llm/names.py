"""Variant spellings of people's names, linked to one identity.

Every distinct spelling is read as given name, first and second surname: order, titles,
middle names, nicknames, initials, accents, wrong encoding and letters that sound alike
are taken out. Each reading is rewritten into every shorter canonical form it may be
typed as; the forms are exploded and equi-joined. A form is scored by its rarity: only a
form that a single identity can be rewritten to links to it, so a short form shared by
namesakes links to none. Slips are forms with letters left out, joined while the other
parts agree, and only where one of the two words isn't established by other bearers.

Scale: spellings are counted first, so a hot speaker is one row; keys hold at least one
whole word and the rest of the name, so no key gathers unrelated names; all links are
equi-joins on DataFrames, none reaches the driver. Nodes are written to the shared
checkpoint folder between stages.

Defined results: null, empty and blank strings are no names; a string without two
readable parts is linked only to strings of the same parts; equal strings are one
spelling, however often and in whichever field they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemerion.llm.text import deletions, distance, fold, repair
from hemerion.operators.entities import follow
from hemerion.session import materialize

#: Forms of address before a name.
TITLES = frozenset(
    "dr dra mtro mtra lic licda licdo ing arq prof profa profr sr sra srta don dona doctor doctora maestro maestra "
    "licenciado licenciada ingeniero ingeniera senor senora cp gral cap tte".split()
)
#: Nicknames and the given names they stand for.
NICKNAMES = {
    "nacho": "ignacio", "lola": "dolores", "gaby": "gabriela", "gabi": "gabriela", "pepe": "jose", "paco": "francisco",
    "pancho": "francisco", "lupe": "guadalupe", "lupita": "guadalupe", "tono": "antonio", "toño": "antonio",
    "chucho": "jesus", "chuy": "jesus", "memo": "guillermo", "quique": "enrique", "kike": "enrique", "tere": "teresa",
    "chayo": "rosario", "charo": "rosario", "concha": "concepcion", "conchita": "concepcion", "paty": "patricia",
    "pati": "patricia", "lety": "leticia", "leti": "leticia", "chela": "graciela", "vero": "veronica", "meche": "mercedes",
    "chabela": "isabel", "chavela": "isabel", "isa": "isabel", "rafa": "rafael", "fer": "fernando", "nando": "fernando",
    "chelo": "consuelo", "lalo": "eduardo", "neto": "ernesto", "gus": "gustavo",
    "checo": "sergio", "goyo": "gregorio", "yola": "yolanda", "yoli": "yolanda", "bety": "beatriz", "betty": "beatriz",
    "mari": "maria", "chema": "jose maria", "manolo": "manuel", "meny": "manuel", "manny": "manuel", "poncho": "alfonso",
    "caro": "carolina", "susy": "susana", "susi": "susana", "xime": "ximena", "adri": "adriana", "juli": "julieta",
    "vicky": "victoria", "chente": "vicente", "rober": "roberto", "leo": "leonardo", "mau": "mauricio", "pau": "paulina",
    "wences": "wenceslao", "cuco": "refugio", "cuca": "refugio", "tomy": "tomas", "ale": "alejandra", "mago": "margarita",
}
#: Nicknames of several given names; the rest of the name decides.
SHARED_NICKNAMES = {
    "beto": ["alberto", "roberto", "humberto", "norberto"], "dani": ["daniel", "daniela"], "tavo": ["gustavo", "octavio"],
}
_SPLIT = re.compile(r"[^a-z]+")
_KEYED = "key string, word string, ident string, own boolean, target boolean"


def sound(word: str) -> str:
    """Letters that sound alike become one; doubled letters become single."""
    word = word.replace("ch", "1").replace("ll", "y").replace("qu", "k").replace("ce", "se").replace("ci", "si")
    word = word.translate(str.maketrans({"c": "k", "q": "k", "v": "b", "z": "s", "y": "i", "h": None, "w": "u", "x": "j", "g": "j"}))
    return re.sub(r"(.)\1+", r"\1", word)


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parts, sure = [], []
        for name in batch["name"]:
            text = fold(repair(name))
            before, comma, after = text.partition(",")
            turned = bool(comma) and bool(_SPLIT.sub("", before)) and bool(_SPLIT.sub("", after))
            words = [w for w in _SPLIT.split(f"{after} {before}" if turned else text) if w]
            while len(words) > 1 and words[0] in TITLES:
                words = words[1:]
            parts.append(words)
            sure.append(turned)
        yield batch.assign(parts=parts, sure=sure)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [reading(list(p), list(s), sure) for p, s, sure in zip(batch["parts"], batch["shares"], batch["sure"])]
        yield pd.concat(
            [batch[["name", "n"]], pd.DataFrame(rows, columns=["given", "first", "second"], index=batch.index)], axis=1
        )


def reading(parts: list[str], shares: list[float], sure: bool) -> tuple[str, str, str]:
    """(given, first surname, second surname); a missing part is ''.

    ``shares``: of each word, the share of names that it opens.
    """
    if not parts:
        return "", "", ""
    is_given = dict(zip(parts, (s >= 0.5 or w in NICKNAMES for w, s in zip(parts, shares))))
    share = dict(zip(parts, shares))
    if len(parts) > 2 and parts[0] == "c" and is_given[parts[1]] and len(parts[1]) > 1:
        parts = parts[1:]
    if not sure and len(parts) > 1 and len(parts[-1]) > 1 and not is_given[parts[0]] and is_given[parts[-1]] and len(parts[0]) > 1:
        parts = [parts[-1], *parts[:-1]]
    elif not sure and len(parts) == 2 and len(parts[1]) > 1 and len(parts[0]) > 1 and share[parts[1]] > share[parts[0]]:
        parts = parts[::-1]
    given, rest = parts[0], parts[1:]
    while len(rest) > 1 and (len(rest) > 2 or is_given[rest[0]] or (len(rest[0]) == 1 and len(rest[1]) > 1)):
        rest = rest[1:]
    given = NICKNAMES.get(given, given)
    return given, *(rest + ["", ""])[:2]


def _typo_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forms with letters left out of one word; full names also of two of the three."""
    for batch in batches:
        out = []
        for kind, form, ident, own, target in zip(batch["kind"], batch["form"], batch["ident"], batch["own"], batch["target"]):
            parts = form.split("|")
            for k, word in enumerate(parts):
                if len(word) > 2:
                    rest = "|".join(parts[:k] + [""] + parts[k + 1 :])
                    out += [(f"{kind}{k}|{d}|{rest}", word, ident, own, target) for d in deletions(word, slips(word))]
            if kind == "F":
                lost = [deletions(w, 1) if len(w) > 4 else {w} for w in parts]
                for k, word in enumerate(parts):
                    left, right = [x for j, x in enumerate(lost) if j != k]
                    words = "|".join(parts[:k] + parts[k + 1 :])
                    out += [(f"D{k}|{word}|{x}|{y}", words, ident, own, target) for x in left for y in right]
        yield pd.DataFrame(out, columns=["key", "word", "ident", "own", "target"])


def slips(word: str) -> int:
    return 1 if len(word) < 6 else 2


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for a, b in zip(batch["word_a"], batch["word_b"]):
            both = list(zip(a.split("|"), b.split("|")))
            keep.append(all(distance(x, y, 2) <= (max(slips(x), slips(y)) if len(both) == 1 else 1) for x, y in both))
        yield batch[keep]


def _forms(df: DataFrame, kinds: list[str], ident: str) -> DataFrame:
    """(kind, form, ident): the rewritings of each reading."""
    initial, second = F.substring("letter", 1, 1), F.substring("second", 1, 1)
    made = {
        "F": F.when(F.length("second") > 1, F.concat_ws("|", "given", "first", "second")),
        "S": F.concat_ws("|", "given", "first"),
        "I": F.when(F.length("second") > 1, F.concat_ws("|", initial, F.col("first"), F.col("second"))),
        "J": F.concat_ws("|", initial, F.col("first")),
        "G": F.when(F.length("second") > 0, F.concat_ws("|", F.col("given"), F.col("first"), second)),
        "K": F.when(F.length("second") > 0, F.concat_ws("|", initial, F.col("first"), second)),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), made[k].alias("form")) for k in kinds])).alias("f")
    return df.select(F.col(ident).alias("ident"), rows).select("f.kind", "f.form", "ident").where("form is not null").distinct()


def form_rarity(forms: DataFrame) -> DataFrame:
    """(kind, form, root, rarity): one over the number of identities that can be rewritten to a form; root is the least of them."""
    return forms.groupBy("kind", "form").agg(F.min("ident").alias("root"), (1 / F.countDistinct("ident")).alias("rarity"))


def _rare(forms: DataFrame) -> DataFrame:
    """Forms that one identity alone can be rewritten to: (kind, form, root)."""
    return form_rarity(forms).where("rarity = 1").drop("rarity")


def _assign(open_nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Open nodes (node, kind, form) with the root of their own form, where it is rare."""
    return open_nodes.join(_rare(targets), ["kind", "form"]).select("node", "root")


def _assign_slips(open_nodes: DataFrame, slipped: DataFrame, roots: DataFrame) -> DataFrame:
    """Open nodes whose form is one word's slip away from forms of a single root."""
    near = open_nodes.select("node").join(slipped, F.col("node") == F.col("a")).select("node", "b")
    of = roots.select(F.col("node").alias("b"), "root")
    found = near.join(of, "b").groupBy("node").agg(F.min("root").alias("root"), F.countDistinct("root").alias("roots"))
    return found.where("roots = 1").select("node", "root")


def _slip_pairs(forms: DataFrame, established: DataFrame) -> DataFrame:
    """(a, b): a's own form is a slip away from a form of b, and not both words are established."""
    typed = forms.mapInPandas(_typo_keys, _KEYED)
    # Explosion isn't in the size estimate, so the join is named: neither side is shipped whole.
    pairs = (
        typed.where("own").select("key", F.col("word").alias("word_a"), F.col("ident").alias("a")).hint("merge")
        .join(typed.where("target").select("key", F.col("word").alias("word_b"), F.col("ident").alias("b")), "key")
        .where("a <> b and word_a <> word_b").select("a", "b", "word_a", "word_b").distinct()
        .mapInPandas(_near, "a string, b string, word_a string, word_b string")
    )
    changed = F.explode(F.arrays_zip(F.split("word_a", "\\|").alias("x"), F.split("word_b", "\\|").alias("y"))).alias("w")
    each = pairs.select("a", "b", changed).select("a", "b", F.col("w.x").alias("x"), F.col("w.y").alias("y")).where("x <> y")
    for side in ("x", "y"):
        known = established.select(F.col("word").alias(side), F.col("bearers").alias(f"bearers_{side}"))
        each = each.join(known, side, "left")
    few = F.least(F.coalesce("bearers_x", F.lit(0)), F.coalesce("bearers_y", F.lit(0)))
    many = F.greatest(F.coalesce("bearers_x", F.lit(0)), F.coalesce("bearers_y", F.lit(0)))
    # By shares alone, less two bearers that any slip may have, so the rule is the same at every size.
    likely = each.withColumn("likely", (few - 2) * 8 <= many)
    return likely.groupBy("a", "b").agg(F.bool_and("likely").alias("likely")).where("likely").select("a", "b")


def _roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): each node follows its most frequent neighbour that outranks it, to the end of the chain."""
    size = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"))
    own = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"))
    up = (
        edges.join(size, "b").join(own, "a").where("n_b > n_a or (n_b = n_a and b < a)")
        .groupBy("a").agg(F.max_by("b", F.struct("n_b", "b")).alias("up"))
    )
    links = nodes.select("node").join(up, F.col("node") == F.col("a"), "left").select("node", F.coalesce("up", "node").alias("root"))
    return follow(links, "node", "root")


def _nicknamed(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes by a nickname of several names, with the one root that fits."""
    names = F.create_map(*[
        x for k, v in SHARED_NICKNAMES.items() for x in (F.lit(sound(k)), F.array(*[F.lit(sound(n)) for n in v]))
    ])
    meant = nodes.where("length(first) > 1").withColumn("meant", F.explode(names[F.col("given")]))
    full = F.length("second") > 1
    rows = meant.select(
        "node", F.when(full, F.lit("F")).otherwise("S").alias("kind"),
        F.when(full, F.concat_ws("|", "meant", "first", "second")).otherwise(F.concat_ws("|", "meant", "first")).alias("form"),
    )
    found = rows.join(_rare(targets), ["kind", "form"]).groupBy("node").agg(F.min("root").alias("root"), F.countDistinct("root").alias("roots"))
    return found.where("roots = 1").select("node", "root")


def link_names(names: DataFrame) -> DataFrame:
    """(name, identity) for the distinct non-blank ``names.name``."""
    counted = names.where(F.trim("name") != "").groupBy("name").agg(F.count("*").alias("n"))
    cleaned = materialize(counted.mapInPandas(_clean, "name string, n long, parts array<string>, sure boolean"), "names")
    words = cleaned.select("name", F.posexplode("parts").alias("at", "word"))
    share = words.groupBy("word").agg((F.count_if(F.col("at") == 0) / F.count("*")).alias("share"))
    shares = (
        words.join(share, "word").groupBy("name")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "share"))), lambda x: x.share).alias("shares"))
    )
    read = cleaned.join(shares, "name", "left").withColumn("shares", F.coalesce("shares", F.array().cast("array<double>")))
    schema = "name string, n long, given string, first string, second string"
    read = read.mapInPandas(_read, schema)
    keyed = materialize(read.mapInPandas(_sound_out, schema + ", letter string"), "readings")
    node = F.concat_ws("|", "given", "first", "second").alias("node")
    read_as = keyed.select("name", "n", node, "given", "first", "second", "letter")
    every_node = materialize(
        read_as.groupBy("node").agg(
            F.sum("n").alias("n"), F.min("given").alias("given"), F.min("first").alias("first"),
            F.min("second").alias("second"), F.min("letter").alias("letter"),
        ),
        "nodes",
    )
    shared = F.col("given").isin([sound(k) for k in SHARED_NICKNAMES])
    nodes = every_node.where(~shared)
    whole = nodes.where("length(given) > 1 and length(first) > 1")
    full = whole.where("length(second) > 1")
    bearers = whole.select(F.col("first").alias("word"), F.col("given").alias("by")).unionByName(
        whole.where("length(second) > 1").select(F.col("second").alias("word"), F.col("given").alias("by"))
    ).unionByName(whole.select(F.col("given").alias("word"), F.col("first").alias("by")))
    established = materialize(bearers.groupBy("word").agg(F.countDistinct("by").alias("bearers")), "words")

    # Own form of each node: a full name, or the kind of short form it is.
    kind = (
        F.when((F.length("given") == 1) & (F.length("second") > 1), "I")
        .when((F.length("given") == 1) & (F.length("second") == 1), "K").when(F.length("given") == 1, "J")
        .when(F.length("second") == 1, "G").otherwise("S")
    )
    short = nodes.where("(length(given) = 1 or length(second) <= 1) and length(first) > 1").withColumn("kind", kind)
    form = F.when(F.col("kind").isin("I", "K", "G"), F.col("node")).otherwise(F.concat_ws("|", "given", "first"))
    short = materialize(short.withColumn("form", form), "short")

    # All slips in one join, of own forms against what names can be rewritten to.
    own, target = F.lit(True).alias("own"), F.lit(True).alias("target")
    not_own, no_target = F.lit(False).alias("own"), F.lit(False).alias("target")
    slippery = (
        _forms(full, ["F"], "node").select("*", own, target).unionByName(_forms(full, ["S", "I", "G", "J"], "node").select("*", not_own, target))
        .unionByName(short.where("kind = 'S'").select("kind", "form", F.col("node").alias("ident"), own, target))
        .unionByName(_forms(short.where("kind = 'S'"), ["J"], "node").select("*", not_own, target))
        .unionByName(short.where("kind in ('I', 'G', 'J')").select("kind", "form", F.col("node").alias("ident"), own, no_target))
    )
    slipped = materialize(_slip_pairs(slippery, established), "slips")

    # Full names follow their most frequent spelling.
    full_roots = _roots(full, slipped.join(full.select(F.col("node").alias("a")), "a", "left_semi"))
    rooted = full.join(full_roots, "node")

    # Shorter forms are looked up among what full names can be rewritten to.
    forms = materialize(_forms(rooted, ["F", "S", "I", "G", "K", "J"], "root"), "forms")
    early = short.where("kind in ('S', 'I', 'G', 'K')")
    exact = _assign(early, forms)
    known = forms.select("kind", "form").distinct()
    unheard = early.where("kind <> 'K'").join(known, ["kind", "form"], "left_anti")
    found = materialize(exact.unionByName(_assign_slips(unheard, slipped, full_roots)), "found")

    # Given name and one surname without a full name are identities of their own.
    alone = materialize(short.where("kind = 'S'").join(found.select("node"), "node", "left_anti"), "alone")
    among = slipped.join(alone.select(F.col("node").alias("a")), "a", "left_semi").join(alone.select(F.col("node").alias("b")), "b", "left_semi")
    alone_roots = _roots(alone, among)
    of_alone = _forms(alone.join(alone_roots, "node"), ["S", "J"], "root")
    every = materialize(forms.where("kind = 'J'").unionByName(of_alone), "every")
    late = short.where("kind <> 'S'").join(found.select("node"), "node", "left_anti").withColumn(
        "kind", F.when(F.length("given") == 1, "J").otherwise("S")
    ).withColumn("form", F.concat_ws("|", "given", "first"))
    # An initial of the second surname rules out identities that have another one.
    late = materialize(late.join(forms.where("kind = 'S'").select("form").distinct(), "form", "left_anti"), "late")
    named = late.where("length(second) = 0 or kind = 'S'")
    late_found = _assign(named, every)
    # With a second surname of its own, only an identity without one can be meant.
    other = _assign(late.where("not (length(second) = 0 or kind = 'S')"), every).where("root like '%|'")
    unheard = named.where("kind = 'J'").join(every.select("kind", "form").distinct(), ["kind", "form"], "left_anti")
    settled = reduce(DataFrame.unionByName, [full_roots, found, alone_roots])
    late_slips = _assign_slips(unheard, slipped, settled)

    nicknamed = _nicknamed(every_node.where(shared), forms.unionByName(every.where("kind = 'S'")))

    roots = materialize(reduce(DataFrame.unionByName, [nicknamed, settled, late_found, other, late_slips]), "roots")
    return read_as.select("name", "node").join(roots, "node", "left").select("name", F.coalesce("root", "node").alias("identity"))


def _sound_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        letter = batch["given"].str[:1].fillna("")
        given = [sound(w) if len(w) > 1 else w for w in batch["given"]]
        # An initial stays the letter typed; a second surname's initial is compared by sound.
        first = [sound(w) if len(w) > 1 else w for w in batch["first"]]
        second = [sound(w) for w in batch["second"]]
        yield batch.assign(given=given, first=first, second=second, letter=letter)


def name_pairs(linked: DataFrame) -> DataFrame:
    """(nombre_a, nombre_b): different spellings of one identity, the smaller first."""
    a = linked.select("identity", F.col("name").alias("nombre_a"))
    b = linked.select("identity", F.col("name").alias("nombre_b"))
    return a.join(b, "identity").where("nombre_a < nombre_b").select("nombre_a", "nombre_b")


def stacked(*fields: tuple[DataFrame, str]) -> DataFrame:
    """One column ``name`` from several fields."""
    parts: list[DataFrame] = [df.select(F.col(column).alias("name")) for df, column in fields]
    return reduce(DataFrame.unionByName, parts)
