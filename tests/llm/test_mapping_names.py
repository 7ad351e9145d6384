import itertools
import random

import pytest
from pyspark.sql import functions as F

from hemerion.llm import mapping, names
from hemerion.llm.text import deletions, distance, fold, repair

OUTLETS = [(1, "Agua, Tierra y Solaria"), (2, "Crónica Mafamaris"), (3, "Canal Lobicablo"), (4, "Portal Lobicablo"), (5, "Guatabacta"),
           (6, "Cadena Mutual Noticiosa de Menipre"), (7, None), (8, " "), (9, "Revista Milillal"), (2, "Crónica Mafamaris")]
PAYEES = [(1, "Editora Beticeno del Altiplano, S.C."), (2, "Comunicaciones Jovagras, A.C."), (3, "Publicaciones Culapral, S.A.P.I. de C.V.")]


def test_text_helpers():
    assert repair("TezaÃ±aro") == "Tezañaro" and repair("Año") == "Año" and fold("Ñandú") == "nandu"
    assert distance("abcd", "abdc", 2) == 1 and distance("abcd", "abcd", 0) == 0 and distance("a", "abcd", 2) == 3
    assert deletions("abc", 1) == {"abc", "ab", "ac", "bc"}


def look(entries, legal=False):
    rows = list({e[0]: e for e in entries if e[1] and e[1].strip()}.values())
    return mapping.Catalogue([e[0] for e in rows], [e[1] for e in rows], legal)


def test_mentions_and_similarity():
    catalogue = look(OUTLETS)
    for typed, want in {
        "crónica  mafamaris": 2, "LA REVISTA CRÓNICA MAFAMARIS": 2, "CrónicaMafamaris": 2, "Mafamaris Crónica": 2, "Cronica Mafamariz (web)": 2,
        "corresponsal de Canal Lobicablo, de Lugar": 3, "Portal Lobicablo.mx": 4, "Guatavacta": 5, "CMNM": 6, "C.M.N.M.": 6, "Rev. Milillal": 9,
        "Agua, Tierra y Solaira": 1, "CrÃ³nica Mafamaris": 2,
    }.items():
        assert [i for i, _ in catalogue.look_up(typed, 0.6)] == [want], typed
    for typed in ("prensa extranjera", "Revista Potarmas", "S/D", "Canal", "", "¿?", "Lobicablo Lobicablo xyzxyzxyz"):
        assert catalogue.look_up(typed, 0.6) == [], typed
    payees = look(PAYEES, legal=True)
    for typed, want in {"EDITORA BETICENO DEL ALTIPLANO S C": 1, "Editora Beticeno del ": 1, "Jovagras, Comunicaciones,AC": 2, "Comunics. Jovagras": 2,
                        "Publicaciones Culapral,SAPI de CV": 3, "Publicaciones Cullapral, Sociedad Anónima Promotora de Inversión de Capital Variable *": 3}.items():
        assert [i for i, _ in payees.look_up(typed, 0.6)] == [want], typed
    assert payees.look_up("Editora Otracosa del Altiplano, S.C.", 0.6) == []


def test_longest_mention_wins():
    catalogue = look([(1, "Radio Sol"), (2, "Radio Sol del Norte")])
    assert [i for i, _ in catalogue.look_up("Radio Sol del Norte", 0.6)] == [2]


@pytest.mark.parametrize("shard", [50_000, 2])
def test_shards_give_the_same(spark, shard):
    entries = spark.createDataFrame(OUTLETS, "id long, name string")
    values = spark.createDataFrame([("Guatabacta",), ("Guatabacta",), ("nadie",), (None,), (" ",), ("Cronica Mafamaris",)], "value string")
    got = {r.value: r.ref_id for r in mapping.map_to_list(values, entries, "id", "name", shard=shard).collect()}
    assert got == {"Guatabacta": 5, "nadie": -1, "Cronica Mafamaris": 2}


@pytest.mark.parametrize("legal", [False, True])
def test_shards_weigh_all_mentions(spark, legal):
    """Overlapping mentions, ties, initials and common words come out as in one pass."""
    listed = [(1, "Radio Sol"), (2, "Radio Sol del Norte"), (3, "Diario Bravo Mira"), (4, "Diario Bravo Mire"), (5, "Red Ancha de Voz Libre"),
              (6, "Ruta Alta Vía Lenta"), (7, "Noticias Palmar"), (8, "Noticias Olivar"), (9, "Noticias Pinar"), (10, "Agencia Tres Ríos de Oro"),
              (11, "Radio Sol"), (12, "Casa Luz")]
    typed = ["Radio Sol del Norte", "Diario Bravo Mir", "RAVL", "R.A.V.L.", "Noticias Palmr", "Noticias", "ATRO", "Casa Luz, de Radio Sol del Norte", "Radio Sol",
             "casaluz", "NoticiasPalmarr", "nadie", "Red Anch de Voz Libre"]
    rng = random.Random(6)
    words = ["Alba", "Brisa", "Cima", "Duna", "Faro", "Luna", "Radio", "Diario", "del"]
    listed += [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for k in range(40)]
    typed += sorted({" ".join(rng.choice(words + ["Albo", "Dunas"]) for _ in range(rng.randint(1, 6))) for _ in range(60)})
    entries = spark.createDataFrame(listed, "id long, name string")
    values = spark.createDataFrame([(v,) for v in typed], "value string")
    one, two = ({(r.value, r.ref_id, round(r.score, 9)) for r in mapping.map_to_list(values, entries, "id", "name", legal=legal, shard=n).collect()}
                for n in (50_000, 13))
    assert one == two
    got = {v: {i for w, i, _ in one if w == v} for v in typed}
    assert got["Radio Sol del Norte"] == {2} and got["Diario Bravo Mir"] == {-1} and got["Radio Sol"] == {-1} and got["RAVL"] == {-1} and got["nadie"] == {-1}


def test_empty_lists_and_clashes(spark):
    entries = spark.createDataFrame([], "id long, name string")
    values = spark.createDataFrame([("x", 1, 2.0)], "value string, ref_id int, score double")
    mapped = mapping.map_to_list(values, entries, "id", "name")
    assert [r.ref_id for r in mapped.collect()] == [-1]
    rows = mapping.map_fields(values, F.lit("o"), F.lit("k"), F.col("value"), mapped)
    assert [tuple(r) for r in rows.collect()] == [("o", "k", -1)]
    assert mapping.map_to_list(values.where("false"), entries, "id", "name").count() == 0


PEOPLE = [
    ["Claudio Nirarria Lopardosa", "CLAUDIO NIRARRIA LOPARDOSA", "Claudio Antonio Nirarria Lopardosa", "Nirarria Lopardosa, Claudio", "C. Nirarria Lopardosa",
     "claudoi nirarria lopardosa", "Claudio Nirarria L.", "Dr. Claudio Nirarria", "Claudio Nirarria-Lopardosa", "Claudio Niraria Lopardosa"],
    ["Ignacio Chajubrido", "Nacho Chajubrido", "Chajubrido Ignacio", "I. Chajubrido", "Ignacio  Chajubrido."],
    ["Irene Mitodraza Sol"], ["Irene Mitodraza Cruz"], ["Fernando Mitodraza"], ["Adriana Mitodraza", "ADRIANA MITODRAZA"],
    ["Dolores Tezañaro", "Dolores TezaÃ±aro", "Lola Tezanaro"],
    ["Claudia Basarreda Nomu"], ["Claudio Basarreda Nomu"], ["Ana Cajuma"], ["Claudia Noma"], ["Claudia Ruteme"], ["Claudio Tepami"], ["Claudio Sodela"], ["Fernando Tuvelo"], ["Irene Galoti"],
]


def test_spellings_of_people(spark):
    rows = [(n,) for p in PEOPLE for n in p for _ in range(3)] + [(None,), ("",), ("  ",), ("Irene Mitodraza",), ("?",)]
    linked = names.link_names(spark.createDataFrame(rows, "name string")).collect()
    of = {r.name: r.identity for r in linked}
    assert len(of) == len(linked) == sum(map(len, PEOPLE)) + 2
    for person in PEOPLE:
        assert len({of[n] for n in person}) == 1, {n: of[n] for n in person}
    assert len({of[p[0]] for p in PEOPLE}) == len(PEOPLE)
    assert of["Irene Mitodraza"] not in {of["Irene Mitodraza Sol"], of["Irene Mitodraza Cruz"]}
    pairs = names.name_pairs(names.link_names(spark.createDataFrame(rows, "name string"))).collect()
    want = {tuple(sorted(p)) for person in PEOPLE for p in itertools.combinations(person, 2)}
    assert {tuple(p) for p in pairs} == want and len(pairs) == len(want)


def test_no_names(spark):
    assert names.link_names(spark.createDataFrame([], "name string")).count() == 0


def test_chains_of_slips_are_followed_to_the_end(spark):
    nodes = spark.createDataFrame([(f"n{k:02d}", 100 - k) for k in range(40)], "node string, n long")
    edges = spark.createDataFrame([(f"n{k:02d}", f"n{k - 1:02d}") for k in range(1, 40)], "a string, b string")
    assert {r.root for r in names._roots(nodes, edges).collect()} == {"n00"}
