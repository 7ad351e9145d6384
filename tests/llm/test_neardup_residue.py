import itertools
import random

import pytest

from hemerion.llm import neardup, residue


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_hamming_join_finds_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(20)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, 30))) for b in base for _ in range(6)]
    rows = [(k, [signed(v >> 64), signed(v & (1 << 64) - 1)]) for k, v in enumerate(values)]
    got = neardup.hamming_join(spark.createDataFrame(rows, "id long, signature array<long>")).collect()
    want = {(a, b, bin(values[a] ^ values[b]).count("1")) for a, b in itertools.combinations(range(len(values)), 2)}
    assert {tuple(r) for r in got} == {w for w in want if w[2] <= neardup.THRESHOLD} and len(got) == len({(r.a, r.b) for r in got})


SUBJECTS = [
    ["Abandono de archivos notariales Fanalleo de sociedad Romavux en Dosardac", "abandono de archivos notariales fanalleo, sociedad romavux: dosardac",
     "Abandono de archivo notariales Fanaleo de sociedad Romavux en Dosardac", "urgente Abandono de archivos notariales Fanalleo de sociedad Romavux en Dosardac",
     "en Dosardac de sociedad Romavux ABANDONO DE ARCHIVOS NOTARIALES FANALLEO"],
    ["Abandono de archivos notariales Tepigora de sociedad Balistro en Nomeque"], ["Aumento al salario de jornaleros"],
]


def test_subjects(spark):
    rows = [(t, 5) for group in SUBJECTS for t in group] * 2 + [(None, 1), ("", 1), ("  ", 1), ("de la", 1)] + [("Calendario escolar", 2)] * 300
    df = spark.createDataFrame(rows, "text string, id int")
    pairs = neardup.text_pairs(*neardup.near_duplicates(df)).collect()
    want = {tuple(sorted(p)) for g in SUBJECTS for p in itertools.combinations(g, 2)}
    assert {tuple(p) for p in pairs} == want and len(pairs) == len(want)
    assert neardup.text_pairs(*neardup.near_duplicates(df.where("false"))).count() == 0


def test_simhash_is_near_for_near_texts():
    a, b, c = residue.simhashes(["la pagina que busca no existe o cambio de lugar", "la pagina que busca no existe y cambio de lugar", "x"])
    assert bin((a ^ b) & (1 << 64) - 1).count("1") < 16
    assert residue.simhashes(["abc", "abc"])[0] == residue.simhashes(["abc"])[0]
    one_by_one = [residue.simhashes([t])[0] for t in ("uno dos tres", "é", "cuatro")]
    assert residue.simhashes(["uno dos tres", "é", "cuatro"]) == one_by_one


RESIDUE = [
    "Estimado {{nombre}}: gracias.", "Hoy ${municipio} informó.", "El %(folio)s dice", "@@fecha@@", "<<medio>>", "{% if x %}", "[INSERTAR FECHA]", "[medio aquí]",
    "[nombre del vocero]", "#MONTO# pesos", "__MEDIO__", "XX de XXXX de 20XX", "{titulo} | x", "Lorem ipsum dolor auctora.", "Texto de relleno.", "Nota por definir.",
    "Please enable JavaScript to continue.", "Su navegador no admite scripts; el reproductor no puede mostrarse.", "Error 410. La página que busca no existe.",
    "HTTP 404 Not Found: the requested document was not located on this server.", '{"status": 502, "error": "x"}', "Traceback (most recent call last): File",
    "Hablaron de agua.\nNo se pudo establecer la conexión con la base de datos.\nSiguió.", "<html><head><title>404</title></head></html> Dijo que sí.",
]
CLEAN = [
    "¿Por qué la página de trámites pide activar JavaScript?, preguntó Ana.", "La reportera contó que el portal marcó error 404 toda la mañana.",
    "Dijo Luis que la plantilla de 73 trabajadores está completa.", "El formato trae campos para nombre, cargo y fecha.", "[Aplausos] [Se proyecta un video]",
    "El acceso denegado a los vecinos fue, según Ana, un error interno de la alcaldía.", "<p>Hola</p> <br> &aacute;", "Tuiteó: #AguaParaTodos con 21% @vecinos",
    "Nombre: ████", "El folio 503 del registro, servicio no disponible en Lugar, quedó en la lista de quejas.", None, "", "   ", "\n\n",
]


def test_residue_documents(spark):
    rows = [(k, t, True) for k, t in enumerate(RESIDUE)] + [(1000 + k, t, False) for k, t in enumerate(CLEAN)]
    rows.append((5000, "Se dijo. " * 20_000 + "Texto de relleno.", True))
    df = spark.createDataFrame(rows, "k long, t string, notice boolean")
    got = {r.k for r in residue.residue_documents(df, "k", "t").collect()}
    assert got == {k for k, _, bad in rows if bad}
    assert residue.residue_documents(df.where("false"), "k", "t").count() == 0


def test_labels_spread_over_links(spark):
    near = ["aviso importante para los lectores de este sitio en reparacion temporal durante la semana" + " x" * k for k in range(4)]
    forms = spark.createDataFrame([(k, f, k == 0, residue.simhashes([f])[0]) for k, f in enumerate(near + ["otra cosa distinta"])],
                                  "id long, form string, notice boolean, hash long")
    got = {r.id for r in residue.spread(forms).collect()}

    def linked(a, b):
        x, y = residue.grams(a), residue.grams(b)
        apart = bin((residue.simhashes([a])[0] ^ residue.simhashes([b])[0]) & (1 << 64) - 1).count("1")
        return len(x & y) >= residue.SIMILARITY * len(x | y) and apart <= residue.DISTANCE

    want, edge = {0}, {0}
    while edge:
        edge = {j for i in edge for j in range(len(near)) if j not in want and linked(near[i], near[j])}
        want |= edge
    assert got == want


@pytest.mark.parametrize("text", RESIDUE)
def test_hints_cover_the_patterns(text):
    for segment in residue.segments(text):
        plain = residue.fold(segment)
        if any(p.search(plain) for p, _ in residue._MACHINE):
            assert any(h in plain for h in residue._MACHINE_HINTS), plain


def similar_pairs(count, low, high, seed):
    """Invented sentences, each with one that differs in some words and has a similarity from ``low`` to ``high``."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    while len(out) < count:
        words = [word() for _ in range(rng.randint(6, 24))]
        other = list(words)
        for k in rng.sample(range(len(words)), len(words)):
            other[k] = word()
            x, y = residue.grams(" ".join(words)), residue.grams(" ".join(other))
            alike = len(x & y) / len(x | y)
            if low <= alike <= high:
                out.append((" ".join(words), " ".join(other)))
            if alike < high:
                break
    return out


def test_spread_against_brute_force_on_similarity(spark):
    pairs = similar_pairs(1500, 0.8, 0.82, 7)
    texts = [t for p in pairs for t in p]
    rows = [(k, t, k % 2 == 0) for k, t in enumerate(texts)]
    got = {r.id for r in residue.spread(spark.createDataFrame(rows, "id long, form string, notice boolean")).collect()}
    assert len(got & set(range(1, 3000, 2))) >= 0.99 * 1500 and got >= set(range(0, 3000, 2))


def test_words_around_residue_spread_nothing(spark):
    around = "el gobernador informo que las obras del acueducto de la sierra quedaran listas antes de que termine el mes de marzo"
    texts = [
        ("xxxxx xxxxx xxxxx xxxxx " + around + ".", True), (around.capitalize() + ".", False),
        ("Texto de relleno para la nota de portada que el equipo de redaccion cambiara manana.", True),
        ("Texto de reyeno para la nota de portada que el equipo de redaccion cambiara manana.", True),
        ("¿Texto de reyeno para la nota de portada que el equipo de redaccion cambiara manana?", False),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "k long, t string")
    assert {r.k for r in residue.residue_documents(df, "k", "t").collect()} == {k for k, (_, bad) in enumerate(texts) if bad}


def test_labels_spread_over_more_than_twenty_links(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(36)]
    chain = [residue.grams(" ".join(words[k : k + 14])) for k in range(23)]
    assert max(len(x & y) / len(x | y) for x, y in zip(chain, chain[2:])) < residue.SIMILARITY
    rows = [(k, " ".join(words[k : k + 14]), k == 0) for k in range(23)]
    got = {r.id for r in residue.spread(spark.createDataFrame(rows, "id long, form string, notice boolean")).collect()}
    assert got == set(range(23))


def test_the_screen_equals_counting_runs():
    rng = random.Random(11)
    words = ["de", "la", "pagina", "error", "servicio", "texto", "no", "existe"]
    some = lambda n: [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    cores, forms = sorted(set(some(30))), some(200) + ["", "x"]
    want = {(i, j) for i, f in enumerate(forms) for j, c in enumerate(cores) if len(residue.grams(c) & residue.grams(f)) >= residue.KEPT * len(residue.grams(c))}
    assert set(residue.Screen(cores).held(forms)) == want
    many = residue.Screen(cores).held(forms * 900)
    assert len(many) == len(set(many)) == 900 * len(want)


@pytest.mark.parametrize("text, found", [
    ("Dear {{" + "x" * 500 + "}}: hello.", True), ("Pagó ${" + "y" * 500 + "} ayer.", True), ("[insertar " + "nombre " * 60 + "]", True), ("{{\n nombre\n}}", True),
    ("Dijo que no. Su navegador no admite scripts; el reproductor no puede mostrarse Sobre lo mismo, ¿cuánto costó la obra?", True),
    ("[pendiente de redactar] Para Ana, el asunto es otro.", True), ("RESPUESTA: Error 404", True), ("Oops! Something went wrong on our side.", True),
    ("This page is having trouble loading. Try again later.", True), ("Consectetur adipiscing elit sed do eiusmod tempor.", True),
    ("La sesión expiró sin acuerdos y los asistentes tuvieron que volver al inicio de la fila.", False), ("¿Página no encontrada?", False),
])
def test_residue_in_any_place(spark, text, found):
    df = spark.createDataFrame([(1, text), (2, "Nada.")], "k long, t string")
    assert [r.k for r in residue.residue_documents(df, "k", "t").collect()] == ([1] if found else [])


def test_labels_come_over_links(spark):
    """Notices reach the corpus over the tables only, also where their wording differs; an own list replaces the confirmed one."""
    said = ["Su sesion ha expirado", "La página que buscas no existe o cambió de lugar.", "El boletín quedó listo hoy."]
    df = spark.createDataFrame(list(enumerate(said)), "k long, t string")
    got = residue.labelled_sentences(df, "k", "t").collect()
    assert {r.doc for r in got} == {0, 1} and not any(r.trusted for r in got)
    assert {r.doc for r in residue.labelled_sentences(df, "k", "t", ["El boletín quedó listo hoy"]).collect()} == {2}
    field = [(0, "Estimado {{nombre}}, le informamos que su trámite quedó listo"), (1, "Estimado {{nombre}, le informamos que su trámite quedó listo"),
             (2, "Estimado Juan, le informamos que su trámite quedó listo")]
    found = residue.labelled_sentences(spark.createDataFrame(field, "k long, t string"), "k", "t").collect()
    assert {(r.doc, r.trusted) for r in found} == {(0, True), (1, False)}


def test_chains_of_slipped_words_are_followed_to_the_end(spark):
    chain = ["a" * k + "b" * (30 - k) for k in range(0, 26, 2)]
    counted = spark.createDataFrame([(w, 100 - k) for k, w in enumerate(chain)], "word string, n long")
    assert {r.word: r.meant for r in neardup.slip_map(counted).collect()} == {w: chain[0] for w in chain[1:]}


def test_common_words_are_matched_one_to_one():
    assert neardup.matched(["casas", "casos", "perro"], ["casar", "perra", "perri"]) == 2
    assert neardup.matched(["abcd", "abce"], ["abcf", "abzz"]) == 2 and neardup.matched(["abc"], ["abd"]) == 0 and neardup.matched([], ["abcd"]) == 0


def test_pairs_at_two_thirds_are_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(5))
    common = ["obra", "puente", "sobre"]
    rows = []
    for k in range(600):
        shared = common + [word() for _ in range(5)]
        rows += [(2 * k, shared + [word(), word()]), (2 * k + 1, shared + [word(), word()])]
    sets = spark.createDataFrame(rows, "id long, meant array<string>")
    got = {(r.a, r.b) for r in neardup.candidates(sets).collect()}
    assert len(got & {(2 * k, 2 * k + 1) for k in range(600)}) >= 0.99 * 600 and len(got) < 4 * 600


def subjects_by_brute_force(texts, share=2 / 3):
    sets = [{w for w in residue.fold(t).split() if len(w) > 2} for t in texts]
    found = set()
    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if sets[a] == sets[b] or min(len(x), len(y)) < share * max(len(x), len(y)) - 1e-9:
            continue
        common = len(x & y) + neardup.matched(sorted(x - y), sorted(y - x))
        if common >= share * (len(x) + len(y) - common) - 1e-9:
            found.add(tuple(sorted((texts[a], texts[b]))))
    return found


def invented_subjects(rng, count):
    word = lambda n: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(n))
    usual, names = [word(3) for _ in range(12)], [word(4) for _ in range(30)]
    texts = set()
    while len(texts) < count:
        subject = rng.sample(usual, rng.randint(1, 8)) + rng.sample(names, rng.randint(0, 3))
        for _ in range(rng.randint(1, 4)):
            said = [w for w in subject if rng.random() > 0.1] or subject
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(said))
                at = rng.randrange(len(said[k]))
                said[k] = said[k][:at] + rng.choice(["", "x", "y", said[k][at] * 2]) + said[k][at + 1 :]
            texts.add(" ".join(said))
    return sorted(texts)


@pytest.mark.parametrize("few, together", [(16, 20_000), (2, 1)])
def test_subjects_equal_brute_force(spark, monkeypatch, few, together):
    """Also where every group is large and every key deep."""
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "TOGETHER", together)
    texts = invented_subjects(random.Random(4), 500)
    members, links = neardup.near_duplicates(spark.createDataFrame([(t,) for t in texts], "text string"))
    of = {r.id: r.text for r in members.collect()}
    got = [tuple(sorted((of[r.a], of[r.b]))) for r in links.collect()]
    want = subjects_by_brute_force(texts)
    assert len(want) > 500 and {p for p in want if p[0] in of.values() and p[1] in of.values()} == set(got) and len(got) == len(set(got))


def test_long_subjects_meet_short_ones(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(5)) for _ in range(60)]
    texts = [" ".join(words[:n]) for n in (26, 32, 36, 48, 60)]
    pairs = neardup.text_pairs(*neardup.near_duplicates(spark.createDataFrame([(t,) for t in texts], "text string"))).collect()
    assert {tuple(p) for p in pairs} == subjects_by_brute_force(texts) and len(pairs) == 6


def test_a_subject_lists_few_keys():
    """What a set writes stays far below the disk that its row may take."""
    import pandas as pd

    names = [f"palabra{k}" for k in range(10)]
    rows = pd.concat(neardup._first_common(2 / 3, {}, {w: 10 ** min(k + 3, 6) for k, w in enumerate(names)})([pd.DataFrame({"id": [7], "words": [names], "changed": [None]})]))
    assert len(rows) <= 20 and rows["rest"].str.len().sum() + 20 * len(rows) < 1000


def test_texts_are_screened_as_their_sentences_are():
    """Folding whole batches letter by letter gives the runs of each sentence's form, odd letters included."""
    rng = random.Random(12)
    cores = sorted({residue.folded(n) for n in residue.NOTICES} | set(residue.MACHINE.values()))
    odd = ["́", "Σ", "각", "😀", "𝒳", " ", "…", "\r\n", "\n", "٣4", "\ud800", "İ", "ﬁ", "_", "¿", "?", ". ", ".", " ", "½", "֑", "ñ", "É", "K"]
    said = [w for n in residue.NOTICES for w in n.split()]
    texts = ["", " ", "...", "́", "404", "Erroŕ 4 0 4", "ERROR ４０４", "Ĺorem ípsum", "x", "Texto de\nrelleno", "Texto de relleno.́ Texto"]
    texts += ["".join(rng.choice(said) + rng.choice([" ", " ", " ", *odd]) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    texts += [" ".join(rng.choice(residue.NOTICES).split()[: rng.randint(1, 6)]) for _ in range(300)]
    screen, letters = residue.Screen(cores), residue.Letters()
    forms = [(k, residue._bare(s)) for k, t in enumerate(texts) for s in residue.segments(residue._FIGURES.sub("0", residue.fold(t)))]
    want = {k for k, f in forms if any(len(residue.grams(c) & residue.grams(f)) >= residue.KEPT * len(residue.grams(c)) for c in cores)}
    held, hinted = screen.texts(letters, texts, residue._MACHINE_HINTS)
    assert held == want and 0 < len(want) < len(texts)
    assert hinted == {k for k, t in enumerate(texts) if any(h in residue.fold(t) for h in residue._MACHINE_HINTS)}


def test_pieces_without_a_core_are_no_nodes():
    import pandas as pd

    text = "Texto de relleno Para Ana, el asunto es otro Desde marzo cambió todo"
    found = pd.concat(residue._splitter(["texto de relleno"])([pd.DataFrame({"doc": [1], "text": [text]})]))
    assert "texto de relleno" in set(found["form"]) and not any(len(residue.grams("texto de relleno") & residue.grams(f)) < 6 for f in found["form"])
