import itertools
import random

from pyspark.sql import functions as F

from hemerion.operators import aggregates, documents, entities, identity, lineage, mining, sessions, similarity


def test_edit_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(150)}

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {frozenset(p) for p in itertools.combinations(words, 2) if apart(*p) <= 2}
    got = entities.edit_pairs(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    assert {frozenset((r.a, r.b)) for r in got} == want and len(got) == len(want)


def test_subjects_equal_the_greedy_loop(spark):
    rng = random.Random(7)
    pool = ["puente", "presa", "costo", "agua", "campo", "trenes", "becas", "hospital"]
    subjects = {" ".join(rng.sample(pool, rng.randint(2, 5))) for _ in range(60)} | {"de la", "y"}
    counts = {s: rng.randint(1, 4) for s in subjects}

    def bag(s):
        return {w for w in s.split() if len(w) >= 4}

    chosen, want = [], {}
    for s in sorted(counts, key=lambda s: (-counts[s], s)):
        near = [r for r in chosen if bag(s) and bag(r) and len(bag(s) & bag(r)) / len(bag(s) | bag(r)) >= 0.5]
        want[s] = near[0] if near else s
        if not near:
            chosen.append(s)
    df = spark.createDataFrame(list(counts.items()), "s string, n int")
    got = {r.asunto: r.canonico for r in similarity.consolidate(df, "s", "n", 0.5).collect()}
    assert got == want


def test_no_chain_through_a_bridge(spark):
    rows = [("a1 agua campo presa", 3), ("agua campo presa trenes", 2), ("presa trenes becas puente", 1)]
    got = similarity.consolidate(spark.createDataFrame(rows, "s string, n int"), "s", "n", 0.5).collect()
    assert len({r.canonico for r in got}) == 2


def test_name_merges(spark):
    rows = [("Periodista Uno", 9), ("Periodista Unno", 1), ("La Periodista Uno", 1), ("Periodista Once", 5), ("Ana", 9), ("Ane", 1)]
    mapped, doubtful = entities.name_merges(spark.createDataFrame(rows, "name string, n int"), "name", "n")
    got = {r.name: r.canonico for r in mapped.collect()}
    assert got["Periodista Unno"] == got["La Periodista Uno"] == "Periodista Uno" and got["Ane"] == "Ane"
    # Names of at most eight letters never merge by slips; two established names stay doubtful.
    assert not doubtful.count()
    near = spark.createDataFrame([("Periodista Uno", 9), ("Periodista Ino", 5)], "name string, n int")
    assert [(r.a, r.b) for r in entities.name_merges(near, "name", "n")[1].collect()] == [("Periodista Uno", "Periodista Ino")]
    manual = spark.createDataFrame([("Periodista Unno", "Otra")], "name string, canonico string")
    fixed = {r.name: r.canonico for r in entities.name_merges(spark.createDataFrame(rows, "name string, n int"), "name", "n", manual)[0].collect()}
    assert fixed["Periodista Unno"] == "Otra"


def test_outlets(spark):
    def split(value):
        df = spark.createDataFrame([(value,)], "m string")
        return df.select(entities.split_outlets(F.col("m"), entities.PLACES, entities.CLAUSES).alias("r")).collect()[0].r

    assert split("Diario Alba, Costa Hoy y Sierra Hoy, de Grupo Sol") == ["Diario Alba", "Costa Hoy", "Sierra Hoy", "Grupo Sol"]
    assert split("Media Uno, Veracruz") == ["Media Uno"]
    assert split("AFP y también Radio Sol") == ["AFP", "Radio Sol"]
    assert split("El Faro / el faro") == ["El Faro"] and split("ab") == ["ab"] and split(None) == [] and split(" ") == []
    votes = spark.createDataFrame([("El imparcial", 22), ("El Imparcial", 21), ("un medio", 3)], "m string, n int")
    assert {r.name: r.canonico for r in entities.outlet_votes(votes, "m", "n").collect()} == {"El imparcial": "El Imparcial", "El Imparcial": "El Imparcial"}


def turns(spark, rows):
    full = [("c", k, kind, text, who) for k, (kind, text, who) in enumerate(rows)]
    return spark.createDataFrame(full, "conferencia_id string, orden int, tipo string, texto string, hablante string")


def test_threads_carry_identity_without_leaks(spark):
    t = turns(spark, [("prensa", "hola", None), ("prensa", "A", None), ("funcionario", "r", "F"), ("anonimo", "x", None), ("prensa", "B", None), ("prensa", "q", None)])
    name = F.when(F.col("texto") == "A", "Ana").when(F.col("texto") == "B", "Beto")
    outlet = F.when(F.col("texto") == "A", "Radio")
    got = sessions.open_threads(t, name.isNotNull(), name, outlet, F.lit("regex")).orderBy("orden").collect()
    assert [r.hilo for r in got] == [-1, 0, 0, 0, 1, 1]
    assert [(r.periodista, r.medio) for r in got[4:]] == [("Beto", None), ("Beto", None)]
    told = sessions.open_threads(t, name.isNotNull(), name, outlet, F.lit("regex")).withColumn("incierta", F.lit(False))
    said = {r.orden: (r.atribucion, r.quien) for r in sessions.attribute(told).collect()}
    assert said == {1: ("declarada", "Ana"), 2: ("declarada", "F"), 3: ("incierta", None), 4: ("declarada", "Beto"), 5: ("propagada", "Beto")}


def test_runs(spark):
    t = turns(spark, [("prensa", "a", None), ("anonimo", "", None), ("prensa", "b", None), ("funcionario", "r", "F"), ("prensa", "c", None)])
    got = {r.orden: (r.tamano, r.incierta) for r in sessions.press_runs(t).collect()}
    assert got == {0: (2, True), 2: (2, True), 4: (1, False)}


def test_exchanges(spark):
    schema = "conferencia_id string, hilo int, orden int, rol string, quien string, texto string, atribucion string, ruido boolean, periodista string"
    rows = [("c", 0, 0, "respuesta", "F", "antes", "declarada", False, "P"), ("c", 0, 1, "pregunta", "P", "¿uno dos?", "declarada", False, "P"),
            ("c", 0, 2, "respuesta", "G", "a b c", "declarada", False, "P"), ("c", 0, 3, "respuesta", "F", "d", "declarada", False, "P"),
            ("c", 0, 4, "pregunta", None, "gracias", "propagada", True, "P"), ("c", 0, 5, "respuesta", "G", "e", "declarada", False, "P"),
            ("c", 0, 6, "pregunta", None, "¿y?", "incierta", False, "P")]
    got = sessions.exchange_words(sessions.exchanges(spark.createDataFrame(rows, schema))).orderBy("orden").collect()
    assert [(r.orden, r.wq, r.wa, r.quien_responde, r.periodista) for r in got] == [(1, 2, 5, ["G", "F"], "P"), (6, 1, 0, [], None)]


def test_documents(spark):
    text = "Título\n\nPREGUNTA: Hola.\n\nDIRECTORA, ANA RUIZ : Sí, https://x.y\n\n—Aplausos—\n\nHTTPS://nada\nSECRETARIO DE SALUD, LUIS SOL (enlace):Va."
    got = documents.turns_of(spark.createDataFrame([("c", text), ("d", None), ("e", "nada")], "k string, t string"), "k", "t").collect()
    assert [(r.orden, r.etiqueta, r.tipo, r.texto, r.apartes) for r in got] == [
        (0, "PREGUNTA", "prensa", "Hola.", []), (1, "DIRECTORA, ANA RUIZ", "funcionario", "Sí, https://x.y\n\nHTTPS://nada", ["Aplausos"]),
        (2, "SECRETARIO DE SALUD, LUIS SOL (enlace)", "funcionario", "Va.", []),
    ]
    video = spark.createDataFrame([("A (INICIA VIDEO) x\ny (FINALIZA VIDEO) B (INICIA AUDIO) z",)], "t string")
    r = video.select(documents.without_videos(F.col("t")).alias("r"), documents.header(F.lit(text)).alias("h")).collect()[0]
    assert (r.r.texto, r.r.videos, r.r.abiertos, r.h) == ("A \n\n B (INICIA AUDIO) z", 1, 1, "Título")
    end = spark.createDataFrame([("Fin.\n —000— ",)], "t string").select(documents.without_end_mark(F.col("t")).alias("r")).collect()[0].r
    assert end.texto.strip() == "Fin." and end.marca
    page = "<html><h1>T</h1><h2>S</h2><section>Lugar | 5 de mayo</section><div class='article-body'><div><p>Uno <em>dos</em>,<br>tres</p></div><p> </p><p>B</p></div><p>pie</p></html>"
    assert documents.page_text(page, "Lugar") == "T\n\nS\n\nLugar | 5 de mayo\n\nUno dos, tres\n\nB"
    assert documents.page_text("<p>x</p>") is None


def test_introductions():
    cases = {
        "Buenos días, Presidenta. Julio Tamarel, de Prensa Norte Group. ¿Qué tal?": ("Julio Tamarel", "Prensa Norte Group"),
        "Soy Elías, de Radio Sol. Pregunto.": ("Elías", "Radio Sol"),
        "Su servidor, Mario Belsara, de ZT Noticias. Gracias.": ("Mario Belsara", "ZT Noticias"),
        "mi nombre es Lorena Pastil y soy del periódico Diario Giro. Hola": ("Lorena Pastil", "periódico Diario Giro"),
        "Emilia Rondera, reportera de Canal 90. Buenas.": ("Emilia Rondera", "Canal 90"),
        "Bruno Salcedera Monte, Torre de Sal. Pregunta.": ("Bruno Salcedera Monte", "Torre de Sal"),
        "Buenos días, Tomás Ladero, de Hora Libre TV. Dos temas.": ("Tomás Ladero", "Hora Libre TV"),
    }
    for said, want in cases.items():
        found = identity.find_introduction(said)
        assert found and found[:2] == want, (said, found)
    for said in ("Se acusa a Paredes Monzón, de encabezar una red.", "En Culiacán, Sinaloa. Hay casos.", "Elena Ruiz, Presidenta de la sala. Bien.", ""):
        assert identity.find_introduction(said) is None, said
    tail = "x" * 400 + ". Muchas gracias. Soy Raúl Mestino, de Escucha y más."
    assert identity.find_introduction(tail)[:2] == ("Raúl Mestino", "Escucha y más")
    said = "Buenos días. Nora Felosa de la Hora Sol. Hola"
    assert identity.find_introduction(said) is None
    assert identity.find_introduction(said, frozenset({"Nora Felosa"}))[:2] == ("Nora Felosa", "Hora Sol")
    assert identity.redact("Hola. Ana Ruiz, de Radio Sol. ¿Cuándo?") == ("Hola. [identificación removida]. ¿Cuándo?", True)
    assert identity.mask_names("Soy Ana Ruiz, de Radio Sol. Oye, Ana", "Ana Ruiz", "Radio Sol") == "Soy [nombre], de [medio]. Oye, [nombre]"


def test_introductions_in_all_places():
    """Where an introduction may stand, what closes it, and what only looks like one."""
    fill = "Le quiero preguntar por el servicio de agua. " * 12
    cases = {
        "Gracias, Presidenta. Dora Escamilla, de Avance.": ("Dora Escamilla", "Avance"),
        fill + "\n\nMuchas gracias.\n\nSoy Gino Asensio, de Informe y más.": ("Gino Asensio", "Informe y más"),
        "Gracias, Presidenta. Reina Aidé Ramos, reportera independiente. Bueno.": ("Reina Aidé Ramos", "reportera independiente"),
        "Soy Jonás Lozano, Mínima FM, de Sierra.": ("Jonás Lozano", "Mínima FM, de Sierra"),
        "Buenos días a todos los presentes. Elda Ferrera, de Noticias del Valle y colaboradora del programa Amanecer, así como de otros": ("Elda Ferrera", "Noticias del Valle"),
        "Presidenta, buenos días. Soy Tea Mora Guillar, corresponsal del Canal de las Rutas, que se transmite en el norte. Presidenta…": ("Tea Mora Guillar", "Canal de las Rutas"),
        "Soy Tea Mora Guillar, corresponsal de Grupo Medianía, al que pertenecen el Canal 44 y el 66.": ("Tea Mora Guillar", "Grupo Medianía"),
        "Hola, Presidenta, buenos días. Soy César Uerta, de la revista Polémica…": ("César Uerta", "revista Polémica"),
        "Presidenta, tras un año de trabajo —perdón, soy Jesenia Peral, de Negocio Hoy—, Presidenta, tras un año…": ("Jesenia Peral", "Negocio Hoy"),
        "Este 16 de abril —soy Gloria Carpo, de Diario Imago— se celebra…": ("Gloria Carpo", "Diario Imago"),
        "Presidenta, en la región de la que vengo " + "pasa algo grave " * 14 + "—soy Susana Carrete, de Radio Academia de Valles. Ahí…": ("Susana Carrete", "Radio Academia de Valles"),
        "Buenos días, Vicente Serrote, de Sin Cortes TV. Presidenta…": ("Vicente Serrote", "Sin Cortes TV"),
        "Muy buenos días, Presidenta. Todas, todos, todes, Inés Arroyuelo, de ABC Valle.": ("Inés Arroyuelo", "ABC Valle"),
        "Buenos días, Presidenta Eliana Valdés, del canal de Uno Oficial.": ("Eliana Valdés", "canal de Uno Oficial"),
        "Perdón, mi nombre es Elsa Lentz, y escribo para La Vida en rosa. Hola.": ("Elsa Lentz", "La Vida en rosa"),
        "Bien, no me presenté, Presidenta. Soy su servidor, Carlos Pozas, reportero de LN Noticias.": ("Carlos Pozas", "LN Noticias"),
        'Presidenta con "A", su servidor Carlos Pozas, reportero de Gran Átomo.': ("Carlos Pozas", "Gran Átomo"),
        "Muchas gracias. Por cierto, soy Gregorio Varas, de Seis Radio. No me presenté.": ("Gregorio Varas", "Seis Radio"),
        "Hola. Olga Ojal Lajas, soy corresponsal del Diario del Puerto.": ("Olga Ojal Lajas", "Diario del Puerto"),
        "Buenos días, Presidenta ―Ramón Floro, del Centinela Avisa―.": ("Ramón Floro", "Centinela Avisa"),
    }
    for said, want in cases.items():
        found = identity.find_introduction(said)
        assert found and found[:2] == want, (said, found)
        assert identity.redact(said)[0].count(identity.MARKER) == 1 and want[0] not in identity.redact(said)[0]
    for said in (
        "Se acusa a Andrés Manso Lope, de encabezar una red.", "palabra " * 60 + "Fulano Mengano, de El Faro.", "Hemos visto una oposición, independiente de lo que diga.",
        "Del gobierno del estado, independiente de lo que pase.", "Sobre Chilpa, Guerrera, quiero preguntar.", "Históricamente Baja Costa, Morada ha ganado ahí.",
        "Canal del Congreso, Elisa Robles. Buenos días.", "Hola. Jonás, de Sitio.", "…a Estados Lejanos, de Puente Analítica, precisamente.", "Preguntar por Israel Vallar, Presidenta.",
        "Se trata de Marina del Pozo, de Baja Costa.", "―Guardia Norte, Marina, Ejército―", "Cuatro Medios… Vera Norte, Carlos Guzmar dijo",
        "pasa algo grave " * 25 + "Fulano Mengano, de El Faro. Y…", "Buenos días, Presidenta. Nora Flores de la revista Contrapeso. Le quería preguntar…",
    ):
        assert identity.find_introduction(said) is None, said
    known = frozenset({"Nora Flores"})
    assert identity.find_introduction("Buenos días, Presidenta. Nora Flores de la revista Contrapeso. Le quería…", known)[:2] == ("Nora Flores", "revista Contrapeso")
    assert identity.find_introduction("Sobre la iniciativa. Ley General de Alimento Sano.", known) is None


def test_introductions_of_known_names_stay_unredacted(spark):
    rows = [("a", "Hola. Nora Flores de la revista Contrapeso. ¿Y?"), ("b", "Hola. Nora Flores, de Contrapeso. ¿Y?"), ("c", None)]
    known = spark.createDataFrame([("Nora Flores",)], "n string")
    got = {r.k: (r.periodista, r.redactado) for r in identity.introductions(spark.createDataFrame(rows, "k string, t string"), ["k"], "t", known).collect()}
    assert got == {"a": ("Nora Flores", rows[0][1]), "b": ("Nora Flores", f"Hola. {identity.MARKER}. ¿Y?"), "c": (None, "")}


def test_manual_rows_open_threads(spark):
    rows = [("prensa", "Mi nombre es Cristián Marte y soy creador.", None), ("funcionario", "Claro.", "F"), ("prensa", "¿Y qué escucha usted?", None),
            ("prensa", "a", None), ("prensa", "b", None), ("funcionario", "r", "F"), ("prensa", "Ana Ruiz, de Sol. " + "x" * 300, None), ("anonimo", "ruido", None)]
    t = turns(spark, rows)
    said = spark.createDataFrame([("c", 3, "Nadie", "N"), ("c", 6, "Ana Ruiz", "Sol")], "conferencia_id string, orden int, periodista string, medio string")
    manual = spark.createDataFrame([("c", 0, "Cristián Marte", None), ("c", 1, "Otro", None), ("c", 9, "Otro", None)], said.schema)
    got = {r.orden: (r.hilo, r.quien, r.medio, r.metodo, r.atribucion) for r in sessions.build_threads(t, said, manual).collect()}
    assert got == {
        0: (0, "Cristián Marte", None, "manual", "declarada"), 1: (0, "F", None, "manual", "declarada"), 2: (0, None, None, "manual", "incierta"),
        3: (0, None, None, "manual", "incierta"), 4: (0, None, None, "manual", "incierta"), 5: (0, "F", None, "manual", "declarada"),
        6: (1, "Ana Ruiz", "Sol", "regex", "declarada"), 7: (1, None, "Sol", "regex", "incierta"),
    }
    assert min(r.orden for r in sessions.build_threads(t, said).collect()) == 6
    assert {r.orden for r in sessions.unused_manual(t, manual).collect()} == {1, 9}
    nested = sessions.nested_threads(sessions.build_threads(t, said, manual)).orderBy("hilo").collect()
    assert [(r.hilo, len(r.turnos), r.metodo_identificacion) for r in nested] == [(0, 6, "manual"), (1, 2, "regex")]


def test_masked_rows(spark):
    df = spark.createDataFrame([("Soy Ana Ruiz, de Sol.", "Ana Ruiz", "Sol"), (None, "A", "B"), ("nada", None, None)], "t string, n string, m string")
    assert [r.texto_cubierto for r in identity.masked(df, "t", "n", "m").collect()] == ["Soy [nombre], de [medio].", None, "nada"]
    long = spark.createDataFrame([("dijo Zapatero", " ".join("abcdefghijk") + " Zapatero", "M")], "t string, n string, m string")
    assert long.select(identity.leak(F.col("t"), F.col("n"), F.col("m"))).collect()[0][0] == "zapatero"


def test_ranking_over_parts_equals_one_sort(spark):
    rng = random.Random(1)
    rows = [(f"n{k}", rng.randint(1, 30)) for k in range(500)]
    df = spark.createDataFrame(rows, "name string, n int").repartition(7)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r.name: r for r in aggregates.concentration(df, "n", "name").collect()}
    total, so_far = sum(n for _, n in rows), 0
    for place, (name, n) in enumerate(want, 1):
        so_far += n
        assert (got[name].rango, got[name].cuota_acumulada, got[name].en_mitad) == (place, round(so_far / total, 6), (so_far - n) * 2 < total)
    assert {r.name: r.rango for r in aggregates.ranking(df, "n", "name").collect()} == {name: k for k, (name, _) in enumerate(want, 1)}
    codes = {r.name: r.c for r in aggregates.dictionary(df, "name", "c").collect()}
    assert codes == {name: k for k, name in enumerate(sorted(n for n, _ in rows))}
    assert aggregates.ranking(df.where("false"), "n", "name").count() == aggregates.concentration(df.where("false"), "n", "name").count() == 0
    lots = [r.lote for r in aggregates.lots(df, ["name"], 3, "s").collect()]
    assert sorted(lots.count(k) for k in (1, 2, 3)) == [166, 167, 167]


def test_stratified_sample_of_a_large_stratum(spark):
    df = spark.range(2000).selectExpr("id", "case when id < 3 then 'b' else 'a' end as s")
    few = aggregates.stratified_sample(df, ["id"], "s", 20, "1").collect()
    assert sorted(r.s for r in few) == ["a"] * 10 + ["b"] * 3
    assert {r.id for r in few} == {r.id for r in aggregates.stratified_sample(df, ["id"], "s", 20, "1", salts=1).collect()}


def test_attachments_keep_all_exchanges(spark):
    e = spark.createDataFrame([("c", 1), ("c", 2)], "conferencia_id string, orden int")
    a = spark.createDataFrame([("c", 1, 1, "x"), ("c", 1, 2, "y"), ("c", 9, 1, "z")], "conferencia_id string, orden int, seq int, tema string")
    got = sessions.with_attachments(e, (a, "seq", ["tema"]), (a.where("false"), "seq", ["tema"])).collect()
    assert sorted((r.orden, r[2], r[3]) for r in got) == [(1, "y", None), (2, None, None)]


def test_bridge_and_outlets(spark):
    b = spark.createDataFrame([(1, ["a"], True), (2, ["a", "b"], False), (3, ["c"], True), (4, ["d", "b"], True)], "id int, k array<string>, p boolean")
    assert {r.id for r in entities.pending_bridge(b, "id", "k", F.col("p")).collect()} == {3}
    t = spark.createDataFrame([("c", 1, ["El Sol", "sol", "nadie"])], "c string, h int, m array<string>")
    mapped = spark.createDataFrame([("El Sol", "El Sol"), ("sol", "El Sol")], "name string, canonico string")
    assert [tuple(r) for r in entities.with_outlets(t, ["c", "h"], F.col("m"), mapped).collect()] == [("c", 1, ["El Sol"])]


def test_leak_check(spark):
    df = spark.createDataFrame([("la nota de Ruíz", "Ana Ruiz", "Radio Sol"), ("nada aquí", "Ana Ruiz", "Radio Sol")], "t string, n string, m string")
    assert [r[0] for r in df.select(identity.leak(F.col("t"), F.col("n"), F.col("m"))).collect()] == ["ruiz", None]


def test_findings(spark):
    df = spark.createDataFrame([("c", "Se está viendo el caso. Lo estamos revisando y se está revisando.\nVamos a revisar. Estudiantes que están estudiando.")], "k string, t string")
    got = [(r.verbo, r.forma, r.sujeto) for r in mining.findings(df, ["k"], "t").orderBy("posicion").collect()]
    assert got == [("ver", "en_curso", "impersonal"), ("revisar", "en_curso", "nosotros"), ("revisar", "compromiso", "")]
    assert mining.best_form(mining.findings(df, ["k"], "t"), ["k"]).collect()[0].forma == "compromiso"


def test_lineage(spark):
    items = spark.createDataFrame([("c-h1-t5",), ("c-h1-t7",), ("c-h2-t9",), ("c-h2-t9",)], "id string")
    done = spark.createDataFrame([("c-h0-t5", "x", 1), ("c-h1-t7", "y", 2), ("z-h0-t1", "w", 3), ("c-h1-t7", "v", 4)], "id string, l string, ts int")
    assert [r.id for r in lineage.pending(items, done, stable=True).collect()] == ["c-h2-t9"]
    assert {r.id: (r.estado, r.id_actual) for r in lineage.remap(done, items).collect()} == {
        "c-h0-t5": ("recuperado", "c-h1-t5"), "c-h1-t7": ("intacto", "c-h1-t7"), "z-h0-t1": ("perdido", "z-h0-t1")}
    assert {(r.id, r.l) for r in lineage.rebuild(done, items).collect()} == {("c-h1-t5", "x"), ("c-h1-t7", "v")}
    rejected = spark.createDataFrame([("a", "error: red"), ("c-h1-t7", "error: red"), ("b", "corto")], "id string, razon string")
    assert [r.id for r in lineage.retryable(rejected, done, "^error").collect()] == ["a"]


def test_vote(spark):
    rows = [("q", "a"), ("q", "a"), ("q", "b"), ("r", "a"), ("r", "b"), ("s", "a"), ("s", None)]
    got = {r.i: (r.votos, r.consenso, r.unanime) for r in aggregates.vote(spark.createDataFrame(rows, "i string, l string"), "i", "l").collect()}
    assert got == {"q": (3, "a", False), "r": (2, None, False), "s": (1, "a", True)}


def test_linkage():
    merges = similarity.average_linkage(["a", "b", "c"], {("a", "b"): 0.2, ("a", "c"): 0.9, ("b", "c"): 0.7})
    assert merges[0][2] == 0.2 and round(merges[1][2], 6) == 0.8


def test_long_lines_and_bad_notes(spark):
    text = "PREGUNTA: " + "palabra (nota) " * 20_000 + "\n" + "X" * 100_000 + "\nDIRECTORA, ANA (en línea, desde Sur): Sí.\n(" * 3 + "FIN: x"
    got = documents.turns_of(spark.createDataFrame([("c", text), ("d", "HTTPS://x.y\nA: no\nÁREA 51: sí")], "k string, t string"), "k", "t").collect()
    assert [(r.k, r.etiqueta) for r in got] == [("c", "PREGUNTA"), *[("c", "DIRECTORA, ANA (en línea, desde Sur)")] * 3, ("d", "ÁREA 51")]
    note = spark.createDataFrame([("a (INICIA VIDEO) b (Se proyecta) c",), ("(FINALIZA AUDIO) a (COMIENZA AUDIO) x (EMPIEZA VIDEO) y (TERMINA AUDIO) z",), (None,)], "t string")
    assert [(r.r.texto, r.r.videos, r.r.abiertos) for r in note.where("t is not null").select(documents.without_videos(F.col("t")).alias("r")).collect()] == [
        ("a (INICIA VIDEO) b (Se proyecta) c", 0, 1), ("(FINALIZA AUDIO) a \n\n z", 1, 0)]
