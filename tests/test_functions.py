from pyspark.sql import functions as F

from hemerion.functions import dates, rules, text
from hemerion.operators import search


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).collect()[0].r


def test_folding(spark):
    assert one(spark, "ÁÉÍÓÚ Ñandú Çà", text.plain) == "aeiou nandu ca"
    assert one(spark, None, text.plain) == ""
    assert one(spark, "¡Hola,  Señor! (2)", text.plain_words) == "hola senor 2"
    assert one(spark, "a b c", text.normalize_spaces) == "a b c"


def test_keys_and_words(spark):
    assert one(spark, "La Revista El Faro", text.comparison_key) == "faro"
    assert one(spark, "revista", text.comparison_key) == "revista"
    assert one(spark, "  uno  dos\ntres ", text.word_count) == 3
    assert one(spark, None, text.word_count) == 0
    assert one(spark, "uno dos tres", lambda c: text.excerpt(c, 9)) == "uno dos…"
    assert one(spark, "el Faro de Luz", lambda c: text.capitalised_words(c, ["de"])) == 2
    assert one(spark, "ñandú azul", text.upper_first) == "Ñandú azul"
    assert one(spark, "Uno. ¿Dos? Tres…\nCuatro", text.sentences) == ["Uno.", "¿Dos?", "Tres…", "Cuatro"]
    assert one(spark, "2025-01-01-h3-t14", text.stable_id) == "2025-01-01-t14"
    assert one(spark, "otro", text.stable_id) == "otro"


def test_noise(spark):
    for said in (None, "", "Gracias.", "Buenos días, Presidenta. Gracias.", "(Inaudible)", "Sí.", "De acuerdo. Adelante."):
        assert one(spark, said, rules.is_noise), said
    for said in ("¿No se le censura?", "Gracias por venir.", "Bien hecho"):
        assert not one(spark, said, rules.is_noise), said


def test_labels(spark):
    def parts(label):
        return tuple(one(spark, label, rules.label_parts))

    assert parts("PREGUNTA") == parts("INTERLOCUTORA") == parts("PREGUNTA (VIDEOLLAMADA)") == ("prensa", None, None)
    assert parts("INTERVENCIÓN HOMBRE (ENLACE)") == parts("ASISTENTES") == parts("VOZ MUJER") == ("anonimo", None, None)
    assert parts("DIRECTOR GENERAL, ANA RUIZ") == ("funcionario", "DIRECTOR GENERAL", "ANA RUIZ")
    assert parts("ANA RUIZ, DIRECTORA GENERAL") == ("funcionario", "DIRECTORA GENERAL", "ANA RUIZ")
    assert parts("ANA RUIZ") == ("funcionario", None, "ANA RUIZ")


def test_verb_forms(spark):
    cases = {
        "Ya lo revisamos.": "hecho", "Hemos revisado el caso": "hecho", "Lo estamos revisando": "en_curso", "Que lo revise el área": "encargo",
        "Hay que revisar": "necesidad", "Vamos a revisar": "compromiso", "Lo revisamos mañana": "compromiso", "La revisión terminó": "otra",
    }
    for said, form in cases.items():
        assert one(spark, said, rules.verb_form) == form, said
    assert one(spark, "se está", rules.acting_subject) == "impersonal"
    assert one(spark, "lo estamos", rules.acting_subject) == "nosotros"
    assert one(spark, "están", rules.acting_subject) == "tercero"
    assert one(spark, None, rules.acting_subject) == ""
    assert one(spark, "Pregunta incompleta", rules.is_no_subject)
    assert one(spark, "x", lambda c: rules.bucket(c, {"b": ["x"]})) == "b"
    assert one(spark, "z", lambda c: rules.bucket(c, {"b": ["x"]})) is None


def test_dates(spark):
    def slug(value):
        found = one(spark, value, dates.date_of_slug)
        return None if found is None else str(found)

    assert slug("version-del-5-de-agosto-de-2026") == "2026-08-05"
    assert slug("x-de-14-de-setiembre-2025?y=1") == "2025-09-14"
    for bad in ("x-del-31-de-febrero-de-2025", "x-del-3-de-brumario-de-2025", "x-del-3-de-mayo-de-20", "", None):
        assert slug(bad) is None, bad
    assert dates.weekdays(spark, "2026-08-07", "2026-08-10").count() == 2


def test_phrases(spark):
    import pytest

    def hit(said, **options):
        return one(spark, said, lambda c: search.matches(c, **options))

    assert hit("Los organismos\nautónomos", any_of=["organismos autonomos"])
    assert not hit("amenazas", any_of=["amenaza"])
    assert hit("amenazas", any_of=["amenaz*"]) and hit("descontento", any_of=["*contento"])
    assert hit("arancel y militar", all_of=["arancel*|cuota", "militar"]) and not hit("arancel", all_of=["arancel", "militar"])
    assert hit("costó 5 (cinco)", any_of=["(cinco)"]) and hit("lo que sea")
    with pytest.raises(ValueError):
        search.phrase_pattern(" * | ")


def test_verb_forms_of_whole_sentences(spark):
    cases = {
        "Con gusto lo revisamos.": "compromiso", "Se está revisando con el área.": "en_curso", "Ya lo revisamos y no hay nada.": "hecho",
        "Que lo revise la comisión.": "encargo", "Pues hay que revisarlo.": "necesidad", "Lo vamos a empezar a revisar.": "compromiso",
        "Entonces, revisamos este caso.": "compromiso", "entonces, revisamos el caso": "compromiso", "con gusto revisamos la obra": "compromiso",
        "Revisamos el expediente mañana.": "compromiso", "que se revisara el contrato": "encargo", "Nosotros hemos estado revisando las cifras.": "en_curso",
        "Y a la otra oficina, para que pueda revisarlo.": "encargo", "Se instruye a la agencia revisar los permisos.": "encargo",
        "Tendría que revisarse quién lo promovió.": "necesidad", "Le pedimos a la fiscal que pueda revisarlo.": "encargo",
        "Lo que pedimos es que la oficina del estado revise qué ocurrió.": "encargo", "Revisamos todos los días la obra.": "otra",
        "Si revisan que hay suficiente información, dictar una orden.": "otra",
    }
    for said, form in cases.items():
        assert one(spark, said, rules.verb_form) == form, said


def test_subjects_that_are_none(spark):
    for said in ("Comentario de periodista", "no_aplica", "Información insuficiente", "Saludo inicial"):
        assert one(spark, said, rules.is_no_subject), said
    assert not one(spark, "obra del puente", rules.is_no_subject) and not one(spark, None, rules.is_no_subject)
    df = spark.createDataFrame([("a", "b"), ("a", None), ("Saludo", "b"), ("", None), (None, None)], "s string, c string")
    assert [r[0] for r in df.select(rules.legible_subject(F.col("s"), F.col("c"))).collect()] == ["b", "a", None, None, None]
    assert one(spark, "DIRECTORA, ANA MÁR", lambda c: rules.is_named(c, ["Mar"])) and not one(spark, None, lambda c: rules.is_named(c, ["Mar"]))


def test_display_forms(spark):
    assert one(spark, 1234, lambda c: text.plural(c, "hilo", "hilos"), "int") == "1,234 hilos" and one(spark, 1, lambda c: text.plural(c, "hilo", "hilos"), "int") == "1 hilo"
    assert one(spark, None, text.whole_number, "int") == "—"
    assert one(spark, "2025-03-05", lambda c: dates.long_date(c.cast("date"))) == "5 de marzo de 2025"
    assert one(spark, "2025-03-05", lambda c: dates.month_label(c.cast("date"))) == "mar 25"
    page = spark.createDataFrame([("Conferencia del 5 de marzo de 2025", "Lugar | 6 de marzo de 2025"), ("Nada", "Lugar | 6 de marzo de 2025"), ("Nada", "Nada")], "h string, p string")
    assert [str(r[0]) for r in page.select(dates.date_in_page(F.col("h"), F.col("p"))).collect()] == ["2025-03-05", "2025-03-06", "None"]
