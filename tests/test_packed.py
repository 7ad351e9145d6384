from pyspark.sql import functions as F

from hemerion.operators.packed import compound_heads, packed_values, split_packed

HEADS = ["agua, tierra y", "campo y"]


def split(spark, text, heads=HEADS):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(packed_values(F.col("t"), heads).alias("v")).collect()[0].v


def test_signs_and_conjunctions(spark):
    for sign in (", ", ";", " / ", "/", "|", "\n", "\t", " · ", " & ", " + ", " // ", " ;; ", " - ", " – ", " y ", ", y ", " así como ", ", además de "):
        assert split(spark, f"Radio Uno{sign}Diario Dos") == ["Radio Uno", "Diario Dos"], sign


def test_literals_are_not_cut(spark):
    assert split(spark, '"A, B y C", D') == ["A, B y C", "D"]
    assert split(spark, "«A; B» y «C / D»") == ["A; B", "C / D"]
    assert split(spark, "'Uno, dos'|“Tres (web)”") == ["Uno, dos", "Tres (web)"]
    assert split(spark, '["Uno", "Dos, tres (web)"]') == ["Uno", "Dos, tres (web)"]


def test_names_with_separators(spark):
    assert split(spark, "Agua, Tierra y Sol, Campo y Mar y Radio Uno") == ["Agua, Tierra y Sol", "Campo y Mar", "Radio Uno"]
    assert split(spark, "Caampo y Mar / Agua,  Tiera  y  Sol") == ["Caampo y Mar", "Agua,  Tiera  y  Sol"]
    assert split(spark, "Canal 7/24/Radio Uno") == ["Canal 7/24", "Radio Uno"]
    assert split(spark, "S/D | Radio Uno") == ["S/D", "Radio Uno"]


def test_remarks_stay(spark):
    assert split(spark, "Radio Uno, de Lugar; Radio Dos, desde Otro") == ["Radio Uno, de Lugar", "Radio Dos, desde Otro"]
    assert split(spark, "Radio Uno (sala, piso) y Dos") == ["Radio Uno (sala, piso)", "Dos"]


def test_defined_results(spark):
    for text in (None, "", "   ", " , ; ", " "):
        assert split(spark, text) == [], repr(text)
    assert split(spark, 'Radio "Uno') == ['Radio "Uno']
    assert split(spark, "L'Uno d'Or; Dos") == ["L'Uno d'Or", "Dos"]
    assert split(spark, "A;;B; ;A") == ["A", "B", "A"]
    long = "; ".join(f"Radio {k}" for k in range(20_000))
    assert len(split(spark, long)) == 20_000


def test_rows_and_clashing_columns(spark):
    rows = [("a", 1, "x; w", 9), ("a", 1, "x; w", 8), ("a", 2, None, 7), ("b", 1, "z", 6)]
    df = spark.createDataFrame(rows, "c string, h int, m string, posicion int")
    got = split_packed(df, "m", ["c", "h"]).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 1, "x"), ("a", 1, 2, "w"), ("b", 1, 1, "z")]
    assert split_packed(df, "m", ["c", "h"], least=2).count() == 2
    assert split_packed(df.where("false"), "m", ["c", "h"]).count() == 0


def test_heads_come_from_the_list(spark):
    df = spark.createDataFrame([("Agua, Tierra y Sol",), ("Campo y Mar",), ("Campo y Río",), ("Radio Uno",), (None,)], "n string")
    assert compound_heads(df, "n") == ["agua, tierra y", "campo y"]
