import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hemerion.operators import classify, layout, lineage, sessions
from hemerion.sources import crawl, readers, writers
from hemerion.streaming import turns as streams


def test_line_files(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1, "b": "ñ"}\n\n{"a": 2}\n{"a": 3, "b"', encoding="utf-8")
    rows, torn = readers.read_torn_jsonl(spark, str(path), "a int, b string")
    assert sorted((r.a, r.b) for r in rows.collect()) == [(1, "ñ"), (2, None)] and torn == 1
    path.write_text('{"a": 1}\n{"a"\n{"a": 3}\n')
    with pytest.raises(ValueError, match="middle"):
        readers.read_torn_jsonl(spark, str(path), "a int, b string")
    df = spark.createDataFrame([(1, "ñ"), (2, None)], "a int, b string")
    assert writers.write_jsonl(df, str(tmp_path / "out")) == 2
    assert sorted(r.a for r in readers.read_jsonl(spark, str(tmp_path / "out"), "a int, b string").collect()) == [1, 2]
    with pytest.raises(Exception):
        writers.write_once(df, str(tmp_path / "out"))


def test_tables(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("# nota\n\nvariante,canonico\n# otra\nA,B\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_commented_csv(spark, str(path), ["variante", "canonico"]).collect()] == [("A", "B")]
    with pytest.raises(ValueError, match="falta|missing"):
        readers.read_commented_csv(spark, str(path), ["otra"])
    (tmp_path / "t.json").write_text(json.dumps({"categorias": [{"clave": "a", "nombre": "A", "definicion": "x"}]}))
    assert readers.read_taxonomy(spark, str(tmp_path / "t.json")).collect()[0].clave == "a"
    df = spark.createDataFrame([("a", "b|c")], "x string, y string")
    assert writers.write_map(df, "x", "y", str(tmp_path / "m.json")) == 1
    assert [tuple(r) for r in readers.read_map(spark, str(tmp_path / "m.json")).collect()] == [("a", "b|c")]
    assert writers.write_csv_bom(df, str(tmp_path / "b.csv")) == 1
    assert (tmp_path / "b.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    assert "b\\|c" in writers.markdown_report(df, "T", ["x", "y"])
    assert writers.write_version(df, str(tmp_path / "v")) != writers.write_version(df, str(tmp_path / "v"))
    (tmp_path / "2025-01-02.html").write_bytes(b"<p>\xff</p>")
    assert readers.read_pages(spark, str(tmp_path / "*.html")).collect()[0].conferencia_id == "2025-01-02"


def test_labels_follow_the_protocol(spark):
    items = spark.createDataFrame([("1", "el puente de la presa"), ("2", "corto"), ("3", None), ("4", "nada que decir hoy"), ("5", "un texto raro de veras")], "id string, t string")

    def ask(texts, turn):
        if any("decir" in t for t in texts):
            raise RuntimeError("caído")
        return ["obra" if "puente" in t else "fuera" for t in texts]

    got = {(r.id, r.pasada): (r.etiqueta, r.razon) for r in classify.label_texts(items.coalesce(1), "id", "t", ask, ["obra"], batch=1, tries=2, pause=0, passes=2).collect()}
    assert got[("1", 0)] == got[("1", 1)] == ("obra", None)
    assert got[("2", 0)][1] == got[("3", 0)][1] == "texto demasiado corto"
    assert got[("4", 0)] == (None, "error: caído") and got[("5", 1)] == (None, "valor fuera de la lista: fuera")
    df = spark.createDataFrame([("q", "c"), ("q", None)], "q string, c string")
    joined = df.select(classify.with_context(F.col("q"), F.col("c")).alias("t"))
    assert [r[0] for r in joined.select(classify.question_only(F.col("t"))).collect()] == ["q", "q"]


def test_resumable_batches(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("1", "a"), ("2", "bb")], "id string, t string").write.parquet(source)

    def work(df):
        return df.withColumn("razon", F.when(F.length("t") > 1, "largo"))

    for extra in (None, [("1", "a"), ("3", "c")]):
        if extra:
            spark.createDataFrame(extra, "id string, t string").write.mode("append").parquet(source)
        streams.resumable(spark, source, "id string, t string", work, folder).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/hechos").collect()) == ["1", "3"]
    assert [r.id for r in spark.read.parquet(f"{folder}/rechazos").collect()] == ["2"]
    assert lineage.split_rejects(spark.createDataFrame([(1,), (2,)], "x int"), F.when(F.col("x") == 1, "no"))[0].count() == 1


def test_stream_threads_equal_the_batch(spark, tmp_path):
    rows = [("c", k, k in (1, 3), f"N{k}" if k in (1, 3) else None, None) for k in range(6)] + [("d", 0, True, "M", "R")]
    schema = "conferencia_id string, orden int, abre boolean, nombre string, declarado string"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    stream = streams.stream_threads(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    found = stream.writeStream.format("memory").queryName("hilos_vivos").outputMode("append").trigger(availableNow=True).start()
    found.awaitTermination()
    got = sorted(map(tuple, spark.table("hilos_vivos").select("conferencia_id", "orden", "hilo", "periodista").collect()), key=str)
    batch = sessions.open_threads(df.withColumn("tipo", F.lit("prensa")), F.col("abre"), F.col("nombre"), F.col("declarado"), F.lit("x"))
    assert got == sorted(map(tuple, batch.select("conferencia_id", "orden", "hilo", "periodista").collect()), key=str)


def test_windows(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime(["2025-01-01 00:01", "2025-01-01 00:02", "2025-01-01 00:07"]), "k": ["a", "a", "b"], "v": [1.0, 2.0, 3.0]})
    df = spark.createDataFrame(rows).withColumn("ts", F.col("ts").cast("timestamp"))
    got = streams.windowed_counts(df, "ts", "k", "v").orderBy("desde").collect()
    assert [(r.k, r.n, r.suma) for r in got] == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_long_texts_are_labelled_whole(spark):
    items = spark.createDataFrame([("1", "nada " * 300 + "puente")], "id string, t string")
    ask = lambda texts, turn: ["obra" if "puente" in t else None for t in texts]
    assert [r.etiqueta for r in classify.label_texts(items, "id", "t", ask, ["obra"]).collect()] == ["obra"]
    assert [r.etiqueta for r in classify.label_texts(items, "id", "t", ask, ["obra"], most=900).collect()] == [None]


def test_line_files_in_many_parts(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("".join(f'{{"a": {k}}}\n' for k in range(2000)) + '{"a"')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows, torn = readers.read_torn_jsonl(spark, str(path), "a int")
        assert rows.rdd.getNumPartitions() > 2 and torn == 1 and [r.a for r in rows.orderBy("seq").collect()] == list(range(2000))
        path.write_text('{"a"\n' + "".join(f'{{"a": {k}}}\n' for k in range(2000)))
        with pytest.raises(ValueError, match="middle"):
            readers.read_torn_jsonl(spark, str(path), "a int")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_reports_hold_every_hit(spark, tmp_path):
    df = spark.range(700).selectExpr("id", "concat('v', id) as v")
    assert writers.markdown_report(df, "T", ["id", "v"]).count("\n") == 704
    with pytest.raises(ValueError):
        writers.markdown_report(df, "T", ["id", "v"], most=500)
    assert writers.write_csv_bom(df, str(tmp_path / "b.csv")) == 700 and (tmp_path / "b.csv").read_text(encoding="utf-8-sig").count("\n") == 701
    assert readers.read_csv(spark, str(tmp_path / "b.csv")).count() == 700
    assert writers.write_map(df, "id", "v", str(tmp_path / "m.json")) == 700 and json.loads((tmp_path / "m.json").read_text())["5"] == "v5"
    assert writers.write_map(df.where("false"), "id", "v", str(tmp_path / "e.json")) == 0 and json.loads((tmp_path / "e.json").read_text()) == {}
    one = writers.write_version(df, str(tmp_path / "v"))
    writers.point_to(spark, str(tmp_path / "v"), one)
    writers.point_to(spark, str(tmp_path / "v"), writers.write_version(df.limit(3), str(tmp_path / "v")))
    assert writers.current_version(spark, str(tmp_path / "v")).count() == 3 and spark.read.parquet(one).count() == 700


def test_rounds_remember_and_resume(spark, tmp_path):
    items = spark.createDataFrame([(str(k), f"el puente número {k} de la presa") for k in range(40)], "id string, t string")
    seen = []

    def ask(vocabulary):
        seen.append(list(vocabulary))
        return lambda texts, turn: ["obra" for _ in texts]

    folder = str(tmp_path / "ledger")
    done = classify.label_batches(items, "id", "t", ask, ["obra"], folder, rounds=3, pause=0)
    assert done.count() == 40 and seen == [[], ["obra"], ["obra"]]
    assert classify.label_batches(items, "id", "t", ask, ["obra"], folder, rounds=3, pause=0).count() == 40
    with pytest.raises(ValueError):
        classify.require_gold(done, "razon", 1)
    classify.require_gold(done, "etiqueta", 40)
    rows, meter = classify.metered(done)
    rows.write.format("noop").mode("overwrite").save()
    assert meter.get["filas"] == 40 and meter.get["rechazos"] == 0
    with pytest.raises(ValueError):
        classify.examples_block(done, "etiqueta", "fragmento", most=10)


def test_crawls_stop_and_resume(spark, tmp_path):
    asked = []

    def fetch(page):
        asked.append(page)
        if page == 2 and asked.count(2) == 1:
            raise RuntimeError("caído")
        return "<a>" if page < 4 else ""

    folder = str(tmp_path / "crawl")
    first = crawl.crawl(spark, fetch, folder, lambda h: not h, pause=0)
    assert asked == [1, 2, 3, 4, 5] and {r.pagina: r.razon for r in first.collect()} == {1: None, 2: "caído", 3: None, 4: None, 5: None}
    crawl.crawl(spark, fetch, folder, lambda h: not h, pause=0, refresh=1)
    assert asked[5:] == [1, 2, 6, 7]


def test_downloads_fall_back(spark):
    page = "<div class='article-body'>" + "x" * 30_000

    def fetch(url):
        if url == "down":
            raise RuntimeError("caído")
        return page if url == "good" else "corta"

    rows = [("a", "down", "good"), ("b", "good", None), ("c", "short", "down"), ("d", None, None)]
    got = {r.k: (r.fuente, r.bytes, r.razon) for r in crawl.download(spark.createDataFrame(rows, "k string, u string, v string"), "k", [("uno", "u"), ("dos", "v")], fetch, pause=0).collect()}
    assert got == {"a": ("dos", len(page), None), "b": ("uno", len(page), None), "c": ("dos", None, "error: caído"), "d": (None, None, "sin dirección")}


def test_sheets_carry_answers(spark, tmp_path):
    sample = spark.createDataFrame([("c1", "texto"), ("c2", "otro")], "codigo string, pregunta string")
    allowed = {"postura": ["crítica", "neutral"]}
    assert writers.coding_sheet(sample, "codigo", ["pregunta"], allowed, str(tmp_path / "s.csv"), spark.createDataFrame([("c2", "neutral"), ("c9", "x")], "codigo string, postura string")) == 2
    sheet = readers.read_commented_csv(spark, str(tmp_path / "s.csv"), ["codigo"])
    good, bad = writers.read_answers(sheet, allowed)
    assert {(r.codigo, r.postura) for r in good.collect()} == {("c1", None), ("c2", "neutral")} and bad.count() == 0
    assert writers.read_answers(spark.createDataFrame([("c1", "mal")], "codigo string, postura string"), allowed)[1].count() == 1
    assert writers.fill_page("<p><!--a--></p>", {"a": "x"}) == "<p>x</p>"
    with pytest.raises(ValueError):
        writers.fill_page("<p></p>", {"a": "x"})


def test_layouts():
    boxes = layout.treemap([6, 6, 4, 3, 2, 2, 1], 6, 4)
    assert [round(b.width * b.height, 6) for b in boxes] == [6, 6, 4, 3, 2, 2, 1] and max(max(b.width / b.height, b.height / b.width) for b in boxes) < 3.1
    assert all(b.x >= -1e-9 and b.x + b.width <= 6 + 1e-9 and b.y + b.height <= 4 + 1e-9 for b in boxes) and layout.treemap([]) == []
    put = layout.spread_labels([5, 5.1, 0, 9.9], 1, 0, 10)
    assert put == [5, 6, 0, 9.9] and layout.spread_labels([1, 1, 1], 9, 0, 10) == [0, 5, 10]
    assert layout.round_axis(0.3, 9.7) == [0, 2, 4, 6, 8, 10] and layout.round_axis(1, 1) == [1]
