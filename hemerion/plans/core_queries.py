"""Registered queries of the core, each over its whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hemerion.functions import dates, rules, text
from hemerion.operators import aggregates as agg
from hemerion.operators import classify, documents, entities, identity, lineage, mining, search, sessions, similarity
from hemerion.operators.packed import compound_heads, split_packed
from hemerion.plans.registry import ORACLES, QUERIES, query
from hemerion.session import table

__all__ = ["ORACLES", "QUERIES"]

#: Shared parts of the SQL: tables without re-sent rows, and threads as rows.
_T = "t AS (SELECT * FROM turnos QUALIFY row_number() OVER (PARTITION BY conferencia_id, orden ORDER BY recibido_en) = 1)"
_H = "h AS (SELECT * FROM hilos QUALIFY row_number() OVER (PARTITION BY conferencia_id, hilo ORDER BY recibido_en) = 1)"
_U = "u AS (SELECT conferencia_id, hilo, periodista, medio, periodista_canonico, unnest(turnos) AS x FROM h)"
_R = (
    "r AS (SELECT conferencia_id, hilo, periodista, medio, periodista_canonico, x.rol AS rol, x.quien AS quien, x.texto AS texto, "
    "x.atribucion AS atribucion, x.ruido AS ruido, x.orden AS orden FROM u)"
)
_ROWS = f"{_H}, {_U}, {_R}"
_E = (
    "v AS (SELECT *, sum(CASE WHEN rol = 'pregunta' THEN 1 ELSE 0 END) OVER (PARTITION BY conferencia_id, hilo ORDER BY orden "
    "ROWS UNBOUNDED PRECEDING) AS intercambio FROM r WHERE NOT coalesce(ruido, false))"
)
_WC = "len(list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda w: w <> ''))"
_EX = (
    "e AS (SELECT conferencia_id, hilo, cast(intercambio AS bigint) AS intercambio, "
    "CASE WHEN max(CASE WHEN rol = 'pregunta' THEN atribucion END) = 'incierta' THEN NULL ELSE min(periodista) END AS periodista, "
    "max(CASE WHEN rol = 'pregunta' THEN texto END) AS pregunta, min(orden) AS orden, "
    f"cast(max(CASE WHEN rol = 'pregunta' THEN {_WC.format('texto')} END) AS bigint) AS wq, "
    f"cast(sum(CASE WHEN rol <> 'pregunta' THEN {_WC.format('texto')} ELSE 0 END) AS bigint) AS wa "
    "FROM v WHERE intercambio > 0 GROUP BY conferencia_id, hilo, intercambio)"
)
_C = "c AS (SELECT * FROM clasificaciones QUALIFY row_number() OVER (PARTITION BY id_pregunta ORDER BY recibido_en DESC, coalesce(asunto, '')) = 1)"
_FOLD = "strip_accents(lower(coalesce({0}, '')))"
_FLAT = "trim(regexp_replace(" + _FOLD + ", '[^a-z0-9]+', ' ', 'g'))"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return sessions.distinct_turns(table(spark, d, "turnos"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return sessions.thread_turns(table(spark, d, "hilos"))


def _exchanges(spark: SparkSession, d: str) -> DataFrame:
    return sessions.exchange_words(sessions.exchanges(_rows(spark, d)))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clasificaciones").withColumn("__s", F.coalesce("asunto", F.lit("")))
    w = Window.partitionBy("id_pregunta").orderBy(F.col("recibido_en").desc(), "__s")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__s")


def _threads(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "hilos").dropDuplicates(["conferencia_id", "hilo"])
    return once.withColumn("mes", F.substring("conferencia_id", 1, 7))


# ---- packed fields -------------------------------------------------------------------


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of every thread whose outlet field holds two or more."""
    heads = compound_heads(table(spark, d, "catalogo_medios"), "nombre")
    return split_packed(table(spark, d, "hilos"), "medio", ["conferencia_id", "hilo"], heads, least=2)


# ---- exchanges and threads -------------------------------------------------------------


@query(f"""WITH {_ROWS}, {_E}, {_EX}
SELECT periodista, count(*) AS n, count(DISTINCT conferencia_id) AS conferencias, cast(sum(wq) AS bigint) AS wq,
  cast(sum(wa) AS bigint) AS wa, round(avg(wq), 4) AS media_q, round(avg(wa), 4) AS media_a, round(sum(wa) / nullif(sum(wq), 0), 4) AS razon
FROM e WHERE periodista IS NOT NULL GROUP BY periodista""")
def exchange_words(spark, d):
    """Words asked and answered by reporter."""
    e = _exchanges(spark, d).where("periodista is not null")
    return e.groupBy("periodista").agg(
        F.count("*").alias("n"), F.countDistinct("conferencia_id").alias("conferencias"), F.sum("wq").alias("wq"), F.sum("wa").alias("wa"),
        F.round(F.avg("wq"), 4).alias("media_q"), F.round(F.avg("wa"), 4).alias("media_a"),
        F.round(F.try_divide(F.sum("wa"), F.sum("wq")), 4).alias("razon"),
    )


@query(f"""WITH {_ROWS}, {_E}, {_EX}, q AS (SELECT conferencia_id, hilo, intercambio, quien, min(orden) AS primero FROM v
  WHERE intercambio > 0 AND rol <> 'pregunta' AND quien IS NOT NULL GROUP BY ALL),
s AS (SELECT conferencia_id, hilo, intercambio, string_agg(quien, '; ' ORDER BY primero) AS responden FROM q GROUP BY ALL)
SELECT e.conferencia_id, e.hilo, e.intercambio, e.orden, e.pregunta, coalesce(s.responden, '') AS responden
FROM e LEFT JOIN s USING (conferencia_id, hilo, intercambio)""")
def exchange_rows(spark, d):
    """Exchanges with their responders in first-seen order."""
    e = _exchanges(spark, d)
    return e.select("conferencia_id", "hilo", "intercambio", "orden", "pregunta", F.array_join("quien_responde", "; ").alias("responden"))


@query(f"""WITH {_ROWS}, f AS (SELECT *, nullif(trim(regexp_replace(coalesce(texto, ''), '\\s+', ' ', 'g')), '') AS p FROM r),
w AS (SELECT *, coalesce(lag(p, 1) OVER z, lag(p, 2) OVER z) AS antes FROM f WINDOW z AS (PARTITION BY conferencia_id, hilo ORDER BY orden))
SELECT conferencia_id, hilo, orden, coalesce(right(antes, 600), '') AS contexto FROM w WHERE rol = 'pregunta' AND length(texto) < 200""")
def exchange_context(spark, d):
    """Context of short questions."""
    return sessions.previous_context(_rows(spark, d)).where("contexto is not null").select("conferencia_id", "hilo", "orden", "contexto")


@query(f"""WITH RECURSIVE {_ROWS}, n AS (SELECT *, length(coalesce(texto, '')) AS l, row_number() OVER (PARTITION BY conferencia_id, hilo ORDER BY orden) AS k FROM r),
p AS (SELECT a.conferencia_id, a.hilo, a.orden, a.rol, b.l, a.k - b.k AS atras FROM n a LEFT JOIN n b
  ON a.conferencia_id = b.conferencia_id AND a.hilo = b.hilo AND b.k BETWEEN a.k - 4 AND a.k - 1),
s AS (SELECT *, sum(l) OVER (PARTITION BY conferencia_id, hilo, orden ORDER BY atras ROWS UNBOUNDED PRECEDING) AS suma FROM p)
SELECT conferencia_id, hilo, orden, cast(count(*) FILTER (WHERE suma <= 900) AS int) AS previos,
  cast(coalesce(max(suma) FILTER (WHERE suma <= 900), 0) AS int) AS caracteres FROM s WHERE rol = 'pregunta' GROUP BY conferencia_id, hilo, orden""")
def context_budget(spark, d):
    """How many turns before a question fit its context."""
    found = sessions.context_budget(_rows(spark, d)).where("rol = 'pregunta'")
    return found.select("conferencia_id", "hilo", "orden", "previos", "caracteres")


@query(f"""WITH {_T}, s AS (SELECT conferencia_id, count(*) AS turnos, count(*) FILTER (WHERE tipo = 'prensa') AS prensa,
  count(DISTINCT hablante) AS hablantes FROM t GROUP BY 1), {_H}, g AS (SELECT conferencia_id, count(*) AS hilos FROM h GROUP BY 1)
SELECT s.conferencia_id, turnos, prensa, hablantes, coalesce(hilos, 0) AS hilos FROM s LEFT JOIN g USING (conferencia_id)""")
def conference_summary(spark, d):
    """Turns, press turns, speakers and threads of each conference."""
    s = _turns(spark, d).groupBy("conferencia_id").agg(
        F.count("*").alias("turnos"), F.count_if(F.col("tipo") == "prensa").alias("prensa"), F.countDistinct("hablante").alias("hablantes"))
    g = _threads(spark, d).groupBy("conferencia_id").agg(F.count("*").alias("hilos"))
    return s.join(g, "conferencia_id", "left").withColumn("hilos", F.coalesce("hilos", F.lit(0)))


_INTRO = r"(?:^|[.!?] )([A-ZÁÉÍÓÚÑ][a-záéíóúñü]+(?: [A-ZÁÉÍÓÚÑ][a-záéíóúñü]+){1,3}), (?:de|para) ([^.]{2,100})\."


@query(f"""WITH {_T}, o AS (SELECT *, tipo = 'prensa' AND regexp_extract(coalesce(texto, ''), '{_INTRO}', 1) <> '' AS abre,
  regexp_extract(coalesce(texto, ''), '{_INTRO}', 1) AS nombre, regexp_extract(coalesce(texto, ''), '{_INTRO}', 2) AS declarado FROM t),
k AS (SELECT *, sum(CASE WHEN abre THEN 1 ELSE 0 END) OVER (PARTITION BY conferencia_id ORDER BY orden ROWS UNBOUNDED PRECEDING) - 1 AS hilo FROM o),
i AS (SELECT conferencia_id, hilo, nombre, declarado FROM k WHERE abre)
SELECT k.conferencia_id, k.orden, cast(k.hilo AS int) AS hilo, i.nombre AS periodista, i.declarado AS medio FROM k LEFT JOIN i USING (conferencia_id, hilo)""")
def thread_open_propagate(spark, d):
    """Threads opened by an introduction; identity carried to the next."""
    t = _turns(spark, d)
    name = F.regexp_extract(F.coalesce("texto", F.lit("")), _INTRO, 1)
    outlet = F.regexp_extract(F.coalesce("texto", F.lit("")), _INTRO, 2)
    found = sessions.open_threads(t, (F.col("tipo") == "prensa") & (name != ""), name, outlet, F.lit("regex"))
    return found.select("conferencia_id", "orden", "hilo", "periodista", "medio")


@query(f"""WITH {_T}, n AS (SELECT *, sum(CASE WHEN tipo = 'funcionario' THEN 1 ELSE 0 END) OVER (PARTITION BY conferencia_id ORDER BY orden
  ROWS UNBOUNDED PRECEDING) AS racha FROM t), p AS (SELECT *, count(*) OVER w AS tamano, max(length(coalesce(texto, ''))) OVER w AS largo
  FROM n WHERE tipo = 'prensa' WINDOW w AS (PARTITION BY conferencia_id, racha))
SELECT conferencia_id, orden, cast(racha AS bigint) AS racha, tamano, tamano >= 2 AND largo <= 200 AS incierta FROM p""")
def runs_uncertain(spark, d):
    """Runs of press turns and whether they are uncertain."""
    return sessions.press_runs(_turns(spark, d)).select("conferencia_id", "orden", "racha", "tamano", "incierta")


@query(f"""WITH {_T}, {_ROWS}, k AS (SELECT DISTINCT conferencia_id, orden FROM r)
SELECT t.conferencia_id, t.tipo, count(*) AS fuera FROM t ANTI JOIN k USING (conferencia_id, orden) GROUP BY 1, 2""")
def out_of_thread(spark, d):
    """Turns in no thread."""
    inside = _rows(spark, d).select("conferencia_id", "orden").distinct()
    return _turns(spark, d).join(inside, ["conferencia_id", "orden"], "left_anti").groupBy("conferencia_id", "tipo").agg(F.count("*").alias("fuera"))


@query("""SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type
FROM events GROUP BY user_id""")
def last_wins(spark, d):
    """The last event of each user."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return agg.last_wins(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


# ---- rankings and reports -----------------------------------------------------------------


@query(f"""WITH {_H} SELECT periodista_canonico AS periodista, substr(conferencia_id, 1, 7) AS mes, count(*) AS hilos, count(DISTINCT conferencia_id) AS conferencias
FROM h WHERE periodista_canonico IS NOT NULL GROUP BY 1, 2""")
def actor_month_matrix(spark, d):
    """Threads by reporter and month."""
    h = _threads(spark, d).where("periodista_canonico is not null")
    return h.groupBy(F.col("periodista_canonico").alias("periodista"), "mes").agg(
        F.count("*").alias("hilos"), F.countDistinct("conferencia_id").alias("conferencias"))


_N = "n AS (SELECT periodista_canonico AS periodista, count(*) AS hilos FROM h WHERE periodista_canonico IS NOT NULL GROUP BY 1)"
_RANK = (
    "k AS (SELECT *, row_number() OVER (ORDER BY hilos DESC, periodista) AS rango, sum(hilos) OVER () AS total, "
    "sum(hilos) OVER (ORDER BY hilos DESC, periodista ROWS UNBOUNDED PRECEDING) AS corrido FROM n)"
)


def _counts(spark, d):
    h = _threads(spark, d).where("periodista_canonico is not null")
    return h.groupBy(F.col("periodista_canonico").alias("periodista")).agg(F.count("*").alias("hilos"))


@query(f"""WITH {_H}, {_N}, {_RANK} SELECT periodista, hilos, cast(rango AS int) AS rango, round(hilos / total, 6) AS cuota,
  round(corrido / total, 6) AS cuota_acumulada, (corrido - hilos) * 2 < total AS en_mitad FROM k""")
def concentration_pareto(spark, d):
    """Who holds the microphone: rank, share, cumulative share, and the half point."""
    return agg.concentration(_counts(spark, d), "hilos", "periodista")


@query(f"""WITH {_H}, {_N}, {_RANK} SELECT CASE WHEN rango <= 10 THEN '1-10' WHEN rango <= 50 THEN '11-50' WHEN rango <= 100 THEN '51-100' ELSE 'resto' END AS tramo,
  count(*) AS cuantos, cast(sum(hilos) AS bigint) AS hilos FROM k GROUP BY 1""")
def rank_tranches(spark, d):
    """Reporters and threads by tranche of rank."""
    return agg.tranches(agg.ranking(_counts(spark, d), "hilos", "periodista"), "hilos", [10, 50, 100])


@query(f"""WITH {_H}, n AS (SELECT medio, periodista_canonico AS periodista, count(*) AS n FROM h WHERE medio IS NOT NULL AND periodista_canonico IS NOT NULL GROUP BY 1, 2),
a AS (SELECT medio, count(*) AS hilos, count(DISTINCT periodista_canonico) AS periodistas FROM h WHERE medio IS NOT NULL GROUP BY 1),
m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY medio ORDER BY n DESC, periodista) = 1)
SELECT a.medio, a.hilos, a.periodistas, m.periodista AS principal FROM a LEFT JOIN m USING (medio)""")
def modal_value(spark, d):
    """Outlets with their threads, reporters and most frequent reporter."""
    h = _threads(spark, d).where("medio is not null")
    counts = h.groupBy("medio").agg(F.count("*").alias("hilos"), F.countDistinct("periodista_canonico").alias("periodistas"))
    most = agg.modal(h, "medio", "periodista_canonico").select("medio", F.col("periodista_canonico").alias("principal"))
    return counts.join(most, "medio", "left")


@query(f"""WITH {_C}, m AS (SELECT categoria, substr(id_pregunta, 1, 7) AS mes FROM c), p AS (SELECT categoria, count(*) AS n FROM m WHERE categoria IS NOT NULL GROUP BY 1
  ORDER BY n DESC, categoria LIMIT 8) SELECT coalesce(p.categoria, 'otros') AS categoria, mes, count(*) AS n FROM m LEFT JOIN p USING (categoria) GROUP BY 1, 2""")
def topic_month_top8_others(spark, d):
    """Categories by month, the eight most frequent and the others."""
    rows = _labels(spark, d).select("categoria", F.substring("id_pregunta", 1, 7).alias("mes"))
    return agg.top_and_others(rows, "categoria", "mes", 8)


@query(f"""WITH {_ROWS}, {_E}, {_EX}, g AS (SELECT periodista, count(*) AS n, avg(wq) AS q, avg(wa) AS a FROM e WHERE periodista IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)
SELECT 'todos' AS grupo, count(*) AS n, round(corr(a, q), 6) AS correlacion, round(regr_slope(a, q), 6) AS pendiente, round(regr_intercept(a, q), 5) AS ordenada,
  round(median(q), 6) AS mediana_q, round(min(a), 6) AS min_a, round(max(a), 6) AS max_a FROM g""")
def ratio_stats(spark, d):
    """Correlation and line between lengths of questions and answers."""
    e = _exchanges(spark, d).where("periodista is not null").groupBy("periodista").agg(F.count("*").alias("n"), F.avg("wq").alias("q"), F.avg("wa").alias("a"))
    return e.where("n >= 3").agg(
        F.lit("todos").alias("grupo"), F.count("*").alias("n"), F.round(F.corr("a", "q"), 6).alias("correlacion"),
        F.round(F.regr_slope("a", "q"), 6).alias("pendiente"), F.round(F.regr_intercept("a", "q"), 5).alias("ordenada"),
        F.round(F.median("q"), 6).alias("mediana_q"), F.round(F.min("a"), 6).alias("min_a"), F.round(F.max("a"), 6).alias("max_a"),
    )


_QT = (
    f"{_ROWS}, {_C}, q AS (SELECT periodista, conferencia_id, conferencia_id || '-h' || hilo || '-t' || orden AS id_pregunta, texto FROM r "
    "WHERE rol = 'pregunta' AND NOT coalesce(ruido, false)), j AS (SELECT q.*, c.categoria, c.asunto, c.asunto_canonico FROM q JOIN c USING (id_pregunta))"
)


def _labelled_questions(spark, d):
    q = _rows(spark, d).where("rol = 'pregunta' and not coalesce(ruido, false)").withColumn(
        "id_pregunta", F.concat("conferencia_id", F.lit("-h"), "hilo", F.lit("-t"), "orden"))
    return q.join(_labels(spark, d).select("id_pregunta", "categoria", "asunto", "asunto_canonico"), "id_pregunta")


@query(f"""WITH {_QT}, n AS (SELECT periodista, categoria, count(*) AS n FROM j WHERE periodista IS NOT NULL AND categoria IS NOT NULL GROUP BY 1, 2)
SELECT periodista, categoria, n, round(n / sum(n) OVER (PARTITION BY periodista), 6) AS cuota,
  cast(row_number() OVER (PARTITION BY periodista ORDER BY n DESC, categoria) AS int) AS puesto FROM n
QUALIFY row_number() OVER (PARTITION BY periodista ORDER BY n DESC, categoria) <= 5""")
def share_topk_per_group(spark, d):
    """The five most frequent categories of each reporter."""
    j = _labelled_questions(spark, d).where("periodista is not null and categoria is not null")
    return agg.top_per_group(j.groupBy("periodista", "categoria").agg(F.count("*").alias("n")), "periodista", "categoria", "n", 5)


@query(f"""WITH {_QT} SELECT periodista, coalesce(asunto_canonico, asunto) AS asunto, count(*) AS n, min(substr(conferencia_id, 1, 10)) AS desde,
  max(substr(conferencia_id, 1, 10)) AS hasta, cast(max(substr(conferencia_id, 1, 10))::date - min(substr(conferencia_id, 1, 10))::date >= 7 AS boolean) AS duradero,
  arg_max(texto, struct_pack(a := length(texto), b := texto)) AS ejemplo
FROM j WHERE periodista IS NOT NULL AND coalesce(asunto_canonico, asunto, '') <> '' GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_subjects(spark, d):
    """Subjects that a reporter brings up more than once, with span and longest question."""
    j = _labelled_questions(spark, d).withColumn("asunto", F.coalesce("asunto_canonico", "asunto")).where("periodista is not null and asunto <> ''")
    day = F.substring("conferencia_id", 1, 10)
    return j.groupBy("periodista", "asunto").agg(
        F.count("*").alias("n"), F.min(day).alias("desde"), F.max(day).alias("hasta"), (F.datediff(F.max(day), F.min(day)) >= 7).alias("duradero"),
        F.max_by("texto", F.struct(F.length("texto"), "texto")).alias("ejemplo"),
    ).where("n > 1")


# ---- search ------------------------------------------------------------------------------------


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches({_FOLD.format('text')}, '\\bagua\\b|\\bhospital|\\bpermiso\\s+de\\s+pesca\\b')")
def phrase_search_or(spark, d):
    """Documents with any of three phrases."""
    hits = search.matches(F.col("text"), any_of=["agua", "hospital*", "permiso de pesca"])
    return _documents(spark, d).where(hits).select("doc_id")


@query(
    f"SELECT doc_id FROM documents WHERE regexp_matches({_FOLD.format('text')}, '\\blicitacion\\b|\\bcontrato\\b') "
    f"AND regexp_matches({_FOLD.format('text')}, '\\bfederacion\\b|\\bcomunidades\\b')"
)
def phrase_search_and(spark, d):
    """Documents with one phrase of each of two groups."""
    hits = search.matches(F.col("text"), all_of=["licitación|contrato", "federación|comunidades"])
    return _documents(spark, d).where(hits).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches({_FOLD.format('text')}, '\\binvirti|ciones\\b')")
def phrase_search_wildcard(spark, d):
    """Documents with words by their beginning or end."""
    hits = search.matches(F.col("text"), any_of=["invirti*", "*ciones"])
    return _documents(spark, d).where(hits).select("doc_id")


@query(f"""WITH {_ROWS}, {_E}, {_EX} SELECT conferencia_id, hilo, orden, periodista, substr(conferencia_id, 1, 10)::date AS fecha FROM e
WHERE substr(conferencia_id, 1, 10)::date BETWEEN date '2024-11-01' AND date '2025-12-31' AND {_FOLD.format('periodista')} LIKE '%mar%'
  AND regexp_matches({_FOLD.format('pregunta')}, '\\bpresa\\b|\\bcosto\\b|\\bpuente\\b|\\bdictamen\\b') ORDER BY fecha, periodista, conferencia_id, orden""")
def range_and_substring_filter(spark, d):
    """Exchanges by date, reporter and phrase in the question."""
    e = sessions.exchanges(_rows(spark, d)).withColumn("fecha", F.substring("conferencia_id", 1, 10).cast("date"))
    found = search.search(e, any_of=["presa", "costo", "puente", "dictamen"], scope="pregunta", first="2024-11-01", last="2025-12-31", reporter="mar")
    return found.select("conferencia_id", "hilo", "orden", "periodista", "fecha")


@query(f"""WITH {_ROWS}, {_E}, {_EX}, g AS (SELECT * FROM e WHERE regexp_matches({_FOLD.format('pregunta')}, '\\bpresa\\b|\\bcosto\\b'))
SELECT coalesce(periodista, 'sin identificar') AS periodista, count(*) AS n, count(DISTINCT conferencia_id) AS conferencias FROM g GROUP BY 1""")
def search_summary(spark, d):
    """Hits and conferences of a search by reporter."""
    e = sessions.exchanges(_rows(spark, d))
    hits = e.where(search.matches(F.col("pregunta"), any_of=["presa", "costo"]))
    return hits.groupBy(F.coalesce("periodista", F.lit("sin identificar")).alias("periodista")).agg(
        F.count("*").alias("n"), F.countDistinct("conferencia_id").alias("conferencias"))


# ---- text functions -------------------------------------------------------------------------------


@query(f"SELECT puente_id, {_FOLD.format('medio_hablado')} AS llano, {_FLAT.format('medio_hablado')} AS palabras FROM (SELECT DISTINCT puente_id, medio_hablado FROM puente_medios)")
def plain_text(spark, d):
    """Outlets folded, with and without signs."""
    rows = table(spark, d, "puente_medios").select("puente_id", "medio_hablado").distinct()
    return rows.select("puente_id", text.plain(F.col("medio_hablado")).alias("llano"), text.plain_words(F.col("medio_hablado")).alias("palabras"))


@query(f"""WITH w AS (SELECT DISTINCT medio_hablado AS medio, {_FLAT.format('medio_hablado')} AS p FROM puente_medios WHERE medio_hablado IS NOT NULL),
x AS (SELECT medio, p, regexp_replace(regexp_replace(regexp_replace(p, '^(?:el|la|los|las) ', ''), '^(?:revista|periodico|portal|semanario|agencia|sitio) ', ''),
  '^(?:el|la|los|las) ', '') AS k FROM w) SELECT medio, replace(coalesce(nullif(k, ''), p), ' ', '') AS clave FROM x""")
def comparison_key(spark, d):
    """Keys under which outlets are compared."""
    rows = table(spark, d, "puente_medios").select(F.col("medio_hablado").alias("medio")).where("medio is not null").distinct()
    return rows.withColumn("clave", text.comparison_key(F.col("medio")))


#: Words without weight of four letters or more; shorter ones are no words of a bag anyway.
_STOPS = "'para', 'unos', 'unas', 'sobre', 'ante', 'tras', 'entre'"
_BAG = f"list_sort(list_distinct(list_filter(regexp_extract_all({_FOLD}, '[a-z0-9]{{{{4,}}}}'), lambda w: NOT list_contains([{_STOPS}], w))))"


@query(f"SELECT DISTINCT asunto, array_to_string({_BAG.format('asunto')}, ' ') AS bolsa FROM clasificaciones WHERE asunto <> ''")
def bag_of_words(spark, d):
    """Subjects as sets of words."""
    rows = table(spark, d, "clasificaciones").select("asunto").where("asunto <> ''").distinct()
    return rows.select("asunto", F.array_join(F.array_sort(similarity.subject_bag(F.col("asunto"))), " ").alias("bolsa"))


#: Every courtesy as a phrase, with and without the person addressed; and sentences of turns that are none.
_COURTESIES = (
    "cb(b) AS (VALUES ('gracias'), ('muchas gracias'), ('muchisimas gracias'), ('buenos dias'), ('buenas tardes'), ('buenas noches')), "
    "ca(a) AS (VALUES (''), (' presidenta'), (' presidente'), (' senora presidenta'), (' senora presidente')), "
    "cs(x) AS (SELECT b || a FROM cb, ca UNION ALL SELECT * FROM (VALUES ('bien'), ('si'), ('no'), ('de acuerdo'), ('asi es'), ('con permiso'), ('adelante'), ('(inaudible)')) v(x)), "
    f"so AS (SELECT conferencia_id, orden, unnest(regexp_split_to_array(regexp_replace(regexp_replace(trim({_FOLD.format('texto')}), '\\s+', ' ', 'g'), '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))) AS o FROM t), "
    "sn AS (SELECT conferencia_id, orden, trim(o) AS o, replace(replace(regexp_replace(regexp_replace(trim(o), '[\\s.,;!¡]+$', ''), '[\\s,]+', ' ', 'g'), '( inaudible )', '(inaudible)'), '(inaudible )', '(inaudible)') AS x FROM so), "
    "ru AS (SELECT conferencia_id, orden, count(*) FILTER (WHERE o <> '' AND cs.x IS NULL) = 0 AS ruido FROM sn LEFT JOIN cs USING (x) GROUP BY ALL)"
)


@query(f"WITH {_T}, {_COURTESIES} SELECT conferencia_id, orden, ruido FROM ru")
def noise_predicate(spark, d):
    """Turns that hold nothing but courtesies."""
    return _turns(spark, d).select("conferencia_id", "orden", rules.is_noise(F.col("texto")).alias("ruido"))


@query("""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n+')) AS linea FROM documents)
SELECT doc_id, count(*) AS lineas, cast(max(length(linea)) AS int) AS mayor FROM s WHERE regexp_matches(linea, '[^\\s\\x{a0}]') GROUP BY 1""")
def line_explode(spark, d):
    """Lines of each document."""
    lines = _documents(spark, d).select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\\n+")).alias("linea")).where(F.col("linea").rlike("[^\\s\\u00a0]"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lineas"), F.max(F.length("linea")).alias("mayor"))


def _forms_of(source: str, keys: str) -> str:
    """SQL of (keys, forma) of the rows of ``source`` with text ``p``: openers, gaps and verbs as a table, joined to the places of words."""
    openers = [("ya", 2, "revis%", "%", 1), ("hemos", 0, "revisado%", "%", 1)]
    openers += [(o, 1, "revisand%", "%", 2) for o in "estamos esta estan estoy seguimos sigue siguen estado estuvimos va_a_estar van_a_estar vamos_a_estar".split()]
    openers += [("que", 4, v, n, 3) for v, n in (("revise%", "%"), ("revisara%", "%"), ("pueda", "revis%"), ("puedan", "revis%"))]
    openers += [("para_que", 2, "revis%", "%", 3), *((o, 4, "revis%", "%", 3) for o in ("instru%", "pedi%", "pido%", "solicit%"))]
    openers += [(o, 1, "revis%", "%", 4) for o in (
        "hay_que habria_que tiene_que tienen_que tenemos_que tendria_que tendriamos_que tendrian_que debe deben debemos deberia necesitamos importante").split()]
    openers += [(o, 2, "revis%", "%", 5) for o in "vamos_a voy_a va_a van_a podemos se_puede puedo".split()]
    openers += [(o, 1, v, "%", 5) for o in "lo la los las".split() for v in ("revisamos", "reviso", "revisaremos")]
    rows = ", ".join(f"('{o.replace('_', ' ')}', {gap}, '{verb}', '{more}', {r})" for o, gap, verb, more, r in openers)
    return (
        f"op(abre, hueco, verbo, sigue, r) AS (VALUES {rows}), tk AS (SELECT {keys}, string_split(p, ' ') AS w FROM {source} WHERE contains(p, 'revis')), "
        "wd AS (SELECT *, list_transform(w, lambda x: regexp_replace(x, '^[^a-z0-9_]+|[^a-z0-9_]+$', '', 'g')) AS c FROM tk), "
        f"vb AS (SELECT {keys}, w, c, unnest(range(1, len(w) + 1)) AS i FROM wd), vr AS (SELECT * FROM vb WHERE c[i] LIKE 'revis%' OR c[i] LIKE 'pueda%'), "
        "vk AS (SELECT vr.*, unnest(range(0, 5)) AS k FROM vr), "
        "ht AS (SELECT vk.*, ' ' || array_to_string(c[greatest(1, i - 3 - k):i - 1 - k], ' ') AS antes FROM vk WHERE i - 1 - k >= 1 AND regexp_matches(w[i - 1 - k], '[a-z0-9_]$') "
        "AND left(w[i], 1) = left(c[i], 1) AND len(list_filter(w[i - k:i - 1], lambda x: NOT regexp_matches(x, '^[a-z0-9_]+$'))) = 0), "
        f"fr AS (SELECT {keys}, r FROM ht JOIN op ON k <= hueco AND c[i] LIKE verbo AND coalesce(c[i + 1], '') LIKE sigue AND CASE WHEN contains(abre, '%') THEN c[i - 1 - k] LIKE abre "
        f"ELSE ends_with(antes, ' ' || abre) END UNION ALL SELECT {keys}, 5 FROM vr WHERE c[i] = 'revisamos' AND w[i] = c[i] AND c[i + 1] IN ('el', 'la', 'los', 'las', 'este', 'esta', 'ese', 'esa', "
        "'eso', 'esto', 'su', 'sus') AND (i = 1 OR c[i - 1] IN ('entonces', 'gusto'))), "
        f"fm AS (SELECT {keys}, ['hecho', 'en_curso', 'encargo', 'necesidad', 'compromiso'][min(r)] AS forma FROM fr GROUP BY ALL)"
    )


#: Sentences of what officials say, folded, by conference, turn and place.
_SAID = (
    "l AS (SELECT conferencia_id, orden, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(texto, ''), '([.?!…])\\s+', '\\1' || chr(10), 'g'), '\\n+'), "
    "lambda x: trim(x)), lambda x: x <> '') AS o FROM t WHERE tipo = 'funcionario'), "
    "s AS (SELECT conferencia_id, orden, unnest(o) AS oracion, unnest(range(len(o))) AS posicion FROM l), "
    "f AS (SELECT conferencia_id, orden, posicion, trim(regexp_replace(strip_accents(lower(oracion)), '\\s+', ' ', 'g')) AS p FROM s)"
)
_PLACE = "conferencia_id, orden, posicion"
#: Findings: gerunds with an auxiliary one to three words before them, and the main verb where it isn't one of them.
_FOUND = (
    f"{_SAID}, {_forms_of('f', _PLACE)}, g(ger, verbo) AS (VALUES ('viendo', 'ver'), ('analizando', 'analizar'), ('investigando', 'investigar'), ('evaluando', 'evaluar'), "
    "('estudiando', 'estudiar'), ('valorando', 'valorar'), ('consultando', 'consultar'), ('checando', 'checar'), ('verificando', 'verificar'), ('averiguando', 'averiguar'), ('revisando', 'revisar')), "
    f"gt AS (SELECT {_PLACE}, string_split(p, ' ') AS w, p FROM f WHERE contains(p, 'ndo')), gw AS (SELECT *, list_transform(w, lambda x: regexp_replace(x, '^[^a-z0-9_]+|[^a-z0-9_]+$', '', 'g')) AS c FROM gt), "
    "gi AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM gw), gk AS (SELECT gi.*, verbo, unnest(range(0, 3)) AS k FROM gi JOIN g ON c[i] = ger), "
    f"gh AS (SELECT {_PLACE}, verbo, i, k, c[i - 1 - k] AS aux, coalesce(c[i - 2 - k], '') AS antes FROM gk WHERE i - 1 - k >= 1 AND regexp_matches(w[i - 1 - k], '[a-z0-9_]$') "
    "AND c[i - 1 - k] IN ('estamos', 'seguimos', 'estoy', 'esta', 'estan', 'sigue', 'siguen') AND len(list_filter(w[i - k:i - 1], lambda x: NOT regexp_matches(x, '^[a-z0-9_]+$'))) = 0 "
    "AND NOT (verbo = 'estudiar' AND (list_contains(c, 'estudiante') OR list_contains(c, 'estudiantes')))), "
    f"cz AS (SELECT * FROM gh QUALIFY row_number() OVER (PARTITION BY {_PLACE}, verbo ORDER BY i, k DESC) = 1), "
    f"mz AS (SELECT {_PLACE}, 'revisar' AS verbo FROM f WHERE len(list_filter(string_split(p, ' '), lambda x: regexp_matches(x, '(^|[^a-z0-9_])(revisa|revise)|(^|[^a-z0-9_])reviso([^a-z0-9_]|$)'))) > 0 "
    f"EXCEPT SELECT {_PLACE}, verbo FROM cz), "
    f"az AS (SELECT {_PLACE}, verbo, aux, antes FROM cz UNION ALL SELECT {_PLACE}, verbo, '', '' FROM mz), "
    f"hz AS (SELECT {', '.join('az.' + k for k in _PLACE.split(', '))}, verbo, CASE WHEN verbo = 'revisar' THEN coalesce(forma, 'otra') ELSE 'en_curso' END AS forma, CASE WHEN aux = '' THEN '' "
    f"WHEN aux IN ('estamos', 'seguimos', 'estoy') THEN 'nosotros' WHEN antes = 'se' THEN 'impersonal' ELSE 'tercero' END AS sujeto FROM az LEFT JOIN fm USING ({_PLACE}))"
)


@query(f"""WITH {_T}, s AS (SELECT conferencia_id, orden, unnest(regexp_split_to_array({_FOLD.format('texto')}, '\\n+')) AS q FROM t WHERE tipo = 'funcionario'),
f AS (SELECT conferencia_id, row_number() OVER () AS linea, trim(regexp_replace(q, '\\s+', ' ', 'g')) AS p FROM s WHERE contains(q, 'revis')), {_forms_of('f', 'conferencia_id, linea')}
SELECT conferencia_id, coalesce(forma, 'otra') AS forma, count(*) AS n FROM f LEFT JOIN fm USING (conferencia_id, linea) GROUP BY 1, 2""")
def rule_forms(spark, d):
    """Forms of "to review" in what officials say, by line."""
    lines = _turns(spark, d).where("tipo = 'funcionario'").select("conferencia_id", F.explode(F.split(text.plain(F.col("texto")), "\\n+")).alias("q"))
    return lines.where(F.col("q").rlike("revis")).groupBy("conferencia_id", rules.verb_form(F.col("q")).alias("forma")).agg(F.count("*").alias("n"))


@query(f"""WITH {_T}, {_FOUND} SELECT verbo, forma, sujeto, count(*) AS n, count(DISTINCT conferencia_id) AS conferencias FROM hz GROUP BY ALL""")
def verb_findings(spark, d):
    """Sentences in which officials look into a matter, by verb, form and subject."""
    found = mining.findings(_turns(spark, d).where("tipo = 'funcionario'"), ["conferencia_id", "orden"], "texto")
    return found.groupBy("verbo", "forma", "sujeto").agg(F.count("*").alias("n"), F.countDistinct("conferencia_id").alias("conferencias"))


_FORM_RANK = "CASE forma WHEN 'compromiso' THEN 1 WHEN 'en_curso' THEN 2 WHEN 'encargo' THEN 3 WHEN 'necesidad' THEN 4 WHEN 'hecho' THEN 5 ELSE 6 END"


@query(f"""WITH {_T}, {_FOUND} SELECT conferencia_id, orden, verbo, forma, sujeto FROM hz
QUALIFY row_number() OVER (PARTITION BY conferencia_id, orden ORDER BY {_FORM_RANK}, posicion, verbo) = 1""")
def best_form(spark, d):
    """The most committed finding of each turn."""
    found = mining.findings(_turns(spark, d).where("tipo = 'funcionario'"), ["conferencia_id", "orden"], "texto")
    return mining.best_form(found, ["conferencia_id", "orden"]).select("conferencia_id", "orden", "verbo", "forma", "sujeto")


#: Example of a rule layer: neutral words that suggest a stance.
_LAYER = {"denuncia": r"\bdenunci|\breclam|\bno les pagan\b", "reconoce": r"\bgracias\b|\bfelicit", "pide_dato": r"\bcuanto|\bplazo\b|\bcosto\b"}


@query(f"""WITH {_ROWS}, m AS (SELECT id_pregunta, arg_max(postura, struct_pack(a := recibido_en, b := pasada, c := coalesce(postura, ''))) AS postura_modelo
  FROM posturas WHERE postura IS NOT NULL GROUP BY 1), q AS (SELECT conferencia_id || '-h' || hilo || '-t' || orden AS id_pregunta, {_FOLD.format('texto')} AS p FROM r
  WHERE rol = 'pregunta' AND NOT coalesce(ruido, false)),
f AS (SELECT id_pregunta, list_filter([{", ".join(f"CASE WHEN regexp_matches(p, '{r}') THEN '{k}' END" for k, r in _LAYER.items())}], lambda x: x IS NOT NULL) AS reglas FROM q)
SELECT f.id_pregunta, array_to_string(reglas, '|') AS reglas, postura_modelo, CASE WHEN list_contains(reglas, 'denuncia') THEN 'crítica' ELSE postura_modelo END AS postura,
  CASE WHEN list_contains(reglas, 'denuncia') THEN 'regla' ELSE 'modelo' END AS metodo FROM f LEFT JOIN m USING (id_pregunta)""")
def rule_layer_over_model(spark, d):
    """Rules go before the model's last label; which fired is kept."""
    p = table(spark, d, "posturas").where("postura is not null")
    model = p.groupBy("id_pregunta").agg(F.max_by("postura", F.struct("recibido_en", "pasada", "postura")).alias("postura_modelo"))
    q = _rows(spark, d).where("rol = 'pregunta' and not coalesce(ruido, false)").select(
        F.concat("conferencia_id", F.lit("-h"), "hilo", F.lit("-t"), "orden").alias("id_pregunta"), rules.fired_rules(F.col("texto"), _LAYER).alias("r"))
    fires = F.array_contains("r", "denuncia")
    return q.join(model, "id_pregunta", "left").select(
        "id_pregunta", F.array_join("r", "|").alias("reglas"), "postura_modelo", F.when(fires, "crítica").otherwise(F.col("postura_modelo")).alias("postura"),
        F.when(fires, "regla").otherwise("modelo").alias("metodo"),
    )


# ---- vocabularies ------------------------------------------------------------------------------------

_VOC = "de la que el en los las con por para una del".split()
_WORDS = (
    f"w AS (SELECT lang, unnest(list_filter(regexp_extract_all({_FOLD.format('text')}, '[a-z]+'), lambda x: length(x) > 2 AND NOT list_contains("
    f"[{', '.join(repr(w) for w in _VOC)}], x))) AS palabra FROM (SELECT coalesce(lang, '?') AS lang, text FROM documents))"
)


def _vocabulary(spark, d):
    rows = table(spark, d, "documents").withColumn("lang", F.coalesce("lang", F.lit("?")))
    return rows.select("lang", F.explode(text.tokens(F.col("text"), _VOC)).alias("palabra"))


@query(f"""WITH {_WORDS}, s AS (SELECT DISTINCT lang, palabra FROM w), n AS (SELECT lang, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.lang AS a, b.lang AS b, count(*) AS comunes FROM s a JOIN s b USING (palabra) WHERE a.lang < b.lang GROUP BY 1, 2)
SELECT a, b, comunes, round(1 - comunes / (x.n + y.n - comunes), 6) AS distancia FROM c JOIN n x ON a = x.lang JOIN n y ON b = y.lang""")
def vocabulary_jaccard(spark, d):
    """Distance of the vocabularies of languages."""
    return similarity.vocabulary_distances(_vocabulary(spark, d), "lang", "palabra")


@query(f"""WITH {_WORDS}, a AS (SELECT palabra, count(*) AS n FROM w WHERE lang = 'es' GROUP BY 1) SELECT palabra, n FROM a
ANTI JOIN (SELECT palabra FROM w WHERE lang <> 'es') b USING (palabra)""")
def vocabulary_difference(spark, d):
    """Words of Spanish documents that no other has."""
    v = _vocabulary(spark, d)
    own = v.where("lang = 'es'").groupBy("palabra").agg(F.count("*").alias("n"))
    return own.join(v.where("lang <> 'es'").select("palabra").distinct(), "palabra", "left_anti")


# ---- names, outlets, subjects ----------------------------------------------------------------------------


def _subject_counts(spark, d):
    return _labels(spark, d).where("asunto <> ''").groupBy("asunto").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_C}, f AS (SELECT asunto, count(*) AS n FROM c WHERE asunto <> '' GROUP BY 1),
s AS (SELECT asunto, row_number() OVER (ORDER BY n DESC, asunto) AS k, {_BAG.format('asunto')} AS w FROM f),
g AS (SELECT cast(0 AS bigint) AS k, cast([] AS STRUCT(a VARCHAR, w VARCHAR[])[]) AS reps, cast(NULL AS VARCHAR) AS asunto, cast(NULL AS VARCHAR) AS canonico
  UNION ALL SELECT k, CASE WHEN hit IS NULL THEN list_append(reps, struct_pack(a := asunto, w := w)) ELSE reps END, asunto, coalesce(hit, asunto) FROM (
    SELECT s.k, g.reps, s.asunto, s.w, list_filter(g.reps, lambda r: len(r.w) > 0 AND len(s.w) > 0
      AND len(list_intersect(r.w, s.w)) >= 0.6 * (len(r.w) + len(s.w) - len(list_intersect(r.w, s.w))) - 1e-9)[1].a AS hit FROM g JOIN s ON s.k = g.k + 1))
SELECT asunto, canonico, count(*) OVER (PARTITION BY canonico) AS variantes FROM g WHERE asunto IS NOT NULL""")
def subject_consolidation(spark, d):
    """Subjects with their representative and group size."""
    mapped = similarity.consolidate(_subject_counts(spark, d), "asunto", "n", 0.6)
    return mapped.withColumn("variantes", F.count("*").over(Window.partitionBy("canonico")))


@query(f"""WITH {_C} SELECT count(DISTINCT asunto) AS asuntos, count(DISTINCT asunto) AS con_representante, cast(0 AS bigint) AS distintos FROM c WHERE asunto <> ''""")
def subject_consolidation_check(spark, d):
    """How many subjects have a representative that represents itself, and how many aren't similar to it."""
    mapped = similarity.consolidate(_subject_counts(spark, d), "asunto", "n", 0.6)
    alike = text.jaccard(similarity.subject_bag(F.col("asunto")), similarity.subject_bag(F.col("canonico")))
    roots = mapped.where("asunto = canonico").select(F.col("asunto").alias("canonico"), F.lit(True).alias("raiz"))
    unlike = (F.col("asunto") != F.col("canonico")) & (alike < 0.6 - 1e-9)
    return mapped.join(roots, "canonico", "left").agg(
        F.count("*").alias("asuntos"), F.count("raiz").alias("con_representante"), F.count_if(unlike).alias("distintos"))


_REPORTERS = f"{_H}, f AS (SELECT periodista AS name, count(*) AS n FROM h WHERE periodista IS NOT NULL GROUP BY 1)"
_KEYED = (
    f"w AS (SELECT name, n, {_FLAT.format('name')} AS p FROM f), x AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(p, '^(?:el|la|los|las) ', ''), "
    "'^(?:revista|periodico|portal|semanario|agencia|sitio) ', ''), '^(?:el|la|los|las) ', '') AS k FROM w), "
    "y AS (SELECT name, n, replace(coalesce(nullif(k, ''), p), ' ', '') AS key, row_number() OVER (ORDER BY n DESC, name) AS r FROM x), "
    "q AS (SELECT a.name AS a, a.n AS n_a, a.r AS r_a, b.name AS b, b.n AS n_b, b.r AS r_b, "
    "a.key = b.key OR (b.n <= 2 AND a.n > 2) AS une FROM y a JOIN y b ON a.r < b.r AND (a.key = b.key OR (length(a.key) > 8 AND length(b.key) > 8 "
    "AND abs(length(a.key) - length(b.key)) <= 2 AND levenshtein(a.key, b.key) <= 2))), p1 AS (SELECT b, min(r_a) AS padre FROM q WHERE une GROUP BY 1)"
)


@query(f"""WITH RECURSIVE {_REPORTERS}, {_KEYED}, up AS (SELECT y.r, y.name, coalesce(p1.padre, y.r) AS padre FROM y LEFT JOIN p1 ON y.name = p1.b),
go AS (SELECT name, r, padre FROM up UNION ALL SELECT go.name, up.r, up.padre FROM go JOIN up ON go.padre = up.r WHERE go.padre <> go.r)
SELECT go.name, y.name AS canonico FROM go JOIN y ON go.r = y.r WHERE go.padre = go.r""")
def name_canonical_map(spark, d):
    """Reporters' names with the name they follow."""
    h = _threads(spark, d).where("periodista is not null").groupBy("periodista").agg(F.count("*").alias("n"))
    return entities.name_merges(h, "periodista", "n")[0]


@query(f"""WITH {_REPORTERS}, {_KEYED} SELECT a, n_a, q.b, n_b FROM q LEFT JOIN p1 ON q.b = p1.b WHERE NOT une AND (padre IS NULL OR r_a < padre)""")
def name_doubtful_pairs(spark, d):
    """Near names that nothing settles."""
    h = _threads(spark, d).where("periodista is not null").groupBy("periodista").agg(F.count("*").alias("n"))
    return entities.name_merges(h, "periodista", "n")[1]


_CONN = "^((" + "|".join(sorted((c.replace(" ", "\\s+") for c in entities.CONNECTORS), key=len, reverse=True)) + ")\\s+)+"
_ENDS = "^[\\s.\\-—·…]+|[\\s.\\-—·…]+$"
_KEY1 = (
    "replace(coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({0}, '^(el|la|los|las) ', ''), '^(revista|periodico|portal|semanario|agencia|sitio) ', ''), "
    "'^(el|la|los|las) ', ''), ''), {0}), ' ', '')"
)
#: Outlets of each thread in order: cut, stripped of connectors, tested, one of each key; the whole where nothing is left.
_OUTLETS = (
    "p AS (SELECT conferencia_id, hilo, periodista_canonico, medio, list_transform(regexp_split_to_array(medio, '\\s*[;,:/|]\\s*|\\s+[ye]\\s+'), "
    f"lambda x: trim(regexp_replace(regexp_replace(x, '{_ENDS}', '', 'g'), '(?i){_CONN}', ''))) AS q FROM h WHERE trim(medio) <> ''), "
    "u AS (SELECT *, unnest(q) AS name, unnest(range(len(q))) AS lugar FROM p), "
    f"z AS (SELECT conferencia_id, hilo, periodista_canonico, name, lugar, {_FLAT.format('name')} AS w, {_FOLD.format('name')} AS v FROM u), "
    f"t AS (SELECT *, {_KEY1.format('w')} AS clave FROM z WHERE (length(name) >= 4 OR regexp_matches(name, '^\\p{{Lu}}{{2,}}[0-9]*$')) AND NOT list_contains("
    f"[{', '.join(repr(x) for x in entities.PLACES)}], v) AND NOT regexp_matches(v, '{entities.CLAUSES}') AND len(regexp_split_to_array(name, '\\s+')) <= 8), "
    "o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY conferencia_id, hilo, clave ORDER BY lugar) = 1), "
    "n AS (SELECT conferencia_id, hilo, periodista_canonico, name FROM o UNION ALL SELECT conferencia_id, hilo, periodista_canonico, trim(medio) FROM p ANTI JOIN o USING (conferencia_id, hilo))"
)


@query(f"WITH {_H}, {_OUTLETS} SELECT name AS cabecera, count(*) AS hilos, count(DISTINCT periodista_canonico) AS periodistas FROM n GROUP BY 1")
def outlet_split_explode(spark, d):
    """Outlets named in declarations, with threads and reporters."""
    named = F.explode(entities.split_outlets(F.col("medio"), entities.PLACES, entities.CLAUSES)).alias("cabecera")
    rows = _threads(spark, d).where("trim(medio) <> ''").select("conferencia_id", "hilo", "periodista_canonico", named)
    return rows.groupBy("cabecera").agg(F.count("*").alias("hilos"), F.countDistinct("periodista_canonico").alias("periodistas"))


@query()
def outlet_canonical(spark, d):
    """Outlets with the spelling chosen for their key."""
    named = F.explode(entities.split_outlets(F.col("medio"), entities.PLACES, entities.CLAUSES)).alias("cabecera")
    counts = _threads(spark, d).where("trim(medio) <> ''").select(named).groupBy("cabecera").agg(F.count("*").alias("n"))
    return entities.outlet_votes(counts, "cabecera", "n")


_PIECES = "list_filter(regexp_split_to_array({0}, '[;|/,]'), lambda x: trim(x) <> '')"
_PKEY = "replace(trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g')), ' ', '')"


@query(f"""WITH {_H}, a AS (SELECT DISTINCT conferencia_id || '#' || hilo AS id, {_PKEY.format('z')} AS k FROM (SELECT conferencia_id, hilo,
  unnest({_PIECES.format('medio')}) AS z FROM h)), b AS (SELECT DISTINCT puente_id, monto_2024_2026 AS monto, {_PKEY.format('medio_hablado')} AS k FROM puente_medios
  WHERE medio_hablado IS NOT NULL) SELECT puente_id, round(max(monto), 2) AS monto, count(DISTINCT id) AS hilos FROM b JOIN a USING (k) WHERE k <> '' GROUP BY 1""")
def set_overlap_bridge(spark, d):
    """Bridge rows with the threads whose outlets overlap theirs."""
    keys = F.transform(F.split("medio", "[;|/,]"), lambda z: F.replace(text.plain_words(z), F.lit(" "), F.lit("")))
    threads = _threads(spark, d).where("medio is not null").select(F.concat_ws("#", "conferencia_id", "hilo").alias("id"), F.array_distinct(keys).alias("k"))
    bridge = table(spark, d, "puente_medios").dropDuplicates(["puente_id"]).where("medio_hablado is not null").select(
        "puente_id", F.col("monto_2024_2026").alias("monto"), F.array(F.replace(text.plain_words(F.col("medio_hablado")), F.lit(" "), F.lit(""))).alias("k"))
    threads = threads.withColumn("k", F.filter("k", lambda x: x != ""))
    hits = entities.overlapping(bridge.where("k[0] <> ''"), "puente_id", "k", threads, "id", "k").groupBy("puente_id").agg(F.count("*").alias("hilos"))
    return hits.join(bridge.select("puente_id", F.round("monto", 2).alias("monto")), "puente_id")


# ---- documents ----------------------------------------------------------------------------------------------


#: A label is in capitals, but for a note in brackets at its end.
_SHOUTED = (
    "(regexp_replace(trim(etiqueta), ' *[(][^()]{0,45}[)]$', '') = upper(regexp_replace(trim(etiqueta), ' *[(][^()]{0,45}[)]$', '')) AND regexp_matches(trim(etiqueta), '^\\p{Lu}') "
    "AND length(regexp_replace(trim(etiqueta), ' *[(][^()]{0,45}[)]$', '')) BETWEEN 3 AND 151)"
)
_KIND = (
    "CASE WHEN regexp_matches(e, '^(PREGUNTAS?|INTERLOCUTORA?|INTERLOCUTORES|INTERLOCUTORAS)( *[(][^)]*[)])?$') THEN 'prensa' "
    "WHEN regexp_matches(e, '^(INTERVENCION(ES)?( (HOMBRES?|MUJER(ES)?))?( *[(][^)]*[)])?|ASISTENTES)$') "
    "OR regexp_matches(e, '^(VOZ|VOCES|DERECHOHABIENTE|MADRE|PADRE|PACIENTE|TRABAJADOR|BENEFICIARI)') THEN 'anonimo' ELSE 'funcionario' END"
)


@query(f"""WITH {_T}, s AS (SELECT *, strip_accents(upper(trim(etiqueta))) AS e FROM t WHERE {_SHOUTED})
SELECT conferencia_id, cast(row_number() OVER (PARTITION BY conferencia_id ORDER BY orden) - 1 AS int) AS orden, trim(etiqueta) AS etiqueta, {_KIND} AS tipo FROM s""")
def label_segmentation(spark, d):
    """Transcripts written out and cut into turns again; a label in small letters is no label, so its turn falls to the one before."""
    line = F.concat(F.coalesce("etiqueta", F.lit("")), F.lit(": "), F.regexp_replace(F.coalesce("texto", F.lit("")), "\\s+", " "))
    listed = F.array_sort(F.collect_list(F.struct("orden", line.alias("l"))))
    docs = _turns(spark, d).groupBy("conferencia_id").agg(F.array_join(F.transform(listed, lambda x: x.l), "\n\n").alias("texto"))
    return documents.turns_of(docs, "conferencia_id", "texto").select("conferencia_id", "orden", "etiqueta", "tipo")


@query(f"""WITH {_T}, p AS (SELECT conferencia_id, orden, trim(regexp_replace(texto, '[\\s\\x{{a0}}]+', ' ', 'g')) AS l FROM t WHERE texto IS NOT NULL)
SELECT conferencia_id, string_agg(l, chr(10) || chr(10) ORDER BY orden) AS texto FROM p WHERE l <> '' GROUP BY 1""")
def html_paragraphs(spark, d):
    """Transcripts written as pages and read back; signs of markup in the text are escaped, as a page has them."""
    flat = F.trim(F.regexp_replace("texto", "[\\s\\u00a0]+", " "))
    for sign, escape in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        flat = F.replace(flat, F.lit(sign), F.lit(escape))
    rows = _turns(spark, d).where("texto is not null").withColumn("l", flat).where("l <> ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("orden", "l"))), lambda x: F.concat(F.lit("<div><p>"), x.l, F.lit("</p></div>"))), "")
    pages = rows.groupBy("conferencia_id").agg(F.concat(F.lit("<html><body><div class='article-body'>"), body, F.lit("</div></body></html>")).alias("html"))
    return documents.pages_to_text(pages, "conferencia_id", "html")


@query()
def introductions(spark, d):
    """Who introduces themselves in press turns."""
    found = identity.introductions(_turns(spark, d).where("tipo = 'prensa'"), ["conferencia_id", "orden"], "texto")
    return found.where("periodista is not null").select("conferencia_id", "orden", "periodista", "medio", "redactado")


@query()
def introductions_known(spark, d):
    """Introductions without a comma, of people who introduced themselves elsewhere."""
    press = _turns(spark, d).where("tipo = 'prensa'")
    first = identity.introductions(press, ["conferencia_id", "orden"], "texto")
    known = first.where("periodista is not null").select("periodista")
    return identity.introductions(press, ["conferencia_id", "orden"], "texto", known).where("periodista is not null").groupBy("periodista").agg(F.count("*").alias("n"))


def _announced(opening: str, between: str = "", most: int = 90) -> str:
    return f"{opening} +{between}[‘“\\x22'']?([^.;\\n’”\\x22'']{{3,{most}}})"


_OPENING = [
    _announced("vamos a hablar", "(?:sobre|del?) +"), _announced("hoy vamos a presentar"), _announced("hoy es", "(?:el +)?(?:d[ií]a de +)?", 80),
    _announced("el tema de hoy es"), _announced("hoy tenemos"),
]
_CLEAN = "nullif(trim(regexp_replace(regexp_replace({0}, '^[ ,;:—-]+|[ ,;:—-]+$', '', 'g'), '\\s+', ' ', 'g')), '')"


@query(f"""WITH {_T}, o AS (SELECT conferencia_id, left(string_agg(texto, chr(10) ORDER BY orden), 2500) AS s FROM t WHERE orden < 6 AND tipo = 'funcionario' GROUP BY 1),
m AS (SELECT conferencia_id, {", ".join(f"nullif(regexp_extract(s, '(?i){p}', 1), '') AS a{k}, regexp_extract(s, '(?i){p}', 0) AS b{k}" for k, p in enumerate(_OPENING))} FROM o),
x AS (SELECT conferencia_id, coalesce(a0, a1, a2, a3, a4) AS a, coalesce({", ".join(f"nullif(b{k}, '')" for k in range(5))}) AS b FROM m)
SELECT conferencia_id, {_CLEAN.format('a')} AS tema, CASE WHEN {_CLEAN.format('a')} IS NULL THEN 'sin_identificar' ELSE 'regex' END AS metodo,
  CASE WHEN {_CLEAN.format('a')} IS NOT NULL THEN left(trim(regexp_replace(b, '\\s+', ' ', 'g')), 160) END AS fragmento FROM x""")
def subject_of_day(spark, d):
    """The subject that officials announce at the opening."""
    return documents.subject_of_day(_turns(spark, d), rules.ANNOUNCEMENTS)


@query(f"""WITH {_T}, n AS (SELECT etiqueta, count(*) AS n FROM t WHERE etiqueta IS NOT NULL GROUP BY 1) SELECT etiqueta, n, n <= 3 AS rara, NOT contains(etiqueta, ',') AS sin_coma FROM n""")
def label_histogram(spark, d):
    """Labels, rare ones and ones without an office."""
    n = _turns(spark, d).where("etiqueta is not null").groupBy("etiqueta").agg(F.count("*").alias("n"))
    return n.select("etiqueta", "n", (F.col("n") <= 3).alias("rara"), (~F.col("etiqueta").contains(",")).alias("sin_coma"))


# ---- sources, calendars, ledgers --------------------------------------------------------------------------------


@query("""WITH a AS (SELECT DISTINCT fecha FROM conferencias WHERE fecha IS NOT NULL), b AS (SELECT min(fecha) AS x, max(fecha) AS y FROM a),
g AS (SELECT unnest(generate_series(x::timestamp, y::timestamp, interval 1 day))::date AS fecha FROM b) SELECT g.fecha FROM g ANTI JOIN a USING (fecha) WHERE isodow(g.fecha) < 6""")
def calendar_gaps(spark, d):
    """Weekdays without a conference."""
    held = table(spark, d, "conferencias").where("fecha is not null").select("fecha").distinct()
    span = held.agg(F.min("fecha").alias("x"), F.max("fecha").alias("y"))
    days = span.select(F.explode(F.sequence("x", "y")).alias("fecha")).where(F.weekday("fecha") < 5)
    return days.join(held, "fecha", "left_anti")


@query("""WITH a AS (SELECT DISTINCT fecha FROM conferencias WHERE fecha IS NOT NULL), b AS (SELECT min(fecha) AS x, max(fecha) AS y FROM a),
g AS (SELECT unnest(generate_series(x::timestamp, y::timestamp, interval 1 day))::date AS fecha FROM b), w AS (SELECT fecha FROM g WHERE isodow(fecha) < 6)
SELECT strftime(w.fecha, '%Y-%m') AS mes, count(*) AS habiles, count(a.fecha) AS cubiertos, round(100 * count(a.fecha) / count(*), 4) AS cobertura
FROM w LEFT JOIN a USING (fecha) GROUP BY 1""")
def source_coverage(spark, d):
    """Share of weekdays with a conference, by month."""
    held = table(spark, d, "conferencias").where("fecha is not null").select("fecha").distinct()
    span = held.agg(F.min("fecha").alias("x"), F.max("fecha").alias("y"))
    days = span.select(F.explode(F.sequence("x", "y")).alias("fecha")).where(F.weekday("fecha") < 5)
    joined = days.join(held.withColumn("si", F.lit(1)), "fecha", "left").groupBy(F.date_format("fecha", "yyyy-MM").alias("mes"))
    return joined.agg(F.count("*").alias("habiles"), F.count("si").alias("cubiertos"), F.round(100 * F.count("si") / F.count("*"), 4).alias("cobertura"))


@query("""WITH s AS (SELECT conferencia_id AS id, 'conferencias' AS fuente, 0 AS prioridad, recibido_en FROM conferencias UNION ALL
SELECT conferencia_id, source, 1, capturado_en FROM documents), k AS (SELECT id, fuente, prioridad FROM s WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY prioridad, recibido_en, fuente) = 1)
SELECT * FROM k UNION ALL SELECT id, fuente, prioridad FROM s WHERE id IS NULL""")
def source_fusion(spark, d):
    """Sources merged, one row per conference by priority; undated rows stay."""
    a = table(spark, d, "conferencias").select(F.col("conferencia_id").alias("id"), F.lit("conferencias").alias("fuente"), "recibido_en")
    b = table(spark, d, "documents").select(F.col("conferencia_id").alias("id"), F.col("source").alias("fuente"), F.col("capturado_en").alias("recibido_en"))
    return agg.first_by_priority([a, b], "id", ["recibido_en", "fuente"]).select("id", "fuente", "prioridad")


_ASKED = (
    f"{_ROWS}, q AS (SELECT DISTINCT conferencia_id || '-h' || hilo || '-t' || orden AS id FROM r WHERE rol = 'pregunta' AND NOT coalesce(ruido, false) "
    "AND length(texto) >= 12)"
)


def _asked(spark, d):
    q = _rows(spark, d).where("rol = 'pregunta' and not coalesce(ruido, false) and length(texto) >= 12")
    return q.select(F.concat("conferencia_id", F.lit("-h"), "hilo", F.lit("-t"), "orden").alias("id")).distinct()


@query(f"""WITH {_ASKED}, k AS (SELECT DISTINCT regexp_replace(id_pregunta, '^(.+?)-h[0-9]+-t([0-9]+)$', '\\1-t\\2') AS s FROM clasificaciones)
SELECT id FROM q WHERE regexp_replace(id, '^(.+?)-h[0-9]+-t([0-9]+)$', '\\1-t\\2') NOT IN (SELECT s FROM k)""")
def pending_anti(spark, d):
    """Questions without a label, by stable key."""
    done = table(spark, d, "clasificaciones").select(F.col("id_pregunta").alias("id"))
    return lineage.pending(_asked(spark, d), done, stable=True)


@query(f"""WITH {_ASKED}, o AS (SELECT DISTINCT CASE WHEN hash_ THEN regexp_replace(id_pregunta, '-h([0-9]+)-', '-h9\\1-') ELSE id_pregunta END AS id FROM
  (SELECT id_pregunta, length(id_pregunta) % 2 = 0 AS hash_ FROM clasificaciones)),
c AS (SELECT min(id) AS id, regexp_replace(id, '^(.+?)-h[0-9]+-t([0-9]+)$', '\\1-t\\2') AS s FROM q GROUP BY 2)
SELECT o.id, CASE WHEN q.id IS NOT NULL THEN 'intacto' WHEN c.id IS NOT NULL THEN 'recuperado' ELSE 'perdido' END AS estado, coalesce(q.id, c.id, o.id) AS id_actual
FROM o LEFT JOIN q ON o.id = q.id LEFT JOIN c ON regexp_replace(o.id, '^(.+?)-h[0-9]+-t([0-9]+)$', '\\1-t\\2') = c.s""")
def remap_stable_key(spark, d):
    """Labels under moved thread numbers, found again by their stable key."""
    moved = F.when(F.length("id_pregunta") % 2 == 0, F.regexp_replace("id_pregunta", "-h([0-9]+)-", "-h9$1-")).otherwise(F.col("id_pregunta"))
    old = table(spark, d, "clasificaciones").select(moved.alias("id")).distinct()
    return lineage.remap(old, _asked(spark, d))


@query(f"""WITH {_ASKED}, l AS (SELECT id_pregunta AS id, categoria, recibido_en AS ts FROM clasificaciones)
SELECT q.id, arg_max(l.categoria, struct_pack(a := l.ts, b := coalesce(l.categoria, ''))) AS categoria FROM l JOIN q USING (id) WHERE l.categoria IS NOT NULL GROUP BY 1""")
def ledger_rebuild(spark, d):
    """The last label of each current question, orphans left out."""
    ledger = table(spark, d, "clasificaciones").where("categoria is not null").select(F.col("id_pregunta").alias("id"), "categoria", F.col("recibido_en").alias("ts"))
    return lineage.rebuild(ledger, _asked(spark, d)).select("id", "categoria")


# ---- votes, samples, encodings --------------------------------------------------------------------------------------


_VOTES = (
    "w AS (SELECT id_pregunta, pasada, nullif(regexp_replace(trim(regexp_replace(strip_accents(lower(replace(postura, '_', ' '))), '[^a-z0-9]+', ' ', 'g')), '^$', ''), '') AS p, "
    "recibido_en FROM posturas WHERE postura IS NOT NULL), x AS (SELECT id_pregunta, pasada, arg_max(p, struct_pack(a := recibido_en, b := p)) AS p FROM w GROUP BY 1, 2), "
    "n AS (SELECT id_pregunta, p, count(*) AS n FROM x GROUP BY 1, 2)"
)


def _votes(spark, d):
    label = text.plain_words(F.regexp_replace("postura", "_", " "))
    rows = table(spark, d, "posturas").where("postura is not null").withColumn("p", label)
    return rows.groupBy("id_pregunta", "pasada").agg(F.max(F.struct("recibido_en", "p")).getField("p").alias("p"))


@query(f"""WITH {_VOTES} SELECT id_pregunta, cast(sum(n) AS bigint) AS votos, CASE WHEN max(n) * 2 > sum(n) THEN arg_max(p, n) END AS consenso, count(*) = 1 AS unanime FROM n GROUP BY 1""")
def consensus_votes(spark, d):
    """Strict majority of the labels of each question."""
    return agg.vote(_votes(spark, d), "id_pregunta", "p")


@query(f"""WITH {_VOTES} SELECT pasada, count(*) AS n, count(*) FILTER (WHERE p <> 'no clasificable') AS base, count(*) FILTER (WHERE p = 'critica') AS criticas,
  round(count(*) FILTER (WHERE p = 'critica') / nullif(count(*) FILTER (WHERE p <> 'no clasificable'), 0), 6) AS cuota FROM x GROUP BY 1""")
def stance_counts(spark, d):
    """Labels by pass, with the base that can be classified."""
    v = _votes(spark, d)
    critical, base = F.count_if(F.col("p") == "critica"), F.count_if(F.col("p") != "no clasificable")
    return v.groupBy("pasada").agg(F.count("*").alias("n"), base.alias("base"), critical.alias("criticas"), F.round(F.try_divide(critical, base), 6).alias("cuota"))


@query("SELECT doc_id, source FROM documents ORDER BY md5(doc_id || '|' || '7'), doc_id LIMIT 100")
def hash_sample(spark, d):
    """A reproducible sample of a hundred documents."""
    return agg.hash_sample(table(spark, d, "documents").select("doc_id", "source"), ["doc_id"], 100, "7")


@query("""WITH k AS (SELECT greatest(2, 60 // count(DISTINCT coalesce(lang, '?'))) AS k FROM documents),
r AS (SELECT doc_id, coalesce(lang, '?') AS lang, row_number() OVER (PARTITION BY coalesce(lang, '?') ORDER BY md5(doc_id || '|' || '3'), doc_id) AS n FROM documents)
SELECT doc_id, lang FROM r, k WHERE n <= k""")
def stratified_sample(spark, d):
    """A reproducible sample by language."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"))
    return agg.stratified_sample(rows, ["doc_id"], "lang", 60, "3")


@query(f"""WITH {_H}, p AS (SELECT periodista_canonico AS v, row_number() OVER (ORDER BY periodista_canonico) - 1 AS k FROM (SELECT DISTINCT periodista_canonico FROM h
  WHERE periodista_canonico IS NOT NULL)) SELECT conferencia_id, hilo, cast(k AS int) AS periodista FROM h LEFT JOIN p ON h.periodista_canonico = p.v""")
def dictionary_export(spark, d):
    """Threads with reporters as dictionary codes."""
    rows = _threads(spark, d).select("conferencia_id", "hilo", "periodista_canonico")
    coded = agg.dictionary_encode(rows, "periodista_canonico", "periodista")
    return coded.select("conferencia_id", "hilo", F.col("periodista").cast("int").alias("periodista"))


@query("""SELECT conferencia_id, strftime(fecha, '%Y-%m') AS mes, CASE WHEN fecha IS NULL THEN NULL ELSE fecha END AS fecha FROM (SELECT DISTINCT conferencia_id, fecha FROM conferencias)""")
def slug_dates(spark, d):
    """Dates read from slugs made of the conferences' dates."""
    names = {n: m for m, n in dates.MONTHS.items() if m != "setiembre"}
    month = F.create_map(*[x for n, m in names.items() for x in (F.lit(n), F.lit(m))])[F.month("fecha")]
    rows = table(spark, d, "conferencias").select("conferencia_id", "fecha").distinct()
    slug = F.concat(F.lit("conferencia-del-"), F.dayofmonth("fecha"), F.lit("-de-"), month, F.lit("-de-"), F.year("fecha"), F.lit("?idiom=es"))
    found = rows.withColumn("fecha", dates.date_of_slug(slug))
    return found.select("conferencia_id", F.date_format("fecha", "yyyy-MM").alias("mes"), "fecha")


def _hits(words: list[str]) -> str:
    return " + ".join(f"(length(b) - length(replace(b, '{w}', ''))) // {len(w)}" for w in words)


_SCORES = (
    f"{_hits(['puente', 'presa', 'carretera', 'línea'])} AS obra, {_hits(['hospital', 'vacuna', 'medic'])} AS salud, {_hits(['millones', 'pesos', 'costo'])} AS dinero"
)
_FIRST = "CASE WHEN greatest(obra, salud, dinero) = 0 THEN NULL WHEN {0} = greatest(obra, salud, dinero) THEN '{0}' WHEN obra = greatest(obra, salud, dinero) THEN 'obra' ELSE '{1}' END"


@query(f"""WITH {_ROWS}, b AS (SELECT lower(coalesce(texto, '')) AS b FROM r WHERE rol = 'pregunta'), s AS (SELECT b, {_SCORES} FROM b),
x AS (SELECT 0 AS pasada, b, {_FIRST.format('dinero', 'salud')} AS e FROM s UNION ALL SELECT 1, b, {_FIRST.format('salud', 'dinero')} FROM s)
SELECT pasada, CASE WHEN length(b) >= 12 THEN e END AS etiqueta, CASE WHEN length(b) < 12 THEN 'texto demasiado corto' END AS razon, count(*) AS n FROM x GROUP BY 1, 2, 3""")
def local_labels(spark, d):
    """Questions labelled by the local classifier, with reasons for rejects."""
    ask = classify.keyword_labeller({"obra": ["puente", "presa", "carretera", "línea"], "salud": ["hospital", "vacuna", "medic"], "dinero": ["millones", "pesos", "costo"]})
    q = _rows(spark, d).where("rol = 'pregunta'").withColumn("id", F.concat("conferencia_id", F.lit("-h"), "hilo", F.lit("-t"), "orden"))
    out = classify.label_texts(q, "id", "texto", ask, ["obra", "salud", "dinero"], passes=2)
    return out.groupBy("pasada", "etiqueta", "razon").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    """Quantity and revenue by flag and status."""
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
    )


from hemerion.plans import report_queries  # noqa: E402,F401  (registers its queries)
