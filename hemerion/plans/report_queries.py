"""Registered queries of threads, joins, reports, samples and checks, each over its whole tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hemerion.functions import dates, rules, text
from hemerion.operators import aggregates as agg
from hemerion.operators import classify, documents, entities, identity, lineage, mining, search, sessions, similarity
from hemerion.plans.core_queries import (
    _C, _COURTESIES, _E, _EX, _FIRST, _FLAT, _FOLD, _FOUND, _H, _LAYER, _PKEY, _QT, _ROWS, _SCORES, _SHOUTED, _T, _exchanges, _labelled_questions, _labels, _OUTLETS, _rows, _threads, _turns, _votes, _VOTES,
)
from hemerion.plans.registry import ORACLES, query
from hemerion.session import ensure_checkpoint_dir, table

# ---- threads ---------------------------------------------------------------------------------

#: Openers of stored threads: their first turn, with the identity they carry.
_OPEN = (
    "o AS (SELECT conferencia_id, min(orden) AS orden, min(periodista) AS periodista, min(medio) AS medio, min(metodo) AS metodo FROM (SELECT conferencia_id, hilo, "
    "periodista, medio, metodo_identificacion AS metodo, unnest(turnos).orden AS orden FROM h) GROUP BY conferencia_id, hilo)"
)


def _openers(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "hilos").dropDuplicates(["conferencia_id", "hilo"])
    turns = once.select("conferencia_id", "hilo", "periodista", "medio", F.col("metodo_identificacion").alias("metodo"), F.explode("turnos.orden").alias("orden"))
    return turns.groupBy("conferencia_id", "hilo").agg(
        F.min("orden").alias("orden"), F.min("periodista").alias("periodista"), F.min("medio").alias("medio"), F.min("metodo").alias("metodo")).drop("hilo")


@query(f"""WITH {_T}, {_H}, {_OPEN}, {_COURTESIES},
n AS (SELECT *, sum(CASE WHEN tipo = 'funcionario' THEN 1 ELSE 0 END) OVER (PARTITION BY conferencia_id ORDER BY orden ROWS UNBOUNDED PRECEDING) AS racha FROM t),
p AS (SELECT conferencia_id, orden, count(*) OVER w >= 2 AND max(length(coalesce(texto, ''))) OVER w <= 200 AS incierta FROM n WHERE tipo = 'prensa'
  WINDOW w AS (PARTITION BY conferencia_id, racha)),
a AS (SELECT t.*, coalesce(p.incierta, false) AS incierta, o.metodo, o.periodista, o.medio, t.tipo = 'prensa' AND (o.metodo = 'manual' OR (o.periodista IS NOT NULL
  AND NOT coalesce(p.incierta, false))) IS TRUE AS abre FROM t LEFT JOIN p USING (conferencia_id, orden) LEFT JOIN o USING (conferencia_id, orden)),
k AS (SELECT *, sum(CASE WHEN abre THEN 1 ELSE 0 END) OVER (PARTITION BY conferencia_id ORDER BY orden ROWS UNBOUNDED PRECEDING) - 1 AS hilo FROM a),
i AS (SELECT conferencia_id, hilo, periodista, medio, metodo FROM k WHERE abre),
u AS (SELECT k.conferencia_id, k.orden, cast(k.hilo AS int) AS hilo, i.periodista, i.medio, i.metodo, CASE WHEN tipo = 'funcionario' THEN 'respuesta' ELSE 'pregunta' END AS rol,
  CASE WHEN abre OR tipo = 'funcionario' THEN 'declarada' WHEN incierta OR tipo = 'anonimo' THEN 'incierta' ELSE 'propagada' END AS atribucion, tipo, hablante
  FROM k JOIN i USING (conferencia_id, hilo) WHERE k.hilo >= 0)
SELECT u.conferencia_id, u.orden, hilo, periodista, medio, metodo, rol, atribucion, ruido,
  CASE WHEN tipo = 'funcionario' THEN hablante WHEN atribucion = 'incierta' THEN NULL ELSE periodista END AS quien FROM u JOIN ru USING (conferencia_id, orden)""")
def thread_rebuild(spark, d):
    """Threads from introductions, uncertain runs and manual rows: identity, role, speaker, attribution and noise of every turn."""
    opened = _openers(spark, d)
    manual = opened.where("metodo = 'manual'").select("conferencia_id", "orden", "periodista", "medio")
    said = opened.where("metodo <> 'manual'").select("conferencia_id", "orden", "periodista", "medio")
    built = sessions.build_threads(_turns(spark, d), said, manual)
    return built.select("conferencia_id", "orden", "hilo", "periodista", "medio", "metodo", "rol", "atribucion", "ruido", "quien")


@query()
def thread_build(spark, d):
    """Threads from the transcripts alone: introductions of a first pass, the names heard in it for a second, manual rows over both."""
    turns = _turns(spark, d)
    press = turns.where("tipo = 'prensa'")
    heard = identity.introductions(press, ["conferencia_id", "orden"], "texto").where("periodista is not null").select("periodista")
    said = identity.introductions(press, ["conferencia_id", "orden"], "texto", heard)
    manual = _openers(spark, d).where("metodo = 'manual'").select("conferencia_id", "orden", "periodista", "medio")
    nested = sessions.nested_threads(sessions.build_threads(turns, said, manual))
    return nested.select("conferencia_id", "hilo", "periodista", "medio", "metodo_identificacion", F.size("turnos").alias("turnos"))


@query(f"""WITH {_T}, {_H}, {_OPEN}, m AS (SELECT conferencia_id, orden, periodista FROM o WHERE metodo = 'manual' UNION ALL SELECT conferencia_id, orden + 1, periodista FROM o)
SELECT DISTINCT m.* FROM m ANTI JOIN (SELECT conferencia_id, orden FROM t WHERE tipo = 'prensa') p USING (conferencia_id, orden)""")
def manual_unused(spark, d):
    """Manual rows, here also ones a turn too late, that opened no thread."""
    opened = _openers(spark, d)
    late = opened.select("conferencia_id", (F.col("orden") + 1).alias("orden"), "periodista")
    manual = opened.where("metodo = 'manual'").select("conferencia_id", "orden", "periodista").unionByName(late)
    return sessions.unused_manual(_turns(spark, d), manual).distinct()


@query(f"""WITH RECURSIVE {_ROWS}, n AS (SELECT *, length(coalesce(texto, '')) AS l, row_number() OVER (PARTITION BY conferencia_id, hilo ORDER BY orden) AS k FROM r),
p AS (SELECT a.conferencia_id, a.hilo, a.orden, a.texto, a.rol, b.l, b.k - a.k AS delante FROM n a LEFT JOIN n b
  ON a.conferencia_id = b.conferencia_id AND a.hilo = b.hilo AND b.k BETWEEN a.k + 1 AND a.k + 4),
s AS (SELECT *, sum(l) OVER (PARTITION BY conferencia_id, hilo, orden ORDER BY delante ROWS UNBOUNDED PRECEDING) AS suma, NOT regexp_matches(trim(coalesce(texto, '')), '[.?!…]$') AS corta FROM p)
SELECT conferencia_id, hilo, orden, cast(CASE WHEN any_value(corta) THEN count(*) FILTER (WHERE suma <= 600) ELSE count(*) FILTER (WHERE delante = 1) END AS int) AS siguientes,
  cast(coalesce(CASE WHEN any_value(corta) THEN max(suma) FILTER (WHERE suma <= 600) ELSE max(l) FILTER (WHERE delante = 1) END, 0) AS int) AS caracteres_siguientes
FROM s WHERE rol = 'pregunta' GROUP BY conferencia_id, hilo, orden""")
def context_next(spark, d):
    """What follows a question: the next turn, or more where the question breaks off."""
    found = sessions.next_context(_rows(spark, d)).where("rol = 'pregunta'")
    return found.select("conferencia_id", "hilo", "orden", "siguientes", "caracteres_siguientes")


# ---- joins -----------------------------------------------------------------------------------


@query(f"""WITH {_ROWS}, {_E}, {_EX}, k AS (SELECT regexp_extract(id_pregunta, '^(.+)-h[0-9]+-t([0-9]+)$', 1) AS conferencia_id, cast(regexp_extract(id_pregunta, '-t([0-9]+)$', 1) AS int) AS orden,
  categoria, asunto, recibido_en FROM clasificaciones), c AS (SELECT conferencia_id, orden, arg_max(struct_pack(categoria := categoria, asunto := asunto),
  struct_pack(a := recibido_en, b := coalesce(categoria, ''), c := coalesce(asunto, ''))) AS z FROM k GROUP BY 1, 2),
q AS (SELECT regexp_extract(id_pregunta, '^(.+)-h[0-9]+-t([0-9]+)$', 1) AS conferencia_id, cast(regexp_extract(id_pregunta, '-t([0-9]+)$', 1) AS int) AS orden, postura, pasada, recibido_en FROM posturas),
p AS (SELECT conferencia_id, orden, arg_max(coalesce(postura, '-'), struct_pack(a := recibido_en, b := pasada, c := coalesce(postura, '-'))) AS postura FROM q GROUP BY 1, 2),
w AS (SELECT conferencia_id, min(doc_id) AS url FROM documents WHERE conferencia_id IS NOT NULL GROUP BY 1)
SELECT e.conferencia_id, e.hilo, e.orden, c.z.categoria AS categoria, c.z.asunto AS asunto, p.postura, w.url FROM e LEFT JOIN c USING (conferencia_id, orden)
LEFT JOIN p USING (conferencia_id, orden) LEFT JOIN w USING (conferencia_id)""")
def exchange_attachments(spark, d):
    """Exchanges with topic, stance and source document, by the key that outlives thread numbers; the last record counts."""
    conf = F.regexp_extract("id_pregunta", "^(.+)-h\\d+-t(\\d+)$", 1).alias("conferencia_id")
    order = F.regexp_extract("id_pregunta", "-t(\\d+)$", 1).cast("int").alias("orden")
    topics = table(spark, d, "clasificaciones").select(
        conf, order, "categoria", "asunto", F.struct("recibido_en", F.coalesce("categoria", F.lit("")), F.coalesce("asunto", F.lit(""))).alias("seq"))
    said = F.coalesce("postura", F.lit("-"))
    stances = table(spark, d, "posturas").select(conf, order, said.alias("postura"), F.struct("recibido_en", "pasada", said).alias("seq"))
    found = sessions.with_attachments(_exchanges(spark, d), (topics, "seq", ["categoria", "asunto"]), (stances, "seq", ["postura"]))
    urls = table(spark, d, "documents").where("conferencia_id is not null").groupBy("conferencia_id").agg(F.min("doc_id").alias("url"))
    return found.join(urls, "conferencia_id", "left").select("conferencia_id", "hilo", "orden", "categoria", "asunto", "postura", "url")


_SIMPLE = "list_filter(list_transform(regexp_split_to_array({0}, '[;|/]'), lambda x: trim(x)), lambda x: x <> '')"
_NAMED = f"n AS (SELECT conferencia_id, hilo, unnest(p) AS name, unnest(range(len(p))) AS lugar FROM (SELECT conferencia_id, hilo, {_SIMPLE.format('medio')} AS p FROM h WHERE trim(medio) <> ''))"
_KEY3 = (
    "regexp_replace(regexp_replace(regexp_replace({0}, '^(?:el|la|los|las) ', ''), '^(?:revista|periodico|portal|semanario|agencia|sitio) ', ''), '^(?:el|la|los|las) ', '')"
)
_CHOSEN = (
    f"f AS (SELECT name, count(*) AS n, {_FLAT.format('name')} AS p FROM n GROUP BY name), k AS (SELECT *, replace(coalesce(nullif({_KEY3.format('p')}, ''), p), ' ', '') AS key, "
    "len(list_filter(regexp_split_to_array(trim(name), '\\s+'), lambda w: regexp_matches(w, '^\\p{Lu}') AND NOT list_contains(['de', 'del', 'la', 'las', 'el', 'los', 'y', 'e', 'en', "
    "'para', 'por', 'a', 'con'], lower(w)))) AS caps FROM f), b AS (SELECT key, arg_min(name, struct_pack(a := -caps, b := -n, c := name)) AS best FROM k GROUP BY key "
    "HAVING bool_or(regexp_matches(name, '\\p{Lu}'))), c AS (SELECT k.name, upper(left(best, 1)) || substr(best, 2) AS canonico FROM k JOIN b USING (key))"
)


def _simple_outlets(spark, d):
    pieces = F.filter(F.transform(F.split("medio", "[;|/]"), lambda x: F.trim(x)), lambda x: x != "")
    return _threads(spark, d).where("trim(medio) <> ''").withColumn("__p", pieces)


@query(f"WITH {_H}, {_NAMED}, {_CHOSEN} SELECT name, canonico FROM c")
def outlet_votes(spark, d):
    """Outlets between signs, with the best capitalised, then most frequent spelling of their key."""
    counts = _simple_outlets(spark, d).select(F.explode("__p").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return entities.outlet_votes(counts, "name", "n")


ORACLES["outlet_canonical"] = f"WITH {_H}, {_OUTLETS}, {_CHOSEN} SELECT name, canonico FROM c"


@query(f"""WITH {_H}, {_NAMED}, {_CHOSEN}, j AS (SELECT conferencia_id, hilo, canonico, min(lugar) AS lugar FROM n JOIN c USING (name) GROUP BY 1, 2, 3)
SELECT conferencia_id, hilo, string_agg(canonico, '; ' ORDER BY lugar) AS medios FROM j GROUP BY 1, 2""")
def thread_outlets(spark, d):
    """Threads with their canonical outlets in order; outlets without one are left out."""
    rows = _simple_outlets(spark, d)
    counts = rows.select(F.explode("__p").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    found = entities.with_outlets(rows, ["conferencia_id", "hilo"], F.col("__p"), entities.outlet_votes(counts, "name", "n"))
    return found.select("conferencia_id", "hilo", F.array_join("medios", "; ").alias("medios"))


@query(f"""WITH {_H}, m AS (SELECT periodista AS name, arg_min(periodista_canonico, struct_pack(a := -n, b := periodista_canonico)) AS canonico FROM (SELECT periodista, periodista_canonico,
  count(*) AS n FROM h WHERE periodista IS NOT NULL AND periodista_canonico IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT h.conferencia_id, h.hilo, coalesce(m.canonico, h.periodista) AS periodista FROM h LEFT JOIN m ON h.periodista = m.name""")
def thread_names(spark, d):
    """Threads with the canonical name of their reporter, by default the name as heard."""
    h = _threads(spark, d).drop("periodista_canonico")
    known = agg.modal(_threads(spark, d).where("periodista is not null"), "periodista", "periodista_canonico")
    mapped = known.select(F.col("periodista").alias("name"), F.col("periodista_canonico").alias("canonico"))
    return entities.with_names(h, mapped).select("conferencia_id", "hilo", F.col("periodista_canonico").alias("periodista"))


@query(f"""WITH {_C}, x AS (SELECT categoria FROM c WHERE categoria IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, categoria LIMIT 6)
SELECT x.categoria, count(*) AS n FROM c LEFT JOIN x USING (categoria) GROUP BY 1""")
def category_in_taxonomy(spark, d):
    """Labels by category; one that the taxonomy (here the six most frequent) doesn't hold counts as none."""
    c = _labels(spark, d)
    taxonomy = c.where("categoria is not null").groupBy("categoria").count().orderBy(F.desc("count"), "categoria").limit(6).select(F.col("categoria").alias("clave"))
    known = c.join(taxonomy, F.col("categoria") == F.col("clave"), "left")
    return known.groupBy(F.col("clave").alias("categoria")).agg(F.count("*").alias("n"))


_MAPPED = (
    "m AS (SELECT asunto, arg_min(asunto_canonico, struct_pack(a := -n, b := asunto_canonico)) AS canonico FROM (SELECT asunto, asunto_canonico, count(*) AS n FROM c "
    "WHERE asunto <> '' AND asunto_canonico <> '' GROUP BY 1, 2) GROUP BY 1)"
)
_META = (
    "(len(list_filter(['pregunta incompleta', 'pregunta no formulada', 'no es una pregunta', 'comentario periodista', 'comentario de periodista', 'comentario informal periodista', "
    "'comentario incompleto periodista', 'comentario deportivo periodista', 'agradecimiento', 'turno de palabra', 'no aplica', 'no_aplica', 'sin contexto', 'informacion insuficiente', 'saludo', "
    f"'despedida', 'fragmento'], lambda x: contains({_FOLD.format('c.asunto')}, x))) > 0)"
)


def _subject_map(c: DataFrame) -> DataFrame:
    known = agg.modal(c.where("asunto <> '' and asunto_canonico <> ''"), "asunto", "asunto_canonico")
    return known.select("asunto", F.col("asunto_canonico").alias("canonico"))


@query(f"""WITH {_C}, {_MAPPED} SELECT c.id_pregunta, CASE WHEN NOT {_META} THEN nullif(coalesce(m.canonico, c.asunto), '') END AS legible,
  CASE WHEN {_META} THEN 'sin asunto' ELSE c.asunto END AS cubeta FROM c LEFT JOIN m USING (asunto)""")
def subject_legible(spark, d):
    """Labels with their canonical subject, by default their own, null where it is none; such subjects share one bucket."""
    c = _labels(spark, d)
    joined = c.join(_subject_map(c), "asunto", "left")
    return joined.select("id_pregunta", rules.legible_subject(F.col("asunto"), F.col("canonico")).alias("legible"), rules.bucketed_subject(F.col("asunto"), "sin asunto").alias("cubeta"))


@query(f"""WITH {_C}, {_MAPPED}, g AS (SELECT m.canonico, c.asunto, count(*) AS n, count(DISTINCT substr(id_pregunta, 1, 10)) AS dias, min(substr(id_pregunta, 1, 10)) AS a, max(substr(id_pregunta, 1, 10)) AS b
  FROM c JOIN m USING (asunto) GROUP BY 1, 2) SELECT canonico, count(*) AS variantes, cast(sum(n) AS bigint) AS n, min(a) AS desde, max(b) AS hasta FROM g GROUP BY 1 HAVING count(*) > 1""")
def consolidation_report(spark, d):
    """Canonical subjects that stand for several: variants, questions and span."""
    c = _labels(spark, d)
    day = F.substring("id_pregunta", 1, 10)
    g = c.join(_subject_map(c), "asunto").groupBy("canonico", "asunto").agg(F.count("*").alias("n"), F.min(day).alias("a"), F.max(day).alias("b"))
    return g.groupBy("canonico").agg(F.count("*").alias("variantes"), F.sum("n").alias("n"), F.min("a").alias("desde"), F.max("b").alias("hasta")).where("variantes > 1")


@query(f"""WITH b AS (SELECT DISTINCT puente_id, medio_hablado, confianza, {_PKEY.format('medio_hablado')} AS k FROM puente_medios WHERE medio_hablado IS NOT NULL)
SELECT puente_id, medio_hablado FROM b WHERE confianza = 'pendiente' AND k NOT IN (SELECT k FROM b WHERE confianza <> 'pendiente')""")
def bridge_pending(spark, d):
    """Bridge rows still pending whose outlet isn't paired elsewhere."""
    key = F.array(F.replace(text.plain_words(F.col("medio_hablado")), F.lit(" "), F.lit("")))
    bridge = table(spark, d, "puente_medios").where("medio_hablado is not null").select("puente_id", "medio_hablado", "confianza").distinct().withColumn("k", key)
    return entities.pending_bridge(bridge, "puente_id", "k", F.col("confianza") == "pendiente").select("puente_id", "medio_hablado")


_LAST = "m AS (SELECT id_pregunta, arg_max(postura, struct_pack(a := recibido_en, b := pasada, c := postura)) AS modelo FROM posturas WHERE postura IS NOT NULL GROUP BY 1)"
_BUSY = "l AS (SELECT periodista FROM h WHERE periodista IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)"


@query(f"""WITH {_ROWS}, {_LAST}, {_BUSY}, q AS (SELECT conferencia_id || '-h' || hilo || '-t' || orden AS id_pregunta, periodista FROM r WHERE rol = 'pregunta' AND NOT coalesce(ruido, false))
SELECT q.id_pregunta, m.modelo, l.periodista IS NOT NULL AS en_lista FROM q LEFT JOIN m USING (id_pregunta) LEFT JOIN l ON q.periodista = l.periodista""")
def stance_flagged(spark, d):
    """Questions with the model's last stance and whether the reporter is on a list (here, those of five threads or more)."""
    p = table(spark, d, "posturas").where("postura is not null")
    model = p.groupBy("id_pregunta").agg(F.max_by("postura", F.struct("recibido_en", "pasada", "postura")).alias("modelo"))
    listed = _threads(spark, d).where("periodista is not null").groupBy("periodista").count().where("count >= 5").select("periodista", F.lit(True).alias("__l"))
    q = _rows(spark, d).where("rol = 'pregunta' and not coalesce(ruido, false)").withColumn("id_pregunta", F.concat("conferencia_id", F.lit("-h"), "hilo", F.lit("-t"), "orden"))
    joined = q.select("id_pregunta", "periodista").join(model, "id_pregunta", "left").join(listed, "periodista", "left")
    return joined.select("id_pregunta", "modelo", F.coalesce("__l", F.lit(False)).alias("en_lista"))


_RULE = f"regexp_matches({_FOLD.format('texto')}, '\\bdenunci|\\breclam|\\bno les pagan\\b')"


@query(f"""WITH {_ROWS}, {_LAST}, q AS (SELECT conferencia_id || '-h' || hilo || '-t' || orden AS id_pregunta, {_RULE} AS regla FROM r WHERE rol = 'pregunta' AND NOT coalesce(ruido, false))
SELECT coalesce(modelo, 'sin etiqueta') AS modelo, count(*) AS n, count(*) FILTER (WHERE regla) AS por_regla, count(*) FILTER (WHERE regla AND modelo IS DISTINCT FROM 'crítica') AS cambian
FROM q LEFT JOIN m USING (id_pregunta) GROUP BY 1""")
def stance_flips(spark, d):
    """How many of the model's stances a rule decides, and how many it changes."""
    p = table(spark, d, "posturas").where("postura is not null")
    model = p.groupBy("id_pregunta").agg(F.max_by("postura", F.struct("recibido_en", "pasada", "postura")).alias("modelo"))
    q = _rows(spark, d).where("rol = 'pregunta' and not coalesce(ruido, false)")
    fired = F.array_contains(rules.fired_rules(F.col("texto"), _LAYER), "denuncia")
    q = q.select(F.concat("conferencia_id", F.lit("-h"), "hilo", F.lit("-t"), "orden").alias("id_pregunta"), fired.alias("regla")).join(model, "id_pregunta", "left")
    return q.groupBy(F.coalesce("modelo", F.lit("sin etiqueta")).alias("modelo")).agg(
        F.count("*").alias("n"), F.count_if("regla").alias("por_regla"), F.count_if(F.col("regla") & ~F.col("modelo").eqNullSafe("crítica")).alias("cambian"))


_ASKED_IDS = f"{_ROWS}, q AS (SELECT DISTINCT conferencia_id || '-h' || hilo || '-t' || orden AS id, conferencia_id, orden, texto, atribucion, periodista, medio FROM r WHERE rol = 'pregunta' AND NOT coalesce(ruido, false) AND length(texto) >= 12)"


def _asked(spark, d):
    q = _rows(spark, d).where("rol = 'pregunta' and not coalesce(ruido, false) and length(texto) >= 12")
    return q.select(F.concat("conferencia_id", F.lit("-h"), "hilo", F.lit("-t"), "orden").alias("id"), "conferencia_id", "orden", "texto", "atribucion", "periodista", "medio").distinct()


@query(f"""WITH {_ASKED_IDS}, g AS (SELECT id FROM q ORDER BY md5(id || '|' || 'oro'), id LIMIT 120), e AS (SELECT id FROM g ORDER BY md5(id || '|' || 'ejemplo'), id LIMIT 20)
SELECT id, 'evaluar' AS uso FROM g ANTI JOIN e USING (id) UNION ALL SELECT id, 'ejemplo' FROM e""")
def lot_restriction(spark, d):
    """A coded lot without the questions that serve as examples, and the examples."""
    gold = agg.hash_sample(_asked(spark, d).select("id"), ["id"], 120, "oro")
    examples = agg.hash_sample(gold, ["id"], 20, "ejemplo")
    judged = gold.join(examples, "id", "left_anti").withColumn("uso", F.lit("evaluar"))
    return judged.unionByName(gold.join(examples, "id", "left_semi").withColumn("uso", F.lit("ejemplo")))


# ---- reports ---------------------------------------------------------------------------------


@query(f"""WITH {_H}, x AS (SELECT * FROM h WHERE substr(conferencia_id, 1, 10) <= '2025-06-30') SELECT periodista_canonico AS periodista, count(*) AS hilos,
  max(substr(conferencia_id, 1, 10)) AS ultima FROM x WHERE periodista_canonico IS NOT NULL GROUP BY 1""")
def activity_until_cut(spark, d):
    """Threads by reporter up to a cut date, the cut's day included."""
    h = search.until(_threads(spark, d), F.substring("conferencia_id", 1, 10), "2025-06-30").where("periodista_canonico is not null")
    return h.groupBy(F.col("periodista_canonico").alias("periodista")).agg(F.count("*").alias("hilos"), F.max(F.substring("conferencia_id", 1, 10)).alias("ultima"))


@query(f"""WITH {_ROWS}, {_E}, {_EX}, g AS (SELECT e.*, h.medio FROM e JOIN h USING (conferencia_id, hilo) WHERE regexp_matches({_FOLD.format('pregunta')}, '\\bpresa\\b|\\bcosto\\b'))
SELECT coalesce(periodista, 'sin identificar') AS periodista, coalesce(CASE WHEN periodista IS NOT NULL THEN medio END, '') AS medio, count(*) AS n FROM g GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15""")
def search_top_reporters(spark, d):
    """The fifteen reporters and outlets with most hits of a search."""
    e = sessions.exchanges(_rows(spark, d))
    hits = e.where(search.matches(F.col("pregunta"), any_of=["presa", "costo"]))
    who, where = F.coalesce("periodista", F.lit("sin identificar")), F.coalesce(F.when(F.col("periodista").isNotNull(), F.col("medio")), F.lit(""))
    return hits.groupBy(who.alias("periodista"), where.alias("medio")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "periodista", "medio").limit(15)


@query(f"""WITH {_QT} SELECT coalesce(asunto_canonico, asunto) AS asunto, count(*) AS n FROM j WHERE regexp_matches({_FOLD.format('texto')}, '\\bpresa\\b|\\bcosto\\b')
AND coalesce(asunto_canonico, asunto, '') <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 60""")
def search_top_subjects(spark, d):
    """The sixty most frequent subjects of a search's hits."""
    j = _labelled_questions(spark, d).withColumn("asunto", F.coalesce("asunto_canonico", "asunto")).where("asunto <> ''")
    hits = j.where(search.matches(F.col("texto"), any_of=["presa", "costo"]))
    return hits.groupBy("asunto").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "asunto").limit(60)


@query(f"""WITH {_ROWS}, {_E}, {_EX}, x AS (SELECT e.*, h.medio FROM e JOIN h USING (conferencia_id, hilo)) SELECT conferencia_id, hilo, orden FROM x
WHERE regexp_matches(coalesce((SELECT string_agg({_FOLD.format('v.texto')}, chr(10)) FROM v WHERE v.conferencia_id = x.conferencia_id AND v.hilo = x.hilo AND v.intercambio = x.intercambio
  AND v.rol <> 'pregunta' AND {_FOLD.format('v.quien')} LIKE '%mar%'), ''), '\\bel\\b|\\bla\\b') AND {_FOLD.format('CASE WHEN periodista IS NOT NULL THEN medio END')} LIKE '%a%'""")
def search_answers(spark, d):
    """Exchanges by outlet and by what one responder said; only that person's answers are searched."""
    e = sessions.exchanges(_rows(spark, d))
    e = e.withColumn("medio", F.when(F.col("periodista").isNotNull(), F.col("medio")))
    return search.search(e, any_of=["el", "la"], scope="respuesta", outlet="a", responder="mar").select("conferencia_id", "hilo", "orden")


_CARD = (
    "k AS (SELECT periodista_canonico AS periodista, count(*) AS hilos, count(DISTINCT substr(conferencia_id, 1, 10)) AS fechas, count(DISTINCT substr(conferencia_id, 1, 7)) AS meses, "
    "min(substr(conferencia_id, 1, 10)) AS primera, max(substr(conferencia_id, 1, 10)) AS ultima FROM h WHERE periodista_canonico IS NOT NULL GROUP BY 1), "
    "q AS (SELECT periodista_canonico AS periodista, count(*) AS preguntas FROM r WHERE rol = 'pregunta' AND NOT coalesce(ruido, false) AND periodista_canonico IS NOT NULL GROUP BY 1), "
    "o AS (SELECT periodista_canonico AS periodista, medio FROM h WHERE periodista_canonico IS NOT NULL AND medio IS NOT NULL GROUP BY 1, 2 "
    "QUALIFY row_number() OVER (PARTITION BY periodista_canonico ORDER BY count(*) DESC, medio) = 1)"
)


def _cards(spark, d):
    h = _threads(spark, d).where("periodista_canonico is not null").withColumnRenamed("periodista", "__heard").withColumnRenamed("periodista_canonico", "periodista")
    day = F.substring("conferencia_id", 1, 10)
    card = h.groupBy("periodista").agg(
        F.count("*").alias("hilos"), F.countDistinct(day).alias("fechas"), F.countDistinct("mes").alias("meses"), F.min(day).alias("primera"), F.max(day).alias("ultima"))
    asked = _rows(spark, d).where("rol = 'pregunta' and not coalesce(ruido, false) and periodista_canonico is not null")
    asked = asked.groupBy(F.col("periodista_canonico").alias("periodista")).agg(F.count("*").alias("preguntas"))
    return card.join(asked, "periodista", "left").join(agg.modal(h, "periodista", "medio").select("periodista", "medio"), "periodista", "left").withColumn(
        "preguntas", F.coalesce("preguntas", F.lit(0)))


@query(f"WITH {_ROWS}, {_CARD} SELECT k.*, coalesce(preguntas, 0) AS preguntas, medio FROM k LEFT JOIN q USING (periodista) LEFT JOIN o USING (periodista)")
def reporter_card(spark, d):
    """Threads, questions, dates, months, span and most frequent outlet of each reporter."""
    return _cards(spark, d)


@query(f"""WITH {_ROWS}, {_CARD} SELECT periodista, hilos, coalesce(preguntas, 0) AS preguntas, medio, primera, ultima FROM k LEFT JOIN q USING (periodista) LEFT JOIN o USING (periodista)
WHERE hilos >= 6 ORDER BY hilos DESC, periodista""")
def data_table(spark, d):
    """The table of reporters with six threads or more."""
    return _cards(spark, d).where("hilos >= 6").select("periodista", "hilos", "preguntas", "medio", "primera", "ultima").orderBy(F.desc("hilos"), "periodista")


@query(f"""WITH {_ROWS}, m AS (SELECT substr(conferencia_id, 1, 7) AS mes, count(*) AS n, count(*) FILTER (WHERE atribucion = 'incierta') AS casos FROM r GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY mes) AS a, row_number() OVER (ORDER BY mes DESC) AS b FROM m),
e AS (SELECT 'primeros' AS borde, n, casos FROM k WHERE a <= 3 UNION ALL SELECT 'ultimos', n, casos FROM k WHERE b <= 4)
SELECT borde, cast(sum(n) AS bigint) AS n, cast(sum(casos) AS bigint) AS casos, round(sum(casos) / nullif(sum(n), 0), 6) AS tasa FROM e GROUP BY 1""")
def edge_months(spark, d):
    """Share of uncertain turns in the first three and the last four months."""
    rows = _rows(spark, d).withColumn("mes", F.substring("conferencia_id", 1, 7))
    return agg.edge_rates(rows, "mes", F.col("atribucion") == "incierta")


@query(f"""WITH {_T}, {_FOUND} SELECT substr(conferencia_id, 1, 7) AS mes, count(*) AS n, count(*) FILTER (WHERE forma IN ('en_curso', 'encargo', 'necesidad', 'compromiso')) AS promesas,
  round(count(*) FILTER (WHERE forma IN ('en_curso', 'encargo', 'necesidad', 'compromiso')) / count(*), 6) AS tasa FROM hz GROUP BY 1""")
def findings_by_month(spark, d):
    """Findings and those that promise something, by month."""
    found = mining.findings(_turns(spark, d).where("tipo = 'funcionario'"), ["conferencia_id", "orden"], "texto")
    promise = F.count_if(F.col("forma").isin("en_curso", "encargo", "necesidad", "compromiso"))
    return found.groupBy(F.substring("conferencia_id", 1, 7).alias("mes")).agg(
        F.count("*").alias("n"), promise.alias("promesas"), F.round(promise / F.count("*"), 6).alias("tasa"))


_PROMISES = ["en_curso", "encargo", "necesidad", "compromiso"]
_BY = (
    "y AS (SELECT hz.conferencia_id, hz.orden, r.hilo, r.periodista_canonico, forma FROM hz JOIN r USING (conferencia_id, orden)), "
    "d AS (SELECT periodista_canonico AS periodista, count(*) AS respuestas FROM r WHERE rol <> 'pregunta' AND periodista_canonico IS NOT NULL GROUP BY 1)"
)


@query(f"""WITH {_T}, {_FOUND}, {_ROWS}, {_BY}, n AS (SELECT periodista_canonico AS periodista, count(*) FILTER (WHERE forma IN ('en_curso', 'encargo', 'necesidad', 'compromiso')) AS promesas
  FROM y WHERE periodista_canonico IS NOT NULL GROUP BY 1)
SELECT periodista, respuestas, promesas, round(promesas / respuestas, 6) AS tasa FROM n JOIN d USING (periodista) ORDER BY promesas DESC, periodista LIMIT 10""")
def promises_by_reporter(spark, d):
    """The ten reporters with most promises among their answers, with the number of answers."""
    found = mining.findings(_turns(spark, d).where("tipo = 'funcionario'"), ["conferencia_id", "orden"], "texto")
    rows = _rows(spark, d).where("periodista_canonico is not null").withColumnRenamed("periodista", "__heard").withColumnRenamed("periodista_canonico", "periodista")
    promised = found.join(rows.select("conferencia_id", "orden", "periodista"), ["conferencia_id", "orden"]).groupBy("periodista").agg(
        F.count_if(F.col("forma").isin(_PROMISES)).alias("promesas"))
    answers = rows.where("rol <> 'pregunta'").groupBy("periodista").agg(F.count("*").alias("respuestas"))
    joined = promised.join(answers, "periodista").withColumn("tasa", F.round(F.col("promesas") / F.col("respuestas"), 6))
    return joined.orderBy(F.desc("promesas"), "periodista").limit(10)


@query(f"""WITH {_T}, {_FOUND}, {_ROWS}, {_C}, y AS (SELECT hz.conferencia_id, hz.orden, r.hilo, forma FROM hz JOIN r USING (conferencia_id, orden)),
q AS (SELECT conferencia_id, hilo, orden, coalesce(lead(orden) OVER (PARTITION BY conferencia_id, hilo ORDER BY orden), 2147483647) AS hasta FROM r WHERE rol = 'pregunta' AND NOT coalesce(ruido, false)),
z AS (SELECT c.categoria, y.forma FROM y JOIN q ON y.conferencia_id = q.conferencia_id AND y.hilo = q.hilo AND y.orden > q.orden AND y.orden < q.hasta
  JOIN c ON c.id_pregunta = q.conferencia_id || '-h' || q.hilo || '-t' || q.orden)
SELECT categoria, forma, count(*) AS n FROM z GROUP BY 1, 2""")
def forms_by_category(spark, d):
    """Forms of what was answered, by the category of the question."""
    found = mining.findings(_turns(spark, d).where("tipo = 'funcionario'"), ["conferencia_id", "orden"], "texto")
    asks = (F.col("rol") == "pregunta") & ~F.coalesce("ruido", F.lit(False))
    w = Window.partitionBy("conferencia_id", "hilo").orderBy("orden").rowsBetween(Window.unboundedPreceding, 0)
    # The question that a turn answers is the last one before it in its thread.
    rows = _rows(spark, d).withColumn("pregunta", F.last(F.when(asks, F.col("orden")), True).over(w)).where(~asks & F.col("pregunta").isNotNull())
    rows = rows.select("conferencia_id", "orden", F.concat("conferencia_id", F.lit("-h"), "hilo", F.lit("-t"), "pregunta").alias("id_pregunta"))
    joined = found.join(rows, ["conferencia_id", "orden"]).join(_labels(spark, d).select("id_pregunta", "categoria"), "id_pregunta")
    return joined.groupBy("categoria", "forma").agg(F.count("*").alias("n"))


@query(f"""WITH {_H}, n AS (SELECT periodista_canonico AS p, count(*) AS hilos FROM h WHERE periodista_canonico IS NOT NULL GROUP BY 1)
SELECT CASE WHEN hilos >= 10 THEN '>=10' WHEN hilos >= 3 THEN '3-9' WHEN hilos = 2 THEN '2' ELSE '1' END AS tramo, count(*) AS cuantos, cast(sum(hilos) AS bigint) AS hilos FROM n GROUP BY 1""")
def frequency_tranches(spark, d):
    """Reporters and threads by how often they came."""
    counts = _threads(spark, d).where("periodista_canonico is not null").groupBy("periodista_canonico").agg(F.count("*").alias("hilos"))
    return agg.frequency_tranches(counts, "hilos", [10, 3, 2, 1])


@query(f"""WITH {_ROWS}, {_E}, {_EX} SELECT (SELECT count(*) FROM h) AS hilos, (SELECT count(*) FROM e) AS intercambios, (SELECT count(DISTINCT periodista) FROM h) AS periodistas,
  (SELECT count(DISTINCT conferencia_id) FROM h) AS conferencias, 'todo' AS alcance""")
def exploration_totals(spark, d):
    """Threads, exchanges, reporters and conferences in one row."""
    h = _threads(spark, d).agg(F.count("*").alias("hilos"), F.countDistinct("periodista").alias("periodistas"), F.countDistinct("conferencia_id").alias("conferencias"))
    e = _exchanges(spark, d).agg(F.count("*").alias("intercambios"))
    # Both sides are one row.
    return h.withColumn("alcance", F.lit("todo")).join(e.withColumn("alcance", F.lit("todo")), "alcance")


@query(f"WITH {_T}, {_H} SELECT conferencia_id, count(*) AS turnos FROM t ANTI JOIN h USING (conferencia_id) GROUP BY 1")
def conferences_without_threads(spark, d):
    """Conferences with turns and no thread."""
    return _turns(spark, d).join(_threads(spark, d).select("conferencia_id").distinct(), "conferencia_id", "left_anti").groupBy("conferencia_id").agg(F.count("*").alias("turnos"))


@query(f"WITH {_ROWS} SELECT conferencia_id, count(*) FILTER (WHERE rol = 'pregunta' AND NOT coalesce(ruido, false)) AS utiles FROM r GROUP BY 1")
def useful_questions(spark, d):
    """Useful questions of each conference with threads."""
    useful = F.count_if((F.col("rol") == "pregunta") & ~F.coalesce("ruido", F.lit(False)))
    return _rows(spark, d).groupBy("conferencia_id").agg(useful.alias("utiles"))


@query(f"""WITH {_ROWS} SELECT conferencia_id, count(*) FILTER (WHERE {_FOLD.format('quien')} LIKE '%lopez%' OR {_FOLD.format('quien')} LIKE '%ruiz%' OR {_FOLD.format('quien')} LIKE '%mar%') AS suyas,
  count(*) AS todas FROM r WHERE rol <> 'pregunta' GROUP BY 1""")
def answers_of_named(spark, d):
    """Answers of the officials whose label holds one of some names."""
    answers = _rows(spark, d).where("rol <> 'pregunta'")
    return answers.groupBy("conferencia_id").agg(F.count_if(rules.is_named(F.col("quien"), ["López", "Ruiz", "Mar"])).alias("suyas"), F.count("*").alias("todas"))


_STOPV = "['que', 'los', 'las', 'con', 'por', 'para', 'una', 'del']"
_TOPW = (
    f"p AS (SELECT periodista AS a FROM h WHERE periodista IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, periodista LIMIT 20), w AS (SELECT periodista AS a, unnest(list_filter(regexp_extract_all("
    f"{_FOLD.format('texto')}, '[a-z]+'), lambda x: length(x) > 2 AND NOT list_contains({_STOPV}, x))) AS palabra FROM r WHERE rol = 'pregunta' AND NOT coalesce(ruido, false) AND periodista IS NOT NULL), "
    "c AS (SELECT a, palabra, count(*) AS n FROM w JOIN p USING (a) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, palabra) <= 400), "
    "s AS (SELECT a, count(*) AS n FROM c GROUP BY 1), x AS (SELECT c.a, d.a AS b, count(*) AS comunes FROM c JOIN c d USING (palabra) WHERE c.a < d.a GROUP BY 1, 2)"
)


def _top_words(spark, d):
    most = _threads(spark, d).where("periodista is not null").groupBy("periodista").count().orderBy(F.desc("count"), "periodista").limit(20).select("periodista")
    asked = _rows(spark, d).where("rol = 'pregunta' and not coalesce(ruido, false) and periodista is not null")
    words = asked.join(most, "periodista", "left_semi").select("periodista", F.explode(text.tokens(F.col("texto"), "que los las con por para una del".split())).alias("palabra"))
    return agg.top_per_group(words.groupBy("periodista", "palabra").agg(F.count("*").alias("n")), "periodista", "palabra", "n", 400)


@query(f"WITH {_ROWS}, {_TOPW} SELECT x.a, x.b, comunes, round(1 - comunes / (s.n + t.n - comunes), 6) AS distancia FROM x JOIN s ON x.a = s.a JOIN s t ON x.b = t.a")
def reporter_vocabularies(spark, d):
    """Distances of the vocabularies of the twenty busiest reporters, each of its 400 most frequent words."""
    return similarity.vocabulary_distances(_top_words(spark, d), "periodista", "palabra")


@query()
def vocabulary_linkage(spark, d):
    """Average linkage of the twenty busiest reporters, closest merge first."""
    pairs = {(r.a, r.b): r.distancia for r in similarity.vocabulary_distances(_top_words(spark, d), "periodista", "palabra").collect()}
    names = sorted({n for p in pairs for n in p})
    merges = similarity.average_linkage(names, pairs)
    rows = [(k + 1, "; ".join(sorted(x)), "; ".join(sorted(y)), round(v, 6)) for k, (x, y, v) in enumerate(merges)]
    return spark.createDataFrame(rows, "paso int, izquierda string, derecha string, distancia double")


@query(f"""WITH {_H}, a AS (SELECT periodista_canonico AS v, row_number() OVER (ORDER BY periodista_canonico) - 1 AS k FROM (SELECT DISTINCT periodista_canonico FROM h WHERE periodista_canonico IS NOT NULL)),
b AS (SELECT medio AS v, row_number() OVER (ORDER BY medio) - 1 AS k FROM (SELECT DISTINCT medio FROM h WHERE medio IS NOT NULL))
SELECT conferencia_id, hilo, cast(a.k AS int) AS periodista_canonico, cast(b.k AS int) AS medio FROM h LEFT JOIN a ON h.periodista_canonico = a.v LEFT JOIN b ON h.medio = b.v""")
def dictionary_export_columns(spark, d):
    """Threads with reporter and outlet as dictionary codes."""
    rows = _threads(spark, d).select("conferencia_id", "hilo", "periodista_canonico", "medio")
    return agg.dictionary_export(rows, ["periodista_canonico", "medio"])[0]


# ---- samples -----------------------------------------------------------------------------------


@query(f"""WITH {_ASKED_IDS}, g AS (SELECT * FROM q ORDER BY md5(id || '|' || 'oro'), id LIMIT 120)
SELECT substr(conferencia_id, 1, 4) AS anio, atribucion = 'declarada' AS abre, count(*) AS n, median(length(texto)) AS mediana FROM g GROUP BY 1, 2""")
def sample_composition(spark, d):
    """A sample by year and by whether a question opens a thread, with the middle length."""
    g = agg.hash_sample(_asked(spark, d), ["id"], 120, "oro")
    return g.groupBy(F.substring("conferencia_id", 1, 4).alias("anio"), (F.col("atribucion") == "declarada").alias("abre")).agg(
        F.count("*").alias("n"), F.median(F.length("texto")).alias("mediana"))


_TERMS = (
    f"list_concat(list_concat([{_FLAT.format('periodista')}], list_filter(string_split({_FLAT.format('periodista')}, ' ')[2:], lambda w: length(w) > 3)), list_concat([{_FLAT.format('medio')}], "
    f"list_filter(string_split({_FLAT.format('medio')}, ' '), lambda w: length(w) > 4 AND NOT list_contains(['noticias', 'radio', 'diario', 'grupo', 'canal', 'revista', 'periodico', 'agencia', 'medios', 'portal'], w))))"
)
_LEAKS = f"x AS (SELECT q.*, len(list_filter({_TERMS}, lambda w: w <> '' AND contains(' ' || {_FLAT.format('texto')} || ' ', ' ' || w || ' '))) > 0 AS fuga FROM q)"


@query(f"WITH {_ASKED_IDS}, {_LEAKS} SELECT id, fuga FROM x")
def leak_check(spark, d):
    """Questions in which the reporter's name or outlet still stands."""
    return _asked(spark, d).select("id", identity.leak(F.col("texto"), F.col("periodista"), F.col("medio")).isNotNull().alias("fuga"))


@query(f"""WITH {_ASKED_IDS}, {_LEAKS}, g AS (SELECT id FROM x WHERE NOT fuga ORDER BY md5(id || '|' || '5'), id LIMIT 60)
SELECT id, cast((row_number() OVER (ORDER BY md5(id || '|' || 'lote'), id) - 1) % 3 + 1 AS int) AS lote FROM g""")
def redrawn_lots(spark, d):
    """A sample that passes over questions that give their reporter away, dealt out to three lots."""
    unfit = identity.leak(F.col("texto"), F.col("periodista"), F.col("medio")).isNotNull()
    g = agg.redrawn_sample(_asked(spark, d), ["id"], 60, unfit, "5").select("id")
    return agg.lots(g, ["id"], 3, "lote")


@query()
def blind_sample(spark, d):
    """A coding sheet: questions masked and redacted, with a code in place of the id."""
    unfit = identity.leak(F.col("texto"), F.col("periodista"), F.col("medio")).isNotNull()
    g = agg.redrawn_sample(_asked(spark, d), ["id"], 60, unfit, "5")
    hidden = identity.masked(g, "texto", "periodista", "medio")
    shown = identity.introductions(hidden.select("id", "texto_cubierto"), ["id"], "texto_cubierto").select("id", F.col("redactado").alias("pregunta"))
    return agg.lots(shown, ["id"], 3, "lote").select(F.substring(F.md5(F.concat(F.lit("clave|"), "id")), 1, 8).alias("codigo"), "lote", "pregunta")


# ---- labelling -----------------------------------------------------------------------------------


@query(f"""WITH {_ASKED_IDS} SELECT count(*) AS n, cast(ceil(count(*) / 10) AS bigint) AS lotes, cast(ceil(sum(length(texto)) * 0.25) + ceil(count(*) / 10) * 1000 AS bigint) AS fichas_entrada,
  count(*) * 60 AS fichas_salida, round(((ceil(sum(length(texto)) * 0.25) + ceil(count(*) / 10) * 1000) * 0.30 + count(*) * 60 * 2.50) / 1000000, 6) AS costo FROM q""")
def dry_run_cost(spark, d):
    """What labelling all questions would cost."""
    return classify.cost_estimate(_asked(spark, d), "texto")


_WORDS = {"obra": ["puente", "presa", "carretera", "línea"], "salud": ["hospital", "vacuna", "medic"], "dinero": ["millones", "pesos", "costo"]}


@query(f"""WITH {_ASKED_IDS}, b AS (SELECT lower(texto) AS b FROM q), s AS (SELECT b, {_SCORES} FROM b), x AS (SELECT {_FIRST.format('dinero', 'salud')} AS etiqueta FROM s)
SELECT etiqueta, cast(NULL AS varchar) AS razon, count(*) AS n FROM x GROUP BY 1""")
def label_rounds(spark, d):
    """Questions labelled in micro-batches with a growing vocabulary and a ledger."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hemerion/ledger-{uuid.uuid4().hex}"
    found = classify.label_batches(_asked(spark, d), "id", "texto", lambda vocabulary: classify.keyword_labeller(_WORDS), list(_WORDS), folder, pause=0.0)
    return found.groupBy("etiqueta", "razon").agg(F.count("*").alias("n"))


@query(f"""WITH {_ASKED_IDS}, b AS (SELECT id, 'CONTEXTO: ' || atribucion || chr(10) || 'PREGUNTA: ' || texto AS entrada FROM q) SELECT id, entrada, regexp_extract(entrada, chr(10) || 'PREGUNTA: ((?s:.*))$', 1) AS pregunta FROM b""")
def context_entries(spark, d):
    """Entries for a labeller made of context and question, and the question got back."""
    entry = classify.with_context(F.col("texto"), F.col("atribucion"))
    return _asked(spark, d).select("id", entry.alias("entrada")).withColumn("pregunta", classify.question_only(F.col("entrada")))


@query(f"""WITH {_VOTES} SELECT CASE WHEN p IN ('critica') THEN 'crítica' WHEN p IN ('favorable', 'neutral') THEN 'no crítica' END AS cubeta, count(*) AS n FROM x GROUP BY 1""")
def stance_buckets(spark, d):
    """Labels by reporting bucket; what can't be classified has none."""
    cube = rules.bucket(F.col("p"), {"crítica": ["critica"], "no crítica": ["favorable", "neutral"]})
    return _votes(spark, d).groupBy(cube.alias("cubeta")).agg(F.count("*").alias("n"))


# ---- sources and texts ---------------------------------------------------------------------------


@query("""SELECT conferencia_id, arg_min(doc_id, struct_pack(a := capturado_en, b := doc_id)) AS doc_id, min(capturado_en) AS capturado_en FROM documents
WHERE conferencia_id IS NOT NULL AND capturado_en IS NOT NULL AND n_chars >= 40 GROUP BY 1""")
def earliest_capture(spark, d):
    """The earliest capture of each conference whose page was whole."""
    rows = table(spark, d, "documents").select("conferencia_id", "doc_id", "capturado_en", "n_chars")
    return lineage.earliest(rows.where("n_chars >= 40"), "conferencia_id", "capturado_en", ["doc_id"])


_SLUG = "'conferencia-del-' || day(fecha) || '-de-' || ['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'][month(fecha)] || '-de-' || year(fecha)"
_LINKS = f"l AS (SELECT DISTINCT conferencia_id, fecha, CASE WHEN fecha IS NULL THEN 'boletin-' || conferencia_id ELSE {_SLUG} END AS slug FROM conferencias)"


def _link_pages(spark, d):
    names = {n: m for m, n in dates.MONTHS.items() if m != "setiembre"}
    month = F.create_map(*[x for n, m in names.items() for x in (F.lit(n), F.lit(m))])[F.month("fecha")]
    slug = F.concat(F.lit("conferencia-del-"), F.dayofmonth("fecha"), F.lit("-de-"), month, F.lit("-de-"), F.year("fecha"))
    rows = table(spark, d, "conferencias").select("conferencia_id", "fecha").distinct().withColumn("slug", F.coalesce(slug, F.concat(F.lit("boletin-"), "conferencia_id")))
    anchor = F.concat(F.lit("<li><a href='"), "slug", F.lit("?idiom=es'>x</a> <a href=\""), "slug", F.lit("\">y</a></li>"))
    return rows.withColumn("html", anchor)


@query(f"WITH {_LINKS} SELECT conferencia_id, slug AS href, 0 AS posicion FROM l")
def page_links(spark, d):
    """Links of pages, without their query, each once in order."""
    return documents.links(_link_pages(spark, d), "conferencia_id", "html").select("conferencia_id", "href", "posicion")


@query(f"""WITH {_LINKS}, w AS (SELECT slug, fecha, fecha IS NOT NULL AND year(fecha) BETWEEN 1000 AND 9999 AS es FROM l)
SELECT 'conferencia' AS clase, count(DISTINCT fecha) AS n FROM w WHERE es UNION ALL SELECT 'otra', count(DISTINCT slug) FROM w WHERE NOT es""")
def wanted_links(spark, d):
    """Links that name a conference's date, the first of each date, and the other ones."""
    hrefs = documents.links(_link_pages(spark, d), "conferencia_id", "html")
    wanted, other = lineage.wanted_links(hrefs, "href", dates.date_of_slug(F.col("href")))
    a = wanted.agg(F.lit("conferencia").alias("clase"), F.count("*").alias("n"))
    return a.unionByName(other.agg(F.lit("otra").alias("clase"), F.count("*").alias("n")))


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Just a moment... ' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '<div class=''article-body''>' END || coalesce(text, '')
  || CASE WHEN doc_id % 2 = 0 THEN repeat('x', 20000) ELSE '' END AS html FROM documents)
SELECT coalesce(CASE WHEN regexp_matches(lower(left(html, 5000)), 'just a moment|challenge-platform|checking your browser') THEN 'pantalla de verificación' WHEN length(html) < 20000
  THEN 'página demasiado corta' WHEN NOT contains(html, 'article-body') THEN 'sin cuerpo del artículo' END, 'válida') AS motivo, count(*) AS n FROM p GROUP BY 1""")
def page_problems(spark, d):
    """Pages made of documents, by what is wrong with them."""
    key, body = F.col("doc_id"), F.coalesce("text", F.lit(""))
    html = F.concat(F.when(key % 5 == 0, "Just a moment... ").otherwise(""), F.when(key % 3 == 0, "").otherwise("<div class='article-body'>"), body,
                    F.when(key % 2 == 0, F.repeat(F.lit("x"), F.lit(20_000))).otherwise(""))
    rows = table(spark, d, "documents").select(html.alias("html"))
    return rows.groupBy(F.coalesce(documents.page_problem(F.col("html")), F.lit("válida")).alias("motivo")).agg(F.count("*").alias("n"))


@query(f"""WITH {_T} SELECT conferencia_id, string_agg('A ' || coalesce(texto, '') || ' B', chr(10) || chr(10) ORDER BY orden) FILTER (WHERE orden % 7 <> 3) AS texto, count(*) FILTER (WHERE orden % 7 = 3) AS videos, count(*) FILTER (WHERE orden % 7 = 3) AS apartes FROM t GROUP BY 1""")
def recordings_and_asides(spark, d):
    """Transcripts with recordings and paragraphs between dashes put in, and taken out again; with the closing mark."""
    body = F.coalesce("texto", F.lit(""))
    line = F.when(F.col("orden") % 7 == 3, F.concat(F.lit("(INICIA VIDEO)"), body, F.lit("(FINALIZA VIDEO)\n\n—Aplausos del público—"))).otherwise(F.concat(F.lit("A "), body, F.lit(" B")))
    listed = F.array_sort(F.collect_list(F.struct("orden", line.alias("l"))))
    docs = _turns(spark, d).groupBy("conferencia_id").agg(F.concat(F.array_join(F.transform(listed, lambda x: x.l), "\n\n"), F.lit("\n\n—000—\n")).alias("t"))
    clean = docs.withColumn("v", documents.without_videos(F.col("t"))).withColumn("m", documents.without_end_mark(F.col("v.texto")))
    parts = clean.withColumn("a", documents.asides(F.col("m.texto")))
    return parts.select("conferencia_id", F.col("a.texto").alias("texto"), F.col("v.videos").cast("long").alias("videos"), F.size("a.apartes").cast("long").alias("apartes"))


@query(f"""WITH {_T}, s AS (SELECT conferencia_id, orden, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(texto, ''), '([.?!…])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS o FROM t)
SELECT conferencia_id, orden, len(o) AS oraciones, cast(coalesce(list_max(list_transform(o, lambda x: length(x))), 0) AS int) AS mayor FROM s""")
def sentence_explode(spark, d):
    """Sentences of each turn and the longest one."""
    o = text.sentences(F.col("texto"))
    return _turns(spark, d).select("conferencia_id", "orden", F.size(o).cast("long").alias("oraciones"), F.coalesce(F.array_max(F.transform(o, lambda x: F.length(x))), F.lit(0)).alias("mayor"))


_CUT = "trim(regexp_replace(texto, '\\s+', ' ', 'g'))"


@query(f"""WITH {_T}, f AS (SELECT conferencia_id, orden, {_CUT} AS p FROM t WHERE texto IS NOT NULL) SELECT conferencia_id, orden,
  CASE WHEN length(p) <= 60 THEN p ELSE regexp_replace(left(p, 60), ' [^ ]*$', '') || '…' END AS recorte FROM f""")
def excerpts(spark, d):
    """Turns cut to sixty letters at a blank."""
    return _turns(spark, d).where("texto is not null").select("conferencia_id", "orden", text.excerpt(F.col("texto"), 60).alias("recorte"))


@query("""WITH n AS (SELECT DISTINCT nombre FROM catalogo_medios WHERE nombre IS NOT NULL) SELECT nombre, upper(left(nombre, 1)) || substr(nombre, 2) AS alto, cast(len(list_filter(regexp_split_to_array(
  trim(nombre), '\\s+'), lambda w: regexp_matches(w, '^\\p{Lu}') AND NOT list_contains(['de', 'del', 'la', 'el', 'los', 'las', 'y'], lower(w)))) AS int) AS mayusculas FROM n""")
def capital_words(spark, d):
    """Names of the list with their first letter raised and their capitalised words counted."""
    names = table(spark, d, "catalogo_medios").select("nombre").where("nombre is not null").distinct()
    words = text.capitalised_words(F.col("nombre"), "de del la el los las y".split())
    return names.select("nombre", text.upper_first(F.col("nombre")).alias("alto"), words.alias("mayusculas"))


_MES = "['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'][month(fecha)]"


@query(f"""WITH k AS (SELECT DISTINCT conferencia_id, fecha FROM conferencias WHERE fecha IS NOT NULL) SELECT conferencia_id, fecha AS en_pagina, day(fecha) || ' de ' || {_MES} || ' de ' || year(fecha) AS larga,
  left({_MES}, 3) || ' ' || strftime(fecha, '%y') AS etiqueta, true AS coincide FROM k""")
def page_dates(spark, d):
    """Dates written out, read back from a heading or from the line with place and date, and compared with the slug's."""
    rows = table(spark, d, "conferencias").select("conferencia_id", "fecha").where("fecha is not null").distinct()
    said = dates.long_date(F.col("fecha"))
    even = F.length("conferencia_id") + F.dayofmonth("fecha")
    heading = F.when(even % 2 == 0, F.concat(F.lit("Conferencia del "), said)).otherwise(F.lit("Conferencia"))
    place = F.concat(F.lit("Lugar | "), said)
    rows = rows.withColumn("p", dates.date_in_page(heading, place)).withColumn("s", dates.settled_date(F.col("p"), F.col("fecha")))
    return rows.select("conferencia_id", F.col("s.fecha").alias("en_pagina"), said.alias("larga"), dates.month_label(F.col("fecha")).alias("etiqueta"), F.col("s.coincide").alias("coincide"))


@query("""SELECT source, count(*) AS n, format('{:,}', count(*)) || ' ' || CASE WHEN count(*) = 1 THEN 'texto' ELSE 'textos' END AS texto,
  coalesce(printf('%.1f', round(100.0 * count(*) FILTER (WHERE lang = 'es') / nullif(count(lang), 0), 1)) || ' %', '—') AS en_es FROM documents GROUP BY 1""")
def display_formats(spark, d):
    """Documents by source with display forms of counts and shares."""
    n, es = F.count("*"), F.count_if(F.col("lang") == "es")
    rows = table(spark, d, "documents").groupBy("source").agg(n.alias("n"), es.alias("es"), F.count("lang").alias("con"))
    return rows.select("source", "n", text.plural(F.col("n"), "texto", "textos").alias("texto"), text.percent(F.col("es"), F.col("con")).alias("en_es"))


@query(f"""WITH {_ASKED_IDS}, k AS (SELECT id_pregunta AS id, bool_or(asunto IS NULL OR asunto = '') AS malo, bool_or(asunto <> '') AS bueno FROM clasificaciones GROUP BY 1)
SELECT id, 'reintentar' AS estado FROM k WHERE malo AND NOT coalesce(bueno, false) UNION ALL SELECT id, 'pendiente' FROM q ANTI JOIN k USING (id)""")
def retry_and_pending(spark, d):
    """Questions whose label was rejected and may be tried again, and those never tried."""
    rows = table(spark, d, "clasificaciones").select(F.col("id_pregunta").alias("id"), "asunto")
    good, bad = lineage.split_rejects(rows, F.when(F.coalesce("asunto", F.lit("")) == "", "error: sin asunto"))
    again = lineage.retryable(bad, good, "^error").select("id", F.lit("reintentar").alias("estado")).distinct()
    waiting = lineage.pending(_asked(spark, d).select("id"), good.select("id"), bad.select("id"))
    return again.unionByName(waiting.select("id", F.lit("pendiente").alias("estado")))


@query("""WITH d AS (SELECT DISTINCT asunto FROM clasificaciones WHERE asunto <> ''), b AS (SELECT asunto, list_distinct(list_filter(regexp_extract_all(strip_accents(lower(asunto)), '[a-z0-9]{4,}'),
  lambda w: NOT list_contains(['para', 'unos', 'unas', 'sobre', 'ante', 'tras', 'entre'], w))) AS w FROM d), u AS (SELECT asunto, len(w) AS n, unnest(w) AS palabra FROM b),
x AS (SELECT a.asunto AS a, b.asunto AS b, count(*) AS comunes, any_value(a.n) AS n, any_value(b.n) AS m FROM u a JOIN u b USING (palabra) WHERE a.asunto < b.asunto GROUP BY 1, 2)
SELECT a, b, round(comunes / (n + m - comunes), 6) AS jaccard FROM x WHERE comunes / (n + m - comunes) >= 0.6""")
def subject_pairs(spark, d):
    """Pairs of subjects that share six tenths of their words."""
    subjects = table(spark, d, "clasificaciones").where("asunto <> ''").select("asunto").distinct()
    sets = subjects.withColumn("w", similarity.subject_bag(F.col("asunto")))
    return similarity.jaccard_pairs(sets, "asunto", "w", 0.6).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_TIDY = "regexp_matches(periodista, '^[A-ZÁÉÍÓÚÑ][a-záéíóúñü]+( [A-ZÁÉÍÓÚÑ][a-záéíóúñü]+){1,2}$') AND regexp_matches(medio, '^[A-ZÁÉÍÓÚÑ][a-záéíóúñü]+( [A-ZÁÉÍÓÚÑ][a-záéíóúñü]+){0,4}$')"


@query(f"""WITH {_H} SELECT conferencia_id, hilo, periodista, medio, '[identificación removida]. ¿Cuándo?' AS redactado FROM h WHERE {_TIDY}""")
def introduction_round_trip(spark, d):
    """Introductions made of threads' reporters and outlets in six ways, read back and taken out."""
    tidy = _threads(spark, d).where(F.expr(_TIDY.replace("regexp_matches", "regexp_like")))
    ways = ["Buenos días, {n}, de {m}", "Soy {n}, reportera de {m}", "{n}, {m}", "Mi nombre es {n}, y escribo para {m}", "Su servidor, {n}, de {m}", "{n}, corresponsal del {m}"]
    made = [F.replace(F.replace(F.lit(w), F.lit("{n}"), F.col("periodista")), F.lit("{m}"), F.col("medio")) for w in ways]
    pick = F.pmod(F.length("periodista") + F.length("medio") + F.col("hilo"), F.lit(len(ways)))
    said = tidy.withColumn("t", F.concat(F.get(F.array(*made), pick), F.lit(". ¿Cuándo?"))).select("conferencia_id", "hilo", "t")
    return identity.introductions(said, ["conferencia_id", "hilo"], "t").select("conferencia_id", "hilo", "periodista", "medio", "redactado")


_LAST_COMMA = "regexp_extract(e, '^(.*),([^,]*)$', {0})"
_STEMS = (
    "SECRETARI|SUBSECRETARI|DIRECTOR|TITULAR|PRESIDENT|COORDINADOR|GOBERNADOR|COMISIONAD|JEFE|JEFA|CONSEJER|VOCERO|VOCERA|ALMIRANTE|GENERAL|PROCURADOR|FISCAL|EMBAJADOR|MAGISTRAD"
    "|MINISTR|RECTOR|GERENTE|ENCARGAD|SUBDIRECTOR|ADMINISTRADOR"
)


@query(f"""WITH l AS (SELECT DISTINCT trim(etiqueta) AS e FROM turnos WHERE etiqueta IS NOT NULL), u AS (SELECT e, strip_accents(upper(e)) AS f, trim({_LAST_COMMA.format(1)}) AS a, trim({_LAST_COMMA.format(2)}) AS b FROM l),
k AS (SELECT *, CASE WHEN regexp_matches(f, '^(PREGUNTAS?|INTERLOCUTOR(A|ES|AS)?)(\\s*[(][^)]*[)])?$') THEN 'prensa' WHEN regexp_matches(f, '^(ASISTENTES|INTERVENCION(ES)?(\\s+(HOMBRE|MUJER)(E?S)?)?(\\s*[(][^)]*[)])?)$')
  OR regexp_matches(f, '^(VOZ|VOCES|DERECHOHABIENTE|MADRE|PADRE|PACIENTE|TRABAJADOR|BENEFICIARI)') THEN 'anonimo' ELSE 'funcionario' END AS tipo,
  regexp_matches(strip_accents(upper(b)), '{_STEMS}') AND NOT regexp_matches(strip_accents(upper(a)), '{_STEMS}') AS vuelta FROM u)
SELECT e AS etiqueta, tipo, CASE WHEN tipo = 'funcionario' AND contains(e, ',') THEN CASE WHEN vuelta THEN b ELSE a END END AS cargo,
  CASE WHEN tipo = 'funcionario' THEN CASE WHEN NOT contains(e, ',') THEN e WHEN vuelta THEN a ELSE b END END AS hablante FROM k""")
def label_parts(spark, d):
    """Labels with their kind, office and speaker."""
    labels = table(spark, d, "turnos").where("etiqueta is not null").select(F.trim("etiqueta").alias("etiqueta")).distinct()
    return labels.withColumn("p", rules.label_parts(F.col("etiqueta"))).select("etiqueta", "p.tipo", "p.cargo", "p.hablante")


@query(f"""WITH {_H}, a AS (SELECT DISTINCT conferencia_id || '#' || hilo AS id, {_PKEY.format('z')} AS k FROM (SELECT conferencia_id, hilo, unnest(regexp_split_to_array(medio, '[;|/,]')) AS z FROM h)),
b AS (SELECT DISTINCT puente_id, beneficiario_canonico, confianza, monto_2024_2026 AS monto, {_PKEY.format('medio_hablado')} AS k FROM puente_medios WHERE medio_hablado IS NOT NULL AND confianza <> 'pendiente')
SELECT confianza, count(DISTINCT puente_id) AS filas, count(DISTINCT id) AS hilos FROM b LEFT JOIN a ON a.k = b.k AND b.k <> '' GROUP BY 1""")
def spend_confidence(spark, d):
    """Paired bridge rows by confidence, with the threads whose outlets overlap theirs."""
    keys = F.transform(F.split("medio", "[;|/,]"), lambda z: F.replace(text.plain_words(z), F.lit(" "), F.lit("")))
    threads = _threads(spark, d).where("medio is not null").select(F.concat_ws("#", "conferencia_id", "hilo").alias("id"), F.filter(F.array_distinct(keys), lambda x: x != "").alias("k"))
    own = F.array(F.replace(text.plain_words(F.col("medio_hablado")), F.lit(" "), F.lit("")))
    bridge = table(spark, d, "puente_medios").where("medio_hablado is not null and confianza <> 'pendiente'").select("puente_id", "confianza", own.alias("k")).distinct()
    hits = entities.overlapping(bridge.where("k[0] <> ''"), "puente_id", "k", threads, "id", "k")
    joined = bridge.select("puente_id", "confianza").distinct().join(hits, "puente_id", "left")
    return joined.groupBy("confianza").agg(F.countDistinct("puente_id").alias("filas"), F.countDistinct("id").alias("hilos"))


@query(f"""WITH {_T}, l AS (SELECT conferencia_id, orden, coalesce(etiqueta, '') || ': ' || trim(regexp_replace(coalesce(texto, ''), '\\s+', ' ', 'g')) AS linea,
  coalesce({_SHOUTED}, false) AS es FROM t), f AS (SELECT conferencia_id, min(orden) FILTER (WHERE es) AS primero FROM l GROUP BY 1)
SELECT conferencia_id, 'Conferencia ' || conferencia_id || coalesce((SELECT string_agg(chr(10) || linea, '' ORDER BY orden) FROM l WHERE l.conferencia_id = f.conferencia_id AND (f.primero IS NULL OR l.orden < f.primero)), '') AS encabezado FROM f""")
def transcript_headers(spark, d):
    """What stands before the first label of transcripts written out with a heading."""
    line = F.concat(F.coalesce("etiqueta", F.lit("")), F.lit(": "), F.trim(F.regexp_replace(F.coalesce("texto", F.lit("")), "\\s+", " ")))
    listed = F.array_sort(F.collect_list(F.struct("orden", line.alias("l"))))
    docs = _turns(spark, d).groupBy("conferencia_id").agg(F.array_join(F.transform(listed, lambda x: x.l), "\n").alias("t"))
    written = F.concat(F.lit("Conferencia "), "conferencia_id", F.lit("\n"), "t")
    return docs.select("conferencia_id", documents.header(written).alias("encabezado"))


@query(f"""WITH {_C}, s AS (SELECT categoria, fragmento FROM c WHERE categoria IS NOT NULL AND fragmento IS NOT NULL QUALIFY row_number() OVER (PARTITION BY categoria ORDER BY md5(id_pregunta || '|' || '9'), id_pregunta)
  <= greatest(2, 40 // (SELECT count(DISTINCT categoria) FROM c WHERE categoria IS NOT NULL AND fragmento IS NOT NULL))), f AS (SELECT categoria, trim(regexp_replace(fragmento, '\\s+', ' ', 'g')) AS p FROM s),
l AS (SELECT '- ' || CASE WHEN length(p) <= 200 THEN p ELSE regexp_replace(left(p, 200), ' [^ ]*$', '') || '…' END || ' → ' || categoria AS l FROM f)
SELECT string_agg(l, chr(10) ORDER BY l) AS bloque FROM l""")
def examples_block(spark, d):
    """Examples for a labeller's prompt, the same number of each category."""
    rows = _labels(spark, d).where("categoria is not null and fragmento is not null")
    return classify.examples_block(agg.stratified_sample(rows, ["id_pregunta"], "categoria", 40, "9"), "categoria", "fragmento")
