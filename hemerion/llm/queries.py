"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemerion.llm.consensus import agreement, consensus, distinct_votes
from hemerion.llm.leakage import leaked_items
from hemerion.llm.mapping import map_fields, map_to_list
from hemerion.llm.names import link_names, name_pairs, stacked
from hemerion.llm.neardup import near_duplicates, text_pairs
from hemerion.llm.residue import residue_documents
from hemerion.llm.tokens import decode_corpus, encode_corpus
from hemerion.operators.packed import compound_heads, packed_values
from hemerion.session import materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outlets and beneficiaries meant by what people typed; -1 for none on the list."""
    outlets = table(spark, sf_dir, "catalogo_medios")
    heads = compound_heads(outlets, "nombre")
    threads = table(spark, sf_dir, "hilos").select("conferencia_id", "hilo", "medio").where(F.trim("medio") != "")
    values = packed_values(F.col("medio"), heads)
    spoken = threads.select(
        F.lit("hilos.medio").alias("origen"),
        F.concat_ws("#", "conferencia_id", "hilo").alias("clave"),
        F.explode(F.when(F.size(values) > 0, values).otherwise(F.array("medio"))).alias("value"),
    )
    bridge = table(spark, sf_dir, "puente_medios")
    key = F.col("puente_id").cast("string").alias("clave")
    typed = spoken.unionByName(
        bridge.select(F.lit("puente_medios.medio_hablado").alias("origen"), key, F.col("medio_hablado").alias("value"))
    )
    paid = bridge.select(
        F.lit("puente_medios.beneficiario_canonico").alias("origen"), key, F.col("beneficiario_canonico").alias("value")
    )
    of_outlets = map_to_list(typed, outlets, "medio_id", "nombre")
    of_payees = map_to_list(paid, table(spark, sf_dir, "catalogo_beneficiarios"), "beneficiario_id", "razon_social", legal=True)
    columns = F.col("origen"), F.col("clave"), F.col("value")
    return map_fields(typed, *columns, of_outlets).unionByName(map_fields(paid, *columns, of_payees))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings that write one person's name."""
    threads = table(spark, sf_dir, "hilos")
    names = stacked((threads, "periodista"), (threads, "periodista_canonico"), (table(spark, sf_dir, "turnos"), "hablante"))
    return name_pairs(materialize(link_names(names), "identities"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of subjects that put one matter in slightly different words."""
    labels = table(spark, sf_dir, "clasificaciones")
    texts = labels.select(F.explode(F.array("asunto", "asunto_canonico")).alias("text"))
    pairs = text_pairs(*near_duplicates(texts))
    return pairs.select(F.col("t").alias("asunto_a"), F.col("u").alias("asunto_b"))


LABELS = ["crítica", "favorable", "neutral", "no clasificable"]


def _stance_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_votes(table(spark, sf_dir, "posturas"), "id_pregunta", "pasada", "postura", "recibido_en", LABELS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label that each question with three or more answers deserves."""
    items, _ = consensus(_stance_votes(spark, sf_dir), LABELS)
    return items.where("votes >= 3").select(F.col("item").alias("id_pregunta"), F.col("label").alias("postura"))


def p4_acuerdo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled question with its label, certainty and agreement."""
    items, _ = consensus(_stance_votes(spark, sf_dir), LABELS)
    return items.select(
        F.col("item").alias("id_pregunta"), F.col("label").alias("postura"), F.round("sure", 4).alias("certeza"),
        F.col("votes").alias("pasadas"), F.round("agreement", 4).alias("acuerdo"),
    )


def p4_confianza(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each pasada can be trusted, and what it answers when it guesses."""
    _, model = consensus(_stance_votes(spark, sf_dir), LABELS)
    rows = [
        (int(a), round(float(c), 4), *[round(float(x), 4) for x in g])
        for a, c, g in zip(model.annotators, model.competence, model.guesses)
    ]
    columns = ", ".join(f"adivina_{name} double" for name in ("critica", "favorable", "neutral", "no_clasificable"))
    return spark.createDataFrame(rows, f"pasada int, competencia double, {columns}")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_texto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return decode_corpus(p6_ids(spark, sf_dir), "doc_id")


def p6_tramos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with where their last token ends, in characters, and how many tokens leave characters out before them."""
    spans = encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", offsets=True)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    walked = F.aggregate(F.arrays_zip("starts", "ends"), start, lambda s, x: F.struct(
        x.ends.alias("end"), (s.n + (x.starts > s.end).cast("int")).alias("n")))
    return spans.select("doc_id", walked.end.alias("fin"), walked.n.alias("huecos"))


def p4_medida(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many answers each question has and what share of their pairs agree."""
    votes = agreement(_stance_votes(spark, sf_dir))
    return votes.select(F.col("item").alias("id_pregunta"), F.col("votes").alias("pasadas"), F.round("agreement", 4).alias("acuerdo"))


def p2_identidades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the identity it belongs to and how many spellings that has."""
    threads = table(spark, sf_dir, "hilos")
    names = stacked((threads, "periodista"), (threads, "periodista_canonico"), (table(spark, sf_dir, "turnos"), "hablante"))
    linked = link_names(names)
    sizes = linked.groupBy("identity").agg(F.count("*").alias("variantes"))
    return linked.join(sizes, "identity").select(F.col("name").alias("nombre"), F.col("identity").alias("identidad"), "variantes")


def p3_grupos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject with its word set, how many spellings that has and to how many other sets it is linked."""
    labels = table(spark, sf_dir, "clasificaciones")
    members, links = near_duplicates(labels.select(F.explode(F.array("asunto", "asunto_canonico")).alias("text")))
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("enlaces"))
    sizes = members.groupBy("id").agg(F.count("*").alias("variantes"))
    found = members.join(sizes, "id").join(ends, "id", "left")
    return found.select(F.col("text").alias("asunto"), F.col("id").alias("conjunto"), "variantes", F.coalesce("enlaces", F.lit(0)).alias("enlaces"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold twelve consecutive words of an evaluation item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "items_evaluacion")
    found = leaked_items(docs, "doc_id", "text", items, "item_id", "texto")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with template residue, filler, error pages or script notices."""
    return residue_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found, "p2_found": p2_found, "p2_identidades": p2_identidades, "p3_found": p3_found, "p3_grupos": p3_grupos, "p4_found": p4_found, "p4_acuerdo": p4_acuerdo,
    "p4_confianza": p4_confianza, "p4_medida": p4_medida, "p6_ids": p6_ids, "p6_texto": p6_texto, "p6_tramos": p6_tramos, "p7_found": p7_found, "p8_found": p8_found,
}
ORACLES: dict[str, str] = {
    "p6_texto": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p6_tramos": "SELECT doc_id, cast(length(coalesce(text, '')) AS int) AS fin, 0 AS huecos FROM documents",
    "p4_medida": """WITH w AS (SELECT id_pregunta, pasada, recibido_en, trim(regexp_replace(strip_accents(lower(replace(postura, '_', ' '))), '[^a-z0-9]+', ' ', 'g')) AS p FROM posturas WHERE postura IS NOT NULL),
x AS (SELECT id_pregunta, pasada, arg_max(p, struct_pack(a := recibido_en, b := p)) AS p FROM w WHERE p IN ('critica', 'favorable', 'neutral', 'no clasificable') GROUP BY 1, 2),
n AS (SELECT id_pregunta, p, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT id_pregunta, sum(n) AS v, sum(n * (n - 1)) AS iguales FROM n GROUP BY 1)
SELECT id_pregunta, cast(v AS int) AS pasadas, round(iguales / nullif(v * (v - 1), 0), 4) AS acuerdo FROM s""",
}
