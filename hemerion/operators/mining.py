"""Sentences in which someone says that a matter is being looked into.

Sentences are arrays of tokens; a construction is a gerund of inquiry with an auxiliary one
to three tokens before it. All of it is Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemerion.functions.rules import AUXILIARIES, FORM_ORDER, GERUNDS, OWN_SIDE, acting_subject, verb_form
from hemerion.functions.text import plain, sentences

#: The verb that counts in any of its forms, and the beginnings and words that are its forms.
MAIN, MAIN_BEGINNINGS, MAIN_WORDS = "revisar", ["revisa", "revise"], ["reviso"]
#: A verb that is no inquiry where one of these words stands in the sentence.
TRADE_WORDS = {"estudiar": ["estudiante", "estudiantes"]}
#: Tokens that may stand between auxiliary and gerund.
BETWEEN = 2


def _words(token: Column) -> Column:
    return F.regexp_replace(token, "^[^a-z0-9_]+|[^a-z0-9_]+$", "")


def _constructions(tokens: Column) -> Column:
    """array(struct(verbo, antes, aux)) of the gerunds that have an auxiliary."""
    verbs = F.create_map(*[x for g, v in GERUNDS.items() for x in (F.lit(g), F.lit(v))])
    nothing = F.struct(F.lit(None).cast("string").alias("verbo"), F.lit("").alias("antes"), F.lit("").alias("aux"))

    def at(token: Column, k: Column) -> Column:
        found = nothing
        for back in range(1, BETWEEN + 2):
            auxiliary = F.get(tokens, k - back)
            # Signs may stand before the auxiliary, none between it and the gerund.
            said = F.regexp_replace(auxiliary, "^[^a-z0-9_]+", "")
            between = [F.get(tokens, k - j) for j in range(1, back)]
            plain_between = [b.rlike("^[a-z0-9_]+$") & ~b.isin(list(GERUNDS)) for b in between]
            fits = said.isin(AUXILIARIES)
            for test in plain_between:
                fits = fits & test
            before = F.coalesce(_words(F.get(tokens, k - back - 1)), F.lit(""))
            construction = F.struct(verbs[_words(token)].alias("verbo"), before.alias("antes"), said.alias("aux"))
            found = F.when(fits, construction).otherwise(found)
        return F.when(_words(token).isin(list(GERUNDS)), found).otherwise(nothing)

    return F.filter(F.transform(tokens, at), lambda c: c.verbo.isNotNull())


def _without_trade(said: Column, verb: str, trade: Column) -> Column:
    return F.filter(said, lambda s: ~((s.verbo == verb) & trade))


def findings(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, posicion, oracion, verbo, forma, sujeto), each verb once per sentence.

    Gerunds come first; the main verb counts in any form where it isn't a gerund already.
    """
    rows = texts.select(*keys, F.posexplode(sentences(F.col(text))).alias("posicion", "oracion"))
    folded = F.trim(F.regexp_replace(plain(F.col("oracion")), "\\s+", " "))
    # Most sentences hold none of the verbs; a look for their letters spares them the rest.
    hints = "|".join(sorted({g[:6] for g in GERUNDS} | set(MAIN_BEGINNINGS) | set(MAIN_WORDS)))
    rows = rows.withColumn("__p", folded).where(F.col("__p").rlike(hints)).withColumn("__t", F.split("__p", " "))
    rows = rows.withColumn("__w", F.transform("__t", _words)).withColumn("__c", _constructions(F.col("__t")))
    said = F.col("__c")
    for verb, words in TRADE_WORDS.items():
        said = _without_trade(said, verb, F.arrays_overlap("__w", F.array(*[F.lit(w) for w in words])))
    rows = rows.withColumn("__c", said)
    listed = F.transform("__c", lambda s: s.verbo)
    once = F.filter("__c", lambda s, k: F.array_position(listed, s.verbo) == k + 1)
    begins = F.exists("__w", lambda w: F.lit(False) | w.isin(MAIN_WORDS) | w.startswith(MAIN_BEGINNINGS[0]) | w.startswith(MAIN_BEGINNINGS[1]))
    main = F.array(F.struct(F.lit(MAIN).alias("verbo"), F.lit("").alias("antes"), F.lit("").alias("aux")))
    every = F.when(begins & ~F.array_contains(listed, MAIN), F.concat(once, main)).otherwise(once)
    out = rows.withColumn("__v", F.explode(every))
    # "Se" belongs to the construction unless the speaker's own side acts.
    passive = (F.col("__v.antes") == "se") & ~F.col("__v.aux").isin(OWN_SIDE)
    construction = F.concat(F.when(passive, "se ").otherwise(""), F.col("__v.aux"))
    form = F.when(F.col("__v.verbo") == MAIN, verb_form(F.col("oracion"))).otherwise(F.lit("en_curso"))
    flat = F.trim(F.regexp_replace("oracion", "\\s+", " "))
    return out.select(*keys, "posicion", flat.alias("oracion"), F.col("__v.verbo").alias("verbo"), form.alias("forma"),
                      acting_subject(construction).alias("sujeto"))


def form_rank(form: Column) -> Column:
    """Place of a form from the most committed on."""
    return F.array_position(F.array(*[F.lit(f) for f in FORM_ORDER]), form)


def best_form(found: DataFrame, keys: list[str]) -> DataFrame:
    """The most committed finding of each key, the first of equal ones."""
    w = Window.partitionBy(*keys).orderBy(form_rank(F.col("forma")), "posicion", "verbo")
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
