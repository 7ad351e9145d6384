import datetime
import os
import random

import pytest

from hemerion.llm import consensus, leakage, tokens

LABELS = ["crítica", "favorable", "neutral", "no clasificable"]


def votes(spark, rows):
    at = datetime.datetime(2025, 1, 1)
    full = [(i, a, l, at + datetime.timedelta(days=d), "x") for i, a, l, d in rows]
    return spark.createDataFrame(full, "q string, p int, l string, r timestamp, label string")


def test_labels_are_cleaned_and_the_last_counts(spark):
    df = votes(spark, [("a", 1, " CRITICA.", 0), ("a", 1, "Neutral", 1), ("a", 2, None, 0), ("a", 3, "no_clasificable", 0), ("a", 4, "otra", 0), (None, 1, "neutral", 0)])
    got = consensus.distinct_votes(df, "q", "p", "l", "r", LABELS).collect()
    assert sorted(map(tuple, got)) == [("a", 1, "neutral"), ("a", 3, "no clasificable")]


def test_reliable_annotators_win(spark):
    rng = random.Random(5)
    skill = {0: 0.95, 1: 0.9, 2: 0.9, 3: 0.1, 4: 0.1, 5: 0.1, 6: 0.8}
    truth = {f"q{k}": rng.choice(LABELS) for k in range(600)}
    rows = []
    for q, t in truth.items():
        for p in rng.sample(list(skill), 5):
            rows.append((q, p, t if rng.random() < skill[p] else ("neutral" if p == 3 else rng.choice(LABELS)), 0))
    items, model = consensus.consensus(consensus.distinct_votes(votes(spark, rows), "q", "p", "l", "r", LABELS), LABELS)
    got = {r.item: r.label for r in items.collect()}
    right = sum(got[q] == t for q, t in truth.items()) / len(truth)
    by = dict(zip(model.annotators, model.competence))
    assert right > 0.93 and min(by[0], by[1], by[2], by[6]) > max(by[3], by[4], by[5]) and model.guesses[3].argmax() == 2


def test_consensus_of_few(spark):
    items, model = consensus.consensus(consensus.distinct_votes(votes(spark, [("a", 1, "neutral", 0)]), "q", "p", "l", "r", LABELS), LABELS)
    assert [(r.label, r.votes, r.agreement) for r in items.collect()] == [("neutral", 1, None)]
    empty = consensus.distinct_votes(votes(spark, [("a", 1, "neutral", 0)]).where("false"), "q", "p", "l", "r", LABELS)
    items, model = consensus.consensus(empty, LABELS)
    assert items.count() == 0 and model.annotators == []


def test_fit_runs_to_the_tolerance_or_raises(spark):
    rng = random.Random(3)
    rows = [(f"q{k}", p, rng.choice(LABELS[:2]), 0) for k in range(60) for p in range(3)]
    df = consensus.distinct_votes(votes(spark, rows), "q", "p", "l", "r", LABELS)
    with pytest.raises(ValueError, match="after 2 rounds"):
        consensus.consensus(df, LABELS, rounds=2)


needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.BYTE_BPE_50K), reason="no vocabulary file")
TEXTS = ["", " ", "Hola, ¿qué tal?", "<|endoftext|> x", "日本語 🙂 naïve\n\t", "Пресс-служба", "a" * 5000, "é" * 3, None]


@needs_vocabulary
def test_tokens_round_trip(spark):
    df = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(TEXTS)], "k long, t string, ids array<int>")
    rows = {r.k: r for r in tokens.encode_corpus(df, "k", "t", offsets=True).collect()}
    assert rows[0].ids == rows[8].ids == [] and rows[1].ids and 50256 not in rows[3].ids
    back = {r.k: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df, "k", "t"), "k").collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(TEXTS))
    for k, t in enumerate(TEXTS):
        if rows[k].ids:
            assert rows[k].starts[0] == 0 and rows[k].ends[-1] == len(t)
            assert all(a <= b for a, b in zip(rows[k].starts, rows[k].ends))
    # The opening mark is split over two tokens and lies in the spans of both; the others are exact.
    exact = [TEXTS[2][a:b] == tokens.decode_ids([i]) for i, a, b in zip(rows[2].ids, rows[2].starts, rows[2].ends)]
    assert exact.count(False) == 2 and "".join(tokens.decode_ids([i]) for i, ok in zip(rows[2].ids, exact) if ok) == "Hola, ¿qué tal?".replace(" ¿", "")
    assert tokens.encode_corpus(df.where("false"), "k", "t").count() == 0


@needs_vocabulary
def test_tokens_equal_the_rank_encoder():
    import base64
    import sys

    import tiktoken

    sys.path.insert(0, os.path.dirname(os.path.realpath(os.path.dirname(tokens.BYTE_BPE_50K))))
    import public_tokenizers

    path = os.path.join(os.path.dirname(tokens.BYTE_BPE_50K), "byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t for t in TEXTS if t]
    assert [e.ids for e in tokens.encode_texts(texts)] == [other.encode_ordinary(t) for t in texts]


def test_byte_table():
    table = tokens.byte_table()
    assert len(set(table.values())) == 256 and table[ord("A")] == "A" and table[ord(" ")] == "Ġ"


def test_bare_words():
    want = "senale bajo que pretexto la nina".split()
    for said in ("Señale, bajo qué pretexto la niña", "Se&ntilde;ale <b>bajo</b>\tqu&amp;eacute; pretexto la ni&#241;a", "Se\\u00f1ale bajo qu\\u00e9\\npretexto la ni\\u00f1a".replace("\\n", "\\n "),
                 "SEÑALE  BAJO QUÉ PRETEXTO—LA NI­ÑA", "SeÃ±ale bajo quÃ© pretexto la niÃ±a", "Señale bajo qu%C3%A9 pretexto la niña".replace("%C3%A9", "é")):
        assert leakage.bare_words(said) == want, said


def items_and_docs(seed):
    rng = random.Random(seed)
    words = ["de", "la", "el", "en"] * 8 + [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for k in range(60)]
    docs = []
    for k in range(150):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        source = rng.choice(items)[1].split()
        at, size = rng.randint(0, max(0, len(source) - 8)), rng.randint(6, 20)
        spot = rng.randint(0, len(parts))
        docs.append((k, " ".join(parts[:spot] + source[at : at + size] + parts[spot:])))
    return items, docs


@pytest.mark.parametrize("seed", range(6))
def test_leaks_equal_brute_force(seed):
    items, docs = items_and_docs(seed)
    index = leakage.ItemIndex([i for i, _ in items], [t for _, t in items])

    def runs(text):
        w = text.split()
        return {tuple(w[k : k + 12]) for k in range(len(w) - 11)}

    for _, text in docs:
        assert set(index.leaks(text)) == {i for i, t in items if runs(t) & runs(text)}


def test_retrieve_equals_scoring_all():
    items, docs = items_and_docs(9)
    index = leakage.ItemIndex([i for i, _ in items], [t for _, t in items])
    for _, text in docs:
        terms = set(text.split())
        scores = [sum(dict(index.postings[t]).get(at, 0.0) for t in terms if t in index.postings) for at in range(len(index.ids))]
        sure = {at for at, s in enumerate(scores) if s >= index.least[at] + 1e-6}
        assert sure <= set(index.retrieve(terms))


def test_leaked_items(spark):
    text = " ".join(f"palabra{k}" for k in range(30))
    items = spark.createDataFrame([(1, text, "a"), (2, "corto", "b"), (3, None, "c"), (None, text, "d"), (1, text, "e")], "item long, t string, doc string")
    docs = spark.createDataFrame([(10, "x " + text[60:260], 1), (11, text[:80], 1), (12, None, 1), (13, "", 1), (14, "y " * 100_000 + text, 1)], "k long, t string, runs int")
    for block in (20_000, 1):
        got = leakage.leaked_items(docs, "k", "t", items, "item", "t", block=block).collect()
        assert {(r.doc, r.item) for r in got} == {(10, 1), (14, 1)}
    assert leakage.leaked_items(docs.where("false"), "k", "t", items, "item", "t").count() == 0
    assert leakage.leaked_items(docs, "k", "t", items.where("false"), "item", "t").count() == 0


def test_markup_of_any_length(spark):
    words = [f"palabra{k}" for k in range(30)]
    text = " ".join(words)
    inside = [" ".join(words[:8]) + f" <a href='{'x' * size}'>" + " ".join(words[8:]) + "</a>" for size in (100, 400, 50_000)]
    inside += [" ".join(words[:8]) + f" <!-- {'> < ' * 300} --> " + " ".join(words[8:]), "<!--" * 20_000 + " " + text]
    items = spark.createDataFrame([(1, text)], "item long, t string")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(inside)] + [(9, " ".join(words[:12]))], "k long, t string")
    got = {r.doc: (r.runs, r.overlap) for r in leakage.leaked_items(docs, "k", "t", items, "item", "t").collect()}
    assert got == {k: (19, 1.0) for k in range(5)} | {9: (1, 1 / 19)}


def test_leaps_end_where_single_steps_end(spark):
    rng = random.Random(8)
    skill = [0.9, 0.85, 0.3, 0.2, 0.7]
    rows = []
    for k in range(300):
        truth = rng.choice(LABELS)
        rows += [(f"q{k}", p, truth if rng.random() < skill[p] else rng.choice(LABELS), 0) for p in rng.sample(range(5), 4)]
    df = consensus.distinct_votes(votes(spark, rows), "q", "p", "l", "r", LABELS)
    _, patterns = consensus._patterns(df, LABELS)
    model = consensus.fit(patterns, LABELS)
    again = consensus._round(patterns, model, 0.1)
    assert abs(again.flat() - model.flat()).max() < 1e-5
    plain = consensus.Mixture(model.annotators, model.competence * 0 + 0.7, model.guesses * 0 + 0.25, model.prior * 0 + 0.25)
    for _ in range(60):
        plain = consensus._round(patterns, plain, 0.1)
    assert abs(plain.flat() - model.flat()).max() < 1e-3
