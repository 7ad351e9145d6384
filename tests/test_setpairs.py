import itertools
import random
import tracemalloc
from datetime import datetime

import pandas as pd
import pytest

from hemerion.llm import neardup
from hemerion.operators import setpairs, similarity
from hemerion.plans import core_queries


def keyed(sets, share, counts, together=setpairs.TOGETHER):
    batch = pd.DataFrame({"id": range(len(sets)), "words": sets, "changed": [None] * len(sets)})
    rows = pd.concat(setpairs.first_common(share, lambda words, own: words, counts, together)([batch]))
    return rows.sort_values("key", kind="stable", ignore_index=True)


def subjects(rng, n, frequent):
    pool = [f"palabra{k}" for k in range(30)]
    return [[*frequent, *rng.sample(pool, rng.randint(0, 9))] for _ in range(n)]


@pytest.mark.parametrize("share", [0.6, 2 / 3, 1.0])
@pytest.mark.parametrize("at_once, few, together", [(50_000, 16, 20_000), (5, 2, 1), (1, 2, 20_000)])
def test_pairs_equal_brute_force_in_any_portions(monkeypatch, share, at_once, few, together):
    monkeypatch.setattr(setpairs, "AT_ONCE", at_once)
    sets = subjects(random.Random(3), 90, ["alto"]) + subjects(random.Random(4), 30, [])
    sets = [s for s in sets if s]
    counts = {w: sum(w in s for s in sets) * 1000 for w in {w for s in sets for w in s}}
    rows = keyed(sets, share, counts, together)
    batches = [rows[k : k + 7].reset_index(drop=True) for k in range(0, len(rows), 7)]
    got = {(a, b) for f in setpairs.meet(share, few)(batches) for a, b in zip(f["a"], f["b"])}
    shared = {(i, j): len(set(sets[i]) & set(sets[j])) for i, j in itertools.combinations(range(len(sets)), 2)}
    assert got == {p for p, n in shared.items() if n >= share * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9} and got


def peak(run):
    tracemalloc.start()
    for _ in run:
        pass
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_workers_hold_little_of_a_large_group():
    """What is made of a group's rows, of words and of signatures is many times as much; only a part of it exists at a time."""
    rng = random.Random(8)
    words = [f"nombre{k}" for k in range(60)]
    sets = [["primero", *rng.sample(words, 11)] for _ in range(12_000)]
    rows = keyed(sets, 2 / 3, {"primero": 1} | {w: 2 for w in words})
    rows = rows[rows["key"] == rows["key"].value_counts().index[0]].reset_index(drop=True)
    assert len(rows) == 12_000
    batches = [rows[k : k + 10_000].reset_index(drop=True) for k in range(0, len(rows), 10_000)]
    assert peak(setpairs.meet(2 / 3)(batches)) < 40
    typed = pd.DataFrame({"word": [f"{k:05d}abcdefg".translate(str.maketrans("0123456789", "hijklmnopq")) for k in range(3_000)], "n": 1})
    assert peak(neardup._word_keys([typed])) < 30
    long = pd.DataFrame({"id": range(1_000), "meant": [[f"x{rng.randrange(10**6)}" for _ in range(40)] for _ in range(1_000)]})
    assert peak(neardup._signer(320, 0)([long])) < 100


@pytest.mark.parametrize("longest", [12, 45])
def test_jaccard_pairs_equal_brute_force(spark, longest):
    """Also where some sets have too many words for keys."""
    rng = random.Random(longest)
    pool = [f"palabra{k}" for k in range(60)]
    sets = [rng.sample(pool, rng.randint(0, longest)) for _ in range(25)]
    sets += [[w for w in s if rng.random() > 0.15] + rng.sample(pool, 2) for s in sets for _ in range(3)]
    rows = [(f"asunto {k}", sorted(set(s))) for k, s in enumerate(sets)]
    got = [tuple(r) for r in similarity.jaccard_pairs(spark.createDataFrame(rows, "s string, w array<string>"), "s", "w", 0.6).collect()]
    want = set()
    for (a, x), (b, y) in itertools.combinations(rows, 2):
        value = len(set(x) & set(y)) / max(1, len(set(x) | set(y)))
        if value >= 0.6 - 1e-12:
            want.add((min(a, b), max(a, b), value))
    assert set(got) == want and len(got) == len(want) > 20


def test_unlike_subjects_with_frequent_words_move_little(spark):
    """Subjects that have six of ten words in common with all others are not written as pairs."""
    written = lambda: sum(e.totalShuffleWrite() for e in (seen.apply(k) for k in range(seen.size())))
    frequent = [f"frecuente{k}" for k in range(6)]
    rows = [(f"asunto {k}", [f"propia{k}x{j}" for j in range(4)] + frequent) for k in range(1_500)]
    sets = spark.createDataFrame(rows, "s string, w array<string>")
    status = spark.sparkContext._jsc.sc().statusStore()
    seen = status.executorList(True)
    before = written()
    assert similarity.jaccard_pairs(sets, "s", "w", 0.6).count() == 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = status.executorList(True)
    assert written() - before < 2e6


def shuffled(spark, run):
    """(result, bytes written to shuffles meanwhile)."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        seen = context.statusStore().executorList(True)
        return sum(seen.apply(k).totalShuffleWrite() for k in range(seen.size()))

    before = written()
    return run(), written() - before


UNLIKE = [" ".join([f"propia{k}x{j}" for j in range(4)] + [f"frecuente{j}" for j in range(6)]) for k in range(1_500)]


def test_consolidation_of_unlike_subjects_moves_little(spark):
    counts = spark.createDataFrame([(s, 1) for s in UNLIKE], "s string, n int")
    got, moved = shuffled(spark, lambda: similarity.consolidate(counts, "s", "n", 0.6).where("asunto = canonico").count())
    assert got == len(UNLIKE) and moved < 3e6


def test_consolidation_check_moves_little(spark, tmp_path):
    labels = [(f"p{k}", s, datetime(2025, 1, 1)) for k, s in enumerate(UNLIKE)]
    spark.createDataFrame(labels, "id_pregunta string, asunto string, recibido_en timestamp").write.parquet(str(tmp_path / "clasificaciones.parquet"))
    got, moved = shuffled(spark, lambda: core_queries.subject_consolidation_check(spark, str(tmp_path)).first())
    assert tuple(got) == (len(UNLIKE), len(UNLIKE), 0) and moved < 3e6
