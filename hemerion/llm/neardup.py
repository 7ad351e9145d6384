"""Near-duplicate short texts: keys of their rarest words, and for long ones signatures.

Texts become sets of folded words; equal sets are one node. A word stands for the most
frequent word within a slip (``slip_map``), so that a typing error keeps its meaning, and
where it is also within a slip of more frequent words that mean something else, for those
too (``other_meanings``). So any two words within two letters share a meaning.

The sets of meanings meet under keys of their rarest meanings (``operators/setpairs.py``): no pair that shares enough
is missed, and no group is cut.

Sets of more than ``LONG`` words have too many such keys. They, and all that are long enough to
be their partners, go through a multi-index Hamming join over b-bit signatures. A signature has one
bit from each of ``bits`` minwise hashes, so the expected distance
of two sets is ``bits * (1 - jaccard) / 2``. It is split into chunks. By the pigeonhole
principle two signatures that differ in at most ``chunks * (radius + 1) - 1`` bits agree
in some chunk up to ``radius`` errors; each side lists its chunk values with half of the
errors, so that the two lists meet and one equi-join finds all pairs under the distance,
with no cap on any bucket. Sets near the similarity asked for may have signatures a
little farther apart; a chunk of theirs agrees up to two errors nearly always (at two thirds
each of fifteen chunks of 21 bits does with chance 0.30, one of them with 0.995), so pairs
up to ``FARTHEST`` are kept. What either finds is verified on the words as typed, by a matching.

Scale: rows are counted per text and per word set first, so the general subjects that
fill a large part of the table are one node each. A set of ten words lists four to twenty keys, each
with four bytes for every meaning behind it; what meets under a key is told apart where it lies, and only
pairs that share enough leave the task. The counts of at most ``LISTED`` words reach the driver; how far
a key goes depends on them. A signature has 330 keys, but only long sets have one.

Defined results: null, empty and blank texts are left out, and so are texts without a
word of three letters; a text is never paired with itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemerion.llm.text import deletions, edits, repair, words
from hemerion.operators.entities import follow
from hemerion.operators.setpairs import FEW, KEYS, LISTED, LONG, PAIRS, TOGETHER, first_common, least, meet
from hemerion.session import materialize

CHUNKS, CHUNK_BITS, RADIUS = 8, 16, 2
#: Largest signature distance that the join is sure to find.
THRESHOLD = CHUNKS * (RADIUS + 1) - 1
#: The signatures of word sets: wide chunks, so that unrelated sets seldom agree in one.
SET_BITS, SET_CHUNKS, SET_WIDTH = 320, 15, 21
#: Largest distance of those that is verified: 53 bits are expected at two thirds, 80 are four deviations more.
FARTHEST = 80
#: Words whose letters are left out, and sets that are signed, in one go.
WORDS_AT_ONCE, SIGNED_AT_ONCE = 1_000, 200


def _word_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(words=[sorted({w for w in words(repair(t)) if len(w) > 2}) for t in batch["text"]])


def _pieces(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The batches in pieces of at most so many rows, since what is made of a row is many times its size."""
    for batch in batches:
        for k in range(0, len(batch), most):
            yield batch.iloc[k : k + most]


def _word_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _pieces(batches, WORDS_AT_ONCE):
        out = [(d, w, n) for w, n in zip(batch["word"], batch["n"]) for d in deletions(w, 2)]
        yield pd.DataFrame(out, columns=["key", "word", "n"])


def slip_map(counted: DataFrame) -> DataFrame:
    """(word, meant): words that a more frequent word within two letters stands for, at the end of the chain.

    ``counted``: word, n. Only alphabetic words of four or more letters take part.
    """
    keys = counted.where("word rlike '^[a-z]{4,}$'").mapInPandas(_word_keys, "key string, word string, n long")
    other = keys.select("key", F.col("word").alias("meant"), F.col("n").alias("n_meant"))
    best = (
        keys.hint("merge").join(other, "key").where("n_meant > n or (n_meant = n and meant < word)")
        .select("word", "meant", "n_meant", F.levenshtein("word", "meant", 2).alias("slip")).where("slip between 0 and 2")
        .groupBy("word").agg(F.max_by("meant", F.struct(-F.col("slip"), "n_meant", "meant")).alias("meant"))
    )
    return follow(best, "word", "meant")


def _meant_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _pieces(batches, WORDS_AT_ONCE):
        out = [(d, w, n, m) for w, n, m in zip(batch["word"], batch["n"], batch["meant"]) for d in deletions(w, 2)]
        yield pd.DataFrame(out, columns=["key", "word", "n", "meant"])


def other_meanings(counted: DataFrame, slips: DataFrame) -> DataFrame:
    """(word, others): what more frequent words within two letters mean, where the word's own chain leads elsewhere.

    ``counted``: word, n. ``slips``: word, meant. With these, any two words within two letters share a meaning.
    """
    known = counted.join(slips, "word", "left").select("word", "n", F.coalesce("meant", "word").alias("meant"))
    keys = known.where("word rlike '^[a-z]{4,}$'").mapInPandas(_meant_keys, "key string, word string, n long, meant string")
    near = keys.select("key", F.col("word").alias("near"), F.col("n").alias("n_near"), F.col("meant").alias("other"))
    met = keys.hint("merge").join(near, "key").where("meant != other and (n_near > n or (n_near = n and near < word))")
    return met.where(F.levenshtein("word", "near", 2) >= 0).groupBy("word").agg(F.collect_set("other").alias("others"))


def _signer(bits: int, draw: int):
    seeds = np.array([xxhash.xxh64_intdigest(f"{draw}-{k}") for k in range(bits)], dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches, SIGNED_AT_ONCE):
            at = {w: k for k, w in enumerate({w for ws in batch["meant"] for w in ws})}
            base = np.fromiter((xxhash.xxh64_intdigest(w) for w in at), dtype=np.uint64, count=len(at))
            with np.errstate(over="ignore"):
                h = base[:, None] ^ seeds[None, :]
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(31)
            rows = np.zeros((len(batch), bits), dtype=np.uint8)
            for k, ws in enumerate(batch["meant"]):
                # The lowest bit would favour small values; a middle bit of the least hash is even.
                rows[k] = (h[[at[w] for w in ws]].min(axis=0) >> np.uint64(20)) & np.uint64(1)
            packed = np.packbits(rows, axis=1)
            longs = packed.view(">i8").astype(np.int64)
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "signature": list(longs)})

    return run


def signatures(sets: DataFrame, bits: int = CHUNKS * CHUNK_BITS, draw: int = 0) -> DataFrame:
    """(id, signature) for rows of ``id``, ``meant``; ``bits`` is a multiple of 64, draws are independent."""
    return sets.select("id", "meant").where(F.size("meant") > 0).mapInPandas(_signer(bits, draw), "id long, signature array<long>")


def _chunk(signature: Column, k: int, width: int) -> Column:
    """Chunk ``k`` of a signature whose longs hold whole chunks."""
    per = 64 // width
    return F.shiftrightunsigned(signature[k // per], 64 - width * (k % per + 1)).bitwiseAND(F.lit((1 << width) - 1))


def hamming_join(signed: DataFrame, chunks: int = CHUNKS, width: int = CHUNK_BITS, radius: int = RADIUS, most: int | None = None) -> DataFrame:
    """(a, b, apart): all pairs of ids at most ``chunks * (radius + 1) - 1`` bits apart.

    Each side lists its chunk values with ``radius / 2`` errors, which is enough for both
    lists to meet. With ``most`` pairs up to that distance are kept where a chunk agrees, which
    beyond the guarantee most do. Only ids travel with the keys; the signatures join the pairs that met.
    """
    if radius not in (0, 2):
        raise ValueError("radius is 0 or 2")
    most = chunks * (radius + 1) - 1 if most is None else most
    values = F.explode(F.array(*[_chunk(F.col("signature"), k, width) + F.lit(k << width) for k in range(chunks)])).alias("value")
    errors = F.explode(F.array(F.lit(0), *[F.lit(1 << j) for j in range(width if radius else 0)])).alias("error")
    key = F.col("value").bitwiseXOR(F.col("error"))
    keyed = signed.select("id", values).select("id", "value", errors).select("id", key.alias("key"))
    # Explosion isn't in the size estimate, so the join is named: neither side is shipped whole.
    met = keyed.select("key", F.col("id").alias("a")).hint("merge").join(keyed.select("key", F.col("id").alias("b")), "key").where("a < b")
    longs = -(-chunks // (64 // width))
    apart = sum((F.bit_count(F.col("sign_a")[k].bitwiseXOR(F.col("sign_b")[k])) for k in range(longs)), F.lit(0))
    sign_a = signed.select(F.col("id").alias("a"), F.col("signature").alias("sign_a"))
    sign_b = signed.select(F.col("id").alias("b"), F.col("signature").alias("sign_b"))
    pairs = met.select("a", "b").distinct().join(sign_a, "a").join(sign_b, "b")
    return pairs.where(apart <= most).select("a", "b", apart.alias("apart"))


def candidates(meant: DataFrame) -> DataFrame:
    """(a, b) of the sets (id, meant) that may share two thirds of their words."""
    return hamming_join(materialize(signatures(meant, SET_BITS), "signatures"), SET_CHUNKS, SET_WIDTH, most=FARTHEST).select("a", "b")


def _meanings(words: list[str], changed: dict[str, list[str]]) -> list[str]:
    """What the words of a set mean; a meaning of several words is there several times, with numbers."""
    seen: dict[str, int] = {}
    for w in words:
        for m in changed.get(w, (w,)):
            seen[m] = seen.get(m, 0) + 1
    return [f"{m}#{k}" if k else m for m, times in seen.items() for k in range(times)]


def _changed(listed: dict[str, list[str]], own: list | None) -> dict[str, list[str]]:
    return listed if own is None else listed | {r["word"]: list(r["meanings"]) for r in own}


def _meant(listed: dict[str, list[str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            meant = [sorted({_changed(listed, c).get(w, [w])[0] for w in ws}) for ws, c in zip(batch["words"], batch["changed"])]
            yield pd.DataFrame({"id": batch["id"], "meant": meant})

    return run


def _first_common(share: float, listed: dict[str, list[str]], counts: dict[str, int]):
    """Rows (key, id, shape, rest) of each set: the meanings that can be the first it has in common with a partner."""
    return first_common(share, lambda words, own: _meanings(words, _changed(listed, own)), counts, TOGETHER)


def alike(sets: DataFrame, share: float = 2 / 3) -> DataFrame:
    """(a, b) of the sets (id, words, n) that may have ``share`` of their words in common, words within two letters counting as one."""
    typed = sets.select("id", "n", F.explode("words").alias("word"))
    vocabulary = materialize(typed.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("sets")), "vocabulary")
    slips = materialize(slip_map(vocabulary.select("word", "n")), "slips")
    meanings = vocabulary.join(slips, "word", "left").join(other_meanings(vocabulary.select("word", "n"), slips), "word", "left").select(
        "word", "sets", F.coalesce("meant", "word").alias("meant"), F.coalesce("others", F.array().cast("array<string>")).alias("others")
    )
    meanings = materialize(meanings.select("word", "sets", F.concat(F.array("meant"), "others").alias("meanings")), "meanings")
    rare_below = (vocabulary.agg(F.sum("sets")).first()[0] or 0) / LISTED
    frequent = meanings.where(F.col("sets") >= rare_below)
    listed = {r.word: r.meanings for r in frequent.collect() if r.meanings != [r.word]}
    standing = meanings.select("sets", F.explode("meanings").alias("meaning")).groupBy("meaning").agg(F.sum("sets").alias("sets"))
    counts = {r.meaning: r.sets for r in standing.where(F.col("sets") >= rare_below).collect()}
    # The meanings of frequent words are shipped; only rare ones have to be joined.
    rare = meanings.where((F.col("sets") < rare_below) & ((F.size("meanings") > 1) | (F.col("meanings")[0] != F.col("word")))).select("word", "meanings")
    others = typed.select("id", "word").join(F.broadcast(frequent.select("word")), "word", "left_anti")
    changed = others.join(rare, "word").groupBy("id").agg(F.collect_list(F.struct("word", "meanings")).alias("changed"))
    known = sets.select("id", "words").join(changed, "id", "left")
    keyed = known.where(F.size("words") <= LONG).mapInPandas(_first_common(share, listed, counts), KEYS)
    found = keyed.repartition("key").sortWithinPartitions("key").mapInPandas(meet(share, FEW), PAIRS)
    partners = F.size("words") >= least(LONG + 1, share)
    if not sets.where(partners).isEmpty():
        long = known.where(partners).mapInPandas(_meant(listed), "id long, meant array<string>")
        found = found.unionByName(candidates(long))
    return found.distinct()


_SLIPPED = re.compile("[a-z]{4,}")


def matched(left: list[str], right: list[str]) -> int:
    """Most words of one list that can each be given a word of the other within two letters (bipartite matching)."""
    near = [[j for j, y in enumerate(right) if _SLIPPED.fullmatch(x) and _SLIPPED.fullmatch(y) and edits(x, y, 2) <= 2] for x in left]
    of: dict[int, int] = {}

    def give(i: int, tried: set[int]) -> bool:
        for j in near[i]:
            if j not in tried:
                tried.add(j)
                if j not in of or give(of[j], tried):
                    of[j] = i
                    return True
        return False

    return sum(give(i, set()) for i in range(len(left)))


def same_words(a: Column, b: Column) -> Column:
    """At least the words common to both: equal, or of four or more letters and within two letters of some word."""
    left, right = F.array_except(a, b), F.array_except(b, a)
    long = "^[a-z]{4,}$"

    def partnered(xs: Column, ys: Column) -> Column:
        near = F.filter(xs, lambda x: x.rlike(long) & F.exists(ys, lambda y: y.rlike(long) & (F.levenshtein(x, y, 2) >= 0)))
        return F.size(near)

    return F.size(F.array_intersect(a, b)) + F.least(partnered(left, right), partnered(right, left))


def _verified(share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = set(x), set(y)
                common = len(x & y)
                common += matched(sorted(x - y), sorted(y - x))
                keep.append(common >= share * (len(x) + len(y) - common) - 1e-9)
            yield batch[keep][["a", "b"]]

    return run


def near_duplicates(texts: DataFrame, share: float = 2 / 3) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the texts in ``texts.text``.

    ``members``: text, id of its word set. ``links``: a < b, ids of different word sets
    whose common words are at least ``share`` of all their different words.
    """
    counted = texts.where(F.trim("text") != "").groupBy("text").agg(F.count("*").alias("n"))
    members = counted.mapInPandas(_word_sets, "text string, n long, words array<string>").where(F.size("words") > 0)
    members = materialize(members.withColumn("id", F.xxhash64(F.array_join("words", " "))), "members")
    sets = materialize(members.groupBy("id").agg(F.min("words").alias("words"), F.sum("n").alias("n")), "sets")
    pairs = materialize(alike(sets, share), "pairs")
    of = sets.select("id", "words")
    both = pairs.join(of.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(
        of.select(F.col("id").alias("b"), F.col("words").alias("y")), "b"
    )
    most = both.withColumn("most", same_words(F.col("x"), F.col("y"))).where(
        F.col("most") >= share * (F.size("x") + F.size("y") - F.col("most")) - 1e-9
    )
    return members.select("text", "id"), most.select("a", "b", "x", "y").mapInPandas(_verified(share), "a long, b long")


def text_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): different texts of one word set or of linked ones, the smaller first."""
    left = members.select(F.col("text").alias("t"), F.col("id").alias("a"))
    right = members.select(F.col("text").alias("u"), F.col("id").alias("b"))
    within = left.join(right.withColumnRenamed("b", "a"), "a").where("t < u").select("t", "u")
    across = links.join(left, "a").join(right, "b").select(F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u"))
    return within.unionByName(across)
