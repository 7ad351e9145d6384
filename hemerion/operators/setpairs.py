"""Pairs of sets that share enough, found under keys of their rarest members.

The members of a set are put in order, the rarest first. Of a set of ``x`` members a partner has at least
``share * x``, so the first of the members common to both stand behind few that are not, and each set
lists all keys that can be the first common ones: one member if it is rare, up to ``DEEPEST`` if it is
frequent. Sets that meet in a key are told apart by their further members, again the first
common ones first, until few are left that are compared each with each. No pair that shares enough
is missed, and no group is cut.

Scale: a set of ten members lists four to twenty keys, each with four bytes for every member behind it. What meets
under a key lies in one task, which holds that group and beside it ``AT_ONCE`` rows on each level: a
group that would be more is told apart in portions, each with a part of the members that can be common next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import xxhash

#: Sets that one member, and each further one a ``SPARSER``-th as often, may bring together under a key; most members in a key.
TOGETHER, SPARSER, DEEPEST = 20_000, 4, 3
#: Sets of a group that are compared each with each; rows, and pairs, that are looked at in one go.
FEW, AT_ONCE = 16, 50_000
#: Members beyond which a set has too many keys; its size has to fit the byte that ``shape`` has for it.
LONG = 32
#: Most members whose counts are shipped to the workers: those that make up more than this part of all.
LISTED = 20_000
#: Rows that are sent on together.
SENT = 10_000

KEYS, PAIRS = "key long, id long, shape int, rest binary", "a long, b long"


def least(size: int, share: float) -> int:
    """Fewest members that a set of ``size`` has in common with any partner."""
    return ceil(share * size - 1e-9)


def coder(counts: dict[str, int]) -> Callable[[str], tuple[int, int]]:
    """Gives each member its place in the order: how many sets have it, and four bytes that are never 0."""

    def coded(member: str) -> tuple[int, int]:
        return counts.get(member, 0), xxhash.xxh32_intdigest(member) or 1

    known = {m: coded(m) for m in counts}
    return lambda member: known.get(member) or coded(member)


def first_common(share: float, members: Callable[[list[str], list | None], list[str]], counts: dict[str, int], together: int = TOGETHER):
    """Rows (key, id, shape, rest) of each set (id, words, changed): the members that can be the first it has in common with a partner.

    ``members`` gives what a set holds for its words. ``shape`` holds the number of words, of members in the key and of
    members that may still be passed over; ``rest`` the members behind the key.
    """

    def deep(count: int) -> int:
        k = 1
        while k < DEEPEST and count > together * SPARSER ** (k - 1):
            k += 1
        return k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = coder(counts)
        keys, ids, shapes, rests = [], [], [], []

        def sent() -> pd.DataFrame:
            out = pd.DataFrame({"key": keys, "id": ids, "shape": shapes, "rest": rests}).astype({"key": "int64", "id": "int64", "shape": "int32"})
            for column in (keys, ids, shapes, rests):
                column.clear()
            return out

        for batch in batches:
            for i, words, own in zip(batch["id"].tolist(), batch["words"], batch["changed"]):
                size = len(words)
                order = sorted(map(place, members(words, own)))
                fewest, hashes = least(size, share), [h for _, h in order]
                spare, packed = len(order) - fewest, np.array(hashes, dtype=np.uint32).tobytes()
                # Pairs with fewer members in common than a key may have lie between short sets; these also meet in single ones.
                for short in (False, True) if fewest < DEEPEST else (False,):
                    for p in range(min(spare + 1, len(order))):
                        depth = 1 if short else deep(order[p][0])
                        reach = spare - p + depth - 1
                        for more in combinations(range(p + 1, min(p + 1 + reach, len(order))), depth - 1):
                            last = more[-1] if more else p
                            at = np.array([hashes[k] for k in (p, *more)], dtype=np.uint32).tobytes() if more else packed[4 * p : 4 * p + 4]
                            keys.append(xxhash.xxh64_intdigest(at, short) - (1 << 63))
                            ids.append(i)
                            shapes.append(size | depth << 8 | (spare - (last + 1 - depth)) << 16)
                            rests.append(packed[4 * last + 4 :])
                if len(keys) >= SENT:
                    yield sent()
        yield sent()

    return run


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of its run, its place there, length of its run) of each element of an ordered array."""
    new = np.append(True, group[1:] != group[:-1])
    first = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    return number, np.arange(len(group)) - first[number], np.diff(np.append(first, len(group)))[number]


def _each_with_each(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the two of every pair within the runs of an ordered array, in parts."""
    _, place, _ = _runs(group)
    start, ends = 0, np.cumsum(place)
    while start < len(group):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
        # The pairs of one set may be more than that; it is then set against a part of the others at a time.
        for low in range(0, int(place[stop - 1]) if stop == start + 1 else 1, AT_ONCE):
            reps = np.minimum(place[start:stop] - low, AT_ONCE) if stop == start + 1 else place[start:stop]
            right = np.repeat(np.arange(start, stop), reps)
            left = right - 1 - low - (np.arange(len(right)) - np.repeat(np.cumsum(reps) - reps, reps))
            if len(right):
                yield left, right
        start = stop


def _enough(rows: dict[str, np.ndarray], group: np.ndarray, share: float) -> Iterator[np.ndarray]:
    """(a, b) of the pairs within groups that have enough members in common."""
    for left, right in _each_with_each(group):
        need = np.ceil(share * (rows["size"][left].astype(np.int64) + rows["size"][right]) / (1 + share) - 1e-9) - rows["depth"][left]
        may = (need <= np.minimum(rows["behind"][left], rows["behind"][right])) & (rows["id"][left] != rows["id"][right])
        left, right, need = left[may], right[may], need[may]
        x, y = rows["rest"][left], rows["rest"][right]
        common = np.zeros(len(x), dtype=np.int64)
        for j in range(x.shape[1]):
            common += ((y == x[:, j, None]) & (x[:, j, None] != 0)).any(axis=1)
        hit = common >= need
        if hit.any():
            yield np.stack([rows["id"][left[hit]], rows["id"][right[hit]]], axis=1)


def _portions(number: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, stop, portions) of rows with ordered group numbers: whole groups that together give ``AT_ONCE`` parts, or one that gives more."""
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    bounds, ends = np.append(first, len(number)), np.cumsum(np.add.reduceat(parts, first))
    k = 0
    while k < len(first):
        done = int(ends[k - 1]) if k else 0
        stop = max(k + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
        yield int(bounds[k]), int(bounds[stop]), max(1, -(-(int(ends[stop - 1]) - done) // AT_ONCE))
        k = stop


def told_apart(rows: dict[str, np.ndarray], share: float, few: int = FEW) -> Iterator[np.ndarray]:
    """(a, b) of the pairs in each group of ``rows`` that have enough members in common.

    Large groups are split by the next common member, as often as it takes.
    """
    if not len(rows["group"]):
        return
    order = np.argsort(rows["group"], kind="stable")
    rows = {k: v[order] for k, v in rows.items()}
    number, _, length = _runs(rows["group"])
    small = (length > 1) & (length <= few)
    yield from _enough({k: v[small] for k, v in rows.items()}, number[small], share)
    rows, number = {k: v[length > few] for k, v in rows.items()}, number[length > few]
    if not len(number):
        return
    # Where the members so far are enough for some, nothing further has to be common.
    smallest = np.full(number.max() + 1, 1 << 30)
    np.minimum.at(smallest, number, rows["size"])
    enough = share * (rows["size"] + smallest[number]) / (1 + share) - 1e-9 <= rows["depth"]
    if enough.any():
        yield from _enough({k: v[enough] for k, v in rows.items()}, number[enough], share)
    for start, stop, portions in _portions(number, np.clip(np.minimum(rows["spare"] + 1, rows["behind"]), 0, None)):
        own, of = {k: v[start:stop] for k, v in rows.items()}, number[start:stop]
        for portion in range(portions):
            yield from told_apart(_by_next(own, of, portions, portion), share, few)


def _by_next(rows: dict[str, np.ndarray], number: np.ndarray, portions: int, portion: int) -> dict[str, np.ndarray]:
    """The rows under each member that can be the next common one and falls in this portion."""
    parts, width = [], max(1, int(rows["behind"].max()) - 1)
    for j in range(int(rows["behind"].max())):
        on = (j < rows["behind"]) & (j <= rows["spare"])
        if portions > 1:
            on &= rows["rest"][:, j] % np.uint32(portions) == portion
        if not on.any():
            continue
        rest = np.zeros((int(on.sum()), width), dtype=np.uint32)
        behind = rows["rest"][on, j + 1 : width + 1]
        rest[:, : behind.shape[1]] = behind
        parts.append({
            "group": number[on].astype(np.uint64) << np.uint64(32) | rows["rest"][on, j], "id": rows["id"][on], "size": rows["size"][on], "depth": rows["depth"][on] + 1,
            "spare": rows["spare"][on] - j, "behind": rows["behind"][on] - j - 1, "rest": rest,
        })
    return {k: np.concatenate([p[k] for p in parts]) if parts else v[:0] for k, v in (rows | {"group": number}).items()}


def _unpacked(batch: pd.DataFrame) -> dict[str, np.ndarray]:
    shape, behind = batch["shape"].to_numpy(), (batch["rest"].str.len().to_numpy() // 4).astype(np.int32)
    rest = np.zeros((len(batch), max(1, int(behind.max()))), dtype=np.uint32)
    rest[np.arange(rest.shape[1]) < behind[:, None]] = np.frombuffer(b"".join(batch["rest"]), dtype=np.uint32)
    return {"group": batch["key"].to_numpy(), "id": batch["id"].to_numpy(), "size": shape & 255, "depth": shape >> 8 & 255, "spare": shape >> 16, "behind": behind, "rest": rest}


def _together(held: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    rest = np.zeros((sum(len(h["id"]) for h in held), max(h["rest"].shape[1] for h in held)), dtype=np.uint32)
    start = 0
    for h in held:
        rest[start : start + len(h["id"]), : h["rest"].shape[1]] = h["rest"]
        start += len(h["id"])
    return {k: rest if k == "rest" else np.concatenate([h[k] for h in held]) for k in held[0]}


def meet(share: float, few: int = FEW):
    """(a, b) of the sets that share enough, from rows of ``first_common`` that are ordered by key."""

    def pairs(rows: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        found, n = [], 0
        for part in told_apart(rows, share, few):
            found.append(part)
            n += len(part)
            if n >= SENT:
                yield sent(found)
                found, n = [], 0
        if n:
            yield sent(found)

    def sent(found: list[np.ndarray]) -> pd.DataFrame:
        both = np.concatenate(found)
        return pd.DataFrame({"a": both.min(axis=1), "b": both.max(axis=1)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(_unpacked(batch))
            # A group may go on in the next batch; it waits until its key has changed.
            if sum(len(h["id"]) for h in held) >= AT_ONCE and held[0]["group"][0] != held[-1]["group"][-1]:
                rows = _together(held)
                last = int(np.searchsorted(rows["group"], rows["group"][-1]))
                held = [{k: v[last:].copy() for k, v in rows.items()}]
                yield from pairs({k: v[:last] for k, v in rows.items()})
        if held:
            rows, held = _together(held), []
            yield from pairs(rows)

    return run
