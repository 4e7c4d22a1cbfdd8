"""Maximal periodic runs of words by Karp-Miller-Rosenberg naming.

**Names.** Level 0 numbers the words of a text; the name of 2^(k+1) words is the number of the pair of names of
its halves, so equal names mean equal words and no fingerprint stands for any. A place whose words are unlike all
others of its text is *single* from then on: only places with a twin go to the next level, so ordinary text costs
two or three levels. Texts of a batch are named together, shortest first; their words are numbered apart, so no
match crosses from one to the next.

**Candidates.** Words q apart agree over at least ``least - q`` words of a run of period q. A grid of places half
that far apart, compared with the places q later at the level that fills the other half, meets every such stretch:
n / q comparisons for a period, n log n in all.

**Extension.** A met place grows both ways by descending levels. Places that a found run of the same period, or of
one that divides it, covers are not extended again, so a text of one word costs no more than another.

Contract: a run is a maximal stretch with smallest period q and ``length >= max(least_length, repeats * q)``. Null
and empty texts have no runs and keep their text; nothing depends on other rows; names take 4 bytes a word and
level, at most ``TOP + 1`` levels whatever the length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackline.llm import shared

#: Names cover at most 2^TOP words; longer matches take several steps of that.
TOP = 12
#: Leaders of a period's matches are extended in so many rounds, then all that is left at once.
ROUNDS = 4

RUN = "struct<start:long,length:long,period:long>"


def names(codes: np.ndarray) -> list[np.ndarray]:
    """By level k: the name of the 2^k words from each place on; single places have negative names of their own.

    ``codes`` are not negative. A last slot, for places beyond the end, is single too. Levels end where all are single.
    """
    n = len(codes)
    single = -1 - np.arange(n + 1, dtype=np.int32)
    level = single.copy()
    twice = np.bincount(codes)[codes] > 1 if n else np.zeros(0, bool)
    active = np.flatnonzero(twice)
    level[active] = codes[active]
    out = []
    while len(active) and len(out) < TOP:
        out.append(level)
        half = 1 << len(out) - 1
        active = active[active + half < n]
        left, right = level[active].astype(np.int64), level[active + half].astype(np.int64)
        both = right >= 0
        active, left, right = active[both], left[both], right[both]
        _, number, count = np.unique(left << 32 | right, return_inverse=True, return_counts=True)
        kept = count[number] > 1
        active = active[kept]
        level = single.copy()
        level[active] = number[kept]
    return out if not len(active) else [*out, level]


def forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree from i and from j on."""
    i, j, at = i.copy(), j.copy(), np.arange(len(i))
    begun = i.copy()
    for k in range(len(levels) - 1, -1, -1):
        now = at
        while len(now := now[levels[k][i[now]] == levels[k][j[now]]]):
            i[now] += 1 << k
            j[now] += 1 << k
            if k < len(levels) - 1:
                break  # below the top a level fits once at most
    return i - begun


def backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree before i and before j, for i < j."""
    i, j, at = i.copy(), j.copy(), np.arange(len(i))
    begun = i.copy()
    for k in range(len(levels) - 1, -1, -1):
        now, step = at, 1 << k
        while True:
            now = now[i[now] >= step]
            now = now[levels[k][i[now] - step] == levels[k][j[now] - step]]
            if not len(now):
                break
            i[now] -= step
            j[now] -= step
            if k < len(levels) - 1:
                break
    return begun - i


def _covered(found: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a stretch of ``found`` (starts ascending, ends) holds the places from ``at`` to ``ends``."""
    out = np.zeros(len(at), bool)
    for starts, stops in found:
        k = np.searchsorted(starts, at, "right") - 1
        out |= (k >= 0) & (ends <= stops[np.maximum(k, 0)])
    return out


def runs(codes: np.ndarray, bounds: np.ndarray, least_length: int = 6, repeats: int = 4) -> np.ndarray:
    """[start, end, period] of all runs in texts that end at ``bounds``, ordered by start, then period.

    Texts are ordered by length and have no code in common.
    """
    levels, n = names(codes), len(codes)
    lengths = np.diff(bounds, prepend=0)
    by_period: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for q in range(1, (int(lengths[-1]) // repeats if len(lengths) else 0) + 1):
        least = max(least_length, repeats * q)
        stretch = least - q
        k = min((stretch // 2).bit_length() - 1 if stretch > 1 else 0, TOP)
        if k >= len(levels):
            break  # no 2^k words occur twice, and k does not fall as q grows
        step, first = stretch - (1 << k) + 1, np.searchsorted(lengths, least)
        if first == len(lengths):
            break
        begin = int(bounds[first] - lengths[first])
        names_k = levels[k]
        later = names_k[begin + q : n : step]
        hits = begin + step * np.flatnonzero(names_k[begin : n - q : step][: len(later)] == later)
        if len(hits):
            hits = hits[~_covered([v for d, v in by_period.items() if q % d == 0], hits, hits + q + (1 << k))]
        found = []
        for turn in range(ROUNDS + 1):
            if not len(hits):
                break
            lead = hits[np.diff(hits, prepend=-step - 1) > step] if turn < ROUNDS else hits
            start = lead - backward(levels, lead, lead + q)
            stop = lead + q + forward(levels, lead, lead + q)
            found.append(np.stack([start, stop], axis=1))
            hits = hits[~_covered([(start, stop)], hits, hits + q + (1 << k))] if turn < ROUNDS else hits[:0]
        if found:
            all_found = np.unique(np.concatenate(found), axis=0)
            all_found = all_found[all_found[:, 1] - all_found[:, 0] >= least]
            if len(all_found):
                by_period[q] = all_found[:, 0], all_found[:, 1]
    if not by_period:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate([np.stack([s, e, np.full(len(s), q)], axis=1) for q, (s, e) in by_period.items()])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)  # of equal stretches the smallest period: the others are its multiples
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _batch(texts: list[bytes], least_length: int, repeats: int) -> list[tuple[np.ndarray, bytes]]:
    """Of each text its runs, and its words joined by one space without what repeats in a run."""
    words = [t.split() for t in texts]  # bytes: exactly space and \t to \r part words
    order = sorted(range(len(texts)), key=lambda k: len(words[k]))
    codes, total, ends = [], 0, []
    for k in order:
        own: dict[bytes, int] = {}
        codes.append(np.fromiter((own.setdefault(w, len(own)) for w in words[k]), np.int64, len(words[k])) + total)
        total += len(own)
    bounds = np.cumsum([len(c) for c in codes]) if codes else np.zeros(0, np.int64)
    rows = runs(np.concatenate(codes) if codes else np.zeros(0, np.int64), bounds, least_length, repeats)
    ends = np.searchsorted(rows[:, 0], bounds)
    out: list = [None] * len(texts)
    for place, k in enumerate(order):
        begin = int(bounds[place]) - len(words[k])
        own_runs = rows[ends[place - 1] if place else 0 : ends[place]] - [begin, begin, 0]
        kept = words[k]
        if len(own_runs):
            edge = np.zeros(len(kept) + 1, np.int64)
            np.add.at(edge, own_runs[:, 0] + own_runs[:, 2], 1)
            np.add.at(edge, own_runs[:, 1], -1)
            kept = [kept[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
        out[k] = own_runs, b" ".join(kept)
    return out


def find(text: str | Column, least_length: int = 6, repeats: int = 4) -> Column:
    """Struct column: ``runs`` (start, length, period in words, by start, then period) and the text ``collapsed``.

    Collapsed: words joined by one space, those left out that a run holds after its first period.
    """

    @F.arrow_udf(f"struct<runs:array<{RUN}>,collapsed:string>")
    def found(texts):
        import pyarrow as pa

        out = _batch([t or b"" for t in texts.cast(pa.binary()).to_pylist()], least_length, repeats)
        rows = np.concatenate([r for r, _ in out]) if out else np.zeros((0, 3), np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r, _ in out])]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], ["start", "length", "period"]))
        return pa.StructArray.from_arrays([listed, pa.array([c for _, c in out], pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    return found(text)


def greatest(runs_of: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first. None has null."""
    first = F.get(runs_of, F.lit(0))
    return F.reduce(runs_of, first, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def detect(docs: DataFrame, text: str | Column = "text", least_length: int = 6, repeats: int = 4, name: str = "periodic") -> DataFrame:
    """``docs`` with a struct column (runs, collapsed); no shuffle. A clashing name gets a leading "_"."""
    shared.session(docs)
    return docs.withColumn(shared.fresh(docs, name), find(text, least_length, repeats))
