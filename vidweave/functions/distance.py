"""Edit distances of many pairs of texts at once, by bit-parallel dynamic programming.

A pair's table is worked on by column: 64 rows of the shorter text are one word of vertical differences (Myers), the
words of a pair hand on the horizontal difference at their lower edge (Hyyrö). Word b of a pair takes the longer text's
character t - b in step t, so that all words of all pairs of a pack take a step in the same few numpy operations. Pairs
are packed by the steps they need; a pack holds a bounded number of words, or one pair. The longest pairs of a pack go by
themselves, in integers of any length, where too few share their steps. Distances count code points, as Spark's
levenshtein does, and are exact."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How many steps of a pair by itself cost as much as a step of a pack, beside what grows with the words in both.
STEP = 50
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def edit_distances(a: list[str], b: list[str], words: int = 8192) -> np.ndarray:
    """The edit distance of each pair; `words` bounds a pack."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    out = np.where([x == y for x, y in zip(a, b, strict=True)], 0, sizes.max(1))
    todo = np.flatnonzero((sizes.min(1) > 0) & (out > 0))
    if not len(todo):
        return out
    n_words = (sizes.min(1) + 63) // 64
    todo = todo[np.argsort(-(sizes.max(1) + n_words)[todo], kind="stable")]
    packs, held = [[]], 0
    for i in todo.tolist():
        if packs[-1] and held + n_words[i] > words:
            packs.append([])
            held = 0
        packs[-1].append(i)
        held += n_words[i]
    for pack in packs:
        pairs = [sorted((a[j], b[j]), key=len) for j in pack]
        steps = np.array([len(p[1]) for p in pairs] + [0]) + np.append(n_words[pack], 0)
        # by themselves: the pairs up to the one after which most is gained
        k = int(np.argmax(np.append(0, STEP * (steps[0] - steps[1:]) - np.cumsum(steps[:-1])))) if len(pairs) else 0
        out[pack] = [_single_distance(*p) for p in pairs[:k]] + (_pack_distances(pairs[k:]).tolist() if k < len(pairs) else [])
    return out


def _single_distance(shorter: str, longer: str) -> int:
    same: dict[str, int] = {}
    for i, c in enumerate(shorter):
        same[c] = same.get(c, 0) | 1 << i
    full = (1 << len(shorter)) - 1
    pv, mv, get = full, 0, same.get
    for c in longer:
        eq = get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = ((mv | (full & ~(xh | pv))) << 1) | 1
        xv = eq | mv
        pv = full & (((pv & xh) << 1) | ~(xv | ph))
        mv = full & ph & xv
    return len(longer) + pv.bit_count() - mv.bit_count()


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _pack_distances(pairs: list[list[str]]) -> np.ndarray:
    """The distances of pairs (shorter, longer), neither empty, with falling numbers of steps."""
    shorter, longer = [p[0] for p in pairs], [p[1] for p in pairs]
    m, n = np.array(list(map(len, shorter))), np.array(list(map(len, longer)))
    n_words = (m + 63) // 64
    first = np.cumsum(n_words) - n_words  # of each pair's words
    total, deepest = int(n_words.sum()), int(n_words.max())
    pair = np.repeat(np.arange(len(pairs)), n_words)
    depth = np.arange(total) - first[pair]

    # symbols of the shorter texts from 1; 0 stands for all others
    s, l = _points(shorter), _points(longer)
    number = np.zeros(int(max(s.max(), l.max())) + 1, np.int64)
    number[s] = 1
    symbols = np.flatnonzero(number)
    number[symbols] = np.arange(1, len(symbols) + 1)
    rows = np.zeros((total, 64), np.int64)
    rows.reshape(-1)[np.arange(len(s)) + np.repeat(64 * first - (np.cumsum(m) - m), m)] = number[s]
    width, word = len(symbols) + 1, np.arange(total)
    same = np.zeros((total, width), np.uint64)
    for bit in range(64):
        same[word, rows[:, bit]] |= np.uint64(1 << bit)
    same[:, 0] = 0
    same = same.reshape(-1)

    text = np.concatenate([np.zeros(deepest, np.int64), number[l], np.zeros(deepest + 1, np.int64)])
    at = deepest + (np.cumsum(n) - n)[pair] - depth
    base = word * width
    last = n[pair] + depth - 1  # a word's last step
    order = np.argsort(last, kind="stable")
    ends = np.searchsorted(last[order], np.arange(int(last.max()) + 2))
    begins = [np.flatnonzero(depth == d) for d in range(deepest)]
    left = np.maximum.accumulate(last[::-1])[::-1]  # the last step of a word or any after it
    used = np.minimum(m[pair] - 64 * depth, 64).astype(np.uint64)
    mask = np.where(used == 64, _ONES, (np.uint64(1) << (used % np.uint64(64))) - np.uint64(1))

    pv, mv = np.full(total, _ONES), np.zeros(total, np.uint64)
    x, xv, ph, eq = (np.zeros(total, np.uint64) for _ in range(4))
    code = np.zeros(total, np.int64)
    hp, hn, hp2, hn2 = (np.zeros(total + 1, np.uint64) for _ in range(4))
    hp[first] = hp2[first] = 1
    top, one = np.uint64(63), np.uint64(1)
    result, live, heads = n.copy(), 0, first
    for t in range(int(last.max()) + 1):
        now = int(np.searchsorted(-left, -t, side="right"))  # words that have not all ended
        if t == 0 or now < 0.94 * live:
            live, heads = now, first[first < now]
            v = [z[:live] for z in (at, code, base, eq, xv, x, ph, pv, mv)]
        vat, vcode, vbase, veq, vxv, vx, vph, vpv, vmv = v
        if t < deepest:
            pv[begins[t]], mv[begins[t]] = _ONES, 0
        p, q = hp[:live], hn[:live]
        np.take(text, vat, out=vcode, mode="clip")
        vcode += vbase
        np.take(same, vcode, out=veq, mode="clip")
        vat += 1
        np.bitwise_or(veq, vmv, out=vxv)
        veq |= q
        np.bitwise_and(veq, vpv, out=vx)
        vx += vpv
        vx ^= vpv
        vx |= veq
        np.bitwise_or(vx, vpv, out=vph)
        np.invert(vph, out=vph)
        vph |= vmv
        vx &= vpv
        np.right_shift(vph, top, out=hp2[1 : live + 1])
        np.right_shift(vx, top, out=hn2[1 : live + 1])
        vph <<= one
        vph |= p
        vx <<= one
        vx |= q
        np.bitwise_or(vxv, vph, out=vpv)
        np.invert(vpv, out=vpv)
        vpv |= vx
        np.bitwise_and(vph, vxv, out=vmv)
        hp2[heads], hn2[heads] = 1, 0
        hp, hn, hp2, hn2 = hp2, hn2, hp, hn
        if ends[t] < ends[t + 1]:
            done = order[ends[t] : ends[t + 1]]
            k = mask[done]
            np.add.at(result, pair[done], np.bitwise_count(pv[done] & k).astype(np.int64) - np.bitwise_count(mv[done] & k).astype(np.int64))
    return result


def edit_distance(a: Column, b: Column) -> Column:
    """levenshtein(a, b) of whole batches; null where one of them is null. Not for use in a lambda."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        both = (x.notna() & y.notna()).to_numpy()
        out = pd.Series(np.zeros(len(x), np.int32), dtype="Int32")
        out[both] = edit_distances(x[both].tolist(), y[both].tolist())
        out[~both] = pd.NA
        return out

    return run(a, b)
