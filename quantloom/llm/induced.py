"""Suffix arrays by induced sorting, in whole-array steps on every level of the recursion."""

from __future__ import annotations

import numpy as np

U = np.uint64


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type); the empty suffix after the last is the smallest."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = (t[1:] > t[:-1]).view(np.int8) - (t[1:] < t[:-1]).view(np.int8)
    step[-1] = -1
    decided = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(decided[::-1])[::-1]
    return step[following] > 0


def _deal(j: np.ndarray, c: np.ndarray, out: np.ndarray, edge: np.ndarray, way: int) -> None:
    """Put the suffixes, in order, into the buckets of their characters: upwards from `edge` (way 1) or downwards (way -1)."""
    if len(j):
        turn = np.argsort(c, kind="stable")
        j, c = j[turn], c[turn]
        first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        sizes = np.diff(np.append(first, len(c)))
        rank = np.arange(len(c)) - np.repeat(first, sizes)
        out[edge[c] + rank if way > 0 else edge[c] - 1 - rank] = j
        edge[c[first]] += way * sizes


def _induce_larger(t: np.ndarray, larger: np.ndarray, starts: np.ndarray, front: np.ndarray, out: np.ndarray) -> None:
    """Scan the buckets upwards; what each suffix induces, the larger one before it, goes to the front of its bucket.

    As many buckets are scanned at once as induce nothing into one another. A bucket that induces into itself is scanned
    alone, in waves.
    """

    def before(j: np.ndarray) -> np.ndarray:
        j = j[j > 0] - 1
        return j[larger[j]]

    at, most, width = 0, len(starts) - 1, 1
    while at < most:
        upto = min(most, at + width)
        j = before(out[starts[at] : starts[upto]])
        c = t[j]
        inside = c < upto
        if inside.any():
            upto = int(c[inside].min())
            width = max(1, 2 * (upto - at))
            if upto == at:
                done = starts[at]
                while done < front[at]:
                    wave, done = out[done : front[at]], front[at]
                    j = before(wave)
                    _deal(j, t[j], out, front, 1)
                j = before(out[front[at] : starts[at + 1]])
                upto = at + 1
            else:
                j = before(out[starts[at] : starts[upto]])
            c = t[j]
        else:
            width *= 2
        _deal(j, c, out, front, 1)
        at = upto


def _induce_smaller(t: np.ndarray, smaller: np.ndarray, starts: np.ndarray, front: np.ndarray, back: np.ndarray, out: np.ndarray) -> None:
    """The same downwards: smaller suffixes go to the back of their buckets. `front` is where larger ones end."""

    def before(j: np.ndarray) -> np.ndarray:
        j = j[::-1]
        j = j[j > 0] - 1
        return j[smaller[j]]

    upto, width = len(starts) - 1, 1
    while upto > 0:
        at = max(0, upto - width)
        j = before(out[starts[at] : starts[upto]])
        c = t[j]
        inside = c >= at
        if inside.any():
            at = int(c[inside].max()) + 1
            width = max(1, 2 * (upto - at))
            if at == upto:
                at = upto - 1
                done = starts[upto]
                while done > back[at]:
                    wave, done = out[back[at] : done], back[at]
                    j = before(wave)
                    _deal(j, t[j], out, back, -1)
                j = before(out[starts[at] : front[at]])
            else:
                j = before(out[starts[at] : starts[upto]])
            c = t[j]
        else:
            width *= 2
        _deal(j, c, out, back, -1)
        upto = at


def induce(t: np.ndarray, smaller: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes from the order of the leftmost smaller ones. Bucket c of a first character begins at starts[c]."""
    out = np.full(len(t), -1, np.int64)
    front, back = starts[:-1].copy(), starts[1:].copy()
    _deal(lms[::-1], t[lms[::-1]], out, back, -1)
    _deal(np.array([len(t) - 1]), t[-1:], out, front, 1)
    _induce_larger(t, ~smaller, starts, front, out)
    out[(out >= 0) & smaller[out]] = -1
    _induce_smaller(t, smaller, starts, front, starts[1:].copy(), out)
    return out


def suffix_array(t: np.ndarray, most: int = 256) -> np.ndarray:
    """The sorted suffixes of a string of numbers below `most`.

    Leftmost smaller suffixes, put in their buckets in any order, induce the order of the substrings from one to the next.
    Equal substrings get one name, and the string of names, half as long at most, is sorted recursively. The order of its
    suffixes is that of the leftmost smaller ones, which induces all suffixes.
    """
    if len(t) < 2:
        return np.arange(len(t))
    smaller = types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    starts = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=most))))
    if len(lms) < 2:
        return induce(t, smaller, starts, lms)
    found = induce(t, smaller, starts, lms)
    number = np.full(len(t), -1)
    number[lms] = np.arange(len(lms))
    k = number[found]
    k = k[k >= 0]
    ends = np.append(lms[1:] + 1, len(t))
    names = np.empty(len(lms), np.int64)
    names[k] = np.concatenate(([0], np.cumsum(~_equal(t, lms[k], (ends - lms)[k], k == len(lms) - 1))))
    return induce(t, smaller, starts, lms[_order(names)])


def _order(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of the string of names.

    A comparison ends at the first name that occurs once, so of the string only repeated names and what follows them
    directly are sorted by recursion; the others' order is their names'.
    """
    once = np.bincount(names)[names] == 1
    keep = np.flatnonzero(~(once & np.concatenate(([True], once[:-1]))))
    place = np.zeros(len(names), np.int64)
    if not once.all():
        used, short = np.unique(names[keep], return_inverse=True)
        place[keep[suffix_array(short, len(used))]] = np.arange(len(keep))
    return np.lexsort((place, names))


def _equal(t: np.ndarray, at: np.ndarray, length: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of a list of substrings whether each is the one before it, number by number; the string's last one is like no other."""
    same = (length[1:] == length[:-1]) & ~last[1:] & ~last[:-1]
    open_, done = np.flatnonzero(same), 0
    while len(open_):
        differ = t[at[open_ + 1] + done] != t[at[open_] + done]
        same[open_[differ]] = False
        done += 1
        open_ = open_[~differ & (length[open_] > done)]
    return same


def _words(t: np.ndarray) -> np.ndarray:
    """Eight bytes from every place on, zeros after the end."""
    padded = np.concatenate((t, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(t)].copy().view(U).ravel()


def permuted_common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of the text how many bytes, `most` at the most, its suffix shares with the suffix before it in the sorted
    list `order` (which may leave suffixes out; theirs and the first one's is 0).

    The prefixes are found in the text's order, where neighbours lie close in memory, eight bytes at a time.
    """
    before = np.full(len(t), -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.flatnonzero(before >= 0)
    shared, words = np.zeros(len(t), np.int64), _words(t)
    room = np.minimum(len(t) - np.maximum(here, before[here]), most)
    done = 0
    while len(here):
        apart = words[here + done] ^ words[before[here] + done]
        low = apart & (~apart + U(1))
        got = np.where(apart == 0, 8, np.bitwise_count(low - U(1)) // 8)
        shared[here] = np.minimum(done + got, room)
        go = (apart == 0) & (room > done + 8)
        here, room = here[go], room[go]
        done += 8
    return shared
