"""Suffix arrays in numpy: Larsson-Sadakane refinement to a depth, and Kasai's common prefixes in lanes."""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as big-endian numbers; zeros follow the text."""
    raw = np.concatenate((text, np.zeros(8, np.uint8))).tobytes()
    return np.ndarray((len(text),), ">u8", raw, strides=(1,))


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes, and each suffix's place.

    As Larsson and Sadakane do it: a group is named by its first place; each round sorts the suffixes of
    groups of several by the group of the suffix h further, which doubles the depth they are sorted to, and
    leaves groups of one alone. The last round steps by depth - h, so that it ends at ``depth``.
    Suffixes that agree so far get places in order of position."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = words_at(text).astype(np.uint64)
    if depth < 8:
        key >>= np.uint64(8 * (8 - depth))
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    group = np.empty(n + depth, np.int64)
    group[n:] = np.arange(depth, 0, -1)  # past the end: before all others, the further the earlier
    group[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + depth + 1
    slots = np.flatnonzero(~(head & np.append(head[1:], True)))
    h = min(8, depth)
    while h < depth and len(slots):
        step = min(h, depth - h)
        mine = sa[slots]
        pair = (group[mine].astype(np.uint64) << np.uint64(32)) | group[mine + step].astype(np.uint64)
        order = np.argsort(pair, kind="stable")
        mine, pair = mine[order], pair[order]
        sa[slots] = mine
        head = np.concatenate(([True], pair[1:] != pair[:-1]))
        group[mine] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))] + depth + 1
        slots = slots[~(head & np.append(head[1:], True))]
        h += step
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    return sa, place


def common_prefixes(text: np.ndarray, sa: np.ndarray, place: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """At each place, how many bytes its suffix shares with the one before, up to ``most``.

    Kasai's walk over positions, where each keeps all but one of the bytes its forerunner shared, goes on
    in lanes of ``lane`` positions side by side; bytes are compared eight at a time. Suffixes that agree to the
    depth of the order are not ordered among themselves: after such a pair only the very next pair keeps."""
    n = len(text)
    out = np.zeros(n, np.int32)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    word = words_at(np.concatenate((text, np.zeros(most + 8, np.uint8))))
    first = np.arange(0, n, lane)
    shared, then = np.zeros(len(first), np.int64), np.full(len(first), -2)
    for k in range(lane):
        i = first + k
        if i[-1] >= n:
            first, shared, then, i = first[:-1], shared[:-1], then[:-1], i[:-1]
            if not len(i):
                break
        j = before[i]
        shared = np.where((j >= 0) & ((shared < most) | (j == then)), np.maximum(shared - 1, 0), 0)
        then = j + 1
        room = np.minimum(n - np.maximum(i, j), most)
        open_ = np.flatnonzero((j >= 0) & (shared < room))
        while len(open_):
            a, b, s = i[open_], j[open_], shared[open_]
            x = word[a + s].astype(np.uint64) ^ word[b + s].astype(np.uint64)
            same = np.full(len(x), 8)
            some = np.flatnonzero(x)
            # leading zero bytes, from the exponent of the word as a float of its upper half
            top = x[some]
            z = np.zeros(len(some), np.int64)
            for bits in (32, 16, 8):
                low = top < (np.uint64(1) << np.uint64(64 - bits))
                z += low * (bits // 8)
                top = np.where(low, top << np.uint64(bits), top)
            same[some] = z
            s = np.minimum(s + same, room[open_])
            shared[open_] = s
            open_ = open_[(same == 8) & (s < room[open_])]
        out[place[i]] = shared
    return out


def repeated(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which ``starts`` begin a string of ``length`` bytes that begins at another of them too."""
    sa, place = suffix_array(text, length)
    lcp = common_prefixes(text, sa, place, length)
    is_start = np.zeros(len(text) + 1, bool)
    is_start[starts] = True
    # places in order, cut into runs that share ``length`` bytes; a run of two starts or more repeats
    run = np.cumsum(lcp < length) - 1 if len(lcp) else np.zeros(0, np.int64)
    count = np.bincount(run, is_start[sa].astype(np.int64), minlength=1) if len(run) else np.zeros(1)
    return count[run[place[starts]]] > 1 if len(starts) else np.zeros(0, bool)
