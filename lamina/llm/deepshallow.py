"""Deep-shallow string sorting, vectorised over all groups at once.

Strings of a group have the same length. The shallow phase is a multikey quicksort whose characters are eight bytes wide: it sorts the open
groups by one such character at a time and splits them where it differs, to a shallow depth. The groups left share a long prefix; these
are ordered by blind tries, built level by level: a group's first string is the trie's path, every other string is compared with it once, and
branches off where they first differ, below (ordered by depth) or above (by falling depth), by the byte there; strings that
branch off at the same place by the same byte are a subtrie, taken up in the next round from that depth on. Of inner nodes only depth and
branching byte are kept. Strings equal to the path are final.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def eights(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each of ``at`` as a number that compares as they do; bytes past the string's end, ``left`` bytes away, count as 0."""
    raw = np.ndarray((len(data) - 7,), ">u8", data.data, 0, (1,))[at].astype(np.uint64)
    short = left < 8
    if short.any():
        gone = (8 * (8 - np.clip(left[short], 0, 8))).astype(np.uint64)
        raw[short] = np.where(gone >= 64, np.uint64(0), (raw[short] >> np.minimum(gone, np.uint64(63))) << np.minimum(gone, np.uint64(63)))
    return raw


def _split(gid: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """New group numbers of sorted rows: a group begins where ``gid`` or a key changes."""
    new = np.zeros(len(gid), bool)
    new[0] = True
    for k in (gid, *keys):
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new) - 1


def sort_groups(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings ``data[start : start + length]`` by group and then content; and which equal the one before in that order.

    ``data`` must go on for eight bytes after the last string.
    """
    n = len(starts)
    order = np.argsort(groups, kind="stable")
    equal = np.zeros(n, bool)
    if not n:
        return order, equal
    gid = _split(groups[order])
    slots, member = np.arange(n), order.copy()

    def opened(slots: np.ndarray, member: np.ndarray, gid: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
        several = (np.bincount(gid) > 1)[gid]
        return tuple(x[several] for x in (slots, member, gid, *more))

    slots, member, gid = opened(slots, member, gid)
    depth = 0
    while len(member) and depth < shallow:
        word = eights(data, np.minimum(starts[member] + depth, len(data) - 8), lengths[member] - depth)
        by = np.lexsort((word, gid))
        member, word, gid = member[by], word[by], gid[by]
        order[slots] = member
        gid = _split(gid, word)
        depth += 8
        ended = lengths[member] <= depth
        if ended.any():
            same = np.append(False, gid[1:] == gid[:-1])
            equal[slots[same & ended]] = True
            slots, member, gid = slots[~ended], member[~ended], gid[~ended]
            if len(gid):
                gid = _split(gid)
        slots, member, gid = opened(slots, member, gid)
    known = np.full(len(member), depth)
    while len(member):
        gid = _split(gid)
        first = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
        path = member[first][gid]
        shared, side, byte = _against(data, starts, lengths[member], member, path, known)
        by = np.lexsort((byte, np.where(side < 0, shared, -shared), side, gid))
        member, gid, shared, side, byte = (x[by] for x in (member, gid, shared, side, byte))
        order[slots] = member
        gid = _split(gid, side, shared, byte)
        same = np.append(False, gid[1:] == gid[:-1])
        done = side == 0
        equal[slots[same & done]] = True
        slots, member, gid, known = slots[~done], member[~done], gid[~done], shared[~done] + 1
        if len(gid):
            gid = _split(gid)
            slots, member, gid, known = opened(slots, member, gid, known)
    return order, equal


def _against(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, member: np.ndarray, path: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string: how many bytes it shares with its path, its side of it (-1, 0 for equal, 1), and its byte where they differ."""
    shared, side, byte = lengths.copy(), np.zeros(len(member), np.int64), np.zeros(len(member), np.int64)
    left = np.flatnonzero(member != path)
    at = known[left].copy()
    last = len(data) - 8
    while len(left):
        rest = lengths[left] - at
        x = eights(data, np.minimum(starts[member[left]] + at, last), rest)
        y = eights(data, np.minimum(starts[path[left]] + at, last), rest)
        off = x != y
        if off.any():
            differ = (x[off] ^ y[off]).astype(np.uint64)
            zeros = np.zeros(len(differ), np.int64)
            for shift in (32, 16, 8):
                high = (differ >> np.uint64(64 - shift)) == 0
                zeros[high] += shift
                differ[high] <<= np.uint64(shift)
            here = left[off]
            shared[here] = at[off] + zeros // 8
            side[here] = np.where(x[off] < y[off], -1, 1)
            byte[here] = data[starts[member[here]] + shared[here]]
        keep = ~off & (rest > 8)
        left, at = left[keep], at[keep] + 8
    return shared, side, byte
