"""Suffix arrays by linear grouping of Lyndon prefixes.

Phase 1 keeps suffixes in groups, ordered by what is known of each suffix's longest Lyndon prefix (at
first its first symbol). Groups are taken in descending order. For each suffix of the group the nearest
one before it in a lower group is found by following such pointers; it continues with the group's
prefix, so it moves to a new group just above its old one - those with more continuations further up.
Phase 2 walks the suffix array from its start and puts each suffix's predecessor, and along the
pointers what the predecessor completes, at the next place of their groups. Nothing is renamed and no
recursion is needed; the work is linear in the length.

suffix_array() does this for one text, suffix_arrays() for many short ones at once: each step takes the
next group (in phase 2 the next place) of every text, in numpy. equal_windows() is the use that is made of
them here.
"""

from __future__ import annotations

import numpy as np

#: A text joins the many only while some that many texts of its length or more are taken together.
TOGETHER = 16


def suffix_array(text: bytes) -> list[int]:
    """The starts of the suffixes of text in ascending order, the empty one (len(text)) first."""
    n = len(text) + 1
    symbols = [c + 1 for c in text]
    symbols.append(0)
    size = [0] * (n + 1)
    count = [0] * 258
    for c in symbols:
        count[c + 1] += 1
    for c in range(257):
        count[c + 1] += count[c]
    group = [count[c] for c in symbols]  # a group's number is its first place
    order, place, fill = [0] * n, [0] * n, {}
    for i, g in enumerate(group):
        at = g + fill.get(g, 0)
        fill[g] = at - g + 1
        order[at], place[i] = i, at
    for g, k in fill.items():
        size[g] = k
    before = [-1] * n

    end = n - 1
    while end >= 0:
        g = group[order[end]]
        members = sorted(order[g : end + 1]) if end > g else [order[g]]
        continued: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                continued[j] = continued.get(j, 0) + 1
        end = g - 1
        if not continued:
            continue
        if len(members) == len(continued):
            ranks = [list(continued)]
        else:
            by: dict[int, list[int]] = {}
            for j, k in continued.items():
                by.setdefault(k, []).append(j)
            ranks = [by[k] for k in sorted(by, reverse=True)]
        for moved in ranks:
            for j in moved:  # to the end of its group
                old = group[j]
                size[old] -= 1
                at = old + size[old]
                other, here = order[at], place[j]
                order[here], place[other] = other, here
                order[at], place[j] = j, at
            for j in moved:
                new = group[j] + size[group[j]]
                if new != group[j]:
                    group[j] = new
                    size[new] += 1
                else:  # the whole group moved: it keeps its number, and is counted again below
                    place[j] = -place[j] - 1
            for j in moved:
                if place[j] < 0:
                    place[j] = -place[j] - 1
                    size[group[j]] += 1

    out, filled, done = [0] * n, [0] * n, [False] * n
    out[0], done[n - 1] = n - 1, True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[g + filled[g]] = s
            filled[g] += 1
            done[s] = True
            s = before[s]
    return out


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix arrays of the texts symbols[bounds[i]:bounds[i + 1]], one after the other, as places in symbols.

    Each text ends with 0, which stands nowhere else; longer texts come first.
    """
    n, lo, end = int(bounds[-1]), bounds[:-1], bounds[1:] - 1
    owner = np.repeat(np.arange(len(lo)), np.diff(bounds))
    key = owner * (int(symbols.max()) + 1) + symbols if n else owner
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[:n])
    size, group, place = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    size[begins] = np.diff(np.append(begins, n))
    group[order], place[order] = np.repeat(begins, size[begins]), np.arange(n)
    before = np.full(n, -1)
    moves, in_tail = np.zeros(n, bool), np.zeros(n, bool)

    end, live = end.copy(), np.arange(len(lo))
    while len(live):
        last = end[live]
        g = group[order[last]]
        count = last - g + 1
        after = np.cumsum(count)
        own = np.repeat(np.arange(len(live)), count)
        members = order[np.arange(after[-1]) + np.repeat(g - after + count, count)]
        members.sort()  # by text, then by place: texts follow one another
        at_least, low = g[own], lo[live][own]
        j = members - 1
        todo = np.flatnonzero((j >= low) & (group[j] > at_least))
        while len(todo):
            back = j[todo] = before[j[todo]]
            todo = todo[(back >= low[todo]) & (group[back] > at_least[todo])]
        j[j < low] = -1
        same = (j >= 0) & (group[j] == at_least)  # the member before it: what that one continues
        if same.any():
            j = j[np.maximum.accumulate(np.where(same, 0, np.arange(len(j))))]
        before[members] = j
        end[live] = g - 1
        starts = np.flatnonzero(np.concatenate(([True], j[1:] != j[:-1])))
        times, moved = np.diff(np.append(starts, len(j))), j[starts]
        times, moved = times[moved >= 0], moved[moved >= 0]
        if len(moved):
            old = group[moved]
            by = np.lexsort((times, old)) if times.max() > 1 else np.argsort(old, kind="stable")
            moved, old, times = moved[by], old[by], times[by]
            new_old = np.concatenate(([True], old[1:] != old[:-1]))
            heads = np.flatnonzero(new_old)
            many = np.diff(np.append(heads, len(old)))
            # those that move fill the end of their group, the more often continued ones last
            tail = np.repeat(old[heads] + size[old[heads]] - many - heads, many) + np.arange(len(old))
            here = place[moved]
            moves[here], in_tail[tail] = True, True
            strangers, free = tail[~moves[tail]], here[~in_tail[here]]
            moves[here], in_tail[tail] = False, False
            other = order[strangers]
            order[free], place[other] = other, free
            order[tail], place[moved] = moved, tail
            classes = np.flatnonzero(new_old | np.concatenate(([True], times[1:] != times[:-1])))
            width = np.diff(np.append(classes, len(old)))
            size[old[heads]] -= many
            size[tail[classes]] = width
            group[moved] = np.repeat(tail[classes], width)
        live = live[end[live] >= lo[live]]

    out, filled, done = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    if n:
        out[lo] = bounds[1:] - 1
        done[out[lo]] = True
    length = np.diff(bounds)
    for i in range(int(length[0]) if n else 0):
        first = lo[: np.searchsorted(-length, -i, "left")]
        s = out[first + i] - 1
        todo = (s >= first) & ~done[s]
        while todo.any():
            s, first = s[todo], first[todo]
            g = group[s]
            out[g + filled[g]] = s
            filled[g] += 1
            done[s] = True
            s = before[s]
            todo = (s >= first) & ~done[s]
    return out


def equal_windows(data: np.ndarray, bounds: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of data at which windows of a length begin that their group has twice or more, and a number for each such window.

    String i is data[bounds[i]:bounds[i + 1]], of group[i] (ascending); windows lie within strings.
    """
    # a group's strings are one text, each with a separator (1) after it, the last with the end (0)
    strings = len(bounds) - 1
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))[:strings])
    size = np.add.reduceat(np.diff(bounds) + 1, heads) if strings else np.zeros(0, np.int64)
    order = np.argsort(-size, kind="stable")
    # short texts are taken together as long as there are many of the longest length
    enough = np.cumsum(size[order][::-1])[::-1] >= TOGETHER * size[order]
    first = int(np.argmax(enough)) if enough.any() else len(order)
    tails = np.append(heads[1:], strings)
    places, numbers, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for texts in [order[k : k + 1] for k in range(first)] + [order[first:]] * (first < len(order)):
        rows = np.concatenate([np.arange(a, b) for a, b in zip(heads[texts].tolist(), tails[texts].tolist(), strict=True)])
        span = np.diff(bounds)[rows] + 1
        begin = np.cumsum(span) - span
        origin = np.arange(int(span.sum())) + np.repeat(bounds[rows] - begin, span)  # the place in data of each symbol
        last = begin + span - 1
        symbols = np.empty(len(origin), np.int64)
        inner = np.ones(len(origin), bool)
        inner[last] = False
        symbols[inner], symbols[last] = data[origin[inner]].astype(np.int64) + 1, 1
        text_bounds = np.concatenate(([0], np.cumsum(size[texts])))
        symbols[text_bounds[1:] - 1] = 0
        if len(texts) == 1:
            suffixes = np.array(suffix_array((symbols[:-1] - (symbols[:-1] > 0)).astype(np.uint8).tobytes()), np.int64)
        else:
            suffixes = suffix_arrays(symbols, text_bounds)
        left = np.repeat(last, span) - np.arange(len(origin))
        whole = suffixes[left[suffixes] >= length]
        at, text = origin[whole], np.repeat(np.arange(len(texts)), size[texts])[whole]
        equal = text[1:] == text[:-1]
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
            word = eights[at + k]
            equal &= word[1:] == word[:-1]
        inside = np.concatenate((equal, [False])) | np.concatenate(([False], equal))
        number = np.cumsum(np.concatenate(([True], ~equal)))[inside[: len(at)]] if len(at) else np.zeros(0, np.int64)
        places.append(at[inside[: len(at)]])
        numbers.append(number + n)
        n += len(at) + 1
    return np.concatenate(places), np.concatenate(numbers)
