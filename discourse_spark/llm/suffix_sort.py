"""Blockwise suffix sorting with a difference cover, in numpy.

The positions whose residue modulo ``PERIOD`` lies in ``COVER`` are a sample with one
property: for any two positions there is one shift below ``PERIOD`` that brings both
onto the sample. The ranks of the sample suffixes are found once by prefix doubling.
Then one bucket of suffixes at a time is sorted by its first eight bytes, and ties,
however long, are resolved by the sample ranks at that shift. Besides the text and
the sample ranks, memory holds one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PERIOD = 7
COVER = (0, 1, 3)
BUCKET = 1 << 18  # positions sorted at once

_SHIFT = np.array([
    [next(s for s in range(PERIOD) if (a + s) % PERIOD in COVER and (b + s) % PERIOD in COVER)
     for b in range(PERIOD)]
    for a in range(PERIOD)
])


def leading_words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    n = len(text)
    word = padded[: n + 7] << np.uint64(8) | padded[1 : n + 8]
    word = word[: n + 5] << np.uint64(16) | word[2 : n + 7]
    return word[:n] << np.uint64(32) | word[4 : n + 4]


def sample_ranks(leading: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The rank of each sample suffix at its position, 0 elsewhere and behind the end.

    With ``depth`` the ranks tell apart what differs within that many bytes, and may
    leave what differs later equal.
    """
    n = len(leading)
    at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    at = at[at < n]
    ranks = np.zeros(n + PERIOD, dtype=np.int64)
    names = _named(leading[at], len(at))
    ranks[at] = names
    length = PERIOD
    while names.max(initial=0) < len(at) and (depth is None or length + 1 < depth):
        ahead = at + length
        following = ranks[np.minimum(ahead, n)]  # 0 behind the end
        names = _named(names * (len(at) + 1) + following, len(at))
        ranks[at] = names
        length *= 2
    return ranks


def _named(keys: np.ndarray, n: int) -> np.ndarray:
    """Names 1, 2, ... of the keys in their order; equal keys share a name."""
    bits = int(n).bit_length()
    if keys.dtype == np.int64 and 3 * bits < 63:  # one sort of numbers beats one of places
        packed = np.sort((keys << bits) | np.arange(n))
        order, ordered = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(keys)
        ordered = keys[order]
    new = np.empty(n, dtype=np.int64)
    new[:1] = 1
    new[1:] = ordered[1:] != ordered[:-1]
    names = np.empty(n, dtype=np.int64)
    names[order] = np.cumsum(new)
    return names


def sorted_buckets(text: np.ndarray, positions: np.ndarray, leading: np.ndarray | None = None,
                   ranks: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The positions in the order of their suffixes, one bucket after the other.

    A bucket takes the suffixes between two splitters among the leading words; all
    suffixes that start alike are in one bucket.
    """
    if leading is None:
        leading = leading_words(text)
    if ranks is None:
        ranks = sample_ranks(leading)
    keys = leading[positions]
    if len(positions) <= BUCKET:
        yield _bucket(positions, keys, ranks)
        return
    sample = np.sort(keys[:: max(1, len(keys) // 4096)])
    step = max(1, len(sample) * BUCKET // (2 * len(keys)))
    splitters = np.unique(sample[step::step])
    part = np.searchsorted(splitters, keys, side="right")
    for k in range(len(splitters) + 1):
        inside = part == k
        if inside.any():
            yield _bucket(positions[inside], keys[inside], ranks)


def _bucket(positions: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    positions, keys = positions[order], keys[order]
    new = np.empty(len(keys), dtype=bool)
    new[:1] = True
    new[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    tied = np.diff(np.append(first, len(keys)))[group] > 1
    if not tied.any():
        return positions
    at, group_of = positions[tied], group[tied]
    # ranks of limited depth may rank a few alike; sorting by them keeps every position
    order = np.lexsort((_rank_in_group(at, group_of, ranks), group_of))
    positions[np.flatnonzero(tied)] = at[order]
    return positions


def _rank_in_group(at: np.ndarray, group: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """How many suffixes of its group are smaller than each one.

    Suffixes of one residue class are in order by a single sample rank; how many of
    another class precede a suffix is a search in that class's order, by the ranks
    at the shift that the two classes share.
    """
    residue = at % PERIOD
    top = np.int64(ranks.max(initial=0) + 1)
    smaller = np.zeros(len(at), dtype=np.int64)
    classes, keys = [], []
    for r in range(PERIOD):
        mine = np.flatnonzero(residue == r)
        base = group[mine] * top
        own = base + ranks[at[mine] + _SHIFT[r, r]]
        order = np.argsort(own)
        mine, base = mine[order], base[order]
        classes.append(mine)
        # a class meets all seven at three shifts only
        keys.append({s: base + ranks[at[mine] + s] for s in set(_SHIFT[r].tolist())} if len(mine) else {})
    for b, theirs in enumerate(classes):
        if not len(theirs):
            continue
        begin = np.searchsorted(group[theirs], np.arange(group[-1] + 2)) if group[-1] < 4 * len(at) else None
        for a, mine in enumerate(classes):
            if not len(mine):
                continue
            shift = int(_SHIFT[a, b])
            before = begin[group[mine]] if begin is not None else np.searchsorted(group[theirs], group[mine])
            smaller[mine] += np.searchsorted(keys[b][shift], keys[a][shift]) - before
    return smaller


def equal_runs(leading: np.ndarray, ordered: np.ndarray, length: int) -> np.ndarray:
    """Marks each sorted suffix that differs from the one before within ``length`` bytes.

    ``length`` is at least eight, and every suffix has that many bytes.
    """
    new = np.zeros(len(ordered), dtype=bool)
    new[:1] = True
    before, after = ordered[:-1], ordered[1:]
    for offset in [*range(0, length - 8, 8), length - 8]:
        new[1:] |= leading[before + offset] != leading[after + offset]
    return new
