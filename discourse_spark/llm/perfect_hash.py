"""A minimal perfect hash with stored fingerprints, built and queried in numpy.

Keys fall into small groups by one hash. Groups, the largest first, search a seed under
which all their keys meet free slots; groups of one key take the slots that are left and
store the slot itself. Every key has a slot of its own, there are as many slots as keys,
and a look-up is one group, one seed, one slot and one comparison.
"""

from __future__ import annotations

import struct

import numpy as np

from discourse_spark.llm.words import mix

KEYS_PER_GROUP = 4
MAGIC = b"MPHF1\0\0\0"


def key_hashes(ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """64-bit hashes of (id, copy number)."""
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return mix(h ^ (copies.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def _slots(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(hashes + seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def build(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds of the groups, slot of each key) for distinct hashes.

    A seed of -1 - s says that the group's only key has slot s.
    """
    n = len(hashes)
    groups = max(1, -(-n // KEYS_PER_GROUP))
    group = (mix(hashes.copy()) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    seeds = np.zeros(groups, dtype=np.int64)
    slots = np.full(n, -1, dtype=np.int64)
    taken = np.zeros(n, dtype=bool)
    by_size = np.argsort(-sizes, kind="stable")
    trial = np.arange(1, 65)
    for g in by_size[sizes[by_size] > 1].tolist():
        keys = order[begin[g] : begin[g + 1]]
        first = 0
        while True:
            tried = trial + first
            at = _slots(hashes[keys][None, :], tried[:, None], n)
            ordered = np.sort(at, axis=1)
            good = ~taken[at].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[g], slots[keys] = tried[k], at[k]
                taken[at[k]] = True
                break
            first += len(trial)
    single = by_size[sizes[by_size] == 1]
    free = np.flatnonzero(~taken)
    seeds[single] = -1 - free
    slots[order[begin[single]]] = free
    return seeds, slots


def pack(hashes: np.ndarray, columns: list[np.ndarray]) -> list[bytes]:
    """File parts: header, seeds, fingerprints, and one 64-bit array per column, by slot."""
    seeds, slots = build(hashes)
    marks = np.zeros(len(hashes), dtype="<u4")
    marks[slots] = fingerprints(hashes)
    parts = [MAGIC + struct.pack("<QQQ", len(hashes), len(seeds), len(columns)),
             seeds.astype("<i8").tobytes(), marks.tobytes()]
    for column in columns:
        by_slot = np.zeros(len(hashes), dtype="<i8")
        by_slot[slots] = column
        parts.append(by_slot.tobytes())
    return parts


class Index:
    """A packed index in memory."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an index file")
        self.n, groups, columns = struct.unpack_from("<QQQ", data, 8)
        self.seeds = np.frombuffer(data, "<i8", groups, 32)
        self.marks = np.frombuffer(data, "<u4", self.n, 32 + 8 * groups)
        at = 32 + 8 * groups + 4 * self.n
        self.columns = [np.frombuffer(data, "<i8", self.n, at + 8 * self.n * k) for k in range(columns)]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no key has this fingerprint."""
        if not self.n:
            return np.full(len(hashes), -1, dtype=np.int64)
        seed = self.seeds[(mix(hashes.copy()) % np.uint64(len(self.seeds))).astype(np.int64)]
        slot = np.where(seed < 0, -1 - seed, _slots(hashes, np.maximum(seed, 0), self.n))
        return np.where(self.marks[slot] == fingerprints(hashes), slot, -1)
