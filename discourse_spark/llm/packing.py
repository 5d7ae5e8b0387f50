"""Best-fit packing of documents into sequences, by bin completion.

Only lengths decide a packing, and there are at most ``CAPACITY`` of them. So the corpus
is counted by length, the counts are solved as one problem whose size does not grow
with the corpus, and pieces are then dealt to the solution's places by their rank among
equals.

Bin completion: the largest open document is filled up with the undominated set of
smaller ones that wastes least; a filling is used as often as the counts allow. When
few pieces are left, branch and bound tries all undominated fillings around the largest
one, prunes by the waste that the bins of a better solution may hold together, and
keeps the best solution found, first of all the best-fit one. Best fit over all counts
is the answer if it needs fewer bins than that.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discourse_spark.llm.common import NO_ID, freed, id_or_last, pick, ship, written

CAPACITY = 4096
END_ID = 1
EXACT_PIECES = 60  # branch and bound works on the last pieces
NODES = 20_000  # fillings looked at there; the best solution so far holds beyond
RANKED = 1_000_000  # pieces of one length ranked in one task
TRIES = 2_000  # steps of the search for one bin, one per length, before all sums are computed


def filling(counts: np.ndarray, room: int, tries: int = TRIES) -> list[int]:
    """The undominated filling of ``room`` that wastes least: lengths, large ones first.

    A filling is undominated if no piece in it can be changed for a larger one. Large
    pieces are tried first, as many copies at once as there are and fit, so among equal
    wastes the one with the most large pieces wins and small ones stay for later bins.
    A search that takes more than ``tries`` steps is left for the sums that can be
    reached, which give the same filling.
    """
    best: list[tuple[int, int]] = []
    best_waste, left, rest, most = room, tries, room, room
    # the largest available length up to each size, so that a step is a look-up
    floor = np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))
    taken: list[tuple[int, int]] = []
    while best_waste:
        left -= 1
        if left < 0:
            return fullest(counts, room)
        length = int(floor[min(rest, most)])
        if length:
            copies = min(int(counts[length]), rest // length)
        elif taken:  # nothing smaller fits: one copy less of the last length
            length, copies = taken.pop()
            rest += copies * length
            copies -= 1
        else:
            break
        most = length - 1
        if copies:
            taken.append((length, copies))
            rest -= copies * length
            if rest < best_waste:
                best, best_waste = list(taken), rest
    return [length for length, copies in best for _ in range(copies)]


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """What ``filling`` looks for, from the sums that the lengths up to each one can reach."""
    lengths = np.flatnonzero(counts[: room + 1]).tolist()
    sums = reachable([(length, int(counts[length])) for length in lengths], room)
    chosen: list[int] = []
    target = sums[-1].bit_length() - 1
    for length, below in zip(lengths[::-1], sums[-2::-1]):
        copies = min(int(counts[length]), target // length)
        while not below >> (target - copies * length) & 1:
            copies -= 1
        chosen += [length] * copies
        target -= copies * length
    return chosen


def reachable(pieces: list[tuple[int, int]], room: int) -> list[int]:
    """Bit s of entry i: some pieces of the first i (length, copies) add up to s."""
    every = (1 << (room + 1)) - 1
    sums = [1]
    for length, copies in pieces:
        reached, copies, step = sums[-1], min(copies, room // length), 1
        while copies and reached != every:
            reached |= reached << min(step, copies) * length
            copies -= min(step, copies)
            step *= 2
        sums.append(reached & every)
    return sums


def complete(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) of bins that hold all pieces of the given counts by length: those of
    bin completion, or of best fit if these are fewer."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    bins: list[tuple[int, list[int]]] = []
    while left.sum() > EXACT_PIECES:
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        chosen = [largest, *filling(left, capacity - largest)]
        left[largest] += 1
        need = np.bincount(chosen, minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        left[used] -= times * need[used]
        bins.append((times, chosen))
    rest = np.repeat(np.arange(capacity + 1), left)[::-1].tolist()
    bins += [(1, b) for b in branch_and_bound(rest, capacity)]
    plain = best_fit_counts(counts, capacity)
    if sum(times for times, _ in plain) < sum(times for times, _ in bins):
        return [(times, [length for length, n in runs for _ in range(n)]) for times, runs in plain]
    return bins


def best_fit_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """What ``best_fit`` does, on counts: (times, ((length, copies), ...)) of equal bins."""
    by_room: list[list[tuple[int, tuple[tuple[int, int], ...]]]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bins have the room r left

    def put(room: int, times: int, runs: tuple[tuple[int, int], ...]) -> None:
        nonlocal rooms
        by_room[room].append((times, runs))
        rooms |= 1 << room

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            # the fullest bins that take the length get as many of it as they can hold
            fits = rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                times, runs = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, times, runs = capacity, n, ()
            copies = min(n, room // length)
            filled = min(times, n // copies)
            put(room - copies * length, filled, (*runs, (length, copies)))
            if runs and filled < times:
                put(room, times - filled, runs)
            n -= filled * copies
    return [group for groups in by_room for group in groups]


def best_fit(pieces: list[int], capacity: int) -> list[list[int]]:
    """Each piece, the largest first, into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: list[int] = []
    for piece in pieces:
        fits = [(r, i) for i, r in enumerate(room) if r >= piece]
        if fits:
            _, i = min(fits)
            bins[i].append(piece)
            room[i] -= piece
        else:
            bins.append([piece])
            room.append(capacity - piece)
    return bins


def lower_bound(pieces: list[int], capacity: int) -> int:
    """No packing has fewer bins: pieces over half need a bin each, and so on by size."""
    best = -(-sum(pieces) // capacity)
    for limit in {p for p in pieces if 2 * p <= capacity}:
        large = [p for p in pieces if p > capacity - limit]
        middle = [p for p in pieces if capacity - limit >= p > capacity / 2]
        small = [p for p in pieces if capacity / 2 >= p >= limit]
        spare = len(middle) * capacity - sum(middle)
        best = max(best, len(large) + len(middle) + max(0, -(-(sum(small) - spare) // capacity)))
    return max(best, sum(2 * p > capacity for p in pieces))


def branch_and_bound(pieces: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Bins of the pieces (largest first): optimal unless ``nodes`` fillings run out."""
    best = best_fit(pieces, capacity)
    target = lower_bound(pieces, capacity)
    left = nodes

    def search(open_pieces: list[int], bins: list[list[int]], waste: int) -> None:
        nonlocal best, left
        if not open_pieces:
            if len(bins) < len(best):
                best = [list(b) for b in bins]
            return
        # a better solution has one bin less, so its bins waste at most this together
        allowed = (len(best) - 1) * capacity - sum(pieces)
        if waste > allowed or len(bins) + lower_bound(open_pieces, capacity) >= len(best):
            return
        largest, rest = open_pieces[0], open_pieces[1:]
        for chosen, wasted, undominated in fillings(rest, capacity - largest):
            left -= 1
            if left < 0 or len(best) <= target or waste + wasted > (len(best) - 1) * capacity - sum(pieces):
                return
            if not undominated:
                continue
            remaining = list(rest)
            for p in chosen:
                remaining.remove(p)
            search(remaining, [*bins, [largest, *chosen]], waste + wasted)

    if len(best) > target:
        search(list(pieces), [], 0)
    return best


def fillings(pieces: list[int], room: int) -> Iterator[tuple[list[int], int, bool]]:
    """(lengths, waste, undominated) of each filling of ``room`` that leaves no piece that still
    fits, least waste first. Undominated: no exchange of one piece for a larger one improves it."""
    counts = Counter(p for p in pieces if p <= room)
    lengths = sorted(counts)
    sums = reachable([(length, counts[length]) for length in lengths], room)

    def adding_up(k: int, total: int, waste: int) -> Iterator[list[int]]:
        if not k:
            yield []
            return
        length = lengths[k - 1]
        for copies in range(min(counts[length], total // length), -1, -1):
            if copies < counts[length] and length <= waste:
                return
            if sums[k - 1] >> (total - copies * length) & 1:
                for smaller in adding_up(k - 1, total - copies * length, waste):
                    yield [length] * copies + smaller

    for waste in range(room + 1):
        if sums[-1] >> (room - waste) & 1:
            for chosen in adding_up(len(lengths), room - waste, waste):
                others = counts - Counter(chosen)
                yield chosen, waste, not any(p < o <= p + waste for p in set(chosen) for o in others)


def places(bins: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """Where pieces go: ranks from ``first`` on, ``per_bin`` of a length in each of
    ``times`` bins, at offsets from ``offset`` on, in sequences from ``sequence`` on."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in bins:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            per_bin = lengths.count(length)
            first = used.get(length, 0)
            rows.append((length, first, per_bin, offset, sequence))
            used[length] = first + times * per_bin
            offset += length * per_bin
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "per_bin", "offset", "sequence"]).sort_values(
        ["length", "first"], ignore_index=True
    )


def _pieces(path: str, capacity: int):
    def pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from discourse_spark.llm.tokens import encoder

        encode = encoder(path).encode
        for part in parts:
            out = {"row_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for row_id, text in zip(part["row_id"].tolist(), part["text"]):
                ids = np.append(encode(text).astype("<u4"), np.uint32(END_ID)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    out["row_id"].append(row_id)
                    out["piece"].append(k)
                    out["start"].append(start)
                    out["length"].append(len(own))
                    out["ids_crc32"].append(zlib.crc32(own.tobytes()))
            yield pd.DataFrame(out)

    return pieces


def _placed(table: pd.DataFrame, begins: dict[tuple[int, int], int]):
    lengths, first_row = np.unique(table["length"].to_numpy(), return_index=True)
    last_row = np.append(first_row[1:], len(table))
    columns = {c: table[c].to_numpy() for c in table.columns}

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            length = part["length"].to_numpy()
            rank = part["rank"].to_numpy() + np.array(
                [begins[k] for k in zip(length.tolist(), part["salt"].tolist())], dtype=np.int64
            ) - 1
            at = np.empty(len(part), dtype=np.int64)
            for value in np.unique(length).tolist():
                k = np.searchsorted(lengths, value)
                own = length == value
                firsts = columns["first"][first_row[k] : last_row[k]]
                at[own] = first_row[k] + np.searchsorted(firsts, rank[own], side="right") - 1
            beyond = rank - columns["first"][at]
            per_bin = columns["per_bin"][at]
            yield part.drop(columns=["salt", "rank"]).assign(
                sequence_id=columns["sequence"][at] + beyond // per_bin,
                offset=columns["offset"][at] + beyond % per_bin * length,
            )

    return placed


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece.

    A null or empty text is its end id alone. Only documents of more than ``capacity``
    tokens are cut. Repeated rows are documents of their own; null ids come back as
    null. Sequences have numbers from 0 without gaps, pieces in them leave none.
    """
    ship(docs.sparkSession)
    rows = pick(docs, **{id_column: "long", text_column: "string"}).toDF("doc_id", "text")
    pieces = written(
        rows.select(id_or_last().alias("row_id"), "text").mapInPandas(
            freed(_pieces(tokenizer_path, capacity)),
            "row_id long, piece int, start long, length long, ids_crc32 long",
        ),
        "pieces",
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pieces.select(F.col("row_id").alias("doc_id"), "piece", "start", "length", "ids_crc32",
                             F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = places(complete(counts, capacity))
    spark = docs.sparkSession
    salts = spark.createDataFrame(
        [(length, -(-n // RANKED)) for length, n in counts.items()], "length long, salts int"
    )  # at most ``capacity`` rows
    salted = pieces.join(F.broadcast(salts), "length").withColumn(
        "salt", F.pmod(F.xxhash64("row_id", "piece", "ids_crc32"), F.col("salts")).cast("int")
    ).drop("salts")
    begins, total = {}, {}
    for r in salted.groupBy("length", "salt").agg(F.count("*").alias("n")).orderBy("length", "salt").collect():
        begins[r["length"], r["salt"]] = total.get(r["length"], 0)
        total[r["length"]] = total.get(r["length"], 0) + r["n"]
    ranked = salted.withColumn(
        "rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row_id", "piece"))
    )
    done = ranked.select("row_id", "piece", "start", "length", "ids_crc32", "salt", "rank").mapInPandas(
        _placed(table, begins),
        "row_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
    return done.select(
        F.when(F.col("row_id") != NO_ID, F.col("row_id")).alias("doc_id"),
        "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
    )
