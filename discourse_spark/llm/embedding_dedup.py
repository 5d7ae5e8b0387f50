"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Centres are fitted on a bounded sample of ``SAMPLE`` vectors; every vector is then
assigned to its nearest centre. Two unit vectors at cosine ``c`` or more lie within
``r = sqrt(2 - 2 c)``. If one is nearest to centre i and the other to centre j, then
neither can be further from the plane halfway between them than r:
``x . ci - x . cj <= r |ci - cj|``. So two cells only compare the vectors on both
sides for which that holds, and no pair is missed.

The vectors of a cell are written once, in files of at most ``BLOCK``. A task holds a group
of blocks and reads those of another group one by one, so no vector is sent or stored once
per cell it may have a partner in. Products are taken of sketches first: the main directions
and the length of what they leave out. By Cauchy and Schwarz they are never below the
cosine, so whole vectors are only multiplied where a sketch says that they may be near.

A task returns a count for each vector and the edges of a spanning forest, not the pairs.
Equal vectors are taken together first and weigh as many as they are.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discourse_spark.llm import files
from discourse_spark.llm.common import (
    NO_ID, _file_system, _path, freed, id_or_last, pick, position, written,
)
from discourse_spark.llm.graph import components
from discourse_spark.session import shared_folder

COSINE = 0.95
SAMPLE = 20_000
CELL_ROWS = 2_000  # wanted vectors in a cell
MOST_CELLS = 1_024
ROUNDS = 12
BLOCK = 2_048
TILE = 512
SKETCH = 16
GROUP_BYTES = 96 << 20  # of the vectors that a task holds
SLACK = 1e-5  # more than single precision loses


def unit(rows: np.ndarray) -> np.ndarray:
    """Finite rows that are not zero scaled to length one, in double precision."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centres of at most ``k`` cells; far points are picked as first centres."""
    random = np.random.default_rng(seed)
    centres = [rows[random.integers(len(rows))]]
    nearest = rows @ centres[0]
    while len(centres) < min(k, len(rows)):
        distance = np.maximum(1.0 - nearest, 0.0)
        if distance.sum() <= 1e-9:
            break
        pick_at = random.choice(len(rows), p=distance / distance.sum())
        centres.append(rows[pick_at])
        nearest = np.maximum(nearest, rows @ rows[pick_at])
    centres = np.stack(centres)
    for _ in range(rounds):
        cell = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, rows)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def _raw(kind: str):
    """Usable vectors as bytes of the type they came in, null for the others."""

    def raw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vectors = part.column(1)
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
            starts = np.cumsum(sizes) - sizes
            found: list[bytes | None] = [None] * len(sizes)
            for width in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == width)
                rows = flat[starts[at][:, None] + np.arange(width)].astype(kind)
                good = np.isfinite(rows).all(axis=1) & rows.any(axis=1)
                for i, row in zip(at[good], rows[good]):
                    found[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["row_id", "raw"])

    return raw


def _homes(centres: np.ndarray, parts_of: np.ndarray, kind: str):
    """Add the nearest cell, one of its parts, and the cosine to its centre."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                some = batch.slice(first, 4096)
                raw = b"".join(some.column(some.schema.get_field_index("raw")).to_pylist())
                near = unit(np.frombuffer(raw, dtype=kind).reshape(some.num_rows, -1)) @ centres.T
                cell = np.argmax(near, axis=1)
                check = some.column(some.schema.get_field_index("check")).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(cell, pa.int32()), pa.array(check % parts_of[cell], pa.int32()),
                     pa.array(near[np.arange(len(cell)), cell])],
                    names=[*some.schema.names, "cell", "part", "own"],
                )

    return homes


def _placed(folder: str, block: int):
    """Write the vectors of a part of a cell in files; what comes back has no vectors."""

    def placed(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["node", "check"])
        piece = np.arange(len(part)) // block
        for k in range(piece[-1] + 1):
            some = part.iloc[k * block : (k + 1) * block]
            files.put(folder, f"{key[0]}-{key[1]}-{k}.bin", [
                b"".join(some["raw"]), some["node"].to_numpy().astype("<i8").tobytes(),
                some["weight"].to_numpy().astype("<i8").tobytes(),
            ])
        return part.drop(columns="raw").assign(piece=piece.astype(np.int32))

    return placed


class _Rows:
    """The vectors of a block, their sketches, ids and weights."""

    def __init__(self, data: bytes, width: int, kind: str, centre: np.ndarray, directions: np.ndarray | None):
        n = len(data) // (width * np.dtype(kind).itemsize + 16)
        self.nodes, self.weights = np.frombuffer(data, "<i8", 2 * n, len(data) - 16 * n).reshape(2, n)
        self.whole = unit(np.frombuffer(data, kind, n * width).reshape(n, width))
        self.single = self.whole.astype(np.float32)
        self.own = self.single @ centre
        self.counts = np.zeros(n, dtype=np.int64)
        self.sketch = self.single
        if directions is not None:
            along = self.whole @ directions
            rest = np.sqrt(np.maximum(1 - (along * along).sum(axis=1, keepdims=True), 0))
            self.sketch = np.hstack([along, rest]).astype(np.float32)


class _Forest:
    """Smallest known id of each id's component, joined by links."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.unique(ids)
        self.label = np.arange(len(self.ids))

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = np.searchsorted(self.ids, a), np.searchsorted(self.ids, b)
        while True:
            low, high = np.minimum(self.label[a], self.label[b]), np.maximum(self.label[a], self.label[b])
            if not (low != high).any():
                return
            np.minimum.at(self.label, high, low)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.ids[child], self.ids[self.label[child]]


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    forest = _Forest(np.concatenate([a, b]))
    forest.join(a, b)
    return forest.edges()


def _true(few: np.ndarray) -> np.ndarray:
    """Places of the few true entries of a matrix, found eight at a time."""
    flat = few.ravel()
    whole = len(flat) & ~7
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    places = np.concatenate([(words[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(flat))])
    return places[flat[places]]


def _links(a: _Rows, b: _Rows, in_a: np.ndarray, in_b: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near vectors among the given ones, a tile at a time."""
    for i in range(0, len(in_a), TILE):
        some = in_a[i : i + TILE]
        sketch = a.sketch[some]
        for j in range(0, len(in_b), TILE):
            other = in_b[j : j + TILE]
            may = _true(sketch @ b.sketch[other].T >= cosine - SLACK)
            if len(may) * 20 > len(some) * len(other):
                x, y = np.nonzero(a.whole[some] @ b.whole[other].T >= cosine)
                x, y = some[x], other[y]
            else:
                x, y = some[may // len(other)], other[may % len(other)]
                near = (a.whole[x] * b.whole[y]).sum(axis=1) >= cosine
                x, y = x[near], y[near]
            if len(x):
                yield x, y


def _compared_groups(folder: str, width: int, kind: str, cosine: float, centres: np.ndarray,
                     directions: np.ndarray | None, names: list[str], cells: np.ndarray, spread: np.ndarray,
                     starts: list[int]):
    """Links between all blocks of two groups; pairs of groups are numbered from 0."""
    radius, limit = math.sqrt(max(0.0, 2 - 2 * cosine)), math.acos(min(1.0, max(-1.0, cosine)))
    single = centres.astype(np.float32)

    def read(i: int) -> _Rows:
        return _Rows(files.get(folder, names[i]), width, kind, single[cells[i]], directions)

    def pair(number: int) -> pa.RecordBatch:
        last = int((math.sqrt(8 * number + 1) - 1) / 2)
        while last * (last + 1) // 2 > number:
            last -= 1
        while (last + 1) * (last + 2) // 2 <= number:
            last += 1
        first = number - last * (last + 1) // 2
        held: dict[int, _Rows] = {}
        nodes, counts, ends = [], [], (np.zeros(0, np.int64), np.zeros(0, np.int64))
        pending, some = [], 0
        for j in range(starts[last], starts[last + 1]):
            mine = np.arange(starts[first], min(starts[first + 1], j + 1))
            apart = np.arccos(np.clip(centres[cells[mine]] @ centres[cells[j]], -1, 1))
            mine = mine[(cells[mine] == cells[j]) | (apart <= spread[mine] + spread[j] + limit + SLACK)]
            if not len(mine):
                continue
            b = held[j] if j in held else read(j)
            if first == last:
                held[j] = b
            for i in mine.tolist():
                a = held.get(i)
                if a is None:
                    a = held[i] = read(i)
                in_a, in_b = np.arange(len(a.nodes)), np.arange(len(b.nodes))
                if cells[i] != cells[j]:
                    gap = radius * np.linalg.norm(centres[cells[i]] - centres[cells[j]]) + SLACK
                    in_a = in_a[a.own - a.single @ single[cells[j]] <= gap]
                    in_b = in_b[b.own - b.single @ single[cells[i]] <= gap]
                for x, y in _links(a, b, in_a, in_b, cosine):
                    a.counts += np.bincount(x, b.weights[y], len(a.nodes)).astype(np.int64)
                    if i != j:
                        b.counts += np.bincount(y, a.weights[x], len(b.nodes)).astype(np.int64)
                    edges = (a.nodes[x], b.nodes[y])
                    pending.append(_spanning(*edges) if len(x) > TILE else edges)
                    some += len(pending[-1][0])
                    if some > 1 << 20:
                        ends = _spanning(*(np.concatenate(e) for e in zip(ends, *pending)))
                        pending, some = [], 0
            if first != last:
                nodes.append(b.nodes)
                counts.append(b.counts)
        for a in held.values():
            nodes.append(a.nodes)
            counts.append(a.counts)
        child, root = _spanning(*(np.concatenate(e) for e in zip(ends, *pending)))
        node, count = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (nodes, counts))
        node, count = node[count > 0], count[count > 0]
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([node, child])),
            pa.array(np.concatenate([count, np.zeros(len(child), dtype=np.int64)])),
            pa.array(np.concatenate([np.full(len(node), NO_ID), root])),
        ], names=["node", "links", "root"])

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for number in part.column(0).to_pylist():
                yield pair(number)

    return freed(compare)


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                    cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Null, empty and zero vectors, and those with null or non-finite components, link
    with nothing; vectors of another width than others link among themselves only.
    Rows that repeat an id are rows of their own; their component is that id or a
    smaller one. A null id is larger than any other and comes back as null.
    """
    given = vectors.schema[position(vectors.columns, vector_column)].dataType
    plain = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    kind = "<f4" if plain else "<f8"
    rows = pick(vectors, **{id_column: "long", vector_column: "array<float>" if plain else "array<double>"})
    rows = rows.toDF("vec_id", "embedding").select(id_or_last("vec_id").alias("row_id"), "embedding")
    raw = rows.mapInArrow(_raw(kind), "row_id long, raw binary").withColumns({
        # two hashes stand for a vector where only its copies are wanted
        "node": F.when(F.col("raw").isNotNull(), F.xxhash64("raw")),
        "check": F.when(F.col("raw").isNotNull(), F.xxhash64(F.lit(7), "raw")),
    })
    keys = written(raw.select("row_id", "node", "check", F.length("raw").alias("bytes")), "keys")
    usable = raw.where("raw is not null")
    widths = [r.bytes for r in keys.where("bytes is not null").select("bytes").distinct().limit(65).collect()]
    if len(widths) > 64:
        raise ValueError("vectors of more than 64 widths")
    pieces = [
        _compared(usable.where(F.length("raw") == w), keys.where(F.col("bytes") == w), w, kind, cosine) for w in widths
    ]
    answers = _labelled(keys.where("bytes is not null"), pieces)
    # ties of equal vectors: each copy links with all the others of its class
    return (
        keys.join(answers, ["node", "check"], "left")
        .select(
            F.when(F.col("row_id") != NO_ID, F.col("row_id")).alias("vec_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "row_id").alias("component"), "row_id",
        )
        .select(
            "vec_id", "n_links",
            F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"),
            (F.col("row_id") == F.col("component")).alias("kept"),
        )
    )


def _compared(usable: DataFrame, keys: DataFrame, size: int, kind: str, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(node, check, row_id, weight) of all classes of one vector width, and (node, links, root) rows."""
    spark = usable.sparkSession
    width = size // np.dtype(kind).itemsize
    n = keys.select("node", "check").distinct().count()
    share = math.ceil(min(1.0, SAMPLE / n) * (1 << 20))
    sample = usable.where(F.pmod("node", F.lit(1 << 20)) < share).select("node", "raw").distinct()
    picked = sample.orderBy("node").limit(SAMPLE).select("raw").collect() or usable.select("raw").limit(1).collect()
    rows = unit(np.frombuffer(b"".join(bytes(r.raw) for r in picked), dtype=kind).reshape(len(picked), width))
    centres = spherical_kmeans(rows, min(MOST_CELLS, max(1, round(n / CELL_ROWS))))
    directions = np.linalg.eigh(rows.T @ rows)[1][:, -(SKETCH - 1):] if width > 2 * SKETCH else None
    likely = np.bincount(np.argmax(rows @ centres.T, axis=1), minlength=len(centres)) * (n / len(rows))
    parts_of = np.maximum(1, np.ceil(likely / BLOCK)).astype(np.int64)

    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    classes = usable.groupBy("raw").agg(
        F.min("row_id").alias("row_id"), F.count("*").alias("weight"),
        F.first("node").alias("node"), F.first("check").alias("check"),
    )
    narrow = "row_id long, weight long, node long, check long, cell int, part int, own double"
    homes = classes.mapInArrow(_homes(centres, parts_of, kind), f"raw binary, {narrow}")
    classes = written(
        homes.groupBy("cell", "part").applyInPandas(_placed(folder, BLOCK), f"{narrow}, piece int"), "classes"
    )
    _file_system(spark, folder).deleteOnExit(_path(spark, folder))
    blocks = classes.groupBy("cell", "part", "piece").agg(F.count("*").alias("n"), F.min("own").alias("own"))
    blocks = blocks.orderBy("cell", "part", "piece").collect()
    most = max(BLOCK, min(-(-n // 8), GROUP_BYTES // (12 * width)))
    starts, held = [0], 0
    for i, b in enumerate(blocks):
        if held and held + b.n > most:
            starts, held = [*starts, i], 0
        held += b.n
    groups = len(starts)
    pairs = groups * (groups + 1) // 2
    compared = spark.range(0, pairs, 1, pairs).mapInArrow(
        _compared_groups(
            folder, width, kind, cosine, centres, directions, [f"{b.cell}-{b.part}-{b.piece}.bin" for b in blocks],
            np.array([b.cell for b in blocks]), np.arccos(np.clip([b.own for b in blocks], -1, 1)), [*starts, len(blocks)],
        ),
        "node long, links long, root long",
    )
    return classes.select("node", "check", "row_id", "weight"), written(compared, "compared")


def _labelled(keys: DataFrame, pieces: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(node, check, n_links, component_id) of each class."""
    if not pieces:
        return keys.select("node", "check", F.lit(0).alias("n_links"), F.col("row_id").alias("component_id"))
    classes, compared = pieces[0]
    for some, piece in pieces[1:]:
        classes, compared = classes.union(some), compared.union(piece)
    counts = compared.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(compared.where(F.col("root") != NO_ID).select(
        F.col("node").alias("a"), F.col("root").alias("b")
    ))
    nodes = (
        classes
        .join(counts, "node", "left")
        .join(found, F.col("node") == F.col("id"), "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select("node", "check", "row_id", "component", (F.greatest(F.coalesce("links", F.lit(1)), F.col("weight")) - 1).alias("n_links"))
    )
    nodes = written(nodes, "nodes")
    smallest = nodes.groupBy("component").agg(F.min("row_id").alias("component_id"))
    return nodes.join(smallest, "component").select("node", "check", "n_links", "component_id")
