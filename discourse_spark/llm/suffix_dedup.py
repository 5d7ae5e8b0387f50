"""Removal of passages that repeat across documents, by blockwise suffix sorting.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document
with a smaller id. To sort the suffixes of the whole corpus would move many times its
size, so suffixes that no other document can share are left out first, without loss:

1. Every window of SPAN bytes is named by the smallest hash of the GRAM-byte strings in
   it. Equal windows have equal names, and neighbouring windows mostly share one, so a
   run of windows with one name is the unit from here on.
2. Names that occur in one document only are dropped; each group of documents learns
   which of its names others have too.
3. Runs with such names go with their bytes to the bucket of their name. Runs that are
   equal within a group of documents are decided there, and only the one with the
   smallest id goes on, so copies do not pile up. Names of very many documents are
   dealt by single windows instead, which spreads them.
4. Each bucket sorts its suffixes block by block (see ``suffix_sort``). Suffixes that
   agree in SPAN bytes stand together; all but those with the smallest id are removed.

Steps 2 to 4 run per group of documents or per bucket, whose sizes do not grow with the
input. Texts travel compressed, twice to their groups for names and runs and once for
the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discourse_spark.llm.common import NO_ID, freed, plain_columns, position, text_batches, written
from discourse_spark.llm.suffix_sort import equal_runs, leading_words, sample_ranks, sorted_buckets
from discourse_spark.llm.words import BASE, BYTE_VALUES, mix, span_hashes

SPAN = 50
GRAM = 24  # 8 + 16, as the hashing below doubles
GROUP_BYTES = 8 << 20  # texts in a group of documents
CHUNK = 1 << 20  # bytes hashed at once
BLOCK = 1 << 20  # bytes of runs sorted at once
LEVEL = 3  # of the compression in which texts travel
HOT = 2_000  # occurrences of one name from which its windows are dealt singly

_LOW48 = np.uint64((1 << 48) - 1)


def window_names(buffer: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The smallest gram hash in each window of ``span`` bytes."""
    h, width = BYTE_VALUES[buffer], 1
    eight = None
    while width < 16:
        h = h[: len(h) - width] * np.uint64(pow(BASE, width, 1 << 64)) + h[width:]
        width *= 2
        if width == 8:
            eight = h
    n = len(buffer) - GRAM + 1
    low = mix(h[:n] * np.uint64(pow(BASE, 8, 1 << 64)) + eight[16 : 16 + n])
    count, reach = span - GRAM + 1, 1
    while 2 * reach <= count:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    rest = count - reach
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def chunks(texts: list[bytes], span: int = SPAN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of texts that are long enough, about CHUNK bytes at a time.

    Yields (buffer, starts in the buffer, text number, offset in the text). A long text
    is cut into pieces that overlap by span - 1 bytes, so each window is in one piece.
    """
    pieces, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text) - span + 1, CHUNK):
            piece = text[at : at + CHUNK + span - 1]
            pieces.append((piece, k, at))
            size += len(piece)
            if size >= CHUNK:
                yield _joined(pieces)
                pieces, size = [], 0
    if pieces:
        yield _joined(pieces)


def _joined(pieces):
    lengths = np.array([len(p) for p, _, _ in pieces])
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return (np.frombuffer(b"".join(p for p, _, _ in pieces), dtype=np.uint8), starts,
            np.array([k for _, k, _ in pieces]), np.array([at for _, _, at in pieces]))


def runs(buffer: np.ndarray, starts: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, number of windows) of each run of windows with one name."""
    names = window_names(buffer, span)
    marks = np.zeros(len(buffer) + 1, dtype=np.int32)
    np.add.at(marks, starts[:-1], 1)
    np.add.at(marks, starts[1:] - span + 1, -1)
    inside = np.cumsum(marks[: len(names)]) > 0
    same = inside[1:] & inside[:-1] & (names[1:] == names[:-1])
    first = inside.copy()
    first[1:] &= ~same
    last = inside.copy()
    last[:-1] &= ~same
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    return names[begin], begin, end - begin + 1


def _texts(table: pa.Table) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(z) for z in table.column("packed").to_pylist()]


def _press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _slim(values: np.ndarray, flags: np.ndarray) -> bytes:
    """Six bytes of each value and one byte of each flag, place by place: of sorted values the
    first places hardly change from one to the next."""
    low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
    return _press(np.ascontiguousarray(low.T).tobytes() + flags.astype(np.uint8).tobytes())


def _unslim(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = _unpress(data)
    n = len(data) // 7
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(data, dtype=np.uint8, count=6 * n).reshape(6, n).T
    return wide.view("<u8").ravel().astype(np.uint64), np.frombuffer(data, dtype=np.uint8, offset=6 * n)


def _planes(array: np.ndarray) -> bytes:
    """A column of numbers or bytes, compressed; numbers place by place."""
    places = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1)
    return _press(np.ascontiguousarray(places.T).tobytes())


def _column(parts: list[bytes], kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    plain = [np.frombuffer(_unpress(p), dtype=np.uint8).reshape(width, -1).T for p in parts]
    return np.ascontiguousarray(np.concatenate(plain)).view(kind).ravel() if plain else np.zeros(0, dtype=kind)


def _split(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each name and what is left of it within the bucket, 48 bits."""
    return names % np.uint64(buckets), (names // np.uint64(buckets)) & _LOW48


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    values, first = np.unique(bucket[order], return_index=True)
    for value, at in zip(values.tolist(), np.split(order, first[1:])):
        yield int(value), at


def _names_of(buckets: int, span: int):
    """For each group of documents: its names, with how often several documents have each."""

    def names(table: pa.Table) -> pa.Table:
        rows = table.column("row_id").to_numpy()
        found, owner = [], []
        for buffer, starts, text, _ in chunks(_texts(table), span):
            name, begin, _ = runs(buffer, starts, span)
            found.append(name)
            owner.append(rows[text[np.searchsorted(starts, begin, side="right") - 1]])
        out = {"key": [], "g": [], "names": []}
        if found:
            name, owner = np.concatenate(found), np.concatenate(owner)
            order = np.argsort(name)
            name, owner = name[order], owner[order]
            begin = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            times = np.minimum(np.diff(np.append(begin, len(name))), 255)
            several = np.maximum.reduceat(owner, begin) > np.minimum.reduceat(owner, begin)
            documents = np.where(several, times, 1)
            bucket, rest = _split(name[begin], buckets)
            for key, at in _by_bucket(bucket):
                out["key"].append(key)
                out["g"].append(table.column("g")[0].as_py())
                out["names"].append(_slim(rest[at], documents[at]))
        return pa.table(out, schema=pa.schema([("key", pa.int64()), ("g", pa.int64()), ("names", pa.binary())]))

    return names


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket of names: for each group those that two documents have, with a mark
    on those of very many."""
    parts = [_unslim(x) for x in table.column("names").to_pylist()]
    name = np.concatenate([p[0] for p in parts])
    documents = np.concatenate([p[1] for p in parts]).astype(np.int64)
    order = np.argsort(name, kind="stable")
    begin = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
    total = np.empty(len(name), dtype=np.int64)
    total[order] = np.repeat(np.add.reduceat(documents[order], begin), np.diff(np.append(begin, len(name))))
    groups, out, at = table.column("g").to_pylist(), {"g": [], "key": [], "names": []}, 0
    key = table.column("key")[0].as_py()
    for g, (own, _) in zip(groups, parts):
        sum_of = total[at : at + len(own)]
        at += len(own)
        if (keep := sum_of >= 2).any():
            out["g"].append(g)
            out["key"].append(key)
            out["names"].append(_slim(own[keep], sum_of[keep] > HOT))
    return pa.table(out, schema=pa.schema([("g", pa.int64()), ("key", pa.int64()), ("names", pa.binary())]))


_SENT = "kind int, key long, g long, n long, name binary, row binary, owner binary, start binary, count binary, body binary"
_SENT_ARROW = pa.schema([
    ("kind", pa.int32()), ("key", pa.int64()), ("g", pa.int64()), ("n", pa.int64()),
    *[(c, pa.binary()) for c in ("name", "row", "owner", "start", "count", "body")],
])


def _numbers(table: pa.Table) -> np.ndarray:
    """The number of each row within its group, by its hash. Equal rows share one."""
    return np.unique(table.column("rid").to_numpy(), return_inverse=True)[1].astype(np.int64)


def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one range after the other."""
    offsets = np.concatenate(([0], np.cumsum(length)))
    return np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])


def _send(buckets: int, span: int):
    """For each group: runs whose name others share, and spans decided within the group."""

    def send(table: pa.Table, shared: pa.Table) -> pa.Table:
        out = {name: [] for name in _SENT_ARROW.names}
        if not table.num_rows or not shared.num_rows:
            return pa.table(out, schema=_SENT_ARROW)
        wanted, hot = [], []
        for key, data in zip(shared.column("key").to_pylist(), shared.column("names").to_pylist()):
            rest, mark = _unslim(data)
            wanted.append((rest << np.uint64(16)) ^ np.uint64(key & 0xFFFF))
            hot.append(mark)
        wanted, hot = np.concatenate(wanted), np.concatenate(hot)
        order = np.argsort(wanted, kind="stable")
        wanted, hot = wanted[order], hot[order] > 0
        rows, owners = _numbers(table), table.column("row_id").to_numpy()
        g = table.column("g")[0].as_py()
        found = []
        for buffer, starts, text, offset in chunks(_texts(table), span):
            name, begin, count = runs(buffer, starts, span)
            bucket, rest = _split(name, buckets)
            key = (rest << np.uint64(16)) ^ (bucket & np.uint64(0xFFFF))
            at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            keep = wanted[at] == key
            name, begin, count, single = name[keep], begin[keep], count[keep], hot[at[keep]]
            if single.any():
                each = np.flatnonzero(single)
                windows = _spread(begin[each], count[each])
                name = np.concatenate([name[~single], span_hashes(buffer, windows, windows + span)])
                begin = np.concatenate([begin[~single], windows])
                count = np.concatenate([count[~single], np.ones(len(windows), dtype=count.dtype)])
            if not len(begin):
                continue
            piece = np.searchsorted(starts, begin, side="right") - 1
            length = count + span - 1
            found.append((
                name, span_hashes(buffer, begin, begin + length), rows[text[piece]], owners[text[piece]],
                begin - starts[piece] + offset[piece], count, buffer[_spread(begin, length)],
            ))
        if not found:
            return pa.table(out, schema=_SENT_ARROW)
        name, content, row, owner, start, count = (np.concatenate([f[k] for f in found]) for k in range(6))
        body = np.concatenate([f[6] for f in found])
        length = count + span - 1
        body_at = np.concatenate(([0], np.cumsum(length)))[:-1]
        order = np.argsort(content)
        first = np.append(True, content[order][1:] != content[order][:-1])
        lowest = np.empty(len(order), dtype=np.int64)
        lowest[order] = np.minimum.reduceat(owner[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        gone = np.flatnonzero(owner > lowest)
        if len(gone):
            _add(out, 1, g, g, None, row[gone], None, start[gone], start[gone] + length[gone], None)
        stay = np.flatnonzero(owner == lowest)
        for key, at in _by_bucket(name[stay] % np.uint64(buckets)):
            own = stay[at]
            _add(out, 0, key, g, name[own], row[own], owner[own], start[own], count[own],
                 body[_spread(body_at[own], length[own])])
        return pa.table(out, schema=_SENT_ARROW)

    return send


def _add(out: dict, kind: int, key: int, g: int, *arrays: np.ndarray | None) -> None:
    for column, value in zip(("kind", "key", "g", "n"), (kind, key, g, len(arrays[1]))):
        out[column].append(value)
    for column, array in zip(("name", "row", "owner", "start", "count", "body"), arrays):
        out[column].append(None if array is None else _planes(array))


_SPANS = pa.schema([("g", pa.int64()), ("row", pa.binary()), ("start", pa.binary()), ("count", pa.binary())])


def _sorted_bucket(span: int):
    """Sort the suffixes of one bucket of names and return the spans to remove, by group."""

    def decide(table: pa.Table) -> pa.Table:
        read = {
            c: _column(table.column(c).to_pylist(), kind)
            for c, kind in (("name", np.uint64), ("row", np.int64), ("owner", np.int64),
                            ("start", np.int64), ("count", np.int64), ("body", np.uint8))
        }
        sizes = table.column("n").to_numpy()
        group = np.repeat(table.column("g").to_numpy(), sizes)
        length = read["count"] + span - 1
        body_at = np.concatenate(([0], np.cumsum(length)))[:-1]
        order = np.lexsort((read["owner"], read["name"]))
        name, owner = read["name"][order], read["owner"][order]
        first = np.append(True, name[1:] != name[:-1])
        begin = np.flatnonzero(first)
        several = np.maximum.reduceat(owner, begin) > np.minimum.reduceat(owner, begin)
        order = order[several[np.cumsum(first) - 1]]
        gone = [np.zeros((0, 4), dtype=np.int64)]
        for block in _blocks(order, read["name"], length):
            gone.append(_block_spans(read, group, body_at, length, block, span))
        gone = np.concatenate(gone)
        out = {"g": [], "row": [], "start": [], "count": []}
        for g, at in _by_bucket(gone[:, 0]):
            out["g"].append(g)
            for k, column in enumerate(("row", "start", "count"), 1):
                out[column].append(_planes(gone[at, k].copy()))
        return pa.table(out, schema=_SPANS)

    return decide


def _blocks(order: np.ndarray, name: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Runs in name order, cut between names into blocks of about BLOCK bytes."""
    if not len(order):
        return
    ordered = name[order]
    ends = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, len(order))
    size = np.cumsum(length[order])
    first, done = 0, 0
    for end in ends.tolist():
        if size[end - 1] - done >= BLOCK or end == len(order):
            yield order[first:end]
            first, done = end, size[end - 1]


def _block_spans(read: dict, group: np.ndarray, body_at: np.ndarray, length: np.ndarray,
                 block: np.ndarray, span: int) -> np.ndarray:
    """(group, row, start, end) of the spans to remove among the runs of one block."""
    long = length[block]
    place = np.concatenate(([0], np.cumsum(long + 4)))
    text = np.zeros(place[-1], dtype=np.uint8)
    text[_spread(place[:-1], long)] = read["body"][_spread(body_at[block], long)]
    ends = np.arange(len(block), dtype=">u4").view(np.uint8)
    text[_spread(place[:-1] + long, np.full(len(block), 4))] = ends  # no two runs end alike
    count = read["count"][block]
    positions = _spread(place[:-1], count)
    run = np.repeat(np.arange(len(block)), count)
    owner_at = np.zeros(len(text), dtype=np.int64)
    owner_at[positions] = read["owner"][block][run]
    leading = leading_words(text)
    removed = np.zeros(len(text) + 1, dtype=bool)
    for ordered in sorted_buckets(text, positions, leading, sample_ranks(leading, span)):
        begin = np.flatnonzero(equal_runs(leading, ordered, span))
        owner = owner_at[ordered]
        lowest = np.repeat(np.minimum.reduceat(owner, begin), np.diff(np.append(begin, len(ordered))))
        removed[ordered[owner > lowest]] = True
    # runs end with bytes that start no window, so spans of two runs never touch here
    edge = np.flatnonzero(removed != np.append(False, removed[:-1]))
    begin, end = edge[0::2], edge[1::2]
    of = np.searchsorted(place, begin, side="right") - 1
    start = read["start"][block][of] + begin - place[of]
    return np.stack([group[block][of], read["row"][block][of], start, start + (end - begin) + span - 1], axis=1)


def _cut(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int]:
    """The text without the given spans, and how many runs went."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])
    begin = start[new]
    stop = reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
    kept, at = [], 0
    for a, b in zip(begin.tolist(), stop.tolist()):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), len(begin)


_RESULT = (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
           ("kept_sha256", pa.string()), ("kept_text", pa.string()))


def _apply(given: list[str], keep_text: bool):
    def apply(table: pa.Table, spans: pa.Table) -> pa.Table:
        row, start, end = (
            _column(spans.column(c).to_pylist(), np.int64)
            for c in ("row", "start", "count")
        )
        order = np.argsort(row, kind="stable")
        row, start, end = row[order], start[order], end[order]
        numbers = _numbers(table)
        first, last = np.searchsorted(row, numbers), np.searchsorted(row, numbers, side="right")
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept_text": []}
        for text, a, b in zip(_texts(table), first.tolist(), last.tolist()):
            kept, n = _cut(text, start[a:b], end[a:b]) if b > a else (text, 0)
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(n)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode("utf-8", "ignore") if keep_text else None)
        added = {name: pa.array(out[name], kind) for name, kind in _RESULT}
        return pa.table({**{c: table.column(c) for c in given}, **added})

    return apply


def _packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=LEVEL)
    for part in parts:
        at = part.schema.get_field_index("text")
        packed = pa.array(
            [pack.compress(t) for *_, texts in text_batches(part.column(at)) for t in texts], pa.binary()
        )
        yield pa.RecordBatch.from_arrays(
            [packed if i == at else part.column(i) for i in range(part.num_columns)],
            names=["packed" if i == at else n for i, n in enumerate(part.schema.names)],
        )


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   span: int = SPAN, keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text, with n_bytes, n_removed, n_spans, kept_sha256
    and kept_text.

    Texts are UTF-8 bytes; null is empty, and texts shorter than ``span`` stay whole.
    Equal ids do not remove from each other, in one row or in several; a null id counts
    as the largest. With ``keep_text`` the remaining bytes come back as text, without
    bytes of characters that were cut; else kept_text is null.
    """
    if span < 32:
        raise ValueError("span must be at least 32 bytes")
    spark, names = docs.sparkSession, docs.columns
    id_at, text_at = (f"_{position(names, c)}" for c in (id_column, text_column))
    rows = plain_columns(docs)
    total = rows.agg(F.sum(F.octet_length(text_at))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    buckets = groups
    given = [c for c in rows.columns if c != text_at]
    rows = rows.select(
        *given, F.col(text_at).alias("text"),
        F.coalesce(F.col(id_at).cast("long"), F.lit(NO_ID)).alias("row_id"),
        F.xxhash64(id_at, text_at).alias("rid"),
    )
    rows = rows.withColumn("g", F.pmod("rid", F.lit(groups)))
    schema = T.StructType([
        T.StructField("packed", T.BinaryType()) if f.name == "text" else f for f in rows.schema.fields
    ])
    texts = rows.mapInArrow(freed(_packed), schema)
    slim = texts.select("g", "row_id", "rid", "packed")
    names_sent = slim.groupBy("g").applyInArrow(_names_of(buckets, span), "key long, g long, names binary")
    shared = written(
        names_sent.groupBy("key").applyInArrow(_shared, "g long, key long, names binary"), "shared"
    )
    sent = written(
        slim.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_send(buckets, span), _SENT), "runs"
    )
    sorted_spans = sent.where("kind = 0").drop("kind").groupBy("key").applyInArrow(
        _sorted_bucket(span), "g long, row binary, start binary, count binary"
    )
    spans = sent.where("kind = 1").select("g", "row", "start", "count").unionByName(sorted_spans)
    kinds = T.StructType([f for f in rows.schema.fields if f.name in given])
    for column, kind in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()),
                         ("kept_sha256", T.StringType()), ("kept_text", T.StringType())):
        kinds = kinds.add(column, kind)
    result = texts.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(_apply(given, keep_text), kinds)
    return result.toDF(*[n for i, n in enumerate(names) if f"_{i}" != text_at],
                       "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
